"""The registered queries of the page, table and cell operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Profile
from ..functions import geometry as G
from ..functions import text as X
from ..operators import cluster, dedupe, edits, lineless, raster, recognize, tables, vote
from ..session import prepare
from ..sources import projects
from . import extract
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) + F.lit(0.0) for n in names})


# ---- clusters and lineless tables

def _clusters(axis: str, source: str = "ctr", key: str = "page_id", name: str = "c") -> str:
    """SQL of gap clusters of an axis: views name_r (runs) and name (key, pos, center, n)."""
    return f"""{name}_g AS (SELECT {key}, c{axis} AS v, CASE WHEN c{axis} - lag(c{axis}) OVER (PARTITION BY {key} ORDER BY c{axis}) > 20 THEN 1 ELSE 0 END AS s FROM {source}),
{name}_r AS (SELECT {key}, v, sum(s) OVER (PARTITION BY {key} ORDER BY v, s DESC ROWS UNBOUNDED PRECEDING) AS pos FROM {name}_g),
{name} AS (SELECT {key}, CAST(pos AS BIGINT) AS pos, CAST(trunc(avg(v)) AS BIGINT) AS center, count(*) AS n FROM {name}_r GROUP BY {key}, pos)"""


def _spacing(name: str, key: str = "page_id") -> str:
    return f"""{name}_s AS (SELECT {key}, count(*) AS k, coalesce(stddev_pop(gap) / (avg(gap) + 1e-6), 0) AS cv FROM (SELECT {key}, lead(center) OVER (PARTITION BY {key} ORDER BY pos) - center AS gap FROM {name}) GROUP BY {key})"""


for _axis, _name in (("x", "columns"), ("y", "rows")):

    @query(f"gap_cluster_{_name}", f"WITH {fx.SQL['blocks']}, {_clusters(_axis)} SELECT page_id, pos, center, n FROM c")
    def _gap(spark: SparkSession, sf_dir: str, axis: str = _axis) -> DataFrame:
        return cluster.gap_clusters(lineless.centers(fx.blocks(spark, sf_dir)), ["page_id"], f"c{axis}")


def _grid_sql(source: str, key: str, keys: str, method: str) -> str:
    return f"""{_clusters('x', source, key, 'c')}, {_clusters('y', source, key, 'r')}, {_spacing('c', key)}, {_spacing('r', key)},
hull AS (SELECT {key}, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM {source} GROUP BY {key})
SELECT {keys}, x, y, w, h, r_s.k AS rows, c_s.k AS cols, CAST(0.6 AS DOUBLE) AS confidence, false AS has_lines, '{method}' AS detection_method
FROM hull JOIN c_s USING ({key}) JOIN r_s USING ({key}) WHERE hull.n >= 4 AND r_s.k >= 2 AND c_s.k >= 2 AND r_s.cv <= 0.5 AND c_s.cv <= 0.5"""


_F1A = fx.SQL["blocks"].replace(", ctr AS", ", a0 AS (SELECT * REPLACE (60 + 45 * ((l_linenumber - 1) % 4) + x5 AS x) FROM blocks), ctr AS", 1) + ", a4 AS (SELECT *, x + CAST(floor(w / 2) AS BIGINT) AS cx, y + CAST(floor(h / 2) AS BIGINT) AS cy FROM a0)"


@query("lineless_basic", f"WITH {_F1A}, {_grid_sql('a4', 'page_id', 'page_id', 'lineless_clustering')}")
def lineless_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineless.grids(fx.blocks(spark, sf_dir, in_columns=True), ["page_id"])


@query(
    "lineless_cells",
    f"""WITH {_F1A}, {_clusters('x', 'a4', name='c')}, {_clusters('y', 'a4', name='r')},
c2 AS (SELECT page_id, pos AS col, center - 20 AS x, coalesce(lead(center) OVER (PARTITION BY page_id ORDER BY pos) - center + 40, 100) AS w FROM c),
r2 AS (SELECT page_id, pos AS row, center - 10 AS y, coalesce(lead(center) OVER (PARTITION BY page_id ORDER BY pos) - center + 20, 40) AS h FROM r)
SELECT page_id, row, col, x, y, w, h FROM r2 JOIN c2 USING (page_id)""",
)
def lineless_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineless.grid_cells(fx.blocks(spark, sf_dir, in_columns=True), ["page_id"])


_EDGES = """pr AS (SELECT a.page_id, a.block_id AS src, b.block_id AS dst, abs(a.cx - b.cx) AS dx, abs(a.cy - b.cy) AS dy, (a.h + b.h) // 2 + 10 AS lh, (a.w + b.w) // 2 + 10 AS lw FROM ctr a JOIN ctr b ON a.page_id = b.page_id AND a.block_id < b.block_id),
edges AS (SELECT page_id, src, dst, sqrt(dx * dx + dy * dy) AS dist, CASE WHEN dy < lh AND NOT dx < lw THEN 'h' WHEN dx < lw AND NOT dy < lh THEN 'v' ELSE 'b' END AS kind FROM pr WHERE (dy < lh OR dx < lw) AND sqrt(dx * dx + dy * dy) < 50)"""
_COMPONENTS = """both_ AS (SELECT page_id, src, dst FROM edges UNION SELECT page_id, dst, src FROM edges),
reach(page_id, block_id, root) AS (SELECT DISTINCT page_id, src, src FROM both_ UNION SELECT r.page_id, b.dst, r.root FROM reach r JOIN both_ b ON b.page_id = r.page_id AND b.src = r.block_id WHERE b.dst > r.root),
comp AS (SELECT page_id, block_id, min(root) AS component FROM reach GROUP BY ALL)"""


@query("adjacency_edges", f"WITH {fx.SQL['blocks']}, {_EDGES} SELECT page_id, src, dst, round(dist, 6) AS dist, kind FROM edges")
def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lineless.adjacency(fx.blocks(spark, sf_dir)), "dist")


@query("grid_components", f"WITH RECURSIVE {fx.SQL['blocks']}, {_EDGES}, {_COMPONENTS} SELECT page_id, block_id, component FROM comp")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineless.block_components(fx.blocks(spark, sf_dir)).select("page_id", "block_id", "component")


@query(
    "lineless_graph",
    f"WITH RECURSIVE {fx.SQL['blocks']}, {_EDGES}, {_COMPONENTS}, g AS (SELECT ctr.*, page_id * 100000 + component AS gid, component FROM ctr JOIN comp USING (page_id, block_id)), {_grid_sql('g', 'gid', 'gid // 100000 AS page_id, gid % 100000 AS component', 'lineless_graph')}",
)
def lineless_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineless.graph_tables(fx.blocks(spark, sf_dir))


@query(
    "grid_score",
    f"WITH {fx.SQL['blocks']}, {_clusters('x', name='c')}, {_clusters('y', name='r')}, {_spacing('c')}, {_spacing('r')} SELECT page_id, round(CASE WHEN r_s.k < 2 OR c_s.k < 2 THEN 0 ELSE 1 - least((r_s.cv + c_s.cv) / 2, 1) END, 6) + 0.0 AS score FROM r_s JOIN c_s USING (page_id)",
)
def grid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lineless.centers(fx.blocks(spark, sf_dir))
    return _rounded(cluster.grid_score(cluster.gap_clusters(b, ["page_id"], "cy"), cluster.gap_clusters(b, ["page_id"], "cx"), ["page_id"]), "score")


@query(
    "line_peaks",
    f"""WITH {fx.SQL['pages']}, v AS (SELECT page_id, CAST((l_partkey % 30) * 10 AS INT) AS pos, sum(255 * (1 + l_quantity)) AS v FROM li GROUP BY ALL),
g AS (SELECT page_id, pos, coalesce(v, 0) AS value FROM (SELECT DISTINCT page_id FROM li) CROSS JOIN (SELECT CAST(i AS INT) AS pos FROM range(300) r(i)) LEFT JOIN v USING (page_id, pos)),
s AS (SELECT page_id, pos, sum(value) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / max(value) OVER (PARTITION BY page_id) / 3 AS s FROM g),
e AS (SELECT *, CASE WHEN s > 0.15 AND NOT coalesce(lag(s) OVER (PARTITION BY page_id ORDER BY pos) > 0.15, false) THEN 1 ELSE 0 END AS e FROM s),
n AS (SELECT *, sum(e) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM e),
b AS (SELECT page_id, run, arg_min(pos, struct_pack(a := -s, b := pos)) AS p FROM n WHERE s > 0.15 GROUP BY ALL),
l AS (SELECT page_id, list(p ORDER BY p) AS l FROM b GROUP BY page_id),
f AS (SELECT page_id, (CASE WHEN l[1] > 10 THEN [0] ELSE [] END) || l || (CASE WHEN l[-1] < 290 THEN [299] ELSE [] END) AS l FROM l),
k AS (SELECT page_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 6 THEN a || x ELSE a END) AS l FROM f)
SELECT page_id, list_aggregate(list_transform(l, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS peaks FROM k""",
)
def line_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cluster.line_peaks(fx.profiles(spark, sf_dir), ["page_id"])
    return made.select("page_id", F.array_join(F.transform("peaks", lambda p: p.cast("string")), ",").alias("peaks"))


# ---- detections

_IOU = "CASE WHEN least({a}.x + {a}.w, {b}.x + {b}.w) < greatest({a}.x, {b}.x) OR least({a}.y + {a}.h, {b}.y + {b}.h) < greatest({a}.y, {b}.y) THEN 0 ELSE (least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) / CAST({a}.w * {a}.h + {b}.w * {b}.h - (least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) AS DOUBLE) END"
_DET = fx.SQL["detections"]


def _nms(order: str) -> str:
    """SQL of suppression: st holds the kept det_ids of a page after each rank."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}, det_id) AS rk FROM det),
l AS (SELECT page_id, list(struct_pack(det_id := det_id, x := x, y := y, w := w, h := h) ORDER BY rk) AS l FROM o GROUP BY page_id),
kept_l AS (SELECT page_id, list_reduce(list_transform(l, lambda d: [d]), lambda a, d: CASE WHEN len(list_filter(a, lambda k: {_IOU.format(a='k', b='d[1]')} > 0.3)) > 0 THEN a ELSE a || d END) AS k FROM l),
kept AS (SELECT page_id, unnest(k).det_id AS det_id FROM kept_l)"""


@query("iou_pairs", f"WITH {_DET}, p AS (SELECT a.page_id, a.det_id AS a, b.det_id AS b, {_IOU.format(a='a', b='b')} AS iou FROM det a JOIN det b ON a.page_id = b.page_id AND a.det_id < b.det_id) SELECT page_id, a, b, round(iou, 6) AS iou FROM p WHERE iou > 0.3")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dedupe.pairs(fx.detections(spark, sf_dir)), "iou")


@query("nms_dedupe", f"WITH {_DET}, {_nms('confidence DESC')} SELECT page_id, det_id, round(confidence, 6) AS confidence FROM kept JOIN det USING (page_id, det_id)")
def nms_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dedupe.suppress(fx.detections(spark, sf_dir)), "confidence").select("page_id", "det_id", "confidence")


@query(
    "merge_overlapping",
    f"""WITH {_DET}, {_nms('confidence DESC, rows * cols DESC')}, ko AS (SELECT o.* FROM o JOIN kept USING (page_id, det_id)),
lost AS (SELECT d.page_id, d.det_id, min(k.rk) AS rk FROM o d JOIN ko k ON k.page_id = d.page_id AND k.rk < d.rk AND {_IOU.format(a='k', b='d')} > 0.3 WHERE (d.page_id, d.det_id) NOT IN (SELECT (page_id, det_id) FROM kept) GROUP BY ALL),
n AS (SELECT page_id, rk, count(*) AS n FROM lost GROUP BY ALL)
SELECT page_id, det_id, round(CASE WHEN n IS NULL THEN confidence ELSE least(1, confidence + 0.1 * n) END, 6) AS confidence, coalesce(n, 0) AS absorbed FROM ko LEFT JOIN n USING (page_id, rk)""",
)
def merge_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dedupe.merge(fx.detections(spark, sf_dir)), "confidence").select("page_id", "det_id", "confidence", F.col("absorbed").cast("long").alias("absorbed"))


_SPLIT = "cv AS (SELECT * FROM det WHERE det_id % 2 = 0), yo AS (SELECT * FROM det WHERE det_id % 2 = 1)"


@query(
    "confirm_boost",
    f"""WITH {_DET}, {_SPLIT}, m AS (SELECT y.page_id, y.det_id AS yid, min(c.det_id) AS det_id FROM yo y JOIN cv c ON c.page_id = y.page_id AND {_IOU.format(a='y', b='c')} > 0.5 GROUP BY ALL),
t AS (SELECT page_id, det_id, count(*) AS n FROM m GROUP BY ALL)
SELECT page_id, det_id, round(least(1, greatest(confidence, 0.8) + 0.15 * coalesce(n, 0)), 6) AS confidence, 'morphology' AS detection_method FROM cv LEFT JOIN t USING (page_id, det_id)
UNION ALL SELECT page_id, det_id, CAST(0.6 AS DOUBLE), 'hough' FROM yo WHERE (page_id, det_id) NOT IN (SELECT (page_id, yid) FROM m)""",
)
def confirm_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    made = dedupe.confirm(d.where("source = 'cv'"), d.where("source = 'yolo'"))
    return _rounded(made, "confidence").select("page_id", "det_id", "confidence", "detection_method")


@query(
    "hybrid_merge",
    f"""WITH RECURSIVE {_DET}, {_SPLIT}, co AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS k FROM cv),
pr AS (SELECT c.page_id, c.k, y.det_id AS yid, {_IOU.format(a='c', b='y')} AS v FROM co c JOIN yo y ON y.page_id = c.page_id),
ok AS (SELECT page_id, k, list(yid ORDER BY v DESC, yid) AS l FROM pr WHERE v > 0.3 GROUP BY ALL),
st(page_id, k, used, got) AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM det
  UNION ALL SELECT s.page_id, s.k + 1, CASE WHEN len(list_filter(coalesce(ok.l, []), lambda i: NOT list_contains(s.used, i))) > 0 THEN list_append(s.used, list_filter(ok.l, lambda i: NOT list_contains(s.used, i))[1]) ELSE s.used END, list_filter(coalesce(ok.l, []), lambda i: NOT list_contains(s.used, i))[1]
  FROM st s JOIN co c ON c.page_id = s.page_id AND c.k = s.k + 1 LEFT JOIN ok ON ok.page_id = s.page_id AND ok.k = s.k + 1)
SELECT c.page_id, c.det_id, round(CASE WHEN got IS NULL THEN confidence ELSE least(1, confidence + 0.15) END, 6) AS confidence, CASE WHEN got IS NULL THEN 'cv' ELSE 'hybrid_confirmed' END AS detection_method, got AS matched FROM st JOIN co c USING (page_id, k)
UNION ALL SELECT page_id, det_id, round(confidence, 6), 'yolo', NULL FROM yo WHERE (page_id, det_id) NOT IN (SELECT (page_id, got) FROM st WHERE got IS NOT NULL)""",
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    made = dedupe.match(d.where("source = 'cv'"), d.where("source = 'yolo'"))
    return _rounded(made, "confidence").select("page_id", "det_id", "confidence", "detection_method", "matched")


@query("validate_tables", f"WITH {_DET} SELECT page_id, det_id FROM det WHERE rows >= 2 AND cols >= 2 AND w * h >= CAST(trunc(700000 * 0.01) AS BIGINT) AND w * h / CAST(700000 AS DOUBLE) >= 0.01")
def validate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.valid(fx.detections(spark, sf_dir), 700_000).select("page_id", "det_id")


@query("adaptive_params", f"WITH {_DET}, s AS (SELECT page_id, max(x + w) AS w, max(y + h) AS h FROM det GROUP BY ALL) SELECT page_id, CAST(trunc(w * h * 0.01) AS BIGINT) AS min_area, greatest(w // 30, 10) AS kernel_h, greatest(h // 30, 10) AS kernel_v, greatest(50, least(w, h) // 20) AS min_line FROM s")
def adaptive_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    return dedupe.adaptive(d.groupBy("page_id").agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height")))


@query(
    "segment_classify",
    f"""WITH {fx.SQL['pages']}, s AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY {fx._LK}) AS seg_id, CASE WHEN l_partkey % 2 = 0 THEN 200 ELSE 12 * (l_linenumber - 4) END AS dx, CASE WHEN l_partkey % 2 = 0 THEN 12 * (l_linenumber - 4) ELSE 200 END AS dy FROM li),
a AS (SELECT *, abs(degrees(atan2(dy, dx))) AS a FROM s) SELECT page_id, seg_id, CASE WHEN a < 10 OR a > 170 THEN 'h' WHEN a > 80 AND a < 100 THEN 'v' END AS kind FROM a""",
)
def segment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.segment_kinds(fx.segments(spark, sf_dir)).select("page_id", "seg_id", "kind")


@query(
    "crossing_tables",
    f"""WITH {fx.SQL['pages']}, s AS (SELECT page_id, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 60 * (l_suppkey % 6) END AS x1, CASE WHEN l_partkey % 2 = 0 THEN 30 * (l_suppkey % 8) ELSE 0 END AS y1,
CASE WHEN l_partkey % 2 = 0 THEN 200 ELSE 60 * (l_suppkey % 6) + 12 * (l_linenumber - 4) END AS x2, CASE WHEN l_partkey % 2 = 0 THEN 30 * (l_suppkey % 8) + 12 * (l_linenumber - 4) ELSE 200 END AS y2 FROM li),
a AS (SELECT *, abs(degrees(atan2(y2 - y1, x2 - x1))) AS a, count(*) OVER (PARTITION BY page_id) AS n FROM s),
hs AS (SELECT page_id, least(y1, y2) AS cy FROM a WHERE n >= 4 AND (a < 10 OR a > 170)), vs AS (SELECT page_id, least(x1, x2) AS cx FROM a WHERE n >= 4 AND a > 80 AND a < 100),
{_clusters('y', 'hs', 'page_id', 'r')}, {_clusters('x', 'vs', 'page_id', 'c')},
rr AS (SELECT page_id, min(center) AS y, max(center) - min(center) AS h, count(*) - 1 AS rows FROM r GROUP BY page_id), cc AS (SELECT page_id, min(center) AS x, max(center) - min(center) AS w, count(*) - 1 AS cols FROM c GROUP BY page_id)
SELECT page_id, x, y, w, h, rows, cols, rows * cols AS n_cells, CAST(0.7 AS DOUBLE) AS confidence FROM rr JOIN cc USING (page_id) WHERE rows >= 2 AND cols >= 2""",
)
def crossing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.crossing_tables(fx.segments(spark, sf_dir))
    return found.select("page_id", "x", "y", "w", "h", "rows", "cols", F.size("cells").cast("long").alias("n_cells"), "confidence")


@query("hybrid_cascade", f"WITH {_DET} SELECT page_id, NOT bool_and(confidence + 0.3 * (page_id % 3) >= 0.7) AS second_look FROM det GROUP BY page_id")
def hybrid_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cascade(fx.detections(spark, sf_dir).withColumn("confidence", F.expr("confidence + 0.3D * (page_id % 3)")))


@query(
    "yolo_refine",
    f"""WITH {_DET}, r AS (SELECT * FROM det WHERE det_id % 2 = 1), i AS (SELECT page_id, det_id - 1 AS region_id, x % 20 AS x, y % 20 AS y, w // 2 AS w, h // 2 AS h, rows, cols, confidence FROM det WHERE det_id % 4 = 0)
SELECT r.page_id, r.det_id AS region_id, r.x + coalesce(i.x, 0) AS x, r.y + coalesce(i.y, 0) AS y, coalesce(i.w, r.w) AS w, coalesce(i.h, r.h) AS h, coalesce(i.rows, 1) AS rows, coalesce(i.cols, 1) AS cols,
round(CASE WHEN i.w IS NULL THEN r.confidence * 0.8 ELSE (r.confidence + i.confidence) / 2 END, 6) AS confidence, CASE WHEN i.w IS NULL THEN 'yolo_only' ELSE 'hybrid_yolo_cv' END AS detection_method FROM r LEFT JOIN i ON i.page_id = r.page_id AND i.region_id = r.det_id""",
)
def yolo_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    inner = d.where("det_id % 4 = 0").selectExpr("page_id", "det_id", "det_id - 1 AS region_id", "x % 20 AS x", "y % 20 AS y", "w div 2 AS w", "h div 2 AS h", "rows", "cols", "confidence")
    return _rounded(dedupe.refine(d.where("source = 'yolo'"), inner), "confidence")


@query(
    "extract_fallback",
    f"WITH {_DET}, f AS (SELECT page_id, det_id, 'lined' AS how FROM det WHERE confidence >= 0.7 AND page_id % 3 <> 0) SELECT * FROM f UNION ALL SELECT page_id, det_id, 'lineless' FROM det WHERE det_id <= 2 AND page_id NOT IN (SELECT page_id FROM f)",
)
def extract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.detections(spark, sf_dir)
    found = d.where("confidence >= 0.7 and page_id % 3 <> 0").select("page_id", "det_id", F.lit("lined").alias("how"))
    return dedupe.with_fallback(found, d.where("det_id <= 2").select("page_id", "det_id", F.lit("lineless").alias("how")))


@query("table_names", f"WITH {_DET}, n AS (SELECT *, 'Table_' || row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS table_name FROM det) SELECT page_id, det_id, table_name FROM n WHERE rows >= 2 AND cols >= 2")
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.named(fx.detections(spark, sf_dir)).select("page_id", "det_id", "table_name")


# ---- recognition

_ALT = fx.SQL["alternatives"]


@query("normalize_text", f"WITH {_ALT} SELECT cell_id, pos, norm FROM n")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.alternatives(spark, sf_dir).select("cell_id", "pos", X.normalized(F.col("text")).alias("norm"))


#: Longest common subsequences by a recursive table, one row for each pair and character of the first text.
_RATIO = """tx AS (SELECT DISTINCT a, b FROM (SELECT p.norm AS a, q.norm AS b FROM n p JOIN n q ON p.cell_id = q.cell_id AND p.pos < q.pos)),
dp(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(length(b) + 1), lambda x: CAST(0 AS BIGINT)) FROM tx
  UNION ALL SELECT a, b, i + 1, [CAST(0 AS BIGINT)] || list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], CASE WHEN substr(a, i + 1, 1) = substr(b, CAST(k AS INT), 1) THEN r[k] + 1 ELSE 0 END)))) FROM dp WHERE i < length(a)),
ra AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2.0::DOUBLE * r[-1] / (length(a) + length(b)) END AS ratio FROM dp WHERE i = length(a)),
pa AS (SELECT p.cell_id, p.pos AS i, q.pos AS j, ratio FROM n p JOIN n q ON p.cell_id = q.cell_id AND p.pos < q.pos JOIN ra ON ra.a = p.norm AND ra.b = q.norm),
sm AS (SELECT c.cell_id, CASE WHEN count(ratio) = 0 THEN 1 ELSE list_reduce(list(ratio ORDER BY i, j), lambda x, y: x + y) / count(ratio) END AS sim FROM (SELECT DISTINCT cell_id FROM n) c LEFT JOIN pa USING (cell_id) GROUP BY c.cell_id)"""


@query("indel_similarity", f"WITH RECURSIVE {_ALT}, {_RATIO} SELECT cell_id, round(sim, 6) AS similarity FROM sm")
def indel_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vote.similarities(fx.alternatives(spark, sf_dir)), "similarity")


@query(
    "similarity_fallback",
    f"""WITH {_ALT}, pr AS (SELECT a.cell_id, a.norm AS a, b.norm AS b FROM n a JOIN n b ON a.cell_id = b.cell_id AND a.pos = 0 AND b.pos = 1)
SELECT cell_id, round(CASE WHEN a = b THEN 1 WHEN greatest(length(a), length(b)) > 0 THEN len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, CAST(i AS INT), 1) = substr(b, CAST(i AS INT), 1))) / CAST(greatest(length(a), length(b)) AS DOUBLE) ELSE 1 END, 6) AS similarity FROM pr""",
)
def similarity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.alternatives(spark, sf_dir).select("cell_id", "pos", X.normalized(F.col("text")).alias("norm"))
    a, b = (n.where(f"pos = {i}").select("cell_id", F.col("norm").alias(c)) for i, c in ((0, "a"), (1, "b")))
    return _rounded(a.join(b, "cell_id").select("cell_id", X.positional_match(F.col("a"), F.col("b")).alias("similarity")), "similarity")


@query(
    "ocr_vote",
    f"""WITH RECURSIVE {_ALT}, {_RATIO}, g AS (SELECT cell_id, norm, count(*) AS k, min(pos) AS f FROM n GROUP BY ALL),
c AS (SELECT cell_id, count(*) AS n, count(DISTINCT norm) AS d FROM n GROUP BY ALL),
mj AS (SELECT cell_id, arg_min(norm, f) AS norm FROM g WHERE k >= 2 GROUP BY cell_id),
rg AS (SELECT c.cell_id, CASE WHEN n = 1 THEN 'single' WHEN d = 1 THEN 'all' WHEN sim > 0.8 THEN 'similar' WHEN n >= 3 AND mj.norm IS NOT NULL THEN 'majority' ELSE 'low' END AS rung, sim, mj.norm AS major FROM c JOIN sm USING (cell_id) LEFT JOIN mj USING (cell_id)),
pick AS (SELECT n.*, rung, sim, row_number() OVER (PARTITION BY n.cell_id ORDER BY CASE WHEN rung = 'low' THEN weight ELSE confidence * weight END DESC, pos) AS spot FROM n JOIN rg USING (cell_id) WHERE rung <> 'majority' OR norm = major)
SELECT cell_id, text, confidence, CASE WHEN rung = 'single' THEN confidence < 0.6 ELSE rung = 'low' END AS needs_review, round(CASE WHEN rung IN ('single', 'all') THEN 1 WHEN rung = 'majority' THEN 0.67 ELSE sim END, 6) AS agreement, rung FROM pick WHERE spot = 1""",
)
def ocr_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vote.vote(fx.alternatives(spark, sf_dir)), "agreement")


@query(
    "word_vote",
    f"""WITH {_ALT}, w AS (SELECT cell_id, pos, unnest(l) AS word, generate_subscripts(l, 1) AS spot FROM (SELECT cell_id, pos, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM alt)),
c AS (SELECT cell_id, spot, word, count(*) AS k, min(pos) AS f FROM w GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cell_id, spot ORDER BY k DESC, f) = 1)
SELECT cell_id, string_agg(word, ' ' ORDER BY spot) AS text FROM b GROUP BY cell_id""",
)
def word_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.word_vote(fx.alternatives(spark, sf_dir))


@query(
    "alternatives_ranked",
    f"""WITH {_ALT}, c AS (SELECT cell_id, text, cell_id % 4 = 3 AS disagreed FROM alt WHERE pos = 1 UNION ALL SELECT -p_partkey, p_name, false FROM part WHERE p_partkey % 50 = 0 AND p_partkey > 0),
l AS (SELECT c.cell_id, weight, pos, CASE WHEN n.text = c.text THEN '✓' ELSE ' ' END || ' ' || upper(source) || ': "' || n.text || '" (' || CAST(trunc(confidence * 100) AS INT) || '%)' AS line FROM c JOIN n USING (cell_id)),
t AS (SELECT cell_id, string_agg(line, chr(10) ORDER BY weight DESC, pos) AS said FROM l GROUP BY cell_id)
SELECT cell_id, coalesce(CASE WHEN disagreed THEN '⚠ OCR engines disagreed:' ELSE 'OCR Results:' END || chr(10) || chr(10) || said, '') AS tooltip FROM c LEFT JOIN t USING (cell_id)""",
)
def alternatives_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.ranked(fx.alternatives(spark, sf_dir), fx.cell_texts(spark, sf_dir))


@query(
    "alternative_texts",
    f"""WITH {_ALT}, c AS (SELECT cell_id, text FROM alt WHERE pos = 1), j AS (SELECT c.cell_id, c.text AS own, n.text, n.pos FROM c JOIN n USING (cell_id))
SELECT cell_id, count(*) > 1 AS has_alternatives, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (text <> own), '') AS others FROM j GROUP BY cell_id""",
)
def alternative_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.alternatives(spark, sf_dir)
    lists = a.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("a"))
    met = a.where("pos = 1").select("cell_id", "text").join(lists, "cell_id")
    return met.select("cell_id", tables.has_alternatives(F.col("a")).alias("has_alternatives"), F.array_join(tables.other_texts(F.col("a"), F.col("text")), "|").alias("others"))


@query("language_map", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE lang END || '+xx' AS tesseract, CASE lang WHEN 'de' THEN 'german' WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' ELSE 'en' END AS paddle FROM documents")
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(F.col("lang"), F.lit("xx"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.mapped_languages(codes).alias("tesseract"), X.single_language(codes).alias("paddle"))


@query("sheet_name", "SELECT p_partkey, substr(translate(p_name || '/' || p_type || '[' || p_brand || ']', '\\/*?:[]', '_______'), 1, 31) AS sheet FROM part")
def sheet_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("p_name", F.lit("/"), "p_type", F.lit("["), "p_brand", F.lit("]"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", X.sheet_name(made).alias("sheet"))


# ---- tables and cells

_CELLS = fx.SQL["cells"]
_STATS = _CELLS + ", st AS (SELECT table_id, max(row) + 1 AS rows, max(col) + 1 AS cols, count(*) AS n_cells, avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END) AS fill, avg(confidence) AS avg_confidence, bool_or(is_merged) AS has_merged, CAST(count(*) FILTER (needs_review) AS BIGINT) AS n_review, CAST(sum(w * h) AS BIGINT) AS area FROM cells GROUP BY table_id)"


@query("table_stats", f"WITH {_STATS} SELECT table_id, rows, cols, n_cells, round(fill, 6) AS fill, round(avg_confidence, 6) AS avg_confidence, has_merged, n_review, area FROM st")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tables.stats(fx.cells(spark, sf_dir)), "fill", "avg_confidence")


for _name, _step, _where in (
    ("min_area", tables.min_area(60_000), "area >= 60000"),
    ("min_size", tables.min_size(12, 7), "rows >= 12 AND cols >= 7"),
    ("min_cells", tables.min_cells(82), "n_cells >= 82"),
    ("text_fill", tables.text_fill(0.5), "round(fill, 9) >= 0.5"),
    ("min_confidence", tables.min_confidence(0.5), "round(avg_confidence, 9) >= 0.5"),
    ("default_filter", tables.default_filter, "rows >= 2 AND cols >= 2 AND area >= 5000 AND fill >= 0.1"),
):

    @query(_name, f"WITH {_STATS} SELECT table_id, n_cells FROM st WHERE {_where}")
    def _filtered(spark: SparkSession, sf_dir: str, step: tables.Step = _step) -> DataFrame:
        s = tables.stats(fx.cells(spark, sf_dir)).withColumns({n: F.round(n, 9) for n in ("fill", "avg_confidence")})
        return s.transform(step).select("table_id", "n_cells")


@query(
    "table_warnings",
    f"""WITH {_STATS} SELECT table_id, array_to_string(list_filter([CASE WHEN has_merged THEN 'Merged cells detected - data may need manual review' END, CASE WHEN round(avg_confidence, 9) < 0.6 THEN 'Low OCR confidence - verify extracted text' END,
CASE WHEN table_id % 2 = 0 THEN 'Table detected without visible lines - structure may need verification' END, CASE WHEN n_review > 0 THEN n_review || ' cells need review - OCR engines disagreed' END], lambda x: x IS NOT NULL), '|') AS warnings FROM st""",
)
def table_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.stats(fx.cells(spark, sf_dir)).withColumn("avg_confidence", F.round("avg_confidence", 9)).withColumn("has_lines", F.col("table_id") % 2 != 0)
    return tables.warnings(s).select("table_id", F.array_join("warnings", "|").alias("warnings"))


@query("merged_cells", f"WITH {_CELLS} SELECT table_id, row, col, is_merged FROM cells")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select("table_id", "row", "col", "is_merged")


@query(
    "expand_merged",
    f"""WITH {_CELLS}, s AS (SELECT table_id, row, col, text, is_merged, CASE WHEN is_merged THEN 2 ELSE 1 END AS rs, CASE WHEN needs_review THEN 3 ELSE 1 END AS cs FROM cells)
SELECT table_id, row + r AS row, col + c AS col, text, is_merged OR r + c > 0 AS is_merged FROM s, range(2) a(r), range(3) b(c) WHERE r < rs AND c < cs""",
)
def expand_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.cells(spark, sf_dir).withColumns({"row_span": F.when(F.col("is_merged"), 2).otherwise(1), "col_span": F.when(F.col("needs_review"), 3).otherwise(1)})
    return tables.expand_spans(c).select("table_id", "row", "col", "text", "is_merged")


for _axis in ("row", "col"):

    @query(f"compact_{'rows' if _axis == 'row' else 'columns'}", f"WITH {_CELLS}, k AS (SELECT table_id, {_axis}, dense_rank() OVER (PARTITION BY table_id ORDER BY {_axis}) - 1 AS p FROM (SELECT DISTINCT table_id, {_axis} FROM cells WHERE trim(text) <> '')) SELECT cells.table_id, {'p AS row, col' if _axis == 'row' else 'row, p AS col'}, text FROM cells JOIN k ON k.table_id = cells.table_id AND k.{_axis} = cells.{_axis}".replace(", k AS (", ", kk AS (").replace("JOIN k ON k.", "JOIN kk ON kk.").replace("AND k.", "AND kk."))
    def _compact(spark: SparkSession, sf_dir: str, axis: str = _axis) -> DataFrame:
        return tables.compact(fx.cells(spark, sf_dir), axis).select("table_id", "row", "col", "text")


@query(
    "compact_headers",
    f"WITH {_CELLS}, u AS (SELECT DISTINCT table_id, col FROM cells WHERE trim(text) <> '') SELECT c.table_id, row_number() OVER (PARTITION BY c.table_id ORDER BY c.index) - 1 AS index, c.name FROM columns_ c JOIN u ON u.table_id = c.table_id AND u.col = c.index",
)
def compact_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.compact_headers(fx.columns(spark, sf_dir), fx.cells(spark, sf_dir))
    return made.select("table_id", F.col("index").cast("long").alias("index"), "name")


@query(
    "filled_tables",
    f"WITH {_CELLS}, g AS (SELECT table_id, count(*) FILTER (w * h >= 1200) AS good FROM cells GROUP BY table_id) SELECT table_id, coalesce(good, 0) = 0 AND NOT EXISTS (SELECT 1 FROM cells c WHERE c.table_id = sizes.table_id) OR coalesce(good, 0) / CAST(rows * cols AS DOUBLE) >= 0.5 AS filled FROM sizes LEFT JOIN g USING (table_id)",
)
def filled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.cells(spark, sf_dir).groupBy("table_id").agg(F.collect_list(F.struct("w", "h")).alias("cells"))
    return fx.sizes(spark, sf_dir).join(c, "table_id", "left").select("table_id", dedupe.filled(F.col("cells"), 1200).alias("filled"))


@query("row_slice", f"WITH {_CELLS} SELECT table_id, col, text FROM cells WHERE row = 3")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.row_slice(fx.cells(spark, sf_dir), 3).drop("pos")


@query("column_slice", f"WITH {_CELLS} SELECT table_id, row, text FROM cells WHERE col = 2")
def column_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_slice(fx.cells(spark, sf_dir), 2).drop("pos")


@query("get_cell", f"WITH {_CELLS} SELECT table_id, text FROM cells WHERE row = 1 AND col = 1")
def get_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.get_cell(fx.cells(spark, sf_dir), 1, 1).select("table_id", "text")


_DENSE = _CELLS + ", dn AS (SELECT g.table_id, g.row, c.index AS col, coalesce(x.text, '') AS text FROM (SELECT table_id, cols, unnest(range(rows)) AS row FROM sizes) g JOIN columns_ c ON c.table_id = g.table_id AND c.enabled AND c.index < g.cols LEFT JOIN cells x ON x.table_id = g.table_id AND x.row = g.row AND x.col = c.index)"


@query("data_matrix", f"WITH {_DENSE} SELECT table_id, row, string_agg(text, '|' ORDER BY col) AS cells FROM dn GROUP BY ALL")
def data_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dense_rows(fx.cells(spark, sf_dir), fx.columns(spark, sf_dir), fx.sizes(spark, sf_dir)).select("table_id", F.col("row").cast("long").alias("row"), F.array_join("values", "|").alias("cells"))


@query("skip_empty", f"WITH {_DENSE} SELECT table_id, row FROM dn GROUP BY ALL HAVING bool_or(trim(text) <> '')")
def skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.without_blank(tables.dense_rows(fx.cells(spark, sf_dir), fx.columns(spark, sf_dir), fx.sizes(spark, sf_dir))).select("table_id", F.col("row").cast("long").alias("row"))


@query(
    "csv_text",
    f"WITH {_DENSE}, hd AS (SELECT table_id, string_agg(name, ';' ORDER BY pos) AS line FROM columns_ WHERE enabled GROUP BY table_id), bd AS (SELECT table_id, row, string_agg(text, ';' ORDER BY col) AS line FROM dn GROUP BY ALL HAVING bool_or(trim(text) <> '')) SELECT hd.table_id, hd.line || chr(13) || chr(10) || coalesce(b.t, '') AS csv FROM hd LEFT JOIN (SELECT table_id, string_agg(line || chr(13) || chr(10), '' ORDER BY row) AS t FROM bd GROUP BY table_id) b USING (table_id)",
)
def csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.csv_text(fx.cells(spark, sf_dir), fx.columns(spark, sf_dir), skip_empty=True, tables=fx.sizes(spark, sf_dir))


@query("column_width", f"WITH {_CELLS}, m AS (SELECT table_id, col, max(length(text)) AS n FROM cells GROUP BY ALL) SELECT c.table_id, c.index, least(greatest(coalesce(n, 0), length(name)) + 2, 50) AS width FROM columns_ c LEFT JOIN m ON m.table_id = c.table_id AND m.col = c.index")
def column_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.column_widths(fx.cells(spark, sf_dir), fx.columns(spark, sf_dir))


@query("headers", f"WITH {_CELLS} SELECT table_id, string_agg(name, '|' ORDER BY pos) AS headers FROM columns_ WHERE enabled GROUP BY table_id")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.headers(fx.columns(spark, sf_dir)).select("table_id", F.array_join("headers", "|").alias("headers"))


@query("header_labels", f"WITH {_CELLS} SELECT table_id, index, CASE WHEN enabled THEN name ELSE '[' || name || ']' END AS label FROM columns_")
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.columns(spark, sf_dir).select("table_id", "index", tables.header_label().alias("label"))


@query(
    "cell_state",
    f"WITH {_CELLS} SELECT table_id, row, col, CASE WHEN needs_review THEN 'review' WHEN is_merged THEN 'merged' WHEN text <> coalesce(nullif(original_text, ''), text) THEN 'edited' WHEN confidence < 0.6 THEN 'low' ELSE 'normal' END AS state FROM cells",
)
def cell_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select("table_id", "row", "col", tables.display_state().alias("state"))


@query("confidence_band", f"WITH {_CELLS}, p AS (SELECT table_id, row, col, CAST(trunc(confidence * 100) AS INT) AS percent FROM cells) SELECT *, CASE WHEN percent >= 80 THEN 'high' WHEN percent >= 60 THEN 'medium' ELSE 'low' END AS band FROM p")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select("table_id", "row", "col", tables.percent(F.col("confidence")).alias("percent"), tables.band(F.col("confidence")).alias("band"))


@query(
    "upsert_cells",
    f"""WITH {_CELLS}, u AS (SELECT table_id, row + 6 AS row, col, 'new' || row AS text FROM cells WHERE col < 3 AND row < 9)
SELECT c.table_id, c.row, c.col, coalesce(u.text, c.text) AS text, c.confidence FROM cells c LEFT JOIN u USING (table_id, row, col)
UNION ALL SELECT table_id, row, col, text, 0 FROM u WHERE (table_id, row, col) NOT IN (SELECT (table_id, row, col) FROM cells)""",
)
def upsert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.cells(spark, sf_dir)
    u = c.where("col < 3 and row < 9").select("table_id", (F.col("row") + 6).alias("row"), "col", F.concat(F.lit("new"), F.col("row").cast("string")).alias("text"))
    return tables.upsert(c, u).select("table_id", "row", "col", "text", "confidence")


@query("auto_columns", f"WITH {_STATS} SELECT table_id, CAST(i AS INT) AS index, 'Col_' || (i + 1) AS name FROM st, range(7) r(i) WHERE i < cols")
def auto_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.auto_columns(tables.stats(fx.cells(spark, sf_dir))).select("table_id", "index", "name")


# ---- edits

_LOG = fx.SQL["log"]


@query(
    "edit_fold",
    f"""WITH RECURSIVE {_LOG}, e AS (SELECT project, seq, kind, row_number() OVER (PARTITION BY project ORDER BY seq) AS i FROM log WHERE kind IN ('edit', 'undo', 'redo')),
s(project, i, done, undone) AS (SELECT DISTINCT project, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM log
  UNION ALL SELECT s.project, s.i + 1, CASE WHEN kind = 'edit' THEN list_append(done[1:len(done) - undone], seq) ELSE done END, CASE kind WHEN 'edit' THEN 0 WHEN 'undo' THEN least(undone + 1, len(done)) ELSE greatest(undone - 1, 0) END FROM s JOIN e ON e.project = s.project AND e.i = s.i + 1),
l AS (SELECT project, unnest(done[1:len(done) - undone]) AS seq FROM s QUALIFY i = max(i) OVER (PARTITION BY project))
SELECT l.project, l.seq, log.row, log.col, new_text FROM l JOIN log USING (seq)""",
)
def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.live_edits(fx.edit_log(spark, sf_dir))


@query("latest_edits", f"WITH {_LOG} SELECT project, row, col, max(seq) AS seq, arg_max(kind, seq) AS kind FROM log GROUP BY project, row, col")
def latest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.latest(fx.edit_log(spark, sf_dir), ["project", "row", "col"]).select("project", "row", "col", "seq", "kind")


@query(
    "review_state",
    f"""WITH {_LOG}, r AS (SELECT project, row, col, seq, CASE kind WHEN 'edit' THEN 'apply' ELSE kind END AS kind, new_text FROM log)
SELECT project, row, col, arg_max(new_text, seq) FILTER (kind = 'apply') AS text, NOT bool_or(kind IN ('apply', 'review')) AS needs_review, arg_max(kind, seq) FILTER (kind IN ('apply', 'reset')) = 'reset' AS reset
FROM r WHERE kind IN ('apply', 'review', 'reset') GROUP BY project, row, col""",
)
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.edit_log(spark, sf_dir)
    return edits.review_state(log.withColumn("kind", F.when(F.col("kind") == "edit", "apply").otherwise(F.col("kind"))))


@query(
    "header_toggles",
    f"""WITH {_LOG}, t AS (SELECT project, col, seq, CASE kind WHEN 'edit' THEN 'toggle' WHEN 'undo' THEN 'none' WHEN 'redo' THEN 'all' WHEN 'review' THEN 'rename' ELSE 'other' END AS kind, seq % 2 = 0 AS value, CASE WHEN seq % 3 = 0 THEN '  ' ELSE ' n' || seq END AS name FROM log),
o AS (SELECT project, col, max(seq) AS seq, arg_max(value, seq) AS v FROM t WHERE kind = 'toggle' GROUP BY ALL),
w AS (SELECT project, max(seq) AS seq, arg_max(kind = 'all', seq) AS v FROM t WHERE kind IN ('all', 'none') GROUP BY ALL),
m AS (SELECT project, col, arg_max(trim(name), seq) AS name FROM t WHERE kind = 'rename' AND trim(name) <> '' GROUP BY ALL)
SELECT project, col, CASE WHEN w.seq IS NOT NULL AND (o.seq IS NULL OR w.seq > o.seq) THEN w.v ELSE coalesce(o.v, true) END AS enabled, m.name
FROM (SELECT DISTINCT project, col FROM t) k LEFT JOIN o USING (project, col) LEFT JOIN w USING (project) LEFT JOIN m USING (project, col)""",
)
def header_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE kind WHEN 'edit' THEN 'toggle' WHEN 'undo' THEN 'none' WHEN 'redo' THEN 'all' WHEN 'review' THEN 'rename' ELSE 'other' END"
    log = fx.edit_log(spark, sf_dir).selectExpr("project", "col", "seq", f"{kind} AS kind", "seq % 2 = 0 AS value", "IF(seq % 3 = 0, '  ', concat(' n', seq)) AS name")
    return edits.toggles(log, "col")


@query("recent_files", f"WITH {_LOG}, m AS (SELECT project, row * 10 + col AS file, max(seq) AS seq FROM log GROUP BY ALL), r AS (SELECT project, file, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS place FROM m) SELECT * FROM r WHERE place <= 10")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.recent(fx.edit_log(spark, sf_dir).withColumn("file", F.col("row") * 10 + F.col("col")), "file").withColumn("place", F.col("place").cast("long"))


# ---- geometry

@query("roi_clamp", "SELECT p_partkey, CAST(trunc(greatest(0, least(1, (p_size - 10) / CAST(35 AS DOUBLE))) * 640) AS BIGINT) AS px FROM part")
def roi_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = G.clamped((F.col("p_size") - 10) / F.lit(35.0))
    return fx.table(spark, sf_dir, "part").select("p_partkey", G.pixel(share, F.lit(640)).alias("px"))


_QUAD = "q AS (SELECT p_partkey AS quad_id, p_size, [struct_pack(x := CAST(p_partkey % 37 AS DOUBLE), y := CAST(p_size AS DOUBLE)), struct_pack(x := CAST(200 + p_size AS DOUBLE), y := CAST(p_partkey % 23 AS DOUBLE)), struct_pack(x := CAST(200 + p_partkey % 90 AS DOUBLE), y := CAST(200 + p_size AS DOUBLE)), struct_pack(x := CAST(p_size AS DOUBLE), y := CAST(180 + p_partkey % 41 AS DOUBLE))] AS p FROM part)"


@query(
    "quad_angles",
    f"""WITH {_QUAD}, v AS (SELECT quad_id, list_transform([1, 2, 3, 4], lambda i: [p[CASE WHEN i = 1 THEN 4 ELSE i - 1 END].x - p[i].x, p[CASE WHEN i = 1 THEN 4 ELSE i - 1 END].y - p[i].y, p[CASE WHEN i = 4 THEN 1 ELSE i + 1 END].x - p[i].x, p[CASE WHEN i = 4 THEN 1 ELSE i + 1 END].y - p[i].y]) AS v FROM q)
SELECT quad_id, len(list_filter(v, lambda t: NOT degrees(acos(greatest(-1, least(1, (t[1] * t[3] + t[2] * t[4]) / (sqrt(t[1] * t[1] + t[2] * t[2]) * sqrt(t[3] * t[3] + t[4] * t[4]) + 1e-10))))) BETWEEN 60 AND 120)) = 0 AS plausible FROM v""",
)
def quad_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [(F.col("pts")[i]["x"], F.col("pts")[i]["y"]) for i in range(4)]
    return fx.quads(spark, sf_dir).select("quad_id", G.plausible_quad(points).alias("plausible"))


@query(
    "order_points",
    f"""WITH {_QUAD}, u AS (SELECT quad_id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM q)
SELECT quad_id, arg_min(s.x, struct_pack(k := s.x + s.y, i := i)) AS tlx, arg_min(s.x, struct_pack(k := s.y - s.x, i := i)) AS trx, arg_min(s.x, struct_pack(k := -(s.x + s.y), i := i)) AS brx, arg_min(s.x, struct_pack(k := s.x - s.y, i := i)) AS blx FROM u GROUP BY quad_id""",
)
def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.ordered_corners(F.col("pts"))
    return fx.quads(spark, sf_dir).select("quad_id", c.alias("c")).select("quad_id", *(F.col(f"c.{n}.x").alias(f"{n}x") for n in ("tl", "tr", "br", "bl")))


@query(
    "line_intersection",
    "WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS r1, (p_partkey % 18) * pi() / 18 AS t1, CAST(p_partkey % 50 AS DOUBLE) AS r2, (p_size % 18) * pi() / 18 AS t2 FROM part), d AS (SELECT *, cos(t1) * sin(t2) - sin(t1) * cos(t2) AS det FROM t) SELECT p_partkey, CASE WHEN abs(det) >= 1e-10 THEN round((sin(t2) * r1 - sin(t1) * r2) / det, 4) + 0.0 END AS px, CASE WHEN abs(det) >= 1e-10 THEN round((cos(t1) * r2 - cos(t2) * r1) / det, 4) + 0.0 END AS py FROM d",
)
def line_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    met = G.line_intersection(F.col("p_size").cast("double"), (F.col("p_partkey") % 18) * F.pi() / 18, (F.col("p_partkey") % 50).cast("double"), (F.col("p_size") % 18) * F.pi() / 18)
    return p.select("p_partkey", met.alias("m")).select("p_partkey", *((F.round(f"m.{n}", 4) + 0.0).alias(n) for n in ("px", "py")))


# ---- pixels. SQL can't express these; the tests hold them against plain loops over pixels.

#: Steps of raster over a gray page, by name.
STEPS: dict[str, Callable] = {
    "dilate": lambda g: raster.dilate(g, 5, 3), "erode": lambda g: raster.erode(g, 3, 5), "opened": lambda g: raster.opened(g, 25, 1), "gauss": lambda g: raster.gauss(g, 1.1), "median": lambda g: raster.median(g, 5),
    "binary_inverse": raster.binary_inverse, "adaptive_inverse": lambda g: raster.adaptive_inverse(g, 11, 2), "binarize": raster.binarize, "clahe": raster.clahe, "sharpen": raster.sharpen, "without_shadows": raster.without_shadows,
    "denoise": raster.denoise, "enhance_lines": raster.enhance_lines, "lighten": lambda g: raster.lighten(np.repeat(g[..., None], 3, 2)), "without_glare": lambda g: raster.without_glare(np.repeat(g[..., None], 3, 2)),
    "resized": lambda g: raster.resized(g, 200), "rotated": lambda g: raster.rotated(g, 5.0), "edges": raster.edges, "deskewed": raster.deskewed, "cropped": lambda g: raster.cropped(g, [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9)]),
    "scan": lambda g: raster.preprocess(g, Profile.scan()), "photo": lambda g: raster.preprocess(np.repeat(g[..., None], 3, 2), Profile.photo()), "for_recognition": raster.for_recognition,
}


@query("image_steps")
def image_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.measured(fx.images(spark, sf_dir), STEPS)


@query("image_measures")
def image_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda c: [] if c is None else c.round(6).ravel().tolist()
    said = {"otsu": raster.otsu, "skew": lambda g: round(raster.skew(g), 6), "crossing_corners": lambda g: none(raster.crossing_corners(g)), "page_corners": lambda g: none(raster.page_corners(g)), "components": lambda g: int(raster.components(g < 128).max())}
    return raster.told(fx.images(spark, sf_dir), said)


@query("detected_tables")
def detected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.detect_tables(fx.images(spark, sf_dir)).select("path", "det_id", "pass", "x", "y", "w", "h", "rows", "cols", "confidence", F.size("cells").alias("n_cells"))


@query("detected_segments")
def detected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.detect(fx.images(spark, sf_dir)).select("path", F.explode("segments").alias("s")).select("path", "s.*")


@query("recognized_words")
def recognized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.text_blocks(recognize.page_words(fx.images(spark, sf_dir)))


# ---- project files

@query("json_roundtrip", f"WITH {_CELLS} SELECT table_id, row, col, text, coalesce(nullif(original_text, ''), text) AS original_text, confidence FROM cells")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.cells(spark, sf_dir)
    cell = F.struct("row", "col", "text", "confidence", "is_merged", "original_text", "needs_review")
    table = c.groupBy("table_id").agg(F.array_sort(F.collect_list(cell)).alias("cells")).select("table_id", F.array(F.struct(F.col("table_id").cast("string").alias("id"), "cells")).alias("tables"))
    text = projects.to_json(table.select(F.col("table_id").alias("project_id"), "tables"))
    return projects.cells(projects.parse(text)).select(F.col("table_id").cast("long").alias("table_id"), "row", "col", "text", "original_text", "confidence")


@query("export_gates", f"WITH {_STATS} SELECT table_id % 7 AS project_id, true AS has_tables, bool_or(table_id % 3 = 0) AS can_export FROM st GROUP BY ALL")
def export_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.stats(fx.cells(spark, sf_dir)).select((F.col("table_id") % 7).alias("project_id"), (F.col("table_id") % 3 == 0).alias("enabled"))
    return projects.ready(t)
