"""Pages, detections, alternatives and cells derived from the star-schema tables, in Spark and as SQL views of the same
rows. LK orders line items wherever a place is needed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import raster

LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
_LK = ", ".join(LK)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pages = max(1, li.count() // 60)
    return li.withColumn("page_id", F.col("l_orderkey") % pages)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("page_id").orderBy(*LK)).cast("long"))


def blocks(spark: SparkSession, sf_dir: str, in_columns: bool = False) -> DataFrame:
    """Text blocks; in_columns: those of line numbers above 4 lie in the first columns too, so that pages are one grid."""
    li = _numbered(lines(spark, sf_dir), "block_id")
    x = "60 + 45 * ((l_linenumber - 1) % 4)" if in_columns else "60 + 45 * (l_linenumber - 1) + IF(l_linenumber > 4, 100, 0)"
    return li.selectExpr(
        "page_id", "block_id", f"{x} + l_partkey % 5 AS x",
        "40 + 32 * (l_suppkey % 6) + l_partkey % 3 AS y", "20 + CAST(l_quantity AS BIGINT) % 15 AS w", "CAST(12 AS BIGINT) AS h",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _numbered(lines(spark, sf_dir), "det_id")
    return li.selectExpr(
        "page_id", "det_id", "l_partkey % 400 AS x", "8 * (l_suppkey % 50) AS y", "60 + CAST(l_quantity AS BIGINT) AS w", "CAST(50 + 10 * l_linenumber AS BIGINT) AS h",
        "0.5D + 5 * l_discount + 0.0D AS confidence", "CAST(1 + l_linenumber % 4 AS BIGINT) AS rows", "1 + l_partkey % 4 AS cols", "IF(det_id % 2 = 0, 'cv', 'yolo') AS source",
    )


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS cell_id", "IF(p_partkey % 7 = 0, repeat(concat(p_name, ' '), 5), p_name) AS p_name", "p_type", "p_size")
    texts = (
        "p_name",
        "CASE cell_id % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, '  ') WHEN 2 THEN replace(p_name, 'e', 'c') ELSE reverse(p_name) END",
        "CASE cell_id % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'i', 'l') ELSE p_type END",
    )
    items = ", ".join(f"named_struct('pos', {i}, 'source', '{s}', 'text', {t}, 'confidence', (p_size * {i + 3} % 100) / 100.0D)" for i, (s, t) in enumerate(zip(("paddleocr", "easyocr", "tesseract"), texts, strict=True)))
    return p.selectExpr("cell_id", f"inline(array({items}))").where("cell_id % 11 <> pos")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").selectExpr("*", "l_suppkey AS table_id", "l_orderkey % 12 AS row", "CAST(l_linenumber - 1 AS BIGINT) AS col")
    first = li.withColumn("at", F.row_number().over(Window.partitionBy("table_id", "row", "col").orderBy(*LK))).where("at = 1")
    text = "CASE WHEN (table_id + row) % 4 = 0 OR l_partkey % 5 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN ' ' ELSE concat(l_returnflag, CAST(l_partkey AS STRING)) END"
    made = first.selectExpr("*", f"{text} AS text").selectExpr(
        "table_id", "row", "col", "row * 100 + col AS pos", "text", "IF(l_partkey % 13 = 0, concat(text, '*'), text) AS original_text", "10 * l_discount + 0.0D AS confidence",
        "40 + CAST(l_quantity AS BIGINT) AS w", "CAST(20 AS BIGINT) AS h", "l_partkey % 9 = 0 AS needs_review",
    )
    from ..operators.tables import merged_flags

    return merged_flags(made)


def _table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with cells, and by the negative ids of every tenth, tables without."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_id")).distinct()
    return t.union(t.where("table_id % 10 = 0 and table_id > 0").select(-F.col("table_id")))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_ids(spark, sf_dir).selectExpr("table_id", "12 + abs(table_id) % 3 AS rows", "7 - abs(table_id) % 2 AS cols")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table_ids(spark, sf_dir)
    at = t.select("table_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("index"))
    return at.select("table_id", "index", F.col("index").alias("pos"), F.concat(F.lit("Col_"), (F.col("index") + 1).cast("string")).alias("name"), ((F.abs("table_id") + F.col("index")) % 3 != 0).alias("enabled"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, text, disagreed) of the cells of alternatives(), some without any."""
    return alternatives(spark, sf_dir).where("pos = 1").selectExpr("cell_id", "text", "cell_id % 4 = 3 AS disagreed").unionByName(table(spark, sf_dir, "part").where("p_partkey % 50 = 0 and p_partkey > 0").selectExpr("-p_partkey AS cell_id", "p_name AS text", "false AS disagreed"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = "CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'reset' WHEN 'signup' THEN 'review' WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'other' END"
    return e.selectExpr("user_id % 20 AS project", "event_id AS seq", f"{kind} AS kind", "event_id % 12 AS row", "event_id % 7 AS col", "props AS new_text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _numbered(lines(spark, sf_dir), "seg_id")
    flat = "l_partkey % 2 = 0"
    return li.selectExpr(
        "page_id", "seg_id", f"IF({flat}, 0, 60 * (l_suppkey % 6)) AS x1", f"IF({flat}, 30 * (l_suppkey % 8), 0) AS y1",
        f"IF({flat}, 200, 60 * (l_suppkey % 6) + 12 * (l_linenumber - 4)) AS x2", f"IF({flat}, 30 * (l_suppkey % 8) + 12 * (l_linenumber - 4), 200) AS y2",
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lines(spark, sf_dir).selectExpr("page_id", "CAST((l_partkey % 30) * 10 AS INT) AS pos", "255 * (1 + l_quantity) AS v")
    sums = li.groupBy("page_id", "pos").agg(F.sum("v").alias("v"))
    grid = li.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("pos"))
    return grid.join(sums, ["page_id", "pos"], "left").select("page_id", "pos", F.coalesce("v", F.lit(0.0)).alias("value"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gray page for each nation (path, height, width, channels, data): a ruled grid whose size and place follow the
    nation's key, some ink in its cells, tilted on every fourth, without lines on every fifth."""

    def run(batches):
        for b in batches:
            for key in b.column("n_nationkey").to_pylist():
                img = np.full((160, 200), 250, np.uint8)
                rows, cols, left, top = 2 + key % 3, 2 + key % 4, 10 + key % 7, 12 + key % 5
                high, wide = 120 // rows, 160 // cols
                for r in range(rows + 1 if key % 5 else 0):
                    img[top + r * high : top + r * high + 2, left : left + cols * wide + 2] = 10
                for c in range(cols + 1 if key % 5 else 0):
                    img[top : top + rows * high + 2, left + c * wide : left + c * wide + 2] = 10
                for r in range(rows):
                    for c in range(cols):
                        img[top + r * high + 8 : top + r * high + 14, left + c * wide + 8 : left + c * wide + 12 + (key * 7 + r * 5 + c * 3) % 12] = 40 + key % 50
                img[::9, ::11] = 245 - key % 9
                img = raster.rotated(img, 2.0) if key % 4 == 0 else img
                yield pa.RecordBatch.from_pylist([{"path": f"page-{key}", "height": 160, "width": 200, "channels": 1, "data": img.tobytes()}], schema)

    schema = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
    return table(spark, sf_dir, "nation").select("n_nationkey").repartition(8).mapInArrow(run, "path string, height int, width int, channels int, data binary")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pts = "array(named_struct('x', CAST(p_partkey % 37 AS DOUBLE), 'y', CAST(p_size AS DOUBLE)), named_struct('x', 200.0D + p_size, 'y', CAST(p_partkey % 23 AS DOUBLE)), named_struct('x', 200.0D + p_partkey % 90, 'y', 200.0D + p_size), named_struct('x', CAST(p_size AS DOUBLE), 'y', 180.0D + p_partkey % 41))"
    return p.selectExpr("p_partkey AS quad_id", f"{pts} AS pts", "p_size")


_PAGES = "li AS (SELECT *, l_orderkey % (SELECT greatest(1, count(*) // 60) FROM lineitem) AS page_id FROM lineitem)"
_N = f"row_number() OVER (PARTITION BY page_id ORDER BY {_LK})"

#: SQL of the same rows, as common table expressions.
SQL = {
    "pages": _PAGES,
    "blocks": f"{_PAGES}, blocks AS (SELECT page_id, {_N} AS block_id, 60 + 45 * (l_linenumber - 1) + CASE WHEN l_linenumber > 4 THEN 100 ELSE 0 END + l_partkey % 5 AS x, l_partkey % 5 AS x5, 40 + 32 * (l_suppkey % 6) + l_partkey % 3 AS y, 20 + CAST(trunc(l_quantity) AS BIGINT) % 15 AS w, 12 AS h, l_linenumber FROM li), "
    "ctr AS (SELECT *, x + CAST(floor(w / 2) AS BIGINT) AS cx, y + CAST(floor(h / 2) AS BIGINT) AS cy FROM blocks)",
    "detections": f"{_PAGES}, det AS (SELECT page_id, {_N} AS det_id, l_partkey % 400 AS x, 8 * (l_suppkey % 50) AS y, 60 + CAST(trunc(l_quantity) AS BIGINT) AS w, 50 + 10 * l_linenumber AS h, CAST(0.5 AS DOUBLE) + 5 * l_discount + 0.0 AS confidence, 1 + l_linenumber % 4 AS rows, 1 + l_partkey % 4 AS cols FROM li)",
    "alternatives": """p AS (SELECT p_partkey AS cell_id, CASE WHEN p_partkey % 7 = 0 THEN repeat(p_name || ' ', 5) ELSE p_name END AS p_name, p_type, p_size FROM part), alt AS (SELECT * FROM (
  SELECT cell_id, 0 AS pos, 'paddleocr' AS source, p_name AS text, (p_size * 3 % 100) / CAST(100 AS DOUBLE) AS confidence FROM p
  UNION ALL SELECT cell_id, 1, 'easyocr', CASE cell_id % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || '  ' WHEN 2 THEN replace(p_name, 'e', 'c') ELSE reverse(p_name) END, (p_size * 4 % 100) / CAST(100 AS DOUBLE) FROM p
  UNION ALL SELECT cell_id, 2, 'tesseract', CASE cell_id % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'i', 'l') ELSE p_type END, (p_size * 5 % 100) / CAST(100 AS DOUBLE) FROM p) WHERE cell_id % 11 <> pos),
n AS (SELECT *, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS norm, CASE source WHEN 'paddleocr' THEN 1.5 WHEN 'easyocr' THEN 1.2 ELSE 1.0 END::DOUBLE AS weight FROM alt)""",
    "cells": f"""k AS (SELECT *, l_suppkey AS table_id, l_orderkey % 12 AS row, l_linenumber - 1 AS col FROM lineitem),
f AS (SELECT *, CASE WHEN (table_id + row) % 4 = 0 OR l_partkey % 5 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN ' ' ELSE l_returnflag || CAST(l_partkey AS VARCHAR) END AS text FROM k QUALIFY row_number() OVER (PARTITION BY table_id, row, col ORDER BY {_LK}) = 1),
c0 AS (SELECT table_id, row, col, row * 100 + col AS pos, text, CASE WHEN l_partkey % 13 = 0 THEN text || '*' ELSE text END AS original_text, 10 * l_discount + 0.0 AS confidence, 40 + CAST(trunc(l_quantity) AS BIGINT) AS w, 20 AS h, l_partkey % 9 = 0 AS needs_review FROM f),
cells AS (SELECT *, w * h > 1.5 * avg(w * h) OVER (PARTITION BY table_id) AS is_merged FROM c0),
ids AS (SELECT DISTINCT l_suppkey AS table_id FROM lineitem UNION ALL SELECT DISTINCT -l_suppkey FROM lineitem WHERE l_suppkey % 10 = 0 AND l_suppkey > 0),
sizes AS (SELECT table_id, 12 + abs(table_id) % 3 AS rows, 7 - abs(table_id) % 2 AS cols FROM ids),
columns_ AS (SELECT table_id, i AS index, i AS pos, 'Col_' || (i + 1) AS name, (abs(table_id) + i) % 3 <> 0 AS enabled FROM ids, range(7) r(i))""",
    "log": "log AS (SELECT user_id % 20 AS project, event_id AS seq, CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'reset' WHEN 'signup' THEN 'review' WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'other' END AS kind, event_id % 12 AS row, event_id % 7 AS col, props AS new_text FROM events)",
}
