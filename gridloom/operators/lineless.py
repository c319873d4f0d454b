"""Tables without lines: grids of aligned text blocks, over whole pages or over connected groups of blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, center
from .cluster import gap_clusters, regular, spacing
from .pagewise import Taken, folded, listed, roots


def centers(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("cx", center(F.col("x"), F.col("w"))).withColumn("cy", center(F.col("y"), F.col("h")))


def grids(blocks: DataFrame, keys: Sequence[str], tolerance: int = 20, least_blocks: int = 4, most: float = 0.5, method: str = "lineless_clustering") -> DataFrame:
    """One table for each key whose blocks form a regular grid: (keys, x, y, w, h, rows, cols, confidence, has_lines,
    detection_method). Rows and columns are gap clusters of block centers; both need two clusters at least and gaps
    whose variation coefficient is at most ``most``."""
    at = centers(blocks)
    hull = blocks.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2")).where(F.col("n") >= least_blocks)
    cols = spacing(gap_clusters(at, keys, "cx", tolerance), keys).select(*keys, F.col("k").alias("cols"), F.col("cv").alias("ccv"))
    rows = spacing(gap_clusters(at, keys, "cy", tolerance), keys).select(*keys, F.col("k").alias("rows"), F.col("cv").alias("rcv"))
    ok = hull.join(cols, list(keys)).join(rows, list(keys)).where(regular(F.col("cols"), F.col("ccv"), most=most) & regular(F.col("rows"), F.col("rcv"), most=most))
    return ok.select(*keys, "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"), "rows", "cols", F.lit(0.6).alias("confidence"), F.lit(False).alias("has_lines"), F.lit(method).alias("detection_method"))


def grid_cells(blocks: DataFrame, keys: Sequence[str], tolerance: int = 20) -> DataFrame:
    """(keys, row, col, x, y, w, h): cells between neighbouring centers, widened by 20 and 10; the last column is 100
    wide, the last row 40 high."""
    at = centers(blocks)
    order = Window.partitionBy(*keys).orderBy("pos")
    c, r = gap_clusters(at, keys, "cx", tolerance), gap_clusters(at, keys, "cy", tolerance)
    nxt = F.lead("center").over(order)
    c = c.select(*keys, F.col("pos").alias("col"), (F.col("center") - 20).alias("x"), F.coalesce(nxt - F.col("center") + 40, F.lit(100)).alias("w"))
    r = r.select(*keys, F.col("pos").alias("row"), (F.col("center") - 10).alias("y"), F.coalesce(nxt - F.col("center") + 20, F.lit(40)).alias("h"))
    return r.join(c, list(keys)).select(*keys, "row", "col", "x", "y", "w", "h")


def _links(bounds: np.ndarray, d: dict[str, np.ndarray], distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, dist, kind) of linked rows of the same list, a before b. Rows meet by cells of the distance: sorted by page
    and cell, a row's partners in a cell are a stretch."""
    page = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cx, cy = d["x"] + d["w"] // 2, d["y"] + d["h"] // 2
    step = int(distance)
    gx, gy = (c // step - (c // step).min() + 1 if len(c) else c for c in (cx, cy))
    wide, high = (int(g.max()) + 2 if len(g) else 1 for g in (gx, gy))
    cell = (page * wide + gx) * high + gy
    order = np.argsort(cell, kind="stable")
    cells = cell[order]
    out = []
    for ox, oy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
        low, high_ = (np.searchsorted(cells, cell + ox * high + oy, side) for side in ("left", "right"))
        n = high_ - low
        a = np.repeat(np.arange(len(cell)), n)
        b = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        if (ox, oy) == (0, 0):
            a, b = a[a < b], b[a < b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        dx, dy = np.abs(cx[a] - cx[b]), np.abs(cy[a] - cy[b])
        h, v = dy < (d["h"][a] + d["h"][b]) // 2 + 10, dx < (d["w"][a] + d["w"][b]) // 2 + 10
        dist = np.sqrt((dx * dx + dy * dy).astype(np.float64))
        on = (h | v) & (dist < distance)
        out.append((a[on], b[on], dist[on], np.where(h & v, "b", np.where(h, "h", "v"))[on]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


BLOCK = ("block_id", "x", "y", "w", "h")


def _blocks(blocks: DataFrame) -> DataFrame:
    return listed(blocks.select("page_id", *(F.col(c).cast("long").alias(c) for c in BLOCK)), ["page_id"], BLOCK, F.col("block_id"))


def adjacency(blocks: DataFrame, distance: float = 50.0) -> DataFrame:
    """(page_id, src, dst, dist, kind) with src < dst: blocks of a page that are aligned (h, v or both) and whose centers
    are nearer than distance. A page's blocks lie in one list and meet by cells of that size, so a crowded page isn't
    compared with itself in full."""

    def fold(bounds: np.ndarray, d: dict[str, np.ndarray]) -> Taken:
        a, b, dist, kind = _links(bounds, d, distance)
        return a, {"src": d["block_id"][a], "dst": d["block_id"][b], "dist": dist, "kind": kind.astype(object)}

    return folded(_blocks(blocks), fold, {"src": "bigint", "dst": "bigint", "dist": "double", "kind": "string"}, [])


def block_components(blocks: DataFrame, distance: float = 50.0) -> DataFrame:
    """(page_id, block_id, x, y, w, h, component) of the linked blocks: the smallest block that each reaches."""

    def fold(bounds: np.ndarray, d: dict[str, np.ndarray]) -> Taken:
        a, b, _, _ = _links(bounds, d, distance)
        at = np.unique(np.concatenate([a, b]))
        return at, {"component": d["block_id"][roots(len(d["block_id"]), a, b)[at]]}

    return folded(_blocks(blocks), fold, {"component": "bigint"})


def page_components(edges: DataFrame) -> DataFrame:
    """(page_id, block_id, component): the smallest block that each linked block reaches. Links never cross pages, so the
    edges of a page meet in one row, bounded by what fits on a sheet, and one pass of union-find labels its blocks."""
    per = edges.groupBy("page_id").agg(F.collect_list(F.col("src").cast("long")).alias("a"), F.collect_list(F.col("dst").cast("long")).alias("b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, blocks, roots = [], [], []
            for page, a, b in zip(*(batch.column(c).to_pylist() for c in ("page_id", "a", "b")), strict=True):
                parent = {n: n for n in (*a, *b)}

                def find(n: int, parent: dict[int, int] = parent) -> int:
                    while parent[n] != n:
                        parent[n] = n = parent[parent[n]]
                    return n

                for x, y in zip(a, b, strict=True):
                    x, y = find(x), find(y)
                    parent[max(x, y)] = min(x, y)
                pages += [page] * len(parent)
                blocks += parent
                roots += map(find, parent)
            yield pa.RecordBatch.from_arrays([pa.array(pages, batch.schema.field("page_id").type), *(pa.array(x, pa.int64()) for x in (blocks, roots))], ["page_id", "block_id", "component"])

    return per.mapInArrow(run, f"page_id {per.schema['page_id'].dataType.simpleString()}, block_id long, component long")


def _spacings(group: np.ndarray, groups: int, at: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """(clusters, variation) of the coordinates of each group; the rules of gap_clusters() and spacing()."""
    order = np.lexsort((at, group))
    g, v = group[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] - v[:-1] > tolerance)])) if len(g) else np.empty(0, np.int64)
    of = g[first]
    center = np.trunc(np.add.reduceat(v, first) / np.diff(np.append(first, len(g)))) if len(g) else np.empty(0)
    near = of[1:] == of[:-1]
    gap, own = (center[1:] - center[:-1])[near], of[1:][near]
    n = np.maximum(np.bincount(own, minlength=groups), 1)
    mean = np.bincount(own, gap, groups) / n
    spread = np.sqrt(np.bincount(own, (gap - mean[own]) ** 2, groups) / n)
    return np.bincount(of, minlength=groups), spread / (mean + 1e-6)


def graph_tables(blocks: DataFrame, distance: float = 50.0, tolerance: int = 20, least_blocks: int = 4, most: float = 0.5) -> DataFrame:
    """Tables of the connected groups of blocks, as grids() of block_components(); links, groups and grids of a page come
    from one pass over its list, so blocks are shuffled once."""

    def fold(bounds: np.ndarray, d: dict[str, np.ndarray]) -> Taken:
        a, b, _, _ = _links(bounds, d, distance)
        at = np.unique(np.concatenate([a, b]))
        first, group, n = np.unique(roots(len(d["x"]), a, b)[at], return_inverse=True, return_counts=True)
        x, y, w, h = (d[c][at] for c in "xywh")
        cols, wide = _spacings(group, len(first), x + w // 2, tolerance)
        rows, high = _spacings(group, len(first), y + h // 2, tolerance)
        far = np.iinfo(np.int64).max
        box_ = [np.full(len(first), far), np.full(len(first), far), np.full(len(first), -far), np.full(len(first), -far)]
        for edge, value, better in zip(box_, (x, y, x + w, y + h), (np.minimum, np.minimum, np.maximum, np.maximum), strict=True):
            better.at(edge, group, value)
        ok = (n >= least_blocks) & (rows >= 2) & (cols >= 2) & (wide <= most) & (high <= most)
        x1, y1, x2, y2 = (e[ok] for e in box_)
        return first[ok], {"component": d["block_id"][first[ok]], "x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1, "rows": rows[ok], "cols": cols[ok]}

    made = folded(_blocks(blocks), fold, {"component": "bigint"} | {c: "bigint" for c in ("x", "y", "w", "h", "rows", "cols")}, [])
    return made.select("*", F.lit(0.6).alias("confidence"), F.lit(False).alias("has_lines"), F.lit("lineless_graph").alias("detection_method"))


__all__ = ["adjacency", "block_components", "box", "centers", "graph_tables", "grid_cells", "grids", "page_components"]
