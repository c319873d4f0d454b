"""Overlapping detections of a page: suppression, merging, confirmation and matching.

The rules are greedy and ordered, so each folds a page's sorted detections in one Arrow pass. Ties keep the order of
det_id. Where rules need pairs, boxes meet in cells of the page, so a crowded page isn't compared with itself in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou, overlaps
from .pagewise import Taken, folded, listed

FIELDS = ("det_id", "x", "y", "w", "h", "confidence", "rows", "cols")
#: Side of the cells in which boxes meet.
CELL = 128


def _meeting(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of boxes (columns prefixed a and b) of a page whose intersection has area, each once: boxes lie in every cell
    that they touch, and a pair meets in the cell of its intersection's first corner."""

    def placed(df: DataFrame, p: str) -> DataFrame:
        for axis, extent, cell in (("x", "w", "gx"), ("y", "h", "gy")):
            start = F.col(f"{p}{axis}")
            df = df.withColumn(cell, F.explode(F.sequence(F.floor(start / CELL), F.floor((start + F.greatest(F.col(f"{p}{extent}"), F.lit(0))) / CELL))))
        return df

    met = placed(left, a).join(placed(right, b), ["page_id", "gx", "gy"])
    first = [F.floor(F.greatest(F.col(f"{a}{c}"), F.col(f"{b}{c}")) / CELL) for c in "xy"]
    return met.where((F.col("gx") == first[0]) & (F.col("gy") == first[1])).drop("gx", "gy")


def pairs(detections: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(page_id, a, b, iou): detections a < b of a page that overlap by more than threshold (0 or more)."""
    left, right = (detections.select("page_id", F.col("det_id").alias(n), *(F.col(c).alias(f"{n}{c}") for c in "xywh")) for n in ("a", "b"))
    met = _meeting(left, right, "a", "b").where("a < b").withColumn("iou", iou(box("a"), box("b")))
    return met.where(F.col("iou") > threshold).select("page_id", "a", "b", "iou")


def _overlap(d: dict[str, np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
    """Intersection over union of row i with others; as functions.geometry.iou()."""
    wide = np.minimum(d["x"][i] + d["w"][i], d["x"][others] + d["w"][others]) - np.maximum(d["x"][i], d["x"][others])
    high = np.minimum(d["y"][i] + d["h"][i], d["y"][others] + d["h"][others]) - np.maximum(d["y"][i], d["y"][others])
    common = (wide * high).astype(np.float64)
    union = d["w"][i] * d["h"][i] + d["w"][others] * d["h"][others] - common
    return np.where((wide < 0) | (high < 0) | (union <= 0), 0.0, common / np.where(union > 0, union, 1.0))


def _seeds(bounds: np.ndarray, d: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, how many each absorbs): rows in order that overlap no seed before them, each with the later rows that
    overlap it and no seed before it."""
    seeds, absorbed = [], []
    for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        left = np.arange(at, end)
        while len(left):
            hit = _overlap(d, left[0], left[1:]) > threshold
            seeds.append(left[0])
            absorbed.append(hit.sum())
            left = left[1:][~hit]
    return np.array(seeds, np.int64), np.array(absorbed, np.int64)


def suppress(detections: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Detections that overlap no kept one of higher confidence."""
    lists = listed(detections, ["page_id"], FIELDS, -F.col("confidence"), F.col("det_id"))
    return folded(lists, lambda bounds, d: (_seeds(bounds, d, threshold)[0], {}), {})


def merge(detections: DataFrame, threshold: float = 0.3, boost: float = 0.1) -> DataFrame:
    """Detections by (confidence, rows * cols), each with the later ones that overlap it; every one absorbed adds boost
    to its confidence, up to 1. Adds column absorbed."""

    def fold(bounds: np.ndarray, d: dict[str, np.ndarray]) -> Taken:
        at, n = _seeds(bounds, d, threshold)
        own = d["confidence"][at]
        return at, {"confidence": np.where(n > 0, np.minimum(1.0, own + boost * n), own), "absorbed": n.astype(np.int32)}

    lists = listed(detections, ["page_id"], FIELDS, -F.col("confidence"), -(F.col("rows") * F.col("cols")), F.col("det_id"))
    return folded(lists, fold, {"confidence": "double", "absorbed": "int"})


def confirm(lined: DataFrame, crossing: DataFrame, threshold: float = 0.5, boost: float = 0.15) -> DataFrame:
    """Lined detections (confidence 0.8 at least), raised by boost, up to 1, for each crossing detection whose first
    overlapping lined one they are; crossing detections that overlap none follow with confidence 0.6."""
    base = lined.withColumn("confidence", F.greatest(F.col("confidence"), F.lit(0.8)))
    c = crossing.select("page_id", F.col("det_id").alias("c_id"), *(F.col(n).alias(f"c{n}") for n in "xywh"))
    met = _meeting(c, base, "c", "").where(overlaps(box("c"), box(), threshold))
    first = met.groupBy("page_id", "c_id").agg(F.min("det_id").alias("det_id"))
    times = first.groupBy("page_id", "det_id").agg(F.count("*").alias("times"))
    raised = base.join(times, ["page_id", "det_id"], "left")
    raised = raised.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + boost * F.coalesce("times", F.lit(0)))).withColumn("detection_method", F.lit("morphology")).drop("times")
    alone = crossing.join(first.select("page_id", F.col("c_id").alias("det_id")), ["page_id", "det_id"], "left_anti")
    return raised.unionByName(alone.withColumn("confidence", F.lit(0.6)).withColumn("detection_method", F.lit("hough")))


def match(cv: DataFrame, other: DataFrame, threshold: float = 0.3, boost: float = 0.15) -> DataFrame:
    """Greedy one-to-one merge in order of det_id: each cv detection takes the free other one of greatest overlap (the
    first of equals), gains boost, up to 1, and is hybrid_confirmed; free others follow unchanged. Adds matched."""
    both = cv.select("page_id", *FIELDS, F.lit(0).alias("side")).unionByName(other.select("page_id", *FIELDS, F.lit(1).alias("side")))

    def fold(bounds: np.ndarray, d: dict[str, np.ndarray]) -> Taken:
        kept, matched = [], []
        for at, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            cut = at + int((d["side"][at:end] == 0).sum())
            free = np.arange(cut, end)
            for i in range(at, cut):
                v = _overlap(d, i, free)
                best = int(v.argmax()) if len(v) else 0
                hit = len(v) > 0 and v[best] > threshold
                kept.append(i)
                matched.append(d["det_id"][free[best]] if hit else None)
                free = np.delete(free, best) if hit else free
            kept += free.tolist()
            matched += [None] * len(free)
        at, hit = np.array(kept, np.int64), np.array([m is not None for m in matched], bool)
        own = d["confidence"][at]
        method = np.where(hit, "hybrid_confirmed", np.where(d["side"][at] == 0, "cv", "yolo"))
        return at, {"confidence": np.where(hit, np.minimum(1.0, own + boost), own), "matched": np.array(matched, object), "detection_method": method.astype(object)}

    lists = listed(both, ["page_id"], [*FIELDS, "side"], F.col("side"), F.col("det_id"))
    return folded(lists, fold, {"confidence": "double", "matched": "bigint", "detection_method": "string"}, FIELDS)


def valid(detections: DataFrame, image_area: int | Column, least: int = 2, share: float = 0.01) -> DataFrame:
    """Detections with enough rows, columns and area for an image of the given area."""
    size, whole = F.col("w") * F.col("h"), F.lit(image_area)
    return detections.where((F.col("rows") >= least) & (F.col("cols") >= least) & (size >= (whole * share).cast("long")) & (size / whole >= share))


def filled(cells: Column, least_area: int = 100, share: float = 0.5) -> Column:
    """Whether enough of the places of a grid (columns rows, cols) have a cell of some size; true without cells."""
    good = F.filter(cells, lambda c: (c["w"] > 0) & (c["h"] > 0) & (c["w"] * c["h"] >= least_area))
    return (F.coalesce(F.size(cells), F.lit(0)) == 0) | (F.size(good) / (F.col("rows") * F.col("cols")) >= share)


def cascade(detections: DataFrame, least: float = 0.7) -> DataFrame:
    """(page_id, second_look): pages whose first detector was unsure of any table."""
    return detections.groupBy("page_id").agg((~F.every(F.col("confidence") >= least)).alias("second_look"))


def refine(regions: DataFrame, inner: DataFrame) -> DataFrame:
    """Regions of a model with what the line detector finds in each (region_id, det_id, in region coordinates): shifted to
    the page, with the mean of both confidences; a region without any is a 1 x 1 table of 0.8 its confidence. Cells, if
    inner has them, are shifted too."""
    r = regions.select("page_id", F.col("det_id").alias("region_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"), F.col("confidence").alias("rc"))
    met = r.join(inner, ["page_id", "region_id"], "left")
    found = F.col("det_id").isNotNull()
    pick = lambda yes, no: F.when(found, yes).otherwise(no)
    more = []
    if "cells" in inner.columns:
        moved = F.transform("cells", lambda c: F.struct((c["x"] + F.col("rx")).alias("x"), (c["y"] + F.col("ry")).alias("y"), c["w"].alias("w"), c["h"].alias("h")))
        whole = F.array(F.struct(F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rw").alias("w"), F.col("rh").alias("h")))
        more = ["det_id", found.alias("has_lines"), pick(moved, whole).alias("cells")]
    return met.select(
        "page_id", "region_id", pick(F.col("x") + F.col("rx"), F.col("rx")).alias("x"), pick(F.col("y") + F.col("ry"), F.col("ry")).alias("y"),
        pick(F.col("w"), F.col("rw")).alias("w"), pick(F.col("h"), F.col("rh")).alias("h"), pick(F.col("rows"), F.lit(1)).alias("rows"), pick(F.col("cols"), F.lit(1)).alias("cols"),
        pick((F.col("rc") + F.col("confidence")) / 2, F.col("rc") * 0.8).alias("confidence"), pick(F.lit("hybrid_yolo_cv"), F.lit("yolo_only")).alias("detection_method"), *more,
    )


def adaptive(pages: DataFrame) -> DataFrame:
    """(page_id, min_area, kernel_h, kernel_v, min_line) from page widths and heights."""
    w, h = F.col("width"), F.col("height")
    return pages.select("page_id", (w * h * 0.01).cast("long").alias("min_area"), F.greatest(F.floor(w / 30), F.lit(10)).alias("kernel_h"), F.greatest(F.floor(h / 30), F.lit(10)).alias("kernel_v"), F.greatest(F.lit(50), F.floor(F.least(w, h) / 20)).alias("min_line"))


def segment_kinds(segments: DataFrame) -> DataFrame:
    """Adds kind h, v or null to segments (x1, y1, x2, y2) by their angle in whole degrees of arc tangent."""
    angle = F.abs(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    return segments.withColumn("kind", F.when((angle < 10) | (angle > 170), "h").when((angle > 80) & (angle < 100), "v"))


def with_fallback(found: DataFrame, lineless: DataFrame) -> DataFrame:
    """found, and for pages without any detection what the lineless operators give."""
    missing = lineless.join(found.select("page_id").distinct(), "page_id", "left_anti")
    return found.unionByName(missing.select(*found.columns))


def named(detections: DataFrame) -> DataFrame:
    """Adds table_name, Table_ and the place on the page; tables below 2 x 2 go after the count, so names have gaps."""
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("det_id"))
    return detections.withColumn("table_name", F.concat(F.lit("Table_"), at)).where("rows >= 2 and cols >= 2")
