"""Gap clusters of coordinates, regularity of their spacing, and line peaks of projection profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pagewise import Taken, folded, listed


def gap_clusters(df: DataFrame, keys: Sequence[str], coord: str, tolerance: int = 20) -> DataFrame:
    """(keys, pos, center, n): runs of sorted coordinates whose neighbours differ by at most tolerance; centers are
    truncated means, pos counts from 0."""
    w = Window.partitionBy(*keys).orderBy(coord)
    starts = F.when(F.col(coord) - F.lag(coord).over(w) > tolerance, 1).otherwise(0)
    runs = df.select(*keys, coord).withColumn("__new", starts).withColumn("pos", F.sum("__new").over(Window.partitionBy(*keys).orderBy(coord, F.desc("__new")).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "pos").agg(F.avg(coord).cast("long").alias("center"), F.count("*").alias("n"))


def spacing(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, k, cv): number of clusters and the variation coefficient of the gaps between centers (0 for one gap or
    none)."""
    gap = F.lead("center").over(Window.partitionBy(*keys).orderBy("pos")) - F.col("center")
    gaps = clusters.select(*keys, gap.alias("gap"))
    cv = F.coalesce(F.stddev_pop("gap") / (F.avg("gap") + 1e-6), F.lit(0.0))
    return gaps.groupBy(*keys).agg(F.count("*").alias("k"), cv.alias("cv"))


def grid_score(rows: DataFrame, cols: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score) from (keys, pos, center) of row and column lines: 1 less the mean variation, at least 0."""
    r, c = (spacing(x, keys).select(*keys, F.col("k").alias(f"{n}_k"), F.col("cv").alias(f"{n}_cv")) for x, n in ((rows, "r"), (cols, "c")))
    score = F.when((F.col("r_k") < 2) | (F.col("c_k") < 2), 0.0).otherwise(1.0 - F.least((F.col("r_cv") + F.col("c_cv")) / 2, F.lit(1.0)))
    return r.join(c, list(keys)).select(*keys, score.alias("score"))


def peaks(profile: np.ndarray, threshold: float = 0.15) -> list[int]:
    """Places of lines in a dense profile: smoothed by a box over a hundredth of the length, the first greatest place of
    each run above the threshold, with the borders added where lines are far from them, and lines nearer than a fiftieth
    of the length to the last kept one left out. A profile of zeros has none."""
    n = len(profile)
    top = profile.max() if n else 0
    if top <= 0:
        return []
    half = (max(3, n // 100) | 1) // 2
    # The box's sum is a difference of running sums of whole numbers, so it is exact for any width.
    upto = np.concatenate([[0.0], np.cumsum(profile, dtype=np.float64)])
    at = np.arange(n)
    smooth = (upto[np.minimum(at + half + 1, n)] - upto[np.maximum(at - half, 0)]) / top / (2 * half + 1)
    cuts = np.flatnonzero(np.diff(np.concatenate([[False], smooth > threshold, [False]]).astype(int)))
    found = [int(a + smooth[a:b].argmax()) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    if found:
        found = [0] * (found[0] > 10) + found + [n - 1] * (found[-1] < n - 10)
    kept: list[int] = []
    for p in found:
        if not kept or p - kept[-1] > n // 50:
            kept.append(p)
    return kept


def line_peaks(profiles: DataFrame, keys: Sequence[str], threshold: float = 0.15) -> DataFrame:
    """(keys, peaks array<int>) of dense profiles (keys, pos from 0, value), by the rule of peaks(); profiles without any
    have no row. A profile is one array, which one Arrow pass reads."""

    def fold(bounds: np.ndarray, d: dict[str, np.ndarray]) -> Taken:
        found = [peaks(d["value"][at:end], threshold) for at, end in zip(bounds[:-1], bounds[1:], strict=True)]
        some = [i for i, f in enumerate(found) if f]
        return bounds[:-1][some], {"peaks": [found[i] for i in some]}

    lists = listed(profiles.withColumn("value", F.col("value").cast("double")), keys, ["value"], F.col("pos"))
    return folded(lists, fold, {"peaks": "array<int>"}, [])


def regular(k: Column, cv: Column, least: int = 2, most: float = 0.5) -> Column:
    return (k >= least) & (cv <= most)
