"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, own, scratch

#: Rows that share source, size and a slice of them, about; such a slice is ranked in one task.
SLICE = 4096
#: Newton stops when every source's words are this near their target, as a share of it, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 60
#: Rounds that are planned as one job.
BATCH = 4


def words(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A key that sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("~"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size): share of all sizes, dealt by weights that repeat in the
    order of the keys; a target stops at most times its source's size and the excess goes to the others by weight.

    With a level t, targets are min(most * size, weight * t); the level that meets the sum is found from running sums
    of the sources by the level at which they stop. These windows see one row for each source, in one task: some hundred
    bytes for each, so millions of sources are within its reach.
    """
    deal = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(deal, ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("w"))
    before = Window.orderBy("stop", "skey").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped, weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    total = share * F.sum("source_size").over(every)
    levels = ranked.select("stop", ((total - capped) / (F.sum("w").over(every) - weight)).alias("level"))
    level = levels.where("level <= stop").agg(F.min_by("level", F.struct("stop", "level"))).first()[0]
    return ranked.select("skey", "source_size", F.least("cap", F.col("w") * F.lit(float(level or 0.0))).alias("target"))


def tilts(hist: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(skey, tilt, mean) that solve the dual: over a source, the sum of n * size * min(most, exp(tilt * size / mean)) is
    its target. hist: (skey, size, n) with sizes above 0.

    The rates are nearest to one copy each, in entropy, among those that meet the word constraint and stay within most.
    Newton steps on the convex dual run for all sources at once, one grouped sum over the histogram for each round; a
    step that leaves its bracket becomes a bisection. One number reaches the driver each round, the greatest miss.
    """
    stats = hist.groupBy("skey").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    start = targets.join(stats, "skey").where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)))
    wanted = F.log(F.col("target") / F.col("source_size"))
    unit = F.col("mean") / F.col("least")
    state = start.select("skey", "mean", "target", F.least(wanted * unit, F.lit(-1e-9)).alias("lo"), (F.log(F.lit(float(most))) * unit).alias("hi"), wanted.alias("tilt"))
    state = materialize(state, "tilts")
    for at in range(1, ROUNDS + 1):
        x = F.col("size") / F.col("mean")
        grown = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        mass = F.col("n") * F.col("size")
        sums = hist.join(state, "skey").groupBy("skey", "mean", "target", "lo", "hi", "tilt").agg(F.sum(mass * F.least(F.lit(float(most)), grown)).alias("f"), F.sum(F.when(grown < most, mass * x * grown).otherwise(0.0)).alias("slope"))
        lo, hi = F.when(F.col("f") < F.col("target"), F.col("tilt")).otherwise(F.col("lo")), F.when(F.col("f") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - (F.col("f") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        sums = sums.withColumns({"lo": lo, "hi": hi, "miss": F.abs(F.col("f") - F.col("target")) / F.col("target"), "step": step})
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        moved = F.when(F.col("miss") <= TOLERANCE, F.col("tilt")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = sums.select("skey", "mean", "target", "lo", "hi", moved.alias("tilt"), "miss")
        if at % BATCH:
            continue
        state = materialize(state, "tilts")
        if (state.agg(F.max("miss")).first()[0] or 0) <= TOLERANCE:
            break
    return state.select("skey", "tilt", "mean")


def _rates(hist: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(skey, size, base, part): whole copies and the fraction of one more for rows of each source and size; targets:
    (skey, source_size, target) over the rows of hist."""
    tilt = tilts(hist, targets, most)
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    grown = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(700.0))))
    rate = F.round(F.when(full, float(most)).when(F.col("target") <= 0, 0.0).otherwise(grown), 9)
    cells = hist.join(targets, "skey").join(tilt, "skey", "left").withColumn("rate", rate)
    return materialize(cells.select("skey", "size", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("part")), "rates")


def _rounded(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """(skey, size, slice, n, base, extra): how many rows of each slice get one copy more, by systematic rounding of the
    running sum of fractions over a source's slices in order of size."""
    order = Window.partitionBy("skey").orderBy("size", "slice")
    mass = F.sum(F.col("n") * F.col("part"))
    to, at = mass.over(order.rowsBetween(Window.unboundedPreceding, 0)), mass.over(order.rowsBetween(Window.unboundedPreceding, -1))
    extra = F.floor(to + 0.5) - F.floor(F.coalesce(at, F.lit(0.0)) + 0.5)
    return counts.join(rates, ["skey", "size"]).select("skey", "size", "slice", "n", "base", extra.alias("extra"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, small: float = 0.4) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs (doc_id, text, source).

    Rates come from tilts() and depend on source and size alone; sources at their cap take every row most times.
    They become copies by systematic rounding, and a hash of doc_id and text says which rows of a slice get the extra
    ones, so reruns agree. A source's long rows are rounded first; what they miss is added to the target of its short rows
    (those that hold the share ``small`` of its words), whose dual is solved again, so the words miss the target by no more
    than about half of the longest short row. Null text has size 0, null source is a source of its own, rows that
    repeat are rows of their own, texts are counted whole, an empty table gives no rows and further columns are ignored.
    Only (id, source, size, a hash of the text) is shuffled; rows meet first by source and size, so one huge source or
    group of copies is summed before it moves and is ranked in slices.
    """
    with scratch(docs.sparkSession):
        own, slices, cells, targets = _planned(docs, weights, share, most, small)
    rows = _sliced(own, slices)
    rank = F.row_number().over(Window.partitionBy("skey", "size", "slice").orderBy(F.xxhash64("doc_id", "said", F.lit(13)), "doc_id"))
    got = rows.withColumn("rank", rank).join(cells, ["skey", "size", "slice"], "left").join(targets, "skey")
    copies = F.coalesce(F.col("base"), F.lit(0)) + F.when(F.col("rank") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    got = got.withColumn("copies", copies.cast("long"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _sliced(own: DataFrame, slices: DataFrame) -> DataFrame:
    return own.join(slices, ["skey", "size"]).withColumn("slice", F.pmod(F.xxhash64("doc_id", "said", F.lit(11)), F.col("slices")))


def _planned(docs: DataFrame, weights: Sequence[float], share: float, most: float, small: float) -> tuple[DataFrame, ...]:
    """What mix() joins, as written tables: rows, slices of each source and size, copies of each slice, targets."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source_key(F.col("source")).alias("skey"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("said"))
    own = materialize(own, "sizes", outlast=1)
    hist = own.groupBy("skey", "size").agg(F.count("*").alias("n"))
    below = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("skey"))
    hist = materialize(hist.withColumn("short", below <= small * whole), "histogram")
    targets = materialize(source_targets(hist.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most), "targets", outlast=1)

    slices = materialize(hist.select("skey", "size", F.ceil(F.col("n") / SLICE).alias("slices")), "sliced", outlast=1)
    counts = materialize(_sliced(own, slices).groupBy("skey", "size", "slice").agg(F.count("*").alias("n")), "slices")
    filled, mass = hist.where("size > 0"), F.sum(F.col("n") * F.col("size"))
    first = _rates(filled.drop("short"), targets, most)
    long_ones = materialize(_rounded(counts, first.join(filled.where("not short").select("skey", "size"), ["skey", "size"], "left_semi")), "long")
    taken = long_ones.groupBy("skey").agg(F.sum((F.col("n") * F.col("base") + F.col("extra")) * F.col("size")).alias("taken"))
    short = filled.where("short").drop("short")
    left = targets.select("skey", "target").join(taken, "skey", "left").join(short.groupBy("skey").agg(mass.alias("source_size")), "skey")
    left = left.select("skey", "source_size", F.greatest(F.lit(0.0), F.col("target") - F.coalesce("taken", F.lit(0))).alias("target"))
    cells = long_ones.unionByName(_rounded(counts, _rates(short, materialize(left, "left"), most))).select("skey", "size", "slice", "base", "extra")
    return own, slices, materialize(cells, "cells", outlast=1), targets


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as many times as the mix takes it. Rows that share a doc_id (or a null one) are taken as often
    as the one of them that is taken most. Columns and their names are those of docs; null texts and those without words
    go, as the mix takes none of their words; an empty table stays empty."""
    key, copies, copy = fresh(docs.columns, "__id", "__copies", "__copy")
    times = mix(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    met = docs.join(times.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*own(docs))
