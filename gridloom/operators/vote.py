"""Votes of recognition engines on the text of a cell."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import engine_weight, mean_similarity, normalized


def _lists(alternatives: DataFrame) -> DataFrame:
    """One row for each cell_id with its alternatives in engine order: pos, source, text, confidence, norm, score."""
    item = F.struct("pos", "source", "text", "confidence", F.coalesce(normalized(F.col("text")), F.lit("")).alias("norm"), (F.col("confidence") * engine_weight(F.col("source"))).alias("score"), engine_weight(F.col("source")).alias("weight"))
    return alternatives.groupBy("cell_id").agg(F.sort_array(F.collect_list(item)).alias("a"))


def _best(items: Column, key: str) -> Column:
    """The item of greatest key, the first of equals."""
    top = F.array_max(F.transform(items, lambda x: F.struct(x[key].alias("k"), (-x["pos"]).alias("m"))))
    return F.filter(items, lambda x: x["pos"] == -top["m"])[0]


def _with_similarity(rows: DataFrame) -> DataFrame:
    """Adds sim, the mean similarity of norms (array of texts of any length), in one Arrow pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = pa.array([mean_similarity(n) for n in b.column("norms").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, sims], [*b.schema.names, "sim"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("sim", T.DoubleType())]))


def vote(alternatives: DataFrame) -> DataFrame:
    """(cell_id, text, confidence, needs_review, agreement, rung) of cells with alternatives (cell_id, pos, source, text,
    confidence). One engine: its text, to review below 0.6. Equal normalized texts: the best weighted confidence. Mean
    similarity above 0.8: the same. Three engines, two equal: the best of these, agreement 0.67. Else the engine of
    greatest weight, to review. Null texts count as empty; texts may have any length.
    """
    rows = _with_similarity(_lists(alternatives).withColumn("norms", F.transform("a", lambda x: x["norm"]))).withColumn("n", F.size("a"))
    groups = F.filter("norms", lambda t: F.size(F.filter(F.col("norms"), lambda u: u == t)) >= 2)
    rows = rows.withColumn("distinct", F.size(F.array_distinct("norms"))).withColumn("major", F.try_element_at(groups, F.lit(1)))
    rung = F.when(F.col("n") == 1, "single").when(F.col("distinct") == 1, "all").when(F.col("sim") > 0.8, "similar").when((F.col("n") >= 3) & F.col("major").isNotNull(), "majority").otherwise("low")
    rows = rows.withColumn("rung", rung)
    chosen = F.when(F.col("rung") == "majority", _best(F.filter("a", lambda x: x["norm"] == F.col("major")), "score")).when(F.col("rung") == "low", _best(F.col("a"), "weight")).otherwise(_best(F.col("a"), "score"))
    agreement = F.when(F.col("rung").isin("single", "all"), 1.0).when(F.col("rung") == "majority", 0.67).otherwise(F.col("sim"))
    review = F.when(F.col("rung") == "single", F.col("c.confidence") < 0.6).otherwise(F.col("rung") == "low")
    return rows.withColumn("c", chosen).select("cell_id", F.col("c.text").alias("text"), F.col("c.confidence").alias("confidence"), review.alias("needs_review"), agreement.alias("agreement"), "rung")


def similarities(alternatives: DataFrame) -> DataFrame:
    """(cell_id, similarity) over the normalized texts of a cell."""
    return _with_similarity(_lists(alternatives).select("cell_id", F.transform("a", lambda x: x["norm"]).alias("norms"))).select("cell_id", F.col("sim").alias("similarity"))


def word_vote(alternatives: DataFrame) -> DataFrame:
    """(cell_id, text): at each place the word that most engines have there, the first seen of equals."""
    words = F.filter(F.split(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "), " "), lambda w: w != "")
    each = alternatives.select("cell_id", "pos", F.posexplode(words).alias("at", "word"))
    counts = each.groupBy("cell_id", "at", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("cell_id", "at").agg(F.max(F.struct("n", (-F.col("first")).alias("m"), "word"))["word"].alias("word"))
    said = best.groupBy("cell_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    return alternatives.select("cell_id").distinct().join(said, "cell_id", "left").select("cell_id", F.coalesce("text", F.lit("")).alias("text"))


def ranked(alternatives: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, tooltip) of cells (cell_id, text, disagreed): a title, an empty line, and the alternatives by descending
    engine weight, stable, each with a tick if it is the cell's text, the engine and percent. Cells without alternatives
    have an empty tooltip."""
    # Title lines and the tick are fixed values.
    title = F.when(F.col("disagreed"), "⚠ OCR engines disagreed:").otherwise("OCR Results:")
    item = F.struct((-engine_weight(F.col("source"))).alias("k"), "pos", "source", "text", "confidence")
    lists = alternatives.groupBy("cell_id").agg(F.sort_array(F.collect_list(item)).alias("a"))
    line = lambda x: F.concat(F.when(x["text"] == F.col("text"), "✓").otherwise(" "), F.lit(" "), F.upper(x["source"]), F.lit(': "'), x["text"], F.lit('" ('), (x["confidence"] * 100).cast("int"), F.lit("%)"))
    said = F.array_join(F.concat(F.array(title, F.lit("")), F.transform("a", line)), "\n")
    return cells.select("cell_id", "text", "disagreed").join(lists, "cell_id", "left").select("cell_id", F.when(F.col("a").isNull(), "").otherwise(said).alias("tooltip"))


__all__ = ["ranked", "similarities", "vote", "word_vote"]
