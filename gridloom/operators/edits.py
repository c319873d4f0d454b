"""Review edits as an ordered log: undo and redo, latest values, recent files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live_edits(log: DataFrame) -> DataFrame:
    """(project, seq, row, col, new_text) of the edits that undo and redo leave in force.

    log: project, seq, kind (edit, undo, redo, or others, which pass), row, col, new_text. A project has one stack; an
    edit drops what could be redone. The stack is a fold over a project's ordered log: its done entries and a count of
    those undone at its end.
    """
    item = F.struct("seq", "kind", "row", "col", "new_text")
    per = log.groupBy("project").agg(F.sort_array(F.collect_list(item)).alias("l"))
    none = F.filter("l", lambda e: F.lit(False))
    start = F.struct(none.alias("done"), F.lit(0).alias("undone"))

    def step(s: Column, e: Column) -> Column:
        depth = F.size(s["done"]) - s["undone"]
        pushed = F.struct(F.array_append(F.slice(s["done"], F.lit(1), depth), e).alias("done"), F.lit(0).alias("undone"))
        undone = F.struct(s["done"].alias("done"), F.least(s["undone"] + 1, F.size(s["done"])).alias("undone"))
        redone = F.struct(s["done"].alias("done"), F.greatest(s["undone"] - 1, F.lit(0)).alias("undone"))
        return F.when(e["kind"] == "edit", pushed).when(e["kind"] == "undo", undone).when(e["kind"] == "redo", redone).otherwise(s)

    done = per.withColumn("s", F.aggregate("l", start, step))
    kept = done.select("project", F.explode(F.slice(F.col("s.done"), F.lit(1), F.size("s.done") - F.col("s.undone"))).alias("e"))
    return kept.select("project", "e.seq", "e.row", "e.col", "e.new_text")


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of each key by seq."""
    return log.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where("__at = 1").drop("__at")


def review_state(log: DataFrame) -> DataFrame:
    """(project, row, col, text, needs_review, reset) after alternatives, reviews and resets: the last text given by an
    apply, whether any apply or review cleared the flag, and whether the last word is a reset to the original."""
    on = log.where(F.col("kind").isin("apply", "review", "reset"))
    last = lambda kinds, what: F.max_by(F.when(F.col("kind").isin(*kinds), what), F.when(F.col("kind").isin(*kinds), F.col("seq")))
    return on.groupBy("project", "row", "col").agg(
        last(["apply"], F.col("new_text")).alias("text"), (~F.bool_or(F.col("kind").isin("apply", "review"))).alias("needs_review"),
        (last(["apply", "reset"], F.col("kind")) == "reset").alias("reset"),
    )


def toggles(log: DataFrame, key: str) -> DataFrame:
    """(project, key, enabled, name) after toggle, all, none and rename events. all and none hold for every key of the
    project; blank names are ignored."""
    own = log.where(F.col("kind") == "toggle").select("project", key, "seq", F.col("value").alias("on"))
    whole = log.where(F.col("kind").isin("all", "none")).groupBy("project").agg(F.max(F.struct("seq", (F.col("kind") == "all").alias("on"))).alias("w"))
    mine = own.groupBy("project", key).agg(F.max(F.struct("seq", "on")).alias("t"))
    names = log.where((F.col("kind") == "rename") & (F.trim("name") != "")).groupBy("project", key).agg(F.max_by(F.trim("name"), "seq").alias("name"))
    keys = log.where(F.col(key).isNotNull()).select("project", key).distinct()
    got = keys.join(mine, ["project", key], "left").join(whole, "project", "left").join(names, ["project", key], "left")
    on = F.when(F.col("w").isNotNull() & (F.col("t").isNull() | (F.col("w.seq") > F.col("t.seq"))), F.col("w.on")).otherwise(F.coalesce("t.on", F.lit(True)))
    return got.select("project", key, on.alias("enabled"), "name")


def recent(log: DataFrame, item: str, most: int = 10) -> DataFrame:
    """(project, item, place): the items last seen, newest first, each once."""
    seen = log.groupBy("project", item).agg(F.max("seq").alias("seq"))
    at = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("seq")))
    return seen.withColumn("place", at).where(F.col("place") <= most).select("project", item, "place")
