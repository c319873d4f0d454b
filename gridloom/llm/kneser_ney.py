"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_in, scratch, without

#: Length of the n-grams and bits of a symbol. Symbols below PLAIN are code points; a greater code point is two symbols,
#: one of PAIRS heads and one of PAIRS tails, so that all up to U+3FFFF stay apart.
ORDER, BITS, PLAIN, PAIRS = 5, 12, 3072, 512
CLASSES = 1 << BITS
#: Entries of the model that are broadcast (12 bytes each); a larger model is joined with the distinct n-grams of blocks of
#: documents, of about so many characters each.
MODEL_ROWS, BLOCK = 1 << 22, 1 << 24
#: Characters handled at once, and distinct n-grams that a task holds before it hands them on.
CHUNK, HELD = 1 << 18, 1 << 20
#: What a score holds.
SCORES = "doc_id long, lang string, n_chars long, logp double"
#: Of trusted documents, one in so many sets the thresholds and teaches nothing.
HELD_OUT = 5


def classes(text: str) -> np.ndarray:
    """Symbols of the characters, in lower case; all white space is a space, 0 is the boundary."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where((c <= 32) | (c == 0x85) | (c == 0xA0), 32, c)
    wide = c >= PLAIN
    if not wide.any():
        return c
    out = np.repeat(c, 1 + wide)
    tail = (np.cumsum(1 + wide) - 1)[wide]
    out[tail - 1], out[tail] = PLAIN + c[wide] // PAIRS % PAIRS, PLAIN + PAIRS + c[wide] % PAIRS
    return out


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed n-grams, index of the text of each) for every symbol of the texts, in blocks. A text begins with
    ORDER - 1 boundaries; a block inside a long text begins with the characters before it."""
    parts, owner, held = [], [], 0
    pad = np.zeros(ORDER - 1, np.int64)

    def packed() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(parts), np.repeat([o for o, _ in owner], [n for _, n in owner])

    for i, text in enumerate(texts):
        c = np.concatenate([pad, classes(text)])
        for at in range(0, len(c) - len(pad), CHUNK):
            piece = c[at : at + CHUNK + len(pad)]
            n = len(piece) - len(pad)
            g = np.zeros(n, np.int64)
            for k in range(ORDER):
                g = (g << BITS) | piece[k : k + n]
            parts.append(g)
            owner.append((i, n))
            held += n
            if held >= CHUNK:
                yield packed()
                parts, owner, held = [], [], 0
    if parts:
        yield packed()


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, c): how often each n-gram occurs over the whole texts of docs. Tasks sum before they shuffle."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            for g, _ in grams([t for t in b["text"] if t]):
                k, c = np.unique(g, return_counts=True)
                k, c = np.concatenate([keys, k]), np.concatenate([counts, c])
                order = np.argsort(k, kind="stable")
                k, c = k[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
                keys, counts = k[first], np.add.reduceat(c, first) if len(first) else c
                if len(keys) > HELD:
                    yield pd.DataFrame({"g": keys, "c": counts})
                    keys, counts = keys[:0], counts[:0]
        yield pd.DataFrame({"g": keys, "c": counts})

    return docs.select("text").mapInPandas(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n = dict.fromkeys((1, 2, 3, 4), 0) | {r["c"]: r["n"] for r in table.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.values()):
        return 0.5, 0.75, 0.9
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))


def _discount(d: tuple[float, float, float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


@dataclass
class Entries:
    """A share of the model as a hash table: what finds no place of its own waits in sorted order."""

    keys: np.ndarray
    values: np.ndarray

    def __post_init__(self) -> None:
        self.table = None

    def build(self) -> None:
        bits = max(10, math.ceil(math.log2(2 * max(1, len(self.keys)))))
        self.shift = np.uint64(64 - bits)
        self.table, self.at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        place = self._place(self.keys)
        _, first = np.unique(place, return_index=True)
        self.table[place[first]], self.at[place[first]] = self.keys[first], self.values[first]
        rest = np.setdiff1d(np.arange(len(self.keys)), first)
        order = rest[np.argsort(self.keys[rest])]
        self.more, self.more_values = self.keys[order], self.values[order]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found) of the keys."""
        if self.table is None:
            self.build()
        place = self._place(keys)
        there = self.table[place]
        found, values = there == keys, self.at[place]
        if len(self.more):
            look = np.flatnonzero(~found & (there >= 0))
            at = np.minimum(np.searchsorted(self.more, keys[look]), len(self.more) - 1)
            hit = self.more[at] == keys[look]
            found[look[hit]], values[look[hit]] = True, self.more_values[at[hit]]
        return values, found

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self.table = None


def _tagged(order: int, g: Column) -> Column:
    return g.bitwiseOR(F.lit(order << 60))


def _context(length: int, h: Column) -> Column:
    return h.bitwiseOR(F.lit(6 << 60 | length << 48))


def train(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(entries, single): the model of the whole texts of docs as a table (key, value), and the log-probabilities of the
    CLASSES single symbols.

    The highest order has the counts of n-grams; each lower one counts the distinct characters before its n-grams.
    An entry is an n-gram's interpolated log-probability or a context's log-weight of the next lower order; the
    recursion down the orders is one join of n-gram shards with their contexts and one with their endings for each
    order.
    """
    with scratch(docs.sparkSession):
        return _trained(docs)


def _trained(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    tables = {ORDER: materialize(count_grams(docs), "grams")}
    for k in range(ORDER - 1, 0, -1):
        ending = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        tables[k] = materialize(tables[k + 1].groupBy(ending.alias("g")).agg(F.count("*").alias("c")), "grams")

    d = _discounts(tables[1])
    single = tables[1].toArrow().to_pandas()  # at most CLASSES rows
    prob = np.full(CLASSES, 1 / CLASSES)
    if len(single):
        c = single["c"].to_numpy(np.float64)
        taken = np.select([c == 1, c == 2], d[:2], d[2])
        prob *= taken.sum() / c.sum()
        prob[single["g"].to_numpy(np.int64)] += (c - taken) / c.sum()
    lower = docs.sparkSession.createDataFrame(pd.DataFrame({"s": np.arange(CLASSES), "below": prob}))
    entries = None
    for k in range(2, ORDER + 1):
        d = _discounts(tables[k])
        rows = tables[k].select("g", "c", F.shiftright("g", BITS).alias("h"), F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("s"))
        contexts = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum(_discount(d)) / F.sum("c")).alias("left"))
        level = rows.join(contexts, "h").join(lower, "s").select("g", "h", ((F.col("c") - _discount(d)) / F.col("total") + F.col("left") * F.col("below")).alias("p"), "left")
        level = materialize(level, "level")
        made = level.select(_tagged(k, F.col("g")).alias("key"), F.log("p").cast("float").alias("value"))
        weights = level.groupBy("h").agg(F.first("left").alias("left")).select(_context(k - 1, F.col("h")).alias("key"), F.log("left").cast("float").alias("value"))
        made = made.union(weights)
        entries = made if entries is None else entries.union(made)
        lower = level.select(F.col("g").alias("s"), F.col("p").alias("below"))
    return materialize(entries, "model", outlast=1), np.log(prob)


def log_probabilities(g: np.ndarray, entries: Entries, single: np.ndarray) -> np.ndarray:
    """Natural logarithms of the characters' probabilities: the longest known n-gram, with the weights of the contexts
    that were too long."""
    out, left = np.zeros(len(g)), np.arange(len(g))
    for k in range(ORDER, 1, -1):
        part = g[left] & ((1 << BITS * k) - 1)
        value, found = entries.find(part | k << 60)
        out[left[found]] += value[found]
        left, part = left[~found], part[~found]
        if not len(left):
            return out
        value, found = entries.find(part >> BITS | 6 << 60 | (k - 1) << 48)
        out[left[found]] += value[found]
    out[left] += single[g[left] & (CLASSES - 1)]
    return out


def _broadcast_scores(source: DataFrame, entries: DataFrame, single: np.ndarray) -> DataFrame:
    got = entries.toArrow()
    sent = source.sparkSession.sparkContext.broadcast((Entries(got["key"].to_numpy(), got["value"].to_numpy()), single))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, alone = sent.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            chars, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for g, of in grams(texts):
                chars += np.bincount(of, minlength=len(texts))
                total += np.bincount(of, weights=log_probabilities(g, model, alone), minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(chars), pa.array(total)], ["doc_id", "lang", "n_chars", "logp"])

    return source.mapInArrow(run, SCORES)


def _blocks(source: DataFrame) -> DataFrame:
    """source with a column block: a task's rows in turn, about BLOCK characters to a block; a longer text ends its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            of = []
            for n in pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist():
                if held and held + n > BLOCK:
                    block, held = block + 1, 0
                held += n
                of.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of, pa.int64())], [*b.schema.names, "block"])

    return source.mapInArrow(run, "doc_id long, lang string, text string, block long")


def _distinct_grams(blocks: DataFrame) -> DataFrame:
    """(block, g): the distinct n-grams of each block; what a task must hand on early, or another task reads, repeats."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, held = None, [], 0

        def made() -> Iterator[pd.DataFrame]:
            if parts:
                yield pd.DataFrame({"block": at, "g": np.unique(np.concatenate(parts))})

        for b in batches:
            for block, rows in b.groupby("block", sort=False):
                if block != at:
                    yield from made()
                    at, parts, held = block, [], 0
                for g, _ in grams([t for t in rows["text"] if t]):
                    parts.append(np.unique(g))
                    held += len(parts[-1])
                    if held > 4 * HELD:
                        parts = [np.unique(np.concatenate(parts))]
                        held = len(parts[0])
                        if held > HELD:
                            yield from made()
                            parts, held = [], 0
        yield from made()

    return blocks.select("block", "text").mapInPandas(run, "block long, g long")


def _rated(wanted: DataFrame, entries: DataFrame, single: np.ndarray) -> DataFrame:
    """(g, logp) of each n-gram of wanted (g, distinct): of its endings, from two symbols up, the known ones have the
    model's value, the others that of the next shorter ending with the weight of the context that was too long."""
    spark, endings = wanted.sparkSession, {ORDER: wanted}
    for k in range(ORDER - 1, 1, -1):
        ending = F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1))
        endings[k] = materialize(endings[k + 1].select(ending.alias("g")).distinct(), "endings")
    below = spark.createDataFrame(pd.DataFrame({"s": np.arange(CLASSES), "below": single}))
    known, weights = entries.withColumnsRenamed({"value": "known"}), entries.withColumnsRenamed({"key": "context", "value": "weight"})
    for k in range(2, ORDER + 1):
        rows = endings[k].select("g", _tagged(k, F.col("g")).alias("key"), _context(k - 1, F.shiftright("g", BITS)).alias("context"), F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("s"))
        met = rows.join(known, "key", "left").join(weights, "context", "left").join(below, "s")
        logp = F.coalesce(F.col("known").cast("double"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) + F.col("below"))
        rated = materialize(met.select("g", logp.alias("logp")), "rated")
        below = rated.select(F.col("g").alias("s"), F.col("logp").alias("below"))
    return rated


def _joined_scores(source: DataFrame, entries: DataFrame, single: np.ndarray) -> DataFrame:
    blocks = materialize(_blocks(source), "blocks")
    found = materialize(_distinct_grams(blocks), "found")
    rated = _rated(materialize(found.select("g").distinct(), "endings"), entries, single)
    values = found.join(rated, "g").select("block", "g", "logp")

    def run(rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        keys, first = np.unique(values["g"].to_numpy(np.int64), return_index=True)
        logp, texts = values["logp"].to_numpy(np.float64)[first], [t or "" for t in rows["text"]]
        chars, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for g, of in grams(texts):
            chars += np.bincount(of, minlength=len(texts))
            total += np.bincount(of, weights=logp[np.searchsorted(keys, g)], minlength=len(texts))
        return pd.DataFrame({"doc_id": rows["doc_id"], "lang": rows["lang"], "n_chars": chars, "logp": total})

    # Ids go as text: pandas would make floats of a column that holds nulls.
    texts = blocks.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("block")
    scored = texts.cogroup(values.groupBy("block")).applyInPandas(run, SCORES.replace("doc_id long", "doc_id string"))
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def score(docs: DataFrame, entries: DataFrame, single: np.ndarray) -> DataFrame:
    """(doc_id, lang, n_chars, logp) of every row of docs (doc_id, text, lang; further columns are ignored): its whole
    text's symbols and their log-probability. Null and empty texts have none of either; rows that repeat a doc_id, or
    have none, stay apart; an empty table gives no rows.

    A model of at most MODEL_ROWS entries is broadcast. Beyond, documents are dealt into blocks; their distinct n-grams
    are rated by joins with the model's shards, one for each order, and meet the texts of their block again, so
    documents are read and moved once however large the model is.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    if entries.count() <= MODEL_ROWS:
        return materialize(_broadcast_scores(source, entries, single), "scores")
    with scratch(docs.sparkSession):
        return materialize(_joined_scores(source, entries, single), "scores", outlast=1)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05, prior_chars: int = 100) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, keep) of every row of docs (doc_id, text, lang).

    Trusted: documents with a label of quality 1 that no label calls toxic. Four in five of them teach the model; the
    others set a threshold for each language: the quantile of their perplexities times slack. Short texts' perplexities
    scatter, so a text counts as prior_chars further symbols of the language's mean. A language without held-out
    trusted documents has the threshold of all; without any, all texts stay. Null and empty texts have no perplexity
    and are rejected. Null lang is a language of its own. Labels join with doc_id through a bounded filter, so texts of
    unlabelled documents are not shuffled.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    trusted = materialize(good.where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HELD_OUT)) == 0).alias("held")), "trusted")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    teach = trusted.where("not held").select("doc_id")
    likely, maybe = maybe_in(own.select("doc_id", "text"), "doc_id", teach)
    taught = likely.where(maybe).join(teach.hint("shuffle_hash"), "doc_id", "left_semi")
    entries, single = train(taught)
    scores = score(own, entries, single).withColumn("lkey", F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("~")))

    held = materialize(scores.join(trusted.where("held").select("doc_id"), "doc_id", "left_semi").where("n_chars > 0"), "held")
    means = held.groupBy("lkey").agg((F.sum("logp") / F.sum("n_chars")).alias("mean"))
    world = held.agg((F.sum("logp") / F.sum("n_chars"))).first()[0]

    def shrunk(rows: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(world).cast("double"), F.col("logp") / F.col("n_chars"))
        surprise = -(F.col("logp") + prior_chars * mean) / (F.col("n_chars") + prior_chars)
        return rows.join(means, "lkey", "left").withColumn("surprise", F.when(F.col("n_chars") > 0, surprise))

    limit = F.percentile_approx("surprise", quantile, 10_000)
    sure = shrunk(held)
    limits = sure.groupBy("lkey").agg((F.exp(limit) * slack).alias("limit"))
    everywhere = sure.agg(F.exp(limit) * slack).first()[0]
    judged = shrunk(scores).join(limits, "lkey", "left").withColumn("threshold", F.coalesce("limit", F.lit(everywhere).cast("double")))
    keep = F.col("surprise").isNotNull() & (F.col("threshold").isNull() | (F.exp("surprise") <= F.col("threshold")))
    return judged.select("doc_id", "lang", "n_chars", F.exp("surprise").alias("perplexity"), "threshold", keep.alias("keep"))


def accepted(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs but those whose doc_id judged rejects; an id of which any row is kept stays. Rows with a null
    doc_id stay if they hold text. Columns and their names are those of docs. Texts are shuffled only for rows that a
    bounded filter can't clear."""
    gone = judged.where("doc_id is not null").groupBy("doc_id").agg(F.max("keep").alias("keep")).where("not keep").select("doc_id")
    return without(docs.where("doc_id is not null or length(text) > 0"), "doc_id", materialize(gone, "rejected"))
