"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, own, scratch

#: Buckets of hashed n-grams, lengths of the n-grams, and languages of a share of the model: a broadcast matrix is at most
#: BUCKETS x LANGUAGES floats of 4 bytes, 64 MB, whatever the corpus; further languages are further shares.
BUCKETS, LENGTHS, LANGUAGES = 1 << 16, (1, 2, 3), 256
#: Code points whose n-grams are hashed and scored at once.
CHUNK = 1 << 18
#: Added to each count.
SMOOTHING = 0.5


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each code point from the n-th on."""
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
    h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text of each) of all n-grams of the texts, in blocks of about CHUNK n-grams of one length. None crosses
    from a text to the next; a piece inside a long text begins with the code points before it, and counts n-grams that end
    after these."""
    codes, piece, new, of, size = [], [], [], [], 0

    def packed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        joined, owner, ends = (np.concatenate(x) for x in (codes, piece, new))
        for n in LENGTHS:
            whole = ends[n - 1 :] & (owner[n - 1 :] == owner[: len(owner) - n + 1])
            yield _buckets(joined, n)[whole], np.array(of)[owner[n - 1 :][whole]]

    for i, text in enumerate(texts):
        all_ = _codes(f" {text} ") if text else np.empty(0, np.uint32)
        for at in range(0, len(all_), CHUNK):
            early = min(at, max(LENGTHS) - 1)
            codes.append(all_[at - early : at + CHUNK])
            piece.append(np.full(len(codes[-1]), len(of)))
            new.append(np.arange(len(codes[-1])) >= early)
            of.append(i)
            size += len(codes[-1])
            if size >= CHUNK:
                yield from packed()
                codes, piece, new, of, size = [], [], [], [], 0
    if codes:
        yield from packed()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """A share of the languages, in order of code point."""

    languages: list[str]
    weights: np.ndarray  # (language, bucket) log-probabilities, float32
    prior: np.ndarray

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) log-likelihoods, and each text's number of n-grams: the n-grams of a batch of texts meet the
        matrix together, and each text's are summed where they lie."""
        total, n = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        for bucket, of in _blocks(texts):
            if not len(of):
                continue
            n += np.bincount(of, minlength=len(texts))
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for k, weights in enumerate(self.weights):
                total[of[first], k] += np.add.reduceat(weights[bucket], first, dtype=np.float64)
        return total, n


def train(docs: DataFrame, label: str = "lang") -> list[Model]:
    """Counts over the whole text of every row of docs whose label is not null and whose text has a letter; no models if
    there is none.

    Each task sums its rows and returns at most BUCKETS counts for a language, so the shuffle follows the number of
    tasks, and what reaches the driver at once the fixed size of a matrix of LANGUAGES languages. A language that occurs
    more often weighs more in the prior.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, rows in b.groupby("lang"):
                texts = [t for t in rows["text"] if has_letter(t)]
                if not texts:
                    continue
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[BUCKETS] += len(texts)
                for bucket, _ in _blocks(texts):
                    own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})

    rows = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("lang"), "text").mapInPandas(count, "lang string, bucket int, n long")
    with scratch(docs.sparkSession):
        summed = materialize(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
        docs_of = {r["lang"]: r["n"] for r in summed.where(F.col("bucket") == BUCKETS).collect()}
        languages, models = sorted(docs_of), []
        for at in range(0, len(languages), LANGUAGES):
            share = languages[at : at + LANGUAGES]
            got = summed.where((F.col("lang") >= share[0]) & (F.col("lang") <= share[-1]) & (F.col("bucket") < BUCKETS)).toArrow().to_pandas()
            counts = np.full((len(share), BUCKETS), SMOOTHING)
            counts[got["lang"].map({x: k for k, x in enumerate(share)}).to_numpy(np.int64), got["bucket"]] += got["n"]
            prior = np.log(np.array([docs_of[x] for x in share]) / sum(docs_of.values()))
            models.append(Model(share, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), prior))
    return models


def predictions(docs: DataFrame, models: list[Model], keep: list[str]) -> DataFrame:
    """The columns keep of docs with lang_pred and score, the language's probability given the whole text, from the text
    alone; und and 0 without a letter or without any learned language, ties to the first language by code point. Then
    logp, the text's log-likelihood in that language, and n_grams, the number of its n-grams.

    Each share of the model is broadcast and passed in turn, in one stage; a row carries the best language so far, its
    log-likelihood and the log of the sum over the languages seen.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    known = {c: x for c, x in zip(docs.columns, own(docs), strict=True)}
    out = docs.select(*(known[c].alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("__text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(float("-inf")).alias("__best"), F.lit(float("-inf")).alias("__all"), F.lit(0).cast("long").alias("__n"))
    for model in models:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for b in batches:
                texts = [t if has_letter(t) else None for t in b.column("__text").to_pylist()]
                total, n = m.totals(texts)
                best, sums, pred = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__best", "__all", "lang_pred"))
                at = total.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
                top = total[np.arange(len(texts)), at]
                here = np.array([t is not None for t in texts], bool) & (top > best)
                pred = np.where(here, np.array(m.languages, object)[at], pred)
                sums = np.logaddexp(sums, top + np.log(np.exp(total - top[:, None]).sum(axis=1)))
                made = {"lang_pred": pa.array(pred, pa.string()), "__best": pa.array(np.where(here, top, best)), "__all": pa.array(sums), "__n": pa.array(n)}
                yield pa.RecordBatch.from_arrays([made.get(n, b.column(i)) for i, n in enumerate(b.schema.names)], b.schema.names)

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema]))
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("__best") - F.col("__all"))))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"), F.col("__best").alias("logp"), F.col("__n").alias("n_grams"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id's text modulo 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang), from a model of the rows that are
    not held out.

    Rows whose lang is null teach nothing. Null texts and texts without a letter are und with score 0, as is every
    text if nothing could be learned. Repeated rows repeat; an empty table gives no rows; long texts are scored whole.
    """
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    models = train(flagged.where(~F.col("held_out")))
    return predictions(flagged, models, ["doc_id", "held_out"]).drop("logp", "n_grams")


def accepted(docs: DataFrame, least: float = 0.5, quantile: float = 0.01, margin: float = 0.5, prior_grams: int = 100) -> DataFrame:
    """The rows of docs whose language a model of the rows not held out names with at least the given probability, and
    whose n-grams are likely in it; null texts and texts without a letter go, as does every row if nothing could be
    learned. Columns and their names are those of docs, which may be any; repeated rows stay or go alike; an empty table
    stays empty.

    Over a whole text the probability is near 1 for the nearest learned language, so a text's mean log-likelihood of an
    n-gram tells whether it is of that language at all. Its limit lies as far below the given quantile of the language's
    own taught rows as that lies below their median, by margin at least. Short texts scatter, so a text counts as
    prior_grams further n-grams of the language's mean. The limits are broadcast, one row for each learned language.
    """
    models = train(docs.where(~held_out()).select("text", "lang"))
    judged = predictions(docs, models, docs.columns)
    rename = [f"__c{i}" for i in range(len(docs.columns))]
    judged = judged.toDF(*rename, "__pred", "__score", "__logp", "__n").where(F.col("__pred") != "und").where(F.col("__score") >= least)
    judged = materialize(judged, "languages")
    at = dict(zip(docs.columns, rename, strict=True))
    taught = judged.where(~held_out(at["doc_id"])).where(F.col(at["lang"]).cast("string") == F.col("__pred")).select("__pred", "__logp", "__n")
    means = materialize(taught.groupBy("__pred").agg((F.sum("__logp") / F.sum("__n")).alias("__mean")), "means")
    fit = (F.col("__logp") + prior_grams * F.col("__mean")) / (F.col("__n") + prior_grams)
    own_fits = taught.join(F.broadcast(means), "__pred").groupBy("__pred", "__mean").agg(F.percentile_approx(fit, [quantile, 0.5], 10_000).alias("q"))
    low, middle = F.col("q")[0], F.col("q")[1]
    limits = materialize(own_fits.select("__pred", "__mean", (low - F.greatest(middle - low, F.lit(margin))).alias("__limit")), "limits")
    kept = judged.join(F.broadcast(limits), "__pred", "left").where(F.col("__limit").isNull() | (fit >= F.col("__limit")))
    return kept.select(*(F.col(r).alias(c) for r, c in zip(rename, docs.columns, strict=True)))
