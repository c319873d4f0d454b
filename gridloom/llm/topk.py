"""Exact top-k inner products by block-at-a-time pruning over integer vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a shard and of a block of it, and queries that one task scores at once.
SHARD, BLOCK, QUERIES = 16_384, 64, 512


def quantized(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(row, vec_id, dim, v array<long>): floor(scale * x) of each component, and a number for each row, so that rows that
    share a vec_id, or have none, stay apart. Rows whose vector is null or holds a null or non-finite component take no
    part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    clean = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where(clean).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floats where they are exact, else by 64-bit integers, else by Python's."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max())) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 1 << 63 else a.astype(object) @ b.astype(object).T


def _arranged(v: np.ndarray) -> np.ndarray:
    """An order that puts like vectors in one block: by the nearest of a few fixed ones, then by the score there."""
    pivots = v[np.linspace(0, len(v) - 1, min(32, len(v))).astype(int)]
    score = v.astype(np.float64) @ pivots.astype(np.float64).T
    best = score.argmax(axis=1)
    return np.lexsort((-score[np.arange(len(v)), best], best))


#: A place in a list of results that holds nothing; the order of a null vec_id, after all others; a score below all.
NONE, NULL, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).max, -(1 << 62)


class Shard:
    """A forward index of vectors (row numbers, ids, vectors) in blocks of like ones, with each block's term maxima."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        order = _arranged(v)
        self.rows, self.ids, self.v = rows[order], ids[order], v[order]
        cuts = np.arange(0, len(v), BLOCK)
        self.blocks = len(cuts)
        self.top, self.low = np.maximum.reduceat(self.v, cuts, axis=0), np.minimum.reduceat(self.v, cuts, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and block, the sum over terms of the query's weight times the block's greatest (or, for negative
        weights, least) value: no vector of the block scores more."""
        return _products(np.maximum(q, 0), self.top) + _products(np.minimum(q, 0), self.low)

    def search(self, q_rows: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, first: int, most: int) -> tuple[np.ndarray, ...]:
        """(row, id, score) of the k best for each query as matrices, the greatest bound left and the vectors scored.

        Blocks are visited in descending order of their bound, from the first-th on and at most so many, until the bound
        is below the query's floor or its kth score so far; a block whose bound equals these is still scored, as it may
        hold a tie of smaller id. The query's own row is left out.
        """
        bound = self.bounds(q)
        visit = np.argsort(-bound, axis=1, kind="stable")
        n = len(q)
        scores = np.full((n, k), LEAST, bound.dtype)
        ids, rows = np.full((n, k), NONE, np.int64), np.full((n, k), NONE, np.int64)
        left, scored, live = np.full(n, LEAST, bound.dtype), np.zeros(n, np.int64), np.arange(n)
        for step in range(first, self.blocks):
            block = visit[live, step]
            on = (bound[live, block] >= floor[live]) & ((bound[live, block] >= scores[live, -1]) | (rows[live, -1] == NONE))
            live, block = live[on], block[on]
            if step - first == most:
                left[live] = bound[live, block]
                break
            if not len(live):
                break
            by = np.argsort(block, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                who, b = live[group], block[group[0]]
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                new = _products(q[who], self.v[at])
                scored[who] += new.shape[1]
                new_rows, new_ids = (np.broadcast_to(x[at], new.shape) for x in (self.rows, self.ids))
                self_ = new_rows == q_rows[who, None]
                new, new_rows = np.where(self_, LEAST, new), np.where(self_, NONE, new_rows)
                s, i, r = np.hstack([scores[who], new]), np.hstack([ids[who], np.where(self_, NONE, new_ids)]), np.hstack([rows[who], new_rows])
                best = np.lexsort((r, i, -s), axis=1)[:, :k]
                scores[who], ids[who], rows[who] = (np.take_along_axis(x, best, 1) for x in (s, i, r))
        return rows, ids, scores, left, scored


def _packed(rows: DataFrame, keys: list[str], name: str, columns: list[str]) -> DataFrame:
    """Rows packed by keys (int): the columns of each row, in order of row, end to end as bytes in columns name_column. A
    null vec_id is packed as NULL."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row")
        return pd.DataFrame({k: [int(g[k].iloc[0])] for k in keys} | {f"{name}_{c}": [np.array(g[c].tolist(), np.int64).tobytes()] for c in columns})

    schema = ", ".join([*(f"{k} int" for k in keys), *(f"{name}_{c} binary" for c in columns)])
    kept = rows.select(*(F.col(k).cast("int").alias(k) for k in keys), *(F.coalesce(c, F.lit(NULL)).alias(c) if c == "vec_id" else c for c in columns))
    return kept.groupBy(*keys).applyInPandas(pack, schema)


FOUND = ["query_row", "query_id", "shard", "vec_row", "vec_id", "score", "left", "scored"]


def _meet(met: DataFrame, k: int, first: int, most: int) -> DataFrame:
    """Searches each chunk of queries in the shard that it met. Rows of FOUND: the best, and one for each query and shard
    with vec_row NONE, the greatest bound left (LEAST if none is) and the number of vectors scored."""
    ints = lambda data: np.frombuffer(data, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                shard = Shard(ints(r.shard_row), ints(r.shard_vec_id), ints(r.shard_v).reshape(len(ints(r.shard_row)), -1))
                q_rows, q_ids, floors = ints(r.chunk_row), ints(r.chunk_vec_id), ints(r.chunk_floor)
                q = ints(r.chunk_v).reshape(len(q_rows), -1)
                for at in range(0, len(q), QUERIES):
                    part = slice(at, at + QUERIES)
                    rows, ids, scores, left, scored = shard.search(q_rows[part], q[part], k, floors[part], first, most)
                    i, c = np.nonzero(rows != NONE)
                    n, zero = len(left), np.zeros(len(i), np.int64)
                    none = np.zeros(n, np.int64)
                    made = [
                        np.concatenate([q_rows[part][i], q_rows[part]]), np.concatenate([q_ids[part][i], q_ids[part]]), np.full(len(i) + n, r.shard), np.concatenate([rows[i, c], none + NONE]),
                        np.concatenate([ids[i, c], none]), np.concatenate([scores[i, c].astype(np.int64), none]), np.concatenate([zero + LEAST, left.astype(np.int64)]), np.concatenate([zero, scored]),
                    ]
                    yield pd.DataFrame(dict(zip(FOUND, made, strict=True)))

    return met.mapInPandas(run, ", ".join(f"{c} long" for c in FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.where(F.col("vec_row") != NONE).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(rows: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, its k best other rows. Ties go to
    the smaller vec_id, null (as which 2^63 - 1 is read) last.

    Rows are told apart by a number, so rows that repeat a vec_id, or have none, are candidates like any other, and each
    row that asks has its own list. Vectors of other lengths than the query's are no candidates; further columns are
    ignored. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    best = _best(_search(rows, every, k, scale), k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NULL)).alias("vec_id"), "score")


def scored(rows: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, scored): how many vectors search() scores for each row that asks."""
    return _search(rows, every, k, scale).groupBy("query_row", "query_id").agg(F.sum("scored").alias("scored")).select("query_id", "scored")


def _search(rows: DataFrame, every: int, k: int, scale: int) -> DataFrame:
    """Rows of FOUND of two rounds. In the first, a query scores the block of greatest bound of each shard; the kth best
    of what all shards found is its floor everywhere. In the second it goes on only in the shards that have a block left
    whose bound reaches the floor. Chunks of queries meet shards by an equi join, each pair in one task of bounded size,
    and a shard returns k rows for a query, of which a partial limit keeps k before the last shuffle."""
    v = materialize(quantized(rows, scale), "vectors")
    n_shards = max(1, math.ceil(v.count() / SHARD))
    shards = materialize(_packed(v.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards))), ["dim", "shard"], "shard", ["row", "vec_id", "v"]), "shards")
    asking = v.where(F.col("vec_id") % every == 0)
    n_chunks = max(1, math.ceil(asking.count() / (8 * QUERIES)))
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(n_chunks)))
    sent = ["row", "vec_id", "v", "floor"]

    chunks = _packed(asking.withColumn("floor", F.lit(LEAST)), ["dim", "chunk"], "chunk", sent)
    everywhere = chunks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    first = materialize(_meet(everywhere.join(shards, ["dim", "shard"]), k, 0, 1), "found")

    floors = _best(first, k).where(F.col("rank") == k).select("query_row", F.col("score").alias("floor"))
    left = first.where((F.col("vec_row") == NONE) & (F.col("left") > LEAST)).select("query_row", "shard", "left").join(floors, "query_row", "left")
    on = left.where("floor is null or left >= floor").select("query_row", "shard", F.coalesce("floor", F.lit(LEAST)).alias("floor"))
    again = _packed(asking.join(on, asking["row"] == on["query_row"]), ["dim", "shard", "chunk"], "chunk", sent)
    second = materialize(_meet(again.join(shards, ["dim", "shard"]), k, 1, 1 << 40), "found")
    return first.union(second)
