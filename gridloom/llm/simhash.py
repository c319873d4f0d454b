"""SimHash near-duplicate groups through vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, maybe_in, own, scratch, without
from .components import components
from .vptree import Forest, Parts, Tree, close_pairs, spanning

#: Fingerprints by which a tree's top is balanced, at most about so many, and never more than a quarter of all; shards
#: beyond which points are dealt by parts of their bits instead, as a point is in 4 of 64 shards of a top, but in 80 of
#: 65,536.
SAMPLE, TOP_MOST = 8192, 64
#: Fingerprints that a shard is planned for, and rows beyond which it is split into blocks.
SHARD, SHARD_MOST = 16_384, 200_000
#: Shingles hashed at once, and shingle hashes beyond which a family of candidates is dealt into blocks.
CHUNK, SETS_MOST = 1 << 15, 1 << 22


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each k-word shingle, repeats included, in blocks; no block if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= k:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - k + 1], end[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), CHUNK):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(start[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """A further 64-bit hash of each hash; the first is the hash itself."""
    if not n:
        return h
    h = h + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash(text: str | None, k: int, parts: int = 1) -> tuple[np.ndarray, int]:
    """(fingerprint as 64-bit parts, shingles): a bit is set if it is set in over half the hashes; no words: zero."""
    return _voted(shingle_hashes(text, k), parts)


def _voted(hashes: Iterable[np.ndarray], parts: int) -> tuple[np.ndarray, int]:
    total, votes = 0, np.zeros((parts, 64), np.int64)
    for h in hashes:
        total += len(h)
        for p in range(parts):
            votes[p] += np.unpackbits(_mixed(h, p).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((votes * 2 > total).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0], total


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The hashes of the text's distinct k-word shingles, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text, k), np.empty(0, np.uint64)]))


def set_simhash(text: str | None, k: int, parts: int) -> tuple[np.ndarray, int]:
    """As simhash, but each distinct shingle counts once, as it does in the similarity of sets."""
    own = shingle_set(text, k)
    return _voted((own[at : at + CHUNK] for at in range(0, len(own), CHUNK)), parts)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row: the 64-bit SimHash over k-word shingles, as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, k)[0][0] for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    """The rows by whose fp a tree's top is balanced."""
    every = max(4, math.ceil(n / SAMPLE))
    return rows.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(every)) == 0)


def _dealt(rows: DataFrame, keys: list[str], most: int, size: str | Column) -> DataFrame:
    """Adds columns own, i and j: groups whose sizes sum to over most are dealt into blocks, and a row of block own goes to
    every task (i, j), i <= j, of which own is one. Each pair of rows has one task, and a task holds two blocks at most."""
    large = rows.groupBy(*keys).agg(F.sum(size).alias("__size")).where(F.col("__size") > most)
    large = materialize(large.select(*keys, F.ceil(F.col("__size") / most).cast("int").alias("__n")), "large")
    dealt = rows.join(large, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("__n")).cast("int")).withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return dealt.withColumn("i", F.least("own", "__at")).withColumn("j", F.greatest("own", "__at")).drop("__n", "__at")


def dealt_pairs(fps: np.ndarray, home: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The close pairs of a task of _dealt: those of its one block, or those that lie across its two."""
    second = own != own.min() if len(own) else home
    if not second.any():
        yield from close_pairs(fps, home, radius)
        return
    for homes, others in ((home & second, ~second), (home & ~second, second & ~home)):
        at = np.flatnonzero(homes | others)
        for a, b in close_pairs(fps[at], homes[at], radius, among=False):
            yield at[a], at[b]


def linked_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints (column fp) reachable by steps of at most radius bits.

    The tops of a vantage-point tree deal fingerprints to shards, boundary points also to the shards that their ball
    overlaps; beyond TOP_MOST shards they are dealt by parts of their bits. A shard searches its own tree and returns a
    spanning forest of the links found, never all pairs. Shards of over SHARD_MOST rows are dealt into blocks, of which a
    task holds two at most.
    """
    n = fps.agg(F.approx_count_distinct("fp")).first()[0]
    shards = 1 if n <= SHARD else math.ceil(n / SHARD)
    tree = Tree(radius) if shards == 1 else Parts(radius, 64, shards)
    if 1 < shards <= TOP_MOST:
        tree = Tree.build(np.sort(_sampled(fps, n).select("fp").toArrow()["fp"].to_numpy().view(np.uint64)), shards, radius)

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            idx, shard, home = tree.route(fp.view(np.uint64))
            yield pd.DataFrame({"shard": shard.astype(np.int32), "home": home, "fp": fp[idx]})

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64)
        forest = Forest(len(fp))
        for a, b in dealt_pairs(fp.view(np.uint64), group["home"].to_numpy(bool), group["own"].to_numpy(np.int64), radius):
            forest.union(a, b)
        root = forest.roots(np.arange(len(fp)))
        out = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[root[out]], "b": fp[out]})

    routed = _dealt(fps.select("fp").mapInPandas(route, "shard int, home boolean, fp long"), ["shard"], SHARD_MOST, F.lit(1))
    return routed.groupBy("shard", "i", "j").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text; further columns are ignored).

    Fingerprints link at radius or fewer differing bits; component_id is the smallest doc_id reachable. Null and empty
    texts and texts of white space have fingerprint zero and link like any other. Repeated rows each return. A null
    doc_id keeps its row; it never names a component unless nothing else is in it. An empty table gives no rows.
    Equal fingerprints meet once: what follows the first aggregation grows with distinct fingerprints alone. The named
    fingerprints are written, so that the last join is one of two tables, whose skewed fingerprints Spark can split.
    """
    with scratch(docs.sparkSession):
        found = materialize(fingerprints(docs, k), "fingerprints", outlast=1)
        fps = found.groupBy("fp").agg(F.min("doc_id").alias("rep"))
        edges = materialize(linked_fingerprints(fps, radius), "links")
        comp = materialize(components(edges), "components")
        named = fps.join(comp, fps["fp"] == comp["node"]).groupBy("comp").agg(F.min("rep").alias("smallest"))
        to = comp.join(named, "comp").select("node", "smallest")
        by_fp = materialize(fps.join(to, fps["fp"] == to["node"], "left").select("fp", F.coalesce("smallest", "rep").alias("component_id")), "named", outlast=1)
    return found.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- documents whose word shingles are similar -----------------------------------------------------------------

#: Parts of 64 bits of a document's wide fingerprint.
PARTS = 4


def _tables(count: int, bits: int) -> list[np.ndarray]:
    """For each table the mask, over the parts, of the bits that it samples; fixed by the counts alone."""
    rng = np.random.default_rng(20_240_229)
    out = []
    while len(out) < count:
        order = rng.permutation(PARTS * 64)
        for at in range(0, PARTS * 64 - bits + 1, bits):
            mask = np.zeros(PARTS * 64, np.uint8)
            mask[order[at : at + bits]] = 1
            out.append(np.packbits(mask, bitorder="little").view(np.uint64))
    return out[:count]


def _gathered(wide: np.ndarray, mask: np.ndarray, bits: int) -> np.ndarray:
    """The sampled bits of each wide fingerprint as one 64-bit word."""
    flags = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")[:, np.unpackbits(mask.view(np.uint8), bitorder="little") == 1]
    word = np.zeros((len(wide), 64), np.uint8)
    word[:, :bits] = flags
    return np.packbits(word, axis=1, bitorder="little").view(np.uint64)[:, 0]


def similar_documents(docs: DataFrame, k: int = 5, similarity: float = 0.8, tables: int = 16, bits: int = 24, radius: int = 2) -> DataFrame:
    """(doc_id, group_id) of the rows of docs (doc_id, text; further columns are ignored) with a near copy, by smallest
    doc_id. Rows without doc_id take no part; of rows that repeat one, the one of smallest text does. Null and empty texts
    and texts of white space are copies of each other. An empty table gives no rows.

    Two documents link if the sets of their k-word shingles have Jaccard similarity of at least ``similarity``.
    Candidates: each of ``tables`` samples ``bits`` bits of a 256-bit SimHash, and a vantage-point tree finds the pairs
    within ``radius`` bits among documents whose numbers of distinct shingles allow the similarity. Every candidate is
    held against the exact shingle sets unless its ends are linked already. First come two edge-disjoint minimum spanning
    forests of a shard's candidates by wide distance, never all pairs. A family of candidates that these links leave in
    several parts, with pairs outside the forests, then meets again with its shingle sets, and all its pairs across parts
    are held inside the task; only links leave it. Bit sampling
    finds a pair of similarity 0.8 in some table with probability 0.99, one of 0.9 with over 0.9999; more tables raise
    both. Documents of equal words are one class from the start; only classes are searched and labelled.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return _similar(one_of_each(known), k, similarity, tables, bits, radius)


def _similar(docs: DataFrame, k: int, similarity: float, tables: int, bits: int, radius: int) -> DataFrame:
    masks = _tables(tables, bits)
    step = math.log(1 / similarity)

    def widen(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [set_simhash(t, k, PARTS) for t in b["text"]]
            wide = np.array([m[0] for m in made], np.uint64).reshape(-1, PARTS)
            same = [xxhash.xxh64_intdigest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()), 1) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "same": np.array(same, np.uint64).view(np.int64), "n": np.array([m[1] for m in made], np.int64), "wide": [w.tobytes() for w in wide]})

    wides = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(widen, "doc_id long, same long, n long, wide binary"), "wide")
    # Documents of equal words are one class, named by its smallest member.
    words = ["same", "n", "wide"]
    classes = materialize(wides.groupBy(*words).agg(F.min("doc_id").alias("fp"), F.count("*").alias("members")), "classes")

    n = classes.count()
    per_table = 1 if n <= 40 * SHARD else math.ceil(n / (40 * SHARD))
    trees = [Tree(radius) if per_table == 1 else Parts(radius, bits, per_table)] * tables
    if 1 < per_table <= TOP_MOST:
        rows = _sampled(classes, n).select("wide").toArrow()["wide"].to_pylist()
        sample = np.frombuffer(b"".join(rows), np.uint64).reshape(-1, PARTS)
        trees = [Tree.build(np.sort(_gathered(sample, m, bits)), per_table, radius) for m in masks]

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            wide = np.frombuffer(b"".join(b["wide"]), np.uint64).reshape(-1, PARTS)
            band = np.floor(np.log(np.maximum(b["n"].to_numpy(np.int64), 1)) / step).astype(np.int32)
            fp, blob, size = b["fp"].to_numpy(np.int64), b["wide"].to_numpy(object), b["n"].to_numpy(np.int64)
            for t, (mask, tree) in enumerate(zip(masks, trees, strict=True)):
                idx, shard, home = tree.route(_gathered(wide, mask, bits))
                for up in (0, 1):  # counts of a similar pair lie in one band or in two neighbours
                    yield pd.DataFrame({"t": np.int32(t), "band": band[idx] + up, "shard": shard.astype(np.int32), "home": home & (up == 0), "fp": fp[idx], "n": size[idx], "wide": blob[idx]})

    # Words of Hamming distance that a pair of the asked similarity exceeds with probability below 1e-4.
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = PARTS * 64 * angle + 4 * math.sqrt(PARTS * 64 * angle * (1 - angle))

    def likely(wide: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(wide distance, whether the pair is a candidate) of each pair."""
        w = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
        return w, (w <= most) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))

    shard = ["t", "band", "shard", "i", "j"]

    def link(group: pd.DataFrame) -> pd.DataFrame:
        wide = np.frombuffer(b"".join(group["wide"]), np.uint64).reshape(-1, PARTS)
        fp, size = group["fp"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        home = group["home"].to_numpy(bool)
        kept = [np.empty(0, np.int64)] * 3
        held = 0
        met = np.zeros(len(fp), np.int64)

        def thin() -> None:
            nonlocal kept, held
            a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else kept
            a, b, w = np.concatenate([kept[0], a]), np.concatenate([kept[1], b]), np.concatenate([kept[2], w])
            at = spanning(len(fp), a, b, w)
            rest = np.setdiff1d(np.arange(len(w)), at)
            at = np.concatenate([at, rest[spanning(len(fp), a[rest], b[rest], w[rest])]])
            kept, held = [a[at], b[at], w[at]], 0
            parts.clear()

        parts: list = []
        for a, b in dealt_pairs(_gathered(wide, masks[int(group["t"].iloc[0])], bits), home, group["own"].to_numpy(np.int64), radius):
            w, ok = likely(wide, size, a, b)
            if ok.any():
                parts.append((a[ok], b[ok], w[ok]))
                met += np.bincount(a[ok], minlength=len(fp))
                held += int(ok.sum())
            if held > 1 << 20:
                thin()
        thin()
        # Families with candidates outside the forests name their members, as rows of which a is b.
        forest = Forest(len(fp))
        forest.union(kept[0], kept[1])
        root = forest.roots(np.arange(len(fp)))
        more = np.bincount(root, met, len(fp)) > np.bincount(root[kept[0]], minlength=len(fp))
        at = np.flatnonzero(more[root])
        edge = {"root": np.int32(-1), "home": False, "a": np.minimum(fp[kept[0]], fp[kept[1]]), "b": np.maximum(fp[kept[0]], fp[kept[1]]), "n": np.int64(0), "wide": b""}
        member = {"root": root[at].astype(np.int32), "home": home[at], "a": fp[at], "b": fp[at], "n": size[at], "wide": group["wide"].to_numpy(object)[at]}
        return pd.concat([pd.DataFrame(edge), pd.DataFrame(member)]).assign(**{key: group[key].iloc[0] for key in shard})

    routed = _dealt(classes.select("fp", "n", "wide").mapInPandas(route, "t int, band int, shard int, home boolean, fp long, n long, wide binary"), ["t", "band", "shard"], SHARD_MOST, F.lit(1))
    found = materialize(routed.groupBy(*shard).applyInPandas(link, "t int, band int, shard int, i int, j int, root int, home boolean, a long, b long, n long, wide binary"), "candidates")
    edges = materialize(found.where("a <> b").select("a", "b").distinct(), "edges")

    ends = edges.select(F.col("a").alias("doc_id")).union(edges.select("b")).distinct()
    flagged, maybe = maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ends)
    texts = flagged.where(maybe).join(ends, "doc_id", "left_semi")

    def sets(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"], "hashes": [shingle_set(t, k).tobytes() for t in b["text"]]})

    def hold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    of = materialize(texts.select("doc_id", "text").mapInPandas(sets, "id long, hashes binary"), "shingles")
    pairs = edges.join(of.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    exact = pairs.mapInPandas(hold, "a long, b long")
    comp = materialize(components(exact), "components")

    # Families that are still in parts.
    family = [*shard, "root"]
    members = found.where("a = b").withColumnRenamed("a", "fp").drop("b")
    members = materialize(members.join(comp, members["fp"] == comp["node"], "left").withColumn("part", F.coalesce("comp", "fp")).drop("node", "comp"), "members")
    apart = materialize(members.groupBy(*family).agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select(*family), "apart")

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        wide = np.frombuffer(b"".join(group["wide"]), np.uint64).reshape(-1, PARTS)
        fp, size, t = group["fp"].to_numpy(np.int64), group["n"].to_numpy(np.int64), int(group["t"].iloc[0])
        hashes, coded = np.unique(np.frombuffer(b"".join(group["hashes"]), np.uint64), return_inverse=True)
        sets = np.split(coded.astype(np.int32), np.cumsum(size)[:-1])
        mark = np.zeros(len(hashes), bool)
        parts, part = np.unique(group["part"].to_numpy(np.int64), return_inverse=True)
        forest, links = Forest(len(parts)), []
        for a, b in dealt_pairs(_gathered(wide, masks[t], bits), group["home"].to_numpy(bool), group["own"].to_numpy(np.int64), radius):
            w, ok = likely(wide, size, a, b)
            ok &= forest.roots(part[a]) != forest.roots(part[b])
            for mask in masks[:t]:  # a pair that an earlier table finds is held there
                ok &= np.bitwise_count((wide[a] ^ wide[b]) & mask).sum(axis=1) > radius
            order = np.flatnonzero(ok)
            if not len(order):
                continue
            order = order[np.lexsort((w[order], a[order]))]
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
                x = int(a[low])
                mark[sets[x]] = True
                for at in range(low, high, 256):
                    ys = b[at : min(at + 256, high)]
                    ys = ys[forest.roots(part[ys]) != forest.roots(part[[x]])]
                    if not len(ys):
                        continue
                    starts = np.cumsum(size[ys]) - size[ys]
                    both = np.add.reduceat(mark[np.concatenate([sets[y] for y in ys])], starts, dtype=np.int64)
                    for y in ys[both >= similarity * (size[x] + size[ys] - both)].tolist():
                        if forest.roots(part[[x]])[0] != forest.roots(part[[y]])[0]:
                            forest.union(part[[x]], part[[y]])
                            links.append((fp[x], fp[y]))
                mark[sets[x]] = False
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    if not apart.isEmpty():
        met = members.join(apart, family, "left_semi").withColumnsRenamed({"i": "fi", "j": "fj"})
        family = ["t", "band", "shard", "fi", "fj", "root"]
        again = _dealt(met, family, SETS_MOST, "n")
        again = again.join(of.withColumnRenamed("id", "fp"), "fp")
        later = materialize(again.groupBy(*family, "i", "j").applyInPandas(settle, "a long, b long"), "later")
        if not later.isEmpty():
            comp = materialize(components(comp.selectExpr("node as a", "comp as b").union(later)), "components")
    linked = classes.join(comp, classes["fp"] == comp["node"], "left").where("members > 1 or comp is not null")
    linked = materialize(linked.select(*words, F.coalesce("comp", "fp").alias("group_id")), "groups")
    return wides.join(linked, words).select("doc_id", "group_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those that share a doc_id, the one of smallest text (null as empty; ties by a hash of the row).
    Rows with a null doc_id stay. Only rows of repeated ids are shuffled, and some that a bounded filter can't clear."""
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = materialize(again, "again")
    flagged, maybe = maybe_in(docs, "doc_id", again)
    key, row = fresh(flagged.columns, "__id", "__row")
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*(c for c, (_, kind) in zip(own(docs), docs.dtypes, strict=True) if "map<" not in kind)))
    twice = flagged.where(maybe).join(again.withColumnRenamed("id", key), F.col("doc_id").cast("long") == F.col(key), "left_semi")
    one = twice.groupBy("doc_id").agg(F.min_by(F.struct(*own(docs)), order).alias(row)).select(f"{row}.*")
    return without(docs, "doc_id", again).union(one)


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8, tables: int = 16, bits: int = 24, radius: int = 2) -> DataFrame:
    """docs without near copies: of each group of similar_documents() the row of smallest doc_id stays; rows of unique
    words stay as they are.

    Of rows that repeat a doc_id one stays, the one of smallest text. Rows with a null doc_id stay. Null and empty texts
    are copies of each other. Columns and their names are those of docs; an empty table stays empty. Texts are shuffled
    only for rows that a bounded filter can't clear.
    """
    single = one_of_each(docs)
    with scratch(docs.sparkSession):
        known = single.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        dropped = materialize(_similar(known, k, similarity, tables, bits, radius).where("doc_id <> group_id").select("doc_id"), "dropped", outlast=1)
    return without(single, "doc_id", dropped)
