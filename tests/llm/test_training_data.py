"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats, clashing columns, and
against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, chat, kneser_ney, langid, media, mixing, queries, simhash, token_files, topk, url_rules, vptree
from gridloom.llm.common import new_path
from gridloom.llm.components import components
from gridloom.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, `__copy` int"
DATA = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows():
    rng = random.Random(7)
    base = [" ".join(rng.choice("the of house tree runs über été niño gross klein water light".split()) for _ in range(60)) for _ in range(12)]
    out = [(i, t, ["en", "de", "fr"][i % 3], ["b", "a", None, "c"][i % 4]) for i, t in enumerate(base)]
    out += [(20, base[0], "en", "a"), (21, base[1] + " more", "de", "a"), (22, None, None, None), (23, "", "en", "b"), (24, " \n\t ", "en", "b"), (25, "one", "en", "c"), (26, "123 !?", "fr", "c")]
    out += [(27, "long " * 20_000 + "x" * 5_000, "en", "c"), (28, "Ünï 漢字 🙂 <|endoftext|> it's IT'S", "de", "b"), (29, base[0], "en", "a"), (29, base[0], "en", "a"), (None, base[2], "fr", "a"), (2**60 + 1, "big id of a house", "en", "a")]
    return [(*r, 1, 2, "s", 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(26, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def plain_simhash(text, k):
    words = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_equal_brute_force(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    data = [(r[0], plain_simhash(r[1], 3)) for r in rows()]
    label = list(range(len(data)))
    for _ in data:
        for i, (_, a) in enumerate(data):
            for j, (_, b) in enumerate(data):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    small = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            small[label[i]] = min(small.get(label[i], d), d)
    want = sorted((str(d), f"{f:016x}", small.get(label[i])) for i, (d, f) in enumerate(data))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("shard", "most", "top"), [(50, 200_000, 64), (50, 40, 64), (10_000, 60, 64), (20, 200_000, 1), (20, 15, 1)])
def test_linked_fingerprints_are_the_same_however_they_are_dealt(spark, monkeypatch, shard, most, top):
    monkeypatch.setattr(simhash, "TOP_MOST", top)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.int64)
    near = base[:60] ^ (1 << rng.integers(0, 62, 60)) ^ (1 << rng.integers(0, 62, 60))
    fps = np.unique(np.concatenate([base, near]))
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "SHARD_MOST", most)
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = {r["node"]: r["comp"] for r in components(simhash.linked_fingerprints(frame)).collect()}
    forest = vptree.Forest(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps.view(np.uint64) ^ fps.view(np.uint64)[i]) <= 2)
        forest.union(np.full(len(j), i), j)
    root = forest.roots(np.arange(len(fps)))
    want = {int(fps[i]): int(fps[r]) for i, r in enumerate(root) if (root == r).sum() > 1}
    assert got == want


def test_spanning_forest_keeps_single_linkage():
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 9, 200)
    kept = vptree.spanning(30, a, b, w)
    for limit in range(9):
        full, part = vptree.Forest(30), vptree.Forest(30)
        full.union(a[w <= limit], b[w <= limit])
        part.union(a[kept][w[kept] <= limit], b[kept][w[kept] <= limit])
        assert (full.roots(np.arange(30)) == part.roots(np.arange(30))).all()


def test_deduplicate_keeps_one_of_each_group(docs, empty):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {20, 29} & set(ids) and 21 not in ids and {0, 1, 2, 22, 25, 26, 27, 28, None}.issubset(ids)
    assert len(ids) == len(set(ids))
    assert simhash.deduplicate(empty).count() == 0
    names = {"source": "__maybe", "lang": "a.b", "fp": "__gone", "size": "__row", "__copy": "__Bits"}
    clash = simhash.deduplicate(docs.withColumnsRenamed(names))
    assert clash.columns == [names.get(c, c) for c in docs.columns]
    assert sorted(map(str, clash.collect())) == sorted(map(str, kept.toDF(*clash.columns).collect()))


def test_similar_documents_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        words = [str(rng.randrange(10**6)) for _ in range(200)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            words = words[:]
            for at in rng.sample(range(200), rng.randrange(1, 6)):
                words[at] = str(rng.randrange(10**6))
            texts.append(" ".join(words))
    texts += [f"{texts[0]}\n{texts[0]}", texts[0].replace(" ", "  "), "", None, "one two", "One two"]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    forest = vptree.Forest(len(texts))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                forest.union(np.array([j]), np.array([i]))
    root = forest.roots(np.arange(len(texts))).tolist()
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    docs = spark.createDataFrame([*enumerate(texts), (3, "~ a later text of 3"), (None, texts[0])], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_documents(docs).collect()} == want
    monkeypatch.setattr(simhash, "SHARD_MOST", 7)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_documents(docs).collect()} == want
    monkeypatch.setattr(simhash, "SHARD", 0.5)
    monkeypatch.setattr(simhash, "TOP_MOST", 1)
    assert {r["doc_id"]: r["group_id"] for r in simhash.similar_documents(docs).collect()} == want


@pytest.mark.parametrize("most", [1 << 22, 40_000])
def test_similar_pairs_hidden_among_likely_ones_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SETS_MOST", most, raising=False)
    rng = random.Random(12)
    word = lambda: str(rng.randrange(10**8))
    shared = [word() for _ in range(404)]
    tails = [[word() for _ in range(63)] for _ in range(400)]
    for i in range(0, 60, 2):
        tails[i + 1][:18] = tails[i][:18]
    texts = [" ".join(shared + t) for t in tails]
    sets = [simhash.shingle_set(t, 5) for t in texts[:3]]
    similarity = [len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets[1:]]
    assert 0.82 < similarity[0] < 0.83 and 0.75 < similarity[1] < 0.77
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_documents(docs).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    h = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def test_token_files_round_trip(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write_shards(docs, new_path(spark, "t"), path, 2)
    t = Tokenizer.from_file(path)
    got = token_files.read_shards(spark, manifest).orderBy("start").collect()
    at = 0
    for row, r in zip(got, sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shard = next(s for m in manifest if 29 in (s := token_files.ShardReader(m["uri"])).keys.tolist())
    assert len(shard.get(29)) == 2 and shard.get(10**9) == []
    every = token_files.TokenFiles(manifest)
    assert [len(every.get(k)) for k in (0, 29, 2**60 + 1, 10**9, -1)] == [1, 2, 1, 0, 0]
    assert every.get(28)[0].tolist() == t.encode(rows()[-5][1], add_special_tokens=False).ids + [2]
    assert token_files.read_shards(spark, token_files.write_shards(empty, new_path(spark, "t"), path, 2)).count() == 0


def test_word_encoder_equals_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, rng = Tokenizer.from_file(path), token_files.WordEncoder(path), random.Random(6)
    monkeypatch.setattr(token_files, "BLOCK", 300)
    monkeypatch.setattr(token_files, "CACHE", 200)
    monkeypatch.setattr(token_files, "KEPT", 50)
    odd = ["a", "Bc", "ör", "Ñ", "İ", "Σ", "e\u0301", "\u0301", "ǅ", "ŉ", "ß", "'s", "'LL", "<|endoftext|>", "</w>", "7", "漢", "🙂", ",", ".", "|", "\xa0", "\x85", "\x1c", "\u2003", " ", "\n", "\t ", "ing", "the"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", None, "x" * 5000, "the house, " * 400]
    ids, sizes = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert len(e.place) <= 250


def test_quality_keeps_trusted_text_and_rejects_noise(spark, docs, labels, empty):
    rng = random.Random(3)
    words = "the house and a tree of water in light was near old river town".split()
    good = [(i, " ".join(rng.choice(words) for _ in range(80)), "en") for i in range(60)]
    bad = [(100 + i, "".join(chr(rng.randint(33, 90)) for _ in range(400)), "en") for i in range(5)]
    data = spark.createDataFrame([*good, *bad, (200, None, "en"), (201, "", None)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.judge(data, marks).collect()}
    assert all(got[i]["keep"] for i in range(60)) and not any(got[i]["keep"] for i in (100, 101, 102, 103, 104, 200, 201))
    assert kneser_ney.accepted(data, kneser_ney.judge(data, marks)).count() == 60
    assert kneser_ney.judge(docs, labels).count() == len(rows())
    assert kneser_ney.judge(empty, labels).count() == 0
    assert kneser_ney.judge(docs, labels.limit(0)).where("keep").count() == len(rows()) - 2


def test_model_is_a_distribution(spark):
    entries, single = kneser_ney.train(spark.createDataFrame([("abracadabra alakazam",), ("banana bandana",)], "text string"))
    got = entries.toArrow()
    model = kneser_ney.Entries(got["key"].to_numpy(), got["value"].to_numpy())
    assert np.isclose(np.exp(single).sum(), 1)
    for context in ("abra", "band", "zzzz", "\0\0\0\0"):
        c = [ord(x) for x in context]
        base = (c[0] << 36 | c[1] << 24 | c[2] << 12 | c[3]) << 12
        assert np.isclose(np.exp(kneser_ney.log_probabilities(base | np.arange(kneser_ney.CLASSES), model, single)).sum(), 1, atol=1e-5)


def plain_log_probabilities(teach, texts):
    """Log-probabilities of whole texts under the model that teach gives, by dictionaries and recursion."""
    n, size = kneser_ney.ORDER, kneser_ney.CLASSES

    def symbols(text):
        out = [0] * (n - 1)
        for c in map(ord, text.lower()):
            c = 32 if c <= 32 or c in (0x85, 0xA0) else c
            out += [c] if c < 3072 else [3072 + c // 512 % 512, 3584 + c % 512]
        return out

    def runs(text):
        s = symbols(text)
        return [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]

    count = {n: Counter(g for t in teach for g in runs(t))}
    for k in range(n - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    context = {k: defaultdict(list) for k in count}
    drop = {}
    for k, table in count.items():
        of = Counter(table.values())
        if all(of[i] for i in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            drop[k] = [min(i - 0.05, max(0.05, i - (i + 1) * y * of[i + 1] / of[i])) for i in (1, 2, 3)]
        else:
            drop[k] = [0.5, 0.75, 0.9]
        for g, c in table.items():
            context[k][g[:-1]].append(c)

    def probability(g):
        k = len(g)
        if not k:
            return 1 / size
        seen = context[k].get(g[:-1])
        if not seen:
            return probability(g[1:])
        cut = lambda c: drop[k][min(c, 3) - 1]
        c = count[k].get(g, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, seen)) * probability(g[1:])) / sum(seen)

    return [sum(math.log(probability(g)) for g in runs(t)) for t in texts]


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_scores_equal_a_plain_model(spark, monkeypatch, most):
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", most)
    rng = random.Random(8)
    teach = ["".join(rng.choice("aabcde fÉ漢字🙂\n") for _ in range(120)) for _ in range(6)]
    texts = [*teach[:2], "", "zz top", "漢漢 字é", "".join(rng.choice("abcdxyz 漢") for _ in range(300)), "a"]
    entries, single = kneser_ney.train(spark.createDataFrame([(t,) for t in teach], "text string"))
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["logp"] for r in kneser_ney.score(frame, entries, single).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_log_probabilities(teach, texts), rel=1e-5)


@pytest.mark.parametrize(("block", "held"), [(1 << 24, 1 << 20), (300, 10)])
def test_a_joined_model_scores_every_row_the_same(spark, docs, empty, monkeypatch, block, held):
    entries, single = kneser_ney.train(docs.select("text").limit(5))
    more = docs.union(docs.selectExpr("null", "concat(text, ' again')", *docs.columns[2:]))

    def scored():
        return sorted((str(r["doc_id"]), str(r["lang"]), r["n_chars"], round(r["logp"], 6)) for r in kneser_ney.score(more, entries, single).collect())

    once = scored()
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", 700)
    monkeypatch.setattr(kneser_ney, "BLOCK", block)
    monkeypatch.setattr(kneser_ney, "HELD", held)
    assert entries.count() > 700
    assert len(once) == 2 * len(rows()) and scored() == once
    assert kneser_ney.score(empty, entries, single).count() == 0


def test_mixture_meets_its_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in got)
    size = sum(r["size"] for r in got)
    by = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in by) == pytest.approx(1.5 * size) and all(t <= 2 * s + 1e-6 for s, t in by)
    for s, t in by:
        own = [r for r in got if (r["source_size"], r["target"]) == (s, t)]
        # copies are whole: a source that is nearly one document can only come within half of it
        assert abs(sum(r["taken"] for r in own) - t) <= max(0.1 * t, max(r["size"] for r in own) / 2)
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(5))).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    names = {"lang": "__id", "size": "__copies", "fp": "a.b"}
    clash = mixing.mixed_documents(docs.withColumnsRenamed(names).withColumn("__copy", F.lit(77)))
    assert clash.columns == [names.get(c, c) for c in docs.columns] and {r["__copy"] for r in clash.collect()} == {77}
    times = Counter(r["doc_id"] for r in clash.collect())
    assert times == Counter({d: n for d, n in Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect()).items()})
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def plain_targets(sizes):
    """Targets by source size: 3, 1, 2 in order of source, null last, 150% of all, 2 times a source's size at most."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def plain_copies(sizes, target):
    """Mean copies by size: min(2, exp(t * size)) with the t whose words meet the target, by bisection."""
    low, high = -50.0, 50.0
    words = lambda t: sum(s * min(2.0, math.exp(min(t * s, 50))) for s in sizes)
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if words(t) < target else (low, t)
    return {s: min(2.0, math.exp(min(low * s, 50))) for s in sizes}


def test_mixture_equals_plain_rates(spark):
    rng = random.Random(21)
    data = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 30])), rng.choice(["a", "b", "c", "d", None]) if i % 3 else "b") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)).collect()
    source = {i: s for i, _, s in data}
    by = defaultdict(list)
    for r in got:
        by[source[r["doc_id"]]].append(r)
    want = plain_targets({s: sum(r["size"] for r in own) for s, own in by.items()})
    for s, own in by.items():
        assert sorted({r["target"] for r in own}) == pytest.approx([want[s]])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 8
        rates = plain_copies([r["size"] for r in own], want[s])
        for size, rate in rates.items():
            same = [r for r in own if r["size"] == size]
            # short rows also make up for what the long ones miss in rounding
            assert sum(r["taken"] for r in same) / size / len(same) == pytest.approx(rate, abs=0.06 + 1 / len(same))


def test_bpe_equals_the_library(docs, empty):
    e = bpe.encoder(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=e.pairs.ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("aabcdeehtin'sSTR  \n\t\x85\xa0\x1c.,!?-_0123é漢🙂") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(b"".join(e.encode(text)), "<u4").tolist() == library.encode_ordinary(text)
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, RANKS, PATTERN).collect()}
    for r in rows():
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        assert tuple(got[r[0]])[1:] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())
    assert bpe.round_trip_digests(empty, RANKS, PATTERN).count() == 0


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(260, 8)).round(2)
    v[50:90] = v[0]
    data = [(i, [float(x) for x in v[i]]) for i in range(260)] + [(300, None), (301, [1.0, None]), (400, [float("nan")] * 8), (500, [1.0]), (501, [2.0]), (None, [1.0]), (500, [5.0]), (501, [2.0])]
    data += [(0, [float(x) for x in v[1] * 9]), (7, [float(x) for x in v[0] * 4]), (None, [float(x) for x in v[0] * 3]), (None, [float(x) for x in v[0]])]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in data], "vec_id long, embedding array<double>, row string, `__p.x` int").repartition(3)
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "BLOCK", 8)
    got = sorted((a, b, str(c), d) for a, b, c, d in topk.search(frame).collect())
    good = [(i, np.floor(np.array(x) * 1024).astype(np.int64)) for i, x in data if x and None not in x and np.isfinite(x).all()]
    want = []
    for at, (i, q) in enumerate(good):
        if i is not None and i % 100 == 0:
            s = sorted((-int(q @ w), j is None, j or 0) for k, (j, w) in enumerate(good) if k != at and len(w) == len(q))[:10]
            want += [(i, k + 1, str(None if null else j), -x) for k, (x, null, j) in enumerate(s)]
    assert got == sorted(want)
    assert topk.search(frame.limit(0)).count() == 0


def test_topk_leaves_vectors_unscored(spark, monkeypatch):
    rng = np.random.default_rng(10)
    v = np.abs(rng.normal(size=(2000, 64))) * (rng.random((2000, 64)) < 0.05)
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "SHARD", 500)
    monkeypatch.setattr(topk, "BLOCK", 16)
    told = topk.scored(frame).collect()
    assert len(told) == 20 and sum(r["scored"] for r in told) < 0.9 * 20 * 2000


def test_url_verdicts(spark):
    pages = [(i, f"http://bad.example.net/x{i}") for i in range(40)] + [(50, "HTTP://A.Example.ORG/es/1?q#f"), (51, "https://example.org/en/12"), (52, "https://x.com/fr/"), (53, "https://notexample.org/es/"), (54, None), (55, "nourl"), (56, "https://good.test/a"), (56, "https://good.test/a"), (57, "https://x.com#/fr/")]
    labels = spark.createDataFrame([(i, 0, 0) for i in range(30)] + [(56, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(frame, labels, rules).collect()}
    assert got[50] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[51][2:] == ("example.org/en/1", "block")
    assert got[52][2:] == ("com/fr/", "allow") and got[53][2:] == ("org/", "allow") and got[54] == ("", "", None, "allow") == got[55]
    assert got[35][3] == "block" and got[56][3] == "allow" and got[57][:3] == ("x.com", "", None)
    many = rules + [("block", f"h{i}.test", f"/{i}") for i in range(3000)] + [("block", "good.test", "/a"), ("allow", "a.b.test", "/")]
    more = spark.createDataFrame([(1, "http://x.h7.test/77"), (2, "http://h7.test/6"), (3, "http://good.test/ab"), (4, "http://.b.test/"), (5, "http://z.a.b.test")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in url_rules.judge(more, labels, many).collect()} == {1: "h7.test/7", 2: None, 3: "good.test/a", 4: None, 5: None}
    ends = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("uk",), ("x.y.z.city.jp",), ("",)], "host string")
    suffix, domain = url_rules.suffix_and_domain(ends["host"], ["co.uk", "z.city.jp"])
    assert [tuple(r) for r in ends.select(suffix, domain).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("z.city.jp", "y.z.city.jp"), ("", "")]
    assert url_rules.judge(frame, labels, rules).count() == len(pages) and url_rules.judge(frame.limit(0), labels.limit(0), rules).count() == 0


def test_language(spark, docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows()) and {r["lang_pred"] for r in got if r["doc_id"] in (22, 23, 24, 26)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (22, 23, 26)").count() == 0


def plain_languages(rows, texts, fits=None):
    """(language, probability) of texts by naive Bayes over rows (text, lang), with counts in dictionaries. Fits, a list,
    gets (language, log-likelihood, n-grams) of texts with a letter."""

    def buckets(text):
        codes = [ord(c) for c in f" {text} ".lower()]
        for n in langid.LENGTHS:
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                yield (h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 48

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in rows:
        if lang is not None and any(c.isalpha() for c in text or ""):
            counts[lang].update(buckets(text))
            docs[lang] += 1
    out = []
    for text in texts:
        if not docs or not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        totals = {}
        for lang in sorted(docs):
            mass = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            totals[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][x] + langid.SMOOTHING) / mass) for x in buckets(text))
        best = max(totals, key=totals.get)
        out.append((best, 1 / sum(math.exp(t - totals[best]) for t in totals.values())))
        if fits is not None:
            fits.append((best, totals[best], len(list(buckets(text)))))
    return out


def plain_accepted(rows):
    """The rows (id, text, lang, ...) that the language stage keeps, by the plain model and exact quantiles."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    teach = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]
    fits: list = []
    named = plain_languages([(r[1], r[2]) for r in teach], [r[1] for r in rows], fits)
    own = defaultdict(list)
    for r, f in zip(rows, fits, strict=True):
        if r in teach and r[2] == f[0]:
            own[f[0]].append(f)
    mean = {x: sum(t for _, t, _ in some) / sum(n for *_, n in some) for x, some in own.items()}
    fit = lambda f: (f[1] + 100 * mean[f[0]]) / (f[2] + 100)
    limit = {}
    for x, some in own.items():
        order = sorted(map(fit, some))
        low, middle = (order[math.ceil(q * len(order)) - 1] for q in (0.01, 0.5))
        limit[x] = low - max(middle - low, 0.5)
    return [r for r, (_, p), f in zip(rows, named, fits, strict=True) if p >= 0.5 and (f[0] not in limit or fit(f) >= limit[f[0]])]


def test_language_rejects_what_was_never_learned(spark):
    rng = random.Random(41)
    words = {"en": "the house and a tree of water in light was near old river town", "de": "das haus und ein baum von wasser im licht war nahe alter fluss stadt"}
    text = lambda some, n: " ".join(rng.choice(some.split()) for _ in range(n))
    data = [(i, text(words[lang], rng.randint(5, 150)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    other = "mitä kuuluu hyvää päivää talo järvi metsä ystävä kiitos työ yö"
    data += [(500 + i, text(other, 60), None) for i in range(5)] + [(600 + i, "дом вода лес " * 20, None) for i in range(3)] + [(700, "xqzj " * 200, None), (701, None, "en"), (702, "12 !", "de")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(2)
    got = sorted(r["doc_id"] for r in langid.accepted(frame).collect())
    assert got == list(range(120)) == sorted(r[0] for r in plain_accepted(data))


@pytest.mark.parametrize(("chunk", "languages"), [(1 << 18, 256), (50, 2)])
def test_language_equals_a_plain_model(spark, monkeypatch, chunk, languages):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    monkeypatch.setattr(langid, "LANGUAGES", languages)
    rng = random.Random(13)
    letters = {"en": "abc d", "de": "abcü d", "fr": "éabc ", "x y": "漢字 a", None: "abc"}
    data = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(0, 130))), lang) for i, lang in enumerate(list(letters) * 8)]
    data += [(100, None, "en"), (101, "12 !", "de"), (102, "b" * 400, "en"), (103, "a", "fr"), (103, "a", "fr"), (None, "üü d", "de")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(2)
    teach = [(t, lang) for i, t, lang in data if i is None or zlib.crc32(str(i).encode()) % 4 != 2]
    want = sorted((str(i), *w) for (i, _, _), w in zip(data, plain_languages(teach, [t for _, t, _ in data]), strict=True))
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in langid.identify(frame).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def test_chat_reads_back(spark):
    probe = "</s>[INST] ok [/INST]"
    long = "<|end|> x" * 60_000
    data = [(8, 0, "user", "q"), (8, 1, "assistant", long), (-7, 0, "user", probe), (-7, 1, "assistant", probe), (1, 1, "assistant", "b<|end|>\\<\\|"), (1, 0, None, None), (1, 1, "assistant", "a"), (None, 0, "user", "x<"), (2, None, "assistant", "")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(frame)).collect()}
    assert got[-7]["loss_chars"] == len(probe) and got[-7]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256("\n\nassistant\na\nassistant\nb<|end|>\\<\\|\n".encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 0
    assert got[8]["loss_chars"] == len(long) and got[8]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "a"]) for _ in range(rng.randint(0, 9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(x in safe for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_chat_parts(spark):
    parts = '[{"type":"text","text":"see <|image:0|> "},{"type":"image","ref":"a.png"},{"type":"audio","ref":"b.wav","tokens":7}]'
    frame = spark.createDataFrame([(1, 0, "user", None, parts)], "conv_id long, turn long, role string, text string, parts string")
    r = chat.format_conversations(frame).first()
    assert r["segment"].count("<|image:0|>") == 1 and r["expanded_tokens"] == 263 and [a["ref"] for a in r["attachments"]] == ["a.png", "b.wav"]
    with pytest.raises(ValueError, match="unknown kind"):
        chat.format_turn("user", [{"type": "video"}])


def test_media_round_trip(docs, empty):
    got = media.media_digests(media.media_columns(docs)).collect()
    assert len(got) == len(rows())
    by = {}
    for r in rows():
        by.setdefault(r[0], r[1])
    for r in got:
        data = (by[r["doc_id"]] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.media_digests(media.media_columns(empty)).count() == 0


def plain_png(png):
    """Gray samples of a PNG, byte by byte."""
    at, data, width = 8, b"", 0
    while at < len(png):
        size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        width = int.from_bytes(body[:4], "big") if kind == b"IHDR" else width
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    raw, out, above, kinds = zlib.decompress(data), [], [0] * width, set()
    for y in range(0, len(raw), width + 1):
        line, kind = list(raw[y + 1 : y + 1 + width]), raw[y]
        kinds.add(kind)
        for x in range(width):
            line[x] = (line[x] + (0, line[x - 1] if x else 0, above[x])[kind]) % 256
        out.append(line)
        above = line
    return np.array(out, np.float64), kinds


def plain_feature(samples):
    """Bits of the 8 x 8 lowest cosine terms above their median, of an image reduced to 32 x 32, by plain sums."""

    def reduced(x):
        n = len(x)
        if n < 32:
            return np.array([x[i * n // 32] for i in range(32)])
        cuts = [i * n // 32 for i in range(32)] + [n]
        return np.array([x[a:b].mean(axis=0) for a, b in zip(cuts, cuts[1:], strict=False)])

    small = reduced(reduced(samples).T).T
    wave = [[math.cos(math.pi / 32 * u * (x + 0.5)) for x in range(32)] for u in range(8)]
    terms = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(terms)
    middle = (middle[31] + middle[32]) / 2
    return f"{int(''.join(str(int(t > middle)) for t in terms), 2):016x}"


def test_media_equals_plain_reading(docs):
    stored = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in media.media_columns(docs).collect()}
    kinds = set()
    for r in media.media_digests(media.media_columns(docs)).collect():
        png = stored[r["doc_id"], r["n_bytes"]]
        samples, used = plain_png(png)
        kinds |= used
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), plain_feature(samples))
    assert kinds == {0, 1, 2}


def test_png_filters_and_checksums():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (12, 64), dtype=np.uint8)
    raw = np.zeros((12, 65), np.uint8)
    above = np.zeros(64, int)
    for y in range(12):
        kind, line = [0, 1, 2, 3, 4, 4, 4, 3, 3, 1, 2, 2][y], samples[y].astype(int)
        left, corner = np.concatenate([[0], line[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        best = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        raw[y, 0], raw[y, 1:] = kind, (line - [0, left, above, (left + above) // 2, best][kind]) % 256
        above = line
    assert (media._unfiltered(raw) == samples).all()
    png = media.encode_png(samples.tobytes())
    assert (media.decode_png(png) == samples).all()
    for broken in (png[:-1], png[:50] + bytes([png[50] ^ 1]) + png[51:], b"x" + png[1:]):
        with pytest.raises(ValueError):
            media.decode_png(broken)


def plain_quality(spark, data, marks):
    """Ids that the quality stage keeps: perplexity of whole texts under the plain model, against the 0.99 quantile of held
    trusted texts by language times 1.05, with 100 symbols of the language's mean."""
    bad = {d for d, q, t in marks if q != 1 or t}
    trusted = {d for d, *_ in marks if d is not None} - bad
    held = {r["d"] for r in spark.createDataFrame([(d,) for d in trusted], "d long").where(F.pmod(F.xxhash64("d", F.lit(5)), F.lit(5)) == 0).collect()}
    logs = plain_log_probabilities([t for d, t, *_ in data if d in trusted - held and t], [t or "" for _, t, *_ in data])
    size = lambda t: sum(1 + (ord(c) >= 3072) for c in (t or "").lower())
    rows = [(d, lang, size(t), log) for (d, t, lang, *_), log in zip(data, logs, strict=True)]
    own = [r for r in rows if r[0] in held and r[2]]
    mean = lambda some: sum(r[3] for r in some) / sum(r[2] for r in some)
    means = {x: mean([r for r in own if r[1] == x]) for x in {r[1] for r in own}}
    surprise = lambda r: -(r[3] + 100 * means.get(r[1], mean(own))) / (r[2] + 100)
    edge = lambda some: math.exp(sorted(map(surprise, some))[math.ceil(0.99 * len(some)) - 1]) * 1.05
    limit = {x: edge([r for r in own if r[1] == x]) for x in means}
    return {r[0] for r in rows if r[2] and math.exp(surprise(r)) <= limit.get(r[1], edge(own))}


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    words = {"en": "the house and a tree of water in light was near old river town".split(), "de": "das haus und ein baum von wasser im licht war fluß über groß".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))
    data = [(i, text(lang := rng.choice(["en", "de"]), rng.randint(30, 120)), lang, rng.choice(["a", "b", None]), 1) for i in range(120)]
    data += [(200 + i, "".join(chr(rng.randint(33, 120)) for _ in range(300)), "en", "a", 1) for i in range(6)]
    data += [(300 + i, data[i][1] + " and more", *data[i][2:]) for i in range(20)] + [(400 + i, data[i][1].upper(), *data[i][2:]) for i in range(10)]
    data += [(500, None, "en", "a", 1), (501, "", None, "b", 1), (502, "12 34 56", "en", "b", 1), (503, "a house", None, None, 1)]
    marks = [(i, 1, 0) for i in range(90)] + [(200, 0, 0), (3, 1, 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()))
    good, spoken, unique, mixed = kept

    want = plain_quality(spark, data, marks)
    assert {r[0] for r in good} == want and 100 < len(want) < len(data) - 8
    assert spoken == plain_accepted(good)
    sets, label = [set(simhash.shingle_set(r[1], 5).tolist()) for r in spoken], list(range(len(spoken)))
    for _ in spoken:
        before = label[:]
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if len(x & y) >= 0.8 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    assert unique == [r for i, r in enumerate(spoken) if label[i] == i] and len(unique) < len(spoken) - 15
    copies, by = Counter(r[0] for r in mixed), defaultdict(list)
    for d, t, _, s in unique:
        by[s].append((d, len(t.split())))
    targets = plain_targets({s: sum(n for _, n in own) for s, own in by.items()})
    for s, own in by.items():
        assert abs(sum(copies[d] * n for d, n in own) - targets[s]) <= max(n for _, n in own) and all(copies[d] <= 2 for d, _ in own)
    assert set(copies) <= {r[0] for r in unique}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.encoder(RANKS, PATTERN).pairs.ranks, special_tokens={})
    plain = []
    for d, t, *_ in mixed:
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        plain.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(plain)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[want.columns.index(c)] for c in order]) for r in want.fetchall())


def test_pipeline_stages_hold(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = {"source": "source", "fp": "__maybe", "size": "a.b", "n_chars": "__gone", "__copy": "__copies"}
    clash = frame.withColumnsRenamed(names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, other = stage(spark, frame, str(tmp_path)), stage(spark, clash, str(tmp_path))
        assert out.columns == docs.columns and other.columns == clash.columns
        assert sorted(map(str, other.toDF(*docs.columns).collect())) == sorted(map(str, out.collect()))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
