"""Token-id shards: raw ids of whole documents in files, with a minimal perfect hash from document keys to offsets.

A shard file: the magic, the ids of its rows end to end (little-endian, 2 bytes each if the vocabulary allows, else 4),
then arrays: offset of each row in ids (rows + 1), key of each distinct document in file order, the perfect hash, and by
slot a 32-bit fingerprint of the key, the first row and the number of rows of that key. The footer is JSON with the
place of each array, its length in the last 8 bytes, and the magic again. Rows with a null key come first, before row
``nulls``. Rows are in ascending order of key, in each shard and from shard to shard.
"""

from __future__ import annotations

import bisect
import codecs
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .perfect_hash import PerfectHash, fingerprint

MAGIC = b"TOKSHRD1"
#: Words that a worker's cache may hold, how many it is cut to beyond that, and the longest word that it holds.
CACHE, KEPT, CACHED_CHARS = 400_000, 200_000, 64
#: Bytes of texts that are encoded at once, and ids that a cache may hold.
BLOCK, IDS_MOST = 1 << 23, 1 << 24
#: Latin letters, of which none becomes anything but one letter when composed and lower-cased, then marks, which are one
#: piece; no apostrophe, which may begin a piece with letters.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: The steps before the model for which plain words need none of them. Fixed values.
STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: The byte alphabet, by byte: bytes without a printable character of their own follow from U+0100 on. A space stays.
_UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
LETTERS = "".join(chr(0x100 + _UNSEEN.index(b)) if b in _UNSEEN and b != 0x20 else chr(b) for b in range(256))
#: White space at which texts may be cut.
SPACE = re.compile(r"[\t-\r ]")


def _open_fs(uri: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(uri)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, end to end."""
    upto = np.cumsum(sizes, dtype=np.int64)
    kind = np.int32 if len(upto) and upto[-1] < 1 << 31 and starts[-1] < 1 << 31 else np.int64
    at = np.repeat((starts - (upto - sizes)).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return at


class WordEncoder:
    """Encodes texts with a tokenizer whose pieces never cross white space.

    Arrow splits a block of texts into words and numbers the distinct ones; only these reach Python. A word's ids lie in
    one array, which is all that the cache keeps of them besides its place; texts are put together by gathering.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        own = json.loads(self.tokenizer.to_str())
        suffix = own["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.model = None
        if suffix and [own["normalizer"], own["pre_tokenizer"]] == STEPS:
            self.model = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}))
        self.place: dict[str, int] = {}
        self.sizes, self.ids = np.empty(0, np.int64), np.empty(0, f"<u{self.width}")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts end to end, number of ids of each); null is empty."""
        texts = texts.fill_null("")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        block = np.cumsum(size) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        made = [self._block(texts.slice(at, end - at)) if size[at:end].sum() <= 2 * BLOCK else self._long(texts.slice(at, end - at)) for at, end in itertools.pairwise(cuts)]
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def _long(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _block, for texts of which one is longer than a block: they are cut at white space."""
        out, counts = [], []
        for text in texts:
            text, at, count = text.as_py(), 0, 0
            while at < len(text):
                end = SPACE.search(text, min(at + BLOCK, len(text)))
                end = end.start() if end else len(text)
                ids, _ = self._block(pa.array([text[at:end]]))
                out.append(ids)
                at, count = max(end, at + 1), count + len(ids)
            counts.append(count)
        return np.concatenate([self.ids[:0], *out]), np.array(counts, np.int64)

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(coded.dictionary.take(pa.array(new)))
        starts = (np.cumsum(self.sizes) - self.sizes)[at].astype(np.int32)
        own = self.sizes[at].astype(np.int32)
        index = coded.indices.to_numpy(zero_copy_only=False)
        sizes = own[index]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[split.offsets.to_numpy()]
        ids = self.ids[_spread(starts[index], sizes)]
        if len(self.place) > CACHE or len(self.ids) > IDS_MOST:
            self.rest()
        return ids, np.diff(upto)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Encodes words and keeps their ids until the next rest; returns their places."""
        parts = pc.extract_regex(words, PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False) if self.model else np.zeros(len(words), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n, words = int(plain.sum()), words.take(pa.array(order))
        parts = parts.take(pa.array(order[:n]))
        ids, sizes = self._plain(parts.field("word"), parts.field("marks"))
        first, words = len(self.sizes), words.to_pylist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words[n:], add_special_tokens=False)]
        self.ids = np.concatenate([self.ids, ids, np.fromiter(itertools.chain.from_iterable(found), self.ids.dtype)])
        self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, found), np.int64, len(found))])
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        for word in [w for w in words if len(w) > CACHED_CHARS]:
            del self.place[word]
        places = np.empty(len(words), np.int64)
        places[order] = np.arange(first, first + len(words))
        return places

    def _plain(self, words: pa.Array, marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of plain words, by calls of the model alone: lower case, marks apart, bytes as
        letters. Each piece ends with an id that only ends pieces."""
        pieces = 1 + (pc.binary_length(marks).to_numpy(zero_copy_only=False) > 0)
        text = pc.utf8_lower(pc.binary_join_element_wise(words, marks, " ")).to_pylist()
        ids = [self.ids[:0]]
        for at in range(0, len(text), 4096):
            part = codecs.charmap_decode(" ".join(text[at : at + 4096]).encode(), "strict", LETTERS)[0]
            ids.append(np.array(self.model.encode_batch_fast([part], add_special_tokens=False)[0].ids, self.ids.dtype))
        ids = np.concatenate(ids)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != pieces.sum():
            raise ValueError("the model's pieces are not those of the words")
        return ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def rest(self) -> None:
        """Cuts a large cache to the words that came first, which are those that come often."""
        if len(self.place) > KEPT or len(self.ids) > IDS_MOST // 2:
            self.place = dict(itertools.islice(self.place.items(), KEPT))
        at = np.fromiter(self.place.values(), np.int64, len(self.place))
        starts = np.cumsum(self.sizes) - self.sizes
        self.ids, self.sizes = self.ids[_spread(starts[at], self.sizes[at])], self.sizes[at]
        self.place = dict(zip(self.place, range(len(at)), strict=True))


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Writes one shard: payload as it comes, index at the end; the file gets its name only when it is whole."""

    def __init__(self, folder: str, part: int, width: int):
        self.fs, at = _open_fs(folder)
        self.fs.create_dir(at, recursive=True)
        self.name = f"shard-{part:06d}-{uuid.uuid4().hex}.tok"
        self.path, self.uri, self.width = f"{at}/{self.name}", f"{folder}/{self.name}", width
        self.out = self.fs.open_output_stream(self.path + ".tmp")
        self.out.write(MAGIC)
        self.keys: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.nulls = 0

    def add(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Rows in ascending order of key, null keys first."""
        self.out.write(np.ascontiguousarray(ids, f"<u{self.width}"))
        self.nulls += keys.null_count
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False))
        self.sizes.append(sizes)

    def close(self) -> dict[str, int | str | None]:
        """Writes the index; returns the shard's line of the manifest."""
        nulls, keys = self.nulls, np.concatenate(self.keys)
        sizes = np.concatenate(self.sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        own, first, count = np.unique(keys, return_index=True, return_counts=True)
        hashed = PerfectHash.build(own.view(np.uint64))
        slot = hashed.slots(own.view(np.uint64))
        by_slot = np.empty_like(slot)
        by_slot[slot] = np.arange(len(slot))
        arrays = {
            "offsets": offsets.astype("<u8").tobytes(), "keys": own.astype("<i8").tobytes(), "hash": hashed.dump(),
            "fingerprints": fingerprint(own.view(np.uint64))[by_slot].astype("<u4").tobytes(),
            "first": (first + nulls)[by_slot].astype("<u8").tobytes(), "count": count[by_slot].astype("<u8").tobytes(),
        }
        at = len(MAGIC) + int(offsets[-1]) * self.width
        foot = {"width": self.width, "rows": len(sizes), "nulls": nulls, "arrays": {}}
        for name, data in arrays.items():
            foot["arrays"][name] = [at, len(data)]
            at += len(data)
            self.out.write(data)
        tail = json.dumps(foot).encode()
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)
        first, last = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return {"uri": self.uri, "rows": len(sizes), "tokens": int(offsets[-1]), "nulls": nulls, "first_key": first, "last_key": last}


class ShardReader:
    """Keyed and ordered access to a shard: a key's place takes one hash, whatever the shard's size."""

    def __init__(self, uri: str):
        fs, path = _open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        foot = json.loads(self.file.read_at(tail, size - 16 - tail))
        self.width, self.rows, self.nulls = foot["width"], foot["rows"], foot["nulls"]
        get = lambda name: self.file.read_at(foot["arrays"][name][1], foot["arrays"][name][0])
        self.offsets = np.frombuffer(get("offsets"), "<u8").astype(np.int64)
        self.keys = np.frombuffer(get("keys"), "<i8")
        self.hash = PerfectHash.load(get("hash"))
        self.fingerprints = np.frombuffer(get("fingerprints"), "<u4")
        self.first, self.count = (np.frombuffer(get(x), "<u8").astype(np.int64) for x in ("first", "count"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, rows) of each key; (-1, 0) for one that the shard doesn't hold."""
        asked = keys.astype(np.int64).view(np.uint64)
        slot = self.hash.slots(asked)
        if not len(self.fingerprints):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        ok = (slot >= 0) & (self.fingerprints[slot] == fingerprint(asked))
        return np.where(ok, self.first[slot], -1), np.where(ok, self.count[slot], 0)

    def ids(self, row: int) -> np.ndarray:
        at, end = self.offsets[row], self.offsets[row + 1]
        return np.frombuffer(self.file.read_at(int(end - at) * self.width, len(MAGIC) + int(at) * self.width), f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        first, count = self.find(np.array([key]))
        return [self.ids(r) for r in range(int(first[0]), int(first[0] + count[0]))]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of several batches together, of about BLOCK bytes: a word is looked up once in a block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.column("text").nbytes for h in held) >= BLOCK:
            yield tuple(pa.concat_arrays([h.column(c) for h in held]) for c in ("doc_id", "text"))
            held = []
    if held:
        yield tuple(pa.concat_arrays([h.column(c) for h in held]) for c in ("doc_id", "text"))


MANIFEST = "part int, uri string, rows long, tokens long, nulls long, first_key long, last_key long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[Row]:
    """Encode every whole text of docs (doc_id, text; further columns are ignored), end each document with end_id, and
    write shards in ascending doc_id order (nulls first; rows that repeat a doc_id by a hash of their text, so that a
    doc_id of many rows may lie in several shards). Returns the manifest, one row
    for each shard: part, uri, rows, tokens, rows with a null key, least and greatest key.

    Null and empty texts have the end id alone. Texts of any length are encoded whole, in blocks cut at white space. An
    empty table writes no shard. Ids are those of the tokenizer as its file sets it up, special tokens in a text
    included. Texts are dealt by ranges of doc_id, encoded after the shuffle and streamed to the file of their partition.
    A task that runs again writes a file of another name, and the manifest names one file for each part.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard = word_encoder(tokenizer), None
        part = TaskContext.get().partitionId()
        for keys, texts in _blocks(batches):
            shard = shard or ShardWriter(folder, part, e.width)
            ids, sizes = e.encode(texts)
            ends = np.cumsum(sizes + 1) - 1
            ended = np.full(len(ids) + len(sizes), end_id, ids.dtype)
            own = np.ones(len(ended), bool)
            own[ends] = False
            ended[own] = ids
            shard.add(keys, ended, sizes + 1)
        e.rest()
        if shard:
            yield pa.RecordBatch.from_pylist([{"part": part} | shard.close()], pa.schema([("part", pa.int32()), ("uri", pa.string()), *((x, pa.int64()) for x in ("rows", "tokens", "nulls", "first_key", "last_key"))]))

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order, "text").select("doc_id", "text")
    return sorted(ordered.mapInArrow(run, MANIFEST).collect(), key=lambda r: r["part"])


class TokenFiles:
    """Keyed access to all shards of a manifest: the key ranges name the shards that may hold a key, whose perfect hash
    and fingerprints give its place. A shard is opened when it is first asked."""

    def __init__(self, manifest: list[Row]):
        self.shards = sorted((r for r in manifest if r["first_key"] is not None), key=lambda r: (r["first_key"], r["part"]))
        self.last = list(itertools.accumulate((r["last_key"] for r in self.shards), max))
        self.open: dict[str, ShardReader] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row of that key; none if no shard holds it."""
        out = []
        for r in self.shards[bisect.bisect_left(self.last, key) :]:
            if r["first_key"] > key:
                break
            if r["uri"] not in self.open:
                self.open[r["uri"]] = ShardReader(r["uri"])
            out += self.open[r["uri"]].get(key)
        return out


def read_shards(spark, manifest: list[Row]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the shards, from the files: each key is found through the
    shard's perfect hash, and its ids through the offsets found there."""
    start, tasks = 0, []
    for row in manifest:
        tasks.append((row["uri"], start))
        start += row["tokens"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, start in zip(b["uri"], b["start"], strict=True):
                shard = ShardReader(uri)
                found = [(None, r) for r in range(shard.nulls)]
                first, count = shard.find(shard.keys)
                if (first < 0).any():
                    raise ValueError(f"{uri}: a key isn't found")
                for at in range(0, len(shard.keys) or 1, 4096):
                    part = slice(at, at + 4096)
                    found += [(k, r) for k, f, n in zip(shard.keys[part].tolist(), first[part].tolist(), count[part].tolist(), strict=True) for r in range(f, f + n)]
                    ids = [shard.ids(r) for _, r in found]
                    yield pd.DataFrame({
                        "doc_id": pd.array([k for k, _ in found], dtype="Int64"), "start": [start + int(shard.offsets[r]) for _, r in found],
                        "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                    })
                    found = []

    listed = spark.createDataFrame(tasks, "uri string, start long").repartition(max(1, len(tasks)))
    return listed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
