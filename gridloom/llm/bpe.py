"""Byte-level BPE by backtracking from longest matches, exact to the merges, and decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the pattern's \s means it, as text: U+0009 to U+000D, space, U+0085, U+00A0 and the wider ones.
SPACES = "\t-\r \x85\xa0  -     　"
#: Characters of a text whose words are listed at once.
BLOCK = 1 << 20
#: Words that a worker's cache holds before it starts anew (twice as many pieces), and the longest that it holds.
CACHE, CACHED_CHARS = 200_000, 64


class BytePairs:
    """The vocabulary's merges, found from its ranks.

    A piece is encoded left to right by the longest token at each place. A token may follow the one before it only if
    the two would stay as they are when their bytes are merged together; otherwise the next shorter token is tried, and
    where none is left the last token is given up and its place blocked. Each place is blocked once at most, so the
    work is linear in the piece's length. Tokens are bytes read as Latin-1, so that the automaton's letters are bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.ranks = ranks
        if any(bytes([x]) not in ranks for x in range(256)):
            raise ValueError("a byte has no token of its own")
        self.longest = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.longest.add_word(token.decode("latin-1")[::-1], rank)
        self.longest.make_automaton()
        self.parts = self._parts()
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}

    def _parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token: the last two left when its bytes are merged by lower ranks."""
        out = {}
        for token, rank in self.ranks.items():
            if len(token) > 1:
                pieces = self.merged(token, rank)
                if len(pieces) == 2:
                    out[rank] = (self.ranks[pieces[0]], self.ranks[pieces[1]])
        return out

    def merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """The plain merge loop: the adjacent pair of lowest rank, the first of equals, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60 or (below is not None and rank >= below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right, side by side, are what the merges leave of their joined bytes (memoised)."""
        key = left << 32 | right
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > 2 * CACHE:
                self.compatible.clear()
            found = self.compatible[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        # Undo the later of the two merges step by step; a pair across the border that would merge before is a conflict.
        limit = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes[left] + self.bytes[right])
            if joined is not None and joined < limit and self.parts.get(joined) == (left, right):
                return False
            if left > right:
                limit = left
                if left not in self.parts:
                    return True
                left = self.parts[left][1]
                if left == limit:
                    return True
            else:
                limit = right + 1
                if right not in self.parts:
                    if left not in self.parts:
                        return True
                    limit, left = left, self.parts[left][1]
                    continue
                right = self.parts[right][0]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of the token; -1 for a single byte."""
        found = self.shorter.get(token)
        if found is None:
            data = self.bytes[token]
            found = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def longest_at(self, piece: bytes) -> list[int]:
        """The longest token that begins at each byte: the automaton runs over the bytes from the end, and of the
        tokens that end at a letter it names the longest first."""
        n, seen = len(piece), -1
        best = [-1] * n
        for end, rank in self.longest.iter(piece[::-1].decode("latin-1")):
            if end != seen:
                seen = end
                best[n - 1 - end] = rank
        return best

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, first, length, out, at = len(piece), self.longest_at(piece), self.length, [], 0
        blocked = bytearray(size + 1)
        token = first[0]
        while at < size:
            end = at + length[token]
            if not blocked[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = first[at] if at < size else -1
                continue
            token = self.next_shorter(token)
            if token < 0:
                blocked[at] = 1
                token = out.pop()
                at -= length[token]
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class _Words(dict):
    """What words become; up to a bound, words and their pieces are kept."""

    def __init__(self, pairs: BytePairs, split: regex.Pattern):
        super().__init__()
        self.pairs, self.split = pairs, split
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = b"".join(map(self._piece, self._cut(word)))
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = found
        return found

    def _cut(self, word: str) -> list[str]:
        """The pattern's pieces of a word; a space and letters, and these before a mark, need no search."""
        if word[0] == " ":
            if word[1:].isalpha():
                return [word]
            if word[-1] in ".,:;!?" and word[1:-1].isalpha():
                return [word[:-1], word[-1]]
        return self.split.findall(word)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            ids = self.pairs.encode(piece.encode("utf-8", "surrogatepass"))
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= CACHED_CHARS:
                if len(self.pieces) >= 2 * CACHE:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found


class Encoder:
    """Encodes texts piece by piece; a bounded cache holds what frequent words become."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = BytePairs(ranks)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
        self.split = regex.compile(plain)
        # A run of white space and the run after it: the pattern never joins a character to white space after it.
        self.words = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.table = [self.pairs.bytes.get(i, b"") for i in range(max(self.pairs.bytes) + 1)]
        self.cache = _Words(self.pairs, self.split)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in blocks."""
        get = self.cache.__getitem__
        if len(text) <= BLOCK:
            yield b"".join(map(get, self.words.findall(text)))
            return
        words = map(re.Match.group, self.words.finditer(text))
        while block := b"".join(map(get, itertools.islice(words, 1 << 16))):
            yield block

    def forget(self) -> None:
        """Empties what a task has gathered, as workers live on after it."""
        for known in (self.cache, self.cache.pieces, self.pairs.compatible):
            known.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file, which must be at path on every machine."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(read_ranks(f.read()), pattern)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary) of every row: its whole text's ids as little-endian unsigned 32-bit integers.

    Null text is empty. Rows are independent: repeated rows repeat, null ids stay, an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            ids = pa.array([b"".join(e.encode(t or "")) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])
        e.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs: its whole text is encoded, the ids are
    digested and decoded, and the bytes digested, in one Python pass. Null and empty texts have no ids; long texts pass in
    blocks; rows are independent, so repeated rows repeat, null ids stay and an empty table gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            made = []
            for text in b.column("text"):
                n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for block in e.encode(text.as_py() or ""):
                    n += len(block) // 4
                    ids.update(block)
                    decoded.update(e.decode(block))
                made.append((n, ids.hexdigest(), decoded.hexdigest()))
            kinds = pa.int64(), pa.string(), pa.string()
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
