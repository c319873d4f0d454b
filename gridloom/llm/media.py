"""Payloads as PNG images in a binary column, read back with checksum tests, and low-frequency transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a row of samples; payloads are padded to a multiple of it.
WIDTH = 64
#: Side of the reduced image and of the corner of its transform that is kept.
SIDE, CORNER = 32, 8
DIGESTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_K = np.arange(SIDE)
#: Rows of the type II cosine transform.
_DCT = np.cos(np.pi / SIDE * np.outer(_K, _K + 0.5))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Rows with their filter before them: of none, the difference to the left and that to the row above, the one whose
    differences, as signed bytes, have the least sum of magnitudes."""
    tried = np.empty((3, *rows.shape), np.uint8)
    tried[0] = tried[1] = tried[2] = rows
    tried[1, :, 1:] -= rows[:, :-1]
    tried[2, 1:] -= rows[:-1]
    kinds = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    return np.hstack([kinds[:, None].astype(np.uint8), tried[kinds, np.arange(len(rows))]])


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit gray PNG of the payload, whose length must be a positive multiple of width. Each row has a filter of its
    own."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(_filtered(rows).tobytes(), level)) + _chunk(b"IEND", b"")


def _wave(rows: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Rows whose filter is the mean of left and above (3) or the nearest of left, above and corner (4), undone along
    diagonals: a sample needs its left, the one above it and their corner, all of earlier diagonals."""
    n, width = rows.shape
    out = np.zeros((n + 1, width + 1), np.int16)  # a row above and a column of zeros to the left
    out[0, 1:] = above
    for t in range(n + width - 1):
        r = np.arange(max(0, t - width + 1), min(n, t + 1))
        c = t - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            a, b, d = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
        out[r + 1, c + 1] = (rows[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _unfiltered(raw: np.ndarray) -> np.ndarray:
    """Rows of gray samples from filtered rows; a run of rows of one filter is undone at once."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(rows)]
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        kind, above = kinds[at] if at < len(rows) else 0, rows[at - 1] if at else np.zeros(rows.shape[1], np.uint8)
        if kind == 1:
            rows[at:end] = np.cumsum(rows[at:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            rows[at] += above
            rows[at:end] = np.cumsum(rows[at:end], axis=0, dtype=np.uint8)
        elif kind:
            rows[at:end] = _wave(rows[at:end], above, kind)
    return rows


def decode_png(png: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit gray PNG without interlace; ValueError if a signature, length, checksum or
    kind is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, shape, data, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body, check = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(body) != size or len(check) != 4 or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", check)[0]:
            raise ValueError(f"chunk {kind!r}: wrong length or checksum")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit gray without interlace is read")
            shape = height, width
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or shape is None:
        raise ValueError("no header or no end")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != shape[0] * (shape[1] + 1):
        raise ValueError("wrong number of samples")
    return _unfiltered(raw.reshape(shape[0], shape[1] + 1))


def feature(samples: np.ndarray) -> str:
    """16 hex digits: which of the lowest 8 x 8 cosine coefficients of the image, reduced to 32 x 32, exceed their median."""

    def reduced(x: np.ndarray) -> np.ndarray:
        """Means over 32 equal stretches of the first axis; an image with fewer rows repeats them."""
        n = len(x)
        if n < SIDE:
            return x[np.arange(SIDE) * n // SIDE]
        cuts = np.arange(SIDE) * n // SIDE
        return np.add.reduceat(x, cuts, axis=0) / np.diff([*cuts, n])[:, None]

    small = reduced(reduced(samples.astype(np.float64)).T).T
    low = (_DCT @ small @ _DCT.T)[:CORNER, :CORNER].round(6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def payload(text: str | None, width: int = WIDTH) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with zero bytes to a positive multiple of width, bytes before padding)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(width, -(-len(data) // width) * width), b"\0"), len(data)


def media_columns(docs: DataFrame, level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media binary) of every row: its whole text, however long, as a PNG. Null and empty
    texts: one row of zeros. Rows are independent, repeated rows repeat, further columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [payload(t) for t in b.column("text").to_pylist()]
            images = pa.array([encode_png(p, level=level) for p, _ in made], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), images], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Per row of media_columns, from the stored bytes read back: lengths, digests and the transform hash.

    Rows are independent, so repeated rows repeat, null ids stay null and an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for png in b.column("media").to_pylist():
                samples = decode_png(png)
                data = samples.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(samples)))
            names, kinds = zip(*DIGESTS, strict=True)
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *made], ["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
