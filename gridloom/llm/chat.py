"""Chat formatting: typed parts of a turn flattened to marked text, with a loss mask, and read back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that a part other than text stands for, if it names none.
EXPANSION = {"image": 256, "audio": 128, "document": 512}
#: Control strings of this template and of other common ones: what follows the first character, after any backslashes.
_CONTROL = re.compile(r"([<\[]\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[]\\*)\\(\||/?s>|/?INST\])")


def escape(text: str) -> str:
    """Text without control strings: a backslash enters after the first character of each; one more where some are there."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


@dataclass
class Flattener:
    """Visits the parts of a turn in order. Text is escaped; other parts leave a numbered placeholder, a reference and
    the count of tokens that the placeholder will expand to. Unknown kinds are an error, not dropped."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            self.pieces.append(escape(part.get("text") or ""))
        elif kind in EXPANSION:
            tokens = part.get("tokens")
            at = len(self.attachments)
            self.attachments.append((at, kind, part.get("ref") or "", EXPANSION[kind] if tokens is None else int(tokens)))
            self.pieces.append(f"<|{kind}:{at}|>")
        else:
            raise ValueError(f"unknown kind of part: {kind}")

    def body(self) -> str:
        return "".join(self.pieces)


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[tuple[int, str, str, int]]]:
    """(segment, start and end of its body in code points, attachments) of one turn."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head = f"{TURN}{escape(role or '')}{BODY}"
    body = flat.body()
    return f"{head}{body}{END}\n", len(head), len(head) + len(body), flat.attachments


def read_turn(segment: str) -> tuple[str, str]:
    """(role, body as it stands, still escaped) of a formatted segment."""
    if not segment.startswith(TURN) or not segment.endswith(END + "\n"):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(TURN) : -len(END) - 1].partition(BODY)
    return unescape(role), body


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted segment for each row (conv_id, turn, role, text, and optionally parts: a JSON list of typed parts
    that stands in place of text).

    A conversation's output is its segments by (turn, role, segment), nulls first. loss_start and loss_end bound the
    part of a segment under the loss mask (null: none). Null text is empty, null role is the empty role; texts of any
    length are formatted whole; repeated rows repeat, further columns are ignored and an empty table gives no rows. Rows
    are formatted one by one, so no conversation is ever gathered here.
    """
    typed = "parts" in rows.columns
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", *(["parts"] if typed else []))

    kind = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(kind), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            parts = b.column("parts").to_pylist() if typed else [None] * b.num_rows
            for role, text, given in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), parts, strict=True):
                segment, start, end, found = format_turn(role, json.loads(given) if given else [{"type": "text", "text": text}])
                learn = role in loss_roles
                out.append((segment, start if learn else None, end if learn else None, [{"position": p, "kind": k, "ref": r, "tokens": n} for p, k, r, n in found], sum(n for *_, n in found)))
            made = [pa.array([r[i] for r in out], of) for i, of in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *made], ["conv_id", "turn", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    return source.mapInArrow(run, "conv_id long, turn long, segment string, loss_start long, loss_end long, attachments array<struct<position:int,kind:string,ref:string,tokens:int>>, expanded_tokens long")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments in order: turns, their digest, the masked text's length and digest,
    and the length of the whole.

    Segments are sorted within partitions and pass through one at a time, so a conversation of any length takes the
    memory of a batch; its digest is a running one, so one task reads it all. A null conv_id is a conversation of its own;
    an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, state = [], None, None

        def close() -> None:
            if state is not None:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, segment, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = read_turn(segment)
                state[0] += 1
                state[1].update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescape(segment[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            yield _digests(out)
            out.clear()
        close()
        yield _digests(out)

    kept = formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end")
    ordered = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
