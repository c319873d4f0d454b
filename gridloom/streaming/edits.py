"""The edit log as a stream: one undo stack for each project, kept as state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "project long, seq long, undone boolean, new_text string"
STATE = "seqs array<long>, texts array<string>, undone int"


def _fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seqs, texts, undone = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
    out = []
    for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
        live = len(seqs) - undone
        if e.kind == "edit":
            seqs, texts, undone = [*seqs[:live], int(e.seq)], [*texts[:live], e.new_text], 0
            out.append((key[0], int(e.seq), False, e.new_text))
        elif e.kind == "undo" and live:
            undone += 1
            out.append((key[0], seqs[live - 1], True, texts[live - 1]))
        elif e.kind == "redo" and undone:
            undone -= 1
            out.append((key[0], seqs[live], False, texts[live]))
    state.update((seqs, texts, undone))
    yield pd.DataFrame(out, columns=["project", "seq", "undone", "new_text"])


def live_edits_stream(log: DataFrame) -> DataFrame:
    """Changes (project, seq, undone, new_text) of a streaming log (project, seq, kind, new_text). Events of a batch are
    taken by seq; an event that comes in a later batch than its successors is applied when it comes."""
    kept = log.select("project", "seq", "kind", "new_text")
    return kept.groupBy("project").applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
