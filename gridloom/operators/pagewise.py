"""Arrow passes over the rows of a page (or of another key): they lie in one ordered list, and a batch of lists is handled
in numpy. A list holds what fits on a sheet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows to take, by their place in the batch, and columns that are added or replaced.
Taken = tuple[np.ndarray, dict[str, np.ndarray | list]]


def listed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], *order: Column) -> DataFrame:
    """(keys, l): the fields of the rows of each key as an array, in the given order."""
    item = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.struct(*fields).alias("d"))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("l")).select(*keys, F.transform("l", lambda s: s["d"]).alias("l"))


def folded(lists: DataFrame, fold: Callable[[np.ndarray, dict[str, np.ndarray]], Taken], more: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """(keys, fields or those to keep, more) of the rows that fold takes. fold gets the place of each list's first row (and
    one past the last) and the fields' values end to end."""
    keys = [c for c in lists.columns if c != "l"]
    element = lists.schema["l"].dataType.elementType
    names = [n for n in element.names if n in (element.names if keep is None else keep)]
    kinds = {n: T._parse_datatype_string(k) for n, k in more.items()}
    arrow = {n: to_arrow_type(k) for n, k in kinds.items()}
    schema = T.StructType([*(lists.schema[k] for k in keys), *(T.StructField(n, kinds.get(n, element[n].dataType)) for n in names), *(T.StructField(n, k) for n, k in kinds.items() if n not in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("l").flatten()
            parts = dict(zip(element.names, values.flatten(), strict=True))
            size = np.array(b.column("l").value_lengths().fill_null(0), np.int64)
            at, made = fold(np.concatenate([[0], np.cumsum(size)]), {n: p.to_numpy(zero_copy_only=False) for n, p in parts.items()})
            owner, at_ = pa.array(np.repeat(np.arange(len(size)), size)[at]), pa.array(at)
            columns = {k: b.column(k).take(owner) for k in keys} | {n: parts[n].take(at_) for n in names} | {n: pa.array(v, arrow[n]) for n, v in made.items()}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], [f.name for f in schema])

    return lists.mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of 0..n-1 reaches over the links a, b."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while (parent != parent[parent]).any():
            parent = parent[parent]
    return parent
