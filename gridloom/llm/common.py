"""Shared helpers: reading tables, written tables that cut lineage, names that clash with none, and a bounded membership
filter."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: Bits of a membership filter; its bitmaps take FILTER_BITS / 8 bytes however many keys it holds.
FILTER_BITS = 1 << 23
#: Rows of an Arrow batch, in place of Spark's 10,000: at some kilobytes a text a batch stays within a few megabytes.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches; a session that sets its own size keeps it."""
    prepare(spark)
    if spark.conf.get(BATCH_SETTING, "10000") == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it is unset, a
    temporary one that goes when the driver ends."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


_SCRATCH = threading.local()


def new_path(spark: SparkSession, what: str, outlast: int = 0) -> str:
    """A new path in the shared folder. It goes at the end of the scratch() around, or outlasts so many of them."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    open_ = getattr(_SCRATCH, "open", [])
    if len(open_) > outlast:
        open_[-1 - outlast].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but those written to outlast it. What is returned must not read them."""
    if not hasattr(_SCRATCH, "open"):
        _SCRATCH.open = []
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            remove(spark, path)


def materialize(df: DataFrame, what: str = "part", outlast: int = 0) -> DataFrame:
    """Write df once to the shared folder and read it again: what follows survives lost executors without computing df anew."""
    path = new_path(df.sparkSession, what, outlast)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores until it is none of those taken, in whatever case."""
    out, known = [], {t.lower() for t in taken}
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """df with one more column, and that column: false means that the long key is surely not among the ids.

    One bit per hashed key in at most FILTER_BITS / 32768 bitmaps of 4 KB (1 MB in all, whatever the number of
    ids), so the broadcast is bounded. Rows flagged true still need the exact join; the others skip its shuffle.
    Null keys are flagged false.
    """
    flag, bucket, bits = fresh(df.columns, "__maybe", "__bucket", "__bits")
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS))
    first = F.col(ids.columns[0])
    at = ids.where(first.isNotNull()).select(place(first).alias("p"))
    maps = at.groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    bit = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    met = df.join(F.broadcast(maps), F.bitmap_bucket_number(place(F.col(key))) == F.col(bucket), "left")
    return met.select(*own(df), (hit & F.col(key).isNotNull()).alias(flag)), F.col(flag)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df but the rows whose long key is among the ids (first column); null keys stay, and columns and their names are
    those of df. Only rows that the filter of maybe_in can't clear are shuffled."""
    flagged, maybe = maybe_in(df, key, ids)
    (name,) = fresh(flagged.columns, "__gone")
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias(name))
    sure = flagged.where(maybe).join(gone, F.col(key).cast("long") == F.col(name), "left_anti")
    return flagged.where(~maybe).select(*own(df)).union(sure.select(*own(df)))
