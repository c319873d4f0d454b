"""Image files as rows of BGR bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted endings. Fixed values.
ENDINGS = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0)).isin(*ENDINGS)


def read(spark: SparkSession, path: str, fail: bool = False) -> DataFrame:
    """(path, height, width, channels, data): decoded images; unreadable files are left out, or an error if fail."""
    raw = spark.read.format("image").option("dropInvalid", str(not fail).lower()).load(path).select("image.*")
    if fail:
        raw = raw.withColumn("height", F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("unreadable image "), "origin"))).otherwise(F.col("height")))
    return raw.where(is_image(F.col("origin"))).select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): the raw bytes, as a project keeps them."""
    return spark.read.format("binaryFile").load(path).where(is_image(F.col("path"))).select("path", "content")
