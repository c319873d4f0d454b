"""Extraction end to end: images become tables and cells with voted text.

Each stage that reads pixels is written to the given folder and read back, so that no image is searched twice and a lost
executor repeats one stage only. All else is joined and folded natively by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DetectorConfig, Profile
from ..operators import cluster, dedupe, lineless, raster, recognize, tables, vote
from ..sources import images as image_files
from ..sources import projects

#: det_id of a page's table of crossing lines; those of ruled tables are smaller.
CROSSING = 1 << 40
_BOX = "x:bigint,y:bigint,w:bigint,h:bigint"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def crossing_tables(segments: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """At most one table for each page from its line segments (page_id, x1, y1, x2, y2): lines cluster by place, and the
    grid between the clusters is the table. Adds cells, row by row. Pages with fewer than four segments have none."""
    kinds = dedupe.segment_kinds(segments).withColumn("__n", F.count("*").over(Window.partitionBy("page_id"))).where("__n >= 4")
    place = F.when(F.col("kind") == "h", F.least("y1", "y2")).otherwise(F.least("x1", "x2"))
    at = kinds.where("kind is not null").select("page_id", "kind", place.alias("at"))
    lines = cluster.gap_clusters(at, ["page_id", "kind"], "at", config.cluster_tolerance)
    per = lines.groupBy("page_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("center")))).alias(n) for k, n in (("h", "ys"), ("v", "xs"))))
    per = per.where((F.size("ys") > config.min_rows) & (F.size("xs") > config.min_cols))
    row = lambda i: F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda j: F.struct(F.col("xs")[j - 1].alias("x"), F.col("ys")[i - 1].alias("y"), (F.col("xs")[j] - F.col("xs")[j - 1]).alias("w"), (F.col("ys")[i] - F.col("ys")[i - 1]).alias("h")))
    cells = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ys") - 1), row))
    x, y = F.col("xs")[0], F.col("ys")[0]
    return per.select(
        "page_id", F.lit(CROSSING).alias("det_id"), x.alias("x"), y.alias("y"), (F.element_at("xs", -1) - x).alias("w"), (F.element_at("ys", -1) - y).alias("h"),
        F.lit(0.7).alias("confidence"), (F.size("ys") - 1).cast("long").alias("rows"), (F.size("xs") - 1).cast("long").alias("cols"), cells.cast(f"array<struct<{_BOX}>>").alias("cells"),
    )


def lined_tables(detected: DataFrame, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Tables with lines of the pages that raster.detect() searched: those of all binarizations merged, confirmed by
    crossing lines, without overlaps and implausible ones, numbered by confidence."""
    pages = detected.withColumnRenamed("path", "page_id")
    ruled = pages.select("page_id", F.explode("tables").alias("t")).select("page_id", "t.*")
    crossing = crossing_tables(pages.select("page_id", F.explode("segments").alias("s")).select("page_id", "s.*"), config)
    merged = dedupe.merge(ruled).drop("absorbed") if config.use_multiple_thresholds else ruled.select("page_id", *dedupe.FIELDS)
    kept = dedupe.suppress(dedupe.confirm(merged, crossing.select("page_id", *dedupe.FIELDS)))
    cells = ruled.select("page_id", "det_id", "cells").unionByName(crossing.select("page_id", "det_id", "cells"))
    found = kept.join(cells, ["page_id", "det_id"]).join(pages.select("page_id", (F.col("height") * F.col("width")).cast("long").alias("area")), "page_id")
    found = dedupe.valid(found, F.col("area"), min(config.min_rows, config.min_cols), config.min_table_area_ratio).where(dedupe.filled(F.col("cells"), config.min_cell_area))
    method = F.when(F.col("det_id") == CROSSING, "hough").otherwise("morphology")
    order = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "det_id")
    return found.withColumn("detection_method", method).withColumn("det_id", F.row_number().over(order).cast("long")).select("page_id", *dedupe.FIELDS, F.lit(True).alias("has_lines"), "detection_method", "cells")


#: det_id of the first table that a model found on a page; those of other tables are smaller.
MODEL = 1 << 41


def modelled_tables(found: DataFrame, images: DataFrame, detector: Callable[[], recognize.Detector], folder: str, config: DetectorConfig = DetectorConfig()) -> DataFrame:
    """found, with a second look by a detection model at pages of which some table is less sure than the fallback
    threshold, or which have none: grids of lines inside its regions, merged one to one with the page's own tables."""
    sure = dedupe.cascade(found, config.model_fallback_threshold).where("not second_look").select("page_id")
    look = images.join(sure.withColumnRenamed("page_id", "path"), "path", "left_anti")
    regions = recognize.model_regions(recognize.page_regions(look, detector, config.model_confidence_threshold), config.model_confidence_threshold)
    regions = _written(regions, f"{folder}/regions")
    inside = lined_tables(_written(raster.detect(raster.crops(look, regions), config), f"{folder}/inside"), config)
    place = F.regexp_extract("page_id", r"^(.*)#(\d+)$", 2).cast("long")
    inside = inside.select(F.regexp_extract("page_id", r"^(.*)#(\d+)$", 1).alias("page_id"), place.alias("region_id"), *dedupe.FIELDS, "cells")
    model = dedupe.refine(regions, inside).withColumn("det_id", MODEL + F.row_number().over(Window.partitionBy("page_id").orderBy("region_id", "det_id")).cast("long"))
    model = model.withColumn("cells", F.col("cells").cast(f"array<struct<{_BOX}>>")).withColumns({c: F.col(c).cast("long") for c in ("rows", "cols")})
    every = ["page_id", *dedupe.FIELDS, "has_lines", "detection_method", "cells"]
    model = _written(model.select(*every), f"{folder}/modelled")
    unsure = found.join(sure, "page_id", "left_anti")
    own = unsure.unionByName(model).select("page_id", "det_id", "has_lines", F.col("detection_method").alias("own"), "cells")
    met = dedupe.match(unsure, model).join(own, ["page_id", "det_id"])
    method = F.when(F.col("matched").isNotNull(), F.col("detection_method")).otherwise(F.col("own"))
    both = found.join(sure, "page_id", "left_semi").unionByName(met.withColumn("detection_method", method).select(*every))
    return both.withColumn("det_id", F.row_number().over(Window.partitionBy("page_id").orderBy("det_id")).cast("long"))


def unlined_tables(blocks: DataFrame, config: DetectorConfig = DetectorConfig(), by_groups: bool = True) -> DataFrame:
    """Tables without lines of the connected groups of text blocks (page_id, block_id, x, y, w, h), or of all of a page
    together, with their cells."""
    keys = ["page_id", "component"]
    own = blocks.withColumn("component", F.lit(1).cast("long")) if not by_groups else lineless.block_components(blocks, config.adjacency_distance)
    most = min(config.max_row_variance, config.max_col_variance)
    found = lineless.grids(own, keys, config.cluster_tolerance, config.lineless_min_blocks, most, "lineless_graph" if by_groups else "lineless_clustering")
    cell = F.struct("row", "col", F.struct("x", "y", "w", "h").cast(f"struct<{_BOX}>").alias("b"))
    cells = lineless.grid_cells(own, keys, config.cluster_tolerance).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(cell)), lambda c: c["b"]).alias("cells"))
    return found.join(cells, keys).withColumnRenamed("component", "det_id").select("page_id", *dedupe.FIELDS, "has_lines", "detection_method", "cells")


def extract(
    images: DataFrame, folder: str, engines: tuple[Callable[[], recognize.Engine], ...] = (recognize.InkEngine,), config: DetectorConfig = DetectorConfig(), profile: Profile | None = None, detect_lineless: bool = True,
    detector: Callable[[], recognize.Detector] | None = None, use_model: bool | None = None, by_groups: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of images (path, height, width, channels, data); path must be unique.

    tables: page_id, table_id, name, rows, cols, box, detection and recognition statistics, warnings. cells: page_id,
    table_id, pos, row, col, box, is_merged, text, original_text, confidence, needs_review, agreement, alternatives.
    A detection model, if given and not switched off (use_model, else config.use_model), looks again at unsure pages.
    Pages without any table are searched for one without lines, by groups of blocks or as a whole. Cells in which no engine reads anything have an empty
    text of confidence 0. Stages are written to folder, which all executors must share. No images give no rows.
    """
    if profile:
        images = _written(raster.prepared(images, profile), f"{folder}/images")
    detected = _written(raster.detect(images, config), f"{folder}/detected")
    found = _written(lined_tables(detected, config), f"{folder}/lined")
    if detector and (config.use_model if use_model is None else use_model):
        found = _written(modelled_tables(found, images, detector, folder, config), f"{folder}/hybrid")
    if detect_lineless:
        bare = images.join(found.select(F.col("page_id").alias("path")).distinct(), "path", "left_anti")
        blocks = _written(recognize.text_blocks(recognize.page_words(bare, engines[0])), f"{folder}/blocks")
        found = dedupe.with_fallback(found, unlined_tables(blocks, config, by_groups))
    named = dedupe.named(found).withColumn("table_id", F.concat_ws("#", "page_id", "table_name"))
    named = _written(named, f"{folder}/tables")

    cells = named.select("page_id", "table_id", F.col("cols").alias("__cols"), F.posexplode("cells").alias("__at", "b"))
    cells = cells.select("page_id", "table_id", F.col("__at").cast("long").alias("pos"), F.floor(F.col("__at") / F.col("__cols")).alias("row"), (F.col("__at") % F.col("__cols")).alias("col"), "b.*")
    cells = tables.merged_flags(cells).withColumn("cell_id", F.concat_ws("#", "table_id", "pos"))
    asked = cells.groupBy(F.col("page_id").alias("path")).agg(F.collect_list(F.struct("cell_id", "x", "y", "w", "h")).alias("cells"))
    read = _written(recognize.recognize_regions(images.join(asked, "path"), engines), f"{folder}/read")
    said = read.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text", "confidence", "source"))), lambda a: F.struct(a["text"].alias("text"), a["confidence"].alias("confidence"), a["source"].alias("source"))).alias("alternatives"))
    known = cells.join(vote.vote(read).drop("rung"), "cell_id", "left").join(said, "cell_id", "left")
    known = known.withColumns({
        "text": F.coalesce("text", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0)), "needs_review": F.coalesce("needs_review", F.lit(False)), "agreement": F.coalesce("agreement", F.lit(1.0)),
        "alternatives": F.coalesce("alternatives", F.array().cast(said.schema["alternatives"].dataType)),
    }).withColumn("original_text", F.col("text"))
    cells = _written(known.drop("cell_id"), f"{folder}/cells")

    seen = tables.stats(cells).select("table_id", "n_cells", "fill", "avg_confidence", "has_merged", "n_review")
    made = named.withColumnRenamed("confidence", "detection_confidence").withColumnRenamed("table_name", "name").drop("cells").join(seen, "table_id")
    return tables.warnings(made), cells


def extract_files(spark: SparkSession, path: str, folder: str, fail: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """extract() of the image files at path; an unreadable one is an error, or left out unless fail."""
    return extract(image_files.read(spark, path, fail), folder, **options)


def as_projects(found: DataFrame, cells: DataFrame, files: DataFrame | None = None, processed: DataFrame | None = None) -> DataFrame:
    """One project for each page, of what extract() returns: project_id (the page's), name, image_path and nested tables,
    as projects.to_json() and the functions of that module take them; with files (path, content) and processed (path,
    png) also image_data and processed_image_data. Pages without tables have no project."""
    cell = F.struct(
        "row", "col", "text", "confidence", F.array("x", "y", "w", "h").alias("bbox"), "is_merged", F.array(F.lit(1), F.lit(1)).alias("merge_span"), "original_text", "alternatives", "needs_review",
    )
    listed = cells.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    columns = tables.auto_columns(found).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("index", "name", "enabled", "width"))).alias("columns"))
    item = F.struct(
        F.col("table_id").alias("id"), "name", "rows", "cols", "cells", "columns", F.array("x", "y", "w", "h").alias("bbox"), F.lit(True).alias("enabled"), F.col("has_merged").alias("has_merged_cells"), "avg_confidence", "warnings",
    ).cast(projects.TABLE)
    per = found.join(listed, "table_id").join(columns, "table_id").groupBy(F.col("page_id").alias("project_id")).agg(F.sort_array(F.collect_list(F.struct("det_id", item.alias("t")))).alias("l"))
    more = []
    for kept, column, name in ((files, "content", "image_data"), (processed, "png", "processed_image_data")):
        if kept is not None:
            per = per.join(kept.select(F.col("path").alias("project_id"), F.base64(column).alias(name)), "project_id", "left")
            more.append(name)
    return per.select("project_id", F.regexp_replace(F.element_at(F.split("project_id", "/"), -1), r"\.[^.]*$", "").alias("name"), F.col("project_id").alias("image_path"), F.transform("l", lambda x: x["t"]).alias("tables"), *more)
