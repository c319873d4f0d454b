"""Project files: nested JSON in and out, as tables of projects, tables, columns, cells and alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ALT = "struct<text:string,confidence:double,source:string>"
_CELL = f"struct<row:bigint,col:bigint,text:string,confidence:double,bbox:array<bigint>,is_merged:boolean,merge_span:array<bigint>,original_text:string,alternatives:array<{_ALT}>,needs_review:boolean>"
_COLUMN = "struct<index:bigint,name:string,enabled:boolean,width:bigint>"
TABLE = f"struct<id:string,name:string,rows:bigint,cols:bigint,cells:array<{_CELL}>,columns:array<{_COLUMN}>,bbox:array<bigint>,enabled:boolean,has_merged_cells:boolean,avg_confidence:double,warnings:array<string>>"
_PROFILE = "struct<name:string,deskew:boolean,denoise:boolean,contrast_enhance:boolean,threshold_value:bigint,line_enhancement:boolean,perspective_correction:boolean,shadow_removal:boolean>"
PROJECT = f"name string, image_path string, profile {_PROFILE}, tables array<{TABLE}>, created_at string, modified_at string, image_data string, processed_image_data string, roi array<array<double>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each project file, with project_id (its path) and image bytes decoded."""
    made = spark.read.schema(PROJECT).json(path, multiLine=True).withColumn("project_id", F.input_file_name())
    return made.withColumns({"name": F.coalesce("name", F.lit("Untitled")), "image": F.unbase64("image_data"), "processed_image": F.unbase64("processed_image_data")})


def parse(text: DataFrame, column: str = "json") -> DataFrame:
    """Rows (project_id, json) as projects; see read()."""
    return text.withColumn("__p", F.from_json(column, f"struct<{', '.join(x.replace(' ', ':', 1) for x in _fields())}>")).select("project_id", "__p.*")


def _fields() -> list[str]:
    return ["name string", "image_path string", f"profile {_PROFILE}", f"tables array<{TABLE}>", "created_at string", "modified_at string", "image_data string", "processed_image_data string", "roi array<array<double>>"]


def _or(c: Column | str, value) -> Column:
    return F.coalesce(c, F.lit(value))


def tables(projects: DataFrame) -> DataFrame:
    """(project_id, pos, table_id, name, rows, cols, x, y, w, h, enabled, has_merged_cells, avg_confidence, warnings)."""
    t = projects.select("project_id", F.posexplode("tables").alias("pos", "t"))
    box = [F.try_element_at("t.bbox", F.lit(i + 1)).alias(n) for i, n in enumerate("xywh")]
    return t.select(
        "project_id", "pos", F.col("t.id").alias("table_id"), F.coalesce(F.nullif("t.name", F.lit("")), F.concat(F.lit("Table_"), "t.id")).alias("name"), _or("t.rows", 0).alias("rows"), _or("t.cols", 0).alias("cols"), *box,
        _or("t.enabled", True).alias("enabled"), _or("t.has_merged_cells", False).alias("has_merged_cells"), _or("t.avg_confidence", 0.0).alias("avg_confidence"), F.coalesce("t.warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def columns(projects: DataFrame) -> DataFrame:
    """(project_id, table_id, pos, index, name, enabled, width) as listed; tables without a list have none."""
    t = projects.select("project_id", F.explode("tables").alias("t")).select("project_id", F.col("t.id").alias("table_id"), F.posexplode("t.columns").alias("pos", "c"))
    return t.select("project_id", "table_id", "pos", F.col("c.index").alias("index"), _or("c.name", "").alias("name"), _or("c.enabled", True).alias("enabled"), _or("c.width", 100).alias("width"))


def cells(projects: DataFrame) -> DataFrame:
    """(project_id, table_id, pos, row, col, text, original_text, ...): an empty original text is the text, an empty box
    none, an empty span 1 x 1."""
    t = projects.select("project_id", F.explode("tables").alias("t")).select("project_id", F.col("t.id").alias("table_id"), F.posexplode("t.cells").alias("pos", "c"))
    text = _or("c.text", "")
    box = [F.try_element_at("c.bbox", F.lit(i + 1)).alias(n) for i, n in enumerate("xywh")]
    span = [F.coalesce(F.try_element_at("c.merge_span", F.lit(i + 1)), F.lit(1)).alias(n) for i, n in enumerate(("row_span", "col_span"))]
    return t.select(
        "project_id", "table_id", F.col("pos").cast("long").alias("pos"), F.col("c.row").alias("row"), F.col("c.col").alias("col"), text.alias("text"), F.coalesce(F.nullif("c.original_text", F.lit("")), text).alias("original_text"),
        _or("c.confidence", 0.0).alias("confidence"), *box, _or("c.is_merged", False).alias("is_merged"), *span, F.coalesce("c.alternatives", F.array().cast(f"array<{_ALT}>")).alias("alternatives"), _or("c.needs_review", False).alias("needs_review"),
    )


def to_json(projects: DataFrame, indent: bool = False) -> DataFrame:
    """(project_id, json) of projects with their nested columns; non-ASCII text stays, a missing roi is left out."""
    names = [f.split(" ", 1)[0] for f in _fields() if f.split(" ", 1)[0] in projects.columns]
    return projects.select("project_id", F.to_json(F.struct(*names), {"pretty": str(indent).lower()}).alias("json"))


def enabled(tables_: DataFrame) -> DataFrame:
    return tables_.where("enabled")


def get_table(tables_: DataFrame, table_id: str) -> DataFrame:
    return tables_.where(F.col("table_id") == table_id)


def with_table(tables_: DataFrame, more: DataFrame) -> DataFrame:
    """tables_ and more tables (project_id, table_id and any of the other columns), after those of their project."""
    last = tables_.groupBy("project_id").agg(F.max("pos").alias("__last"))
    at = F.row_number().over(Window.partitionBy("project_id").orderBy(*(["pos"] if "pos" in more.columns else []), "table_id"))
    new = more.withColumn("__at", at).join(last, "project_id", "left").withColumn("pos", (F.coalesce("__last", F.lit(-1)) + F.col("__at")).cast(tables_.schema["pos"].dataType))
    return tables_.unionByName(new.drop("__at", "__last"), allowMissingColumns=True)


def without_table(tables_: DataFrame, table_id: str) -> DataFrame:
    return tables_.where(F.col("table_id") != table_id)


def ready(tables_: DataFrame) -> DataFrame:
    """(project_id, has_tables, can_export): the gates before review and export."""
    return tables_.groupBy("project_id").agg((F.count("*") > 0).alias("has_tables"), F.bool_or("enabled").alias("can_export"))
