"""Cells of tables in coordinate form: filters, statistics, slices, dense rows, compaction, spans and display.

cells: table_id, row, col, pos, text, original_text, confidence, w, h, is_merged, needs_review. columns: table_id, index,
pos, name, enabled. Where several cells share a place the one of smallest pos counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank

Step = Callable[[DataFrame], DataFrame]


# ---- filters over table statistics

def stats(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols, n_cells, fill, avg_confidence, has_merged, n_review, area)."""
    return cells.groupBy("table_id").agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count("*").alias("n_cells"),
        F.avg(F.when(~blank(F.col("text")), 1.0).otherwise(0.0)).alias("fill"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.bool_or("is_merged").alias("has_merged"), F.count_if("needs_review").alias("n_review"), F.sum(F.col("w") * F.col("h")).alias("area"),
    )


def min_area(least: float = 5000, area: str = "area") -> Step:
    """Tables of at least so much area; those without a box (null) stay."""
    return lambda t: t.where(F.col(area).isNull() | (F.col(area) >= least))


def min_size(rows: int = 2, cols: int = 2) -> Step:
    return lambda t: t.where((F.col("rows") >= rows) & (F.col("cols") >= cols))


def min_cells(least: int = 4) -> Step:
    return lambda t: t.where(F.col("n_cells") >= least)


def text_fill(least: float = 0.1) -> Step:
    return lambda t: t.where(F.col("fill") >= least)


def min_confidence(least: float = 0.3) -> Step:
    return lambda t: t.where(F.col("avg_confidence") >= least)


def apply_filters(tables: DataFrame, steps: list[Step]) -> DataFrame:
    return reduce(DataFrame.transform, steps, tables)


def default_filter(tables: DataFrame) -> DataFrame:
    return apply_filters(tables, [min_size(), min_area(), text_fill()])


def warnings(tables: DataFrame) -> DataFrame:
    """Adds warnings, in their fixed order, to rows of stats() with has_lines."""
    # The sentences are fixed values.
    said = F.array(
        F.when(F.col("has_merged"), "Merged cells detected - data may need manual review"),
        F.when(F.col("avg_confidence") < 0.6, "Low OCR confidence - verify extracted text"),
        F.when(~F.col("has_lines"), "Table detected without visible lines - structure may need verification"),
        F.when(F.col("n_review") > 0, F.concat(F.col("n_review").cast("string"), F.lit(" cells need review - OCR engines disagreed"))),
    )
    return tables.withColumn("warnings", F.filter(said, lambda w: w.isNotNull()))


# ---- lookups and slices

def first_cells(cells: DataFrame) -> DataFrame:
    """The cell of each place that lookups see."""
    best = F.row_number().over(Window.partitionBy("table_id", "row", "col").orderBy("pos"))
    return cells.withColumn("__at", best).where("__at = 1").drop("__at")


def get_cell(cells: DataFrame, row: int, col: int) -> DataFrame:
    return first_cells(cells.where((F.col("row") == row) & (F.col("col") == col)))


def row_slice(cells: DataFrame, row: int) -> DataFrame:
    return cells.where(F.col("row") == row).select("table_id", "col", "pos", "text")


def column_slice(cells: DataFrame, col: int) -> DataFrame:
    return cells.where(F.col("col") == col).select("table_id", "row", "pos", "text")


def upsert(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """cells with the texts of updates (table_id, row, col, text); places without a cell get one of confidence 0 whose
    original text is the new one. Only the first cell of a place changes."""
    new = updates.select("table_id", "row", "col", F.col("text").alias("__text"))
    first = cells.groupBy("table_id", "row", "col").agg(F.min("pos").alias("pos")).join(new, ["table_id", "row", "col"])
    kept = cells.join(first, ["table_id", "row", "col", "pos"], "left").withColumn("text", F.coalesce("__text", "text")).drop("__text")
    added = new.join(cells, ["table_id", "row", "col"], "left_anti")
    made = {"pos": F.lit(1 << 40), "text": F.col("__text"), "original_text": F.col("__text"), "confidence": F.lit(0.0), "is_merged": F.lit(False), "needs_review": F.lit(False)}
    added = added.select(*(made.get(c, F.col(c) if c in ("table_id", "row", "col") else F.lit(None)).cast(t).alias(c) for c, t in cells.dtypes))
    return kept.select(*cells.columns).unionByName(added)


def headers(columns: DataFrame, enabled_only: bool = True) -> DataFrame:
    """(table_id, headers) in list order."""
    kept = columns.where("enabled") if enabled_only else columns
    return kept.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("headers"))


def auto_columns(tables: DataFrame) -> DataFrame:
    """(table_id, index, name, enabled, width) made for tables (table_id, cols)."""
    at = F.explode(F.when(F.col("cols") > 0, F.sequence(F.lit(0), F.col("cols").cast("int") - 1))).alias("index")
    return tables.select("table_id", at).select("table_id", "index", F.concat(F.lit("Col_"), F.col("index") + 1).alias("name"), F.lit(True).alias("enabled"), F.lit(100).alias("width"))


def table_name(name: Column, table_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Table_"), table_id.cast("string")))


# ---- dense rows and text output

def sizes(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols) that just hold the cells."""
    return cells.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def dense_rows(cells: DataFrame, columns: DataFrame, tables: DataFrame | None = None, enabled_only: bool = True) -> DataFrame:
    """(table_id, row, values): every row of the tables (table_id, rows, cols; by default what holds the cells) over their
    columns, or the enabled ones, by index below cols; missing cells are empty, and so are rows of a table without
    columns."""
    size = (sizes(cells) if tables is None else tables).select("table_id", F.col("rows").cast("long").alias("rows"), F.col("cols").cast("int").alias("cols"))
    if enabled_only:
        listed = columns.where("enabled").groupBy("table_id").agg(F.sort_array(F.collect_set(F.col("index").cast("int"))).alias("at"))
        size = size.join(listed, "table_id", "left").withColumn("at", F.filter(F.coalesce("at", F.array().cast("array<int>")), lambda i: i < F.col("cols")))
    else:
        size = size.withColumn("at", F.when(F.col("cols") > 0, F.sequence(F.lit(0), F.col("cols") - 1)).otherwise(F.array().cast("array<int>")))
    grid = size.where("rows > 0").select("table_id", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"))
    texts = first_cells(cells).groupBy("table_id", F.col("row").cast("long").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "text"))).alias("texts"))
    values = F.transform("at", lambda i: F.coalesce(F.try_element_at("texts", i), F.lit("")))
    return grid.join(texts, ["table_id", "row"], "left").select("table_id", "row", values.alias("values"))


def without_blank(rows: DataFrame) -> DataFrame:
    return rows.where(F.exists("values", lambda v: ~blank(v)))


def csv_field(v: Column, sep: str = ";") -> Column:
    """A field in quotes where it holds the separator, a quote or a line break."""
    return F.when(v.rlike(f'[{sep}"\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(rows: DataFrame, sep: str = ";") -> DataFrame:
    """(table_id, row, line): values as a line; a row of one empty field is a pair of quotes."""
    line = F.array_join(F.transform("values", lambda v: csv_field(v, sep)), sep)
    return rows.select("table_id", "row", F.when((F.size("values") == 1) & (F.col("values")[0] == ""), '""').otherwise(line).alias("line"))


def csv_text(cells: DataFrame, columns: DataFrame, include_headers: bool = True, skip_empty: bool = False, sep: str = ";", tables: DataFrame | None = None) -> DataFrame:
    """(table_id, csv): each of the tables (see dense_rows()) as text with CRLF; one without enabled columns is empty text."""
    size = sizes(cells) if tables is None else tables
    rows = dense_rows(cells, columns, size)
    body = csv_lines(without_blank(rows) if skip_empty else rows, sep)
    top = headers(columns).select("table_id", F.lit(-1).cast("long").alias("row"), F.col("headers").alias("values"))
    if include_headers:
        body = body.unionByName(csv_lines(top, sep))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\r\n"), F.lit("\r\n"))
    made = body.join(top.select("table_id"), "table_id", "left_semi").groupBy("table_id").agg(text.alias("csv"))
    return size.select("table_id").distinct().join(made, "table_id", "left").select("table_id", F.coalesce("csv", F.lit("")).alias("csv"))


def column_widths(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, index, width): longest of header and texts plus 2, 50 at most."""
    longest = cells.groupBy("table_id", F.col("col").alias("index")).agg(F.max(F.length("text")).alias("n"))
    return columns.join(longest, ["table_id", "index"], "left").select("table_id", "index", F.least(F.greatest(F.coalesce("n", F.lit(0)), F.length("name")) + 2, F.lit(50)).alias("width"))


# ---- compaction and spans

def compact(cells: DataFrame, axis: str) -> DataFrame:
    """Cells of the rows (or cols) that hold text, renumbered from 0 within each table."""
    full = cells.where(~blank(F.col("text"))).select("table_id", axis).distinct()
    place = full.withColumn("__new", F.row_number().over(Window.partitionBy("table_id").orderBy(axis)) - 1)
    return cells.join(place, ["table_id", axis]).drop(axis).withColumnRenamed("__new", axis).select(*cells.columns)


def compact_headers(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """columns of the indexes that hold text, reindexed with their names."""
    full = cells.where(~blank(F.col("text"))).select("table_id", F.col("col").alias("index")).distinct()
    place = full.withColumn("__new", F.row_number().over(Window.partitionBy("table_id").orderBy("index")) - 1)
    return columns.join(place, ["table_id", "index"]).drop("index").withColumnRenamed("__new", "index").select(*columns.columns)


def expand_spans(cells: DataFrame) -> DataFrame:
    """cells (with row_span, col_span) followed by copies over the rest of their spans; copies come after originals."""
    at = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("row_span") - 1)).alias("__r")).select("*", F.explode(F.sequence(F.lit(0), F.col("col_span") - 1)).alias("__c"))
    more = at.where("__r > 0 or __c > 0").withColumns({"row": F.col("row") + F.col("__r"), "col": F.col("col") + F.col("__c"), "pos": F.col("pos") + (1 << 32), "is_merged": F.lit(True)})
    return cells.unionByName(more.drop("__r", "__c"))


def merged_flags(cells: DataFrame, factor: float = 1.5) -> DataFrame:
    """is_merged: area above factor times the mean area of the table."""
    size = F.col("w") * F.col("h")
    return cells.withColumn("is_merged", size > factor * F.avg(size).over(Window.partitionBy("table_id")))


# ---- cell predicates and display

def edited(text: str = "text", original: str = "original_text") -> Column:
    return F.col(text) != F.coalesce(F.nullif(F.col(original), F.lit("")), F.col(text))


def low_confidence(c: Column) -> Column:
    return c < 0.6


def display_state() -> Column:
    return F.when(F.col("needs_review"), "review").when(F.col("is_merged"), "merged").when(edited(), "edited").when(low_confidence(F.col("confidence")), "low").otherwise("normal")


def percent(c: Column) -> Column:
    return (c * 100).cast("int")


def band(c: Column) -> Column:
    p = percent(c)
    return F.when(p >= 80, "high").when(p >= 60, "medium").otherwise("low")


def header_label() -> Column:
    return F.when(F.col("enabled"), F.col("name")).otherwise(F.concat(F.lit("["), "name", F.lit("]")))


def other_texts(alternatives: Column, text: Column) -> Column:
    """Texts of the alternatives that differ from the cell's."""
    return F.filter(F.transform(alternatives, lambda a: a["text"]), lambda t: t != text)


def has_alternatives(alternatives: Column) -> Column:
    """Whether more than one engine read the cell."""
    return F.size(alternatives) > 1
