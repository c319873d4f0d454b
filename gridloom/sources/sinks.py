"""Files of tables: CSV with a byte-order mark, and workbooks, written by the tasks that hold the tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from urllib.parse import quote
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sheet_name
from ..operators.tables import column_widths, csv_text, dense_rows, headers, without_blank
from .projects import to_json

BOM = b"\xef\xbb\xbf"


def _put(uri: str, data: bytes) -> None:
    folder, _, name = uri.rpartition("/")
    store, path = fs.FileSystem.from_uri(quote(folder, safe="/:@%?=&+,;!$'()*~"))
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def _writer(name: str, column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(name).to_pylist()
            for path, data in zip(paths, b.column(column).to_pylist(), strict=True):
                _put(path, data if isinstance(data, bytes) else BOM + data.encode())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return run


def _sized(names: DataFrame) -> DataFrame | None:
    return names.select("table_id", "rows", "cols").distinct() if {"rows", "cols"} <= set(names.columns) else None


def write_csv(cells: DataFrame, columns: DataFrame, names: DataFrame, folder: str, base: str, include_headers: bool = True, skip_empty: bool = False) -> list[str]:
    """One file {base}_{name}.csv for each enabled table of names (table_id, name, enabled; with rows and cols, tables
    without cells have files too): semicolons, CRLF, BOM. Tables of one name share a file, and the greatest table_id wins.
    Returns the paths."""
    text = csv_text(cells, columns, include_headers, skip_empty, tables=_sized(names)).join(names.where("enabled").select("table_id", "name"), "table_id")
    last = text.groupBy("name").agg(F.max_by("csv", "table_id").alias("csv"))
    made = last.select(F.concat(F.lit(f"{folder}/{base}_"), "name", F.lit(".csv")).alias("path"), "csv")
    return sorted(r["path"] for r in made.mapInArrow(_writer("path", "csv"), "path string").collect())


def write_first_csv(cells: DataFrame, columns: DataFrame, names: DataFrame, path: str, include_headers: bool = True, skip_empty: bool = False) -> list[str]:
    """The first table of names (table_id, pos), enabled or not, as the one file path; no tables write none."""
    first = names.orderBy("pos").limit(1)
    text = csv_text(cells, columns, include_headers, skip_empty, tables=_sized(first)).join(first.select("table_id"), "table_id")
    made = text.select(F.lit(path).alias("path"), "csv")
    return [r["path"] for r in made.mapInArrow(_writer("path", "csv"), "path string").collect()]


def export(kind: str, cells: DataFrame, columns: DataFrame, names: DataFrame, path: str, **options) -> list[str]:
    """Enabled tables of names (project_id, table_id, pos, name, enabled) by format: csv, a file for each table beside
    path, named after it; xlsx, a workbook for each project in path. Returns the paths."""
    if kind == "csv":
        folder, _, base = path.rpartition("/")
        return write_csv(cells, columns, names, folder, base.rsplit(".", 1)[0], **options)
    if kind == "xlsx":
        return write_workbooks(cells, columns, names, path, **options)
    raise ValueError(f"unknown format {kind}")


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        i, out = i // 26 - 1, chr(65 + i % 26) + out
    return out


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_STYLES = (
    f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFE0E0E0"/></patternFill></fill></fills><borders count="2"><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>'
    '<xf borderId="1" applyBorder="1" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>'
)


def workbook(sheets: list[tuple[str, list[int], list[list[str]], bool]]) -> bytes:
    """An XLSX file of (name, column widths, rows, whether the first row is a header). Cells are text. Names that repeat
    get a number; without sheets there is one named Empty."""
    used: set[str] = set()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        listed, links, kinds = [], [], []
        for n, (name, widths, rows, head) in enumerate(sheets or [("Empty", [], [], False)], 1):
            title, k = name, 1
            while title.lower() in used:
                title, k = f"{name[: 31 - len(str(k))]}{k}", k + 1
            used.add(title.lower())
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            body = "".join(
                f'<row r="{r}">' + "".join(f'<c r="{_column(c)}{r}" t="inlineStr" s="{1 if head and r == 1 else 2}"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'{_XML}<worksheet xmlns="{_MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{body}</sheetData></worksheet>')
            listed.append(f'<sheet name="{escape(title, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>')
            links.append(f'<Relationship Id="rId{n}" Type="{_REL}/worksheet" Target="worksheets/sheet{n}.xml"/>')
            kinds.append(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        links.append(f'<Relationship Id="rId0" Type="{_REL}/styles" Target="styles.xml"/>')
        z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(listed)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACK}/relationships">{"".join(links)}</Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr(
            "[Content_Types].xml",
            f'{_XML}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
            f"{''.join(kinds)}</Types>",
        )
    return out.getvalue()


def write_projects(projects: DataFrame, folder: str, ending: str = ".json", now: str | None = None) -> list[str]:
    """One file {folder}/{name}{ending} for each project (project_id, name and nested columns): indented JSON, text not
    escaped, modified now (an ISO time; by default the current one), created then if it never was. Returns the paths."""
    at = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    made = projects.withColumns({"created_at": F.coalesce(F.col("created_at"), at) if "created_at" in projects.columns else at, "modified_at": at})
    named = to_json(made).join(projects.select("project_id", F.concat(F.lit(f"{folder}/"), "name", F.lit(ending)).alias("path")), "project_id").select("path", "json")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            for path, text in zip(paths, b.column("json").to_pylist(), strict=True):
                _put(path, json.dumps(json.loads(text), ensure_ascii=False, indent=2).encode())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return sorted(r["path"] for r in named.mapInArrow(run, "path string").collect())


def write_workbooks(cells: DataFrame, columns: DataFrame, names: DataFrame, folder: str, include_headers: bool = True, skip_empty: bool = False) -> list[str]:
    """One workbook {folder}/{project_id}.xlsx for each project of names (project_id, table_id, pos, name, enabled), a
    sheet for each enabled table in order. Returns the paths."""
    rows = dense_rows(cells, columns, _sized(names))
    body = (without_blank(rows) if skip_empty else rows).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row", "values"))).alias("body"))
    wide = column_widths(cells, columns.where("enabled")).groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("index", "width"))).alias("wide"))
    t = names.where("enabled").join(body, "table_id", "left").join(wide, "table_id", "left").join(headers(columns), "table_id", "left")
    sheet = F.struct("pos", sheet_name(F.col("name")).alias("name"), F.col("headers"), F.transform("wide", lambda w: w["width"].cast("int")).alias("widths"), F.transform("body", lambda b: b["values"]).alias("rows"))
    books = names.select("project_id").distinct().join(t.groupBy("project_id").agg(F.sort_array(F.collect_list(sheet)).alias("sheets")), "project_id", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [f"{folder}/{p}.xlsx" for p in b.column("project_id").to_pylist()]
            for path, sheets in zip(paths, b.column("sheets").to_pylist(), strict=True):
                made = []
                for s in sheets or []:
                    top = [s["headers"]] if include_headers and s["headers"] else []
                    made.append((s["name"], s["widths"] or [], [*top, *(s["rows"] or [])], bool(top)))
                _put(path, workbook(made))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return sorted(r["path"] for r in books.mapInArrow(run, "path string").collect())
