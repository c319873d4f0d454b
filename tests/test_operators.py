"""The page, table and cell operators on hand-made cases, and every query that has SQL against it."""

from __future__ import annotations

import importlib.machinery
import json
import os
import sys
import types
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.config import AppConfig, Profile
from gridloom.functions import geometry as G
from gridloom.functions import text as X
from gridloom.operators import cluster, dedupe, edits, raster, recognize, tables, vote
from gridloom.plans import catalogue
from gridloom.sources import images, projects, sinks

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return "null" if v is None or v != v else f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert a == b


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*b):
    return [F.lit(x) for x in b]


def test_overlap_limits(spark):
    assert value(spark, G.iou(box(0, 0, 10, 10), box(10, 0, 10, 10))) == 0
    assert value(spark, G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1
    assert value(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert not value(spark, G.overlaps(box(0, 0, 10, 13), box(0, 7, 10, 13), 0.3))  # exactly 0.3


def test_gap_tolerance_is_inclusive_and_centers_truncate(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 20, 41, 41, -9)], "k int, c long")
    got = [tuple(r)[1:] for r in cluster.gap_clusters(df, ["k"], "c").orderBy("pos").collect()]
    assert got == [(0, 3, 3), (1, 41, 2)]
    assert cluster.gap_clusters(df.limit(0), ["k"], "c").count() == 0


def test_texts(spark):
    assert value(spark, X.normalized(F.lit("\x1c A\xa0\tB  "))) == "a b"
    assert X.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13) and X.indel_ratio("ab" * 60, "b" * 70) == pytest.approx(2 * 60 / 190)
    assert X.indel_ratio("", "") == 1 and X.indel_ratio("", "a") == 0 == X.indel_ratio("x" * 63, "y" * 63) and X.mean_similarity(["a"]) == 1
    assert X.mean_similarity(["new widget", "new wldget", "tegdiw wen"]) == (0.9 + X.indel_ratio("new widget", "tegdiw wen") + X.indel_ratio("new wldget", "tegdiw wen")) / 3
    assert value(spark, X.sheet_name(F.lit(""))) == "Sheet" and value(spark, X.sheet_name(F.lit("a/b" * 20))) == ("a_b" * 20)[:31]
    assert value(spark, X.mapped_languages(F.array(F.lit("ru"), F.lit("xx")))) == "rus+xx"


def test_vote_rungs(spark):
    rows = [
        (1, 0, "tesseract", "A", 0.59), (2, 0, "tesseract", "A", 0.60), (3, 0, "paddleocr", "a  b", 0.5), (3, 1, "easyocr", "A B", 0.9),
        (4, 0, "paddleocr", "cat", 0.9), (4, 1, "easyocr", "dog", 0.1), (4, 2, "tesseract", "DOG", 0.3), (5, 0, "easyocr", "one", 0.9), (5, 1, "tesseract", "zzz", 0.9),
        (6, 0, "easyocr", "long text " * 13 + "xyz", 0.5), (6, 1, "tesseract", "long text " * 13 + "xab", 0.9), (7, 0, "easyocr", None, 0.9), (7, 1, "tesseract", "", 0.9),
    ]
    got = {r["cell_id"]: r for r in vote.vote(spark.createDataFrame(rows, "cell_id long, pos int, source string, text string, confidence double")).collect()}
    assert [got[i]["rung"] for i in range(1, 6)] == ["single", "single", "all", "majority", "low"]
    assert (got[6]["rung"], got[6]["agreement"], got[7]["rung"]) == ("similar", pytest.approx(2 * 131 / 266), "all")
    assert [got[i]["needs_review"] for i in range(1, 6)] == [True, False, False, False, True]
    assert (got[3]["text"], got[4]["text"], got[4]["agreement"], got[5]["text"]) == ("A B", "DOG", 0.67, "one")


def test_suppression_leaves_no_overlap(spark):
    rng = np.random.default_rng(0)
    rows = [(1, i, *map(int, rng.integers(1, 60, 4)), float(rng.random()), 2, 2) for i in range(60)]
    d = spark.createDataFrame(rows, "page_id long, det_id long, x long, y long, w long, h long, confidence double, rows long, cols long")
    assert dedupe.pairs(dedupe.suppress(d)).count() == 0
    merged = dedupe.merge(d).collect()
    assert sum(r["absorbed"] + 1 for r in merged) == 60 and max(r["confidence"] for r in merged) <= 1


def test_undo_redo(spark):
    kinds = ["edit", "edit", "undo", "undo", "redo", "edit", "redo", "undo", "undo", "undo", "redo"]
    log = spark.createDataFrame([(1, i, k, 0, 0, f"t{i}") for i, k in enumerate(kinds)], "project long, seq long, kind string, row long, col long, new_text string")
    assert [r["seq"] for r in edits.live_edits(log).collect()] == [0]
    assert edits.live_edits(log.limit(0)).count() == 0


def test_edit_stream_matches_the_batch(spark, tmp_path):
    from gridloom.streaming.edits import live_edits_stream

    kinds = ["edit", "edit", "undo", "edit", "undo", "redo"]
    spark.createDataFrame([(p, i, k, f"{p}-{i}") for p in (1, 2) for i, k in enumerate(kinds)], "project long, seq long, kind string, new_text string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("project long, seq long, kind string, new_text string").json(f"{tmp_path}/in")
    q = live_edits_stream(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("live").collect():
        last[r["project"], r["seq"]] = r["undone"]
    assert {k for k, undone in last.items() if not undone} == {(1, 0), (1, 3), (2, 0), (2, 3)}


CELLS = "table_id long, row long, col long, pos long, text string, original_text string, confidence double, w long, h long, is_merged boolean, needs_review boolean"


def test_files(spark, tmp_path):
    rows = [(1, 0, 0, 0, 'a;"b"', "", 0.5, 1, 1, False, False), (1, 1, 1, 1, "Ж\n2", "x", 0.5, 1, 1, False, False), (1, 3, 0, 2, " ", "", 0.5, 1, 1, False, False), (2, 0, 0, 0, "", "", 0.1, 1, 1, False, False)]
    cells = spark.createDataFrame(rows, CELLS)
    columns = spark.createDataFrame([(1, 0, 0, "A", True), (1, 1, 1, "B", True), (2, 0, 0, "only", True)], "table_id long, index long, pos long, name string, enabled boolean")
    names = spark.createDataFrame([("p", 1, 0, "x/y", True), ("p", 2, 1, "x/y", True), ("q", 3, 0, "off", False)], "project_id string, table_id long, pos long, name string, enabled boolean")
    paths = sinks.write_csv(cells, columns, names.withColumn("name", F.concat(F.lit("t"), "table_id")), f"file://{tmp_path}", "out", skip_empty=True)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["out_t1.csv", "out_t2.csv"]
    assert (tmp_path / "out_t1.csv").read_bytes() == b'\xef\xbb\xbfA;B\r\n"a;""b""";\r\n;"' + "Ж".encode() + b'\n2"\r\n'
    assert sinks.csv_text(cells, columns).where("table_id = 2").first()["csv"] == 'only\r\n""\r\n'
    sized = names.withColumn("name", F.concat(F.lit("s"), "table_id")).withColumn("enabled", F.lit(True)).withColumn("rows", F.lit(2)).withColumn("cols", F.lit(2))
    more = columns.union(spark.createDataFrame([(3, 0, 0, "N", True)], columns.schema))
    assert [p.rsplit("/", 1)[1] for p in sinks.export("csv", cells, more, sized, f"file://{tmp_path}/out.csv")] == ["out_s1.csv", "out_s2.csv", "out_s3.csv"]
    assert (tmp_path / "out_s3.csv").read_bytes() == b'\xef\xbb\xbfN\r\n""\r\n""\r\n' and (tmp_path / "out_s1.csv").read_bytes().count(b"\r\n") == 3
    assert sinks.write_first_csv(cells, columns, names, f"file://{tmp_path}/first.csv") == [f"file://{tmp_path}/first.csv"] and (tmp_path / "first.csv").read_text("utf-8-sig").startswith("A;B")
    with pytest.raises(ValueError, match="unknown format"):
        sinks.export("pdf", cells, columns, names, "x")
    books = sinks.write_workbooks(cells, columns, names, f"file://{tmp_path}")
    assert [b.rsplit("/", 1)[1] for b in books] == ["p.xlsx", "q.xlsx"]
    with zipfile.ZipFile(tmp_path / "p.xlsx") as z:
        assert z.testzip() is None and 'name="x_y"' in z.read("xl/workbook.xml").decode() and 'name="x_y1"' in z.read("xl/workbook.xml").decode()
        assert "a;&quot;" in z.read("xl/worksheets/sheet1.xml").decode() or 'a;"b"' in z.read("xl/worksheets/sheet1.xml").decode()
    with zipfile.ZipFile(tmp_path / "q.xlsx") as z:
        assert 'name="Empty"' in z.read("xl/workbook.xml").decode()


def test_project_json(spark, tmp_path):
    data = {"name": "p", "tables": [{"id": "t1", "rows": 2, "cols": 2, "cells": [{"row": 0, "col": 0, "text": "Ä", "merge_span": [1, 2], "is_merged": True}, {"row": 1, "col": 1, "text": " ", "confidence": 0.59, "bbox": [0, 0, 10, 10], "alternatives": [{"text": "x", "confidence": 0.4, "source": "easyocr"}]}], "columns": [{"index": 0}, {"index": 1, "enabled": False}]}]}
    (tmp_path / "a.json").write_text(json.dumps(data, indent=2))
    p = projects.read(spark, str(tmp_path))
    c = projects.cells(p).orderBy("pos").collect()
    assert (c[0]["original_text"], c[0]["x"], c[0]["col_span"], c[1]["h"], c[1]["alternatives"][0]["source"]) == ("Ä", None, 2, 10, "easyocr")
    assert [r["enabled"] for r in projects.columns(p).orderBy("pos").collect()] == [True, False]
    t = projects.tables(p).first()
    assert (t["name"], t["enabled"], t["warnings"]) == ("Table_t1", True, []) and projects.ready(projects.tables(p)).first()["can_export"]
    again = projects.parse(projects.to_json(p))
    assert projects.cells(again).orderBy("pos").collect() == c
    both = tables.expand_spans(projects.cells(p).select("table_id", "row", "col", "pos", "text", "is_merged", "row_span", "col_span"))
    assert tables.get_cell(both, 0, 1).first()["text"] == "Ä"


def test_settings(tmp_path):
    with pytest.raises(TypeError):
        Profile.from_dict({"no": 1})
    assert not Profile.from_form("scan", True, True).shadow_removal
    AppConfig(csv_delimiter=",").save(f"{tmp_path}/c.json")
    assert AppConfig.load(f"{tmp_path}/c.json").csv_delimiter == "," and AppConfig.load(f"{tmp_path}/none.json") == AppConfig()


def page(rows=3, cols=4):
    img = np.full((400, 600), 255, np.uint8)
    for y in np.linspace(60, 340, rows + 1).astype(int):
        img[y : y + 2, 60:542] = 0
    for x in np.linspace(60, 540, cols + 1).astype(int):
        img[60:342, x : x + 2] = 0
    return img


def test_ruled_grid_is_found(spark):
    found = raster.detect_lines(page())
    assert found and all((t["rows"], t["cols"]) == (3, 4) and abs(t["x"] - 60) < 6 and abs(t["w"] - 482) < 12 for t in found)
    frame = spark.createDataFrame([("p", 400, 600, 1, bytearray(page().tobytes()))], "path string, height int, width int, channels int, data binary")
    got = raster.detect_tables(frame).collect()
    assert len(got) == len(found) and len(got[0]["cells"]) == 12


def test_raster_steps():
    img = page()
    colour = np.repeat(img[..., None], 3, 2)
    for profile in (Profile.scan(), Profile.photo()):
        out = raster.preprocess(colour[100:220, 100:260], profile)
        assert out.ndim == 2 and out.dtype == np.uint8
    tilted = raster.rotated(img, 3)
    assert abs(abs(raster.skew(tilted)) - 3) <= 1
    assert raster.otsu(np.array([[0, 0, 200, 200]], np.uint8)) < 200
    assert raster.warped(img, np.array([[0, 0], [9, 0], [9, 9], [0, 9]])) is img
    assert raster.cropped(img, [(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)]).shape == (200, 300)
    assert raster.for_recognition(255 - img[:20]).mean() > 127 and raster.for_recognition(img[:20]).shape[0] == 30
    assert len(np.unique(raster.components(np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]])))) == 2


def test_recognition_plug_in(spark):
    img = page()
    frame = spark.createDataFrame([(1, 60, 60, 120, 93, 400, 600, 1, bytearray(img.tobytes())), (2, 700, 700, 5, 5, 400, 600, 1, bytearray(img.tobytes()))], "cell_id long, x int, y int, w int, h int, height int, width int, channels int, data binary")
    got = recognize.joined(recognize.recognize_cells(frame)).collect()
    assert len(got) == 1 and got[0]["text"] == "124x97" and 0 < got[0]["confidence"] <= 1


def test_image_endings(spark):
    got = spark.createDataFrame([("A.PNG",), ("b.tif",), ("c.gif",), ("png",)], "p string").where(images.is_image(F.col("p"))).count()
    assert got == 2


def plain_window(img, high, wide, f):
    """f of the pixels around each, the border repeated."""
    out = np.zeros(img.shape)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            around = [img[min(max(y + dy, 0), img.shape[0] - 1), min(max(x + dx, 0), img.shape[1] - 1)] for dy in range(-(high // 2), high - high // 2) for dx in range(-(wide // 2), wide - wide // 2)]
            out[y, x] = f(around)
    return out


def test_pixel_steps_equal_plain_loops():
    img = np.random.default_rng(3).integers(0, 256, (23, 31), dtype=np.uint8)
    assert (raster.dilate(img, 5, 3) == plain_window(img, 3, 5, max)).all() and (raster.erode(img, 3, 5) == plain_window(img, 5, 3, min)).all()
    assert (raster.median(img, 3) == plain_window(img, 3, 3, lambda w: sorted(w)[4])).all()
    assert (raster._box_sums(img.astype(np.int64), 7) == plain_window(img.astype(int), 7, 7, sum)).all()
    counts = np.bincount(img.ravel(), minlength=256)
    spread = []
    for t in range(256):
        low, high = counts[: t + 1].sum(), counts[t + 1 :].sum()
        a, b = (counts[: t + 1] * np.arange(t + 1)).sum() / max(low, 1), (counts[t + 1 :] * np.arange(t + 1, 256)).sum() / max(high, 1)
        spread.append(low * high * (a - b) ** 2)
    assert raster.otsu(img) == int(np.argmax(spread))

    small = img[:9, :8]
    wide = np.pad(small.astype(int), 2, mode="reflect")
    want = np.zeros(small.shape)
    at = lambda a, y, x: a[min(max(y, 0), a.shape[0] - 1), min(max(x, 0), a.shape[1] - 1)]
    for y in range(9):
        for x in range(8):
            total = mass = 0.0
            for dy in range(5):
                for dx in range(5):
                    moved = wide[dy : dy + 9, dx : dx + 8]
                    unlike = sum((int(at(small, y + j, x + i)) - int(at(moved, y + j, x + i))) ** 2 for j in (-1, 0, 1) for i in (-1, 0, 1)) / 9
                    weight = np.exp(-unlike / 10000)
                    total, mass = total + weight * moved[y, x], mass + weight
            want[y, x] = round(total / mass)
    assert (raster.denoise(small, 100.0, 3, 5) == want).all()


def test_colours_and_outlines():
    colour = np.random.default_rng(5).integers(0, 256, (20, 20, 3), dtype=np.uint8)
    assert np.abs(raster.from_lab(raster.to_lab(colour)).astype(int) - colour).max() <= 1
    assert raster.to_lab(np.array([[[255, 255, 255], [0, 0, 255]]], np.uint8)).round(1).tolist() == [[[100.0, 0.0, 0.0], [53.2, 80.1, 67.2]]]
    spot = np.full((60, 60), 120, np.uint8)
    spot[20:35, 20:35] = 255
    assert raster.without_glare(spot).max() <= 121 and (raster.without_glare(np.repeat(spot[..., None], 3, 2)) == raster.without_glare(spot)).all()
    dark = np.full((200, 300), 20, np.uint8)
    y, x = np.mgrid[0:200, 0:300]
    dark[(y > 20 + x // 30) & (y < 180 - x // 40) & (x > 30) & (x < 270)] = 230
    corners = raster.page_corners(dark)
    assert np.abs(corners - np.array([[31, 22], [269, 29], [269, 173], [31, 179]])).max() <= 2
    round_ = np.full((200, 300), 20, np.uint8)
    round_[(y - 100) ** 2 + (x - 150) ** 2 < 6400] = 230
    assert raster.page_corners(round_) is None
    assert raster.simplified(raster.hull(np.array([[0, 0], [9, 0], [9, 9], [0, 9], [5, 5], [5, 0]])), 1.0).shape == (4, 2)


def test_png_files_hold_the_pixels(spark):
    img = np.random.default_rng(4).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for pixels in (img, img[..., 0]):
        png = raster.encode_png(pixels)
        assert png[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(png[16:20], "big") == 7
        body = zlib.decompress(png[41 : 41 + int.from_bytes(png[33:37], "big")])
        lines = np.frombuffer(body, np.uint8).reshape(5, -1)[:, 1:]
        assert (lines.reshape(pixels.shape) == (pixels[..., ::-1] if pixels.ndim == 3 else pixels)).all()


def test_engine_adapters(monkeypatch, tmp_path):
    from gridloom.operators import engines

    assert engines.TesseractEngine().words(page(), 6) == [] == engines.EasyEngine().words(page(), 6) == engines.PaddleEngine().words(page(), 6)
    assert engines.makers() == () and not engines.Yolo.available() and engines.Yolo().regions(page(), 0.5) == []
    data = {"text": [" a ", ""], "conf": [90, -1], "left": [1, 0], "top": [2, 0], "width": [3, 0], "height": [4, 0]}
    reader = types.SimpleNamespace(readtext=lambda image, **_: [([(1, 2), (5, 2), (5, 9), (1, 9)], "b", 0.5)], ocr=lambda image, cls: [[[[(0, 0), (4, 0), (4, 4), (0, 4)], ("c ", 0.25)]]])
    box_ = types.SimpleNamespace(cls=[1.0], conf=[0.75], xyxy=[(1, 2, 3, 4)])
    model = types.SimpleNamespace(predict=lambda image, **_: [types.SimpleNamespace(boxes=[box_], names={1: "a table"}), types.SimpleNamespace(boxes=None, names={})], to=lambda d: None)
    made = {
        "pytesseract": {"image_to_data": lambda image, **_: data, "pytesseract": types.SimpleNamespace(), "get_languages": lambda: ["eng"]}, "easyocr": {"Reader": lambda *_, **__: reader},
        "paddleocr": {"PaddleOCR": lambda **_: reader}, "ultralytics": {"YOLO": lambda path: model},
    }
    for name, parts in made.items():
        module = types.ModuleType(name)
        module.__spec__ = importlib.machinery.ModuleSpec(name, None)
        module.__dict__.update(parts)
        monkeypatch.setitem(sys.modules, name, module)
    t = engines.TesseractEngine(["ru", "xx"])
    assert t.languages == "rus+xx" and t.known_languages() == ["eng"] and t.words(page(), 6)[0] == ("a", 90.0, (1, 2, 3, 4))
    assert [m().words(page(), 6)[0] for m in engines.makers(["de"])] == [("c", 25.0, (0, 0, 4, 4)), ("b", 50.0, (1, 2, 4, 7)), ("a", 90.0, (1, 2, 3, 4))]
    y = engines.Yolo(device="cpu")
    assert y.regions(page(), 0.5) == [(1.0, 2.0, 3.0, 4.0, 0.75, 1, "a table")] and y.model
    y.unload()
    assert y.model is None and engines.bundled([str(tmp_path)]) == (None, None)
    (tmp_path / "tesseract" / "tessdata").mkdir(parents=True)
    (tmp_path / "tesseract" / "tesseract").touch()
    assert engines.bundled(["/none", str(tmp_path)]) == (f"{tmp_path}/tesseract/tesseract", f"{tmp_path}/tesseract/tessdata")


def test_project_files(spark, tmp_path):
    data = [("p1", "first Ж", [("t1", "T")], "2020-01-01"), ("p2", "second", [], None)]
    frame = spark.createDataFrame(data, "project_id string, name string, tables array<struct<id:string,name:string>>, created_at string")
    paths = sinks.write_projects(frame, f"file://{tmp_path}", now="2024-05-06T07:08:09")
    assert [p.rsplit("/", 1)[1] for p in paths] == ["first Ж.json", "second.json"]
    text = (tmp_path / "first Ж.json").read_text("utf-8")
    made = json.loads(text)
    assert (made["created_at"], made["modified_at"]) == ("2020-01-01", "2024-05-06T07:08:09") and '\n  "name": "first Ж"' in text
    t = projects.tables(projects.read(spark, f"{tmp_path}/first*.json"))
    more = projects.with_table(t, t.select("project_id", F.lit("t2").alias("table_id")))
    assert [(r["table_id"], r["pos"]) for r in more.orderBy("pos").collect()] == [("t1", 0), ("t2", 1)] and projects.get_table(more, "t2").count() == 1
