"""Extraction from images end to end."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridloom.config import DetectorConfig
from gridloom.operators import raster
from gridloom.plans import extract
from gridloom.sources import projects

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the tests' folder
IMAGE = "path string, height int, width int, channels int, data binary"


class Blobs:
    """Reads dark squares as words."""

    name = "easyocr"

    def words(self, image, mode):
        labels = raster.components(image < 128)
        out = []
        for label in np.unique(labels[labels > 0]):
            y, x = np.nonzero(labels == label)
            if len(y) > 30:
                out.append(("w", 90.0, (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1)))
        return out


class Sure(Blobs):
    name = "paddleocr"

    def words(self, image, mode):
        return [("W", 80.0, (0, 0, 1, 1))]


def ruled(rows=3, cols=4):
    img = np.full((400, 600), 255, np.uint8)
    for y in np.linspace(60, 340, rows + 1).astype(int):
        img[y : y + 2, 60:542] = 0
    for x in np.linspace(60, 540, cols + 1).astype(int):
        img[60:342, x : x + 2] = 0
    return img


def bare():
    img = np.full((300, 300), 255, np.uint8)
    for y in (40, 80, 120):
        for x in (40, 80, 120):
            img[y : y + 12, x : x + 12] = 0
    return img


def frame(spark, **pages):
    return spark.createDataFrame([(k, *v.shape, 1, bytearray(v.tobytes())) for k, v in pages.items()], IMAGE)


def test_segments_follow_the_lines():
    mask = np.zeros((200, 300), bool)
    mask[50, 20:250] = mask[150, 20:250] = mask[50:151, 20] = mask[50:151, 249] = True
    mask[100, 20:60] = mask[100, 100:250] = True
    got = {tuple(s) for s in raster.segments(mask, 80, 50)}
    level = sorted((s[1], min(s[0], s[2]), max(s[0], s[2])) for s in got if s[1] == s[3])
    assert [y for y, *_ in level] == [50, 100, 150] and level[1][2] - level[1][1] < 160
    assert raster.segments(np.zeros((50, 50), bool), 80, 50) == []


def test_page_corners_fall_back_to_lines():
    img = np.full((300, 400), 120, np.uint8)
    img[60:240, 80:321] = 255
    c = raster.crossing_corners(img)
    assert c is not None and np.abs(c - [[80, 60], [320, 60], [320, 239], [80, 239]]).max() < 15
    assert raster.crossing_corners(np.full((300, 400), 120, np.uint8)) is None


def test_crossing_tables(spark):
    lines = [("a", 0, y, 300, y + 2) for y in (10, 13, 60, 110)] + [("a", x, 0, x, 200) for x in (20, 120, 221)] + [("a", 0, 0, 90, 90), ("b", 0, 5, 90, 5), ("c", 0, 5, 90, 5), ("c", 0, 50, 90, 50), ("c", 0, 90, 90, 90), ("c", 0, 150, 90, 150)]
    got = extract.crossing_tables(spark.createDataFrame(lines, "page_id string, x1 long, y1 long, x2 long, y2 long")).collect()
    assert [(r["page_id"], r["x"], r["y"], r["w"], r["h"], r["rows"], r["cols"]) for r in got] == [("a", 20, 11, 201, 99, 2, 2)]
    assert [tuple(c) for c in got[0]["cells"]] == [(20, 11, 100, 49), (120, 11, 101, 49), (20, 60, 100, 50), (120, 60, 101, 50)]


def test_extraction_end_to_end(spark, tmp_path):
    img = ruled()
    img[100:112, 100:112] = 0
    images = frame(spark, ruled=img, bare=bare(), blank=np.full((200, 200), 255, np.uint8))
    tables, cells = extract.extract(images, f"file://{tmp_path}", (Sure, Blobs))
    seen = {r["page_id"]: r for r in tables.collect()}
    assert seen["ruled"]["has_lines"] and (seen["ruled"]["rows"], seen["ruled"]["cols"], seen["ruled"]["n_cells"]) == (3, 4, 12) and seen["ruled"]["name"] == "Table_1"
    assert {(r["row"], r["col"]) for r in cells.where("page_id = 'ruled'").collect()} == {(i, j) for i in range(3) for j in range(4)}
    assert set(seen) == {"ruled"} and cells.where(F.size("alternatives") == 0).count() == 0
    # Blobs sees each cell's rules as one word, and two words where the square is: there the engines disagree.
    assert cells.where("text = 'W'").count() == 12 and [(r["row"], r["col"]) for r in cells.where("needs_review").collect()] == [(0, 0)]
    assert "1 cells need review - OCR engines disagreed" in seen["ruled"]["warnings"]


def test_pages_without_lines_and_without_tables(spark, tmp_path):
    images = frame(spark, bare=bare(), blank=np.full((200, 200), 255, np.uint8))
    tables, cells = extract.extract(images, f"file://{tmp_path}/a", (Blobs,))
    rows = tables.collect()
    assert [(r["page_id"], r["rows"], r["cols"], r["has_lines"], r["detection_method"]) for r in rows] == [("bare", 3, 3, False, "lineless_graph")]
    assert any("without visible lines" in w for w in rows[0]["warnings"]) and cells.count() == 9
    again, none = extract.extract(images, f"file://{tmp_path}/b", (Blobs,), DetectorConfig(), detect_lineless=False)
    assert again.count() == 0 and none.count() == 0
    again, none = extract.extract(images.limit(0), f"file://{tmp_path}/c")
    assert again.count() == 0 and none.count() == 0


def test_files_become_projects(spark, tmp_path):
    img = ruled()
    head = b"BM" + (54 + img.size * 3).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + img.shape[1].to_bytes(4, "little") + img.shape[0].to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "page.one.bmp").write_bytes(head + info + np.repeat(img[::-1, :, None], 3, 2).tobytes())
    tables, cells = extract.extract_files(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", engines=(Sure,))
    back = projects.parse(projects.to_json(extract.as_projects(tables, cells)))
    assert [r["name"] for r in back.collect()] == ["page.one"] and projects.columns(back).count() == 4
    got = projects.cells(back).orderBy("pos").collect()
    assert [(r["row"], r["col"], r["text"]) for r in got] == [(i, j, "W") for i in range(3) for j in range(4)] and got[0]["w"] > 0
    t = projects.tables(back).first()
    assert (t["rows"], t["cols"], t["enabled"], round(t["avg_confidence"], 9)) == (3, 4, True, 0.8)


def test_a_model_takes_a_second_look(spark, tmp_path):
    class Model:
        def regions(self, image, least):
            found = [(150.0, 10.0, 650.0, 390.0, 0.9, 0, "grid"), (2.0, 2.0, 40.0, 40.0, 0.6, 7, "a table"), (5.0, 5.0, 9.0, 9.0, 0.9, 7, "chair")]
            return [r for r in found if r[4] >= least] if image[0, 0] == 254 else []

    def grid(corner):
        img = np.full((400, 700), 255, np.uint8)
        for y in np.linspace(60, 340, 4).astype(int):
            img[y : y + 2, 200:602] = 0
        for x in np.linspace(200, 600, 4).astype(int):
            img[60:342, x : x + 2] = 0
        img[0, 0] = corner
        return img

    pages = [("a", grid(254)), ("b", grid(255)), ("c", np.full((400, 700), 254, np.uint8))]
    frame = spark.createDataFrame([(n, 400, 700, 1, bytearray(i.tobytes())) for n, i in pages], "path string, height int, width int, channels int, data binary")
    config = DetectorConfig(model_fallback_threshold=1.01)
    found = {}
    for use in (None, False):
        made, cells = extract.extract(frame, f"file://{tmp_path}/{use}", config=config, detector=Model, use_model=use, detect_lineless=False)
        found[use] = {(r["page_id"], r["det_id"]): r for r in made.collect()}
    assert {k[0] for k in found[False]} == {"a", "b"} and all(r["detection_method"] != "hybrid_confirmed" for r in found[False].values())
    a = [r for k, r in found[None].items() if k[0] == "a"]
    assert [r["detection_method"] for r in a] == ["hybrid_confirmed"] and a[0]["detection_confidence"] >= found[False]["a", 1]["detection_confidence"]
    assert [r["detection_method"] for k, r in found[None].items() if k[0] == "b"] == [r["detection_method"] for k, r in found[False].items() if k[0] == "b"]
    assert not [k for k in found[None] if k[0] == "c"]  # regions without lines are 1 x 1, which extraction leaves out
    regions = extract.recognize.model_regions(extract.recognize.page_regions(frame, Model), every=True)
    assert regions.count() == 6
    files = frame.selectExpr("path", "data as content").limit(3)
    saved = extract.as_projects(*extract.extract(frame, f"file://{tmp_path}/p", by_groups=False), files, extract.raster.as_png(frame)).collect()
    assert len(saved) == 2 and all(r["image_data"] and r["processed_image_data"].startswith("iVBOR") for r in saved)
