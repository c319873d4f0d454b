"""Recognition engines behind one interface: words of image regions become rows, and rows texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .raster import for_recognition, gray, pixels


#: Text, confidence from 0 to 100, box.
Word = tuple[str, float, tuple[int, int, int, int]]


class Engine(Protocol):
    """What a worker needs of an engine; made once in each worker, where the model is loaded."""

    name: str

    def words(self, image: np.ndarray, mode: int) -> list[Word]:
        """The words of an image."""


class Detector(Protocol):
    """What a worker needs of a detection model; made once in each worker."""

    def regions(self, image: np.ndarray, least: float) -> list[tuple[float, float, float, float, float, int, str]]:
        """(x1, y1, x2, y2, confidence, class, class name) of what it finds with at least that confidence."""


class InkEngine:
    """A deterministic stand-in: it names each region by its size and ink, so plans can be run without a model."""

    name = "tesseract"

    def words(self, image: np.ndarray, mode: int) -> list[Word]:
        ink = float((image < 128).mean())
        return [(f"{image.shape[1]}x{image.shape[0]}", 100 * (1 - ink), (0, 0, image.shape[1], image.shape[0]))] if ink else []


_ENGINES: dict[Callable, Engine | Detector] = {}


def _engine(make: Callable[[], Engine | Detector]) -> Engine | Detector:
    if make not in _ENGINES:
        _ENGINES[make] = make()
    return _ENGINES[make]


def page_mode(height: int) -> int:
    """One line below 50 pixels, else a block."""
    return 7 if height < 50 else 6


def recognize_cells(cells: DataFrame, make: Callable[[], Engine] = InkEngine, pad: int = 2) -> DataFrame:
    """(cell_id, pos, word, confidence, source) of cells (cell_id, x, y, w, h) with their page's image (height, width,
    channels, data): the region, padded within the page, prepared and read."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = _engine(make)
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                img = pixels(r)
                x0, y0 = max(0, r["x"] - pad), max(0, r["y"] - pad)
                region = img[y0 : min(img.shape[0], r["y"] + r["h"] + pad), x0 : min(img.shape[1], r["x"] + r["w"] + pad)]
                if region.size:
                    out += [(r["cell_id"], i, t, c, engine.name) for i, (t, c, _) in enumerate(engine.words(for_recognition(region), page_mode(region.shape[0])))]
            yield pd.DataFrame(out, columns=["cell_id", "pos", "word", "confidence", "source"])

    source = cells.select("cell_id", "x", "y", "w", "h", "height", "width", "channels", "data")
    return source.mapInPandas(run, "cell_id long, pos int, word string, confidence double, source string")


def joined(words: DataFrame) -> DataFrame:
    """(cell_id, source, text, confidence): words of positive confidence in order, and their mean confidence from 0 to 1."""
    kept = words.where((F.col("confidence") > 0) & ~blank(F.col("word")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return kept.groupBy("cell_id", "source").agg(text.alias("text"), (F.avg("confidence") / 100).alias("confidence"))


def text_blocks(words: DataFrame, least: float = 30.0) -> DataFrame:
    """Words (page_id, word, confidence, box columns) above least, as blocks with confidence from 0 to 1."""
    kept = words.where((F.col("confidence") > least) & ~blank(F.col("word")))
    return kept.withColumn("confidence", F.col("confidence") / 100).withColumnRenamed("word", "text")


def page_regions(images: DataFrame, make: Callable[[], Detector], least: float = 0.5) -> DataFrame:
    """(page_id, det_id, x1, y1, x2, y2, confidence, class_id, class_name): all that a detection model finds on each of
    images (path, height, width, channels, data), numbered by page. A worker makes and loads the model once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _engine(make)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                found = [(row["path"], k, *map(float, r[:5]), int(r[5]), str(r[6])) for k, r in enumerate(model.regions(pixels(row), least))]
                names = ["page_id", "det_id", "x1", "y1", "x2", "y2", "confidence", "class_id", "class_name"]
                kinds = [pa.string(), pa.int64(), *[pa.float64()] * 5, pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*found, strict=True)) or [()] * 9, kinds, strict=True)], names)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "page_id string, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int, class_name string")


def model_regions(found: DataFrame, threshold: float | None = None, default: float = 0.5, classes: tuple[int, ...] = (0,), every: bool = False) -> DataFrame:
    """Regions (page_id, x1, y1, x2, y2, confidence, class_id, class_name) of a model that count as tables (or every one),
    as boxes, with any det_id; a threshold of 0 or none is the default."""
    table = F.lower("class_name").contains("table") | F.col("class_id").isin(*classes) | F.lit(every)
    kept = found.where((F.col("confidence") >= (threshold or default)) & table)
    x, y = F.col("x1").cast("long"), F.col("y1").cast("long")
    return kept.select("page_id", *(["det_id"] if "det_id" in found.columns else []), x.alias("x"), y.alias("y"), (F.col("x2").cast("long") - x).alias("w"), (F.col("y2").cast("long") - y).alias("h"), "confidence", "class_name")


#: Page mode of a search for words anywhere on a page. Fixed value.
SPARSE = 11
_REGION = "path string, cell_id string, pos int, source string, text string, confidence double"


def recognize_regions(pages: DataFrame, makers: tuple[Callable[[], Engine], ...] = (InkEngine,), pad: int = 3, least: int = 32, smooth: bool = True) -> DataFrame:
    """(path, cell_id, pos, source, text, confidence): what each engine, in order, reads in the regions of pages (path,
    height, width, channels, data, cells array of cell_id, x, y, w, h). An image moves once for all its cells. Words of
    positive confidence are joined; engines that read none give no row. Regions off the page give none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines = [_engine(m) for m in makers]
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                img, out = pixels(row), []
                for c in row["cells"] or []:
                    region = img[max(0, c["y"] - pad) : max(0, c["y"] + c["h"] + pad), max(0, c["x"] - pad) : max(0, c["x"] + c["w"] + pad)]
                    if not region.size:
                        continue
                    ready = for_recognition(region, least, smooth)
                    for pos, engine in enumerate(engines):
                        said = [(t, p) for t, p, _ in engine.words(ready, page_mode(ready.shape[0])) if p > 0 and t.strip()]
                        if said:
                            out.append((row["path"], c["cell_id"], pos, engine.name, " ".join(t for t, _ in said), sum(p for _, p in said) / len(said) / 100))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _REGION.split(", ")])

    return pages.select("path", "height", "width", "channels", "data", "cells").mapInArrow(run, _REGION)


def page_words(images: DataFrame, make: Callable[[], Engine] = InkEngine) -> DataFrame:
    """(page_id, block_id, word, confidence, x, y, w, h): the words that an engine finds anywhere on each image."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(make)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                found = [(row["path"], k, t, float(c), *map(int, box)) for k, (t, c, box) in enumerate(engine.words(gray(pixels(row)), SPARSE))]
                names = ["page_id", "block_id", "word", "confidence", "x", "y", "w", "h"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*found, strict=True)) or [()] * 8, kinds, strict=True)], names)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, "page_id string, block_id long, word string, confidence double, x long, y long, w long, h long")
