"""Adapters of installed recognition engines and of a detection model. None is imported until a worker makes one; an
adapter whose library is missing reads nothing, so plans run wherever some engine is."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Sequence
from functools import partial
from pathlib import Path

import numpy as np

from .recognize import Engine, Word

#: Names under which two engines know languages, by short code; others stay as they are. Fixed values.
TESSERACT = {"ru": "rus", "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "zh": "chi_sim", "ja": "jpn", "ko": "kor"}
PADDLE = {"ru": "ru", "en": "en", "de": "german", "fr": "fr", "es": "es", "it": "it", "zh": "ch", "ja": "japan", "ko": "korean"}
#: Libraries of the adapters, in the order in which engines vote.
LIBRARIES = {"paddleocr": "paddleocr", "easyocr": "easyocr", "tesseract": "pytesseract"}


def installed(name: str) -> bool:
    """Whether an engine's library can be imported here."""
    return importlib.util.find_spec(LIBRARIES.get(name, name)) is not None


def bundled(roots: Sequence[str]) -> tuple[str | None, str | None]:
    """(program, data folder) of the first of the folders that has tesseract/tesseract or tesseract/tesseract.exe."""
    for root in map(Path, roots):
        for program in (root / "tesseract" / "tesseract", root / "tesseract" / "tesseract.exe"):
            if program.is_file():
                data = program.parent / "tessdata"
                return str(program), str(data) if data.is_dir() else None
    return None, None


def _box(points) -> tuple[int, int, int, int]:
    x, y = (np.array([p[i] for p in points], float) for i in (0, 1))
    return int(x.min()), int(y.min()), int(x.max() - x.min()), int(y.max() - y.min())


class TesseractEngine:
    name = "tesseract"

    def __init__(self, languages: Sequence[str] = ("ru", "en"), roots: Sequence[str] = (), data: str | None = None):
        self.library = None
        if installed(self.name):
            import pytesseract

            program, own = bundled(roots)
            if program:
                pytesseract.pytesseract.tesseract_cmd = program
            if own or data:
                os.environ["TESSDATA_PREFIX"] = own or data
            self.library = pytesseract
        self.languages = "+".join(TESSERACT.get(x, x) for x in languages)

    def known_languages(self) -> list[str]:
        """Languages that the program has data of; none without the program."""
        try:
            return list(self.library.get_languages()) if self.library else []
        except OSError:
            return []

    def words(self, image: np.ndarray, mode: int) -> list[Word]:
        if self.library is None:
            return []
        d = self.library.image_to_data(image, lang=self.languages, config=f"--psm {mode}", output_type="dict")
        return [(t.strip(), float(c), (x, y, w, h)) for t, c, x, y, w, h in zip(d["text"], d["conf"], d["left"], d["top"], d["width"], d["height"], strict=True)]


class EasyEngine:
    name = "easyocr"

    def __init__(self, languages: Sequence[str] = ("ru", "en")):
        self.reader = None
        if installed(self.name):
            import easyocr

            self.reader = easyocr.Reader(list(languages), gpu=False, verbose=False)

    def words(self, image: np.ndarray, mode: int) -> list[Word]:
        found = self.reader.readtext(image, detail=1, paragraph=False) if self.reader else []
        return [(t.strip(), 100.0 * float(c), _box(points)) for points, t, c in found]


class PaddleEngine:
    name = "paddleocr"

    def __init__(self, languages: Sequence[str] = ("ru", "en")):
        self.reader = None
        if installed(self.name):
            import paddleocr

            one = next((PADDLE[x] for x in languages if x in PADDLE), "en")
            self.reader = paddleocr.PaddleOCR(use_angle_cls=True, lang=one, use_gpu=False, show_log=False)

    def words(self, image: np.ndarray, mode: int) -> list[Word]:
        found = (self.reader.ocr(image, cls=True) if self.reader else None) or [None]
        return [(said[0].strip(), 100.0 * float(said[1]), _box(points)) for points, said in found[0] or []]


ADAPTERS: dict[str, type] = {"paddleocr": PaddleEngine, "easyocr": EasyEngine, "tesseract": TesseractEngine}


def makers(languages: Sequence[str] = ("ru", "en"), names: Sequence[str] = tuple(ADAPTERS)) -> tuple[Callable[[], Engine], ...]:
    """What makes the installed ones of the named engines, in voting order, for extract() and recognize_regions()."""
    return tuple(partial(ADAPTERS[n], tuple(languages)) for n in ADAPTERS if n in names and installed(n))


class Yolo:
    """A detection model of the ultralytics library: loaded when first asked, finds nothing where it can't be."""

    def __init__(self, path: str = "yolov8m.pt", device: str | None = None):
        self.path, self.device, self.model, self.failed = path, device, None, False

    @staticmethod
    def available() -> bool:
        return installed("ultralytics")

    def load(self) -> bool:
        if self.model is None and not self.failed and self.available():
            import ultralytics

            try:
                self.model = ultralytics.YOLO(self.path)
                if self.device:
                    self.model.to(self.device)
            except (OSError, RuntimeError, ValueError):
                self.model, self.failed = None, True
        return self.model is not None

    def unload(self) -> None:
        self.model, self.failed = None, False

    def regions(self, image: np.ndarray, least: float) -> list[tuple[float, float, float, float, float, int, str]]:
        out = []
        for result in self.model.predict(image, conf=least, verbose=False) if self.load() else []:
            for box in result.boxes if result.boxes is not None else []:
                kind = int(box.cls[0])
                out.append((*(float(v) for v in box.xyxy[0]), float(box.conf[0]), kind, result.names.get(kind, "unknown")))
        return out
