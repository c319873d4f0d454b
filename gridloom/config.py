"""Settings, bound into plans as literals on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class DetectorConfig:
    """Limits of table detection. Fixed values."""

    angle_tolerance: float = 10.0
    cluster_tolerance: int = 20
    min_line_length: int = 50
    hough_threshold: int = 80
    min_table_area_ratio: float = 0.01
    min_rows: int = 2
    min_cols: int = 2
    min_cell_area: int = 100
    max_row_variance: float = 0.5
    max_col_variance: float = 0.5
    use_clahe: bool = True
    clahe_clip_limit: float = 2.0
    clahe_tile_size: int = 8
    use_multiple_thresholds: bool = True
    adaptive_block_sizes: tuple[int, ...] = (11, 15, 21)
    lineless_min_blocks: int = 4
    adjacency_distance: int = 50
    use_model: bool = True
    model_path: str = "yolov8m.pt"
    model_confidence_threshold: float = 0.5
    model_fallback_threshold: float = 0.7


@dataclass(frozen=True)
class Profile:
    """Preprocessing steps of an image. Fixed values."""

    name: str = "scan"
    deskew: bool = True
    denoise: bool = True
    contrast_enhance: bool = True
    threshold_value: int = 127
    line_enhancement: bool = True
    perspective_correction: bool = False
    shadow_removal: bool = False

    @staticmethod
    def scan() -> Profile:
        return Profile()

    @staticmethod
    def photo() -> Profile:
        return Profile(name="photo", perspective_correction=True, shadow_removal=True)

    @staticmethod
    def from_dict(data: dict) -> Profile:
        """Unknown keys are an error; missing ones take their defaults."""
        return Profile(**data)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_form(name: str, perspective: bool, shadows: bool, **other) -> Profile:
        """A scan takes no step that is for photos alone."""
        photo = name == "photo"
        return Profile(name=name, perspective_correction=photo and perspective, shadow_removal=photo and shadows, **other)


@dataclass(frozen=True)
class AppConfig:
    """Settings of an installation. Fixed values."""

    csv_delimiter: str = ";"
    ocr_languages: str = "rus+eng"
    min_table_area: int = 5000
    min_table_rows: int = 2
    min_table_cols: int = 2
    recent_files: tuple[str, ...] = ()

    @staticmethod
    def load(path: str) -> AppConfig:
        """Settings of a JSON file; defaults where it is absent, broken or has unknown keys."""
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
            if set(data) - {f.name for f in fields(AppConfig)}:
                return AppConfig()
            return AppConfig(**data | {"recent_files": tuple(data.get("recent_files", ()))})
        except (OSError, ValueError, TypeError):
            return AppConfig()

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), encoding="utf-8")
