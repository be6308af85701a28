"""Settings of the four stages, read from JSON files and checked."""

from __future__ import annotations

import itertools
import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..operators.records import Rules
from ..operators.resample import STRATEGIES
from ..operators.transitions import THRESHOLDS

logger = logging.getLogger(__name__)
INDICES, WINDOWS = ("GCC", "RCC", "BCC"), ("1D", "3D")


class Settings:
    """Reads a settings class from JSON: paths become paths, unknown keys are warned of, problems raise ValueError."""

    PATHS: tuple[str, ...] = ()

    def problems(self) -> Iterator[tuple[bool, str]]:
        """(wrong, what) for each rule."""
        return iter(())

    def check(self):
        for wrong, what in self.problems():
            if wrong:
                raise ValueError(f"{type(self).__name__}: {what}")
        return self

    @classmethod
    def load(cls, path: str | Path):
        raw = read_json(path, "settings")
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(raw) - known):
            logger.warning("unknown settings are ignored: %s", ", ".join(unknown))
        made = {k: Path(v) if k in cls.PATHS and v is not None else v for k, v in raw.items() if k in known}
        return cls(**made).check()


def read_json(path: str | Path, what: str):
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ValueError(f"{what} {str(path)!r} can't be read: {e}") from e


def _unreadable(path: Path | None) -> bool:
    if path is None:
        return False
    try:
        read_json(path, "")
    except ValueError:
        return True
    return not path.is_file()


@dataclass
class Extraction(Settings):
    """Stage 1: pictures and polygons to observations."""

    image_dataset_root: Path
    output_root: Path
    polygon_files_root: Path
    polygon_config_path: Path
    uid_mapping_path: Path
    categories_kept: list[str] = field(default_factory=lambda: ["individual tree"])
    shrink_ratios: list[int] = field(default_factory=lambda: [33])
    plot_dir: Path | None = None
    camera_hashes_path: Path | None = None
    PATHS = ("image_dataset_root", "output_root", "polygon_files_root", "polygon_config_path", "uid_mapping_path", "plot_dir", "camera_hashes_path")

    def problems(self):
        for name in ("image_dataset_root", "polygon_files_root"):
            yield not getattr(self, name).exists(), f"{name} does not exist"
        for name in ("polygon_config_path", "camera_hashes_path", "uid_mapping_path"):
            yield _unreadable(getattr(self, name)), f"{name} is not a readable JSON file"
        yield not self.categories_kept or not all(isinstance(c, str) for c in self.categories_kept), "categories_kept must name at least one category"
        yield not all(0 < r < 100 for r in self.shrink_ratios), "shrink_ratios must lie between 0 and 100"


@dataclass
class Processing(Settings):
    """Stage 2: observations to products."""

    input_root: Path
    output_root: Path
    num_workers: int = 1
    snow_flags_root: Path | None = None
    brightness_min: float = 50.0
    brightness_max: float = 650.0
    aggregation_windows: list[str] = field(default_factory=lambda: list(WINDOWS))
    aggregation_strategies: list[str] = field(default_factory=lambda: list(STRATEGIES))
    smoothing_window_candidates: list[int] = field(default_factory=lambda: list(range(3, 22, 2)))
    smoothing_cv_kfolds: int = 5
    smoothing_use_rust: bool = False
    noon_only_on_resolution_change: bool = True
    shrink_suffix: str | None = "33"
    exclude_locations: list[str] = field(default_factory=list)
    PATHS = ("input_root", "output_root", "snow_flags_root")

    def problems(self):
        yield not self.input_root.exists(), "input_root does not exist"
        yield self.snow_flags_root is not None and not self.snow_flags_root.exists(), "snow_flags_root does not exist"
        yield self.num_workers < 1, "num_workers must be at least 1"
        yield min(self.brightness_min, self.brightness_max) < 0, "brightness bounds must not be negative"
        yield self.brightness_min >= self.brightness_max, "brightness_min must be below brightness_max"
        yield not self.aggregation_windows or not all(isinstance(w, str) for w in self.aggregation_windows), "aggregation_windows must name at least one window"
        yield not self.aggregation_strategies or bool(set(self.aggregation_strategies) - set(STRATEGIES)), f"aggregation_strategies must be among {STRATEGIES}"


@dataclass
class Modelling(Settings):
    """Stage 3: products to transition dates and their uncertainty."""

    input_root: Path
    output_root: Path
    random_seed: int
    num_workers: int = 1
    series_index: str | list[str] = "GCC"
    series_window: str | list[str] = "3D"
    series_strategy: str = "p90"
    cv_window_min: int = 3
    cv_window_max: int = 21
    cv_kfolds: int = 5
    cv_random_state: int = 42
    amplitude_thresholds: list[float] = field(default_factory=lambda: list(THRESHOLDS))
    doy_min: int = 60
    doy_max: int = 320
    mc_iterations: int = 1000
    use_rust: bool = False
    PATHS = ("input_root", "output_root")

    @staticmethod
    def _list(x: str | list[str]) -> list[str]:
        return [x] if isinstance(x, str) else list(x)

    def combinations(self) -> Iterator[Modelling]:
        """One copy for each pair of index and window."""
        for index, window in itertools.product(self._list(self.series_index), self._list(self.series_window)):
            yield replace(self, series_index=index, series_window=window)

    def candidates(self) -> list[int]:
        """Window widths to try, capped by what the product allows."""
        from ..operators.smooth import window_limit

        most = min(self.cv_window_max, window_limit(int(str(self.series_window).rstrip("D"))))
        return list(range(self.cv_window_min, most + 1, 2))

    def problems(self):
        yield not self.input_root.exists(), "input_root does not exist"
        for name, known in (("series_index", INDICES), ("series_window", WINDOWS)):
            chosen = self._list(getattr(self, name))
            yield not chosen or bool(set(chosen) - set(known)), f"{name} must be among {known}"
        yield self.series_strategy not in STRATEGIES, f"series_strategy must be among {STRATEGIES}"
        yield self.num_workers < 1, "num_workers must be at least 1"
        low, high = self.cv_window_min, self.cv_window_max
        yield min(low, high) < 3 or low > high or low % 2 == 0 or high % 2 == 0, "cv_window_min and cv_window_max must be odd, at least 3 and in order"
        yield self.cv_kfolds < 2, "cv_kfolds must be at least 2"
        yield not self.amplitude_thresholds or not all(0 < t < 1 for t in self.amplitude_thresholds), "amplitude_thresholds must lie between 0 and 1"
        yield not 1 <= self.doy_min < self.doy_max <= 366, "doy_min and doy_max must be days of the year in order"
        yield self.mc_iterations < 1, "mc_iterations must be at least 1"


@dataclass
class Aggregation(Settings):
    """Stage 4: records, filtered."""

    input_root: Path
    output_path: Path
    min_thresholds: dict = field(default_factory=dict)
    max_thresholds: dict = field(default_factory=dict)
    nan_ok_keys: list = field(default_factory=list)
    exclude_csv_path: Path | None = None
    allow_partial: bool = True
    exclude_locations: list = field(default_factory=list)
    required_keys: list = field(default_factory=list)
    PATHS = ("input_root", "output_path", "exclude_csv_path")

    def problems(self):
        yield not self.input_root.exists(), "input_root does not exist"
        for name in ("min_thresholds", "max_thresholds"):
            yield not isinstance(getattr(self, name), dict), f"{name} must map keys to bounds"

    def rules(self) -> Rules:
        return Rules(self.min_thresholds, self.max_thresholds, self.nan_ok_keys, self.required_keys, self.allow_partial)


LOADERS: dict[str, Callable] = {"extract": Extraction.load, "process": Processing.load, "transitions": Modelling.load, "aggregate": Aggregation.load}
