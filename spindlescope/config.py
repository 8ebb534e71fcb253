"""Fixed names, feature presets and the run configuration."""

from __future__ import annotations

import dataclasses
import hashlib
import json

KEYS = ("serial_number", "date")
LABELS = ("failure", "predict_val", "validate_val")
CORE = ("serial_number", "date", "model", "capacity_bytes", "failure")

# Column sets and attribute ids that must equal the published data layout.
NONSTANDARD_SMART = (22, 220, 222, 224, 226)
CRITICAL_STATS = (1, 5, 7, 10, 184, 187, 188, 189, 190, 193, 194, 196, 197, 198, 201, 240, 241, 242)
TOTAL_FEATURES_NORMALIZED = (1, 5, 7, 184, 187, 189, 193, 197, 198)
TOTAL_FEATURES_RAW = (5, 9, 12, 183, 184, 187, 193, 197, 198, 199)
ISTEP_RAW = (1, 3, 4, 5, 9, 10, 12, 192, 193, 194, 197, 198, 199)
PRESET_KEYS = ("date", "serial_number", "model", "failure")
QUARTER_MONTHS = {"Q1": (1, 3), "Q2": (4, 6), "Q3": (7, 9), "Q4": (10, 12)}

PRESETS = {
    "total_features": PRESET_KEYS
    + tuple(f"smart_{n}_normalized" for n in TOTAL_FEATURES_NORMALIZED)
    + tuple(f"smart_{n}_raw" for n in TOTAL_FEATURES_RAW),
    "iSTEP": PRESET_KEYS + tuple(f"smart_{n}_raw" for n in ISTEP_RAW),
}
CRITICAL_COLUMNS = tuple(f"smart_{n}_raw" for n in CRITICAL_STATS)


def smart_columns(df, containing: str = "smart") -> list[str]:
    """Names of the SMART columns of ``df``, optionally only raw or normalized ones."""
    return [c for c in df.columns if c.startswith("smart") and containing in c]


@dataclasses.dataclass(frozen=True)
class RunConfig:
    """Settings of one training run; saved next to the fitted model and reused by scoring.

    ``interpolate_first`` fills missing days before labels are set, so the horizon counts calendar days instead of observed
    rows. ``wavelets`` adds the magnitudes of ``wavelet_scales`` - 1 scales of every column to the days before they are windowed.
    """

    models: str = ""
    manufacturer: str = "custom"
    years: tuple[str, ...] = ()
    preset: str | None = None
    min_days: int = 115
    gap_window: int = 30
    gap_tolerance: float = 2.0
    max_missing: int | None = None
    horizon: int = 7
    window: int = 32
    overlap: str = "full"
    windowing: bool = True
    interpolate: str | None = "linear"
    interpolate_first: bool = False
    fillna_method: str | None = None
    test_type: str = "t-test"
    num_features: int = 18
    ranking: bool = True
    smoothing: float | None = None
    split: str = "random"
    test_share: float = 0.3
    over_ratio: float | str | None = None
    under_ratio: float | str | None = None
    extract: str | None = None
    pca_components: int = 3
    learner: str = "random_forest"
    search: str | None = None
    n_iter: int = 100
    weighted_features: bool = False
    genetic: bool = False
    population: int = 10
    generations: int = 2
    augmentation: str = "duplicate"
    wavelets: bool = False
    wavelet_scales: int = 50
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "RunConfig":
        raw = json.loads(text)
        raw["years"] = tuple(raw["years"])
        return cls(**raw)

    def digest(self, *parts: str) -> str:
        """Short stable key for stages built under this configuration."""
        return hashlib.md5("|".join([self.to_json(), *parts]).encode()).hexdigest()[:12]
