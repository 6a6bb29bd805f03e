"""Run configuration. Keys and defaults are fixed values: configurations of users hold them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from . import names


@dataclass
class Project:
    output_dir: str = "artifacts"
    random_seed: int = 42
    school_year_start_month: int = 8


@dataclass
class Data:
    attendance_events: str
    student_schedule: str
    school_calendar: str


@dataclass
class Modeling:
    substantial_threshold: float = 0.5  # names.MISS_THRESHOLD in a file
    short_horizon_school_days: int = 5
    lesson_horizon_school_days: int = 5
    top_k_fractions: list[float] = field(default_factory=lambda: [0.01, 0.02, 0.05])
    minimum_rows_for_ebm: int = 500
    train_negative_to_positive_ratio: float = 5.0
    max_train_rows_per_task: int = 250_000


@dataclass
class Experiment:
    name: str
    train_years: list[str]
    validation_years: list[str]
    test_years: list[str] = field(default_factory=list)
    production_refit_years: list[str] = field(default_factory=list)


@dataclass
class Config:
    data: Data
    experiments: list[Experiment]
    project: Project = field(default_factory=Project)
    modeling: Modeling = field(default_factory=Modeling)


#: Fields that are called otherwise in a file.
_FIELDS = {names.MISS_THRESHOLD: "substantial_threshold"}
_CASTS = {"int": int, "float": float, "str": str, "list[float]": lambda v: [float(x) for x in v], "list[str]": lambda v: [str(x) for x in v]}


def _build(kind: type, raw: dict[str, Any]) -> Any:
    values = {f.name: _CASTS[f.type](raw[f.name]) for f in fields(kind) if f.name in raw}
    try:
        return kind(**values)
    except TypeError as e:
        raise ValueError(f"{kind.__name__.lower()} of the configuration: {e}") from e


def load_config(path: str) -> Config:
    """YAML with ``data`` and ``experiments``; ``project`` and ``modeling`` have defaults."""
    import yaml

    if "://" in path:  # a store that Spark reaches
        from .sources.files import read_text

        text = read_text(path)
    else:
        text = Path(path).read_text()
    raw = yaml.safe_load(text) or {}
    for key in ("data", "experiments"):
        if key not in raw:
            raise ValueError(f"the configuration has no {key}")
    return Config(_build(Data, raw["data"]), [_build(Experiment, e) for e in raw["experiments"]], _build(Project, raw.get("project") or {}), _build(Modeling, {_FIELDS.get(k, k): v for k, v in (raw.get("modeling") or {}).items()}))
