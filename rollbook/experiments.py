"""Runs: backtests with production refit, class scoring, and the search loop over feature tables."""

from __future__ import annotations

import json
import time
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .config import Config, Experiment
from .functions import features as C
from .ml import models as M
from .operators import metrics
from .names import LESSON_PROB, LESSON_SUM, SHORT_PROB
from .operators.sampling import cap_rows, sample_fraction
from .plans.prepare import Prepared, prepare
from .plans.scoring import IDS, Scoring
from .plans.tasks import Task, all_tasks, filter_years
from .sources.files import exists, feature_summary, load_inputs, read_text, schema_sidecar, write_feature_table, write_frame, write_text


def load_prepared(spark: SparkSession, config: Config) -> Prepared:
    tables = load_inputs(spark, vars(config.data))
    return prepare(tables["attendance_events"], tables["student_schedule"], tables["school_calendar"], config.modeling, config.project.school_year_start_month).stored()


def evaluate(task: Task, model: M.Model, frame: DataFrame, split: str, config: Config) -> tuple[DataFrame, dict[str, Any], list[dict[str, Any]]]:
    """Scored frame, its metrics, and those of each stage."""
    score, fractions = f"{task.name}_prob", config.modeling.top_k_fractions
    scored = model.with_probability(frame, score).select(*task.ids, task.target, score)
    found = {**metrics.binary_metrics(scored, task.target, score, fractions, task.ids), "split": split, "candidate": model.candidate}
    groups = [r.asDict() for r in metrics.group_metrics(scored, task.group, task.target, score, fractions, task.ids).orderBy(task.group).collect()]
    if task.name == "lesson":
        totals = metrics.lesson_totals(scored, score, task.target)
        found |= metrics.lesson_metrics(totals, fractions).first().asDict() if not totals.isEmpty() else {"lesson_count": 0}
    return scored, found, groups


def run(spark: SparkSession, config: Config) -> list[dict[str, Any]]:
    """Train, evaluate and refit every task in every experiment; writes models, predictions and reports."""
    tasks, out, records = all_tasks(load_prepared(spark, config), config.modeling, config.project.school_year_start_month), config.project.output_dir, []
    for e in config.experiments:
        for name, task in tasks.items():
            seen = filter_years(task.frame, e.validation_years)
            if filter_years(task.frame, e.train_years).isEmpty() or seen.isEmpty():
                continue
            model, candidates = M.train(task, e, config)
            about = {"experiment": e.name, "task": name}
            for split, frame in (("validation", seen), ("test", filter_years(task.frame, e.test_years) if e.test_years else None)):
                if frame is None or frame.isEmpty():
                    continue
                scored, found, groups = evaluate(task, model, frame, split, config)
                records += [{**about, **found}, *({**about, "split": f"{split}_subgroup", **g} for g in groups)]
                write_frame(scored, f"{out}/predictions/{e.name}/{name}_{split}.parquet")
            model.save(spark, f"{out}/predictions/{e.name}/{name}_{model.candidate}")
            records += [{**about, "split": "candidate_validation", **c} for c in candidates]
            if e.production_refit_years and not filter_years(task.frame, e.production_refit_years).isEmpty():
                M.refit(task, model.candidate, e.production_refit_years, e.validation_years, config).save(spark, f"{out}/models/production/{name}")
    reports.write_json(records, f"{out}/reports/metrics.json")
    reports.write_markdown(records, f"{out}/reports/metrics.md")
    return records


def score_class(spark: SparkSession, config: Config, as_of: str, school_id: str, class_id: str) -> dict[str, str]:
    """Five prediction files for a class as of a date, from the production models."""
    p = load_prepared(spark, config)
    s = Scoring(p.lesson_frame, p.calendar, as_of, school_id, class_id, config.modeling, config.project.school_year_start_month).check()
    out = config.project.output_dir
    load = lambda task: M.Model.load(spark, f"{out}/models/production/{task}")
    ids = ["date", *IDS]
    short = load("short_horizon").with_probability(s.short_horizon(), SHORT_PROB).select(*ids, SHORT_PROB)

    def risks(frame: DataFrame, prefix: str, end: str) -> DataFrame:
        for k in (10, 20):
            frame = load(f"{prefix}_{k}").with_probability(frame, f"risk_{k}pct_{end}_end")
        return frame.select(*ids, f"risk_10pct_{end}_end", f"risk_20pct_{end}_end").orderBy(F.desc(f"risk_20pct_{end}_end"), "student_id")

    lesson = load("lesson").with_probability(s.lesson(), LESSON_PROB)
    lesson = lesson.select("score_date", "target_date", *IDS, "lesson_id", "target_subject", "target_lesson_start_minutes", LESSON_PROB)
    frames = {
        "short_horizon_predictions": short.orderBy(F.desc(SHORT_PROB), "student_id"),
        "chronic_predictions": risks(s.chronic(), "chronic", "term"),
        "chronic_lasyar_predictions": risks(s.chronic_year(), "chronic_year", "year"),
        "lesson_predictions": lesson.orderBy("target_date", "target_lesson_start_minutes", F.desc(LESSON_PROB), "student_id"),
        LESSON_SUM: metrics.expected_missed(lesson, LESSON_PROB, LESSON_SUM).orderBy("target_date", "target_lesson_start_minutes", "lesson_id"),
    }
    folder = f"{out}/scoring/{school_id}_{class_id}_{as_of}"
    for name, df in frames.items():
        write_frame(df, f"{folder}/{name}.parquet")
    return {name: f"{folder}/{name}.parquet" for name in frames}


def materialise(spark: SparkSession, config: Config, folder: str) -> dict[str, Any]:
    """Feature table, schema and summary of every task."""
    summary = {}
    for name, t in all_tasks(load_prepared(spark, config), config.modeling, config.project.school_year_start_month).items():
        t.frame = spark.read.parquet(write_feature_table(t.frame, folder, name))
        write_text(f"{folder}/{name}_schema.json", schema_sidecar(t.frame, t.target, t.numeric, t.categorical, t.ids))
        summary[name] = {**feature_summary(t.frame, t.target).first().asDict(), "n_numeric": len(t.numeric), "n_categorical": len(t.categorical)}
    write_text(f"{folder}/summary.json", json.dumps(summary, indent=2))
    return summary


def load_candidate(folder: str) -> dict[str, Any]:
    import yaml

    file = f"{folder}/config.yaml"
    if not exists(file):
        raise FileNotFoundError(f"{file} is not there")
    raw = yaml.safe_load(read_text(file)) or {}
    if "task" not in raw:
        raise ValueError("candidate config must specify 'task'")
    return raw


def run_candidate(spark: SparkSession, folder: str, features: str, config: Config, log: str, importance: bool = True, repeats: int = 5) -> dict[str, Any]:
    """One search step on a materialised feature table; writes metrics, importance, model and a log line."""
    began, raw = time.monotonic(), load_candidate(folder)
    name, groups = raw["task"], raw.get("feature_groups") or C.DEFAULT_GROUPS[raw["task"]]
    settings = dict(raw.get("model") or {})
    kind, seed = settings.pop("type", "logistic"), int(raw.get("seed", config.project.random_seed))
    numeric, categorical = C.resolve(groups, name)
    if not exists(f"{features}/{name}.parquet"):
        raise FileNotFoundError(f"Feature table not found: {features}/{name}.parquet; materialise the features first")
    frame = spark.read.parquet(f"{features}/{name}.parquet")
    missing = [c for c in numeric + categorical if c not in frame.columns]
    if missing:
        raise ValueError(f"Feature table for '{name}' is missing columns: {missing}")
    task = Task(name, frame, C.target_of(name), numeric, categorical, C.id_columns(name))
    e: Experiment = next((x for x in config.experiments if x.name == raw.get("experiment")), config.experiments[0])
    train, seen = filter_years(frame, e.train_years), filter_years(frame, e.validation_years)
    for df, years in ((train, e.train_years), (seen, e.validation_years)):
        if df.isEmpty():
            raise RuntimeError(f"Frame is empty for years {years}")
    rows = sample_fraction(train, float(raw.get("sample_fraction", 1.0)), task.ids, seed)
    rows = cap_rows(rows, task.target, int(raw.get("max_rows", config.modeling.max_train_rows_per_task)), task.ids, seed, strict=True)
    model = M.fit_candidate(rows, task, kind, seed, settings)
    scored = model.with_raw(seen)
    found = metrics.binary_metrics(scored, task.target, "raw_score", config.modeling.top_k_fractions, task.ids)
    subgroups = [r.asDict() for r in metrics.group_metrics(scored, task.group, task.target, "raw_score", config.modeling.top_k_fractions, task.ids).collect()]
    M.calibrate(model, seen, task.target, task.group).save(spark, f"{folder}/model")
    by_feature = {r[0]: r[1] for r in M.permutation_importance(model, seen, task.target, task.ids, repeats=repeats, seed=seed).collect()} if importance else {}
    by_group = C.group_importance(by_feature)
    row = {"candidate": PurePosixPath(folder).name, "task": name, "experiment": e.name, "model_type": kind, "hyperparams": settings, "feature_groups": groups, "n_features": len(numeric) + len(categorical), "train_rows": rows.count(), "val_rows": found["row_count"], "runtime_s": round(time.monotonic() - began, 1), **found, "subgroups": subgroups}
    write_text(f"{folder}/metrics.json", json.dumps(row, indent=2))
    write_text(f"{folder}/importance.json", json.dumps({"by_feature": by_feature, "by_group": by_group}, indent=2))
    reports.append_log(log, row, by_group)
    return row
