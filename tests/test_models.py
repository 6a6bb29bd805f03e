"""Training against an own solver, calibration, and a run from files to reports."""

import math
import inspect
import json
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook import experiments, registry
from rollbook.config import Config, Data, Experiment, Modeling, Project
from rollbook.ml import models as M
from rollbook.ml.encode import fit_encoder
from rollbook.plans.tasks import Task

from . import school


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(400):
        x, z = float(rng.normal()), float(rng.normal())
        y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * x - 0.5))))
        data.append((f"i{i}", x if i % 9 else None, z, None, "abc"[i % 3] if i % 7 else None, "F-3" if i % 2 else "4-6", y))
    return spark.createDataFrame(data, "id string, x double, z double, none double, cat string, stage string, y int").persist()


def newton(features, y, weight, c):
    """Minimum of weighted log loss plus |b|^2 / (2C), the intercept free."""
    a = np.c_[features, np.ones(len(y))]
    b = np.zeros(a.shape[1])
    ridge = np.diag([1 / c] * features.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        g = a.T @ (weight * (p - y)) + ridge @ b
        b -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, g)
    return b


def task(rows):
    return Task("chronic_10", rows, "y", ["x", "z", "none"], ["cat"], ["id"])


def test_logistic_is_the_penalised_minimum(rows):
    e = fit_encoder(rows, ["x", "z", "none"], ["cat"])
    beta, intercept = M.fit_logistic(rows, "y", e, c=0.5)
    got = rows.orderBy("id").select(F.array(*(x for _, x in e.terms())).alias("f"), "y").collect()
    f, y = np.array([r["f"] for r in got]), np.array([r["y"] for r in got], float)
    n = len(y)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    assert np.allclose(newton(f, y, w, 0.5), [*beta, intercept], atol=1e-3)


def test_model_round_trip_sql_and_importance(spark, rows, tmp_path):
    m = M.calibrate(M.fit_candidate(rows, task(rows), "logistic", 1), rows, "y")
    m.save(spark, str(tmp_path / "m"))
    back = M.Model.load(spark, str(tmp_path / "m"))
    both = back.with_probability(rows, "p").withColumn("q", F.expr(m.to_sql()))
    assert both.where("abs(p - q) > 1e-9").count() == 0
    found = {r[0]: r[1] for r in M.permutation_importance(m, rows, "y", ["id"], fraction=0.2, repeats=3).collect()}
    assert set(found) == {"x", "z", "none", "cat"} and found["x"] > 0.1 and found["none"] == 0


def test_boosted_trees(spark, rows, tmp_path):
    m = M.fit_candidate(rows, task(rows), "ebm", 1, {"rounds": 5})
    m.save(spark, str(tmp_path / "m"))
    back = M.Model.load(spark, str(tmp_path / "m"))
    assert back.with_probability(rows, "p").where("p BETWEEN 0 AND 1").count() == 400
    with pytest.raises(ValueError, match="Unknown candidate"):
        M.fit_candidate(rows, task(rows), "forest", 1)


def test_additive_scores_are_no_worse_than_stumps(spark):
    """Held-out loss and precision against boosted trees of depth one on the same columns."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from rollbook.operators import metrics

    rng = np.random.default_rng(3)
    data = []
    for i in range(3000):
        x, z = float(rng.normal()), float(rng.normal())
        data.append((f"i{i}", i, x if i % 9 else None, z, "abc"[i % 3] if i % 7 else None, int(rng.random() < 1 / (1 + np.exp(-(1.5 * np.sin(2 * x) + abs(z) + (i % 3 == 1) - 1.5))))))
    df = spark.createDataFrame(data, "id string, i int, x double, z double, cat string, y int").persist()
    train, seen = df.where("i < 2000"), df.where("i >= 2000")
    m = M.fit_candidate(train, Task("chronic_10", train, "y", ["x", "z"], ["cat"], ["id"]), "ebm", 1)
    assert [s.column for s in m.shapes] == ["x", "z", "cat"] and all(len(s.values) == len(s.cuts) + 1 for s in m.shapes[:2])
    coded = lambda d: d.withColumn("features", array_to_vector(F.array(*m.encoder.codes()))).withColumn("label", F.col("y").cast("double"))
    stumps = GBTClassifier(maxDepth=1, maxIter=40, stepSize=0.2).fit(coded(train)).transform(coded(seen)).withColumn("raw_score", vector_to_array("probability")[1])
    loss = lambda d: d.agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("raw_score")).otherwise(1 - F.col("raw_score"))))).first()[0]
    ours = m.with_raw(seen)
    assert loss(ours) < loss(stumps) + 0.005
    precision = [metrics.precision_at(d, "y", "raw_score", 0.1, ["id"]).first()[0] for d in (ours, stumps)]
    assert precision[0] >= precision[1] - 0.02
    assert ours.withColumn("q", F.expr(M.Model("t", "ebm", m.encoder, intercept=m.intercept, shapes=m.shapes, overall=(2.0, -1.0)).to_sql())).where("abs(q - 1 / (1 + exp(-(2 * raw_score - 1)))) > 1e-9").count() == 0


def test_medians_of_many_columns(spark, monkeypatch):
    from rollbook.ml import encode

    monkeypatch.setattr(encode, "GATHERED", 20)
    rng = np.random.default_rng(4)
    n = 3001
    cols = {"a": rng.normal(size=n), "ties": np.where(rng.random(n) < 0.8, 0.0, rng.normal(size=n)), "wide": np.exp(rng.normal(size=n) * 100), "two": np.where(np.arange(n) % 2, 1.0, 5.0), "even": np.where(np.arange(n) < 3000, rng.normal(size=n), np.nan), "none": np.full(n, np.nan), "ints": rng.integers(0, 4, n).astype(float)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(n)], ", ".join(f"{c} double" for c in cols))
    want = [None if np.isnan(v).all() else float(np.nanmedian(v)) for v in cols.values()]
    assert encode.medians(df, list(cols)) == want
    assert encode.medians(df.limit(0), ["a"]) == [None] and encode.medians(df, []) == []


def test_calibrators_of_all_stages_at_once(rows):
    """Against one Newton solution for each stage."""
    df = rows.withColumn("raw", F.round(1 / (1 + F.exp(-F.coalesce("x", F.lit(0.0)))), 3))
    stages, overall = M.fit_calibrators(df, "raw", "y", "stage")
    got = df.select("raw", "y", "stage").collect()
    for found, part in ((overall, got), *((stages[s], [r for r in got if r["stage"] == s]) for s in ("4-6", "F-3"))):
        x, y = np.array([[r["raw"]] for r in part]), np.array([r["y"] for r in part], float)
        assert np.allclose(found, newton(x, y, np.ones(len(y)), 1.0), atol=1e-9)
    one = M.fit_calibrators(df.where("stage = 'F-3' OR y = 1"), "raw", "y", "stage")[0]
    assert one["4-6"] == (None, 1.0) and one["F-3"][0] is not None


def test_certificate_tells_a_minimum(rows):
    m = M.fit_candidate(rows, task(rows), "logistic", 1)
    assert M.certificate(m, rows, "y").where("abs(gradient) > 1e-6").count() == 0
    m.coefficients[0] += 0.1
    assert M.certificate(m, rows, "y").where("abs(gradient) > 1e-3").count() > 0


def test_calibrators(rows):
    assert M.fit_calibrator(rows.where("y = 1"), "z", "y") == (None, 1.0)
    assert M.fit_calibrator(rows.where("false"), "z", "y") == (None, 0.0)


def test_search_and_scoring_from_files(spark, tmp_path):
    paths = {}
    for t, df in zip(("attendance_events", "student_schedule", "school_calendar"), school.frames(spark), strict=True):
        paths[t] = str(tmp_path / f"{t}.parquet")
        df.write.parquet(paths[t])
    e = Experiment("final", ["2022/23", "2023/24"], ["2024/25"], [], [])
    c = Config(Data(**paths), [e], Project(str(tmp_path / "out"), 7), Modeling(top_k_fractions=[0.1, 0.2], minimum_rows_for_ebm=5000, max_train_rows_per_task=10000))
    p = experiments.load_prepared(spark, c)
    from rollbook.plans import tasks
    from rollbook.sources.files import write_feature_table

    t = tasks.chronic(p, 0.10)
    write_feature_table(t.frame, str(tmp_path / "features"), t.name)
    folder = tmp_path / "cand"
    folder.mkdir()
    (folder / "config.yaml").write_text("task: chronic_10\nfeature_groups: [daily_raw, gap_to_threshold]\nsample_fraction: 0.9\nmax_rows: 50\n")
    got = experiments.run_candidate(spark, str(folder), str(tmp_path / "features"), c, str(tmp_path / "log.tsv"), repeats=1)
    assert got["n_features"] == 4 + 8 + 2 + 2 and got["val_rows"] == 50 and got["train_rows"] == 50
    assert json.loads((folder / "importance.json").read_text())["by_feature"]
    model, records = M.train(t, e, c)
    assert [r["candidate"] for r in records] == ["logistic"]
    scored, found, groups = experiments.evaluate(t, model, t.frame.where("academic_year = '2024/25'"), "validation", c)
    assert scored.count() == 50 and found["row_count"] == 50 and {g["stage"] for g in groups} == {"7-9"}


def test_importance_of_trees(spark, rows):
    task = Task("chronic_10", rows, "y", ["x", "z"], ["cat"], ["id"])
    m = M.fit_candidate(rows, task, "ebm", 1, {"rounds": 10})
    found = {r[0]: r[1] for r in M.permutation_importance(m, rows, "y", ["id"], fraction=0.2, repeats=3).collect()}
    assert set(found) == {"x", "z", "cat"} and max(found, key=found.get) == "x" and found["x"] > 0.05


def test_registered_importance_shuffles_as_often_as_the_default(monkeypatch):
    seen = []
    task = SimpleNamespace(frame=MagicMock(), target="y", ids=["id"])
    monkeypatch.setattr(registry, "prepared", lambda *_: None)
    monkeypatch.setattr(registry, "tasks", SimpleNamespace(chronic=lambda *_: task))
    monkeypatch.setattr(registry, "permutation_importance", lambda *a, **k: seen.append(inspect.signature(M.permutation_importance).bind(*a, **k)))
    registry._importance(None, None)
    seen[0].apply_defaults()
    assert seen[0].arguments["repeats"] == 5


def test_newton_steps_finish_a_fit_that_stopped_early(spark):
    """From a start far from flat, with two columns that are nearly equal, every gradient ends near zero."""
    from pyspark.ml.functions import array_to_vector

    from rollbook.ml.models import _polished

    rows = spark.range(0, 400, 1, 3).selectExpr("double(pmod(hash(id), 17)) / 17 AS a", "id").selectExpr("a", "a + if(id % 50 = 0, 0.01, 0) AS b", "double(pmod(hash(id, 3), 5) + 5 * a > 4) AS label", "1.0D AS w")
    rows = rows.select(array_to_vector(F.array("a", "b")).alias("features"), "label", "w")
    beta, intercept = _polished(rows, [0.1, 0.1, 0.0], 400, 1.0)
    x = [(r.features.toArray(), r.label) for r in rows.collect()]
    residual = [1 / (1 + math.exp(-(v @ beta + intercept))) - y for v, y in x]
    gradients = [sum(e * v[j] for e, (v, _) in zip(residual, x, strict=True)) / 400 + beta[j] / 400 for j in (0, 1)] + [sum(residual) / 400]
    assert max(map(abs, gradients)) < 1e-9


def test_bin_sums_are_added_up_in_tasks(spark):
    from rollbook.ml.additive import _bin_sums

    rows = spark.range(0, 100, 1, 4).selectExpr("double(id % 2) AS y", "int(id % 3) AS b0", "int(id % 5) AS b1")
    got = {(r.j, r.k): (r.g, r.h, r.n) for r in _bin_sums(rows, [[0.5, -0.25, 0.0, 0.0], [0.0] * 6], 0.125, range(1, 2))}
    assert set(got) == {(1, k) for k in range(5)}  # bins without rows have no sums
    p = [1 / (1 + math.exp(-(0.125 + (0.5, -0.25, 0.0)[i % 3]))) for i in range(100)]
    for k in range(5):
        own = [i for i in range(100) if i % 5 == k]
        assert got[1, k] == pytest.approx((sum(i % 2 - p[i] for i in own), sum(p[i] * (1 - p[i]) for i in own), len(own)))


@pytest.mark.parametrize("margin", [0.002, -0.02])  # with the second, the cuts are too high and all rows are ranked
def test_importance_over_all_rows(spark, monkeypatch, margin):
    """Against shuffles of the whole table in numpy; the registered groups take more rows than the report's 5,000."""
    from hashlib import md5

    from rollbook.ml.encode import Encoder

    monkeypatch.setattr(M, "MARGIN", margin)
    n = 6000
    rng = np.random.default_rng(5)
    x, w = np.round(rng.normal(size=n), 2), np.round(rng.normal(size=n), 1)
    y = (x + 0.5 * w + rng.normal(size=n) > 1).astype(float)
    df = spark.createDataFrame([(f"k{i}", float(x[i]), float(w[i]), int(y[i])) for i in range(n)], "id string, x double, w double, y int")
    order = sorted(range(n), key=lambda i: md5(f"k{i}|42".encode()).hexdigest())
    x, w, y = x[order], w[order], y[order]
    at = np.arange(1, n + 1)
    best = lambda z: y[np.lexsort((at, -np.round(z, 9)))[:300]].mean()
    want = {"x": 0.0, "w": 0.0}
    for r in (1, 2):
        digest = sorted(range(n), key=lambda i: md5(f"{i + 1}|{r}|42".encode()).hexdigest())
        j = np.empty(n, int)
        j[digest] = np.arange(n)
        want["x"] += (best(x + 0.5 * w) - best(x[j] + 0.5 * w)) / 2
        want["w"] += (best(x + 0.5 * w) - best(x + 0.5 * w[j])) / 2
    model = M.Model("t", "logistic", Encoder([("x", 0.0, 0.0, 1.0), ("w", 0.0, 0.0, 1.0)], []), [1.0, 0.5])
    got = {r[0]: r[1] for r in M.permutation_importance(model, df, "y", ["id"], repeats=2, most=None).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_registered_groups_take_all_rows():
    assert "5000" not in registry.oracle_sql()["group_importance"]
    assert "5000" in registry.oracle_sql()["permutation_importance"]


def test_fit_reads_the_rows_a_few_times(spark, monkeypatch):
    """Newton steps need a pass each, and end flat also where labels are rare and nearly told apart by one column."""
    passes = []
    keep = type(spark.range(1)).mapInPandas
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda *a, **k: passes.append(1) or keep(*a, **k))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 2))
    y = (x[:, 0] > 2).astype(int)
    y[:3] = 1 - y[:3]
    df = spark.createDataFrame([(float(a), None if i % 11 == 0 else float(b), "ab"[i % 2], int(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "x double, z double, cat string, y int")
    t = Task("t", df, "y", ["x", "z"], ["cat"], ["x"])
    m = M.fit_candidate(df, t, "logistic", 1)
    assert 3 < len(passes) <= 25
    assert M.certificate(m, df, "y").where("abs(gradient) > 1e-8").count() == 0


@pytest.mark.parametrize("bins", [5, 300])
def test_bins_are_stored_in_blocks_of_small_numbers(spark, monkeypatch, bins):
    """A byte a bin (two where there are over 255), many rows in one; sums are those of the rows."""
    from rollbook.ml import additive

    stored = []
    keep = additive.written
    monkeypatch.setattr(additive, "written", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    rows = spark.range(0, 1000, 1, 3).selectExpr("int(id % 2 = 0 OR id % 7 = 0) AS y", f"concat('k', id % {bins}) AS cat", "double(id % 10) AS x")
    shapes, intercept = additive.fit_additive(rows, "y", ["x"], {"cat": sorted(f"k{i}" for i in range(bins))}, cycles=1)
    assert stored[0].columns == ["block"] and stored[0].count() <= 1000 / additive.PACK + 3
    assert sum(len(r.block) for r in stored[0].collect()) == 1000 * 3 * (1 if bins < 255 else 2)
    y = np.array([float(i % 2 == 0 or i % 7 == 0) for i in range(1000)])
    p = y.mean()
    got = dict(zip(shapes[1].levels, shapes[1].values, strict=True))
    step = np.array([additive.RATE * (y[k::bins] - p).sum() / (len(y[k::bins]) * p * (1 - p) + additive.SMOOTH) for k in range(bins)])
    mean = sum(step[k] * len(y[k::bins]) for k in range(bins)) / 1000
    assert [got[f"k{k}"] for k in range(bins)] == pytest.approx(list(step - mean))
