"""Training, calibration, selection and scoring."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Experiment
from ..functions import features as C
from ..operators import metrics
from ..operators.ranges import descending, digest_rank, running_totals
from ..operators.sampling import cap_rows, draw, draw_order, sample_negatives
from ..plans.tasks import Task, filter_years
from ..sources.shared import cleared, written
from .additive import CYCLES, Shape, fit_additive
from .encode import Encoder, fit_encoder

#: ``(slope, intercept)`` on the raw probability, or ``(None, constant)``.
Calibrator = tuple[float | None, float]


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


@dataclass
class Model:
    task: str
    candidate: str
    encoder: Encoder
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0
    shapes: list[Shape] = field(default_factory=list)
    stages: dict[str, Calibrator] = field(default_factory=dict)
    overall: Calibrator = (None, 0.0)
    metadata: dict[str, Any] = field(default_factory=dict)

    def parts(self) -> dict[str, Column]:
        """What each input column adds to the score."""
        if self.shapes:
            return {x.column: x.value() for x in self.shapes}
        out: dict[str, Column] = {}
        for b, (c, x) in zip(self.coefficients, self.encoder.terms(), strict=True):
            out[c] = out[c] + b * x if c in out else b * x
        return out

    def logit(self) -> Column:
        """Score of a logistic or additive model as an expression."""
        if self.shapes:
            return reduce(lambda z, x: z + x, self.parts().values(), F.lit(self.intercept))
        return reduce(lambda z, t: z + t[0] * t[1][1], zip(self.coefficients, self.encoder.terms(), strict=True), F.lit(self.intercept))

    def with_raw(self, df: DataFrame, out: str = "raw_score") -> DataFrame:
        return df.withColumn(out, sigmoid(self.logit()))

    def calibrated(self, raw: Column, stage: Column) -> Column:
        """Calibrator of the stage, or the overall one for stages never seen."""
        use = lambda c: F.lit(c[1]) if c[0] is None else sigmoid(c[0] * raw + c[1])
        return reduce(lambda rest, kv: F.when(stage == kv[0], use(kv[1])).otherwise(rest), self.stages.items(), use(self.overall))

    def with_probability(self, df: DataFrame, out: str, raw: str = "__raw_score") -> DataFrame:
        return self.with_raw(df, raw).withColumn(out, self.calibrated(F.col(raw), F.col("stage"))).drop(raw)

    def to_sql(self) -> str:
        """The calibrated probability as a SQL expression over the feature columns."""
        q = lambda v: "'" + v.replace("'", "''") + "'"
        terms = [f"(coalesce({c}, {m!r}) - {mean!r}) / {sd!r}" for c, m, mean, sd in self.encoder.numeric]
        for c, fill, values in self.encoder.categorical:
            terms += [f"CASE WHEN coalesce({c}, {q(fill)}) = {q(v)} THEN 1.0 ELSE 0.0 END" for v in values]
        parts = [f"({x.to_sql()})" for x in self.shapes] if self.shapes else [f"{b!r} * ({t})" for b, t in zip(self.coefficients, terms, strict=True)]
        raw = f"(1 / (1 + exp(-({' + '.join([repr(self.intercept), *parts])}))))"
        use = lambda c: repr(c[1]) if c[0] is None else f"1 / (1 + exp(-({c[0]!r} * {raw} + {c[1]!r})))"
        return "CASE " + "".join(f"WHEN stage = {q(s)} THEN {use(c)} " for s, c in self.stages.items()) + f"ELSE {use(self.overall)} END" if self.stages else use(self.overall)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        d = json.loads(spark.read.text(f"{path}/model").first()[0])
        e = d.pop("encoder")
        encoder = Encoder([tuple(x) for x in e["numeric"]], [tuple(x) for x in e["categorical"]])
        shapes = [Shape(**x) for x in d.pop("shapes")]
        return Model(**{**d, "stages": {k: tuple(v) for k, v in d["stages"].items()}, "overall": tuple(d["overall"])}, encoder=encoder, shapes=shapes)


def fit_logistic(df: DataFrame, target: str, encoder: Encoder, c: float = 1.0, balanced: bool = True) -> tuple[list[float], float]:
    """L2-penalised logistic regression by Newton steps; the penalty is 1 / (C * total weight), not on the intercept."""
    y = F.col(target).cast("double")
    n, pos = df.agg(F.count("*"), F.sum(y)).first()
    if not pos or pos == n:
        raise ValueError("training rows hold one class only")
    weight = F.when(y == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
    names = list(dict.fromkeys(encoder.inputs))
    plain = [F.col(f"`{x}`").cast("double" if x in {v[0] for v in encoder.numeric} else "string").alias(x) for x in names]
    rows = df.select(*plain, y.alias("__label"), weight.alias("__w"))
    numeric, categorical = encoder.numeric, encoder.categorical
    width = len(encoder.terms()) + 1

    def read(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encoded columns as :meth:`Encoder.terms` has them, labels and weights."""
        x = np.empty((len(batch), width - 1))
        for j, (name, median, mean, deviation) in enumerate(numeric):
            v = batch[name].to_numpy(dtype="float64", na_value=np.nan)
            x[:, j] = (np.where(np.isnan(v), median, v) - mean) / deviation
        j = len(numeric)
        for name, fill, values in categorical:
            v = batch[name].fillna(fill).to_numpy()
            for level in values:
                x[:, j] = v == level
                j += 1
        return x, batch["__label"].to_numpy(), batch["__w"].to_numpy()

    return _newton_fit(rows, [0.0] * width, n, c, read)


#: Most steps of a fit, the greatest gradient of a row's mean loss at which it ends, that from which losses are too close to compare,
#: halvings of a step that raises the loss, and rows that are multiplied at once.
POLISH, FLAT, NEAR, HALVINGS, SLICE = 50, 1e-9, 1e-6, 30, 10_000


def _polished(rows: DataFrame, beta: list[float], n: int, c: float) -> tuple[list[float], float]:
    """Newton steps over ``features`` that are vectors already."""

    def read(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(batch["features"].tolist()).reshape(len(batch), -1), batch["label"].to_numpy(), batch["w"].to_numpy()

    return _newton_fit(rows.withColumn("features", vector_to_array("features")), beta, n, c, read)


def _newton_fit(rows: DataFrame, beta: list[float], n: int, c: float, read: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[float], float]:
    """Newton steps until every gradient is flat; a pass over the rows for each. Tasks add up their rows' share of the normal
    equations and of the loss, which a step must not raise: it is halved if it does."""
    width = len(beta)
    penalty = np.append(np.full(width - 1, 1 / (c * n)), 0.0)  # none on the intercept

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss, its gradient and its curvature."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, width + 2))
            for batch in batches:
                for i in range(0, len(batch), SLICE):
                    x, y, w = read(batch.iloc[i : i + SLICE])
                    x = np.column_stack([x, np.ones(len(x))])
                    z = x @ at
                    p = 0.5 * (1 + np.tanh(z / 2))
                    total[:, :width] += (x * (w * p * (1 - p))[:, None]).T @ x
                    total[:, width] += x.T @ (w * (p - y))
                    total[0, width + 1] += (w * (np.logaddexp(0, z) - y * z)).sum()
            yield pd.DataFrame({"i": np.arange(width), "v": [*total]})

        shares = rows.mapInPandas(add, "i int, v array<double>")
        found = shares.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # the square of the coefficients
        total = np.zeros((width, width + 2))
        for r in found:
            total[r["i"], r["j"]] = r["v"]
        loss = total[0, width + 1] / n + (penalty * at * at).sum() / 2
        return loss, total[:, width] / n + penalty * at, total[:, :width] / n + np.diag(penalty)

    at = np.array(beta)
    loss, gradient, curvature = sums(at)
    best, step, halved = (float(np.abs(gradient).max()), at), None, 0
    for _ in range(POLISH):
        if best[0] < FLAT or halved > HALVINGS:
            break
        if step is None:
            step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        after = sums(at - step)
        steepest = float(np.abs(after[1]).max())
        if after[0] <= loss or steepest < best[0] < NEAR:
            at, step, halved = at - step, None, 0
            loss, gradient, curvature = after
            best = min(best, (steepest, at), key=lambda x: x[0])
        elif best[0] < NEAR:  # no better: the last one stays
            break
        else:
            step, halved = step / 2, halved + 1
    return best[1][:-1].tolist(), float(best[1][-1])


def fit_candidate(df: DataFrame, task: Task, candidate: str, seed: int, hyper: dict[str, Any] | None = None) -> Model:
    """``logistic``, or ``ebm``: an additive booster with a lookup table for each feature (``rounds``: its cycles). Both are free of chance; ``seed`` is kept for other candidates."""
    hyper = hyper or {}
    encoder = fit_encoder(df, task.numeric, task.categorical)
    if candidate == "logistic":
        beta, intercept = fit_logistic(df, task.target, encoder, float(hyper.get("C", 1.0)), str(hyper.get("class_weight", "balanced")) == "balanced")
        return Model(task.name, candidate, encoder, beta, intercept)
    if candidate == "ebm":
        shapes, intercept = fit_additive(df, task.target, task.numeric, {c: v for c, _, v in encoder.categorical}, int(hyper.get("rounds", CYCLES)))
        return Model(task.name, candidate, encoder, intercept=intercept, shapes=shapes)
    raise ValueError(f"Unknown candidate model: {candidate}")


#: Newton steps of a calibrator, and the step at which they end.
STEPS, SMALL = 50, 1e-12


def fit_calibrators(df: DataFrame, raw: str, target: str, group: str) -> tuple[dict[str, Calibrator], Calibrator]:
    """A logistic curve on the raw probability for each group, and one for all rows.

    The slope is penalised by half its square. Every Newton step of all curves is one grouped aggregation of
    their 2 x 2 normal equations, over rows that were first counted by group, score and label. No rows:
    0; one class: that class.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(raw).cast("double").alias("x"), F.col(target).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = rows.groupBy("g", "x", "y").agg(F.count("*").alias("n")).persist()
    seen = {r["g"]: (r["low"], r["high"]) for r in rows.groupBy("g").agg(F.min("y").alias("low"), F.max("y").alias("high")).collect()}
    fixed = {g: (None, low) for g, (low, high) in seen.items() if low == high and g is not None}
    low, high = min((x[0] for x in seen.values()), default=0.0), max((x[1] for x in seen.values()), default=0.0)
    curves: dict[Any, list[float]] = {g: [0.0, 0.0] for g in seen if g is not None and g not in fixed}
    if low < high:
        curves[_ALL] = [0.0, 0.0]
    for _ in range(STEPS if curves else 0):
        moved = 0.0
        for g, (a, b) in _newton(rows, curves).items():
            moved = max(moved, abs(a - curves[g][0]), abs(b - curves[g][1]))
            curves[g] = [a, b]
        if moved < SMALL:
            break
    rows.unpersist()
    overall = tuple(curves.pop(_ALL)) if _ALL in curves else (None, float(low))
    return {g: tuple(curves[g]) if g in curves else fixed[g] for g in sorted(x for x in seen if x is not None)}, overall


_ALL = object()


def _newton(rows: DataFrame, curves: dict[Any, list[float]]) -> dict[Any, tuple[float, float]]:
    """The next slope and intercept of every curve."""
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    own = {g: c for g, c in curves.items() if g is not _ALL}
    value = lambda k: reduce(lambda rest, kv: F.when(F.col("g") == kv[0], F.lit(kv[1][k])).otherwise(rest), own.items(), F.lit(0.0))

    def sums(a: Column, b: Column, name: str) -> list[Column]:
        p = sigmoid(a * x + b)
        w, e = n * p * (1 - p), n * (p - y)
        return [F.sum(c).alias(f"{name}{k}") for k, c in (("ee", e), ("ex", e * x), ("w", w), ("wx", w * x), ("wxx", w * x * x))]

    both = sums(value(0), value(1), "g_") + (sums(F.lit(curves[_ALL][0]), F.lit(curves[_ALL][1]), "t_") if _ALL in curves else [])
    found = rows.groupBy("g").agg(*both).collect()  # a row for each group
    keys = ("ee", "ex", "w", "wx", "wxx")
    totals = {r["g"]: [r[f"g_{k}"] for k in keys] for r in found if r["g"] in own}
    if _ALL in curves:
        totals[_ALL] = [sum(r[f"t_{k}"] for r in found) for k in keys]
    out = {}
    for g, (ee, ex, w, wx, wxx) in totals.items():
        a, b = curves[g]
        ga, gb, haa = ex + a, ee, wxx + 1
        det = haa * w - wx * wx
        out[g] = (a - (w * ga - wx * gb) / det, b - (haa * gb - wx * ga) / det) if det > 0 else (a, b)
    return out


def fit_calibrator(df: DataFrame, raw: str, target: str) -> Calibrator:
    """One curve for all rows; see :func:`fit_calibrators`."""
    return fit_calibrators(df.withColumn("__group", F.lit("all")), raw, target, "__group")[1]


def calibrate(model: Model, df: DataFrame, target: str, group: str = "stage") -> Model:
    """Fit a calibrator for each stage and one for all, on frames the model did not see."""
    model.stages, model.overall = fit_calibrators(model.with_raw(df), "raw_score", target, group)
    return model


def certificate(model: Model, df: DataFrame, target: str, c: float = 1.0, balanced: bool = True) -> DataFrame:
    """``term, value, gradient`` of a logistic model: at the minimum of the penalised loss every gradient is zero.

    Terms are the encoded columns (a category as ``column=value``) and ``intercept``; gradients are means over
    the rows, the penalty's share included.
    """
    y = F.col(target).cast("double")
    n, pos = df.agg(F.count("*"), F.sum(y)).first()
    weight = F.when(y == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
    names = [x[0] for x in model.encoder.numeric] + [f"{x[0]}={v}" for x in model.encoder.categorical for v in x[2]]
    values = F.array(*(x for _, x in model.encoder.terms()), F.lit(1.0))
    rows = df.select((weight * (sigmoid(model.logit()) - y)).alias("e"), F.posexplode(values).alias("i", "x"))
    sums = rows.groupBy("i").agg((F.sum(F.col("e") * F.col("x")) / n).alias("mean"))
    beta = F.array(*map(F.lit, [*model.coefficients, model.intercept]))
    penalty = F.when(F.col("i") < len(names), F.get(beta, "i") / (c * n)).otherwise(0.0)
    return sums.select(F.get(F.array(*map(F.lit, [*names, "intercept"])), "i").alias("term"), F.get(beta, "i").alias("value"), (F.col("mean") + penalty).alias("gradient"))


def training_rows(df: DataFrame, task: Task, config: Config) -> DataFrame:
    m, seed = config.modeling, config.project.random_seed
    df = sample_negatives(df, task.target, m.train_negative_to_positive_ratio, task.ids, seed)
    return cap_rows(df, task.target, m.max_train_rows_per_task, task.ids, seed)


def train(task: Task, experiment: Experiment, config: Config) -> tuple[Model, list[dict[str, Any]]]:
    """Fit all candidates, keep the best precision at the first fraction (the earlier one on ties), calibrate."""
    rows = training_rows(filter_years(task.frame, experiment.train_years), task, config).persist()
    seen = filter_years(task.frame, experiment.validation_years).persist()
    names = ["logistic"] + (["ebm"] if rows.count() >= config.modeling.minimum_rows_for_ebm else [])
    fractions, best, records = config.modeling.top_k_fractions, None, []
    for name in names:
        model = fit_candidate(rows, task, name, config.project.random_seed)
        found = metrics.binary_metrics(model.with_raw(seen), task.target, "raw_score", fractions, task.ids)
        records.append({"candidate": name, **found})
        score = found[f"precision_at_{fractions[0]:.2f}"]
        if best is None or (score is not None and score > best[0]):
            best = (-1.0 if score is None else score, model)
    model = calibrate(best[1], seen, task.target, task.group)
    model.metadata = {"candidate_records": records}
    rows.unpersist()
    seen.unpersist()
    return model, records


def refit(task: Task, candidate: str, years: list[str], calibration_years: list[str], config: Config, hyper: dict[str, Any] | None = None) -> Model:
    """The chosen candidate on the production years, calibrated on the validation years."""
    model = fit_candidate(training_rows(filter_years(task.frame, years), task, config), task, candidate, config.project.random_seed, hyper)
    return calibrate(model, filter_years(task.frame, calibration_years), task.target, task.group)


#: Share of the rows by which the cut of a shuffle's best rows may be off before its rows are taken whole.
MARGIN = 0.002


def permutation_importance(model: Model, df: DataFrame, target: str, ids: list[str], fraction: float = 0.05, repeats: int = 5, seed: int = 42, most: int | None = 5000) -> DataFrame:
    """``feature, importance``: mean loss of precision at ``fraction`` when a column is shuffled.

    Over the first ``most`` rows in draw order, or over all: shuffling a column of an additive score swaps its part
    of it, so all columns are shuffled in one join a repeat, and only rows near the top or above it are kept to be
    ranked. Shuffles are ranks of MD5 digests, the same in every engine.
    """
    parts = model.parts()
    names = list(parts)
    df = written(df.select(*dict.fromkeys([*ids, target, *names])), "importance_rows")  # read for the draw and for the rows drawn
    if most is not None:
        df = draw(df, most, ids, seed)
    rows = df.select(*ids, F.col(target).cast("double").alias("y"), F.round(model.logit(), 9).alias("z"), F.array(*parts.values()).alias("c"))
    rows = written(digest_rank(rows, draw_order(ids, seed), ids, "i").select("i", "y", "z", "c"), "importance")
    n = rows.count()
    k = max(1, math.ceil(n * fraction))
    base = metrics.precision_at(rows, "y", "z", fraction, ["i"], n).first()[0]
    other = rows.select(F.col("i").alias("j"), F.col("c").alias("d"))
    changed = [F.round(F.col("z") + F.get("d", F.lit(f)) - F.get("c", F.lit(f)), 9) for f in range(len(names))]  # equal scores stay equal

    def swapped(r: int) -> DataFrame:
        digest = F.md5(F.concat_ws("|", "i", F.lit(r), F.lit(str(seed))).cast("binary"))
        return digest_rank(rows, digest, ["i"], "j").join(other, "j").select("i", "y", *(z.alias(f"z{f}") for f, z in enumerate(changed)))

    def best(r: int, least: list[float]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"z{f}").alias("z")) for f in range(len(names))))).alias("x")
        enough = reduce(lambda rest, v: F.when(F.col("f") == v[0], v[1]).otherwise(rest), enumerate(least), F.lit(0.0))
        return written(swapped(r).select("i", "y", each).select(F.lit(r).alias("r"), "x.f", "i", "y", "x.z").where(F.col("z") >= enough), "importance_best")

    at = max(0.0, 1 - k / max(1, n) - MARGIN - 1 / math.sqrt(max(1, n)))
    with cleared(rows.sparkSession):
        least = list(swapped(1).agg(*(F.percentile_approx(f"z{f}", at, 10_000) for f in range(len(names)))).first())  # about where the best begin, in any shuffle
    kept = []
    for r in range(1, repeats + 1):
        top = best(r, least)
        found = {x["f"]: x["count"] for x in top.groupBy("f").count().collect()}
        if any(found.get(f, 0) < k for f in range(len(names))):  # the cut was too high
            top = best(r, [float("-inf")] * len(names))
        kept.append(top)
    ranked = running_totals(reduce(DataFrame.unionByName, kept), [descending("z"), F.col("i")], {"rank": F.lit(1)}, ["r", "f"])
    means = ranked.where(F.col("rank") <= k).groupBy("f").agg((F.lit(base) - F.avg("y")).alias("importance"))
    return means.select(F.get(F.array(*map(F.lit, names)), F.col("f")).alias("feature"), "importance")


def group_means(importance: DataFrame) -> DataFrame:
    """``feature_group, importance``: mean of the features of each group."""
    names = F.create_map(*(F.lit(x) for g, cols in C.GROUPS.items() for c in cols for x in (c, g)))
    rows = importance.withColumn("feature_group", F.coalesce(names[F.col("feature")], F.lit(C.group_of(""))))
    return rows.groupBy("feature_group").agg(F.avg("importance").alias("importance"))
