"""Ranking and probability metrics as aggregations.

Rows are first grouped by score, so cumulative windows run over the distinct scores; ties at a cut are
broken by the id columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranges import descending, first_rows, running_totals


def _scored(df: DataFrame, *columns: str | list[str]) -> DataFrame:
    """The named columns, written once."""
    names = [c for x in columns for c in ([x] if isinstance(x, str) else x)]
    return written(df.select(*dict.fromkeys(names)), "scored")


def precision_at(df: DataFrame, target: str, score: str, fraction: float, ids: list[str], n: int | None = None) -> DataFrame:
    """``precision``: mean label of the ceil(n * fraction) best rows, one at least."""
    if n is None:  # the rows are read several times: their few columns are written once
        df = _scored(df, target, score, ids)
        n = df.count()
    top = first_rows(df, max(1, math.ceil(n * fraction)), [descending(score), *map(F.col, ids)])
    return top.agg(F.avg(F.col(target).cast("double")).alias("precision"))


def average_precision(df: DataFrame, target: str, score: str, by: list[str] = ()) -> DataFrame:
    """``pr_auc`` by steps: precision at each distinct score, weighted by its positives; null with one class."""
    cut = df.groupBy(*by, score).agg(F.sum(F.col(target).cast("double")).alias("p"), F.count("*").alias("n"))
    cut = running_totals(cut, [descending(score)], {"tp": F.col("p"), "all": F.col("n")}, list(by))
    whole = cut.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("rows"))
    cut = cut.join(whole, list(by)) if by else cut.crossJoin(F.broadcast(whole))  # one row
    area = F.sum(F.col("p") / F.when(F.col("pos") > 0, F.col("pos")) * F.col("tp") / F.col("all"))
    return cut.groupBy(*by).agg(F.when((F.max("pos") > 0) & (F.max("pos") < F.max("rows")), area).alias("pr_auc"))


def basics(df: DataFrame, target: str, score: str, by: list[str] = ()) -> DataFrame:
    """``row_count, positive_rate, brier``; Brier is null with one class."""
    y = F.col(target).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), F.avg(y).alias("positive_rate"), F.when(F.min(y) < F.max(y), F.avg(F.pow(F.col(score) - y, F.lit(2)))).alias("brier"))


def binary_metrics(df: DataFrame, target: str, score: str, fractions: list[float], ids: list[str]) -> dict[str, float | None]:
    """All metrics of a scored frame as a small dictionary."""
    df = _scored(df, target, score, ids)
    out = {**basics(df, target, score).first().asDict(), "pr_auc": average_precision(df, target, score).first()["pr_auc"] if not df.isEmpty() else None}
    for f in fractions:
        out[f"precision_at_{f:.2f}"] = precision_at(df, target, score, f, ids, out["row_count"]).first()["precision"]
    return out


def group_metrics(df: DataFrame, group: str, target: str, score: str, fractions: list[float], ids: list[str], min_rows: int = 25) -> DataFrame:
    """A row of metrics for each group of at least ``min_rows`` rows."""
    df = _scored(df, group, target, score, ids)
    out = basics(df, target, score, [group]).where(F.col("row_count") >= min_rows)
    out = out.join(average_precision(df, target, score, [group]), group)
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    ranked = running_totals(df, [descending(score), *map(F.col, ids)], {"r": F.lit(1)}, [group]).join(sizes, group).select(group, F.col(target).cast("double").alias("y"), "r", "n")
    for f in fractions:
        top = ranked.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * f))).groupBy(group).agg(F.avg("y").alias(f"precision_at_{f:.2f}"))
        out = out.join(top, group)
    return out


def lesson_totals(df: DataFrame, score: str, target: str) -> DataFrame:
    """Expected and actual missed attendances of each lesson; rows with a null key belong to none."""
    keys = ["date", "school_id", "class_id", "lesson_id"]
    return df.dropna(subset=keys).groupBy(*keys).agg(F.sum(score).alias("expected_missed"), F.sum(F.col(target).cast("double")).alias("actual_missed"))


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank of ``col`` from 1, ties sharing their mean rank; ranks come from the distinct values' counts."""
    counts = df.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    counts = running_totals(counts, [F.col("__v")], {"__upto": F.col("__n")})
    ranks = counts.select("__v", (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(col) == F.col("__v")).drop("__v")


def lesson_metrics(totals: DataFrame, fractions: list[float]) -> DataFrame:
    """One row: count, Spearman correlation, mean absolute error and top-k hit rates.

    Lesson totals are written once; they are read for the rank sums and for each of the two top lists of a fraction.
    """
    totals = written(totals, "lesson_totals")
    keys = ["date", "school_id", "class_id", "lesson_id"]
    ranked = totals.transform(average_rank, "expected_missed", "re").transform(average_rank, "actual_missed", "ra")
    out = ranked.agg(F.count("*").alias("lesson_count"), F.corr("re", "ra").alias("rank_correlation"), F.avg(F.abs(F.col("expected_missed") - F.col("actual_missed"))).alias("mae_expected_missed"))
    n = totals.count()
    for f in fractions:
        k = max(1, math.ceil(n * f))
        best = [first_rows(totals, k, [descending(c), *map(F.col, keys)]).select(*keys) for c in ("expected_missed", "actual_missed")]
        hit = best[0].join(best[1], keys).agg((F.count("*") / k).alias(f"lesson_hit_rate_at_{f:.2f}"))
        out = out.crossJoin(hit)  # one row each
    return out


def expected_missed(predictions: DataFrame, prob: str, out: str = "lesson_expected_missed") -> DataFrame:
    """Sum of the probabilities of all students of a lesson; rows with a null key belong to none."""
    keys = ["target_date", "lesson_id", "target_subject", "target_lesson_start_minutes"]
    return predictions.dropna(subset=keys).groupBy(*keys).agg(F.sum(prob).alias(out))
