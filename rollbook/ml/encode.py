"""Imputation, scaling and one-hot encoding as fixed expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Encoder:
    """Medians, means and deviations of numeric columns; fill values and categories of the others."""

    numeric: list[tuple[str, float, float, float]]
    categorical: list[tuple[str, str, list[str]]]

    @property
    def inputs(self) -> list[str]:
        return [x[0] for x in self.numeric] + [x[0] for x in self.categorical]

    def terms(self) -> list[tuple[str, Column]]:
        """``(input column, encoded value)`` for each model coefficient; unknown categories give zeros."""
        out = [(c, (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / sd) for c, m, mean, sd in self.numeric]
        for c, fill, values in self.categorical:
            out += [(c, (F.coalesce(F.col(c), F.lit(fill)) == v).cast("double")) for v in values]
        return out

    def codes(self) -> list[Column]:
        """Imputed numbers and ordinal codes, unknown categories -1: input of tree models."""
        out = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m, _, _ in self.numeric]
        for c, fill, values in self.categorical:
            out.append(F.array_position(F.array(*map(F.lit, values)), F.coalesce(F.col(c), F.lit(fill))).cast("double") - 1 if values else F.lit(-1.0))
        return out


#: Rank error of a range around a median, as a share of the rows; values of a range that are gathered for each column.
ERROR, GATHERED = 1e-4, 1000


def medians(df: DataFrame, columns: list[str]) -> list[float | None]:
    """Exact medians of all columns, a few aggregations in all; null without values.

    A quantile sketch gives a range around each median; the rows below and in it are counted, and the range
    is cut again until few values are left, which are gathered. No buffer grows with the rows.
    """
    xs = {i: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for i, c in enumerate(columns)}
    counts = df.agg(*(F.count(x).alias(f"n{i}") for i, x in xs.items())).first() if columns else {}
    open_ = {i: (None, None, 0, counts[f"n{i}"]) for i in xs if counts[f"n{i}"]}  # least, most, rows below, rows within
    out: list[float | None] = [None] * len(columns)
    inside = lambda i, lo, hi: F.when((xs[i] >= lo) & (xs[i] <= hi), xs[i]) if lo is not None else xs[i]
    while open_:
        ranks = {i: ((counts[f"n{i}"] - 1) // 2, counts[f"n{i}"] // 2) for i in open_}
        few = {i: v for i, v in open_.items() if v[3] <= GATHERED}
        many = {i: v for i, v in open_.items() if i not in few}
        asked = [F.sort_array(F.collect_list(inside(i, *v[:2]))).alias(f"v{i}") for i, v in few.items()]
        for i, (lo, hi, below, n) in many.items():
            at = [min(1.0, max(0.0, (r - below + 0.5) / n + d * ERROR)) for r, d in zip(ranks[i], (-2, 2), strict=True)]
            asked.append(F.percentile_approx(inside(i, lo, hi), at, int(1 / ERROR)).alias(f"q{i}"))
        got = df.agg(*asked).first()
        for i, v in few.items():
            values = got[f"v{i}"]
            out[i] = sum(values[r - v[2]] for r in ranks[i]) / 2
        if not many:
            break
        cut = {i: tuple(got[f"q{i}"]) for i in many}
        sizes = df.agg(*(F.count_if(xs[i] < lo).alias(f"b{i}") for i, (lo, _) in cut.items()), *(F.count_if((xs[i] >= lo) & (xs[i] <= hi)).alias(f"i{i}") for i, (lo, hi) in cut.items())).first()
        open_ = {}
        for i, (lo, hi) in cut.items():
            below, n = sizes[f"b{i}"], sizes[f"i{i}"]
            holds = below <= ranks[i][0] and ranks[i][1] < below + n
            if holds and lo == hi:
                out[i] = lo
            elif holds and n < many[i][3]:
                open_[i] = (lo, hi, below, n)
            else:  # the sketch was off, or ties fill the range: an exact percentile of the column
                out[i] = df.agg(F.percentile(xs[i], 0.5)).first()[0]
    return out


def levels(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, int]]]:
    """Values of each column and their counts, by value; nulls left out. As many rows as an encoder has categories."""
    if not columns:
        return {}
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))).alias("p")
    rows = df.select(pairs).where("p.v IS NOT NULL").groupBy("p.c", "p.v").agg(F.count("*").alias("n")).collect()
    found: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: r["v"].encode()):
        found[r["c"]].append((r["v"], r["n"]))
    return found


def fit_encoder(df: DataFrame, numeric: list[str], categorical: list[str]) -> Encoder:
    """Medians, means and deviations after imputation, modes (ties: the first value); a column without any value is 0, one without spread is only centred."""
    middle = [m or 0.0 for m in medians(df, numeric)]
    filled = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(m)) for c, m in zip(numeric, middle, strict=True)]
    spread = df.agg(F.count("*").alias("n"), *(F.avg(x).alias(f"a{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled))).first()
    found = levels(df, categorical)
    mode = {c: max(v, key=lambda x: x[1])[0] if v else "missing" for c, v in found.items()}
    return Encoder(
        [(c, m, spread[f"a{i}"] or 0.0, spread[f"s{i}"] or 1.0) for i, (c, m) in enumerate(zip(numeric, middle, strict=True))],
        [(c, mode[c], [x for x, _ in found[c]]) for c in categorical],
    )
