"""An additive booster: a lookup table for each feature, learned by cyclic boosting on binned features.

Numbers are cut at quantiles once, categories are their own bins, and missing values have a bin of their own.
The binned rows, a byte for each bin, are written once in blocks. A round visits the next features of the cycle:
one grouped aggregation sums gradients and curvatures of the log loss in each of their bins, and every bin takes
a damped Newton step. Tasks add up the sums of their rows by table lookups, and only sums of bins reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BINS, CYCLES, BLOCK, RATE, SMOOTH = 32, 12, 8, 0.4, 1.0

#: Rows that are stored as one, and rows that are added up at once.
PACK, SLICE = 64, 16_384


@dataclass
class Shape:
    """Scores of a feature's bins: between ``cuts`` (a cut belongs to the bin above it) or of ``levels``; ``other`` is for missing and unknown values."""

    column: str
    cuts: list[float]
    levels: list[str]
    values: list[float]
    other: float = 0.0

    @property
    def numeric(self) -> bool:
        return not self.levels

    def _pick(self, results: list[Column], other: Column) -> Column:
        c = F.col(f"`{self.column}`")
        if self.levels:
            return reduce(lambda rest, kv: F.when(c == kv[0], kv[1]).otherwise(rest), zip(self.levels, results, strict=True), other)
        x = F.nanvl(c.cast("double"), F.lit(None))

        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return results[lo]
            mid = (lo + hi) // 2
            return F.when(x < self.cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

        return F.when(x.isNull(), other).otherwise(search(0, len(self.cuts)))

    def value(self) -> Column:
        """The feature's part of the score."""
        return self._pick([F.lit(v) for v in self.values], F.lit(self.other))

    def bin(self) -> Column:
        return self._pick([F.lit(i) for i in range(len(self.values))], F.lit(len(self.values)))

    def to_sql(self) -> str:
        q = lambda v: "'" + v.replace("'", "''") + "'"
        if self.levels:
            return f"CASE {self.column} " + "".join(f"WHEN {q(k)} THEN {v!r} " for k, v in zip(self.levels, self.values, strict=True)) + f"ELSE {self.other!r} END"
        whens = "".join(f"WHEN {self.column} < {c!r} THEN {v!r} " for c, v in zip(self.cuts, self.values, strict=False))
        return f"CASE WHEN {self.column} IS NULL THEN {self.other!r} {whens}ELSE {self.values[-1]!r} END"


def empty_shapes(df: DataFrame, numeric: list[str], categories: dict[str, list[str]], bins: int = BINS) -> list[Shape]:
    """Shapes without scores; numbers are cut at quantiles of all rows, from one sketch of bounded size a column."""
    at = [i / bins for i in range(1, bins)]
    asked = [F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), at, 1000).alias(f"q{i}") for i, c in enumerate(numeric)]
    found = df.agg(*asked).first() if numeric else {}
    cuts = [sorted(set(found[f"q{i}"] or [])) for i in range(len(numeric))]
    shapes = [Shape(c, x, [], [0.0] * (len(x) + 1)) for c, x in zip(numeric, cuts, strict=True)]
    return shapes + [Shape(c, [], v, [0.0] * len(v)) for c, v in categories.items() if v]


def packed(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Blocks of ``PACK`` rows as bytes, row by row ``b0`` to the last of ``width`` bins (below ``most``) and the label ``y``; a pass then moves little."""
    kind, names = np.min_scalar_type(max(1, most)), [*(f"b{j}" for j in range(width)), "y"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.column_stack([batch[c].to_numpy() for c in names]).astype(kind)
            yield pd.DataFrame({"block": [cells[i : i + PACK].tobytes() for i in range(0, len(cells), PACK)]})

    known = {*rows.columns}
    return rows.select(*(F.col(c) if c in known else F.lit(0).alias(c) for c in names)).mapInPandas(pack, "block binary")


def _bin_sums(rows: DataFrame, tables: list[list[float]], intercept: float, own: range) -> list:
    """``j, k, g, h, n``: sums of gradients and curvatures, and rows, in each bin of the features ``own``; of rows, or of blocks of them."""
    lookup = [(j, np.array(t)) for j, t in enumerate(tables) if any(t)]
    sizes = {j: len(tables[j]) for j in own}
    width, most = len(tables), max(map(len, tables), default=0)
    kind = np.min_scalar_type(max(1, most))
    at_once = SLICE

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {j: np.zeros((3, size)) for j, size in sizes.items()}
        for batch in batches:
            cells = np.frombuffer(b"".join(batch["block"]), kind).reshape(-1, width + 1)
            for start in range(0, len(cells), at_once):
                bins = np.ascontiguousarray(cells[start : start + at_once].T)
                y = bins[width].astype("float64")
                z = np.full(len(y), intercept)
                for j, table in lookup:
                    z += table[bins[j]]
                p = 1 / (1 + np.exp(-z))
                for j, found in sums.items():
                    for i, x in enumerate((y - p, p * (1 - p), None)):
                        found[i] += np.bincount(bins[j], x, found.shape[1])
        yield pd.concat(pd.DataFrame({"j": j, "k": np.arange(x.shape[1]), "g": x[0], "h": x[1], "n": x[2].astype("int64")}) for j, x in sums.items())

    blocks = rows if "block" in rows.columns else packed(rows, width, most)
    sums = blocks.mapInPandas(add, "j int, k int, g double, h double, n long")
    return sums.groupBy("j", "k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).where("n > 0").collect()  # a row for each bin


def fit_additive(df: DataFrame, target: str, numeric: list[str], categories: dict[str, list[str]], cycles: int = CYCLES, bins: int = BINS, block: int = BLOCK, rate: float = RATE, smooth: float = SMOOTH) -> tuple[list[Shape], float]:
    """Shapes and intercept; scores of a feature have mean zero over the rows."""
    import math

    shapes = empty_shapes(df, numeric, categories, bins)
    n, pos = df.agg(F.count("*"), F.sum(F.col(target).cast("double"))).first()
    if not pos or pos == n:
        raise ValueError("training rows hold one class only")
    intercept = math.log(pos / (n - pos))
    tables = [[0.0] * (len(s.values) + 1) for s in shapes]
    binned = df.select(F.col(target).cast("double").alias("y"), *(s.bin().alias(f"b{j}") for j, s in enumerate(shapes)))
    rows = written(packed(binned, len(tables), max(map(len, tables), default=0)), "binned")
    rounds = -(-len(shapes) // block)
    for turn in range(cycles * rounds):
        own = range((turn % rounds) * block, min(len(shapes), (turn % rounds + 1) * block))
        sums = _bin_sums(rows, tables, intercept, own)
        for j in own:
            found = {r["k"]: r for r in sums if r["j"] == j}
            for k, r in found.items():
                tables[j][k] += rate * r["g"] / (r["h"] + smooth)
            mean = sum(tables[j][k] * r["n"] for k, r in found.items()) / n
            tables[j] = [v - mean for v in tables[j]]
            intercept += mean
    return [Shape(s.column, s.cuts, s.levels, t[:-1], t[-1]) for s, t in zip(shapes, tables, strict=True)], intercept
