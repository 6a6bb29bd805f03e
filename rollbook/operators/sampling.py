"""Exact-size deterministic sampling by a seeded hash of the row's key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import first_rows


def draw_order(keys: list[str], seed: int) -> Column:
    """The same in every run and engine: MD5 of the key's text and the seed."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed))).cast("binary"))


def draw(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """The first ``n`` rows in draw order."""
    return first_rows(df, n, [draw_order(keys, seed), *map(F.col, keys)])


def _counts(df: DataFrame, target: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    return row[0], row[1]


def sample_negatives(df: DataFrame, target: str, ratio: float, keys: list[str], seed: int) -> DataFrame:
    """All positives and at most ``ratio`` times as many negatives; one class only: all rows."""
    pos, neg = _counts(df, target)
    if not pos or not neg:
        return df
    return df.where(F.col(target) == 1).unionByName(draw(df.where(F.col(target) == 0), int(min(neg, pos * ratio)), keys, seed))


def cap_rows(df: DataFrame, target: str, most: int, keys: list[str], seed: int, strict: bool = False) -> DataFrame:
    """All positives and as many negatives as the cap leaves.

    When positives alone reach the cap, negatives all stay, or all go with ``strict``.
    """
    pos, neg = _counts(df, target)
    rest = max(most - pos, 0)
    if pos + neg <= most or (not rest and not strict):
        return df
    return df.where(F.col(target) == 1).unionByName(draw(df.where(F.col(target) == 0), min(neg, rest), keys, seed))


def sample_fraction(df: DataFrame, fraction: float, keys: list[str], seed: int) -> DataFrame:
    """A share of all rows, to the nearest row."""
    return df if fraction >= 1 else draw(df, math.floor(df.count() * fraction + 0.5), keys, seed)
