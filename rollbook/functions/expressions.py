"""Scalar rules as Column expressions. Nulls stand for missing values; NaN never enters a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_MONTH = 8
THRESHOLD = 0.5


def number(col: Column) -> Column:
    """As double; what is no number, and NaN, is null."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def safe_divide(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def true(col: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(col, F.lit(False))


def zero(col: Column) -> Column:
    """Null counts as 0."""
    return F.coalesce(col, F.lit(0))


def grade_to_stage(grade: Column) -> Column:
    """F-3, 4-6, 7-9 or UNKNOWN; fractions are cut off."""
    text = F.upper(F.trim(grade))
    n = text.try_cast("double").try_cast("int")
    # fixed values: names of the preschool class
    preschool = text.isin("F", "FK", "FORSKOLEKLASS", "FORSKOLEKLASSEN", "0")
    rule = F.when(preschool | (n <= 3), "F-3").when(n <= 6, "4-6").when(n <= 9, "7-9").otherwise("UNKNOWN")
    # plain grades, most of all, need no parsing
    return F.when(grade.isin("F", "0", "1", "2", "3"), "F-3").when(grade.isin("4", "5", "6"), "4-6").when(grade.isin("7", "8", "9"), "7-9").otherwise(rule)


def academic_year(date: Column, start_month: int = START_MONTH) -> Column:
    """Label such as 2022/23."""
    start = F.year(date) - (F.month(date) < start_month).cast("int")
    return F.concat(start.cast("string"), F.lit("/"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0"))


def previous_academic_year(label: Column) -> Column:
    """The label one year before; null for what is no label."""
    part = F.split(label, "/")
    start, end = F.get(part, F.lit(0)).try_cast("int"), F.get(part, F.lit(1)).try_cast("int")
    before = F.concat((start - 1).cast("string"), F.lit("/"), F.lpad(F.pmod(end - 1, F.lit(100)).cast("string"), 2, "0"))
    return F.when(F.size(part) == 2, before)


def start_minutes(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("double")


def time_bin(minutes: Column) -> Column:
    """Bins cut at 9, 11 and 13 o'clock."""
    return F.when(minutes.isNull(), "unknown").when(minutes < 540, "before_09").when(minutes < 660, "09_11").when(minutes < 780, "11_13").otherwise("after_13")


def weekday_name(date: Column) -> Column:
    return F.lower(F.date_format(date, "EEEE"))


def missed_minutes(recorded: Column, scheduled: Column, attended: Column, missed: Column) -> Column:
    """Recorded value, else what attendance leaves of the schedule (0 at least); null without a record."""
    rest = scheduled - zero(attended)
    return F.when(recorded, F.coalesce(missed, F.when(rest.isNotNull(), F.greatest(rest, F.lit(0.0)))))


def attended_minutes(recorded: Column, scheduled: Column, attended: Column, missed: Column) -> Column:
    rest = scheduled - missed
    return F.when(recorded, F.coalesce(attended, F.when(rest.isNotNull(), F.greatest(rest, F.lit(0.0)))))


def yes_no(flag: Column) -> Column:
    return F.when(true(flag), "yes").otherwise("no")


def percent(threshold: float) -> int:
    """Column suffix of a threshold, cut off as a double: 0.29 gives 28."""
    return int(threshold * 100)


def reached(ratio: Column, threshold: float) -> Column:
    """1 where the ratio is known and at or over the threshold."""
    return true(ratio >= threshold).cast("int")
