"""Columns and types of the three input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import number
from ..names import VALIDITY

# Names and types of the input contract.
_KEYS = "student_id string, school_id string, class_id string, grade string"
_LESSON = "date date, lesson_id string, subject string, scheduled_start_at timestamp_ntz, scheduled_minutes double"
SCHEMAS = {
    "attendance_events": f"{_KEYS}, term_id string, {_LESSON}, attended_minutes double, missed_minutes double, {VALIDITY} string, record_created_at timestamp_ntz, record_updated_at timestamp_ntz",
    "student_schedule": f"{_KEYS}, {_LESSON}",
    "school_calendar": "school_id string, date date, term_id string, is_instructional_day boolean, school_day_index int",
}


def fields(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) for x in SCHEMAS[table].split(", ")]


def validate_columns(table: str, actual: list[str]) -> None:
    """Every contract column must be there; others are allowed."""
    missing = sorted({c for c, _ in fields(table)} - set(actual))
    if missing:
        raise ValueError(f"{table} is missing required columns: {missing}")


def _typed(name: str, kind: str) -> Column:
    """The column in its contract type, null where it does not parse."""
    c = F.col(f"`{name}`")
    if kind == "double":
        return number(c)
    return c.try_cast("string").try_cast(kind) if kind == "boolean" else c.try_cast(kind)


def conform(table: str, df: DataFrame) -> DataFrame:
    """Contract columns in contract types.

    Dates and record times must parse; lesson starts, minutes and other values that do not are null.
    """
    validate_columns(table, df.columns)
    lenient = lambda name, kind: name == "scheduled_start_at" or kind in ("double", "int", "boolean")
    return df.select(*((_typed(n, k) if lenient(n, k) else F.col(n).cast(k)).alias(n) for n, k in fields(table)))


#: Columns that name a row of each table.
ROW_KEYS = {"attendance_events": ["student_id", "school_id", "class_id", "grade", "date", "lesson_id", "record_updated_at"], "student_schedule": ["student_id", "school_id", "class_id", "grade", "date", "lesson_id"], "school_calendar": ["school_id", "date"]}


def contract_violations(table: str, df: DataFrame) -> DataFrame:
    """``table, rule, column, rows``: what breaks the contract, as rows instead of an error.

    Rules: a column is missing (all rows), a value does not parse in its type, a part of the row's key is null
    (``record_updated_at`` may be), and a key is repeated (rows beyond the first; nulls are equal). One
    pass for all but the last. No violations, or an empty table with all columns: no rows.
    """
    here = [(n, k) for n, k in fields(table) if n in df.columns]
    keys = [k for k in ROW_KEYS[table] if k in df.columns]
    checks = [("missing column", n, F.count("*")) for n, _ in fields(table) if n not in df.columns]
    checks += [("failed cast", n, F.count_if(F.col(f"`{n}`").isNotNull() & _typed(n, k).isNull())) for n, k in here]
    checks += [("null key", n, F.count_if(_typed(n, k).isNull())) for n, k in here if n in keys and n != "record_updated_at"]
    wide = df.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks)))
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(n).alias("column"), F.col(f"c{i}").alias("rows")) for i, (r, n, _) in enumerate(checks)))).alias("v")
    found = wide.select(rows).select("v.rule", "v.column", "v.rows")
    typed = df.select(*(_typed(n, k).alias(n) for n, k in here if n in keys)).groupBy(*keys).agg((F.count("*") - 1).alias("more"))
    again = typed.agg(F.sum("more").alias("rows")).select(F.lit("repeated key").alias("rule"), F.lit(",".join(keys)).alias("column"), "rows")
    return found.unionByName(again).where("rows > 0").select(F.lit(table).alias("table"), "rule", "column", "rows")
