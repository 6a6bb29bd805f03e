"""Conforming and joining the inputs into one row per scheduled lesson."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..names import VALIDITY

KEYS = ["student_id", "school_id", "class_id", "grade", "date", "lesson_id"]

#: Lessons of one task: what it sorts grows with them, so their number is fixed and that of tasks grows.
LESSONS = 50_000

#: Lessons that one task reads and deals, about: it holds their rows until it has read all, or spills them.
READ = 1_000_000

#: Rounds in which more lessons than that are dealt to be stored.
ROUNDS = 4


def pieces(schedule: DataFrame) -> int:
    """Number of pieces that lessons are dealt into, by their count."""
    return max(schedule.sparkSession.sparkContext.defaultParallelism, math.ceil(schedule.count() / LESSONS))


def rounds(n: int | None) -> int:
    """Number of rounds in which lessons of ``n`` pieces are dealt to be stored: one for few, else a fixed number, as each reads the tables."""
    return ROUNDS if (n or 1) * LESSONS > READ else 1


def finer_reads(spark: SparkSession, n: int) -> None:
    """Have files read by as many tasks as ``n`` pieces need, for the session; a larger number set before stays.

    Files are split by bytes, so the rows that a task deals would grow with the tables up to a split's. It changes tasks, not results.
    """
    key, least = "spark.sql.files.minPartitionNum", math.ceil(n * LESSONS / READ)
    if least > max(spark.sparkContext.defaultParallelism, int(spark.conf.get(key, None) or 0)):
        spark.conf.set(key, least)


#: Bytes of generated code above which the JVM interprets a method for good.
METHOD = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Have stages of wide rows run by code that the JVM compiles, for the session; a smaller limit set before stays.

    Spark's own limit lets the code of a stage grow to where the JVM only interprets it, several times as slow. It changes time, not results.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > METHOD:
        spark.conf.set(key, METHOD)


def _latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row of each key in ``order``; remaining ties by all other columns, largest first."""
    rest = [F.col(c).desc_nulls_last() for c in sorted(set(df.columns) - set(keys))]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedup_attendance(df: DataFrame) -> DataFrame:
    """Latest update of each lesson record; a null update time counts as the latest, ties by creation time."""
    return _latest(df, KEYS, F.col("record_updated_at").desc_nulls_first(), F.col("record_created_at").desc_nulls_first())


def dedup_schedule(df: DataFrame) -> DataFrame:
    return _latest(df, KEYS)


def dedup_calendar(df: DataFrame) -> DataFrame:
    return _latest(df, ["school_id", "date"])


def lesson_frame(attendance: DataFrame, schedule: DataFrame, calendar: DataFrame, start_month: int = X.START_MONTH, threshold: float = X.THRESHOLD, n: int | None = None) -> DataFrame:
    """Scheduled lessons on instructional days with attendance and flags.

    Both large tables are put under each other and dealt by student once, into ``n`` pieces (by default as many as
    :func:`pieces` says); one sort finds each lesson's row and its record, and every later window and grouping of a
    student's rows reuses the deal. Null keys other than the student's match each other. Attendance without a
    scheduled lesson is dropped; lessons without a calendar row stay.
    """
    n = n or pieces(schedule)
    finer_reads(schedule.sparkSession, n)
    compiled_methods(schedule.sparkSession)
    own = [c for c in schedule.columns if c not in KEYS]
    other = [c for c in attendance.columns if c not in KEYS]
    a = attendance.select(*KEYS, *(F.col(c).alias(f"a_{c}") for c in other), F.lit(True).alias("__record"))
    rows = schedule.withColumn("__record", F.lit(False)).unionByName(a, allowMissingColumns=True).repartition(n, "student_id")
    # each lesson's scheduled rows as `dedup_schedule` orders them, then its records as `dedup_attendance` does
    latest = [F.col(f"a_record_{x}_at").desc_nulls_first() for x in ("updated", "created")]
    order = ["__record", *latest, *(F.col(c).desc_nulls_last() for c in [*(f"a_{c}" for c in sorted(other)), *sorted(own)])]
    w = Window.partitionBy(*KEYS).orderBy(*order)
    used = ["term_id", "subject", "scheduled_start_at", "scheduled_minutes", "attended_minutes", "missed_minutes", VALIDITY, "record_created_at", "record_updated_at"]
    record = F.when(F.col("__record") & F.col("student_id").isNotNull(), F.struct(*(F.col(f"a_{x}").alias(x) for x in used)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"__row": F.row_number().over(w), "__a": F.first(record, ignorenulls=True).over(whole)}).where("__row = 1 AND NOT __record")
    c = dedup_calendar(calendar).select(F.col("school_id").alias("c_school"), F.col("date").alias("c_date"), "term_id", "is_instructional_day", "school_day_index")
    lesson = rows.join(c, (rows["school_id"] == F.col("c_school")) & (rows["date"] == F.col("c_date")), "left").where(F.coalesce("is_instructional_day", F.lit(True)))
    known = lambda x: F.coalesce(F.col(x), F.col(f"__a.{x}")).alias(x)
    both = used[:4]
    lesson = lesson.select(*(known(x) if x in both else x for x in schedule.columns), known("term_id"), "is_instructional_day", "school_day_index", *(F.col(f"__a.{x}").alias(x) for x in used[4:]))
    return with_flags(lesson, start_month, threshold)


def with_flags(lesson: DataFrame, start_month: int = X.START_MONTH, threshold: float = X.THRESHOLD) -> DataFrame:
    recorded = F.col("record_updated_at").isNotNull()
    missed = X.missed_minutes(recorded, F.col("scheduled_minutes"), F.col("attended_minutes"), F.col("missed_minutes"))
    lesson = lesson.withColumn("has_attendance_record", recorded).withColumn("missed_minutes", missed)
    lesson = lesson.withColumn("attended_minutes", X.attended_minutes(F.col("has_attendance_record"), F.col("scheduled_minutes"), F.col("attended_minutes"), F.col("missed_minutes")))
    start = X.start_minutes(F.col("scheduled_start_at"))
    share = X.safe_divide(F.col("missed_minutes"), F.col("scheduled_minutes"))
    validity = F.lower(F.coalesce(VALIDITY, F.lit("")))
    return lesson.withColumns({
        "is_instructional_day": F.coalesce("is_instructional_day", F.lit(True)),
        "academic_year": X.academic_year(F.col("date"), start_month),
        "lesson_start_minutes": start,
        "lesson_time_bin": X.time_bin(start),
        "stage": X.grade_to_stage(F.col("grade")),
        "weekday": F.weekday("date"),
        "weekday_name": X.weekday_name(F.col("date")),
        "miss_share": share,
        "substantial_miss": X.true(share >= threshold),
        "partial_miss": X.true(F.col("missed_minutes") > 0) & ~X.true(share >= threshold),
        "is_giltig": validity == "giltig",
        "is_ogiltig": validity == "ogiltig",
        "registration_missing": ~F.col("has_attendance_record"),
    })
