"""The six classification datasets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Modeling
from ..functions import expressions as X
from ..functions import features as C
from ..operators.days import day_order, to_date_frame, with_common
from .prepare import Prepared

SLOTS = {
    "subject": ["subject"],
    "weekday": ["weekday_name"],
    "timebin": ["lesson_time_bin"],
    "subject_weekday_timebin": ["subject", "weekday_name", "lesson_time_bin"],
}


@dataclass
class Task:
    name: str
    frame: DataFrame
    target: str
    numeric: list[str]
    categorical: list[str]
    ids: list[str]
    group: str = "stage"


def filter_years(df: DataFrame, years: list[str] | None) -> DataFrame:
    """Rows of the school years; none named: all."""
    return df.where(F.col("academic_year").isin(years)) if years else df


def _task(name: str, frame: DataFrame, years: list[str] | None) -> Task:
    numeric, categorical = C.resolve(C.DEFAULT_GROUPS[name], name)
    ids, target = C.id_columns(name), C.target_of(name)
    columns = dict.fromkeys([*ids, target, *numeric, *categorical])
    return Task(name, filter_years(frame, years).select(*columns), target, numeric, categorical, ids)


def short_horizon_frame(days: DataFrame, horizon: int) -> DataFrame:
    """Student-days with the label and schedule of the next ``horizon`` school days of the same year."""
    ahead = day_order("academic_year").rowsBetween(1, horizon)
    total = lambda c: X.zero(F.sum(c).over(ahead)).cast("double")
    sums = {"total_scheduled_lessons": "total_scheduled_lessons", "total_scheduled_minutes": "total_scheduled_minutes", "total_subject_count": "subject_count", "morning_lessons": "morning_lessons", "afternoon_lessons": "afternoon_lessons"}
    following = lambda c: F.lead(c).over(day_order("academic_year"))
    nexts = {c: c for c in ("total_scheduled_lessons", "total_scheduled_minutes", "first_lesson_start", "last_lesson_start", "subject_count", "morning_lessons", "afternoon_lessons", "after_long_break", "weekday_name")}
    nexts["gap_days"] = "calendar_days_since_previous_school_day"
    out = with_common(days).withColumns({
        "future_school_days_available": F.count("*").over(ahead),
        "target_short_horizon": X.true(F.bool_or("daily_any_substantial_miss").over(ahead)).cast("int"),
        "__complete": X.true(F.bool_and("registration_complete").over(ahead)),
        **{f"future_{k}": total(c) for k, c in sums.items()},
        **{f"next_school_day_{k}": following(c) for k, c in nexts.items()},
    })
    complete = (F.col("future_school_days_available") == horizon) & F.col("__complete")
    average = X.safe_divide(F.col("future_total_scheduled_minutes"), F.col("future_school_days_available"))
    return out.withColumns({"future_horizon_complete": complete, "future_average_daily_minutes": average}).drop("__complete")


def short_horizon(p: Prepared, m: Modeling | None = None, years: list[str] | None = None) -> Task:
    frame = short_horizon_frame(p.student_day, (m or Modeling()).short_horizon_school_days)
    return _task("short_horizon", frame.where("future_horizon_complete"), years)


def with_term_gaps(days: DataFrame) -> DataFrame:
    return days.withColumns({f"gap_to_{k}pct": F.lit(t) - F.col("term_cumulative_missed_ratio") for k, t in ((10, 0.10), (20, 0.20))})


def _final_ratio(by: str):
    w = Window.partitionBy("student_id", by)
    return X.safe_divide(F.sum("daily_missed_minutes").over(w), F.sum("daily_recorded_minutes").over(w))


def chronic(p: Prepared, threshold: float, years: list[str] | None = None) -> Task:
    """Every student-day; does the term's final missed ratio reach the threshold?"""
    k = X.percent(threshold)
    frame = with_common(p.student_day).withColumn(f"target_chronic_{k}", X.reached(_final_ratio("term_id"), threshold))
    return _task(f"chronic_{k}", with_term_gaps(frame), years)


def year_to_date(days: DataFrame, start_month: int = 8) -> DataFrame:
    w = to_date_frame("academic_year")
    ratio = X.safe_divide(F.sum("daily_missed_minutes").over(w), F.sum("daily_recorded_minutes").over(w))
    return days.withColumns({
        "year_cumulative_missed_ratio": ratio,
        "gap_to_year_10pct": F.lit(0.10) - ratio,
        "gap_to_year_20pct": F.lit(0.20) - ratio,
        "is_term2": (F.month("date") < start_month).cast("double"),
        "year_school_days_elapsed": F.row_number().over(day_order("academic_year")),
    })


def with_term1_actuals(days: DataFrame) -> DataFrame:
    """Last known cumulative ratios of the year's first term, 0 within that term and where unknown."""
    w = day_order("academic_year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = ("missed", "giltig", "ogiltig")
    last = {f"term1_actual_{k}_ratio": F.last(F.when(F.col("is_term2") == 0, F.col(f"term_cumulative_{k}_ratio")), ignorenulls=True).over(w) for k in kinds}
    return days.withColumns({c: F.when(F.col("is_term2") == 0, 0.0).otherwise(F.coalesce(x, F.lit(0.0))) for c, x in last.items()})


def year_calendar(calendar: DataFrame, start_month: int = 8) -> DataFrame:
    """Distinct instructional dates of each school and year."""
    open_ = calendar.where("is_instructional_day").withColumn("academic_year", X.academic_year(F.col("date"), start_month))
    return open_.groupBy("school_id", "academic_year").agg(F.count_distinct("date").alias("year_total_school_days"))


def with_year_progress(days: DataFrame, calendar: DataFrame, start_month: int = 8) -> DataFrame:
    days = days.join(year_calendar(calendar, start_month), ["school_id", "academic_year"], "left")
    return days.withColumns({
        "year_progress_ratio": X.safe_divide(F.col("year_school_days_elapsed"), F.col("year_total_school_days")),
        "year_days_remaining": F.col("year_total_school_days") - F.col("year_school_days_elapsed"),
    })


def with_year_level(days: DataFrame, calendar: DataFrame, start_month: int = 8) -> DataFrame:
    return days.transform(with_term_gaps).transform(year_to_date, start_month).transform(with_term1_actuals).transform(with_year_progress, calendar, start_month)


def chronic_year(p: Prepared, threshold: float, start_month: int = 8, years: list[str] | None = None) -> Task:
    """Every student-day; does the school year's final missed ratio reach the threshold?"""
    k = X.percent(threshold)
    frame = with_common(p.student_day).withColumn(f"target_chronic_year_{k}", X.reached(_final_ratio("academic_year"), threshold))
    return _task(f"chronic_year_{k}", with_year_level(frame, p.calendar, start_month), years)


def slot_history(lessons: DataFrame, slot: str) -> DataFrame:
    """Cumulative lesson count and substantial rate of each student and slot, by date."""
    by = ["student_id", *SLOTS[slot]]
    daily = lessons.where("has_attendance_record").dropna(subset=[*by, "date"]).groupBy(*by, "date").agg(F.count("*").alias("n"), F.count_if("substantial_miss").alias("s"))
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    n, s = F.sum("n").over(w), F.sum("s").over(w)
    return daily.select(*by, "date", n.cast("double").alias(f"hist_{slot}_lesson_count"), X.safe_divide(s, n).alias(f"hist_{slot}_substantial_rate"))


def with_histories(frame: DataFrame, lessons: DataFrame) -> DataFrame:
    """Slot histories known at ``score_date`` for each target lesson, as :func:`slot_history` counts them; 0 without history.

    The rows and the daily counts of the finest slot make one timeline of a student; running sums over it, by each
    slot, are the histories. So the rows are computed once and need no join. The student's column has a name of its
    own there, so that the union sees the deal of both sides and nothing is exchanged.
    """
    slot = SLOTS["subject_weekday_timebin"]
    daily = lessons.where("has_attendance_record").dropna(subset=["student_id", "date"]).groupBy("student_id", *slot, "date").agg(F.count("*").alias("__n"), F.count_if("substantial_miss").alias("__s"))
    daily = daily.select(F.col("student_id").alias("__who"), *(F.col(c).alias(f"target_{c}") for c in slot), F.col("date").alias("score_date"), "__n", "__s")
    line = frame.withColumnRenamed("student_id", "__who").withColumn("__asked", F.lit(True)).unionByName(daily, allowMissingColumns=True)
    found = {}
    for name, columns in SLOTS.items():
        by = ["__who", *(f"target_{c}" for c in columns)]
        w = Window.partitionBy(*by).orderBy("score_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        n, s = (F.when(reduce(and_, (F.col(c).isNotNull() for c in by)), F.sum(x).over(w)) for x in ("__n", "__s"))  # a null slot has no history
        found |= {f"hist_{name}_lesson_count": X.zero(n.cast("double")), f"hist_{name}_substantial_rate": X.zero(X.safe_divide(s, n))}
    return line.withColumns(found).where("__asked").drop("__asked", "__n", "__s").withColumnRenamed("__who", "student_id")


def with_target_flags(lessons: DataFrame) -> DataFrame:
    """Target columns of a lesson; first and last are by start among the given lessons of the day."""
    w = Window.partitionBy("student_id", "date")
    start = F.col("lesson_start_minutes")
    return lessons.select(
        "student_id", "school_id", "class_id", "grade", "stage", "date", "lesson_id", "academic_year", "substantial_miss",
        F.col("scheduled_minutes").alias("target_scheduled_minutes"), start.alias("target_lesson_start_minutes"),
        F.col("subject").alias("target_subject"), F.col("weekday_name").alias("target_weekday_name"), F.col("lesson_time_bin").alias("target_lesson_time_bin"),
        X.yes_no(start == F.min(start).over(w)).alias("target_first_lesson_flag"), X.yes_no(start == F.max(start).over(w)).alias("target_last_lesson_flag"),
    )


def day_positions(days: DataFrame) -> DataFrame:
    """Score-day features of each student's row position."""
    features = [c for c in C.STUDENT_DAY + C.GROUPS["calendar"]]
    return with_common(days).select("student_id", F.col("date").alias("score_date"), (F.row_number().over(day_order()) - 1).alias("pos"), "weekday_name", *features)


def target_day_schedule(days: DataFrame) -> DataFrame:
    return days.select(
        F.col("student_id").alias("__student"), F.col("date").alias("__date"),
        F.col("total_scheduled_lessons").alias("target_day_total_scheduled_lessons"), F.col("total_scheduled_minutes").alias("target_day_total_scheduled_minutes"),
        F.col("subject_count").alias("target_day_subject_count"), F.col("calendar_days_since_previous_school_day").alias("target_days_since_previous_school_day"),
        F.col("after_long_break").alias("target_after_long_break"),
    )


def with_target_day(frame: DataFrame, days: DataFrame) -> DataFrame:
    """Lessons with the schedule of their own day."""
    t = target_day_schedule(days)
    return frame.join(t, (F.col("student_id") == F.col("__student")) & (F.col("date") == F.col("__date")), "left").drop("__student", "__date")


def seen_lessons(lessons: DataFrame, days: DataFrame, horizon: int) -> DataFrame:
    """Each recorded lesson as seen 1 to ``horizon`` school days before, in a few columns; ``__at`` is the position of that day."""
    target = with_target_flags(lessons.where("has_attendance_record"))
    at = day_positions(days).select(F.col("student_id").alias("__student"), F.col("score_date").alias("__date"), F.col("pos").alias("__pos"))
    placed = target.join(at, (F.col("student_id") == F.col("__student")) & (F.col("date") == F.col("__date"))).drop("__student", "__date")
    seen = placed.withColumn("horizon_school_days", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("__at", F.col("__pos") - F.col("horizon_school_days")).where("__at >= 0")
    at = at.withColumnsRenamed({"__date": "score_date", "__pos": "pos"})
    seen = seen.join(at, (F.col("student_id") == F.col("__student")) & (F.col("__at") == F.col("pos"))).drop("__student", "__pos", "pos")
    return seen.withColumn("target_label", F.col("substantial_miss").cast("int"))


def with_score_day(frame: DataFrame, days: DataFrame) -> DataFrame:
    """The features of the day at ``__at``, the only wide columns; so they come last."""
    score = day_positions(days).withColumnRenamed("student_id", "__student").drop("score_date")
    return frame.join(score, (F.col("student_id") == F.col("__student")) & (F.col("__at") == F.col("pos")), "left").drop("__student", "__at", "pos")


def expand_lessons(lessons: DataFrame, days: DataFrame, horizon: int) -> DataFrame:
    """Each recorded lesson as seen 1 to ``horizon`` school days before, with the features of that day."""
    return with_score_day(seen_lessons(lessons, days, horizon), days)


def until_target(frame: DataFrame) -> DataFrame:
    return frame.withColumn("calendar_days_until_target", F.date_diff("date", "score_date"))


def lesson(p: Prepared, m: Modeling | None = None, years: list[str] | None = None) -> Task:
    """Everything but the features of the score day is joined to narrow rows, and those last."""
    frame = seen_lessons(filter_years(p.lesson_frame, years), p.student_day, (m or Modeling()).lesson_horizon_school_days)
    frame = frame.transform(with_target_day, p.student_day).transform(until_target).transform(with_histories, p.lesson_frame)
    return _task("lesson", with_score_day(frame, p.student_day), None)


def all_tasks(p: Prepared, m: Modeling | None = None, start_month: int = 8, years: list[str] | None = None) -> dict[str, Task]:
    tasks = [short_horizon(p, m, years), *(chronic(p, t, years) for t in (0.10, 0.20)), *(chronic_year(p, t, start_month, years) for t in (0.10, 0.20)), lesson(p, m, years)]
    return {t.name: t for t in tasks}
