"""One row per student and school day: schedule, attendance and history features.

Everything is a window or grouping within a student, so the deal by student made for the lessons serves
all of it; only the small calendar totals are joined in from elsewhere.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions.features import WINDOWS

DAY_KEYS = ["student_id", "school_id", "class_id", "grade", "stage", "date", "term_id", "academic_year", "school_day_index"]
_ORDER = ["date", "school_id", "class_id", "grade", "stage", "term_id", "academic_year", "school_day_index"]
NOON = 12 * 60


def day_order(*by: str) -> Window:
    """Rows of a student in date order; equal dates by the rest of the day's key."""
    return Window.partitionBy("student_id", *by).orderBy(*_ORDER)


def to_date_frame(*by: str) -> Window:
    return day_order(*by).rowsBetween(Window.unboundedPreceding, 0)


def _schedule_aggregates() -> list[Column]:
    start = F.col("lesson_start_minutes")
    return [
        F.count("*").alias("total_scheduled_lessons"),
        X.zero(F.sum("scheduled_minutes")).alias("total_scheduled_minutes"),
        F.min(start).alias("first_lesson_start"),
        F.max(start).alias("last_lesson_start"),
        F.count_distinct("subject").alias("subject_count"),
        F.count_if(start < NOON).alias("morning_lessons"),
        F.count_if(start >= NOON).alias("afternoon_lessons"),
    ]


def with_calendar_gaps(days: DataFrame) -> DataFrame:
    w = day_order()
    since = F.date_diff("date", F.lag("date").over(w))
    return days.withColumns({
        "calendar_days_since_previous_school_day": since,
        "calendar_days_until_next_school_day": F.date_diff(F.lead("date").over(w), "date"),
        "after_long_break": X.true(since >= 4).cast("int"),
    })


def _keyed(lessons: DataFrame) -> DataFrame:
    """Lessons whose day key is complete; others belong to no day."""
    return lessons.dropna(subset=DAY_KEYS)


def schedule_day(lessons: DataFrame) -> DataFrame:
    return with_calendar_gaps(_keyed(lessons).groupBy(*DAY_KEYS).agg(*_schedule_aggregates()))


def day_totals(lessons: DataFrame) -> DataFrame:
    """Schedule and attendance of each day in one grouping; giltig and ogiltig minutes count the student's whole date."""
    date = Window.partitionBy("student_id", "date")
    rec = F.col("has_attendance_record")
    for kind in ("giltig", "ogiltig"):
        lessons = lessons.withColumn(f"__{kind}", X.zero(F.sum(F.when(rec & F.col(f"is_{kind}"), F.col("missed_minutes"))).over(date)))
    days = _keyed(lessons).groupBy(*DAY_KEYS).agg(
        *_schedule_aggregates(),
        F.count_if(rec).alias("daily_recorded_lessons"),
        X.zero(F.sum(F.when(rec, F.col("scheduled_minutes")))).alias("daily_recorded_minutes"),
        X.zero(F.sum(F.when(rec, F.col("missed_minutes")))).alias("daily_missed_minutes"),
        F.count_if(rec & F.col("substantial_miss")).alias("daily_substantial_miss_lessons"),
        F.count_if(rec & F.col("partial_miss")).alias("daily_partial_miss_lessons"),
        X.true(F.bool_or(rec & F.col("substantial_miss"))).alias("daily_any_substantial_miss"),
        F.max("__giltig").alias("daily_giltig_missed_minutes"),
        F.max("__ogiltig").alias("daily_ogiltig_missed_minutes"),
    )
    minutes = F.col("daily_recorded_minutes")
    days = days.withColumns({
        "registration_complete": F.col("daily_recorded_lessons") == F.col("total_scheduled_lessons"),
        **{f"daily_{k}_ratio": X.safe_divide(F.col(f"daily_{m}"), minutes) for k, m in (("missed", "missed_minutes"), ("giltig", "giltig_missed_minutes"), ("ogiltig", "ogiltig_missed_minutes"))},
        "daily_partial_lesson_ratio": X.safe_divide(F.col("daily_partial_miss_lessons"), F.col("daily_recorded_lessons")),
    })
    return with_calendar_gaps(days)


#: How sums over so many rows are put together: of shorter ones, each a number of rows back.
_SUMS = {3: [(1, 0), (1, 1), (1, 2)], 5: [(3, 0), (1, 3), (1, 4)], 10: [(5, 0), (5, 5)], 20: [(10, 0), (10, 10)]}


def with_rolling(days: DataFrame) -> DataFrame:
    """Ratios of sums and means of daily values over the last rows; they run on over terms and years.

    Sums of a window are made of sums of shorter ones some rows back, by additions only, so what has left a
    window leaves no trace, however large it was.
    """
    w = day_order()
    daily = {
        "missed": F.col("daily_missed_minutes"), "giltig": F.col("daily_giltig_missed_minutes"), "ogiltig": F.col("daily_ogiltig_missed_minutes"), "recorded": F.col("daily_recorded_minutes"),
        "partial": X.zero(F.col("daily_partial_lesson_ratio")), "lessons": F.col("daily_partial_lesson_ratio").isNotNull().cast("int"), "substantial": F.col("daily_any_substantial_miss").cast("int"), "rows": F.lit(1),
    }
    days = days.withColumn("__last_1", F.struct(*(x.alias(k) for k, x in daily.items())))
    for n, parts in _SUMS.items():
        back = {f"__back_{m}_{k}": F.lag(f"__last_{m}", k).over(w) for m, k in parts if k and f"__back_{m}_{k}" not in days.columns}
        days = days.withColumns(back)
        pick = lambda m, k: f"__back_{m}_{k}" if k else f"__last_{m}"
        total = lambda c, parts=parts: reduce(add, (X.zero(F.col(f"{pick(m, k)}.{c}")) for m, k in parts))
        days = days.withColumn(f"__last_{n}", F.struct(*(total(c).alias(c) for c in daily)))
    out = {}
    for n in WINDOWS:
        last = lambda k, n=n: F.col(f"__last_{n}.{k}")
        for kind in ("missed", "giltig", "ogiltig"):
            out[f"roll_{n}d_{kind}_ratio"] = X.safe_divide(last(kind), last("recorded"))
        out[f"roll_{n}d_partial_ratio"] = X.safe_divide(last("partial"), last("lessons"))
        out[f"roll_{n}d_substantial_day_rate"] = X.safe_divide(last("substantial"), last("rows"))
    days = days.withColumns(out)
    days = days.drop(*(c for c in days.columns if c.startswith(("__last_", "__back_"))))
    return days.withColumn("trend_5_vs_20_missed_ratio", F.col("roll_5d_missed_ratio") - F.col("roll_20d_missed_ratio"))


def with_streaks(days: DataFrame) -> DataFrame:
    """Rows in a row with a miss, and rows since the last one, over the student's whole history."""
    days = days.withColumn("__row", F.row_number().over(day_order()))
    w, out = to_date_frame(), {}
    for kind, flag, since in (("substantial", F.col("daily_any_substantial_miss"), "substantial_miss"), ("ogiltig", F.col("daily_ogiltig_missed_minutes") > 0, "ogiltig_miss")):
        out[f"{kind}_streak_days"] = F.col("__row") - X.zero(F.max(F.when(~flag, F.col("__row"))).over(w))
        out[f"school_days_since_{since}"] = F.col("__row") - F.max(F.when(flag, F.col("__row"))).over(w)
    return days.withColumns(out).drop("__row")


def with_term_to_date(days: DataFrame) -> DataFrame:
    w = to_date_frame("term_id")
    sums = {f"term_cumulative_{m}": F.sum(f"daily_{m}").over(w) for m in ("missed_minutes", "recorded_minutes", "giltig_missed_minutes", "ogiltig_missed_minutes")}
    days = days.withColumns(sums)
    total = F.col("term_cumulative_recorded_minutes")
    return days.withColumns({f"term_cumulative_{k}_ratio": X.safe_divide(F.col(f"term_cumulative_{m}"), total) for k, m in (("missed", "missed_minutes"), ("giltig", "giltig_missed_minutes"), ("ogiltig", "ogiltig_missed_minutes"))})


def with_term_progress(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Term length from the calendar as given: not deduplicated, closed days included."""
    terms = calendar.groupBy("school_id", "term_id").agg(F.max("school_day_index").alias("term_total_school_days"))
    days = days.join(terms, ["school_id", "term_id"], "left")
    return days.withColumns({
        "term_days_remaining": F.col("term_total_school_days") - F.col("school_day_index"),
        "term_progress_ratio": X.safe_divide(F.col("school_day_index"), F.col("term_total_school_days")),
    })


def with_prior_year(days: DataFrame) -> DataFrame:
    """Ratios of the whole school year before, by a range frame over a student's years; null without one."""
    start = F.substring_index("academic_year", "/", 1).cast("int")
    before = Window.partitionBy("student_id").orderBy("__year").rangeBetween(-1, -1)
    days = days.withColumns({"__year": start, "__new_date": (~F.col("date").eqNullSafe(F.lag("date").over(day_order()))).cast("int")})
    total = lambda c: F.sum(c).over(before)
    recorded = total("daily_recorded_minutes")
    days = days.withColumns({
        "prior_year_missed_ratio": X.safe_divide(total("daily_missed_minutes"), recorded),
        "prior_year_giltig_ratio": X.safe_divide(total("daily_giltig_missed_minutes"), recorded),
        "prior_year_ogiltig_ratio": X.safe_divide(total("daily_ogiltig_missed_minutes"), recorded),
        "prior_year_substantial_day_rate": X.safe_divide(total(F.col("daily_any_substantial_miss").cast("int")), total("__new_date")),
        "previous_academic_year": X.previous_academic_year(F.col("academic_year")),
    })
    return days.drop("__year", "__new_date").withColumn("has_prior_year_history", F.col("prior_year_missed_ratio").isNotNull().cast("int"))


def student_day(lessons: DataFrame, calendar: DataFrame) -> DataFrame:
    days = day_totals(lessons).transform(with_rolling).transform(with_streaks).transform(with_term_to_date)
    return days.transform(with_prior_year).transform(with_term_progress, calendar)


def with_common(days: DataFrame) -> DataFrame:
    return days.withColumns({"grade_numeric": X.number(F.col("grade")), "weekday_name": X.weekday_name(F.col("date"))})
