"""All queries of the library and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .functions import expressions as X
from .functions import features as C
from .ml.additive import Shape
from .ml.encode import Encoder, fit_encoder
from .ml.models import Model, certificate, fit_calibrators, fit_candidate, group_means, permutation_importance
from .names import VALIDITY
from .operators import days, lessons, metrics, sampling
from .operators.asof import asof_join
from .oracles import sql
from .plans import tasks
from .plans.prepare import Prepared, prepare
from .plans.scoring import ClassScoring
from .sources import derived, files
from .sources.contracts import conform, contract_violations
from .sources.shared import shared_folder, written

DAY = ["student_id", "date"]
LESSON = ["student_id", "date", "lesson_id"]
_STRINGS = {"student_id", "school_id", "class_id", "grade", "stage", "term_id", "academic_year", "previous_academic_year", "lesson_id", "subject", "lesson_time_bin", "weekday_name", VALIDITY, "years", "split", "next_school_day_weekday_name", *C.EXTRA_CATEGORICAL["lesson"], "feature_group"}
_DATES = {"date", "score_date", "target_date"}
_FLAGS = {"has_attendance_record", "substantial_miss", "partial_miss", "is_giltig", "is_ogiltig", "registration_missing", "daily_any_substantial_miss", "registration_complete", "is_instructional_day", "future_horizon_complete"}
_TIMES = {"scheduled_start_at", "record_created_at", "record_updated_at"}


def _plain(c: str) -> bool:
    return c in _STRINGS | _DATES | _FLAGS | _TIMES


def _rounded(x: Column) -> Column:
    """To nine places, halves away from zero; only numbers too large for whole billionths need decimal arithmetic (``+ 0.0`` makes -0.0 the 0.0 that rounding gives)."""
    billionths = F.signum(x) * F.floor(F.abs(x) * 1e9 + 0.5) / F.lit(1e9)
    return F.when(x == F.rint(x), x + 0.0).when(F.abs(x) < 4e6, billionths + 0.0).otherwise(F.round(x, 9))


def out(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns in the types both engines agree on: numbers as doubles of nine places."""
    return df.select(*(F.col(c) if _plain(c) else _rounded(F.col(f"`{c}`").cast("double")).alias(c) for c in dict.fromkeys(cols)))


def select(cols: list[str], frm: str) -> str:
    return "SELECT " + ", ".join(f"{c}" if _plain(c) else f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in dict.fromkeys(cols)) + f" FROM {frm}"


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def add(name: str, build: Callable[[SparkSession, str], DataFrame], cols: list[str], frm: str | None = None, which: str = "has_attendance_record", raw: str | None = None) -> None:
    """Register a query; ``frm`` is what its SQL selects from, ``raw`` a final SELECT of its own."""
    _QUERIES[name] = lambda spark, d: out(build(spark, d), cols)
    if frm or raw:
        _SQL[name] = sql(raw or select(cols, frm), which)


def inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return derived.attendance_events(spark, d), derived.student_schedule(spark, d), derived.school_calendar(spark, d)


def lesson_rows(spark: SparkSession, d: str) -> DataFrame:
    attendance, schedule, calendar = inputs(spark, d)
    return lessons.lesson_frame(attendance, schedule, written(calendar, "calendar"))


def prepared(spark: SparkSession, d: str) -> Prepared:
    """The calendar, small and read by several frames, is derived once."""
    attendance, schedule, calendar = inputs(spark, d)
    return prepare(attendance, schedule, written(calendar, "calendar"))


def day_rows(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d).student_day


_SCHEDULE = ["school_id", "class_id", "grade", "lesson_id", "subject", "scheduled_start_at", "scheduled_minutes"]
_ATTENDANCE = [*_SCHEDULE, "term_id", "attended_minutes", "missed_minutes", VALIDITY, "record_created_at", "record_updated_at"]
_CALENDAR = ["school_id", "date", "term_id", "is_instructional_day", "school_day_index"]
add("contract_attendance", derived.attendance_events, [*DAY, *_ATTENDANCE], "att0")
add("contract_schedule", derived.student_schedule, [*DAY, *_SCHEDULE], "sched")
add("contract_calendar", derived.school_calendar, _CALENDAR, "cal")
add("dedup_latest_attendance", lambda s, d: lessons.dedup_attendance(derived.attendance_events(s, d)), [*DAY, *_ATTENDANCE], "att")
add("dedup_schedule", lambda s, d: lessons.dedup_schedule(derived.student_schedule(s, d)), [*DAY, *_SCHEDULE], "(SELECT DISTINCT * FROM sched)")
add("dedup_calendar", lambda s, d: lessons.dedup_calendar(derived.school_calendar(s, d)), _CALENDAR, "cal")


def _repeats(df: DataFrame, where: str, **other: str) -> DataFrame:
    """Rows of ``df``, and those of ``where`` once more with other values and once as they are."""
    again = df.where(where)
    return df.unionByName(again.withColumns({c: F.expr(x) for c, x in other.items()})).unionByName(again)


add("dedup_schedule_repeats", lambda s, d: lessons.dedup_schedule(_repeats(derived.student_schedule(s, d), "subject = 'SUBJ1'", subject="'SUBJ0'")), [*DAY, *_SCHEDULE],
    frm="""(SELECT * FROM (SELECT * FROM sched UNION ALL SELECT * REPLACE ('SUBJ0' AS subject) FROM sched WHERE subject = 'SUBJ1' UNION ALL SELECT * FROM sched WHERE subject = 'SUBJ1')
      QUALIFY row_number() OVER (PARTITION BY student_id, school_id, class_id, grade, date, lesson_id ORDER BY scheduled_minutes DESC NULLS LAST, scheduled_start_at DESC NULLS LAST, subject DESC NULLS LAST) = 1)""")  # fmt: skip
add("dedup_calendar_repeats", lambda s, d: lessons.dedup_calendar(_repeats(derived.school_calendar(s, d), "school_id = 'SCH1'", is_instructional_day="NOT is_instructional_day", term_id="'other'")), _CALENDAR,
    frm="""(SELECT * FROM (SELECT * FROM cal UNION ALL SELECT * REPLACE ('other' AS term_id, NOT is_instructional_day AS is_instructional_day) FROM cal WHERE school_id = 'SCH1' UNION ALL SELECT * FROM cal WHERE school_id = 'SCH1')
      QUALIFY row_number() OVER (PARTITION BY school_id, date ORDER BY is_instructional_day DESC, school_day_index DESC NULLS LAST, term_id DESC) = 1)""")  # fmt: skip


def _csv_schedule(spark, d):
    """The schedule written as csv, read as strings, checked and typed by the contract."""
    path = f"{shared_folder(spark)}/schedule_{uuid.uuid4().hex}.csv"
    files.write_frame(derived.student_schedule(spark, d), path)
    return conform("student_schedule", files.load_table(spark, path))


def _feature_table(spark, d):
    """The term dataset written as a feature table and read again for two school years."""
    path = files.write_feature_table(tasks.chronic(prepared(spark, d), 0.20).frame, f"{shared_folder(spark)}/features_{uuid.uuid4().hex}", "chronic_20")
    return tasks.filter_years(spark.read.parquet(path), ["1994/95", "1996/97"])


add("csv_round_trip", _csv_schedule, [*DAY, *_SCHEDULE], "sched")
add("lesson_frame", lesson_rows, [*LESSON, *_SCHEDULE, "term_id", "is_instructional_day", "school_day_index", "academic_year", "stage", "attended_minutes", "missed_minutes", VALIDITY, "has_attendance_record", "lesson_start_minutes", "lesson_time_bin", "weekday", "miss_share", "substantial_miss", "partial_miss", "is_giltig", "is_ogiltig", "registration_missing"], "lesson")
add("lesson_flags", lesson_rows, [*LESSON, "substantial_miss", "partial_miss", "is_giltig", "is_ogiltig", "registration_missing"], "lesson")
add("minutes_inference", lesson_rows, [*LESSON, "has_attendance_record", "attended_minutes", "missed_minutes", "miss_share"], "lesson")
add("grade_stage", lambda s, d: derived.student_schedule(s, d).select("grade").distinct().withColumns({"stage": X.grade_to_stage(F.col("grade")), "grade_numeric": X.number(F.col("grade"))}), ["grade", "stage", "grade_numeric"],
    raw="SELECT DISTINCT grade, CASE WHEN grade IN ('F','1','2','3') THEN 'F-3' WHEN grade IN ('4','5','6') THEN '4-6' ELSE '7-9' END AS stage, round(TRY_CAST(grade AS DOUBLE), 9) AS grade_numeric FROM sched")
add("academic_year_labels", lambda s, d: derived.student_schedule(s, d).select("date").distinct().withColumn("academic_year", X.academic_year(F.col("date"))).withColumn("previous_academic_year", X.previous_academic_year(F.col("academic_year"))), ["date", "academic_year", "previous_academic_year"],
    raw="SELECT DISTINCT date, printf('%d/%02d', year(date - INTERVAL 7 MONTH), (year(date - INTERVAL 7 MONTH) + 1) % 100) AS academic_year, printf('%d/%02d', year(date - INTERVAL 7 MONTH) - 1, year(date - INTERVAL 7 MONTH) % 100) AS previous_academic_year FROM sched")
add("weekday_names", lambda s, d: derived.student_schedule(s, d).select("date").distinct().withColumns({"weekday": F.weekday("date"), "weekday_name": X.weekday_name(F.col("date"))}), ["date", "weekday", "weekday_name"],
    raw="SELECT DISTINCT date, CAST(isodow(date) - 1 AS DOUBLE) AS weekday, lower(dayname(date)) AS weekday_name FROM sched")
add("safe_ratio", lambda s, d: day_rows(s, d).select(*DAY, X.safe_divide(F.col("daily_missed_minutes"), F.col("daily_recorded_minutes")).alias("ratio")), [*DAY, "ratio"], "(SELECT *, daily_missed_ratio AS ratio FROM day2)")
_TOTALS = ["total_scheduled_lessons", "total_scheduled_minutes", "first_lesson_start", "last_lesson_start", "subject_count", "morning_lessons", "afternoon_lessons"]
add("schedule_day", lambda s, d: days.schedule_day(lesson_rows(s, d)), [*days.DAY_KEYS, *_TOTALS, *C.GROUPS["calendar"]], "sday")
add("calendar_gaps", lambda s, d: days.schedule_day(lesson_rows(s, d)), [*DAY, *C.GROUPS["calendar"]], "sday")
_DAILY = [*C.GROUPS["daily_raw"], "daily_partial_miss_lessons", "daily_any_substantial_miss"]
add("daily_attendance", lambda s, d: days.day_totals(lesson_rows(s, d)), [*DAY, *_DAILY], "day2")
add("validity_minutes", lambda s, d: days.day_totals(lesson_rows(s, d)), [*DAY, "daily_giltig_missed_minutes", "daily_ogiltig_missed_minutes"], "day2")
add("registration_complete", lambda s, d: days.day_totals(lesson_rows(s, d)), [*DAY, "registration_complete"], "day2")
_ROLL = C.GROUPS["rolling_short"] + C.GROUPS["rolling_long"]
add("rolling_ratios", lambda s, d: days.with_rolling(days.day_totals(lesson_rows(s, d))), [*DAY, *(c for c in _ROLL if c.endswith(("missed_ratio", "giltig_ratio")))], "sd")
add("rolling_means", lambda s, d: days.with_rolling(days.day_totals(lesson_rows(s, d))), [*DAY, *(c for c in _ROLL if c.endswith(("partial_ratio", "day_rate")))], "sd")
add("trend", lambda s, d: days.with_rolling(days.day_totals(lesson_rows(s, d))), [*DAY, "trend_5_vs_20_missed_ratio"], "sd")
add("streaks", lambda s, d: days.with_streaks(days.day_totals(lesson_rows(s, d))), [*DAY, *C.GROUPS["streaks"][:2]], "streak")
add("days_since", lambda s, d: days.with_streaks(days.day_totals(lesson_rows(s, d))), [*DAY, *C.GROUPS["streaks"][2:]], "streak")
add("term_cumulative", lambda s, d: days.with_term_to_date(days.day_totals(lesson_rows(s, d))), [*DAY, "term_id", *C.GROUPS["term_cumulative"], *(f"term_cumulative_{x}_minutes" for x in ("missed", "recorded", "giltig_missed", "ogiltig_missed"))], "sd")
add("term_progress", day_rows, [*DAY, "term_total_school_days", "term_days_remaining", "term_progress_ratio"], "sd")
add("prior_year", day_rows, [*DAY, "previous_academic_year", *C.GROUPS["prior_year"]], "sd")
add("student_day", day_rows, [*days.DAY_KEYS, *_TOTALS, *C.GROUPS["calendar"], *_DAILY, *_ROLL, *C.GROUPS["streaks"], *C.GROUPS["trend"], *C.GROUPS["term_cumulative"], *C.GROUPS["prior_year"], "term_days_remaining", "term_progress_ratio", "registration_complete"], "sd")
_SHORT = ["future_horizon_complete", "target_short_horizon", *C.GROUPS["schedule_future"], *C.GROUPS["schedule_next_day"], "next_school_day_weekday_name"]
add("short_horizon_frame", lambda s, d: tasks.short_horizon_frame(day_rows(s, d), 5), [*DAY, *_SHORT], "short")
add("next_school_day", lambda s, d: tasks.short_horizon_frame(day_rows(s, d), 5), [*DAY, *C.GROUPS["schedule_next_day"], "next_school_day_weekday_name"], "short")


def _task_columns(name: str) -> list[str]:
    return list(dict.fromkeys([*C.id_columns(name), C.target_of(name), *sum(C.resolve(C.DEFAULT_GROUPS[name], name), [])]))


add("short_horizon_dataset", lambda s, d: tasks.short_horizon(prepared(s, d)).frame, _task_columns("short_horizon"), "short WHERE future_horizon_complete")
for _k, _t in ((10, 0.10), (20, 0.20)):
    add(f"chronic_{_k}", lambda s, d, t=_t: tasks.chronic(prepared(s, d), t).frame, _task_columns(f"chronic_{_k}"), "chronic")
    add(f"chronic_year_{_k}", lambda s, d, t=_t: tasks.chronic_year(prepared(s, d), t).frame, _task_columns(f"chronic_year_{_k}"), "chronic_year")
add("feature_table_round_trip", _feature_table, _task_columns("chronic_20"), "chronic WHERE academic_year IN ('1994/95', '1996/97')")
add("year_cumulative", lambda s, d: tasks.year_to_date(day_rows(s, d)), [*DAY, "year_cumulative_missed_ratio", "gap_to_year_10pct", "gap_to_year_20pct", "year_school_days_elapsed"], "chronic_year")
add("term1_finals", lambda s, d: tasks.with_term1_actuals(tasks.year_to_date(day_rows(s, d))), [*DAY, "is_term2", *(f"term1_actual_{k}_ratio" for k in ("missed", "giltig", "ogiltig"))], "chronic_year")
add("year_calendar", lambda s, d: tasks.year_calendar(derived.school_calendar(s, d)), ["school_id", "academic_year", "year_total_school_days"], raw="SELECT school_id, printf('%d/%02d', y0, (y0 + 1) % 100) AS academic_year, round(CAST(year_total_school_days AS DOUBLE), 9) AS year_total_school_days FROM year_cal")
_TARGET = ["target_scheduled_minutes", "target_lesson_start_minutes", *C.EXTRA_CATEGORICAL["lesson"]]
for _s, _by in tasks.SLOTS.items():
    _hist = [f"hist_{_s}_lesson_count", f"hist_{_s}_substantial_rate"]
    _name = {"subject_weekday_timebin": "combined"}.get(_s, _s)
    add(f"slot_history_{_name}", lambda s, d, slot=_s: tasks.slot_history(lesson_rows(s, d), slot), ["student_id", *_by, "date", *_hist], f"slot_{_s}")

    def _asof(s, d, slot=_s):
        p = prepared(s, d).stored_lessons()
        frame = tasks.expand_lessons(p.lesson_frame, p.student_day, 5)
        history = tasks.slot_history(p.lesson_frame, slot).withColumnsRenamed({c: f"target_{c}" for c in tasks.SLOTS[slot]})
        return asof_join(frame, history, ["student_id", *(f"target_{c}" for c in tasks.SLOTS[slot])], "score_date", "date", [f"hist_{slot}_lesson_count", f"hist_{slot}_substantial_rate"], 0.0)

    add(f"asof_{_name}", _asof, [*LESSON, "score_date", *_hist], "asof_subject_weekday_timebin")
add("lesson_expand", lambda s, d: (lambda p: tasks.expand_lessons(p.lesson_frame, p.student_day, 5))(prepared(s, d).stored_lessons()), [*LESSON, "score_date", "horizon_school_days", "target_label", "roll_5d_missed_ratio"], "expanded")
add("lesson_day_flags", lambda s, d: tasks.with_target_flags(lesson_rows(s, d).where("has_attendance_record")), [*LESSON, *_TARGET], "flags")
add("lesson_dataset", lambda s, d: tasks.lesson(prepared(s, d).stored()).frame, _task_columns("lesson"), "asof_subject_weekday_timebin")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Classes to score: every class on the 3rd, 10th, 17th and 24th of each month, where these are school days."""
    days_ = derived.student_schedule(spark, d).where("weekday(date) < 5 AND day(date) IN (3, 10, 17, 24)")
    return days_.select("school_id", "class_id", F.col("date").alias("as_of")).distinct()


def _score(kind: str):
    def build(spark, d):
        p = prepared(spark, d).stored_lessons()  # read for the cohort and for its lessons
        scoring = ClassScoring(p.lesson_frame, p.calendar, written(_requests(spark, d), "requests"), pieces=p.pieces)
        return getattr(scoring.stored() if kind == "lesson" else scoring, kind)()

    return build


def _score_columns(task: str) -> list[str]:
    ids = ["student_id", "school_id", "class_id", "grade", "stage"]
    return list(dict.fromkeys([*ids, *(["score_date", "target_date", "lesson_id"] if task == "lesson" else ["date"]), *sum(C.resolve(C.DEFAULT_GROUPS[task], task), [])]))


_TODAY = "day(date) IN (3, 10, 17, 24)"
add("score_short_horizon", _score("short_horizon"), _score_columns("short_horizon"), f"short WHERE {_TODAY}")
add("score_chronic", _score("chronic"), _score_columns("chronic_10"), f"chronic WHERE {_TODAY}")
add("score_chronic_year", _score("chronic_year"), _score_columns("chronic_year_10"), f"chronic_year WHERE {_TODAY}")
add("score_lesson", _score("lesson"), _score_columns("lesson"), f"(SELECT *, date AS target_date FROM asof_subject_weekday_timebin) x WHERE (student_id, score_date) IN (SELECT (student_id, date) FROM sd WHERE {_TODAY})", which="TRUE")


def _scored_days(spark, d):
    """Chronic rows with a stand-in score: the missed ratio of the last 20 days, 0 where unknown."""
    return tasks.chronic(prepared(spark, d), 0.10).frame.withColumn("score", F.coalesce(F.round("roll_20d_missed_ratio", 9), F.lit(0.0)))


_SCORED = "(SELECT *, coalesce(round(roll_20d_missed_ratio, 9), 0) AS score, target_chronic_10 AS y FROM chronic) "
_IDS = ["date", "student_id", "lesson_id"]
add("split_by_year", lambda s, d: day_rows(s, d).withColumn("split", F.when(F.col("academic_year").isin("1994/95", "1995/96", "1996/97"), "train").when(F.col("academic_year") == "1997/98", "validation").when(F.col("academic_year") == "1998/99", "test")).where("split IS NOT NULL"), [*DAY, "academic_year", "split"],
    raw="SELECT student_id, date, academic_year, CASE WHEN y0 < 1997 THEN 'train' WHEN y0 = 1997 THEN 'validation' ELSE 'test' END AS split FROM sd WHERE y0 <= 1998")
add("binary_metrics", lambda s, d: metrics.basics(_scored_days(s, d), "target_chronic_10", "score"), ["row_count", "positive_rate", "brier"],
    raw=f"SELECT round(CAST(count(*) AS DOUBLE), 9) AS row_count, round(avg(y), 9) AS positive_rate, round(avg((score - y) * (score - y)), 9) AS brier FROM {_SCORED} x")
add("brier", lambda s, d: metrics.basics(_scored_days(s, d), "target_chronic_10", "score", ["stage"]), ["stage", "brier"], raw=f"SELECT stage, CASE WHEN count(DISTINCT y) > 1 THEN round(avg((score - y) * (score - y)), 9) END AS brier FROM {_SCORED} x GROUP BY stage")
add("precision_at_k", lambda s, d: metrics.precision_at(_scored_days(s, d), "target_chronic_10", "score", 0.05, DAY), ["precision"],
    raw=f"SELECT round(avg(y), 9) AS precision FROM (SELECT y, row_number() OVER (ORDER BY score DESC, student_id, date) AS r, count(*) OVER () AS n FROM {_SCORED} x) WHERE r <= greatest(1, ceil(n * 0.05))")
_AP = "SELECT {g}CASE WHEN max(pos) < max(tot) THEN round(sum(p / pos * tp / alln), 9) END AS pr_auc FROM (SELECT *, sum(n) OVER (PARTITION BY g) AS tot, sum(p) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY g ORDER BY score DESC) AS alln, sum(p) OVER (PARTITION BY g) AS pos FROM (SELECT {by} AS g, score, sum(y) AS p, count(*) AS n FROM " + _SCORED + " x GROUP BY ALL)) GROUP BY ALL"
add("average_precision", lambda s, d: metrics.average_precision(_scored_days(s, d), "target_chronic_10", "score"), ["pr_auc"], raw=_AP.format(g="", by="1"))
add("stage_metrics", lambda s, d: metrics.group_metrics(_scored_days(s, d), "stage", "target_chronic_10", "score", [0.05], DAY), ["stage", "row_count", "positive_rate", "brier", "pr_auc", "precision_at_0.05"],
    raw=f"""SELECT stage, round(CAST(count(*) AS DOUBLE), 9) AS row_count, round(avg(y), 9) AS positive_rate, CASE WHEN count(DISTINCT y) > 1 THEN round(avg((score - y) * (score - y)), 9) END AS brier, any_value(a.pr_auc) AS pr_auc,
      round(avg(y) FILTER (r <= greatest(1, ceil(n * 0.05))), 9) AS "precision_at_0.05"
      FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, student_id, date) AS r, count(*) OVER (PARTITION BY stage) AS n FROM {_SCORED} x) x
      JOIN ({_AP.format(g='g AS stage, ', by='stage')}) a USING (stage) GROUP BY stage HAVING count(*) >= 25""")  # fmt: skip


def _scored_lessons(spark, d):
    """The lesson dataset with a stand-in score: the rate of the combined slot history."""
    return tasks.lesson(prepared(spark, d).stored()).frame.withColumn("score", F.round("hist_subject_weekday_timebin_substantial_rate", 6))


_LESSONS = "(SELECT *, round(hist_subject_weekday_timebin_substantial_rate, 6) AS score FROM asof_subject_weekday_timebin)"
_LSUM = f"(SELECT date, school_id, class_id, lesson_id, round(sum(score), 6) AS e, sum(target_label) AS a FROM {_LESSONS} GROUP BY ALL)"


def _lesson_totals(spark, d):
    return metrics.lesson_totals(_scored_lessons(spark, d), "score", "target_label").withColumn("expected_missed", F.round("expected_missed", 6))


add("lesson_aggregate_metrics", lambda s, d: metrics.lesson_metrics(_lesson_totals(s, d), [0.05]), ["lesson_count", "rank_correlation", "mae_expected_missed", "lesson_hit_rate_at_0.05"],
    raw=f"""SELECT round(CAST(count(*) AS DOUBLE), 9) AS lesson_count, round(corr(re, ra), 9) AS rank_correlation, round(avg(abs(e - a)), 9) AS mae_expected_missed,
      round(count(*) FILTER (pe <= k AND pa <= k) / any_value(k), 9) AS "lesson_hit_rate_at_0.05"
      FROM (SELECT *, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS re, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
        row_number() OVER (ORDER BY e DESC, date, school_id, class_id, lesson_id) AS pe, row_number() OVER (ORDER BY a DESC, date, school_id, class_id, lesson_id) AS pa, ceil(count(*) OVER () * 0.05) AS k FROM {_LSUM})""")  # fmt: skip
add("expected_missed", lambda s, d: metrics.expected_missed(_scored_lessons(s, d).withColumnRenamed("date", "target_date"), "score"), ["target_date", "lesson_id", "target_subject", "target_lesson_start_minutes", "lesson_expected_missed"],
    raw=f"SELECT date AS target_date, lesson_id, target_subject, round(CAST(target_lesson_start_minutes AS DOUBLE), 9) AS target_lesson_start_minutes, round(sum(score), 9) AS lesson_expected_missed FROM {_LESSONS} WHERE target_lesson_start_minutes IS NOT NULL AND target_subject IS NOT NULL GROUP BY ALL")
add("feature_summary", lambda s, d: files.feature_summary(tasks.chronic(prepared(s, d), 0.10).frame, "target_chronic_10"), ["row_count", "positive_rate", "years"],
    raw="SELECT round(CAST(count(*) AS DOUBLE), 9) AS row_count, round(avg(target_chronic_10), 9) AS positive_rate, string_agg(DISTINCT academic_year, ',' ORDER BY academic_year) AS years FROM chronic")
_DRAW = "md5(student_id || '|' || strftime(date, '%Y-%m-%d') || '|' || '42')"


def _kept(task: tasks.Task, *more: str) -> DataFrame:
    """Key columns and target of a task's rows, written once, as a draw reads them several times."""
    return written(task.frame.select(*dict.fromkeys([*DAY, task.target, *more])), task.name)


add("negative_sampling", lambda s, d: sampling.sample_negatives(_kept(tasks.short_horizon(prepared(s, d))), "target_short_horizon", 0.25, DAY, 42), [*DAY, "target_short_horizon"],
    raw=f"SELECT student_id, date, round(CAST(target_short_horizon AS DOUBLE), 9) AS target_short_horizon FROM (SELECT *, row_number() OVER (PARTITION BY target_short_horizon ORDER BY {_DRAW}, student_id, date) AS r, sum(target_short_horizon) OVER () AS p FROM short WHERE future_horizon_complete) WHERE target_short_horizon = 1 OR r <= floor(p * 0.25)")
add("row_cap", lambda s, d: (lambda f: sampling.cap_rows(f, "target_chronic_20", int(f.count() * 0.75), DAY, 42))(_kept(tasks.chronic(prepared(s, d), 0.20))), [*DAY, "target_chronic_20"],
    raw=f"SELECT student_id, date, round(CAST(target_chronic_20 AS DOUBLE), 9) AS target_chronic_20 FROM (SELECT *, row_number() OVER (PARTITION BY target_chronic_20 ORDER BY {_DRAW}, student_id, date) AS r, sum(target_chronic_20) OVER () AS p, count(*) OVER () AS n FROM chronic) WHERE target_chronic_20 = 1 OR r <= floor(n * 0.75) - p")
add("search_sample", lambda s, d: sampling.sample_fraction(_kept(tasks.chronic(prepared(s, d), 0.20)), 0.5, DAY, 42), DAY,
    raw=f"SELECT student_id, date FROM (SELECT *, row_number() OVER (ORDER BY {_DRAW}, student_id, date) AS r, count(*) OVER () AS n FROM chronic) WHERE r <= floor(n * 0.5 + 0.5)")


#: A fixed model, so that the exported SQL and the expression can be held against each other.
_FIXED = Model("chronic_10", "logistic", Encoder([("roll_20d_missed_ratio", 0.1, 0.2, 0.25), ("term_cumulative_missed_ratio", 0.15, 0.2, 0.2)], [("weekday_name", "monday", ["friday", "monday"])]),
    [1.5, 2.25, 0.125, -0.25], -0.5, stages={"F-3": (4.0, -2.0), "4-6": (None, 0.25)}, overall=(3.0, -1.0))
add("sql_scored_probabilities", lambda s, d: _FIXED.with_probability(tasks.chronic(prepared(s, d), 0.10).frame, "probability"), [*DAY, "probability"],
    raw="""SELECT student_id, date, round(CASE WHEN stage = 'F-3' THEN 1 / (1 + exp(-(4 * p - 2))) WHEN stage = '4-6' THEN 0.25 ELSE 1 / (1 + exp(-(3 * p - 1))) END, 9) AS probability
      FROM (SELECT *, 1 / (1 + exp(-(-0.5 + 1.5 * (coalesce(roll_20d_missed_ratio, 0.1) - 0.2) / 0.25 + 2.25 * (coalesce(term_cumulative_missed_ratio, 0.15) - 0.2) / 0.2
        + 0.125 * (CASE WHEN weekday_name = 'friday' THEN 1 ELSE 0 END) - 0.25 * (CASE WHEN weekday_name = 'monday' THEN 1 ELSE 0 END)))) AS p FROM chronic)""")  # fmt: skip
#: The same for a model of lookup tables.
_TABLES = Model("chronic_10", "ebm", Encoder([], []), intercept=-0.75, stages={"7-9": (2.0, -0.5)}, overall=(3.0, -1.0), shapes=[
    Shape("roll_20d_missed_ratio", [0.05, 0.1, 0.25], [], [-1.0, -0.25, 0.5, 1.5], -0.125), Shape("school_days_since_substantial_miss", [3.0, 10.0], [], [0.75, 0.25, -0.5], -1.0),
    Shape("weekday_name", [], ["friday", "monday"], [0.25, 0.125], 0.0)])
add("additive_probabilities", lambda s, d: _TABLES.with_probability(tasks.chronic(prepared(s, d), 0.10).frame, "probability"), [*DAY, "probability"],
    raw="""SELECT student_id, date, round(CASE WHEN stage = '7-9' THEN 1 / (1 + exp(-(2 * p - 0.5))) ELSE 1 / (1 + exp(-(3 * p - 1))) END, 9) AS probability
      FROM (SELECT *, 1 / (1 + exp(-(-0.75 + CASE WHEN r IS NULL THEN -0.125 WHEN r < 0.05 THEN -1 WHEN r < 0.1 THEN -0.25 WHEN r < 0.25 THEN 0.5 ELSE 1.5 END
        + CASE WHEN s IS NULL THEN -1 WHEN s < 3 THEN 0.75 WHEN s < 10 THEN 0.25 ELSE -0.5 END + CASE weekday_name WHEN 'friday' THEN 0.25 WHEN 'monday' THEN 0.125 ELSE 0 END))) AS p
        FROM (SELECT *, roll_20d_missed_ratio AS r, school_days_since_substantial_miss AS s FROM chronic))""")  # fmt: skip
_TRAIN, _SEEN = ["1994/95", "1995/96", "1996/97"], ["1997/98"]
_IN_TRAIN = "academic_year IN ('1994/95', '1995/96', '1996/97')"
_NUMERIC, _CATEGORICAL = C.resolve(C.DEFAULT_GROUPS["chronic_20"], "chronic_20")


def _encoder_rows(spark, d):
    """What imputation, scaling and encoding learn from the term dataset."""
    rows = written(tasks.chronic(prepared(spark, d), 0.20).frame.select(*_NUMERIC, *_CATEGORICAL), "chronic")  # read several times
    e = fit_encoder(rows, _NUMERIC, _CATEGORICAL)
    rows = [(c, m, mean, sd, None, None) for c, m, mean, sd in e.numeric] + [(c, None, None, None, mode, len(v)) for c, mode, v in e.categorical]
    return spark.createDataFrame(rows, "feature string, median double, mean double, deviation double, mode string, levels int")


_STRINGS |= {"feature", "mode", "term"}
_STATS = ", ".join(f"{{'feature': '{c}', 'm': coalesce(CAST(median({c}) AS DOUBLE), 0), 'k': count({c}), 'n': count(*), 'avg': avg(CAST({c} AS DOUBLE)), 'var': var_pop(CAST({c} AS DOUBLE))}}" for c in _NUMERIC)
_MODES = " UNION ALL ".join(f"SELECT '{c}', NULL, NULL, NULL, (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM data WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1), CAST((SELECT count(DISTINCT {c}) FROM data) AS DOUBLE)" for c in _CATEGORICAL)
add("encoder_statistics", _encoder_rows, ["feature", "median", "mean", "deviation", "mode", "levels"],
    raw=f"""SELECT * FROM (WITH data AS MATERIALIZED (SELECT * FROM chronic), s AS (SELECT unnest([{_STATS}], recursive := true) FROM data),
      t AS (SELECT *, (k * coalesce(avg, 0) + (n - k) * m) / n AS mean FROM s)
      SELECT feature, round(m, 9) AS median, round(mean, 9) AS mean, round(coalesce(nullif(sqrt((k * coalesce(var, 0) + k * (coalesce(avg, 0) - mean) ** 2 + (n - k) * (m - mean) ** 2) / n), 0), 1), 9) AS deviation,
        CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS DOUBLE) AS levels FROM t UNION ALL {_MODES})""")  # fmt: skip


def _trained(spark, d, candidate="logistic"):
    """A chronic model of the first three school years, and its task with rows written once."""
    task = tasks.chronic(prepared(spark, d), 0.20)
    task.frame = written(task.frame.where(F.col("academic_year").isin(_TRAIN + _SEEN)), "chronic")
    return fit_candidate(task.frame.where(F.col("academic_year").isin(_TRAIN)), task, candidate, 42), task


def _train_logistic(spark, d):
    model, task = _trained(spark, d)
    return model.with_raw(task.frame.where(F.col("academic_year").isin(_SEEN)))


def _certified(spark, d):
    """Whether each gradient of the fitted logistic model is zero, up to a millionth of a row's."""
    model, task = _trained(spark, d)
    rows = certificate(model, task.frame.where(F.col("academic_year").isin(_TRAIN)), task.target)
    return rows.withColumn("at_minimum", F.abs("gradient") < 1e-6)


_FLAGS.add("at_minimum")
add("logistic_certificate", _certified, ["term", "at_minimum"],
    raw=f"SELECT unnest([{', '.join(map(repr, [*_NUMERIC, 'intercept']))}]) AS term, TRUE AS at_minimum" + "".join(f" UNION ALL SELECT DISTINCT '{c}=' || {c}, TRUE FROM chronic WHERE {_IN_TRAIN} AND {c} IS NOT NULL" for c in _CATEGORICAL))


def _calibrated(spark, d):
    """Probabilities by calibrators that are fitted for each stage on a stand-in score, the missed ratio of the last 20 days."""
    rows = written(tasks.chronic(prepared(spark, d), 0.20).frame.withColumn("raw_score", F.coalesce(F.round("roll_20d_missed_ratio", 9), F.lit(0.0))), "calibrated")
    stages, overall = fit_calibrators(rows, "raw_score", "target_chronic_20", "stage")
    model = Model("chronic_20", "logistic", Encoder([], []), stages=stages, overall=overall)
    return rows.withColumn("probability", model.calibrated(F.col("raw_score"), F.col("stage")))


def _newton_sql(steps: int) -> str:
    """Newton steps of the curves of all stages, one common table expression each."""
    step = """, p{0} AS MATERIALIZED (SELECT stage, a - (w * ga - wx * gb) / (haa * w - wx * wx) AS a, b - (haa * gb - wx * ga) / (haa * w - wx * wx) AS b
      FROM (SELECT stage, a, b, sum(n * (p - y) * x) + a AS ga, sum(n * (p - y)) AS gb, sum(n * p * (1 - p)) AS w, sum(n * p * (1 - p) * x) AS wx, sum(n * p * (1 - p) * x * x) + 1 AS haa
        FROM (SELECT c.*, a, b, 1 / (1 + exp(-(a * x + b))) AS p FROM c JOIN p{1} USING (stage)) GROUP BY stage, a, b))"""
    return "p0 AS (SELECT DISTINCT stage, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM c)" + "".join(step.format(i + 1, i) for i in range(steps))


add("calibrate_by_stage", _calibrated, [*DAY, "stage", "probability"],
    raw=f"""SELECT * FROM (WITH data AS MATERIALIZED (SELECT student_id, date, stage, coalesce(round(roll_20d_missed_ratio, 9), 0) AS x, CAST(target_chronic_20 AS DOUBLE) AS y FROM chronic),
      c AS MATERIALIZED (SELECT stage, x, y, count(*) AS n FROM data GROUP BY ALL), {_newton_sql(20)}
      SELECT student_id, date, stage, round(1 / (1 + exp(-(a * x + b))), 9) AS probability FROM data JOIN p20 USING (stage))""")  # fmt: skip


def _boosted(spark, d):
    model, task = _trained(spark, d, "ebm")
    return model.with_raw(task.frame.where(F.col("academic_year").isin(_SEEN)))


def _importance(spark, d, **rows):
    return permutation_importance(_FIXED, tasks.chronic(prepared(spark, d), 0.10).frame, "target_chronic_10", DAY, **rows)


_FIXED_PARTS = {
    "roll_20d_missed_ratio": "1.5 * (coalesce(roll_20d_missed_ratio, 0.1) - 0.2) / 0.25", "term_cumulative_missed_ratio": "2.25 * (coalesce(term_cumulative_missed_ratio, 0.15) - 0.2) / 0.2",
    "weekday_name": "(0.125 * (CASE WHEN weekday_name = 'friday' THEN 1 ELSE 0 END) - 0.25 * (CASE WHEN weekday_name = 'monday' THEN 1 ELSE 0 END))",
}
_IMPORTANCE = f"""(WITH s AS MATERIALIZED (SELECT *, count(*) OVER () AS n FROM (SELECT CAST(target_chronic_10 AS DOUBLE) AS y, round(-0.5 + {' + '.join(_FIXED_PARTS.values())}, 9) AS z,
        [{', '.join(_FIXED_PARTS.values())}] AS c, row_number() OVER (ORDER BY {_DRAW}, student_id, date) AS i FROM chronic) WHERE i <= 5000),
      base AS (SELECT avg(y) AS b FROM (SELECT *, row_number() OVER (ORDER BY z DESC, i) AS k FROM s) WHERE k <= greatest(1, ceil(n * 0.05))),
      perm AS (SELECT i, r, row_number() OVER (PARTITION BY r ORDER BY md5(i || '|' || r || '|42'), i) AS j FROM s, range(1, 6) t(r)),
      swapped AS (SELECT r, f, s.i, s.y, s.n, round(s.z + o.c[f] - s.c[f], 9) AS z FROM s JOIN perm USING (i) JOIN s o ON o.i = perm.j, range(1, 4) t(f)),
      top AS (SELECT f, y FROM swapped QUALIFY row_number() OVER (PARTITION BY r, f ORDER BY z DESC, i) <= greatest(1, ceil(n * 0.05)))
      SELECT [{', '.join(map(repr, _FIXED_PARTS))}][f] AS feature, any_value(b) - avg(y) AS importance FROM top, base GROUP BY f)"""
add("train_logistic", _train_logistic, [*DAY, "raw_score"])
add("ebm_like", _boosted, [*DAY, "raw_score"])
add("permutation_importance", _importance, ["feature", "importance"], raw=f"SELECT feature, round(importance, 9) AS importance FROM {_IMPORTANCE}")
#: Of groups, over all rows.
_WHOLE = _IMPORTANCE.replace(" WHERE i <= 5000", "")
add("group_importance", lambda s, d: group_means(_importance(s, d, most=None)), ["feature_group", "importance"],
    raw=f"SELECT CASE feature {' '.join(f'WHEN {c!r} THEN {C.group_of(c)!r}' for c in _FIXED_PARTS)} END AS feature_group, round(avg(importance), 9) AS importance FROM {_WHOLE} GROUP BY 1")


def _task_totals(spark, d):
    """Rows and positive labels of all six task datasets, from frames written once."""
    found = [t.frame.agg(F.lit(n).alias("task"), F.count("*").alias("rows"), F.sum(F.col(t.target).cast("double")).alias("positives")) for n, t in tasks.all_tasks(prepared(spark, d).stored()).items()]
    return reduce(DataFrame.unionByName, found)


_STRINGS |= {"task", "table", "rule", "column"}
_TOTALS_SQL = {"short_horizon": ("target_short_horizon", "short WHERE future_horizon_complete"), "lesson": ("target_label", "asof_subject_weekday_timebin"), **{f"chronic{y}_{k}": (f"target_chronic{y}_{k}", f"chronic{y}") for y in ("", "_year") for k in (10, 20)}}
add("task_totals", _task_totals, ["task", "rows", "positives"],
    raw=" UNION ALL ".join(f"SELECT '{t}' AS task, round(CAST(count(*) AS DOUBLE), 9) AS rows, round(sum(CAST({y} AS DOUBLE)), 9) AS positives FROM {frm}" for t, (y, frm) in _TOTALS_SQL.items()))


def _violations(spark, d):
    """Contract checks of a schedule with planted faults."""
    rows = derived.student_schedule(spark, d).withColumns({
        "scheduled_minutes": F.expr("if(lesson_id LIKE '%7', 'many', string(scheduled_minutes))"), "date": F.expr("if(subject = 'SUBJ2', 'someday', string(date))"), "student_id": F.expr("if(grade = '4', NULL, student_id)"),
    })
    return contract_violations("student_schedule", rows.unionByName(rows.where("subject = 'SUBJ3'")).drop("school_id"))


add("contract_violations", _violations, ["table", "rule", "column", "rows"],
    raw="""SELECT * FROM (WITH f AS MATERIALIZED (SELECT class_id, grade, lesson_id, subject, CASE WHEN grade <> '4' THEN student_id END AS student_id, CASE WHEN subject = 'SUBJ2' THEN 'someday' ELSE CAST(date AS VARCHAR) END AS date,
        lesson_id LIKE '%7' AS many FROM (SELECT * FROM sched UNION ALL SELECT * FROM sched WHERE subject = 'SUBJ3')),
      v AS (SELECT 'missing column' AS rule, 'school_id' AS "column", count(*) AS rows FROM f UNION ALL SELECT 'failed cast', 'scheduled_minutes', count(*) FROM f WHERE many UNION ALL SELECT 'failed cast', 'date', count(*) FROM f WHERE date = 'someday'
        UNION ALL SELECT 'null key', 'student_id', count(*) FROM f WHERE student_id IS NULL UNION ALL SELECT 'null key', 'date', count(*) FROM f WHERE date = 'someday'
        UNION ALL SELECT 'repeated key', 'student_id,class_id,grade,date,lesson_id', count(*) - count(DISTINCT (student_id, class_id, grade, CASE WHEN date <> 'someday' THEN date END, lesson_id)) FROM f)
      SELECT 'student_schedule' AS "table", rule, "column", round(CAST(rows AS DOUBLE), 9) AS rows FROM v WHERE rows > 0)""")  # fmt: skip


def _log(spark, d):
    """A search log written by several runs, one file each, and read again as a table."""
    path = f"{shared_folder(spark)}/log_{uuid.uuid4().hex}.tsv"
    stages = tasks.chronic(prepared(spark, d), 0.10).frame.groupBy("stage").agg(F.count("*").alias("n"), F.avg("target_chronic_10").alias("rate")).collect()  # three stages
    for r in stages:
        reports.append_log(path, {"candidate": r["stage"], "task": "chronic_10", "feature_groups": ["daily_raw", "trend"], "train_rows": r["n"], "precision_at_0.05": round(r["rate"], 9)}, {"daily_raw": 0.25, "trend": 0.5})
    rows = reports.read_log(spark, path)
    return rows.select(F.col("candidate").alias("stage"), "task", "feature_groups", F.col("train_rows").alias("rows"), F.col("`precision_at_0.05`").alias("rate"), "top_groups")


_STRINGS |= {"feature_groups", "top_groups"}
add("log_round_trip", _log, ["stage", "task", "feature_groups", "rows", "rate", "top_groups"],
    raw="SELECT stage, 'chronic_10' AS task, 'daily_raw,trend' AS feature_groups, round(CAST(count(*) AS DOUBLE), 9) AS rows, round(avg(target_chronic_10), 9) AS rate, 'trend,daily_raw' AS top_groups FROM chronic GROUP BY stage")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Student-days, those with the highest missed ratio of the last five days first."""
    rows = _QUERIES["student_day"](spark, sf_dir)
    return rows.orderBy(F.col("roll_5d_missed_ratio").desc_nulls_last(), *DAY)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
