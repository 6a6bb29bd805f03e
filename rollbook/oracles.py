"""DuckDB SQL for the queries: one chain of common table expressions, written apart from the Spark code."""

from __future__ import annotations

from .names import VALIDITY

BASE = """
adapter AS (
  SELECT 'S' || l_suppkey AS student_id, 'SCH' || (s_nationkey % 5) AS school_id, 'C' || s_nationkey AS class_id,
    CASE WHEN l_suppkey % 10 = 0 THEN 'F' ELSE CAST(l_suppkey % 10 AS VARCHAR) END AS grade, CAST(l_shipdate AS DATE) AS date,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey AS lesson_id, 'SUBJ' || (l_partkey % 6) AS subject,
    l_shipdate + to_hours(7 + l_linenumber) AS start_at, l_shipdate + INTERVAL 15 HOUR AS created_at,
    l_shipdate + INTERVAL 16 HOUR AS updated_at, l_shipdate + INTERVAL 40 HOUR AS corrected_at,
    CAST(40 + 5 * (l_linenumber % 3) AS DOUBLE) AS sched_min,
    CAST(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_quantity >= 26 + 3 * (l_suppkey % 8) THEN 40 + 5 * (l_linenumber % 3)
         WHEN l_quantity >= 20 + 3 * (l_suppkey % 8) THEN 15 ELSE 0 END AS DOUBLE) AS miss_min,
    CASE l_returnflag WHEN 'R' THEN 'ogiltig' WHEN 'A' THEN 'giltig' ELSE 'present' END AS validity,
    CAST(year(l_shipdate) - CASE WHEN month(l_shipdate) < 8 THEN 1 ELSE 0 END AS VARCHAR) || CASE WHEN month(l_shipdate) < 8 THEN '_VT' ELSE '_HT' END AS term_id,
    l_tax < CAST(0.075 AS DOUBLE) AS recorded, l_discount >= CAST(0.095 AS DOUBLE) AS corrected, l_orderkey AS ok
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
sched AS (
  SELECT student_id, school_id, class_id, grade, date, lesson_id, CASE WHEN ok % 89 <> 0 THEN subject END AS subject,
    CASE WHEN ok % 97 <> 0 THEN start_at END AS scheduled_start_at, sched_min AS scheduled_minutes FROM adapter),
att0 AS (
  SELECT student_id, school_id, class_id, grade, term_id, date, lesson_id, subject, CASE WHEN ok % 97 <> 0 THEN start_at END AS scheduled_start_at,
    sched_min AS scheduled_minutes, CASE WHEN ok % 53 <> 0 AND ok % 59 <> 0 THEN sched_min - miss_min END AS attended_minutes,
    CASE WHEN ok % 53 <> 0 THEN miss_min END AS missed_minutes, validity AS {validity}, created_at AS record_created_at,
    CASE WHEN ok % 211 <> 0 THEN updated_at END AS record_updated_at FROM adapter WHERE recorded
  UNION ALL
  SELECT student_id, school_id, class_id, grade, term_id, date, lesson_id, subject, start_at, sched_min, sched_min, 0.0, 'present', created_at, corrected_at
  FROM adapter WHERE recorded AND corrected),
att AS (
  SELECT * FROM att0 QUALIFY row_number() OVER (PARTITION BY student_id, school_id, class_id, grade, date, lesson_id ORDER BY record_updated_at DESC NULLS FIRST) = 1),
cal AS (
  SELECT school_id, date, term_id, isodow(date) < 6 AS is_instructional_day,
    sum(CASE WHEN isodow(date) < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY school_id, term_id ORDER BY date) AS school_day_index
  FROM (SELECT DISTINCT school_id, date, term_id FROM adapter) WHERE day(date) <> 13),
joined AS (
  SELECT s.student_id, s.school_id, s.class_id, s.grade, s.date, s.lesson_id, coalesce(c.term_id, a.term_id) AS term_id, coalesce(s.subject, a.subject) AS subject,
    coalesce(s.scheduled_start_at, a.scheduled_start_at) AS scheduled_start_at, coalesce(s.scheduled_minutes, a.scheduled_minutes) AS scheduled_minutes,
    c.school_day_index, coalesce(c.is_instructional_day, TRUE) AS is_instructional_day, a.attended_minutes AS att_raw, a.missed_minutes AS miss_raw,
    coalesce(a.{validity}, '') AS v, a.{validity}, a.record_updated_at IS NOT NULL AS has_attendance_record
  FROM sched s LEFT JOIN cal c ON s.school_id = c.school_id AND s.date = c.date
  LEFT JOIN att a ON (s.student_id, s.school_id, s.class_id, s.grade, s.date, s.lesson_id) = (a.student_id, a.school_id, a.class_id, a.grade, a.date, a.lesson_id)),
minutes AS (
  SELECT *, CASE WHEN NOT has_attendance_record THEN NULL WHEN miss_raw IS NOT NULL THEN miss_raw
      WHEN scheduled_minutes - coalesce(att_raw, 0) > 0 THEN scheduled_minutes - coalesce(att_raw, 0) ELSE 0 END AS missed_minutes
  FROM joined WHERE is_instructional_day),
lesson AS (
  SELECT *, CASE WHEN NOT has_attendance_record THEN NULL WHEN att_raw IS NOT NULL THEN att_raw
      WHEN scheduled_minutes > missed_minutes THEN scheduled_minutes - missed_minutes ELSE 0 END AS attended_minutes,
    year(date) - (CASE WHEN month(date) < 8 THEN 1 ELSE 0 END) AS y0,
    printf('%d/%02d', year(date) - (CASE WHEN month(date) < 8 THEN 1 ELSE 0 END), (year(date) + (CASE WHEN month(date) < 8 THEN 0 ELSE 1 END)) % 100) AS academic_year,
    hour(scheduled_start_at) * 60 + minute(scheduled_start_at) AS lesson_start_minutes,
    CASE WHEN scheduled_start_at IS NULL THEN 'unknown' WHEN hour(scheduled_start_at) < 9 THEN 'before_09' WHEN hour(scheduled_start_at) < 11 THEN '09_11'
      WHEN hour(scheduled_start_at) < 13 THEN '11_13' ELSE 'after_13' END AS lesson_time_bin,
    CASE WHEN grade IN ('F', '0', '1', '2', '3') THEN 'F-3' WHEN grade IN ('4', '5', '6') THEN '4-6' WHEN grade IN ('7', '8', '9') THEN '7-9' ELSE 'UNKNOWN' END AS stage,
    isodow(date) - 1 AS weekday, lower(dayname(date)) AS weekday_name, missed_minutes / nullif(scheduled_minutes, 0) AS miss_share,
    coalesce(missed_minutes / nullif(scheduled_minutes, 0) >= 0.5, FALSE) AS substantial_miss,
    coalesce(missed_minutes > 0 AND missed_minutes / nullif(scheduled_minutes, 0) < 0.5, FALSE) AS partial_miss,
    v = 'giltig' AS is_giltig, v = 'ogiltig' AS is_ogiltig, NOT has_attendance_record AS registration_missing
  FROM minutes),
sday0 AS (
  SELECT student_id, school_id, class_id, grade, stage, date, term_id, academic_year, y0, school_day_index, count(*) AS total_scheduled_lessons,
    coalesce(sum(scheduled_minutes), 0) AS total_scheduled_minutes, min(lesson_start_minutes) AS first_lesson_start, max(lesson_start_minutes) AS last_lesson_start,
    count(DISTINCT subject) AS subject_count, count(*) FILTER (lesson_start_minutes < 720) AS morning_lessons, count(*) FILTER (lesson_start_minutes >= 720) AS afternoon_lessons
  FROM lesson WHERE term_id IS NOT NULL AND school_day_index IS NOT NULL GROUP BY ALL),
sday AS (
  SELECT *, date - lag(date) OVER w AS calendar_days_since_previous_school_day, lead(date) OVER w - date AS calendar_days_until_next_school_day,
    CASE WHEN date - lag(date) OVER w >= 4 THEN 1 ELSE 0 END AS after_long_break, row_number() OVER w AS rn
  FROM sday0 WINDOW w AS (PARTITION BY student_id ORDER BY date)),
rec AS (SELECT * FROM lesson WHERE has_attendance_record),
daily AS (
  SELECT student_id, date, count(*) AS daily_recorded_lessons, sum(scheduled_minutes) AS daily_recorded_minutes, sum(missed_minutes) AS daily_missed_minutes,
    count(*) FILTER (substantial_miss) AS daily_substantial_miss_lessons, count(*) FILTER (partial_miss) AS daily_partial_miss_lessons,
    bool_or(substantial_miss) AS daily_any_substantial_miss FROM rec WHERE term_id IS NOT NULL GROUP BY ALL),
validity AS (
  SELECT student_id, date, coalesce(sum(missed_minutes) FILTER (is_giltig), 0) AS g, coalesce(sum(missed_minutes) FILTER (is_ogiltig), 0) AS o FROM rec GROUP BY ALL),
day1 AS (
  SELECT s.*, coalesce(d.daily_recorded_lessons, 0) AS daily_recorded_lessons, coalesce(d.daily_recorded_minutes, 0) AS daily_recorded_minutes,
    coalesce(d.daily_missed_minutes, 0) AS daily_missed_minutes, coalesce(d.daily_substantial_miss_lessons, 0) AS daily_substantial_miss_lessons,
    coalesce(d.daily_partial_miss_lessons, 0) AS daily_partial_miss_lessons, coalesce(d.daily_any_substantial_miss, FALSE) AS daily_any_substantial_miss,
    coalesce(v.g, 0) AS daily_giltig_missed_minutes, coalesce(v.o, 0) AS daily_ogiltig_missed_minutes
  FROM sday s LEFT JOIN daily d USING (student_id, date) LEFT JOIN validity v USING (student_id, date)),
day2 AS (
  SELECT *, daily_recorded_lessons = total_scheduled_lessons AS registration_complete, daily_missed_minutes / nullif(daily_recorded_minutes, 0) AS daily_missed_ratio,
    daily_giltig_missed_minutes / nullif(daily_recorded_minutes, 0) AS daily_giltig_ratio, daily_ogiltig_missed_minutes / nullif(daily_recorded_minutes, 0) AS daily_ogiltig_ratio,
    daily_partial_miss_lessons / nullif(daily_recorded_lessons, 0) AS daily_partial_lesson_ratio,
    sum(CASE WHEN daily_any_substantial_miss THEN 0 ELSE 1 END) OVER w AS isle_s, sum(CASE WHEN daily_ogiltig_missed_minutes > 0 THEN 0 ELSE 1 END) OVER w AS isle_o,
    sum(CASE WHEN daily_any_substantial_miss THEN 1 ELSE 0 END) OVER w AS seen_s, sum(CASE WHEN daily_ogiltig_missed_minutes > 0 THEN 1 ELSE 0 END) OVER w AS seen_o
  FROM day1 WINDOW w AS (PARTITION BY student_id ORDER BY date)),
roll AS (SELECT student_id, date, {roll} FROM day2),
streak AS (
  SELECT student_id, date, count(*) FILTER (daily_any_substantial_miss) OVER (PARTITION BY student_id, isle_s ORDER BY date) AS substantial_streak_days,
    count(*) FILTER (daily_ogiltig_missed_minutes > 0) OVER (PARTITION BY student_id, isle_o ORDER BY date) AS ogiltig_streak_days,
    CASE WHEN seen_s > 0 THEN row_number() OVER (PARTITION BY student_id, seen_s ORDER BY date) - 1 END AS school_days_since_substantial_miss,
    CASE WHEN seen_o > 0 THEN row_number() OVER (PARTITION BY student_id, seen_o ORDER BY date) - 1 END AS school_days_since_ogiltig_miss
  FROM day2),
term AS (
  SELECT student_id, date, sum(daily_missed_minutes) OVER w AS term_cumulative_missed_minutes, sum(daily_recorded_minutes) OVER w AS term_cumulative_recorded_minutes,
    sum(daily_giltig_missed_minutes) OVER w AS term_cumulative_giltig_missed_minutes, sum(daily_ogiltig_missed_minutes) OVER w AS term_cumulative_ogiltig_missed_minutes
  FROM day2 WINDOW w AS (PARTITION BY student_id, term_id ORDER BY date)),
term_len AS (SELECT school_id, term_id, max(school_day_index) AS term_total_school_days FROM cal GROUP BY ALL),
years AS (
  SELECT student_id, y0 + 1 AS y0, sum(daily_missed_minutes) / nullif(sum(daily_recorded_minutes), 0) AS prior_year_missed_ratio,
    sum(daily_giltig_missed_minutes) / nullif(sum(daily_recorded_minutes), 0) AS prior_year_giltig_ratio,
    sum(daily_ogiltig_missed_minutes) / nullif(sum(daily_recorded_minutes), 0) AS prior_year_ogiltig_ratio,
    count(*) FILTER (daily_any_substantial_miss) / count(DISTINCT date) AS prior_year_substantial_day_rate FROM day2 GROUP BY student_id, day2.y0),
sd AS (
  SELECT d.*, r.* EXCLUDE (student_id, date), k.* EXCLUDE (student_id, date), t.* EXCLUDE (student_id, date), roll_5d_missed_ratio - roll_20d_missed_ratio AS trend_5_vs_20_missed_ratio,
    term_cumulative_missed_minutes / nullif(term_cumulative_recorded_minutes, 0) AS term_cumulative_missed_ratio,
    term_cumulative_giltig_missed_minutes / nullif(term_cumulative_recorded_minutes, 0) AS term_cumulative_giltig_ratio,
    term_cumulative_ogiltig_missed_minutes / nullif(term_cumulative_recorded_minutes, 0) AS term_cumulative_ogiltig_ratio,
    term_total_school_days, term_total_school_days - school_day_index AS term_days_remaining, school_day_index / nullif(term_total_school_days, 0) AS term_progress_ratio,
    printf('%d/%02d', d.y0 - 1, d.y0 % 100) AS previous_academic_year, prior_year_missed_ratio, prior_year_giltig_ratio, prior_year_ogiltig_ratio, prior_year_substantial_day_rate,
    CASE WHEN prior_year_missed_ratio IS NULL THEN 0 ELSE 1 END AS has_prior_year_history, CASE WHEN grade <> 'F' THEN CAST(grade AS DOUBLE) END AS grade_numeric,
    lower(dayname(date)) AS weekday_name
  FROM day2 d JOIN roll r USING (student_id, date) JOIN streak k USING (student_id, date) JOIN term t USING (student_id, date)
  LEFT JOIN term_len USING (school_id, term_id) LEFT JOIN years y ON d.student_id = y.student_id AND d.y0 = y.y0),
ahead AS (
  SELECT d.student_id, d.date, count(f.date) AS future_school_days_available, coalesce(max(CASE WHEN f.daily_any_substantial_miss THEN 1 ELSE 0 END), 0) AS target_short_horizon,
    coalesce(bool_and(f.registration_complete), FALSE) AND count(f.date) = 5 AS future_horizon_complete, coalesce(sum(f.total_scheduled_lessons), 0) AS future_total_scheduled_lessons,
    coalesce(sum(f.total_scheduled_minutes), 0) AS future_total_scheduled_minutes, sum(f.total_scheduled_minutes) / nullif(count(f.date), 0) AS future_average_daily_minutes,
    coalesce(sum(f.subject_count), 0) AS future_total_subject_count, coalesce(sum(f.morning_lessons), 0) AS future_morning_lessons, coalesce(sum(f.afternoon_lessons), 0) AS future_afternoon_lessons
  FROM day2 d LEFT JOIN day2 f ON d.student_id = f.student_id AND d.y0 = f.y0 AND f.rn BETWEEN d.rn + 1 AND d.rn + 5 GROUP BY ALL),
short AS (
  SELECT s.*, a.* EXCLUDE (student_id, date), n.total_scheduled_lessons AS next_school_day_total_scheduled_lessons, n.total_scheduled_minutes AS next_school_day_total_scheduled_minutes,
    n.first_lesson_start AS next_school_day_first_lesson_start, n.last_lesson_start AS next_school_day_last_lesson_start, n.subject_count AS next_school_day_subject_count,
    n.morning_lessons AS next_school_day_morning_lessons, n.afternoon_lessons AS next_school_day_afternoon_lessons,
    n.calendar_days_since_previous_school_day AS next_school_day_gap_days, n.after_long_break AS next_school_day_after_long_break, lower(dayname(n.date)) AS next_school_day_weekday_name
  FROM sd s JOIN ahead a USING (student_id, date) LEFT JOIN day2 n ON s.student_id = n.student_id AND s.y0 = n.y0 AND n.rn = s.rn + 1),
final_term AS (SELECT student_id, term_id, sum(daily_missed_minutes) / nullif(sum(daily_recorded_minutes), 0) AS r FROM day2 GROUP BY ALL),
final_year AS (SELECT student_id, y0, sum(daily_missed_minutes) / nullif(sum(daily_recorded_minutes), 0) AS r FROM day2 GROUP BY ALL),
chronic AS (
  SELECT s.*, CAST(0.1 AS DOUBLE) - term_cumulative_missed_ratio AS gap_to_10pct, CAST(0.2 AS DOUBLE) - term_cumulative_missed_ratio AS gap_to_20pct,
    CASE WHEN f.r >= 0.1 THEN 1 ELSE 0 END AS target_chronic_10, CASE WHEN f.r >= 0.2 THEN 1 ELSE 0 END AS target_chronic_20,
    CASE WHEN y.r >= 0.1 THEN 1 ELSE 0 END AS target_chronic_year_10, CASE WHEN y.r >= 0.2 THEN 1 ELSE 0 END AS target_chronic_year_20
  FROM sd s LEFT JOIN final_term f USING (student_id, term_id) LEFT JOIN final_year y ON s.student_id = y.student_id AND s.y0 = y.y0),
term1 AS (
  SELECT student_id, y0, arg_max(term_cumulative_missed_ratio, date) FILTER (term_cumulative_missed_ratio IS NOT NULL) AS m,
    arg_max(term_cumulative_giltig_ratio, date) FILTER (term_cumulative_giltig_ratio IS NOT NULL) AS g,
    arg_max(term_cumulative_ogiltig_ratio, date) FILTER (term_cumulative_ogiltig_ratio IS NOT NULL) AS o FROM sd WHERE month(date) >= 8 GROUP BY ALL),
year_cal AS (
  SELECT school_id, year(date) - (CASE WHEN month(date) < 8 THEN 1 ELSE 0 END) AS y0, count(DISTINCT date) AS year_total_school_days FROM cal WHERE is_instructional_day GROUP BY ALL),
year1 AS (
  SELECT c.*, sum(daily_missed_minutes) OVER w / nullif(sum(daily_recorded_minutes) OVER w, 0) AS year_cumulative_missed_ratio, row_number() OVER w AS year_school_days_elapsed
  FROM chronic c WINDOW w AS (PARTITION BY student_id, y0 ORDER BY date)),
chronic_year AS (
  SELECT c.*, CAST(0.1 AS DOUBLE) - year_cumulative_missed_ratio AS gap_to_year_10pct, CAST(0.2 AS DOUBLE) - year_cumulative_missed_ratio AS gap_to_year_20pct,
    CASE WHEN month(date) < 8 THEN 1 ELSE 0 END AS is_term2, CASE WHEN month(date) < 8 THEN coalesce(t.m, 0) ELSE 0 END AS term1_actual_missed_ratio,
    CASE WHEN month(date) < 8 THEN coalesce(t.g, 0) ELSE 0 END AS term1_actual_giltig_ratio, CASE WHEN month(date) < 8 THEN coalesce(t.o, 0) ELSE 0 END AS term1_actual_ogiltig_ratio,
    year_total_school_days, year_school_days_elapsed / nullif(year_total_school_days, 0) AS year_progress_ratio, year_total_school_days - year_school_days_elapsed AS year_days_remaining
  FROM year1 c LEFT JOIN term1 t ON c.student_id = t.student_id AND c.y0 = t.y0 LEFT JOIN year_cal k ON c.school_id = k.school_id AND c.y0 = k.y0),
{slots}
target AS (
  SELECT student_id, school_id, class_id, grade, stage, date, lesson_id, academic_year, substantial_miss, has_attendance_record, scheduled_minutes AS target_scheduled_minutes,
    lesson_start_minutes AS target_lesson_start_minutes, subject AS target_subject, weekday_name AS target_weekday_name, lesson_time_bin AS target_lesson_time_bin FROM lesson),
flags AS (
  SELECT *, CASE WHEN target_lesson_start_minutes = min(target_lesson_start_minutes) OVER w THEN 'yes' ELSE 'no' END AS target_first_lesson_flag,
    CASE WHEN target_lesson_start_minutes = max(target_lesson_start_minutes) OVER w THEN 'yes' ELSE 'no' END AS target_last_lesson_flag
  FROM target WHERE {which} WINDOW w AS (PARTITION BY student_id, date)),
expanded AS (
  SELECT t.*, s.date AS score_date, d.rn - s.rn AS horizon_school_days, d.date - s.date AS calendar_days_until_target, CASE WHEN t.substantial_miss THEN 1 ELSE 0 END AS target_label,
    d.total_scheduled_lessons AS target_day_total_scheduled_lessons, d.total_scheduled_minutes AS target_day_total_scheduled_minutes, d.subject_count AS target_day_subject_count,
    d.calendar_days_since_previous_school_day AS target_days_since_previous_school_day, d.after_long_break AS target_after_long_break,
    s.* EXCLUDE (student_id, school_id, class_id, grade, stage, date, academic_year, rn)
  FROM flags t JOIN day2 d USING (student_id, date) JOIN sd s ON s.student_id = d.student_id AND s.rn BETWEEN d.rn - 5 AND d.rn - 1),
{asof}
nothing AS (SELECT 1)
"""

ROLL = ", ".join(
    f"sum({n}) OVER (PARTITION BY student_id ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) / nullif(sum(daily_recorded_minutes) OVER (PARTITION BY student_id ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 0) AS roll_{w}d_{k}_ratio"
    for w in (1, 3, 5, 10, 20)
    for k, n in (("missed", "daily_missed_minutes"), ("giltig", "daily_giltig_missed_minutes"), ("ogiltig", "daily_ogiltig_missed_minutes"))
) + ", " + ", ".join(
    f"avg({n}) OVER (PARTITION BY student_id ORDER BY rn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS roll_{w}d_{k}"
    for w in (1, 3, 5, 10, 20)
    for k, n in (("partial_ratio", "daily_partial_lesson_ratio"), ("substantial_day_rate", "CASE WHEN daily_any_substantial_miss THEN 1 ELSE 0 END"))
)
SLOT_KEYS = {"subject": ["subject"], "weekday": ["weekday_name"], "timebin": ["lesson_time_bin"], "subject_weekday_timebin": ["subject", "weekday_name", "lesson_time_bin"]}
SLOTS = "".join(
    f"""slot_{s} AS (SELECT DISTINCT student_id, {', '.join(k)}, date, count(*) OVER w AS hist_{s}_lesson_count, count(*) FILTER (substantial_miss) OVER w / count(*) OVER w AS hist_{s}_substantial_rate
  FROM rec WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} WINDOW w AS (PARTITION BY student_id, {', '.join(k)} ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
"""
    for s, k in SLOT_KEYS.items()
)


def _asof() -> str:
    out, last = "", "expanded"
    for s, k in SLOT_KEYS.items():
        on = " AND ".join(f"e.target_{c} = h.{c}" for c in k)
        out += f"""asof_{s} AS (SELECT e.*, coalesce(h.hist_{s}_lesson_count, 0) AS hist_{s}_lesson_count, coalesce(h.hist_{s}_substantial_rate, 0) AS hist_{s}_substantial_rate
  FROM {last} e ASOF LEFT JOIN slot_{s} h ON e.student_id = h.student_id AND {on} AND e.score_date >= h.date),
"""
        last = f"asof_{s}"
    return out


def sql(final: str, which: str = "has_attendance_record") -> str:
    """The chain with a final query. ``which`` chooses the target lessons: recorded ones, or all."""
    return f"WITH {BASE.format(validity=VALIDITY, roll=ROLL, slots=SLOTS, asof=_asof(), which=which)}\n{final}"
