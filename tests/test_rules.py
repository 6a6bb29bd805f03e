"""Scalar rules, traps with nulls and ties, contracts and helpers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rollbook import config, reports
from rollbook.functions import expressions as X
from rollbook.functions import features
from rollbook.names import VALIDITY
from rollbook.operators import days, lessons, metrics, sampling
from rollbook.operators.asof import asof_join
from rollbook.sources import contracts, files

from . import school


def column(spark, values, kind, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", *(c.alias(f"c{k}") for k, c in enumerate(cols))).orderBy("i").collect()
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in rows]


def test_stage(spark):
    got = column(spark, ["F", " fk ", "0", "3", "3.9", "4", "6", "7", "9", "10", "x", "", None, "nan"], "string", X.grade_to_stage(F.col("x")))
    assert got == ["F-3", "F-3", "F-3", "F-3", "F-3", "4-6", "4-6", "7-9", "7-9", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_school_years(spark):
    got = column(spark, [dt.date(1999, 8, 1), dt.date(1999, 7, 31), dt.date(2009, 12, 1)], "date", X.academic_year(F.col("x")))
    assert got == ["1999/00", "1998/99", "2009/10"]
    got = column(spark, ["2000/01", "1999/00", "2000-01", "a/b", None], "string", X.previous_academic_year(F.col("x")))
    assert got == ["1999/00", "1998/99", None, None, None]


def test_time_bins(spark):
    assert column(spark, [None, 539.0, 540.0, 659.0, 660.0, 779.0, 780.0], "double", X.time_bin(F.col("x"))) == ["unknown", "before_09", "09_11", "09_11", "11_13", "11_13", "after_13"]


def test_numbers(spark):
    assert column(spark, ["1.5", "x", "NaN", None], "string", X.number(F.col("x"))) == [1.5, None, None, None]
    assert column(spark, [0.0, 2.0, None], "double", X.safe_divide(F.lit(1.0), F.col("x"))) == [None, 0.5, None]
    assert X.percent(0.29) == 28
    assert column(spark, [None, 0.1, 0.05], "double", X.reached(F.col("x"), 0.1)) == [0, 1, 0]


def lesson(n=1, **over):
    row = dict(student_id="A", school_id="S", class_id="C", grade="5", term_id="T", date=dt.date(2024, 9, 2), lesson_id=f"L{n}", subject="M", scheduled_start_at=dt.datetime(2024, 9, 2, 8), scheduled_minutes=45.0, attended_minutes=45.0, missed_minutes=0.0, record_created_at=dt.datetime(2024, 9, 2, 15), record_updated_at=dt.datetime(2024, 9, 2, 16))
    return {**row, VALIDITY: "present", **over}


def frame(spark, attendance, schedule=None, calendar=None):
    names = {t: [c for c, _ in contracts.fields(t)] for t in contracts.SCHEMAS}
    pick = lambda t, rows: [tuple(r[c] for c in names[t]) for r in rows]
    a, s, c = school.frames(spark, attendance_events=pick("attendance_events", attendance), student_schedule=pick("student_schedule", schedule or attendance), school_calendar=calendar if calendar is not None else [("S", dt.date(2024, 9, 2), "T", True, 1)])
    return lessons.lesson_frame(a, s, c)


def test_latest_record_wins_and_null_update_is_latest(spark):
    rows = [lesson(1, missed_minutes=10.0), lesson(1, missed_minutes=45.0, record_updated_at=dt.datetime(2024, 9, 3)), lesson(2, missed_minutes=45.0), lesson(2, record_updated_at=None)]
    got = {r["lesson_id"]: r for r in frame(spark, rows).collect()}
    assert got["L1"]["missed_minutes"] == 45.0 and got["L1"]["substantial_miss"]
    assert not got["L2"]["has_attendance_record"] and got["L2"]["missed_minutes"] is None and got["L2"]["registration_missing"]


def test_minutes_are_inferred(spark):
    rows = [lesson(1, missed_minutes=None, attended_minutes=22.0), lesson(2, missed_minutes=None, attended_minutes=60.0), lesson(3, missed_minutes=None, attended_minutes=None), lesson(4, missed_minutes=-5.0, attended_minutes=None), lesson(5, scheduled_minutes=None, missed_minutes=None), lesson(6, scheduled_minutes=0.0, missed_minutes=5.0)]
    got = {r["lesson_id"]: (r["missed_minutes"], r["attended_minutes"], r["substantial_miss"], r["partial_miss"]) for r in frame(spark, rows).collect()}
    assert got == {"L1": (23.0, 22.0, True, False), "L2": (0.0, 60.0, False, False), "L3": (45.0, 0.0, True, False), "L4": (-5.0, 50.0, False, False), "L5": (None, 45.0, False, False), "L6": (5.0, 45.0, False, True)}


def test_gaps_are_filled_from_attendance_and_unscheduled_lessons_drop(spark):
    rows = [lesson(1), lesson(2)]
    got = frame(spark, rows, [lesson(1, subject=None, scheduled_start_at=None, scheduled_minutes=None)], []).collect()
    assert [(r["lesson_id"], r["subject"], r["lesson_start_minutes"], r["scheduled_minutes"], r["term_id"]) for r in got] == [("L1", "M", 480.0, 45.0, "T")]
    assert days.schedule_day(frame(spark, rows, calendar=[])).count() == 0  # no calendar row: no day


def test_closed_days_drop(spark):
    assert frame(spark, [lesson(1)], calendar=[("S", dt.date(2024, 9, 2), "T", False, 1)]).count() == 0


def test_two_classes_on_one_date(spark):
    rows = [lesson(1, missed_minutes=45.0, **{VALIDITY: "Ogiltig"}), lesson(2, class_id="D")]
    got = days.day_totals(frame(spark, rows)).orderBy("class_id").collect()
    assert [r["daily_ogiltig_missed_minutes"] for r in got] == [45.0, 45.0]
    assert [r["calendar_days_since_previous_school_day"] for r in got] == [None, 0]
    assert [r["daily_missed_minutes"] for r in got] == [45.0, 0.0]


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, None), (None, 1, 9.0)], "k string, u int, v double")
    got = {(r["k"], r["t"]): r["v"] for r in asof_join(left, right, ["k"], "t", "u", ["v"], 0.0).collect()}
    assert got == {("a", 1): 0.0, ("a", 3): 2.0, ("a", 5): 2.0, ("b", 5): 0.0, (None, 5): 0.0}


def scored(spark, rows):
    return spark.createDataFrame([(f"i{k}", y, s) for k, (y, s) in enumerate(rows)], "id string, y int, s double")


def test_metrics(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)])
    got = metrics.binary_metrics(df, "y", "s", [0.01, 0.4], ["id"])
    assert got["row_count"] == 5 and got["precision_at_0.01"] == 1.0 and got["precision_at_0.40"] == 0.5
    assert math.isclose(got["pr_auc"], 0.5 * 1 + 0.5 * 2 / 4)
    assert math.isclose(got["brier"], (0.01 + 0.64 + 0.09 + 0.49 + 0.01) / 5)
    one = metrics.binary_metrics(scored(spark, [(1, 0.9)]), "y", "s", [0.5], ["id"])
    assert one["pr_auc"] is None and one["brier"] is None and one["precision_at_0.50"] == 1.0


def test_lesson_metrics(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "S", "C", f"L{k}", e, a) for k, (e, a) in enumerate([(3.0, 2.0), (2.0, 2.0), (1.0, 0.0), (1.0, 1.0)])], "date date, school_id string, class_id string, lesson_id string, expected_missed double, actual_missed double")
    got = metrics.lesson_metrics(df, [0.5]).first()
    assert got["lesson_count"] == 4 and got["mae_expected_missed"] == 0.5 and got["lesson_hit_rate_at_0.50"] == 1.0
    assert math.isclose(got["rank_correlation"], 4.0 / 4.5, rel_tol=1e-9)


def test_sampling(spark):
    df = scored(spark, [(1, 0.0)] * 3 + [(0, 0.0)] * 20)
    a = sampling.sample_negatives(df, "y", 2.0, ["id"], 1)
    assert (a.where("y = 1").count(), a.where("y = 0").count()) == (3, 6)
    assert sorted(a.collect()) == sorted(sampling.sample_negatives(df, "y", 2.0, ["id"], 1).collect())
    assert sampling.cap_rows(df, "y", 10, ["id"], 1).count() == 10
    assert sampling.cap_rows(df, "y", 2, ["id"], 1).count() == 23
    assert sampling.cap_rows(df, "y", 2, ["id"], 1, strict=True).count() == 3
    assert sampling.sample_negatives(df.where("y = 1"), "y", 2.0, ["id"], 1).count() == 3
    assert sampling.sample_fraction(df, 0.5, ["id"], 1).count() == 12


def test_feature_groups():
    with pytest.raises(ValueError, match="No such feature group"):
        features.resolve(["nope"], "lesson")
    assert len(features.resolve(features.DEFAULT_GROUPS["lesson"], "lesson")[0]) == 70
    assert features.group_importance({"roll_1d_missed_ratio": 1.0, "roll_3d_missed_ratio": 3.0, "stage": 5.0}) == {"rolling_short": 2.0, "base": 5.0}


def test_contracts_and_files(spark, tmp_path):
    with pytest.raises(ValueError, match="missing required columns.*'date'"):
        contracts.validate_columns("school_calendar", ["school_id"])
    with pytest.raises(ValueError, match="Unsupported"):
        files.load_table(spark, "a.txt")
    raw = spark.createDataFrame([("S", "2024-01-01", "T", "false", "x", "extra")], "school_id string, date string, term_id string, is_instructional_day string, school_day_index string, more string")
    files.write_frame(raw, str(tmp_path / "c.csv"))
    got = contracts.conform("school_calendar", files.load_table(spark, str(tmp_path / "c.csv"))).first()
    assert (got["date"], got["is_instructional_day"], got["school_day_index"]) == (dt.date(2024, 1, 1), False, None)


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("data: {attendance_events: a, student_schedule: b, school_calendar: c}\nexperiments: [{name: x, train_years: [2020/21], validation_years: []}]\nmodeling: {top_k_fractions: [1]}")
    c = config.load_config(str(f))
    assert c.experiments[0].train_years == ["2020/21"] and c.modeling.top_k_fractions == [1.0] and c.project.random_seed == 42
    f.write_text("data: {}")
    with pytest.raises(ValueError, match="experiments"):
        config.load_config(str(f))


def test_reports(spark, tmp_path):
    reports.write_json([{"a": float("nan")}], str(tmp_path / "m.json"))
    assert "null" in (tmp_path / "m.json").read_text()
    reports.write_markdown([{"experiment": "e", "task": "t", "split": "s", "m": 0.5}], str(tmp_path / "m.md"))
    assert "m=0.5000" in (tmp_path / "m.md").read_text()
    reports.write_json([], str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text() == "[]" and not [f for f in tmp_path.iterdir() if f.name.endswith(".tmp")]


def test_runs_at_the_same_time_keep_all_lines(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = str(tmp_path / "l.tsv")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: reports.append_log(log, {"candidate": f"c{i}", "feature_groups": ["a", "b"], "pr_auc": 0.5}, {"x": 1.0, "y": 2.0}), range(12)))
    rows = reports.read_log(spark, log).collect()
    assert sorted(r["candidate"] for r in rows) == sorted(f"c{i}" for i in range(12))
    assert {(r["feature_groups"], r["pr_auc"], r["top_groups"], r["brier"]) for r in rows} == {("a,b", "0.5", "y,x", None)}


@pytest.mark.parametrize("value", [float("inf"), 1e15, float("nan")])
def test_a_value_leaves_no_trace_after_its_windows(spark, value):
    """A day that is infinite, huge or not a number shows in the windows that hold it, and in no other."""
    daily = lambda i, v: ("s", dt.date(2024, 1, 1) + dt.timedelta(i), v, 3.0, 0.1, 45.7, (i % 3) / 7, i % 2 == 0)
    schema = "student_id string, date date, daily_missed_minutes double, daily_giltig_missed_minutes double, daily_ogiltig_missed_minutes double, daily_recorded_minutes double, daily_partial_lesson_ratio double, daily_any_substantial_miss boolean"
    extra = {c: F.lit("x") for c in ("school_id", "class_id", "grade", "stage", "term_id", "academic_year", "school_day_index")}
    runs = [{r["date"]: r.asDict() for r in days.with_rolling(spark.createDataFrame([daily(i, v if i == 4 else float(i % 5)) for i in range(40)], schema).withColumns(extra)).collect()} for v in (value, 2.0)]
    for n in (1, 3, 5, 10, 20):
        for i, day in enumerate(sorted(runs[0])):
            odd, plain = (r[day][f"roll_{n}d_missed_ratio"] for r in runs)
            if 4 <= i < 4 + n:
                assert odd != plain
            else:
                want = sum(float(k % 5) if k != 4 else 2.0 for k in range(max(0, i - n + 1), i + 1)) / (45.7 * min(n, i + 1))
                assert odd == plain and abs(odd - want) < 1e-12


def test_stored_frames_leave_no_table(spark):
    from rollbook.sources.shared import stored

    out = stored(spark.range(100).withColumn("k", F.col("id") % 7), "some", "k")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("some")]
    assert out.groupBy("k").count().count() == 7 and out.count() == 100
    assert "Exchange hashpartitioning(k" not in out.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()


def test_violations_of_the_contract(spark):
    calendar = spark.createDataFrame([("A", "2024-01-01", "true", "1"), ("A", "2024-01-01", "maybe", None), (None, "x", "false", "one"), ("B", "2024-01-02", None, "2")], "school_id string, date string, is_instructional_day string, school_day_index string")
    got = {tuple(r)[1:] for r in contracts.contract_violations("school_calendar", calendar).collect()}
    assert got == {("missing column", "term_id", 4), ("failed cast", "date", 1), ("failed cast", "is_instructional_day", 1), ("failed cast", "school_day_index", 1), ("null key", "school_id", 1), ("null key", "date", 1), ("repeated key", "school_id,date", 1)}
    fine = calendar.where("school_id = 'B'").withColumn("term_id", F.lit("t"))
    assert contracts.contract_violations("school_calendar", fine).count() == 0
    assert contracts.contract_violations("school_calendar", fine.limit(0)).count() == 0
