"""Hand-derived results of the small school."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.plans import tasks
from rollbook.plans.prepare import prepare
from rollbook.plans.scoring import ClassScoring, Scoring

from . import school

YEARS = ["2022/23", "2023/24", "2024/25", "2025/26"]


@pytest.fixture(scope="module")
def prepared(spark):
    return prepare(*school.frames(spark)).stored()


def per_year(frame, target):
    return {r["academic_year"]: (r["n"], r["p"]) for r in frame.groupBy("academic_year").agg(F.count("*").alias("n"), F.sum(target).alias("p")).collect()}


def test_student_days(prepared):
    days = prepared.student_day
    assert days.count() == 200
    assert days.where("NOT registration_complete").count() == 11
    assert prepared.schedule_day.count() == 200


def test_term_cumulative_ratio_of_one_student(prepared):
    rows = prepared.student_day.where("student_id = 'S1' AND academic_year = '2022/23'").orderBy("date").select("term_cumulative_missed_ratio").collect()
    assert [round(r[0], 6) for r in rows] == [0.5, 0.25, 0.166667, 0.125, 0.151111, 0.209259, 0.179365, 0.156944, 0.139506, 0.151111]


def test_final_ratios(prepared):
    rows = prepared.student_day.groupBy("student_id", "academic_year").agg(F.sum("daily_missed_minutes").alias("m"), F.sum("daily_recorded_minutes").alias("r")).collect()
    got = {(r[0], r[1]): (r["m"], r["r"]) for r in rows}
    assert [got["S1", y] for y in YEARS] == [(136, 900)] * 3 + [(113, 720)]
    assert [got["S3", y] for y in YEARS] == [(340, 900)] * 3 + [(204, 720)]
    assert [got["S4", y] for y in YEARS] == [(60, 900)] * 3 + [(30, 720)]


def test_short_horizon(prepared):
    assert per_year(tasks.short_horizon(prepared).frame, "target_short_horizon") == dict(zip(YEARS, [(25, 14), (25, 14), (23, 14), (15, 8)], strict=True))


@pytest.mark.parametrize(("threshold", "positive"), [(0.10, 20), (0.20, 10)])
def test_chronic(prepared, threshold, positive):
    k = int(threshold * 100)
    assert set(per_year(tasks.chronic(prepared, threshold).frame, f"target_chronic_{k}").values()) == {(50, positive)}
    assert set(per_year(tasks.chronic_year(prepared, threshold).frame, f"target_chronic_year_{k}").values()) == {(50, positive)}


def test_lessons(prepared):
    assert per_year(tasks.lesson(prepared).frame, "target_label") == dict(zip(YEARS, [(350, 71), (500, 80), (495, 80), (400, 50)], strict=True))


def test_scoring(prepared):
    s = Scoring(prepared.lesson_frame, prepared.calendar, "2025-08-27", "SCHOOL_1", "CLASS_7A").check()
    assert s.short_horizon().count() == s.chronic().count() == s.chronic_year().count() == 3
    lesson = s.lesson()
    assert lesson.count() == 12
    assert {r[0] for r in lesson.select("horizon_school_days").collect()} == {1, 2}
    with pytest.raises(ValueError, match="has no student"):
        Scoring(prepared.lesson_frame, prepared.calendar, "2025-12-24", "SCHOOL_1", "CLASS_7A").check()


def test_scoring_rows_equal_training_rows(prepared):
    s = Scoring(prepared.lesson_frame, prepared.calendar, "2025-08-20", "SCHOOL_1", "CLASS_7A")
    trained = tasks.chronic_year(prepared, 0.1).frame.where("date = '2025-08-20' AND class_id = 'CLASS_7A'")
    scored = s.chronic_year()
    cols = sorted(set(scored.columns) & set(trained.columns))
    assert sorted(map(str, scored.select(cols).collect())) == sorted(map(str, trained.select(cols).collect()))


def test_many_classes_at_once(spark, prepared):
    """A table of requests gives what each request gives by itself."""
    asked = [("SCHOOL_1", "CLASS_7A", "2025-08-20"), ("SCHOOL_1", "CLASS_7A", "2025-08-21"), ("SCHOOL_1", "CLASS_4A", "2025-08-21"), ("SCHOOL_1", "CLASS_7A", "2025-12-24"), ("SCHOOL_2", "CLASS_7A", "2025-08-21")]
    requests = spark.createDataFrame([*asked, asked[0], (None, "CLASS_7A", "2025-08-20")], "school_id string, class_id string, as_of string")
    whole = ClassScoring(prepared.lesson_frame, prepared.calendar, requests)
    for kind, rows in (("chronic_year", 8), ("lesson", 80)):
        got = getattr(whole, kind)()
        single = [getattr(Scoring(prepared.lesson_frame, prepared.calendar, day, school, group), kind)().select(got.columns).collect() for school, group, day in asked[:3]]
        assert sorted(map(str, got.collect())) == sorted(str(r) for part in single for r in part)
        assert got.count() == rows
    assert ClassScoring(prepared.lesson_frame, prepared.calendar, requests.limit(0)).short_horizon().count() == 0


def test_features_do_not_look_ahead(spark, prepared):
    """Attendance after a day changes no feature of the day."""
    cut = dt.date(2024, 8, 23)
    data = school.tables()["attendance_events"]
    later = [r if r[5] <= cut else (*r[:10], 0.0, 45.0, "ogiltig", *r[13:]) for r in data]
    other = prepare(*school.frames(spark, attendance_events=later))
    cols = [c for c in tasks.C.STUDENT_DAY if c != "grade_numeric"]
    rows = [sorted(map(str, p.student_day.where(F.col("date") <= F.lit(cut)).select("student_id", "date", *cols).collect())) for p in (prepared, other)]
    assert rows[0] == rows[1]


def test_no_place_is_a_feature(prepared):
    for t in tasks.all_tasks(prepared).values():
        assert not {"school_id", "class_id", "student_id"} & set(t.numeric + t.categorical)
        assert set(t.numeric + t.categorical + [t.target] + t.ids) == set(t.frame.columns)
