"""A small school: 5 students, 4 years of 10 business days, 2 lessons a day."""

from __future__ import annotations

import datetime as dt

from rollbook.sources.contracts import SCHEMAS

STARTS = ["2022-08-22", "2023-08-21", "2024-08-19", "2025-08-18"]
STUDENTS = {"S1": ("CLASS_7A", "7"), "S2": ("CLASS_7A", "7"), "S3": ("CLASS_7A", "7"), "S4": ("CLASS_4A", "4"), "S5": ("CLASS_4A", "4")}


def missed(student: str, lesson: int, day: int) -> tuple[int, str]:
    if student == "S1" and lesson == 1 and day % 5 == 0:
        return 45, "ogiltig"
    if student == "S1" and lesson == 2 and day % 5 == 4:
        return 23, "giltig"
    if student == "S3" and day >= 5:
        return (45, 23)[lesson - 1], "ogiltig"
    if student == "S4" and lesson == 1 and day % 6 == 2:
        return 30, "ogiltig"
    return 0, "present"


def tables() -> dict[str, list[tuple]]:
    attendance, schedule, calendar = [], [], []
    for y, start in enumerate(STARTS):
        first, days = dt.date.fromisoformat(start), []
        d = first
        while len(days) < 10:
            if d.weekday() < 5:
                days.append(d)
            d += dt.timedelta(days=1)
        term = f"{first.year}/{(first.year + 1) % 100:02d}_term"
        for i, d in enumerate(days):
            calendar.append(("SCHOOL_1", d, term, True, i + 1))
            for s, (klass, grade) in STUDENTS.items():
                for n, (subject, hour) in enumerate((("Math", 8), ("Swedish", 10)), 1):
                    at = dt.datetime.combine(d, dt.time(hour))
                    lesson = f"{term}_{s}_{d:%Y%m%d}_L{n}"
                    schedule.append((s, "SCHOOL_1", klass, grade, d, lesson, subject, at, 45.0))
                    if d > dt.date(2025, 8, 27) or (y == 2 and s == "S2" and i == 2 and n == 2):
                        continue
                    m, kind = missed(s, n, i)
                    made = dt.datetime.combine(d, dt.time(15))
                    attendance.append((s, "SCHOOL_1", klass, grade, term, d, lesson, subject, at, 45.0, 45.0 - m, float(m), kind, made, made + dt.timedelta(minutes=5)))
    return {"attendance_events": attendance, "student_schedule": schedule, "school_calendar": calendar}


def frames(spark, **rows):
    """Contract frames, of the school or of ``rows`` by table."""
    data = {**tables(), **rows}
    return [spark.createDataFrame(data[t], SCHEMAS[t]) for t in ("attendance_events", "student_schedule", "school_calendar")]
