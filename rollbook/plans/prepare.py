"""All prepared frames from the three inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import Modeling
from ..operators import days, lessons
from ..sources.shared import stored


@dataclass
class Prepared:
    lesson_frame: DataFrame
    student_day: DataFrame
    schedule_day: DataFrame
    calendar: DataFrame
    pieces: int | None = None  # into which lessons are dealt by student

    def stored_lessons(self) -> Prepared:
        """The same, with the lessons written once, in buckets of students."""
        frame = stored(self.lesson_frame, "lesson_frame", "student_id", self.pieces, lessons.rounds(self.pieces))
        return Prepared(frame, days.student_day(frame, self.calendar), days.schedule_day(frame), self.calendar, self.pieces)

    def stored(self) -> Prepared:
        """The same, with both frames that every task reads written once."""
        p = self.stored_lessons()
        return Prepared(p.lesson_frame, stored(p.student_day, "student_day", "student_id", p.pieces), p.schedule_day, p.calendar, p.pieces)


def prepare(attendance: DataFrame, schedule: DataFrame, calendar: DataFrame, m: Modeling | None = None, start_month: int = 8) -> Prepared:
    m = m or Modeling()
    n = lessons.pieces(schedule)
    frame = lessons.lesson_frame(attendance, schedule, calendar, start_month, m.substantial_threshold, n)
    return Prepared(frame, days.student_day(frame, calendar), days.schedule_day(frame), calendar, n)
