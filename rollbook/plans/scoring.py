"""Frames for scoring classes as of dates.

A table of requests (school, class, date) is answered in one plan. The cohort is found in the lessons by a semi
join and everything is limited to its students before any window: all windows are within a student, so the
result is the same and the work small.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Modeling
from ..functions import features as C
from ..operators.days import DAY_KEYS, student_day, with_common
from ..sources.shared import stored
from . import tasks

IDS = ["student_id", "school_id", "class_id", "grade", "stage"]


def _columns(task: str) -> list[str]:
    return sum(C.resolve(C.DEFAULT_GROUPS[task], task), [])


@dataclass
class ClassScoring:
    """Scoring frames of the students whom each class of ``requests`` (``school_id, class_id, as_of``) has on its date.

    Repeated requests count once, those with a null never match, and without requests all frames are empty.
    """

    lesson_frame: DataFrame
    calendar: DataFrame
    requests: DataFrame
    modeling: Modeling = field(default_factory=Modeling)
    start_month: int = 8
    pieces: int | None = None  # into which lessons are dealt by student

    def __post_init__(self) -> None:
        self.asked = self.requests.select(F.col("school_id").cast("string").alias("__school"), F.col("class_id").cast("string").alias("__class"), F.col("as_of").cast("date").alias("__as_of")).distinct()
        self.students = self._today(self.lesson_frame.dropna(subset=DAY_KEYS)).select(F.col("student_id").alias("__cohort")).distinct()
        self.lessons = self.lesson_frame.join(self.students, F.col("student_id") == F.col("__cohort"), "left_semi")
        self.days = student_day(self.lessons, self.calendar)

    def stored(self):
        """The same, with the cohort's days written once; lessons that are stored already are not written again."""
        self.days = stored(self.days, "cohort_days", "student_id", self.pieces)
        return self

    def _today(self, df: DataFrame) -> DataFrame:
        """Rows of a requested class on its date."""
        on = (F.col("school_id").cast("string") == F.col("__school")) & (F.col("class_id").cast("string") == F.col("__class")) & (F.col("date") == F.col("__as_of"))
        return df.join(self.asked, on, "left_semi")

    def _pick(self, df: DataFrame, task: str) -> DataFrame:
        return self._today(df).select(*dict.fromkeys(["date", *IDS, *_columns(task)]))

    def short_horizon(self) -> DataFrame:
        return self._pick(tasks.short_horizon_frame(self.days, self.modeling.short_horizon_school_days), "short_horizon")

    def chronic(self) -> DataFrame:
        return self._pick(tasks.with_term_gaps(with_common(self.days)), "chronic_10")

    def chronic_year(self) -> DataFrame:
        """What a row knows of its year lies on or before its date: sums to date, and the first term once it is over."""
        return self._pick(tasks.with_year_level(with_common(self.days), self.calendar, self.start_month), "chronic_year_10")

    def lesson(self) -> DataFrame:
        """Lessons of the next school days; first and last flags look at all scheduled lessons of a day."""
        score = tasks.day_positions(self.days).select(F.col("student_id").alias("__student"), "score_date", "pos")
        rows = self._today(with_common(self.days)).select(F.col("student_id").alias("__s"), F.col("date").alias("__d")).distinct()
        now = score.join(rows, (F.col("__student") == F.col("__s")) & (F.col("score_date") == F.col("__d")), "left_semi")
        steps = F.explode(F.sequence(F.lit(1), F.lit(self.modeling.lesson_horizon_school_days)))
        now = now.withColumn("horizon_school_days", steps).withColumn("__pos", F.col("pos") + F.col("horizon_school_days")).withColumnRenamed("pos", "__at")
        ahead = score.select(F.col("__student").alias("__who"), F.col("score_date").alias("__date"), "pos")
        ahead = ahead.join(now, (F.col("__who") == F.col("__student")) & (F.col("pos") == F.col("__pos")))
        target = tasks.with_target_flags(self.lessons)
        frame = target.join(ahead, (F.col("student_id") == F.col("__who")) & (F.col("date") == F.col("__date"))).drop("__who", "__student", "__date", "pos", "__pos")
        frame = frame.transform(tasks.with_target_day, self.days).transform(tasks.until_target).transform(tasks.with_histories, self.lessons)
        frame = tasks.with_score_day(frame, self.days).withColumn("target_date", F.col("date"))
        return frame.select(*dict.fromkeys(["score_date", "target_date", *IDS, "lesson_id", *_columns("lesson")]))


class Scoring(ClassScoring):
    """The same for one class as of one date."""

    def __init__(self, lesson_frame: DataFrame, calendar: DataFrame, as_of: str, school_id: str, class_id: str, modeling: Modeling | None = None, start_month: int = 8):
        self.name = f"class {class_id} of school {school_id} has no student with a complete day on {as_of}"
        one = lesson_frame.sparkSession.createDataFrame([(str(school_id), str(class_id), str(as_of))], "school_id string, class_id string, as_of string")
        super().__init__(lesson_frame, calendar, one, modeling or Modeling(), start_month)

    def check(self) -> Scoring:
        """``ValueError`` if the class has no student that day."""
        if self.students.isEmpty():
            raise ValueError(self.name)
        return self
