"""Names that users' tables, configurations and result files hold. They must stay as they are."""

from __future__ import annotations

#: Column of the attendance table.
VALIDITY = "absence_validity"
#: Key under ``modeling`` in a configuration.
MISS_THRESHOLD = "substantial_absence_threshold"
#: Columns, and one file, of scoring results.
SHORT_PROB = "short_horizon_absence_prob"
LESSON_PROB = "lesson_absence_prob"
LESSON_SUM = "lesson_expected_absence"
