"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from rollbook import registry

TABLES = ["lineitem", "supplier"]
CHECKED = ["contract_attendance", "csv_round_trip", "dedup_schedule_repeats", "dedup_calendar_repeats", "feature_table_round_trip", "search_sample", "precision_at_k", "dedup_latest_attendance", "lesson_frame", "student_day", "short_horizon_dataset", "chronic_20", "chronic_year_20", "slot_history_combined", "asof_combined", "lesson_dataset", "lesson_expand", "score_lesson", "stage_metrics", "average_precision", "negative_sampling", "lesson_aggregate_metrics", "sql_scored_probabilities", "additive_probabilities", "encoder_statistics", "logistic_certificate", "calibrate_by_stage", "permutation_importance", "group_importance", "task_totals", "contract_violations", "log_round_trip", "score_short_horizon", "rolling_ratios"]


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 6) + 0.0)
    return str(v)[:19].removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted(tuple(map(plain, r)) for r in d[cols].astype(object).itertuples(index=False)) for d in (got, want)]
    assert rows[0] == rows[1]


def test_flagship_has_rows(spark, sf_dir):
    assert registry.flagship(spark, sf_dir).limit(1).count() == 1
