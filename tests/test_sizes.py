"""What one task holds must not grow with the tables: numbers of pieces do, and wide rows are not stored to be ranked."""

import re

from rollbook import registry
from rollbook.operators import lessons


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lessons_are_dealt_once_into_pieces_by_their_count(spark, sf_dir, monkeypatch):
    for size in (2000, 1000):
        monkeypatch.setattr(lessons, "LESSONS", size)
        p = registry.prepared(spark, sf_dir)
        assert p.pieces >= p.lesson_frame.count() / size
        deals = [x for x in re.findall(r"Exchange hashpartitioning\(([^\n]*?)\), [A-Z_]+", plan(p.student_day)) if "student_id" in x]
        assert len(deals) == 1 and deals[0].endswith(f" {p.pieces}")  # the deal of the lessons serves all windows


def test_first_rows_stores_keys_only(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rollbook.operators import ranges

    stored = []
    keep = ranges.written
    monkeypatch.setattr(ranges, "written", lambda df, name: stored.append(df.columns) or keep(df, name))
    df = spark.range(1000).selectExpr("if(id % 100 = 7, NULL, id % 50) AS k", "id", "repeat('x', 100) AS wide")
    order = [F.col("k")]  # ties, nulls first
    want = df.orderBy("k").collect()
    for n in (0, 1, 10, 11, 500, 999, 1000, 2000):
        got = ranges.first_rows(df, n, order)
        assert sorted((r.k is not None, r.k or 0) for r in got.collect()) == sorted((r.k is not None, r.k or 0) for r in want[:n])
        assert got.columns == df.columns
    assert all("wide" not in c for c in stored)


def test_scored_rows_are_computed_once(spark):
    """The frame of a metric is evaluated once, however often it is read."""
    from pyspark.sql import functions as F

    from rollbook.operators import metrics

    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "double")
    df = spark.range(0, 200, 1, 4).selectExpr("id", "id % 2 AS y", "double(id % 9) AS score", "if(id < 100, 'a', 'b') AS stage").withColumn("score", count.asNondeterministic()("score"))
    assert metrics.group_metrics(df, "stage", "y", "score", [0.1], ["id"]).count() == 2
    assert seen.value == 200


def test_lesson_rows_are_not_dealt_again_for_joins(spark, sf_dir):
    """Joins by student and day or position use the deal of the stored frames; only the narrow slot keys are exchanged."""
    df = registry.queries()["lesson_dataset"](spark, sf_dir)
    deals = re.findall(r"Exchange hashpartitioning\(([^\n]*?)\)", plan(df))
    assert not [x for x in deals if re.search(r"\b(date|__date|pos|__at)#", x)], deals


def test_slot_histories_are_looked_up_in_the_deal_of_students(spark, sf_dir):
    """The timelines of an as-of join are unions of frames dealt alike; they are not exchanged."""
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        for name in ("score_lesson", "lesson_dataset"):
            p = plan(registry.queries()[name](spark, sf_dir))
            deals = re.findall(r"Exchange hashpartitioning\(([^\n]*?)\)", p)
            assert not [x for x in deals if re.match(r"(__by_|__)?student_id#|.*target_", x)], deals
            assert p.count("Union") == 1  # one timeline for all slots
        p = plan(registry.queries()["asof_combined"](spark, sf_dir))
        assert not re.search(r"Exchange hashpartitioning\(\w*student_id#", p)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_slot_histories_are_those_of_an_asof_join(spark):
    """Running sums over one timeline find what the general join finds, with null slots, null dates and several rows a day."""
    from pyspark.sql import functions as F

    from rollbook.operators.asof import asof_join
    from rollbook.plans import tasks

    some = lambda c, k, n: f"if((id * {k}) % 11 = 3, NULL, concat('{c}', (id * {k}) % {n}))"
    lessons_ = spark.range(400).selectExpr(
        f"{some('p', 7, 4)} AS student_id", f"{some('s', 3, 3)} AS subject", f"{some('w', 5, 2)} AS weekday_name", f"{some('t', 13, 2)} AS lesson_time_bin",
        "if(id % 17 = 5, NULL, date_add(date'2024-01-01', int((id * 29) % 40))) AS date", "id % 5 <> 1 AS has_attendance_record", "if(id % 23 = 2, NULL, id % 3 = 0) AS substantial_miss")
    asked = lessons_.selectExpr("student_id", "subject AS target_subject", "weekday_name AS target_weekday_name", "lesson_time_bin AS target_lesson_time_bin", "date_add(date, 1) AS score_date")
    want = asked
    for slot, by in tasks.SLOTS.items():
        history = tasks.slot_history(lessons_, slot).withColumnsRenamed({c: f"target_{c}" for c in by})
        want = asof_join(want, history, ["student_id", *(f"target_{c}" for c in by)], "score_date", "date", [f"hist_{slot}_lesson_count", f"hist_{slot}_substantial_rate"], 0.0)
    got = tasks.with_histories(asked, lessons_)
    columns = [F.col(c) for c in want.columns]
    assert sorted(got.columns) == sorted(want.columns) and got.count() == 400
    key = lambda r: [(v is None, v) if v is not None else (True, "") for v in map(str, r)]
    assert sorted(got.select(columns).collect(), key=key) == sorted(want.collect(), key=key)
    assert want.where("hist_subject_weekday_timebin_lesson_count > 1").count() > 20


def test_reads_are_split_by_the_number_of_lessons(spark, sf_dir, monkeypatch):
    key = "spark.sql.files.minPartitionNum"
    monkeypatch.setattr(lessons, "READ", 500)
    try:
        for name in ("chronic_20", "chronic_year_10", "short_horizon_dataset"):
            spark.conf.unset(key)
            registry.queries()[name](spark, sf_dir)
            assert int(spark.conf.get(key)) >= registry.lesson_rows(spark, sf_dir).count() / 500
        spark.conf.set(key, "100000")
        registry.lesson_rows(spark, sf_dir)
        assert spark.conf.get(key) == "100000"  # a larger number stays
    finally:
        spark.conf.unset(key)


def shuffle_files(spark):
    import glob
    import os

    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir")
    return {f for r in root.split(",") for f in glob.glob(f"{r}/**/shuffle_*.data", recursive=True)}


def test_stored_lessons_are_dealt_in_rounds_and_leave_no_shuffle_files(spark, sf_dir, monkeypatch):
    from rollbook.plans import prepare

    seen, keep = [], prepare.stored
    monkeypatch.setattr(prepare, "stored", lambda df, name, by, n, rounds=1: seen.append((name, rounds)) or keep(df, name, by, n, rounds))
    key = "spark.sql.files.minPartitionNum"
    try:
        few = registry.prepared(spark, sf_dir).stored_lessons().lesson_frame.count()
        monkeypatch.setattr(lessons, "LESSONS", 300)
        monkeypatch.setattr(lessons, "READ", 1000)
        p = registry.prepared(spark, sf_dir)
        whole, before = p.lesson_frame, shuffle_files(spark)
        frame = p.stored_lessons().lesson_frame
        assert not shuffle_files(spark) - before
        assert seen == [("lesson_frame", 1), ("lesson_frame", lessons.ROUNDS)] and lessons.ROUNDS > 1
        assert frame.count() == few
        assert not frame.exceptAll(whole).count() and not whole.exceptAll(frame).count()
    finally:
        spark.conf.unset(key)


def test_rounds_store_every_row_in_its_bucket_once(spark):
    """A round holds its own buckets, also that of null keys; the session's setting of shuffle files is as before."""
    import glob

    from rollbook.sources import shared

    df = spark.range(0, 3000, 1, 3).selectExpr("if(id % 50 = 7, NULL, concat('S', id % 40)) AS student_id", "id")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for rounds in (1, 3, 4, 9):
        out = shared.stored(df, "some", "student_id", 7, rounds)
        assert sorted(out.collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
        files = [f for p in {f.rsplit("/", 1)[0].removeprefix("file://") for f in out.inputFiles()} for f in glob.glob(f"{p}/*.parquet")]
        buckets = [re.search(r"_(\d{5})\.", f).group(1) for f in files]
        assert len(buckets) == len(set(buckets)) <= 7
        assert "Exchange" not in plan(out.groupBy("student_id").count())
        assert spark.conf.get(key, "false") == "false"


def test_scored_days_come_from_buckets_by_the_number_of_lessons(spark, sf_dir, monkeypatch):
    """A task of `score_short_horizon` holds the students of one piece; more lessons make more pieces, dealt in rounds."""
    key = "spark.sql.files.minPartitionNum"
    monkeypatch.setattr(lessons, "READ", 1000)
    try:
        for size in (1500, 750):
            monkeypatch.setattr(lessons, "LESSONS", size)
            before = shuffle_files(spark)
            df = registry.queries()["score_short_horizon"](spark, sf_dir)
            assert not shuffle_files(spark) - before  # the deal of the lessons and all tables written before are done with
            p = plan(df)
            deals = re.findall(r"Exchange hashpartitioning\(([^\n]*?)\)", p)
            assert not [x for x in deals if "student_id" in x], deals
            buckets = {int(x) for x in re.findall(r"SelectedBucketsCount: \d+ out of (\d+)", p)}
            assert buckets and min(buckets) >= registry.lesson_rows(spark, sf_dir).count() / size
    finally:
        spark.conf.unset(key)


def test_wide_stages_are_run_by_compiled_code(spark, sf_dir):
    """The JVM interprets methods of over 8,000 bytes; Spark is told to make none for a stage, and a smaller limit stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for name in ("lesson_dataset", "chronic_year_10"):
            spark.conf.set(key, "65535")
            registry.queries()[name](spark, sf_dir)
            assert int(spark.conf.get(key)) <= 8000
        spark.conf.set(key, "4000")
        registry.lesson_rows(spark, sf_dir)
        assert spark.conf.get(key) == "4000"
    finally:
        spark.conf.set(key, before)


def test_results_are_rounded_without_decimals(spark):
    """Whole billionths, as decimal rounding gives them; only numbers of over four million take that."""
    from pyspark.sql import functions as F

    values = [None, float("nan"), float("inf"), -float("inf"), -0.0, -1e-12, 1e300, 5e-10, 4.9e-10, -5e-10, 1 / 1024, 123456.1234567895, 3999999.123456789, 4000001.123456789, *(a / b for a in range(-40, 40) for b in range(1, 60))]
    df = spark.createDataFrame([(x,) for x in values], "x double").select(registry._rounded(F.col("x")).alias("a"), F.round("x", 9).alias("b"))
    assert df.where("NOT a <=> b").count() == 0
    assert [str(r.a) for r in df.limit(6).collect()][4:] == ["0.0", "0.0"]
