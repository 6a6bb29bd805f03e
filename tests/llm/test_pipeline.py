"""The corpus pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
from rollbook.llm import queries

from .test_operators import components, frame, word_set


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    kept = [n]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            kept.append(docs.count())
        if k == 2:
            rows = sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
            sets = [word_set(t, 5) for _, t in rows]
            pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            want = {d for i, ((d, _), c) in enumerate(zip(rows, components(len(rows), pairs), strict=True)) if c == i}
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
    assert 0.8 * n < kept[1] <= n and kept[2] == kept[1] and kept[3] < kept[2]
    assert docs.select("doc_id").distinct().count() == kept[3]


def test_lines_of_small_sources(spark, sf_dir):
    rows = [(i, f"Menu\nline {i}" + ("\nTwice" if i < 2 else ""), "en", "s0", 1) for i in range(19)] + [(30 + i, "Both", "en", "s1", 4) for i in range(2)]
    rows += [(40 + i, "Menu\nFew" if i < 3 else f"Menu\nown {i}", "en", "s2", 1) for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, frame(spark, rows), sf_dir).collect()}
    want = {i: f"line {i}" + ("\nTwice" if i < 2 else "") for i in range(19)} | {30: "Both", 31: "Both"}
    assert got == want | {40 + i: "Few" if i < 3 else f"own {i}" for i in range(30)}


def test_registry_names():
    names = list(queries.queries())
    assert [x.split("_")[0] for x in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_near_duplicates_of_odd_ids(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(7, long), (7, "other words that stand alone here"), (None, f"{long} x"), (3, f"{long} y"), (None, "nothing else is like this one"), (9, long), (9, long)]
    rows += [(20, "a text of its own that comes twice"), (20, "a text of its own that comes twice"), (30, "..."), (31, None), (31, "")]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    want = [(7, rows[1][1]), (3, rows[3][1]), (None, rows[4][1]), (20, rows[7][1]), (30, "..."), (31, None), (31, "")]
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(map(str, want))


def test_empty_table(spark, sf_dir, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
