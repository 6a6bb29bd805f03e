"""Toxicity by held-out accuracy, and on odd texts."""

import random
import string

import numpy as np
from pyspark.sql import functions as F

from rollbook.llm import toxicity

DOC = "doc_id long, text string, toxic int"


def texts(n, seed=1):
    """Plain words, and in every fifth text a few words grown from three stems."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(30, 120))]
        toxic = int(i % 5 == 0)
        for k in range(0, len(words), 20) if toxic else ():
            words[k] = rng.choice(("vrexqu", "okjarz", "zywhol")) + rng.choice(syllables)
        rows.append((i, " ".join(words), toxic))
    return rows


def fitted(spark, rows):
    df = spark.createDataFrame(rows, DOC)
    return toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_unseen_forms_of_learned_stems(spark):
    rows = texts(900)
    model = fitted(spark, rows[:700])
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows[700:], DOC).drop("toxic"), model).collect()}
    right = [got[i]["predicted"] == y for i, _, y in rows[700:]]
    assert len(got) == 200 and np.mean(right) > 0.97
    assert all((r["score"] >= 0.5) == r["predicted"] and 0 <= r["score"] <= 1 for r in got.values())
    plain, known, misspelt = model.of_words(["tabodu", "vrexquba", "vrexqqu"])
    assert plain < misspelt < known


def test_odd_texts(spark):
    model = fitted(spark, texts(300))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n ?! ", "c"), (4, "ba " * 200_000 + "x" * 300_000, "d"), (5, "vrexquba " * 3, "e"), (5, "vrexquba " * 3, "f"), (None, "中文 ünï \U0001f600", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.score(frame, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    by = {(r["doc_id"], k): r["score"] for k, r in enumerate(sorted(got.collect(), key=lambda r: (r["doc_id"] or 0)))}
    alone = 1 / (1 + np.exp(-model.bias))
    assert [by[k] for k in sorted(by, key=lambda k: k[1])[1:4]] == [alone] * 3 and alone < 0.5
    assert by[5, 5] == by[5, 6] > 0.5
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_fits_without_two_classes(spark):
    empty = fitted(spark, [])
    assert toxicity.score(spark.createDataFrame([(1, "x", 0)], DOC).drop("toxic"), empty).first()["predicted"] == 0
    clean = fitted(spark, [(1, "some words", 0), (2, None, 1), (3, "more", None), (4, "words", 2), (None, "words", 1)])
    assert toxicity.score(spark.createDataFrame([(1, "some", 0)], DOC).drop("toxic"), clean).first()["predicted"] == 0


def test_buckets_are_those_of_each_word():
    rng = random.Random(2)
    words = ["".join(rng.choices(string.ascii_lowercase + "éß中", k=rng.randint(1, 9))) for _ in range(50)] + ["x" * 1000]
    bucket, owner = toxicity.buckets(words)
    for i, w in enumerate(words):
        alone, _ = toxicity.buckets([w])
        assert sorted(bucket[owner == i]) == sorted(alone) and len(alone) == 1 + sum(max(0, len(w) + 3 - n) for n in toxicity.GRAMS)
    cache = {}
    model = toxicity.Toxicity(np.random.default_rng(1).standard_normal(toxicity.WIDTH), 0.0)
    assert np.allclose(model.logits(["a b", "b", None], cache), [model.of_words(["a", "b"]).mean(), model.of_words(["b"])[0], 0.0])


def test_held_out_documents(spark, sf_dir):
    """Labels and sources are no inputs: scores stay when they change."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.op12_toxicity(spark, sf_dir)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    seen = got.join(labels, "doc_id")
    means = {r["toxic"]: r["m"] for r in seen.groupBy("toxic").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0]
