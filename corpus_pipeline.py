"""Corpus cleaning over ``documents``: language ID, line dedup, near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import jaccard_join, language_id, line_dedup, packing
from rollbook.llm.common import materialise, ship, table
from rollbook.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart, with that language; texts without a letter or with a narrow margin go."""
    ship(spark)
    out = language_id.identify(docs.drop("lang"), language_id.fit(docs), keep_text=True)
    return out.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines: on 3 or more and over a tenth of its documents, at any size of source."""
    ship(spark)
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingles at a similarity of 0.8; documents without words stay.

    Where an id repeats or is null, each row is judged by its own text, and of rows with one set of
    shingles one stays.
    """
    ship(spark)
    rows = materialise(jaccard_join.jaccard_rows(docs, words=5, num=80, den=100), "groups")
    odd = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "odd")
    copies = rows.where("doc_id <> component_id").select("doc_id").unionByName(odd.dropna()).distinct()
    kept = docs.where("doc_id IS NOT NULL").join(materialise(copies, "copies"), "doc_id", "left_anti").select(COLUMNS)
    if odd.isEmpty():
        return kept
    mine = rows.where("doc_id <=> component_id OR n_shingles = 0").select(F.col("doc_id").alias("__id"), "d1", "d2", "n_shingles").distinct()
    again = docs.where("doc_id IS NULL").unionByName(docs.join(odd, "doc_id", "left_semi").select(docs.columns))
    again = jaccard_join.with_digest(again).join(mine, ["d1", "d2"]).where("doc_id <=> __id")
    return kept.unionByName(again.where("n_shingles = 0").select(COLUMNS)).unionByName(again.where("n_shingles > 0").dropDuplicates(["doc_id", "d1", "d2"]).select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack),
]

#: Compression sizes and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all stages keep.

    Null and empty texts go with language ID, as do texts without a letter; rows that repeat an id or have
    none are judged by their own texts; texts of any length are taken whole; an empty table gives no piece;
    columns other than those of documents are dropped.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
