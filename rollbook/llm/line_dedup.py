"""Site-relative line dedup with DataFrame functions only.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds
``max_ratio`` and at least ``min_pages`` of them do. Lines are compared without blanks and tabs at their
ends; empty lines are never boilerplate. The rule is the same at any size of a host.

A host with P pages and L distinct lines a page on average has fewer than L / max_ratio boilerplate
lines, so the list kept for each host stays small however many pages the host has. Counting sends
128-bit line digests, pre-aggregated before the shuffle, never the lines. Whether the list is
broadcast or joined by a (skew-split) sort-merge join is left to Spark, which knows the size of the
written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, wide_hash

MAX_RATIO = 0.1
MIN_PAGES = 3


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host with boilerplate: ``host, lines array<struct<k1 long, k2 long>>``."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where("host IS NOT NULL")
    line = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("line")
    counts = (
        pages.select("host", line).where("line <> ''")
        .groupBy("host", *wide_hash(F.col("line"), "k")).agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    over = counts.join(totals, "host").where(F.col("n") > max_ratio * F.col("total"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``__lines`` and ``__dropped`` (counts).

    * Every row stays, with its other columns as they were, whatever their names; a text may become empty.
      Columns named ``__lines`` and ``__dropped`` make way for the results.
    * Null text: stays null, 0 lines. Null host: no site to compare with, text unchanged.
    * A line on fewer than ``min_pages`` pages of its host stays.
    * Repeated rows each count as a page, also where they repeat an id; a line counts once a page.
    * An empty table gives an empty result.
    """
    spec = materialise(boilerplate_lines(docs, host, text, max_ratio, min_pages), "boilerplate")
    names = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{host}`").alias("host"), F.split(f"`{text}`", "\n").alias("lines"))
    rows = rows.join(spec.withColumnRenamed("lines", "boilerplate"), "host", "left")
    keyed = F.transform("lines", lambda x: F.struct(x.alias("x"), *wide_hash(_key(x), "k")))
    kept = F.filter(keyed, lambda x: ~F.exists("boilerplate", lambda b: (b["k1"] == x["k1"]) & (b["k2"] == x["k2"])))
    rows = rows.withColumns({"kept": F.when(F.col("boilerplate").isNotNull(), kept), "n": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")})
    rows = rows.withColumn("dropped", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long"))
    cleaned = F.when(F.col("dropped") > 0, F.array_join(F.col("kept")["x"], "\n")).otherwise(F.col("row")[text])
    return rows.select(*((cleaned if c == text else F.col("row")[c]).alias(c) for c in names), F.col("n").alias("__lines"), F.col("dropped").alias("__dropped"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without their source's boilerplate lines; odd rows as in :func:`drop_boilerplate`."""
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


OP2_SQL = """
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos
      FROM d WHERE text IS NOT NULL),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
n AS (SELECT source, key, count(DISTINCT r) AS n FROM k WHERE key <> '' AND source IS NOT NULL GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (SELECT source, key FROM n JOIN t USING (source) WHERE n >= 3 AND n > 0.1 * total),
c AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (b.key IS NULL) AS text, count(*) AS n_lines, count(b.key) AS n_dropped
      FROM k LEFT JOIN b ON k.source = b.source AND k.key = b.key GROUP BY r)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM d LEFT JOIN c USING (r)
"""
