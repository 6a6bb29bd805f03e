"""Canonical exact digests of texts with DataFrame functions only.

Canonical text: NFKC, full case folding, NFKC again, every run of white space as one blank, none at
the ends. Normaliser and case folding are those of ICU, which Spark itself ships for its collations;
SQL reaches them by ``java_method``. The fingerprint is 128 bits of xxhash64. Documents whose hashes
are equal are then compared byte for byte with the first of their bucket; a bucket that holds
different texts gets the SHA-256 of each text appended to its fingerprints, so equal fingerprints
always mean equal canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, spread, table, wide_hash


def canonical(text: Column) -> Column:
    """Canonical form; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def nfkc(x: Column) -> Column:
        return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.octet_length(text) == F.length(text)  # ASCII is in every normal form
    return F.btrim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"(?U)\s+", " "))


def _hex(a: str, b: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (a, b))))


def split_buckets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Hash buckets ``f1, f2`` that hold different canonical texts (hardly ever any).

    Hashes are counted first; only buckets with several rows are compared, each row with the text of
    the bucket's smallest id. Both joins are plain equi-joins whose hot keys Spark can split.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), canonical(F.col(text)).alias("c")).select("id", "c", *wide_hash(F.col("c"), "f"))
    shared = keyed.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    shared = materialise(shared.select("f1", "f2", "id"), "buckets")
    first = keyed.join(shared, ["id", "f1", "f2"]).groupBy("f1", "f2").agg(F.min("c").alias("first"))
    # written before the distinct, so that Spark may split a hot bucket in this join
    return materialise(keyed.join(first, ["f1", "f2"]).where("c <> first").select("f1", "f2"), "collisions").distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct canonical text: ``fingerprint, group_id`` (smallest id), ``n`` rows.

    Null text counts as empty; repeated rows count again; an empty table gives no groups.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return with_fingerprint(keyed, "text", "fingerprint", split_buckets(keyed, "id")).groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count("*").alias("n"))


def with_fingerprint(df: DataFrame, text: str, out: str, buckets: DataFrame) -> DataFrame:
    """Add the fingerprint of column ``text`` as ``out``; ``buckets`` come from :func:`split_buckets`."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # so that no name of a column is in the way
    keyed = df.select(whole, canonical(F.col(f"`{text}`")).alias("c")).select("row", "c", *wide_hash(F.col("c"), "f"))
    keyed = keyed.join(buckets.select("f1", "f2", F.lit(True).alias("split")), ["f1", "f2"], "left")
    print_ = F.when(F.col("split").isNull(), _hex("f1", "f2")).otherwise(F.concat(_hex("f1", "f2"), F.lit("-"), F.sha2("c", 256)))
    names = [c for c in df.columns if c != out]
    return keyed.select(*(F.col("row")[c].alias(c) for c in names), print_.alias(out))


def with_next(docs: DataFrame, doc_id: str = "doc_id", cols: tuple[str, ...] = ("text",)) -> DataFrame:
    """Add ``next_<col>`` of the row that follows by ascending id (after the last: the first).

    Other columns stay as they were, whatever their names; those named like a result make way for it.
    Rows are cut into id ranges at quantiles of the ids, so each window holds a bounded share however
    the ids lie; each range also receives a copy of the first row of the following range. Equal ids
    are ordered by the columns. Null ids come first.
    """
    spark = docs.sparkSession
    n = spread(spark, 4)
    cuts = docs.select(F.percentile_approx(doc_id, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.col(doc_id)
    bucket = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c <= at)) if cuts else F.lit(0)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no name of a column is in the way
    ranged = docs.select(whole, at.alias("id"), F.when(at.isNull(), 0).otherwise(bucket).alias("bucket"), F.lit(0).alias("halo"))
    least = F.coalesce("id", F.lit(-(2**63)))
    # a row for each range that has rows: at most n
    firsts = sorted(ranged.groupBy("bucket").agg(F.min(least).alias("id")).collect(), key=lambda r: (r["bucket"], r["id"]))
    ids = [r["id"] for r in firsts]
    before = {i: firsts[k - 1]["bucket"] for k, i in enumerate(ids)}  # the range before each first row; that of the very first is the last
    w = Window.partitionBy("bucket").orderBy("halo", F.col("id").asc_nulls_first(), *(F.col("row")[c] for c in cols))
    both = ranged
    if firsts:
        to = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), least)
        both = ranged.unionByName(ranged.where(least.isin(ids)).withColumn("bucket", to).withColumn("halo", F.lit(1)))
    nexts = [F.lead(F.col("row")[c]).over(w).alias(f"next_{c}") for c in cols]
    names = [c for c in docs.columns if c not in {f"next_{x}" for x in cols}]
    return both.select("row", "halo", *nexts).where("halo = 0").select(*(F.col("row")[c].alias(c) for c in names), *(f"next_{c}" for c in cols))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    An exact digest is either the same or not: likenesses are 1.0 for equal fingerprints whose canonical
    texts are also equal byte for byte, else 0.0. Null text counts as empty. Ids that repeat are ordered by
    text; a table of one row follows itself; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    buckets = split_buckets(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("n_chars", n.cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
    for text, out in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        rows = with_fingerprint(rows, text, out, buckets)
    same = {f"near_{x}": ((F.col("fingerprint") == F.col(f"{x}_fingerprint")) & (canonical(F.col("text")) == canonical(F.col(c)))).cast("double") for x, c in (("edited", "edited"), ("next", "next_text"))}
    return rows.withColumns(same).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
