"""Ranks and running totals over a whole table in a total order, without gathering it in one task.

Rows are dealt into ranges of the order, cut at a few sampled keys; totals of the ranges, a small table,
carry over what comes before. Each range is sorted by itself.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Most ranges, and sampled keys for each.
RANGES, SAMPLED = 512, 40


def descending(c: str) -> Column:
    """Ascending key of a number in descending order, nulls last."""
    return F.coalesce(-F.col(c), F.lit(float("inf")))


def _range(df: DataFrame, order: list[Column]) -> Column:
    """Number of the range of a row's key, by a search in cuts that are drawn once and stay."""
    pieces = min(RANGES, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    names = [f"k{i}" for i in range(len(order))]
    keys = df.select(*(c.alias(n) for c, n in zip(order, names, strict=True)))
    share = min(1.0, pieces * SAMPLED / max(1, keys.count()))
    drawn = keys.where(F.pmod(F.xxhash64(*names), F.lit(1 << 40)) < int(share * (1 << 40))).distinct().orderBy(*names).collect()
    kinds = [f.dataType for f in keys.schema.fields]
    cuts = [F.struct(*(F.lit(v).cast(k) for v, k in zip(r, kinds, strict=True))) for r in drawn[len(drawn) // pieces :: max(1, len(drawn) // pieces)]]
    key = F.struct(*order)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Add sums of ``totals`` over all rows up to each row in ``order``, within equal ``by``.

    Rows with equal keys are counted one after the other. Rows with a null in ``by`` are a group. The
    rows are written to the shared folder first, as they are read several times.
    """
    names = [f"__key_{i}" for i in range(len(order))]
    df = written(df.withColumns({**{f"__sum_{n}": c for n, c in totals.items()}, **dict(zip(names, order, strict=True))}), "ranked")
    order = [F.col(n) for n in names]
    df = df.withColumn("__range", _range(df, order))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = df.groupBy(*by, "__range").agg(*(F.sum(f"__sum_{n}").alias(n) for n in totals))
    sums = sums.select(*(F.col(b).alias(f"__by_{b}") for b in by), F.col("__range").alias("__range_of"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in totals))
    on = F.col("__range") == F.col("__range_of")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__sum_{n}": F.sum(f"__sum_{n}").over(within) for n in totals}).join(sums, on)
    df = df.withColumns({n: F.col(f"__sum_{n}") + F.col(f"__before_{n}") for n in totals})
    return df.drop("__range", "__range_of", *names, *(f"__by_{b}" for b in by), *(f"{x}{n}" for n in totals for x in ("__sum_", "__before_")))


#: Ranges of a digest, by its first three hexadecimal digits, and rows of a task that sorts some of them.
DIGITS, SORTED = 3, 1_000_000


def digest_rank(df: DataFrame, digest: Column, ties: list[str], out: str) -> DataFrame:
    """Add the rank from 1 in the order of an MD5 digest; equal digests by ``ties``.

    Digests are spread evenly, so their first digits make even ranges; each is sorted by itself, and the counts
    of the ranges, a small table, carry over. ``df`` is read twice.
    """
    df = df.withColumn("__digest", digest).withColumn("__range", F.substring("__digest", 1, DIGITS))
    sizes = sorted(tuple(r) for r in df.groupBy("__range").count().collect())  # 4,096 rows at most
    before = list(accumulate((n for _, n in sizes), initial=0))
    offsets = df.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sizes, before, strict=False)], "__range string, __before long")
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), before[-1] // SORTED)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__digest", *ties))
    df = df.repartition(tasks, "__range").withColumn("__rank", rank).join(F.broadcast(offsets), "__range")
    return df.withColumn(out, F.col("__rank") + F.col("__before")).drop("__digest", "__range", "__rank", "__before")


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in ``order``.

    Only the keys are written, and only the range that holds the ``n``-th is sorted; rows are then taken up to its
    key, so wide rows are neither stored nor moved. Of rows that share that key, as many as are wanted.
    """
    if n <= 0:
        return df.limit(0)
    names = [f"__key_{i}" for i in range(len(order))]
    keys = written(df.select(*(c.alias(k) for k, c in zip(names, order, strict=True))), "ranked")
    ranged = keys.withColumn("__range", _range(keys, [F.col(k) for k in names]))
    sizes = sorted(tuple(r) for r in ranged.groupBy("__range").count().collect())  # a row for each range
    before = 0
    for number, size in sizes:
        if before + size >= n:
            break
        before += size
    else:
        return df
    ranks = ranged.where(F.col("__range") == number).withColumn("__rank", F.row_number().over(Window.partitionBy("__range").orderBy(*names)))
    last = ranks.where(F.col("__rank") == n - before).first()
    cut = F.struct(*(F.lit(last[f.name]).cast(f.dataType) for f in keys.schema.fields))
    more, wanted = ranks.where(F.struct(*names) == cut).agg(F.count_if(F.col("__rank") > n - before), F.count_if(F.col("__rank") <= n - before)).first()
    key = F.struct(*order)
    return df.where(key < cut).unionByName(df.where(key == cut).limit(wanted)) if more else df.where(key <= cut)
