"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in ``spark.checkpoint.dir``; a temporary one only for a local master that names none.

    It may be deleted as a whole when the application has ended.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within are deleted as soon as a write ends; nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, by: str, n: int | None = None, rounds: int = 1) -> DataFrame:
    """Write ``df`` to the shared folder in ``n`` buckets of ``by`` (by default as many as a shuffle has) and read it again.

    What follows starts from the files, also after executors are lost, and groupings, windows and joins
    by ``by``, with or without further keys, need no exchange; for joins with further keys the session is told that a
    deal by some of them will do. The catalog entry that buckets need is dropped again; the files stay until
    the application's folder goes.

    In several ``rounds`` each deals and writes its share of the buckets, so that the files of the shuffle take up a
    share of the disk; what ``df`` reads is read once a round, and shuffled once in all.
    """
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    turn = F.pmod(F.pmod(F.hash(by), F.lit(n)), F.lit(rounds))  # of a bucket
    with cleared(spark):
        for i in range(rounds):
            share = df.where(turn == i) if rounds > 1 else df
            share.repartition(n, by).write.bucketBy(n, by).option("path", f"{shared_folder(spark)}/{table}").option("compression", "zstd").mode("append").saveAsTable(table)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: ``out`` keeps its files and buckets
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The same without buckets, for a frame that is read several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    with cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
