"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once, unless the session sets a number: texts are long, and both sides hold such a batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once for each application, in batches that suit texts."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    atexit.register(shutil.rmtree, os.path.dirname(path), ignore_errors=True)
    with zipfile.ZipFile(path, "w") as out:
        for f in (root / "__init__.py", *sorted(Path(__file__).resolve().parent.glob("*.py"))):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, as named in ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set for a local master (unit tests in
    one JVM); any other master raises, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
        _own_dirs[app] = f"file://{path}"
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before.

    It lies in a folder of the application, which may be deleted as a whole when that has ended.
    """
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Lost executors recompute only what follows. The re-read table also has a known size, so Spark
    itself decides whether a later join may broadcast it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide_hash(col: Column, name: str) -> list[Column]:
    """128 bits of xxhash64 as two longs ``<name>1`` and ``<name>2``."""
    return [F.xxhash64(col).alias(f"{name}1"), F.xxhash64(F.lit(1), col).alias(f"{name}2")]


def spread(spark: SparkSession, times: int = 1) -> int:
    """Partitions for an explicit exchange, following the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times
