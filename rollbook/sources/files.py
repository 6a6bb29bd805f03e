"""Readers and writers by file extension."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import SCHEMAS, conform


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """csv (header, all strings) or parquet, by the lower-cased extension."""
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        return spark.read.option("header", True).csv(path)
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type: {path}")


def load_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The three tables, validated and typed; ``paths`` by table name."""
    return {t: conform(t, load_table(spark, str(paths[t]))) for t in SCHEMAS}


def _hadoop(path: str):
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(path: str) -> bool:
    """Whether there is a file or folder, in any store that the active session reaches."""
    system, place = _hadoop(path)
    return system.exists(place)


def read_text(path: str) -> str:
    """A small text file."""
    row = SparkSession.active().read.text(path, wholetext=True).first()
    return row[0] if row else ""


def write_text(path: str, text: str) -> None:
    """A small text file in place of what was there, with its folders: written aside and renamed, so readers see the old or the new one."""
    system, place = _hadoop(path)
    aside = place.suffix(f".{uuid.uuid4().hex}.tmp")
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    spark = SparkSession.active()
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, place, how)


def write_frame(df: DataFrame, path: str) -> None:
    """csv for ``.csv``, else parquet."""
    if PurePosixPath(path).suffix == ".csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_feature_table(df: DataFrame, folder: str, task: str) -> str:
    """Feature table of a task, partitioned by school year so that experiments read only their years."""
    path = f"{folder}/{task}.parquet"
    df.write.mode("overwrite").partitionBy("academic_year").parquet(path)
    return path


def schema_sidecar(df: DataFrame, target: str, numeric: list[str], categorical: list[str], ids: list[str]) -> str:
    return json.dumps({"target": target, "id_columns": ids, "numeric_features": numeric, "categorical_features": categorical, "columns": df.columns, "dtypes": dict(df.dtypes)}, indent=2)


def feature_summary(df: DataFrame, target: str) -> DataFrame:
    """``row_count, positive_rate, years`` in one pass."""
    return df.agg(F.count("*").alias("row_count"), F.avg(target).alias("positive_rate"), F.array_join(F.sort_array(F.collect_set("academic_year")), ",").alias("years"))
