"""The three contract tables, derived from ``lineitem`` and ``supplier``.

Suppliers stand for students and line items for lessons; edge cases are planted on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..names import VALIDITY


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
        "concat('S', l_suppkey) AS student_id",
        "concat('SCH', s_nationkey % 5) AS school_id",
        "concat('C', s_nationkey) AS class_id",
        "if(l_suppkey % 10 = 0, 'F', string(l_suppkey % 10)) AS grade",
        "date(l_shipdate) AS date",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS lesson_id",
        "concat('SUBJ', l_partkey % 6) AS subject",
        "l_shipdate + make_dt_interval(0, 7 + l_linenumber) AS start_at",
        "l_shipdate + interval '15' hour AS created_at",
        "l_shipdate + interval '16' hour AS updated_at",
        "l_shipdate + interval '40' hour AS corrected_at",
        "double(40 + 5 * (l_linenumber % 3)) AS sched_min",
        """double(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_quantity >= 26 + 3 * (l_suppkey % 8) THEN 40 + 5 * (l_linenumber % 3)
           WHEN l_quantity >= 20 + 3 * (l_suppkey % 8) THEN 15 ELSE 0 END) AS miss_min""",
        "decode(l_returnflag, 'R', 'ogiltig', 'A', 'giltig', 'present') AS validity",
        "concat(year(l_shipdate) - if(month(l_shipdate) < 8, 1, 0), if(month(l_shipdate) < 8, '_VT', '_HT')) AS term_id",
        "l_tax < double('0.075') AS recorded", "l_discount >= double('0.095') AS corrected", "l_orderkey AS ok",
    )


def attendance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).where("recorded")
    common = ["student_id", "school_id", "class_id", "grade", "term_id", "date", "lesson_id", "subject"]
    first = rows.selectExpr(
        *common, "if(ok % 97 = 0, NULL, start_at) AS scheduled_start_at", "sched_min AS scheduled_minutes",
        "if(ok % 53 = 0 OR ok % 59 = 0, NULL, sched_min - miss_min) AS attended_minutes", "if(ok % 53 = 0, NULL, miss_min) AS missed_minutes",
        f"validity AS {VALIDITY}", "created_at AS record_created_at", "if(ok % 211 = 0, NULL, updated_at) AS record_updated_at",
    )
    later = rows.where("corrected").selectExpr(
        *common, "start_at AS scheduled_start_at", "sched_min AS scheduled_minutes", "sched_min AS attended_minutes", "0.0D AS missed_minutes",
        f"'present' AS {VALIDITY}", "created_at AS record_created_at", "corrected_at AS record_updated_at",
    )
    return first.unionByName(later)


def student_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).selectExpr(
        "student_id", "school_id", "class_id", "grade", "date", "lesson_id", "if(ok % 89 = 0, NULL, subject) AS subject",
        "if(ok % 97 = 0, NULL, start_at) AS scheduled_start_at", "sched_min AS scheduled_minutes",
    )


def school_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = base(spark, sf_dir).select("school_id", "date", "term_id").distinct().where("day(date) <> 13")
    open_ = F.weekday("date") < 5
    index = F.sum(open_.cast("int")).over(Window.partitionBy("school_id", "term_id").orderBy("date"))
    return days.withColumn("is_instructional_day", open_).withColumn("school_day_index", index.cast("int"))
