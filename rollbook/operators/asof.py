"""As-of join: the latest known values at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], default: float | None = None) -> DataFrame:
    """Add ``values`` of the latest ``right`` row with equal ``by`` and ``right_time <= left_time``.

    Both sides are merged into one timeline by a union; a window over each key carries the last known
    values forward. Each side is read once. Sides dealt alike by a part of the key, as tables in as many buckets are, need
    no exchange for the window: their keys get names of their own, so that the union sees one deal in both. Ask with few
    columns, as all of them are sorted. Rows of one key must be few enough to sort together, as a student's are. Null keys
    or times, and keys without history, get ``default``; a null value does not hide an earlier one.
    """
    own = {c: f"__by_{c}" for c in by}
    kinds = {v: right.schema[v].dataType for v in values}
    known = right.dropna(subset=[*by, right_time]).select(*by, F.col(right_time).alias(left_time), *values, F.lit(False).alias("__asked"))
    asked = left.withColumns({**{v: F.lit(None).cast(k) for v, k in kinds.items()}, "__asked": F.lit(True)})
    known, asked = known.withColumnsRenamed(own), asked.withColumnsRenamed(own)
    w = Window.partitionBy(*own.values()).orderBy(left_time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(known, allowMissingColumns=True).withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    out = found.where("__asked").drop("__asked").withColumnsRenamed({o: c for c, o in own.items()})
    return out if default is None else out.withColumns({v: F.coalesce(F.col(v), F.lit(default)) for v in values})
