"""Joins that Spark has no operator of its own for, as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]
#: Rows of a side that may be broadcast (a lookup of a few columns).
BROADCAST_ROWS = 100_000


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a side has at most so many rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def as_of(left: DataFrame, right: DataFrame, keys: Names, time: str, values: Names) -> DataFrame:
    """Each left row with ``values`` of the latest right row of its keys at or
    before its time; nulls where there is none.  One shuffle on the keys: both
    sides in one ordered stream, so no pairs are made.  Of right rows of the
    same keys and time any one is taken."""
    others = [c for c in left.columns if c not in (*keys, time)]
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in left.schema if f.name in others}
    absent = F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType)
    asked = left.select(*keys, time, F.lit(1).alias("_side"), *others, absent.alias("_found"))
    given = right.select(*keys, time, F.lit(0).alias("_side"), *[nothing[c].alias(c) for c in others], F.struct(*values).alias("_found"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    latest = given.unionByName(asked).withColumn("_found", F.last("_found", ignorenulls=True).over(w)).where("_side = 1")
    return latest.select(*left.columns, *[F.col("_found")[v].alias(v) for v in values])


def band_join(df: DataFrame, value: str, bands: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with the disjoint band [low, high) that holds their value.  A few
    bands are broadcast; many are met by as-of order instead of pairs."""
    within = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    if small_enough(bands):
        return df.join(F.broadcast(bands), within)
    kind = bands.schema[low].dataType
    asked = df.withColumn("_at", F.col(value).cast(kind)).withColumn("_all", F.lit(0))
    given = bands.withColumn("_at", F.col(low)).withColumn("_all", F.lit(0))
    return as_of(asked, given, ["_all"], "_at", bands.columns).where(within).drop("_at", "_all")
