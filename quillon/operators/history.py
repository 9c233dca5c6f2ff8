"""Differences between successive records, templates and shapes, as window plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans import selection

Names = list[str]


def differences(df: DataFrame, key: Names, order: Names, fields: Names) -> DataFrame:
    """Per record: ``changed`` (fields that differ from the record before),
    ``full`` for the first, and each field's value where it changed."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    differ = {f: ~F.col(f).eqNullSafe(F.lag(f).over(w)) for f in fields}
    rows = df.withColumns({"full": first, **{f"_c_{f}": first | differ[f] for f in fields}})
    count = sum((F.col(f"_c_{f}").cast("int") for f in fields[1:]), F.col(f"_c_{fields[0]}").cast("int"))
    return rows.select(
        *key, *order, "full", F.when(F.col("full"), 0).otherwise(count).alias("changed"),
        *[F.when(F.col(f"_c_{f}"), F.struct(F.col(f).alias("v"))).alias(f"set_{f}") for f in fields],
    )


def replay(df: DataFrame, key: Names, order: Names, fields: Names) -> DataFrame:
    """Applies the differences in order: the inverse of ``differences``."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*key, *order, *[F.last(f"set_{f}", ignorenulls=True).over(w)["v"].alias(f) for f in fields])


def patch_choice(df: DataFrame, fields: Names, patch_size, full_size) -> DataFrame:
    """Adds ``patch``: whether a record goes out as a difference."""
    use = selection.use_patch(F.col("changed"), F.lit(len(fields)), patch_size, full_size)
    return df.withColumn("patch", ~F.col("full") & use)


def template_masks(df: DataFrame, key: Names, batch: str, order: Names, fields: Names) -> DataFrame:
    """Per batch: which columns differ from the same column of the batch before."""
    columns = [F.array_sort(F.collect_list(F.struct(*order, F.col(f).alias("v")))).getField("v").alias(f) for f in fields]
    lists = df.groupBy(*key, batch).agg(F.count("*").alias("n"), *columns)
    w = Window.partitionBy(*key).orderBy(batch)
    mask = [(~F.col(f).eqNullSafe(F.lag(f).over(w))).alias(f"changed_{f}") for f in fields]
    return lists.select(*key, batch, "n", *mask)


def shapes(df: DataFrame, key: Names, order: Names, names: str, fewest: int = 3) -> DataFrame:
    """Adds how often a key sequence was seen so far, and whether it goes out as
    a shape: from the second time on, with ``fewest`` keys or more."""
    w = Window.partitionBy(*key, names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn("seen", F.count("*").over(w))
    return seen.withColumn("shaped", (F.col("seen") >= 2) & (F.size(F.split(names, ",")) >= fewest))


def string_modes(df: DataFrame, key: Names, order: Names, value: str) -> DataFrame:
    """Adds ``mode``: EMPTY, REF for a string seen before in the scope, or LITERAL."""
    w = Window.partitionBy(*key, value).orderBy(*order)
    again = F.row_number().over(w) > 1
    return df.withColumn("mode", F.when(F.col(value) == "", "EMPTY").when(again, "REF").otherwise("LITERAL"))


def against_snapshot(df: DataFrame, key: Names, order: Names, fields: Names, back: int) -> DataFrame:
    """Per record: fields that differ from the oldest snapshot still kept."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-back, 0)
    differ = [(~F.col(f).eqNullSafe(F.first(f).over(w))).cast("int") for f in fields]
    return df.select(*key, *order, sum(differ[1:], differ[0]).alias("changed"))


def template_changes(df: DataFrame, key: Names, batch: str, order: Names, fields: Names) -> DataFrame:
    """Per batch, each column as a list where it differs from the batch before,
    ready for ``replay``."""
    columns = [F.array_sort(F.collect_list(F.struct(*order, F.col(f).alias("v")))).getField("v").alias(f) for f in fields]
    lists = df.groupBy(*key, batch).agg(*columns)
    w = Window.partitionBy(*key).orderBy(batch)
    changed = [F.when(~F.col(f).eqNullSafe(F.lag(f).over(w)), F.struct(F.col(f).alias("v"))).alias(f"set_{f}") for f in fields]
    return lists.select(*key, batch, *changed)


def positional_operations(before: DataFrame, after: DataFrame, key: Names, place: str, value: str) -> DataFrame:
    """Per key and place the operation that turns the list before into the one
    after: KEEP, REPLACE, APPEND or TRUNCATE."""
    a = after.select(*key, place, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    b = before.select(*key, place, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    both = a.join(b, [*key, place], "full")
    operation = (
        F.when(F.col("_in_old").isNull(), "APPEND").when(F.col("_in_new").isNull(), "TRUNCATE")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "KEEP").otherwise("REPLACE")
    )
    return both.select(*key, place, F.col("_new").alias(value), operation.alias("operation"))


def global_places(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds each row's place in a global order: ranges are numbered apart and
    shifted by the counts before them, one row a range."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    within = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return within.join(F.broadcast(shifts), "_range").withColumn(name, (F.col("_shift") + F.col("_r")).cast("long")).drop("_range", "_r", "_shift")
