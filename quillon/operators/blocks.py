"""Per-block statistics, codec choice and encoded sizes, as one plan.

A block is the rows that share the block columns; its values are ordered by
the order columns, which must be total (equal rows are harmless).  One shuffle
on the block columns serves the windows and the aggregate alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import sizes as S
from quillon.plans import selection

Names = list[str]


def neighbours(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Adds first and second differences and run edges.  The first difference
    of a block is its first value; differences that overflow are null."""
    w = Window.partitionBy(*block).orderBy(*order)
    v = F.col(value)
    df = df.withColumns({"_prev": F.lag(v).over(w), "_next": F.lead(v).over(w), "_i": F.row_number().over(w) - 1})
    df = df.withColumn("_d", F.when(F.col("_i") == 0, v).otherwise(F.try_subtract(v, F.col("_prev"))))
    return df.withColumn("_dd", F.when(F.col("_i") > 0, F.try_subtract(F.col("_d"), F.lag("_d").over(w))))


def integer_statistics(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """One row per block: the statistics that choose an integer codec."""
    rows = neighbours(df.select(*block, *[c for c in order if c not in block], F.col(value).cast("long").alias("_v")), block, order, "_v")
    v, d = F.col("_v"), F.col("_d")
    in_run = (v == F.col("_prev")) | (v == F.col("_next"))
    return rows.groupBy(*block).agg(
        F.count("*").alias("n"),
        F.min(v).alias("min_v"),
        F.max(v).alias("max_v"),
        S.bits(S.saturating_range(F.min(v), F.max(v))).cast("long").alias("range_bits"),
        (F.coalesce(F.sum(F.when(F.col("_dd") != 0, 1).otherwise(0)), F.lit(0)) / F.greatest(F.count("*") - 1, F.lit(1))).alias("nonzero_dd_ratio"),
        S.bits(S.saturating_range(F.min(d), F.max(d))).cast("long").alias("delta_range_bits"),
        (F.sum(F.when(in_run, 1).otherwise(0)) / F.count("*")).alias("repeated_ratio"),
        (F.count("*") / F.sum(F.when(F.coalesce(v == F.col("_prev"), F.lit(False)), 0).otherwise(1))).alias("avg_run"),
        F.min(F.coalesce(v >= F.col("_prev"), F.lit(True))).alias("monotonic"),
        F.max(S.magnitude_bits(d)).cast("long").alias("max_abs_delta_bits"),
        F.max(S.magnitude_bits(v)).cast("long").alias("max_abs_bits"),
    )


def integer_codec(df: DataFrame, block: Names, order: Names, value: str, unsigned: bool = False) -> DataFrame:
    stats = integer_statistics(df, block, order, value)
    choose = selection.unsigned_codec if unsigned else selection.integer_codec
    return stats.withColumn("codec", choose(F.col))


def integer_sizes(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Encoded payload bytes of each block under every integer codec."""
    rows = neighbours(df.select(*block, *[c for c in order if c not in block], F.col(value).cast("long").alias("_v")), block, order, "_v")
    w = Window.partitionBy(*block)
    rows = rows.withColumns({"_min": F.min("_v").over(w), "_dmin": F.min("_d").over(w)})
    v, d, z = F.col("_v"), F.col("_d"), S.zigzag
    run_start = ~F.coalesce(v == F.col("_prev"), F.lit(False))
    # lengths of runs, counted at their starts
    order_w = Window.partitionBy(*block).orderBy(*order)
    rows = rows.withColumn("_run", F.sum(run_start.cast("int")).over(order_w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*block, "_run").agg(F.count("*").alias("_len"), F.first("_v").alias("_rv"))
    rle = runs.groupBy(*block).agg(
        (S.varint_size(F.count("*")) + F.sum(S.varint_size(z(F.col("_rv"))) + S.varint_size(F.col("_len")))).alias("rle_bytes")
    )
    n = F.count("*")
    widest = lambda x: F.max(S.bits(z(x))).cast("long")
    at = lambda i, x: F.max(F.when(F.col("_i") == i, x))
    second = F.when(F.col("_i") >= 2, F.col("_dd"))
    dd_packed = S.packed_size(F.count(second), F.coalesce(widest(second), F.lit(1).cast("long")))
    sized = rows.groupBy(*block).agg(
        n.alias("n"),
        (S.varint_size(n) + F.sum(S.varint_size(z(v)))).alias("plain_bytes"),
        S.packed_size(n, widest(v)).alias("direct_bytes"),
        S.packed_size(n, widest(d)).alias("delta_bytes"),
        (S.varint_size(z(F.min(v))) + S.packed_size(n, widest(v - F.col("_min")))).alias("for_bytes"),
        (S.varint_size(z(F.min(d))) + S.packed_size(n, widest(d - F.col("_dmin")))).alias("delta_for_bytes"),
        (S.varint_size(n) + S.varint_size(z(at(0, v)))
         + F.when(n > 1, S.varint_size(z(at(1, d))) + dd_packed).otherwise(F.lit(0))).alias("delta_delta_bytes"),
    )
    return sized.join(rle, block)


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the raw bits of a double as a long.  The JVM call counts as
    non-deterministic, so it is projected before any aggregate."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col(value)).cast("long")
    return df.withColumn(name, F.when(F.col(value).isNotNull(), bits))


def float_statistics(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """XOR statistics of neighbouring doubles, and both sizes."""
    rows = with_bits(df.select(*block, *[c for c in order if c not in block], F.col(value).cast("double").alias("_f")), "_f", "_b")
    w = Window.partitionBy(*block).orderBy(*[c if c != value else "_f" for c in order])
    rows = rows.withColumn("_x", F.col("_b").bitwiseXOR(F.lag("_b").over(w)))
    x = F.col("_x")
    pairs = F.greatest(F.count("*") - 1, F.lit(1))
    width = F.when(x != 0, S.bits(x).cast("double"))
    # trailing zeros: bits below the lowest set one
    low = S.bits(x.bitwiseAND(F.try_subtract(F.lit(0).cast("long"), x))) - 1
    low = F.when(x == F.lit(-S.LONG_MAX) - F.lit(1), F.lit(63)).otherwise(low)
    payload = F.expr("shiftrightunsigned(_x, _t)")
    rows = rows.withColumn("_t", F.when(x != 0, low).cast("int"))
    return rows.groupBy(*block).agg(
        F.count("*").alias("n"),
        (F.sum(F.when(F.bit_count(x) <= 1, 1).otherwise(0)) / pairs).alias("near_ratio"),
        F.coalesce(F.avg(width), F.lit(0.0)).alias("mean_xor_bits"),
        (S.varint_size(F.count("*")) + F.lit(8) * F.count("*")).alias("plain_bytes"),
        (S.varint_size(F.count("*")) + F.lit(8)
         + F.coalesce(F.sum(F.when(x.isNull(), 0).when(x == 0, 1).otherwise(F.lit(4) + S.varint_size(payload))), F.lit(0))).alias("xor_bytes"),
    )


def string_statistics(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Prefix and repetition statistics, and the sizes of all string codecs."""
    rows = df.select(*block, *[c for c in order if c not in block], F.col(value).alias("_s"))
    order = [c if c != value else "_s" for c in order]
    w = Window.partitionBy(*block).orderBy(*order)
    rows = rows.withColumns({"_prev": F.lag("_s").over(w), "_i": F.row_number().over(w)})
    rows = rows.withColumn("_lcp", F.when(F.col("_prev").isNotNull(), S.common_prefix(F.col("_s"), F.col("_prev"))))
    rows = rows.withColumn("_first", F.min("_i").over(Window.partitionBy(*block, "_s")))
    rows = rows.withColumn("_id", F.dense_rank().over(Window.partitionBy(*block).orderBy("_first")) - 1)
    size = F.octet_length("_s").cast("long")
    text = S.varint_size(size) + size
    kept = F.col("_lcp").cast("long")
    n = F.count("*")
    fresh = F.col("_i") == F.col("_first")
    return rows.groupBy(*block).agg(
        n.alias("n"),
        F.sum(fresh.cast("long")).alias("n_unique"),
        (F.sum(F.when(F.col("_lcp") >= 3, 1).otherwise(0)) / F.greatest(n - 1, F.lit(1))).alias("prefix_ratio"),
        (F.sum(fresh.cast("long")) / n).alias("unique_ratio"),
        (S.varint_size(n) + F.sum(text)).alias("plain_bytes"),
        (S.varint_size(F.sum(fresh.cast("long"))) + F.sum(F.when(fresh, text).otherwise(0)) + S.varint_size(n)
         + F.sum(S.varint_size(F.col("_id").cast("long")))).alias("dictionary_bytes"),
        (S.varint_size(n) + F.sum(F.when(kept.isNull(), text).otherwise(
            S.varint_size(kept) + S.varint_size(size - kept) + size - kept))).alias("prefix_bytes"),
    )


def unsigned_codec_wide(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Codec of blocks of unsigned values up to 2**64 - 1, held as decimals; for
    blocks that fit a long use ``integer_codec(..., unsigned=True)``."""
    half = F.lit("9223372036854775808").cast("decimal(20, 0)")
    bits = lambda x: F.when(x >= half, F.lit(64)).otherwise(S.bits(F.when(x < half, x).cast("long")))
    rows = df.select(*block, *order, F.col(value).cast("decimal(20, 0)").alias("_v"))
    w, v = Window.partitionBy(*block).orderBy(*order), F.col("_v")
    rows = rows.withColumns({"_prev": F.lag("_v").over(w), "_next": F.lead("_v").over(w)})
    again = F.coalesce(v == F.col("_prev"), F.lit(False))
    stats = rows.groupBy(*block).agg(
        F.count("*").alias("n"), bits(F.max(v)).alias("width"), bits((F.max(v) - F.min(v)).cast("decimal(20, 0)")).alias("range_bits"),
        (F.sum((again | F.coalesce(v == F.col("_next"), F.lit(False))).cast("int")) / F.count("*")).alias("repeated_ratio"),
        (F.count("*") / F.sum((~again).cast("int"))).alias("avg_run"),
    )
    return stats.withColumn("codec", selection.unsigned_codec_wide(F.col))
