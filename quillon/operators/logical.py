"""Logical column codecs as window plans, each with its inverse.

Every operator takes the columns that name a block and a total order in it.
Encoders keep one row per value (or per run) and are exact inverses of the
decoders; the byte form of the same codecs is in ``quillon.functions.vectors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import sizes as S

Names = list[str]


def _order(block: Names, order: Names):
    return Window.partitionBy(*block).orderBy(*order)


def _so_far(block: Names, order: Names):
    return _order(block, order).rowsBetween(Window.unboundedPreceding, 0)


def delta(df: DataFrame, block: Names, order: Names, value: str, out: str = "delta") -> DataFrame:
    """First differences; the first is the value itself."""
    return df.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(_order(block, order)), F.lit(0)))


def undelta(df: DataFrame, block: Names, order: Names, value: str = "delta", out: str = "value") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(_so_far(block, order)))


def delta_delta(df: DataFrame, block: Names, order: Names, value: str, out: str = "dd") -> DataFrame:
    """Second differences; the first two are the value and the first difference."""
    w = _order(block, order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumn(
        out, F.when(one.isNull(), F.col(value)).when(two.isNull(), F.col(value) - one).otherwise(F.col(value) - 2 * one + two)
    )


def undelta_delta(df: DataFrame, block: Names, order: Names, value: str = "dd", out: str = "value") -> DataFrame:
    """The second entry is a first difference, so it joins the running sum of
    second differences without the first value."""
    w, run = _order(block, order), _so_far(block, order)
    place = F.row_number().over(w)
    rows = df.withColumn("_p", place)
    rows = rows.withColumn("_d", F.sum(F.when(F.col("_p") > 1, F.col(value)).otherwise(F.lit(0))).over(run))
    rows = rows.withColumn("_s", F.when(F.col("_p") == 1, F.col(value)).otherwise(F.col("_d")))
    return rows.withColumn(out, F.sum("_s").over(run)).drop("_p", "_d", "_s")


def frame_of_reference(df: DataFrame, block: Names, value: str) -> DataFrame:
    """Adds ``base`` (the block's least value) and ``offset``."""
    base = F.min(value).over(Window.partitionBy(*block))
    return df.withColumn("base", base).withColumn("offset", F.col(value) - F.col("base"))


def patched_frame(df: DataFrame, block: Names, value: str) -> DataFrame:
    """Frame of reference with offsets wider than the base width set apart."""
    rows = frame_of_reference(df, block, value)
    most = F.max("offset").over(Window.partitionBy(*block))
    rows = rows.withColumn("base_width", F.greatest(S.bits(most) - 2, F.lit(0)).cast("int"))
    wide = S.bits(F.col("offset")) > F.col("base_width")
    main = F.expr("offset & (shiftleft(1L, base_width) - 1)")
    return rows.withColumns({"main": F.when(wide, main).otherwise(F.col("offset")), "patch": F.when(wide, F.col("offset"))})


def unpatch(df: DataFrame, out: str = "value") -> DataFrame:
    return df.withColumn(out, F.col("base") + F.coalesce("patch", "main"))


def runs(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Run-length form: (block, run, value, length)."""
    w = _order(block, order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_start", starts).withColumn("run", F.sum("_start").over(_so_far(block, order)))
    return marked.groupBy(*block, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def expand_runs(df: DataFrame, block: Names, value: str) -> DataFrame:
    """(block, place, value): the inverse of ``runs``; places count from 0."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy(*block).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = df.withColumn("_at", before)
    each = placed.select(*block, value, "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("_k"))
    return each.select(*block, (F.col("_at") + F.col("_k")).alias("place"), value)


def dictionary_first_seen(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Ids by first appearance, from 0: (block, id, value, uses).  Distinct
    values are aggregated before they are ranked."""
    placed = df.withColumn("_at", F.struct(*order))
    seen = placed.groupBy(*block, value).agg(F.min("_at").alias("_first"), F.count("*").alias("uses"))
    return seen.withColumn("id", F.row_number().over(_order(block, ["_first"])) - 1).drop("_first")


def dictionary_sorted(df: DataFrame, block: Names, value: str) -> DataFrame:
    """Ids in byte order, from 0."""
    seen = df.groupBy(*block, value).agg(F.count("*").alias("uses"))
    return seen.withColumn("id", F.row_number().over(_order(block, [value])) - 1)


def intern(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Replaces each value by its first-seen id (column ``id``)."""
    ids = dictionary_first_seen(df, block, order, value).select(*block, value, "id")
    return df.join(ids, [*block, value])


def prefix_delta(df: DataFrame, block: Names, order: Names, value: str) -> DataFrame:
    """Adds ``kept`` (bytes shared with the string before, cut to whole
    characters) and ``suffix``."""
    w = _order(block, order)
    rows = df.withColumn("_prev", F.lag(value).over(w))
    shared = F.coalesce(S.common_prefix(F.col(value), F.col("_prev")), F.lit(0))
    rows = rows.withColumns({"_lcp": shared})
    raw = F.encode(F.col(value), "UTF-8")
    # a byte prefix that ends inside a character is cut back to its start
    kept = F.aggregate(
        F.sequence(F.lit(0), F.lit(3)), F.col("_lcp"),
        lambda k, _: F.when((k > 0) & (k < F.octet_length(value)) & F.hex(F.substr(raw, k + 1, F.lit(1))).between("80", "BF"), k - 1).otherwise(k),
    )
    rows = rows.withColumn("kept", kept.cast("int"))
    return rows.withColumn("suffix", F.decode(F.substr(raw, F.col("kept") + 1, F.octet_length(value)), "UTF-8")).drop("_prev", "_lcp")


def xor_previous(df: DataFrame, block: Names, order: Names, bits: str, out: str = "xor") -> DataFrame:
    """XOR of raw bits with the value before; the first stays as it is."""
    return df.withColumn(out, F.col(bits).bitwiseXOR(F.coalesce(F.lag(bits).over(_order(block, order)), F.lit(0).cast("long"))))


def unxor(df: DataFrame, block: Names, order: Names, xor: str = "xor", out: str = "bits") -> DataFrame:
    return df.withColumn(out, F.bit_xor(F.col(xor)).over(_so_far(block, order)))


def retain_last(df: DataFrame, block: Names, order: Names, n: int = 8) -> DataFrame:
    """The last n rows of each block, as a snapshot store keeps them."""
    w = Window.partitionBy(*block).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
