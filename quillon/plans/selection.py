"""Deterministic codec choice as ``when`` chains over block statistics.

Rules, in order, for integers (first match wins): fewer than 4 values PLAIN;
8 or more with at most a quarter of the second differences non-zero, or first
differences within 2 bits, DELTA_DELTA; at least half of the items in runs and
runs of 3 on average RLE; range within 60 bits FOR; monotonic with differences
3 bits narrower than the range DELTA_FOR; differences within 61 bits DELTA;
values within 63 bits DIRECT; else PLAIN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codec numbers of the wire format.
CODECS = {
    "PLAIN": 0, "DIRECT_BITPACK": 1, "DELTA_BITPACK": 2, "FOR_BITPACK": 3, "DELTA_FOR_BITPACK": 4,
    "DELTA_DELTA_BITPACK": 5, "RLE": 6, "PATCHED_FOR": 7, "SIMPLE8B": 8, "XOR_FLOAT": 9,
    "DICTIONARY": 10, "STRING_REF": 11, "PREFIX_DELTA": 12,
}
# Element type numbers of the wire format.
ELEMENTS = {"bool": 0, "i64": 1, "u64": 2, "f64": 3, "string": 4, "binary": 5, "value": 6}


def integer_codec(s) -> Column:
    """``s`` maps statistic names to Columns."""
    n = s("n")
    plain, width = F.lit("PLAIN"), s("max_abs_bits")
    return (
        F.when(n < 4, plain)
        .when((n >= 8) & ((s("nonzero_dd_ratio") <= 0.25) | (s("delta_range_bits") <= 2)), "DELTA_DELTA_BITPACK")
        .when((s("repeated_ratio") >= 0.5) & (s("avg_run") >= 3.0), "RLE")
        .when(s("range_bits") <= 60, "FOR_BITPACK")
        .when((n >= 8) & s("monotonic") & (s("delta_range_bits") <= s("range_bits") - 3), "DELTA_FOR_BITPACK")
        .when(s("max_abs_delta_bits") <= 61, "DELTA_BITPACK")
        .when((n >= 8) & (width <= 16) & ~s("monotonic"), "SIMPLE8B")
        .when(width < 64, "DIRECT_BITPACK")
        .otherwise(plain)
    )


def unsigned_codec(s) -> Column:
    """For unsigned values that fit a long: difference codecs become DIRECT."""
    signed = integer_codec(s)
    keep = signed.isin("RLE", "FOR_BITPACK", "SIMPLE8B", "DIRECT_BITPACK", "PLAIN")
    return F.when(keep, signed).otherwise("DIRECT_BITPACK")


def float_codec(s) -> Column:
    near = (s("n") >= 4) & (s("near_ratio") >= 0.5) & (s("mean_xor_bits") <= 16.0)
    return F.when(near, "XOR_FLOAT").otherwise("PLAIN")


def string_codec(s) -> Column:
    n = s("n")
    return (
        F.when(n < 4, "PLAIN")
        .when(s("prefix_ratio") >= 0.5, "PREFIX_DELTA")
        .when((n >= 16) & (s("unique_ratio") <= 0.25), "DICTIONARY")
        .when(s("n_unique") < n, "STRING_REF")
        .otherwise("PLAIN")
    )


def null_strategy(n: Column, nulls: Column) -> Column:
    """No nulls: elided; at most a quarter: inverted bitmap; else bitmap."""
    return F.when(nulls == 0, "ALL_PRESENT_ELIDED").when(nulls <= F.floor(n / 4), "INVERTED_PRESENCE_BITMAP").otherwise("PRESENCE_BITMAP")


def batch_layout(n: Column) -> Column:
    """Row layout below 16 rows, columns from there on."""
    return F.when(n >= 16, "COLUMN_BATCH").otherwise("ROW_BATCH")


def use_patch(changed: Column, total: Column, patch_size: Column, full_size: Column) -> Column:
    """Whether a difference replaces the full message."""
    ratio = changed / F.greatest(total, F.lit(1))
    few = (ratio <= 0.10) | ((total <= 8) & (changed * 2 <= total) & (ratio <= 0.34))
    return few & (patch_size < full_size)


def unsigned_codec_wide(s) -> Column:
    """For blocks with unsigned values of 2**63 or more."""
    n = s("n")
    return (
        F.when(n < 4, "DIRECT_BITPACK")
        .when((s("repeated_ratio") >= 0.5) & (s("avg_run") >= 3.0), "RLE")
        .when(s("range_bits") <= 60, "FOR_BITPACK")
        .when((n >= 8) & (s("width") <= 16), "SIMPLE8B")
        .when(s("width") < 64, "DIRECT_BITPACK")
        .otherwise("PLAIN")
    )


# Checks of a schema field, as columns.


def in_range(field) -> Column:
    """Whether a value is there and within its field's range."""
    value = F.col(field.name)
    return F.coalesce((value >= F.lit(field.low)) & (value <= F.lit(field.high)), F.lit(False))


def in_enum(field) -> Column:
    return F.col(field.name).isin(*field.enum)


def or_default(field) -> Column:
    """The value, or the field's default where it is missing."""
    return F.coalesce(F.col(field.name), F.lit(field.default))
