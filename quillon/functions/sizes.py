"""Column expressions for bit widths, varints and closed-form encoded sizes.

Everything here is a Catalyst expression over 64-bit integers; nothing leaves
the JVM.  Widths and sizes follow the wire format: a width is at least 1, a
varint takes ``ceil(bits / 7)`` bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1


def bits(x: Column) -> Column:
    """Bits of a long read as unsigned, at least 1."""
    return F.length(F.bin(x))


def varint_size(x: Column) -> Column:
    """Bytes of the varint of a long read as unsigned."""
    return F.ceil(bits(x) / F.lit(7)).cast("long")


def zigzag(x: Column) -> Column:
    """Sign moved to the lowest bit, as the unsigned bits of a long."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def packed_size(n: Column, widest: Column) -> Column:
    """Bit-packed block of n values of ``widest`` bits: count, width, payload."""
    body = varint_size(n) + F.lit(1) + F.ceil(n * widest / F.lit(8)).cast("long")
    return F.when(n == 0, F.lit(2).cast("long")).otherwise(body)


def saturating_range(low: Column, high: Column) -> Column:
    """high - low, at most the largest long."""
    return F.coalesce(F.try_subtract(high, low), F.lit(LONG_MAX))


def magnitude_bits(x: Column) -> Column:
    """Bits of |x|; the smallest long has 64."""
    smallest = F.lit(-LONG_MAX) - F.lit(1)
    return F.when(x == smallest, F.lit(64)).otherwise(bits(F.abs(F.when(x == smallest, F.lit(0).cast("long")).otherwise(x))))


def common_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the common prefix of two strings; 0 beside a null."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    n = F.least(F.octet_length(a), F.octet_length(b))
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))

    def step(s, i):
        same = s.on & (F.substr(x, i * 2 + 1, F.lit(2)) == F.substr(y, i * 2 + 1, F.lit(2)))
        return F.struct(same.alias("on"), F.when(same, s.n + 1).otherwise(s.n).alias("n"))

    steps = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, lambda s: s.n)
    return F.when((n > 0) & b.isNotNull(), steps).otherwise(F.lit(0))
