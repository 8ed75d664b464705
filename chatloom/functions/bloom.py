"""A Bloom filter of a column's values as one binary literal: rows that can't be among them go before any join.

The filter has 16 bits a value, up to `MOST` bytes; with more values it lets more rows through, and stays right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, PROBES = 1 << 20, 4


def places(value: Column, size: int) -> list[Column]:
    """The bits of a value, in a filter of `size` bytes."""
    return [F.pmod(F.xxhash64(F.lit(k), value), F.lit(size * 8)) for k in range(PROBES)]


def built(values: DataFrame, column: str) -> bytes:
    """What comes to the driver is a number a byte of the filter that isn't 0."""
    n = values.count()
    size = min(MOST, 1 << max(3, (2 * n - 1).bit_length() if n else 3))
    bits = values.select(F.explode(F.array(*places(F.col(column), size))).alias("at"))
    found = bits.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("bits"))
    out = bytearray(size)
    for r in found.toLocalIterator():
        out[r.byte] = r.bits
    return bytes(out)


def may_hold(filter_: bytes, value: Column) -> Column:
    """False only for values that the filter wasn't built of; null is none of them."""
    def one(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(filter_), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (at % 8).cast("int")) == 1

    out = value.isNotNull()
    for at in places(value, len(filter_)):
        out = out & one(at)
    return out
