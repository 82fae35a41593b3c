"""Owners of rows: block, cyclic and hashed partitions, and shortlists by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("cyclic", "block", "hash")


def partition_mode(name: str) -> str:
    """An unknown name means cyclic."""
    return name.lower() if name.lower() in MODES else "cyclic"


def cyclic_owner(row: Column, parts: int) -> Column:
    return F.pmod(row, F.lit(parts)).cast("long")


def block_owner(row: Column, n: int, parts: int) -> Column:
    """Contiguous blocks; the first n mod parts of them have one row more."""
    small, larger = divmod(n, parts)
    edge = (small + 1) * larger
    rest = F.lit(larger) if small == 0 else F.lit(larger) + F.floor((row - edge) / small)
    return F.when(row < edge, F.floor(row / (small + 1))).otherwise(rest).cast("long")


_WORD = 1 << 32


def _halves(value: int) -> tuple[int, int]:
    return value >> 32, value % _WORD


def _times(high: Column, low: Column, factor: int) -> tuple[Column, Column]:
    """The product mod 2**64 in halves of 32 bits; decimals hold what a long would overflow."""
    fh, fl = _halves(factor)
    wide = low.cast("decimal(20,0)") * F.lit(fl).cast("decimal(20,0)")
    carry = F.floor(wide / F.lit(_WORD).cast("decimal(20,0)")).cast("decimal(20,0)")
    new_low = (wide - carry * _WORD).cast("long")
    cross = low.cast("decimal(20,0)") * F.lit(fh).cast("decimal(20,0)") + high.cast("decimal(20,0)") * F.lit(fl).cast("decimal(20,0)") + carry
    new_high = (cross % F.lit(_WORD).cast("decimal(20,0)")).cast("long")
    return new_high, new_low


def _fold(high: Column, low: Column) -> tuple[Column, Column]:
    """x ^ (x >> 33)."""
    return high, low.bitwiseXOR(F.shiftrightunsigned(high, 1))


#: The multipliers of the 64-bit finaliser.
FINAL_1, FINAL_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def hash_owner(row: Column, parts: int) -> Column:
    """A 64-bit finaliser of the row number, unsigned, modulo the parts; rows from 0 on."""
    high, low = F.shiftrightunsigned(row.cast("long"), 32), row.cast("long").bitwiseAND(F.lit(_WORD - 1))
    high, low = _fold(high, low)
    high, low = _fold(*_times(high, low, FINAL_1))
    high, low = _fold(*_times(high, low, FINAL_2))
    return ((high % parts) * (_WORD % parts) + low % parts) % F.lit(parts)


def with_part(base: DataFrame, parts: int, mode: str = "block", n: int | None = None) -> DataFrame:
    """``base(id, ...)`` with ``part``; ids are row numbers."""
    mode = partition_mode(mode)
    if mode == "hash":
        owner = hash_owner(F.col("id"), parts)
    elif mode == "cyclic":
        owner = cyclic_owner(F.col("id"), parts)
    else:
        owner = block_owner(F.col("id"), base.count() if n is None else n, parts)
    return base.withColumn("part", owner.cast("long"))


def part_stats(parted: DataFrame) -> DataFrame:
    return parted.groupBy("part").agg(F.count("*").alias("n"))
