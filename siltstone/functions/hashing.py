"""Hashes and labels that routing depends on, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a and the number of cache shards.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
SHARDS = 256


def text_bytes(column: Column) -> Column:
    """The UTF-8 bytes of a string as an array of bigint; empty for an empty string."""
    digits = F.hex(F.encode(column, "UTF-8"))
    positions = F.when(F.length(digits) > 0, F.sequence(F.lit(0), F.length(digits).cast("int") - 2, F.lit(2))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(positions, lambda i: F.conv(digits.substr(i + 1, F.lit(2)), 16, 10).cast("bigint"))


def _fold(values: Column, number: Callable[[Column], Column]) -> Column:
    step = lambda h, b: (h.bitwiseXOR(number(b)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit((1 << 32) - 1))
    return F.aggregate(values, F.lit(FNV_OFFSET).cast("bigint"), step)


def fnv1a32(column: Column) -> Column:
    """FNV-1a over the bytes of a string, as an unsigned 32-bit number in a bigint; the offset basis for ''.

    Where every character is one byte, its number is the byte.
    """
    plain = F.when(column == "", F.lit(FNV_OFFSET).cast("bigint")).otherwise(_fold(F.split(column, ""), lambda c: F.ascii(c).cast("bigint")))
    return F.when(F.octet_length(column) == F.char_length(column), plain).otherwise(_fold(text_bytes(column), lambda b: b))


def shard_of(column: Column, shards: int = SHARDS) -> Column:
    return (fnv1a32(column) % shards).cast("int")


def crc32(column: Column) -> Column:
    """CRC-32 (IEEE) of a string's bytes, the default hash of rings."""
    return F.crc32(F.encode(column, "UTF-8"))


def octets(column: Column) -> Column:
    """Length in bytes, which is what capacities and offsets count."""
    return F.octet_length(column).cast("bigint")
