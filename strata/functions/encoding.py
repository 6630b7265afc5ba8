"""Byte-level scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def le_uint(data, start: int, width: int) -> Column:
    """The little-endian unsigned integer of ``width`` bytes (up to 8, from 2**63 on as a signed bigint) at a 1-based position of a binary column."""
    out = F.lit(0).cast("bigint")
    for i in range(width):
        byte = F.conv(F.hex(_col(data).substr(start + i, 1)), 16, 10).cast("bigint")
        out = out + F.shiftleft(byte, 8 * i)
    return out


def le_bytes(number, width: int) -> Column:
    """A non-negative integer as ``width`` little-endian bytes."""
    n = _col(number).cast("bigint")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]))


def pack(size, offset) -> Column:
    """Two 32-bit numbers in one: size * 2**32 + offset."""
    return F.shiftleft(_col(size).cast("bigint"), 32).bitwiseOR(_col(offset).cast("bigint"))


def unpack(packed) -> tuple[Column, Column]:
    return F.shiftrightunsigned(_col(packed), 32), _col(packed).bitwiseAND(F.lit(0xFFFFFFFF))


def encode_vref(ref) -> Column:
    """A value reference as bytes: u64 segment, u32 offset (u64 from 2**32 on), u32 length, u32 checksum, little-endian."""
    r = _col(ref)
    wide = r["offset"] > 0xFFFFFFFF
    place = F.when(wide, le_bytes(r["offset"], 8)).otherwise(le_bytes(r["offset"], 4))
    return F.when(r.isNotNull(), F.concat(le_bytes(r["segment_id"], 8), place, le_bytes(r["value_len"], 4), le_bytes(r["checksum"], 4)))


def decode_vref(data) -> Column:
    """encode_vref's inverse; null for other lengths."""
    d = _col(data)
    at = lambda wide: 17 if wide else 13

    def made(wide: bool) -> Column:
        return F.struct(
            le_uint(d, 1, 8).alias("segment_id"), le_uint(d, 9, 8 if wide else 4).alias("offset"),
            le_uint(d, at(wide), 4).alias("value_len"), le_uint(d, at(wide) + 4, 4).alias("checksum"),
        )

    return F.when(F.octet_length(d) == 20, made(False)).when(F.octet_length(d) == 24, made(True))


def file_number(path) -> Column:
    """The number a file's name starts with, or null."""
    return F.regexp_extract(_col(path), r"([0-9]+)\.[A-Za-z]+$", 1).try_cast("bigint")


def segment_name(number) -> Column:
    return F.concat(F.lpad(_col(number).cast("string"), 20, "0"), F.lit(".vlog"))
