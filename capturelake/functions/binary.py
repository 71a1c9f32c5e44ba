"""Numbers in bytes, as expressions: for headers that are already in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(data: Column, at: Column | int, n: int) -> Column:
    """The unsigned number in ``n`` (up to 7) bytes from byte ``at`` (from 0)."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(n))), 16, 10).cast("bigint")


def little_endian(data: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return sum((F.shiftleft(big_endian(data, at + i, 1), 8 * i) for i in range(1, n)), big_endian(data, at, 1))


def crc8(data: Column) -> Column:
    """CRC-8 with polynomial 7 and start 0, a table's entry a byte."""
    table = F.array(*(F.lit(_crc_byte(c)) for c in range(256)))
    # in Latin-1 a byte is the character of its number
    text = F.decode(data, "ISO-8859-1")
    return F.aggregate(F.split(text, ""), F.lit(0), lambda crc, x: F.get(table, crc.bitwiseXOR(F.ascii(x))))


def _crc_byte(c: int) -> int:
    """The table's entry for a byte."""
    for _ in range(8):
        c = ((c << 1) ^ (7 if c & 0x80 else 0)) & 0xFF
    return c


def streaminfo(data: Column) -> Column:
    """A struct of a 34-byte STREAMINFO block: min_block, max_block, min_frame,
    max_frame (null for 0), rate, channels, bps, total, known, md5.  A total of
    0 is unknown."""
    word = lambda at, n: big_endian(data, at, n)
    flags = word(10, 4)
    total = F.shiftleft(flags.bitwiseAND(0xF), 32) + word(14, 4)
    frame = lambda x: F.when(x > 0, x.cast("int"))
    return F.struct(
        word(0, 2).cast("int").alias("min_block"),
        word(2, 2).cast("int").alias("max_block"),
        frame(word(4, 3)).alias("min_frame"),
        frame(word(7, 3)).alias("max_frame"),
        F.shiftright(flags, 12).alias("rate"),
        (F.shiftright(flags, 9).bitwiseAND(7) + 1).cast("int").alias("channels"),
        (F.shiftright(flags, 4).bitwiseAND(31) + 1).cast("int").alias("bps"),
        total.alias("total"),
        (total > 0).alias("known"),
        F.lower(F.hex(F.substring(data, 19, 16))).alias("md5"),
    )
