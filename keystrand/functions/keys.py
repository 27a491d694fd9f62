"""Scalar functions over keys, values and files, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the level layout: bytes of level 1, growth per level, levels.
LEVEL_ONE_BYTES = 640 * 1024 * 1024
LEVEL_GROWTH = 10


def encode_key(n: Column) -> Column:
    """key_ and the number in 20 digits."""
    return F.format_string("key_%020d", n)


def file_name(n: Column, suffix: str) -> Column:
    """The number in 20 digits and a suffix, so that names sort as numbers do."""
    return F.concat(F.format_string("%020d", n), F.lit(suffix))


def base64_plain(value: Column) -> Column:
    """Standard base64 in one line."""
    return F.regexp_replace(F.base64(value.cast("binary")), "[\r\n]", "")


def big_endian(n: Column) -> Column:
    """Eight bytes in hexadecimal, most significant first."""
    return F.lpad(F.hex(n), 16, "0")


def checksum(key: Column, seq: Column, op: Column, value: Column) -> Column:
    """CRC-32 over tag, sequence number, key and value of a log record."""
    return F.crc32(F.concat(F.unhex(F.lpad(F.hex(op.cast("int")), 2, "0")), F.unhex(big_endian(seq)), F.encode(key, "UTF-8"), F.coalesce(value, F.unhex(F.lit("")))))


def valid_utf8(raw: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))


def percent_decoded(path: Column) -> Column:
    """A key from its form in a URL path; null where an escape is malformed.  A plus stays one."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def elapsed_second(ms: Column) -> Column:
    """The whole second that an elapsed time in milliseconds falls into."""
    return F.floor(ms / 1000).cast("long")


def level_limit(level: int) -> int:
    """Bytes a level from 1 on may hold before it is compacted."""
    return LEVEL_ONE_BYTES * LEVEL_GROWTH ** (level - 1)
