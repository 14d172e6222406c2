"""Scalar functions: text, identity, checksums and times."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: the digits of Crockford's base 32, in lower case.
BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower case of A to Z only: prefix search folds no other letters."""
    return F.translate(text, UPPER, UPPER.lower())


def has_prefix(text: Column, prefix: str) -> Column:
    """Prefix match without case for ASCII letters; no character is a wildcard."""
    return F.startswith(fold_ascii(text), fold_ascii(F.lit(prefix)))


def escape_like(text: str) -> str:
    r"""text as a LIKE pattern that matches itself, with \ as the escape."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def leading_int(text: Column) -> Column:
    """The integer a text starts with, as scanning reads it: '2abc' is 2."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def whole_int(text: Column) -> Column:
    """A decimal of the header grammar that fits 64 bits; null for anything else, also
    for the least 64-bit integer."""
    digits = F.regexp_extract(text, "^-?0*([0-9]*)$", 1)
    fits = text.rlike("^-?[0-9]+$") & ((F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= "9223372036854775807")))
    return F.when(fits, text.try_cast("bigint"))


def base32(number: Column, digits: int) -> Column:
    """The lowest bits of a number in base 32, highest digit first."""
    parts = (F.substr(F.lit(BASE32), (F.shiftright(number, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in reversed(range(digits)))
    return F.concat(*parts)


def time_id(seconds: Column) -> Column:
    """An id of seven characters that sorts by time: 32 bits of Unix seconds, the highest first."""
    return base32(F.shiftleft(seconds.bitwiseAND(F.lit(0xFFFFFFFF)), 3), 7)


def suffixed(base: Column, nth: Column) -> Column:
    """The nth id on a base that is taken: none, then a to z, then aa and so on."""
    tens = F.floor((nth - 27) / 26).cast("int")
    letter = F.chr(F.lit(97) + F.pmod(nth - 1, F.lit(26)))
    return F.when(nth <= 0, base).when(nth <= 26, F.concat(base, letter)).otherwise(F.concat(base, F.chr(F.lit(97) + tens), letter))


def uuid_short(uuid: Column) -> Column:
    """Twelve base-32 characters in upper case: the first 60 random bits of a time-ordered UUID."""
    plain = F.replace(uuid, F.lit("-"))
    first = F.conv(F.substring(plain, 14, 3), 16, 10).cast("bigint")
    second = F.conv(F.substring(plain, 17, 13), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << 50) - 1))
    return F.upper(base32(F.shiftleft(first, 48).bitwiseOR(F.shiftright(second, 2)), 12))


def uuid_path(uuid: Column) -> Column:
    """YYYY/MM-DD/<short>.md from a time-ordered UUID."""
    millis = F.conv(F.substring(F.replace(uuid, F.lit("-")), 1, 12), 16, 10).cast("bigint")
    day = F.date_format(F.timestamp_millis(millis), "yyyy/MM-dd")
    return F.concat(day, F.lit("/"), uuid_short(uuid), F.lit(".md"))


_RFC3339 = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def is_rfc3339(text: Column) -> Column:
    """Whether a text is a full time with an offset, on a day that exists."""
    return text.rlike(_RFC3339) & F.try_to_timestamp(F.concat(F.substring(text, 1, 10), F.lit(" 00:00:00"))).isNotNull()


def rfc3339(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fnv1a31(text: str) -> int:
    """FNV-1a of 32 bits, its sign bit dropped."""
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    return F.when(F.length(digits) > 0, F.transform(places, lambda p: F.conv(F.substr(digits, p, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a31_of(text: Column) -> Column:
    """`fnv1a31` of a column."""
    step = lambda h, b: (h.bitwiseXOR(b) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(_bytes(text), F.lit(0x811C9DC5).cast("bigint"), step).bitwiseAND(F.lit(0x7FFFFFFF))


def _castagnoli() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC_TABLE = _castagnoli()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli)."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC_TABLE[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def crc32c_of(text: Column) -> Column:
    """`crc32c` of a column's UTF-8 bytes."""
    table = F.array(*(F.lit(x).cast("bigint") for x in _CRC_TABLE))
    step = lambda c, b: F.element_at(table, (c.bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int")).bitwiseXOR(F.shiftright(c, 8))
    return F.aggregate(_bytes(text), F.lit(0xFFFFFFFF).cast("bigint"), step).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint"))


def instant(text: Column) -> Column:
    """The moment that a full time with an offset names, null for anything else."""
    return F.when(is_rfc3339(text), F.try_to_timestamp(text))


def now_utc() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
