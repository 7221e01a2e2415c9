"""Scalar functions of the link-graph engine, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32_MAX = (1 << 32) - 1
WHITE_SPACE = " \t\n\r\f\v"
SEPARATOR = " -> "


def spaced(title: Column) -> Column:
    """Underscores of stored titles as spaces."""
    return F.translate(title, "_", " ")


def unescaped(raw: Column, compat: bool = False) -> Column:
    """SQL string escapes undone: `\\x` is `x`; with compat only `\\'` and `\\\\` keep their character, any other escape goes whole."""
    return F.regexp_replace(raw, r"\\(?:([\\'])|.)" if compat else r"\\(.)", "$1")


def trimmed(text: Column) -> Column:
    """White space off both ends (Spark's plain trim takes blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def unsigned(text: Column, most: int = UINT32_MAX) -> Column:
    """A non-negative whole number up to `most`, else null; nothing raises."""
    n = text.try_cast("bigint")
    return F.when(n.between(0, most), n)


def flag(text: Column) -> Column:
    """True for a nonzero unsigned number, null where it is none."""
    return unsigned(text) != 0


def leading_int(text: Column) -> Column:
    """The 32-bit number that a text begins with, whatever follows; null where none does or it doesn't fit."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def character(code: Column) -> Column:
    """The character of a code point (Spark's char() is modulo 256): its UTF-8 bytes by arithmetic."""
    tail = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63))
    two = F.lit(0xC080) + F.shiftright(code, 6) * 0x100 + tail(0)
    three = F.lit(0xE08080) + F.shiftright(code, 12) * 0x10000 + tail(6) * 0x100 + tail(0)
    four = F.lit(0xF0808080) + F.shiftright(code, 18) * 0x1000000 + tail(12) * 0x10000 + tail(6) * 0x100 + tail(0)
    number = F.when(code < 0x80, code).when(code < 0x800, two).when(code < 0x10000, three).otherwise(four)
    digits = F.hex(number)
    return F.decode(F.unhex(F.when(code < 0x80, F.lpad(digits, 2, "0")).otherwise(digits)), "UTF-8")


def entities_decoded(text: Column) -> Column:
    """Numeric character references decoded from left to right, once each.

    `&#` with no semicolon anywhere after it stays; one whose number doesn't
    parse makes the result null, so that its row can be left out. Named
    references stay.
    """
    steps = F.sequence(F.lit(1), F.greatest(F.size(F.split(text, "&#")) - 1, F.lit(1)))
    state = F.struct(F.lit("").alias("done"), text.alias("rest"), F.lit(False).alias("bad"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        at = F.locate("&#", rest)
        stop = F.when(at > 0, F.instr(F.substr(rest, at), F.lit(";"))).otherwise(0)
        body = F.substr(rest, at + 2, stop - 3)
        hexed = body.rlike("^[xX]")
        digits = F.when(hexed, F.regexp_extract(body, r"^[xX]\s*\+?(?:0[xX])?([0-9a-fA-F]{1,6})(?![0-9a-fA-F])", 1)).otherwise(F.regexp_extract(body, r"^\s*\+?([0-9]{1,7})(?![0-9])", 1))
        code = F.when(digits != "", F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
        skip = F.struct(F.concat(acc["done"], F.substr(rest, F.lit(1), at + 1)).alias("done"), F.substr(rest, at + 2).alias("rest"), acc["bad"].alias("bad"))
        put = F.struct(F.concat(acc["done"], F.substr(rest, F.lit(1), at - 1), F.coalesce(character(code), F.lit(""))).alias("done"), F.substr(rest, at + stop).alias("rest"), (acc["bad"] | code.isNull()).alias("bad"))
        return F.when(at == 0, acc).when(stop == 0, skip).otherwise(put)

    return F.aggregate(steps, state, step, lambda acc: F.when(~acc["bad"], F.concat(acc["done"], acc["rest"])))


def joined_titles(titles: Column) -> Column:
    return F.array_join(titles, SEPARATOR)


def thousands(n: Column) -> Column:
    """A whole number with a comma for every three digits."""
    return F.format_number(n, 0)


def megabytes(n: Column) -> Column:
    """Bytes as units of 2^20 with two decimals."""
    return F.format_string("%.2f MB", n.cast("double") / (1 << 20))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0, less, or null."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def percent(share: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", share * 100)
