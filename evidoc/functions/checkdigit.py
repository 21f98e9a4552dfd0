"""Check digits of machine-readable lines (weights 7, 3, 1 over character values, modulo 10)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = (7, 3, 1)
#: Characters by value: a character's place modulo 36 is its value. Lower-case letters count as upper-case ones.
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ----------abcdefghijklmnopqrstuvwxyz"
#: Places (from 1) of a second line that the composite check digit covers: number, birth and expiry
#: with their digits, and the optional data with its digit.
COMPOSITE = (*range(1, 11), *range(14, 21), *range(22, 44))


def char_value(c: Column) -> Column:
    """0-9 are themselves, A-Z (any case) are 10-35, everything else counts 0; null for null."""
    place = F.greatest(F.instr(F.lit(VALUES), c) - 1, F.lit(0)) % 36  # the empty string counts 0
    return F.when(c == "-", F.lit(0)).otherwise(place)


def chars(s: Column) -> Column:
    """The characters of a string as an array; the empty string has none."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def weight(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), (i % 3 + 1).cast("int"))


def weighted_sum(s: Column) -> Column:
    values = F.transform(chars(s), lambda c, i: char_value(c) * weight(i))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def sum_at(s: Column, places: Iterable[int], first: int = 0) -> Column:
    """The weighted sum of a string's characters at fixed places (from 1), the first of which weighs as
    place ``first`` (from 0) does; places beyond the end count 0. One plain sum, given as SQL: a column
    for each step is slow to put together. The string is evaluated once."""
    terms = [f"greatest(instr('{VALUES}', substr(x, {p}, 1)) - 1, 0) % 36 * {WEIGHTS[(first + k) % 3]}" for k, p in enumerate(places)]
    return F.element_at(F.call_function("transform", F.array(F.translate(s, "-", "<")), F.expr(f"x -> {' + '.join(terms)}")), 1)


def check_digit(s: Column, width: int | None = None) -> Column:
    """The check digit of a string as a one-character string; ``0`` for the empty string. With
    ``width``, which no string exceeds, it is a sum over fixed places instead of a fold."""
    total = weighted_sum(s) if width is None else sum_at(s, range(1, width + 1))
    return (total % 10).cast("string")


def agrees(own: Column, digit: Column) -> Column:
    """Whether a check digit is the one that stands; a filler stands for 0, nothing is never right."""
    return F.coalesce((digit != "") & (own == F.when(digit == "<", F.lit("0")).otherwise(digit)), F.lit(False))


def verify(s: Column, digit: Column, width: int | None = None) -> Column:
    """Whether ``digit`` is the check digit of ``s``."""
    return agrees(check_digit(s, width), digit)


def composite_ok(line2: Column) -> Column:
    digit = (sum_at(line2, COMPOSITE) % 10).cast("string")
    return F.coalesce((F.length(line2) >= 44) & agrees(digit, F.substring(line2, 44, 1)), F.lit(False))


def passing_checks(number: Column, birth: Column, expiry: Column, composite: Column) -> Column:
    """How many of the four checks pass; -1 where there was no parse at all (all null)."""
    parts = [F.coalesce(c.cast("int"), F.lit(0)) for c in (number, birth, expiry, composite)]
    nothing = number.isNull() & birth.isNull() & expiry.isNull() & composite.isNull()
    return F.when(nothing, F.lit(-1)).otherwise(parts[0] + parts[1] + parts[2] + parts[3])
