"""Column helpers for operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: blank and 0x09-0x0D.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, although body's own functions of many
    elements refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column, between: str = BLANKS) -> Column:
    """The words of ``text`` joined by one blank; ``between`` matches what parts words."""
    return F.trim(F.regexp_replace(text, between, " "))


def blanks(text: Column) -> Column:
    """How many blanks stand in ``text``."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(blanks(joined) + 1).cast("long")
