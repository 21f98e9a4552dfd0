"""Text columns: cleaning of machine-readable lines, transliteration, visual dates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidoc.functions.refdata import MONTHS, SYMBOLS_FROM, SYMBOLS_TO


def sql_literal(value: str | int | float) -> str:
    return str(value) if not isinstance(value, str) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict[str, object]) -> Column:
    """A constant map, parsed from one piece of SQL (a column per literal is slow to put together)."""
    return F.expr("map(" + ", ".join(sql_literal(x) for pair in values.items() for x in pair) + ")")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def caseless(s: Column) -> Column:
    """Lower case of the same length, with the dotted and dotless i alike."""
    return F.translate(F.lower(F.translate(s, "İ", "i")), "ı", "i")


def clean_line(s: Column) -> Column:
    """A machine-readable line from OCR text: upper case, symbols to fillers, only ``A-Z0-9<``."""
    mapped = F.translate(F.trim(F.upper(s)), SYMBOLS_FROM, SYMBOLS_TO)
    return F.regexp_replace(mapped, "[^A-Z0-9<]", "")


def _accents() -> tuple[str, str, str]:
    """Letters with a one-letter base, their bases, and combining marks that fall away."""
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    letters, bases = "ıİ", "iI"
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != chr(c) and chr(c) not in letters:
            letters, bases = letters + chr(c), bases + plain
    return letters, bases, marks


ACCENTED, PLAIN, MARKS = _accents()


def fold(s: Column) -> Column:
    """Upper case without accents; letters without a base letter (Ø, Ł, Đ, Æ) stay as they are."""
    return F.upper(F.translate(s, ACCENTED + MARKS, PLAIN))


def same_transliterated(a: Column, b: Column) -> Column:
    """Whether two names agree but for accents, case, blanks and fillers; false if either is missing."""
    key = lambda s: F.translate(fold(s), " <", "")
    return F.coalesce((a != "") & (b != "") & (key(a) == key(b)), F.lit(False))


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three integers, or null."""
    padded = lambda n, k: F.lpad(n.cast("string"), k, "0")
    text = F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day, 2))
    return let(text, lambda t: F.when(t > "0001", F.try_to_date(t, "yyyy-MM-dd")))


def _year(raw: Column) -> Column:
    return F.when(raw > 100, raw).when(raw < 50, raw + 2000).otherwise(raw + 1900)


# The shapes of a visual date, in the order in which they are tried.
DAY_FIRST = r"(?U)\b([0-9]{1,2})[. /\-]+([0-9]{1,2})[. /\-]+([0-9]{4})\b"
YEAR_FIRST = r"(?U)\b([0-9]{4})[./\-]([0-9]{1,2})[./\-]([0-9]{1,2})\b"
MONTH_NAME = r"(?U)\b([0-9]{1,2})\s+(\p{L}{3,})[\s/]*(?:\p{L}{3,}\s*)?([0-9]{2}|[0-9]{4})\b"
TWO_MONTHS = r"(?U)\b([0-9]{1,2})\s+(\w{3,4})\s*/\s*(\w{3,4})\s+([0-9]{2,4})\b"


def visual_date(s: Column) -> Column:
    """The date in a piece of visual text, or null: day first, year first, or with month names; a
    shape whose date does not exist gives way to the next. Two-digit years below 50 are 20xx."""
    months = literal_map(MONTHS)
    part = lambda source, shape, k: F.regexp_extract(source, shape, k)
    number = lambda source, shape, k: part(source, shape, k).try_cast("int")
    month = lambda token: F.coalesce(F.try_element_at(months, token), F.try_element_at(months, F.substring(token, 1, 3)))
    three = lambda token: F.try_element_at(months, F.substring(token, 1, 3))

    def tried(x: Column) -> Column:
        text, up = x["text"], x["up"]
        year = lambda shape, k: let(number(up, shape, k), _year)
        # Only a text of a shape is taken apart: a cast of what is no number costs Spark an exception.
        shaped = lambda source, shape, *dates: F.when(F.rlike(source, F.lit(shape)), F.coalesce(*dates))
        return F.coalesce(
            shaped(text, DAY_FIRST, _date(number(text, DAY_FIRST, 3), number(text, DAY_FIRST, 2), number(text, DAY_FIRST, 1))),
            shaped(text, YEAR_FIRST, _date(number(text, YEAR_FIRST, 1), number(text, YEAR_FIRST, 2), number(text, YEAR_FIRST, 3))),
            shaped(up, MONTH_NAME, _date(year(MONTH_NAME, 3), month(part(up, MONTH_NAME, 2)), number(up, MONTH_NAME, 1))),
            shaped(
                up, TWO_MONTHS,
                _date(year(TWO_MONTHS, 4), three(part(up, TWO_MONTHS, 2)), number(up, TWO_MONTHS, 1)),
                _date(year(TWO_MONTHS, 4), three(part(up, TWO_MONTHS, 3)), number(up, TWO_MONTHS, 1)),
            ),
        )

    return let(F.struct(F.trim(s).alias("text"), F.upper(F.trim(s)).alias("up")), tried)
