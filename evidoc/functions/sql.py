"""The text functions as temporary SQL functions, for queries written in SQL.

``register(spark)`` creates them in a session. They are SQL expressions, which Spark puts in place of
their calls, so they run like the columns of ``checkdigit``, ``text`` and ``mrz`` and need no Python.
Nulls give null, but for functions that say whether something holds: these are never null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from evidoc.functions.checkdigit import COMPOSITE, VALUES, WEIGHTS
from evidoc.functions.refdata import MONTHS, SYMBOLS_FROM, SYMBOLS_TO
from evidoc.functions.text import ACCENTED, DAY_FIRST, MARKS, MONTH_NAME, PLAIN, TWO_MONTHS, YEAR_FIRST, sql_literal


def _months() -> str:
    return "map(" + ", ".join(f"{sql_literal(k)}, {v}" for k, v in MONTHS.items()) + ")"


def _group(shape: str, k: int, source: str = "upper(trim(s))") -> str:
    return f"try_cast(regexp_extract({source}, r'{shape}', {k}) AS INT)"


def _month(shape: str, k: int, whole: bool) -> str:
    token = f"regexp_extract(upper(trim(s)), r'{shape}', {k})"
    start = f"try_element_at({_months()}, substr({token}, 1, 3))"
    return f"coalesce(try_element_at({_months()}, {token}), {start})" if whole else start


def definitions() -> list[tuple[str, str, str]]:
    """(signature, result type, body) of each function; later ones use earlier ones."""
    composite = "concat(substr(line2, 1, 10), substr(line2, 14, 7), substr(line2, 22, 22))"
    if "".join(map(str, COMPOSITE)) != "".join(map(str, (*range(1, 11), *range(14, 21), *range(22, 44)))):
        raise AssertionError("the composite's places")
    year = "evidoc_year(" + _group(MONTH_NAME, 3) + ")", "evidoc_year(" + _group(TWO_MONTHS, 4) + ")"
    birth_year = "CASE WHEN y > r THEN y - 100 ELSE y END"
    expiry_year = "CASE WHEN y < r - 20 THEN y + 100 WHEN y > r + 79 THEN y - 100 ELSE y END"
    return [
        ("mrz_clean(s STRING)", "STRING", f"regexp_replace(translate(trim(upper(s)), {sql_literal(SYMBOLS_FROM)}, '{SYMBOLS_TO}'), '[^A-Z0-9<]', '')"),
        (
            "mrz_check_digit(s STRING)", "STRING",
            "cast(aggregate(transform(filter(split(translate(s, '-', '<'), ''), c -> c <> ''), "
            f"(c, i) -> greatest(instr('{VALUES}', c) - 1, 0) % 36 * element_at(array{WEIGHTS}, i % 3 + 1)), 0, (a, v) -> a + v) % 10 AS STRING)",
        ),
        ("mrz_verify(s STRING, digit STRING)", "BOOLEAN", "coalesce(digit <> '' AND mrz_check_digit(s) = CASE WHEN digit = '<' THEN '0' ELSE digit END, false)"),
        ("mrz_composite_ok(line2 STRING)", "BOOLEAN", f"coalesce(length(line2) >= 44 AND mrz_verify({composite}, substr(line2, 44, 1)), false)"),
        ("evidoc_date(y INT, m INT, d INT)", "DATE", "CASE WHEN y > 0 THEN try_to_date(concat(lpad(y, 4, '0'), '-', lpad(m, 2, '0'), '-', lpad(d, 2, '0')), 'yyyy-MM-dd') END"),
        ("evidoc_year(y INT)", "INT", "CASE WHEN y > 100 THEN y WHEN y < 50 THEN y + 2000 ELSE y + 1900 END"),
        ("evidoc_century(y INT, r INT, expiry BOOLEAN)", "INT", f"CASE WHEN expiry THEN {expiry_year} ELSE {birth_year} END"),
        (
            "mrz_date(s STRING, expiry BOOLEAN, reference_year INT)", "DATE",
            "CASE WHEN s RLIKE '^[0-9]{6}$' THEN evidoc_date(evidoc_century(cast(floor(reference_year / 100) * 100 AS INT) + try_cast(substr(s, 1, 2) AS INT), reference_year, expiry), "
            "try_cast(substr(s, 3, 2) AS INT), try_cast(substr(s, 5, 2) AS INT)) END",
        ),
        (
            "visual_date(s STRING)", "DATE",
            "coalesce("
            f"evidoc_date({_group(DAY_FIRST, 3, 'trim(s)')}, {_group(DAY_FIRST, 2, 'trim(s)')}, {_group(DAY_FIRST, 1, 'trim(s)')}), "
            f"evidoc_date({_group(YEAR_FIRST, 1, 'trim(s)')}, {_group(YEAR_FIRST, 2, 'trim(s)')}, {_group(YEAR_FIRST, 3, 'trim(s)')}), "
            f"evidoc_date({year[0]}, {_month(MONTH_NAME, 2, True)}, {_group(MONTH_NAME, 1)}), "
            f"evidoc_date({year[1]}, {_month(TWO_MONTHS, 2, False)}, {_group(TWO_MONTHS, 1)}), "
            f"evidoc_date({year[1]}, {_month(TWO_MONTHS, 3, False)}, {_group(TWO_MONTHS, 1)}))",
        ),
        ("name_fold(s STRING)", "STRING", f"upper(translate(s, '{ACCENTED + MARKS}', '{PLAIN}'))"),
        ("names_match(a STRING, b STRING)", "BOOLEAN", "coalesce(a <> '' AND b <> '' AND translate(name_fold(a), ' <', '') = translate(name_fold(b), ' <', ''), false)"),
    ]


def register(spark: SparkSession) -> None:
    """Create the functions in a session; those of these names that it has are replaced."""
    for signature, kind, body in definitions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
