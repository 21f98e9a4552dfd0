"""Machine-readable zones of type TD3: building, gating, parsing, dates and country names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.functions.checkdigit import COMPOSITE, check_digit, composite_ok, sum_at, verify
from evidoc.functions.refdata import COUNTRY_NAMES, LINE1_TYPES, SPECIAL_CODES
from evidoc.functions.text import let
from evidoc.settings import DEFAULTS


def filled(s: Column, n: int) -> Column:
    """``s`` cut or padded with fillers to ``n`` characters."""
    return F.rpad(F.coalesce(s, F.lit("")), n, "<")


def build_lines(
    number: Column, surname: Column, given_names: Column, issuer: Column, nationality: Column, birth: Column, sex: Column, expiry: Column,
    optional: Column | None = None, kind: Column | None = None,
) -> Column:
    """A struct of the two 44-character lines with all check digits; dates come as yymmdd."""
    name = lambda s: F.replace(F.upper(F.trim(s)), F.lit(" "), F.lit("<"))
    names = F.concat(name(surname), F.lit("<<"), name(given_names))
    line1 = F.concat(filled(F.lit("P") if kind is None else kind, 2), filled(issuer, 3), filled(names, 39))
    bare = lambda s: F.translate(s, "<", "")
    own, given = filled(bare(number), 9), F.lit("") if optional is None else F.coalesce(optional, F.lit(""))
    extra = filled(bare(given), 14)
    extra_digit = F.lit("<") if optional is None else F.when(given == "", F.lit("<")).otherwise(check_digit(extra, 14))
    with_digit = lambda x, width: F.concat(x, check_digit(x, width))
    body = F.concat(
        with_digit(own, 9), filled(nationality, 3), with_digit(birth, 6), F.upper(F.substring(sex, 1, 1)), with_digit(expiry, 6), extra, extra_digit
    )
    line2 = let(body, lambda b: F.concat(b, (sum_at(b, COMPOSITE) % 10).cast("string")))
    return F.struct(line1.alias("line1"), line2.alias("line2"))


def plausible_line1(s: Column) -> Column:
    """Whether a cleaned line can be a first line: long enough, a known type, no digits, an issuer
    of letters (or ``D<<``), and two names of letters parted by fillers."""
    s = F.coalesce(s, F.lit(""))
    head = F.substring(s, 1, 44)
    issuer = F.substring(s, 3, 3)
    names = F.substring(s, 6, 1_000_000)
    cut = F.split(names, "<<", 2)
    letters = lambda c: F.translate(c, "<", "").rlike(r"^\p{L}+$")
    return (
        (F.length(s) >= DEFAULTS.min_line_chars)
        & s.rlike(f"^[{LINE1_TYPES}]")
        & ~head.rlike("[0-9]")
        & (issuer.rlike(r"^\p{L}{3}$") | (issuer == "D<<"))
        & F.contains(names, F.lit("<<"))
        & letters(F.get(cut, 0))
        & letters(F.coalesce(F.get(cut, 1), F.lit("")))
    )


def resolve_date(yymmdd: Column, is_expiry: bool, reference_year: int = DEFAULTS.reference_year) -> Column:
    """The date of six digits, or null. A birth lies in the last hundred years, an expiry no more
    than twenty years back."""
    century = reference_year // 100 * 100
    year = century + F.substring(yymmdd, 1, 2).try_cast("int")
    if is_expiry:
        year = F.when(year < reference_year - 20, year + 100).when(year > reference_year + 79, year - 100).otherwise(year)
    else:
        year = F.when(year > reference_year, year - 100).otherwise(year)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.substring(yymmdd, 3, 2), F.substring(yymmdd, 5, 2))
    return F.when(yymmdd.rlike("^[0-9]{6}$"), F.try_to_date(text, "yyyy-MM-dd"))


def line(s: Column) -> Column:
    return filled(F.replace(F.upper(F.trim(s)), F.lit(" "), F.lit("")), 44)


def parse(line1: Column, line2: Column, reference_year: int = DEFAULTS.reference_year) -> Column:
    """A struct of everything that two TD3 lines say, with the five checks and their verdict."""
    cut = lambda b, start, n: F.substring(b, start, n)
    digits = let(
        line(line2),
        lambda b: F.struct(
            b.alias("line"),
            verify(cut(b, 1, 9), cut(b, 10, 1), 9).alias("number"),
            verify(cut(b, 14, 6), cut(b, 20, 1), 6).alias("birth"),
            verify(cut(b, 22, 6), cut(b, 28, 1), 6).alias("expiry"),
            composite_ok(b).alias("composite"),
        ),
    )
    return let(F.struct(line(line1).alias("a"), digits.alias("b")), lambda x: _fields(x["a"], x["b"], reference_year))


def _fields(a: Column, checked: Column, reference_year: int) -> Column:
    b = checked["line"]
    names = F.split(F.substring(a, 6, 39), "<<", 2)
    words = lambda s: F.trim(F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), "<", " "), " +", " "))
    cut = lambda start, n: F.substring(b, start, n)
    plain = lambda s: F.translate(s, "<", "")
    personal = plain(cut(29, 14))
    number_ok, birth_ok, expiry_ok, composite = (checked[c] for c in ("number", "birth", "expiry", "composite"))
    return F.struct(
        plain(F.substring(a, 1, 2)).alias("document_type"),
        plain(F.substring(a, 3, 3)).alias("issuing_country"),
        words(F.get(names, 0)).alias("surname"),
        words(F.get(names, 1)).alias("given_names"),
        plain(cut(1, 9)).alias("passport_number"),
        plain(cut(11, 3)).alias("nationality"),
        resolve_date(cut(14, 6), False, reference_year).alias("date_of_birth"),
        F.when(cut(21, 1).isin("M", "F"), cut(21, 1)).otherwise("X").alias("sex"),
        resolve_date(cut(22, 6), True, reference_year).alias("expiry_date"),
        cut(22, 6).alias("raw_expiry"),
        personal.alias("personal_number"),
        number_ok.alias("number_ok"),
        birth_ok.alias("birth_ok"),
        expiry_ok.alias("expiry_ok"),
        composite.alias("composite_ok"),
        F.when((personal != "") & (cut(43, 1) != "<"), verify(cut(29, 14), cut(43, 1), 14)).alias("personal_ok"),
        (number_ok & birth_ok & expiry_ok & composite).alias("valid"),
    )


def candidate_score(line1: Column, parsed: Column) -> Column:
    """How well a parsed pair of lines stands up, without the confidence of the OCR."""
    one = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0.0))
    return (
        one(parsed["number_ok"], 2.0) + one(parsed["birth_ok"], 1.5) + one(parsed["expiry_ok"], 1.5) + one(parsed["composite_ok"], 3.0)
        + one(F.startswith(line1, F.lit("P")), 0.5) + F.lit(0.6)
    )


def iso_countries(spark: SparkSession) -> dict[str, str]:
    """Alpha-3 codes and English names of the ISO 3166 countries, as the Java platform has them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english = locale.ENGLISH
    named = {}
    for code in locale.getISOCountries():
        own = locale("", code)
        named[own.getISO3Country()] = own.getDisplayCountry(english)
    return named | COUNTRY_NAMES


def with_country_name(df: DataFrame, code: str, out: str, countries: dict[str, str] | None = None) -> DataFrame:
    """Append ``out``: the name of the issuing code in column ``code``. Special codes come first, as
    they stand and then without fillers; a code that no table has is its own name; nothing is null."""
    names = iso_countries(df.sparkSession) if countries is None else countries
    rows = [(k, v) for k, v in ({k: v for k, v in names.items() if k not in SPECIAL_CODES} | SPECIAL_CODES).items()]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "__code string, __name string"))  # a few hundred codes
    bare = F.translate(F.upper(F.col(code)), "<", "")
    raw = df.join(table, F.upper(F.col(code)) == F.col("__code"), "left").withColumnRenamed("__name", "__raw").drop("__code")
    both = raw.join(table, bare == F.col("__code"), "left")
    name = F.when(bare != "", F.coalesce("__raw", "__name", bare))
    return both.withColumn(out, name).drop("__raw", "__name", "__code")
