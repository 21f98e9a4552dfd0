"""Queries over machine-readable lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.functions.checkdigit import check_digit, composite_ok, passing_checks, verify
from evidoc.functions.refdata import CONFUSIONS, DIGIT_TO_LETTER, LETTER_TO_DIGIT, LINE1_TYPES, SPECIAL_CODES, SYMBOLS_FROM, SYMBOLS_TO
from evidoc.functions.text import clean_line
from evidoc.operators import candidates
from evidoc.operators.mrz import parse, plausible_line1, resolve_date, with_country_name
from evidoc.operators.repair import constrain, corrections, repair_lines, repair_number
from evidoc.plans.bridge import HOLDERS, LINES, NOISY, holders, lines, noisy, sql_digit, table

PARSED = (
    "document_type", "issuing_country", "surname", "given_names", "passport_number", "nationality", "date_of_birth", "sex", "expiry_date",
    "number_ok", "birth_ok", "expiry_ok", "composite_ok", "valid",
)


def flat(parsed: str = "p") -> list[Column]:
    return [F.col(f"{parsed}.{c}").cast("string").alias(c) if "date" in c else F.col(f"{parsed}.{c}").alias(c) for c in PARSED]


def td3_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", check_digit(F.col("c_name")).alias("check_digit"))


TD3_CHECK_DIGIT = f"SELECT c_custkey, {sql_digit('upper(c_name)')} AS check_digit FROM customer"


def td3_build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line1", "line2")


TD3_BUILD_LINES = f"WITH {LINES} SELECT doc_id, line1, line2 FROM lines"


def td3_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", parse(F.col("line1"), F.col("line2")).alias("p")).select("doc_id", *flat())


def _sql_date(yymmdd: str, expiry: bool) -> str:
    """The century by trying both: a birth no later than 2026, an expiry no earlier than 2006."""
    two, one = f"try_strptime('20' || {yymmdd}, '%Y%m%d')", f"try_strptime('19' || {yymmdd}, '%Y%m%d')"
    year = f"try_cast(substr({yymmdd}, 1, 2) AS INTEGER)"
    if expiry:
        pick = f"CASE WHEN {year} < 6 THEN try_strptime('21' || {yymmdd}, '%Y%m%d') ELSE {two} END"
    else:
        pick = f"CASE WHEN {year} > 26 THEN {one} ELSE {two} END"
    return f"strftime(CASE WHEN regexp_full_match({yymmdd}, '[0-9]{{6}}') THEN {pick} END, '%Y-%m-%d')"


TD3_PARSE = f"""
WITH {LINES}
SELECT doc_id, 'P' AS document_type, nationality AS issuing_country, surname, given_names, number AS passport_number, nationality,
       {_sql_date('birth', False)} AS date_of_birth, CASE WHEN sex = '<' THEN 'X' ELSE sex END AS sex, {_sql_date('expiry', True)} AS expiry_date,
       true AS number_ok, true AS birth_ok, true AS expiry_ok, true AS composite_ok, true AS valid
FROM lines"""


def td3_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line tampered with in its composite digit, every fifth cut short."""
    c = F.col
    last = ((F.substring("line2", 44, 1).cast("int") + 9) % 10).cast("string")
    line2 = F.when(c("doc_id") % 3 == 0, F.concat(F.substring("line2", 1, 43), last)).when(c("doc_id") % 5 == 0, F.substring("line2", 1, 40)).otherwise(c("line2"))
    rows = lines(spark, sf_dir).select("doc_id", line2.alias("line2"))
    own = lambda s, n, d: verify(F.substring("line2", s, n), F.substring("line2", d, 1))
    checks = passing_checks(own(1, 9, 10), own(14, 6, 20), own(22, 6, 28), composite_ok(c("line2")))
    return rows.select("doc_id", composite_ok(c("line2")).alias("composite_ok"), checks.alias("checks"))


TD3_COMPOSITE = f"""
WITH {HOLDERS}
SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS composite_ok, CAST(CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 4 ELSE 3 END AS INTEGER) AS checks FROM holders"""


def mrz_date_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six digits from order dates and keys, some of days that do not exist."""
    c = F.col
    digits = F.when(c("o_orderkey") % 7 == 0, F.concat(F.lpad((c("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("0231")))
    digits = digits.when(c("o_orderkey") % 11 == 0, F.lit("95O415")).otherwise(
        F.concat(F.lpad((c("o_orderkey") % 100).cast("string"), 2, "0"), F.date_format("o_orderdate", "MMdd"))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("yymmdd"))
    day = lambda expiry: resolve_date(c("yymmdd"), expiry).cast("string")
    return rows.select("o_orderkey", "yymmdd", day(False).alias("birth"), day(True).alias("expiry"))


MRZ_DATE_RESOLUTION = f"""
WITH d AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '0231' WHEN o_orderkey % 11 = 0 THEN '95O415'
         ELSE lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || strftime(o_orderdate, '%m%d') END AS yymmdd FROM orders
)
SELECT o_orderkey, yymmdd, {_sql_date('yymmdd', False)} AS birth, {_sql_date('yymmdd', True)} AS expiry FROM d"""

#: Codes that the nation keys stand for in the country lookup.
CODES = ("TUR", "D<<", "D", "GBR", "GBN", "KOR", "XXB", "RKS", "ZZZ", "", "FRA", "deu", "<<<", "UNO", "XOM", "YUG", "ESP", "ITA", "XXD", "UTO", "EUE", "GBD", "NLD", "XPO", "USA")
NAMES = {"TUR": "Türkiye", "GBR": "United Kingdom", "KOR": "South Korea", "FRA": "France", "DEU": "Germany", "ESP": "Spain", "ITA": "Italy", "NLD": "Netherlands", "USA": "United States"}


def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, CODES)), F.col("c_nationkey") % len(CODES) + 1)
    rows = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"))
    return with_country_name(rows, "code", "country", NAMES).select("c_custkey", "code", "country")


def _country_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    names = ", ".join(f"({q(k)}, {q(v)})" for k, v in {**NAMES, **SPECIAL_CODES}.items())
    codes = ", ".join(q(c) for c in CODES)
    return f"""
WITH t(k, v) AS (VALUES {names}), c AS (SELECT c_custkey, [{codes}][c_nationkey % {len(CODES)} + 1] AS code FROM customer)
SELECT c_custkey, code, CASE WHEN replace(code, '<', '') = '' THEN NULL
  ELSE coalesce((SELECT v FROM t WHERE k = upper(code)), (SELECT v FROM t WHERE k = replace(upper(code), '<', '')), replace(upper(code), '<', '')) END AS country
FROM c"""


def mrz_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = clean_line(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(line).cast("long").alias("n_chars"), F.md5(line).alias("line_md5"))


def _clean_sql() -> str:
    q = lambda s: s.replace("'", "''")
    return f"""
WITH c AS (
  SELECT doc_id, regexp_replace(translate(trim(upper(replace(text, 'ß', 'SS')), ' '), '{q(SYMBOLS_FROM)}', '{SYMBOLS_TO}'), '[^A-Z0-9<]', '', 'g') AS line FROM documents
)
SELECT doc_id, CAST(length(line) AS BIGINT) AS n_chars, md5(line) AS line_md5 FROM c"""


def line1_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines with one thing wrong in most: type, length, a digit, issuer, names."""
    c, k = F.col, F.col("doc_id") % 8
    line = (
        F.when(k == 0, F.concat(F.lit("X"), F.substring("line1", 2, 43)))
        .when(k == 1, F.substring("line1", 1, 27))
        .when(k == 2, F.replace(c("line1"), F.lit("A"), F.lit("4")))
        .when(k == 3, F.concat(F.lit("P<D<<"), F.substring("line1", 6, 39)))
        .when(k == 4, F.concat(F.lit("P<A<<"), F.substring("line1", 6, 39)))
        .when(k == 5, F.replace(c("line1"), F.lit("<<"), F.lit("<")))
        .when(k == 6, F.concat(F.lit("R"), F.substring("line1", 2, 43)))
        .otherwise(c("line1"))
    )
    return lines(spark, sf_dir).select("doc_id", line.alias("line")).select("doc_id", "line", plausible_line1(c("line")).alias("plausible"))


LINE1_GATE = f"""
WITH {LINES}, l AS (
  SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'X' || substr(line1, 2) WHEN 1 THEN substr(line1, 1, 27) WHEN 2 THEN replace(line1, 'A', '4')
    WHEN 3 THEN 'P<D<<' || substr(line1, 6) WHEN 4 THEN 'P<A<<' || substr(line1, 6) WHEN 5 THEN replace(line1, '<<', '<')
    WHEN 6 THEN 'R' || substr(line1, 2) ELSE line1 END AS line
  FROM lines
)
SELECT doc_id, line, length(line) >= 28 AND regexp_matches(line, '^[{LINE1_TYPES}].([A-Z]{{3}}|D<<)[A-Z<]*$')
  AND regexp_full_match(replace(string_split(substr(line, 6), '<<')[1], '<', ''), '[A-Z]+') AND contains(substr(line, 6), '<<')
  AND regexp_full_match(replace(substr(line, 6 + strpos(substr(line, 6), '<<') + 1), '<', ''), '[A-Z]+') AS plausible
FROM l"""


def _misread(c: Column, key: Column) -> Column:
    """A second line with letters for digits in its dates and digits in its nationality."""
    wrong = F.translate(F.substring(c, 14, 6), "0123456789", "OIZEASGTBP")
    nation = F.translate(F.substring(c, 11, 3), "AO", "40")
    sex = F.when(key % 2 == 0, F.lit("H")).when(key % 3 == 0, F.lit("E")).when(key % 5 == 0, F.lit("8")).otherwise(F.substring(c, 21, 1))
    return F.concat(F.substring(c, 1, 10), nation, wrong, F.substring(c, 20, 1), sex, F.translate(F.substring(c, 22, 7), "158", "LSB"), F.substring(c, 29, 16))


def positional_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = lines(spark, sf_dir).select("doc_id", _misread(c("line2"), c("doc_id")).alias("misread"))
    fixed = rows.withColumn("line2", constrain(c("misread")))
    return fixed.select("doc_id", "misread", "line2", F.array_join(corrections(c("misread"), c("line2")), ",").alias("corrections"))


MISREAD = """
misread AS (
  SELECT *, substr(line2, 1, 10) || translate(substr(line2, 11, 3), 'AO', '40') || translate(substr(line2, 14, 6), '0123456789', 'OIZEASGTBP') || substr(line2, 20, 1)
    || CASE WHEN doc_id % 2 = 0 THEN 'H' WHEN doc_id % 3 = 0 THEN 'E' WHEN doc_id % 5 = 0 THEN '8' ELSE substr(line2, 21, 1) END
    || translate(substr(line2, 22, 7), '158', 'LSB') || substr(line2, 29) AS misread
  FROM lines
)"""

_D = "translate(x, '" + "".join(LETTER_TO_DIGIT) + "', '" + "".join(LETTER_TO_DIGIT.values()) + "')"
_L = "translate(x, '" + "".join(DIGIT_TO_LETTER) + "', '" + "".join(DIGIT_TO_LETTER.values()) + "')"
_S = f"CASE WHEN x IN ('M', 'F', '<') THEN x WHEN x IN ('W', 'N', 'H') THEN 'M' WHEN x = 'E' THEN 'F' WHEN {_D} <> x THEN '<' ELSE x END"
POSITIONAL_CONSTRAINTS = f"""
WITH {LINES}, {MISREAD}, places AS (
  SELECT doc_id, misread, p, substr(misread, p + 1, 1) AS x FROM misread, range(0, 44) r(p)
), fixed AS (
  SELECT doc_id, misread, p, x, CASE WHEN p IN (9, 19, 27, 43) OR p BETWEEN 13 AND 18 OR p BETWEEN 21 AND 26 THEN {_D}
    WHEN p BETWEEN 10 AND 12 THEN {_L} WHEN p = 20 THEN {_S} ELSE x END AS y FROM places
)
SELECT doc_id, misread, string_agg(y, '' ORDER BY p) AS line2,
  coalesce(string_agg(CASE WHEN x <> y THEN p || ':' || x || '>' || y END, ',' ORDER BY p), '') AS corrections
FROM fixed GROUP BY doc_id, misread"""


def doc_number_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = holders(spark, sf_dir).select("doc_id", noisy(c("number"), c("doc_id")).alias("misread"), check_digit(c("number")).alias("digit"))
    return rows.withColumn("r", repair_number(c("misread"), c("digit"), strict=False)).select(
        "doc_id", "misread", c("r.number").alias("number"), c("r.ok").alias("ok"), c("r.replaced").alias("replaced"), c("r.passing").alias("passing")
    )


def _repair_sql() -> str:
    """Brute force: every replacement is written out and its check digit computed anew."""
    conf = ", ".join(f"('{k}', '{v}')" for k, v in CONFUSIONS.items())
    put = lambda s, p, a: f"(substr({s}, 1, {p} - 1) || {a} || substr({s}, {p} + 1))"
    d = sql_digit
    two, three = put(put("a.misread", "a.p", "a.a"), "b.p", "b.a"), put(put(put("a.misread", "a.p", "a.a"), "b.p", "b.a"), "c.p", "c.a")
    order = "ORDER BY q1, q2, q3, o1, o2, o3"
    return f"""
WITH {NOISY}, conf(c, alts) AS (VALUES {conf}),
n AS (SELECT doc_id, wrong AS misread, {d('number')} AS digit FROM noise),
amb AS (
  SELECT n.*, p, alts, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS q, count(*) OVER (PARTITION BY doc_id) AS m
  FROM n, range(1, 10) r(p) JOIN conf ON conf.c = substr(misread, p, 1)
),
s AS (SELECT amb.*, o, substr(alts, o, 1) AS a FROM amb, range(1, 5) t(o) WHERE o <= length(alts)),
same AS (SELECT doc_id, misread AS number, 0 AS replaced FROM n WHERE {d('misread')} = digit),
one AS (
  SELECT a.doc_id, {put('a.misread', 'a.p', 'a.a')} AS number, digit, q AS q1, 0 AS q2, 0 AS q3, o AS o1, 0 AS o2, 0 AS o3
  FROM s a WHERE doc_id NOT IN (SELECT doc_id FROM same)
),
one_ok AS (SELECT * FROM one WHERE {d('number')} = digit),
two AS (
  SELECT a.doc_id, {two} AS number, a.digit, a.q AS q1, b.q AS q2, 0 AS q3, a.o AS o1, b.o AS o2, 0 AS o3
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.q > a.q AND b.q <= a.q + 5
  WHERE a.doc_id NOT IN (SELECT doc_id FROM same UNION ALL SELECT doc_id FROM one_ok)
),
two_ok AS (SELECT * FROM two WHERE {d('number')} = digit),
three AS (
  SELECT a.doc_id, {three} AS number, a.digit, a.q AS q1, b.q AS q2, c.q AS q3, a.o AS o1, b.o AS o2, c.o AS o3
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.q > a.q AND b.q <= a.q + 3 JOIN s c ON a.doc_id = c.doc_id AND c.q > b.q AND c.q <= b.q + 2
  WHERE a.m BETWEEN 3 AND 8 AND a.o <= 2 AND b.o <= 2 AND c.o <= 2
    AND a.doc_id NOT IN (SELECT doc_id FROM same UNION ALL SELECT doc_id FROM one_ok UNION ALL SELECT doc_id FROM two_ok)
),
three_ok AS (SELECT * FROM three WHERE {d('number')} = digit),
ranked AS (
  SELECT doc_id, number, 1 AS replaced, count(*) OVER (PARTITION BY doc_id) AS passing, row_number() OVER (PARTITION BY doc_id {order}) AS k FROM one_ok
  UNION ALL SELECT doc_id, number, 2, count(*) OVER (PARTITION BY doc_id), row_number() OVER (PARTITION BY doc_id {order}) FROM two_ok
  UNION ALL SELECT doc_id, number, 3, count(*) OVER (PARTITION BY doc_id), row_number() OVER (PARTITION BY doc_id {order}) FROM three_ok
  UNION ALL SELECT doc_id, number, replaced, 1, 1 FROM same
)
SELECT n.doc_id, misread, coalesce(r.number, misread) AS number, r.number IS NOT NULL AS ok, CAST(replaced AS INTEGER) AS replaced, CAST(coalesce(passing, 0) AS INTEGER) AS passing
FROM n LEFT JOIN ranked r ON n.doc_id = r.doc_id AND k = 1"""


def repaired_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread lines repaired and parsed."""
    c = F.col
    rows = lines(spark, sf_dir).select("doc_id", "line1", _misread(c("line2"), c("doc_id") * 0 + 1).alias("line2"))
    fixed = rows.withColumn("r", repair_lines(c("line1"), c("line2")))
    return fixed.select("doc_id", F.size("r.corrections").alias("n_corrections"), parse(c("r.line1"), c("r.line2")).alias("p")).select("doc_id", "n_corrections", *flat())


REPAIRED_PARSE = f"""
WITH {LINES}, m AS (
  SELECT *, length(regexp_replace(substr(line2, 11, 3), '[^AO]', '', 'g')) + 6 + length(regexp_replace(substr(line2, 22, 7), '[^158]', '', 'g')) AS n FROM lines
)
SELECT doc_id, CAST(n AS INTEGER) AS n_corrections, 'P' AS document_type, nationality AS issuing_country, surname, given_names, number AS passport_number,
       nationality, {_sql_date('birth', False)} AS date_of_birth, CASE WHEN sex = '<' THEN 'X' ELSE sex END AS sex, {_sql_date('expiry', True)} AS expiry_date,
       true AS number_ok, true AS birth_ok, true AS expiry_ok, true AS composite_ok, true AS valid
FROM m"""


def mrz_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings of each zone: of a heading, with a wrong composite, right (not for every
    seventh), and the same at a higher confidence. The first right one wins, else the best score."""
    c = F.col
    rows = lines(spark, sf_dir)
    last = ((F.substring("line2", 44, 1).cast("int") + 3) % 10).cast("string")
    worse = F.concat(F.substring("line2", 1, 43), last)
    right = F.when(c("doc_id") % 7 == 0, F.concat(F.lit("<<<<<<<<<<"), F.substring("line2", 11, 33), last)).otherwise(c("line2"))
    readings = F.array(
        F.struct(F.lit("TOTDIATIUMYDANOATEOFTRSUEDATEFDEDUVSANC").alias("line1"), c("line2").alias("line2"), F.lit(0.99).alias("confidence")),
        F.struct(c("line1"), worse.alias("line2"), F.lit(0.80).alias("confidence")),
        F.struct(c("line1"), right.alias("line2"), F.lit(0.70).alias("confidence")),
        F.struct(c("line1"), right.alias("line2"), F.lit(0.95).alias("confidence")),
    )
    pairs = rows.select("doc_id", F.posexplode(readings).alias("visit", "x")).select("doc_id", "visit", "x.*")
    best = candidates.best_parse(candidates.judged(pairs), ["doc_id"])
    return best.select("doc_id", "visit", F.col("parsed.valid").alias("valid"), F.round("score", 4).alias("score"))


MRZ_BEST_CANDIDATE = f"""
WITH {HOLDERS}
SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 2 END AS INTEGER) AS visit, doc_id % 7 <> 0 AS valid,
  CASE WHEN doc_id % 7 = 0 THEN 2.0 + 1.5 + 1.5 + 0.5 + 0.6 + 0.475 ELSE 2.0 + 1.5 + 1.5 + 3.0 + 0.5 + 0.6 + 0.35 END::DOUBLE AS score
FROM holders"""


def zone_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses of two turns with two crops each: the zone is readable upright or, for odd documents,
    only on the turned page."""
    c = F.col
    rows = lines(spark, sf_dir)
    broken = F.concat(F.lit("ZZZZZZZZZZ"), F.substring("line2", 11, 34))
    lost = F.concat(F.lit("ZZZZZZZZZZ"), F.substring("line2", 11, 3), F.lit("0000009"), F.substring("line2", 21, 24))
    crop = lambda turn, k, presence, line: F.struct(F.lit(turn).alias("turn"), F.lit(k).alias("crop"), F.lit(presence).alias("presence"), line.alias("line2"))
    odd = c("doc_id") % 2 == 1
    each = F.array(
        crop(0, 0, 0.6, F.when(odd, lost).otherwise(broken)), crop(0, 1, 0.3, F.when(odd, lost).otherwise(c("line2"))), crop(0, 2, 0.1, c("line2")),
        crop(1, 0, 0.9, F.when(odd, c("line2")).otherwise(broken)), crop(1, 1, 0.05, broken),
    )
    crops = rows.select("doc_id", "line1", F.inline(each)).withColumn("parsed", parse(c("line1"), c("line2")))
    return candidates.resolve_orientation(crops).select("doc_id", "turn", "crop", "checks", c("parsed.valid").alias("valid"))


ZONE_ORIENTATION = f"""
WITH {HOLDERS}
SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS turn, CAST(1 - doc_id % 2 AS INTEGER) AS crop, CAST(4 AS INTEGER) AS checks, true AS valid FROM holders"""


def fragment_row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lines cut into three pieces each, read from the last to the first, a little askew."""
    cut = [(line, k, F.substring(line, 15 * k + 1, 15 if k < 2 else 14)) for line in ("line1", "line2") for k in range(3)]
    each = F.array(
        *[
            F.struct(
                F.lit(5 - n).alias("ord"), text.alias("text"), F.lit(150 * k).alias("x1"), (F.lit(40 * (line == "line2") + 2 * k) + (F.col("doc_id") % 3).cast("int")).alias("y1"),
                (F.lit(40 * (line == "line2") + 2 * k + 20) + (F.col("doc_id") % 3).cast("int")).alias("y2"), F.lit(0.9 + 0.01 * k).alias("confidence"),
            )
            for n, (line, k, text) in enumerate(cut)
        ]
    )
    rows = candidates.rows_of(lines(spark, sf_dir).select("doc_id", F.inline(each)))
    return rows.select("doc_id", "row_ord", "line", F.round("confidence", 6).alias("confidence"))


FRAGMENT_ROW_GROUPING = f"""
WITH {LINES}
SELECT doc_id, CAST(0 AS INTEGER) AS row_ord, line1 AS line, 0.91::DOUBLE AS confidence FROM lines
UNION ALL SELECT doc_id, CAST(1 AS INTEGER), line2, 0.91::DOUBLE FROM lines"""


def zone_from_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments to rows, rows to pairs, pairs to the best parse."""
    cut = [(line, k, F.substring(line, 15 * k + 1, 15 if k < 2 else 14)) for line in ("line1", "line2") for k in range(3)]
    each = F.array(
        *[
            F.struct(
                F.lit(n).alias("ord"), text.alias("text"), F.lit(150 * k).alias("x1"), F.lit(40 * (line == "line2")).alias("y1"),
                F.lit(40 * (line == "line2") + 20).alias("y2"), F.lit(0.9).alias("confidence"),
            )
            for n, (line, k, text) in enumerate(cut)
        ]
    )
    rows = candidates.rows_of(lines(spark, sf_dir).select("doc_id", F.inline(each)))
    best = candidates.best_parse(candidates.judged(candidates.adjacent_pairs(rows, ["doc_id"])), ["doc_id"])
    return best.select("doc_id", *flat("parsed"))


def strip_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated strips: each strip's joined line and its long single fragments, crossed."""
    c = F.col
    rows = lines(spark, sf_dir)
    strip = lambda line: rows.select(
        "doc_id",
        F.inline(F.array(
            F.struct(F.lit(0).alias("ord"), F.substring(line, 31, 14).alias("text"), F.lit(300).alias("x1"), F.lit(0.8).alias("confidence")),
            F.struct(F.lit(1).alias("ord"), F.substring(line, 1, 30).alias("text"), F.lit(0).alias("x1"), F.lit(0.9).alias("confidence")),
        )),
    )
    pairs = candidates.crossed_pairs(candidates.single_line(strip("line1"), ["doc_id"]), candidates.single_line(strip("line2"), ["doc_id"]), ["doc_id"])
    return pairs.select("doc_id", "visit", F.length("line1").alias("n1"), F.length("line2").alias("n2"), F.round("confidence", 4).alias("confidence"), F.md5(F.concat(c("line1"), c("line2"))).alias("pair_md5"))


STRIP_PAIRING = f"""
WITH {LINES}, a AS (
  SELECT doc_id, 0 AS o, line1, line2, 0.85 AS c FROM lines UNION ALL SELECT doc_id, 1, substr(line1, 1, 30), substr(line2, 1, 30), 0.9 FROM lines
)
SELECT x.doc_id, CAST(2 * x.o + y.o AS INTEGER) AS visit, CAST(length(x.line1) AS INTEGER) AS n1, CAST(length(y.line2) AS INTEGER) AS n2,
  round((x.c + y.c) / 2, 4)::DOUBLE AS confidence, md5(x.line1 || y.line2) AS pair_md5
FROM a x JOIN a y ON x.doc_id = y.doc_id"""

QUERIES = {
    "td3_check_digit": (td3_check_digit, TD3_CHECK_DIGIT),
    "td3_build_lines": (td3_build_lines, TD3_BUILD_LINES),
    "td3_parse": (td3_parse, TD3_PARSE),
    "td3_composite": (td3_composite, TD3_COMPOSITE),
    "mrz_date_resolution": (mrz_date_resolution, MRZ_DATE_RESOLUTION),
    "country_lookup": (country_lookup, _country_sql()),
    "mrz_clean_text": (mrz_clean_text, _clean_sql()),
    "line1_gate": (line1_gate, LINE1_GATE),
    "positional_constraints": (positional_constraints, POSITIONAL_CONSTRAINTS),
    "doc_number_repair": (doc_number_repair, _repair_sql()),
    "repaired_parse": (repaired_parse, REPAIRED_PARSE),
    "mrz_best_candidate": (mrz_best_candidate, MRZ_BEST_CANDIDATE),
    "zone_orientation": (zone_orientation, ZONE_ORIENTATION),
    "fragment_row_grouping": (fragment_row_grouping, FRAGMENT_ROW_GROUPING),
    "zone_from_fragments": (zone_from_fragments, TD3_PARSE),
    "strip_pairing": (strip_pairing, STRIP_PAIRING),
}
