"""Queries over the visual zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.functions.text import fold, same_transliterated, visual_date
from evidoc.operators import labels, visual
from evidoc.plans.bridge import LINES, boxes, scattered, spread, table


def visual_date_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in nine notations, two of them of no date."""
    d, k = "o_orderdate", F.col("o_orderkey") % 9
    up = lambda f: F.upper(F.date_format(d, f))
    text = (
        F.when(k == 0, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 1, F.date_format(d, "d/M/yyyy"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 3, up("dd MMM yyyy"))
        .when(k == 4, F.concat(up("dd MMM"), F.lit(" / "), up("MMM yy")))
        .when(k == 5, F.concat(F.lit("born "), F.date_format(d, "dd MM yyyy")))
        .when(k == 6, F.concat(F.lit("31.02."), F.date_format(d, "yyyy")))
        .when(k == 7, F.lit("no date"))
        .otherwise(F.concat(F.date_format(d, "dd"), F.lit(" JUILLET "), F.date_format(d, "yyyy")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", "text", visual_date(F.col("text")).cast("string").alias("date"))


VISUAL_DATE_LADDER = """
WITH t AS (
  SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN upper(strftime(o_orderdate, '%d %b %Y'))
    WHEN 4 THEN upper(strftime(o_orderdate, '%d %b') || ' / ' || strftime(o_orderdate, '%b %y')) WHEN 5 THEN 'born ' || strftime(o_orderdate, '%d %m %Y')
    WHEN 6 THEN '31.02.' || strftime(o_orderdate, '%Y') WHEN 7 THEN 'no date' ELSE strftime(o_orderdate, '%d') || ' JUILLET ' || strftime(o_orderdate, '%Y') END AS text
  FROM orders
)
SELECT o_orderkey, text, CASE WHEN o_orderkey % 9 IN (6, 7) THEN NULL WHEN o_orderkey % 9 = 8 THEN strftime(d, '%Y-07-%d') ELSE strftime(d, '%Y-%m-%d') END AS date FROM t"""


def transliteration_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    other = F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("doc_id") % 3 == 1, F.translate(F.lower(text), "éèñ", "eeÑ")).otherwise(F.concat(F.lit("< "), text))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold(text)).alias("folded_md5"), same_transliterated(text, other).alias("same"))


TRANSLITERATION_FOLD = """
SELECT doc_id, md5(upper(strip_accents(replace(text, 'ß', 'ss')))) AS folded_md5, text IS NOT NULL AND text <> '' AND doc_id % 3 <> 0 AS same FROM documents"""


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label texts, some of words that only contain a label."""
    k = F.col("l_linenumber")
    text = (
        F.when(k == 1, F.lit("Surname / Nom: SMITH"))
        .when(k == 2, F.lit("SURNAME: SMITH Given names: ANNA"))
        .when(k == 3, F.lit("Unsurnamed nominal"))
        .when(k == 4, F.lit("issue date of birth"))
        .when(k == 5, F.lit("Date de naissance 01.02.1990"))
        .when(k == 6, F.lit("(Passport No.) 12"))
        .otherwise(F.lit("STAATSANGEHÖRIGKEIT"))
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    # A file of few row groups keeps few cores busy; a row takes some 10 us, so a task has more of them than of pages.
    rows = spread(lines, "l_orderkey", keys=lines.count() // 20).select("l_orderkey", "l_linenumber", visual.label_matches(text).alias("m"))
    fields = F.array_join(F.transform("m", lambda x: F.concat(x["field"], F.lit("@"), x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",")
    return rows.select("l_orderkey", "l_linenumber", fields.alias("labels"))


LABEL_MATCH = """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'surname@0-7,surname@10-13' WHEN 2 THEN 'surname@0-7,given_names@15-26' WHEN 3 THEN ''
  WHEN 4 THEN 'date_of_birth@6-19' WHEN 5 THEN 'date_of_birth@0-17' WHEN 6 THEN 'passport_number@1-13' ELSE 'nationality@0-19' END AS labels
FROM lineitem"""


def inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.inline_values(boxes(spark, sf_dir)).select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"))


#: The confidence that a form's box has by its place in the reader's order.
CONF = "round(0.70 + ((doc_id * 7 + {} * 3) % 30) / 100.0, 2)"

INLINE_VALUES = f"""
WITH {LINES}
SELECT doc_id, 'passport_number' AS field, number AS value, {CONF.format(7)}::DOUBLE AS confidence FROM lines WHERE doc_id % 4 <> 3
UNION ALL SELECT doc_id, 'sex', CASE WHEN sex = '<' THEN 'X' ELSE sex END, {CONF.format(10)}::DOUBLE FROM lines"""


def label_value_spatial_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = visual.adjacent_candidates(scattered(spark, sf_dir))
    return found.select("doc_id", "l_ord", "ord", "way", F.round("score", 6).alias("score"))


LABEL_VALUE_SPATIAL_JOIN = """
WITH b AS (
  SELECT DISTINCT l_orderkey AS doc_id, l_partkey * 8 + l_linenumber AS ord, l_linenumber % 2 = 1 AS label, (l_partkey * 37) % 900 AS x1,
    (l_suppkey * 53 + l_linenumber * 29) % 600 AS y1, (l_partkey * 37) % 900 + 40 + CAST(trunc(l_quantity) AS INTEGER) AS x2, (l_suppkey * 53 + l_linenumber * 29) % 600 + 20 AS y2
  FROM lineitem
), p AS (
  SELECT l.doc_id, l.ord AS l_ord, v.ord, l.x1 AS lx1, l.y1 AS ly1, l.x2 AS lx2, l.y2 AS ly2, v.x1, v.y1, v.x2, v.y2
  FROM b l JOIN b v ON l.doc_id = v.doc_id WHERE l.label AND NOT v.label
)
SELECT doc_id, l_ord, ord, CAST(0 AS INTEGER) AS way, round(0.7 / (1 + (y1 - ly2) / 20.0) + 0.3 / (1 + abs(x1 - lx1) / 1400.0 * 10), 6)::DOUBLE AS score
FROM p WHERE y1 >= ly2 AND y1 - ly2 <= 60 AND ((x1 < lx2 AND lx1 < x2) OR abs(x1 - lx1) < 84)
UNION ALL
SELECT doc_id, l_ord, ord, CAST(1 AS INTEGER), round(0.9 / (1 + (x1 - lx2) / 1400.0 * 20), 6)::DOUBLE
FROM p WHERE x1 >= lx2 AND x1 - lx2 <= greatest(1.5 * (lx2 - lx1), 210) AND least(ly2, y2) - greatest(ly1, y1) > 6"""


def adjacent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.adjacent_values(boxes(spark, sf_dir)).select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"))


_ADJACENT = f"""
SELECT doc_id, 'surname' AS field, surname AS value, {CONF.format(1)}::DOUBLE AS confidence FROM lines
UNION ALL SELECT doc_id, 'given_names', given_names[1:4] || ' ' || given_names[5:9], round(({CONF.format(3)} + {CONF.format(4)}) / 2, 4)::DOUBLE FROM lines
UNION ALL SELECT doc_id, 'nationality', nationality, {CONF.format(6)}::DOUBLE FROM lines
UNION ALL SELECT doc_id, 'date_of_birth', '19' || birth[1:2] || '-' || birth[3:4] || '-' || birth[5:6], {CONF.format(9)}::DOUBLE FROM lines
UNION ALL SELECT doc_id, 'date_of_expiry', '20' || expiry[1:2] || '-' || expiry[3:4] || '-' || expiry[5:6], {CONF.format(12)}::DOUBLE FROM lines
UNION ALL SELECT doc_id, 'issuing_authority', 'OFFICE ' || nationality, {CONF.format(14)}::DOUBLE FROM lines"""
ADJACENT_VALUES = f"WITH {LINES} {_ADJACENT}"


def number_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.standalone_numbers(boxes(spark, sf_dir)).select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"))


# Where no number stands alone, a birth date in one word has the generic shape.
NUMBER_FALLBACK = f"""
WITH {LINES}
SELECT doc_id, 'passport_number' AS field, number AS value, {CONF.format(7)}::DOUBLE AS confidence FROM lines WHERE doc_id % 4 = 3
UNION ALL SELECT doc_id, 'passport_number', upper(strftime(strptime('19' || birth, '%Y%m%d'), '%d%b%Y')), round({CONF.format(9)} * 0.9, 4)::DOUBLE FROM lines WHERE doc_id % 4 <> 3"""


def visual_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.extract(boxes(spark, sf_dir)).select("doc_id", "field", "value", F.round("confidence", 4).alias("confidence"))


VISUAL_FIELDS = f"""
WITH {LINES} {_ADJACENT}
UNION ALL SELECT doc_id, 'passport_number', number, {CONF.format(7)}::DOUBLE FROM lines
UNION ALL SELECT doc_id, 'sex', CASE WHEN sex = '<' THEN 'X' ELSE sex END, {CONF.format(10)}::DOUBLE FROM lines"""

def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner points of turned boxes, from parts."""
    k = F.col("p_partkey").cast("int")
    point = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    box = F.array(point(k % 50 + 5, k % 31), point(k % 50 + F.col("p_size"), k % 17), point(k % 13, k % 31 + 40), point(k % 50, k % 7 + F.col("p_size")))
    return visual.with_bounds(table(spark, sf_dir, "part").select("p_partkey", box.alias("box"))).drop("box")


BOX_BOUNDS = """
WITH p AS (
  SELECT p_partkey, unnest([p_partkey % 50 + 5, p_partkey % 50 + p_size, p_partkey % 13, p_partkey % 50]) AS x, unnest([p_partkey % 31, p_partkey % 17, p_partkey % 31 + 40, p_partkey % 7 + p_size]) AS y FROM part
)
SELECT p_partkey, CAST(min(x) AS INTEGER) AS x1, CAST(min(y) AS INTEGER) AS y1, CAST(max(x) AS INTEGER) AS x2, CAST(max(y) AS INTEGER) AS y2 FROM p GROUP BY p_partkey"""

def indexed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one to three words that begin some conversations' turns, looked for in all turns."""
    turns = table(spark, sf_dir, "conversations")
    begin = F.regexp_extract("text", r"(?U)^(\w+(?:\W+\w+){0,2})", 1)
    k = F.col("conv_id") % 3 + 1
    cut = F.when(k == 1, F.regexp_extract(begin, r"(?U)^\w+", 0)).when(k == 2, F.regexp_extract(begin, r"(?U)^\w+\W+\w+", 0)).otherwise(begin)
    made = turns.select(cut.alias("label"), (F.col("conv_id") * 1_000 + F.col("turn")).alias("ord")).filter("label <> ''")
    rows = made.groupBy("label").agg(F.min("ord").alias("ord")).withColumn("field", F.concat(F.lit("f"), F.col("ord") % 7))
    found = labels.places(turns, ["conv_id", "turn"], labels.index(rows))
    return found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_places"), F.sum(F.col("start") * (F.col("stop") - F.col("start"))).alias("weighted"), F.countDistinct("rank").alias("n_labels"))


# Every label is tried at every place of every turn.
INDEXED_LABELS = r"""
WITH t AS (SELECT conv_id, turn, text, translate(lower(translate(text, 'İ', 'i')), 'ı', 'i') AS low FROM conversations WHERE text IS NOT NULL),
w AS (SELECT CASE conv_id % 3 WHEN 0 THEN regexp_extract(text, '^[\p{L}\p{M}\p{N}_]+') WHEN 1 THEN regexp_extract(text, '^[\p{L}\p{M}\p{N}_]+[^\p{L}\p{M}\p{N}_]+[\p{L}\p{M}\p{N}_]+')
  ELSE regexp_extract(text, '^[\p{L}\p{M}\p{N}_]+(?:[^\p{L}\p{M}\p{N}_]+[\p{L}\p{M}\p{N}_]+){0,2}') END AS label, conv_id * 1000 + turn AS ord FROM t),
g AS (SELECT label, min(ord) AS ord FROM w WHERE label <> '' GROUP BY label),
l AS (SELECT translate(lower(translate(label, 'İ', 'i')), 'ı', 'i') AS low, 'f' || (ord % 7) AS field, min(ord) AS ord FROM g GROUP BY ALL),
c AS (SELECT conv_id, turn, t.low AS text, l.low AS label, ord FROM t JOIN l ON contains(t.low, l.low)),
p AS (SELECT c.*, s - 1 AS start FROM c, range(1, 20000) r(s) WHERE s <= length(text) AND substr(text, s, length(label)) = label)
SELECT conv_id, turn, count(*) AS n_places, sum(start * length(label))::BIGINT AS weighted, count(DISTINCT ord) AS n_labels FROM p
WHERE (start = 0 OR NOT regexp_matches(substr(text, start, 1), '[\p{L}\p{M}\p{N}_]')) AND NOT regexp_matches(substr(text, start + length(label) + 1, 1), '[\p{L}\p{M}\p{N}_]') GROUP BY conv_id, turn"""


QUERIES = {
    "indexed_labels": (indexed_labels, INDEXED_LABELS),
    "box_bounds": (box_bounds, BOX_BOUNDS),
    "visual_date_ladder": (visual_date_ladder, VISUAL_DATE_LADDER),
    "transliteration_fold": (transliteration_fold, TRANSLITERATION_FOLD),
    "label_match": (label_match, LABEL_MATCH),
    "inline_values": (inline_values, INLINE_VALUES),
    "label_value_spatial_join": (label_value_spatial_join, LABEL_VALUE_SPATIAL_JOIN),
    "adjacent_values": (adjacent_values, ADJACENT_VALUES),
    "number_fallback": (number_fallback, NUMBER_FALLBACK),
    "visual_fields": (visual_fields, VISUAL_FIELDS),
}
