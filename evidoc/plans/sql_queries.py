"""Queries written in SQL text, with the temporary functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.functions import sql
from evidoc.plans.bridge import LINES, lines, sql_digit, table

ZONE_TEXT = """
SELECT doc_id, mrz_check_digit(number) AS number_digit,
  mrz_verify(substr(line2, 1, 9), substr(line2, 10, 1)) AS number_ok, mrz_verify(substr(line2, 14, 6), substr(line2, 20, 1)) AS birth_ok,
  mrz_composite_ok(line2) AS composite_ok, mrz_composite_ok(substr(line2, 1, 43) || 'X') AS wrong_ok,
  cast(mrz_date(birth, false, 2026) AS STRING) AS birth_date, cast(mrz_date(expiry, true, 2026) AS STRING) AS expiry_date,
  mrz_clean(' ' || lower(line1) || '!? ') AS cleaned
FROM {lines}"""


def sql_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits, dates and cleaning of the zone; every fifth number has a wrong digit."""
    sql.register(spark)
    rows = lines(spark, sf_dir)
    wrong = F.concat(F.substring("line2", 1, 9), ((F.substring("line2", 10, 1).cast("int") + 1) % 10).cast("string"), F.substring("line2", 11, 34))
    return spark.sql(ZONE_TEXT, lines=rows.withColumn("line2", F.when(F.col("doc_id") % 5 == 1, wrong).otherwise(F.col("line2"))))


def _year(column: str, expiry: bool) -> str:
    y = f"(2000 + {column}[1:2]::INTEGER)"
    return f"CASE WHEN {y} {'< 2006' if expiry else '> 2026'} THEN {y} {'+' if expiry else '-'} 100 ELSE {y} END"


SQL_ZONE = f"""
WITH {LINES}
SELECT doc_id, {sql_digit('number')} AS number_digit, doc_id % 5 <> 1 AS number_ok, true AS birth_ok, doc_id % 5 <> 1 AS composite_ok,
  line2[44] = '0' AND false AS wrong_ok, ({_year('birth', False)}) || '-' || birth[3:4] || '-' || birth[5:6] AS birth_date, ({_year('expiry', True)}) || '-' || expiry[3:4] || '-' || expiry[5:6] AS expiry_date,
  line1 || '17' AS cleaned FROM lines"""


MATCH_TEXT = """
SELECT o_orderkey, cast(visual_date(text) AS STRING) AS read, names_match(a, b) AS same, name_fold(a) AS folded FROM {seen}"""


def sql_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as they are printed in five ways, one of them impossible, and names with accents."""
    sql.register(spark)
    k = F.col("o_orderkey") % 5
    shown = lambda form: F.date_format("o_orderdate", form)
    text = F.when(k == 0, shown("dd.MM.yyyy")).when(k == 1, shown("yyyy-MM-dd")).when(k == 2, F.concat(F.lit("on "), F.upper(shown("d MMM yyyy")))).when(k == 3, F.concat(shown("dd"), F.lit(" "), F.upper(shown("MMM")), F.lit(" / JUIN "), shown("yy")))
    status = F.col("o_orderpriority")
    seen = table(spark, sf_dir, "orders").select(
        "o_orderkey", text.otherwise(F.lit("31.02.1999")).alias("text"), F.translate(status, "EIO", "ÉÎÖ").alias("a"), F.when(k == 4, F.lit("")).when(k == 3, F.lower(status)).otherwise(F.concat(status, F.lit(" <"))).alias("b")
    )
    return spark.sql(MATCH_TEXT, seen=seen)


SQL_VISUAL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS read, o_orderkey % 5 <> 4 AS same, upper(o_orderpriority) AS folded FROM orders"""

QUERIES = {"sql_zone": (sql_zone, SQL_ZONE), "sql_visual": (sql_visual, SQL_VISUAL)}
