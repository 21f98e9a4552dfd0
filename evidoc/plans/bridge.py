"""Inputs of the engine derived from the driver's tables, in DataFrame and in SQL form.

The tables hold no identity documents, so holders, machine-readable lines, forms of text boxes and
candidate lines are made from customers, orders and line items by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.operators.mrz import build_lines

PAGE_W, PAGE_H = 1400, 1000
#: Keys that one task makes rows from.
KEYS_A_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, keys: int | None = None) -> DataFrame:
    """Rows dealt to all cores by ``key``: where a few bytes of a table grow to images or profiles, its files
    are too small for Spark to split them by size. A task has no more than about ``KEYS_A_TASK``, however many
    there are; unless ``keys`` says how many, they are counted in the files' footers."""
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, (rows.count() if keys is None else keys) // KEYS_A_TASK + 1)
    return rows.repartition(tasks, key)


def lettered(s: Column) -> Column:
    return F.translate(s, "0123456789_", "ABCDEFGHIJ ")


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number, surname, given_names, nationality, birth and expiry (yymmdd), sex."""
    span = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("b"), F.max("o_orderdate").alias("e"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(span, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(
        F.col("c_custkey").alias("doc_id"),
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("number"),
        lettered(F.col("n_name")).alias("surname"),
        lettered(F.substring("c_name", 10, 9)).alias("given_names"),
        F.concat(F.lit("N"), lettered(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))).alias("nationality"),
        F.coalesce(F.date_format("b", "yyMMdd"), F.lit("800101")).alias("birth"),
        F.coalesce(F.date_format("e", "yyMMdd"), F.lit("300101")).alias("expiry"),
        F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("<")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("sex"),
    )


HOLDERS = """
span AS (SELECT o_custkey, min(o_orderdate) AS b, max(o_orderdate) AS e FROM orders GROUP BY o_custkey),
holders AS (
  SELECT c_custkey AS doc_id, 'C' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS number,
         translate(n_name, '0123456789_', 'ABCDEFGHIJ ') AS surname,
         translate(substr(c_name, 10, 9), '0123456789', 'ABCDEFGHIJ') AS given_names,
         'N' || translate(lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), '0123456789', 'ABCDEFGHIJ') AS nationality,
         coalesce(strftime(b, '%y%m%d'), '800101') AS birth, coalesce(strftime(e, '%y%m%d'), '300101') AS expiry,
         ['M', 'F', '<'][c_custkey % 3 + 1] AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN span ON c_custkey = o_custkey
)"""


def sql_digit(s: str) -> str:
    """SQL for the check digit of ``s``."""
    value = "greatest(0, strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)"
    return f"CAST(coalesce(list_sum(list_transform(string_split({s}, ''), lambda c, i: {value} * [7, 3, 1][(i - 1) % 3 + 1])), 0) % 10 AS VARCHAR)"


LINES = (
    HOLDERS
    + f""",
body AS (
  SELECT *, rpad('P<' || nationality || replace(surname, ' ', '<') || '<<' || given_names, 44, '<') AS line1,
         number || {sql_digit('number')} || nationality || birth || {sql_digit('birth')} || sex || expiry || {sql_digit('expiry')} || repeat('<', 15) AS body
  FROM holders
),
lines AS (
  SELECT * EXCLUDE (body), body || {sql_digit("(body[1:10] || body[14:20] || body[22:43])")} AS line2 FROM body
)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holders with their two lines."""
    rows = holders(spark, sf_dir)
    c = F.col
    own = build_lines(c("number"), c("surname"), c("given_names"), c("nationality"), c("nationality"), c("birth"), c("sex"), c("expiry"))
    return rows.withColumn("l", own).select(*rows.columns, "l.line1", "l.line2")


def noisy(number: Column, key: Column) -> Column:
    """``number`` with as many misread digits as ``key`` modulo 4 says."""
    wrong = lambda c: F.translate(c, "0123456789", "OIZEASGTBP")
    swap = lambda s, p: F.concat(F.substr(s, F.lit(1), p - 1), wrong(F.substr(s, p, F.lit(1))), F.substr(s, p + 1))
    first = F.when(key % 4 > 0, swap(number, F.lit(4) + (key % 3).cast("int"))).otherwise(number)
    second = F.when(key % 4 > 1, swap(first, F.lit(7))).otherwise(first)
    return F.when(key % 4 > 2, swap(second, F.lit(9))).otherwise(second)


def _sql_swap(s: str, p: str) -> str:
    return f"(substr({s}, 1, {p} - 1) || translate(substr({s}, {p}, 1), '0123456789', 'OIZEASGTBP') || substr({s}, {p} + 1))"


NOISY = (
    LINES
    + f""",
noise1 AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN {_sql_swap('number', '(4 + doc_id % 3)')} ELSE number END AS w1 FROM lines),
noise2 AS (SELECT *, CASE WHEN doc_id % 4 > 1 THEN {_sql_swap('w1', '7')} ELSE w1 END AS w2 FROM noise1),
noise AS (SELECT * EXCLUDE (w1, w2), CASE WHEN doc_id % 4 > 2 THEN {_sql_swap('w2', '9')} ELSE w2 END AS wrong FROM noise2)"""
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form of text boxes per holder: labels with values inside, below and beside them, a value in
    two boxes beside another column, a number without a label on every fourth, and the zone."""
    rows = spread(lines(spark, sf_dir), "doc_id", table(spark, sf_dir, "customer").count())
    c, lit = F.col, F.lit
    # Printed as the digits say: the day of a real order, 29 February 2000, is none in 1900.
    part = lambda name, start: F.substring(name, start, 2)
    month = F.upper(F.date_format(F.to_date(F.concat(lit("2000-"), part("birth", 3), lit("-01"))), "MMM"))
    birth = F.concat_ws(" ", part("birth", 5), month, F.concat(lit("19"), part("birth", 1)))
    expiry = F.concat_ws(".", part("expiry", 5), part("expiry", 3), F.concat(lit("20"), part("expiry", 1)))
    sex = F.when(c("sex") == "M", "MALE").when(c("sex") == "F", "FEMALE").otherwise("X")
    number = F.when(c("doc_id") % 4 == 3, c("number")).otherwise(F.concat(lit("Passport No.: "), c("number")))
    texts = [
        # text, x1, y1, width
        (lit("Surname"), 100, 100, 90), (c("surname"), 100, 125, 200),
        (lit("Given names"), 100, 200, 110), (F.substring("given_names", 1, 4), 100, 225, 60), (F.substring("given_names", 5, 5), 175, 225, 70),
        (lit("Nationality"), 300, 200, 100), (c("nationality"), 300, 225, 60),
        (number, 700, 100, 300),
        (lit("Date of birth"), 100, 300, 130), (birth, 100, 325, 150),
        (F.concat(lit("Sex: "), sex), 700, 300, 120),
        (lit("Date of expiry"), 100, 420, 140), (expiry, 260, 420, 140),
        (lit("Authority"), 100, 560, 90), (F.concat(lit("OFFICE "), c("nationality")), 100, 585, 160),
        (c("line1"), 100, 900, 1200), (c("line2"), 100, 940, 1200),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("ord"), t.alias("text"), *[F.lit(v).alias(n) for n, v in (("x1", x), ("y1", y), ("x2", x + w), ("y2", y + 20))]) for k, (t, x, y, w) in enumerate(texts)])
    confidence = 0.70 + (F.col("doc_id") * 7 + F.col("ord") * 3) % 30 / 100.0
    return rows.select("doc_id", F.inline(each)).withColumns({"confidence": F.round(confidence, 2), "width": F.lit(PAGE_W), "height": F.lit(PAGE_H)})


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes at places that line items give, a page per order; odd line numbers are labels."""
    c = F.col
    x, y = ((c("l_partkey") * 37) % 900).cast("int"), ((c("l_suppkey") * 53 + c("l_linenumber") * 29) % 600).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"),
        (c("l_partkey") * 8 + c("l_linenumber")).alias("ord"),
        F.concat(F.lit("v"), c("l_partkey").cast("string")).alias("text"),
        (c("l_quantity") / 100.0).alias("confidence"),
        F.when(c("l_linenumber") % 2 == 1, F.lit("surname")).alias("label"),
        x.alias("x1"), y.alias("y1"), (x + 40 + c("l_quantity").cast("int")).alias("x2"), (y + 20).alias("y2"),
        F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"),
    )
    # Two line items of an order may have the same part and number, and still lie at different places.
    return rows.dropDuplicates(["doc_id", "ord", "label", "x1", "y1", "x2", "y2"])
