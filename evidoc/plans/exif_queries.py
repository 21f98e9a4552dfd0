"""Queries over photographs' metadata, in files of differing layouts put together by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.plans.bridge import table
from evidoc.plans.pixel_queries import drawn
from evidoc.sources import exif

c = F.col


def _bytes(value: Column, n: int, little: Column) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.when(little, F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])).otherwise(digits)


def photographs(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``content``: JPEG heads with segments before the metadata, entries before the orientation,
    either byte order and differing directory offsets; every 7th damaged, every 11th without metadata."""
    k = c(key)
    little, big = k % 2 == 1, F.lit(False)
    before = F.repeat(F.concat(F.lit("FFE0"), _bytes(2 + k % 23, 2, big), F.expr(f"repeat('A5', cast({key} % 23 AS INT))")), (k % 4).cast("int"))
    entry = lambda tag, value: F.concat(_bytes(tag, 2, little), _bytes(F.lit(3), 2, little), _bytes(F.lit(1), 4, little), _bytes(value, 2, little), F.lit("0000"))
    others = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 5), lambda i: entry(F.lit(0x0100) + i, F.lit(6).cast("long") + i)), "")
    gap = F.expr(f"repeat('00', cast({key} % 6 AS INT))")
    directory = F.concat(_bytes(k % 5 + 2, 2, little), others, entry(F.lit(exif.ORIENTATION), k % 9), F.lit("00000000"))
    offset = F.when(k % 7 == 3, F.lit(60_000).cast("long")).otherwise(8 + k % 6)
    header = F.concat(F.when(little, F.lit("4949")).otherwise("4D4D"), _bytes(F.lit(42), 2, little), _bytes(offset, 4, little), gap, directory)
    body = F.concat(F.lit(exif.EXIF), header)
    app1 = F.concat(F.lit(exif.METADATA), _bytes(2 + F.length(body) / 2, 2, big), body)
    pixels = F.lit("FFDB0004AAAAFFDA0004BBBB")
    return rows.select(key, F.unhex(F.concat(F.lit(exif.START), before, F.when(k % 11 != 0, app1).otherwise(""), pixels)).alias("content"))


def exif_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photographs(table(spark, sf_dir, "part"), "p_partkey")
    return rows.select("p_partkey", exif.orientation(c("content")).alias("orientation"), exif.quarters(c("content")).alias("quarters"))


EXIF_TURNS = """
WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 3 AND p_partkey % 9 > 0 THEN p_partkey % 9 END AS v FROM part)
SELECT p_partkey, v::INTEGER AS orientation, CASE v WHEN 3 THEN 2 WHEN 6 THEN 1 WHEN 8 THEN 3 ELSE 0 END AS quarters FROM o"""


def upright_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 7 by 5 pixels turned by what photographs of the same numbers say, as digits."""
    gray = drawn(spark, sf_dir, 7, 5, lambda s, x, y: (s * 7 + x * 30 + y * 3) % 256)
    turn = photographs(table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("doc_id")), "doc_id").select("doc_id", exif.quarters(c("content")).alias("turn"))
    image = F.struct(F.lit("").alias("origin"), c("height"), c("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), c("gray").alias("data"))
    out = exif.upright(gray.join(turn, "doc_id").select("doc_id", image.alias("image"), "turn"))
    return out.select("doc_id", "image.width", "image.height", F.hex("image.data").alias("digits"))


# A clockwise quarter moves column 0 to the top row, from below to above.
UPRIGHT_IMAGES = """
WITH o AS (SELECT s_suppkey AS d, CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 7 = 3 THEN 0 ELSE CASE s_suppkey % 9 WHEN 3 THEN 2 WHEN 6 THEN 1 WHEN 8 THEN 3 ELSE 0 END END AS q FROM supplier),
p AS (SELECT d, q, (d * 7 + x * 30 + y * 3) % 256 AS v,
    CASE q WHEN 0 THEN x WHEN 1 THEN 4 - y WHEN 2 THEN 6 - x ELSE y END AS nx, CASE q WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 4 - y ELSE 6 - x END AS ny FROM o, range(7) a(x), range(5) b(y))
SELECT d AS doc_id, CASE WHEN q % 2 = 1 THEN 5 ELSE 7 END AS width, CASE WHEN q % 2 = 1 THEN 7 ELSE 5 END AS height, string_agg(printf('%02X', v), '' ORDER BY ny, nx) AS digits FROM p GROUP BY d, q"""

QUERIES = {"exif_turns": (exif_turns, EXIF_TURNS), "upright_images": (upright_images, UPRIGHT_IMAGES)}
