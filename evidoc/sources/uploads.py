"""Uploaded files as rows: type by leading bytes, limits, names and replayable session ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.settings import DEFAULTS
from evidoc.sources import exif

#: Brands of the HEIF family.
HEIF_BRANDS = ("heic", "heix", "hevc", "heim", "mif1", "msf1")


#: Media types and file endings that may be sent.
MEDIA_TYPES = ("image/jpeg", "image/png", "image/webp", "image/heic", "image/heif", "application/pdf")
ENDINGS = ("jpg", "jpeg", "png", "webp", "heic", "heif", "pdf")


def sendable(name: Column, media: Column, length: Column, limit: int = DEFAULTS.max_upload_bytes) -> Column:
    """Whether a file may be sent: not empty, within the limit, of a known type or ending."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(length.between(1, limit) & (media.isin(*MEDIA_TYPES) | ending.isin(*ENDINGS)), F.lit(False))


def media_type(content: Column) -> Column:
    """The media type that a file's leading bytes tell, or null (also for fewer than 12 bytes)."""
    is_ = lambda start, hexed: F.hex(F.substring(content, start, len(hexed) // 2)) == hexed
    text = lambda s: s.encode().hex().upper()
    brand = F.hex(F.substring(content, 9, 4)).isin(*[text(b) for b in HEIF_BRANDS])
    kind = (
        F.when(is_(1, "FFD8FF"), F.lit("image/jpeg"))
        .when(is_(1, "89504E470D0A1A0A"), F.lit("image/png"))
        .when(is_(1, text("RIFF")) & is_(9, text("WEBP")), F.lit("image/webp"))
        .when(is_(1, text("%PDF")), F.lit("application/pdf"))
        .when(is_(5, text("ftyp")) & brand, F.lit("image/heic"))
    )
    return F.when(F.octet_length(content) >= 12, kind)


def rejection(content: Column, limit: int = DEFAULTS.max_upload_bytes) -> Column:
    """Why a file is not taken, or null: ``empty``, ``too large`` or ``unknown type``."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, F.lit("empty")).when(size > limit, F.lit("too large")).when(media_type(content).isNull(), F.lit("unknown type"))


def session_id(content: Column) -> Column:
    """A session id that the same bytes always get."""
    return F.sha2(content, 256)


def data_url(content: Column, media: str = "image/jpeg") -> Column:
    return F.when(F.octet_length(content) > 0, F.concat(F.lit(f"data:{media};base64,"), F.base64(content))).otherwise("")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length, media_type, session_id, rejection and content of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", "length", media_type(F.col("content")).alias("media_type"), session_id(F.col("content")).alias("session_id"),
        rejection(F.col("content")).alias("rejection"), "content",
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the origin) and Spark's image struct of every JPEG or PNG under ``path``,
    within the pixel limit, turned upright as the files' metadata say."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    small = rows.filter(F.col("image.width").cast("long") * F.col("image.height") <= DEFAULTS.max_pixels)
    # The image source gives no metadata: they come from the files' bytes, of which only a number is kept.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    plain = lambda p: F.regexp_replace(p, "^([a-z0-9]+):/+", "$1:/")
    turns = files.select(plain(F.col("path")).alias("__path"), exif.quarters(F.col("content")).alias("turn")).filter("turn > 0")
    decoded = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # origins are URIs, paths are not
    named = small.withColumn("__path", plain(decoded)).join(turns, "__path", "left")
    return exif.upright(named.select(F.xxhash64("image.origin").alias("doc_id"), "image", F.coalesce("turn", F.lit(0)).alias("turn")))
