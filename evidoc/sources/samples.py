"""Sample pages as tables: the text boxes, lines and measurements that a reader of generated pages
would give, for any number of holders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidoc.operators.mrz import build_lines

#: The page, the column of the fields and the baselines of their rows.
WIDTH, HEIGHT, LEFT = 1420, 1000, 470
ROWS = (
    ("Passport No", "number", 195), ("Surname", "surname", 260), ("Given names", "given_names", 325), ("Nationality", "nationality", 390), ("Date of birth", "birth_text", 455),
    ("Sex", "sex", 520), ("Place of birth", "place", 585), ("Date of issue", "issue_text", 650), ("Date of expiry", "expiry_text", 715),
)
#: Variants of a page with the sharpness and the glare that they are measured with; others are clean.
VARIANTS = {"clean": (400.0, 0.0), "skewed": (300.0, 0.0), "blurry": (20.0, 0.0), "glare": (400.0, 0.12)}


def boxes(holders: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Labels with values below them, the authority in a column of its own, and the zone in three
    pieces a line. ``holders`` has number, surname, given_names, nationality, birth, expiry (yymmdd),
    sex, place, authority, and birth_text, issue_text, expiry_text as printed."""
    c = F.col
    lines = build_lines(c("number"), c("surname"), c("given_names"), c("nationality"), c("nationality"), c("birth"), c("sex"), c("expiry"))
    box = lambda text, x, y, w: F.struct(text.alias("text"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + w).alias("x2"), F.lit(y + 20).alias("y2"))
    each = []
    for label, value, y in ROWS:
        each += [box(F.lit(label), LEFT, y - 10, 160), box(c(value), LEFT, y + 18, 260)]
    each += [box(F.lit("Authority"), 980, 185, 160), box(c("authority"), 980, 213, 260)]
    for k, line in enumerate(("line1", "line2")):
        each += [box(F.substring(f"l.{line}", 15 * n + 1, 15 if n < 2 else 14), 60 + 420 * n, 860 + 50 * k, 400) for n in range(3)]
    rows = holders.withColumn("l", lines).select("doc_id", F.posexplode(F.array(*each)).alias("ord", "b"))
    return rows.select("doc_id", "ord", "b.*").withColumns({"confidence": F.lit(confidence), "width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def measurements(pages: DataFrame) -> DataFrame:
    """Measurements of pages (doc_id, variant)."""
    sharp, glare = (F.create_map(*[F.lit(x) for v, own in VARIANTS.items() for x in (v, own[k])]) for k in range(2))
    pick = lambda table, k: F.coalesce(F.try_element_at(table, F.col("variant")), F.lit(VARIANTS["clean"][k]))
    return pages.select(
        "doc_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), pick(sharp, 0).alias("variance"), pick(glare, 1).alias("glare_ratio"),
        F.lit(150.0).alias("brightness"), F.lit(True).alias("page_found"),
    )
