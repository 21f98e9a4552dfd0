"""Decisions about images, given what a reader measured: geometry, choices and quality rules.

Pixels are measured by one Arrow-batched function over Spark's image rows; everything that follows
(which contour, turn, line band or portrait, and what is good enough) is plain column work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidoc.functions.text import let
from evidoc.settings import DEFAULTS


def ordered_quad(points: Column) -> Column:
    """Corner points (structs of x and y) as a struct: tl, tr, br, bl."""
    by = lambda key: F.array_sort(F.transform(points, lambda p, i: F.struct(key(p).alias("key"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    first = lambda s: F.struct(F.get(s, 0)["x"].alias("x"), F.get(s, 0)["y"].alias("y"))
    total, slope = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]
    return F.struct(
        first(by(total)).alias("tl"), first(by(slope)).alias("tr"), first(by(lambda p: -total(p))).alias("br"), first(by(lambda p: -slope(p))).alias("bl")
    )


def page_contour(contours: DataFrame) -> DataFrame:
    """Of each page's ten largest contours, the first that can be the document's: a quadrilateral of
    a third of the page and of a passport's proportions (doc_id, ord, area, corners, aspect,
    page_area)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("area"), "ord")
    top = contours.withColumn("__k", F.row_number().over(w)).filter("__k <= 10")
    good = top.filter((F.col("area") >= 0.35 * F.col("page_area")) & (F.col("corners") == 4) & F.col("aspect").between(1.15, 1.8))
    return good.groupBy("doc_id").agg(F.min_by(F.struct("ord", "area", "aspect"), "__k").alias("c")).select("doc_id", "c.*")


def zone_contour(contours: DataFrame) -> DataFrame:
    """The largest contour that can be a machine-readable zone (doc_id, ord, area, x, y, w, h,
    page_w, page_h), padded; where there is none, the bottom quarter of the page."""
    good = (F.col("w") / F.col("page_w") > 0.50) & (F.col("w") / F.greatest(F.lit(1), F.col("h")) > 2.5) & (F.col("h") >= 40)
    best = contours.groupBy("doc_id", "page_w", "page_h").agg(F.min_by(F.when(good, F.struct("x", "y", "w", "h")), F.when(good, F.struct(-F.col("area"), F.col("ord")))).alias("c"))
    px, py = F.floor(F.col("c.w") * 0.05), F.floor(F.col("c.h") * 0.35)
    x1, y1 = F.greatest(F.lit(0), F.col("c.x") - px), F.greatest(F.lit(0), F.col("c.y") - py)
    x2, y2 = F.least(F.col("page_w"), F.col("c.x") + F.col("c.w") + px), F.least(F.col("page_h"), F.col("c.y") + F.col("c.h") + py)
    found = F.col("c").isNotNull()
    put = lambda a, b: F.when(found, a).otherwise(b).cast("int")
    return best.select(
        "doc_id", found.alias("found"), put(x1, F.lit(0)).alias("x1"), put(y1, F.floor(F.col("page_h") * 0.75)).alias("y1"),
        put(x2, F.col("page_w")).alias("x2"), put(y2, F.col("page_h")).alias("y2"),
    )


def best_turn(turns: DataFrame) -> DataFrame:
    """Of four quarter turns (doc_id, turn 0 to 3, width, height, score) the best; a portrait page
    counts three quarters. Without any score a portrait page is turned once, others not."""
    scored = turns.withColumn("s", F.when(F.col("width") <= F.col("height"), F.col("score") * 0.75).otherwise(F.col("score")))
    best = scored.groupBy("doc_id").agg(
        F.max_by("turn", F.struct("s", -F.col("turn"))).alias("turn"), F.max("s").alias("s"), F.max(F.when(F.col("turn") == 0, F.col("height") > F.col("width"))).alias("portrait")
    )
    return best.select("doc_id", F.when(F.col("s") > 0, F.col("turn")).when(F.col("portrait"), F.lit(1)).otherwise(F.lit(0)).alias("turn"), F.col("s").alias("score"))


def skew(segments: DataFrame) -> DataFrame:
    """The angle to turn a page back by (doc_id, angle of each line segment): the median of at least
    five angles within twenty degrees, if over half a degree; else 0."""
    near = F.when(F.abs("angle") < 20, F.col("angle"))
    middle = segments.groupBy("doc_id").agg(F.count(near).alias("n"), F.percentile(near, 0.5).alias("m"))
    return middle.select("doc_id", F.col("n").alias("segments"), F.when((F.col("n") >= 5) & (F.abs("m") > 0.5), F.col("m")).otherwise(F.lit(0.0)).alias("angle"))


def line_bands(profiles: DataFrame) -> DataFrame:
    """Text bands of a strip from its smoothed row profile (doc_id, profile: array of double): bands
    of at least 8 % of the height above a threshold; of more than two, close ones are merged."""
    return _bands(profiles).select("doc_id", "h", "bands")


def line_crops(profiles: DataFrame) -> DataFrame:
    """doc_id, h, crops: the rows to read as lines, as structs of ``a`` and ``b`` (end), from the top.

    Two bands get a margin of 15 % of their height (two rows at least). A single band is cut where the
    profile is lowest within a sixth of the height from the middle (the uppermost of equal places),
    and both parts reach a twentieth over the cut. Otherwise the whole strip is the one crop.
    """
    rows = _bands(profiles)
    h = F.col("h")
    crop = lambda a, b: F.struct(F.greatest(F.lit(0), a).cast("int").alias("a"), F.least(h, b).cast("int").alias("b"))
    margin = lambda x: F.greatest(F.lit(2), F.floor((x["b"] - x["a"]) * 0.15))
    two = F.transform("bands", lambda x: crop(x["a"] - margin(x), x["b"] + margin(x)))
    sixth, middle, over = F.floor(h / 6), F.floor(h / 2), F.greatest(F.lit(2), F.floor(h / 20))
    low = F.greatest(F.lit(0), middle - sixth).cast("int")
    near = F.slice(F.col("profile"), low + 1, (F.least(h, middle + sixth) - low).cast("int"))
    gap = low + F.array_position(near, F.array_min(near)) - 1
    cut = F.array(crop(F.lit(0), gap + over), crop(gap - over, h))
    whole = F.array(crop(F.lit(0), h))
    crops = F.when(F.size("bands") == 2, two).when((F.col("found") == 1) & (F.size(near) > 0), cut).otherwise(whole)
    return rows.select("doc_id", "h", crops.alias("crops"))


def _bands(profiles: DataFrame) -> DataFrame:
    """doc_id, h, profile, the number of bands found, and ``bands`` after merging."""
    high = F.size("profile")
    top = F.array_max("profile")
    mean = F.aggregate("profile", F.lit(0.0), lambda a, v: a + v) / high
    # The limit is bound once a row, not worked out at each place.
    on = let(F.greatest(mean * 0.3, top * 0.15), lambda limit: F.transform("profile", lambda v: v > limit))
    rows = profiles.select("doc_id", "profile", high.alias("h"), on.alias("on"))
    edge = lambda i, other: F.coalesce(F.get(F.col("on"), other), F.lit(False))
    places = F.sequence(F.lit(0), F.col("h") - 1)
    starts = F.filter(places, lambda i: F.get(F.col("on"), i) & ((i == 0) | ~edge(i, i - 1)))
    stops = F.transform(F.filter(places, lambda i: F.get(F.col("on"), i) & ((i == F.col("h") - 1) | ~edge(i, i + 1))), lambda i: i + 1)
    all_bands = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.struct(x["a"].cast("int").alias("a"), x["b"].cast("int").alias("b")))
    rows = rows.select("doc_id", "profile", "h", F.filter(all_bands, lambda x: x["b"] - x["a"] >= F.col("h") * 0.08).alias("bands"))
    average = F.aggregate("bands", F.lit(0.0), lambda s, x: s + (x["b"] - x["a"])) / F.size("bands")
    none = F.array().cast("array<struct<a:int,b:int>>")

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), x["b"].alias("b"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["a"] - last["b"] < average * 0.4, joined).otherwise(F.concat(done, F.array(x)))

    return rows.select("doc_id", "profile", "h", F.size("bands").alias("found"), F.when(F.size("bands") > 2, F.aggregate("bands", none, merge)).otherwise(F.col("bands")).alias("bands"))


def zone_presence(glyphs: DataFrame) -> DataFrame:
    """How much a page's glyphs look like a machine-readable zone, 0 to 1 (doc_id, x, y, height,
    area, page_w, page_h): lines of many glyphs at a constant pitch over the whole width."""
    fit = glyphs.filter((F.col("height") > 0.04 * F.col("page_h")) & (F.col("height") < 0.45 * F.col("page_h")) & (F.col("area") > 8))
    page = Window.partitionBy("doc_id")
    down = page.orderBy("y", "x")
    rows = fit.withColumn("n", F.count(F.lit(1)).over(page)).withColumn("mean", F.avg("height").over(page)).filter("n >= 20")
    jump = F.coalesce(F.col("y") - F.lag("y").over(down) > F.col("mean") * 0.8, F.lit(False)).cast("int")
    rows = rows.withColumn("jump", jump).withColumn("line", F.sum("jump").over(down))
    bounds = rows.groupBy("doc_id", "line").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("own")).filter("own >= 15")
    # A line takes all glyphs within a pixel of its bounds, its neighbours' too.
    inside = bounds.join(fit.select("doc_id", "x", "y", "page_w"), "doc_id").filter(F.col("y").between(F.col("low") - 1, F.col("high") + 1))
    along = Window.partitionBy("doc_id", "line").orderBy("x")
    gaps = inside.withColumn("gap", F.col("x") - F.lag("x").over(along))
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    lines = gaps.groupBy("doc_id", "line").agg(
        F.count(F.lit(1)).alias("n"), F.count(gap).alias("gaps"), (F.stddev_pop(gap) / F.greatest(F.lit(1e-6), F.avg(gap))).alias("cv"),
        ((F.max("x") - F.min("x")) / F.first("page_w")).alias("spread"),
    )
    usable = lines.filter("n >= 20 and gaps >= 15")
    score = 0.35 * F.greatest(F.lit(0.0), 1 - F.col("cv") / 0.6) + 0.35 * F.least(F.lit(1.0), F.col("n") / 40.0) + 0.30 * F.col("spread")
    best = usable.groupBy("doc_id").agg(F.max(score).alias("best"))
    found = bounds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    every = glyphs.select("doc_id").distinct().join(best, "doc_id", "left").join(found, "doc_id", "left")
    total = F.col("best") * (0.7 + 0.3 * F.least(F.lit(1.0), F.col("lines") / 2.0))
    return every.select("doc_id", F.coalesce(F.col("lines"), F.lit(0)).alias("lines"), F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0))).alias("presence"))


def candidate_crops(pages: DataFrame) -> DataFrame:
    """Regions to look for a zone in (doc_id, page_w, page_h, and x1, y1, x2, y2 of the contour's
    crop): the crop, then bands from 75, 62 and 45 % down; equal ones once, small ones not."""
    band = lambda share: F.struct(F.lit(0).alias("x1"), F.floor(F.col("page_h") * share).cast("int").alias("y1"), F.col("page_w").cast("int").alias("x2"), F.col("page_h").cast("int").alias("y2"))
    own = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    rows = pages.select("doc_id", F.posexplode(F.array(own, band(0.75), band(0.62), band(0.45))).alias("ord", "b"))
    big = rows.filter((F.col("b.y2") - F.col("b.y1") >= 20) & (F.col("b.x2") - F.col("b.x1") >= 100))
    return big.groupBy("doc_id", "b").agg(F.min("ord").alias("ord")).select("doc_id", "ord", "b.*")


def portrait(faces: DataFrame) -> DataFrame:
    """The holder's portrait among detected faces (doc_id, ord, x, y, w, h, detection, page_w,
    page_h; a page without faces has a row of null ord): box with margins and confidence."""
    page = Window.partitionBy("doc_id")
    area = F.col("w") * F.col("h")
    rows = faces.withColumn("area", area).withColumn("largest", F.max(area).over(page)).withColumn("n", F.count("ord").over(page))
    rows = rows.filter(F.col("ord").isNull() | (F.col("n") == 1) | (F.col("area") >= 0.35 * F.col("largest")))
    place, shape = F.col("x") / F.col("page_w"), F.when(F.col("h") > 0, F.col("w") / F.col("h"))
    bonus = F.when(place < 0.38, 0.2).when(place > 0.60, 0.1).otherwise(0.0)
    score = F.col("area") / F.col("largest") + bonus + F.when(shape.between(0.60, 0.85), 0.1).otherwise(0.0) + 0.15 * F.col("detection")
    rows = rows.withColumn("score", score).withColumn("k", F.row_number().over(page.orderBy(F.desc("score"), "ord"))).filter("k = 1")
    some = F.col("ord").isNotNull()
    side, top, bottom = F.floor(F.col("w") * 0.22), F.floor(F.col("h") * 0.28), F.floor(F.col("h") * 0.38)
    put = lambda own, share, of: F.when(some, own).otherwise(F.floor(F.col(of) * share)).cast("int")
    return rows.select(
        "doc_id",
        put(F.greatest(F.lit(0), F.col("x") - side), 0.055, "page_w").alias("x1"),
        put(F.greatest(F.lit(0), F.col("y") - top), 0.17, "page_h").alias("y1"),
        put(F.least(F.col("page_w"), F.col("x") + F.col("w") + side), 0.295, "page_w").alias("x2"),
        put(F.least(F.col("page_h"), F.col("y") + F.col("h") + bottom), 0.60, "page_h").alias("y2"),
        F.when(some, F.round(F.least(F.lit(0.99), 0.85 + 0.14 * F.col("score")), 2)).otherwise(F.lit(0.82)).alias("confidence"),
    )


def quality(metrics: DataFrame) -> DataFrame:
    """Flags and feedback from measurements (doc_id, width, height, variance, glare_ratio,
    brightness, page_found). Warnings start earlier than rejections."""
    c = F.col
    sharp, glare = c("variance"), c("glare_ratio")
    flags = F.array(
        F.when((c("width") < DEFAULTS.min_width) | (c("height") < DEFAULTS.min_height), F.lit("Resolution is low.")),
        F.when(sharp < DEFAULTS.blur_warning, F.lit("Image is too blurry.")),
        F.when(glare > DEFAULTS.glare_warning, F.lit("Glare was detected.")),
        F.when(c("brightness") < 40, F.lit("Image is too dark.")).when(c("brightness") > 230, F.lit("Image is too bright.")),
        F.when(~c("page_found"), F.lit("The page's edges were not found.")),
    )
    bad = (sharp < 35) | (c("width") < 400) | (c("height") < 300) | (glare > 0.25)
    return metrics.select(
        "doc_id",
        ((c("width") >= DEFAULTS.min_width) & (c("height") >= DEFAULTS.min_height)).alias("resolution_ok"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sharp / 250.0)), 3).alias("blur_score"),
        (glare > DEFAULTS.glare_warning).alias("glare"),
        F.round("brightness", 1).alias("brightness"),
        (~bad).alias("acceptable"),
        F.filter(flags, lambda x: x.isNotNull()).alias("feedback"),
    )


def measured(images: DataFrame) -> DataFrame:
    """doc_id, width, height, variance, glare_ratio and brightness of images (doc_id and Spark's
    image struct ``image``: height, width, nChannels, data in BGR order)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, w, h, n, data in part.itertuples(index=False):
                pixels = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n).astype(np.float64)
                rows.append((doc, w, h, *_measure(pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2))))
            yield pd.DataFrame(rows, columns=["doc_id", "width", "height", "variance", "glare_ratio", "brightness"])

    src = images.select("doc_id", "image.width", "image.height", "image.nChannels", "image.data")
    return src.mapInPandas(run, "doc_id long, width int, height int, variance double, glare_ratio double, brightness double")


def _measure(bgr: np.ndarray) -> tuple[float, float, float]:
    gray = np.rint(bgr @ np.array([0.114, 0.587, 0.299]))
    edged = np.pad(gray, 1, mode="reflect")
    laplacian = edged[:-2, 1:-1] + edged[2:, 1:-1] + edged[1:-1, :-2] + edged[1:-1, 2:] - 4 * gray
    value, low = bgr.max(axis=2), bgr.min(axis=2)
    saturation = np.where(value > 0, (value - low) / np.maximum(value, 1) * 255, 0)
    return float(laplacian.var()), float(((value > 250) & (saturation < 25)).mean()), float(gray.mean())
