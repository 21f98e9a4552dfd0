"""What a page's pixels say about glyphs, the zone, text rows and skew.

An image is a row of (doc_id, width, height, gray: one byte a pixel, row by row). Kernels turn one image
at a time into another plane and its histogram, or into rows; thresholds, choices and sums between them
are columns and aggregations. No image leaves its partition: thresholds are found in the image's own row.

Defined results: rows without pixels, or whose bytes are not width times height, are left out; images
too small for a zone (under 20 rows or 100 columns) have no glyphs, and profiles without text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidoc.functions import levels, raster

PLANE = "doc_id long, width int, height int, gray binary"
MIN_ROWS, MIN_COLUMNS = 20, 100


def whole(images: DataFrame) -> DataFrame:
    return images.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("gray") == F.col("width").cast("long") * F.col("height")))


def per_image(images: DataFrame, schema: str, kernel: Callable[..., dict[str, object] | None], *more: str) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` that ``kernel`` gives for the pixels of each image (and the
    columns ``more``): lists or arrays of as many rows as it likes, or None."""
    full = T.StructType.fromDDL(f"doc_id long, {schema}")
    kinds = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc, w, h, gray, *rest = (b.column(c)[k] for c in range(b.num_columns))
                pixels = np.frombuffer(gray.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py())
                made = kernel(pixels, *(v.as_py() for v in rest))
                if made is not None:
                    n = len(next(iter(made.values())))
                    cols = [pa.array([doc.as_py()] * n, pa.int64())] + [pa.array(made[f.name], f.type) for f in list(kinds)[1:]]
                    yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    return whole(images).select(F.col("doc_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "gray", *more).mapInArrow(run, full)


def grayed(images: DataFrame) -> DataFrame:
    """Spark's image rows (doc_id, image) as grey planes."""
    kinds = to_arrow_schema(T.StructType.fromDDL(PLANE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                doc, w, h, n, data = (b.column(c)[k].as_py() for c in range(5))
                p = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n)
                gray = p[:, :, 0] if n < 3 else np.rint(p[:, :, :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "width": w, "height": h, "gray": gray.tobytes()}], schema=kinds)

    return images.select("doc_id", "image.width", "image.height", "image.nChannels", "image.data").mapInArrow(run, PLANE)


def histograms(strips: DataFrame) -> DataFrame:
    """doc_id and ``hist``, the counts of the 256 levels, of images that may be cut into strips: each
    strip is counted where it is, and Spark adds the counts of an image's strips up by level."""

    def count(pixels: np.ndarray) -> dict[str, object]:
        n = np.bincount(pixels.ravel(), minlength=levels.LEVELS)
        return {"level": np.flatnonzero(n).astype(np.int32), "n": n[n > 0]}

    by_level = per_image(strips, "level int, n long", count).groupBy("doc_id", "level").agg(F.sum("n").alias("n"))
    own = by_level.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(levels.LEVELS - 1)), lambda v: F.coalesce(F.try_element_at("m", v), F.lit(0)))
    return own.select("doc_id", every.cast("array<long>").alias("hist"))


def thresholds(strips: DataFrame) -> DataFrame:
    """doc_id, low, high, threshold, and the threshold after low to high are spread over all levels."""
    rows = histograms(strips).select("doc_id", "hist", levels.lowest(F.col("hist")).alias("low"), levels.highest(F.col("hist")).alias("high"))
    moved = rows.select("doc_id", "low", "high", F.posexplode("hist").alias("level", "n")).filter("n > 0")
    moved = moved.groupBy("doc_id", levels.spread(F.col("level"), F.col("low"), F.col("high")).alias("level")).agg(F.sum("n").alias("n"))
    again = moved.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(levels.LEVELS - 1)), lambda v: F.coalesce(F.try_element_at("m", v), F.lit(0))).cast("array<long>")
    after = again.select("doc_id", levels.otsu(every).alias("spread_threshold"))
    return rows.select("doc_id", "low", "high", levels.otsu(F.col("hist")).alias("threshold")).join(after, "doc_id")


def marked(images: DataFrame, feature: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    """The plane that ``feature`` makes of each image (doc_id, width, height, gray), its threshold, and the
    page's size (page_w, page_h)."""

    def make(pixels: np.ndarray) -> dict[str, object] | None:
        plane = feature(pixels)
        if plane is None or not plane.size:
            return None
        plane = plane.astype(np.uint8)
        hist = np.bincount(plane.ravel(), minlength=levels.LEVELS)
        return {"width": [plane.shape[1]], "height": [plane.shape[0]], "gray": [plane.tobytes()], "hist": [hist], "page_w": [pixels.shape[1]], "page_h": [pixels.shape[0]]}

    made = per_image(images, "width int, height int, gray binary, hist array<long>, page_w int, page_h int", make)
    return made.select("doc_id", "width", "height", "gray", levels.otsu(F.col("hist")).alias("threshold"), "page_w", "page_h")


BOXES = "left int, top int, width int, height int, area long, x double, y double, page_w int, page_h int"


def _boxes(planes: DataFrame) -> DataFrame:
    def label(pixels: np.ndarray, threshold: int, page_w: int, page_h: int) -> dict[str, object]:
        found = raster.components(pixels > threshold)
        return found | {n: found[n].astype(np.int32) for n in ("left", "top", "width", "height")} | {n: np.full(len(found["area"]), v, dtype=np.int32) for n, v in (("page_w", page_w), ("page_h", page_h))}

    return per_image(planes, BOXES, label, "threshold", "page_w", "page_h")


def large(pixels: np.ndarray) -> bool:
    return pixels.shape[0] >= MIN_ROWS and pixels.shape[1] >= MIN_COLUMNS


def glyphs(images: DataFrame) -> DataFrame:
    """Connected dark spots of each image, as ``imaging.zone_presence`` takes them: centre (x, y), height,
    area and the page's size; also left, top and width."""
    return _boxes(marked(images, lambda p: raster.dark_spots(p, 13, 5) if large(p) else None))


def zone_feature(pixels: np.ndarray) -> np.ndarray | None:
    """Where the lower 35 % of a page have much print side by side: dark spots, their change across,
    spread, blurred, and closed over gaps between words and lines."""
    low = pixels[int(pixels.shape[0] * 0.65) :]
    return raster.closing(raster.blurred(raster.stretched(raster.across(raster.dark_spots(low, 13, 5)))), 25, 19) if low.size else None


def zone_boxes(images: DataFrame) -> DataFrame:
    """Printed areas of each page's lower part, as ``imaging.zone_contour`` takes them: ord (by area, then
    place), area in pixels, x, y, w, h on the page, and the page's size."""
    rows = _boxes(marked(images, zone_feature))
    top = F.floor(F.col("page_h") * 0.65).cast("int")
    each = F.struct((-F.col("area")).alias("rank"), "top", "left", "width", "height", "area", top.alias("first"))
    ranked = rows.groupBy("doc_id", "page_w", "page_h").agg(F.array_sort(F.collect_list(each)).alias("all"))
    out = ranked.select("doc_id", "page_w", "page_h", F.posexplode("all").alias("ord", "b"))
    return out.select(
        "doc_id", "ord", F.col("b.area").cast("double").alias("area"), F.col("b.left").alias("x"), (F.col("b.top") + F.col("b.first")).alias("y"),
        F.col("b.width").alias("w"), F.col("b.height").alias("h"), "page_w", "page_h",
    )


def zone_boxes_of_all(images: DataFrame) -> DataFrame:
    """``zone_boxes`` with a row of nulls for pages that have none, so that each page gets a zone."""
    pages = whole(images).select("doc_id", F.col("width").alias("page_w"), F.col("height").alias("page_h"))
    return pages.join(zone_boxes(images).drop("page_w", "page_h"), "doc_id", "left")


def row_profiles(strips: DataFrame) -> DataFrame:
    """How much print each row of a strip has (doc_id, profile), smoothed, as ``imaging.line_crops`` takes
    it. Strips too small to have lines have a profile of zeros."""

    def dark(pixels: np.ndarray, threshold: int, page_w: int, page_h: int) -> dict[str, object]:
        rows = (pixels <= threshold).sum(axis=1) * 255.0
        return {"profile": [rows if large(pixels) else np.zeros(len(rows))]}

    rows = per_image(marked(strips, raster.blurred), "profile array<double>", dark, "threshold", "page_w", "page_h")
    return rows.select("doc_id", levels.smoothed(F.col("profile")).alias("profile"))
