"""Outlines and straight edges: corners and area of a page's outline, lines by voting.

``contours`` and ``segments`` give what ``imaging.page_contour`` and ``imaging.skew`` decide on.

Defined results: an outline of fewer than three points, or with a missing one, has no area and all its
points as corners; equal points are points like any other; a page without edges has no segments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import cos, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidoc.functions import raster
from evidoc.operators.imaging import ordered_quad
from evidoc.operators.pixels import per_image

# --- outlines: arrays of points (structs of x and y), closed ----------------------------------------


def _around(points: Column, term) -> Column:
    """The sum of ``term(point, next point)`` over a closed outline."""
    n = F.size(points)
    each = F.transform(points, lambda p, i: term(p, F.get(points, (i + 1) % n)))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def area(points: Column) -> Column:
    """The area inside an outline, by the sum of signed trapezoids."""
    return F.abs(_around(points, lambda p, q: (p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"]))) / 2


def perimeter(points: Column) -> Column:
    return _around(points, lambda p, q: F.sqrt(F.pow((p["x"] - q["x"]).cast("double"), 2.0) + F.pow((p["y"] - q["y"]).cast("double"), 2.0)))


def corners(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """The points that stay of a closed outline so that no other is further than ``tolerance`` from the
    line between its neighbours that stay, in order.

    The outline is cut at the point farthest from the first one and the point farthest from that; each
    part is cut on at its farthest point for as long as that is too far. The two points at which it was
    cut first go if they are on the line between what is left beside them. Of equally far points the first one.
    """
    n = len(x)
    if n < 3:
        return list(range(n))

    def farthest_from(k: int) -> int:
        return int(((x - x[k]) ** 2 + (y - y[k]) ** 2).argmax())

    def off(i: np.ndarray, a: int, b: int) -> np.ndarray:
        """Squared distances, times the squared length, of points from the line from a to b, or from
        a where the two are at one place; and that length."""
        dx, dy = int(x[b] - x[a]), int(y[b] - y[a])
        if dx == dy == 0:
            return ((x[i] - x[a]) ** 2 + (y[i] - y[a]) ** 2), 1
        return (dx * (y[i] - y[a]) - dy * (x[i] - x[a])) ** 2, dx * dx + dy * dy

    first = farthest_from(0)
    second = farthest_from(first)
    low, high = min(first, second), max(first, second)
    kept, todo = {low, high}, [(low, high), (high, low + n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner = np.arange(a + 1, b)
        far, length = off(inner % n, a % n, b % n)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance * length:
            kept.add(int(inner[k]) % n)
            todo += [(a, int(inner[k])), (int(inner[k]), b)]
    order = sorted(kept)
    if len(order) > 3:
        gone = set()
        for k in {low, high}:
            at = order.index(k)
            far, length = off(np.array([k]), order[at - 1], order[(at + 1) % len(order)])
            if far[0] <= tolerance * tolerance * length:
                gone.add(k)
        order = [k for k in order if k not in gone]
    return order


SHARE = 0.02  # of the perimeter, that an outline may be off


def simplified(outlines: DataFrame, share: float = SHARE, keep: Sequence[str] = ()) -> DataFrame:
    """Outlines (doc_id, ord, points of whole numbers, and the columns ``keep``) with perimeter, area and
    ``quad``, the corners."""
    measured = outlines.withColumns({"perimeter": perimeter(F.col("points")), "area": area(F.col("points"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, around = b.column("points"), b.column("perimeter").to_pylist()
            flat, there, bounds = points.values, points.is_valid().to_pylist(), points.offsets.to_pylist()
            x, y = (flat.field(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in "xy")
            kept, stops = [], [0]
            for k, length in enumerate(around):
                low, high = bounds[k], bounds[k + 1] if there[k] else bounds[k]
                # An outline that has no length, as one with a missing point, keeps all its points.
                own = range(high - low) if length is None else corners(x[low:high], y[low:high], share * length)
                kept += [low + i for i in own]
                stops.append(len(kept))
            places = pa.array([s if ok else None for s, ok in zip(stops, there, strict=False)] + stops[-1:], pa.int32())
            quads = pa.ListArray.from_arrays(places, flat.take(pa.array(kept, pa.int64())), type=points.type)
            yield pa.RecordBatch.from_arrays([*b.columns, quads], names=[*b.schema.names, "quad"])

    src = measured.select("doc_id", "ord", "points", "perimeter", "area", *keep)
    kind = src.schema["points"].dataType.simpleString()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields) + f", quad {kind}"
    return src.mapInArrow(run, schema)


def contours(outlines: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, ord, area, corners (how many), aspect of the quadrilateral (null for others) and page_area
    of outlines (doc_id, ord, points, page_area)."""
    rows = simplified(outlines, share, ["page_area"])
    q = ordered_quad(F.col("quad"))
    side = lambda a, b: F.sqrt(F.pow((a["x"] - b["x"]).cast("double"), 2.0) + F.pow((a["y"] - b["y"]).cast("double"), 2.0))
    four = rows.withColumn("q", F.when(F.size("quad") == 4, q))
    sized = four.withColumns({"w": side(F.col("q.tl"), F.col("q.tr")), "h": side(F.col("q.tl"), F.col("q.bl"))})
    aspect = F.when((F.col("w") > 0) & (F.col("h") > 0), F.greatest(F.col("w") / F.col("h"), F.col("h") / F.col("w")))
    return sized.select("doc_id", "ord", "area", F.size("quad").alias("corners"), aspect.alias("aspect"), "page_area")


# --- straight edges ------------------------------------------------------------------------------------

#: Half degrees within which lines are looked for, either way; scale of sines and cosines as whole numbers.
HALF_DEGREES, SCALE = 39, 65_536
#: Change in level over an edge, places of an edge on a line, and share of the page's best line.
CHANGE, VOTES, SHARE_OF_BEST = 50, 100, 0.75


def edges(pixels: np.ndarray, change: int = CHANGE) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the places where the level changes most from above to below."""
    down = raster.across(pixels.T).T
    near = np.pad(down, ((1, 1), (0, 0)))
    y, x = np.nonzero((down > 16 * change) & (down >= near[:-2]) & (down > near[2:]))
    return x, y


def turns() -> list[tuple[float, int, int]]:
    """(angle in degrees, cosine, sine) of the lines looked for."""
    return [(k / 2, round(SCALE * cos(radians(k / 2))), round(SCALE * sin(radians(k / 2)))) for k in range(-HALF_DEGREES, HALF_DEGREES + 1)]


def votes(points: DataFrame) -> DataFrame:
    """doc_id, angle, distance and votes: each edge point votes for the nearly level lines through it, one
    an angle, whose distances are whole pixels. Votes are counted where points are before they move."""
    each = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(c).alias("c"), F.lit(s).alias("s")) for a, c, s in turns()])
    cast = points.select("doc_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.explode(each).alias("t"))
    distance = F.floor((F.col("y") * F.col("t.c") - F.col("x") * F.col("t.s") + SCALE // 2) / SCALE)
    return cast.groupBy("doc_id", F.col("t.angle").alias("angle"), distance.alias("distance")).agg(F.count(F.lit(1)).alias("votes"))


def segments(images: DataFrame, least: int = VOTES, share: float = SHARE_OF_BEST) -> DataFrame:
    """doc_id, angle and votes of the lines with ``least`` votes and ``share`` of those of their page's
    best line, as ``imaging.skew`` takes them. An image's votes are counted where it is, an angle at a
    time, as ``votes`` counts them; only lines leave it."""

    def lines(pixels: np.ndarray) -> dict[str, object] | None:
        x, y = edges(pixels)
        angles, counts = [], []
        for angle, co, si in turns() if len(x) >= least else ():
            distance = (y * co - x * si + SCALE // 2) // SCALE
            cells = np.bincount(distance - distance.min())
            cells = cells[cells >= least]
            angles.append(np.full(len(cells), angle))
            counts.append(cells)
        found = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        if not len(found):
            return None
        kept = found >= found.max() * share
        return {"angle": np.concatenate(angles)[kept], "votes": found[kept]}

    return per_image(images, "angle double, votes long", lines)
