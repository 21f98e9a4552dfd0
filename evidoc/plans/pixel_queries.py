"""Queries over pixels: images drawn from suppliers by fixed rules, measured, and the same by SQL.

The SQL works on a table of pixels: windows are window functions, thresholds are all tried, and
components are reached run by run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.operators import imaging, pixels, shapes
from evidoc.plans.bridge import spread, table

c = F.col

#: Images that are drawn for one batch.
DRAWN = 64


def between(v: np.ndarray, low: int, high: int) -> np.ndarray:
    return (v >= low) & (v <= high)


def drawn(spark: SparkSession, sf_dir: str, width: int, height: int, rule: Callable[[int, np.ndarray, np.ndarray], np.ndarray | int], top: int = 0) -> DataFrame:
    """An image (doc_id, width, height, gray) a supplier: ``rule(key, x, y)`` gives the pixels' levels."""
    x, y = np.arange(width, dtype=np.int64), np.arange(top, top + height, dtype=np.int64)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            for own in (keys[k : k + DRAWN] for k in range(0, len(keys), DRAWN)):
                gray = [np.broadcast_to(rule(s, x, y), (height, width)).astype(np.uint8).tobytes() for s in own]
                sizes = (pa.array([n] * len(own), pa.int32()) for n in (width, height))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *sizes, pa.array(gray, pa.binary())], names=["doc_id", "width", "height", "gray"])

    keys = table(spark, sf_dir, "supplier").select(c("s_suppkey").cast("long").alias("doc_id"))
    return spread(keys, "doc_id").mapInArrow(run, pixels.PLANE)


def sql_pixels(width: int, height: int, rule: str) -> str:
    return f"px AS MATERIALIZED (SELECT s_suppkey AS d, x, y, ({rule})::INTEGER AS v FROM supplier, range({width}) a(x), range({height}) b(y))"


def sql_window(source: str, size: int, axis: str, op: str) -> str:
    other, half = "xy"[axis == "x"], size // 2
    return f"SELECT d, x, y, {op}(v) OVER (PARTITION BY d, {other} ORDER BY {axis} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS v FROM {source}"


def sql_closing(name: str, source: str, width: int, height: int) -> str:
    """``name``: the closing of ``source``."""
    steps, out, last = (("max", "x", width), ("max", "y", height), ("min", "x", width), ("min", "y", height)), [], source
    for k, (op, axis, size) in enumerate(steps):
        step = name if k == 3 else f"{name}{k}"
        out.append(f"{step} AS MATERIALIZED ({sql_window(last, size, axis, op)})")
        last = step
    return ", ".join(out)


def sql_beside(source: str, axis: str, weights: tuple[int, int, int]) -> str:
    """Weighted sum of a pixel and its neighbours along an axis, mirrored at edges."""
    other = "xy"[axis == "x"]
    w = f"(PARTITION BY d, {other} ORDER BY {axis})"
    back, ahead = f"lag(v) OVER {w}", f"lead(v) OVER {w}"
    return f"SELECT d, x, y, {weights[0]} * coalesce({back}, {ahead}) + {weights[1]} * v + {weights[2]} * coalesce({ahead}, {back}) AS v FROM {source}"


def sql_blurred(name: str, source: str) -> str:
    return f"{name}0 AS ({sql_beside(source, 'x', (1, 2, 1))}), {name}1 AS ({sql_beside(f'{name}0', 'y', (1, 2, 1))}), {name} AS MATERIALIZED (SELECT d, x, y, (v + 8) // 16 AS v FROM {name}1)"


def sql_otsu(name: str, source: str) -> str:
    """``name`` (d, t): the threshold of each image, by trying all 256."""
    return f"""{name}h AS (SELECT d, v, count(*) AS n FROM {source} GROUP BY d, v),
{name}a AS (SELECT d, sum(n)::BIGINT AS n, sum(n * v)::BIGINT AS s FROM {name}h GROUP BY d),
{name}t AS (SELECT h.d, t, any_value(a.n) AS n, any_value(a.s) AS s, sum(h.n)::BIGINT AS n0, sum(h.n * v)::BIGINT AS s0 FROM {name}h h JOIN {name}a a USING (d), range(256) r(t) WHERE v <= t GROUP BY h.d, t),
{name}v AS (SELECT d, t, CASE WHEN n0 < n THEN (n * s0 - n0 * s)::DOUBLE * (n * s0 - n0 * s)::DOUBLE / (n0 * (n - n0)) ELSE 0 END AS b FROM {name}t),
{name} AS (SELECT d, CASE WHEN max(b) > 0 THEN arg_max(t, (b, -t)) ELSE 0 END AS t FROM {name}v GROUP BY d)"""


def sql_components(name: str, mask: str) -> str:
    """``name``: the boxes, areas and centres of the 8-connected groups of ``mask`` (d, x, y)."""
    return f"""{name}i AS (SELECT d, x, y, x - row_number() OVER (PARTITION BY d, y ORDER BY x) AS g FROM {mask}),
{name}r AS MATERIALIZED (SELECT d, y, min(x) AS a, max(x) AS b, row_number() OVER (PARTITION BY d ORDER BY y, min(x)) AS k FROM {name}i GROUP BY d, y, g),
{name}e AS MATERIALIZED (SELECT p.d, p.k AS i, q.k AS j FROM {name}r p JOIN {name}r q ON p.d = q.d AND abs(p.y - q.y) = 1 AND p.a <= q.b + 1 AND q.a <= p.b + 1),
{name}c(d, i, j) AS (SELECT d, k, k FROM {name}r UNION SELECT w.d, w.i, e.j FROM {name}c w JOIN {name}e e ON w.d = e.d AND w.j = e.i),
{name}p AS (SELECT d, i AS k, min(j) AS root FROM {name}c GROUP BY d, i),
{name} AS (SELECT r.d, min(a) AS "left", min(y) AS top, max(b) - min(a) + 1 AS width, max(y) - min(y) + 1 AS height, sum(b - a + 1)::BIGINT AS area,
    sum((a + b) / 2.0 * (b - a + 1)) / sum(b - a + 1) AS x, sum(y * (b - a + 1)) / sum(b - a + 1) AS y FROM {name}r r JOIN {name}p p ON r.d = p.d AND r.k = p.k GROUP BY r.d, p.root)"""


# --- grey levels -----------------------------------------------------------------------------------


def gray_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 24 by 16 pixels, each cut into two strips: of many tones, of two, and of one."""

    def rule(s: int, x: np.ndarray, y: np.ndarray) -> np.ndarray | int:
        if s % 5 == 0:
            return s % 256
        if s % 5 == 1:
            return np.where((x + y * s) % 3 == 0, s % 200, s % 50 + 205)
        return (s * 31 + x * x * s + y * 7 * x + y * y) % (90 + s % 160) + s % 7

    strips = drawn(spark, sf_dir, 24, 8, rule).union(drawn(spark, sf_dir, 24, 8, rule, top=8))
    return pixels.thresholds(strips)


GRAY_LEVELS = f"""
WITH {sql_pixels(24, 16, "CASE s_suppkey % 5 WHEN 0 THEN s_suppkey % 256 WHEN 1 THEN CASE WHEN (x + y * s_suppkey) % 3 = 0 THEN s_suppkey % 200 ELSE s_suppkey % 50 + 205 END ELSE (s_suppkey * 31 + x * x * s_suppkey + y * 7 * x + y * y) % (90 + s_suppkey % 160) + s_suppkey % 7 END")},
m AS (SELECT d, min(v) AS low, max(v) AS high FROM px GROUP BY d),
sp AS (SELECT d, CASE WHEN high > low THEN (v - low) * 255 // (high - low) ELSE v END AS v FROM px JOIN m USING (d)),
{sql_otsu("o", "px")}, {sql_otsu("q", "sp")}
SELECT m.d AS doc_id, low, high, o.t::INTEGER AS threshold, q.t::INTEGER AS spread_threshold FROM m JOIN o USING (d) JOIN q USING (d)"""


# --- glyphs ------------------------------------------------------------------------------------------


GLYPH_W, GLYPH_H = 104, 24


def glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged dark marks on an uneven light ground, as components of dark spots."""

    def rule(s: int, x: np.ndarray, y: np.ndarray) -> np.ndarray | int:
        ink = between(y, 5, 15) & (x % 9 < 6) & ((s * 13 + x // 9 * 3 + x * y * (s % 3 + 1) + y * y) % 7 < 4)
        return np.where(ink, 20 + (s + x * 5 + y) % 40, 190 + (x * 3 + y * 5 + s) % 20)

    rows = pixels.glyphs(drawn(spark, sf_dir, GLYPH_W, GLYPH_H, rule))
    return rows.select("doc_id", "left", "top", "width", "height", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


GLYPH_BOXES = f"""
WITH RECURSIVE {sql_pixels(GLYPH_W, GLYPH_H, "CASE WHEN y BETWEEN 5 AND 15 AND x % 9 < 6 AND (s_suppkey * 13 + x // 9 * 3 + x * y * (s_suppkey % 3 + 1) + y * y) % 7 < 4 THEN 20 + (s_suppkey + x * 5 + y) % 40 ELSE 190 + (x * 3 + y * 5 + s_suppkey) % 20 END")},
{sql_closing("cl", "px", 13, 5)}, bh AS MATERIALIZED (SELECT px.d, px.x, px.y, cl.v - px.v AS v FROM px JOIN cl USING (d, x, y)),
{sql_otsu("o", "bh")}, mask AS MATERIALIZED (SELECT d, x, y FROM bh JOIN o USING (d) WHERE v > t), {sql_components("k", "mask")}
SELECT d AS doc_id, "left"::INTEGER AS "left", top::INTEGER AS top, width::INTEGER AS width, height::INTEGER AS height, area, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y FROM k"""


# --- the zone's boxes --------------------------------------------------------------------------------


ZONE_W, ZONE_H = 120, 80


def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed areas in the lower part of pages with two lines of marks, some of them interrupted."""

    def rule(s: int, x: np.ndarray, y: np.ndarray) -> np.ndarray | int:
        line = between(y, 57, 61) | between(y, 68, 72)
        ink = line & ((x * 7 + s * 5 + y * (s % 4)) % 11 < 6) & ~between(x, 40, 38 + s % 60) & (x > s % 13)
        return np.where(ink, 30 + (x * s + y) % 25, 200 + (x * 5 + y * 3 + s * 7) % 12)

    return pixels.zone_boxes(drawn(spark, sf_dir, ZONE_W, ZONE_H, rule))


# Pixels of the lower part only: rows from 52 on.
ZONE_BOXES = f"""
WITH RECURSIVE all_{sql_pixels(ZONE_W, ZONE_H, "CASE WHEN (y BETWEEN 57 AND 61 OR y BETWEEN 68 AND 72) AND (x * 7 + s_suppkey * 5 + y * (s_suppkey % 4)) % 11 < 6 AND NOT x BETWEEN 40 AND 38 + s_suppkey % 60 AND x > s_suppkey % 13 THEN 30 + (x * s_suppkey + y) % 25 ELSE 200 + (x * 5 + y * 3 + s_suppkey * 7) % 12 END")},
px AS MATERIALIZED (SELECT d, x, y - 52 AS y, v FROM all_px WHERE y >= 52),
{sql_closing("cl", "px", 13, 5)}, bh AS MATERIALIZED (SELECT px.d, px.x, px.y, cl.v - px.v AS v FROM px JOIN cl USING (d, x, y)),
g0 AS ({sql_beside("bh", "x", (-1, 0, 1))}), g1 AS (SELECT d, x, y, CASE WHEN x IN (0, {ZONE_W - 1}) THEN 0 ELSE v END AS v FROM g0),
g2 AS ({sql_beside("g1", "y", (3, 10, 3))}), g AS MATERIALIZED (SELECT d, x, y, abs(v) AS v FROM g2),
m AS (SELECT d, min(v) AS low, max(v) AS high FROM g GROUP BY d),
sp AS MATERIALIZED (SELECT d, x, y, CASE WHEN high > low THEN (v - low) * 255 // (high - low) ELSE v END AS v FROM g JOIN m USING (d)),
{sql_blurred("bl", "sp")}, {sql_closing("cz", "bl", 25, 19)},
{sql_otsu("o", "cz")}, mask AS MATERIALIZED (SELECT d, x, y FROM cz JOIN o USING (d) WHERE v > t), {sql_components("k", "mask")}
SELECT d AS doc_id, (row_number() OVER (PARTITION BY d ORDER BY area DESC, top, "left") - 1)::INTEGER AS ord, area::DOUBLE AS area, "left"::INTEGER AS x, (top + 52)::INTEGER AS y,
  width::INTEGER AS w, height::INTEGER AS h, {ZONE_W} AS page_w, {ZONE_H} AS page_h FROM k"""


# --- rows of text --------------------------------------------------------------------------------------


STRIP_W, STRIP_H = 104, 60


def row_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of strips of noise, of one band of text and of three."""

    def rule(s: int, x: np.ndarray, y: np.ndarray) -> np.ndarray | int:
        bands = ((), ((10, 40 + s % 9),), ((4, 14), (24, 34 + s % 3), (45, 55)))[s % 3]
        ink = sum((between(y, *b) for b in bands), np.zeros_like(y, dtype=bool)) & ((x * 5 + y * (s % 7) + s) % 8 < 4)
        return np.where(ink, 25 + (x + y) % 30, 180 + (x * x * 3 + y * y * 7 + x * y * s) % 40)

    rows = pixels.row_profiles(drawn(spark, sf_dir, STRIP_W, STRIP_H, rule))
    return rows.select("doc_id", F.posexplode("profile").alias("row", "v")).select("doc_id", "row", F.round("v", 6).alias("v"))


ROW_PROFILES = f"""
WITH {sql_pixels(STRIP_W, STRIP_H, "CASE WHEN CASE s_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN y BETWEEN 10 AND 40 + s_suppkey % 9 ELSE y BETWEEN 4 AND 14 OR y BETWEEN 24 AND 34 + s_suppkey % 3 OR y BETWEEN 45 AND 55 END AND (x * 5 + y * (s_suppkey % 7) + s_suppkey) % 8 < 4 THEN 25 + (x + y) % 30 ELSE 180 + (x * x * 3 + y * y * 7 + x * y * s_suppkey) % 40 END")},
{sql_blurred("bl", "px")}, {sql_otsu("o", "bl")},
r AS (SELECT d, y, sum(CASE WHEN v <= t THEN 255 ELSE 0 END)::DOUBLE AS p FROM bl JOIN o USING (d) GROUP BY d, y),
n AS (SELECT d, y, p, lag(p) OVER w AS b, lead(p) OVER w AS a FROM r WINDOW w AS (PARTITION BY d ORDER BY y))
SELECT d AS doc_id, y::INTEGER AS "row", round(0.25 * coalesce(b, a) + 0.5 * p + 0.25 * coalesce(a, b), 6)::DOUBLE AS v FROM n"""


# --- outlines and lines ----------------------------------------------------------------------------------


def outline_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of 24 points a customer: shaken quadrilaterals, with a dent for every third."""
    k = c("c_custkey")
    xs, ys = (F.lit(40) + k % 50, F.lit(900) + k % 31, F.lit(880) - k % 70, F.lit(60) + k % 41), (F.lit(30) + k % 23, F.lit(50) - k % 37, F.lit(600) + k % 19, F.lit(580) - k % 200)

    def point(i: Column) -> Column:
        edge, part = F.floor(i / 6).cast("int"), i % 6
        pick = lambda own, e: F.element_at(F.array(*own), (e % 4 + 1).cast("int"))
        on = lambda own: F.floor((pick(own, edge) * (6 - part) + pick(own, edge + 1) * part) / 6)
        dent = F.when((k % 3 == 0) & (i == 9), 150 + k % 40).otherwise(0)
        return F.struct((on(xs) + (k * 7 + i * i) % 5 - 2 - dent).cast("int").alias("x"), (on(ys) + (k * 3 + i * 5) % 5 - 2).cast("int").alias("y"))

    rows = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("doc_id"), F.lit(0).alias("ord"), F.transform(F.sequence(F.lit(0), F.lit(23)), point).alias("points"), F.lit(620_000.0).alias("page_area"))
    out = shapes.contours(rows)
    return out.select("doc_id", "corners", F.round("area", 3).alias("area"), F.round("aspect", 6).alias("aspect"))


# Points are numbered over two rounds, so that a part of the outline is a range of numbers.
OUTLINE_CONTOURS = f"""
WITH RECURSIVE q AS (
  SELECT c_custkey AS d, [40 + c_custkey % 50, 900 + c_custkey % 31, 880 - c_custkey % 70, 60 + c_custkey % 41] AS xs, [30 + c_custkey % 23, 50 - c_custkey % 37, 600 + c_custkey % 19, 580 - c_custkey % 200] AS ys FROM customer
), p AS MATERIALIZED (
  SELECT d, i, floor((xs[i // 6 + 1] * (6 - i % 6) + xs[(i // 6 + 1) % 4 + 1] * (i % 6)) / 6.0)::BIGINT + (d * 7 + i * i) % 5 - 2 - CASE WHEN d % 3 = 0 AND i = 9 THEN 150 + d % 40 ELSE 0 END AS x,
    floor((ys[i // 6 + 1] * (6 - i % 6) + ys[(i // 6 + 1) % 4 + 1] * (i % 6)) / 6.0)::BIGINT + (d * 3 + i * 5) % 5 - 2 AS y FROM q, range(24) r(i)
), pp AS MATERIALIZED (SELECT d, i, x, y FROM p UNION ALL SELECT d, i + 24, x, y FROM p),
m AS (
  SELECT a.d, abs(sum(a.x * b.y - b.x * a.y)) / 2.0 AS area, 0.02 * sum(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE)) AS off
  FROM p a JOIN pp b ON a.d = b.d AND b.i = a.i + 1 GROUP BY a.d
), f AS (
  SELECT p.d, arg_max(p.i, ((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y), -p.i)) AS k FROM p JOIN p o ON p.d = o.d AND o.i = 0 GROUP BY p.d
), g AS (
  SELECT p.d, f.k AS a, arg_max(p.i, ((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y), -p.i)) AS b FROM f JOIN p USING (d) JOIN p o ON o.d = f.d AND o.i = f.k GROUP BY p.d, f.k
), s(d, lo, hi) AS (
  SELECT d, least(a, b), greatest(a, b) FROM g UNION ALL SELECT d, greatest(a, b), least(a, b) + 24 FROM g
  UNION ALL
  SELECT t.d, CASE WHEN side = 0 THEN lo ELSE k END, CASE WHEN side = 0 THEN k ELSE hi END FROM (
    SELECT s.d, lo, hi, arg_max(n.i, (@FAR, -n.i)) AS k, max(@FAR) AS far, any_value(@LEN) AS len
    FROM s JOIN pp a ON a.d = s.d AND a.i = lo JOIN pp b ON b.d = s.d AND b.i = hi JOIN pp n ON n.d = s.d AND n.i > lo AND n.i < hi GROUP BY s.d, lo, hi
  ) t JOIN m USING (d), range(2) r(side) WHERE far > off * off * len
), c AS MATERIALIZED (SELECT DISTINCT d, lo % 24 AS i FROM s UNION SELECT DISTINCT d, hi % 24 FROM s),
o AS (SELECT d, i, coalesce(lag(i) OVER w, max(i) OVER (PARTITION BY d)) AS lo, coalesce(lead(i) OVER w, min(i) OVER (PARTITION BY d)) AS hi, count(*) OVER (PARTITION BY d) AS n FROM c WINDOW w AS (PARTITION BY d ORDER BY i)),
z AS (
  SELECT o.d, o.i FROM o JOIN g USING (d) JOIN m USING (d) JOIN p a ON a.d = o.d AND a.i = lo JOIN p b ON b.d = o.d AND b.i = hi JOIN p n ON n.d = o.d AND n.i = o.i
  WHERE (o.i = g.a OR o.i = g.b) AND o.n > 3 AND @FAR <= off * off * @LEN
), e AS (SELECT d, x, y FROM c JOIN p USING (d, i) WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.d = c.d AND z.i = c.i)),
v AS (
  SELECT d, count(*) AS n, arg_min((x, y), x + y) AS tl, arg_min((x, y), y - x) AS tr, arg_max((x, y), y - x) AS bl FROM e GROUP BY d
), w AS (SELECT d, n, sqrt(((tl[1] - tr[1]) ** 2 + (tl[2] - tr[2]) ** 2)::DOUBLE) AS w, sqrt(((tl[1] - bl[1]) ** 2 + (tl[2] - bl[2]) ** 2)::DOUBLE) AS h FROM v)
SELECT d AS doc_id, n::INTEGER AS corners, round(area, 3)::DOUBLE AS area, CASE WHEN n = 4 THEN round(greatest(w / h, h / w), 6) END::DOUBLE AS aspect FROM w JOIN m USING (d)""".replace(
    "@FAR", "(CASE WHEN a.x = b.x AND a.y = b.y THEN (n.x - a.x) * (n.x - a.x) + (n.y - a.y) * (n.y - a.y) ELSE ((b.x - a.x) * (n.y - a.y) - (b.y - a.y) * (n.x - a.x)) * ((b.x - a.x) * (n.y - a.y) - (b.y - a.y) * (n.x - a.x)) END)"
).replace("@LEN", "greatest(1, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))")


SKEW_W, SKEW_H = 160, 64


def page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of slanting bars: the lines that their edges vote for, and the turn that these make."""
    rule = lambda s, x, y: np.where((y * 40 - x * (s % 13 - 6)) % 600 < 160, 30 + s % 20, 220)
    lines = shapes.segments(drawn(spark, sf_dir, SKEW_W, SKEW_H, rule))
    return imaging.skew(lines).select("doc_id", "segments", F.round("angle", 6).alias("angle"))


PAGE_SKEW = f"""
WITH {sql_pixels(SKEW_W, SKEW_H, "CASE WHEN ((y * 40 - x * (s_suppkey % 13 - 6)) % 600 + 600) % 600 < 160 THEN 30 + s_suppkey % 20 ELSE 220 END")},
g0 AS ({sql_beside("px", "y", (-1, 0, 1))}), g1 AS (SELECT d, x, y, CASE WHEN y IN (0, {SKEW_H - 1}) THEN 0 ELSE v END AS v FROM g0),
g2 AS ({sql_beside("g1", "x", (3, 10, 3))}), g AS (SELECT d, x, y, abs(v) AS v FROM g2),
n AS (SELECT d, x, y, v, coalesce(lag(v) OVER w, 0) AS a, coalesce(lead(v) OVER w, 0) AS b FROM g WINDOW w AS (PARTITION BY d, x ORDER BY y)),
e AS MATERIALIZED (SELECT d, x, y FROM n WHERE v > 800 AND v >= a AND v > b),
t(angle, co, si) AS (VALUES {", ".join(f"({a}, {co}, {si})" for a, co, si in shapes.turns())}),
cell AS (SELECT d, angle, (y * co - x * si + 32768) >> 16 AS r, count(*) AS n FROM e, t GROUP BY ALL HAVING count(*) >= 100),
best AS (SELECT d, angle::DOUBLE AS angle FROM cell QUALIFY n >= 0.75 * max(n) OVER (PARTITION BY d))
SELECT d AS doc_id, count(*) AS segments, round(CASE WHEN count(*) >= 5 AND abs(quantile_cont(angle, 0.5)) > 0.5 THEN quantile_cont(angle, 0.5) ELSE 0 END, 6)::DOUBLE AS angle FROM best GROUP BY d"""


QUERIES = {
    "gray_levels": (gray_levels, GRAY_LEVELS),
    "glyph_boxes": (glyph_boxes, GLYPH_BOXES),
    "zone_boxes": (zone_boxes, ZONE_BOXES),
    "row_profiles": (row_profiles, ROW_PROFILES),
    "outline_contours": (outline_contours, OUTLINE_CONTOURS),
    "page_skew": (page_skew, PAGE_SKEW),
}
