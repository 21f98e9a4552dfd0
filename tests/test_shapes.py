import random
from math import cos, hypot, pi, radians, sin, tan

import numpy as np
import pytest

from evidoc.operators import imaging, shapes
from tests.test_pixels import frame

POINTS = "doc_id long, ord int, points array<struct<x:int,y:int>>, page_area double"


def naive_corners(points, tolerance):
    """The same choice, recursively and point by point."""

    def off(p, a, b):
        if a == b:
            return hypot(p[0] - a[0], p[1] - a[1])
        return abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / hypot(b[0] - a[0], b[1] - a[1])

    def cut(a, b):
        inner = range(a + 1, b)
        far = [off(points[i % n], points[a % n], points[b % n]) for i in inner]
        if not far or max(far) <= tolerance:
            return []
        k = inner[far.index(max(far))]
        return [*cut(a, k), k % n, *cut(k, b)]

    n = len(points)
    far = lambda o: max(range(n), key=lambda i: ((points[i][0] - points[o][0]) ** 2 + (points[i][1] - points[o][1]) ** 2, -i))
    first = far(0)
    a, b = sorted((first, far(first)))
    kept = sorted({a, b, *cut(a, b), *cut(b, a + n)})
    if len(kept) > 3:
        drop = {k for k in (a, b) if off(points[k], points[kept[kept.index(k) - 1]], points[kept[(kept.index(k) + 1) % len(kept)]]) <= tolerance}
        kept = [k for k in kept if k not in drop]
    return kept


def test_corners_equal_a_naive_version_on_random_polygons():
    r = random.Random(1)
    for _ in range(600):
        n = r.randrange(3, 40)
        points = [(r.randrange(0, 60), r.randrange(0, 60)) for _ in range(n)] if r.random() < 0.5 else [(round(50 * cos(2 * pi * k / n) + r.random() * 5), round(30 * sin(2 * pi * k / n))) for k in range(n)]
        tolerance = r.choice((0.37, 2.3, 7.1))
        x, y = (np.array(v, dtype=np.int64) for v in zip(*points, strict=True))
        assert shapes.corners(x, y, tolerance) == naive_corners(points, tolerance)


def rounded_page(corners, per_side, r):
    out = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        out += [(round(ax + (bx - ax) * k / per_side) + r.randrange(-1, 2), round(ay + (by - ay) * k / per_side) + r.randrange(-1, 2)) for k in range(per_side)]
    return out


def test_outlines_lead_to_the_page(spark):
    r = random.Random(2)
    page = [(50, 40), (950, 60), (930, 640), (60, 620)]
    rows = [
        (1, 0, rounded_page(page, 25, r), 700_000.0),
        (1, 1, rounded_page([(0, 0), (999, 0), (999, 699), (0, 699)][:3], 20, r), 700_000.0),  # a triangle
        (2, 0, rounded_page([(400, 300), (500, 300), (500, 370), (400, 370)], 9, r), 700_000.0),  # too small
        (3, 0, [(1, 1), (5, 1)], 9.0), (3, 1, [], 9.0), (3, 2, None, 9.0), (3, 3, [(2, 2)] * 5, 9.0), (3, 4, [(1, 1), None, (4, 5)], 9.0),
    ]
    outlines = spark.createDataFrame(rows, POINTS)
    got = {(x["doc_id"], x["ord"]): x for x in shapes.contours(outlines).collect()}
    assert got[1, 0]["corners"] == 4 and abs(got[1, 0]["area"] - 512_000) < 6_000 and 1.4 < got[1, 0]["aspect"] < 1.6
    assert got[1, 1]["corners"] == 3 and got[1, 1]["aspect"] is None
    assert got[3, 0]["area"] == 0 and got[3, 0]["corners"] == 2 and got[3, 3]["area"] == 0 and len(got) == 8
    assert [(x["doc_id"], x["ord"]) for x in imaging.page_contour(shapes.contours(outlines)).collect()] == [(1, 0)]


@pytest.fixture(scope="module")
def slanted():
    out = {}
    for k, angle in enumerate((-12.3, -3.0, 0.0, 2.6, 7.9, 15.4)):
        y, x = np.indices((400, 600))
        level = y * cos(radians(angle)) - x * sin(radians(angle))
        out[k] = angle, np.where(level % 40 < 12, 40, 215)
    return out


def test_a_known_turn_is_found_within_half_a_degree(spark, slanted):
    r = np.random.default_rng(5)
    images = {k: np.clip(a + r.integers(-8, 9, a.shape), 0, 255) for k, (_, a) in slanted.items()}
    images[50] = np.full((200, 300), 128)
    got = {x["doc_id"]: x for x in imaging.skew(shapes.segments(frame(spark, images))).collect()}
    for k, (angle, _) in slanted.items():
        assert got[k]["segments"] >= 5 and abs(got[k]["angle"] - angle) <= 0.5
    assert got[2]["angle"] == 0 and 50 not in got


def test_votes_lie_on_the_line(spark):
    points = [(1, x, round(30 + x * tan(radians(5)))) for x in range(0, 200)]
    best = shapes.votes(spark.createDataFrame(points, "doc_id long, x int, y int")).orderBy("votes", ascending=False).first()
    assert abs(best["angle"] - 5) <= 0.5 and abs(best["distance"] - 30 * cos(radians(5))) <= 1 and best["votes"] > 150
