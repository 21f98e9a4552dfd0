import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidoc.functions import levels, raster
from evidoc.operators import imaging, pixels


def frame(spark, images):
    rows = [(k, int(a.shape[1]), int(a.shape[0]), bytearray(a.astype(np.uint8).tobytes())) for k, a in images.items()]
    return spark.createDataFrame(rows, pixels.PLANE).repartition(2)


def flood(mask):
    """Sorted (left, top, width, height, area, x, y) of 8-connected groups, pixel by pixel."""
    left, out = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        ys, xs = zip(*own, strict=True)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own), round(sum(xs) / len(own), 6), round(sum(ys) / len(own), 6)))
    return sorted(out)


def test_windows_equal_naive_ones():
    r = np.random.default_rng(1)
    for shape, size in (((7, 40), 13), ((3, 5), 13), ((1, 1), 5), ((30, 9), 5), ((4, 26), 25), ((2, 13), 1)):
        a = r.integers(0, 256, shape).astype(np.uint8)
        for axis in (0, 1):
            for op, best in ((np.maximum, max), (np.minimum, min)):
                rows = a if axis else a.T
                want = [[best(row[max(0, k - size // 2) : k + size // 2 + 1]) for k in range(len(row))] for row in rows.tolist()]
                assert (raster.running(a, size, axis, op) == (np.array(want) if axis else np.array(want).T)).all()


def test_components_equal_a_flood_fill():
    r = np.random.default_rng(2)
    masks = [r.random((k % 17 + 1, k % 23 + 1)) < share for k in range(40) for share in (0.2, 0.45, 0.7)]
    masks += [np.zeros((4, 4), bool), np.ones((3, 50), bool), np.indices((9, 9)).sum(axis=0) % 2 == 0]
    spiral = np.zeros((11, 11), bool)
    spiral[::2], spiral[1::4, -1], spiral[3::4, 0] = True, True, True
    for mask in [*masks, spiral]:
        got = raster.components(mask)
        rows = zip(*(got[n].tolist() for n in ("left", "top", "width", "height", "area")), got["x"].round(6).tolist(), got["y"].round(6).tolist(), strict=True)
        assert sorted(rows) == flood(mask)


def naive_otsu(values):
    best, at = 0, 0
    for t in range(256):
        low, high = values[values <= t], values[values > t]
        if len(low) and len(high):
            apart = (len(values) * int(low.sum()) - len(low) * int(values.sum())) ** 2 / (len(low) * len(high))
            if apart > best:
                best, at = apart, t
    return at


def test_thresholds_of_many_two_one_and_equally_good_tones(spark):
    r = np.random.default_rng(3)
    images = {k: r.integers(0, k * 40 + 2, (6, 9)) for k in range(6)}
    images |= {10: np.full((4, 4), 77), 11: np.array([[5, 5, 9, 9]]), 12: np.array([[10, 20, 30, 40]]), 13: np.array([[0, 255]]), 14: np.array([[255]])}
    got = {x["doc_id"]: x for x in pixels.thresholds(frame(spark, images)).collect()}
    for k, a in images.items():
        low, high = int(a.min()), int(a.max())
        spread = (a - low) * 255 // (high - low) if high > low else a
        assert (got[k]["low"], got[k]["high"], got[k]["threshold"], got[k]["spread_threshold"]) == (low, high, naive_otsu(a.ravel()), naive_otsu(spread.ravel()))
    none = spark.createDataFrame([([0] * 256,)], "hist array<long>")
    assert none.select(levels.otsu(F.col("hist")).alias("t"), levels.lowest(F.col("hist")).alias("low")).first() == (0, None)


def test_long_bells_are_normalised_and_mirrored(spark):
    r = random.Random(4)
    for h in (1, 2, 40, 95, 160, 290):
        profile = [r.random() * 100 for _ in range(h)]
        got = spark.createDataFrame([(profile,)], "p array<double>").select(levels.smoothed(F.col("p")).alias("s")).first()["s"]
        k = max(3, h // 30) | 1
        short = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [2, 7, 14, 18, 14, 7, 2]}
        w = np.array(short.get(k) or np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * (0.3 * ((k - 1) / 2 - 1) + 0.8) ** 2)), dtype=float)
        want = np.convolve(np.pad(profile, k // 2, mode="reflect") if h > 1 else profile * k, w / w.sum(), mode="valid")
        assert np.allclose(got, want)


def written(width, height, baseline_rows, pitch, seed, ragged=False):
    """A light strip with rows of dark glyphs, at a constant pitch or a ragged one with gaps."""
    r = random.Random(seed)
    a = np.full((height, width), 220, dtype=np.uint8)
    for y in baseline_rows:
        x = 12
        while x < width - 14:
            w = r.randrange(3, 9) if ragged else 7
            for _ in range(3):
                a[y + r.randrange(0, 4) : y + 14, x + r.randrange(0, 2) : x + r.randrange(2, w + 1)] = 40
            a[y : y + 14, x : x + 2] = 40
            x += (w + r.choice((3, 4, 5, 30, 60))) if ragged else pitch
    return a


def test_glyphs_of_a_zone_score_above_a_heading(spark):
    images = {1: written(640, 100, (20, 60), 14, 5), 2: written(640, 100, (20, 60), 14, 6, ragged=True), 3: np.full((100, 640), 200), 4: written(90, 100, (20,), 14, 7), 5: written(640, 15, (0,), 14, 8)}
    glyphs = pixels.glyphs(frame(spark, images)).cache()
    assert {r["doc_id"] for r in glyphs.select("doc_id").distinct().collect()} == {1, 2}  # small and plain images have none
    for k in (1, 2):
        spots = raster.dark_spots(images[k], 13, 5)
        want = flood(spots > naive_otsu(spots.ravel().astype(np.int64)))
        rows = glyphs.filter(f"doc_id = {k}").select("left", "top", "width", "height", "area", F.round("x", 6), F.round("y", 6)).collect()
        assert sorted(map(tuple, rows)) == want
    presence = {r["doc_id"]: r["presence"] for r in imaging.zone_presence(glyphs).collect()}
    assert presence[1] > 0.8 and presence[1] > presence[2] + 0.2


def test_zone_is_found_on_a_page(spark):
    page = np.full((600, 900), 215, dtype=np.uint8)
    page[470:570] = written(900, 100, (20, 48), 14, 5)
    page[100:150, 60:300] = 90
    blank = np.full((600, 900), 215)
    boxes = pixels.zone_boxes_of_all(frame(spark, {1: page, 2: blank}))
    zone = {r["doc_id"]: r for r in imaging.zone_contour(boxes).collect()}
    assert zone[1]["found"] and zone[1]["y1"] < 490 and zone[1]["y2"] > 530 and zone[1]["x1"] < 20 and zone[1]["x2"] > 860 and zone[1]["y1"] > 440
    assert not zone[2]["found"] and (zone[2]["y1"], zone[2]["y2"]) == (450, 600)


def test_profiles_give_line_crops(spark):
    noise = np.random.default_rng(9).integers(150, 250, (80, 300))
    one = np.full((80, 300), 220)
    one[20:60, 10:290:2] = 30
    images = {1: written(640, 100, (20, 60), 14, 5), 2: noise, 3: one, 4: written(640, 140, (10, 60, 110), 14, 5), 5: np.full((12, 300), 9)}
    crops = {r["doc_id"]: [(b["a"], b["b"]) for b in r["crops"]] for r in imaging.line_crops(pixels.row_profiles(frame(spark, images))).collect()}
    (a, b), (c, d) = crops[1]
    assert a <= 20 and 34 <= b <= 45 and 50 <= c <= 60 and 74 <= d <= 80
    assert len(crops[3]) == 2 and crops[3][0][0] == 0 and crops[3][1][1] == 80  # one band is cut in two
    assert crops[4] == [(0, 140)] and crops[5] == [(0, 12)]  # three bands, and a strip that is too small


def test_planes_of_spark_images(spark):
    a = np.random.default_rng(1).integers(0, 256, (3, 4, 3)).astype(np.uint8)
    images = spark.createDataFrame([(1, (3, 4, 3, bytearray(a.tobytes()))), (2, (1, 2, 1, bytearray(b"\x07\x09")))], "doc_id long, image struct<height int, width int, nChannels int, data binary>")
    got = {r["doc_id"]: r for r in pixels.grayed(images).collect()}
    want = np.rint(a @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
    assert bytes(got[1]["gray"]) == want.tobytes() and bytes(got[2]["gray"]) == b"\x07\x09" and (got[1]["width"], got[1]["height"]) == (4, 3)


def test_rows_without_pixels_are_left_out(spark):
    bad = spark.createDataFrame([(1, 4, 4, None), (2, 4, 4, bytearray(b"abc")), (3, None, 4, bytearray(b"abcd")), (4, 0, 0, bytearray(b""))], pixels.PLANE)
    for made in (pixels.glyphs(bad), pixels.zone_boxes(bad), pixels.row_profiles(bad), pixels.thresholds(bad)):
        assert made.count() == 0
