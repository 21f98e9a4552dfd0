from random import Random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidoc.operators import shapes
from evidoc.plans import pixel_queries
from tests.test_pixels import frame


def test_lines_counted_in_an_image_are_those_of_counted_points(spark):
    r, images = Random(3), {}
    for k in range(6):
        y, x = np.indices((90, 160))
        images[k] = np.where((y * 40 - x * r.randrange(-6, 7)) % 600 < 160, 30, 220)
    points = [(k, int(x), int(y)) for k, a in images.items() for x, y in zip(*shapes.edges(a.astype(np.uint8)), strict=True)]
    cells = shapes.votes(spark.createDataFrame(points, "doc_id long, x int, y int")).filter("votes >= 100")
    best = cells.withColumn("best", F.max("votes").over(Window.partitionBy("doc_id"))).filter("votes >= 0.75 * best")
    want = sorted(map(tuple, best.select("doc_id", "angle", "votes").collect()))
    assert want and sorted(map(tuple, shapes.segments(frame(spark, images)).collect())) == want


def test_lines_move_no_points(spark, sf):
    plan = pixel_queries.page_skew(spark, sf)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_images_are_drawn_on_all_cores(spark, sf):
    for query in (pixel_queries.page_skew, pixel_queries.zone_boxes, pixel_queries.row_profiles, pixel_queries.glyph_boxes):
        plan = query(spark, sf)._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan and "unhex" not in plan.lower(), query
