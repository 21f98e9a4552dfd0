from evidoc.plans import bridge


def test_line_items_of_one_part_at_two_places_are_two_boxes(spark, tmp_path):
    rows = [(7, 11, 3, 2, 5.0), (7, 11, 9, 2, 8.0), (7, 11, 9, 2, 8.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = bridge.scattered(spark, str(tmp_path)).select("ord", "x2", "y1").collect()
    assert sorted(map(tuple, got)) == [(90, 452, 217), (90, 455, 535)]
