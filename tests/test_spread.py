import pytest

from evidoc.plans import bridge, catalog

MADE = ("line_bands", "line_crops", "pixel_metrics", "page_contour", "zone_presence", "outline_contours")


def plan(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def test_tasks_grow_with_keys(spark, monkeypatch):
    keys = spark.range(1_000).withColumnRenamed("id", "k").coalesce(1)
    few = bridge.spread(keys, "k").rdd.getNumPartitions()
    monkeypatch.setattr(bridge, "KEYS_A_TASK", 10)
    many = bridge.spread(keys, "k")
    assert few == 4 * spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 101
    assert sorted(r["k"] for r in many.collect()) == list(range(1_000))


@pytest.mark.parametrize("name", MADE)
def test_rows_are_made_on_all_cores(spark, sf, name):
    assert "REPARTITION_BY_NUM" in plan(spark, sf, name)


def test_a_profile_is_summed_once_a_row(spark, sf):
    assert "> greatest(" not in plan(spark, sf, "line_bands")


def test_outlines_are_not_joined_to_themselves(spark, sf):
    assert "Join" not in plan(spark, sf, "outline_contours")


def test_words_do_not_go_through_the_driver_nor_carry_texts(spark, sf):
    made = plan(spark, sf, "indexed_labels")
    assert "BroadcastHashJoin" not in made and "SortMergeJoin" in made
    assert "array_distinct" in made


def test_labels_are_looked_for_on_all_cores(spark, sf):
    assert "REPARTITION_BY_NUM" in plan(spark, sf, "label_match")
