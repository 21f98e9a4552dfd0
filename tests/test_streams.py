import pytest
from pyspark.sql import functions as F

from evidoc.sources import records
from evidoc.streaming.live import NO_DATA, live


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of records that come in four files, one a micro-batch."""
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 37).alias("session_id"), F.timestamp_seconds(F.col("id")).alias("confirmed_at"), F.col("id").cast("string").alias("payload"))
    for k in range(4):
        rows.filter(f"cast(payload AS INT) % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_restarted_stream_repeats_and_loses_nothing(spark, arriving, tmp_path, monkeypatch):
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")
    plain, tries = records.write_batch, []

    def failing(rows, batch, path):
        plain(rows, batch, path)
        tries.append(batch)
        if tries.count(2) == 1 and batch == 2:
            raise RuntimeError("lost after the batch was written, before it was noted")

    monkeypatch.setattr(records, "write_batch", failing)
    with pytest.raises(Exception, match="lost after"):
        records.save_stream(arriving, store, checkpoint).awaitTermination()
    assert tries == [0, 1, 2]
    for _ in range(2):
        records.save_stream(arriving, store, checkpoint, name="again").awaitTermination()
    assert tries == [0, 1, 2, 2, 3]
    rows = [r["payload"] for r in spark.read.parquet(store).collect()]
    assert sorted(map(int, rows)) == list(range(400))
    last = {r["session_id"]: int(r["payload"]) for r in records.stored(spark, store).collect()}
    assert last == {f"s{k}": max(range(k, 400, 37)) for k in range(37)}
    assert [int(r["payload"]) for r in records.one(spark, store, "s5").collect()] == [last["s5"]]


@pytest.mark.parametrize(("ttl", "created"), [(3600, 37), (0.001, 37 * 4)])
def test_sessions_lapse_by_the_clock(spark, arriving, tmp_path, ttl, created):
    spark.conf.set(NO_DATA, "false")
    try:
        out = live(arriving.select("session_id", F.col("confirmed_at").alias("ts")), ttl)
        out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}"))).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(NO_DATA)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 37 * 4 and sum(r["state"] == "created" for r in rows) == created
    most = {s: max(r["n_events"] for r in rows if r["session_id"] == s) for s in {r["session_id"] for r in rows}}
    own = {f"s{k}": len(range(k, 400, 37)) for k in range(37)}
    assert most == own if created == 37 else all(most[s] < own[s] for s in own)
