"""Queries that run streams to their end over tables dealt into files, and stop and start them meanwhile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidoc.plans.bridge import table
from evidoc.sources import records
from evidoc.storage import shared_folder
from evidoc.streaming.live import NO_DATA, live

FILES = 6


def arriving(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """A table as a stream: dealt into files, of which each micro-batch takes two."""
    rows.repartition(FILES).write.parquet(f"{folder}/arriving")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arriving")


def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' records, streamed to the store in micro-batches by a query that is started twice."""
    folder = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("ts").alias("confirmed_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("payload"))
    stream = arriving(spark, rows, folder)
    for _ in range(2):  # the second run finds nothing new
        records.save_stream(stream, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    counts = spark.read.parquet(f"{folder}/store").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"))
    last = records.stored(spark, f"{folder}/store")
    return last.join(counts, "session_id").select("session_id", "n_rows", "payload")


STREAMED_RECORDS = """
SELECT 'u' || user_id AS session_id, count(*) AS n_rows, lpad(arg_max(event_id, (ts, event_id))::VARCHAR, 12, '0') AS payload FROM events GROUP BY user_id"""


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as live sessions, none of which lapses meanwhile: the last state of each."""
    folder = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), "ts")
    states = live(arriving(spark, rows, folder), ttl_seconds=86_400)
    def keep(batch: DataFrame, number: int) -> None:
        batch.select("session_id", "n_events", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/states/number={number}")

    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)
    return spark.read.parquet(f"{folder}/states").groupBy("session_id").agg(F.max_by("n_events", "batch").alias("n_events"))


LIVE_SESSIONS = "SELECT 'u' || user_id AS session_id, count(*) AS n_events FROM events GROUP BY user_id"

QUERIES = {"streamed_records": (streamed_records, STREAMED_RECORDS), "live_sessions": (live_sessions, LIVE_SESSIONS)}
