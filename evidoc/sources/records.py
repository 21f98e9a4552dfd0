"""A store of final records, as Parquet: appended by session, read back by session.

Streams write each micro-batch to a folder that its number names, in place of what an earlier try of the same
batch left there, so a batch that is run again after a failure is in the store once. Batches of a
stream and of ``save`` lie side by side: a store is either appended to or streamed to, and read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidoc.operators.review import latest

#: Folders that sessions are dealt to, so that looking one up reads a small part of the store.
BUCKETS = 64


def bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(BUCKETS)).cast("int")


def save(records: DataFrame, path: str) -> None:
    """Append records (session_id, confirmed_at, payload) to the store."""
    dealt = records.withColumn("bucket", bucket(F.col("session_id")))
    dealt.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(path)


def write_batch(records: DataFrame, batch: int, path: str) -> None:
    """Put a stream's micro-batch (session_id, confirmed_at, payload) into the store, in place of an
    earlier try of it."""
    dealt = records.select("session_id", "confirmed_at", "payload", bucket(F.col("session_id")).alias("bucket"))
    # A batch's files are as few as its buckets; whole batches are replaced, never single files.
    dealt.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch={batch}")


def save_stream(records: DataFrame, path: str, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    """Write a stream of records to the store. After a stop, the same ``checkpoint`` goes on behind the
    last batch that was finished, and an unfinished one is written anew under its number."""
    writer = records.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path))
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (writer.queryName(name) if name else writer).start()


def stored(spark: SparkSession, path: str, deletions: DataFrame | None = None) -> DataFrame:
    """The last record of each session that was not deleted since."""
    return latest(spark.read.parquet(path).select("session_id", "confirmed_at", "payload"), deletions)


def one(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The last record of one session; only its bucket's folder is read."""
    rows = spark.read.parquet(path).filter(F.col("bucket") == bucket(F.lit(session_id)))
    return latest(rows.filter(F.col("session_id") == session_id).select("session_id", "confirmed_at", "payload"))
