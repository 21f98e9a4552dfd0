"""The reviewer's side: what to look at, how it is shown, edits and confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of a reviewer's form that are named otherwise in the record.
EDIT_KEYS = {"date_of_issue": "issue_date", "date_of_expiry": "expiry_date"}


def needs_review(review: Column, value: Column) -> Column:
    return F.coalesce(review, F.lit(False)) | (F.coalesce(value, F.lit("")) == "")


def badge(status: Column) -> Column:
    return F.when(status == "VERIFIED", F.lit("ok")).when(status == "VERIFIED WITH WARNING", F.lit("warning")).when(status == "NEEDS REVIEW", F.lit("review")).otherwise("n/a")


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, F.lit("high")).when(confidence >= 0.65, F.lit("medium")).otherwise("low")


def check_label(check: Column) -> Column:
    return F.when(check, F.lit("PASS")).when(~check, F.lit("FAIL")).otherwise("N/A")


def quality_state(acceptable: Column, feedback: Column) -> Column:
    """severe: not acceptable; advisory: acceptable with feedback; pass: neither."""
    return F.when(~acceptable, F.lit("severe")).when(F.size(feedback) > 0, F.lit("advisory")).otherwise("pass")


def queue(evidence: DataFrame) -> DataFrame:
    """doc_id with the fields that need a look, in the order of the record."""
    rows = evidence.filter(needs_review(F.col("review"), F.col("value")))
    fields = F.array_sort(F.collect_list(F.struct("k", "field")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), fields.alias("f")).select("doc_id", "n", F.transform("f", lambda x: x["field"]).alias("fields"))


def overlay(record: DataFrame, edits: DataFrame) -> DataFrame:
    """``record`` (doc_id, key, value) with each key's last edit (doc_id, key, value, ord) put over
    it; edits of keys that the record lacks are added."""
    names = F.create_map(*[F.lit(x) for kv in EDIT_KEYS.items() for x in kv])
    last = edits.withColumn("key", F.coalesce(F.try_element_at(names, F.col("key")), F.col("key")))
    last = last.groupBy("doc_id", "key").agg(F.max_by(F.struct(F.col("value").alias("v")), "ord").alias("edit"))
    both = record.join(last, ["doc_id", "key"], "full")
    return both.select("doc_id", "key", F.when(F.col("edit").isNotNull(), F.col("edit.v")).otherwise(F.col("value")).alias("value"), F.col("edit").isNotNull().alias("edited"))


def latest(confirmations: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """The last confirmation of each session (session_id, confirmed_at, payload), without sessions
    that were deleted (session_id, deleted_at) at or after it."""
    w = Window.partitionBy("session_id").orderBy(F.desc("confirmed_at"), F.desc("payload"))
    rows = confirmations.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    if deletions is None:
        return rows
    gone = deletions.groupBy("session_id").agg(F.max("deleted_at").alias("__gone"))
    return rows.join(gone, "session_id", "left").filter("__gone is null or __gone < confirmed_at").drop("__gone")


def exported(records: DataFrame, key: str, file: str = "file", json: str = "json") -> DataFrame:
    """Each record as JSON with the name of its export file."""
    name = F.concat(F.lit("passport_"), F.coalesce(F.col(key), F.lit("unknown")), F.lit(".json"))
    return records.select("doc_id", name.alias(file), F.to_json(F.struct(*[c for c in records.columns])).alias(json))
