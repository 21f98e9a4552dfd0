"""A corpus-cleaning pipeline over ``documents``.

Stages, in order: toxic documents go, documents without a language go, one document of each
near-duplicate group stays, documents with a benchmark passage go, and what is left is packed. Each
stage is written as Parquet and reread as the next one's documents; all but the last return the
columns of documents. A stage's table is removed when the next one is written.

Defined results: documents without a text, or without a letter in it, go with the language stage;
rows of the same id and text are one document from the near-duplicate stage on; rows without an id are
documents of their own, one for each group of near copies, if no row of the group has an id; other
columns of any name are carried along up to packing; without labels nothing is toxic; without
languages no document is kept; without benchmark items none is contaminated; an empty table gives no
pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidoc.llm import decontam, langid, packing, simhash, toxicity
from evidoc.llm.common import shared_folder, store, table
from evidoc.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those whose phrases are of two characters or more
    on average in some language's labelled text."""
    return langid.keep_known(docs, langid.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five-word shingles, a
    similarity of 0.8 or more)."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_language),
    ("near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Documents that go to a Python task at once while the stages run, which bounds what tasks hold.
ARROW_ROWS, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000

#: Trained models and a tokenizer are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), ROWS_AT_ONCE) if int(rows) > 0 else ROWS_AT_ONCE))
    try:
        return _run(spark, sf_dir)
    finally:
        spark.conf.set(ARROW_ROWS, rows)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            system, path = store(before)
            system.delete_dir(path)
        before = f"{folder}/{name}"
    return docs
