import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidoc.llm import decontam, langid, packing, simhash, toxicity
from evidoc.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.llm.conftest import prose
from tests.llm.test_decontam import words
from tests.llm.test_simhash import near_roots


def test_pipeline_equals_its_parts_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    chain = toxicity.learn(docs, labels)
    rows = {k: r for k, r in rows.items() if chain.predict([(r["text"] or "").encode() or None])[0, -1] < chain.threshold}
    left = spark.createDataFrame(list(rows.values()), docs.schema)
    parser = langid.learn(left)
    rows = {k: r for k, r in rows.items() if parser.predict([r["text"]])[2][0] >= langid.MIN_PHRASE}
    roots = near_roots(sorted((k, r["text"]) for k, r in rows.items()))
    rows = {k: r for k, r in rows.items() if roots[k] == k}
    windows = {tuple(w[i : i + min(10, len(w))]) for w in (words(t) for _, t in items) if w for i in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[i : i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))
    rows = {k: r for k, r in rows.items() if not hit(words(r["text"]))}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    encoder = packing.Encoder(tokenizer_path())
    for k, r in rows.items():
        assert sum(x["length"] for x in got if x["doc_id"] == k) == len(encoder.encode(r["text"])) // 4 + 1


def test_odd_rows_and_empty_tables(spark, docs, empty, tmp_path):
    """Null ids and texts, repeated rows, extra columns with clashing names, and nothing at all."""
    more = docs.filter("doc_id = 6").limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(prose(9, 50))})
    own = docs.union(more).union(more).withColumn("lang", F.when(F.col("text").rlike("[A-Za-z]{3}"), F.lit("xx")))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    for name, d in (("odd", own), ("empty", empty)):
        for table, frame in (("documents", d), ("labels", labels.limit(0) if name == "empty" else labels), ("benchmark", bench)):
            frame.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [r["doc_id"] for r in got if r["piece"] == 0]
    assert len(ids) - ids.count(None) == len(set(ids)) - 1 and ids.count(None) == 2 and {6, 10, 19} <= set(ids)
    assert not {0, 1, 2, 4, 7, 18} & set(ids)  # no text, contaminated, a copy, no letter
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = QUERIES[name](spark, folder)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {cols} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_decontam_and_simhash_stages_see_only_what_is_left(spark, docs):
    first = simhash.deduplicate(docs)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.clean(first, bench).count() < first.count()
