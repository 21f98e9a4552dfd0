import hashlib
import random
import re

from evidoc.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, ids = words(text), set(), set()
    for item, body in items:
        w = words(body)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for p in range(len(own) - m + 1):
                if own[p : p + m] == w[i : i + m]:
                    hit |= set(range(p, p + m))
                    ids.add(item)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def fixture(spark):
    r = random.Random(2)
    few = ["a", "b", "ç", "d1"]
    sentence = lambda n: " ".join(r.choice(few) for _ in range(n))
    items = [(str(k), sentence(r.choice((3, 9, 10, 11, 14, 30)))) for k in range(12)]
    items += [("50", "one two three"), ("51", ""), ("52", None), ("7", items[7][1]), ("60", "Solo")]
    texts = [None, "", "...", "Solo!", "x one TWO-three y", *(sentence(n) for n in (5, 40, 200, 300))]
    texts += [f"start {items[3][1]} middle {items[5][1].upper()} end", items[8][1].replace(" ", ", ")]
    texts += [texts[-1]]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame([(int(i), t, "x") for i, t in items], "item_id long, text string, w string")
    return docs, bench, texts, items


def test_report_equals_brute_force(spark):
    docs, bench, texts, items = fixture(spark)
    for block_words in (500_000, 60, 16):  # one block, and many; items cut within
        got = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(docs, bench, block_words=block_words).collect()}
        assert got == {k: brute(t, items) for k, t in enumerate(texts)}


def test_long_items_are_cut_with_an_overlap(spark):
    """Every window of an item that is much longer than a block is found."""
    long = " ".join(f"w{k}" for k in range(400))
    w = long.split()
    docs = spark.createDataFrame([(k, " ".join(w[k : k + 10]), "x") for k in range(391)] + [(999, " ".join(w[5:14]), "y"), (999, " ".join(w[5:14]), "y")], "doc_id long, text string, __row string")
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = [(r["doc_id"], r["n_hit"]) for r in decontam.report(docs, bench, block_words=50).collect()]
    assert sorted(got) == [(k, 10) for k in range(391)] + [(999, 0)] * 2


def test_clean_keeps_columns_and_drops_contaminated(spark):
    docs, bench, texts, items = fixture(spark)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, t in enumerate(texts) if not brute(t, items)[-1]]


def test_odd_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one two three"), (None, "all rights reserved")], "item_id long, text string")
    none = bench.filter("item_id < 0")
    assert decontam.report(empty, bench).count() == 0
    assert decontam.report(docs, none).filter("contaminated").count() == 0 and decontam.report(docs, none).count() == docs.count()
    assert decontam.report(docs, bench).filter("contaminated").count() == 2
