import math
import re
from collections import Counter

import xxhash

from evidoc.llm import quality
from tests.llm.conftest import odd_texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(words, n=quality.BUCKETS):
    """Spark's hash of several columns seeds each with the hash before it."""
    single = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    pair = [signed(xxhash.xxh64_intdigest(b.encode(), h & (1 << 64) - 1)) for h, b in zip(single, words[1:], strict=False)]
    return [h % n for h in single + pair]


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_judge_equals_brute_force(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0), (10, 1, 0), (19, 0, 0), (None, 1, 0), (20, None, 0)], "doc_id long, quality int, toxic int")
    texts = docs.select("doc_id", "text").collect()
    every, good = Counter(), Counter()
    for r in texts:
        own = buckets(WORD.findall(r["text"] or ""))
        every.update(own)
        if r["doc_id"] in (6, 10):
            good.update(own)
    n = quality.BUCKETS
    score = lambda b: math.log((good[b] + 1) / (sum(good.values()) + n)) - math.log((every[b] + 1) / (sum(every.values()) + n))
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r["text"] for r in texts}
    for r in got:
        want = base(by_id[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        own = buckets(WORD.findall(by_id[r["doc_id"]] or ""))
        mean = sum(map(score, own)) / len(own) if own else 0.0
        assert abs(r["llr"] - mean) < 1e-9
        assert r["kept"] == (not want[-1] and r["llr"] >= quality.THRESHOLD)


def test_repeated_windows_overlap_as_they_stand(spark):
    texts = ["a a a a a", "a b c a b c", "a b a b a b x", "p q r s p q r t q r s", "z " * 100, "one two"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, w string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for k, t in enumerate(texts):
        assert got[k]["n_repeat_words"] == base(t)[4]
        assert got[k]["llr"] == 0.0


def test_no_python_on_the_main_path(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality.judge(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(empty, labels).count() == 0
    assert len(odd_texts()) == 21


def test_every_trusted_document_counts(spark):
    """More trusted documents than 16,384, each with a word of its own: each moves its bucket."""
    many = 17_000
    docs = spark.range(many).selectExpr("id AS doc_id", "concat('w', id) AS text")
    docs = docs.unionByName(spark.createDataFrame([(None, "nobody"), (many, "stranger")], "doc_id long, text string"))
    labels = spark.range(many).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    n = quality.BUCKETS
    own = Counter(b for k in range(many) for b in buckets([f"w{k}"]))
    every = own + Counter(buckets(["nobody", "stranger"])[:2])
    got = quality.ratios(docs, labels)
    base = math.log(many + 2 + n) - math.log(many + n)
    assert max(abs(got[b] - (base + math.log(own[b] + 1) - math.log(every[b] + 1))) for b in range(n)) < 1e-9
