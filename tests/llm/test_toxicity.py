import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from evidoc.llm import toxicity
from tests.llm.conftest import prose


def labelled(spark, n=240):
    rows, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        text = prose(k + 100, 40) + (" vileword grossly nastyness" if bad else "")
        rows.append((k, text, "x", "y"))
        labels.append((k, 0 if k % 5 == 0 else 1, int(bad), "z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string, toxic string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1, "z"), (3, None, None, "z")], "doc_id long, quality int, toxic int, text string")


def test_learns_planted_words(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    assert all(got[k]["toxic"] == (k % 6 == 0) for k in got) and len(got) == 240
    kept = toxicity.keep_clean(docs, toxicity.learn(docs, labels))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(240) if k % 6]


def test_chain_passes_probabilities_on(spark):
    docs, labels = labelled(spark)
    chain = toxicity.learn(docs, labels)
    assert chain.names == ("low_quality", "toxic") and [len(m.chain) for m in chain.models] == [0, 1]
    longer = toxicity.learn(docs, labels, categories=(("a", "toxic"), ("b", "1 - quality"), ("c", "toxic")))
    assert [len(m.chain) for m in longer.models] == [0, 1, 2]
    assert longer.models[2].chain[0] > 0.5  # the first category tells the last


def auc(p, y):
    return np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])


def test_out_of_fold_predictions_do_not_see_their_rows(spark):
    """With labels that are noise, out-of-fold probabilities cannot tell them apart; with features
    chosen on all labels they can, which is what would show here."""
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 4000, size=150)) for _ in range(210)]
    y = r.integers(0, 2, size=210)
    frame = spark.createDataFrame([(k, int(v), t) for k, (v, t) in enumerate(zip(y, texts, strict=True))], "doc_id long, noise int, text string")
    _, probabilities, sample = toxicity.train(frame, ("noise",), features=60)
    assert abs(auc(probabilities[:, 0], sample.labels[:, 0]) - 0.5) < 0.1
    leak = toxicity.Sample(sample.rows, sample.labels, sample.fold, [sample.chosen[-1]] * 4)
    leaked = np.zeros(210)
    for k in range(3):
        leaked[sample.fold == k] = toxicity.trained(leak, k, 0, np.zeros((210, 0)))[1]
    assert auc(leaked, sample.labels[:, 0]) > 0.65


def test_equal_texts_share_a_fold(spark):
    docs, labels = labelled(spark, 60)
    twice = docs.union(docs.selectExpr("doc_id + 1000", "text", "p_toxic", "toxic"))
    both = labels.select("doc_id", "quality", "toxic").filter("doc_id is not null")
    rows = toxicity.sampled(twice, both.union(both.selectExpr("doc_id + 1000", "quality", "toxic")), toxicity.CATEGORIES, 500)
    sample, _ = toxicity.numbered(rows, ("low_quality", "toxic"), 100, 3)
    assert len(sample.rows) == 120
    of = {}
    for own, fold in zip(map(tuple, sample.rows), sample.fold.tolist(), strict=True):
        assert of.setdefault(own, fold) == fold


def plain_tokens(text):
    """Words, and the first four bytes of longer ones behind a mark."""
    w = set("".join(c.lower() if "A" <= c <= "Z" else c for c in text).split())
    return w | {"^" + x[:4] for x in w if len(x) > 4}


def plain_fit(x, earlier, y, use):
    """Logistic regression in plain Python lists."""
    width, k, rows = len(x[0]), len(earlier[0]), [i for i in range(len(x)) if use[i]]
    w = [0.0] * (width + k + 1)
    share = (sum(y[i] for i in rows) + 0.5) / (len(rows) + 1)
    w[-1] = math.log(share / (1 - share))
    m, v = [0.0] * len(w), [0.0] * len(w)
    full = [[*x[i], *earlier[i], 1.0] for i in range(len(x))]
    prob = lambda i: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, full[i], strict=True))))
    for t in range(1, 121):
        off = {i: (prob(i) - y[i]) / len(rows) for i in rows}
        grad = [sum(off[i] * full[i][j] for i in rows) + (1e-4 * w[j] if j < width else 0) for j in range(len(w))]
        for j, g in enumerate(grad):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            w[j] -= 0.3 * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.99**t)) + 1e-10)
    return [prob(i) for i in range(len(x))], w


def test_chain_equals_plain_python(spark):
    """Features per fold by chi-square, out-of-fold probabilities, two categories, the threshold."""
    r = np.random.default_rng(5)
    words = ["red", "blue", "greenish", "greener", "yellow", "pinkest", "grey"]
    rows = []
    for k in range(36):
        own = [w for w in words if r.random() < 0.5]
        a, b = int("red" in own or r.random() < 0.1), int(("red" in own) != ("blue" in own) or r.random() < 0.1)
        rows.append((k, a, b, " ".join(own) or "none"))
    frame = spark.createDataFrame(rows, "doc_id long, a int, b int, text string")
    chain, got, _ = toxicity.train(frame, ("a", "b"), features=5)
    order = [x["doc_id"] for x in frame.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows = [rows[k] for k in order]
    own, y = [plain_tokens(x[3]) for x in rows], [list(x[1:3]) for x in rows]
    fold = [zlib.crc32(x[3].encode()) % 3 for x in rows]

    def features(use):
        n, score = sum(use), {}
        for t in set().union(*own):
            seen = sum(u for u, o in zip(use, own, strict=True) if t in o)
            for c in range(2):
                pos = sum(v[c] for u, v in zip(use, y, strict=True) if u)
                both = sum(v[c] for u, v, o in zip(use, y, own, strict=True) if u and t in o)
                want = seen * pos / n
                spread = max(1e-9, want * (1 - pos / n) * (1 - seen / n))
                if seen >= 3:
                    score[t] = max(score.get(t, 0), (both - want) ** 2 / spread)
        return sorted(sorted(score, key=lambda t: (-round(score[t], 9), t))[:5])

    earlier = [[] for _ in rows]
    for c in range(2):
        out = [0.0] * len(rows)
        for k in range(4):
            use = [f != k for f in fold]
            chosen = features(use)
            x = [[(t in o) / math.sqrt(max(1, sum(z in o for z in chosen))) for t in chosen] for o in own]
            p, w = plain_fit(x, earlier, [v[c] for v in y], use)
            for i, f in enumerate(fold):
                out[i] = p[i] if f == k else out[i]
            if k == 3:
                assert np.allclose([*chain.models[c].words, *chain.models[c].chain, chain.models[c].bias], w, atol=1e-6)
                assert sorted(t.decode() for t in chain.features) == chosen
        assert np.allclose(got[:, c], out, atol=1e-6)
        earlier = [[*e, v] for e, v in zip(earlier, out, strict=True)]
    f1 = lambda cut: 2 * sum(v[1] for e, v in zip(earlier, y, strict=True) if e[1] >= cut) / (sum(e[1] >= cut for e in earlier) + sum(v[1] for v in y))
    assert abs(f1(chain.threshold) - max(f1(e[1]) for e in earlier)) < 1e-9


def test_odd_rows(spark, docs, empty):
    own, labels = labelled(spark)
    chain = toxicity.learn(own, labels)
    got = toxicity.score(docs, chain, ["doc_id"]).collect()
    assert len(got) == docs.count()
    assert all(r["p_toxic"] == 0 and not r["toxic"] for r in got if r["doc_id"] in (0, 1, 2))
    assert toxicity.score(empty, chain, ["doc_id"]).count() == 0
    nothing = toxicity.report(docs, labels.filter("doc_id < 0"))
    assert nothing.count() == docs.count() and nothing.filter("toxic").count() == 0


def test_labels_of_one_class(spark):
    docs, labels = labelled(spark)
    assert toxicity.report(docs, labels.filter("toxic = 0")).filter("toxic").count() == 0


def test_accuracy_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "is_toxic")
    rows = toxicity.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).join(labels, "doc_id").collect()
    assert np.mean([r["toxic"] == (r["is_toxic"] == 1) for r in rows]) >= 0.97
