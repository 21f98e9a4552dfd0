import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidoc.llm import tokencount
from evidoc.llm.queries import tokenizer_path
from tests.llm.conftest import odd_texts, prose

PATH = tokenizer_path("word_bpe_49k.json")
NAMES = ("<|endoftext|>", "<|startoftext|>")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH)


def library(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def mixed(r, n):
    letters = "abcdeéèñßİıÅẠ̊́k'rvelst  \n\t!?.,123中文한국\U0001f600<|>ſK　\x85\x1c\x00​"
    return "".join(r.choice((*NAMES, "'re", "'ve", "'ll")) if r.random() < 0.06 else r.choice(letters) for _ in range(n))


def test_report_equals_the_library(spark, docs, tokenizer):
    rows = [(k, t) for k, t in enumerate(odd_texts())]
    rows += [(100 + k, prose(k, 2500)) for k in range(3)] + [(200, "x" * 60_000), (201, "!?" * 9_000), (202, "a " * 2048), (203, "a " * 2049)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("taken")).repartition(3)
    got = {r["doc_id"]: r for r in tokencount.report(frame, PATH).collect()}
    want = library(tokenizer, [t or "" for _, t in rows])
    for (k, t), n in zip(rows, want, strict=True):
        r = got[k]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 2048)
        assert (r["within_chars"] is None) == (n <= 2048)
    assert got[203]["within_chars"] == 4096 and sum(r["over_limit"] for r in got.values()) >= 5
    # repeated rows and one without an id
    assert tokencount.report(docs, PATH).count() == docs.count()


def test_code_points(tokenizer, counter):
    """All of the first planes' scripts, and every seventh of what lies beyond."""
    chars = [chr(c) for c in (*range(0x3400), *range(0x3400, 0x110000, 7)) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 20_000):
        texts = [f"{c}'re a{c}b 1{c}" for c in chars[lo : lo + 20_000]]
        assert [counter.count(t) for t in texts] == library(tokenizer, texts)


def test_random_words(tokenizer, counter):
    r = random.Random(1)
    parts = [*"abcdefghijklmnopqrstuvwxyz", "th", "ing", "er", "aa", "ll", "s", "é", "!"]
    words = ["".join(r.choice(parts) for _ in range(r.randrange(1, 20))) for _ in range(20_000)]
    words += ["a" * k for k in range(1, 120)] + ["ha" * k for k in range(1, 80)] + ["!" * k for k in range(1, 120)]
    assert [counter.count(w) for w in words] == library(tokenizer, words)


def test_all_prefixes_and_budgets(tokenizer, counter):
    r = random.Random(2)
    for _ in range(400):
        text = mixed(r, r.randrange(1, 40))
        norm, counts = counter.prefixes(text)
        assert counts == library(tokenizer, [norm[:k] for k in range(len(norm) + 1)])
        assert counts[-1] == counter.count(text) == library(tokenizer, [text])[0]
        for limit in (0, 1, 2, 5, 11):
            cut = counter.within(text, limit)
            longest = max(k for k, n in enumerate(counts) if n <= limit)
            assert (len(norm) if cut is None else cut) == longest


def test_stored_counts_answer_budgets_in_spark(spark, docs, tokenizer):
    stored = tokencount.prefix_counts(docs.filter("doc_id is not null"), PATH, ["doc_id"])
    for limit in (0, 3, 100):
        for r in stored.select("normalised", tokencount.cut_to(F.lit(limit)).alias("kept")).collect():
            assert r["normalised"].startswith(r["kept"])
            n = library(tokenizer, [r["kept"], r["normalised"]])
            assert n[0] <= limit and (r["kept"] == r["normalised"] or n[1] > limit or "<|" in r["normalised"])


def test_memory_is_bounded_within_a_text(counter, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 50)
    monkeypatch.setattr(tokencount, "BORDERS", 40)
    own = tokencount.Counter(PATH)
    text = " ".join(prose(k, 1) + str(k) for k in range(2000))
    assert own.count(text) == counter.count(text)
    assert max(len(own.chunks), len(own.chunks.older), len(own.words), len(own.words.older)) <= 50 and own.pairs.n_borders <= 40


def test_tokens_that_no_text_gives_are_never_used():
    """bc is merged before ab, so ab never stands before c."""
    model = {"vocab": {c: k for k, c in enumerate(("a", "b", "c", "bc", "ab", "abd", "d"))}, "merges": [["b", "c"], ["a", "b"], ["ab", "d"]]}
    pairs = tokencount.Pairs(model)
    assert pairs.count("abc") == 2 and pairs.count("abd") == 1 and pairs.count("abcd") == 3 and pairs.prefixes("abcd")[1] == [0, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        tokencount.Pairs({"vocab": {}, "merges": [["ab", "c"], ["a", "b"]]})


def test_empty(empty):
    assert tokencount.report(empty, PATH).count() == 0
