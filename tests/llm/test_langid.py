import math
import random

import numpy as np
from pyspark.sql import functions as F

from evidoc.llm import langid


def naive_phrases(text, labelled):
    """Longest matches from the text's start, with ``in``."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in labelled:
            j += 1
        i, n = j, n + 1
    return n


def naive_verdict(text, labelled):
    """The language of the fewest phrases (the first of equal ones) and its share."""
    own = langid.letters_only(text or "")
    if not own or not labelled:
        return "und", 0.0
    scale = math.log2(max(2, *map(len, labelled.values())))
    bits = {k: naive_phrases(own, v) * scale / len(own) for k, v in labelled.items()}
    best = min(sorted(bits), key=lambda k: bits[k])
    return best, 1 / sum(2 ** (bits[best] - v) for v in bits.values())


def test_automaton_accepts_exactly_the_substrings():
    r = random.Random(3)
    for _ in range(30):
        text = "".join(r.choice("abc") for _ in range(40))
        states = langid.suffix_automaton(text)
        for _ in range(60):
            probe = "".join(r.choice("abc") for _ in range(r.randrange(1, 7)))
            at = 0
            for c in probe:
                at = states[at].get(c) if at is not None else None
            assert (at is not None) == (probe in text)


def test_interleaved_transitions_are_those_of_the_automaton():
    r = random.Random(4)
    for letters in ("ab", "abcdefgh", [chr(0x4E00 + k) for k in range(400)]):
        texts = {k: "".join(r.choice(letters) for _ in range(300)) for k in "xyz"}
        parser = langid.CrossParser(texts)
        code = {c: k + 3 for k, c in enumerate(sorted({c for t in texts.values() for c in t}))}
        for k, root in zip(parser.languages, parser.roots, strict=True):
            states = langid.suffix_automaton(texts[k])
            for c in range(parser.width):
                want = [next((root + t for x, t in own.items() if code[x] == c), -1) for own in states]
                assert parser.step(root + np.arange(len(states)), c).tolist() == want


def test_large_alphabets_and_many_languages_stay_small():
    """Memory grows with the labelled text, and verdicts stay those of brute force."""
    r = random.Random(6)
    wide = [chr(0x4E00 + k) for k in range(3000)]
    labelled = {f"l{k}": " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(1700))[:12_000] for k in range(4)}
    labelled["wide"] = "".join(r.choice(wide) for _ in range(12_000))
    parser = langid.CrossParser(labelled)
    assert sum(x.nbytes for x in (parser.base, parser.owner, parser.target)) < 20_000_000
    probes = [v[500:640] for v in labelled.values()]
    assert parser.predict(probes)[0] == list(labelled)
    many = {f"n{k:03}": "".join(r.choice("abcdefgh ") for _ in range(200)).strip() for k in range(100)}
    parser = langid.CrossParser(many)
    probes = [v[40:90].strip() for v in many.values()]
    names, scores, _ = parser.predict(probes)
    want = [naive_verdict(p, many) for p in probes]
    assert names == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want])


def test_phrases_are_longest_matches():
    """Blocks of any size give the phrases of whole texts, also where phrases span several blocks."""
    r = random.Random(5)
    texts = {"p": "the cat sat on the mat " * 3, "q": "el gato duerme en la casa " * 3, "r": "abcabdabe" * 20}
    labelled = {k: v.strip() for k, v in texts.items()}
    for block in (1, 4, 7, 64, langid.BLOCK):
        parser = langid.CrossParser(labelled, block)
        batch = [langid.letters_only("".join(r.choice("the catsoelgdurm nk ") for _ in range(r.randrange(1, 700)))) for _ in range(25)]
        batch += ["abcabdabe" * 12 + "abd", ("the cat sat on the mat " * 2 + "zzz ") * 9, "ab" * 100, "xyz", "c"]
        batch = [x.strip() for x in batch if x.strip()]
        got = parser.phrases([parser.encode(x) for x in batch])
        assert got.tolist() == [[naive_phrases(x, labelled[k]) for k in parser.languages] for x in batch]


def test_verdicts_and_ties_equal_brute_force():
    r = random.Random(9)
    labelled = {"b": "one two three", "a": "one two three", "c": "drei vier one"}
    parser = langid.CrossParser(labelled)
    texts = [None, "", " .. 12", "one", "two", "vier", "漢字", "ONE two", "x", *(" ".join(r.choice(("one", "two", "drei", "vier", "qqq")) for _ in range(r.randrange(1, 90))) for _ in range(60))]
    names, scores, _ = parser.predict(texts)
    want = [naive_verdict(t, labelled) for t in texts]
    assert names == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want])
    assert names[3] == "a" and names[6] == "a" and "b" not in names  # of equal ones the first name


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(k, "aaa bbb ccc" if k % 2 else "xxx yyy zzz", "one" if k % 2 else "two") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang", F.when(langid.held_out(), F.lit("never")).otherwise(F.col("lang")))
    assert langid.learn(docs).languages == ["one", "two"]


def test_odd_texts(spark, docs, empty):
    got = {r["doc_id"]: r for r in langid.report(docs).collect()}
    for k in (0, 1, 2, 18):  # null, empty, blank, digits and marks
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert langid.report(docs).count() == docs.count() and langid.report(empty).count() == 0
    kept = langid.keep_known(docs, langid.learn(docs))
    assert kept.columns == docs.columns and not {0, 1, 2, 18} & {r["doc_id"] for r in kept.collect()}


def test_texts_of_unlearned_languages_go_and_others_stay(spark):
    texts = [(tongue(100 * lang + k, 150), f"l{lang}") for lang in (1, 2) for k in range(8)]
    parser = langid.learn(labelled(spark, texts))
    good = [tongue(150, 60), tongue(250, 9), tongue(170, 1), "ABC 12 " + tongue(260, 40), "q"]
    bad = ["\u043f\u0440\u0438\u0432\u0435\u0442 \u0434\u0440\u0443\u0437\u044c\u044f", "\u4eca\u65e5\u306f\u3044\u3044\u5929\u6c17", "\u03b1\u03b2\u03b3 " * 50, "12 34", None]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_known(docs, parser).collect()) == list(range(len(good)))
    assert langid.keep_known(docs, parser, min_score=1.0).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.report(docs).first()["lang_pred"] == "und"


def labelled(spark, texts):
    """Documents that are not held out, of (text, lang)."""
    ids = [r["id"] for r in spark.range(4 * len(texts) + 40).filter(~langid.held_out("id")).collect()]
    return spark.createDataFrame([(k, t, lang) for k, (t, lang) in zip(ids, texts, strict=False)], "doc_id long, text string, lang string")


def tongue(seed, n):
    """Prose of one language: ``seed`` // 100 deals its words."""
    r = random.Random(seed // 100)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def test_a_rare_label_beside_large_ones_wins_nothing(spark):
    texts = [(tongue(100 * lang + k, 150), f"l{lang}") for lang in (1, 2, 3) for k in range(12)]
    parser = langid.learn(labelled(spark, [*texts, ("inonth", "a"), ("123 456", "b")]))
    assert parser.languages == ["a", "l1", "l2", "l3"]  # no letter, no language
    for lang in (1, 2, 3):
        assert set(parser.predict([tongue(100 * lang + k, 100) for k in range(50, 70)])[0]) == {f"l{lang}"}
    blank = langid.CrossParser({"l1": tongue(100, 150), "b": " "})
    assert blank.predict([tongue(150, 100)])[0] == ["l1"]


def test_texts_are_learned_beyond_their_openings(spark):
    """One passage opens all documents; what tells the languages apart stands far behind it."""
    header = tongue(900, 60)
    texts = [(f"{header} {tongue(100 * lang + k, 2500)}", f"l{lang}") for lang in (1, 2) for k in range(8)]
    docs = labelled(spark, texts)
    parser = langid.learn(docs)
    for lang in (1, 2):
        assert set(parser.predict([tongue(100 * lang + k, 60) for k in range(50, 70)])[0]) == {f"l{lang}"}
    chosen = langid.pieces(docs.selectExpr("lang", "doc_id AS h", "text"), langid.SAMPLE_CHARS).collect()
    assert sum(len(r["piece"]) + 1 for r in chosen) >= 2 * langid.SAMPLE_CHARS
    passages = {header[k : k + 60] for k in range(len(header) - 60)}
    assert not any(p in r["piece"] for p in passages for r in chosen)
    whole = [t for t, _ in texts]
    places = [next(t.index(r["piece"]) / len(t) for t in whole if r["piece"] in t) for r in chosen if any(r["piece"] in t for t in whole)]
    assert len(places) > 100 and min(places) < 0.2 and max(places) > 0.8


def test_labels_of_equal_texts_are_learned(spark):
    parser = langid.learn(labelled(spark, [(tongue(100, 50), "x"), (tongue(100, 50), "y")]))
    assert parser.languages == ["x", "y"]
