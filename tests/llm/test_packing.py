import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evidoc.llm import packing
from evidoc.llm.queries import tokenizer_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_and_places(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"] or "")
    pieces, wanted = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), []
    for doc, own in texts.items():
        for text in own:
            ids = tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]
            first = len(ids) % 1024 or min(1024, len(ids))
            starts = [0, *range(first, len(ids), 1024)]
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                wanted.append((str(doc), k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())))
    assert pieces == sorted(wanted)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_chunks_give_the_ids_of_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    encoder, r = packing.Encoder(PATH), random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2003", "\u3000", "\x00", "a", "Word", "don't", "12", "...", "é", "漢", "<|endoftext|>", "'s", "_", "\u200b", " word.", "naïve,", "?!", " x1;", "ſ", "’", ":", " ."]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_ids_of_code_points():
    """The first scripts, those that versions of Unicode disagree on, and every seventh of what lies beyond."""
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    some = (*range(0x3400), *range(0xA700, 0xA800), *range(0x10D00, 0x12000), *range(0x16E00, 0x17000), *range(0x1C800, 0x1F000), *range(0x2E000, 0x34000, 3), *range(0x3400, 0x110000, 7))
    chars = [chr(c) for c in some if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(chars), 20_000):
        texts = [f"{c}'re a{c}b 1{c} {c}!" for c in chars[lo : lo + 20_000]]
        for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert encoder.encode(text) == np.array(want.ids, dtype="<u4").tobytes(), ascii(text)


def test_memory_is_bounded_within_a_text(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "_memories", {})
    encoder = packing.Encoder(PATH)
    text = " ".join(f"word{k}é w{k}" for k in range(3000))
    assert encoder.encode(text) == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert len(encoder.memory) <= 41 and len(encoder.memory.older) <= 41


def test_names_of_special_tokens_are_those_tokens():
    encoder = packing.Encoder(PATH)
    got = np.frombuffer(encoder.encode("a <|endoftext|> b"), dtype="<u4").tolist()
    assert got == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids and len(got) == 4


def test_plan_uses_the_histogram_and_few_sequences():
    for seed in range(6):
        r = random.Random(seed)
        histogram = {r.randrange(1, 1025): r.randrange(1, 4000) for _ in range(r.randrange(1, 300))}
        made = packing.plan(histogram)
        used = defaultdict(int)
        for lengths, times in made:
            assert times > 0 and sum(lengths) <= 1024
            for v in lengths:
                used[v] += times
        assert dict(used) == histogram
        assert sum(n for _, n in made) <= 1.005 * sum(n for _, n in packing.best_fit_decreasing(histogram, 1024)) + 1


def histogram_of(spark, sf):
    rows = packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), PATH).groupBy("length").count().collect()
    return {r["length"]: r["count"] for r in rows}


def test_fitted_patterns_carry_most_sequences(spark):
    """On the tables' own lengths the fit needs no more sequences than best fit alone, and patterns of
    less than a whole sequence's piece make most of them."""
    histogram = histogram_of(spark, "sf0.01")
    fitted, residual = packing.plan_parts(histogram)
    own = sum(n for lengths, n in fitted if lengths != (1024,))
    assert own >= sum(n for _, n in residual) and sum(n for _, n in fitted) >= 3 * sum(n for _, n in residual)
    assert sum(n for _, n in fitted + residual) <= sum(n for _, n in packing.best_fit_decreasing(histogram, 1024))


def test_dense_histograms_are_packed_nearly_full():
    r = random.Random(6)
    for mean in (5.3, 5.9):
        histogram = defaultdict(int)
        for _ in range(50_000):
            histogram[min(1024, max(1, int(r.lognormvariate(mean, 0.9))))] += 1
        bins = sum(n for _, n in packing.plan(histogram))
        assert bins <= 1.001 * -(-sum(k * n for k, n in histogram.items()) // 1024) + 10


def test_least_squares_counts_are_not_negative():
    histogram = np.zeros(1025)
    histogram[[512, 256, 300, 724]] = [100, 50, 80, 80]
    table = packing.patterns(np.flatnonzero(histogram), 1024)
    assert {(512, 512, 0), (724, 300, 0), (512, 256, 256)} <= set(map(tuple, table.tolist())) and (table.sum(axis=1) <= 1024).all()
    assert (packing.fit(table, histogram) >= 0).all()


def test_sequences_hold_their_ids(spark, docs):
    for r in packing.sequences(docs, PATH).collect():
        assert len(r["ids"]) <= 1024 and len(r["doc_ids"]) == len(r["offsets"])


def test_empty(spark, empty):
    assert packing.pack(empty, PATH).count() == 0


def test_plain_words_are_told_by_their_letters_alone(monkeypatch):
    encoder = packing.Encoder(tokenizer_path())
    encoder.memory.clear()
    encoder.memory.older = {}
    asked = []
    monkeypatch.setattr(packing.Memory, "parts", staticmethod(lambda chunk: asked.append(chunk) or packing.PARTS.findall(chunk)))
    text = "Plain words, some of them with marks! and 7 others?! A.b it's"
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == want
    assert not any(x.strip(" .,;:!?").isalpha() for x in asked)
