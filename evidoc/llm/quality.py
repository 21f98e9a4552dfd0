"""Quality rules: hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs of every document are hashed to ``BUCKETS`` buckets. Two multinomials over the
buckets are counted, one over all documents and one over all trusted documents (quality labels of
1). A document's value is the mean over its n-grams of log p_trusted - log p_all; it passes at
``THRESHOLD`` or more. Simple rules come first: too few words, or too many words in repeated
three-word windows.

Defined results: a null text has no words and fails; a text without words has value 0 and fails by
its length; with no trusted document the ratio is 0 everywhere, so the simple rules decide alone;
repeated rows get rows of their own; extra columns are ignored; rows of labels with null ids or
quality are not trusted.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidoc.llm.native import let, spaced

BUCKETS = 8_192
SMOOTHING = 1.0
THRESHOLD = -0.10
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that stand twice or more in the array of words."""

    def at(k: Column) -> Column:
        return F.get(w, k)

    windows = F.when(
        F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(at(k), at(k + 1), at(k + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def twice(g: Column) -> Column:
        by_hash = F.array_sort(F.transform(g, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def starts(s: Column) -> Column:
            def one(i: Column) -> Column:
                h = F.get(s, i)["h"]
                same = (F.get(s, i - 1)["h"] == h) | (F.get(s, i + 1)["h"] == h)
                return F.when(same, F.get(s, i)["k"])

            return F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), one), lambda k: k.isNotNull()))

        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            let(by_hash, starts),
            none,
            lambda a, k: F.struct((k + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - k)).alias("n")),
            lambda a: a["n"],
        )

    # Most texts repeat no window; they are spared the sort.
    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(twice(g)))


def buckets(w: Column, n: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    single = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
    pair = F.when(
        F.size(w) > 1,
        F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.pmod(F.xxhash64(F.get(w, k), F.get(w, k + 1)), F.lit(n)).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(single, pair)


def trusted(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()


def ratios(docs: DataFrame, labels: DataFrame, n: int = BUCKETS) -> list[float]:
    """log p_trusted - log p_all of every bucket; counts over all documents and over all trusted
    ones, summed in Spark to ``n`` rows."""

    def grams(rows: DataFrame, good: Column) -> DataFrame:
        return rows.select(good.alias("good"), F.explode(let(words(F.col("text")), lambda w: buckets(w, n))).alias("bucket"))

    # Counted apart, so that rows without an id take no part in the join; a merge join at every size,
    # as trusted ids grow with the table.
    texts = docs.select("doc_id", "text")
    rows = grams(texts, F.lit(False)).union(grams(texts.join(trusted(labels).hint("merge"), "doc_id"), F.lit(True)))
    counts = rows.groupBy("bucket").agg(F.count_if(~F.col("good")).alias("all"), F.count_if("good").alias("good")).collect()
    total, good = sum(r["all"] for r in counts), sum(r["good"] for r in counts)
    if not good:
        return [0.0] * n
    base = math.log(total + SMOOTHING * n) - math.log(good + SMOOTHING * n)
    out = [base] * n
    for r in counts:
        out[r["bucket"]] = base + math.log(r["good"] + SMOOTHING) - math.log(r["all"] + SMOOTHING)
    return out


def mean_ratio(w: Column, table: Column, n: int = BUCKETS) -> Column:
    def mean(b: Column) -> Column:
        return F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(b)

    return let(buckets(w, n), lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(mean(b)))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    the log-likelihood ratio of every document."""
    table = F.lit(np.array(ratios(docs, labels), dtype=np.float64))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            mean_ratio(w, table).alias("llr"),
        ),
    )
    measured = docs.select(
        "doc_id",
        of_words.alias("w"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    return measured.select(
        "doc_id",
        "w.n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "w.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("w.llr") >= threshold)).alias("kept"),
        "w.llr",
    )
