"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The test strings are the windows of ``window`` consecutive words of every benchmark item (an item
of fewer words is one shorter string). They are searched per string length m with blocks of up to
three words: a shift table tells how far the search may jump when a block of the document occurs in
no string or only early in one, a bucket per suffix block (and prefix block within it) selects the
few strings that can end there, and a direct comparison of all words confirms an occurrence.

Defined results: null or wordless text has no words, no hits and no items; an item without words
has no windows; an item with a null id matches under the id ``""``; repeated items and repeated
documents are each handled on their own, one output row per input row; extra columns are ignored;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import LOWER, UPPER, WORD_BYTES, cut, fresh, per_row, row_key, shared_folder, store

#: Words of benchmark text in one block of test strings (some 100 MB of tables). Blocks are files in
#: the shared folder that tasks read; a larger benchmark takes a pass over the texts for each.
BLOCK_WORDS = 500_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Shift tables and suffix buckets for one block of benchmark items."""

    BLOCK = 3

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        strings: dict[int, dict[tuple, set[str]]] = {}
        for item, words in items:
            m = min(window, len(words))
            if m:
                own = strings.setdefault(m, {})
                for i in range(len(words) - m + 1):
                    own.setdefault(tuple(words[i : i + m]), set()).add(item)
        self.classes = [self._tables(m, own) for m, own in sorted(strings.items())]

    @classmethod
    def _tables(cls, m: int, strings: dict[tuple, set[str]]):
        b = min(cls.BLOCK, m)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict[tuple, list]] = {}
        for s, items in strings.items():
            for end in range(b, m + 1):
                block = s[end - b : end]
                shift[block] = min(shift.get(block, m), m - end)
            buckets.setdefault(s[m - b :], {}).setdefault(s[:b], []).append((s, tuple(sorted(items))))
        return m, b, m - b + 1, shift, buckets

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(start, end, ids of the items) of every occurrence of a test string."""
        n = len(words)
        for m, b, default, shift, buckets in self.classes:
            end, get = m, shift.get
            while end <= n:
                block = tuple(words[end - b : end])
                jump = get(block, default)
                if jump:
                    end += jump
                    continue
                start = end - m
                for s, items in buckets[block].get(tuple(words[start : start + b]), ()):
                    if tuple(words[start:end]) == s:
                        yield start, end, items
                end += 1


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Disjoint sorted spans that cover the same words."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def benchmark_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[str, int]:
    """Write the benchmark's words to the shared folder in blocks of about ``block_words`` words, and
    return the folder and the number of blocks. Items longer than half a block are cut, the cuts
    overlapping by all but one word of a window; cuts are dealt to blocks by their hash."""
    spark = benchmark.sparkSession
    most = max(window, block_words // 2)

    def run(batches):
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text.encode() if text else None)
                for lo in range(0, max(1, len(w) - window + 1), most - window + 1):
                    own = w[lo : lo + most]
                    rows.append((item, lo, len(own), b" ".join(own)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["item", "at", "n", "words"])

    rows = cut(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).mapInArrow(run, "item string, at long, n long, words binary"))
    blocks = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // block_words))
    folder = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    block = F.pmod(F.xxhash64("item", "at", "words"), F.lit(blocks)).cast("int")
    rows.filter("n > 0").select("item", "words", block.alias("block")).repartition(blocks, "block").write.partitionBy("block").parquet(folder)
    return folder, blocks


_matcher: dict[tuple, WuManber] = {}


def matcher(folder: str, block: int, window: int) -> WuManber:
    """The tables of a block; a Python worker keeps those of the last one for its next tasks."""
    key = (folder, block, window)
    if key not in _matcher:
        system, path = store(folder)
        own = f"{path}/block={block}"
        items: list[tuple[str, list[bytes]]] = []
        if system.get_file_info(own).type == fs.FileType.Directory:
            for info in sorted(system.get_file_info(fs.FileSelector(own)), key=lambda x: x.path):
                if info.base_name.endswith(".parquet"):
                    with system.open_input_file(info.path) as file:
                        t = pq.read_table(file, columns=["item", "words"])
                    items += [(i, w.split()) for i, w in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)]
        _matcher.clear()
        _matcher[key] = WuManber(items, window)
    return _matcher[key]


SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
IDS = T.ArrayType(T.StringType())


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
    text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Columns ``keep`` of every document, with its number of words, the disjoint word spans that
    occurrences cover (``[start, end)``) and the ids of the items whose windows occur."""
    n_words, spans, items = names
    added = [(n_words, T.LongType()), (spans, SPANS), (items, IDS)]
    folder, blocks = benchmark_blocks(benchmark, window, block_words)
    if blocks == 1:
        return per_row(docs, keep, [text], added, searcher(folder, 0, window))
    # One pass over the texts for each block; what is found travels with a key of the row, and meets
    # the rows in the end.
    key = fresh([*docs.columns, *names], "__row")
    keyed = docs.withColumn(key, row_key(text))
    found = None
    for block in range(blocks):
        own = per_row(keyed, [key], [text], added, searcher(folder, block, window)).filter(F.size(spans) > 0)
        own = cut(own.dropDuplicates([key]).select(key, spans, items))
        found = own if found is None else found.union(own)
    lists = found.groupBy(key).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    lists = per_row(lists, [key, items], [spans], [(spans, SPANS)], lambda: lambda own: [[merged(x) for x in own]])
    counted = per_row(keyed, list(dict.fromkeys([*(c for c in keep if c not in names), key])), [text], [(n_words, T.LongType())], lambda: lambda texts: [[len(words_of(t)) for t in texts]])
    out = counted.join(lists, key, "left").withColumns({spans: F.coalesce(spans, F.array().cast(SPANS)), items: F.coalesce(items, F.array().cast(IDS))})
    return out.select(*[f"`{c}`" for c in [*(c for c in keep if c not in names), *names]])


def searcher(folder: str, block: int, window: int):
    """For ``per_row``: number of words, spans and items of each text, for one block."""

    def make():
        own = matcher(folder, block, window)

        def step(texts):
            counts, all_spans, all_items = [], [], []
            for t in texts:
                words = words_of(t)
                got: list[list[int]] = []
                ids: set[str] = set()
                for lo, hi, found in own.search(words):
                    if got and got[-1][0] <= lo <= got[-1][1] <= hi:
                        got[-1] = [got[-1][0], hi]
                    else:
                        got.append([lo, hi])
                    ids.update(found)
                counts.append(len(words))
                all_spans.append(merged(got))
                all_items.append(sorted(ids))
            return counts, all_spans, all_items

        return step

    return make


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    found = find(docs, benchmark, ["doc_id"], window=window, block_words=block_words)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, all columns, in which no benchmark window occurs."""
    taken = list(docs.columns)
    names = []
    for base in ("__n_words", "__spans", "__items"):
        names.append(fresh([*taken, *names], base))
    found = find(docs, benchmark, taken, tuple(names), window=window)
    return found.filter(F.size(names[1]) == 0).select(*[f"`{c}`" for c in taken])


def sql(window: int = 10) -> str:
    """The report by joining every window of a document with those of the items."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least({window}, len(w)) AS m FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM i)
), dw AS (
  SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw))
), hits AS (
  SELECT r, p, iw.m, item FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s
), covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN found f ON d.r = f.r
"""
