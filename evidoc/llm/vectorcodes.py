"""Vector code compression: product codebooks, searched by a kd-tree each.

A vector's components become integers and are cut into ``PARTS`` equal consecutive parts. Each part
position has a codebook that starts as that part of the smallest vector ids. In each of ``ROUNDS``
rounds a kd-tree of every codebook is broadcast; tasks find each part's nearest entry by branch and
bound and add parts up per entry; Spark adds the tasks' sums, and the floors of the means become the
new entries. A node is visited if its bound is not greater than the best distance so far, so that of
entries at one distance the lowest index is found wherever it stands. All arithmetic is on integers,
so results do not depend on how rows are dealt out.

The driver sees the codebooks and their sums alone, ``ENTRIES`` times the vector's length numbers.
The table is read once for the starts and once a round; only (id, label, code, error) is written.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so
are vectors shorter than the table's longest one; lengths that ``PARTS`` does not divide are padded with
zeros; components are held within what keeps a squared distance within a long (some 740,000 for 64
components); a repeated id gives its smallest vector to the codebooks once and a row for each of its
rows; rows without an id get codes but are not among the starts; if all ids are null, the codebooks are
empty and no row is given; fewer ids than ``ENTRIES`` make smaller codebooks; equal entries keep their
indexes, and the lowest is used; null labels add up together; a label's sum beyond a long is null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidoc.llm.common import cut, join_counted
from evidoc.llm.vectors import integers, length, matrices, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a leaf of a tree.
LEAF = 4


class Tree:
    """A kd-tree over the rows of an integer matrix. Nodes are boxes; leaves hold entries' indexes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low, self.high, self.children, self.own = [], [], [], []
        self._add(np.arange(len(entries)))

    def _add(self, own: np.ndarray) -> int:
        points = self.entries[own]
        node = len(self.low)
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.children.append(None)
        self.own.append(own)
        wide = self.high[node] - self.low[node]
        if len(own) > LEAF and wide.max() > 0:
            order = own[np.argsort(points[:, wide.argmax()], kind="stable")]
            half = len(order) // 2
            self.children[node] = self._add(order[:half]), self._add(order[half:])
        return node

    def _bound(self, node: int, points: np.ndarray) -> np.ndarray:
        """The squared distance of each point to a node's box."""
        out = np.maximum(0, np.maximum(self.low[node] - points, points - self.high[node]))
        return (out * out).sum(axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; the lower index of equally near ones."""
        index = np.full(len(points), len(self.entries), dtype=np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        self._visit(0, np.arange(len(points)), self._bound(0, points), points, index, best)
        return index, best

    def _visit(self, node, who, bound, points, index, best) -> None:
        who = who[bound <= best[who]]
        if not len(who):
            return
        if self.children[node] is None:
            own = points[who]
            for k in self.own[node]:
                gap = own - self.entries[k]
                far = (gap * gap).sum(axis=1)
                better = (far < best[who]) | ((far == best[who]) & (k < index[who]))
                at = who[better]
                best[at], index[at] = far[better], k
            return
        left, right = self.children[node]
        at_left, at_right = (self._bound(n, points[who]) for n in (left, right))
        first = at_left <= at_right  # the nearer child of each point goes first
        self._visit(left, who[first], at_left[first], points, index, best)
        self._visit(right, who, at_right, points, index, best)
        self._visit(left, who[~first], at_left[~first], points, index, best)


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Codebooks:
    """Codebooks (part, entry, component) and the trees over them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [Tree(own) for own in entries if len(own)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries and squared distances (row, part) of the rows of a matrix."""
        parts, _, width = self.entries.shape
        x = padded(x, parts * width)
        found = [tree.nearest(x[:, p * width : (p + 1) * width]) for p, tree in enumerate(self.trees)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def starts(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids: (part, entry, component)."""
    # Ids first: repeated ones fold before they move. Then the few vectors.
    ids = [r[0] for r in rows.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    few = rows.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect() if ids else []
    each = -(-width // parts)
    x = padded(np.array([r["x"] for r in few], dtype=np.int64).reshape(len(few), width), each * parts)
    return x.reshape(len(few), parts, each).transpose(1, 0, 2)


def improved(rows: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, entries, each = books.entries.shape

    def run(batches):
        trees = shared.value
        total = np.zeros((parts, entries, each), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            for _, x in matrices(b.column(0), width):
                code, _ = trees.assign(x)
                x = padded(x, parts * each)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p * each : (p + 1) * each])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    made = rows.select("x").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    # Longs hold a task's sums; those of all tasks need not fit one.
    wide = [F.sum(F.get("sums", k).cast("decimal(38,0)")).alias(f"s{k}") for k in range(each)]
    new = books.entries.copy()
    for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():
        new[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(each)]
    shared.destroy()
    return Codebooks(new)


def coded(rows: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """vec_id, label, code and error of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        trees = shared.value
        for b in batches:
            for lo, x in matrices(b.column(2), width):
                code, far = trees.assign(x)
                text = np.char.mod("%02x", code)
                text = ["".join(own) for own in text.tolist()]
                own = [b.column(k).slice(lo, len(x)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(text, pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    src = rows.select("vec_id", "label", "x")
    kind = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def train(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame, int]:
    """The codebooks after ``rounds`` rounds, the rows (vec_id, label, x) that they are of, and the
    vectors' length."""
    width = length(embeddings)
    limit = isqrt((1 << 61) // max(1, width))
    rows = integers(embeddings.filter(usable() & (F.size("embedding") == width)), ["vec_id", "label"], limit)
    books = Codebooks(starts(rows, width, parts, entries)) if width else Codebooks(np.zeros((0, 0, 0), dtype=np.int64))
    for _ in range(rounds if books.entries.size else 0):
        books = improved(rows, books, width)
    return books, rows, width


def report(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row."""
    if entries > 256:
        raise ValueError("an entry's index has two hex digits")
    books, rows, width = train(embeddings.select("vec_id", "label", "embedding"), parts, entries, rounds)
    if not books.entries.size:
        rows = rows.limit(0)
    # A null label is a key of its own.
    key = F.when(F.col("label").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    made = cut(coded(rows, books, width).withColumn("key", key))
    sums = made.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    sums = cut(sums)
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = join_counted(made, sums, "key", "rows", total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def sql(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The report by trying every entry, in DuckDB, for vectors of ``width`` components."""
    each = width // parts
    far = " + ".join(f"(v[{k}] - c[{k}]) * (v[{k}] - c[{k}])" for k in range(1, each + 1))
    tables = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, x[p * {each} + 1 : p * {each} + {each}] AS v FROM kept, range({parts}) t(p)
), first AS (
  SELECT vec_id, min(x) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id
), b0 AS MATERIALIZED (
  SELECT p, k, x[p * {each} + 1 : p * {each} + {each}] AS c FROM first, range({parts}) t(p) WHERE k < {entries}
)"""
    ]
    # The least of distance * entries + index: of equal distances the lower index.
    for n in range(rounds + 1):
        tables.append(f"a{n} AS MATERIALIZED (SELECT r, p, v, min(({far}) * {entries} + k) AS m FROM parts JOIN b{n} USING (p) GROUP BY r, p, v)")
        if n < rounds:
            sums = ", ".join(f"sum(v[{k}]) AS s{k}" for k in range(1, each + 1))
            mean = ", ".join(f"((s{k} - ((s{k} % n + n) % n)) // n)::BIGINT" for k in range(1, each + 1))
            tables.append(f"s{n} AS (SELECT p, m % {entries} AS k, count(*) AS n, {sums} FROM a{n} GROUP BY ALL)")
            tables.append(f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.k, CASE WHEN n IS NULL THEN c ELSE [{mean}] END AS c FROM b{n} b LEFT JOIN s{n} s ON b.p = s.p AND b.k = s.k)")
    tables.append(f"coded AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)")
    tables.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS d FROM b{rounds})")
    return f"""WITH {', '.join(tables)}
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM kept JOIN coded USING (r), digest"""
