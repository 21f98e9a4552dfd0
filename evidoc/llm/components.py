"""Connected components of a link table, by alternating large and small stars.

Each round shuffles links by one end and keeps only links to the smallest neighbour, so the number
of links never grows and every component becomes a star round its smallest node after a number of
rounds that grows with the logarithm of its diameter. Links and components stay in Spark; the
driver sees a few numbers a round. A node that has more than a thousandth of all links, as the root of
a large component does, gets its smallest neighbour by broadcast, so its links are in no single task;
up to ``FEW`` links are joined at once, which a task can hold and which keeps the driver's plans small.

Before the rounds, tasks make stars of every ``FEW`` links that they hold, where nodes are longs or structs
of longs. So up to ``FEW`` links need no round, and more of them fewer rounds over fewer links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import cut, join_counted, released


#: Links that may meet in one task.
FEW = 100_000


def joined(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` nodes that links reach from each."""
    first = np.arange(n)
    while True:
        before = first.copy()
        np.minimum.at(first, high, first[low])
        np.minimum.at(first, low, first[high])
        first = first[first]
        if (first == before).all():
            return first


def _words(nodes: pa.Array) -> np.ndarray:
    """A row of longs for each node."""
    columns = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)


def _stars(links: DataFrame, total: int, few: int) -> DataFrame:
    """``a``, the smallest node ``b`` that links reach from it, and ``b`` itself, for every ``few`` links."""

    def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind = batches[0].column(0).type
        ends = np.concatenate([_words(b.column(k)) for k in (0, 1) for b in batches])
        nodes, at = np.unique(ends, axis=0, return_inverse=True)
        low, high = at.reshape(2, -1)
        columns = []
        for own in (nodes, nodes[joined(low, high, len(nodes))]):
            parts = [pa.array(np.ascontiguousarray(own[:, k]), pa.int64()) for k in range(own.shape[1])]
            columns.append(pa.StructArray.from_arrays(parts, names=[f.name for f in kind]) if pa.types.is_struct(kind) else parts[0])
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, few):
                part = b.slice(lo, few)
                if rows + part.num_rows > few:
                    yield stars(held)
                    held, rows = [], 0
                held, rows = [*held, part], rows + part.num_rows
        if held:
            yield stars(held)

    return links.coalesce(-(-total // few) or 1).mapInArrow(released(run), links.schema)


def _long(kind: T.DataType) -> bool:
    return kind == T.LongType() or isinstance(kind, T.StructType) and all(f.dataType == T.LongType() for f in kind)


def _star(links: DataFrame, total: int) -> DataFrame:
    """Rounds of (node, neighbour): neighbour -> smallest of the node and its neighbours."""
    low = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if total <= FEW:
        return links.join(low.select("a", F.least("a", "m").alias("m")), "a")
    return join_counted(links, low.select("a", F.least("a", "m").alias("m"), "n"), "a", "n", total)


def components(links: DataFrame, a: str, b: str, few: int = FEW) -> DataFrame:
    """``node``, ``root`` of every node in a link; the root is its component's smallest node."""
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b")
    if _long(pairs.schema["a"].dataType):
        now = cut(pairs)
        total = now.count()
        stars = cut(_stars(now, total, few))
        if total <= few:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        pairs = stars.filter("a != b")
    now = cut(pairs.distinct())
    total = now.count()
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        kept = cut(large.distinct())
        small = _star(kept, total)  # here every b < a, so m is the smallest neighbour below a
        down = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = cut(down.filter("a != b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state, total = tuple(seen), seen[0]
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
