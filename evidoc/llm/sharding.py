"""Sharding by longest-processing-time scheduling.

Documents with equal texts stay together. Groups, sorted by size, largest first, go one after the
other to the least-loaded shard, which a heap gives. The scheduler works on size classes: up to
``EXACT`` bytes a class is one size, beyond it sizes that agree in their leading eleven bits (under
0.1 % apart), so the driver sees a bounded number of classes (``EXACT`` and 1024 for each doubling
of the size) whatever the number of groups. Of a class, the first groups bring shards that are behind
level with the others, as the heap does, and the rest, again as the heap does with equal sizes, go
round the shards in the order of their loads. Groups take these places by rank, largest first (to a
64th of a class's width, and by hash within that).

Defined results: a null text is a group of its own, apart from the empty text, of size 1 and CRC 0;
repeated rows share a group and get slots of their own; extra columns are ignored; an empty table
gives no rows. A group larger than an even share fills a shard on its own, as it may not be cut.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm import ranks
from evidoc.llm.common import cut, fresh, join_counted

SHARDS = 16
EXACT = 2048
#: Parts of a class's width by which its groups are sorted.
PARTS = 64


def spare_bits(size: Column) -> Column:
    """Bits of a size beyond its leading eleven."""
    return F.greatest(F.lit(0), F.length(F.bin(size)) - 11)


def size_class(size: Column) -> Column:
    """The class of a size: its leading eleven bits, the others zero."""
    return F.call_function("shiftleft", F.call_function("shiftright", size, spare_bits(size)), spare_bits(size))


def within_class(size: Column) -> Column:
    """Which part of its class's width a size is in; 0 is the largest."""
    rest = (size - size_class(size)) * PARTS
    return F.lit(PARTS - 1) - F.call_function("shiftright", rest, spare_bits(size)).cast("int")


def longest_first(classes: list[tuple[int, int, int]], shards: int = SHARDS) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
    """Schedule (class, groups, bytes of all its groups) rows: per class, (groups, shard) runs that bring
    shards level, and the shards that further groups go to in turn.

    Loads are counted in units of one byte over the class's number of groups, so all of them are whole
    numbers where a class is one size.
    """
    heap = [(0, s) for s in range(shards)]
    placed: dict[int, tuple[list[tuple[int, int]], list[int]]] = {}
    for name, count, total in sorted(classes, reverse=True):
        size = total // count if total % count == 0 else total / count
        # Shards that are behind get what brings them to the most loaded one, or as far as all get.
        top = level = max(heap)[0]
        got = {s: (top - load) // size for load, s in heap}
        if sum(got.values()) > count:
            low, level = min(heap)[0], top
            for _ in range(200):  # halving ends long before
                middle = (low + level) // 2 if isinstance(low + level, int) else (low + level) / 2
                if middle in (low, level):
                    break
                many = sum(max(0, middle - load) // size for load, _ in heap)
                low, level = (middle, level) if many <= count else (low, middle)
            got = {s: max(0, low - load) // size for load, s in heap}
        runs = [(int(got[s]), s) for _, s in sorted(heap) if got[s]]
        heap = [(load + got[s] * size, s) for load, s in heap]
        heapq.heapify(heap)
        left = count - sum(n for n, _ in runs)
        turn = [s for _, s in sorted(heap)]
        loads = {s: load for load, s in heap}
        for k, s in enumerate(turn):
            loads[s] += size * (left // shards + (k < left % shards))
        heap = [(load, s) for s, load in loads.items()]
        heapq.heapify(heap)
        placed[name] = runs, turn
    return placed


def homes(rows: DataFrame, shards: int) -> DataFrame:
    """``__text``, ``__n`` (rows) and ``__shard`` of every group of rows (``__text``, ``__size``)."""
    spark = rows.sparkSession
    groups = rows.groupBy("__text").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__n")).withColumn("__class", size_class(F.col("__bytes")))
    groups = cut(groups)
    classes = [tuple(r) for r in groups.groupBy("__class").agg(F.count(F.lit(1)), F.sum("__bytes")).collect()]
    table = []
    for name, (runs, turn) in longest_first(classes, shards).items():
        ends, at = [], 0
        for n, s in runs:
            at += n
            ends.append((at, s))
        table.append((name, ends, at, turn))
    counts = {name: n for name, n, _ in classes}
    kind = T.ArrayType(T.StructType([T.StructField("end", T.LongType()), T.StructField("shard", T.IntegerType())]))
    schema = T.StructType([T.StructField("__class", T.LongType()), T.StructField("__ends", kind), T.StructField("__level", T.LongType()), T.StructField("__turn", T.ArrayType(T.IntegerType())), T.StructField("__groups", T.LongType())])
    where = F.broadcast(spark.createDataFrame([(*r, counts[r[0]]) for r in table], schema))  # bounded: a row per size class
    dealt = groups.join(where.select("__class", "__groups"), "__class")
    of_part = ranks.cells(F.col("__groups") / PARTS)
    dealt = dealt.withColumn("__cell", within_class(F.col("__bytes")) * of_part + F.pmod(F.xxhash64("__text"), of_part)).drop("__groups")
    ranked = ranks.within(dealt, ["__class"], "__cell", [F.desc("__bytes"), F.col("__text")], "__rank").join(where, "__class")
    run = F.element_at(F.filter("__ends", lambda x: x["end"] > F.col("__rank")), 1)["shard"]
    turn = F.get("__turn", F.pmod(F.col("__rank") - F.col("__level"), F.lit(shards)).cast("int"))
    return ranked.select("__text", "__n", F.when(F.col("__rank") < F.col("__level"), run).otherwise(turn).alias("__shard"))


def placed(docs: DataFrame, keep: list[Column], shards: int) -> DataFrame:
    """The columns ``keep`` of every document, in a struct ``__doc``, with ``__id``, ``__size``,
    ``__crc``, ``__shard`` and ``__slot``."""
    rows = cut(
        docs.select(
            F.struct(*keep).alias("__doc"),
            F.col("doc_id").cast("long").alias("__id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("__size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("__crc"),
            F.coalesce(F.sha2("text", 256), F.lit("null")).alias("__text"),
        )
    )
    total = rows.count()
    home = cut(homes(rows, shards))
    out = join_counted(rows, home, "__text", "__n", total).drop("__n")
    # One shard may hold any part of the rows, so its slots are counted in cells of its own.
    per_shard = F.lit(max(1, total // ranks.CELL_ROWS)).cast("long")
    out = out.withColumn("__cell", F.pmod(F.xxhash64("__id"), per_shard))
    return ranks.within(out, ["__shard"], "__cell", [F.col("__id"), F.col("__crc"), F.col("__text")], "__slot")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    return placed(docs, [F.lit(True).alias("row")], shards).select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents, all columns, as Parquet in one folder per shard (``shard=0``; ``_shard=0``
    where the documents have a column of that name), its files in the order of slots."""
    name = fresh(docs.columns, "shard")
    out = placed(docs, [F.col(f"`{c}`") for c in docs.columns], shards)
    ordered = out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    columns = [F.col("__doc").getField(c).alias(c) for c in docs.columns]
    ordered.select(*columns, F.col("__shard").alias(name)).write.partitionBy(name).parquet(path)
