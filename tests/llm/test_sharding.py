import heapq
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq

from evidoc.llm import sharding


def test_assign(spark, docs):
    rows = sharding.assign(docs).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"])
    assert len(rows) == sum(map(len, texts.values()))
    homes, slots, sizes = {}, defaultdict(list), defaultdict(int)
    for r in rows:
        text = texts[r["doc_id"]][0]
        raw = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert homes.setdefault(text, r["shard"]) == r["shard"] and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def plain(sizes, shards=16):
    """One heap step per group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_schedule_is_longest_first():
    """Classes of one size each, few and many groups, give the loads of one heap step per group."""
    for seed in range(40):
        r = random.Random(seed)
        shards = r.choice((2, 3, 16))
        sizes = r.sample(range(1, 3000), r.choice((1, 3, 60)))
        classes = [(s, n, s * n) for s in sizes for n in [r.choice((1, 2, 17, r.randrange(1, 200), r.randrange(1, 5000)))]]
        made, loads = sharding.longest_first(classes, shards), [0] * shards
        for size, n, _ in classes:
            runs, turn = made[size]
            rest = n - sum(k for k, _ in runs)
            assert rest >= 0 and sorted(turn) == list(range(shards))
            for k, s in runs:
                loads[s] += k * size
            for k in range(rest):
                loads[turn[k % shards]] += size
        assert sorted(loads) == plain([s for s, n, _ in classes for _ in range(n)], shards)


def test_loads_are_those_of_plain_scheduling(spark):
    """Beyond exact classes too: within the width of a class of what one heap over all groups gives."""
    rows = [(k, "x" * n) for k, n in enumerate([5, 5, 5, 40, 40, 3000, 3001, 3002, 90_001, 90_002, *range(2500, 2900), *range(100, 400), 200_000])]
    docs = spark.createDataFrame([*rows, *rows[8:10], *rows[:3]], "doc_id long, text string")
    loads = {}
    for r in sharding.assign(docs).collect():
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    groups = {}
    for r in docs.collect():
        groups[r["text"]] = groups.get(r["text"], 0) + len(r["text"]) + 1
    want = plain(groups.values())
    assert all(abs(a - b) <= 100 for a, b in zip(sorted(loads.values()), want, strict=True))


def test_groups_of_equal_size_tie_over_all_shards(spark):
    docs = spark.createDataFrame([(k, f"{k:06d}") for k in range(4000)], "doc_id long, text string")
    sizes = [r["count"] for r in sharding.assign(docs).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and set(sizes) == {250}


def test_near_equal_bytes(spark, sf):
    rows = sharding.assign(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in rows]
    assert len(loads) == 16 and max(loads) <= 1.35 * sum(loads) / 16


def test_write_keeps_all_rows_in_slot_order(spark, docs, tmp_path):
    sharding.write(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == [*docs.columns, "_shard"] and back.count() == docs.count()
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(repr, map(key, back.collect()))) == sorted(map(repr, map(key, docs.collect())))
    slots = {(r["doc_id"], r["shard"]): r["slot"] for r in sharding.assign(docs).collect()}
    for folder in (tmp_path / "out").iterdir():
        if folder.is_dir():
            shard = int(folder.name.partition("=")[2])
            for file in sorted(folder.glob("*.parquet")):
                own = [slots[x, shard] for x in pq.read_table(file).column("doc_id").to_pylist() if x not in (None, 6)]
                assert own == sorted(own)


def test_empty(spark, empty):
    assert sharding.assign(empty).count() == 0
