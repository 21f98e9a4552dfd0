import hashlib
import random
from math import floor, inf, nan

import numpy as np
import pytest

from evidoc.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, `key` string"


def brute(rows, parts, entries, rounds):
    """The report by trying every entry, in plain Python: {(vec_id, code, error, label_error)}, digest."""
    kept = [(i, [floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and abs(x) < inf for x in v)]
    each = len(kept[0][1]) // parts
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    books = [[v[p * each : (p + 1) * each] for v in list(first.values())[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * each : (p + 1) * each], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(assign(v, p)[1], []).append(v[p * each : (p + 1) * each])
            for k, own in groups.items():
                new[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = new
    found = [(i, label, [assign(v, p) for p in range(parts)]) for i, v, label in kept]
    sums = {}
    for _, label, a in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((-1 if i is None else i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), sums[label]) for i, label, a in found), digest


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 5, "k") for r in rows], SCHEMA).repartition(3)


def vectors(n, width, seed, coarse=False):
    r = random.Random(seed)
    rows = [(k, [r.randrange(-3, 4) / 256 if coarse else r.uniform(-0.5, 0.5) for _ in range(width)], r.choice((0, 1, 1, 1, None))) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [nan] * width, 1), (n + 2, [0.0] * (width - 1) + [None], 2), (n + 3, [inf] + [0.0] * (width - 1), 2), (n + 4, [0.0, 0.5], 3)]
    rows += [rows[3], rows[3], (None, rows[5][1], None), (3, rows[9][1], 0)]  # repeated rows, an id with two vectors, and no id
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("coarse", [False, True])
def test_report_equals_brute_force(spark, coarse):
    """``coarse`` vectors have seven values a component, so distances tie all the time."""
    rows = vectors(260, 64, 4, coarse)
    own = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, digest = brute([r for r in own if r[1] is None or len(r[1]) == 64], 16, 64, 2)
    got = vectorcodes.report(frame(spark, rows)).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_trees_find_the_lowest_of_equally_near_entries():
    r = np.random.default_rng(3)
    for size, width, span in ((64, 4, 4), (64, 2, 3), (5, 4, 300), (64, 4, 300), (1, 4, 2), (64, 1, 2)):
        entries = r.integers(-span, span, (size, width))
        points = r.integers(-2 * span, 2 * span, (700, width))
        far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        index, best = vectorcodes.Tree(entries).nearest(points)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_odd_sizes(spark):
    few = [(k, [k / 7] * 16, k % 2) for k in range(5)]
    want, digest = brute([(i, [float(np.float32(x)) for x in v], label) for i, v, label in few], 16, 64, 2)
    got = vectorcodes.report(frame(spark, few)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want and got[0]["codebooks_sha256"] == digest
    assert {r["error"] for r in got} == {0}
    # A length that parts do not divide, huge components, and one vector for most rows.
    rows = [(k, [0.25] * 10, 1) for k in range(300)] + [(300, [3e38] * 10, None), (301, [-3e38] * 10, 1)]
    got = vectorcodes.report(frame(spark, rows)).collect()
    assert len(got) == 302 and all(r["error"] >= 0 and r["label_error"] is not None for r in got)


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 1)], [(2, [], 1)], [(None, [1.0] * 16, 1)]):
        out = vectorcodes.report(frame(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
