import random

import numpy as np
import xxhash

from evidoc.llm import components, simhash
from tests.llm.conftest import WORDS, prose


def naive(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marked):
    """doc -> smallest doc reachable, by comparing all pairs."""
    parent = {d: d for d, _ in marked}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(marked):
        for b, y in marked[:i]:
            if bin(x ^ y).count("1") <= 4:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in parent}


def test_report_equals_brute_force(spark, docs):
    own = docs.filter("doc_id is not null")
    rows = own.select("doc_id", "text").collect()
    fps = {r["doc_id"]: naive(r["text"]) for r in rows}
    want = brute_components(sorted(fps.items()))
    got = simhash.report(own).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def test_links_reach_all_close_pairs(spark):
    """Random fingerprints and neighbours of them at every small distance, in chains too."""
    r = random.Random(7)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
    # one segment's bits in common: a crowded variant, searched and blocked
    fps |= {(5 << 50) | r.getrandbits(20) for _ in range(300)}
    nodes = [(simhash.signed(x), x) for x in sorted(fps)]
    frame = spark.createDataFrame([(a,) for a, _ in nodes], "fp long")
    for large in (simhash.LARGE, 280):
        found = components.components(simhash.links(frame, large=large), "a", "b").collect()
        root = {x["node"]: x["root"] for x in found}
        ids = {x: k for k, (_, x) in enumerate(nodes)}
        want = brute_components([(k, x) for x, k in ids.items()])
        groups, wanted = {}, {}
        for a, x in nodes:
            groups.setdefault(root.get(a, a), set()).add(ids[x])
            wanted.setdefault(want[ids[x]], set()).add(ids[x])
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_hubs_chains_and_cycles(spark):
    import random

    r = random.Random(3)
    edges = [(0, k) for k in range(1, 900)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)]
    edges += [(3000 + r.randrange(200), 3000 + r.randrange(200)) for _ in range(150)] + [(950, 940), (940, 5), (7, 7), (1, 0)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    frame = spark.createDataFrame(edges, "x long, y long")
    got = {n["node"]: n["root"] for n in components.components(frame, "x", "y").collect()}
    assert got == {x: root(x) for x in parent}
    for few in (150, 7):  # several tasks' stars, which rounds then join, and links within one batch
        parts = components.components(frame.repartition(5), "x", "y", few).collect()
        assert len(parts) == len(parent) and {n["node"]: n["root"] for n in parts} == got


def test_components_of_few_links_take_no_rounds(spark):
    """Up to ``FEW`` links are one task's; rounds over them were some hundred stages of the pipeline."""
    frame = spark.createDataFrame([((k, 0, -k), (k + 1, 0, -k - 1)) for k in range(-300, 300)], "x struct<w0:bigint,w1:bigint,w2:bigint>, y struct<w0:bigint,w1:bigint,w2:bigint>")
    spark.sparkContext.setJobGroup("few links", "components")
    got = {tuple(n["node"]): tuple(n["root"]) for n in components.components(frame, "x", "y").collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(k, 0, -k): (-300, 0, 300) for k in range(-300, 301)}
    assert len(jobs) <= 6


def test_variants_by_brute_force_and_small_code(spark, capsys):
    """Each key is a segment with one bit cleared; code for them must not grow with the bits (the driver
    compiled 223,000 characters for 192 bits once, which took it over its memory)."""
    r = random.Random(5)
    for scheme in (simhash.EXACT, simhash.NEAR):
        fps = [tuple(r.getrandbits(64) for _ in range(scheme.words)) for _ in range(20)]
        fps += [(0,) * scheme.words, ((1 << 64) - 1,) * scheme.words]
        want = set()
        for fp in fps:
            number = 0
            for pieces in scheme.segments:
                value = width = 0
                for w, lo, n in pieces:
                    value |= (fp[w] >> lo & (1 << n) - 1) << width
                    width += n
                want |= {(tuple(map(simhash.signed, fp)), number + k << 40 | value & ~(1 << k), number + k) for k in range(width)}
                number += width
        names = simhash.WORDS[: scheme.words]
        rows = [(tuple(map(simhash.signed, fp)) if scheme.words > 1 else simhash.signed(fp[0]),) for fp in fps]
        kind = f"struct<{','.join(f'{n}:bigint' for n in names)}>" if scheme.words > 1 else "bigint"
        got = simhash.variants(spark.createDataFrame(rows, f"fp {kind}"), scheme)
        found = [(tuple(x["fp"]) if scheme.words > 1 else (x["fp"],), x["key"], x["bit"]) for x in got.collect()]
        assert len(found) == len(want) and set(found) == want
        capsys.readouterr()
        got.explain("codegen")
        assert len(capsys.readouterr().out) < 60_000


def test_segments_cover_all_bits():
    for scheme, widths in ((simhash.EXACT, [21, 21, 22]), (simhash.NEAR, [17, 17, 18, 17, 18, 17, 18, 17, 18, 17, 18])):
        assert scheme.widths() == widths
        bits = [64 * w + k for own in scheme.segments for w, lo, n in own for k in range(lo, lo + n)]
        assert sorted(bits) == list(range(64 * scheme.words))


def mixed(h):
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = h * odd % (1 << 64)
        h ^= h >> 32
    return h


def near_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def naive_near(text):
    """192 bits by majority over the set of five-word shingles; the first word is the lowest."""
    shingles = near_shingles(text)
    hashes = [h | mixed(h) << 64 | mixed(mixed(h)) << 128 for h in (xxhash.xxh64_intdigest(s, 42) for s in shingles)]
    return sum(1 << b for b in range(192) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_linked(x, y):
    edges = [192 * k // 11 for k in range(12)]
    parts = [(x ^ y) >> lo & (1 << hi - lo) - 1 for lo, hi in zip(edges, edges[1:], strict=False)]
    return (x ^ y).bit_count() <= 44 and min(p.bit_count() for p in parts) <= 1


def near_roots(rows):
    """key -> smallest key reachable, by comparing all pairs of (key, text)."""
    root = {k: k for k, _ in rows}
    marked = [(k, naive_near(t), near_shingles(t)) for k, t in rows]
    for i, (a, x, s) in enumerate(marked):
        for b, y, t in marked[:i]:
            if root[a] != root[b] and near_linked(x, y) and 5 * len(s & t) >= 4 * len(s | t):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_deduplicate_keeps_one_of_each(spark, docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = {(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""): r["text"] for r in docs.collect()}
    roots = near_roots(sorted(rows.items()))
    want = sorted(k for k, v in roots.items() if k == v)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == want


def edited(text, r, share):
    """Each word replaced with the given chance."""
    return " ".join(r.choice(WORDS) + "x" if r.random() < share else w for w in text.split())


def jaccard(x, y):
    a, b = near_shingles(x), near_shingles(y)
    return len(a & b) / len(a | b)


def grouped(spark, texts):
    """Number of a text -> root of its fingerprint."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {tuple(x["fp"]): tuple(x["root"]) for x in simhash.near_roots(frame).collect()}
    fps = [simhash.fingerprint(t.encode(), simhash.NEAR) for t in texts]
    return [roots[tuple(map(simhash.signed, f))] for f in fps]


def test_near_copies_are_linked_and_others_not(spark):
    r = random.Random(8)
    texts, pairs = [], []
    for k in range(240):
        base = prose(1000 + k, 300)
        pairs.append((len(texts), len(texts) + 1))
        texts += [base, edited(base, r, r.choice((0.003, 0.01, 0.015, 0.02, 0.03, 0.2)))]
    got = grouped(spark, texts)
    found = {s: [got[a] == got[b] for a, b in pairs if s <= jaccard(texts[a], texts[b]) < s + 0.1] for s in (0.8, 0.9)}
    assert np.mean(found[0.9]) > 0.98 and np.mean(found[0.8]) > 0.93 and min(map(len, found.values())) > 30
    far = [got[a] == got[b] for a, b in pairs if jaccard(texts[a], texts[b]) < 0.8]
    assert len(far) > 60 and not any(far)


def test_recall_and_removals_on_the_documents(spark):
    """All pairs of sf0.01 by an inverted index: nine in ten of similar pairs share a component, and no
    document goes without a similar one in its component."""
    texts = [t or "" for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()]
    got = grouped(spark, texts)
    sets, at, close = [near_shingles(t) for t in texts], {}, {}
    for k, own in enumerate(sets):
        shared = {}
        for s in own:
            for other in at.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            at[s].append(k)
        for other, n in shared.items():
            if 5 * n >= 4 * (len(own) + len(sets[other]) - n):
                close.setdefault(k, []).append(other)
                close.setdefault(other, []).append(k)
    hits = [got[a] == got[b] for a, own in close.items() for b in own]
    assert len(hits) > 40 and np.mean(hits) > 0.9
    members = {}
    for k, root in enumerate(got):
        members.setdefault(root, []).append(k)
    for own in members.values():
        if len({frozenset(sets[k]) for k in own}) > 1:
            assert all(any(got[b] == got[a] for b in close.get(a, [])) for a in own)


def test_a_large_group_of_near_copies_is_one(spark):
    r = random.Random(4)
    base = prose(77, 400)
    texts = [edited(base, r, 0.005) for _ in range(420)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(grouped(spark, texts))) == 1
    assert [x["doc_id"] for x in simhash.deduplicate(frame).collect()] == [0]


def test_links_of_a_large_family_are_few_and_connect_all(spark, monkeypatch):
    """Four hundred texts, most pairs of them candidates and few similar: forests under each variant by
    itself gave 42 links a text, each of which carries two sets of shingles through a join."""
    r = random.Random(6)
    base = prose(78, 150)
    fps = {simhash.fingerprint(edited(base, r, r.uniform(0.003, 0.06)).encode(), simhash.NEAR) for _ in range(400)}
    nodes = sorted(tuple(map(simhash.signed, f)) for f in fps)
    frame = spark.createDataFrame([(n,) for n in nodes], "fp struct<w0:bigint,w1:bigint,w2:bigint>")
    whole = [sum((w & (1 << 64) - 1) << 64 * k for k, w in enumerate(n)) for n in nodes]
    low, high = np.array([(i, j) for i in range(len(nodes)) for j in range(i) if near_linked(whole[i], whole[j])]).T
    want = simhash.joined(low, high, len(nodes))
    for small, large in ((simhash.SMALL, simhash.LARGE), (40, 100)):
        monkeypatch.setattr(simhash, "SMALL", small)
        found = {(tuple(x["a"]), tuple(x["b"])) for x in simhash.links(frame, simhash.NEAR, large).collect()}
        at = {n: k for k, n in enumerate(nodes)}
        a, b = np.array([(at[x], at[y]) for x, y in found]).T
        assert (simhash.joined(a, b, len(nodes)) == want).all()
        assert len(low) > 40 * len(nodes) and len(found) < 12 * len(nodes)


def test_parts_are_one_node():
    """Trees over rows that parts connect already: no link within a part, and the same groups with them."""
    r = np.random.default_rng(9)
    for n in (2, 20, 60):
        fps = np.unique(r.integers(0, 1 << 9, (n, 3)).astype(np.uint64), axis=0)
        n = len(fps)
        key, part = np.zeros(n, np.int64), r.integers(0, 1 + n // 4, n)
        node = simhash.one_node(key, part)
        assert all((node[i] == node[j]) == (i == j or part[i] == part[j] > 0) for i in range(n) for j in range(n))
        assert (simhash.one_node(np.arange(n), part) == np.arange(n)).all()
        low, high = np.triu_indices(n, 1)
        near = simhash.distance(fps[low] ^ fps[high]) <= 9
        own = np.arange(n)
        want = simhash.joined(np.concatenate([low[near], node]), np.concatenate([high[near], own]), n)
        at = {tuple(f): k for k, f in enumerate(fps)}
        a, b = (np.array([at[tuple(f)] for x in side for f in x], dtype=np.int64) for side in simhash.nearest_tree(fps, 9, node))
        assert (node[a] != node[b]).all() and len(a) < len(set(node))
        assert (simhash.joined(np.concatenate([a, node]), np.concatenate([b, own]), n) == want).all()


def test_no_pair_goes_unverified_where_close_candidates_fail(spark):
    """Sixty texts about the limit of similarity: forests of the closest candidates leave groups apart that
    other pairs link (``FORESTS`` alone gave 21 and 20 groups)."""
    for seed, want in ((4, 19), (40, 19)):
        r = random.Random(seed)
        base = [f"w{r.randrange(10**6)}" for _ in range(100)]
        texts = [" ".join(w if r.random() >= 0.02 else f"x{r.randrange(10**6)}" for w in base) for _ in range(60)]
        sets = [near_shingles(t) for t in texts]
        root = list(range(60))
        for i in range(60):
            for j in range(i):
                if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root = [root[j] if x == root[i] else x for x in root]
        got = grouped(spark, texts)
        assert len(set(root)) == want
        assert {frozenset(k for k in range(60) if got[k] == g) for g in got} == {frozenset(k for k in range(60) if root[k] == g) for g in root}


def test_similar_roots_in_blocks():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(1, 30))
        sets = [np.unique(r.integers(0, 14, r.integers(0, 14))) for _ in range(n)]
        root, side = r.integers(0, 6, n), r.integers(0, 2, n)
        links = simhash.similar_roots(root, side, np.concatenate(sets), np.cumsum([len(x) for x in sets]))
        two = len(set(side)) > 1
        near = [(i, j) for i in range(n) for j in range(i) if (side[i] != side[j] or not two) and 9 * len(set(sets[i]) & set(sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
        same = lambda pairs: (lambda a: simhash.joined(a[:, 0], a[:, 1], 6).tolist())(np.array(pairs, dtype=np.int64).reshape(-1, 2))
        assert same(links) == same([(root[i], root[j]) for i, j in near])


def test_trees_of_least_distance():
    """Both ways against trees grown pair by pair from the closest on; ties may fall either way, so the sums count."""
    r = np.random.default_rng(5)
    for n in (1, 2, 9, 60):
        fps = np.unique(r.integers(0, 1 << 9, (n, 3)).astype(np.uint64), axis=0)
        n = len(fps)
        low, high = np.triu_indices(n, 1)
        far = simhash.distance(fps[low] ^ fps[high])
        low, high, far = (v[far <= 11] for v in (low, high, far))
        root, want = list(range(n)), []
        for k in np.argsort(far, kind="stable"):
            a, b = root[low[k]], root[high[k]]
            if a != b:
                root = [a if x == b else x for x in root]
                want.append(int(far[k]))
        a, b = simhash.nearest_tree(fps, 11)
        assert sorted(simhash.distance(x ^ y).item() for x, y in zip(np.concatenate(a)[:, None], np.concatenate(b)[:, None], strict=True)) == want if a else want == []
        own = simhash.nearest_forests(low, high, far, n)
        assert sorted(far[own].tolist())[: len(want)] <= want and len(own) <= simhash.FORESTS * max(n - 1, 0)
        assert (simhash.joined(low[own], high[own], n) == simhash.joined(low, high, n)).all()


def test_empty(spark, empty):
    assert simhash.report(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_a_majority_is_over_half():
    assert simhash.fingerprint(b"a b c d e") == (naive("a b c d e"),) and simhash.fingerprint(b"w")[0] > 0
    assert simhash.fingerprint(None) == simhash.fingerprint(b"") == (0,) and simhash.fingerprint(b" ", simhash.NEAR) == (0, 0, 0)


def test_rows_without_ids_are_one_document(spark, docs):
    nameless = docs.filter("doc_id is null").union(docs.filter("doc_id is null"))
    assert simhash.deduplicate(nameless).count() == 1
    far = nameless.union(docs.filter("doc_id = 10"))
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(far).collect()) == ["10", "None"]


def test_different_texts_without_ids_or_under_one_id_all_stay(spark):
    one, two, three, four, five = (prose(seed, 80) for seed in range(90, 95))
    rows = [(None, one), (None, two), (None, two), (None, three), (1, three), (5, four), (5, one + " " + five), (5, two), (9, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.deduplicate(docs).collect()))
    # ``two`` is both without an id and under 5: the one with an id stays
    assert got == sorted([(0, one), (1, three), (5, four), (5, one + " " + five), (5, two)])
