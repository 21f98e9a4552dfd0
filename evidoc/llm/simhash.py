"""SimHash near-dedup by deletion-variant signatures.

A fingerprint has a bit set where over half of the hashes of a text's word shingles have it set.
Fingerprints that differ in at most ``Scheme.bits`` bits are linked. A fingerprint is cut into few
segments, so that one of them differs by at most one bit: every distinct fingerprint is indexed under
each segment with each one of its bits cleared (a one-wildcard variant), fingerprints under an equal
variant meet, and the full distance is verified.

``EXACT`` (64 bits of XXH64, 4-word shingles with repeats, up to 4 bits, 3 segments) misses no link: of
4 differing bits some segment has at most one. ``NEAR`` finds candidates for texts whose sets of 5-word
shingles have a Jaccard similarity of 0.8 or more: 192 bits, of which texts of exactly 0.8 differ in 29
on average, 11 segments of 17 or 18 bits. A candidate is found if some segment differs by at most one
bit, which is likely, not certain; the README states the recall by similarity. Candidates become
links only if the similarity of their sets of shingles, which is then worked out, is 0.8 or more. Forests
of the closest candidates are verified first; where one of these fails, all texts that candidates connect
are compared exactly (``missed``), so none goes unverified.

Only distinct fingerprints are indexed, so copies cost nothing. Up to ``SMALL`` fingerprints under
a variant are compared with each other, each pair under the first variant it shares; more of them are
searched breadth first. Either way a variant gives a spanning forest, fewer links than fingerprints,
so groups of near copies do not give their pairs: under ``EXACT`` each to the smallest fingerprint of its
tree, under ``NEAR`` those of least distance, as every link is to be verified and the closest texts are
the likeliest to pass. Beyond ``LARGE`` they are cut into blocks, and each pair of blocks is such a group
of its own.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
texts of fewer words than a shingle have their whole word sequence as the one shingle; a repeated
row gets a row of its own; rows with a null id never name a component unless all its ids are null;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import cut, fresh, join_counted, per_row, released, row_key, signed
from evidoc.llm.components import components, joined

SEED = 42
#: Fingerprints under one variant that are compared pair by pair, and that one task may search.
SMALL, LARGE = 256, 20_000


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints of some 64-bit words, and which of these are linked: in stars, or
    by trees of least distance (``nearest``). ``first`` segments are searched before the others, whose
    search then leaves out pairs that links of the first ones connect."""

    words: int
    shingle: int
    bits: int
    segments: tuple[tuple[tuple[int, int, int], ...], ...]  # pieces (word, lowest bit, width) of each
    nearest: bool = False
    first: int = 0

    def widths(self) -> list[int]:
        return [sum(w for _, _, w in own) for own in self.segments]


def cut_up(words: int, count: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """``count`` segments over all bits of ``words`` words, as even as can be."""
    edges = [64 * words * k // count for k in range(count + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        out.append(tuple((w, max(lo - 64 * w, 0), min(hi, 64 * w + 64) - max(lo, 64 * w)) for w in range(words) if lo < 64 * w + 64 and hi > 64 * w))
    return tuple(out)


EXACT = Scheme(1, 4, 4, cut_up(1, 3))
NEAR = Scheme(3, 5, 44, cut_up(3, 11), nearest=True, first=1)
#: The least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Edge-disjoint forests of least distance that a small group gives.
FORESTS = 2
#: Shingles of the texts in a block, of which each two meet in a task.
BLOCK = 200_000


def shingle_hashes(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 of each shingle of a text's words, in order."""
    words = text.lower().split() if text else []  # bytes: only A-Z fold, only 0x09-0x0D and 0x20 part
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(whole, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of 64-bit hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65_536):
        own = hashes[lo : lo + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def second(h: np.ndarray) -> np.ndarray:
    """Another 64 bits for each hash or its last ones: two rounds of multiply and fold."""
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = h * np.uint64(odd)
        h = h ^ (h >> np.uint64(32))
    return h


def fingerprint(text: bytes | None, scheme: Scheme = EXACT) -> tuple[int, ...]:
    """The words of a text's fingerprint. Schemes of one word count repeated shingles as often as they
    stand, those of two words once, as the similarity of sets does."""
    hashes = np.array(shingle_hashes(text, scheme.shingle), dtype=np.uint64)
    if scheme.words == 1:
        return (majority(hashes),)
    hashes = np.unique(hashes)
    out = [majority(hashes)]
    for _ in range(scheme.words - 1):
        hashes = second(hashes)
        out.append(majority(hashes))
    return tuple(out)


WORDS = ("w0", "w1", "w2")


def fingerprints(docs: DataFrame, keep: list[str], scheme: Scheme = EXACT, text: str = "text") -> DataFrame:
    """Columns ``keep`` of every document and its fingerprint ``fp``: a long, or a struct of longs."""
    names = [fresh(keep, n) for n in WORDS[: scheme.words]]

    def make():
        return lambda texts: list(zip(*[map(signed, fingerprint(t, scheme)) for t in texts], strict=True)) or [[]] * len(names)

    rows = per_row(docs, keep, [text], [(n, T.LongType()) for n in names], make)
    return rows.select(*[f"`{c}`" for c in keep], (F.struct(*[F.col(n).alias(w) for n, w in zip(names, WORDS, strict=False)]) if scheme.words > 1 else F.col(names[0])).alias("fp"))


def word(fp: Column, scheme: Scheme, k: int) -> Column:
    return fp[WORDS[k]] if scheme.words > 1 else fp


def variants(fps: DataFrame, scheme: Scheme = EXACT, wanted: slice = slice(None)) -> DataFrame:
    """``fp`` (and other columns) under its one-wildcard keys in the segments ``wanted``: wildcard bit
    (``bit``, numbered through all segments), and segment value with it cleared. Segments become rows
    first and bits after them: an expression for each bit makes code that takes some 250 MB of the
    driver's heap to compile."""
    segments, number = [], 0
    mask = lambda n: F.lit((1 << n) - 1).cast("long")
    for pieces in scheme.segments:
        value, width = F.lit(0).cast("long"), 0
        for w, lo, n in pieces:
            own = F.shiftrightunsigned(word(F.col("fp"), scheme, w), lo).bitwiseAND(mask(n))
            value, width = value.bitwiseOR(F.shiftleft(own, width)), width + n
        segments.append(F.struct(value.alias("value"), F.lit(number).alias("first"), F.lit(number + width - 1).alias("last")))
        number += width
    rows = fps.select(*fps.columns, F.inline(F.array(*segments[wanted])))
    bits = rows.select(*fps.columns, "value", "first", F.explode(F.sequence("first", "last")).alias("bit"))
    wildcard = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") - F.col("first"))
    bit = F.col("bit").cast("long")
    key = F.col("value").bitwiseAND(F.bitwise_not(wildcard)).bitwiseOR(F.shiftleft(bit, 40))
    return bits.select(*fps.columns, key.alias("key"), bit.alias("bit"))


def distance(x: np.ndarray) -> np.ndarray:
    """Set bits of each row of words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def first_shared(x: np.ndarray, bit: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Whether ``bit`` is the wildcard of the first variant that two fingerprints share, given the
    bits ``x`` in which they differ: the differing bit, or the lowest, of the first segment that
    differs by at most one bit."""
    ok = np.zeros(len(x), dtype=bool)
    open_ = np.ones(len(x), dtype=bool)
    number = 0
    for pieces in scheme.segments:
        own, width = np.zeros(len(x), dtype=np.uint64), 0
        for w, lo, n in pieces:
            own |= ((x[:, w] >> np.uint64(lo)) & np.uint64((1 << n) - 1)) << np.uint64(width)
            width += n
        here = open_ & (np.bitwise_count(own) <= 1)
        place = np.where(own == 0, 0, np.bitwise_count(own - np.uint64(1))).astype(np.int64)
        ok |= here & (number + place == bit)
        open_ &= ~here
        number += width
    return ok


def forest(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of ``fps`` under the distance, by breadth-first search."""
    a, b = [], []
    rest = fps
    while len(rest):
        seen, rest = rest[:1], rest[1:]
        k = 0
        while k < len(seen) and len(rest):
            near = distance(rest ^ seen[k]) <= bits
            if near.any():
                found = rest[near]
                a.append(np.repeat(seen[:1], len(found), axis=0))  # all of a tree is linked to its root
                b.append(found)
                seen = np.concatenate([seen, found])
                rest = rest[~near]
            k += 1
    return a, b


def one_node(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each row the first one that has its key and its part; a part of zero is each row's own."""
    first, rows = np.arange(len(key)), np.flatnonzero(part)
    if len(rows):
        rows = rows[np.lexsort((part[rows], key[rows]))]
        new = np.concatenate([[True], (np.diff(key[rows]) != 0) | (np.diff(part[rows]) != 0)])
        first[rows] = rows[new][np.cumsum(new) - 1]
    return first


def nearest_tree(fps: np.ndarray, bits: int, part: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest of least distances, grown node by node. Rows of the same ``part`` are
    linked already."""
    part = np.arange(len(fps)) if part is None else part
    left, place, mine = fps[1:].copy(), np.arange(1, len(fps)), part[1:].copy()
    best, by = np.full(len(left), 64 * fps.shape[1] + 1), np.zeros(len(left), dtype=np.int64)
    own, a, b = 0, [], []
    for n in range(len(left), 0, -1):
        far = distance(left[:n] ^ fps[own])
        closer = np.flatnonzero(far < best[:n])
        best[closer], by[closer] = far[closer], own
        best[:n][mine[:n] == part[own]] = -1
        k = int(best[:n].argmin())
        own = int(place[k])
        if 0 <= best[k] <= bits:
            a.append(by[k])
            b.append(own)
        for column in (left, place, mine, best, by):
            column[k] = column[n - 1]
    return ([fps[a]], [fps[b]]) if a else ([], [])


def nearest_forests(low: np.ndarray, high: np.ndarray, far: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs make forests of least distance: each tree takes its shortest pair to another
    until none is left, and each further forest is made of pairs that earlier ones have not."""
    taken = np.zeros(len(low), dtype=bool)
    order = np.argsort(far, kind="stable")
    for _ in range(FORESTS):
        open_ = order[~taken[order]]
        root, mine = np.arange(n), np.zeros(len(low), dtype=bool)
        while True:
            open_ = open_[root[low[open_]] != root[high[open_]]]
            if not len(open_):
                break
            first = np.full(n, len(open_))
            for side in (low, high):
                np.minimum.at(first, root[side[open_]], np.arange(len(open_)))
            mine[open_[np.unique(first[first < len(open_)])]] = True
            root = joined(low[mine], high[mine], n)
        taken |= mine
    return np.flatnonzero(taken)


def _links(sorted_rows: DataFrame, scheme: Scheme, large: int | None) -> DataFrame:
    """Links of rows (key, bit, fp) that come sorted by key and fp. A group of over ``large`` gives a row
    with its key and size instead. Rows may have a ``part``, within which all is linked already."""
    names = WORDS[: scheme.words]
    held = ["part"] if "part" in sorted_rows.columns else []
    ends = [f"{side}{n}" for side in "ab" for n in names]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*ends, "key", "n")])

    def pairs(key, bit, fp, part):
        """Links of small groups: all pairs are compared, and of each tree they make every node is
        linked to the first, or the closest pairs are taken, so a group never gives more links than
        it has rows (in each forest)."""
        a, b, d = [], [], []
        node = one_node(key, part)
        for lag in range(1, SMALL):
            same = np.flatnonzero(key[lag:] == key[:-lag]) if len(key) > lag else ()
            if not len(same):
                break
            same = same[node[same] != node[same + lag]]
            x = fp[same] ^ fp[same + lag]
            far = distance(x)
            ok = far <= scheme.bits
            ok[ok] = first_shared(x[ok], bit[same][ok], scheme)
            a.append(same[ok])
            b.append(same[ok] + lag)
            d.append(far[ok])
        if not sum(map(len, a)):
            return [], []
        low, high = np.concatenate(a), np.concatenate(b)
        if scheme.nearest:
            own = nearest_forests(node[low], node[high], np.concatenate(d), len(key))
            return [fp[low[own]]], [fp[high[own]]]
        first = joined(low, high, len(key))
        own = np.flatnonzero(first != np.arange(len(key)))
        return [fp[first[own]]], [fp[own]]

    def batch(a, b, key=(), n=()):
        a, b = (np.concatenate(v).view(np.int64) if v else np.zeros((0, scheme.words), np.int64) for v in (a, b))
        cols = [pa.array(np.ascontiguousarray(side[:, k])) for side in (a, b) for k in range(scheme.words)]
        none, gone = pa.nulls(len(a), pa.int64()), pa.nulls(len(key), pa.int64())
        cols = [pa.concat_arrays([c, gone]) for c in cols] + [pa.concat_arrays([none, pa.array(v, pa.int64())]) for v in (key, n)]
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    def groups(key, bit, fp, part):
        """Whole groups: the small ones at once, the others one by one."""
        if not len(key):
            return
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        big = np.flatnonzero(ends - starts > SMALL)
        keep = np.ones(len(key), dtype=bool)
        for k in big:
            s, e = starts[k], ends[k]
            keep[s:e] = False
            if large is not None and e - s > large:
                yield batch([], [], [int(key[s])], [int(e - s)])
            else:
                yield batch(*(nearest_tree(fp[s:e], scheme.bits, one_node(key[s:e], part[s:e])) if scheme.nearest else forest(fp[s:e], scheme.bits)))
        yield batch(*pairs(key[keep], bit[keep], fp[keep], part[keep]))

    def run(batches):
        rest = None  # rows of the last group so far
        over = 0  # rows of it that were dropped, once it is too large
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]
            own = [cols[0], cols[1], np.stack(cols[2 : 2 + scheme.words], axis=1).view(np.uint64), cols[-1] if held else np.zeros(len(cols[0]), np.int64)]
            if rest is not None:
                own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if not len(own[0]):
                continue
            last = int(np.searchsorted(own[0], own[0][-1]))
            if last and over:
                head = int(np.searchsorted(own[0], own[0][0], side="right"))
                yield batch([], [], [int(own[0][0])], [over + head])
                own, last, over = [x[head:] for x in own], last - head, 0
            yield from groups(*[x[:last] for x in own])
            rest = [x[last:] for x in own]
            if large is not None and len(rest[0]) > large:
                over += len(rest[0]) - 1
                rest = [x[-1:] for x in rest]
        if rest is not None and len(rest[0]):
            if over:
                yield batch([], [], [int(rest[0][0])], [over + len(rest[0])])
            else:
                yield from groups(*rest)

    made = sorted_rows.select("key", "bit", *[word(F.col("fp"), scheme, k).alias(n) for k, n in enumerate(names)], *[F.coalesce(c, F.lit(0).cast("long")) for c in held]).mapInArrow(released(run), schema)
    fp = lambda side: (F.struct(*[F.col(f"{side}{n}").alias(n) for n in names]) if scheme.words > 1 else F.col(f"{side}w0")).alias(side)
    return made.select(fp("a"), fp("b"), "key", "n")


def searched(fps: DataFrame, scheme: Scheme, own: slice, large: int) -> DataFrame:
    """Links ``a``, ``b`` under the variants of the segments ``own``."""
    keyed = variants(fps, scheme, own)
    found = cut(_links(keyed.repartition("key").sortWithinPartitions("key", "fp"), scheme, large))
    made = found.filter("key is null").select("a", "b")
    over = found.filter("key is not null").select("key", "n")
    if over.isEmpty():
        return made
    # Groups too large for a task: blocks of about half of one's size; each two blocks meet in a group.
    blocks = F.ceil(F.col("n") * 2 / F.lit(large)).cast("long")
    dealt = keyed.join(over.withColumn("__blocks", blocks).drop("n"), "key").withColumn("__own", F.pmod(F.xxhash64("fp"), F.col("__blocks")))
    other = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    meet = F.xxhash64("key", F.least("__own", "__other"), F.greatest("__own", "__other"))
    # A chance collision of two groups' hashes joins them; the distance is verified all the same.
    again = other.select(meet.alias("key"), "bit", *fps.columns).distinct()
    return made.union(_links(again.repartition("key").sortWithinPartitions("key", "fp"), scheme, None).select("a", "b"))


def links(fps: DataFrame, scheme: Scheme = EXACT, large: int = LARGE) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``), with the components of all
    pairs that share a variant and differ in at most ``scheme.bits`` bits.

    A large family gives a forest under each variant, some hundred links a fingerprint. So where the
    scheme has ``first`` segments, what their links connect is one node (``part``) to all later variants.
    """
    if not scheme.first:
        return searched(fps, scheme, slice(None), large)
    made = cut(searched(fps, scheme, slice(scheme.first), large).distinct())
    parts = components(made, "a", "b")
    # Two parts of one 64-bit hash would have to be candidates of each other to lose a link.
    held = fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", F.when(F.col("root").isNotNull(), F.xxhash64("root")).alias("part"))
    return made.union(searched(held, scheme, slice(scheme.first, None), large))


def rooted(nodes: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """``nodes``, which has each fingerprint ``fp`` once, and the ``root`` of its component."""
    roots = components(links(nodes.select("fp"), scheme), "a", "b")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "fp").alias("root"))


def group(docs: DataFrame, keep: list[str], scheme: Scheme = EXACT) -> DataFrame:
    """Columns ``keep`` (``doc_id`` among them), ``fp`` and ``component_id``, the smallest doc_id
    that links reach."""
    marked = cut(fingerprints(docs, keep, scheme))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    named = cut(rooted(nodes, scheme))
    lowest = cut(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    fps, rows = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    ids = cut(join_counted(named, lowest, "root", "fps", fps).select("fp", "component_id", "rows"))
    return join_counted(marked, ids, "fp", "rows", rows).drop("rows")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return group(docs, ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(rows: DataFrame, keep: list[str], scheme: Scheme) -> DataFrame:
    """Columns ``keep`` and ``shingles``, the distinct hashes of a text's shingles."""

    def make():
        return lambda texts: [[np.unique(np.array(shingle_hashes(t, scheme.shingle), dtype=np.uint64)).view(np.int64) for t in texts]]

    return per_row(rows, keep, ["text"], [("shingles", T.ArrayType(T.LongType()))], make)


def candidate_sets(candidates: DataFrame, texts: DataFrame, nodes: DataFrame, scheme: Scheme = NEAR) -> DataFrame:
    """``fp`` and ``shingles`` of the fingerprints in candidates ``a``, ``b``. ``texts`` has ``key`` and
    ``text``, ``nodes`` the key of one text of each fingerprint ``fp``. Only texts with a candidate are
    shuffled."""
    ends = candidates.select(F.col("a").alias("fp")).union(candidates.select("b")).distinct()
    wanted = nodes.join(ends, "fp", "left_semi")
    own = texts.join(wanted, "key").dropDuplicates(["key"])
    return cut(shingle_sets(own, ["fp"], scheme))


def compared(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates ``a``, ``b`` once each, and ``ok``, whether their texts have a similarity of ``SIMILAR``
    or more."""
    side = lambda end: sets.select(F.col("fp").alias(end), F.col("shingles").alias(f"s{end}"))
    rows = candidates.distinct().join(side("a"), "a").join(side("b"), "b")
    least, of = SIMILAR
    low, both = F.least(F.size("sa"), F.size("sb")), F.size("sa") + F.size("sb")
    # common / (both - common) >= least / of; the smaller set bounds what is common
    can = low * (least + of) >= both * least
    ok = F.when(can, F.size(F.array_intersect("sa", "sb")) * (least + of) >= both * least).otherwise(F.lit(False))
    return rows.select("a", "b", ok.alias("ok"))


def similar_roots(root: np.ndarray, side: np.ndarray, shingles: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of roots that texts of a similarity of ``SIMILAR`` or more link. Texts of side 0 meet those
    of side 1, or all meet all if there is one side only; text k has the shingles up to ``ends[k]``."""
    least, of = SIMILAR
    root, links = root.copy(), []
    starts = np.concatenate([[0], ends[:-1]])
    words = np.unique(shingles, return_inverse=True)[1]
    there = np.zeros(words.max(initial=0) + 1, dtype=bool)
    sizes = ends - starts
    most = np.bincount(root).argmax()  # pairs within it are none
    halves = []
    for k in np.unique(side):
        rows = np.flatnonzero(side == k)
        halves.append((rows, np.concatenate([words[starts[r] : ends[r]] for r in rows]), np.concatenate([[0], np.cumsum(sizes[rows])])))
    for k, (mine, _, _) in enumerate(halves):
        rows, of_rows, edges = halves[1 - k] if len(halves) > 1 else halves[0]
        for i in mine[root[mine] != most]:
            if (root[rows] == root[i]).all():
                continue
            own = words[starts[i] : ends[i]]
            there[own] = True
            common = np.diff(np.concatenate([[0], np.cumsum(there[of_rows])])[edges])
            there[own] = False
            near = rows[(common * (least + of) >= (sizes[rows] + sizes[i]) * least) & (root[rows] != root[i])]
            for other in np.unique(root[near]):
                links.append((int(root[i]), int(other)))
            # From here on these roots are one; the largest keeps its name, as it is left out above.
            joined_up = np.unique(np.append(root[near], root[i]))
            root[np.isin(root, joined_up)] = most if most in joined_up else joined_up[0]
    return links


def missed(named: DataFrame, failed: DataFrame, sets: DataFrame, scheme: Scheme = NEAR) -> DataFrame:
    """Links ``a``, ``b`` between roots that the forests' verified links leave apart although texts under
    them have a similarity of ``SIMILAR`` or more.

    ``named`` has the root of each fingerprint with a candidate, ``failed`` the candidates whose texts are
    less similar. Forests span all candidates, so two roots with any candidate between them are linked by
    failed ones: these make clusters of roots, and within a cluster all texts of different roots are
    compared, in blocks of about ``BLOCK`` shingles of which each two meet in a task. Clusters of two
    texts have no other pair than the failed one.
    """
    end = lambda e: named.select(F.col("fp").alias(e), F.col("root").alias(f"r{e}"))
    apart = cut(failed.join(end("a"), "a").join(end("b"), "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    clusters = components(apart, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    members = cut(named.join(clusters, "root").join(sets, "fp").select("cluster", "root", "fp", "shingles"))
    weigh = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("shingles")).alias("shingles")).filter("texts > 2")
    blocks = weigh.select("cluster", F.ceil(F.col("shingles") / F.lit(BLOCK)).cast("long").alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = other.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "root", "shingles")
    names = WORDS[: scheme.words]
    schema = T.StructType([T.StructField(f"{e}{n}", T.LongType()) for e in "ab" for n in names])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        struct, lists = (rows.column(c).combine_chunks() for c in ("root", "shingles"))
        found, root = np.unique(np.stack([struct.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1), axis=0, return_inverse=True)
        own, low = (rows.column(c).to_numpy() for c in ("own", "low"))
        sizes = lists.value_lengths().to_numpy()
        made = similar_roots(root.reshape(-1), (own != low).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
        a, b = (found[[x[k] for x in made]].reshape(-1, len(names)) for k in (0, 1))
        return pa.table([pa.array(np.ascontiguousarray(v[:, k]), pa.int64()) for v in (a, b) for k in range(len(names))], names=schema.names)

    made = meet.groupBy("cluster", "low", "high").applyInArrow(run, schema)
    return made.select(*[F.struct(*[F.col(f"{e}{n}").alias(n) for n in names]).alias(e) for e in "ab"]).distinct()


def near_roots(docs: DataFrame, scheme: Scheme = NEAR) -> DataFrame:
    """``fp``, ``first`` (the order and key of its first row) and ``root`` of each distinct fingerprint.

    Texts of equal fingerprints are one node, shown by its first text: 192 bits agree by chance only
    where hardly a shingle differs (for a similarity of 0.8 once in some 10^13 pairs).
    """
    texts = docs.select("doc_id", "text", row_key().alias("key"))
    marked = fingerprints(texts, ["doc_id", "key"], scheme)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    nodes = cut(marked.groupBy("fp").agg(F.min(order).alias("first")))
    candidates = cut(links(nodes.select("fp"), scheme))
    sets = candidate_sets(candidates, texts.select("key", "text"), nodes.select("fp", "first.key"), scheme)
    pairs = cut(compared(candidates, sets))
    roots = components(pairs.filter("ok"), "a", "b")
    linked = sets.select("fp")
    named = cut(linked.join(roots, linked["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))
    later = components(missed(named, pairs.filter("not ok").select("a", "b"), sets, scheme), "a", "b").withColumnRenamed("root", "last")
    every = named.join(later, named["root"] == later["node"], "left").select("fp", F.coalesce("last", "root").alias("root"))
    return nodes.join(every, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame, scheme: Scheme = NEAR) -> DataFrame:
    """One document, with all columns, of each component: that of the smallest doc_id (none comes
    last), and of several texts under that id the one of the smallest digest.

    An id names no text by itself: rows of different texts under one id, or without ids, stay or go
    by their own components. Rows of the same id and text are one document. Every document that goes
    has a text of similarity 0.8 or more in its component.
    """
    keep = list(docs.columns)
    named = near_roots(docs, scheme)
    name, own = fresh(keep, "__kept"), fresh(keep, "__row")
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(name))

    def kept(rows: DataFrame) -> DataFrame:
        return rows.join(chosen, rows[own] == chosen[name], "left_semi")

    rows = docs.withColumn(own, row_key())
    # The join and the dropping of repeated rows share one shuffle. Rows without ids can repeat
    # without end, so theirs are dropped before it too.
    with_id = kept(rows.filter("doc_id is not null")).dropDuplicates([own])
    without = kept(rows.filter("doc_id is null").dropDuplicates([own]))
    return with_id.unionByName(without).select(*[f"`{c}`" for c in keep])
