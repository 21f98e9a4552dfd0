"""Best-fit packing: pattern packing by non-negative least squares.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. The histogram of piece
lengths (at most ``capacity`` numbers) is all that the driver sees. Patterns of one to three lengths
that fill a sequence exactly, or nearly where few do, are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares, rounded, and taken as far as the histogram has
pieces; what is left is packed by best-fit decreasing, again on the histogram. Patterns always make
half of the sequences or more. The plan gives, per length, intervals of ranks; pieces get their rank
in a distributed way and look their place up.

Defined results: a null text is an empty one and makes a piece of the end id alone; the name of a
special token in a text gives that token's id, as the tokenizer has it; repeated documents each get pieces of their own; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm import ranks
from evidoc.llm.common import CACHES, ROWS_PER_STEP, cut, released, values

CAPACITY = 1024
END_ID = 2
#: Chunks of text in a generation of what a Python worker remembers the ids of (about 120 MB).
REMEMBERED = 600_000

#: White space as the tokenizer's pattern has it (Unicode White_Space).
OTHER_SPACE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = " \n" + OTHER_SPACE
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Text that has one of these, or other white space than ASCII's, is not cut at each blank.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x00")
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: What a byte-level pre-tokenizer cuts text into, for characters before ``SETTLED``: all versions of
#: Unicode agree on them. Fixed value but for its white space, spelled out.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r \x85\xa0\p{L}\p{N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
SETTLED = "\u0250"
#: Marks that stand behind words.
MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one
    of those from U+0100 on, in turn."""
    letters = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    for b in range(0x100):
        letters.setdefault(b, chr(0x100 + len([x for x in letters if ord(letters[x]) >= 0x100])))
    return letters


class Memory(dict):
    """Ids of chunks, in two generations: when the younger one is full, in whatever text, it becomes the
    older one, and what is not asked for again goes with that.

    The parts of a new chunk of Latin letters are looked up before the tokenizer's model is asked for them.
    What is a letter beyond is left to the tokenizer's own pre-tokenizer, as versions of Unicode differ. Tokenizers
    that are not byte-level BPE without a prefix or normalizer are asked for whole chunks.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.older = tokenizer, {}
        before = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.model = tokenizer.model if plain and tokenizer.normalizer is None else None
        self.letters = byte_letters()
        self.space = self.letters[0x20]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if self.model is None:
                ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif chunk.isascii() and (core := chunk.rstrip(MARKS))[core[:1] == " " :].isalpha():  # most are, so nothing else is asked
                if len(core) == len(chunk):
                    ids = self.part(self.space + core[1:] if core[0] == " " else core)
                else:
                    ids = self[core] + self[chunk[len(core) :]]
            elif chunk.isascii() or max(chunk) < SETTLED:
                parts = self.parts(chunk)
                ids = self.part(chunk.encode().decode("latin-1").translate(self.letters)) if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
            else:
                ids = b"".join(self.part(word) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk))
        if len(self) >= REMEMBERED:
            self.older = self.copy()
            self.clear()
        self[chunk] = ids
        return ids

    @staticmethod
    def parts(chunk: str) -> list[str]:
        """What PARTS finds; a word with or without common marks behind it is told without it."""
        core = chunk.rstrip(MARKS)
        if core[core[:1] == " " :].isalpha():
            return [core] if len(core) == len(chunk) else [core, chunk[len(core) :]]
        return PARTS.findall(chunk)

    def part(self, letters: str) -> bytes:
        """The ids of a word in byte letters."""
        found = self.model.tokenize(letters)
        return array("I", [t.id for t in found]).tobytes() if sys.byteorder == "little" else np.array([t.id for t in found], dtype="<u4").tobytes()


_memories: dict[str, Memory] = {}
CACHES.append(_memories)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer never joins a non-space to a space after it, so a text's ids are
    those of its chunks (white space and the word behind it) in turn; chunks that came before are
    remembered until the Python worker gets a task of something else. A text that has the name of one of the
    tokenizer's added tokens goes to the tokenizer whole.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        if tokenizer_path not in _memories:
            _memories[tokenizer_path] = Memory(Tokenizer.from_file(tokenizer_path))
        self.memory = _memories[tokenizer_path]
        self.tokenizer = self.memory.tokenizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    @staticmethod
    def chunks(text: str) -> list[str]:
        if any(x in text for x in UNEVEN) or not text.isascii() and WIDE_SPACE.search(text):
            return CHUNK.findall(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.memory.__getitem__, self.chunks(text))) if text else b""


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``with_ids`` adds the ids."""
    schema = T.StructType(PIECES.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer_path)
        gc.disable()  # nothing below refers to itself, and the collector would walk all that is remembered
        try:
            yield from cut_up(encoder, batches)
        finally:
            gc.enable()

    def cut_up(encoder, batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(lo, ROWS_PER_STEP)
                rows: list[list] = [[], [], [], [], []]
                ids = []
                for doc, text in zip(part.column(0).to_pylist(), values(part.column(1)), strict=True):
                    raw = encoder.encode((text or b"").decode()) + end
                    for k, (s, n) in enumerate(cut_points(len(raw) // 4, capacity)):
                        own = raw[4 * s : 4 * (s + n)]
                        for col, v in zip(rows, (doc, k, s, n, zlib.crc32(own)), strict=True):
                            col.append(v)
                        if with_ids:
                            ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                cols = [pa.array(c, type=t) for c, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
                if with_ids:
                    cols.append(pa.array(ids, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run, remembers=True), schema)


# --- the plan: patterns, least squares, rounding, residuals -----------------------------------


#: Triples and pairs that each length is the longest of, at least, where sequences cannot be filled exactly.
NEAR, PAIRS = 64, 32
#: What a sequence's free tokens cost in the fit, as a share of the mean count per length.
FREE_COST = 2.0
#: What a sequence's third document costs in the fit, as a share of the mean count per length: short
#: documents are kept for what only they can fill.
THIRD_COST = 0.3
#: Full sequences of fitted patterns that are packed anew with the sequences that are not full, as
#: multiples of the latter's number; the fewest sequences win.
RELEASED = (0.0, 0.25, 0.5, 1.0)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sorted length triples (0: unused) from ``lengths`` that fill ``capacity``: exactly, and, for a
    longest length with fewer than ``NEAR`` such triples, the nearest ones below and ``PAIRS`` pairs."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    below = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))  # the largest length up to each
    found = []
    for a in np.flatnonzero(have[1:]) + 1:
        b = np.flatnonzero(have[: min(a, capacity - a) + 1])
        c = below[np.minimum(b, capacity - a - b)]
        free = capacity - a - b - c
        exact = int((free == 0).sum())
        keep = np.argsort(free, kind="stable")[: max(NEAR, exact)]
        found.append(np.stack([np.full(len(keep), a), b[keep], c[keep]], axis=1))
        if exact < NEAR:  # the longest pairs too: a third document may be worth more elsewhere
            pair = b[-PAIRS:]
            found.append(np.stack([np.full(len(pair), a), pair, np.zeros_like(pair)], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


def fit(table: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - h|, and a little the tokens left free and the third
    documents, by accelerated projected gradients.

    Column p of A counts how often pattern p has each length; ``histogram[0]`` must be 0.
    """
    if not len(table):
        return np.zeros(0)
    flat, used = table.ravel(), (table > 0).ravel()
    size = len(histogram)
    free = 1 - table.sum(axis=1) / (size - 1)
    mean = histogram.sum() / max(1, np.count_nonzero(histogram))
    cost = mean * (FREE_COST * free + THIRD_COST * ((table > 0).sum(axis=1) > 2))

    def forward(x):
        return np.bincount(flat, weights=np.repeat(x, 3) * used, minlength=size)

    def backward(r):
        return (r[flat] * used).reshape(-1, 3).sum(axis=1)

    v = np.ones(len(table))
    for _ in range(30):  # the largest eigenvalue of A'A bounds the step
        v = backward(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(backward(forward(v))))
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (backward(forward(y) - histogram) + cost))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole counts whose running sums stay within a half of those of ``x``."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)


def best_fit_decreasing(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(contents, bins) of best-fit decreasing, on counts: bins of equal contents move together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    room = 0  # bit r: a bin with r free tokens is open
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            fits = room >> length
            if fits:
                free = length + (fits & -fits).bit_length() - 1
                content, bins = open_bins[free].pop()
                if not open_bins[free]:
                    room &= ~(1 << free)
            else:
                free, content, bins = capacity, (), count
            each = free // length
            full = min(bins, count // each)
            made = [((content + (length,) * each), full, free - each * length)]
            count -= full * each
            bins -= full
            if bins and count:
                some = min(count, each)
                made.append((content + (length,) * some, 1, free - some * length))
                count -= some
                bins -= 1
            if content:
                made.append((content, bins, free))
            for c, n, f in made:
                if n:
                    open_bins[f].append((c, n))
                    room |= 1 << f
    return [x for own in open_bins.values() for x in own]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences), which use the histogram up exactly."""
    fitted, residual = plan_parts(histogram, capacity)
    return fitted + residual


def plan_parts(histogram: dict[int, int], capacity: int = CAPACITY):
    """The plan's sequences of fitted patterns, and those of residuals.

    Patterns are taken as often as their rounded counts say and pieces allow; best fit packs the rest.
    Rounding leaves long pieces without the short ones that would fill them up, so pieces of sequences
    that are not full are packed anew together with those of some full ones, the ones with the
    shortest pieces first, for each amount of ``RELEASED`` that leaves patterns half of the sequences.
    """
    h = np.zeros(capacity + 1)
    for length, count in histogram.items():
        h[length] = count
    alone = [((capacity,), int(h[capacity]))] if h[capacity] else []
    h[capacity] = 0
    table = patterns(np.flatnonzero(h), capacity)
    fitted, left = _filled(table, rounded(fit(table, h)), h.astype(np.int64), capacity)
    best = fitted, best_fit_decreasing(left, capacity)
    full = sorted((x for x in fitted if sum(x[0]) == capacity), key=lambda x: (min(x[0]), x))
    short = sum(n for content, n in (*best[0], *best[1]) if sum(content) < capacity)
    for share in RELEASED[1:]:
        kept, open_, most = [], defaultdict(int, left), int(share * short)
        for content, n in [*full, *(x for x in fitted if sum(x[0]) < capacity)]:
            gone = min(n, most) if sum(content) == capacity else n
            most -= gone if sum(content) == capacity else 0
            for v in content:
                open_[v] += gone
            kept += [(content, n - gone)] if n > gone else []
        made = kept, best_fit_decreasing({v: n for v, n in open_.items() if n}, capacity)
        some, every = _count(made[0]), _count(made[0]) + _count(made[1])
        if 2 * some >= every and every < _count(best[0]) + _count(best[1]):
            best = made
    return alone + best[0], best[1]


def _count(made: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(n for _, n in made)


def _filled(table: np.ndarray, wanted: np.ndarray, left: np.ndarray, capacity: int):
    """Patterns as often as ``wanted`` and as the pieces ``left`` allow, and the pieces left then."""
    out = []
    free = capacity - table.sum(axis=1)
    for k in np.lexsort((-wanted, free)):  # the fullest first, of these the most frequent
        if not wanted[k]:
            continue
        own = [int(v) for v in table[k] if v]
        times = min(int(wanted[k]), *(int(left[v]) // own.count(v) for v in own))
        if times > 0:
            out.append((tuple(own), times))
            for v in own:
                left[v] -= times
    return out, {int(v): int(left[v]) for v in np.flatnonzero(left)}


class Places:
    """Per length, which interval of ranks goes to which sequences and at which offset."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        first = 0
        for content, times in made:
            offset = 0
            for length in content:
                rows[length].append((taken[length], first, offset))
                taken[length] += times
                offset += length
            first += times
        self.sequences = first
        self.rows = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
        for v in np.unique(length):
            at = np.flatnonzero(length == v)
            starts, firsts, offsets = self.rows[int(v)]
            k = np.searchsorted(starts, rank[at], side="right") - 1
            sequence[at] = firsts[k] + rank[at] - starts[k]
            offset[at] = offsets[k]
        return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    made = cut(pieces(docs, tokenizer_path, capacity))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(plan(histogram, capacity))
    cells = [1 + histogram.get(v, 0) // ranks.CELL_ROWS for v in range(capacity + 1)]
    dealt = F.xxhash64("doc_id", "piece", "ids_crc32")
    number = F.element_at(F.array(*map(F.lit, cells)), (F.col("length") + 1).cast("int"))
    ranked = ranks.within(
        made.withColumn("__cell", F.pmod(dealt, number)), ["length"], "__cell", [F.col("doc_id"), F.col("piece")], "__rank"
    ).drop("__cell")
    schema = T.StructType(PIECES.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            own = [b.column(b.schema.get_field_index(c)) for c in PIECES.names]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, places.look_up(length, rank))], names=schema.names)

    return ranked.mapInArrow(released(run, remembers=True), schema)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and doc_ids and offsets of their pieces."""
    ids = pieces(docs, tokenizer_path, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    placed = pack(docs, tokenizer_path, capacity).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset")
    # Repeated documents have the same ids, so one copy of a piece's ids serves all its places.
    joined = placed.join(ids.dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        joined.groupBy("sequence_id")
        .agg(rows.alias("rows"))
        .select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"))
    )
