"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text is built. A text is parsed against each automaton
into phrases, each the longest match that the language's text has for what follows; a language that
is the text's own needs few phrases. The number of phrases times log2 of the length of the longest
labelled text, over the length of the text, estimates the cross entropy in bits a character; the
language with the lowest estimate wins. All languages share that one scale, and a letter that a
language lacks is a phrase, so a language with little labelled text has no cheaper phrases.

Texts are lower-cased and runs of anything but letters become one blank. Whole texts are parsed. With
numpy, blocks of ``BLOCK`` characters are first parsed side by side, each from its own start; then
each is entered where the phrase that reaches into it ends, and parsed anew up to the first phrase
that both parses begin at the same place, so the phrases are those of one parse from the text's
start. Labelled text is a bounded sample: ``SAMPLE_DOCS`` documents a language by the smallest
hash of their ids among texts with a letter, ``SAMPLE_CHARS`` characters a language in all, in
pieces of ``PIECE`` characters or more by the hash of their places in the whole texts. Words of a
``WINDOW``-word passage that several documents share are learned once, and not at all where the
documents have different languages and other words.

``keep_known`` drops documents whose best language still needs a phrase for less than ``MIN_PHRASE``
characters on average: no learned language is theirs.

Defined results: null text and text without a letter are ``und`` with score 0; ties go to the
language whose name sorts first; with no labelled row everything is ``und``; labels outside
``documents.lang`` (null) are not learned from; a repeated row gets a row of its own; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import cut, fresh, per_row

SAMPLE_DOCS = 64
SAMPLE_CHARS = 12_000
BLOCK = 256
#: Characters that a task parses side by side, which bounds the arrays that it holds.
AT_ONCE = 1 << 19
PIECE, WINDOW = 192, 8
#: Free slots that are tried for a state's transitions before new ones are taken.
TRIES = 64
#: Mean characters of a phrase below which a text is in none of the learned languages. A script that
#: no labelled text has costs a phrase a letter; prose of a learned language has phrases of five.
MIN_PHRASE = 2.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def letters_only(text: str) -> str:
    """Lower-case letters; runs of anything else are one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    to: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return to


def interleaved(states: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (letter code -> state) with the rows of all states pushed into each other: the
    transition of state s under c, if any, is in slot ``base[s] + c``, and ``owner`` tells whose it is.

    States of many transitions take their slots first; the many states of one fill what is left
    between. Slots grow with the transitions, not with states times letters.
    """
    base = np.zeros(len(states), dtype=np.int64)
    taken, free = bytearray(b"\1" * width), width  # the first slots are no one's, so no base is negative
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        if not states[s]:
            break  # its base is 0, where nothing is owned
        low, *others = sorted(states[s])
        gaps = [c - low for c in others]
        at = free
        for _ in range(TRIES):
            at = taken.find(b"\0", at)
            if at < 0 or not any(taken[at + g] for g in gaps if at + g < len(taken)):
                break
            at += 1
        else:
            at = -1
        at = len(taken) if at < 0 else at
        taken.extend(bytes(max(0, at + (gaps[-1] if gaps else 0) + 1 - len(taken))))
        for g in (0, *gaps):
            taken[at + g] = 1
        base[s] = at - low
        hole = taken.find(b"\0", free)
        free = len(taken) if hole < 0 else hole
    owner = np.full(len(taken) + width, -1, dtype=np.int32)
    target = np.zeros(len(owner), dtype=np.int32)
    for s, own in enumerate(states):
        for c, to in own.items():
            owner[base[s] + c], target[base[s] + c] = s, to
    return base, owner, target


class CrossParser:
    """The automata of all languages in one table of interleaved transitions."""

    #: Codes of characters: past the end, blank, a letter that no labelled text has.
    END, BLANK, UNKNOWN = 0, 1, 2
    PLANE = 0x3000

    def __init__(self, texts: dict[str, str], block: int = BLOCK):
        self.block = block
        self.languages = sorted(texts)
        alphabet = sorted({c for t in texts.values() for c in t} - {" "})
        self.width = len(alphabet) + 3
        code = {c: k + 3 for k, c in enumerate(alphabet)} | {" ": self.BLANK}
        self.codes = np.array([self.UNKNOWN if chr(c).isalpha() else self.BLANK for c in range(self.PLANE)], dtype=np.uint16 if self.width < 1 << 16 else np.int32)
        self.beyond = {ord(c): k for c, k in code.items() if ord(c) >= self.PLANE}
        for c, k in code.items():
            if ord(c) < self.PLANE:
                self.codes[ord(c)] = k
        self.roots, parts, first, slots = [], [], 0, 0
        for name in self.languages:
            base, owner, target = interleaved([{code[c]: t for c, t in own.items()} for own in suffix_automaton(texts[name])], self.width)
            parts.append((base + slots, np.where(owner < 0, -1, owner + first).astype(np.int32), target + np.int32(first)))
            self.roots.append(first)
            first, slots = first + len(base), slots + len(owner)
        none = np.zeros(0, np.int64)
        self.base, self.owner, self.target = map(np.concatenate, zip(*parts, strict=True)) if parts else (none, none, none)
        self.scale = np.log2(max([2, *map(len, texts.values())]))

    def step(self, state: np.ndarray | int, letter: np.ndarray) -> np.ndarray:
        """The states after ``state`` under ``letter``, or -1."""
        slot = self.base[state] + letter
        return np.where(self.owner[slot] == state, self.target[slot], np.int32(-1))

    def encode(self, text: str) -> np.ndarray:
        """Codes of a lower-cased text, runs of blanks as one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.codes[np.minimum(points, self.PLANE - 1)]
        far = np.flatnonzero(points >= self.PLANE)
        for k in far:
            p = int(points[k])
            codes[k] = self.beyond.get(p, self.UNKNOWN if chr(p).isalpha() else self.BLANK)
        blank = codes == self.BLANK
        return codes[~(blank & np.concatenate([[True], blank[:-1]]))] if len(codes) else codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        flat = np.full(sizes.sum() + 1, self.END, dtype=np.int32)
        first = np.cumsum(sizes) - sizes
        for at, t in zip(first, texts, strict=True):
            flat[at : at + len(t)] = t
        each = -(-(sizes - 1) // self.block)
        owner = np.repeat(np.arange(len(texts)), each)
        number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        starts = first[owner] + number * self.block
        ends = np.minimum(starts + self.block, first[owner] + sizes[owner] - 1)
        out = np.zeros((len(texts), len(self.languages)))
        for k, root in enumerate(self.roots):
            opens = np.zeros(len(flat), dtype=bool)  # where phrases begin
            leave = self._walk(flat, starts, ends, root, opens, None)
            # A block's first phrase begins where the last of the block before it ends. Parsed again
            # from there, most meet a beginning that is known, and all is the same from there on.
            todo = np.flatnonzero(number > 0)
            enter = leave[todo - 1]
            todo, enter = todo[enter != starts[todo]], enter[enter != starts[todo]]
            while len(todo):
                fresh = np.zeros(len(flat), dtype=bool)
                met = self._walk(flat, enter, ends[todo], root, fresh, opens)
                gone = np.minimum(met, ends[todo]) - starts[todo]
                at = np.repeat(starts[todo], gone) + np.arange(gone.sum()) - np.repeat(np.cumsum(gone) - gone, gone)
                opens[at] = fresh[at]
                through = met >= ends[todo]  # no meeting within the block: the next one is entered elsewhere
                moved = todo[through & (leave[todo] != met)]
                leave[todo[through]] = met[through]
                moved = moved[(moved + 1 < len(number)) & (number[np.minimum(moved + 1, len(number) - 1)] > 0)]
                todo, enter = moved + 1, leave[moved]
            out[:, k] = np.bincount(owner, weights=np.add.reduceat(opens, starts) if len(starts) else None, minlength=len(texts))
        return out

    def _walk(self, flat: np.ndarray, pos: np.ndarray, ends: np.ndarray, root: int, opens: np.ndarray, known: np.ndarray | None) -> np.ndarray:
        """Parse side by side from each of ``pos``, marking in ``opens`` where phrases begin, until one
        would begin at or past the end, or at a place that ``known`` has; return where."""
        out = pos.copy()
        stop = (pos >= ends) | (known[pos] if known is not None else False)
        who = np.flatnonzero(~stop)
        pos, ends = pos[who].copy(), ends[who]
        opens[pos] = True
        state = np.full(len(who), root, dtype=np.int32)
        while len(who):
            new = self.step(state, flat[pos])
            stuck = np.flatnonzero(new < 0)
            if len(stuck):
                # The match so far is a phrase, and so is a letter that the language lacks.
                p = pos[stuck] + (state[stuck] == root)
                over = p >= ends[stuck]
                if known is not None:
                    over |= known[p]
                opens[p[~over]] = True
                again = self.step(root, flat[p])
                new[stuck] = np.where(again < 0, root, again)
                pos += 1
                pos[stuck] = p + (again >= 0)
                if over.any():
                    gone = stuck[over]
                    out[who[gone]] = p[over]
                    stay = np.ones(len(who), dtype=bool)
                    stay[gone] = False
                    who, pos, ends, new = who[stay], pos[stay], ends[stay], new[stay]
            else:
                pos += 1
            state = new
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Of each text the language, its share among all and its phrases' mean length (the text's end
        counts as a character; 0 without a letter)."""
        coded = [self.encode(t) if t else np.zeros(0, np.uint16) for t in texts]
        some = [k for k, c in enumerate(coded) if self.languages and (c > self.BLANK).any()]
        names, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if some:
            sizes = np.array([[len(coded[k])] for k in some])
            phrases = np.concatenate([self.phrases([coded[k] for k in own]) for own in portions(some, coded)])
            bits = phrases * self.scale / sizes
            best = bits.argmin(axis=1)
            weight = np.exp2(bits.min(axis=1)[:, None] - bits)
            span = (sizes[:, 0] + 1) / phrases.min(axis=1)
            for k, b, share, mean in zip(some, best, 1 / weight.sum(axis=1), span, strict=True):
                names[k], scores[k], spans[k] = self.languages[b], float(share), float(mean)
        return names, scores, spans


def portions(some: list[int], coded: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts that are parsed at once: about ``AT_ONCE`` characters, or one longer text."""
    own, size = [], 0
    for k in some:
        if own and size + len(coded[k]) > AT_ONCE:
            yield own
            own, size = [], 0
        own.append(k)
        size += len(coded[k])
    if own:
        yield own


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> CrossParser:
    """Build the automata from documents that are labelled, have a letter and are not held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(sample_docs))
    labelled = usable.select("lang", salt.alias("salt"), F.xxhash64("doc_id", F.lit(1)).alias("h"))
    # One document of each language and salt: the ids first, then the few texts.
    chosen = labelled.groupBy("lang", "salt").agg(F.min("h").alias("h")).select("h", "lang").collect()
    hashes = sorted({r["h"] for r in chosen})
    if not hashes:
        return CrossParser({})
    wanted = docs.sparkSession.createDataFrame([(h,) for h in hashes], "h long")
    few = usable.select("lang", "text", F.xxhash64("doc_id", F.lit(1)).alias("h")).join(F.broadcast(wanted), "h")  # sample_docs rows a language
    few = cut(few.groupBy("lang", "h").agg(F.min("text").alias("text")))
    parts: dict[str, list[str]] = {}
    for r in pieces(few, sample_chars).orderBy("lang", "turn", "mark").collect():
        parts.setdefault(r["lang"], []).append(r["piece"])
    return CrossParser({lang: " ".join(own)[:sample_chars].strip() for lang, own in parts.items()})


def pieces(few: DataFrame, sample_chars: int) -> DataFrame:
    """Pieces of the texts of a sample (lang, h, text): ``lang``, ``turn``, ``mark``, ``piece``. In the
    order of turn and mark, texts take turns and each gives its pieces by the hash of their places;
    the pieces of a language that reach ``sample_chars`` characters are given."""

    def windows(batches):
        for b in batches:
            for lang, h, text in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                w = letters_only(text).split()
                keys = [xxhash.xxh64_intdigest(" ".join(w[k : k + WINDOW]).encode(), 0) >> 1 for k in range(max(1, len(w) - WINDOW + 1))]
                for lo in range(0, len(keys), 65_536):
                    own = keys[lo : lo + 65_536]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "h": [h] * len(own), "at": list(range(lo, lo + len(own))), "key": own})

    # Passages that another document of the sample has: first of a language's documents or not.
    seen = few.select("lang", "h", "text").mapInArrow(windows, "lang string, h long, at long, key long")
    by_lang = seen.groupBy("key", "lang").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    by_key = by_lang.groupBy("key").agg(F.count(F.lit(1)).alias("langs"))
    shared = by_lang.join(by_key, "key").filter("langs > 1 OR first < last")
    marked = seen.join(shared, ["key", "lang"]).groupBy("lang", "h").agg(
        F.collect_list(F.when(F.col("h") != F.col("first"), F.col("at"))).alias("again"),
        F.collect_list(F.when(F.col("langs") > 1, F.col("at"))).alias("foreign"),
    )

    def cut_up(words: list[str], h: int) -> list[tuple[int, int, str]]:
        out, start, size = [], 0, 0
        for k, w in enumerate(words):
            size += len(w) + 1
            if size > PIECE or k + 1 == len(words):
                out.append(" ".join(words[start : k + 1]))
                start, size = k + 1, 0
        ranked = sorted((xxhash.xxh64_intdigest(f"{h} {k}".encode(), 0) >> 1, p) for k, p in enumerate(out))
        got, size = [], 0
        for turn, (mark, p) in enumerate(ranked):
            got.append((turn, mark, p))
            size += len(p) + 1
            if size > sample_chars:
                break
        return got

    def run(batches):
        for b in batches:
            rows = []
            for lang, h, text, again, foreign in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                w = letters_only(text).split()
                for pure, gone in ((True, [*(again or ()), *(foreign or ())]), (False, again or ())):
                    bad = {k for at in gone for k in range(at, at + WINDOW)}
                    rows += [(lang, pure, *x) for x in cut_up([x for k, x in enumerate(w) if k not in bad], h)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["lang", "pure", "turn", "mark", "piece"])

    all_ = few.join(marked, ["lang", "h"], "left").select("lang", "h", "text", "again", "foreign").mapInArrow(run, "lang string, pure boolean, turn long, mark long, piece string")
    # Passages of other languages only where a language has nothing else.
    own = Window.partitionBy("lang")
    before = own.orderBy("turn", "mark", "piece").rowsBetween(Window.unboundedPreceding, -1)
    left = all_.withColumn("any", F.max("pure").over(own)).filter("pure = any")
    return left.withColumn("before", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0))).filter(F.col("before") < sample_chars)


NAMES = ("lang_pred", "score", "phrase_chars")


def classify(docs: DataFrame, parser: CrossParser, keep: list[str], names: Sequence[str] = NAMES, text: str = "text") -> DataFrame:
    """Columns ``keep`` of every document, its language, its score and its phrases' mean length."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def make():
        p = shared.value
        return lambda texts: p.predict([t.decode() if t else None for t in texts])

    return per_row(docs, keep, [text], list(zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)), make)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_chars of every document."""
    out = classify(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *NAMES)


def keep_known(docs: DataFrame, parser: CrossParser, min_phrase: float = MIN_PHRASE, min_score: float = 0.0) -> DataFrame:
    """The documents, all columns, that are in one of the learned languages: their phrases are of
    ``min_phrase`` characters or more on average, and their score is ``min_score`` or more."""
    taken = list(docs.columns)
    names: list[str] = []
    for n in NAMES:
        names.append(fresh([*taken, *names], f"__{n}"))
    lang, score, span = map(F.col, names)
    out = classify(docs, parser, taken, names)
    return out.filter((lang != "und") & (span >= min_phrase) & (score >= min_score)).select(*[f"`{c}`" for c in taken])
