"""Token counts by prefix dynamic programming.

A word's byte-pair encoding need not be made to be counted. Two tokens may follow each other in an
encoding if no merge across their border comes before those inside them; a row of tokens of which all
neighbours may follow each other is the encoding of its text, so every prefix of a word has exactly one
last token that may follow the last token of the prefix before it. One pass over a word finds it at
each place, and with it the number of tokens of every prefix, open (more of the word follows) and
closed (the word ends there). Counts at every prefix of a whole text follow by addition, so how many
tokens a text has, how many its first so many characters have, and where it must be cut to stay
within a budget are all looked up, without encoding anything.

The tokenizer's own normalizer and pre-tokenizer tell the words of a chunk, a run of anything but ASCII
blanks and line feeds, across which neither ever reaches (printable ASCII is split here, by the same rule).
A Python worker remembers chunks in two
generations of ``REMEMBERED``, checked at each chunk, so neither many texts nor one very long text
grow its memory.

Prefixes are those of the normalised text, by character: what the tokenizer reads. Names of special
tokens are found as the tokenizer does by default: a whole name is one token, a part of it plain text.

Defined results: a null text is an empty one, of no tokens; blank texts have no tokens; a repeated
row gets a row of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import per_row

LIMIT = 2048
#: Chunks in a generation of what a Python worker remembers, and the longest that are remembered.
REMEMBERED, LONGEST = 250_000, 64
#: Borders of tokens whose judgement a worker remembers.
BORDERS = 1_000_000
CONTRACTION = re.compile("'(?:re|ve|ll)")
CHUNK = re.compile("[^ \n]+")

#: How the word-ending vocabulary's file normalises and splits texts. Fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What SPLIT finds in lower-case printable ASCII, where byte letters are the characters themselves; other
#: chunks, and other tokenizers' texts, go through the tokenizer's own normalizer and pre-tokenizer.
ASCII_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")


class Pairs:
    """The merges of a byte-pair vocabulary, and which tokens may follow each other."""

    def __init__(self, model: dict):
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError("only plain byte-pair models can be counted")
        self.end = model.get("end_of_word_suffix") or ""
        self.rank: dict[str, dict[str, int]] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for k, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(left, {})[right] = k
            whole = left + right
            if whole in self.made:
                raise ValueError("merges must make each token once")
            self.halves[whole], self.made[whole] = (left, right), k
        if any(self.made.get(half, -1) > self.made[whole] for whole, halves in self.halves.items() for half in halves):
            raise ValueError("merges must use what earlier ones made")
        self.longest = max((len(t.removesuffix(self.end)) for t in self.made), default=1)
        self.spines: tuple[dict, dict] = {}, {}
        letters = model["vocab"].keys() - self.made.keys()
        self.wholes = dict.fromkeys(letters, True)
        self.usable = letters | {t for t in self.made if self.whole(t)}
        #: How long open tokens of over three letters are at most, by their last four letters.
        self.reach: dict[str, int] = {}
        for t in self.usable:
            if len(t) > 3:
                self.reach[t[-4:]] = max(len(t), self.reach.get(t[-4:], 0))
        self.borders: dict[str, dict[str, bool]] = {}
        self.n_borders = 0

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of a token at its right (``side`` 1) or left (0) edge, and the merge that ends each."""
        out = self.spines[side].get(token)
        if out is None:
            halves = self.halves.get(token)
            inner = [] if halves is None else [(part, min(gone, self.made[token])) for part, gone in self.spine(halves[side], side)]
            out = self.spines[side][token] = [(token, float("inf")), *inner]
        return out

    def _across(self, left: str, right: str, skip: tuple[str, str] | None = None) -> bool:
        """Whether a merge across the border of two tokens comes before one that ends its parts. Of the
        same merge at two places the one further left comes first."""
        over = self.spine(right, 0)
        for a, gone in self.spine(left, 1):
            merges = self.rank.get(a)
            if merges:
                for b, limit in over:
                    k = merges.get(b)
                    if k is not None and k < gone and k <= limit and (a, b) != skip:
                        return True
        return False

    def follow(self, left: str, right: str) -> bool:
        """Whether two tokens may follow each other in an encoding."""
        known = self.borders.get(left, {}).get(right)
        if known is None:
            known = not self._across(left, right)
            if self.n_borders >= BORDERS:
                self.borders, self.n_borders = {}, 0
            self.borders.setdefault(left, {})[right] = known
            self.n_borders += 1
        return known

    def whole(self, token: str) -> bool:
        """Whether a token's own text is encoded as that token: both halves are whole, and nothing but
        themselves merges across their border before they do."""
        known = self.wholes.get(token)
        if known is None:
            left, right = self.halves[token]
            known = self.whole(left) and self.whole(right) and not self._across(left, right, skip=(left, right))
            self.wholes[token] = known
        return known

    def prefixes(self, word: str) -> tuple[list[int], list[int]]:
        """Tokens of each prefix of a word of byte letters, from the empty one: closed and open."""
        last, opened = self._open(word, len(word))
        if not self.end:
            return opened, opened
        return [0, *(opened[self._closing(word, k, last)] + 1 for k in range(1, len(word) + 1))], opened

    def count(self, word: str) -> int:
        """Tokens of a closed word."""
        if not word:
            return 0
        last, opened = self._open(word, len(word) - 1)
        return opened[self._closing(word, len(word), last)] + 1

    def _open(self, word: str, size: int) -> tuple[list[str], list[int]]:
        """The last token and the number of tokens of each prefix up to ``size`` letters."""
        last, opened = [""], [0]
        usable, borders, reach = self.usable, self.borders, self.reach
        for k in range(1, size + 1):
            far = k - reach.get(word[k - 4 : k], 3) if k > 3 else 0
            for j in range(far if far > 0 else 0, k):
                token = word[j:k]
                if token in usable:
                    if not j:
                        break
                    before = last[j]
                    good = borders[before].get(token) if before in borders else None
                    if good or good is None and self.follow(before, token):
                        break
            else:
                raise ValueError(f"no token ends {word[:k]!r}")
            last.append(token)
            opened.append(opened[j] + 1)
        return last, opened

    def _closing(self, word: str, k: int, last: list[str]) -> int:
        """Where the last token of the word ``word[:k]`` begins."""
        for j in range(max(0, k - self.longest), k):
            token = word[j:k] + self.end
            if token in self.usable and (not j or self.follow(last[j], token)):
                return j
        raise ValueError(f"no token closes {word[:k]!r}")


class Remembered(dict):
    """What a function gives for texts, in two generations: when the younger one is full it becomes the
    older one. Texts of over ``LONGEST`` letters are not remembered."""

    def __init__(self, function):
        self.function, self.older = function, {}

    def __missing__(self, text: str):
        n = self.older.get(text)
        if n is None:
            n = self.function(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = n
        return n


class Counter:
    """Token counts of texts, as a tokenizer file has them."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.pairs = Pairs(json.loads(self.tokenizer.to_str())["model"])
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None
        self.words, self.chunks, self.normals = Remembered(self.pairs.count), Remembered(self._chunk), Remembered(self._normals)
        told = json.loads(self.tokenizer.to_str())
        self.known = (told["normalizer"], told["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)

    def normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def split(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """The words of a normalised text, in byte letters, and where they stand in it."""
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """A text cut at names of special tokens: (whether it is one, text)."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [x for x in (*out, (False, text[at:])) if x[1]]

    def _chunk(self, chunk: str) -> int:
        if self.known and chunk.isascii() and chunk.isprintable() and not (self.special and self.special.search(chunk)):
            low = chunk.lower()
            return self.words[low] if low.isalpha() else sum(map(self.words.__getitem__, ASCII_WORD.findall(low)))
        return sum(1 if own else sum(self.words[w] for w, _ in self.split(self.normal(part))) for own, part in self.parts(chunk))

    def _normals(self, chunk: str) -> str:
        return "".join(part if own else self.normal(part) for own, part in self.parts(chunk))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def plain(self, text: str) -> list[int]:
        """Tokens of each prefix of a normalised text without special tokens."""
        out, done = [0], 0
        for word, (start, stop) in self.split(text):
            closed = self.pairs.prefixes(word)[0]
            ends = accumulate(len(c.encode()) for c in text[start:stop])  # byte letters up to each character
            own = [closed[e] for e in ends]
            if CONTRACTION.fullmatch(text[start:stop]):  # one word only when it is whole
                own[1] = closed[1] + self.words[word[1]]
            out += [done] * (start + 1 - len(out)) + [done + n for n in own]
            done += closed[-1]
        return out + [done] * (len(text) + 1 - len(out))

    def prefixes(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and the tokens of each of its prefixes, from the empty one."""
        norm, out = "", [0]
        for own, part in self.parts(text):
            before = out[-1]
            if own:  # a name that has begun is plain text, one that is whole a single token
                word = norm[norm.rfind(" ") + 1 :]
                open_ = out[len(norm) - len(word)]
                out += [open_ + self._chunk(word + part[:k]) for k in range(1, len(part))] + [before + 1]
            else:
                part = self.normal(part)
                out += [before + n for n in self.plain(part)[1:]]
            norm += part
        return norm, out

    def within(self, text: str, limit: int) -> int | None:
        """Characters of the normalised text's longest prefix of at most ``limit`` tokens; None if the
        whole text has no more. Only the chunk in which they are passed is looked into."""
        done = 0
        for m in CHUNK.finditer(text):
            n = self.chunks[m[0]]
            if done + n > limit:
                norm, inner = self.prefixes(m[0])
                head = re.sub("  +", " ", " ".join(map(self.normals.__getitem__, text[: m.start()].replace("\n", " ").split(" "))))
                joined = head[-1:] == " " == norm[:1] and not self.parts(m[0])[0][0]  # blanks are one
                return len(head) - joined + max(k for k, v in enumerate(inner) if done + v <= limit)
            done += n
        return None


_counters: dict[str, Counter] = {}


def counter(tokenizer_path: str) -> Counter:
    """A Python worker's counter, with what it remembers."""
    if tokenizer_path not in _counters:
        _counters[tokenizer_path] = Counter(tokenizer_path)
    return _counters[tokenizer_path]


ADDED = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("within_chars", T.LongType())]


def report(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and within_chars: where the normalised text must be cut to
    have at most ``limit`` tokens (null: nowhere)."""

    def make():
        own = counter(tokenizer_path)

        def run(texts):
            whole = [(t or b"").decode() for t in texts]
            n = [own.count(t) for t in whole]
            return [len(t or b"") for t in texts], n, [v > limit for v in n], [own.within(t, limit) if v > limit else None for t, v in zip(whole, n, strict=True)]

        return run

    return per_row(docs, ["doc_id"], [text], ADDED, make)


def prefix_counts(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text", names: tuple[str, str] = ("normalised", "prefix_tokens")) -> DataFrame:
    """Columns ``keep`` of every document, its normalised text, and the token counts of all its prefixes
    (element k + 1: of the first k characters), against which any budget can be asked later by ``cut_to``."""

    def make():
        own = counter(tokenizer_path)
        return lambda texts: list(zip(*[own.prefixes((t or b"").decode()) for t in texts], strict=True)) or [[], []]

    return per_row(docs, keep, [text], [(names[0], T.StringType()), (names[1], T.ArrayType(T.IntegerType()))], make)


def cut_to(limit: Column, text: Column | str = "normalised", counts: Column | str = "prefix_tokens") -> Column:
    """The longest prefix of a text with at most ``limit`` tokens, from stored counts."""
    fits = F.transform(counts, lambda n, k: F.when(n <= limit, k))
    return F.substring(text, F.lit(1), F.array_max(fits))
