"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models; each sees the document's
words and the probabilities of the categories before it. In training those probabilities are
out-of-fold predictions, so that a later model learns from errors as it will meet them. The labels
table has one toxicity flag and a quality flag, so the chain is ``low_quality`` then ``toxic``; any
list of 0/1 columns makes a chain.

Features are the presence of words (A-Z folded) and of word stems (leading bytes), the ``FEATURES``
best by a chi-square test. Training uses at most ``SAMPLE`` labelled documents, those with the
smallest hashes of their ids. Their tokens are counted in Spark; the driver sees the chosen features
and, per document, the numbers of those it has, not the texts. Equal texts share a fold, and each
fold has features of its own choice, made without its labels. The models of a category are fitted as
tasks. Every document is scored, on its whole text. The threshold is the one of best F1 among the
out-of-fold predictions.

Defined results: null, empty and wordless texts have probability 0 and are not toxic; labels of a
repeated doc_id count as positive if any row's is; null labels count as 0; with no labelled row of
either class a category has the probability of its share, and without a positive one nothing is toxic; repeated documents get rows of their own;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidoc.llm.common import WORD_BYTES, cut, fresh, per_row, released

SAMPLE = 8_000
FEATURES = 4_096
FOLDS = 3
STEM = 4

#: The chain over the labels table: name and SQL expression of each 0/1 category, in order.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def tokens(text: bytes | None) -> set[bytes]:
    words = set(text.translate(WORD_BYTES).split()) if text else set()
    return words | {b"^" + w[:STEM] for w in words if len(w) > STEM}


class Rows:
    """Documents as rows of feature numbers (compressed sparse rows), each of length one."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.at = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64, copy=False)
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.some = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.some]
        self.norm = 1 / np.sqrt(np.maximum(1, self.sizes))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.some):
            out[self.some] = np.add.reduceat(w[self.at], self.starts)
        return out * self.norm

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=np.repeat(g * self.norm, self.sizes), minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    words: np.ndarray
    chain: np.ndarray
    bias: float

    def predict(self, x: Rows, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(x.dot(self.words) + earlier @ self.chain + self.bias)


def fit(x: Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = 120, ridge: float = 1e-4) -> Linear:
    """Logistic regression on the rows ``use`` by Adam on the whole gradient."""
    k = earlier.shape[1]
    share = (y[use].sum() + 0.5) / (use.sum() + 1)
    w = np.zeros(x.width + k + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y[use].sum() < use.sum():
        return Linear(w[: x.width], w[x.width : -1], w[-1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = use.sum()
    for t in range(1, rounds + 1):
        p = sigmoid(x.dot(w[: x.width]) + earlier @ w[x.width : -1] + w[-1])
        g = np.where(use, p - y, 0) / n
        grad = np.concatenate([x.back(g) + ridge * w[: x.width], earlier.T @ g, [g.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return Linear(w[: x.width].copy(), w[x.width : -1].copy(), float(w[-1]))


@dataclass
class Chain:
    """Features, the models in order and the threshold of the last category."""

    names: tuple[str, ...]
    features: dict[bytes, int]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def rows(self, texts: list[bytes | None]) -> Rows:
        get = self.features.keys()
        return Rows([np.array(sorted(self.features[t] for t in tokens(x) & get), dtype=np.int32) for x in texts], len(self.features))

    def predict(self, texts: list[bytes | None]) -> np.ndarray:
        """Probabilities (documents by categories)."""
        x = self.rows(texts)
        out = np.zeros((x.n, 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(x, out)])
        blank = np.array([not (t and t.translate(WORD_BYTES).split(None, 1)) for t in texts], dtype=bool)
        out[blank] = 0
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below which F1 is best; out of reach where no row is positive."""
    if not y.any():
        return 2.0
    if y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float((p[order[k]] + below) / 2)


def fold_of(text: bytes, folds: int) -> int:
    """The fold of a text: equal texts share it."""
    return zlib.crc32(text) % folds


def sampled(docs: DataFrame, labels: DataFrame, categories, sample: int) -> DataFrame:
    """doc_id, the categories and text of the ``sample`` labelled documents with the smallest hashes
    of their ids."""
    names = [n for n, _ in categories]
    rows = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.expr(e), F.lit(0)).cast("int")).alias(n) for n, e in categories]
    )
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.filter("text is not null").select("doc_id", "text")
    # ``sample`` rows of a few integers are broadcast; texts of a repeated id count once.
    return texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))


def counted(rows: DataFrame, names: tuple[str, ...], folds: int) -> DataFrame:
    """Per token: in how many of the sample's documents of each fold it stands (``n0``, ``n1``, ...),
    and in how many positive ones of each category (``n0_0``: fold, category)."""

    def run(batches):
        for b in batches:
            *ys, texts = [c.to_pylist() for c in b.columns]
            for k, text in enumerate(texts):
                raw = text.encode()
                own, fold = sorted(tokens(raw)), fold_of(raw, folds)
                for lo in range(0, len(own), 65_536):
                    part = own[lo : lo + 65_536]
                    cols = [pa.array(part, pa.binary())] + [pa.array(np.full(len(part), v, dtype=np.int32)) for v in (fold, *[y[k] for y in ys])]
                    yield pa.RecordBatch.from_arrays(cols, names=["token", "fold", *names])

    schema = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("fold", T.IntegerType())] + [T.StructField(n, T.IntegerType()) for n in names])
    each = rows.select(*[f"`{n}`" for n in names], "text").mapInArrow(released(run), schema)
    sums = []
    for k in range(folds):
        sums.append(F.count_if(F.col("fold") == k).alias(f"n{k}"))
        sums += [F.count_if((F.col("fold") == k) & (F.col(f"`{n}`") == 1)).alias(f"n{k}_{c}") for c, n in enumerate(names)]
    return each.groupBy("token").agg(*sums)


def best_tokens(counts: DataFrame, sizes: np.ndarray, use: list[int], most: int) -> list[bytes]:
    """The ``most`` tokens of at least three documents of the folds ``use`` with the largest
    chi-square of any category there. ``sizes`` has a row per fold: documents, positive ones."""
    n, *positive = sizes[use].sum(axis=0).tolist() if use else [0] * sizes.shape[1]
    if not n:
        return []
    total = lambda suffix="": sum((F.col(f"n{k}{suffix}") for k in use[1:]), F.col(f"n{use[0]}{suffix}"))
    seen, best = total(), F.lit(0.0)
    for c, pos in enumerate(positive):
        want = seen * F.lit(pos / n)
        spread = F.greatest(F.lit(1e-9), want * F.lit(1 - pos / n) * (1 - seen / F.lit(n)))
        best = F.greatest(best, F.pow(total(f"_{c}") - want, F.lit(2.0)) / spread)
    rows = counts.select("token", seen.alias("seen"), best.alias("best")).filter("seen >= 3").orderBy(F.desc("best"), "token").limit(most)
    return [bytes(r["token"]) for r in rows.select("token").collect()]


@dataclass
class Sample:
    """The sample as feature numbers: what the driver and the training tasks hold of it (at most
    ``SAMPLE`` rows of at most ``FEATURES`` times ``FOLDS + 1`` numbers)."""

    rows: list[np.ndarray]
    labels: np.ndarray
    fold: np.ndarray
    chosen: list[np.ndarray]  # per fold and then for all rows: the features chosen without that fold

    def within(self, k: int) -> Rows:
        """The rows with the features of choice ``k`` only, numbered anew."""
        number = np.full(self.chosen[k].size, -1, dtype=np.int32)
        number[self.chosen[k]] = np.arange(self.chosen[k].sum())
        own = [number[r] for r in self.rows]
        return Rows([np.sort(r[r >= 0]) for r in own], int(self.chosen[k].sum()))


def numbered(rows: DataFrame, names: tuple[str, ...], features: int, folds: int) -> tuple[Sample, list[bytes]]:
    """The sample's rows by feature numbers, and the features in order."""
    rows = cut(rows)
    counts = cut(counted(rows, names, folds))
    fold = F.pmod(F.crc32("text"), F.lit(folds))
    sums = rows.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"`{n}`").alias(f"p{c}") for c, n in enumerate(names)]).collect()
    sizes = np.zeros((folds, 1 + len(names)))
    for r in sums:
        sizes[r["fold"]] = r[1:]
    sets = [best_tokens(counts, sizes, [j for j in range(folds) if j != k], features) for k in range(folds + 1)]
    order = sorted(set().union(*sets))
    number = {t: i for i, t in enumerate(order)}
    chosen = [np.isin(np.arange(len(order)), [number[t] for t in own]) for own in sets]
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        get = shared.value
        for b in batches:
            texts = [x.encode() for x in b.column(b.num_columns - 1).to_pylist()]
            own = [sorted(get[t] for t in tokens(x) & get.keys()) for x in texts]
            cols = [pa.array(own, pa.list_(pa.int32())), pa.array([fold_of(x, folds) for x in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=["doc_id", *names, "features", "fold"])

    schema = T.StructType([rows.schema[n] for n in ("doc_id", *names)] + [T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("fold", T.IntegerType())])
    got = rows.select("doc_id", *[f"`{n}`" for n in names], "text").mapInArrow(released(run), schema).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    labels = np.array([[r[n] for n in names] for r in got], dtype=float).reshape(len(got), len(names))
    return Sample([np.array(r["features"], dtype=np.int32) for r in got], labels, np.array([r["fold"] for r in got], dtype=np.int64), chosen), order


def trained(sample: Sample, k: int, category: int, earlier: np.ndarray) -> tuple[Linear, np.ndarray]:
    """The model of a category without fold ``k``, and its predictions for that fold's rows (the last
    ``k``: of all rows, with none to predict)."""
    x, here = sample.within(k), sample.fold == k
    model = fit(x, earlier, sample.labels[:, category], ~here)
    return model, model.predict(x, earlier)[here]


def train(rows: DataFrame, names: tuple[str, ...], features: int = FEATURES, folds: int = FOLDS) -> tuple[Chain, np.ndarray, Sample]:
    """The chain learned from ``rows`` (doc_id, a 0/1 column per name, text), the out-of-fold
    probabilities and the sample. The models of a category are fitted as tasks, one for each fold
    left out and one on all rows; neither features nor weights of the former see the fold's labels."""
    spark = rows.sparkSession
    sample, order = numbered(rows, names, features, folds)
    chain = Chain(names, {t: i for i, t in enumerate(t for t, own in zip(order, sample.chosen[-1], strict=True) if own)})
    earlier = np.zeros((len(sample.rows), 0))
    shared = spark.sparkContext.broadcast(sample)
    for category in range(len(names)):

        def run(batches, category=category, earlier=earlier):
            for b in batches:
                for k in b.column(0).to_pylist():
                    m, p = trained(shared.value, k, category, earlier)
                    yield pa.RecordBatch.from_pydict({"k": [k], "words": [m.words], "chain": [m.chain], "bias": [m.bias], "p": [p]})

        fits = spark.range(0, folds + 1, 1, folds + 1).mapInArrow(released(run), "k long, words array<double>, chain array<double>, bias double, p array<double>")
        out_of_fold = np.zeros(len(sample.rows))
        for r in fits.collect():
            if r["k"] < folds:
                out_of_fold[sample.fold == r["k"]] = r["p"]
            else:
                chain.models.append(Linear(np.array(r["words"]), np.array(r["chain"]), r["bias"]))
        earlier = np.column_stack([earlier, out_of_fold])
    if names:
        chain.threshold = best_threshold(earlier[:, -1], sample.labels[:, -1])
    return chain, earlier, sample


def learn(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Train on the ``sample`` labelled documents with the smallest hashes of their ids."""
    return train(sampled(docs, labels, categories, sample), tuple(n for n, _ in categories), features, folds)[0]


def score(docs: DataFrame, chain: Chain, keep: list[str], toxic: str = "toxic", probabilities: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep``, one probability per category and the verdict on the last category."""
    names = probabilities or [f"p_{n}" for n in chain.names]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        c = shared.value

        def step(texts):
            p = c.predict(texts)
            return [*p.T, p[:, -1] >= c.threshold]

        return step

    added = [(n, T.DoubleType()) for n in names] + [(toxic, T.BooleanType())]
    return per_row(docs, keep, [text], added, make)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic of every document."""
    return score(docs, learn(docs, labels), ["doc_id"])


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents, all columns, that are not toxic."""
    taken = list(docs.columns)
    new: list[str] = []
    for n in (*chain.names, "toxic_verdict"):
        new.append(fresh([*taken, *new], f"__{n}"))
    out = score(docs, chain, taken, new[-1], new[:-1])
    return out.filter(~F.col(new[-1])).select(*[f"`{c}`" for c in taken])
