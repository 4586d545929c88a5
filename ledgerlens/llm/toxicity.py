"""Toxicity by a counterfactual-regularised classifier.

Features of a text are its distinct words and their beginnings, by hash. A bounded sample of labelled rows (``ROWS``)
picks the ``FEATURES`` with the largest chi-square and fits a logistic regression. For every sampled text that names a
group of people the naming words are swapped for others of the same kind, and the loss adds COUNTERFACTUAL times the
squared change of the log-odds, so that a neutral mention moves no score. All texts are scored whole; identity terms
keep whatever weight the penalty leaves them.

Edge cases: null and empty texts have no features and get the base rate's score; labels that are null are not learned
from, a doc_id with several labels counts as toxic if one says so, and labels without a document are ignored; without
any usable label every score is 0.5; repeated rows are scored alike; a null doc_id is never trained on or held out; an
empty table gives an empty table. Only doc_id, text, and the labels' doc_id and toxic are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import dropped, saved, table

ROWS, FEATURES, COUNTERFACTUAL, CUT = 12_000, 4096, 5.0, 0.3
WORD = re.compile(r"\w+")
#: Words that name groups of people, by kind; a swap stays inside its kind and form.
IDENTITY_TERMS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["woman", "man"],
    ["women", "men"],
    ["girl", "boy"],
    ["girls", "boys"],
    ["black", "white", "asian", "hispanic", "arab", "african", "european"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["old", "young"],
    ["deaf", "blind", "disabled"],
]
SWAPS = {w: kind[(i + 1 + len(w) % (len(kind) - 1)) % len(kind)] if kind[(i + 1 + len(w) % (len(kind) - 1)) % len(kind)] != w else kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, w in enumerate(kind)}


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its proper beginnings of 3 to 8 letters."""
    out = [xxhash.xxh3_64_intdigest(word) >> 1]
    out += [xxhash.xxh3_64_intdigest(f"{word[:n]}*") >> 1 for n in range(3, min(9, len(word)))]
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def counterfactual(words: set[str]) -> set[str] | None:
    """The words with every identity term swapped; None if there is none."""
    named = words & SWAPS.keys()
    return (words - named) | {SWAPS[w] for w in named} if named else None


class Vocabulary:
    """Picked features by hash, with a bounded cache from words to their picked features."""

    def __init__(self, features: list[int]):
        self.index = {f: i for i, f in enumerate(features)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"index": self.index, "cache": {}}

    def of(self, words: set[str]) -> list[int]:
        out: set[int] = set()
        for w in words:
            own = self.cache.get(w)
            if own is None:
                own = tuple(i for f in word_features(w) if (i := self.index.get(f)) is not None)
                if len(self.cache) > 400_000:
                    self.cache.clear()
                self.cache[w] = own
            if own:
                out.update(own)
        return sorted(out)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            (pos if toxic else neg).update({f for w in words_of(text.as_py()) for f in word_features(w)})
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["feature", "pos", "neg"])


def fit(rows: list[tuple[int, list[int], list[int] | None]], width: int, weight: float = COUNTERFACTUAL, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: label, feature numbers, and those of the counterfactual text if there is one."""
    if not rows:
        return np.zeros(width), 0.0
    y = np.array([r[0] for r in rows], float)
    flat = np.array([i for r in rows for i in r[1]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    swapped = [(set(r[1]), set(r[2])) for r in rows if r[2] is not None]
    plus = [(k, i) for k, (a, b) in enumerate(swapped) for i in b - a]
    minus = [(k, i) for k, (a, b) in enumerate(swapped) for i in a - b]
    pair = np.array([k for k, _ in plus + minus], np.int64)
    item = np.array([i for _, i in plus + minus], np.int64)
    sign = np.array([1.0] * len(plus) + [-1.0] * len(minus))
    base = (y.sum() + 0.5) / (len(y) + 1)
    w, bias = np.zeros(width), float(np.log(base / (1 - base)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[flat], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        grad = np.bincount(flat, error[row], width) + l2 * w / len(rows) * 10
        if len(pair):
            change = np.bincount(pair, sign * w[item], len(swapped))
            grad += 2 * weight * np.bincount(item, sign * change[pair], width) / len(rows)
        grad = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


class Model:
    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.vocabulary.of(words_of(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = ROWS, features: int = FEATURES, weight: float = COUNTERFACTUAL) -> Model:
    """A model of the labels (doc_id, toxic) of docs (doc_id, text), from at most max_rows of them, drawn by hash."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = saved(marked, "labels")
    share = min(1.0, 0.95 * max_rows / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003).limit(max_rows)
    # at most max_rows pairs of two numbers
    sample = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").limit(max_rows), "toxic-sample")
    total = {bool(r.toxic): r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, n = total.get(True, 0) + 1.0, total.get(False, 0) + 1.0
    a, b = F.col("pos"), F.col("neg")
    chi = (a * n - b * p) ** 2 / (a + b) / (p + n - a - b)
    counts = sample.select("text", "toxic").mapInArrow(_counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    top = counts.where("pos + neg >= 3").orderBy(chi.desc(), "feature").limit(features).collect()
    named = {f for w in SWAPS for f in word_features(w)}
    vocabulary = Vocabulary(list(dict.fromkeys([*(r.feature for r in top), *sorted(named)])))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = [], []
            for text in b.column(0):
                w = words_of(text.as_py())
                own.append(vocabulary.of(w))
                other.append(None if (c := counterfactual(w)) is None else vocabulary.of(c))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["toxic", "own", "other"])

    rows = [(r.toxic, list(r.own), None if r.other is None else list(r.other)) for r in sample.select("text", "toxic").mapInArrow(numbered, "toxic int, own array<int>, other array<int>").collect()]
    dropped(marked, sample)
    return Model(vocabulary, *fit(rows, len(vocabulary.index), weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~is_held_out()))
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
