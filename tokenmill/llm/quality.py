"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's features are hashed unigrams and bigrams of its words, unigrams to trigrams of its words' shapes, and its repeated
word trigrams. A feature's value is its count over the number of words, so a score is a sparse dot product
of counts with the weights, computed here as a sum over the n-grams in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import CACHE_WORDS, WordHash, arrow_batches, bounded_batches, in_fold, labelled_sample, mixed, ngram_hashes, texts_of

BUCKETS = 1 << 18
#: Labelled texts of each class that the model is fitted on, at most, and passes over them.
PER_LABEL, PASSES = 1500, 3
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.01
#: Factor of a feature's share of the words, so that weights are of order one.
SCALE = 10.0
THRESHOLD = 0.3

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


def shape_of(word: bytes) -> bytes:
    """Digits, capitals, a capital first, small letters; other characters are a shape of their own, whatever their number."""
    if word[:1].isdigit():
        return b"0"
    if word[:1].isalpha() or word[0] >= 128:
        return b"A" if len(word) > 1 and word.isupper() else b"Aa" if word[:1].isupper() else b"a"
    return word[:1] if len(set(word)) == 1 else word[:2]


class _Shapes(dict):
    """Hash of a word's shape; a cache of bounded size."""

    def __init__(self, hashes: WordHash):
        super().__init__()
        self.hashes = hashes

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = self.hashes[b"\x00" + shape_of(word)]
        return value


class Features:
    """Buckets of all n-grams of a text, repeated as they occur, and the number of its words."""

    def __init__(self):
        self.hashes = WordHash()
        self.shapes = _Shapes(self.hashes)

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        words = _TOKEN.findall(text)
        h = self.hashes.of(words)
        s = np.fromiter(map(self.shapes.__getitem__, words), np.uint64, len(words))
        three = ngram_hashes(h, 3)
        again = len(three) - len(np.unique(three))
        grams = [ngram_hashes(h, 1), ngram_hashes(h, 2), *(ngram_hashes(s, n) for n in (1, 2, 3)), np.full(again, 1, np.uint64)]
        return (mixed(np.concatenate(grams)) % np.uint64(BUCKETS)).astype(np.int64), len(words)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float) -> Model:
    """Weights by FTRL-proximal updates, one text at a time, both classes weighing the same; the bias then shifts to
    the classes' true shares. ``examples`` has (buckets, values). With one class only, all weights are 0."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    n_one = sum(labels)
    if not 0 < n_one < len(labels):
        return Model(np.zeros(BUCKETS, np.float32), prior)
    of_class = {1: 0.5 * len(labels) / n_one, 0: 0.5 * len(labels) / (len(labels) - n_one)}
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for k in range(PASSES):
        for i in np.random.default_rng(k).permutation(len(examples)):
            at, x = examples[i]
            w = weights(at)
            g = of_class[labels[i]] * (_sigmoid(w @ x) - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]) + prior)


def example(buckets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text, the constant feature last."""
    at, count = np.unique(buckets, return_counts=True)
    return np.append(at, BUCKETS), np.append(count * (SCALE / max(n_words, 1)), 1.0)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.features = model, Features()

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        z = np.empty(len(texts))
        for i, text in enumerate(texts):
            buckets, n = self.features(text)
            z[i] = self.model.weights[buckets].sum(dtype=np.float64) * SCALE / max(n, 1) + self.model.bias
        return _sigmoid(z)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
_EXAMPLES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from at most ``per_label`` labelled texts of each class; ``labels`` has (doc_id, label), label 0 or 1.

    Texts are turned into sparse features on the executors; only those come to the driver.
    """
    labels = labels.where(F.col("label").isin(0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()

        def make(batch: pa.RecordBatch) -> dict:
            found = [example(*features(t)) for t in texts_of(batch["text"])]
            return {"doc_id": batch["doc_id"], "label": batch["label"], "buckets": [a.astype(np.int32) for a, _ in found], "values": [v.astype(np.float32) for _, v in found]}

        yield from arrow_batches(batches, _EXAMPLES, make)

    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "label", per_label).select("doc_id", F.col("label").cast("int").alias("label"), "text")
    rows = sample.mapInArrow(run, "doc_id long, label int, buckets array<int>, values array<float>").toArrow().sort_by("doc_id")
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    examples = [(np.asarray(a.values, np.int64), np.asarray(v.values, np.float64)) for a, v in zip(rows["buckets"], rows["values"])]
    return fit(examples, rows["label"].to_pylist(), counts.get(1, 0) / (sum(counts.values()) or 1))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, per_label: int = PER_LABEL) -> DataFrame:
    """One row for every row of ``docs``: doc_id, held_out, score, predicted.

    Only labels of ids outside the held-out fold are learned from. A null or empty text has the score of the bias alone. A null
    id is in no fold; of repeated labels of an id the least counts; repeated rows are scored one by one; texts are read
    whole; other columns are ignored; without labels of both classes every score is the share of label 1.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(~in_fold("doc_id", folds, held) & F.col("label").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(train(docs, known, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        yield from arrow_batches(batches, _SCHEMA, lambda b: {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score(texts_of(b["text"]))})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", folds, held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
