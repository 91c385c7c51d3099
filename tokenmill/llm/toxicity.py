"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is ``WINDOW`` words; it is the mean of its words, and a word the mean of the vectors of its character n-grams and of
itself, so a misspelling or a new compound shares most vectors with the words it was made from. A bag goes through a linear
softmax; a text's log-odds are a soft maximum over those of its bags, because a text is as toxic as its worst part. Embeddings and
softmax start at random and are trained together, through the soft maximum, on labels of whole texts, until the loss on a part of
the sample that is not trained on stops falling. The trained model is linear in the n-grams and is sent out as one number for each hash bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import CACHE_WORDS, arrow_batches, bounded_batches, in_fold, labelled_sample, mixed, texts_of

BUCKETS, DIM, WINDOW = 1 << 18, 8, 3
GRAMS = (4, 5, 6)
#: Labelled texts of each class that the model is fitted on, at most; every fifth of them tells when to stop and what a score means.
PER_LABEL, HELD = 2000, 5
#: Texts that a bucket must occur in; sharpness of the soft maximum.
LEAST_TEXTS, SHARP = 4, 4.0
#: Steps at most, steps between two looks at the loss, looks without a lower one that end training; step of the largest coordinate, of the softmax; decay.
STEPS, LOOK, PATIENCE, RATE, RATE_OUT, DECAY = 160, 10, 8, 0.3, 0.01, 0.004
THRESHOLD = 0.3

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class Model(NamedTuple):
    value: np.ndarray  # of each bucket, for the difference of the two classes' scores
    bias: float
    slope: float  # from a text's soft maximum to its log-odds
    offset: float
    losses: tuple[tuple[float, float], ...] = ()  # (of the trained part, of the held part) at each look


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z); other ASCII characters than letters and digits separate them."""
    return text.translate(_TABLE).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every word with its ends marked, and of the word itself."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    owners = [np.arange(len(words))]
    hashes = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))]
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k: len(data) - n + 1 + k]
        inside = owner[: len(data) - n + 1] == owner[n - 1:]
        owners.append(owner[: len(data) - n + 1][inside])
        hashes.append(mixed(h[inside]))
    return np.concatenate(owners), ((np.concatenate(hashes) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def bags_of(n: int) -> np.ndarray:
    """Bag of each of n words."""
    return np.arange(n) // WINDOW


def soft_maximum(z: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each run of z (log of the mean of exponentials, ``SHARP`` times as steep), and its derivative by each z."""
    most = np.maximum.reduceat(z, first)
    e = np.exp(SHARP * (z - np.repeat(most, size)))
    total = np.add.reduceat(e, first)
    return most + np.log(total / size) / SHARP, e / np.repeat(total, size)


class Means:
    """A sparse matrix whose rows are means over their columns; rows come in order."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int):
        count = np.bincount(row, minlength=rows)
        self.shape, self.size = (rows, cols), np.maximum(count, 1).astype(np.float32)
        order = np.argsort(row, kind="stable")
        self.of_row = col[order].astype(np.int32), (np.cumsum(count) - count)[count > 0], count > 0
        count = np.bincount(col, minlength=cols)
        order = np.argsort(col, kind="stable")
        self.of_col = row[order].astype(np.int32), (np.cumsum(count) - count)[count > 0], count > 0

    @staticmethod
    def _sums(side: tuple, x: np.ndarray, n: int) -> np.ndarray:
        other, starts, full = side
        out = np.zeros(n, np.float32)
        if len(starts):
            out[full] = np.add.reduceat(x[other], starts)
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._sums(self.of_row, x, self.shape[0]) / self.size

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        return self._sums(self.of_col, x / self.size, self.shape[1])


class Bags:
    """Texts as bags of words of subwords."""

    def __init__(self, texts: list[bytes], y: np.ndarray):
        vocabulary: dict[bytes, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t) or [b""]], np.int32) for t in texts]
        n_bags = np.array([(len(x) - 1) // WINDOW + 1 for x in ids])
        self.size, self.first = n_bags, np.cumsum(n_bags) - n_bags
        words = np.concatenate(ids)
        bag = np.concatenate([bags_of(len(x)) + a for x, a in zip(ids, self.first)])
        owner, bucket = subwords(list(vocabulary))
        self.words = Means(owner, bucket, len(vocabulary), BUCKETS)
        self.bags = Means(bag, words, int(n_bags.sum()), len(vocabulary))
        self.y = y.astype(np.float32)
        self.weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(np.float32)
        of_text = np.unique(np.repeat(np.arange(len(ids)), [len(x) for x in ids]) * len(vocabulary) + words)
        self.texts_with = self._texts_with(of_text // len(vocabulary), of_text % len(vocabulary), owner, bucket)

    @staticmethod
    def _texts_with(text: np.ndarray, word: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """How many texts have each bucket; (text, word) are the distinct words of each text. A few texts at a time."""
        order = np.argsort(owner, kind="stable")
        bucket, n = bucket[order], np.bincount(owner, minlength=int(word.max()) + 1)
        starts, out = np.cumsum(n) - n, np.zeros(BUCKETS, np.int64)
        for low in range(0, int(text[-1]) + 1, 64):
            a, b = np.searchsorted(text, (low, low + 64))
            reps = n[word[a:b]]
            at = np.repeat(starts[word[a:b]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            out += np.bincount(np.unique(np.repeat(text[a:b], reps) * BUCKETS + bucket[at]) % BUCKETS, minlength=BUCKETS)
        return out

    def odds(self, value: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        return soft_maximum(self.bags.times(self.words.times(value.astype(np.float32))) + bias, self.first, self.size)

    def loss(self, value: np.ndarray, bias: float) -> float:
        z, _ = self.odds(value, bias)
        return float((self.weight * np.logaddexp(0, np.where(self.y == 1, -z, z))).sum())

    def gradients(self, embed: np.ndarray, out: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the loss, by the embeddings (buckets x DIM), the softmax (DIM x 2) and its bias (of class 1)."""
        turn = out[:, 1] - out[:, 0]
        z, part = self.odds(embed @ turn, bias)
        of_text = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.y) * self.weight
        of_bag = part * np.repeat(of_text, self.size)
        of_bucket = self.words.transposed_times(self.bags.transposed_times(of_bag))
        of_turn = embed.T @ of_bucket
        return of_bucket[:, None] * turn, np.stack([-of_turn, of_turn], 1), float(of_bag.sum())


def fit(texts: list[bytes], labels: list[int], shares: dict[int, float], seed: int = 7) -> Model:
    """A model from labelled texts; ``shares`` has the share of each label among all labelled texts.

    With no texts of one of the classes, every text gets the share of label 1.
    """
    share = min(max(shares.get(1, 0.0), 1e-3), 1 - 1e-3)
    prior = float(np.log(share / (1 - share)))
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, prior)
    turn = np.zeros(len(y), np.int64)
    for label in (0, 1):  # every HELD-th of each class
        turn[y == label] = np.arange((y == label).sum())
    held = turn % HELD == 1
    every = np.ones(len(y), bool)
    if len(set(y[held])) < 2:
        held, every = ~every, held | ~held
    of = lambda some: Bags([t for t, h in zip(texts, some) if h], y[some])
    test = of(held if held.any() else every)
    steps, value, bias, losses = _trained(of(~held), STEPS, seed, test)
    slope, offset = _calibrated(test.odds(value, bias)[0].astype(np.float64), test.y)
    if held.any():  # as many steps again, with what was held back
        _, value, bias, _ = _trained(of(every), steps, seed)
    return Model(value.astype(np.float32), bias, slope, offset + prior, tuple(losses))


def _trained(data: Bags, steps: int, seed: int, test: Bags | None = None) -> tuple[int, np.ndarray, float, list[tuple[float, float]]]:
    """(steps, value of each bucket, bias, losses): where the loss on ``test`` is least, or after ``steps`` steps without one."""
    known = (data.texts_with >= min(LEAST_TEXTS, 1 + len(data.y) // 8)).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) * known
    half = rng.normal(0, 0.5, DIM)
    out, bias = np.stack([-half, half], 1).astype(np.float32), 0.0
    speed, first, second = np.zeros_like(embed), np.zeros_like(out), np.zeros_like(out)
    best, losses, largest = None, [], 0.0
    for t in range(steps + 1):
        if test is not None and t % LOOK == 0:
            value = embed @ (out[:, 1] - out[:, 0])
            losses.append((data.loss(value, bias), test.loss(value, bias)))
            if best is None or losses[-1][1] < best[0]:
                best = losses[-1][1], t, value, bias
            elif t - best[1] >= PATIENCE * LOOK:
                break
        if t == steps:
            break
        g_embed, g_out, g_bias = data.gradients(embed, out, bias)
        g_embed *= known
        speed = 0.9 * speed + 0.1 * g_embed
        top = float(np.abs(g_embed).max()) + 1e-12
        largest = max(largest, top)
        embed = (embed - RATE * speed / (1 - 0.9 ** (t + 1)) / max(top, 0.02 * largest)) * np.float32(1 - DECAY)
        first, second = 0.9 * first + 0.1 * g_out, 0.99 * second + 0.01 * g_out * g_out
        out = out - RATE_OUT * (first / (1 - 0.9 ** (t + 1))) / (np.sqrt(second / (1 - 0.99 ** (t + 1))) + 1e-8)
        bias -= RATE * g_bias
    if best is None:
        return steps, embed @ (out[:, 1] - out[:, 0]), bias, losses
    return best[1], best[2], best[3], losses


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of y on z with both classes weighing the same, by Newton's method with a little damping."""
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    x = np.stack([z, np.ones_like(z)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-4 * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
    return float(max(b[0], 0.0)), float(b[1])


class Scorer:
    """Probability of label 1 for whole texts; the values of words are kept in a cache of bounded size."""

    def __init__(self, model: Model):
        self.model = model
        self.cache: dict[bytes, float] = {}

    def _learn(self, words: list[bytes]) -> None:
        owner, bucket = subwords(words)
        sums = np.bincount(owner, self.model.value[bucket], len(words)) / np.bincount(owner, minlength=len(words))
        self.cache.update(zip(words, sums.tolist()))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(self.cache)
        if new:
            self._learn(list(new))
        out = np.empty(len(texts))
        for i, words in enumerate(split):
            z = self.model.bias
            if words:
                v = np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))
                bag = bags_of(len(v))
                z = float(soft_maximum(np.bincount(bag, v) / np.bincount(bag) + self.model.bias, np.zeros(1, np.int64), bag[-1:] + 1)[0][0])
            out[i] = self.model.slope * z + self.model.offset
        return 1 / (1 + np.exp(-out))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from at most ``per_label`` labelled texts of each class; ``labels`` has (doc_id, label), label 0 or 1."""
    labels = labels.where(F.col("label").isin(0, 1))
    rows = labelled_sample(docs, labels, "label", per_label).orderBy("doc_id").collect()
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    total = sum(counts.values()) or 1
    return fit([(r["text"] or "").encode() for r in rows], [r["label"] for r in rows], {k: v / total for k, v in counts.items()})


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = THRESHOLD, per_label: int = PER_LABEL) -> DataFrame:
    """One row for every row of ``docs``: doc_id, held_out, score, predicted.

    Only labels of ids outside the held-out fold are learned from. A null or empty text has the score of a text of
    neutral words. A null id is in no fold; repeated labels of an id count once, by their least; repeated rows are scored one by one; texts are
    read whole; other columns are ignored; without labels of both classes every score is the same.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(~in_fold("doc_id", folds, held) & F.col("label").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(train(docs, known, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        yield from arrow_batches(batches, _SCHEMA, lambda b: {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": score(texts_of(b["text"]))})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", folds, held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
