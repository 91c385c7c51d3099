"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary n-gram classifier (logistic regression on hashed byte n-grams of the letters)
predicts each bit; the classifiers are trained together in numpy. Decoding sums, for each language, the loss of every classifier's
output against the language's bit, weighted by how well that classifier does on texts it was not fitted on, and takes the language
with the smallest sum. A text whose two best sums are close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import arrow_batches, bounded_batches, in_fold, labelled_sample, mixed

BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Texts of each language that the classifiers are fitted on, at most; fewer if there are so many languages that they are more than SAMPLE_ROWS in all.
PER_LANGUAGE = 100
#: Lengths in bytes of the snippets that are cut out of each of them besides the whole text, so that short texts are learned, too.
SNIPPETS = (12, 30, 80, 200)
STEPS, RATE, DECAY = 40, 0.5, 1e-4
#: Least lead of the best language's probability over the next one's; below it a text is ambiguous.
CLEAR = 0.1
UNKNOWN = "und"

_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def letters_of(text: str | None) -> bytes | None:
    """Lower-case letters of a text in UTF-8, words separated and enclosed by one space; None if it has no letter."""
    if not text or not _LETTER.search(text):
        return None
    return b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "


def buckets_of(data: bytes) -> np.ndarray:
    """Bucket of every byte n-gram, in runs of the orders in GRAMS."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [], np.zeros(0, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = b.copy() if n == 1 else (h[:-1] << np.uint32(8)) | b[n - 1:]
        if n in GRAMS:
            m = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            out.append((m ^ (m >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(16))
    return np.concatenate(out).astype(np.int64)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n codewords of -1 and 1, one in each row.

    Up to six languages have all columns that split them differently; more have random columns, the best of some draws by the
    least distance between two words.
    """
    if n <= 6:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T.reshape(n, -1)
    rng, best = np.random.default_rng(seed), None
    bits = int(15 * np.ceil(np.log2(n)))
    for _ in range(20):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= rng.permuted(np.where(np.arange(n) % 2, -1, 1)).astype(np.int8)[:, None]
        near = (code.astype(np.int32) @ code.T.astype(np.int32) - 2 * bits * np.eye(n, dtype=np.int32)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding
    sharpness: float  # from losses to probabilities


def _losses(f: np.ndarray, model: Model) -> np.ndarray:
    """Weighted logistic loss of the outputs f (texts x bits) against each language's bits."""
    return np.stack([(model.trust * np.logaddexp(0, -f * c)).sum(1) for c in model.code], 1)


def _probabilities(loss: np.ndarray, sharpness: float) -> np.ndarray:
    p = np.exp(-sharpness * (loss - loss.min(1, keepdims=True)))
    return p / p.sum(1, keepdims=True)


class _Examples(NamedTuple):
    """Texts and snippets as sparse rows: each row's distinct buckets and their shares of its n-grams."""

    column: np.ndarray
    share: np.ndarray
    row: np.ndarray
    starts: np.ndarray  # of each row
    y: np.ndarray

    def outputs(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.column] * self.share[:, None], self.starts, axis=0)


def _examples(texts: list[bytes], labels: list[int], seed: int) -> _Examples:
    rng, columns, shares, y = np.random.default_rng(seed), [], [], []
    for text, label in zip(texts, labels):
        parts = [text]
        for size in SNIPPETS:
            if len(text) > size:
                a = int(rng.integers(0, len(text) - size))
                parts.append(b" " + text[a: a + size].strip() + b" ")
        for part in parts:
            found, count = np.unique(buckets_of(part), return_counts=True)
            columns.append(found.astype(np.int32))
            shares.append((count / count.sum()).astype(np.float32))
            y.append(label)
    sizes = np.array([len(c) for c in columns])
    return _Examples(np.concatenate(columns), np.concatenate(shares), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.cumsum(sizes) - sizes, np.array(y))


def fit(texts: list[bytes], labels: list[str], seed: int = 5) -> Model | None:
    """A model from texts as ``letters_of`` gives them. None without any text; one language needs no classifier."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((1, 0), np.int8)
    bits = code.shape[1]
    empty = Model(languages, code, np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits), 1.0)
    if bits == 0:
        return empty
    number = {x: i for i, x in enumerate(languages)}
    y = [number[x] for x in labels]
    fitted = [i for i in range(len(texts)) if i % 5]
    data = _examples([texts[i] for i in fitted] or texts, [y[i] for i in fitted] or y, seed)
    of_language = 1 / np.bincount(data.y, minlength=len(languages))[data.y] / len(languages)
    sign = code[data.y].astype(np.float32)
    order = np.argsort(data.column, kind="stable")
    by_column, row_of, share_of = data.column[order], data.row[order], data.share[order][:, None]
    col_starts = np.flatnonzero(np.diff(by_column, prepend=-1))
    used = by_column[col_starts]
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    squares = np.full((len(used), bits), 1e-8, np.float32)
    for _ in range(STEPS):
        z = data.outputs(w) + b
        g = (-sign / (1 + np.exp(np.clip(sign * z, -30, 30))) * of_language[:, None]).astype(np.float32)
        grad = np.add.reduceat(g[row_of] * share_of, col_starts, axis=0)
        squares += grad * grad
        w[used] = (1 - DECAY) * w[used] - RATE * grad / np.sqrt(squares)
        b -= RATE * g.sum(0)
    model = empty._replace(weights=w, bias=b)
    held = [i for i in range(len(texts)) if not i % 5]
    tests = _examples([texts[i] for i in held] or texts, [y[i] for i in held] or y, seed + 1)
    truth, f = tests.y, tests.outputs(w) + b
    right = ((f * code[truth]) > 0).mean(0)
    model = model._replace(trust=np.maximum(2 * right - 1, 0.01))
    loss = _losses(f, model)
    fits = [(-np.log(np.maximum(_probabilities(loss, s)[np.arange(len(truth)), truth], 1e-9)).mean(), s) for s in (0.25, 0.5, 1, 2, 4, 8, 16)]
    return model._replace(sharpness=float(min(fits)[1]))


class Predictor:
    """(language, probability, ambiguous) of texts."""

    def __init__(self, model: Model | None):
        self.model = model

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        if self.model is None:
            return out
        known = [(i, t) for i, t in ((i, letters_of(t)) for i, t in enumerate(texts)) if t]
        for a in range(0, len(known), 64):
            some = known[a: a + 64]
            if self.model.code.shape[1]:
                f = np.stack([self._mean(t) for _, t in some]) + self.model.bias
                p = _probabilities(_losses(f, self.model), self.model.sharpness)
            else:
                p = np.ones((len(some), 1))
            best = p.argmax(1)
            top = p[np.arange(len(some)), best]
            lead = top - np.sort(np.pad(p, ((0, 0), (1, 0))), axis=1)[:, -2]
            for (i, _), k, q, d in zip(some, best, top, lead):
                out[i] = (self.model.languages[k], float(q), bool(d < CLEAR))
        return out

    def _mean(self, text: bytes) -> np.ndarray:
        """Mean of the weights over a text's n-grams, a piece of the text at a time."""
        total, n, step, lap = 0.0, 0, 1 << 16, max(GRAMS) - 1
        for a in range(0, max(len(text) - lap, 1), step):
            b = buckets_of(text[a: a + step + lap])
            total, n = total + self.model.weights[b].sum(0, dtype=np.float64), n + len(b)
        return total / n


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def train(docs: DataFrame, folds: int, held: int, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from at most ``per_language`` texts of each value of ``lang``."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).where(~in_fold("doc_id", folds, held) & F.col("lang").isNotNull())
    rows = labelled_sample(docs, known, "lang", per_language).orderBy("doc_id", "label").collect()
    found = [(t, r["label"]) for t, r in ((letters_of(r["text"]), r) for r in rows) if t]
    return fit([t for t, _ in found], [x for _, x in found])


def identify(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, ambiguous.

    Only rows outside the held-out fold with a lang are learned from; predictions use the text alone. A null text, one
    without a letter, and all texts if nothing can be learned are ``und`` with score 0, ambiguous. A null id is in no fold; of
    repeated ids the least lang and text are learned; repeated rows are judged one by one; texts are read whole; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model.value)

        def make(batch: pa.RecordBatch) -> dict:
            lang, score, ambiguous = zip(*predict(batch["text"].to_pylist()))
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score, "ambiguous": ambiguous}

        yield from arrow_batches(batches, _SCHEMA, make)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id", folds, held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def without_unclear(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known: neither ``und`` nor ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor(model.value)
        for batch in batches:
            yield batch.filter(pa.array([lang != UNKNOWN and not ambiguous for lang, _, ambiguous in predict(batch["text"].to_pylist())], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
