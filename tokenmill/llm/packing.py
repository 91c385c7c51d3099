"""Best-fit packing of tokenised documents into sequences of bounded length.

One pass over the texts gives one row per piece (its length and checksum, not its tokens). Pieces are then dealt at
random into groups of about ``group_rows`` rows, and every group is packed by itself: bounded-space online best-fit,
where the open bins lie in a bitset keyed by their free room; a group's pieces arrive longest first. More documents mean more groups of the same size, so
neither a task's memory nor its time grows with the corpus.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import arrow_batches, bounded_batches, saved

CAPACITY = 1024
END_ID = 2
#: Bins that a group keeps open at once.
OPEN_BINS = 8192
#: Pieces of one group, on average.
GROUP_ROWS = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str, ranks_path: str | None):
    """Function from text to a numpy array of ids; one per worker process.

    With ``ranks_path`` (the same vocabulary as byte-pair ranks) plain text goes through the faster reader of ranks.
    A text that spells out an added token goes through the tokenizer file itself, which has it as one id; it is
    loaded when such a text comes.
    """
    @lru_cache(maxsize=1)
    def slow():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def by_file(text: str) -> np.ndarray:
        return np.asarray(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return by_file
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return by_file(text)
        return np.asarray(fast.encode_ordinary(text), np.uint32)

    return by_ranks


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: what is over comes first, all others are full."""
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(ids)])]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document, with the tokens' checksum; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path)

        def make(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in _PIECES.names}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(ids, capacity)):
                    for name, value in zip(_PIECES.names, (doc, k, start, length, zlib.crc32(ids[start: start + length]))):
                        out[name].append(value)
            return out

        yield from arrow_batches(batches, _PIECES, make)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths, capacity: int, open_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length in the order given; all lengths are in 1..capacity.

    An item goes into the open bin with the least free room that takes it, else into a new one. Bit f of ``room`` is
    set while a bin with f free places is open. When more than ``open_bins`` are open, the fullest is closed.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = n_open = made = 0
    for i, need in enumerate(lengths):
        fits = room >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            b = held[free].pop()
            if not held[free]:
                room ^= 1 << free
            n_open -= 1
        else:
            b, free = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - need:
            held[left].append(b)
            room |= 1 << left
            n_open += 1
            if n_open > open_bins:
                fullest = (room & -room).bit_length() - 1
                held[fullest].pop(0)
                n_open -= 1
                if not held[fullest]:
                    room ^= 1 << fullest
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` in 1..capacity) plus sequence_id and offset.

    ``pieces`` has to be a stored table (it is read twice: counted, then dealt). Rows are dealt by their place in
    that table, so equal keys do not meet in one group.
    """
    rows = pieces.count()
    groups = max(1, round(rows / group_rows))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__row"], ascending=[False, True], kind="stable")
        bins, offsets = best_fit(pdf["length"].tolist(), capacity, open_bins)
        group = int(pdf["__group"].iloc[0])
        return pdf.drop(columns=["__row", "__group"]).assign(sequence_id=bins + (group << 32), offset=offsets)

    dealt = pieces.withColumn("__row", F.xxhash64(F.monotonically_increasing_id())).withColumn("__group", F.pmod("__row", F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end id alone. A text
    of any length is cut whole. Repeated rows and repeated ids are packed as often as they occur. An empty table
    gives no rows. Other columns of ``docs`` are ignored.
    """
    return pack_pieces(saved(tokenized_pieces(docs, tokenizer_path, ranks_path, capacity, end_id)), capacity, open_bins, group_rows)
