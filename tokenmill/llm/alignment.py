"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how often ids end together.

Both tokenizers cut the same bytes, a space and then the text. The cumulative ends of each one's tokens are keys of a dictionary
to the tokens' places (a table over the text's byte offsets, as those are the keys); the keys that both have cut the two lists of ids into groups. A group's last two tokens end together,
which is a link. Counts of linked id pairs are taken over the whole corpus and read back for every document.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import bounded_batches, saved

#: Id pairs whose counts are broadcast at once (16 bytes each); more are gone through in blocks of about as many.
PAIRS_A_PASS = 4_000_000
#: Different id pairs that a task counts before it hands them on.
HELD_PAIRS = 1_000_000

_ALIGNED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("links", pa.binary()), ("groups_sha256", pa.string())])
_COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_SCORES = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


class ByteRanks:
    """A byte-level BPE vocabulary given as ranks; ids and the bytes of each id. Special tokens are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, text: str) -> list[int]:
        return self.model.encode_ordinary(text)


class Pieces:
    """A sentence-piece model that puts a space before the text; ids and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(ranks_path: str, pieces_path: str) -> tuple[ByteRanks, Pieces]:
    """Both tokenizers, once for each worker process."""
    return ByteRanks(ranks_path), Pieces(pieces_path)


class Aligner:
    """Aligns ids of the two vocabularies, given as the bytes of each id."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        if max(len(a_bytes), len(b_bytes)) > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids")
        self.b_bytes = b_bytes
        self.a_len, self.b_len = np.array([*map(len, a_bytes)]), np.array([*map(len, b_bytes)])
        # what an id looks like in the list of groups: A inside a group, A at its end, B inside, B at its end; filled up with zeros
        ids = [f"{i}{end}" for n, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for end in ends for i in range(n)]
        self.shown = np.array(ids, "S8").view(np.uint64)

    @staticmethod
    def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of A and of B tokens up to the end of each group, from the cumulative ends of the tokens."""
        a_at, b_at = (np.zeros(max(a_ends[-1], b_ends[-1]) + 1, np.int32) for _ in range(2))
        a_at[a_ends], b_at[b_ends] = np.arange(1, len(a_ends) + 1), np.arange(1, len(b_ends) + 1)
        common = np.flatnonzero((a_at != 0) & (b_at != 0))
        return a_at[common], b_at[common]

    def listed(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
        what = np.empty(len(a) + len(b), np.int64)
        low = 0
        for ids, ends, other, size in ((a, a_ends, np.append(0, b_ends[:-1]), len(self.a_len)), (b, b_ends, a_ends, len(self.b_len))):
            mark = ids + low
            mark[ends - 1] += size
            what[np.arange(len(ids)) + np.repeat(other, np.diff(ends, prepend=0))] = mark
            low = 2 * size
        return self.shown[what].tobytes().translate(None, b"\0")[:-1]

    def align(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, int, bytes, str]:
        """(n_a, n_b, n_groups, links as 32-bit words A << 16 | B, digest of the groups); nothing if the bytes differ.

        A's tokens are stretches of the text in order, so they spell it out if they are as long in all; B's may be anything.
        """
        whole = b" " + text.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return 0, 0, 0, b"", ""
        m, n = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_len[m]), np.cumsum(self.b_len[n])
        if not len(m) or a_ends[-1] != len(whole):
            return 0, 0, 0, b"", ""
        a_last, b_last = self.groups(a_ends, b_ends)
        links = (m[a_last - 1] << 16 | n[b_last - 1]).astype("<u4").tobytes()
        return len(m), len(n), len(a_last), links, hashlib.sha256(self.listed(m, n, a_last, b_last)).hexdigest()


def aligned(docs: DataFrame, ranks_path: str, pieces_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, groups_sha256) of every row; ``links`` has 4 bytes for each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(ranks_path, pieces_path)
        aligner = Aligner(a.bytes, b.bytes)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [aligner.align(t, a.encode(" " + t), ids) if t else (0, 0, 0, b"", "") for t, ids in zip(texts, b.encode(texts))]
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, list(_ALIGNED)[1:]))], schema=_ALIGNED)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each id pair, over all rows; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        for batch in batches:
            new, n = np.unique(np.frombuffer(b"".join(batch["links"].to_pylist()), "<u4"), return_counts=True)
            both, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            pairs, counts = both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            if len(pairs) > HELD_PAIRS:
                yield pa.RecordBatch.from_pydict({"pair": pairs.astype(np.int64), "n": counts}, schema=_COUNTS)
                pairs, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        yield pa.RecordBatch.from_pydict({"pair": pairs.astype(np.int64), "n": counts}, schema=_COUNTS)

    return links.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_of(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """True where a pair's count is the highest of its B id."""
    most = np.zeros(1 << 16, np.int64)
    np.maximum.at(most, pairs & 0xFFFF, counts)
    return counts == most[pairs & 0xFFFF]


def scores(rows: DataFrame, table) -> DataFrame:
    """(row, n_best, count_sum) over the links whose pair is in the broadcast ``table`` (sorted pairs, counts, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            links = [np.frombuffer(x, "<u4") for x in batch["links"].to_pylist()]
            flat = np.concatenate([*links, np.empty(0, np.uint32)])
            at = np.minimum(np.searchsorted(pairs, flat), len(pairs) - 1)
            known = pairs[at] == flat
            ends = np.cumsum([len(x) for x in links])
            total = lambda x: np.diff(np.append(0, np.cumsum(np.where(known, x, 0)))[ends], prepend=0) if len(flat) else np.zeros(len(links), np.int64)
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "n_best": total(best[at].astype(np.int64)), "count_sum": total(counts[at])}, schema=_SCORES)

    return rows.select("row", "links").mapInArrow(run, "row long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, ranks_path: str, pieces_path: str, pairs_a_pass: int = PAIRS_A_PASS) -> DataFrame:
    """One row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    A is the byte-level vocabulary at ``ranks_path`` over a space and the text, B the sentence-piece model at ``pieces_path`` over the text.
    A link is a pair of an A and a B token whose byte ranges end together. Null and empty texts, and texts whose tokens
    don't spell out the same bytes as a space and the text, have zeros and an empty digest. Repeated rows and repeated or null ids are rows of
    their own, and their links count as often. Texts are read whole, whatever their length. An empty table gives no rows. Other columns are ignored.

    The counts of all id pairs are broadcast if there are up to about ``pairs_a_pass``; else they go in blocks of B ids, and the stored links,
    4 bytes each, are read once for each block. A block has at most one B id's pairs more than that.
    """
    spark = docs.sparkSession
    rows = saved(aligned(docs, ranks_path, pieces_path).withColumn("row", F.monotonically_increasing_id()))
    counts = saved(pair_counts(rows))
    by_b = counts.groupBy(F.col("pair").bitwiseAND(0xFFFF).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # at most a row for each id
    first, held = [0], 0
    for r in by_b:
        if held and held + r.n > pairs_a_pass:
            first.append(r.b)
            held = 0
        held += r.n
    parts = []
    for low, high in zip(first, [*first[1:], 1 << 16]):
        some = counts.where(F.col("pair").bitwiseAND(0xFFFF).between(low, high - 1)).toArrow().sort_by("pair")  # a block, as columns
        pairs, n = some["pair"].to_numpy(), some["n"].to_numpy()
        if not len(pairs):
            continue
        table = spark.sparkContext.broadcast((pairs.astype(np.uint32), n, best_of(pairs, n)))
        parts.append(scores(rows, table) if len(first) == 1 else saved(scores(rows, table)))
        if len(first) > 1:
            table.unpersist()
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    if not parts:
        return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    added = reduce(DataFrame.union, parts)
    if len(parts) > 1:
        added = added.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.join(added, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
