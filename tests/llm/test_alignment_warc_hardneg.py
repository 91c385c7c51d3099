"""Operators 11 to 13 against brute force and exact round trips; and their defined edge cases."""

from __future__ import annotations

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenmill.llm import alignment, hardneg, warc
from tokenmill.llm.queries import QUERIES

RANKS, PIECES, FILE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))


# op11

def page_rows(pages):
    """What the contract says of (page_id, html): bytes, digest, type and target by page."""
    lead = {}
    for i, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            lead[data] = min(i, lead.get(data, i))
    out = Counter()
    for i, html in pages:
        data = (html or "").encode()
        to = lead.get(data)
        to = None if to == i else to
        out[i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def pages_table(spark, rows):
    schema = "page_id long, url string, html string, path string, payload string, lead string, record_type string, n long, payload_digest string"
    return spark.createDataFrame([(i, u, h, "p", "x", "l", "t", 1, "d") for i, u, h in rows], schema)


def test_archives_give_every_page_back(spark, tmp_path):
    rng = random.Random(4)
    long_text = "".join(rng.choices("abc é\r\n\r\n", k=300_000))
    rows = [(1, "http://a.example/", None), (2, None, ""), (3, "http://a.example/x y\r\nX-Page-ID: 9", "é" * 49 + "x"), (4, "u", "é" * 50), (5, "u", "é" * 50), (9, "u", long_text),
            (8, "u", long_text), (8, "u", long_text), (7, "u", "q" * 99), (6, "u", "q" * 99), (None, "u", "é" * 50), (None, "u", "n" * 200), (None, "v", "n" * 200), (-3, "u", "\0WARC/1.1\r\n\r\n"),
            *[(100 + k, f"http://h{k % 7}.example/{k}", f"<html>page {k % 60} of {'lorem ipsum ' * (k % 60)}</html>") for k in range(900)]]
    archives = warc.write_archives(pages_table(spark, rows).repartition(3), str(tmp_path / "w"), archive_bytes=20_000)
    assert archives.count() > 3
    got = warc.read_archives(archives).toPandas()
    assert got["problem"].isna().all()
    null = lambda x: None if x != x or x is None else int(x)
    found = Counter((null(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, null(r.refers_to)) for r in got.itertuples())
    assert found == page_rows([(i, h) for i, _, h in rows])
    whole = {r.payload_digest: r.payload for r in got.itertuples() if r.record_type == "response"}
    assert all(whole[hashlib.sha256((h or "").encode()).hexdigest()] == (h or "").encode() for _, _, h in rows)
    assert {r.url for r in got.itertuples() if r.page_id == 3} == {"http://a.example/x%20y%0D%0AX-Page-ID:%209"}


def test_no_pages_no_archives(spark, tmp_path):
    archives = warc.write_archives(pages_table(spark, []), str(tmp_path / "w"))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0


def written(tmp_path, records, name="a.warc.zst"):
    a = warc.Archive(str(tmp_path / name))
    for r in records:
        a.add(r)
    a.close()
    return tmp_path / name


def some_records(n):
    bodies = [f"<p>{k} {'common words here ' * 20}</p>".encode() for k in range(n)]
    return [warc.record(k, f"http://x.example/{k}", b, hashlib.sha256(b).hexdigest(), None, False) for k, b in enumerate(bodies)]


def test_dictionary_leads_and_each_record_is_a_frame(tmp_path):
    raw = some_records(300)
    data = written(tmp_path, raw).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and len(data) < len(b"".join(raw)) / 4
    plain = zstandard.ZstdDecompressor().decompressobj().decompress(data[8:8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    with open(tmp_path / "a.warc.zst", "rb") as f:
        found = list(warc.frames(f))
    assert [r for _, r in found] == raw
    for at, r in found[::50]:
        assert reader.decompressobj().decompress(data[at:]) == r
    # the same with a plain dictionary, other skippable frames between records, and no dictionary at all
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(plain))
    pad = struct.pack("<II", 0x184D2A53, 5) + b"hello"
    (tmp_path / "b").write_bytes(struct.pack("<II", 0x184D2A5D, len(plain)) + plain + b"".join(c.compress(r) + pad for r in raw))
    (tmp_path / "c").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in raw))
    for name in "bc":
        rows = list(warc.read_archive(str(tmp_path / name), True))
        assert [r["page_id"] for r in rows] == list(range(300)) and not any(r["problem"] for r in rows)


def test_broken_records_are_told_and_the_rest_is_read(tmp_path):
    good = some_records(3)
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"

    def made(version=b"WARC/1.1", length=len(body), block=body, end=b"\r\n\r\n", kind=b"response", more=b"", drop=b""):
        lines = [b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x>", b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Length: %d" % length]
        return version + b"\r\n" + b"".join(x + b"\r\n" for x in lines if not drop or not x.startswith(drop)) + more + b"\r\n" + block + end

    bad = {"version": made(version=b"WARC/9"), "content-length is 40": made(length=40), "blank lines": made(end=b"\r\n"), "no warc-date": made(drop=b"WARC-Date"),
           "header line": made(more=b"no colon\r\n"), "block differs": made(more=b"WARC-Block-Digest: sha256:00\r\n"), "payload differs": made(more=b"WARC-Payload-Digest: sha256:00\r\n"),
           "HTTP content-length": made(block=body[:-1] + b"xy", length=len(body) + 1), "no HTTP header": made(block=b"x" * len(body)), "a revisit needs": made(kind=b"revisit"),
           "has no end": b"WARC/1.1\r\nA: b", "content-length is '1x'": made(drop=b"Content-Length", more=b"Content-Length: 1x\r\n")}
    path = written(tmp_path, [good[0], *bad.values(), made(kind=b"metadata"), good[1]])
    rows = list(warc.read_archive(str(path), True))
    assert [r["page_id"] for r in rows if r["problem"] is None] == [0, None, 1]
    for what, row in zip(bad, rows[1:]):
        assert ("content-length" if what == "blank lines" else what) in row["problem"]
    data = path.read_bytes()
    for cut in (data[:-3], data[:-60] + b"\xff" * 60, data + b"xyz"):
        (tmp_path / "cut").write_bytes(cut)
        rows = list(warc.read_archive(str(tmp_path / "cut"), True))
        assert rows[0]["page_id"] == 0 and rows[-1]["problem"].startswith("after this record")
    (tmp_path / "empty").write_bytes(b"")
    assert list(warc.read_archive(str(tmp_path / "empty"), True)) == []


# op12

def brute_alignment(texts):
    """The contract with dictionaries and lists; other libraries' calls for A."""
    import sentencepiece
    from tokenizers import Tokenizer
    tok, sp = Tokenizer.from_file(FILE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    rows = []
    for t in texts:
        if not t:
            rows.append(None)
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False), sp.encode(t)
        a_bytes = [bytes(back[c] for c in x) for x in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            rows.append(None)
            continue
        ends = []
        for parts in (a_bytes, b_bytes):
            at, e = 0, {}
            for k, p in enumerate(parts):
                at += len(p)
                e[at] = k
            ends.append(e)
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0][e] + 1, ends[1][e] + 1
            groups.append((a.ids[i:i2], b[j:j2]))
            i, j = i2, j2
        rows.append((a.ids, b, groups))
    counts = Counter((x[-1], y[-1]) for r in rows if r for x, y in r[2])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in r[2]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in r[2])
        out.append((len(r[0]), len(r[1]), len(r[2]), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  two  spaces ", "a▁b", "▁", "naïve ﬁ ½ ① 中文 🙂 \x00\x7f tab\tline\nline", "<|endoftext|> <s> </s> <unk> <0x41>", "aaaa" * 4000, "x", "x", "é" * 3, "١٢٣ ١", "  ​　"]


@pytest.mark.parametrize("pairs_a_pass", [alignment.PAIRS_A_PASS, 40])
def test_alignment_is_that_of_brute_force(spark, sf, pairs_a_pass):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = [*docs, *((None if k % 3 == 0 else 7, t) for k, t in enumerate(ODD)), docs[0]]
    table = spark.createDataFrame([(i, t, "c", 1, "w", b"1") for i, t in rows], "doc_id long, text string, row string, n long, pair string, links binary").repartition(3)
    got = alignment.align_tokenizers(table, RANKS, PIECES, pairs_a_pass).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((i, *r) for (i, _), r in zip(rows, brute_alignment([t for _, t in rows])))


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(empty, RANKS, PIECES).count() == 0
    one = alignment.align_tokenizers(spark.createDataFrame([(1, None)], "doc_id long, text string"), RANKS, PIECES).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, 0, 0, 0, "")]


# op13

@settings(max_examples=60, deadline=None)
@given(st.integers(1, 130), st.integers(0, 10**6), st.sampled_from([0.01, 1.0, 3000.0]), st.integers(1, 5), st.integers(1, 8))
def test_every_score_is_in_its_interval(dims, seed, size, levels, planes):
    rng = np.random.default_rng(seed)
    vectors = [*(rng.standard_normal((12, dims)) * size), np.zeros(dims), np.ones(dims)]
    ints, turn = hardneg.integers(vectors, dims, 256), hardneg.rotation(dims)
    anchors = hardneg.Anchors(np.arange(5), np.zeros(5), ints[9:], turn, levels, planes)
    least, most = anchors.intervals(*hardneg.encoded(ints, turn, levels), slice(None))
    scores = ints @ ints[9:].T
    assert (least <= scores).all() and (scores <= most).all()


def test_intervals_drop_most_rows(spark, sf):
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ints, turn = hardneg.integers(vectors, 64, 256), hardneg.rotation(64)
    _, most = hardneg.Anchors(np.arange(20), np.zeros(20), ints[:20], turn).intervals(*hardneg.encoded(ints, turn), slice(None))
    edge = np.sort(ints @ ints[:20].T, 0)[-6]
    assert (most >= edge).mean() < 0.5


def brute_negatives(rows, anchor_ids, k=5):
    """rows: {id: (label, integers)}."""
    out = []
    for a in anchor_ids:
        if a not in rows:
            continue
        label, v = rows[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in rows.items()}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in first(i for i in rows if i != a and rows[i][0] == label):
            fits = (i for i in rows if rows[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p])
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(first(fits), 1)]
    return out


@pytest.mark.parametrize("a_pass", [hardneg.ANCHORS_A_PASS, 3])
def test_negatives_are_those_of_brute_force(spark, a_pass):
    rng = random.Random(8)
    base = [[rng.uniform(-1, 1) for _ in range(9)] for _ in range(12)]
    rows = [(i, rng.randrange(3), [x + rng.uniform(-0.2, 0.2) * (i % 4) for x in rng.choice(base)]) for i in range(400)]  # with many ties
    rows += [(500, None, [1.0] * 9), (600, 1, None), (700, 1, [1.0] * 8 + [None]), (800, 1, [1.0] * 8 + [float("nan")]), (900, 1, [1.0] * 8 + [float("-inf")]), (None, 1, [1.0] * 9),
             (1000, 1, [0.5, 0.25]), (1001, 2, []), (1100, 9, [1.0] * 9), (399, 2, [9.0] * 9), (399, 0, [2.0] * 9), (399, 0, [1.0] * 9), (1200, 2, [3e38] * 9), (1201, 2, [-3e38] * 9)]
    schema = "vec_id long, label int, embedding array<double>, codes string, slot int, score string"
    table = spark.createDataFrame([(i, y, v, "c", 1, "s") for i, y, v in rows], schema).repartition(3)
    got = hardneg.hard_negatives(table, F.col("vec_id") % 100 == 0, anchors_a_pass=a_pass, rows_a_task=50).collect()
    held: dict = {}
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held[i] = min((y, v), held.get(i, (y, v)))
    ints = {i: (y, hardneg.integers([v], 9, 256)[0].tolist()) for i, (y, v) in held.items()}
    assert sorted(map(tuple, got)) == sorted(brute_negatives(ints, [i for i in ints if i % 100 == 0]))


def test_no_vectors_no_negatives(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hardneg.hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hardneg.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0
    bare = spark.createDataFrame([(0, 1, []), (1, 1, []), (2, 2, [])], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in hardneg.hard_negatives(bare, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_queries_are_registered():
    assert {"op11_warc", "op12_cross_tokenizer_alignment", "op13_hard_negative_mining"} <= set(QUERIES)
