"""Tokenizer and bits-per-byte queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.operators import scoring
from tokenmill.plans.catalog import register
from tokenmill.plans.derived import CORPUS_SQL, byte_rows_sql, corpus_split


@register("agg01_bpb_bytes_by_lang", sql=f"""
WITH {CORPUS_SQL},
toks AS {byte_rows_sql("corpus_split", "doc_id, split, lang")},
pairs AS (
  SELECT split, lang, coalesce(lag(tok) OVER (PARTITION BY doc_id ORDER BY i), 256) AS a, tok AS b FROM toks),
pc AS (SELECT split, lang, a, b, count(*) AS n FROM pairs GROUP BY ALL),
c_ab AS (SELECT a, b, sum(n) AS c_ab FROM pc WHERE split = 'train' GROUP BY a, b),
c_a AS (SELECT a, sum(c_ab) AS c_a FROM c_ab GROUP BY a),
scored AS (
  SELECT pc.split, pc.lang, pc.n,
         -ln((coalesce(c_ab.c_ab, 0) + 1.0) / (coalesce(c_a.c_a, 0) + 256.0)) AS loss
  FROM pc LEFT JOIN c_ab USING (a, b) LEFT JOIN c_a USING (a))
SELECT split, lang, CAST(sum(n) AS BIGINT) AS n_targets, CAST(sum(n) AS BIGINT) AS n_bytes,
       round(sum(n * loss) / (ln(2) * sum(n)), 6) AS bpb
FROM scored GROUP BY split, lang
""")
def bpb_bytes_by_lang(spark, sf):
    """Flagship: documents -> byte tokens (+BOS) -> bigram count scorer -> bits per byte."""
    return scoring.corpus_bpb(corpus_split(spark, sf), ["lang"])


# ----------------------------------------------------------------------------- byte tokenizer / chunks
from tokenmill.functions.text import SIMPLE_SPLIT_PATTERN, pretokenize  # noqa: E402
from tokenmill.operators import tokenizer as TK  # noqa: E402
from tokenmill.operators.filters import char_budget, crop_docs  # noqa: E402
from tokenmill.plans.derived import corpus  # noqa: E402
from tokenmill.session import table  # noqa: E402
from tokenmill.sources import corpus as C  # noqa: E402

SIMPLE_SQL = SIMPLE_SPLIT_PATTERN.replace("'", "''")


@register("tok01_pretokenize", sql=f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{SIMPLE_SQL}')) AS BIGINT) AS n_chunks,
       CAST(array_to_string(regexp_extract_all(text, '{SIMPLE_SQL}'), '') = text AS BIGINT) AS lossless
FROM documents
""")
def pretokenize_q(spark, sf):
    d = table(spark, sf, "documents")
    ch = pretokenize("text", SIMPLE_SPLIT_PATTERN, unicode=False)
    return d.select("doc_id", F.size(ch).cast("bigint").alias("n_chunks"),
                    (F.array_join(ch, "") == F.col("text")).cast("bigint").alias("lossless"))


@register("tok01_pretokenize_full", sql="""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS joined_md5 FROM documents""")
def pretokenize_full_q(spark, sf):
    """The pattern that training uses: chunks make up the text again."""
    d = table(spark, sf, "documents").select("doc_id", pretokenize("text").alias("c"))
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda acc, x: acc + F.char_length(x))
    return d.select("doc_id", n.alias("n_chars"), F.md5(F.array_join("c", "")).alias("joined_md5"))


# White space as the pattern sees it, and without the ends of lines.
_WS = r"\t-\r\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BLANK = r"\t\x0b\x0c\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# DuckDB's expressions can't look ahead, so a mark (U+0001) is set first between the last blank before a character and the white space before it; the
# alternatives are those of the training pattern, with the mark as the place where a run of white space ends.
_MARKED = (rf"''(?i:[sdmt]|ll|ve|re)|\x01?[^\r\n\p{{L}}\p{{N}}\x01]?\p{{L}}+|\p{{N}}{{1,2}}|\x01? ?[^{_WS}\p{{L}}\p{{N}}\x01]+[\r\n]*"
           rf"|[{_WS}]*[\r\n]|[{_WS}]+|\x01[{_WS}]")


def chunks_sql(text: str = "text") -> str:
    """DuckDB twin of the training pre-tokenizer (texts without U+0001)."""
    return (f"list_transform(regexp_extract_all(regexp_replace({text}, '([{_BLANK}])([^{_WS}])', chr(1) || '\\1\\2', 'g'), '{_MARKED}'), "
            "lambda c: replace(c, chr(1), ''))")


CHUNK_COUNTS_SQL = f"SELECT chunk, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({chunks_sql()}) AS chunk FROM documents) GROUP BY chunk"


@register("tok02_chunk_counts", sql=CHUNK_COUNTS_SQL)
def chunk_counts_q(spark, sf):
    return TK.chunk_counts(table(spark, sf, "documents"))


@register("tok02_chunk_counts_simple", sql=f"""
SELECT chunk, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(regexp_extract_all(text, '{SIMPLE_SQL}')) AS chunk FROM documents) GROUP BY chunk
""")
def chunk_counts_simple_q(spark, sf):
    return TK.chunk_counts(table(spark, sf, "documents"), pattern=SIMPLE_SPLIT_PATTERN, unicode=False)


@register("tok13_byte_encode", sql=f"""
WITH t AS {byte_rows_sql("documents", "doc_id")}
SELECT doc_id, CAST(count(*) + 1 AS BIGINT) AS n_tokens, CAST(sum(tok) + 256 AS BIGINT) AS id_sum,
       CAST(max(tok) AS BIGINT) AS max_byte,
       CAST(sum(CASE WHEN tok >= 128 THEN 1 ELSE 0 END) AS BIGINT) AS n_non_ascii
FROM t GROUP BY doc_id
""")
def byte_encode_q(spark, sf):
    d = TK.byte_encode(table(spark, sf, "documents"), prepend=TK.BYTE_BOS)
    body = F.slice("ids", 2, F.size("ids"))
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
                    F.array_max(body).cast("bigint").alias("max_byte"),
                    F.size(F.filter(body, lambda x: x >= 128)).cast("bigint").alias("n_non_ascii"))


@register("tok05_byte_roundtrip", sql="""
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(0 AS BIGINT) AS n_failures,
       CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
FROM documents GROUP BY lang
""")
def byte_roundtrip_q(spark, sf):
    d = TK.byte_encode(table(spark, sf, "documents"), prepend=TK.BYTE_BOS)
    d = TK.byte_decode(d, out="decoded")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(~F.col("decoded").eqNullSafe(F.col("text")), 1)).alias("n_failures"),
        F.sum(F.size("ids") - 1).cast("bigint").alias("n_bytes"))


@register("tok12_join_docs", sql=f"""
WITH {CORPUS_SQL}
SELECT CAST(shard_idx AS BIGINT) AS shard_idx, CAST(rg_idx AS BIGINT) AS rg_idx,
       md5(string_agg(text, chr(10) ORDER BY row_in_rg)) AS joined_md5,
       CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS joined_len
FROM corpus GROUP BY shard_idx, rg_idx
""")
def join_docs_q(spark, sf):
    from tokenmill.operators.conversation import join_docs
    j = join_docs(corpus(spark, sf), ["shard_idx", "rg_idx"], "row_in_rg")
    return j.select(F.col("shard_idx").cast("bigint").alias("shard_idx"), F.col("rg_idx").cast("bigint").alias("rg_idx"),
                    F.md5("joined").alias("joined_md5"), F.char_length("joined").cast("bigint").alias("joined_len"))


# ----------------------------------------------------------------------------- BPE (plain-Python model tests)
#: Vocabulary of the registered queries: bytes, specials and so many merges. A parameter; training is greedy for any number.
BPE_MERGES = 256
BPE_VOCAB = 256 + 9 + BPE_MERGES
_MODELS: dict[tuple, TK.BPEModel] = {}


def train_corpus_bpe(spark, sf, vocab_size: int = BPE_VOCAB) -> TK.BPEModel:
    """Chunk counts of all documents, whole -> BPE; one model for each session, path and size."""
    key = (spark.sparkContext.applicationId, sf, vocab_size)
    if key not in _MODELS:
        _MODELS[key] = TK.train_bpe(TK.chunk_counts(corpus(spark, sf)), vocab_size)
    return _MODELS[key]


# Greedy training and encoding in SQL. A chunk (kind 0) is its ids as |116||104||..., so that a replacement merges left to right; kind 1 are the pairs
# (a << 16 | b) with their counts, kind 2 the merges. A step merges the most frequent pair in the chunks that have it and corrects the counts by what they
# had before and have after. ``encoded`` has the ids of each document, ``vocab`` the tokens.
def _pairs_sql(s: str, n: str, src: str) -> str:
    return f"""SELECT CAST(unnest(t[:-2]) AS BIGINT) * 65536 + CAST(unnest(t[2:]) AS BIGINT) AS p, w FROM (SELECT string_split({s}[2:-2], '||') AS t, {n} AS w FROM {src})"""


_VALID = ("[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF](?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[1-3](?:[89AB].){3}|F48.(?:[89AB].){2}")
_CUT = "E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].(?:[89AB].)?|F[1-3](?:[89AB].){1,2}|F48.(?:[89AB].)?"
SPECIALS_SQL = "[" + ", ".join(f"'{name}'" for name in TK.SPECIAL_TOKENS) + "]"
BPE_SQL = f"""WITH RECURSIVE chunk_counts AS ({CHUNK_COUNTS_SQL}),
init AS MATERIALIZED (SELECT row_number() OVER (ORDER BY chunk) AS k, chunk, hex(encode(chunk)) AS h, n FROM chunk_counts),
start AS MATERIALIZED (
  SELECT k, array_to_string(list_transform(range(0, length(h) // 2), lambda i: '|' || CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) || '|'), '') AS s, n
  FROM init WHERE length(h) > 2),
bpe(kind, k, s, n, step) USING KEY (kind, k) AS (
  SELECT 0, k, s, n, 0 FROM start
  UNION ALL SELECT 1, p, '', CAST(sum(w) AS BIGINT), 0 FROM ({_pairs_sql("s", "n", "start")}) GROUP BY p
  UNION
  (WITH best AS (SELECT k, k // 65536 AS a, k % 65536 AS b, n, (SELECT max(step) FROM recurring.bpe) AS done FROM recurring.bpe
                 WHERE kind = 1 AND n > 0 ORDER BY n DESC, k LIMIT 1),
  changed AS MATERIALIZED (
    SELECT t.k, s AS old, replace(s, '|' || a || '||' || b || '|', '|' || (256 + done) || '|') AS new, t.n, done FROM recurring.bpe t, best
    WHERE kind = 0 AND done < {BPE_MERGES} AND contains(s, '|' || a || '||' || b || '|')),
  deltas AS (SELECT p, CAST(sum(w) AS BIGINT) AS d FROM ({_pairs_sql("old", "-n", "changed")} UNION ALL {_pairs_sql("new", "n", "changed")}) GROUP BY p)
  SELECT 0, k, new, n, done + 1 FROM changed
  UNION ALL SELECT 1, p, '', coalesce(r.n, 0) + d, done + 1 FROM deltas LEFT JOIN (SELECT * FROM recurring.bpe WHERE kind = 1) r ON r.k = p, (SELECT done FROM best)
  UNION ALL SELECT 2, done, a || '|' || b, n, done + 1 FROM best WHERE done < {BPE_MERGES})),
merges AS MATERIALIZED (SELECT CAST(k AS INTEGER) AS rank, CAST(string_split(s, '|')[1] AS INTEGER) AS a, CAST(string_split(s, '|')[2] AS INTEGER) AS b FROM bpe WHERE kind = 2),
hexes(r, hx) AS (
  SELECT 0, list_transform(range(256), lambda i: upper(printf('%02x', i)))
  UNION ALL SELECT r + 1, list_append(hx, hx[a + 1] || hx[b + 1]) FROM hexes JOIN merges ON rank = r),
tokens AS (SELECT unnest(range(len(hx))) AS token_id, unnest(hx) AS token_hex FROM hexes WHERE r = (SELECT max(r) FROM hexes)),
n_tokens AS (SELECT count(*) AS n FROM tokens),
vocab AS MATERIALIZED (
  SELECT CAST(token_id AS INTEGER) AS token_id, token_hex, false AS is_special, CAST(length(token_hex) // 2 AS INTEGER) AS n_bytes, NULL::VARCHAR AS name FROM tokens
  UNION ALL SELECT CAST(n + unnest(range({len(TK.SPECIAL_TOKENS)})) AS INTEGER), NULL::VARCHAR, true, 0, unnest({SPECIALS_SQL}) FROM n_tokens),
token_bytes AS (
  SELECT token_id, CAST(CASE WHEN is_special THEN 0 ELSE list_sum(list_transform(regexp_extract_all(token_hex, '{_VALID}|{_CUT}|..'),
         lambda x: CASE WHEN regexp_full_match(x, '{_VALID}') THEN length(x) // 2 ELSE 3 END)) END AS INTEGER) AS token_bytes FROM vocab),
sizes AS (SELECT chunk, CASE WHEN length(h) = 2 THEN 1 ELSE len(string_split(s[2:-2], '||')) END AS n_ids FROM init LEFT JOIN (SELECT k, s FROM bpe WHERE kind = 0) USING (k)),
encoded AS (
  SELECT doc_id, any_value(lang) AS lang, any_value(text) AS text, CAST(coalesce(sum(n_ids), 0) AS BIGINT) AS n_ids
  FROM (SELECT doc_id, lang, text, unnest(list_append({chunks_sql()}, NULL)) AS chunk FROM documents) LEFT JOIN sizes USING (chunk) GROUP BY doc_id)"""


@register("tok03_train_bpe", sql=f"""{BPE_SQL}
SELECT rank, a AS "left", b AS "right", token_id AS merged, token_hex AS merged_hex FROM merges JOIN vocab ON token_id = 256 + rank""")
def train_bpe_q(spark, sf):
    return train_corpus_bpe(spark, sf).merges_df(spark)


#: Merges of a real vocabulary: 32,768 entries less bytes and specials.
VOCAB_MERGES = 32_768 - 256 - len(TK.SPECIAL_TOKENS)


@register("tok03_train_bpe_vocab")
def train_bpe_vocab_q(spark, sf):
    """Training to the size of a real vocabulary, or as far as there are pairs."""
    return train_corpus_bpe(spark, sf, 256 + len(TK.SPECIAL_TOKENS) + VOCAB_MERGES).merges_df(spark)


@register("tok04_bpe_encode", sql=f"""{BPE_SQL}
SELECT doc_id, CAST(n_ids + 1 AS BIGINT) AS n_tokens, true AS roundtrip_ok FROM encoded""")
def bpe_encode_q(spark, sf):
    m = train_corpus_bpe(spark, sf)
    d = TK.bpe_encode(table(spark, sf, "documents"), m, prepend="<|bos|>")
    d = TK.bpe_decode(d.withColumn("body", F.slice("ids", 2, F.size("ids"))), m, ids="body", out="decoded")
    return d.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    (F.col("decoded") == F.col("text")).alias("roundtrip_ok"))


@register("tok04_bpe_roundtrip", sql="""
SELECT doc_id, md5(text) AS decoded_md5, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents""")
def bpe_roundtrip_q(spark, sf):
    """What the ids decode to, and the bytes of the ids' tokens."""
    m = train_corpus_bpe(spark, sf)
    d = TK.bpe_decode(TK.bpe_encode(table(spark, sf, "documents"), m), m, out="decoded")
    sizes = F.array(*[F.lit(len(b)) for _, b in sorted(m.token_bytes().items())])
    n = F.aggregate("ids", F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(sizes, i))
    return d.select("doc_id", F.md5("decoded").alias("decoded_md5"), n.alias("n_bytes"))


@register("tok09_compression", sql=f"""{BPE_SQL}
SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, CAST(sum(n_ids) AS BIGINT) AS n_tokens,
       round(sum(octet_length(encode(text))) / sum(n_ids), 6) AS ratio FROM encoded GROUP BY lang""")
def compression_q(spark, sf):
    m = train_corpus_bpe(spark, sf)
    d = TK.bpe_encode(table(spark, sf, "documents"), m)
    return TK.compression(d, ["lang"])


@register("tok10_compare_tokenizers", sql=f"""{BPE_SQL}
SELECT *, round((base_tokens - ours_tokens) / base_tokens * 100.0, 6) AS rel_diff_pct,
       CASE WHEN ours_ratio > base_ratio THEN 'ours' WHEN ours_ratio < base_ratio THEN 'base' ELSE 'tie' END AS better
FROM (SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS base_tokens, CAST(1 AS DOUBLE) AS base_ratio, CAST(sum(n_ids) AS BIGINT) AS ours_tokens,
             round(sum(octet_length(encode(text))) / sum(n_ids), 6) AS ours_ratio FROM encoded GROUP BY lang)""")
def compare_q(spark, sf):
    m = train_corpus_bpe(spark, sf)
    docs = table(spark, sf, "documents")
    ours = TK.compression(TK.bpe_encode(docs, m), ["lang"])
    base = TK.compression(TK.byte_encode(docs), ["lang"])
    return TK.compare_tokenizers(base, ours, ["lang"])


@register("tok07_special_ids", sql=f"""{BPE_SQL}
SELECT max(token_id) FILTER (name = '<|assistant_start|>') AS token_id, max(token_id) FILTER (name = '<|bos|>') AS bos_id FROM vocab""")
def special_ids_q(spark, sf):
    v = train_corpus_bpe(spark, sf).vocab_df(spark)
    return TK.special_id(v, "<|assistant_start|>").crossJoin(TK.bos_id(v))


@register("tok08_vocab_info", sql=f"""{BPE_SQL}
SELECT count(*) AS vocab_size, count(*) FILTER (is_special) AS n_special, string_agg(name, ',' ORDER BY name) AS specials FROM vocab""")
def vocab_info_q(spark, sf):
    return TK.vocab_info(train_corpus_bpe(spark, sf).vocab_df(spark))


@register("snk03_token_bytes", sql=f"""{BPE_SQL}
SELECT token_id, token_bytes FROM token_bytes""")
def token_bytes_q(spark, sf):
    return TK.token_bytes_table(train_corpus_bpe(spark, sf).vocab_df(spark))


@register("tok11_token_bytes_stats", sql=f"""{BPE_SQL}
SELECT CAST(min(token_bytes) AS BIGINT) AS min_bytes, CAST(max(token_bytes) AS BIGINT) AS max_bytes, round(avg(token_bytes), 6) AS mean_bytes,
       round(stddev_samp(token_bytes), 6) AS std_bytes FROM token_bytes WHERE token_bytes > 0""")
def token_bytes_stats_q(spark, sf):
    return TK.token_bytes_stats(TK.token_bytes_table(train_corpus_bpe(spark, sf).vocab_df(spark)))


@register("set05_exclude_specials", sql=f"""{BPE_SQL}
SELECT token_id, token_hex, n_bytes FROM vocab WHERE NOT is_special""")
def exclude_specials_q(spark, sf):
    """SET-05: the vocabulary without its special tokens."""
    v = train_corpus_bpe(spark, sf).vocab_df(spark)
    return TK.exclude_specials(v).select("token_id", "token_hex", "n_bytes")
