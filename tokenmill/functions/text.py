"""Column-level text helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the reference ---------------------------------
# Special tokens, in id order (their ids follow the byte/merge vocabulary).
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]
# Pre-tokenizer: GPT-4 style split with numbers grouped by at most two digits.
SPLIT_PATTERN = (r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+""")
# ---------------------------------------------------------------------------------

# Lookahead-free variant that RE2 (DuckDB) also accepts; used where an SQL
# oracle has to produce the same chunks.
SIMPLE_SPLIT_PATTERN = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+"

N_BYTES = 256

# White space as Python's str.strip() sees it; the same class works in Java's and RE2's expressions.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP_PATTERN = rf"^[{SPACES}]+|[{SPACES}]+\z"


def strip(text: str | Column) -> Column:
    """Text without leading and trailing white space, Unicode's included."""
    return F.regexp_replace(col(text), STRIP_PATTERN, "")


def strip_sql(expr: str) -> str:
    """DuckDB twin of :func:`strip`."""
    return f"regexp_replace({expr}, '{STRIP_PATTERN}', '', 'g')"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pretokenize(text: str | Column, pattern: str = SPLIT_PATTERN, unicode: bool = True) -> Column:
    """TOK-01: split text into chunks. ``(?U)`` gives Java the Unicode classes Python's regex uses."""
    pat = ("(?U)" + pattern) if unicode else pattern
    return F.regexp_extract_all(col(text), F.lit(pat), 0)


def byte_ids(text: str | Column) -> Column:
    """TOK-13: UTF-8 bytes of a string as ARRAY<INT>, linear and JVM-side.

    The UTF-8 bytes are re-read as ISO-8859-1, which maps every byte to exactly
    one character, so ``split(.., '')`` + ``ascii`` yields the byte values.
    """
    latin1 = F.decode(F.encode(col(text), "UTF-8"), "ISO-8859-1")
    return F.when(latin1 == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(latin1, ""), lambda c: F.ascii(c)))


def bytes_to_text(ids: str | Column) -> Column:
    """TOK-05 on the byte vocabulary: ids < 256 are bytes, specials are dropped; bytes that are no UTF-8 become U+FFFD."""
    kept = F.filter(col(ids), lambda x: x < N_BYTES)
    hexs = F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return F.make_valid_utf8(F.unhex(hexs).cast("string"))


def utf8_len(text: str | Column) -> Column:
    return F.octet_length(col(text)).cast("bigint")


def char_len(text: str | Column) -> Column:
    """Code points (Python ``len``)."""
    return F.char_length(col(text)).cast("bigint")


def words(text: str | Column) -> Column:
    return F.split(col(text), " ")


def first_half(text: str | Column) -> Column:
    w = words(text)
    return F.array_join(F.slice(w, 1, F.greatest(F.floor(F.size(w) / 2), F.lit(1)).cast("int")), " ")


def second_half(text: str | Column) -> Column:
    w = words(text)
    h = F.greatest(F.floor(F.size(w) / 2), F.lit(1)).cast("int")
    return F.array_join(F.slice(w, h + 1, F.greatest(F.size(w) - h, F.lit(0))), " ")
