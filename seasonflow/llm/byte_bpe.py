"""Byte-level BPE encoding and decoding as a tree reduction over text halves.

The encodings of adjacent texts form a monoid. A text is halved until a part is short enough to be encoded alone; two
neighbours are joined by encoding anew a window around their border. The split pattern never matches across a place
where a single space stands between two other characters, before that space, whatever stands elsewhere; the window
therefore grows on each side, doubling, until it ends at such a place inside its half or takes in the whole half. The
tokens outside the window are then the same as in the encoding of the joined text. Decoding concatenates bytes up the
same tree.

Defined results: a null text counts as empty and gives no tokens; any ranks that cover all single bytes will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 16_384
FIRST_WINDOW = 64
SAFE = re.compile(r"(?<=\S) (?=\S)")


def load(path: str, pattern: str):
    """The tiktoken encoding of a file of ranks, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def last_safe(text: str, lo: int, mid: int) -> int:
    """The last safe place of text[lo:mid], found in a growing window; lo if there is none."""
    n = FIRST_WINDOW
    while True:
        start = max(lo, mid - n)
        at = -1
        for m in SAFE.finditer(text, start, mid):
            at = m.start()
        if at >= 0:
            return at
        if start == lo:
            return lo
        n *= 2


def first_safe(text: str, mid: int, hi: int) -> int:
    """The first safe place of text[mid:hi], found in a growing window; hi if there is none."""
    n = FIRST_WINDOW
    while True:
        end = min(hi, mid + n)
        m = SAFE.search(text, mid, end)
        if m:
            return m.start()
        if end == hi:
            return hi
        n *= 2


def encode(enc, text: str, lo: int = 0, hi: int | None = None, leaf: int = LEAF_CHARS) -> list[int]:
    """Token ids of text[lo:hi]."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf:
        return enc.encode_ordinary(text[lo:hi])
    mid = (lo + hi) // 2
    left, right = encode(enc, text, lo, mid, leaf), encode(enc, text, mid, hi, leaf)
    a, b = last_safe(text, lo, mid), first_safe(text, mid, hi)
    drop_left, drop_right = len(enc.encode_ordinary(text[a:mid])), len(enc.encode_ordinary(text[mid:b]))
    return left[: len(left) - drop_left] + enc.encode_ordinary(text[a:b]) + right[drop_right:]


def decode(enc, ids: list[int], leaf: int = LEAF_CHARS) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(enc, ids[:mid], leaf) + decode(enc, ids[mid:], leaf)


def encode_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array column of token ids; path is a file of ranks, there on every machine."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(path, pattern)
        for b in batches:
            yield pd.Series([encode(enc, t) for t in b.fillna("").tolist()], dtype=object)

    return docs.withColumn(out, encoded(F.col(text_col)))


def decode_column(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of an array column of token ids; null stays null."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load(path, pattern)
        for b in batches:
            yield pd.Series([None if x is None else decode(enc, list(x)) for x in b], dtype=object)

    return df.withColumn(out, decoded(F.col(ids_col)))


def digest_column(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """docs with a struct (n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded in one pass.

    For round-trip checks: ids and bytes are hashed where they are made and don't travel.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = load(path, pattern)
        for b in batches:
            rows = []
            for t in b.fillna("").tolist():
                ids = encode(enc, t)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(enc, ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(out, digested(F.col(text_col)))
