"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to ORDER with frozen counts. A byte's probability is its share
in the longest seen context, c / (T + D), where T counts the context's bytes and D its distinct ones; an unseen byte
first pays the escape D / (T + D) and falls to the next shorter context, at last to 1/256. The exact code length of a
text is the sum over its bytes; the language with the shortest one wins.

Defined results: a null text or one without a letter gives 'und' with score 0; ties go to the first language in
alphabetical order; with nothing to learn from, every text gives 'und'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import is_held_out, slices, unit_hash

ORDER = 4
LETTER = re.compile(r"[^\W\d_]")
TABLE_BITS = 19
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def windows(data: bytes) -> np.ndarray:
    """For each byte from the ORDER-th on: itself (low 8 bits) and the ORDER bytes before it."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - ORDER
    out = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= b[ORDER - k : ORDER - k + n] << np.uint64(8 * k)
    return out


def joined(texts: list[str]) -> tuple[bytes, list[int]]:
    """Texts in lower case as UTF-8, each after ORDER line feeds; the start and end of each among the windows."""
    parts, at, pos = [], [], 0
    for t in texts:
        raw = t.lower().encode("utf-8", "replace")
        parts += [b"\n" * ORDER, raw]
        at += [pos, pos + len(raw)]
        pos += len(raw) + ORDER
    return b"".join(parts), at


def grow(texts: list[str]) -> list[tuple]:
    """The context tree of some texts: by order, sorted (context, byte) codes with counts, and contexts with T and D."""
    data, at = joined(texts)
    if len(data) <= ORDER:
        return []
    w = windows(data)
    own = np.zeros(len(w), bool)
    for a, b in zip(at[::2], at[1::2]):
        own[a:b] = True
    w, tree = w[own], []
    for k in range(ORDER + 1):
        code, n = np.unique(w & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        ctx, first = np.unique(code >> np.uint64(8), return_index=True)
        tree.append((
            code, n.astype(np.float64), ctx, np.add.reduceat(n, first).astype(np.float64) if len(first) else n.astype(np.float64),
            np.diff(np.append(first, len(code))).astype(np.float64)
        ))
    return tree


def found(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(keys, at)
    i[i == len(keys)] = 0
    return i, keys[i] == at


def code_bits(tree: list[tuple], w: np.ndarray) -> np.ndarray:
    """Exact code length in bits of each window's last byte."""
    bits, open_ = np.zeros(len(w)), np.arange(len(w))
    for k in range(ORDER, -1, -1):
        if not len(open_) or not tree:
            break
        code, n, ctx, total, distinct = tree[k]
        own = w[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
        i, seen = found(ctx, own >> np.uint64(8))
        j, hit = found(code, own)
        whole = total[i] + distinct[i]
        bits[open_] += np.where(hit, np.log2(whole / n[j]), np.where(seen, np.log2(whole / distinct[i]), 0.0))
        open_ = open_[~hit]
    bits[open_] += 8.0
    return bits


class Coder:
    """Sums code lengths by text and language; remembers the windows it has priced."""

    def __init__(self, model: dict[str, list]):
        self.langs = sorted(model)
        self.trees = [model[x] for x in self.langs]
        self.keys = np.full(1 << TABLE_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.vals = np.zeros((1 << TABLE_BITS, len(self.langs)))

    def price(self, w: np.ndarray) -> np.ndarray:
        i = ((w * GOLDEN) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out, miss = self.vals[i], self.keys[i] != w
        if miss.any():
            u, back = np.unique(w[miss], return_inverse=True)
            cost = np.stack([code_bits(t, u) for t in self.trees], axis=1)
            out[miss] = cost[back]
            j = ((u * GOLDEN) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            self.keys[j], self.vals[j] = u, cost
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits by text and language."""
        total = np.zeros((len(texts), len(self.langs)))
        for i, j in slices(texts, 300_000):
            data, at = joined(texts[i:j])
            w = windows(data)
            for a in range(0, len(w), 600_000):  # a very long text goes through in parts
                run = self.price(w[a : a + 600_000])
                for k in range(j - i):
                    lo, hi = max(at[2 * k] - a, 0), min(at[2 * k + 1] - a, len(run))
                    if hi > lo:
                        total[i + k] += run[lo:hi].sum(0)
        return total

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the evidence."""
        return self.explain(texts)[:2]

    def explain(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """predict() and, for each text with a letter, the bits by which its best code is longer (or shorter, below 0) than its plain bytes."""
        texts = ["" if t is None else t for t in texts]
        named, score, excess = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        has = [k for k, t in enumerate(texts) if LETTER.search(t)] if self.langs else []
        if has:
            bits = self.code_lengths([texts[k] for k in has])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for k, b, s in zip(has, best, share):
                named[k], score[k] = self.langs[b], s
            excess[has] = bits.min(1) - [8.0 * len(texts[k].encode("utf-8", "replace")) for k in has]
        return named, score, excess


def train(docs: DataFrame, docs_per_language: int = 250, bytes_per_language: int = 1 << 24) -> dict[str, list]:
    """A tree for each language from about docs_per_language whole texts of about bytes_per_language at most.

    They are drawn by a hash of id and text, row by row, and equal rows once. Rows whose crc32(doc_id) is divisible
    by 5 and rows without a language are never used.
    """
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not sizes:
        return {}
    shares = {r.lang: min(docs_per_language / r.n, bytes_per_language / max(r.bytes, 1)) for r in sizes}
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    drawn: dict[str, list[str]] = {}
    for r in rows.where(unit_hash("doc_id", "text", F.lit(2)) < share[F.col("lang")]).distinct().collect():
        drawn.setdefault(r.lang, []).append(r.text)
    return {k: grow(v) for k, v in drawn.items()}


def identify(docs: DataFrame, model: dict[str, list], text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """docs with a struct column (lang_pred string, score double, excess double); other columns stay as they are.

    excess is null where no language is named.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, excess double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared.value)
        for b in batches:
            lang, s, excess = coder.explain([x if isinstance(x, str) else None for x in b.tolist()])
            yield pd.DataFrame({"lang_pred": lang, "score": s, "excess": [None if np.isnan(x) else x for x in excess]})

    return docs.withColumn(out, named(F.col(text_col)))
