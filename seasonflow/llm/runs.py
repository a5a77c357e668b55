"""Periodic runs of words: seeds from multi-scale minimizers, extended to whole runs; short periods by direct lag scans.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least LEAST_TIMES * q and
LEAST_WORDS words long and that no neighbouring word extends. A batch of texts is one array of word numbers with a
number of its own after each text, so that no run leaves its text.

Periods up to LAGS: each lag's array is compared with itself and stretches of equality are read off. Beyond, scale
K = 2 LAGS, 4 LAGS, ... holds the periods in (K / 2, K]: every K words have a hash (from the two halves' hashes), every
K / 2 neighbouring hashes a minimum, leftmost on ties. Within a run of such a period q a hash of K >= q words recurs
at exactly q, since its root is primitive; and a window and the same window q later lie both inside the run, as
K / 2 + K - 1 + q <= 4 q. So some minimum recurs at q and is the next minimum with its hash: pairs of neighbouring equal minima
at distances in (K / 2, K] are the seeds, and no run is missed. A seed is compared word by word and extended both
ways; stretches with a smaller period are another run's and go. Equal hashes of different words can only add seeds,
which the comparison drops. A scale looks only at texts long enough for its periods; all scales together take
n log(n)^2 steps for n words.

Defined results: words are what lies between the ASCII white space characters (space, tab to carriage return); a null
or empty text has no words, no runs and an empty collapsed text. Rows that repeat an id are texts of their own. Texts
are read as bytes, so broken UTF-8 passes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import fresh

LEAST_TIMES, LEAST_WORDS = 4, 6
#: The longest period that is found by direct comparison; a power of two.
LAGS = 8
#: Words that are worked on at once; a longer text is a batch of its own.
BATCH = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true flags."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every `width` neighbours, leftmost on ties, in order."""
    bits = np.uint64(max(20, len(h).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    low = (h >> bits << bits) | place
    reach = 1
    while reach < width:
        low[:-reach] = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    at = low & ((np.uint64(1) << bits) - np.uint64(1))
    return at[np.flatnonzero(np.diff(at, prepend=at[:1] + np.uint64(1)))].astype(np.int64)


def seeds(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of each scale, by period and place; text k is x[starts[k]:][:sizes[k]], then a number of its own."""
    h, at, width = mixed(x.astype(np.uint64)), np.arange(len(x)), 1
    while len(h) and (sizes >= LEAST_TIMES * (width // 2 + 1)).any():
        if width > LAGS:
            low = minima(h, width // 2)
            low = low[np.argsort(h[low], kind="stable")]
            same = h[low[1:]] == h[low[:-1]]
            first, period = at[low[:-1]][same], np.diff(at[low])[same]
            fit = (period > width // 2) & (period <= width)
            first, period = first[fit], period[fit]
            order = np.lexsort((first, period))
            yield first[order], period[order]
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([h[width:], np.zeros(min(width, len(h)), np.uint64)]))
        width *= 2
        long = sizes >= LEAST_TIMES * (width // 2 + 1)
        if not long.all():
            keep = np.repeat(long, sizes + 1)
            h, at, sizes = h[keep], at[keep], sizes[long]


def equal_for(x: np.ndarray, at: int, lag: int, way: int) -> int:
    """How many words from `at` on, in the direction `way`, equal the word `lag` further on."""
    n, size = 0, 64
    most = len(x) - lag - at if way > 0 else at + 1
    while n < most:
        size = min(size * 2, 1 << 16, most - n)
        part = slice(at + n, at + n + size) if way > 0 else slice(at - n - size + 1, at - n + 1)
        differs = x[part] != x[part.start + lag : part.stop + lag]
        if differs.any():
            return n + int(differs.argmax() if way > 0 else differs[::-1].argmax())
        n += size
    return n


def divisors(q: int) -> list[int]:
    """q divided by each of its primes."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def is_smallest(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """A stretch of at least twice a period has no smaller one unless a divisor of it is one."""
    return not any((x[start : end - q] == x[start + q : end]).all() for q in divisors(period))


def find_runs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the texts in x, by start and period."""
    found = []
    for q in range(1, min(LAGS, int(sizes.max(initial=0)) // LEAST_TIMES) + 1):
        s, e = stretches(x[:-q] == x[q:])
        for k in np.flatnonzero(e - s + q >= max(LEAST_WORDS, LEAST_TIMES * q)):
            found.append((int(s[k]), int(e[k]) + q, q))
    for places, periods in seeds(x, starts, sizes):
        last, end = 0, -1
        for at, q in zip(places.tolist(), periods.tolist()):
            if q == last and at < end:
                continue
            first = at - equal_for(x, at - 1, q, -1)
            last, end = q, at + equal_for(x, at, q, 1)
            if end - first + q >= max(LEAST_WORDS, LEAST_TIMES * q):
                found.append((first, end + q, q))
    return sorted((s, e - s, q) for s, e, q in found if is_smallest(x, s, e, q))


def runs_of(texts: list[bytes | None]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs, text of the words that are no repetition) of each text, in order."""
    held: list[list[bytes]] = []
    size = 0
    for t in texts:
        own = (t or b"").split()
        if held and size + len(own) > BATCH:
            yield from _batch(held)
            held, size = [], 0
        held.append(own)
        size += len(own)
    yield from _batch(held)


def _batch(words: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    names: dict[bytes, int] = {}
    x = np.empty(int(sizes.sum()) + len(words), np.int64)
    for w, at in zip(words, starts.tolist()):
        x[at : at + len(w)] = [names.setdefault(a, len(names)) for a in w]
    x[starts + sizes] = len(names) + np.arange(len(words))
    own: dict[int, list[tuple[int, int, int]]] = {}
    for s, n, q in find_runs(x, starts, sizes):
        k = int(np.searchsorted(starts, s, "right")) - 1
        own.setdefault(k, []).append((s - int(starts[k]), n, q))
    for k, w in enumerate(words):
        runs = own.get(k, [])
        if runs:
            over = np.zeros(len(w) + 1, np.int64)
            for s, n, q in runs:
                over[s + q] += 1
                over[s + n] -= 1
            w = [w[i] for i in np.flatnonzero(np.cumsum(over[:-1]) == 0)]
        yield runs, b" ".join(w)


def periodic_runs(docs: DataFrame, text_col: str = "text", out: str = "periodic") -> DataFrame:
    """docs with a struct `out`: n_words, runs (by start and period) and the collapsed text, in which each run keeps its first period."""
    schema = pa.struct([
        ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.binary())
    ])

    @F.arrow_udf(f"struct<n_words:bigint,runs:{RUNS},collapsed:binary>")
    def found(texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        rows = [
            {"n_words": len((t or b"").split()), "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": kept}
            for t, (runs, kept) in zip(raw, runs_of(raw))
        ]
        return pa.array(rows, schema)

    raw = fresh(docs, "found")
    return docs.withColumn(raw, found(F.col(text_col).cast("binary"))).withColumn(
        out, F.struct(F.col(f"{raw}.n_words"), F.col(f"{raw}.runs"), F.col(f"{raw}.collapsed").cast("string").alias("collapsed"))
    ).drop(raw)
