"""Near-duplicate texts by improved consistent weighted sampling.

A text is the set of its shingles of five words (\\w+ in lower case), each weighing (1 + ln tf) * idf. The idf of a
shingle is the mean of its words' 1 + ln(N / df) / ln(N + 1), which lies between 1 and 2: common phrases count less,
and a copy in a group of thousands is judged like one in a pair. df counts documents for each of WORD_BUCKETS word
hashes, over all documents. A consistent weighted sample of a text keeps, for each of bands x rows hash functions, the
shingle with the least value of Ioffe's ln a = ln c - r * (floor(ln w / r + beta) - beta + 1); two texts share a
sample with a probability equal to their weighted Jaccard similarity. Texts that agree in all samples of a band meet.

Texts with the same words are one class from the start. Then each class is compared with the smallest one that it
meets in any band; links join components. At last every band key that still holds more than one component is settled:
its members, whatever their number, are dealt into blocks of bounded rows and bytes, blocks of those outside the
largest component meet each other and that component's, each pair of blocks goes to one task with the members' texts,
and there every two members of different components are compared. From keys of more than one block those texts go
first whose own shingles, which no other text of such keys has, weigh too much for any match: texts that only quote
the same passage aren't dealt at all. A task returns links that join components, never pairs that don't; keys with
the same members are settled once. So all texts that share a
band are compared or joined by links already: texts 0.8 alike miss each other in all of 14 bands of 3 once in 20000
times, in keys of any size. All comparisons are exact weighted Jaccard similarities.

Defined results: null texts and texts without words are never linked; a text of fewer than five words is one
shingle; rows that repeat a doc_id are one document, whose text is the smallest one that isn't null; a null doc_id is
not returned.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import added_up, cut
from seasonflow.llm.components import components

WORD = re.compile(r"\w+")
#: Bytes of ASCII texts: what \w doesn't match becomes a space.
SPACED = bytes(c if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes([32]) * 128
SHINGLE = 5
WORD_BUCKETS = 1 << 18
POOL_BITS = 16
KNOWN_WORDS = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


def split_words(text: str) -> list[str]:
    """The words (\\w+) of text in lower case; ASCII texts take a shorter way."""
    text = text.lower()
    return text.encode("ascii").translate(SPACED).decode("ascii").split() if text.isascii() else WORD.findall(text)


class Words:
    """Word hashes of texts; remembers the words it has hashed."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found, known = split_words(text), self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    raw = w.encode("utf-8", "replace")
                    known[w] = zlib.crc32(raw) << 32 | zlib.crc32(raw + b"#", 0x9E3779B9)
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def bucket(words: np.ndarray) -> np.ndarray:
    return ((words * MIX) >> np.uint64(64 - 18)).astype(np.int64)


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and their weights."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0)
    n = max(1, len(words) - SHINGLE + 1)
    size = min(SHINGLE, len(words))
    h, w, own = np.full(n, np.uint64(size)), np.zeros(n), idf[bucket(words)]
    for k in range(size):
        h = (h ^ words[k : k + n]) * STEP
        h ^= h >> np.uint64(29)
        w += own[k : k + n]
    h, first, tf = np.unique(h * MIX, return_index=True, return_counts=True)
    return h, w[first] / size * (1 + np.log(tf))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: the sum of lesser weights over the sum of greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    less = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - less
    return less / whole if whole > 0 else 0.0


class Sampler:
    """Consistent weighted samples with k hash functions.

    r, ln c and beta of a shingle come from a pool of 2^16 draws, picked by its hash under each function; of shingles
    that tie, the smaller hash counts.
    """

    def __init__(self, k: int, seed: int = 9):
        g = np.random.default_rng(seed)
        self.odd = g.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        n = 1 << POOL_BITS
        self.r = g.gamma(2.0, 1.0, n).astype(np.float32)
        self.ln_c = np.log(g.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = g.random(n).astype(np.float32)

    def __call__(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        ln_w = np.log(w).astype(np.float32)
        best, least, functions = None, None, np.arange(len(self.odd))
        for at in range(0, len(h), 512):
            part = h[at : at + 512]
            i = ((self.odd[:, None] * part) >> np.uint64(64 - POOL_BITS)).view(np.intp)
            r, beta = self.r.take(i, mode="clip"), self.beta.take(i, mode="clip")
            t = ln_w[at : at + 512] / r
            t += beta
            np.floor(t, t)
            np.subtract(t, beta, beta)
            beta += np.float32(1)
            beta *= r
            value = np.subtract(self.ln_c.take(i, mode="clip"), beta, r)
            row = value.argmin(1)  # hashes are sorted: the first of equals is the smaller hash
            found, sample = value[functions, row], part[row] ^ (t[functions, row].astype(np.int64).astype(np.uint64) * STEP)
            if best is None:
                best, least = sample, found
            else:
                better = found < least
                best, least = np.where(better, sample, best), np.where(better, found, least)
        return best


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by bucket of their words, and all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out, words = np.zeros(WORD_BUCKETS + 1, np.int64), Words()
        for b in batches:
            out[WORD_BUCKETS] += len(b)
            for t in b["text"]:
                if isinstance(t, str):
                    out[bucket(words(t))] += 1  # a bucket that stands several times among the indices counts once
        return out

    n = added_up(docs.select("text"), count, WORD_BUCKETS + 1)
    return n[:WORD_BUCKETS], int(n[WORD_BUCKETS])


def smoothed_idf(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(max(n, 1) / np.maximum(df, 1)) / np.log(n + 2)).clip(1, 2)


def sampled(docs: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """(doc_id, same, size, keys) of each text with words: a digest of its words, its length and a hash for each band."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, sampler, own = Words(), Sampler(bands * rows), idf.value
        odd = np.random.default_rng(5).integers(0, 1 << 63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            ids, same, size, keys = [], [], [], []
            for i, t in zip(b["doc_id"], b["text"]):
                w = words(t) if isinstance(t, str) else ()
                if not len(w):
                    continue
                ids.append(i)
                same.append(w.tobytes())
                size.append(len(t))
                s = sampler(*shingles(w, own)).reshape(bands, rows)
                h = odd.copy()
                for k in range(rows):
                    h = (h ^ s[:, k]) * STEP
                    h ^= h >> np.uint64(31)
                keys.append(h.view(np.int64))
            if ids:
                yield pd.DataFrame({"doc_id": ids, "same": [hashlib.blake2b(x, digest_size=16).digest() for x in same], "size": size, "keys": keys})

    return docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, same binary, size long, keys array<long>")


def compared(pairs: DataFrame, texts: DataFrame, idf, least: float, block: int = 64) -> DataFrame:
    """Those pairs(a, b) whose texts are at least `least` alike, with their similarity. Pairs of one a are dealt into blocks of about block."""
    many = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "many")
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / block)).cast("int").alias("part"))
    dealt = cut(dealt, "pairs")
    t = texts.select(F.col("doc_id").alias("id"), "text")
    first = dealt.select("a", "part").distinct().join(t.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    other = dealt.join(t.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        words, own = Words(), idf.value
        is_first = g["b"].isna().to_numpy()
        text = g["text"].to_numpy()
        mine = shingles(words(text[np.flatnonzero(is_first)[0]]), own)
        out = []
        for k in np.flatnonzero(~is_first):
            theirs = shingles(words(text[k]), own)
            lo, hi = sorted((mine[1].sum(), theirs[1].sum()))
            if lo >= least * hi * (1 - 1e-9) and (alike := similarity(mine, theirs)) >= least:
                out.append((int(g["a"].iloc[0]), int(g["b"].iloc[k]), float(alike)))
        return pd.DataFrame(out, columns=["a", "b", "alike"]).astype({"a": "int64", "b": "int64", "alike": "float64"})

    return first.unionByName(other).groupBy("a", "part").applyInPandas(compare, "a long, b long, alike double")


def settled(texts: list[str], c: np.ndarray, main: int, second: np.ndarray, idf: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of texts at least `least` alike that join different components c, found by an inverted index.

    Where second holds anything, only pairs of a text in second with one outside count. Pairs within main are not
    compared, nor are those that earlier links have joined.
    """
    words = Words()
    own = [shingles(words(t), idf) for t in texts]
    n = np.array([len(h) for h, _ in own])
    whole = np.array([w.sum() for _, w in own])
    doc, w = np.repeat(np.arange(len(own)), n), np.concatenate([w for _, w in own])
    _, key, held = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True, return_counts=True)
    met = held[key] > 1
    doc, w, key = doc[met], w[met], key[met]
    order = np.argsort(key, kind="stable")
    posted, weighing, start = doc[order], w[order], np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(held)))])
    mine = np.searchsorted(doc, np.arange(len(own) + 1))
    label, apart, found = c.copy(), second.any(), []
    for x in np.flatnonzero(c != main):
        open_ = (label != label[x]) & ((c == main) | (np.arange(len(own)) > x))
        if apart:
            open_ &= second != second[x]
        open_ &= np.minimum(whole, whole[x]) >= least * np.maximum(whole, whole[x]) * (1 - 1e-9)
        if not open_.any():
            continue
        k = key[mine[x] : mine[x + 1]]
        many = start[k + 1] - start[k]
        at = np.repeat(start[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        less = np.bincount(posted[at], np.minimum(weighing[at], np.repeat(w[mine[x] : mine[x + 1]], many)), minlength=len(own))
        for y in np.flatnonzero(open_ & (less >= least * (whole + whole[x] - less) * (1 - 1e-9))):
            if label[y] != label[x] and similarity(own[x], own[y]) >= least:
                label[label == label[y]] = label[x]
                found.append((int(x), int(y)))
    return found


def mixed(members: DataFrame) -> DataFrame:
    """Keys of members(key, doc_id, c, size) that hold several components: (key, main, n, size, main_n, main_size), main being the largest one.

    Of keys with the same members, one.
    """
    counts = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("doc_id")).alias("who"))
    keys = counts.groupBy("key").agg(
        F.max(F.struct("n", "c", "size")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"),
        F.bit_xor("who").alias("who")
    )
    one = F.min(F.struct("key", F.col("m.c").alias("main"), F.col("m.n").alias("main_n"), F.col("m.size").alias("main_size"))).alias("k")
    return keys.where("parts > 1").groupBy("n", "size", "who").agg(one).select("k.*", "n", "size")


def unmatched(texts: DataFrame, idf, least: float) -> DataFrame:
    """(doc_id) of texts(doc_id, text) that hold too much which no other of them holds to be `least` alike to any of them.

    What a text shares with another one is at most its weight without the shingles that it alone has, and both
    together weigh no less than the text. So the search loses no pair.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, own = Words(), idf.value
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                h, w = shingles(words(t), own)
                yield pd.DataFrame({"doc_id": np.full(len(h), i), "h": h.view(np.int64), "share": (w / w.sum()).astype(np.float32)})

    held = texts.select("doc_id", "text").mapInPandas(listed, "doc_id long, h long, share float")
    lone = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("share").alias("share")).where("n = 1")
    # shares are rounded to floats; the slack is wider than their sum's error
    return lone.groupBy("doc_id").agg(F.sum("share").alias("share")).where(F.col("share") > 1 - least + 1e-3).select("doc_id")


def dealt_members(members: DataFrame, texts: DataFrame, idf, least: float, block: int, block_bytes: int) -> DataFrame:
    """(key, p, q, main, doc_id, c, second): members of mixed keys, once for each task (key, p, q) that they go to.

    A key's largest component is its main one; the others are its rest. Blocks of the rest meet each other and those
    of main, blocks of main don't meet. Task (p, p) holds block p of the rest and block 0 of main, (p, q > p) two
    blocks of the rest, (p, -j) block p of the rest and block j of main. From keys of more than one block those
    members go first that no other member of such a key can match.
    """
    in_blocks = lambda n, size: F.least(n, F.greatest(F.ceil(n / block), F.ceil(size / block_bytes))).cast("int")
    keys = cut(mixed(members), "mixed")
    crowded = keys.where(in_blocks(F.col("n"), F.col("size")) > 1).select("key")
    if not crowded.isEmpty():
        in_mixed = cut(members.join(keys.select("key"), "key"), "mixed")
        ids = in_mixed.join(crowded, "key", "left_semi").select("doc_id").distinct()
        lone = cut(unmatched(texts.join(ids.hint("merge"), "doc_id", "left_semi"), idf, least), "lone")
        gone = in_mixed.join(crowded, "key", "left_semi").join(lone, "doc_id").select("key", "doc_id")
        members = cut(in_mixed.join(gone, ["key", "doc_id"], "left_anti").select("key", "doc_id", "c", "size"), "matched")
        keys = cut(mixed(members), "mixed")
    keys = keys.select(
        "key", "main", in_blocks(F.col("n") - F.col("main_n"), F.col("size") - F.col("main_size")).alias("rest_blocks"),
        in_blocks(F.col("main_n"), F.col("main_size")).alias("main_blocks")
    )
    is_main = F.col("c") == F.col("main")
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(is_main, F.col("main_blocks")).otherwise(F.col("rest_blocks")).cast("long")).cast("int")
    task = lambda p, q, second: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), second.alias("second"))
    rest = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    beyond = F.filter(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: j > 0)
    of_rest = F.concat(
        F.transform(rest, lambda o: task(F.least(o, "own"), F.greatest(o, "own"), F.col("own") > o)),
        F.transform(beyond, lambda j: task(F.col("own"), -j, F.lit(False)))
    )
    of_main = F.transform(rest, lambda o: F.when(F.col("own") == 0, task(o, o, F.lit(False))).otherwise(task(o, -F.col("own"), F.lit(True))))
    placed = members.join(keys, "key").withColumn("own", own)
    return placed.select("key", "main", "doc_id", "c", F.explode(F.when(is_main, of_main).otherwise(of_rest)).alias("at")).select(
        "key", "main", "doc_id", "c", "at.*"
    )


def crossing(members: DataFrame, texts: DataFrame, idf, least: float, block: int, block_bytes: int) -> DataFrame:
    """Links (a, b) between components c that share a key in members(key, doc_id, c, size)."""
    held = cut(dealt_members(members, texts, idf, least, block, block_bytes), "dealt").join(texts, "doc_id")

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        ids = g["doc_id"].to_numpy()
        found = settled(g["text"].tolist(), g["c"].to_numpy(), g["main"].iloc[0], g["second"].to_numpy(), idf.value, least)
        return pd.DataFrame([(ids[x], ids[y]) for x, y in found], columns=["a", "b"]).astype("int64")

    return held.groupBy("key", "p", "q").applyInPandas(settle, "a long, b long")


def one_text_each(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the smallest text of each doc_id that repeats; other rows aren't shuffled."""
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return docs
    several = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return cut(docs.join(again, "doc_id", "left_anti").unionByName(several), "once")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 14, rows: int = 3, block: int = 256, block_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, class_id, kept) for every document: class_id is the smallest doc_id of its class, which is kept.

    block, block_bytes: the most rows and about the most bytes of text in a block of members of one band key; a task
    holds two blocks.
    """
    docs = one_text_each(docs.select("doc_id", "text").where("doc_id is not null"))
    df, n = document_frequencies(docs)
    idf = docs.sparkSession.sparkContext.broadcast(smoothed_idf(df, n))
    signed = cut(sampled(docs, idf, bands, rows), "signed")
    classes = cut(signed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size"), F.first("keys").alias("keys")), "classes")
    member = cut(signed.select("doc_id", "same").join(classes.select("same", "rep"), "same").select("doc_id", "rep"), "member")
    keyed = classes.select(F.col("rep").alias("doc_id"), "size", F.explode("keys").alias("key"))
    # keys that more than one class has
    shared = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least"), "shared")
    keyed = cut(keyed.join(shared, "key"), "met")
    # a merge join at every size: the ids grow with the documents
    texts = cut(docs.join(keyed.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    first = keyed.where("least < doc_id").groupBy("doc_id").agg(F.min("least").alias("a")).select("a", F.col("doc_id").alias("b"))
    links = cut(compared(cut(first, "first"), texts, idf, threshold).select("a", "b"), "links")
    label = components(links)
    placed = keyed.select("key", "doc_id", "size").join(label.toDF("doc_id", "c"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("c", "doc_id").alias("c"), "size"
    )
    links = cut(links.unionByName(crossing(cut(placed, "placed"), texts, idf, threshold, block, block_bytes)), "links")
    label = components(links)
    out = member.join(label.toDF("rep", "c"), "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("class_id"))
    out = docs.select("doc_id").join(cut(out, "grouped"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("class_id") == F.col("doc_id"))
