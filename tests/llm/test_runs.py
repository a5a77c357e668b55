"""Periodic runs against a brute-force search, on planted and odd texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seasonflow.llm import registry, runs

DOC = "doc_id long, text string"


def brute(w: list) -> list[tuple[int, int, int]]:
    """Every period, every place, the smallest period by trying all."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(6, 4 * q) and not any(all(w[j] == w[j + r] for j in range(s, s + n - r)) for r in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out)


def collapsed(w: list[str], found: list) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(rnd: random.Random, n: int) -> list[str]:
    some = rnd.choice([1, 2, 3, 6, 100])
    w = [str(rnd.randrange(some)) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        p, a = rnd.randrange(1, max(2, n // 3)), rnd.randrange(max(1, n))
        root = [str(rnd.randrange(some)) for _ in range(p)]
        for i in range(min(n - a, rnd.randrange(1, 8) * p + rnd.randrange(p))):
            w[a + i] = root[i % p]
    return w


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_a_batch_equal_brute_force(seed):
    rnd = random.Random(seed)
    texts = [planted(rnd, rnd.randrange(300)) for _ in range(12)]
    got = list(runs.runs_of([" ".join(w).encode() for w in texts]))
    for w, (found, kept) in zip(texts, got):
        assert found == brute(w) and kept.decode() == collapsed(w, found)


@given(st.lists(st.sampled_from("ab"), max_size=60), st.integers(1, 7), st.lists(st.sampled_from("abc"), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_runs_next_to_others(head, times, root):
    w = head + root * times + head[::-1] * 4
    assert next(iter(runs.runs_of([" ".join(w).encode()])))[0] == brute(w)


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 16, 17, 31, 32, 33, 64, 100, 128, 129, 1000])
@pytest.mark.parametrize("extra", [0, 1, -1])
def test_every_scale_finds_runs_of_just_four_periods(period, extra):
    own = [f"w{i}" for i in range(period)]
    n = max(6, 4 * period) + extra
    w = ["left"] + [own[i % period] for i in range(n)] + ["right"] * 2
    found = next(iter(runs.runs_of([" ".join(w).encode()])))[0]
    assert found == ([] if extra < 0 else [(1, n, period)])


def test_long_texts_and_batches_of_their_own(monkeypatch):
    monkeypatch.setattr(runs, "BATCH", 50)
    texts = [b"a " * 200_000, b"", None, b"x y " * 30_000 + b"z", b" ".join(b"%d" % (i % 3001) for i in range(40_000))]
    got = list(runs.runs_of(texts))
    assert [r for r, _ in got] == [[(0, 200_000, 1)], [], [], [(0, 60_000, 2)], [(0, 40_000, 3001)]]
    assert [k[:9] for _, k in got[:4]] == [b"a", b"", b"", b"x y z"]


def plain_query(doc_id, text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, hashlib.sha256(collapsed(w, found).encode()).hexdigest())


def test_query_against_plain_code(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, " ".join(planted(rnd, rnd.randrange(1, 150)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "a b é\x0bé\x0cé\ré é é é é"), (None, "z z z z z z"), (5, rows[5][1]), (None, None)]
    rows += [(i, "one") for i in range(410, 440)] + [(i, "a b") for i in range(440, 480)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"{DOC}, runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op11_periodic_runs(spark, str(tmp_path)).collect()
    cols = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda t: (t[0] is None, t[0] or 0, t[1:][-1])
    assert sorted(((r.doc_id, *(r[c] for c in cols)) for r in got), key=key) == sorted(((i, *plain_query(i, t)) for i, t in rows), key=key)
    assert sum(r.n_runs > 0 and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in got) > 10
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_extra_columns_and_long_rows(spark):
    df = spark.createDataFrame([(1, "b c " * 100_000, "x"), (1, None, None)], f"{DOC}, found string")
    got = runs.periodic_runs(df, out="text2").collect()
    assert sorted((r.text2.n_words, [tuple(x) for x in r.text2.runs], r.text2.collapsed, r.found) for r in got) == [
        (0, [], "", None), (200_000, [(0, 200_000, 2)], "b c", "x")
    ]
