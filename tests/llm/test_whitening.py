"""Whitening against plain linear algebra on exact numbers, and on odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from seasonflow.llm import registry, whitening


def plain(vecs: list[list[float]]):
    """x, n, exact sums, covariance in doubles from exact fractions."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vecs]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    t = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in t), n**3)) for j in range(d)] for i in range(d)])
    return x, n, t, cov


def query(spark, tmp_path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return registry.op13_jacobi_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("d", [1, 5, 12])
def test_whitened_rows_against_plain_algebra(spark, tmp_path, d):
    g = np.random.default_rng(d)
    vecs = (g.normal(size=(300, d)) @ g.normal(size=(d, d)) + 3).astype(np.float32).tolist()
    bad = [None, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), []]
    got = query(spark, tmp_path, [*enumerate(vecs), *((1000 + i, b) for i, b in enumerate(bad)), (7, vecs[7]), (None, vecs[8])])
    fitted = [*vecs, vecs[7], vecs[8]]
    _, n, t, cov = plain(fitted)
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1], units[:, ::-1].T
    k = min(8, d)
    assert len(got) == len(fitted) * k and {r.vec_id for r in got} == {*range(300), None}
    sign = {}
    for r in got:
        i, c = (r.vec_id if r.vec_id is not None else 301), r.component - 1
        want = np.array(t[i], float) / n @ units[c] / np.sqrt(values[c])
        s = sign.setdefault(c, np.sign(want) * np.sign(r.whitened)) if abs(want) > 1e-3 else sign.get(c)
        assert s is None or abs(r.whitened - s * want) < 1e-8
        assert (r.n, r.deviation, r.deviation_exact) == (n, sum(a * a for a in t[i]), str(sum(a * a for a in t[i])))
        assert abs(r.explained - values[c] / cov.trace()) < 1e-10 and r.identity_error < 1e-9
    assert set(range(1, k + 1)) == {r.component for r in got} and len({r.identity_error for r in got}) == 1


def test_tables_without_a_spread_have_no_component(spark, tmp_path):
    assert query(spark, tmp_path, []) == []
    assert query(spark, tmp_path, [(1, None)]) == []
    assert query(spark, tmp_path, [(1, [1.0, 2.0])]) == []
    assert query(spark, tmp_path, [(i, [1.0, 2.0]) for i in range(9)]) == []


def test_components_end_at_the_rank(spark, tmp_path):
    got = query(spark, tmp_path, [(i, [float(i), float(2 * i), 5.0, float(i)]) for i in range(50)])
    assert {r.component for r in got} == {1} and len(got) == 50
    assert abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-10


def test_lengths_are_tables_of_their_own_and_large_entries_stay_exact(spark, tmp_path):
    rows = [(i, [float(i), float(i * i % 17)]) for i in range(40)] + [(100 + i, [float(i % 3)]) for i in range(10)]
    rows += [(200 + i, [1e14 * (i + 1), -1e13 * i * i, 3.0 + i % 2]) for i in range(6)] + [(300, [1e300, 0.0, 0.0])]
    got = query(spark, tmp_path, rows, "double")
    assert {r.vec_id: r.n for r in got} == {i: 40 if i < 100 else 10 if i < 200 else 6 for i, _ in rows[:-1]}
    _, n, t, _ = plain([v for _, v in rows[50:56]])
    for r in got:
        if r.vec_id >= 200:
            exact = sum(a * a for a in t[r.vec_id - 200])
            assert r.deviation_exact == str(exact) and r.deviation is None and r.identity_error < 1e-6


@pytest.mark.parametrize("rank", [3, 20])
def test_jacobi_on_the_cholesky_factor(rank):
    g = np.random.default_rng(rank)
    a = g.normal(size=(90, rank)) @ g.normal(size=(rank, 20)) * np.logspace(0, 2, 20)
    scatter = a.T @ a
    factor = whitening.pivoted_cholesky(scatter)
    assert factor.shape[1] == rank and np.allclose(factor @ factor.T, scatter, rtol=1e-12, atol=1e-9 * scatter.max())
    values, units = whitening.eigen(scatter, 8)
    want = np.linalg.eigvalsh(scatter)[::-1][: len(values)]
    assert np.allclose(values, want, rtol=1e-9) and np.allclose(units @ units.T, np.eye(len(units)), atol=1e-13)
    assert np.allclose(scatter @ units.T, units.T * values, atol=1e-9 * values[0])


def test_states_add_up_in_any_order():
    x = np.random.default_rng(1).integers(-(10**6), 10**6, size=(500, 4)) + 10**9
    one, parts = whitening.State.of(x), [whitening.State.of(x[i : i + 37]) for i in range(0, 500, 37)]
    for order in (parts, parts[::-1]):
        total = whitening.State(order[0].n, order[0].sums, order[0].block)
        for s in order[1:]:
            total.add(s)
        assert total.n == 500 and total.sums == one.sums and np.allclose(total.block, one.block, rtol=1e-12)


def test_clashing_names_are_kept_apart(spark):
    df = spark.createDataFrame([(i, [float(i), float(i % 5)], "x") for i in range(20)], "v long, embedding array<double>, white string")
    got = whitening.whiten(df, whitening.fit(df), out="white")
    assert got.columns == ["v", "embedding", "white"] and got.where("white.n = 20").count() == 20
