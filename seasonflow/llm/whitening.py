"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on the triangular factor.

An entry c becomes the whole number x = floor(SCALE * c) + SHIFT. Each task adds up the exact sums of its x and their
scatter about its own mean; two such states join by the exact difference of their means, so nothing is multiplied
before it is centred and one pass over the vectors is enough. States are added in two rounds, in blocks of scatter
rows, so that no task holds more than a bounded part of them. The scatter of each vector length is then factored as
L L' with pivoting, and columns of L are rotated in pairs until all are at right angles: V = L L' keeps its value, the
rotated columns' squared norms are its eigenvalues, the normalised columns its eigenvectors.

Defined results: rows whose vector is null, or holds null or non-finite entries, or entries of 2^52 and more (whose x and
its differences a long may not hold), are left out; so are empty vectors, which have no component. Vectors of different
lengths are tables of their own: each length has its own fit, n and components. Components beyond the rank of the
scatter don't exist: a table of one vector, or of equal ones, has none and gives no row. Of the two signs, a component
has the one that makes its largest entry (ties: the first) positive. deviation is exact; where it exceeds a long it is
null, and deviation_exact has it as text. Rows that repeat an id are vectors of their own. A row without an id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import fresh

SCALE, SHIFT = 1024.0, 100_000
#: Entries of a scatter that travel in one row, and entries of a table that are worked on at once.
PART, CHUNK = 1 << 17, 1 << 20
#: Groups into which the states of all tasks are added first.
FAN = 256
#: Most bytes of fitted models that every task gets.
MOST_MODEL_BYTES = 1 << 28
STATE = "dim int, part int, grp int, n long, sums array<decimal(38,0)>, block binary"


class Model(NamedTuple):
    """The fit of one vector length: sums holds whole numbers; rows of components are unit vectors, by falling eigenvalue.

    error is the largest absolute entry of the whitened vectors' covariance minus the identity.
    """

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    error: float = 0.0


def whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each vector length: places of the usable vectors in the column and their x, in chunks."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(n)])[:-1]
    for d in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == d)
        for at in range(0, len(rows), step := max(1, CHUNK // d)):
            own = rows[at : at + step]
            c = SCALE * flat[starts[own][:, None] + np.arange(d)]
            good = (np.abs(c) < 2.0**62).all(1)  # false for NaN too
            if good.any():
                yield own[good], np.floor(c[good]).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns as whole numbers of any size."""
    high, low = x >> 31, x & (2**31 - 1)
    return [(int(a) << 31) + int(b) for a, b in zip(high.sum(0), low.sum(0))]


def step(na: int, sa: list[int], nb: int, sb: list[int]) -> np.ndarray:
    """The difference of two means, each entry rounded once."""
    return np.array([(b * na - a * nb) / (na * nb) for a, b in zip(sa, sb)])


class State:
    """n, exact sums and rows first.. of the scatter of the vectors added so far."""

    def __init__(self, n: int, sums: list[int], block: np.ndarray, first: int = 0):
        self.n, self.sums, self.block, self.first = n, sums, block, first

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        y = (x - x[0]).astype(np.float64)
        sums = exact_sums(x)
        mean = np.array([(s - int(a) * len(x)) / len(x) for s, a in zip(sums, x[0])])
        y -= mean
        return cls(len(x), sums, y.T @ y)

    def add(self, other: State) -> None:
        gap = step(self.n, self.sums, other.n, other.sums)
        rows = slice(self.first, self.first + len(self.block))
        self.block = self.block + other.block + np.outer(gap[rows], gap) * (self.n / (self.n + other.n) * other.n)
        self.n, self.sums = self.n + other.n, [a + b for a, b in zip(self.sums, other.sums)]


def rows_in_part(d: int) -> int:
    return max(1, PART // d)


def scatters(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows of STATE that add up to the scatter of each vector length: one for each part of it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, State] = {}
        grp = 0
        for b in batches:
            if b.num_rows:
                grp = b.column("grp")[0].as_py()
            for _, x in whole(b.column("v")):
                own = State.of(x)
                held[x.shape[1]].add(own) if x.shape[1] in held else held.__setitem__(x.shape[1], own)
        for d, s in held.items():
            step = rows_in_part(d)
            for part, at in enumerate(range(0, d, step)):
                yield pa.RecordBatch.from_pydict(
                    {"dim": [d], "part": [part], "grp": [grp], "n": [s.n], "sums": [s.sums], "block": [s.block[at : at + step].tobytes()]},
                    pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("grp", pa.int32()), ("n", pa.int64()),
                               ("sums", pa.list_(pa.decimal128(38, 0))), ("block", pa.binary())])
                )

    def added(g: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in g.itertuples():
            own = State(int(r.n), [int(s) for s in r.sums], np.frombuffer(r.block).reshape(-1, r.dim), r.part * rows_in_part(r.dim))
            total.add(own) if total else (total := own)
        first = g.iloc[0]
        return pd.DataFrame({
            "dim": [first["dim"]], "part": [first["part"]], "grp": [0], "n": [total.n], "sums": [[Decimal(s) for s in total.sums]],
            "block": [total.block.tobytes()]
        })

    vectors = vectors.select(F.col(vec_col).cast("array<double>").alias("v"), (F.spark_partition_id() % FAN).cast("int").alias("grp"))
    once = vectors.mapInArrow(counted, STATE)
    return once.groupBy("dim", "part", "grp").applyInPandas(added, STATE).groupBy("dim", "part").applyInPandas(added, STATE)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with as many columns as a has rank, L L' = a; triangular once its rows are in the order of the pivots."""
    d = len(a)
    factor, left = np.zeros((d, d)), a.diagonal().copy()
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    open_ = np.ones(d, bool)
    for k in range(d):
        pivot = int(np.argmax(np.where(open_, left, -np.inf)))
        if left[pivot] <= least:
            return factor[:, :k]
        column = a[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        open_[pivot] = False
        root = np.sqrt(left[pivot])
        factor[open_, k] = column[open_] / root
        factor[pivot, k] = root
        left = left - factor[:, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of factor, rotated in pairs until they are at right angles, as rows."""
    rows = factor.T.copy()
    if len(rows) % 2:
        rows = np.vstack([rows, np.zeros((1, rows.shape[1]))])
    half, order = len(rows) // 2, np.arange(len(rows))
    enough = np.finfo(float).eps * np.sqrt(max(rows.shape[1], 1))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(rows) - 1, 0)):
            p, q = order[:half], order[half:][::-1]
            a, b = rows[p], rows[q]
            aa, bb, ab = (np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (b, b), (a, b)))
            size = np.sqrt(aa) * np.sqrt(bb)
            slant = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            worst = max(worst, slant.max())
            turn = slant > enough
            if turn.any():
                zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                c, s = c[:, None], (c * t)[:, None]
                rows[p[turn]], rows[q[turn]] = c * a[turn] - s * b[turn], s * a[turn] + c * b[turn]
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if worst <= enough:
            break
    return rows


def eigen(scatter: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a scatter, at most `most`, and their unit vectors as rows."""
    scale = np.abs(scatter).max(initial=0.0) or 1.0
    rows = one_sided_jacobi(pivoted_cholesky(scatter / scale))
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    best = [k for k in np.argsort(-norms, kind="stable")[:most] if norms[k] ** 2 > len(scatter) * np.finfo(float).eps * norms.max() ** 2]
    units = rows[best] / norms[best][:, None]
    lead = np.abs(units).argmax(1) if len(units) else np.zeros(0, int)
    return norms[best] ** 2 * scale, units * np.where(units[np.arange(len(units)), lead] < 0, -1.0, 1.0)[:, None]


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 8) -> dict[int, Model]:
    """A model for each vector length, fitted on all usable vectors of that length.

    A length's scatter meets in one task, which returns its first components: `components` x length numbers reach the
    driver and later every task, for all lengths MOST_MODEL_BYTES at most.
    """

    def solved(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        d, n = int(g["dim"].iloc[0]), int(g["n"].iloc[0])
        scatter = np.vstack([np.frombuffer(x).reshape(-1, d) for x in g["block"]])
        values, units = eigen((scatter + scatter.T) / 2, components)
        return pd.DataFrame({
            "dim": [d], "n": [n], "sums": [list(g["sums"].iloc[0])], "trace": [float(scatter.trace() / n)], "vals": [list(values / n)], "units": [units.tobytes()]
        })

    schema = "dim int, n long, sums array<decimal(38,0)>, trace double, vals array<double>, units binary"
    out, size = {}, 0
    for r in scatters(vectors, vec_col).groupBy("dim").applyInPandas(solved, schema).toLocalIterator():
        out[r.dim] = Model(r.n, [int(s) for s in r.sums], r.trace, np.array(r.vals), np.frombuffer(r.units).reshape(-1, r.dim).copy())
        if (size := size + len(r.units) + 40 * r.dim) > MOST_MODEL_BYTES:
            raise ValueError("vectors of so many lengths are not one table of embeddings")
    errors = identity_errors(vectors, out, vec_col)
    return {d: m._replace(error=errors[d]) for d, m in out.items()}


def centred(x: np.ndarray, m: Model) -> np.ndarray:
    """n * x - S, exactly: as longs where they hold it, else as Python's whole numbers."""
    if m.n * (int(np.abs(x).max()) + 1) < 2**62 and max(map(abs, m.sums)) < 2**62:
        return x * m.n - np.array(m.sums, np.int64)
    return x.astype(object) * m.n - np.array(m.sums, object)


def deviations(t: np.ndarray) -> list[int]:
    """Sums of squares of whole numbers by row, exactly."""
    if t.dtype != object and (float(np.abs(t).max()) + 1) ** 2 * t.shape[1] < 2.0**62:
        return (t * t).sum(1).tolist()
    return [sum(int(a) * int(a) for a in row) for row in t]


def projected(t: np.ndarray, m: Model) -> np.ndarray:
    return (t.astype(np.float64) / m.n) @ m.components.T / np.sqrt(m.values)


def identity_errors(vectors: DataFrame, model: dict[int, Model], vec_col: str = "embedding") -> dict[int, float]:
    """By vector length, the largest absolute entry of the whitened vectors' covariance minus the identity.

    Whitened vectors are centred to within rounding; what is left of their mean is taken off all the same.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in whole(b.column("v")):
                m = model[x.shape[1]]
                w = np.hstack([projected(centred(x, m), m), np.ones((len(x), 1))])
                held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for d, s in held.items():
            i, j = map(np.ravel, np.indices(s.shape))
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "s": s.ravel()})

    parts = vectors.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(counted, "dim int, i int, j int, s double")
    sums = {d: np.zeros((len(m.values) + 1,) * 2) for d, m in model.items()}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        sums[r.dim][r.i, r.j] = r.s
    out = {}
    for d, m in model.items():
        mean = sums[d][-1, :-1] / m.n
        cov = sums[d][:-1, :-1] / m.n - np.outer(mean, mean)
        out[d] = float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, model: dict[int, Model], vec_col: str = "embedding", out: str = "white") -> DataFrame:
    """Rows of vectors that have a fit, with a struct `out`: n, deviation, deviation_exact, whitened and explained by component, identity_error."""
    schema = pa.struct([
        ("n", pa.int64()), ("deviation", pa.int64()), ("deviation_exact", pa.string()), ("whitened", pa.list_(pa.float64())),
        ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())
    ])

    kind = "struct<n:bigint,deviation:bigint,deviation_exact:string,whitened:array<double>,explained:array<double>,identity_error:double>"

    @F.arrow_udf(kind)
    def added(v: pa.Array) -> pa.Array:
        rows: list = [None] * len(v)
        for at, x in whole(v):
            m = model.get(x.shape[1])
            if m is None:
                continue
            t = centred(x, m)
            share = (m.values / m.trace).tolist()
            for k, dev, w in zip(at.tolist(), deviations(t), projected(t, m).tolist()):
                rows[k] = {"n": m.n, "deviation": dev if dev < 2**63 else None, "deviation_exact": str(dev), "whitened": w, "explained": share, "identity_error": m.error}
        return pa.array(rows, schema)

    own = fresh(vectors, out)
    # not deterministic: else the filter would compute it a second time
    once = added.asNondeterministic()
    done = vectors.withColumn(own, once(F.col(vec_col).cast("array<double>"))).where(F.col(own).isNotNull())
    return done if own == out else done.drop(*[c for c in vectors.columns if c.lower() == out.lower()]).withColumnRenamed(own, out)
