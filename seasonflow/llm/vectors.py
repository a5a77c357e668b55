"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Every vector lives in the cell of its nearest centre and also visits each cell whose border is near: of two vectors
at an angle of at most t, at least one is within t / 2 of the great-circle border between their cells, so it visits
the other's cell, and no link is lost. Where both visit each other, the cell with the smaller number counts the link.
Vectors of a length other than the most common one form a cell for each length, without visitors. Cosines are taken
in double precision. A cell's residents and visitors are dealt into blocks; each pair of resident blocks and each
resident block with each visitor block is one product, so that a cell of any size spreads over many tasks. Cells
and blocks grow with the table up to what a task may hold, so that a vector travels to a bounded number of products
while the table grows to PARTS times that. A product returns, for each vector, its number of links and its smallest
partner through links of that product: pairs are never listed.

How much the cells prune depends on the vectors: those in clusters visit few cells, while for directions without any
structure in d dimensions most borders are near and the work is that of all pairs, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id,
link with nothing; so do vectors of different lengths with each other. Vectors are scaled by their largest component
first, so no finite one overflows or vanishes. Cosines within 1e-9 of the threshold are decided by exact sums, the
same in every block. Equal vectors are compared once and counted by their number. Rows that repeat an id are vectors
of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonflow.llm.common import cut, unit_hash
from seasonflow.llm.components import components

#: Blocks into which a table is cut at least; the least and the most vectors in a block, and its most bytes.
PARTS, LEAST_BLOCK, MOST_BLOCK, BLOCK_BYTES = 16, 1024, 16384, 1 << 25
#: Slack for rounding at borders.
EPS = 1e-6


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a finite, non-zero vector."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def centres(vectors: DataFrame, k: int, n: int, d: int, seed_rows: int, rounds: int = 4) -> np.ndarray:
    """Unit centres by spherical k-means on about seed_rows of n vectors, drawn by hash; sums are made where the rows are."""
    drawn = cut(vectors.select("v").where(unit_hash("v") < seed_rows / max(n, 1)), "seeds")
    first = drawn.orderBy(F.xxhash64("v"), "v").limit(k).collect()
    if not first:
        first = vectors.select("v").limit(k).collect()
    c = unit(np.array([r.v for r in first], np.float64))
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                if b.num_rows:
                    x = unit(rows_of(b.column("v")))
                    own = (x @ c.T).argmax(1)
                    np.add.at(total, own, x)
                    seen += np.bincount(own, minlength=len(c))
            at = np.flatnonzero(seen)
            if len(at):
                yield pa.RecordBatch.from_pydict({"cell": at, "s": pa.array(list(total[at]), pa.list_(pa.float64()))})

        parts = drawn.mapInArrow(sums, "cell long, s array<double>")
        added = parts.groupBy("cell").agg(*[F.sum(F.col("s")[i]).alias(f"x{i}") for i in range(d)]).collect()
        c = c.copy()
        for r in added:
            x = np.array(r[1:], dtype=np.float64)
            if (norm := np.sqrt(x @ x)) > 0:
                c[r[0]] = x / norm
    return np.unique(c, axis=0)


def assign(vectors: DataFrame, c: np.ndarray, threshold: float, kind: str) -> DataFrame:
    """Rows (key, v, w, cell, home, visits): one in the vector's own cell, which lists the cells that it visits, and one in each of those."""
    reach = math.sin(math.acos(threshold) / 2) + EPS
    step = max(16, (1 << 22) // len(c))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for at in range(0, all_.num_rows, step):
                b = all_.slice(at, step)
                s = unit(rows_of(b.column("v"))) @ c.T
                own, every = s.argmax(1), np.arange(len(s))
                home, at_home = np.unique(own, return_inverse=True)
                # distances from the batch's own centres; those between all centres would grow with their square
                gap = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 1e-30))
                near = (s[every, own][:, None] - s) / gap[at_home] <= reach
                near[every, own] = True
                row, cell = np.nonzero(near)
                resident = cell == own[row]
                # a resident lists its cells, a visitor none
                many = np.where(resident, near.sum(1)[row], 0)
                listed = np.nonzero(near[row[resident]])[1].astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(listed))
                kept = b.select(["key", "v", "w"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell), pa.array(own[row]), visits], names=["key", "v", "w", "cell", "home", "visits"])

    return vectors.select("key", "v", "w").mapInArrow(dealt, f"key long, v {kind}, w long, cell long, home long, visits array<int>")


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1, the smallest name reached over the links a-b."""
    label = names.copy()
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == old).all():
            return label


def product(g: pa.Table, threshold: float) -> pa.Table:
    """Links within one pair of blocks: (key, to, n), n counting linked rows and to being the smallest key reached.

    side is 0 for the first block's residents, 1 for those of a second block, 2 for visitors.
    """
    column = lambda c: g.column(c).to_numpy()
    side, key, w = column("side"), column("key"), column("w")
    raw = rows_of(g.column("v"))
    x = unit(raw)
    i, j = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    alone = g.column("p")[0].as_py() == g.column("q")[0].as_py()  # a block with itself
    j = i if alone else j
    others, links = x[j].T.copy(), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(i), 512):
        part = i[at : at + 512]
        cosine = x[part] @ others
        near = cosine >= threshold - 1e-9
        if alone:
            near &= part[:, None] < j[None, :]
        p, q = np.nonzero(near)
        close = np.flatnonzero(cosine[p, q] < threshold + 1e-9)
        sure = np.ones(len(p), bool)
        for k in close:
            a, b = sorted((part[p[k]], j[q[k]]), key=lambda n: key[n])
            sure[k] = exact_cosine(raw[a] / np.abs(raw[a]).max(), raw[b] / np.abs(raw[b]).max()) >= threshold
        links.append((part[p[sure]], j[q[sure]]))
    a, b = (np.concatenate(z) for z in zip(*links))
    if len(a) and (side[b] == 2).any():  # a visitor whose own cell the resident visits too: the smaller cell counts
        cell, home = g.column("cell")[0].as_py(), column("home")
        visits = g.column("visits").combine_chunks()
        row = np.repeat(np.arange(len(visits)), np.diff(visits.offsets.to_numpy()))
        span = int(home.max()) + 1
        known = np.unique(row * span + np.minimum(visits.flatten().to_numpy(), span))
        again = (home[b] < cell) & np.isin(a * span + home[b], known)
        a, b = a[~again], b[~again]
    n = np.zeros(len(key), np.int64)
    np.add.at(n, a, w[b])
    np.add.at(n, b, w[a])
    met = np.flatnonzero(n)
    return pa.table({"key": key[met], "to": smallest_reached(len(key), a, b, key)[met], "n": n[met]})


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, cells: int | None = None,
    block: int | None = None
) -> DataFrame:
    """One row per row of df: (id, n_links, component_id, kept); one vector of each group of linked ones is kept.

    block: residents in a block, by default a PARTS-th of the distinct vectors within the bounds above; cells: their
    number, by default so many that one holds about a block. Centres are fitted on about 20000 vectors, or 8 for each
    centre where that is more; they are the only thing that goes to every task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kind = rows.schema["v"].dataType.simpleString()
    good = usable(rows, "v").where("id is not null").select("id", "v", F.xxhash64("v").alias("key"))
    # equal vectors become one
    distinct = cut(good.groupBy("key", "v").agg(F.min("id").alias("vid"), F.count(F.lit(1)).alias("w")).withColumn("d", F.size("v")), "distinct")
    lengths = distinct.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    d, n = lengths[0].d, lengths[0].n
    block = block or max(LEAST_BLOCK, min(n // PARTS, MOST_BLOCK, BLOCK_BYTES // (8 * d)))
    common = distinct.where(F.col("d") == d)
    k = max(1, cells or n // block)
    c = centres(common, k, n, d, seed_rows=max(20_000, 8 * k))
    apart = distinct.where(F.col("d") != d).select(
        "key", "v", "w", (-F.col("d")).cast("long").alias("cell"), (-F.col("d")).cast("long").alias("home"),
        F.array().cast("array<int>").alias("visits")
    )
    dealt = cut(assign(common, c, threshold, kind).unionByName(apart), "dealt").withColumn("resident", F.col("home") == F.col("cell"))
    sizes = dealt.groupBy("cell").agg(
        F.ceil(F.count_if("resident") / block).cast("int").alias("br"),
        F.ceil(F.count_if(~F.col("resident")) / (2 * block)).cast("int").alias("bv")
    )
    # visitors of a cell without residents meet nobody
    placed = dealt.join(cut(sizes.where("br > 0"), "sizes"), "cell")
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.when(F.col("resident"), F.col("br")).otherwise(F.col("bv")).cast("long")).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.alias("side"))
    # product (p, q): resident blocks p <= q; product (p, -1 - q): residents of block p with visitors of block q
    with_residents = F.transform(up_to(F.col("br")), lambda o: group(F.least(o, "own"), F.greatest(o, "own"), F.when(F.col("own") <= o, 0).otherwise(1)))
    with_visitors = F.transform(F.filter(up_to(F.greatest("bv", F.lit(1))), lambda o: o < F.col("bv")), lambda o: group(F.col("own"), -1 - o, F.lit(0)))
    as_visitor = F.transform(up_to(F.col("br")), lambda o: group(o, -1 - F.col("own"), F.lit(2)))
    at = F.when(F.col("resident"), F.concat(with_residents, with_visitors)).otherwise(as_visitor)
    placed = placed.withColumn("own", own).select(
        "key", "v", "w", "cell", "home", "visits", F.explode(at).alias("at")
    ).select("key", "v", "w", "cell", "home", "visits", "at.*")

    def met(g: pa.Table) -> pa.Table:
        return product(g, threshold)

    found = cut(placed.groupBy("cell", "p", "q").applyInArrow(met, "key long, to long, n long"), "met")
    group_of = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = distinct.select("key", "vid", "w").join(counted, "key", "left").join(group_of.toDF("key", "g"), "key", "left")
    named = cut(named.select("key", "vid", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("g", "key").alias("g")), "named")
    smallest = named.groupBy("g").agg(F.min("vid").alias("component_id"))
    result = cut(named.join(smallest, "g").select("key", "n_links", "component_id"), "result")
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.xxhash64("v")).alias("key")).join(result, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
