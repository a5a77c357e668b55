"""Mixing by weights of any length, and schedules that go on when a source ends."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonflow.llm import mixing


def docs_of(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, n long").select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("doc_id"))


def plain(ps, ns):
    """(source, block, slot, epoch, released, due) by one pass over the slots, epoch by epoch."""
    ps, had, out, epoch, start = list(ps), [0] * len(ps), [], 0, 0
    while any(p and n > h for p, n, h in zip(ps, ns, had)):
        ps = [p if n > h else 0 for p, n, h in zip(ps, ns, had)]
        q, done = sum(ps), [0] * len(ps)
        while True:
            t = len(out) - start
            _, i = min((-(-(done[i] + 1) * q // p), i) for i, p in enumerate(ps) if p and done[i] * q // p <= t)
            if had[i] + done[i] == ns[i]:
                break
            done[i] += 1
            out.append((i, had[i] + done[i], len(out), epoch, start + (done[i] - 1) * q // ps[i], start - (-done[i] * q // ps[i])))
        had = [h + d for h, d in zip(had, done)]
        epoch, start = epoch + 1, len(out)
    return out


CASES = [
    ({"a": 0.1234567890123457, "b": 0.5432109876543211}, {"a": 700, "b": 1500}),
    ({"a": 1717 / 15000, "b": 1 / 7, "c": "2/3"}, {"a": 300, "b": 40, "c": 900}),
    ({"a": 3, "b": 2, "c": 0}, {"a": 5, "b": 400, "c": 30}),
    ({f"s{k}": 1 / (k + 3) for k in range(6)}, {f"s{k}": 10 + 37 * k for k in range(6)}),
]


@pytest.mark.parametrize("weights, sizes", CASES)
def test_a_schedule_that_goes_on(spark, weights, sizes):
    got = mixing.mixed(docs_of(spark, sizes), weights=weights, frame=50, go_on=True).toPandas()
    names = sorted(sizes)
    ps = mixing.whole(weights)
    want = plain([ps[s] for s in names], [sizes[s] for s in names])
    mine = got[got.in_mix].sort_values("slot")
    assert [(names.index(r.source), r.block, r.slot, r.epoch, r.released, r.due) for r in mine.itertuples()] == want
    assert len(got) == sum(sizes.values()) and len(mine) == sum(n for s, n in sizes.items() if ps[s])
    # within an epoch each share is off by less than a block
    for e, part in mine.groupby("epoch"):
        alive = [s for s in names if ps[s] and sum(1 for w in want if w[3] < e and names[w[0]] == s) < sizes[s]]
        total = sum(ps[s] for s in alive)
        for s in alive:
            seen = np.cumsum(part.source == s)
            assert all(abs(Fraction(int(x)) - Fraction((t + 1) * ps[s], total)) < 1 for t, x in enumerate(seen))


def test_shares_as_floats_over_many_rows(spark):
    """16 uneven sources, 60000 rows, shares with all their digits: every row of a source with a weight gets a slot."""
    sizes = {f"s{k:02}": 20 + (k * k * 3989) % 7900 for k in range(16)}
    total = sum(sizes.values())
    weights = {s: (n / total) ** 0.7 for s, n in sizes.items()}
    got = mixing.mixed(docs_of(spark, sizes), weights=weights, go_on=True)
    assert got.where("slot is null").count() == 0 and got.count() == total
    assert got.agg(F.count_distinct("slot"), F.max("slot")).first()[:] == (total, total - 1)
    assert got.where("slot < released or slot >= due").count() == 0


def test_weights_without_room_are_an_error():
    with pytest.raises(ValueError, match="common denominator"):
        mixing.whole({"a": 1e-30, "b": 0.5})


def test_uneven_sources_against_sql(spark):
    """The mix that ends at the first source, by the query's SQL on a table with uneven sources."""
    from conftest import same_rows

    from seasonflow.llm import registry

    df = docs_of(spark, {"a": 40, "b": 3, "c": 160, "d": 77}).select((F.monotonically_increasing_id()).alias("doc_id"), "source")
    df = spark.createDataFrame(df.collect(), "doc_id long, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = mixing.mixed(df).withColumn("slot", F.col("slot").cast("double"))
    same_rows(got, con.execute(f"SELECT * REPLACE (slot::DOUBLE AS slot) FROM ({registry.ORACLES['op4_pfair_mixing']})").df())
