"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block each. Weights are whole numbers p that add up to Q (fractions and decimals are
brought to a common denominator, so nothing is rounded). Block i (from 1) of a source is released at slot
floor((i - 1) * Q / p) and due at slot ceil(i * Q / p); each slot goes to the released block with the earliest
deadline, ties to the first source by name. No slot stays empty, every deadline is met, and after any number of slots
each source's share deviates from its target by less than one block. A source of weight 0 gets no slot.

The schedule is drawn up in frames of slots, all at once: a frame starts from a guess of how many blocks each source
has had by then, and is drawn up again where the frame before it ends otherwise, until all frames fit. What fits is
the schedule that one pass over all slots gives; as the earliest deadlines soon wipe out a wrong guess, a few rounds
do, and no task holds more than its frames.

By default the mix ends where the first source has no block left for its turn. With go_on the schedule goes on there
without the sources that have ended: the others' weights, which now add up to less, start a new epoch, within which
the bound holds again, until every block of a source with a weight has its slot. An epoch ends one source at least.

Products of blocks and weights are taken in decimals of 38 digits where longs may not hold them, so shares given as
floats with all their digits are exact too; weights whose common denominator leaves no room for that are an error.

Documents are numbered within their source in the order of their digests, in parts by the digest's first three hex
digits, so that no task sees a whole source. Every document is returned; those beyond the mix have no slot.

Defined results: a null source is a source of its own, after all others; a null id has a digest of its own; equal rows
take neighbouring numbers; a source without a weight has weight 0; where all weights are 0 nothing is mixed; an empty
table gives an empty result; weights below 0 are an error.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.llm.common import cut

#: Weights that add up to less than this are multiplied in longs, others in decimals; the most that decimals leave room for.
LONG_WEIGHTS, MOST_WEIGHTS = 1 << 22, 10**25
#: Slots in a frame.
FRAME = 1000
CHUNK = 1000


def digest(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def div(a: Column, b: Column) -> Column:
    """a / b in whole numbers."""
    return F.call_function("div", a, b)


def whole(weights: dict) -> dict:
    """Whole numbers in the ratio of weights, which are numbers, fractions or strings like 0.7004 or 2/3."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    if min(exact.values(), default=0) < 0:
        raise ValueError("a weight is below 0")
    common = math.lcm(*[w.denominator for w in exact.values()])
    p = {s: int(w * common) for s, w in exact.items()}
    part = math.gcd(*p.values()) or 1
    p = {s: x // part for s, x in p.items()}
    if sum(p.values()) >= MOST_WEIGHTS:
        raise ValueError("the weights' common denominator is too long: give them as shares with fewer digits")
    return p


def quotas(sizes: DataFrame, weights: dict | None) -> DataFrame:
    """(i, source, n, p, q): each source's place by name, its blocks, its weight and all weights together.

    Without weights p is the whole number next to the root of n. Sources are a catalogue: they meet in one window.
    """
    p = F.round(F.sqrt("n")).cast("long")
    if weights is not None:
        given = whole(weights)
        kind = "long" if sum(given.values()) < LONG_WEIGHTS else "decimal(38,0)"
        p = F.lit(0).cast(kind)
        for source, x in given.items():
            p = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(str(x)).cast(kind)).otherwise(p)
    rows = sizes.withColumn("p", p)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    return rows.select((F.row_number().over(by_name) - 1).alias("i"), "source", "n", "p", all_weights(rows.schema["p"].dataType).alias("q"))


def all_weights(kind) -> Column:
    return F.sum("p").over(Window.partitionBy(F.lit(0))).cast(kind)


def due(block: Column, p: Column, q: Column) -> Column:
    return div(block * q + p - 1, p)


def frames(quota: DataFrame, frame: int) -> DataFrame:
    """(f, first, past, q, ps, done): the slots [first, past) of each frame and a guess of the blocks done before it.

    Before slot t a source has had floor(t * p / Q) blocks or one more; the guess gives one more to those whose next
    block is due first. The last slot is the one by which some source must have had a block that it hasn't got.
    """
    some = quota.where("p > 0")
    listed = some.groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct("i", "p")))["p"].alias("ps"), F.min(due(F.col("n") + 1, F.col("p"), F.col("q"))).alias("last")
    )
    n = div(F.col("last") + frame - 1, F.lit(frame))
    of = listed.select("q", "ps", "last", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("f"))
    of = of.select("f", (F.col("f") * frame).alias("first"), F.least("last", (F.col("f") + 1) * frame).alias("past"), "q", "ps")
    low = F.transform("ps", lambda p: div(F.col("first") * p, F.col("q")))
    of = of.withColumn("low", low).withColumn("extra", F.col("first") - F.aggregate("low", F.lit(0).cast("long"), lambda s, x: s + x))
    ahead = F.transform(
        "ps",
        lambda p, i: F.when(F.pmod(F.col("first") * p, F.col("q")) > 0, F.struct(due(F.get("low", i) + 1, p, F.col("q")).alias("due"), i.alias("i")))
    )
    first = F.transform(F.slice(F.array_sort(F.filter(ahead, lambda x: x.isNotNull())), F.lit(1), F.col("extra").cast("int")), lambda x: x["i"])
    of = of.withColumn("ahead", first)
    done = F.transform("low", lambda k, i: k + F.when(F.array_contains("ahead", i), 1).otherwise(0))
    return of.select("f", "first", "past", "q", "ps", done.alias("done"))


def drawn(of: DataFrame) -> DataFrame:
    """of with plan, which holds block * sources + source of each slot, and after, the blocks done past the frame."""
    m = F.size("ps").cast("long")

    def step(state: Column, t: Column) -> Column:
        def open_(k: Column, i: Column) -> Column:
            p = F.get("ps", i)
            return F.when(div(k * F.col("q"), p) <= t, due(k + 1, p, F.col("q")) * m + i)

        pick = F.pmod(F.array_min(F.transform(state["done"], open_)), m)
        done = F.transform(state["done"], lambda k, i: F.when(i == pick, k + 1).otherwise(k))
        return F.struct(done.alias("done"), F.concat(state["plan"], F.array(F.get(done, pick.cast("int")) * m + pick)).alias("plan"))

    start = F.struct(F.col("done"), F.array().cast("array<bigint>").alias("plan"))
    end = F.aggregate(F.sequence(F.col("first"), F.col("past") - 1), start, step)
    return of.withColumn("end", end).select(*of.columns, F.col("end.plan").alias("plan"), F.col("end.done").alias("after"))


def schedule(quota: DataFrame, frame: int = FRAME) -> DataFrame:
    """(i, k, slot): the slot of block k of the i-th source, up to the slot at which a source has no block left."""
    spark = quota.sparkSession
    spread = lambda df: df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "f")
    done = cut(drawn(spread(frames(quota, frame))), "frames")
    while True:
        # frames that start otherwise than the frame before them ends
        ends = done.select((F.col("f") + 1).alias("f"), F.col("after").alias("done2"))
        wrong = cut(done.join(ends, "f").where("done <> done2").select("f", "first", "past", "q", "ps", F.col("done2").alias("done")), "wrong")
        if wrong.isEmpty():
            break
        fits = done.join(wrong.select("f"), "f", "left_anti").select(done.columns)
        done = cut(fits.unionByName(drawn(spread(wrong))), "frames")
    slots = done.select("first", F.size("ps").cast("long").alias("m"), F.posexplode("plan").alias("at", "x"))
    slots = slots.select(F.pmod("x", "m").alias("j"), div(F.col("x"), F.col("m")).alias("k"), (F.col("first") + F.col("at")).alias("slot"))
    # places among the sources with a weight -> places among all
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    named = quota.where("p > 0").select((F.row_number().over(w) - 1).cast("long").alias("j"), "i", "n")
    slots = cut(slots.join(named, "j").select("i", "k", "slot", "n"), "slots")
    horizon = slots.where("k > n").agg(F.min("slot").alias("horizon"))
    return slots.crossJoin(F.broadcast(horizon)).where("slot < horizon").select("i", "k", "slot")  # one row


def epochs(quota: DataFrame, frame: int, go_on: bool) -> DataFrame:
    """(i, k, slot, epoch, released, due): the schedule, epoch by epoch; without go_on the first one only.

    The loop runs once for each source that ends, which is a catalogue's length at most; what it carries is a row for
    each source.
    """
    quota, out, start = quota.withColumn("had", F.lit(0).cast("long")), None, 0
    for epoch in range(quota.count() if go_on else 1):
        slots = schedule(quota, frame).join(quota.select("i", "p", "q", "had"), "i")
        now = cut(slots.select(
            "i", (F.col("had") + F.col("k")).alias("k"), (F.col("slot") + start).alias("slot"), F.lit(epoch).alias("epoch"),
            (div((F.col("k") - 1) * F.col("q"), F.col("p")) + start).alias("released"), (due(F.col("k"), F.col("p"), F.col("q")) + start).alias("due")
        ), "epoch")
        out = now if out is None else out.unionByName(now)
        if not go_on:
            break
        counts = now.groupBy("i").agg(F.count(F.lit(1)).alias("c"))
        left = quota.join(counts, "i", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        left = left.select("i", "source", (F.col("n") - F.col("c")).alias("n"), "p", (F.col("had") + F.col("c")).alias("had"))
        kind = left.schema["p"].dataType
        left = left.withColumn("p", F.when(F.col("n") > 0, F.col("p")).otherwise(F.lit(0)).cast(kind)).withColumn("q", all_weights(kind))
        quota = cut(left, "quota")
        start += now.count()
        if quota.where("p > 0").isEmpty():
            break
    return out


def numbered(docs: DataFrame, id_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(source, id, nth) of every document, and (source, n)."""
    d = digest("id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source")).groupBy("source", "id").agg(F.count(F.lit(1)).alias("m"))
    rows = cut(rows.withColumn("d", d).withColumn("part", F.substring("d", 1, 3)), "rows")
    counts = cut(rows.groupBy("source", "part").agg(F.sum("m").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("source").alias("s2"), F.col("part").alias("p2"), F.coalesce(before, F.lit(0)).alias("before"))
    upto = F.sum("m").over(Window.partitionBy("source", "part").orderBy("d", F.asc_nulls_last("id")).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    placed = placed.select("source", "id", (F.col("before") + F.col("upto") - F.col("m")).alias("from"), "m")
    # rows that repeat an id, in pieces of bounded size
    pieces = placed.select("source", "id", "from", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))).alias("o"))
    nth = F.explode(F.sequence(F.col("from") + F.col("o") + 1, F.col("from") + F.least("m", F.col("o") + CHUNK)))
    return pieces.select("source", "id", nth.alias("nth")), counts.groupBy("source").agg(F.sum("n").alias("n"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict | None = None, block: int = 1, frame: int = FRAME, go_on: bool = False) -> DataFrame:
    """(id, source, nth, block, released, due, slot, in_mix) of every document; with go_on epoch too, from 0.

    weights: source -> target weight; by default the whole number next to the root of its number of documents, which
    damps large sources. block: documents of one source that go together. Sources are a catalogue, not a share of the
    documents: arrays in the schedule have one entry for each.
    """
    rows, sizes = numbered(docs, id_col, source_col)
    quota = cut(quotas(sizes.select("source", F.ceil(F.col("n") / block).cast("long").alias("n")), weights), "quota")
    rows = rows.withColumn("block", div(F.col("nth") - 1, F.lit(block)) + 1)
    of = quota.select(F.col("source").alias("s3"), "i", "p", "q")
    placed = rows.join(of, F.col("source").eqNullSafe(F.col("s3")))
    slots = epochs(quota, frame, go_on).withColumnsRenamed({"k": "block", "released": "_released", "due": "_due"})
    placed = placed.join(slots, ["i", "block"], "left")
    has = F.col("p") > 0
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "nth", "block",
        F.coalesce("_released", F.when(has, div((F.col("block") - 1) * F.col("q"), F.col("p")))).alias("released"),
        F.coalesce("_due", F.when(has, due(F.col("block"), F.col("p"), F.col("q")))).alias("due"),
        "slot", F.col("slot").isNotNull().alias("in_mix"), *(["epoch"] if go_on else []),
    )
