"""The streamed table of opportunities: files that land again, whenever, and batches that are tried again."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from seasonflow.streaming import jobs

HEAD = "LorS,date,daysOut,sym,sharpe_ratio,avg_profit,avg_profit2\n"


def land(src, name, rows, days_ago=0.0):
    os.makedirs(f"{src}/{name}/combo=10_8", exist_ok=True)
    path = f"{src}/{name}/combo=10_8/part.csv"
    with open(path, "w") as f:
        f.write(HEAD + "".join(r + "\n" for r in rows))
    at = time.time() - days_ago * 86400
    os.utime(path, (at, at))


ROWS = ["l,2000-01-03,10,A,1.5,2.0,", "s,2000-01-04,12,B,1.1,2.5,3.0", "l,2000-01-05,14,C,1.2,2.1,1.0"]


def table(spark, out):
    return sorted((r.symbol, r.direction, r.sharpe_ratio, r.avg_profit2) for r in spark.read.parquet(out).collect())


WANT = [("A", "l", 1.5, 2.0), ("B", "s", 1.1, 3.0), ("C", "l", 1.2, 1.0)]


def test_a_file_that_lands_again_days_later_adds_nothing(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    go = lambda: jobs.ingest(jobs.opps_stream(spark, src), out, state, ["direction"])
    land(src, "one", ROWS[:2], days_ago=30)
    go()
    land(src, "two", ROWS, days_ago=9)  # past any watermark of a day
    go()
    assert table(spark, out) == WANT
    land(src, "three", [*ROWS, ROWS[0], "x,2000-01-05,14,D,1.2,2.1,1.0", "l,nodate,3,E,1,1,1", "l,2000-01-05,0,F,1,1,1"])
    go()
    go()
    assert table(spark, out) == WANT


def test_a_batch_that_is_tried_again_gives_the_same_table(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    go = lambda: jobs.ingest(jobs.opps_stream(spark, src), out, state, ["direction"])
    land(src, "one", ROWS[:1])
    go()
    land(src, "two", ROWS)
    go()
    # as if the driver had died after the write and before the commit
    for f in [*glob.glob(f"{state}/commits/1"), *glob.glob(f"{state}/commits/.1.crc")]:
        os.remove(f)
    go()
    assert table(spark, out) == WANT


def test_a_batch_that_failed_halfway_is_completed(spark, tmp_path):
    rows = [(1, "a", "l", 5.0), (2, "b", "s", 6.0), (2, "b", "s", 4.0), (3, "c", "l", 7.0)]
    batch = spark.createDataFrame(rows, "arrived int, symbol string, direction string, x double")
    out = f"{tmp_path}/out"
    add = lambda df, n: jobs.add_new(df, n, out, ["symbol", "direction"], ["direction"], "arrived")
    add(batch.where("symbol = 'a'"), 0)
    add(batch.where("direction = 'l'"), 1)  # one partition of batch 1 is there, the other isn't
    add(batch, 1)
    add(batch, 2)
    got = sorted((r.symbol, r.x, r.batch) for r in spark.read.parquet(out).collect())
    assert got == [("a", 5.0, 0), ("b", 4.0, 1), ("c", 7.0, 1)]
    add(batch.limit(0), 3)
    assert spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("part", ["l", "s"])
def test_only_touched_partitions_are_read(spark, tmp_path, part):
    df = spark.createDataFrame([(1, "a", "l"), (1, "b", "s")], "arrived int, symbol string, direction string")
    jobs.add_new(df, 0, f"{tmp_path}/out", ["symbol", "direction"], ["direction"], "arrived")
    other = "s" if part == "l" else "l"
    for f in glob.glob(f"{tmp_path}/out/direction={other}/batch=0/*.parquet"):
        with open(f, "wb") as g:
            g.write(b"no parquet")
    jobs.add_new(df.where(F.col("direction") == part), 1, f"{tmp_path}/out", ["symbol", "direction"], ["direction"], "arrived")
    assert spark.read.parquet(f"{tmp_path}/out/direction={part}").count() == 1
