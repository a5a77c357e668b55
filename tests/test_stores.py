"""Bucketed bars, sketches kept by day, observed counts, published results, statistics of books and strategies."""

import datetime as dt
import glob
import math
import os
import random
import statistics

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from seasonflow.operators import metrics as mt
from seasonflow.operators import selection as sl
from seasonflow.operators import sketches as sk
from seasonflow.sources import files as fl
from seasonflow.sources.results import forget, manifest, publish, published

DAY = dt.date(2000, 1, 3)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(f"Brand#{s}", DAY + dt.timedelta(days=n), float(s + n % 7)) for s in range(40) for n in range(60)]
    return spark.createDataFrame(rows, "symbol string, date date, close double").selectExpr("symbol", "date", "close AS open", "close AS high", "close AS low", "close", "1.0 AS volume")


def test_bar_table_prunes_buckets_and_needs_no_shuffle(spark, bars, tmp_path):
    for name in ("bars_a", "bars_b"):
        fl.write_bar_table(bars, name, f"{tmp_path}/{name}", 8)
    some = fl.bar_table(spark, "bars_a", ["Brand#3", "Brand#17"], "2000-01-10")
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(auto, "false")
    found = plan(fl.bar_table(spark, "bars_a", ["Brand#3", "Brand#17"]))
    spark.conf.unset(auto)
    assert int(found.split("SelectedBucketsCount: ")[1].split(" ")[0]) <= 2
    assert some.count() == 2 * 53 and {r.symbol for r in some.collect()} == {"Brand#3", "Brand#17"}
    mean = F.avg("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-19, 0))
    assert "Exchange" not in plan(fl.bar_table(spark, "bars_a").withColumn("sma", mean))
    a, b = fl.bar_table(spark, "bars_a"), fl.bar_table(spark, "bars_b").withColumnRenamed("close", "other")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    joined = a.hint("merge").join(b.select("symbol", "date", "other"), ["symbol", "date"])
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined) and joined.count() == 2400
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    assert sorted(map(tuple, fl.bar_table(spark, "bars_a").collect())) == sorted(map(tuple, bars.collect()))
    # the other buckets' files aren't opened
    own = {r[0].rsplit("/", 1)[1] for r in some.select(F.col("_metadata.file_path")).distinct().collect()}
    others = [f for f in glob.glob(f"{tmp_path}/bars_a/part-*") if f.rsplit("/", 1)[1] not in own]
    assert len(own) <= 2 and len(others) >= 4
    for f in others:
        with open(f, "wb") as g:
            g.write(b"no parquet")
    assert fl.bar_table(spark, "bars_a", ["Brand#3", "Brand#17"], "2000-01-10").count() == 2 * 53
    for name in ("bars_a", "bars_b"):
        spark.sql(f"DROP TABLE {name}")


def test_csv_scan_reads_the_folders_of_some_symbols(spark, bars, tmp_path):
    fl.write_bars_csv(bars, f"{tmp_path}/csv")
    for f in glob.glob(f"{tmp_path}/csv/file_symbol=Brand_5/*.csv"):
        os.remove(f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc")
        with open(f, "a") as g:
            g.write("not,a,bar\n2000-13-45,1,1,1,1,1\n")
    assert fl.scan_bars(spark, f"{tmp_path}/csv").count() == 2400
    some = fl.scan_bars(spark, f"{tmp_path}/csv", symbols=["Brand#5", "Brand#6"])
    assert "PartitionFilters: [file_symbol" in plan(some) and len(some.inputFiles()) <= len(glob.glob(f"{tmp_path}/csv/*/*.csv"))
    assert sorted({r.symbol for r in some.collect()}) == ["Brand#5", "Brand#6"] and some.count() == 120


def test_edges_of_any_range_from_stored_sketches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(d, rnd.gauss(d, 3) if rnd.random() < 0.9 else 5.0) for d in range(20) for _ in range(3000)] + [(3, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "day int, x double")
    sk.sketches(df, "x", ["day"]).write.parquet(f"{tmp_path}/sketches")
    stored = spark.read.parquet(f"{tmp_path}/sketches")
    assert stored.count() == 20 and stored.agg(F.sum("n")).first()[0] == 60_000
    for low, high in ((0, 19), (5, 9), (7, 7)):
        got = sk.edges(stored.where(F.col("day").between(low, high)), 10)
        own = sorted(x for d, x in rows if low <= d <= high and x is not None and not math.isnan(x))
        edges = got.first().edges
        assert edges == sorted(set(edges)) and len(edges) <= 11
        import bisect

        for e in edges:
            # the rank of an edge is within 1.5 % of a tenth's; ties take a range of ranks
            a, b = bisect.bisect_left(own, e) / len(own), bisect.bisect_right(own, e) / len(own)
            assert min(abs(k / 10 - r) if not a <= k / 10 <= b else 0 for k in range(11) for r in (a, b)) < 0.015
        binned = mt.with_bin(df.where(F.col("day").between(low, high)).where("x is not null and not isnan(x)"), "x", 10, edges=got)
        assert binned.select("bin").distinct().count() == len(edges) - 1
    assert sk.edges(stored.limit(0), 10).count() == 0


def test_funnel_is_counted_in_the_same_pass(spark):
    rows = [(DAY, f"s{k % 9}", k, "l", None if k % 5 == 0 else k / 40, 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "date date, symbol string, holding_days int, direction string, win_probability double, predicted_return double")
    seen = Observation()
    picks = sl.daily_selection(df, 0.6, 4, seen)
    assert len(picks.collect()) == 4
    assert seen.get == {"prefiltered": 40, "scored": 32, "over_floor": sum(k % 5 != 0 and k >= 24 for k in range(40))}
    assert [r.symbol for r in sl.daily_selection(df, 0.6, 4).collect()] == [r.symbol for r in picks.collect()]


def test_a_set_of_results_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/results"
    a = spark.createDataFrame([(1, "x,y", 1.5), (2, None, None)], "k int, s string, x double")
    b = spark.range(3)
    assert manifest(spark, path) is None
    with pytest.raises(ValueError):
        published(spark, path, "a")
    publish(spark, path, "one", {"a": (a, "csv"), "b": (b, "json"), "c": (a, "parquet")})
    read = lambda n: sorted(map(tuple, published(spark, path, n).collect()), key=str)
    old = {n: read(n) for n in "abc"}
    assert old["a"] == old["c"] == sorted(map(tuple, a.collect()), key=str) and old["b"] == [(0,), (1,), (2,)]
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("k"))
    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            publish(spark, path, "two", {"a": (a.limit(1), "csv"), "b": (bad, "json")})
        assert manifest(spark, path)["run"] == "one" and {n: read(n) for n in "abc"} == old
    publish(spark, path, "two", {"a": (a.limit(1), "csv"), "b": (b.limit(1), "json")})
    assert manifest(spark, path)["run"] == "two" and len(read("a")) == 1
    publish(spark, path, "two", {"a": (bad, "csv")})  # published already: nothing is written
    assert len(read("a")) == 1 and glob.glob(f"{path}/one/*")
    forget(spark, path)
    assert not glob.glob(f"{path}/one") and len(read("b")) == 1


def test_book_statistics(spark):
    rnd = random.Random(8)
    picks = [(DAY + dt.timedelta(days=d), rnd.gauss(0.1, 2)) for d in range(40) for _ in range(rnd.randrange(1, 4))]
    r = mt.book_statistics(mt.daily_book(spark.createDataFrame(picks, "date date, trade_return double"))).first()
    days = sorted({d for d, _ in picks})
    rets = [statistics.fmean(x - 0.2 for dd, x in picks if dd == d) / 100 for d in days]
    equity, peak, fall = 100000.0, 100000.0, 0.0
    for x in rets:
        equity *= 1 + x
        peak = max(peak, equity)
        fall = max(fall, (peak - equity) / peak)
    assert (r.days, r.n_trades) == (40, len(picks)) and math.isclose(r.max_drawdown, fall) and math.isclose(r.log_growth, math.log(equity / 100000))
    assert math.isclose(r.sharpe, math.sqrt(252) * statistics.fmean(rets) / statistics.pstdev(rets))
    assert math.isclose(r.win_rate, sum(x > 0.2 for _, x in picks) / len(picks)) and math.isclose(r.avg_trade, statistics.fmean(x - 0.2 for _, x in picks))
    one = mt.book_statistics(mt.daily_book(spark.createDataFrame([(DAY, -9.8)], "date date, trade_return double"))).first()
    assert math.isclose(one.max_drawdown, 0.1) and one.sharpe == 0 and one.win_rate == 0
    assert mt.book_statistics(mt.daily_book(spark.createDataFrame([], "date date, trade_return double"))).count() == 0


def test_models_compared_by_year(spark):
    rnd = random.Random(1)
    rows = [(y, rnd.random(), rnd.gauss(0, 1)) for y in (2000, 2001) for _ in range(200)]
    a = spark.createDataFrame(rows, "val_year int, predicted double, actual_return double")
    b = spark.createDataFrame([(y, x, x) for y, _, x in rows], a.schema)
    got = {(r.year, r["name"]): r for r in mt.compared_by_year({"combined": a, "split": b}, "predicted", "actual_return").collect()}
    assert len(got) == 4 and got[(2000, "combined")].auc_gain == 0
    r = got[(2001, "split")]
    assert r.auc == 1 and r.win_top == 1 and r.n_top == 60 and math.isclose(r.auc_gain, 1 - got[(2001, "combined")].auc)


def test_strategies_with_and_without_metadata(spark):
    t = spark.createDataFrame([("a", 0.1 * k, 4, k < 6) for k in range(8)] + [("b", 0.2, 1, True)] * 5 + [("c", -0.1, 2, True)], "strategy_id string, exit_return double, days_held int, inside boolean")
    meta = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("a", 1, "x"), ("b", 5, None)], "strategy_id string, k int, s string")
    got = {r.strategy_id: r for r in mt.strategies_compared(t, F.col("inside"), meta).collect()}
    x = [0.1 * k for k in range(6)]
    assert got["a"].n_inside == 6 and (got["a"].k, got["a"].s) == (1, "x")
    assert math.isclose(got["a"].sharpe_inside, statistics.fmean(x) / statistics.stdev(x) * math.sqrt(252 / 4))
    assert got["b"].sharpe_inside is None and got["c"].sharpe_inside is None and got["c"].k is None and got["c"].win_rate == 0
