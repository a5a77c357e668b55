"""Prefix scans against plain running sums, and what rests on them."""

import random

import pytest
from pyspark.sql import functions as F

from seasonflow.operators import metrics as mt
from seasonflow.operators.prefix import prefix_scan
from seasonflow.plans import catalog


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


@pytest.mark.parametrize("parts", [None, 1, 3, 40])
def test_running_sums_of_groups(spark, parts):
    rnd = random.Random(parts or 0)
    rows = [(rnd.choice("aab"), k, rnd.randrange(10), rnd.randrange(-5, 5)) for k in rnd.sample(range(1000), 300)] + [("c", 1, 2, 3)]
    got = prefix_scan(spark.createDataFrame(rows, "g string, k int, x int, y int"), ["k"], ["x", "y"], ["g"], parts).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [t for t in rows if t[0] == r.g]
        before = [t for t in own if t[1] < r.k]
        assert (r.before_x, r.before_y) == (sum(t[2] for t in before), sum(t[3] for t in before))
        assert (r.all_x, r.all_y) == (sum(t[2] for t in own), sum(t[3] for t in own))


def test_running_sums_of_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit(1).alias("one"))
    assert all(r.before_one == r.k and r.all_one == 500 for r in prefix_scan(df, ["k"], ["one"], parts=9).collect())
    assert prefix_scan(df.limit(0), ["k"], ["one"]).count() == 0


def test_calibration_reads_once_and_equals_bins_by_row(spark):
    rnd = random.Random(3)
    rows = [(float(rnd.choice([1, 1, 1, 2, 3, rnd.random() * 9])), rnd.choice([None, rnd.random() * 8 - 2])) for _ in range(700)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "pred double, actual_return double")
    got = {r.bin: r for r in mt.calibration(df, "pred", n=10).collect()}
    binned = [r for r in mt.with_bin(df.where("pred is not null"), "pred", 10).collect()]
    assert set(got) == {r.bin for r in binned}
    for k, r in got.items():
        own = [x for x in binned if x.bin == k]
        known = [x.actual_return for x in own if x.actual_return is not None]
        assert (r.n_samples, r.pred_min, r.pred_max) == (len(own), min(x.pred for x in own), max(x.pred for x in own))
        assert abs(r.pred_mean - sum(x.pred for x in own) / len(own)) < 1e-12 and abs(r.avg_outcome - sum(known) / len(known)) < 1e-12
        assert abs(r.win_prob - sum(x > 0 for x in known) / len(own)) < 1e-12
        assert abs(r.p_hit_pred - sum(x.actual_return is not None and x.actual_return >= x.pred for x in own) / len(own)) < 1e-12


def test_lift_and_calibration_plan_few_scans(spark, sf):
    assert scans(catalog.QUERIES["eval_topk_lift"](spark, sf)) <= 10
    assert scans(catalog.QUERIES["calibrate"](spark, sf)) <= 6


def test_lift_of_odd_rows(spark):
    """Rows without a score or outcome, one hot score, floors that nothing reaches."""
    schema = "date date, k int, s double, p boolean, actual_return double, actual_mfe double"
    rows = [(f"2000-01-{1 + i % 28:02d}", i, 5.0 if i % 3 else float(i), i % 2 == 0, None if i == 7 else float(i % 5 - 2), float(i)) for i in range(60)]
    rows += [("2000-02-01", 60, None, True, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date string, k int, s double, p boolean, actual_return double, actual_mfe double").withColumn("date", F.to_date("date"))
    got = {r["filter"]: r for r in mt.lift(df, "s", F.col("p"), ["date", "k"], floors=(50, 99), least=1).collect()}
    assert got["all"].n == 59 and got["positive"].n == 30 and 0 < got["50"].n < 59 and "99" not in got
    assert abs(got["all"].pct_of_trades - 5900 / 61) < 1e-9
    values = sorted(r[4] for r in rows[:60] if r[4] is not None)
    assert got["all"].median_return == values[29]
    assert mt.lift(spark.createDataFrame([], schema), "s", F.col("p"), ["date", "k"]).count() == 0
