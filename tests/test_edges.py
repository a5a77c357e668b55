"""Edge cases by hand, properties, and leaks."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from seasonflow.functions import timeseries as ts
from seasonflow.functions.core import avg_tie_rank, require_columns
from seasonflow.functions.regime import calendar_features, cycle_year
from seasonflow.operators import metrics as mt
from seasonflow.operators import patterns as pt
from seasonflow.operators import selection as sl
from seasonflow.operators import trades as tr
from seasonflow.sources import files as fl

DAY = date(2000, 1, 3)


def bars_of(spark, closes, symbol="A", start=DAY, skip=()):
    rows, d = [], start
    for x in closes:
        while d in skip or d.weekday() > 4:
            d += timedelta(1)
        rows.append((symbol, d, float(x), float(x), float(x), float(x), 100.0))
        d += timedelta(1)
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_leap_day_is_skipped(spark):
    b = bars_of(spark, range(10, 800), start=date(1999, 1, 4))
    o = spark.createDataFrame([("A", date(2000, 2, 29), 10, "l")], "symbol string, date date, days_out int, direction string")
    got = pt.replay(o, b, (1999, 2001), 0).select("year").collect()
    assert [r.year for r in got] == [2000]


def test_leap_day_of_year(spark):
    df = spark.createDataFrame([(date(2000, 12, 31),), (date(1999, 12, 31),)], "date date").select(*[c.alias(k) for k, c in calendar_features(F.col("date")).items()])
    assert all(r.cal_day_of_year == 1.0 for r in df.collect())


def test_cycle_year_before_2001(spark):
    assert [r[0] for r in spark.createDataFrame([(1997,), (2000,), (2001,), (2024,)], "y int").select(cycle_year(F.col("y"))).collect()] == [1, 4, 1, 4]


def test_next_trading_day_tolerance(spark):
    b = spark.createDataFrame([("A", date(2000, 1, 3)), ("A", date(2000, 1, 14))], "symbol string, date date")
    got = {r.cal_date: r.trade_date for r in ts.next_trading_day(b, 3).collect()}
    assert got[date(2000, 1, 11)] == date(2000, 1, 14)
    assert date(2000, 1, 10) not in got and got[date(2000, 1, 3)] == date(2000, 1, 3)


@pytest.mark.parametrize("seed", range(3))
def test_next_trading_day_is_a_range_join(spark, seed):
    rnd = random.Random(seed)
    days = sorted(rnd.sample(range(200), 60))
    b = spark.createDataFrame([("A", DAY + timedelta(x)) for x in days], "symbol string, date date")
    got = {r.cal_date: r.trade_date for r in ts.next_trading_day(b, 4).collect()}
    for x in range(-6, 205):
        want = next((y for y in days if x <= y <= x + 4), None)
        assert got.get(DAY + timedelta(x)) == (None if want is None else DAY + timedelta(want))


def test_ema_equals_the_recursion(spark):
    rnd = random.Random(1)
    closes = [100 + rnd.random() * 10 for _ in range(600)]
    got = [r.ema5 for r in ts.with_ema(bars_of(spark, closes), (5,)).orderBy("date").collect()]
    s = closes[0]
    for x, y in zip(closes, got):
        s = s if x is closes[0] else s * (1 - 1 / 3) + x / 3
        assert abs(s - y) < 1e-9


@pytest.mark.parametrize("span", [5, 12, 26])
def test_ema_over_several_blocks(spark, span):
    rnd, a = random.Random(span), 2 / (span + 1)
    closes = [100 + rnd.random() * 50 for _ in range(1300)]
    rows = ts.with_ema(bars_of(spark, closes).unionByName(bars_of(spark, [7.0] * 3, "B")), (span,)).orderBy("symbol", "date").collect()
    s = closes[0]
    for k, (x, r) in enumerate(zip(closes, rows)):
        s = s if k == 0 else s * (1 - a) + x * a
        assert math.isclose(s, r[f"ema{span}"], rel_tol=1e-12)
    assert [r[f"ema{span}"] for r in rows[1300:]] == pytest.approx([7.0] * 3)


def test_ema_passes_over_nulls(spark):
    df = spark.createDataFrame([("A", DAY + timedelta(k), x) for k, x in enumerate([None, 1.0, None, 4.0])], "symbol string, date date, close double")
    assert [r.ema5 for r in ts.with_ema(df, (5,)).orderBy("date").collect()] == [None, 1.0, pytest.approx(1.0), pytest.approx(2.0)]


def test_ranked_counts_of_a_heavy_tail(spark):
    """One outlier must not put all other values in one part."""
    rnd = random.Random(4)
    xs = [rnd.random() for _ in range(3000)] + [1e12, 1e12]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = mt.ranked_counts(df, "x", [], 16)
    s = sorted(xs)
    assert {r.x: (r.before, r.n) for r in got.collect()} == {x: (s.index(x), s.count(x)) for x in set(xs)}
    cuts = df.groupBy().agg(F.percentile_approx("x", F.array(*[F.lit(k / 16) for k in range(1, 16)]), 320).alias("c")).first().c
    sizes = [sum(a < x <= b for x in xs) for a, b in zip([-1, *cuts], [*cuts, 2e12])]
    assert max(sizes) < 400


def test_lift_drawdown_is_that_of_the_curve(spark):
    rnd = random.Random(5)
    rows = [(DAY + timedelta(k // 7), f"S{k % 7}", 10, "l", float(rnd.randrange(100)), rnd.uniform(-9, 9), abs(rnd.gauss(0, 3))) for k in range(400)]
    df = spark.createDataFrame(rows, "date date, symbol string, holding_days int, direction string, ml_score double, actual_return double, actual_mfe double")
    got = {r["filter"]: r for r in mt.lift(df, "ml_score", F.col("actual_return") > 5, ["date", "symbol", "holding_days", "direction"]).collect()}
    scores = sorted(r[4] for r in rows)
    pct = {x: (scores.index(x) + (scores.count(x) + 1) / 2) / len(rows) * 100 for x in scores}
    keep = {"all": lambda r: True, "positive": lambda r: r[5] > 5, **{str(f): lambda r, f=f: pct[r[4]] >= f for f in (50, 90)}}
    for k, own in keep.items():
        cum, peak, worst, n = 1.0, 0.0, 0.0, 0
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            if own(r):
                cum, n = cum * (1 + r[5] / 100), n + 1
                peak = max(peak, cum)
                worst = min(worst, (cum - peak) / peak * 100)
        assert got[k].n == n and math.isclose(got[k].max_drawdown, worst, rel_tol=1e-9, abs_tol=1e-9), k


def test_rsi_without_losses(spark):
    up = bars_of(spark, range(1, 40))
    assert ts.with_rsi(up).orderBy(F.desc("date")).first().rsi14 is None
    assert ts.with_rsi(up, no_loss=100.0).orderBy(F.desc("date")).first().rsi14 == 100.0


def test_zero_range_and_volume(spark):
    flat = bars_of(spark, [5] * 60).withColumn("volume", F.lit(0.0))
    r = ts.with_bollinger(ts.with_rvol(ts.with_price_vs_sma(ts.with_atr(ts.with_sma(flat))))).orderBy(F.desc("date")).first()
    assert r.bollinger == 0.5 and r.rvol20 is None and r.price_vs_sma200 is None


def test_average_tie_rank(spark):
    df = spark.createDataFrame([("d", x) for x in (1, 2, 2, 3)], "g string, x int").withColumn("r", avg_tie_rank(["g"], "x"))
    assert sorted(r.r for r in df.collect()) == [0.25, 0.625, 0.625, 1.0]


def test_global_rank_equals_average_ranks(spark):
    rnd = random.Random(2)
    xs = [float(rnd.randrange(50)) for _ in range(2000)]
    got = {r.x: r["rank"] for r in mt.global_rank(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 7).collect()}
    s = sorted(xs)
    assert all(got[x] == (s.index(x) + 1 + s.index(x) + s.count(x)) / 2 for x in set(xs))


def test_quantile_bins_with_duplicate_edges(spark):
    pd = pytest.importorskip("pandas")
    xs = [0.0] * 30 + [1.0] * 10 + [float(x) for x in range(2, 22)]
    got = mt.with_bin(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 10).toPandas()
    want = pd.qcut(pd.Series(got["x"]), 10, labels=False, duplicates="drop")
    assert (got["bin"] == want).all()


def walk(path, predicted, rule, last):
    """The exits as a loop over days."""
    hwm, reached = 0.0, False
    for t, cum in enumerate(path, 1):
        hwm = max(hwm, cum)
        if rule == "ET" and t >= int(last * 0.6) and not reached:
            return t, cum
        reached = reached or cum >= predicted
        if reached and cum <= predicted + (hwm - predicted) * 0.5:
            return t, predicted + (hwm - predicted) * 0.5
        if t >= last:
            return t, cum


def test_exits_equal_the_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for k in range(150):
        n, cum, path, p = rnd.randrange(1, 15), 0.0, [], rnd.uniform(-0.01, 0.05)
        for t in range(1, n + 1):
            cum += rnd.uniform(-0.03, 0.03)
            path.append(cum)
            rows.append((f"S{k}", DAY, 10, "l", t, cum, n, p))
        want[f"S{k}"] = {r: walk(path, p, r, n) for r in ("EM", "ET")}
    df = spark.createDataFrame(rows, "symbol string, date date, holding_days int, direction string, t int, cum double, last int, p double")
    for rule, f in (("EM", tr.exit_mfe_trail), ("ET", tr.exit_time_trail)):
        for r in f(df, F.col("p")).collect():
            t, ret = want[r.symbol][rule]
            assert r.exit_t == t and math.isclose(r.exit_return, ret, abs_tol=1e-12)


def test_option_floor_and_recovery(spark):
    cums = [-0.2, -0.5, -0.1, 0.1]
    df = spark.createDataFrame(
        [("A", DAY, 10, "l", t, x, 4) for t, x in enumerate(cums, 1)],
        "symbol string, date date, holding_days int, direction string, t int, cum double, last int"
    )
    got = [r.opt for r in tr.option_path(df, "D60", F.lit(20)).orderBy("t").collect()]
    delta, lev, value, cost = tr.STRIKES["D60"]
    s, prev, want = -cost / 2, 0.0, []
    for i, x in enumerate(cums):
        left = max(20 - i, 1)
        s = max(s + (x - prev) * delta * lev - (math.sqrt(left / 20) - math.sqrt((left - 1) / 20)) * value, -1.0)
        prev = x
        want.append(s)
    assert min(got) == -1.0 and all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want))


def test_short_path_gains_when_price_falls(spark):
    b = bars_of(spark, [100, 90, 80])
    c = spark.createDataFrame([("A", DAY, 5, "s")], "symbol string, date date, holding_days int, direction string")
    assert math.isclose(tr.exit_hold(tr.trade_path(c, b)).first().exit_return, 0.2)


def test_earnings_interval_ends(spark):
    c = spark.createDataFrame([("A", DAY, 10, "l")], "symbol string, date date, holding_days int, direction string")
    for shift, kept in ((-1, 1), (0, 0), (10, 0), (11, 1)):
        e = spark.createDataFrame([("A", DAY + timedelta(shift))], "symbol string, date date")
        assert tr.without_events(c, e).count() == kept


def test_kelly_defaults(spark):
    rows = [(90.0, 2000, 1.0)] * 5 + [(90.0, 2000, -1.0)] * 5
    df = spark.createDataFrame(rows, "ml_score double, year int, actual_return double")
    assert [r.r for r in sl.kelly_ratio(df, [70.0], [2001]).collect()] == [1.3]
    many = spark.createDataFrame([(90.0, 2000, 2.0)] * 60 + [(90.0, 2000, -1.0)] * 60, "ml_score double, year int, actual_return double")
    assert [r.r for r in sl.kelly_ratio(many, [70.0], [2001]).collect()] == [2.0]


def test_sector_cap_equals_greedy(spark):
    rnd = random.Random(4)
    rows = [(DAY + timedelta(d), f"s{i}", rnd.choice("abc"), rnd.random()) for d in range(10) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, symbol string, sector string, score double")
    got = {(r.date, r.symbol) for r in sl.sector_capped(df, 5, 2, [F.desc("score"), F.col("symbol")]).collect()}
    want = set()
    for d in {r[0] for r in rows}:
        used, n = {}, 0
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1])):
            if n < 5 and used.get(r[2], 0) < 2:
                used[r[2]] = used.get(r[2], 0) + 1
                n += 1
                want.add((d, r[1]))
    assert got == want


def test_requests(spark):
    rows = [
        ("A", "2000-01-01", "0", "l", None), ("A", "2000-01-01", "x", "l", None), ("A", None, "5", "l", None),
        ("A", "2000-01-01", "5", "l", "9_9"), ("A", "2000-01-01", "45", "l", "10_30"), ("A", "2000-01-01", "45", "l", None)
    ]
    df = spark.createDataFrame(rows, "symbol string, date string, days_out string, direction string, tier string")
    got = [(r.error, r.tier, r.mismatch) for r in sl.validated(df, ["10_30", "31_60", "61_90"]).collect()]
    assert [g[0] for g in got] == ["daysOut must be positive", "daysOut must be an integer", "Missing required fields", "Unknown tier", None, None]
    assert got[4][2] is True and got[5] == (None, "31_60", False)


def test_prior_statistics_do_not_leak(spark):
    rows = [("A", y, float(x)) for y in (1998, 1999, 2000) for x in (1, 2, 3)] + [("B", y, -1.0) for y in (1998, 1999, 2000)]
    df = spark.createDataFrame(rows, "symbol string, year int, actual_return double")
    changed = df.withColumn("actual_return", F.when(F.col("year") >= 2000, 99.0).otherwise(F.col("actual_return")))
    pick = lambda d: {(r.symbol, r.year): r.quality for r in sl.symbol_quality(d).where("year <= 2000").collect()}
    assert pick(df) == pick(changed)


def test_market_order(spark):
    df = spark.createDataFrame(
        [("A", DAY, "COMM", 1.0), ("A", DAY, "ETF", 2.0), ("A", DAY, "MOON", 3.0)], "symbol string, date date, market string, close double"
    )
    assert [r.market for r in fl.first_market(df).collect()] == ["ETF"]


def test_bad_dates_in_json(spark):
    df = spark.createDataFrame([('{"A": ["2000-01-03", "soon", "2000-02-30"]}',), ("not json",)], "value string")
    assert [(r.symbol, r.date) for r in fl.earnings_of_json(df).collect()] == [("A", DAY)]


def test_cache_repairs_short_partitions(spark, tmp_path):
    df = spark.createDataFrame([("US", "a", k) for k in range(5)] + [("ETF", "a", k) for k in range(3)], "market string, target_date string, x int")
    path = str(tmp_path / "cache")
    fl.write_cache(df.where("market = 'US' and x < 2"), path)  # what a failed job has left
    fl.write_cache(df, path)
    fl.write_cache(df, path)
    got = sorted((r.market, r.x) for r in spark.read.parquet(path).collect())
    assert got == sorted((r.market, r.x) for r in df.collect())
    fl.write_cache(df.where("market = 'ETF'"), path)
    assert spark.read.parquet(path).count() == 8


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    from seasonflow.streaming import jobs

    rows = [("1", "A", "2000-01-03", "12", "l", "10_30"), ("2", "B", "2000-01-03", "12", "l", "10_30"), ("3", "A", "bad", "0", "l", None)]
    req = spark.createDataFrame(rows, "event_id string, symbol string, date string, days_out string, direction string, tier string")
    req.write.parquet(str(tmp_path / "in"))
    features = spark.createDataFrame([("A", 1.0)], "symbol string, predicted double")
    bins = spark.createDataFrame([(0, 0.0, 2.0, 0.5, 0.5)], "bin int, pred_min double, pred_max double, win_prob double, p_hit_pred double")
    for checkpoint in ("one", "two"):  # a new checkpoint: batch 0 runs once more
        jobs.scored_stream(
            spark.readStream.schema(req.schema).parquet(str(tmp_path / "in")), features, bins, ["10_30"], str(tmp_path / "out"),
            str(tmp_path / checkpoint)
        )
    got = {r.event_id: r.error for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and got["1"] is None and got["2"] == "no features" and got["3"] is not None


def test_infinite_predictions_are_errors(spark):
    bins = spark.createDataFrame([(0, 0.0, 2.0, 0.5, 0.5)], "bin int, pred_min double, pred_max double, win_prob double, p_hit_pred double")
    df = spark.createDataFrame([(1, 1.0), (2, float("inf")), (3, float("-inf")), (4, float("nan")), (5, None)], "k int, p double")
    got = {r.k: (r.error, r.calibrated_score) for r in mt.scored(df, bins, "p").collect()}
    assert got[1] == (None, 50.0) and all(got[k] == ("prediction is not finite", None) for k in (2, 3, 4, 5))


def test_loss_breaker_counts_trading_days(spark):
    days = spark.createDataFrame([(DAY + timedelta(k), k) for k in range(30)], "date date, idx long")
    trades = spark.createDataFrame(
        [("s", DAY, DAY + timedelta(x), r) for x, r in ((2, -0.1), (3, -0.1), (3, 0.1), (4, -0.2))] + [("s", DAY + timedelta(k), DAY + timedelta(29), 0.1) for k in (3, 4, 7, 8, 20)] + [("t", DAY + timedelta(4), DAY + timedelta(29), 0.1)],
        "strategy_id string, entry_date date, exit_date date, exit_return double"
    )
    got = {(r.strategy_id, (r.entry_date - DAY).days): (r.day_losses, r.blocked) for r in sl.loss_breaker(trades, days).where("exit_return = 0.1 and exit_date = date'2000-02-01'").collect()}
    assert got == {("s", 3): (2, False), ("s", 4): (3, True), ("s", 7): (3, True), ("s", 8): (2, False), ("s", 20): (0, False), ("t", 4): (0, False)}


def test_losses_over_month_ends(spark):
    rnd = random.Random(8)
    rows = []
    for s, share in (("a", 0.8), ("b", 0.3), ("c", 1.0), ("d", 0.0)):
        day = DAY
        for k in range(120):
            day += timedelta(rnd.choice((0, 0, 1, 2, 9, 40)))
            rows.append((s, f"S{k}", day, day, "l", 10, -0.1 if rnd.random() < share else 0.1))
    df = spark.createDataFrame(
        rows, "strategy_id string, symbol string, entry_date date, exit_date date, direction string, holding_days int, exit_return double"
    )
    streaks = {r.strategy_id: (r.longest, r.n_long) for r in mt.losing_streaks(df, ["strategy_id"], ["entry_date", "symbol"]).collect()}
    flags = {(r.strategy_id, r.symbol): r.losses for r in sl.recent_losses(df).collect()}
    for s in "abcd":
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        lost = [int(r[6] < 0) for r in own]
        runs = [len(x) for x in "".join(map(str, lost)).split("0") if x]
        assert streaks[s] == (max(runs, default=0), sum(x >= 3 for x in runs))
        assert [flags[(s, r[1])] for r in own] == [sum(lost[max(0, k - 5) : k]) for k in range(len(own))]


def test_one_pass_of_rules_equals_each_alone(spark):
    rnd = random.Random(6)
    rows = [(f"S{k}", DAY, 10, "l", t, rnd.uniform(-0.2, 0.2), 8, 0.05, rnd.uniform(-1, 1), rnd.randrange(1, 9)) for k in range(40) for t in range(1, 9)]
    df = spark.createDataFrame(
        rows,
        "symbol string, date date, holding_days int, direction string, t int, cum double, last int, p double, opt double, dte_left int"
    )
    rules = ["ES", "EC", "EM", "ET", "EA20"]
    both = {(r.symbol, r.rule): (r.exit_t, r.exit_return, r.reason) for r in tr.exit_options(df, rules, F.col("p"), F.lit(0.03)).collect()}
    for rule in rules:
        assert {r.symbol: (r.exit_t, r.exit_return, r.reason) for r in tr.exit_option(df, rule, F.col("p"), F.lit(0.03)).collect()} == {s: x for (s, k), x in both.items() if k == rule}


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns: b"):
        require_columns(spark.range(1).withColumnRenamed("id", "a"), ["a", "b"])
