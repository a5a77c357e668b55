"""Paths of trades over the shared trading days: days without a bar, month ends, deadlines without a trading day."""

import datetime as dt
import random

from pyspark.sql import functions as F

from seasonflow.operators import trades as tr

DAY = dt.date(2000, 1, 3)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def plain(trades, closes):
    """By a loop over the trading days, as a daily replay goes."""
    days = sorted({d for _, d in closes})
    out = {}
    for symbol, date, hold, direction in trades:
        entry = closes.get((symbol, date))
        if not entry or entry <= 0 or date == days[-1]:
            continue
        at = days.index(date)
        inside = [d for d in days[at + 1 :] if d <= date + dt.timedelta(days=hold)] or [days[at + 1]]
        sign, held = 1 if direction == "l" else -1, 0.0
        for t, d in enumerate(inside, 1):
            now = closes.get((symbol, d))
            cum = sign * (now / entry - 1) if now is not None else 0.0
            held = cum if now is not None else held
            out[(symbol, date, hold, direction, t)] = (d, cum, held, len(inside))
    return out


def run(spark, trades, closes):
    df = spark.createDataFrame(trades, "symbol string, date date, holding_days int, direction string")
    bars = spark.createDataFrame([(s, d, c) for (s, d), c in closes.items()], "symbol string, date date, close double")
    rows = tr.trade_path(df.withColumn("close", F.lit("clash")), bars).collect()
    return {(r.symbol, r.date, r.holding_days, r.direction, r.t): (r.bar_date, r.cum, r.held, r["last"]) for r in rows}


def test_days_without_a_bar_over_month_ends(spark):
    rnd = random.Random(4)
    closes = {("a", day(n)): 10 + rnd.random() for n in range(100) if n % 7 < 5}
    closes |= {("b", day(n)): 20 + rnd.random() for n in range(60) if rnd.random() < 0.25}
    closes |= {("c", day(0)): 5.0, ("c", day(64)): 6.0, ("d", day(1)): -1.0, ("e", day(2)): None}
    trades = [(s, d, h, w) for (s, d), c in closes.items() for h in (1, 3, 30, 80) for w in "ls" if rnd.random() < 0.5]
    trades += [("c", day(0), h, "l") for h in (63, 64, 65, 99)] + [("a", day(5), 5, "l"), ("zz", day(0), 5, "l")]
    trades = sorted(set(trades))
    closes = {k: v for k, v in closes.items()}
    want = plain(trades, closes)
    got = run(spark, trades, closes)
    assert set(got) == set(want)
    for k, (d, cum, held, last) in want.items():
        assert got[k][0] == d and got[k][3] == last and abs(got[k][1] - cum) < 1e-12 and abs(got[k][2] - held) < 1e-12, k


def test_a_stock_is_flat_and_an_option_holds_on_a_missing_day(spark):
    closes = {("a", dt.date(2000, 1, 28)): 10.0, ("a", dt.date(2000, 1, 31)): 12.0, ("b", dt.date(2000, 2, 1)): 1.0, ("b", dt.date(2000, 3, 1)): 1.0, ("a", dt.date(2000, 3, 2)): 9.0}
    got = run(spark, [("a", dt.date(2000, 1, 28), 40, "l")], closes)
    assert [(round(v[1], 9), round(v[2], 9)) for _, v in sorted(got.items(), key=lambda x: x[0][-1])] == [(0.2, 0.2), (0.0, 0.2), (0.0, 0.2), (-0.1, -0.1)]


def test_no_trades_or_bars(spark):
    none = spark.createDataFrame([], "symbol string, date date, holding_days int, direction string")
    bars = spark.createDataFrame([("a", DAY, 1.0)], "symbol string, date date, close double")
    assert tr.trade_path(none, bars).count() == 0
    assert tr.trade_path(spark.createDataFrame([("a", DAY, 5, "l")], none.schema), bars).count() == 0
    assert tr.trade_path(none, bars.limit(0)).count() == 0


def test_events_inside_by_month(spark):
    trades = [("a", day(n), h, "l") for n in range(0, 90, 7) for h in (0, 1, 40, 70)] + [("b", day(0), 5, "s")] * 2
    events = [("a", day(30)), ("a", day(28)), ("a", day(95)), ("b", day(6))]
    df = spark.createDataFrame(trades, "symbol string, date date, holding_days int, direction string")
    ev = spark.createDataFrame(events, "symbol string, date date")
    want = [any(s == e and d <= x <= d + dt.timedelta(days=h) for e, x in events) for s, d, h, _ in trades]
    got = tr.with_event_flag(df, ev)
    assert sorted((r.symbol, r.date, r.holding_days, r.has_event) for r in got.collect()) == sorted((*t[:3], w) for t, w in zip(trades, want))
    assert tr.without_events(df, ev).count() == want.count(False)


def test_paths_unfold_where_rules_need_them(spark, sf):
    """No shuffle of unfolded paths, and one path for both options."""
    from seasonflow.plans.trades import exit_option_rules, exit_spread_rules

    for query in (exit_option_rules, exit_spread_rules):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("inline(_ahead") == 1, plan
        assert "Exchange" not in plan[: plan.index("inline(_ahead")], plan


def test_several_options_in_one_pass(spark):
    rnd = random.Random(5)
    closes = {("a", day(n)): 10 + rnd.random() for n in range(60)}
    trades = spark.createDataFrame([("a", day(n), h, w) for n in range(0, 30, 3) for h in (5, 20) for w in "ls"], "symbol string, date date, holding_days int, direction string")
    bars = spark.createDataFrame([(s, d, c) for (s, d), c in closes.items()], "symbol string, date date, close double")
    path = tr.carried(tr.trade_path(trades, bars))
    options = {"one": ("D60", F.col("holding_days") * 2), "two": ("D40", F.col("holding_days") + 10)}
    rules = {"one": ["ES", "EC", "EA20"], "two": ["EM", "ET", "EC"]}
    rows = lambda df: {(*r[:4], r.rule): (r.exit_t, r.exit_return, r.reason) for r in df.select(*tr.TRADE, "rule", "exit_t", "exit_return", "reason").collect()}
    both = tr.exit_options(tr.option_paths(path, options), rules, F.lit(0.02), F.lit(0.03)).persist()
    for name, (strike, dte) in options.items():
        alone = tr.exit_options(tr.option_path(path, strike, dte), rules[name], F.lit(0.02), F.lit(0.03))
        assert rows(both.where(F.col("option") == name)) == rows(alone) and both.where(F.col("option") == name).count() == 120


def test_trades_and_closes_come_from_one_pass(spark, sf, monkeypatch):
    """The ticks are read once, and sorted by one number."""
    from seasonflow.plans import trades
    from seasonflow.sources import views as v

    read, real = [], v.ticks
    monkeypatch.setattr(v, "ticks", lambda *a: read.append(1) or real(*a))
    trades.path(spark, sf)
    assert len(read) == 1
    plan = v.candidates(spark, sf)._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "- Sort [" in line]
    assert sorts and all(line.count(" ASC ") == 1 for line in sorts), plan


def test_last_ticks_of_odd_rows(spark, tmp_path):
    """Nulls, far days and negative keys are groups of their own, as by the four columns; closes are those of bars."""
    from seasonflow.sources import views as v

    rnd = random.Random(6)
    some = lambda *values: rnd.choice(values)
    parts = [(k, some("a", "b", None, "")) for k in range(12)]
    days = [None, dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31), dt.datetime(1969, 12, 31, 23, 59), dt.datetime(1970, 1, 1)]
    lines = [(
        some(None, -41, -20, 0, 20, 21, 2**62), rnd.randrange(12), some(None, 3, 4), some(1, 2), some(1.0, 2.0), float(n), rnd.random(), 0.01, "N", some("F", "O", None), some(*days)
    ) for n in range(1500)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    brand, want = dict(parts), {}
    order = lambda k: tuple((x is not None, x or 0) for x in k)
    for o, p, s, n, qty, price, discount, tax, _, status, at in lines:
        sign = -1 if o is not None and o < 0 else 1
        g = (brand[p], at and at.date(), None if o is None else 10 + sign * (abs(o) % 21), "l" if status == "F" else "s")
        want.setdefault(g, []).append((o, n, p, s, discount, tax))
    got = v.last_ticks(spark, str(tmp_path), "px").persist()
    rows = {(r.symbol, r.date, r.holding_days, r.direction): (*[r[c] for c in v.KEY], r.l_discount, r.l_tax) for r in got.collect()}
    assert got.count() == len(rows) and rows == {g: max(own, key=order) for g, own in want.items()}
    prices = {}
    for o, p, s, n, qty, price, _, _, _, _, at in lines:
        prices.setdefault((brand[p], at and at.date()), []).append(((o, n, p, s), int(price / qty * 100 + 0.5) / 100))
    for closes in (v.closes(got), v.bars(spark, str(tmp_path))):
        found = {(r.symbol, r.date): r.close for r in closes.collect()}
        assert set(found) == set(prices)
        for k, own in prices.items():  # of ticks with one KEY any may be the last
            top = max((key for key, _ in own), key=order)
            assert found[k] in [px for key, px in own if key == top], k
