"""Operators on seasonal patterns: depth profiles, replays over years, labels and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import day_number, ratio
from seasonflow.functions.timeseries import last_trading_day, next_trading_day

PATTERN = ["symbol", "date", "days_out", "direction"]


def depth_profile(opps: DataFrame, depth_cap: int = 35, capped: int = 30) -> DataFrame:
    """One row per pattern over its combos; ties of the best Sharpe ratio go to the first combo by name.

    avg_profit2 is the best row's. data_years is the deepest non-cycle combo of the symbol.
    """
    plain = lambda c: F.when(~F.col("is_pe"), c)
    win = F.col("year2") / F.col("year1")
    recent = ~F.col("is_pe") & (F.col("year1") == 10) & (F.col("year2") == 10)
    years = opps.where("not is_pe").groupBy("symbol").agg(F.max("year1").alias("data_years"))
    worst_first = F.struct(F.col("sharpe_ratio"), -F.col("year1"), -F.col("year2"), ~F.col("is_pe"))
    g = opps.groupBy(*PATTERN).agg(
        F.max("sharpe_ratio").alias("best_sharpe"), F.max_by("avg_profit2", worst_first).alias("avg_profit2"), F.coalesce(F.max(plain(F.col("year1"))), F.lit(0)).alias("deepest_pass"),
        F.max_by(
            "sharpe_ratio", F.when(~F.col("is_pe"), F.struct("year1", "sharpe_ratio"))
        ).alias("sharpe_at_deepest"), F.max(F.when(recent, 1).otherwise(0)).alias("passes_recent_10"), F.max(F.when(recent, F.col("sharpe_ratio"))).alias("sharpe_at_10"),
        F.count(F.lit(1)).alias("n_combos"), F.coalesce(F.max(F.when(F.col("is_pe"), F.col("year1"))), F.lit(0)).alias("pe_deepest"), F.max(win).alias("best_winrate"), F.min(win).alias("worst_winrate"),
        F.coalesce(F.stddev_pop(plain(win)), F.lit(0.0)).alias("consistency_std"),
    )
    g = g.join(years, "symbol", "left")
    depth = F.least(F.col("data_years"), F.lit(depth_cap))
    return g.withColumns({
        "deepest_capped": F.least(F.col("deepest_pass"), F.lit(capped)), "pe_match": F.when(F.col("pe_deepest") > 0, 1).otherwise(0), "depth_utilization": F.coalesce(ratio(F.col("deepest_pass"), depth), F.lit(0.0)),
        "pe_utilization": F.coalesce(ratio(F.col("pe_deepest"), depth / 4.0), F.lit(0.0)), "recent_vs_deep": ratio(
            F.when(F.col("sharpe_at_10") != 0, F.col("sharpe_at_10")), F.col("sharpe_at_deepest")
        ),
    })


def extra_profile(opps: DataFrame) -> DataFrame:
    """Profit per day, Sharpe per root day, MFE ratio, holding bucket and whether a pattern passes at its symbol's deepest combo."""
    order = F.struct(F.col("sharpe_ratio"), -F.col("year1"), -F.col("year2"), ~F.col("is_pe"))
    g = opps.groupBy(*PATTERN).agg(
        F.max_by(F.struct("sharpe_ratio", "avg_profit", F.coalesce("avg_profit2", "avg_profit").alias("p2")), order).alias("b"),
        F.max(F.when(~F.col("is_pe"), F.col("year1"))).alias("deepest")
    )
    deepest = opps.where("not is_pe").groupBy("symbol").agg(F.max("year1").alias("most"))
    g = g.join(deepest, "symbol", "left")
    d = F.col("days_out")
    bucket = F.when(d <= 15, 0).when(d <= 45, 1).when(d <= 90, 2).otherwise(3)
    return g.select(
        *PATTERN, (F.col("b.avg_profit") / d).alias("profit_per_day"), (F.col("b.sharpe_ratio") / F.sqrt(d)).alias("sharpe_per_day"), F.when(F.col("b.avg_profit") == 0, 1.0).otherwise(ratio(F.col("b.p2"), F.col("b.avg_profit"))).alias("mfe_ratio"),
        bucket.alias("days_bucket"), F.when(F.col("deepest") >= F.col("most"), 1).otherwise(0).alias("passes_at_max_depth"),
    )


def month_days(opps: DataFrame) -> DataFrame:
    """Distinct patterns by month-day."""
    return opps.select("symbol", F.date_format("date", "MM-dd").alias("md"), "days_out", "direction").distinct()


def resolved(rows: DataFrame, bars: DataFrame, wanted: str = "wanted", entry_tolerance: int = 3, exit_tolerance: int = 4) -> DataFrame:
    """rows(symbol, wanted, days_out, direction, ...) with entry, exit, and ret, the signed percent return between their closes.

    Entry is the first trading day from the wanted date within the tolerance, exit the first one from entry + days_out.
    Both are equi-joins on a map of calendar dates to trading days with their closes. Rows without an entry or exit go.
    """
    close = bars.select("symbol", "date", "close")
    at = lambda tolerance, on, day, price: next_trading_day(close, tolerance, ("close",)).select(
        "symbol", F.col("cal_date").alias(on), F.col("trade_date").alias(day), F.col("close").alias(price)
    )
    out = rows.join(at(entry_tolerance, wanted, "entry", "p_in"), ["symbol", wanted]).where("p_in <> 0")
    out = out.withColumn("_out", F.expr("date_add(entry, days_out)")).join(at(exit_tolerance, "_out", "exit", "p_out"), ["symbol", "_out"]).drop("_out")
    sign = F.when(F.col("direction") == "l", 1).otherwise(-1)
    return out.withColumn("ret", sign * 100 * (F.col("p_out") - F.col("p_in")) / F.col("p_in"))


def replay(opps: DataFrame, bars: DataFrame, years: tuple[int, int], least_history: int = 200) -> DataFrame:
    """Every pattern in every year: (symbol, md, days_out, direction, year, entry, exit, ret, hit).

    29 February is skipped in years without it; entries with fewer than least_history earlier bars go.
    """
    p = month_days(opps).withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    p = p.withColumn("wanted", F.expr("try_to_date(concat(year, '-', md), 'yyyy-MM-dd')")).where("wanted is not null")
    seen = bars.select("symbol", F.col("date").alias("entry"), (F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1).alias("_seen"))
    out = resolved(p, bars).join(seen, ["symbol", "entry"]).where(F.col("_seen") >= least_history)
    return out.withColumn("hit", F.when(F.col("ret") > 0, 1).otherwise(0)).drop("_seen", "wanted")


def best_closes(bars: DataFrame, days: list[int], slack: int = 4) -> DataFrame:
    """(symbol, date, days_out, best_high, best_low): extreme closes in (date, date + days_out + slack], for all days at once.

    Every horizon is a range frame over one sort of the bars; the horizons are stacked afterwards.
    """
    w = Window.partitionBy("symbol").orderBy("_day")
    b = bars.select("symbol", "date", "close", day_number("date").alias("_day"))
    frames = {}
    for d in days:
        f = w.rangeBetween(1, d + slack)
        frames[f"h{d}"], frames[f"l{d}"] = F.max("close").over(f), F.min("close").over(f)
    wide = b.withColumns(frames)
    rows = F.array(*[F.struct(F.lit(d).alias("days_out"), F.col(f"h{d}").alias("best_high"), F.col(f"l{d}").alias("best_low")) for d in days])
    return wide.select("symbol", "date", "close", F.inline(rows))


def favourable_excursion(rows: DataFrame, bars: DataFrame, days: list[int], slack: int = 4) -> DataFrame:
    """rows(symbol, date, days_out, direction) with mfe, the best close's signed percent return; not floored at 0."""
    best = best_closes(bars, days, slack)
    out = rows.join(best, ["symbol", "date", "days_out"])
    long, short = (F.col("best_high") - F.col("close")) / F.col("close"), (F.col("close") - F.col("best_low")) / F.col("close")
    return out.withColumn("mfe", 100 * F.when(F.col("direction") == "l", long).otherwise(short)).where("mfe is not null").drop("close", "best_high", "best_low")


def backward_label(rows: DataFrame, bars: DataFrame, tolerance: int = 5) -> DataFrame:
    """rows(symbol, date, days_out, direction) with ret and hit by the last closes up to the entry and exit dates."""
    close = bars.select("symbol", "date", "close")
    at = last_trading_day(close, tolerance).join(close.select("symbol", F.col("date").alias("trade_date"), "close"), ["symbol", "trade_date"])
    one = at.select("symbol", F.col("cal_date").alias("date"), F.col("close").alias("p_in"))
    two = at.select("symbol", F.col("cal_date").alias("_out"), F.col("close").alias("p_out"))
    out = rows.join(one, ["symbol", "date"]).withColumn("_out", F.expr("date_add(date, days_out)")).join(two, ["symbol", "_out"]).where("p_in <> 0")
    sign = F.when(F.col("direction") == "l", 1).otherwise(-1)
    out = out.withColumn("ret", sign * 100 * (F.col("p_out") - F.col("p_in")) / F.col("p_in"))
    return out.withColumn("hit", F.when(F.col("ret") > 0, 1).otherwise(0)).drop("_out", "p_in", "p_out")


def neighbourhood(opps: DataFrame, bars: DataFrame, years: tuple[int, int], window: int = 10, shifts: tuple[int, ...] = (-14, -7, 0, 7, 14)) -> DataFrame:
    """(symbol, md, days_out, direction, year, neighbour_wr, sharpness, pre_slope, post_cliff) from the win rates of up to `window` earlier years.

    One replay of every pattern under every shift; win rates by shift are means over strictly earlier years.
    """
    p = month_days(opps).withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    p = p.withColumn("base", F.expr("try_to_date(concat(year, '-', md), 'yyyy-MM-dd')")).where("base is not null")
    p = p.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("wanted", F.expr("date_add(base, shift)"))
    key = ["symbol", "md", "days_out", "direction", "shift"]
    won = resolved(p, bars).select(*key, "year", F.when(F.col("ret") > 0, 1.0).otherwise(0.0).alias("win"))
    grid = p.select(*key, "year").join(won, [*key, "year"], "left")
    wr = F.avg("win").over(Window.partitionBy(*key).orderBy("year").rangeBetween(-window, -1))
    rates = grid.withColumn("wr", wr)
    of = lambda s: F.max(F.when(F.col("shift") == s, F.col("wr")))
    g = rates.groupBy(*key[:-1], "year").agg(*[of(s).alias(f"w{i}") for i, s in enumerate(shifts)])
    pre2, pre1, own, post1, post2 = (F.col(f"w{i}") for i in range(5))

    def mean(*cols: Column) -> Column:
        some = F.filter(F.array(*cols), lambda x: x.isNotNull())
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some))

    near = mean(pre2, pre1, post1, post2)
    return g.select(
        *key[:-1], "year", near.alias("neighbour_wr"), ratio(own, near).alias("sharpness"), (pre1 - pre2).alias("pre_slope"),
        (own - mean(post1, post2)).alias("post_cliff")
    )


def hit_last_year(samples: DataFrame, bars: DataFrame) -> DataFrame:
    """samples(symbol, date, days_out, direction) with hit_last_year, null where last year's dates can't be resolved."""
    s = samples.select("symbol", "date", "days_out", "direction").distinct()
    before = F.expr("try_to_date(concat(year(date) - 1, date_format(date, '-MM-dd')), 'yyyy-MM-dd')")
    won = resolved(s.withColumn("wanted", before).where("wanted is not null"), bars)
    won = won.select("symbol", "date", "days_out", "direction", F.when(F.col("ret") > 0, 1).otherwise(0).alias("hit_last_year"))
    return samples.join(won, ["symbol", "date", "days_out", "direction"], "left")


def interactions(df: DataFrame) -> DataFrame:
    """Products of a pattern's direction, depth and quality with market and sector trends.

    Needs direction, spy, spy_sma200, etf, etf_sma200, vix, deepest_pass, best_sharpe.
    """
    sign = F.when(F.col("direction") == "l", 1).otherwise(-1)
    trend = lambda p, m: F.when(F.col(p).isNotNull() & F.col(m).isNotNull(), F.when(F.col(p) > F.col(m), 1).otherwise(-1))
    above = F.when(F.col("spy_sma200").isNotNull(), F.when(F.col("spy") > F.col("spy_sma200"), 1.0).otherwise(0.0))
    return df.withColumns({
        "dir_x_market": sign * trend("spy", "spy_sma200"), "dir_x_sector": sign * trend("etf", "etf_sma200"),
        "depth_x_vix": ratio(F.col("deepest_pass"), F.col("vix")), "quality_x_regime": F.col("best_sharpe") * above
    })
