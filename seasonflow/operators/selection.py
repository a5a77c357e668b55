"""Filters, ranks, top-k, allocation and sizing over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import avg_tie_rank, prior, ratio

#: Holding-day ranges of the tiers (fixed values).
TIERS = {"10_30": (10, 30), "31_60": (31, 60), "61_90": (61, 90), "91_120": (91, 120), "121_200": (121, 200), "201_300": (201, 300)}
KEY = ["date", "symbol", "holding_days", "direction"]


def tier_for(days: Column) -> Column:
    """The serving tier of a holding period; null where it isn't positive."""
    return F.when(days <= 0, None).when(days <= 30, "10_30").when(days <= 60, "31_60").otherwise("61_90")


def in_tier(df: DataFrame, tier: str, days: str = "holding_days") -> DataFrame:
    return df.where(F.col(days).between(*TIERS[tier]))


def calm(df: DataFrame, vix: DataFrame, limit: float = 35.0, strict: bool = False, drop_missing: bool = False) -> DataFrame:
    """Rows of days with VIX up to the limit, below it if strict; a missing VIX passes unless drop_missing. vix: a calendar."""
    out = df.join(F.broadcast(vix.select("date", "vix")), "date", "left")
    level = F.col("vix") if drop_missing else F.coalesce("vix", F.lit(0.0))
    return out.where(level < limit if strict else level <= limit)


def with_vix(df: DataFrame, vix: DataFrame, default: float) -> DataFrame:
    return df.join(F.broadcast(vix.select("date", F.col("vix").alias("_v"))), "date", "left").withColumn("vix", F.coalesce("_v", F.lit(default))).drop("_v")


def prefilter(opps: DataFrame, direction: str, days: tuple[int, int], least_profit: float, excluded: list[str]) -> DataFrame:
    """Opportunities of a direction (or both) and range with either Sharpe ratio over 1 and enough profit, without some symbols in any case.

    A table without a second ratio is judged by the first.
    """
    way = F.col("direction").isin("l", "s") if direction == "both" else F.col("direction") == direction
    sharpe = F.greatest(*[F.col(c) for c in ("sharpe_ratio", "sharpe_ratio2") if c in opps.columns], F.lit(float("-inf")))
    return opps.where(way & F.col("days_out").between(*days) & (sharpe > 1) & (F.col("avg_profit") >= least_profit) & ~F.upper("symbol").isin(*[x.upper() for x in excluded]))


def thresholds(df: DataFrame, ml: float, win: float, predicted: float) -> DataFrame:
    return df.where((F.col("ml_score") >= ml) & (F.col("win_probability") >= win) & (F.col("predicted_return") >= predicted))


def in_windows(date: Column, windows: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for first, last in windows:
        out = out | date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return out


def regime_switch(
    df: DataFrame, windows: list[tuple[str, str]], ml: float, floor: float = 70.0, excluded: tuple[str, ...] = ("ASIA",),
    direction: str | None = None
) -> DataFrame:
    """Within the windows: long only, a lower score floor, some sectors left out; elsewhere the usual floor and direction."""
    inside = in_windows(F.col("date"), windows)
    usual = F.lit(True) if direction is None else F.col("direction") == direction
    return df.withColumn("in_regime", inside).where(F.when(
        inside, (F.col("ml_score") >= min(ml, floor)) & (F.col("direction") == "l") & ~F.col("sector").isin(*excluded)
    ).otherwise((F.col("ml_score") >= ml) & usual))


def iv_share(symbol: Column, date: Column, code: str) -> Column:
    """A number from 0 to 1 fixed by symbol, date and code: the first 8 hex digits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", symbol, date.cast("string"), F.lit(code))), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def drop_empty_columns(df: DataFrame, among: list[str]) -> DataFrame:
    """df without those columns that are null in every row: one pass of counts."""
    seen = df.agg(*[F.count(c).alias(c) for c in among]).first()
    return df.drop(*[c for c in among if seen[c] == 0])


def rank_by(df: DataFrame, method: str) -> DataFrame:
    """df with rank 1..n within each day by WP, PR, MS, MG, or the weighted average-tie ranks CW and CR; ties by key."""
    df = df.withColumn("gap", F.col("predicted_mfe") - F.col("predicted_return"))
    simple = {"WP": "win_probability", "PR": "predicted_return", "MS": "ml_score", "MG": "gap"}
    if method in simple:
        score = F.col(simple[method])
    else:
        a, b, c = {"CW": (0.60, 0.25, 0.15), "CR": (0.30, 0.50, 0.20)}[method]
        df = df.withColumns({
            "_a": avg_tie_rank(["date"], "win_probability"), "_b": avg_tie_rank(["date"], "predicted_return"),
            "_c": avg_tie_rank(["date"], "gap")
        })
        score = F.floor((F.col("_a") * a + F.col("_b") * b + F.col("_c") * c) * 1e9 + 0.5) / 1e9
    df = df.withColumn("score", score)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), *KEY))).drop("_a", "_b", "_c")


def symbol_quality(df: DataFrame) -> DataFrame:
    """(symbol, year, quality): mean of earlier years' mean returns, 0 without any, as a percent rank within the year times 10."""
    yearly = df.groupBy("symbol", "year").agg(F.avg("actual_return").alias("r"))
    before = yearly.select("symbol", "year", F.coalesce(F.avg("r").over(prior("symbol")), F.lit(0.0)).alias("before"))
    before = before.withColumn("before", F.floor(F.col("before") * 1e9 + 0.5) / 1e9)
    return before.select("symbol", "year", (10 * avg_tie_rank(["year"], "before")).alias("quality"))


def symbol_quality_rows(df: DataFrame, years: DataFrame, least: int = 10, least_all: int = 1000, limit: float = 10.0) -> DataFrame:
    """(symbol, year, quality): mean return over all rows of earlier years, limited; all rows where earlier ones are too few.

    Symbols with fewer than `least` such rows have no quality. From sums by symbol and year, so years are few.
    """
    own = df.groupBy("symbol", "year").agg(F.sum("actual_return").alias("s"), F.count(F.lit(1)).alias("n"))
    grid = own.select("symbol").distinct().crossJoin(F.broadcast(years.select("year"))).join(own, ["symbol", "year"], "left")
    whole = Window.partitionBy("symbol")
    run = grid.select(
        "symbol", "year", F.sum("s").over(prior("symbol")).alias("s"), F.sum("n").over(prior("symbol")).alias("n"),
        F.sum("s").over(whole).alias("sa"), F.sum("n").over(whole).alias("na")
    )
    enough = run.groupBy("year").agg((F.coalesce(F.sum("n"), F.lit(0)) >= least_all).alias("enough"))
    run = run.join(F.broadcast(enough), "year").select(
        "symbol", "year", F.when(F.col("enough"), F.col("s")).otherwise(F.col("sa")).alias("s"),
        F.when(F.col("enough"), F.col("n")).otherwise(F.col("na")).alias("n")
    )
    return run.where(F.col("n") >= least).select("symbol", "year", F.greatest(F.least(F.col("s") / F.col("n"), F.lit(limit)), F.lit(-limit)).alias("quality"))


def rank_quality(df: DataFrame, quality: DataFrame, method: str = "CW", default: float = 5.0) -> DataFrame:
    """Composite rank with a tenth for the symbol's quality; days whose qualities agree count it as one half."""
    df = df.join(quality, ["symbol", "year"], "left").withColumn("quality", F.coalesce("quality", F.lit(default))).withColumn("gap", F.col("predicted_mfe") - F.col("predicted_return"))
    a, b, c = {"CW": (0.54, 0.225, 0.135), "CR": (0.27, 0.45, 0.18)}[method]
    day = Window.partitionBy("date")
    df = df.withColumns({
        "_a": avg_tie_rank(["date"], "win_probability"), "_b": avg_tie_rank(["date"], "predicted_return"),
        "_c": avg_tie_rank(["date"], "gap"), "_q": avg_tie_rank(["date"], "quality"),
        "_flat": F.min("quality").over(day) == F.max("quality").over(day)
    })
    score = F.col("_a") * a + F.col("_b") * b + F.col("_c") * c + F.when(F.col("_flat"), 0.5).otherwise(F.col("_q")) * 0.10
    df = df.withColumn("score", F.floor(score * 1e9 + 0.5) / 1e9)
    return df.withColumn("rank", F.row_number().over(day.orderBy(F.desc("score"), *KEY))).drop("_a", "_b", "_c", "_q", "_flat")


def combo_rank() -> Column:
    return 0.45 * F.col("ml_score") + 35 * F.col("win_probability") + 3 * F.col("predicted_return") + 10 * F.col("p_hit_return")


def best_per(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def sector_capped(df: DataFrame, k: int, cap: int, order: list[Column]) -> DataFrame:
    """A day's first k rows of which at most cap share a sector; equal to picking greedily in order."""
    capped = best_per(df, ["date", "sector"], order, cap)
    return best_per(capped, ["date"], order, k)


def daily_selection(df: DataFrame, floor: float, n: int, seen: Observation | None = None) -> DataFrame:
    """One candidate per symbol and day above the floor, the best n of each day (0: all).

    seen takes the funnel's counts in the pass that makes the selection: prefiltered (rows that come in), scored (rows
    with a probability) and over_floor; they are there once an action has run.
    """
    p = F.col("win_probability")
    if seen is not None:
        df = df.observe(seen, F.count(F.lit(1)).alias("prefiltered"), F.count(p).alias("scored"), F.count_if(F.coalesce(p >= floor, F.lit(False))).alias("over_floor"))
    order = [F.desc("win_probability"), F.desc("predicted_return"), F.col("holding_days"), F.col("direction")]
    one = best_per(df.where(p >= floor), ["date", "symbol"], order)
    return best_per(one, ["date"], [*order[:2], F.col("symbol")], n) if n else one


def no_repeat(trades: DataFrame, days: int) -> DataFrame:
    """Trades of a strategy whose symbol had no earlier trade that ended less than `days` before their entry."""
    w = Window.partitionBy("strategy_id", "symbol").orderBy("entry_date", "exit_date", "direction", "holding_days")
    gap = F.datediff("entry_date", F.lag("exit_date").over(w))
    return trades.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= days)).drop("_gap")


def recent_losses(trades: DataFrame, n: int = 5, least: int = 3) -> DataFrame:
    """trades with the losses among the strategy's last n exits before their own, and whether those are at least `least`.

    Exits are counted within their month, so that no task sees all of a strategy; what a month's first n rows still lack
    comes from the last n rows of the months before, carried over in a table of a row for each month.
    """
    order, month = ["exit_date", "entry_date", "symbol", "direction", "holding_days"], ["strategy_id", "_month"]
    w = Window.partitionBy(*month).orderBy(*order)
    back = Window.partitionBy(*month).orderBy(*[F.desc(c) for c in order])
    t = trades.withColumn("_month", F.trunc("exit_date", "month")).withColumn("_l", F.when(F.col("exit_return") <= 0, 1).otherwise(0))
    t = t.withColumns({
        "_rn": F.row_number().over(w), "_back": F.row_number().over(back),
        "_own": F.coalesce(F.sum("_l").over(w.rowsBetween(-n, -1)), F.lit(0))
    })
    tail = t.where(F.col("_back") <= n).groupBy(*month).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_back", "_l"))), lambda x: x["_l"]
    ).alias("_tail"))
    before = F.collect_list("_tail").over(Window.partitionBy("strategy_id").orderBy("_month").rowsBetween(-n, -1))
    carried = tail.select(*month, F.slice(F.flatten(F.reverse(before)), 1, n).alias("_carried"))
    t = t.join(carried, month)
    lacking = F.slice("_carried", F.lit(1), F.greatest(F.lit(n) - F.col("_rn") + 1, F.lit(0)))
    losses = F.col("_own") + F.aggregate(lacking, F.lit(0), lambda s, x: s + x)
    return t.withColumn("losses", losses.cast("long")).withColumn("many_losses", F.col("losses") >= least).select(*trades.columns, "losses", "many_losses")


def days_with_losses(trades: DataFrame, trading_days: DataFrame, days: int = 5, least: int = 3) -> DataFrame:
    """(strategy_id, idx, losses, blocked): losing exits within the last `days` trading days up to each day that has one, and whether those are at least `least`.

    trading_days: (date, idx), with every calendar date, its idx being that of the latest trading day. Losses are summed
    by day first, so that the window sees a row for each strategy and day.
    """
    lost = trades.where("exit_return <= 0").join(trading_days.select(F.col("date").alias("exit_date"), "idx"), "exit_date")
    own = lost.groupBy("strategy_id", "idx").agg(F.count(F.lit(1)).alias("n"))
    ahead = own.select("strategy_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda d: F.col("idx") + d)).alias("idx"), "n")
    return ahead.groupBy("strategy_id", "idx").agg(F.sum("n").alias("losses")).withColumn("blocked", F.col("losses") >= least)


def loss_breaker(trades: DataFrame, trading_days: DataFrame, days: int = 5, least: int = 3) -> DataFrame:
    """trades with day_losses, the strategy's losing exits within the trading days before and on their entry, and blocked."""
    lost = days_with_losses(trades, trading_days, days, least).withColumnRenamed("losses", "day_losses")
    out = trades.join(
        trading_days.select(F.col("date").alias("entry_date"), "idx"), "entry_date", "left"
    ).join(lost, ["strategy_id", "idx"], "left").drop("idx")
    return out.withColumns({"day_losses": F.coalesce("day_losses", F.lit(0).cast("long")), "blocked": F.coalesce("blocked", F.lit(False))})


def pareto(df: DataFrame, risk: str, reward: str) -> DataFrame:
    """Rows whose reward beats that of every row with less risk; a table of strategies, so one window."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(risk), F.desc(reward)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(reward).over(w)).where(F.col("_best").isNull() | (F.col(reward) > F.col("_best"))).drop("_best")


def kelly_ratio(
    df: DataFrame, floors: list[float], years: list[int], by: tuple[str, ...] = (), least: int = 100, least_side: int = 10,
    default: float = 1.3
) -> DataFrame:
    """(by, threshold, year, r): mean win over mean loss in earlier years, all years where these are few, a default where a side is.

    Rows are spread over thresholds and summed by year first; the running sums see a few rows per threshold.
    """
    t = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in floors]))).where(F.col("ml_score") >= F.col("threshold"))
    win = F.col("actual_return") > 0
    own = t.groupBy(*by, "threshold", "year").agg(
        F.sum(F.when(win, F.col("actual_return"))).alias("ws"), F.count_if(win).alias("wn"),
        F.sum(F.when(~win, F.abs("actual_return"))).alias("ls"), F.count_if(~win).alias("ln")
    )
    grid = own.select(*by, "threshold").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    cols = ("ws", "wn", "ls", "ln")
    allrows = own.groupBy(*by, "threshold").agg(*[F.sum(c).alias(f"{c}_all") for c in cols])
    before = prior(*by, "threshold")
    every = grid.join(own, [*by, "threshold", "year"], "full")
    run = every.select(
        *by, "threshold", "year", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in cols]
    ).where(F.col("year").isin(*years)).join(allrows, [*by, "threshold"])
    few = F.col("wn") + F.col("ln") < least
    pick = {c: F.when(few, F.coalesce(f"{c}_all", F.lit(0))).otherwise(F.col(c)) for c in cols}
    run = run.select(*by, "threshold", "year", *[e.alias(c) for c, e in pick.items()])
    r = F.when((F.col("wn") > least_side) & (F.col("ln") > least_side), ratio(F.col("ws") / F.col("wn"), F.col("ls") / F.col("ln"))).otherwise(F.lit(default))
    return run.select(*by, "threshold", "year", r.alias("r"))


def kelly(win: Column, r: Column) -> Column:
    return F.greatest(win - (1 - win) / r, F.lit(0.0))


def size_fraction(method: str, slots: int = 10, reserve: float = 0.10, r: Column | None = None) -> Column:
    """Suggested share of equity: SF equal, SK / SH quarter / half Kelly, SA Kelly by score, SC by confidence, SV by inverse volatility."""
    base = (1 - reserve) / slots
    win, k = F.col("win_probability"), kelly(F.col("win_probability"), r if r is not None else F.lit(1.3))
    if method == "SK":
        return F.least(k * 0.25, F.lit(base * 2))
    if method == "SH":
        return F.least(k * 0.50, F.lit(base * 2))
    if method == "SA":
        share = F.when(F.col("ml_score") >= 90, 0.50).when(F.col("ml_score") >= 80, 0.35).otherwise(0.25)
        return F.least(k * share, F.lit(base * 2))
    if method == "SC":
        return F.greatest(F.lit(0.5), F.least(F.lit(1.5), (win - 0.50) * 4)) * base
    if method == "SV":
        vol = F.when(F.coalesce("stock_volatility_20d", F.lit(0.25)) <= 0, 0.25).otherwise(F.coalesce("stock_volatility_20d", F.lit(0.25)))
        return F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.lit(0.25) / vol)) * base
    return F.lit(base)


def position_weight(mode: str, base: float = 0.15, least_win: float = 0.68, vix: Column | None = None, reference: float = 20.0) -> Column:
    """Weight by confidence or inverse volatility with caps, scaled down where VIX stands over its reference."""
    w = F.lit(base)
    if mode == "confidence":
        w = F.least(base * F.greatest(F.lit(0.75), F.least(F.lit(1.35), F.col("win_probability") / least_win)), F.lit(0.24))
    elif mode == "vol_inverse":
        w = F.least(F.greatest(base * 25.0 / F.greatest(F.lit(15.0), F.col("stock_volatility_20d") * 100), F.lit(base * 0.6)), F.lit(base * 1.4))
    return w if vix is None else F.when(vix > 0, w * F.least(F.lit(1.0), reference / F.greatest(vix, F.lit(10.0)))).otherwise(w)


#: Shares of equity that one position and all of them may take, and the hard limit of one (fixed values).
LIMITS = {"option": (0.10, 0.50, 0.15), "spread": (0.10, 0.50, 0.10)}


def budget(kind: str, method: str, slots: int = 10, open_share: Column | None = None, r: Column | None = None) -> Column:
    """Share of equity for an option's premium or a spread: SF equal, SK, SH and SA as for stocks, under the kind's limits and what open positions leave."""
    one, total, hard = LIMITS[kind]
    k = kelly(F.col("win_probability"), r if r is not None else F.lit(1.3))
    by_score = F.when(F.col("ml_score") >= 90, 0.50).when(F.col("ml_score") >= 80, 0.35).otherwise(0.25)
    alloc = {"SK": k * 0.25, "SH": k * 0.50, "SA": k * by_score}.get(method, F.lit(total / slots))
    headroom = F.lit(total) - (open_share if open_share is not None else F.lit(0.0))
    return F.greatest(F.least(alloc, F.lit(one), F.lit(hard), headroom), F.lit(0.0))


def vix_scale(vix: Column, calm: float = 15.0, top: float = 35.0, least: float = 0.1) -> Column:
    """1 up to a calm VIX, then (top - vix) / (top - calm), between `least` and 1."""
    return F.when(vix > calm, F.greatest(F.least((top - vix) / (top - calm), F.lit(1.0)), F.lit(least))).otherwise(1.0)


def capped_allocation(df: DataFrame, alloc: str, headroom: Column) -> DataFrame:
    """A day's allocations scaled so that they add up to at most its headroom."""
    total = F.sum(alloc).over(Window.partitionBy("date"))
    return df.withColumn("capped", F.when(headroom <= 0, 0.0).when(total <= headroom, F.col(alloc)).otherwise(F.col(alloc) * headroom / total))


def validated(requests: DataFrame, tiers: list[str], default_tier: str | None = None) -> DataFrame:
    """requests(symbol, date, days_out as text, direction, tier) with error (null if good), days, tier and mismatch.

    The row's tier goes first, then the batch's, then the one that fits the holding period.
    """
    days = F.expr("try_cast(days_out AS INT)")
    missing = F.greatest(*[(F.coalesce(F.col(c), F.lit("")) == "") for c in ("symbol", "date", "days_out", "direction")])
    auto = tier_for(F.col("days"))
    df = requests.withColumn("days", days).withColumn("tier", F.coalesce("tier", F.lit(default_tier), auto))
    error = F.when(missing, "Missing required fields").when(F.col("days").isNull(), "daysOut must be an integer").when(F.col("days") <= 0, "daysOut must be positive").when(~F.col("tier").isin(*tiers), "Unknown tier")
    return df.withColumn("error", error).withColumn("mismatch", F.col("error").isNull() & (F.col("tier") != auto))
