"""Indicators over daily bars (symbol, date, open, high, low, close, volume): each function adds columns.

All windows are per symbol in date order, so one shuffle by symbol serves any number of them. Rows without enough
history are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import EMA_ROWS, by_symbol, full_mean, ratio, rolling, with_emas


def lagged(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def with_sma(df: DataFrame, spans: tuple[int, ...] = (20, 50, 100, 200), c: str = "close") -> DataFrame:
    return df.withColumns({f"sma{n}": full_mean(c, n) for n in spans})


def with_ema(df: DataFrame, spans: tuple[int, ...] = (5, 12, 26), c: str = "close") -> DataFrame:
    return with_emas(df, {f"ema{n}": n for n in spans}, c)


def with_wma(df: DataFrame, n: int = 13, c: str = "close") -> DataFrame:
    weighted = sum((F.lag(c, k).over(by_symbol()) * F.lit(float(n - k)) for k in range(1, n)), F.col(c) * F.lit(float(n)))
    return df.withColumn(f"wma{n}", weighted / F.lit(n * (n + 1) / 2))


def with_macd(df: DataFrame) -> DataFrame:
    """macd, macd_signal, macd_hist and macd_slope, the histogram's change in a row; adds ema12 and ema26 where they lack."""
    df = with_ema(df, tuple(n for n in (12, 26) if f"ema{n}" not in df.columns)) if not {"ema12", "ema26"} <= set(df.columns) else df
    df = with_emas(df.withColumn("macd", F.col("ema12") - F.col("ema26")), {"macd_signal": 9}, "macd")
    df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return df.withColumn("macd_slope", F.col("macd_hist") - lagged("macd_hist"))


def with_rsi(df: DataFrame, n: int = 14, no_loss: float | None = None) -> DataFrame:
    """Relative strength by simple means; where there was no loss, no_loss (null in training, 100 in serving)."""
    df = df.withColumn("_d", F.col("close") - lagged("close"))
    df = df.withColumn("_g", F.greatest("_d", F.lit(0.0))).withColumn("_l", F.greatest(-F.col("_d"), F.lit(0.0)))
    df = df.withColumn("_g", F.when(F.col("_d").isNotNull(), F.col("_g"))).withColumn("_l", F.when(F.col("_d").isNotNull(), F.col("_l")))
    df = df.withColumn("_g", full_mean("_g", n)).withColumn("_l", full_mean("_l", n))
    rsi = F.when(F.col("_l") > 0, 100 - 100 / (1 + ratio(F.col("_g"), F.col("_l")))).when(F.col("_l") == 0, F.lit(no_loss).cast("double"))
    return df.withColumn(f"rsi{n}", rsi).drop("_d", "_g", "_l")


def true_range() -> Column:
    before = lagged("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(df: DataFrame, n: int = 14, least: int = 10) -> DataFrame:
    """atr{n}, a full mean of true ranges, and atr_pct, a share of the close from `least` rows on."""
    df = df.withColumn("_tr", true_range())
    some = F.when(F.count("_tr").over(rolling(n)) >= least, F.avg("_tr").over(rolling(n)))
    return df.withColumn(f"atr{n}", full_mean("_tr", n)).withColumn("atr_pct", ratio(some, F.col("close"))).drop("_tr")


def with_atr_percentile(df: DataFrame, n: int = 60, c: str = "atr14") -> DataFrame:
    """Share of the last n values that are at most the present one, from n values on."""
    past = F.collect_list(c).over(rolling(n))
    return df.withColumn("_past", past).withColumn(
        "atr_percentile", F.when(F.size("_past") == n, F.size(F.filter("_past", lambda x: x <= F.col(c))) / F.lit(float(n)))
    ).drop("_past")


def with_rvol(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn(f"rvol{n}", ratio(F.col("volume"), full_mean("volume", n)))


def with_roc(df: DataFrame, spans: tuple[int, ...] = (5, 20), c: str = "close") -> DataFrame:
    return df.withColumns({f"roc{n}": ratio(F.col(c), lagged(c, n)) - 1 for n in spans})


def with_diff(df: DataFrame, spans: tuple[int, ...] = (5, 20, 60), c: str = "close") -> DataFrame:
    return df.withColumns({f"diff{n}": F.col(c) - lagged(c, n) for n in spans})


def with_price_vs_sma(df: DataFrame) -> DataFrame:
    """Distances from sma200 in units of atr14; needs sma50, sma200, atr14."""
    return df.withColumn(
        "price_vs_sma200", ratio(F.col("close") - F.col("sma200"), F.col("atr14"))
    ).withColumn("sma50_vs_sma200", ratio(F.col("sma50") - F.col("sma200"), F.col("atr14")))


def with_bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Position within the band of `width` population deviations: 0 at the lower, 1 at the upper edge; 0.5 without spread."""
    mean, sd = full_mean("close", n), F.when(F.count("close").over(rolling(n)) == n, F.stddev_pop("close").over(rolling(n)))
    df = df.withColumn("_m", mean).withColumn("_s", sd)
    at = F.when(F.col("_s") > 0, (F.col("close") - (F.col("_m") - width * F.col("_s"))) / (2 * width * F.col("_s"))).when(F.col("_s") == 0, 0.5)
    return df.withColumn("bollinger", at).drop("_m", "_s")


def with_obv_slope(df: DataFrame, n: int = 10) -> DataFrame:
    """On-balance volume and the least-squares slope of its last n values."""
    sign = F.coalesce(F.signum(F.col("close") - lagged("close")), F.lit(0.0))
    df = df.withColumn("_v", sign * F.col("volume")).withColumn("obv", F.sum("_v").over(by_symbol()))
    mid, norm = (n - 1) / 2, n * (n * n - 1) / 12
    slope = sum((F.lag("obv", n - 1 - x).over(by_symbol()) * F.lit((x - mid) / norm) for x in range(n)), F.lit(0.0))
    return df.withColumn("obv_slope", slope).drop("_v")


def with_volume_confirmation(df: DataFrame) -> DataFrame:
    """1 where the close's direction comes with rising volume, -1 where with falling volume, 0 where either stands still."""
    up, vol = F.col("close") - lagged("close"), F.col("volume") - lagged("volume")
    return df.withColumn("vol_price_confirm", F.when(up.isNull(), None).when((up == 0) | (vol == 0), 0).when(vol > 0, 1).otherwise(-1))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def with_trend_score(df: DataFrame, missing_sma: float | None = None) -> DataFrame:
    """trend_long and trend_short from 0 to 100 by ten components each, and trend_delta, the first one's change in a row.

    missing_sma is what a component without its mean counts: null (training) or 5 (serving).
    """
    df = with_sma(df) if "sma200" not in df.columns else df
    df = with_macd(with_ema(df, (5, 12, 26))) if "macd_hist" not in df.columns else df
    df = with_roc(with_rsi(with_atr(with_wma(df))), (20,))
    atr = F.when(F.col("atr14") != 0, F.col("atr14"))
    means = lambda sign: [F.coalesce(
        clip(5 + sign * (F.col("close") - F.col(f"sma{n}")) / atr, 0, 10), F.lit(missing_sma).cast("double")
    ) for n in (20, 50, 100, 200)]
    up = F.col("macd_hist") > 0
    size = clip(F.abs("macd_hist") / atr, 0, 5) / 5 * 10
    vote = lambda c, sign: F.when(c, 5.0 + 2 * sign).otherwise(5.0 - 2 * sign)
    rsi = clip(F.col("rsi14") / 10, 0, 10)

    def score(sign: int) -> Column:
        parts = [
            *means(sign), vote(up, sign), F.when(up if sign > 0 else ~up, size).otherwise(10 - size),
            vote(F.col("ema5") > F.col("wma13"), sign), vote(F.col("close") > F.col("ema5"), sign)
        ]
        parts += [rsi if sign > 0 else 10 - rsi, clip(F.abs("roc20") * 200, 0, 10) / 2 + 2.5]
        return sum(parts[1:], parts[0])

    df = df.withColumns({"trend_long": score(1), "trend_short": score(-1)})
    return df.withColumn("trend_delta", F.col("trend_long") - lagged("trend_long"))


def trend_direction_match(trend: Column, direction: Column, high: float = 60, low: float = 40) -> Column:
    """1 where trend and direction agree, -1 where they oppose, 0 between the bands."""
    sign = F.when(direction == "l", 1).otherwise(-1)
    return F.when(trend >= high, sign).when(trend <= low, -sign).when(trend.isNotNull(), 0)


def with_52w(df: DataFrame, n: int = 252, least: int = 20) -> DataFrame:
    enough = F.count("close").over(rolling(n)) >= least
    df = df.withColumn("_h", F.when(enough, F.max("high").over(rolling(n)))).withColumn("_l", F.when(enough, F.min("low").over(rolling(n))))
    close = F.col("close")
    df = df.withColumn("from_high", ratio(close - F.col("_h"), F.col("_h"))).withColumn("from_low", ratio(close - F.col("_l"), F.col("_l")))
    return df.withColumn("in_range", ratio(close - F.col("_l"), F.col("_h") - F.col("_l"))).drop("_h", "_l")


def with_liquidity(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.withColumn(f"avg_volume{n}", full_mean("volume", n))
    return df.withColumn("log_dollar_volume", F.when(F.col("close") * F.col("volume") > 0, F.log(F.col("close") * F.col("volume"))))


def asof_ffill(dates: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """dates(date) with the latest value of series(date, value) up to each date, and src_date, where that stands.

    A union sorted once, with the last non-null value carried forward: no range join. For one series; its size is
    that of a calendar.
    """
    both = dates.select(
        "date", F.lit(None).cast(series.schema[value].dataType).alias(value), F.lit(None).cast("date").alias("src_date")
    ).unionByName(series.where(F.col(value).isNotNull()).select("date", value, F.col("date").alias("src_date")))
    one = both.groupBy("date").agg(F.max(value).alias(value), F.max("src_date").alias("src_date"), F.lit(0).alias("_one"))
    w = Window.partitionBy("_one").orderBy("date")
    filled = one.select("date", F.last(value, ignorenulls=True).over(w).alias(value), F.last("src_date", ignorenulls=True).over(w).alias("src_date"))
    return dates.select("date").distinct().join(filled, "date")


def next_trading_day(bars: DataFrame, tolerance: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, cal_date, trade_date, and carried columns of the bar): for each calendar date up to `tolerance` days before a bar, the first bar from it on.

    Each bar spreads backwards over the days since the bar before it, so that a lookup is an equi-join.
    """
    before = F.lag("date").over(by_symbol())
    first = F.greatest(F.date_add("date", -tolerance), F.date_add(before, 1))
    days = F.sequence(F.coalesce(first, F.date_add("date", -tolerance)), F.col("date"))
    return bars.select("symbol", "date", *carried, days.alias("days")).select(
        "symbol", F.explode("days").alias("cal_date"), F.col("date").alias("trade_date"), *carried
    )


def last_trading_day(bars: DataFrame, tolerance: int) -> DataFrame:
    """(symbol, cal_date, trade_date): for each calendar date up to `tolerance` days after a bar, the last bar up to it."""
    after = F.lead("date").over(by_symbol())
    last = F.least(F.date_add("date", tolerance), F.date_add(after, -1))
    days = F.sequence(F.col("date"), F.coalesce(last, F.date_add("date", tolerance)))
    return bars.select("symbol", "date", days.alias("days")).select("symbol", F.explode("days").alias("cal_date"), F.col("date").alias("trade_date"))


def days_to_event(rows: DataFrame, events: DataFrame, near: int = 5) -> DataFrame:
    """rows(symbol, date) with days_to_event, to the next event from that date on, and is_near."""
    both = rows.select("symbol", "date", F.lit(None).cast("date").alias("event")).unionByName(events.select("symbol", "date", F.col("date").alias("event")))
    one = both.groupBy("symbol", "date").agg(F.max("event").alias("event"))
    w = by_symbol().rowsBetween(0, Window.unboundedFollowing)
    ahead = one.select("symbol", "date", F.first("event", ignorenulls=True).over(w).alias("event"))
    out = rows.join(ahead, ["symbol", "date"]).withColumn("days_to_event", F.datediff("event", "date")).drop("event")
    return out.withColumn("is_near", F.coalesce(F.col("days_to_event") <= near, F.lit(False)))
