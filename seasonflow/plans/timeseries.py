"""Queries over daily bars: indicators and as-of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonflow.functions import timeseries as ts
from seasonflow.functions.core import q
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.sources import views as v

QUERIES, ORACLES = {}, {}
W = "OVER (PARTITION BY symbol ORDER BY date)"


def w(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def mean(c: str, n: int) -> str:
    return f"(CASE WHEN count({c}) {w(n)} = {n} THEN avg({c}) {w(n)} END)"


def ema_sql(c: str, n: int) -> str:
    a = 2.0 / (n + 1)
    return f"list_reduce(list({c}) {w(ts.EMA_ROWS[n])}, lambda s, x: s * {1 - a!r}::DOUBLE + x * {a!r}::DOUBLE)"


TRUE_RANGE = f"greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W}))"
EXTRA = {
    "emas": f"SELECT *, {ema_sql('close', 5)} AS ema5, {ema_sql('close', 12)} AS ema12, {ema_sql('close', 26)} AS ema26 FROM bars",
    "macds": f"SELECT *, macd - {ema_sql('macd', 9)} AS macd_hist, {ema_sql('macd', 9)} AS macd_signal FROM (SELECT *, ema12 - ema26 AS macd FROM emas)",
    "gains": f"SELECT *, greatest(d, 0) + 0 * d AS g, greatest(-d, 0) + 0 * d AS l FROM (SELECT *, close - lag(close) {W} AS d FROM bars)",
    "rsis": f"SELECT symbol, date, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi14 FROM (SELECT symbol, date, {mean('g', 14)} AS g, {mean('l', 14)} AS l FROM gains)",
    "ranges": f"SELECT *, {TRUE_RANGE} AS tr FROM bars",
    "atrs": f"SELECT *, {mean('tr', 14)} AS atr14, CASE WHEN count(tr) {w(14)} >= 10 THEN avg(tr) {w(14)} / nullif(close, 0) END AS atr_pct FROM ranges",
    "smas": f"SELECT *, {mean('close', 20)} AS sma20, {mean('close', 50)} AS sma50, {mean('close', 100)} AS sma100, {mean('close', 200)} AS sma200 FROM atrs",
    "wmas": f"SELECT symbol, date, ({' + '.join(f'lag(close, {k}) {W} * {13 - k}' for k in range(1, 13))} + close * 13) / 91 AS wma13, close / nullif(lag(close, 20) {W}, 0) - 1 AS roc20 FROM bars",
    "trends": """SELECT *, least(greatest(5 - (close - sma20) / a, 0), 10) + least(greatest(5 - (close - sma50) / a, 0), 10) + least(greatest(5 - (close - sma100) / a, 0), 10)
  + CASE WHEN sma200 IS NOT NULL THEN least(greatest(5 - (close - sma200) / a, 0), 10) END + CASE WHEN macd_hist > 0 THEN 3 ELSE 7 END
  + CASE WHEN macd_hist > 0 THEN 10 - least(abs(macd_hist) / a, 5) / 5 * 10 ELSE least(abs(macd_hist) / a, 5) / 5 * 10 END
  + CASE WHEN ema5 > wma13 THEN 3 ELSE 7 END + CASE WHEN close > ema5 THEN 3 ELSE 7 END + 10 - rsi14 / 10 + least(abs(roc20) * 200, 10) / 2 + 2.5::DOUBLE AS trend_short, least(greatest(5 + (close - sma20) / a, 0), 10) + least(greatest(5 + (close - sma50) / a, 0), 10) + least(greatest(5 + (close - sma100) / a, 0), 10)
  + CASE WHEN sma200 IS NOT NULL THEN least(greatest(5 + (close - sma200) / a, 0), 10) END + CASE WHEN macd_hist > 0 THEN 7 ELSE 3 END
  + CASE WHEN macd_hist > 0 THEN least(abs(macd_hist) / a, 5) / 5 * 10 ELSE 10 - least(abs(macd_hist) / a, 5) / 5 * 10 END
  + CASE WHEN ema5 > wma13 THEN 7 ELSE 3 END + CASE WHEN close > ema5 THEN 7 ELSE 3 END + rsi14 / 10 + least(abs(roc20) * 200, 10) / 2 + 2.5::DOUBLE AS trend_long
  FROM (SELECT s.*, nullif(atr14, 0) AS a, macd_hist, ema5, wma13, rsi14, roc20 FROM smas s JOIN macds USING (symbol, date) JOIN wmas USING (symbol, date) JOIN rsis USING (symbol, date))""",
}


def add(name: str, spark_side, body: str) -> None:
    spark_side.__name__ = name
    QUERIES[name] = spark_side
    ORACLES[name] = sql(body, EXTRA)


def indicator(name: str, build, columns: dict[str, int | None], body: str) -> None:
    """A query of (symbol, date, columns); places of rounding by column, None for columns that are exact (whole numbers, given as doubles since they may be null)."""

    def run(spark, sf_dir):
        df = build(v.bars(spark, sf_dir))
        return df.select("symbol", "date", *[F.col(c).cast("double").alias(c) if p is None else q(c, p).alias(c) for c, p in columns.items()])

    cols = ", ".join(c if p is None else f"{sq(c, p)} AS {c}" for c, p in columns.items())
    add(name, run, f"SELECT symbol, date, {cols} FROM ({body})")


indicator("ts_sma", ts.with_sma, {f"sma{n}": 4 for n in (20, 50, 100, 200)}, "SELECT * FROM smas")
indicator("ts_ema", ts.with_ema, {f"ema{n}": 4 for n in (5, 12, 26)}, "SELECT * FROM emas")
indicator("ts_wma", ts.with_wma, {"wma13": 4}, "SELECT * FROM wmas")
indicator(
    "ts_macd", ts.with_macd, {"macd": 4, "macd_signal": 4, "macd_hist": 4, "macd_slope": 4},
    f"SELECT *, macd_hist - lag(macd_hist) {W} AS macd_slope FROM macds"
)
indicator("ts_rsi", ts.with_rsi, {"rsi14": 6}, "SELECT * FROM rsis")
indicator("ts_atr", ts.with_atr, {"atr14": 4, "atr_pct": 6}, "SELECT * FROM atrs")
indicator("ts_atr_percentile", lambda b: ts.with_atr_percentile(ts.with_atr(b).withColumn("atr14", q("atr14", 4))), {"atr_percentile": 6}, f"""
  SELECT symbol, date, CASE WHEN len(p) = 60 THEN len(list_filter(p, lambda x: x <= a)) / 60.0::DOUBLE END AS atr_percentile
  FROM (SELECT symbol, date, a, list(a) FILTER (a IS NOT NULL) {w(60)} AS p FROM (SELECT symbol, date, {sq("atr14", 4)} AS a FROM atrs))""")
indicator("ts_rvol", ts.with_rvol, {"rvol20": 6}, f"SELECT symbol, date, volume / nullif({mean('volume', 20)}, 0) AS rvol20 FROM bars")
indicator(
    "ts_roc", ts.with_roc, {"roc5": 6, "roc20": 6},
    f"SELECT symbol, date, close / nullif(lag(close, 5) {W}, 0) - 1 AS roc5, close / nullif(lag(close, 20) {W}, 0) - 1 AS roc20 FROM bars"
)
indicator(
    "ts_diff", ts.with_diff, {f"diff{n}": 4 for n in (5, 20, 60)},
    "SELECT symbol, date, " + ", ".join(f"close - lag(close, {n}) {W} AS diff{n}" for n in (5, 20, 60)) + " FROM bars"
)
indicator(
    "ts_price_vs_sma", lambda b: ts.with_price_vs_sma(ts.with_atr(ts.with_sma(b))), {"price_vs_sma200": 6, "sma50_vs_sma200": 6},
    "SELECT symbol, date, (close - sma200) / nullif(atr14, 0) AS price_vs_sma200, (sma50 - sma200) / nullif(atr14, 0) AS sma50_vs_sma200 FROM smas"
)
indicator("ts_bollinger", ts.with_bollinger, {"bollinger": 6}, f"""SELECT symbol, date, CASE WHEN s > 0 THEN (close - (m - 2 * s)) / (4 * s) WHEN s = 0 THEN 0.5::DOUBLE END AS bollinger
  FROM (SELECT symbol, date, close, {mean('close', 20)} AS m, CASE WHEN count(close) {w(20)} = 20 THEN stddev_pop(close) {w(20)} END AS s FROM bars)""")
indicator("ts_obv_slope", ts.with_obv_slope, {"obv": 4, "obv_slope": 4}, f"""SELECT *, {' + '.join(f"lag(obv, {9 - x}) {W} * ({(x - 4.5) / 82.5!r}::DOUBLE)" for x in range(10))} AS obv_slope FROM (
  SELECT symbol, date, sum(v) {W} AS obv FROM (SELECT symbol, date, coalesce(sign(close - lag(close) {W}), 0) * volume AS v FROM bars))""")
indicator("ts_vol_price_confirm", ts.with_volume_confirmation, {"vol_price_confirm": None}, f"""SELECT symbol, date, (CASE WHEN u IS NULL THEN NULL WHEN u = 0 OR x = 0 THEN 0 WHEN x > 0 THEN 1 ELSE -1 END)::DOUBLE AS vol_price_confirm
  FROM (SELECT symbol, date, close - lag(close) {W} AS u, volume - lag(volume) {W} AS x FROM bars)""")
indicator(
    "ts_trend_score", ts.with_trend_score, {"trend_long": 5, "trend_short": 5, "trend_delta": 5},
    f"SELECT symbol, date, trend_long, trend_short, trend_long - lag(trend_long) {W} AS trend_delta FROM trends"
)
indicator("ts_52w", ts.with_52w, {"from_high": 6, "from_low": 6, "in_range": 6}, f"""SELECT symbol, date, (close - h) / nullif(h, 0) AS from_high, (close - l) / nullif(l, 0) AS from_low, (close - l) / nullif(h - l, 0) AS in_range
  FROM (SELECT *, CASE WHEN count(close) {w(252)} >= 20 THEN max(high) {w(252)} END AS h, CASE WHEN count(close) {w(252)} >= 20 THEN min(low) {w(252)} END AS l FROM bars)""")
indicator(
    "ts_liquidity", ts.with_liquidity, {"avg_volume20": 4, "log_dollar_volume": 6},
    f"SELECT symbol, date, {mean('volume', 20)} AS avg_volume20, CASE WHEN close * volume > 0 THEN ln(close * volume) END AS log_dollar_volume FROM bars"
)


def ts_trend_direction_match(spark, sf_dir):
    """Candidates with the trend of their day against their direction."""
    trend = ts.with_trend_score(v.bars(spark, sf_dir)).select("symbol", "date", q("trend_long", 5).alias("trend_long"))
    c = v.candidates(spark, sf_dir).select("symbol", "date", "holding_days", "direction").join(trend, ["symbol", "date"], "left")
    return c.select(
        "symbol", "date", "holding_days", "direction",
        ts.trend_direction_match(F.col("trend_long"), F.col("direction")).cast("double").alias("trend_match")
    )


add("ts_trend_direction_match", ts_trend_direction_match, f"""SELECT symbol, date, holding_days, direction, (CASE WHEN t >= 60 THEN s WHEN t <= 40 THEN -s WHEN t IS NOT NULL THEN 0 END)::DOUBLE AS trend_match
  FROM (SELECT symbol, date, holding_days, direction, CASE WHEN direction = 'l' THEN 1 ELSE -1 END AS s, {sq('trend_long', 5)} AS t FROM candidates LEFT JOIN trends USING (symbol, date))""")


def ts_rs_vs_bench(spark, sf_dir):
    """20-row return minus the benchmark's and minus the sector's (a brand each) at the latest date up to the bar's."""
    b = ts.with_roc(v.bars(spark, sf_dir), (20,)).select("symbol", "date", F.col("roc20"))
    days = b.select("date").distinct()
    out = b
    for name, brand in (("spy", "Brand#1"), ("sec", "Brand#2")):
        bench = ts.asof_ffill(days, b.where(F.col("symbol") == brand).select("date", F.col("roc20").alias(name)), name).drop("src_date")
        out = out.join(bench, "date", "left")
    return out.select(
        "symbol", "date", q(F.col("roc20") - F.col("spy")).alias("rs_vs_spy"), q(F.col("sec") - F.col("spy")).alias("sector_vs_spy"),
        q(F.col("roc20") - F.col("sec")).alias("rs_vs_sector")
    )


add("ts_rs_vs_bench", ts_rs_vs_bench, f"""WITH r AS (SELECT symbol, date, close / nullif(lag(close, 20) {W}, 0) - 1 AS roc20 FROM bars)
SELECT r.symbol, r.date, {sq('r.roc20 - a.roc20')} AS rs_vs_spy, {sq('b.roc20 - a.roc20')} AS sector_vs_spy, {sq('r.roc20 - b.roc20')} AS rs_vs_sector
FROM r ASOF LEFT JOIN (SELECT date, roc20 FROM r WHERE symbol = 'Brand#1' AND roc20 IS NOT NULL) a ON r.date >= a.date ASOF LEFT JOIN (SELECT date, roc20 FROM r WHERE symbol = 'Brand#2' AND roc20 IS NOT NULL) b ON r.date >= b.date""")


def ts_days_to_event(spark, sf_dir):
    out = ts.days_to_event(v.bars(spark, sf_dir).select("symbol", "date"), v.earnings(spark, sf_dir))
    return out.withColumn("days_to_event", F.col("days_to_event").cast("double"))


add("ts_days_to_event", ts_days_to_event, """SELECT b.symbol, b.date, (e.date - b.date)::DOUBLE AS days_to_event, coalesce(e.date - b.date <= 5, false) AS is_near
FROM bars b ASOF LEFT JOIN earnings e ON b.symbol = e.symbol AND b.date <= e.date""")


def asof_ffill(spark, sf_dir):
    """Bars with the latest two-year rate up to their date."""
    b = v.bars(spark, sf_dir).select("symbol", "date")
    rate = ts.asof_ffill(b.select("date").distinct(), v.index_series(spark, sf_dir).select("date", "us2y"), "us2y")
    return b.join(rate, "date", "left").select("symbol", "date", "us2y", F.col("src_date").cast("string").alias("src_date"))


add(
    "asof_ffill", asof_ffill,
    "SELECT b.symbol, b.date, i.us2y, i.date::VARCHAR AS src_date FROM bars b ASOF LEFT JOIN (SELECT date, us2y FROM index_series WHERE us2y IS NOT NULL) i ON b.date >= i.date"
)


def asof_back_tolerance(spark, sf_dir):
    """Candidates with the close on their exit date or up to 5 days before."""
    b = v.bars(spark, sf_dir).select("symbol", "date", "close")
    at = ts.last_trading_day(b, 5)
    c = v.candidates(spark, sf_dir).select("symbol", "date", "holding_days", "direction").withColumn("cal_date", F.date_add("date", F.col("holding_days")))
    c = c.join(at, ["symbol", "cal_date"], "left")
    return c.join(b.select("symbol", F.col("date").alias("trade_date"), "close"), ["symbol", "trade_date"], "left").select(
        "symbol", "date", "holding_days", "direction", F.col("trade_date").cast("string").alias("trade_date"), "close"
    )


add("asof_back_tolerance", asof_back_tolerance, """SELECT c.symbol, c.date, c.holding_days, c.direction, CASE WHEN c.x - b.date <= 5 THEN b.date::VARCHAR END AS trade_date, CASE WHEN c.x - b.date <= 5 THEN b.close END AS close
FROM (SELECT *, (date + holding_days)::DATE AS x FROM candidates) c ASOF LEFT JOIN bars b ON c.symbol = b.symbol AND c.x >= b.date""")


def asof_forward_tolerance(spark, sf_dir):
    """Candidates with the close of the first trading day in the 5 days from their exit date on."""
    b = v.bars(spark, sf_dir).select("symbol", "date", "close")
    at = ts.next_trading_day(b, 4)
    c = v.candidates(spark, sf_dir).select("symbol", "date", "holding_days", "direction").withColumn("cal_date", F.date_add("date", F.col("holding_days")))
    c = c.join(at, ["symbol", "cal_date"], "left")
    return c.join(b.select("symbol", F.col("date").alias("trade_date"), "close"), ["symbol", "trade_date"], "left").select(
        "symbol", "date", "holding_days", "direction", F.col("trade_date").cast("string").alias("trade_date"), "close"
    )


add("asof_forward_tolerance", asof_forward_tolerance, """SELECT c.symbol, c.date, c.holding_days, c.direction, CASE WHEN b.date - c.x <= 4 THEN b.date::VARCHAR END AS trade_date, CASE WHEN b.date - c.x <= 4 THEN b.close END AS close
FROM (SELECT *, (date + holding_days)::DATE AS x FROM candidates) c ASOF LEFT JOIN bars b ON c.symbol = b.symbol AND c.x <= b.date""")
