"""Queries over index series: market regime, seasons and calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonflow.functions import regime as rg
from seasonflow.functions.core import q
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.sources import views as v

QUERIES, ORACLES = {}, {}
W = "OVER (ORDER BY date)"
WIDE = {k: f"Brand#{i}" for i, k in enumerate(("hyg", "lqd", "xlk", "xlu", "dxy", "cl", "gc"), 1)}
PHASE = "(((year({d}) - 2001) % 4 + 4) % 4 + 1)::INT"
EXTRA = {
    "wide": "SELECT date, " + ", ".join(f"max(close) FILTER (symbol = '{b}') AS {k}" for k, b in WIDE.items()) + f" FROM bars WHERE symbol IN {tuple(WIDE.values())} GROUP BY date",
    "fwds": f"SELECT date, week(date)::INT AS week, {PHASE.format(d='date')} AS phase, 100 * (lead(spx, 15) {W} - spx) / nullif(spx, 0) AS fwd, lead(date, 15) {W} AS fwd_date FROM index_series",
    "expanding": """SELECT f.week, f.phase, y.year, count(*) AS n, avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS win_rate, avg(fwd) AS mean_return
  FROM fwds f JOIN (SELECT DISTINCT year(date)::INT AS year FROM index_series) y ON year(f.fwd_date) < y.year WHERE fwd IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""",
}


def mean(c: str, n: int) -> str:
    o = f"OVER (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({c}) {o} = {n} THEN avg({c}) {o} END)"


def add(name: str, spark_side, body: str) -> None:
    spark_side.__name__ = name
    QUERIES[name] = spark_side
    ORACLES[name] = sql(body, EXTRA)


def wide(spark, sf_dir):
    """Closes of seven brands by date, as stand-ins for funds and commodities."""
    b = v.bars(spark, sf_dir).where(F.col("symbol").isin(*WIDE.values()))
    return b.groupBy("date").agg(*[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(k) for k, s in WIDE.items()])


def series(name: str, source, build, columns: dict[str, int], body: str) -> None:
    def run(spark, sf_dir):
        return build(source(spark, sf_dir)).select("date", *[q(c, p).alias(c) for c, p in columns.items()])

    add(name, run, f"SELECT date, {', '.join(f'{sq(c, p)} AS {c}' for c, p in columns.items())} FROM ({body})")


series("mkt_vix", v.index_series, rg.vix_features, {"vix_pct": 6, "vix_change": 6, "vix_bucket": 0, "vix_term": 6}, f"""
  SELECT date, CASE WHEN len(p) = 60 THEN (len(list_filter(p, lambda x: x < vix)) + (len(list_filter(p, lambda x: x = vix)) + 1) / 2.0::DOUBLE) / 60 END AS vix_pct, vix - lag(vix, 5) {W} AS vix_change,
    CASE WHEN vix <= 15 THEN 0 WHEN vix <= 20 THEN 1 WHEN vix <= 25 THEN 2 WHEN vix <= 30 THEN 3 WHEN vix IS NOT NULL THEN 4 END AS vix_bucket,
    vix - last_value(vix3m IGNORE NULLS) {W} AS vix_term
  FROM (SELECT *, list(vix) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS p FROM index_series)""")
series("mkt_rates", v.index_series, rg.rate_features, {"spread": 6, "spread_slope": 6, "fed_rate": 6, "rate_direction": 6}, f"""
  SELECT date, spread, spread - lag(spread, 5) {W} AS spread_slope, fed_rate, fed_rate - lag(fed_rate, 60) {W} AS rate_direction
  FROM (SELECT *, us10y - last_value(us2y IGNORE NULLS) {W} AS spread, last_value(irx IGNORE NULLS) {W} AS fed_rate FROM index_series)""")
series(
    "mkt_credit", wide, lambda d: rg.ratio_change(d, "hyg", "lqd"), {"ratio": 5, "ratio_change": 5},
    f"SELECT date, ratio, ratio - lag(ratio, 20) {W} AS ratio_change FROM (SELECT *, hyg / nullif(lqd, 0) AS ratio FROM wide)"
)
series(
    "mkt_spy", v.index_series, rg.index_trend, {"index_roc": 6, "above_mean": 0},
    f"SELECT date, spx / nullif(lag(spx, 20) {W}, 0) - 1 AS index_roc, CASE WHEN spx > m THEN 1 WHEN m IS NOT NULL THEN 0 END AS above_mean FROM (SELECT *, {mean('spx', 200)} AS m FROM index_series)"
)
series(
    "mkt_breadth", v.index_series, rg.breadth, {"breadth": 6, "breadth_momentum": 6},
    f"SELECT date, b AS breadth, b - lag(b, 20) {W} AS breadth_momentum FROM (SELECT *, {mean('advn', 10)} / nullif({mean('decn', 10)}, 0) AS b FROM index_series)"
)
series(
    "mkt_rotation", wide, lambda d: rg.rotation(d, "xlk", "xlu"), {"rotation": 5},
    f"SELECT date, (xlk / nullif(lag(xlk, 20) {W}, 0) - 1) - (xlu / nullif(lag(xlu, 20) {W}, 0) - 1) AS rotation FROM wide"
)
series("mkt_commodity_fx", wide, lambda d: rg.filled_roc(d, ["dxy", "cl", "gc"]), {"dxy_roc": 5, "cl_roc": 5, "gc_roc": 5}, f"""
  SELECT date, {', '.join(f'{k} / nullif(lag({k}, 20) {W}, 0) - 1 AS {k}_roc' for k in ('dxy', 'cl', 'gc'))}
  FROM (SELECT date, {', '.join(f'last_value({k} IGNORE NULLS) {W} AS {k}' for k in ('dxy', 'cl', 'gc'))} FROM wide)""")


def agg_seasonal_lookup(spark, sf_dir):
    return rg.seasonal_lookup(v.index_series(spark, sf_dir), "spx").select(
        "week", "phase", "n", q("win_rate").alias("win_rate"), q("mean_return", 5).alias("mean_return")
    )


add(
    "agg_seasonal_lookup", agg_seasonal_lookup,
    f"SELECT week, phase, count(*) AS n, {sq('avg(CASE WHEN fwd > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS win_rate, {sq('avg(fwd)', 5)} AS mean_return FROM fwds WHERE fwd IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5"
)


def agg_seasonal_expanding(spark, sf_dir):
    return rg.seasonal_expanding(v.index_series(spark, sf_dir), "spx").select(
        "week", "phase", "year", "n", q("win_rate").alias("win_rate"), q("mean_return", 5).alias("mean_return")
    )


add(
    "agg_seasonal_expanding", agg_seasonal_expanding,
    f"SELECT week, phase, year, n, {sq('win_rate')} AS win_rate, {sq('mean_return', 5)} AS mean_return FROM expanding"
)


def mkt_seasonal_features(spark, sf_dir):
    """Candidates with the season that earlier years show for their week and cycle phase."""
    look = rg.seasonal_expanding(v.index_series(spark, sf_dir), "spx").select(
        "week", "phase", "year", q("win_rate").alias("win_rate"), q("mean_return", 5).alias("mean_return")
    )
    c = v.candidates(spark, sf_dir).select(
        "symbol", "date", "holding_days", "direction", "year", F.weekofyear("date").alias("week"),
        rg.cycle_year(F.year("date")).alias("phase")
    )
    regime, alignment = rg.seasonal_regime(F.col("win_rate"), F.col("direction"))
    out = c.join(F.broadcast(look), ["week", "phase", "year"], "left")  # at most 53 weeks x 4 phases x the number of years
    return out.select(
        "symbol", "date", "holding_days", "direction", "win_rate", "mean_return", regime.cast("double").alias("regime"),
        alignment.cast("double").alias("alignment")
    )


SEASONAL = f"""WITH look AS (SELECT week, phase, year, {sq('win_rate')} AS win_rate, {sq('mean_return', 5)} AS mean_return FROM expanding)
SELECT symbol, date, holding_days, direction, win_rate, mean_return,
  (CASE WHEN win_rate < 0.4 THEN -2 WHEN win_rate < 0.5 THEN -1 WHEN win_rate < 0.6 THEN 0 WHEN win_rate < 0.7 THEN 1 WHEN win_rate IS NOT NULL THEN 2 END)::DOUBLE AS regime,
  (CASE WHEN win_rate >= 0.55 THEN 1 WHEN win_rate <= 0.45 THEN -1 WHEN win_rate IS NOT NULL THEN 0 END * CASE WHEN direction = 'l' THEN 1 ELSE -1 END)::DOUBLE AS alignment
FROM (SELECT *, week(date)::INT AS week, {PHASE.format(d='date')} AS phase FROM candidates) LEFT JOIN look USING (week, phase, year)"""
add("mkt_seasonal_features", mkt_seasonal_features, SEASONAL)


def cal_features(spark, sf_dir):
    d = v.bars(spark, sf_dir).select("date").distinct()
    f = rg.calendar_features(F.col("date"))
    f["cal_day_of_year"] = q(f["cal_day_of_year"])
    return d.select("date", *[c.alias(k) for k, c in f.items()])


add("cal_features", cal_features, f"""SELECT date, month(date)::INT AS cal_month, {sq("dayofyear(date) / dayofyear(make_date(year(date), 12, 31))::DOUBLE")} AS cal_day_of_year, ((day(date) - 1) // 7 + 1)::INT AS cal_week_of_month, quarter(date)::INT AS cal_quarter,
  (CASE WHEN day(date) <= 10 THEN 0 WHEN day(date) <= 20 THEN 1 ELSE 2 END)::INT AS cal_month_position, {PHASE.format(d='date')} AS cal_pe_year,
  (CASE WHEN date BETWEEN f - 4 AND f THEN 1 ELSE 0 END)::INT AS cal_is_opex_week
FROM (SELECT *, (m + ((5 - isodow(m) + 7) % 7 + 14)::INT)::DATE AS f FROM (SELECT DISTINCT date, date_trunc('month', date)::DATE AS m FROM bars))""")


def aligned_series(spark, sf_dir):
    """Two series on the dates that both have, and their difference."""
    b = v.bars(spark, sf_dir)
    one = b.where("symbol = 'Brand#1'").select("date", F.col("close").alias("a"))
    two = b.where("symbol = 'Brand#2'").select("date", F.col("close").alias("b"))
    return one.join(two, "date").select("date", q(F.col("a") - F.col("b"), 4).alias("diff"))


add(
    "aligned_series", aligned_series,
    f"SELECT a.date, {sq('a.close - b.close', 4)} AS diff FROM bars a JOIN bars b USING (date) WHERE a.symbol = 'Brand#1' AND b.symbol = 'Brand#2'"
)


def trading_days(spark, sf_dir):
    """The dates on which any symbol trades, within two years, numbered: a calendar, so its numbering is one small task."""
    from pyspark.sql import Window

    d = v.ticks(spark, sf_dir).select("date").where(F.col("date").between("1997-01-01", "2000-12-31")).distinct()
    return d.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).cast("long").alias("idx"))


add(
    "trading_days", trading_days,
    "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM ticks WHERE date BETWEEN '1997-01-01' AND '2000-12-31')"
)
