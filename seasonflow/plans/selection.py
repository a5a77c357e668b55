"""Queries over candidates: filters, ranks, top-k, quality, Kelly ratios and sizes."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import avg_tie_rank, q, written
from seasonflow.operators import selection as sl
from seasonflow.plans import regime
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.sources import views as v

QUERIES, ORACLES = {}, {}
K = ["symbol", "date", "holding_days", "direction"]
KS = ", ".join(K)
WINDOWS = [("1998-03-01", "1998-10-31"), ("2000-05-01", "2000-06-30")]
IN = " OR ".join(f"date BETWEEN '{a}' AND '{b}'" for a, b in WINDOWS)
YEARS = [1996, 1997, 1998, 1999, 2000, 2001]


def tie(by: str, c: str) -> str:
    return f"((rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {by}))"


EXTRA = {
    "gapped": "SELECT *, predicted_mfe - predicted_return AS gap FROM candidates",
    "tied": f"SELECT *, {tie('date', 'win_probability')} AS a, {tie('date', 'predicted_return')} AS b, {tie('date', 'gap')} AS c FROM gapped",
    "qual0": "SELECT symbol, year, avg(actual_return) AS r FROM candidates GROUP BY 1, 2",
    "qual1": "SELECT symbol, year, floor(coalesce(avg(r) OVER (PARTITION BY symbol ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1e9 + 0.5::DOUBLE) / 1e9 AS before FROM qual0",
    "quality": f"SELECT symbol, year, 10 * {tie('year', 'before')} AS quality FROM qual1",
    "capped": "SELECT * FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY ml_score DESC, symbol, holding_days, direction) <= 2) QUALIFY row_number() OVER (PARTITION BY date ORDER BY ml_score DESC, symbol, holding_days, direction) <= 5",
}
BY_SCORE = [F.desc, "ml_score"]


def query(body: str, extra: dict | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql(body, {**EXTRA, **(extra or {})})
        return f

    return keep


def c(spark, sf_dir):
    return v.candidates(spark, sf_dir)


@query(f"SELECT {KS}, ml_score FROM candidates WHERE holding_days BETWEEN 10 AND 30")
def filter_tier(spark, sf_dir):
    return sl.in_tier(c(spark, sf_dir), "10_30").select(*K, "ml_score")


@query("SELECT l_orderkey, l_linenumber, days, CASE WHEN days <= 0 THEN NULL WHEN days <= 30 THEN '10_30' WHEN days <= 60 THEN '31_60' ELSE '61_90' END AS tier FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 100 - 5 AS days FROM lineitem)")
def tier_for_days_out(spark, sf_dir):
    t = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 100 - 5).alias("days"))
    return t.withColumn("tier", sl.tier_for(F.col("days")))


@query(f"SELECT {KS}, coalesce(vix, 0) AS vix FROM candidates LEFT JOIN index_series USING (date) WHERE coalesce(vix, 0) <= 30")
def filter_vix(spark, sf_dir):
    return sl.calm(c(spark, sf_dir), v.index_series(spark, sf_dir), 30.0).select(*K, F.coalesce("vix", F.lit(0.0)).alias("vix"))


@query(f"SELECT {KS}, coalesce(vix, 20) AS vix FROM candidates LEFT JOIN index_series USING (date)")
def join_vix_by_date(spark, sf_dir):
    return sl.with_vix(c(spark, sf_dir), v.index_series(spark, sf_dir), 20.0).select(*K, "vix")


@query(
    f"SELECT {KS}, ml_score, coalesce(alignment, 0) AS alignment FROM candidates JOIN ({regime.SEASONAL}) USING ({KS}) WHERE coalesce(alignment, 0) <> -1",
    regime.EXTRA
)
def filter_against_season(spark, sf_dir):
    """Candidates without those whose direction is against the season of earlier years; those without a season stay."""
    aligned = regime.mkt_seasonal_features(spark, sf_dir).select(*K, F.coalesce("alignment", F.lit(0.0)).alias("alignment"))
    return c(spark, sf_dir).join(aligned, K).where(F.col("alignment") != -1).select(*K, "ml_score", "alignment")


@query(" UNION ALL ".join(f"SELECT '{way}' AS way, symbol, date, days_out, direction, combo, sharpe_ratio, sharpe_ratio2, avg_profit FROM opps WHERE {cond} AND days_out BETWEEN 10 AND 25 AND (sharpe_ratio > 1 OR coalesce(sharpe_ratio2 > 1, false)) AND avg_profit >= 2 AND upper(symbol) NOT IN ('BRAND#3', 'BRAND#17')" for way, cond in (
    ("l", "direction = 'l'"), ("both", "direction IN ('l', 's')")
)))
def filter_prefilter(spark, sf_dir):
    o = v.opportunities(spark, sf_dir)
    shown = lambda way: sl.prefilter(o, way, (10, 25), 2.0, ["brand#3", "Brand#17"]).select(
        F.lit(way).alias("way"), "symbol", "date", "days_out", "direction", "combo", "sharpe_ratio", "sharpe_ratio2", "avg_profit"
    )
    return shown("l").unionByName(shown("both"))


@query(f"SELECT {KS}, ml_score FROM candidates ANTI JOIN earnings e ON candidates.symbol = e.symbol AND e.date BETWEEN candidates.date AND (candidates.date + holding_days) WHERE ml_score >= 70 AND win_probability >= 0.68 AND predicted_return >= 1.5".replace("symbol, date,", "candidates.symbol, candidates.date,"))
def filter_thresholds(spark, sf_dir):
    """Candidates over the floors without earnings in their holding period."""
    from seasonflow.operators.trades import without_events

    return without_events(sl.thresholds(c(spark, sf_dir), 70.0, 0.68, 1.5), v.earnings(spark, sf_dir)).select(*K, "ml_score")


@query(f"SELECT {KS}, ml_score, in_regime FROM (SELECT *, {IN} AS in_regime FROM candidates) WHERE CASE WHEN in_regime THEN ml_score >= 70 AND direction = 'l' AND sector <> 'ASIA' ELSE ml_score >= 85 END")
def filter_regime_switch(spark, sf_dir):
    return sl.regime_switch(c(spark, sf_dir), WINDOWS, 85.0).select(*K, "ml_score", "in_regime")


@query(f"SELECT {KS}, {IN} AS in_window FROM candidates")
def range_window_membership(spark, sf_dir):
    return c(spark, sf_dir).select(*K, sl.in_windows(F.col("date"), WINDOWS).alias("in_window"))


@query(f"SELECT {KS} FROM candidates WHERE isodow(date) <> 1")
def filter_skip_monday(spark, sf_dir):
    return c(spark, sf_dir).where(F.weekday("date") != 0).select(*K)


@query(f"SELECT {KS} FROM candidates WHERE ('0x' || md5(symbol || '_' || date || '_IL')[1:8])::BIGINT / 4294967295 < 0.6")
def filter_iv_hash(spark, sf_dir):
    return c(spark, sf_dir).where(sl.iv_share(F.col("symbol"), F.col("date"), "IL") < 0.6).select(*K)


@query("SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS seen, count(*) OVER (PARTITION BY symbol) AS n FROM bars) WHERE close IS NOT NULL AND close <> 0 AND seen >= 200 AND n >= 252")
def filter_validity(spark, sf_dir):
    b = v.bars(spark, sf_dir)
    seen = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1
    b = b.withColumn("seen", seen).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return b.dropna(subset=["close"]).where("close <> 0 and seen >= 200 and n >= 252").select("symbol", "date", "close")


@query(f"SELECT {KS}, ml_score FROM candidates")
def drop_all_null_features(spark, sf_dir):
    df = c(spark, sf_dir).select(*K, "ml_score").withColumn("nothing", F.lit(None).cast("double"))
    return sl.drop_empty_columns(df, ["ml_score", "nothing"])


REQUESTS = """SELECT event_id, 'Brand#' || (user_id % 25 + 1) AS symbol, ts::DATE::VARCHAR AS date, CASE WHEN event_id % 50 = 7 THEN 'ten' WHEN event_id % 50 = 9 THEN '' ELSE json_extract_string(props, '$.k') END AS days_out,
  CASE event_type WHEN 'click' THEN 'l' WHEN 'view' THEN 's' ELSE 'l' END AS direction, CASE WHEN event_id % 11 = 0 THEN '31_60' WHEN event_id % 13 = 0 THEN '1_5' END AS tier FROM events"""


def request_rows(spark, sf_dir, events=None):
    """Requests from events: unvalidated text fields, some missing or malformed."""
    e = v.table(spark, sf_dir, "events") if events is None else events
    days = F.when(F.col("event_id") % 50 == 7, "ten").when(F.col("event_id") % 50 == 9, "").otherwise(F.get_json_object("props", "$.k"))
    return e.select(
        "event_id", F.concat(F.lit("Brand#"), F.col("user_id") % 25 + 1).alias("symbol"), F.to_date("ts").cast("string").alias("date"), days.alias("days_out"),
        F.when(F.col("event_type") == "view", "s").otherwise("l").alias("direction"), F.when(F.col("event_id") % 11 == 0, "31_60").when(F.col("event_id") % 13 == 0, "1_5").alias("tier"),
    )


VALIDATED = """SELECT *, error IS NULL AND tier <> auto AS mismatch FROM (SELECT *, CASE WHEN symbol = '' OR date = '' OR days_out = '' OR direction = '' OR symbol IS NULL OR date IS NULL OR days_out IS NULL OR direction IS NULL THEN 'Missing required fields'
  WHEN days IS NULL THEN 'daysOut must be an integer' WHEN days <= 0 THEN 'daysOut must be positive' WHEN tier NOT IN ('10_30', '31_60', '61_90') THEN 'Unknown tier' END AS error
  FROM (SELECT event_id, symbol, date, days_out, direction, coalesce(tier, auto) AS tier, days, auto FROM (SELECT *, CASE WHEN days <= 0 THEN NULL WHEN days <= 30 THEN '10_30' WHEN days <= 60 THEN '31_60' ELSE '61_90' END AS auto
  FROM (SELECT *, try_cast(days_out AS INT) AS days FROM requests))))"""


@query(
    "SELECT event_id, symbol, date, days_out, direction, tier, error, coalesce(mismatch, false) AS mismatch FROM validated",
    {"requests": REQUESTS, "validated": VALIDATED}
)
def validate_requests(spark, sf_dir):
    out = sl.validated(request_rows(spark, sf_dir), ["10_30", "31_60", "61_90"])
    return out.select("event_id", "symbol", "date", "days_out", "direction", "tier", "error", F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


@query(f"SELECT symbol, date, holding_days, direction, (date + holding_days)::DATE AS exit_date, {sq('actual_return / 100')} AS ret, {sq('atr_14d_pct * 100')} AS atr_pct_points, stock_volatility_20d AS rel_volume FROM candidates")
def proj_rename_units(spark, sf_dir):
    df = c(spark, sf_dir).withColumnsRenamed({"stock_volatility_20d": "rel_volume"})
    return df.select(
        *K, F.expr("date_add(date, holding_days)").alias("exit_date"), q(F.col("actual_return") / 100).alias("ret"),
        q(F.col("atr_14d_pct") * 100).alias("atr_pct_points"), "rel_volume"
    )


@query(f"SELECT {KS}, {sq('0.45 * ml_score + 35 * win_probability + 3 * predicted_return + 10 * p_hit_return')} AS combo_rank FROM candidates")
def proj_combo_rank(spark, sf_dir):
    return c(spark, sf_dir).select(*K, q(sl.combo_rank()).alias("combo_rank"))


@query(f"SELECT {KS}, row_number() OVER (PARTITION BY date ORDER BY win_probability DESC, symbol, holding_days, direction) AS wp, row_number() OVER (PARTITION BY date ORDER BY gap DESC, symbol, holding_days, direction) AS mg FROM gapped")
def rank_simple(spark, sf_dir):
    a = sl.rank_by(c(spark, sf_dir), "WP").select(*K, "predicted_mfe", "predicted_return", F.col("rank").cast("long").alias("wp"))
    return sl.rank_by(a, "MG").select(*K, "wp", F.col("rank").cast("long").alias("mg"))


@query(f"SELECT {KS}, s AS score, row_number() OVER (PARTITION BY date ORDER BY s DESC, symbol, holding_days, direction) AS rank FROM (SELECT *, floor((a * 0.6::DOUBLE + b * 0.25::DOUBLE + c * 0.15::DOUBLE) * 1e9 + 0.5::DOUBLE) / 1e9 AS s FROM tied)")
def rank_composite(spark, sf_dir):
    return sl.rank_by(c(spark, sf_dir), "CW").select(*K, "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT {KS}, {sq(tie('date', 'ml_score'))} AS pct FROM candidates")
def rank_avg_tie(spark, sf_dir):
    return c(spark, sf_dir).select(*K, q(avg_tie_rank(["date"], "ml_score")).alias("pct"))


@query(f"SELECT symbol, year, {sq('quality')} AS quality FROM quality")
def agg_symbol_quality(spark, sf_dir):
    return sl.symbol_quality(c(spark, sf_dir)).select("symbol", "year", q("quality").alias("quality"))


@query(f"""SELECT symbol, y AS year, {sq('greatest(least(s / n, 10), -10)')} AS quality FROM (
  SELECT c.symbol, y.y, sum(c.actual_return) AS s, count(*) AS n FROM candidates c, (SELECT unnest({YEARS})::INT AS y) y
  WHERE c.year < y.y OR (SELECT count(*) FROM candidates k WHERE k.year < y.y) < 1000 GROUP BY 1, 2) WHERE n >= 10""")
def agg_symbol_quality_rows(spark, sf_dir):
    df = c(spark, sf_dir)
    years = df.select("year").distinct()
    return sl.symbol_quality_rows(df, years).where(F.col("year").isin(*YEARS)).select("symbol", "year", q("quality").alias("quality"))


@query(f"SELECT {KS}, {sq('coalesce(quality, 5)')} AS quality FROM candidates LEFT JOIN (SELECT * FROM quality WHERE year < 2001) USING (symbol, year)")
def join_symbol_year_quality(spark, sf_dir):
    df = c(spark, sf_dir)
    quality = sl.symbol_quality(df).where("year < 2001")
    return df.join(quality, ["symbol", "year"], "left").select(*K, q(F.coalesce("quality", F.lit(5.0))).alias("quality"))


@query(f"""WITH t AS (SELECT *, {tie('date', 'quality')} AS d, min(quality) OVER (PARTITION BY date) = max(quality) OVER (PARTITION BY date) AS flat FROM tied JOIN quality USING (symbol, year)),
s AS (SELECT *, floor((a * 0.54::DOUBLE + b * 0.225::DOUBLE + c * 0.135::DOUBLE + CASE WHEN flat THEN 0.5::DOUBLE ELSE d END * 0.10::DOUBLE) * 1e9 + 0.5::DOUBLE) / 1e9 AS score FROM t)
SELECT {KS}, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol, holding_days, direction) AS rank FROM s""")
def rank_quality(spark, sf_dir):
    df = c(spark, sf_dir)
    return sl.rank_quality(df, sl.symbol_quality(df)).select(*K, "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT symbol, date, direction, holding_days, ml_score FROM candidates QUALIFY row_number() OVER (PARTITION BY date, symbol, direction ORDER BY ml_score DESC, holding_days) = 1")
def dedup_best(spark, sf_dir):
    return sl.best_per(
        c(spark, sf_dir), ["date", "symbol", "direction"], [F.desc("ml_score"), F.col("holding_days")]
    ).select("symbol", "date", "direction", "holding_days", "ml_score")


@query("SELECT symbol, date, days_out, direction, combo, sharpe_ratio FROM opps QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC, date, days_out, direction, combo) <= 3")
def topk_per_symbol(spark, sf_dir):
    return sl.best_per(
        v.opportunities(spark, sf_dir), ["symbol"],
        [F.desc("sharpe_ratio"), F.col("date"), F.col("days_out"), F.col("direction"), F.col("combo")], 3
    ).select("symbol", "date", "days_out", "direction", "combo", "sharpe_ratio")


@query("""WITH one AS (SELECT * FROM candidates WHERE win_probability >= 0.6 QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY win_probability DESC, predicted_return DESC, holding_days, direction) = 1),
funnel AS (SELECT count(*) AS prefiltered, count(win_probability) AS scored, count(*) FILTER (win_probability >= 0.6) AS over_floor FROM candidates)
SELECT date, symbol, win_probability, predicted_return, prefiltered, scored, over_floor FROM (FROM one QUALIFY row_number() OVER (PARTITION BY date ORDER BY win_probability DESC, predicted_return DESC, symbol) <= 4), funnel""")
def select_daily(spark, sf_dir):
    """Picks with the counts of their funnel, which were taken while the picks were written."""
    seen = Observation()
    picks = sl.daily_selection(c(spark, sf_dir), 0.6, 4, seen).select("date", "symbol", "win_probability", "predicted_return")
    picks = written(picks, "picks")
    return picks.select("*", *[F.lit(seen.get[k]).cast("long").alias(k) for k in ("prefiltered", "scored", "over_floor")])


@query("SELECT date, symbol, holding_days, direction, sector, ml_score FROM capped")
def topk_sector_cap(spark, sf_dir):
    return sl.sector_capped(
        c(spark, sf_dir), 5, 2, [F.desc("ml_score"), F.col("symbol"), F.col("holding_days"), F.col("direction")]
    ).select("date", "symbol", "holding_days", "direction", "sector", "ml_score")


@query("SELECT strategy_id, symbol, entry_date, exit_date, direction, holding_days FROM (SELECT *, entry_date - lag(exit_date) OVER (PARTITION BY strategy_id, symbol ORDER BY entry_date, exit_date, direction, holding_days) AS g FROM trades) WHERE g IS NULL OR g >= 5")
def no_repeat(spark, sf_dir):
    return sl.no_repeat(v.trades(spark, sf_dir), 5).select("strategy_id", "symbol", "entry_date", "exit_date", "direction", "holding_days")


DAYS = "SELECT d::DATE AS date, (SELECT count(*) FROM (SELECT DISTINCT date FROM ticks) t WHERE t.date <= d::DATE) - 1 AS idx FROM (SELECT unnest(generate_series((SELECT min(date) FROM ticks), (SELECT max(date) + 40 FROM ticks), INTERVAL 1 DAY)) AS d)"


def trading_days(spark, sf_dir):
    """(date, idx) of every calendar date from the first bar to 40 days after the last: the number of the latest trading day. A calendar."""
    d = v.ticks(spark, sf_dir).select("date").distinct()
    ends = d.agg(F.min("date").alias("a"), F.date_add(F.max("date"), 40).alias("b"))
    every = ends.select(F.explode(F.sequence("a", "b")).alias("date")).join(d.withColumn("t", F.lit(1)), "date", "left")
    return every.select("date", (F.count("t").over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("idx"))


@query("""SELECT strategy_id, symbol, entry_date, direction, holding_days, losses, losses >= 3 AS many_losses, coalesce(day_losses, 0)::BIGINT AS day_losses, coalesce(day_losses, 0) >= 3 AS blocked FROM (SELECT *, coalesce(sum(CASE WHEN exit_return <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy_id
  ORDER BY exit_date, entry_date, symbol, direction, holding_days ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS losses FROM trades)
LEFT JOIN (SELECT date AS entry_date, idx FROM days) USING (entry_date) LEFT JOIN (SELECT strategy_id, idx, sum(n) AS day_losses FROM
  (SELECT strategy_id, unnest([i, i + 1, i + 2, i + 3, i + 4, i + 5]) AS idx, n FROM (SELECT strategy_id, idx AS i, count(*) AS n FROM trades JOIN days ON exit_date = date WHERE exit_return <= 0 GROUP BY 1, 2)) GROUP BY 1, 2) USING (strategy_id, idx)""", {"days": DAYS})
def recent_loss_flag(spark, sf_dir):
    """Losses among the last five exits, and losing exits within five trading days up to the entry."""
    t = sl.loss_breaker(sl.recent_losses(v.trades(spark, sf_dir)), trading_days(spark, sf_dir))
    return t.select("strategy_id", "symbol", "entry_date", "direction", "holding_days", "losses", "many_losses", "day_losses", "blocked")


KELLY = """WITH t AS (SELECT *, unnest([70, 80, 85, 90])::DOUBLE AS threshold FROM candidates), f AS (SELECT * FROM t WHERE ml_score >= threshold),
g AS (SELECT DISTINCT {d}threshold, unnest({years})::INT AS y FROM f),
n AS (SELECT {dg}g.threshold, g.y, count(*) FILTER (f.year < g.y) AS n FROM g JOIN f ON f.threshold = g.threshold {on} GROUP BY ALL),
p AS (SELECT {dg}g.threshold, g.y, avg(actual_return) FILTER (actual_return > 0) AS w, count(*) FILTER (actual_return > 0) AS wn, avg(abs(actual_return)) FILTER (actual_return <= 0) AS l, count(*) FILTER (actual_return <= 0) AS ln
  FROM n g JOIN f ON f.threshold = g.threshold {on} AND (f.year < g.y OR g.n < 100) GROUP BY ALL)
SELECT {d}threshold, y AS year, {r} AS r FROM p"""
R = sq("CASE WHEN wn > 10 AND ln > 10 THEN w / nullif(l, 0) ELSE 1.3::DOUBLE END", 5)


@query(KELLY.format(d="", dg="", on="", years=YEARS, r=R))
def agg_kelly_r(spark, sf_dir):
    return sl.kelly_ratio(c(spark, sf_dir), [70, 80, 85, 90], YEARS).select("threshold", "year", q("r", 5).alias("r"))


@query(KELLY.format(d="direction, ", dg="g.direction, ", on="AND f.direction = g.direction", years=YEARS, r=R))
def agg_kelly_r_dir(spark, sf_dir):
    return sl.kelly_ratio(c(spark, sf_dir), [70, 80, 85, 90], YEARS, ("direction",)).select("direction", "threshold", "year", q("r", 5).alias("r"))


B = 0.09


@query(f"""SELECT {KS}, {sq(f'{B}')} AS sf, {sq(f'least(k * 0.25, {2 * B})')} AS sk, {sq(f'least(k * 0.5, {2 * B})')} AS sh, {sq(f'least(k * CASE WHEN ml_score >= 90 THEN 0.5 WHEN ml_score >= 80 THEN 0.35 ELSE 0.25 END, {2 * B})')} AS sa,
  {sq(f'greatest(0.5, least(1.5, (win_probability - 0.5) * 4)) * {B}')} AS sc, {sq(f'greatest(0.5, least(2.0, 0.25 / stock_volatility_20d)) * {B}')} AS sv,
  {sq('least(0.15 * greatest(0.75, least(1.35, win_probability / 0.68)), 0.24)')} AS conf, {sq('least(greatest(0.15 * 25 / greatest(15, stock_volatility_20d * 100), 0.15 * 0.6), 0.15 * 1.4) * least(1, 20 / greatest(coalesce(vix, 20), 10))')} AS inv_vix,
  {sq(f'least(k * 0.25, {2 * B}) * CASE WHEN coalesce(vix, 15) > 15 THEN greatest(least((35 - coalesce(vix, 15)) / 20, 1.0::DOUBLE), 0.1::DOUBLE) ELSE 1.0::DOUBLE END')} AS sk_vix,
  {sq('least(0.05::DOUBLE, 0.1::DOUBLE)')} AS opt_sf, {sq('least(k * 0.5, 0.1::DOUBLE)')} AS opt_sh, {sq('greatest(least(k * 0.5, 0.1::DOUBLE, 0.5::DOUBLE - ml_score / 200), 0)')} AS opt_left,
  {sq('least(k * CASE WHEN ml_score >= 90 THEN 0.5 WHEN ml_score >= 80 THEN 0.35 ELSE 0.25 END, 0.1::DOUBLE)')} AS spread_sa
FROM (SELECT *, greatest(win_probability - (1 - win_probability) / 1.3::DOUBLE, 0) AS k FROM candidates) LEFT JOIN index_series USING (date)""")
def size_fraction(spark, sf_dir):
    """Shares of equity by method; of these one under the second VIX scale, and premiums of options and spreads (one beside open positions)."""
    df = sl.with_vix(c(spark, sf_dir), v.index_series(spark, sf_dir).select("date", "vix"), 20.0).withColumnRenamed("vix", "vix20")
    df = sl.with_vix(df, v.index_series(spark, sf_dir).select("date", "vix"), 15.0)
    sizes = {m.lower(): q(sl.size_fraction(m)) for m in ("SF", "SK", "SH", "SA", "SC", "SV")}
    return df.select(*K, *[e.alias(m) for m, e in sizes.items()], q(sl.position_weight("confidence")).alias("conf"), q(sl.position_weight("vol_inverse", vix=F.col("vix20"))).alias("inv_vix"),
        q(sl.size_fraction("SK") * sl.vix_scale(F.col("vix"))).alias("sk_vix"), q(sl.budget("option", "SF")).alias("opt_sf"), q(sl.budget("option", "SH")).alias("opt_sh"),
        q(sl.budget("option", "SH", open_share=F.col("ml_score") / 200)).alias("opt_left"), q(sl.budget("spread", "SA")).alias("spread_sa"))


@query(f"SELECT {KS}, {sq('CASE WHEN t <= 0.5 THEN a ELSE a * 0.5 / t END')} AS capped FROM (SELECT *, sum(a) OVER (PARTITION BY date) AS t FROM (SELECT *, greatest(0.5, least(1.5, (win_probability - 0.5) * 4)) * {B} AS a FROM candidates))")
def alloc_cap_daily(spark, sf_dir):
    df = c(spark, sf_dir).withColumn("alloc", sl.size_fraction("SC"))
    return sl.capped_allocation(df, "alloc", F.lit(0.5)).select(*K, q("capped").alias("capped"))


@query(f"SELECT {KS}, coalesce(s.sector, 'Unknown') AS sector FROM candidates c LEFT JOIN sectors s USING (symbol)".replace(f"{KS}", "c.symbol, c.date, c.holding_days, c.direction"))
def join_sector(spark, sf_dir):
    df = c(spark, sf_dir).drop("sector")
    return df.join(F.broadcast(v.sectors(spark, sf_dir)), "symbol", "left").select(*K, F.coalesce("sector", F.lit("Unknown")).alias("sector"))
