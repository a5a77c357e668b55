"""Queries over seasonal patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonflow.functions import timeseries as ts
from seasonflow.functions.core import q
from seasonflow.operators import patterns as pt
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.sources import views as v

QUERIES, ORACLES = {}, {}
YEARS = (1995, 2001)
DAYS = list(range(10, 31))
SIGN = "CASE WHEN direction = 'l' THEN 1 ELSE -1 END"
EXTRA = {
    "mds": "SELECT DISTINCT symbol, strftime(date, '%m-%d') AS md, days_out, direction FROM opps",
    "replayed": f"SELECT *, try_cast(year || '-' || md AS DATE) AS base FROM mds, (SELECT unnest(range({YEARS[0]}, {YEARS[1] + 1}))::INT AS year)",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS seen FROM bars",
}


def resolve(source: str) -> str:
    """Entry, exit and signed percent return of the rows of a view with symbol, wanted, days_out, direction."""
    return f"""SELECT *, {SIGN} * 100 * (p_out - p_in) / p_in AS ret FROM (
  SELECT o.*, x.date AS exit, x.close AS p_out FROM (
    SELECT s.*, e.date AS entry, e.close AS p_in, e.seen, (e.date + s.days_out)::DATE AS out_date FROM {source} s ASOF JOIN numbered e ON s.symbol = e.symbol AND s.wanted <= e.date WHERE e.date - s.wanted <= 3) o
  ASOF JOIN bars x ON o.symbol = x.symbol AND o.out_date <= x.date WHERE x.date - o.out_date <= 4) WHERE p_in <> 0"""


def add(name: str, spark_side, body: str, extra: dict | None = None) -> None:
    spark_side.__name__ = name
    QUERIES[name] = spark_side
    ORACLES[name] = sql(body, {**EXTRA, **(extra or {})})


def agg_pattern_depth(spark, sf_dir):
    d = pt.depth_profile(v.opportunities(spark, sf_dir))
    doubles = ["best_winrate", "worst_winrate", "consistency_std", "depth_utilization", "pe_utilization", "recent_vs_deep"]
    whole = ["deepest_pass", "deepest_capped", "pe_deepest", "pe_match", "passes_recent_10", "n_combos", "data_years"]
    return d.select(
        *pt.PATTERN, "best_sharpe", "avg_profit2", "sharpe_at_deepest", "sharpe_at_10", *[F.col(c).cast("double").alias(c) for c in whole],
        *[q(c).alias(c) for c in doubles]
    )


add("agg_pattern_depth", agg_pattern_depth, f"""WITH years AS (SELECT symbol, max(year1) AS data_years FROM opps WHERE NOT is_pe GROUP BY 1),
g AS (SELECT symbol, date, days_out, direction, max(sharpe_ratio) AS best_sharpe, (list(avg_profit2 ORDER BY sharpe_ratio DESC, year1, year2, is_pe))[1] AS avg_profit2,
  coalesce(max(year1) FILTER (NOT is_pe), 0) AS deepest_pass, (list(sharpe_ratio ORDER BY year1 DESC, sharpe_ratio DESC) FILTER (NOT is_pe))[1] AS sharpe_at_deepest,
  max(CASE WHEN NOT is_pe AND year1 = 10 AND year2 = 10 THEN 1 ELSE 0 END) AS passes_recent_10, max(sharpe_ratio) FILTER (NOT is_pe AND year1 = 10 AND year2 = 10) AS sharpe_at_10,
  count(*) AS n_combos, coalesce(max(year1) FILTER (is_pe), 0) AS pe_deepest, max(year2 / year1) AS best_winrate, min(year2 / year1) AS worst_winrate, coalesce(stddev_pop(year2 / year1) FILTER (NOT is_pe), 0) AS sd
  FROM opps GROUP BY 1, 2, 3, 4)
SELECT symbol, date, days_out, direction, best_sharpe, avg_profit2, sharpe_at_deepest, sharpe_at_10, deepest_pass::DOUBLE AS deepest_pass, least(deepest_pass, 30)::DOUBLE AS deepest_capped, pe_deepest::DOUBLE AS pe_deepest,
  (pe_deepest > 0)::INT::DOUBLE AS pe_match, passes_recent_10::DOUBLE AS passes_recent_10, n_combos::DOUBLE AS n_combos, data_years::DOUBLE AS data_years, {sq('best_winrate')} AS best_winrate, {sq('worst_winrate')} AS worst_winrate,
  {sq('sd')} AS consistency_std, {sq('coalesce(deepest_pass / least(data_years, 35), 0)')} AS depth_utilization, {sq('coalesce(pe_deepest / (least(data_years, 35) / 4), 0)')} AS pe_utilization,
  {sq('CASE WHEN sharpe_at_10 <> 0 THEN sharpe_at_10 / nullif(sharpe_at_deepest, 0) END')} AS recent_vs_deep
FROM g LEFT JOIN years USING (symbol)""")


def agg_pattern_extra(spark, sf_dir):
    d = pt.extra_profile(v.opportunities(spark, sf_dir))
    return d.select(*pt.PATTERN, *[q(c).alias(c) for c in ("profit_per_day", "sharpe_per_day", "mfe_ratio")], "days_bucket", "passes_at_max_depth")


add("agg_pattern_extra", agg_pattern_extra, f"""WITH years AS (SELECT symbol, max(year1) AS most FROM opps WHERE NOT is_pe GROUP BY 1),
g AS (SELECT symbol, date, days_out, direction, (list({{'s': sharpe_ratio, 'p': avg_profit, 'p2': coalesce(avg_profit2, avg_profit)}} ORDER BY sharpe_ratio DESC, year1, year2, is_pe))[1] AS b, max(year1) FILTER (NOT is_pe) AS deepest FROM opps GROUP BY 1, 2, 3, 4)
SELECT symbol, date, days_out, direction, {sq('b.p / days_out')} AS profit_per_day, {sq('b.s / sqrt(days_out)')} AS sharpe_per_day, {sq('CASE WHEN b.p = 0 THEN 1 ELSE b.p2 / b.p END')} AS mfe_ratio,
  (CASE WHEN days_out <= 15 THEN 0 WHEN days_out <= 45 THEN 1 WHEN days_out <= 90 THEN 2 ELSE 3 END)::INT AS days_bucket, (CASE WHEN deepest >= most THEN 1 ELSE 0 END)::INT AS passes_at_max_depth
FROM g LEFT JOIN years USING (symbol)""")


def label_replay(spark, sf_dir):
    r = pt.replay(v.opportunities(spark, sf_dir), v.bars(spark, sf_dir), YEARS)
    return r.select("symbol", "md", "days_out", "direction", "year", "entry", "exit", q("ret").alias("ret"), "hit")


add(
    "label_replay", label_replay,
    f"SELECT symbol, md, days_out, direction, year, entry, exit, {sq('ret')} AS ret, (ret > 0)::INT AS hit FROM replayed_out WHERE seen >= 200",
    {"wanted_rows": "SELECT *, base AS wanted FROM replayed WHERE base IS NOT NULL", "replayed_out": resolve("wanted_rows")}
)


def agg_concurrent(spark, sf_dir):
    """Samples with the number of patterns of their symbol that enter on the same day, and of distinct (days_out, direction)."""
    from pyspark.sql import Window

    r = pt.replay(v.opportunities(spark, sf_dir), v.bars(spark, sf_dir), YEARS)
    w = Window.partitionBy("symbol", "entry")
    kinds = F.size(F.collect_set(F.struct("days_out", "direction")).over(w)).cast("long")
    return r.select("symbol", "md", "days_out", "direction", "entry", F.count(F.lit(1)).over(w).alias("concurrent"), kinds.alias("kinds"))


add(
    "agg_concurrent", agg_concurrent,
    "SELECT symbol, md, days_out, direction, entry, count(*) OVER (PARTITION BY symbol, entry) AS concurrent, len(list_distinct(list(days_out || direction) OVER (PARTITION BY symbol, entry)))::BIGINT AS kinds FROM replayed_out WHERE seen >= 200",
    {"wanted_rows": "SELECT *, base AS wanted FROM replayed WHERE base IS NOT NULL", "replayed_out": resolve("wanted_rows")}
)


def sample_rows(spark, sf_dir):
    return v.candidates(spark, sf_dir).select("symbol", "date", F.col("holding_days").alias("days_out"), "direction")


def label_mfe(spark, sf_dir):
    return pt.favourable_excursion(sample_rows(spark, sf_dir), v.bars(spark, sf_dir), DAYS).select(
        "symbol", "date", "days_out", "direction", q("mfe").alias("mfe")
    )


add("label_mfe", label_mfe, f"""SELECT c.symbol, c.date, c.holding_days AS days_out, c.direction, {sq("100 * CASE WHEN c.direction = 'l' THEN (max(x.close) - any_value(b.close)) / any_value(b.close) ELSE (any_value(b.close) - min(x.close)) / any_value(b.close) END")} AS mfe
FROM candidates c JOIN bars b ON c.symbol = b.symbol AND c.date = b.date JOIN bars x ON x.symbol = c.symbol AND x.date > c.date AND x.date <= c.date + c.holding_days + 4 GROUP BY 1, 2, 3, 4""")


def label_backward(spark, sf_dir):
    return pt.backward_label(sample_rows(spark, sf_dir), v.bars(spark, sf_dir)).select("symbol", "date", "days_out", "direction", q("ret").alias("ret"), "hit")


add("label_backward", label_backward, f"""SELECT symbol, date, days_out, direction, {sq('ret')} AS ret, (ret > 0)::INT AS hit FROM (
  SELECT o.symbol, o.date, o.days_out, o.direction, {SIGN} * 100 * (x.close - o.p_in) / o.p_in AS ret FROM (
    SELECT c.symbol, c.date, c.holding_days AS days_out, c.direction, b.close AS p_in, (c.date + c.holding_days)::DATE AS out_date FROM candidates c ASOF JOIN bars b ON c.symbol = b.symbol AND c.date >= b.date WHERE c.date - b.date <= 5) o
  ASOF JOIN bars x ON o.symbol = x.symbol AND o.out_date >= x.date WHERE o.out_date - x.date <= 5)""")


def pat_neighborhood(spark, sf_dir):
    n = pt.neighbourhood(v.opportunities(spark, sf_dir), v.bars(spark, sf_dir), YEARS)
    return n.select("symbol", "md", "days_out", "direction", "year", *[q(c).alias(c) for c in ("neighbour_wr", "sharpness", "pre_slope", "post_cliff")])


add("pat_neighborhood", pat_neighborhood, f"""WITH rates AS (SELECT g.symbol, g.md, g.days_out, g.direction, g.shift, g.year, avg(win) OVER (PARTITION BY g.symbol, g.md, g.days_out, g.direction, g.shift ORDER BY g.year RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING) AS wr
  FROM shifted g LEFT JOIN (SELECT *, CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS win FROM shifted_out) w USING (symbol, md, days_out, direction, shift, year)),
p AS (SELECT symbol, md, days_out, direction, year, max(wr) FILTER (shift = -14) AS a, max(wr) FILTER (shift = -7) AS b, max(wr) FILTER (shift = 0) AS o, max(wr) FILTER (shift = 7) AS c, max(wr) FILTER (shift = 14) AS d FROM rates GROUP BY ALL)
SELECT symbol, md, days_out, direction, year, {sq('list_avg([a, b, c, d])')} AS neighbour_wr, {sq('o / nullif(list_avg([a, b, c, d]), 0)')} AS sharpness, {sq('b - a')} AS pre_slope, {sq('o - list_avg([c, d])')} AS post_cliff FROM p""",
    {"shifted": "SELECT *, (base + shift)::DATE AS wanted FROM replayed, (SELECT unnest([-14, -7, 0, 7, 14])::INT AS shift) WHERE base IS NOT NULL", "shifted_out": resolve("shifted")})


def pat_hit_last_year(spark, sf_dir):
    return pt.hit_last_year(sample_rows(spark, sf_dir), v.bars(spark, sf_dir)).withColumn("hit_last_year", F.col("hit_last_year").cast("double"))


add("pat_hit_last_year", pat_hit_last_year, "SELECT c.symbol, c.date, c.holding_days AS days_out, c.direction, (r.ret > 0)::INT::DOUBLE AS hit_last_year FROM candidates c LEFT JOIN last_out r ON c.symbol = r.symbol AND c.date = r.date AND c.holding_days = r.days_out AND c.direction = r.direction",
    {"last_rows": "SELECT * FROM (SELECT symbol, date, holding_days AS days_out, direction, try_cast((year(date) - 1) || strftime(date, '-%m-%d') AS DATE) AS wanted FROM candidates) WHERE wanted IS NOT NULL", "last_out": resolve("last_rows").replace("SELECT s.*, e.date AS entry", "SELECT s.symbol, s.date, s.days_out, s.direction, e.date AS entry")})


def pat_interactions(spark, sf_dir):
    """Pattern profiles with the market (Brand#1), the sector (Brand#2) and VIX as of their date."""
    p = pt.depth_profile(v.opportunities(spark, sf_dir)).select(*pt.PATTERN, "best_sharpe", "deepest_pass")
    b = ts.with_sma(v.bars(spark, sf_dir), (200,))
    days = p.select("date").distinct()
    out = p
    for name, brand in (("spy", "Brand#1"), ("etf", "Brand#2")):
        s = b.where(F.col("symbol") == brand).select("date", F.struct(F.col("close"), F.col("sma200")).alias("x"))
        at = ts.asof_ffill(days, s, "x").select("date", F.col("x.close").alias(name), F.col("x.sma200").alias(f"{name}_sma200"))
        out = out.join(at, "date", "left")
    out = out.join(ts.asof_ffill(days, v.index_series(spark, sf_dir).select("date", "vix"), "vix").select("date", "vix"), "date", "left")
    r = pt.interactions(out)
    return r.select(
        *pt.PATTERN, F.col("dir_x_market").cast("double").alias("dir_x_market"), F.col("dir_x_sector").cast("double").alias("dir_x_sector"),
        q("depth_x_vix").alias("depth_x_vix"), q("quality_x_regime").alias("quality_x_regime")
    )


add("pat_interactions", pat_interactions, f"""WITH p AS (SELECT symbol, date, days_out, direction, max(sharpe_ratio) AS best_sharpe, coalesce(max(year1) FILTER (NOT is_pe), 0) AS deepest_pass FROM opps GROUP BY 1, 2, 3, 4),
s AS (SELECT symbol, date, close, CASE WHEN count(close) OVER w = 200 THEN avg(close) OVER w END AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
SELECT p.symbol, p.date, p.days_out, p.direction, (CASE WHEN p.direction = 'l' THEN 1 ELSE -1 END * CASE WHEN a.m IS NULL THEN NULL WHEN a.close > a.m THEN 1 ELSE -1 END)::DOUBLE AS dir_x_market,
  (CASE WHEN p.direction = 'l' THEN 1 ELSE -1 END * CASE WHEN e.m IS NULL THEN NULL WHEN e.close > e.m THEN 1 ELSE -1 END)::DOUBLE AS dir_x_sector, {sq('p.deepest_pass / nullif(i.vix, 0)')} AS depth_x_vix,
  {sq('p.best_sharpe * CASE WHEN a.m IS NULL THEN NULL WHEN a.close > a.m THEN 1 ELSE 0 END')} AS quality_x_regime
FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE symbol = 'Brand#1') a ON p.date >= a.date ASOF LEFT JOIN (SELECT * FROM s WHERE symbol = 'Brand#2') e ON p.date >= e.date ASOF LEFT JOIN index_series i ON p.date >= i.date""")
