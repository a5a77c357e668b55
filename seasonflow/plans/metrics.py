"""Queries of aggregates, calibration, evaluation and strategy statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seasonflow.functions import timeseries as ts
from seasonflow.functions.core import q, ratio, written
from seasonflow.operators import metrics as mt
from seasonflow.operators import selection as sl
from seasonflow.operators import trades as tr
from seasonflow.plans.selection import EXTRA as SELECTION
from seasonflow.plans.selection import WINDOWS
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.plans.timeseries import EXTRA as SERIES
from seasonflow.sources import views as v

QUERIES, ORACLES = {}, {}
K = ["symbol", "date", "holding_days", "direction"]
YEARS = 7.0
WIN = "avg(CASE WHEN actual_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
IN = " OR ".join(f"date BETWEEN '{a}' AND '{b}'" for a, b in WINDOWS)
E = "PARTITION BY strategy_id ORDER BY date"


def bin_sql(source: str, c: str, n: int) -> str:
    grid = "[" + ", ".join(f"{i / n!r}::DOUBLE" for i in range(n + 1)) + "]"
    return f"SELECT *, greatest(len(list_filter(edges, lambda e: e < {c})) - 1, 0)::INT AS bin FROM {source}, (SELECT list_sort(list_distinct(quantile_cont({c}, {grid}))) AS edges FROM {source})"


def rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


CAL = "SELECT bin, min({c}) AS pred_min, max({c}) AS pred_max, avg({c}) AS pred_mean, count(*) AS n_samples, " + WIN + " AS win_prob, avg(CASE WHEN {o} >= {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_hit_pred, avg({o}) AS avg_outcome FROM {s} GROUP BY bin"
EXTRA = {
    **SERIES, **SELECTION,
    "binned": bin_sql("candidates", "predicted_return", 20), "cal": CAL.format(c="predicted_return", o="actual_return", s="binned"),
    "cal4": f"SELECT bin, {sq('pred_min', 4)} AS pred_min, {sq('pred_max', 4)} AS pred_max, {sq('win_prob', 4)} AS win_prob, {sq('p_hit_pred', 4)} AS p_hit_pred FROM cal",
    "calibrated": """SELECT *, least(greatest(CASE WHEN b.pred_max > b.pred_min THEN (predicted_return - b.pred_min) / (b.pred_max - b.pred_min) ELSE 0.5 END, 0), 1) AS inside FROM (
  SELECT *, t[i + 1] AS b, len(t) AS nb FROM (SELECT *, least(len(list_filter(t, lambda x: x.pred_max <= predicted_return)), len(t) - 1)::INT AS i FROM candidates, (SELECT list({'bin': bin, 'pred_min': pred_min, 'pred_max': pred_max, 'win_prob': win_prob, 'p_hit_pred': p_hit_pred} ORDER BY bin) AS t FROM cal4)))""",
    "member": "SELECT *, unnest([{'m': 'a', 'p': predicted_return}, {'m': 'b', 'p': predicted_mfe - 1}, {'m': 'mean', 'p': (predicted_return + (predicted_mfe - 1)) / 2}], recursive := true) FROM candidates",
    "span": "SELECT strategy_id, min(date) AS a, max(date) AS b, arg_min(equity, date) AS first, arg_max(equity, date) AS last FROM equity GROUP BY 1",
    "weekdays": "SELECT strategy_id, d::DATE AS date FROM (SELECT strategy_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM span) WHERE isodow(d) < 6",
    "resampled": "SELECT w.strategy_id, w.date, e.equity FROM weekdays w ASOF LEFT JOIN equity e ON w.strategy_id = e.strategy_id AND w.date >= e.date",
    "drawn": f"SELECT *, max(equity) OVER ({E}) AS peak FROM equity",
    "stats": f"""SELECT s.strategy_id, last / first - 1 AS total_return, pow(last / first, 365.25 / (b - a)) - 1 AS annual_return, monthly_sharpe, daily_sharpe, max_drawdown, years_profitable, worst_year FROM span s
  JOIN (SELECT strategy_id, sqrt(12) * avg(r) / stddev_samp(r) AS monthly_sharpe FROM (SELECT strategy_id, e / lag(e) OVER (PARTITION BY strategy_id ORDER BY m) - 1 AS r FROM (SELECT strategy_id, date_trunc('month', date) AS m, arg_max(equity, date) AS e FROM equity GROUP BY 1, 2)) GROUP BY 1) USING (strategy_id)
  JOIN (SELECT strategy_id, sqrt(252) * avg(r) / stddev_pop(r) AS daily_sharpe FROM (SELECT strategy_id, equity / lag(equity) OVER ({E}) - 1 AS r FROM resampled) GROUP BY 1) USING (strategy_id)
  JOIN (SELECT strategy_id, max((peak - equity) / peak) AS max_drawdown FROM drawn GROUP BY 1) USING (strategy_id)
  JOIN (SELECT strategy_id, count(*) FILTER (r > 0) AS years_profitable, min(r) AS worst_year FROM (SELECT strategy_id, arg_max(equity, date) / arg_min(equity, date) - 1 AS r FROM equity GROUP BY strategy_id, year(date)) GROUP BY 1) USING (strategy_id)""",
    "trade_stats": """SELECT strategy_id, direction, count(*) AS n, avg((exit_return > 0)::INT::DOUBLE) AS win_rate, coalesce(avg(exit_return) FILTER (exit_return > 0), 0) AS avg_win, coalesce(avg(exit_return) FILTER (exit_return <= 0), 0) AS avg_loss,
  coalesce(sum(pnl) FILTER (exit_return > 0), 0) AS gross_profit, coalesce(abs(sum(pnl) FILTER (exit_return <= 0)), 0) AS gross_loss, min(exit_return) AS worst, avg((exit_return <= -1)::INT::DOUBLE) AS total_loss_rate, avg(exit_return) AS ev, avg(days_held) AS avg_days FROM trades GROUP BY 1, 2""",
    "option_stats": """SELECT strategy_id, direction, count(*) AS n, avg((option_return > 0)::INT::DOUBLE) AS win_rate, coalesce(avg(option_return) FILTER (option_return > 0), 0) AS avg_win, coalesce(avg(option_return) FILTER (option_return <= 0), 0) AS avg_loss,
  coalesce(sum(pnl) FILTER (option_return > 0), 0) AS gross_profit, coalesce(abs(sum(pnl) FILTER (option_return <= 0)), 0) AS gross_loss, min(option_return) AS worst, avg((option_return <= -0.9::DOUBLE)::INT::DOUBLE) AS total_loss_rate,
  avg(theta) AS avg_theta, CASE WHEN abs(sum(exit_return)) > 0.001 THEN sum(option_return) / sum(exit_return) ELSE 0 END AS multiplier FROM trades GROUP BY 1, 2""",
    "long_trades": "SELECT * FROM trades WHERE direction = 'l'",
    "book_days": f"SELECT date, count(*) AS n, avg(actual_return - 0.2::DOUBLE) / 100 AS ret FROM capped GROUP BY date",
    "book": "SELECT date, n, ret, 100000 * exp(sum(ln(1 + greatest(ret, -0.9999::DOUBLE))) OVER (ORDER BY date)) AS equity FROM book_days",
}


def query(body: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql(body, EXTRA)
        return f

    return keep


def c(spark, sf_dir):
    return v.candidates(spark, sf_dir)


def rounded(df, exact: list[str], doubles: dict[str, int] | list[str]):
    places = doubles if isinstance(doubles, dict) else dict.fromkeys(doubles, 6)
    return df.select(*exact, *[q(k, p).alias(k) for k, p in places.items()])


def rsql(source: str, exact: list[str], doubles: dict[str, int] | list[str]) -> str:
    places = doubles if isinstance(doubles, dict) else dict.fromkeys(doubles, 6)
    return f"SELECT {', '.join([*exact, *[f'{sq(k, p)} AS {k}' for k, p in places.items()]])} FROM ({source})"


BINS = ["pred_min", "pred_max", "pred_mean", "win_prob", "p_hit_pred", "avg_outcome"]


@query(rsql("SELECT * FROM cal", ["bin", "n_samples"], BINS))
def agg_calibration_bins(spark, sf_dir):
    return rounded(mt.calibration(c(spark, sf_dir), "predicted_return"), ["bin", "n_samples"], BINS)


def bins(spark, sf_dir):
    b = mt.calibration(c(spark, sf_dir), "predicted_return")
    return b.select("bin", *[q(x, 4).alias(x) for x in ("pred_min", "pred_max", "win_prob", "p_hit_pred")])


@query(f"SELECT symbol, date, holding_days, direction, i AS bin, b.win_prob AS cal_win_prob, b.p_hit_pred AS p_hit FROM calibrated")
def join_calibration(spark, sf_dir):
    d = mt.calibrated(c(spark, sf_dir), bins(spark, sf_dir), "predicted_return")
    return d.select(*K, "bin", F.col("win_prob").alias("cal_win_prob"), "p_hit")


@query("SELECT symbol, date, holding_days, direction, floor((i + inside) / nb * 100 * 10 + 0.5 + 1e-6) / 10 AS calibrated_score, b.win_prob AS cal_win_prob, b.p_hit_pred AS p_hit FROM calibrated")
def calibrate(spark, sf_dir):
    d = mt.calibrated(c(spark, sf_dir), bins(spark, sf_dir), "predicted_return")
    return d.select(*K, "calibrated_score", F.col("win_prob").alias("cal_win_prob"), "p_hit")


@query(f"SELECT {sq('avg((predicted_mfe < (SELECT min(pred_min) FROM cal4))::INT::DOUBLE)')} AS below, {sq('avg((predicted_mfe > (SELECT max(pred_max) FROM cal4))::INT::DOUBLE)')} AS above, avg((predicted_mfe < (SELECT min(pred_min) FROM cal4) OR predicted_mfe > (SELECT max(pred_max) FROM cal4))::INT::DOUBLE) > 0.05 AS warn FROM candidates")
def check_calibration_range(spark, sf_dir):
    """Shares of another prediction below and above the range that the bins cover."""
    ends = bins(spark, sf_dir).agg(F.min("pred_min").alias("lo"), F.max("pred_max").alias("hi"))
    d = c(spark, sf_dir).crossJoin(F.broadcast(ends))
    lo, hi = F.col("predicted_mfe") < F.col("lo"), F.col("predicted_mfe") > F.col("hi")
    return d.agg(q(mt.share(lo)).alias("below"), q(mt.share(hi)).alias("above"), (mt.share(lo | hi) > 0.05).alias("warn"))


@query(f"SELECT year, direction, count(*) AS n, {sq('avg(actual_return)')} AS mean, {sq('stddev_samp(actual_return)')} AS std, {sq(WIN)} AS hit_rate FROM candidates GROUP BY 1, 2")
def agg_yearly_label_stats(spark, sf_dir):
    g = c(spark, sf_dir).groupBy("year", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual_return").alias("mean"), F.stddev_samp("actual_return").alias("std"),
        mt.share(F.col("actual_return") > 0).alias("hit_rate")
    )
    return rounded(g, ["year", "direction", "n"], ["mean", "std", "hit_rate"])


OV = ["win_rate", "corr_return", "corr_mfe", "mean", "median", "p05", "p95", "event_rate", "mfe_mean", "mfe_median"]


@query(rsql(f"""SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, min(date) AS date_min, max(date) AS date_max, 100 * {WIN} AS win_rate, corr(predicted_return, actual_return) AS corr_return, corr(predicted_mfe, actual_mfe) AS corr_mfe,
  avg(actual_return) AS mean, quantile_cont(actual_return, 0.5) AS median, quantile_cont(actual_return, 0.05) AS p05, quantile_cont(actual_return, 0.95) AS p95, 100 * avg(has_event::INT::DOUBLE) AS event_rate, avg(actual_mfe) AS mfe_mean, quantile_cont(actual_mfe, 0.5) AS mfe_median
  FROM (SELECT *, EXISTS (SELECT 1 FROM earnings e WHERE e.symbol = c.symbol AND e.date BETWEEN c.date AND c.date + c.holding_days) AS has_event FROM candidates c)""", ["n", "symbols", "date_min", "date_max"], OV))
def agg_overview(spark, sf_dir):
    return rounded(mt.overview(tr.with_event_flag(c(spark, sf_dir), v.earnings(spark, sf_dir))), ["n", "symbols", "date_min", "date_max"], OV)


DIMS = ["direction", "year", "sector", "holding_days"]
BD = ["win_rate", "avg_return", "avg_predicted", "avg_mfe"]


@query(rsql(
    " UNION ALL ".join(f"SELECT '{d}' AS dim, {d}::VARCHAR AS value, count(*) AS trades, 100 * {WIN} AS win_rate, avg(actual_return) AS avg_return, avg(predicted_return) AS avg_predicted, avg(actual_mfe) AS avg_mfe FROM candidates GROUP BY {d}" for d in DIMS),
    ["dim", "value", "trades"], BD
))
def agg_by_dim(spark, sf_dir):
    return rounded(mt.by_dimension(c(spark, sf_dir), DIMS), ["dim", "value", "trades"], BD)


@query(" UNION ALL ".join(f"SELECT '{x}' AS by, bin + 1 AS decile, count(*) AS trades, {sq('100 * ' + WIN)} AS win_rate, {sq('avg(actual_return)')} AS avg_return FROM ({bin_sql('candidates', x, 10)}) GROUP BY bin" for x in ("ml_score", "win_probability")))
def agg_deciles(spark, sf_dir):
    out = None
    for x in ("ml_score", "win_probability"):
        g = mt.with_bin(c(spark, sf_dir), x, 10).groupBy((F.col("bin") + 1).alias("decile")).agg(
            F.count(F.lit(1)).alias("trades"), (100 * mt.share(F.col("actual_return") > 0)).alias("win_rate"),
            F.avg("actual_return").alias("avg_return")
        )
        g = rounded(g.withColumn("by", F.lit(x)), ["by", "decile", "trades"], ["win_rate", "avg_return"])
        out = g if out is None else out.unionByName(g)
    return out


WS = {
    "wr": "true", "wr_long": "direction = 'l'", "wr_short": "direction = 's'", "wr70": "ml_score >= 70", "wr85": "ml_score >= 85",
    "wr85_long": "ml_score >= 85 AND direction = 'l'", "wr85_short": "ml_score >= 85 AND direction = 's'"
}
WA = {f"avg{k}": WS[f"wr{k}"] for k in ("70", "85", "85_long")}
NAMED = {f"w{i}": w for i, w in enumerate(WINDOWS)}
PERIODS = f"SELECT *, CASE WHEN {IN} THEN 'inside' ELSE 'outside' END AS period FROM candidates" + "".join(f" UNION ALL SELECT *, '{k}' AS period FROM candidates WHERE date BETWEEN '{a}' AND '{b}'" for k, (a, b) in NAMED.items())


@query(rsql(f"""SELECT period, count(*) AS n, count(*) FILTER (direction = 'l') AS n_long, count(*) FILTER (direction = 's') AS n_short, {', '.join(f"100 * avg((actual_return > 0)::INT::DOUBLE) FILTER ({x}) AS {k}" for k, x in WS.items())},
  {', '.join(f"avg(actual_return) FILTER ({x}) AS {k}" for k, x in WA.items())}, coalesce(avg(actual_return) FILTER (ml_score >= 70) / nullif(stddev_samp(actual_return) FILTER (ml_score >= 70), 0) * sqrt(252), 0) AS sharpe70 FROM ({PERIODS}) GROUP BY 1""", ["period", "n", "n_long", "n_short"], [*WS, *WA, "sharpe70"]))
def agg_window_stats(spark, sf_dir):
    return rounded(mt.window_statistics(c(spark, sf_dir), NAMED), ["period", "n", "n_long", "n_short"], [*WS, *WA, "sharpe70"])


@query(f"SELECT sector, {sq('i')} AS inside, {sq('o')} AS outside, {sq('i - o')} AS delta FROM (SELECT sector, avg(actual_return) FILTER (w) AS i, avg(actual_return) FILTER (NOT w) AS o FROM (SELECT *, {IN} AS w FROM candidates) GROUP BY 1)")
def agg_sector_in_out(spark, sf_dir):
    w = sl.in_windows(F.col("date"), WINDOWS)
    g = c(spark, sf_dir).groupBy("sector").agg(
        F.avg(F.when(w, F.col("actual_return"))).alias("inside"), F.avg(F.when(~w, F.col("actual_return"))).alias("outside")
    )
    return rounded(g.withColumn("delta", F.col("inside") - F.col("outside")), ["sector"], ["inside", "outside", "delta"])


FLOORS = list(range(50, 100, 5))
GRID = f"SELECT threshold, w AS in_window, count(*) AS n, {WIN} AS win_rate, avg(actual_return) AS avg_return FROM (SELECT *, unnest({FLOORS})::INT AS threshold, {IN} AS w FROM candidates WHERE direction = 'l') WHERE ml_score >= threshold GROUP BY 1, 2"


@query(f"""WITH grid AS ({GRID}), ref AS (SELECT max(win_rate) AS r FROM grid WHERE threshold = 85 AND NOT in_window), eq AS (SELECT min(threshold) FILTER (in_window AND win_rate >= r) AS equivalent FROM grid, ref)
SELECT threshold, in_window, n, {sq('win_rate')} AS win_rate, {sq('avg_return')} AS avg_return, equivalent FROM grid, eq""")
def agg_threshold_grid(spark, sf_dir):
    """Longs over each floor inside and outside the windows, with the lowest floor inside that is as good as 85 outside."""
    g = mt.threshold_grid(c(spark, sf_dir).where("direction = 'l'"), sl.in_windows(F.col("date"), WINDOWS), FLOORS)
    g = g.crossJoin(F.broadcast(mt.equivalent_threshold(g, 85).select("equivalent")))  # one row
    return rounded(g, ["threshold", "in_window", "n", "equivalent"], ["win_rate", "avg_return"])


@query(f"SELECT floor, above, {sq('avg((actual_return > above)::INT::DOUBLE)')} AS pct FROM (SELECT *, unnest([0, 2, 5, 8, 10, 15, 20])::INT AS above FROM (SELECT *, unnest([0, 70, 85])::INT AS floor FROM candidates)) WHERE ml_score >= floor GROUP BY 1, 2")
def agg_return_exceedance(spark, sf_dir):
    d = c(spark, sf_dir).withColumn("floor", F.explode(F.array(*[F.lit(x) for x in (0, 70, 85)]))).where(F.col("ml_score") >= F.col("floor"))
    g = d.groupBy("floor").agg(*[mt.share(F.col("actual_return") > x).alias(str(x)) for x in (0, 2, 5, 8, 10, 15, 20)])
    rows = F.array(*[F.struct(F.lit(x).alias("above"), F.col(f"`{x}`").alias("pct")) for x in (0, 2, 5, 8, 10, 15, 20)])
    return rounded(g.select("floor", F.inline(rows)), ["floor", "above"], ["pct"])


REG = ["rmse", "mae", "r2", "actual_mean", "actual_std", "pred_mean", "pred_std"]
REG_SQL = "count(*) AS n, sqrt(avg(pow({p} - actual_return, 2))) AS rmse, avg(abs({p} - actual_return)) AS mae, 1 - avg(pow({p} - actual_return, 2)) / var_pop(actual_return) AS r2, avg(actual_return) AS actual_mean, stddev_pop(actual_return) AS actual_std, avg({p}) AS pred_mean, stddev_pop({p}) AS pred_std"


@query(rsql(f"SELECT year, {REG_SQL.format(p='predicted_return')} FROM candidates GROUP BY 1", ["year", "n"], REG))
def eval_regression(spark, sf_dir):
    return rounded(mt.regression(c(spark, sf_dir), "predicted_return", "actual_return", ["year"]), ["year", "n"], REG)


BIN = ["accuracy", "precision", "recall", "f1", "base_rate"]


@query(rsql("""SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (SELECT year, count(*) AS n, avg((p = h)::INT::DOUBLE) AS accuracy, coalesce(count(*) FILTER (p AND h) / nullif(count(*) FILTER (p), 0), 0) AS precision,
  coalesce(count(*) FILTER (p AND h) / nullif(count(*) FILTER (h), 0), 0) AS recall, avg(h::INT::DOUBLE) AS base_rate FROM (SELECT year, predicted_return > 0 AS p, actual_return > 0 AS h FROM candidates) GROUP BY 1)""", ["year", "n"], BIN))
def eval_binary(spark, sf_dir):
    return rounded(mt.binary(c(spark, sf_dir), "predicted_return", F.col("actual_return") > 0, ["year"]), ["year", "n"], BIN)


AUC = "(sum(r) FILTER ({h}) - count(*) FILTER ({h}) * (count(*) FILTER ({h}) + 1) / 2) / (count(*) FILTER ({h}) * count(*) FILTER (NOT {h}))"


@query(f"SELECT year, {sq(AUC.format(h='actual_return > 0'))} AS auc, {sq(AUC.format(h='actual_mfe > m'))} AS auc_mfe FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY predicted_return) + (count(*) OVER (PARTITION BY year, predicted_return) - 1) / 2.0::DOUBLE AS r FROM candidates) JOIN (SELECT year, quantile_cont(actual_mfe, 0.5) AS m FROM candidates GROUP BY 1) USING (year) GROUP BY 1")
def eval_auc(spark, sf_dir):
    """Of hits, and of excursions over their year's median."""
    d = mt.above_median(c(spark, sf_dir), "actual_mfe", ["year"])
    high = mt.auc(d, "predicted_return", F.col("is_high"), ["year"]).withColumnRenamed("auc", "auc_mfe")
    return rounded(mt.auc(d, "predicted_return", F.col("actual_return") > 0, ["year"]).join(high, "year"), ["year"], ["auc", "auc_mfe"])


@query(f"SELECT {sq('corr(a, b)')} AS spearman FROM (SELECT {rank_sql('predicted_return')} AS a, {rank_sql('actual_return')} AS b FROM candidates)")
def eval_spearman(spark, sf_dir):
    return rounded(mt.spearman(c(spark, sf_dir), "predicted_return", "actual_return"), [], ["spearman"])


FILTERS = {"all": "true", **{str(f): f"pct >= {f}" for f in (50, 60, 70, 80, 85, 90)}, "positive": "predicted_return > 0"}
LIFTED = " UNION ALL ".join(f"SELECT *, '{k}' AS filter FROM scored WHERE {x}" for k, x in FILTERS.items())
LIFT = f"""WITH scored AS (SELECT *, {rank_sql('ml_score')} / count(*) OVER () * 100 AS pct, count(*) OVER () AS total FROM candidates), f AS ({LIFTED}),
curve AS (SELECT filter, date, symbol, holding_days, direction, sum(ln(1 + greatest(actual_return / 100, -0.9999::DOUBLE))) OVER (PARTITION BY filter ORDER BY date, symbol, holding_days, direction) AS c FROM f),
fall AS (SELECT filter, min(exp(c - p) - 1) * 100 AS max_drawdown FROM (SELECT filter, c, max(c) OVER (PARTITION BY filter ORDER BY date, symbol, holding_days, direction) AS p FROM curve) GROUP BY 1)
SELECT filter, count(*) AS n, {WIN} AS win_rate, avg(actual_return) AS avg_return, quantile_cont(actual_return, 0.5) AS median_return, avg(actual_mfe) AS avg_mfe, quantile_cont(actual_mfe, 0.5) AS median_mfe,
  coalesce(avg(actual_return) / nullif(stddev_samp(actual_return), 0) * sqrt(252), 0) AS sharpe, count(*) / any_value(total) * 100 AS pct_of_trades, any_value(max_drawdown) AS max_drawdown
FROM f JOIN fall USING (filter) GROUP BY 1 HAVING count(*) >= 10"""
LIFT_COLS = ["win_rate", "avg_return", "median_return", "sharpe", "max_drawdown", "pct_of_trades"]
BY_DAY = ["date", "symbol", "holding_days", "direction"]


def lifted(spark, sf_dir):
    return mt.lift(c(spark, sf_dir), "ml_score", F.col("predicted_return") > 0, BY_DAY)


@query(rsql(LIFT, ["filter", "n"], LIFT_COLS))
def eval_topk_lift(spark, sf_dir):
    return rounded(lifted(spark, sf_dir), ["filter", "n"], LIFT_COLS)


@query(rsql(LIFT, ["filter", "n"], ["avg_mfe", "median_mfe", "win_rate", "sharpe"]))
def eval_topk_lift_mfe(spark, sf_dir):
    return rounded(lifted(spark, sf_dir), ["filter", "n"], ["avg_mfe", "median_mfe", "win_rate", "sharpe"])


def members(spark, sf_dir):
    """Candidates with three predictions: two learners' and their mean."""
    d = c(spark, sf_dir).withColumn("a", F.col("predicted_return")).withColumn("b", F.col("predicted_mfe") - 1)
    return ensemble(d, ["a", "b"])


def ensemble(df, cols: list[str], out: str = "mean"):
    return df.withColumn(out, sum((F.col(x) for x in cols[1:]), F.col(cols[0])) / len(cols))


@query(f"SELECT symbol, date, holding_days, direction, {sq('p')} AS mean FROM member WHERE m = 'mean'")
def ensemble_mean(spark, sf_dir):
    return members(spark, sf_dir).select(*K, q("mean").alias("mean"))


def member_rank(x: str) -> str:
    return f"(rank() OVER (PARTITION BY year, m ORDER BY {x}) + (count(*) OVER (PARTITION BY year, m, {x}) - 1) / 2.0::DOUBLE)"


@query(rsql(f"""SELECT year, m AS member, {REG_SQL.format(p='p')}, {AUC.format(h='actual_return > 0')} AS auc, {AUC.format(h='actual_mfe > median')} AS auc_mfe, corr(r, ra) AS spearman
  FROM (SELECT *, {member_rank('p')} AS r, {member_rank('actual_return')} AS ra FROM member) JOIN (SELECT year, quantile_cont(actual_mfe, 0.5) AS median FROM candidates GROUP BY 1) USING (year) GROUP BY 1, 2""", ["year", "member", "n"], [*REG, "auc", "auc_mfe", "spearman"]))
def eval_ensemble_by_member(spark, sf_dir):
    return rounded(by_member(members(spark, sf_dir), ["a", "b", "mean"], "year"), ["year", "member", "n"], [*REG, "auc", "auc_mfe", "spearman"])


def by_member(df, names: list[str], year: str):
    """Regression metrics, both AUCs and the rank correlation of each member's predictions by year.

    All members have the same rows, so the median is taken by year before they are laid out; that table is written once.
    """
    by = [year, "member"]
    d = mt.above_median(df.select(year, "actual_return", "actual_mfe", *names), "actual_mfe", [year])
    d = written(d.unpivot([year, "actual_return", "is_high"], names, "member", "p"), "members")
    areas = mt.aucs(d, "p", {"auc": F.col("actual_return") > 0, "auc_mfe": F.col("is_high")}, by)
    return mt.regression(d, "p", "actual_return", by).join(areas, by).join(mt.spearman(d, "p", "actual_return", by), by)


@query(f"""WITH w AS (SELECT y AS val_year FROM (SELECT unnest(range(1998, 2002))::INT AS y))
SELECT val_year, 'expanding' AS kind, count(*) FILTER (year < val_year) AS n_train, count(*) FILTER (year = val_year) AS n_val FROM candidates, w WHERE year <= val_year GROUP BY 1
UNION ALL SELECT val_year, 'same_phase', count(*) FILTER (year < val_year AND (val_year - year) % 4 = 0), count(*) FILTER (year = val_year) FROM candidates, w WHERE year <= val_year GROUP BY 1""")
def wf_windows(spark, sf_dir):
    from seasonflow.operators.ml import walk_forward_windows

    d = walk_forward_windows(c(spark, sf_dir), [1998, 1999, 2000, 2001])
    return d.groupBy("val_year", "kind").agg(F.count_if(~F.col("is_val")).alias("n_train"), F.count_if(F.col("is_val")).alias("n_val"))


@query("SELECT o.k AS given, 13::INT AS n_features, o.k = 'same' AS ok, count(*) AS n_rows, count(*) FILTER (atr_14d_pct IS NOT NULL AND ml_score IS NOT NULL) AS n_complete FROM candidates, (SELECT unnest(['same', 'reversed']) AS k) o GROUP BY 1")
def feature_contract(spark, sf_dir):
    """Whether the features that a model needs come in the order it was fitted with, as they are and turned round; rows in all and rows without a null."""
    from seasonflow.operators.ml import FEATURES, contract, with_features

    d = with_features(c(spark, sf_dir)).select(*FEATURES)
    rows = d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.greatest(*[F.col(x).isNull() for x in FEATURES]) == F.lit(False)).alias("n_complete"))
    ways = {"same": d, "reversed": d.select(*FEATURES[::-1])}
    one, other = (contract(x, FEATURES).select(F.lit(k).alias("given"), "n_features", "ok") for k, x in ways.items())
    return one.unionByName(other).crossJoin(F.broadcast(rows))  # one row


DD = ["peak", "drawdown"]


@query(f"SELECT strategy_id, date, equity, {sq('peak', 4)} AS peak, {sq('(peak - equity) / peak')} AS drawdown FROM drawn")
def drawdown(spark, sf_dir):
    d = mt.drawdown(v.equity(spark, sf_dir), ["strategy_id"], ["date"], "equity")
    return d.select("strategy_id", "date", "equity", q("peak", 4).alias("peak"), q("drawdown").alias("drawdown"))


@query("SELECT strategy_id, date, equity FROM resampled")
def equity_resample(spark, sf_dir):
    return mt.resampled(v.equity(spark, sf_dir)).select("strategy_id", "date", "equity")


ST = ["total_return", "annual_return", "monthly_sharpe", "daily_sharpe", "max_drawdown", "worst_year"]


@query(rsql("SELECT * FROM stats", ["strategy_id", "years_profitable"], ST))
def equity_stats(spark, sf_dir):
    return rounded(mt.equity_statistics(v.equity(spark, sf_dir)), ["strategy_id", "years_profitable"], ST)


MM = "CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"


@query(f"SELECT strategy_id, {sq('0.40 * years_profitable / 7 + 0.25 * ' + MM.format(c='monthly_sharpe') + ' + 0.20 * (1 - ' + MM.format(c='max_drawdown') + ') + 0.15 * ' + MM.format(c='total_return'))} AS weighted_score FROM stats")
def weighted_score(spark, sf_dir):
    return rounded(mt.weighted_score(mt.equity_statistics(v.equity(spark, sf_dir)), YEARS), ["strategy_id"], ["weighted_score"])


@query(f"SELECT strategy_id, {sq('0.5 * monthly_sharpe + 0.3 * (1 - least(max_drawdown, 1)) + 0.2 * years_profitable / 7')} AS brief_score FROM stats")
def brief_score(spark, sf_dir):
    return rounded(mt.brief_score(mt.equity_statistics(v.equity(spark, sf_dir)), YEARS), ["strategy_id"], ["brief_score"])


TS = {
    "avg_theta": 6, "multiplier": 4, "win_rate": 6, "avg_win": 6, "avg_loss": 6, "gross_profit": 2, "gross_loss": 2, "worst": 6,
    "total_loss_rate": 6, "profit_factor": 6, "per_year": 6
}


@query(" UNION ALL ".join(rsql(
    f"SELECT *, '{kind}' AS kind, gross_profit / nullif(gross_loss, 0) AS profit_factor, n / 7.0::DOUBLE AS per_year{extra} FROM {source}",
    ["kind", "strategy_id", "direction", "n"], TS
) for kind, source, extra in (("stock", "trade_stats", ", NULL::DOUBLE AS avg_theta, NULL::DOUBLE AS multiplier"), ("option", "option_stats", ""))))
def trade_stats(spark, sf_dir):
    """The same trades by stocks and by options."""
    t, by = v.trades(spark, sf_dir), ["strategy_id", "direction"]
    stock = mt.trade_statistics(t, by, YEARS).withColumns({
        "kind": F.lit("stock"), "avg_theta": F.lit(None).cast("double"), "multiplier": F.lit(None).cast("double")
    })
    return rounded(stock.unionByName(mt.option_statistics(t, by, YEARS).withColumn("kind", F.lit("option"))), ["kind", *by, "n"], TS)


EC = {"win_rate": 6, "avg_win": 6, "avg_loss": 6, "per_year": 6, "ev": 6, "dollars": 4, "after_30": 4, "after_50": 4}
DOLLARS = "ev * n * 0.1::DOUBLE * 10000"


@query(rsql(f"""SELECT s.strategy_id, s.direction, d.year, d.n, s.win_rate, s.avg_win, s.avg_loss, s.n / 7.0::DOUBLE AS per_year, d.ev, d.dollars, d.dollars * (1 - 0.3::DOUBLE) AS after_30, d.dollars * (1 - 0.5::DOUBLE) AS after_50 FROM trade_stats s JOIN (
  WITH y AS (SELECT strategy_id, direction, year(entry_date)::INT AS year, count(*) AS n, avg(exit_return) AS ev FROM trades GROUP BY 1, 2, 3)
  SELECT strategy_id, direction, year, n, ev, {DOLLARS} AS dollars FROM y UNION ALL SELECT strategy_id, direction, 0, sum(n)::BIGINT, sum(ev * n) / sum(n), avg({DOLLARS}) FROM y GROUP BY 1, 2) d ON s.strategy_id = d.strategy_id AND s.direction = d.direction""", ["strategy_id", "direction", "year", "n"], EC))
def agg_trade_economics(spark, sf_dir):
    """Dollars by year of a strategy that stakes a tenth of 10000 on each trade, their mean (year 0), and both after haircuts."""
    t, by = v.trades(spark, sf_dir), ["strategy_id", "direction"]
    whole = mt.trade_statistics(t, by, YEARS).select(*by, "win_rate", "avg_win", "avg_loss", "per_year")
    return rounded(mt.yearly_dollars(t, by, 10000.0, 0.1).join(whole, by), [*by, "year", "n"], EC)


@query(f"""WITH m AS (SELECT strategy_id, date_trunc('month', entry_date)::DATE AS month, {sq('sum(exit_return)')} AS s FROM trades GROUP BY 1, 2), w AS (SELECT strategy_id, min(s) AS worst_month, (list(month ORDER BY s, month))[1] AS month FROM m GROUP BY 1)
SELECT strategy_id, {sq('min(exit_return)')} AS worst, {sq('quantile_cont(exit_return, 0.05)')} AS p5, {sq('quantile_cont(exit_return, 0.10)')} AS p10, any_value(worst_month) AS worst_month, any_value(month) AS month FROM trades JOIN w USING (strategy_id) GROUP BY 1""")
def agg_worst_case(spark, sf_dir):
    t = v.trades(spark, sf_dir)
    m = t.groupBy("strategy_id", F.trunc("entry_date", "month").alias("month")).agg(q(F.sum("exit_return")).alias("s"))
    w = m.groupBy("strategy_id").agg(F.min(F.struct("s", "month")).alias("m")).select(
        "strategy_id", F.col("m.s").alias("worst_month"), F.col("m.month").alias("month")
    )
    low = mt.pivoted(mt.quantiles(t, "exit_return", [0.05, 0.10], ["strategy_id"]), {0.05: "p5", 0.10: "p10"}, ["strategy_id"])
    g = t.groupBy("strategy_id").agg(F.min("exit_return").alias("worst")).join(low, "strategy_id")
    return rounded(g.join(w, "strategy_id"), ["strategy_id", "worst_month", "month"], ["worst", "p5", "p10"])


@query(f"SELECT kind, {sq('avg(monthly_sharpe)')} AS sharpe, {sq('avg(max_drawdown)')} AS drawdown, count(*) FILTER (total_return > 0) AS profitable, count(*) FILTER (years_profitable >= 4) AS steady FROM (SELECT *, CASE WHEN strategy_id < 'F' THEN 'stock' ELSE 'spread' END AS kind FROM stats) GROUP BY 1")
def agg_structure_summary(spark, sf_dir):
    s = mt.equity_statistics(v.equity(spark, sf_dir)).withColumn("kind", F.when(F.col("strategy_id") < "F", "stock").otherwise("spread"))
    g = s.groupBy("kind").agg(
        F.avg("monthly_sharpe").alias("sharpe"), F.avg("max_drawdown").alias("drawdown"),
        F.count_if(F.col("total_return") > 0).alias("profitable"), F.count_if(F.col("years_profitable") >= 4).alias("steady")
    )
    return rounded(g, ["kind", "profitable", "steady"], ["sharpe", "drawdown"])


ORDER = ["entry_date", "exit_date", "symbol", "direction", "holding_days"]


@query(f"""WITH t AS (SELECT strategy_id, exit_return <= 0 AS l, row_number() OVER (PARTITION BY strategy_id ORDER BY {', '.join(ORDER)}) - row_number() OVER (PARTITION BY strategy_id, exit_return <= 0 ORDER BY {', '.join(ORDER)}) AS g FROM trades),
r AS (SELECT strategy_id, l, g, count(*) AS n FROM t GROUP BY ALL) SELECT strategy_id, coalesce(max(n) FILTER (l), 0) AS longest, count(*) FILTER (l AND n >= 3) AS n_long FROM r GROUP BY 1""")
def streak_losses(spark, sf_dir):
    return mt.losing_streaks(v.trades(spark, sf_dir), ["strategy_id"], ORDER)


@query(f"SELECT strategy_id, {sq('monthly_sharpe')} AS monthly_sharpe FROM stats ORDER BY monthly_sharpe DESC, strategy_id LIMIT 3")
def topn_strategies(spark, sf_dir):
    s = mt.equity_statistics(v.equity(spark, sf_dir)).orderBy(F.desc("monthly_sharpe"), "strategy_id").limit(3)
    return rounded(s, ["strategy_id"], ["monthly_sharpe"])


@query(f"""WITH s AS (SELECT symbol, {sq('stddev_samp(exit_return)')} AS risk, {sq('avg(exit_return)')} AS reward FROM trades GROUP BY 1)
SELECT symbol, risk, reward FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.risk < s.risk AND o.reward >= s.reward) AND NOT EXISTS (SELECT 1 FROM s o WHERE o.risk = s.risk AND o.reward > s.reward)""")
def pareto_frontier(spark, sf_dir):
    s = v.trades(spark, sf_dir).groupBy("symbol").agg(q(F.stddev_samp("exit_return")).alias("risk"), q(F.avg("exit_return")).alias("reward"))
    return sl.pareto(s, "risk", "reward")


def sample_subset(spark, sf_dir):
    """A seeded tenth of the candidates: the feature is a sample, so no exact counterpart."""
    return c(spark, sf_dir).sample(0.1, 42).select(*K, "ml_score")


QUERIES["sample_subset"] = sample_subset


@query(f"SELECT strategy_id, n, {sq('m / s * sqrt(252 / h)')} AS sharpe FROM (SELECT strategy_id, count(*) AS n, avg(exit_return) AS m, stddev_samp(exit_return) AS s, avg(holding_days) AS h FROM trades GROUP BY 1) WHERE n >= 5")
def holding_adjusted_sharpe(spark, sf_dir):
    g = v.trades(spark, sf_dir).groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n"),
        (ratio(F.avg("exit_return"), F.stddev_samp("exit_return")) * F.sqrt(252 / F.avg("holding_days"))).alias("sharpe")
    )
    return rounded(g.where("n >= 5"), ["strategy_id", "n"], ["sharpe"])


@query(f"SELECT strategy_id, CASE WHEN entry_date < '2000-01-01' THEN 'fit' ELSE 'holdout' END AS period, count(*) AS n, {sq('avg((exit_return > 0)::INT::DOUBLE)')} AS win_rate, {sq('avg(exit_return)')} AS ev FROM trades GROUP BY 1, 2")
def holdout_split(spark, sf_dir):
    t = v.trades(spark, sf_dir).withColumn("period", F.when(F.col("entry_date") < "2000-01-01", "fit").otherwise("holdout"))
    return rounded(mt.trade_statistics(t, ["strategy_id", "period"], YEARS), ["strategy_id", "period", "n"], ["win_rate", "ev"])


@query(f"SELECT floor, least_win, count(*) AS n, {sq(WIN)} AS win_rate, {sq('avg(actual_return)')} AS avg_return FROM candidates, (SELECT unnest([70, 80, 90])::INT AS floor), (SELECT unnest([0.68, 0.74])::DOUBLE AS least_win) WHERE ml_score >= floor AND win_probability >= least_win GROUP BY 1, 2")
def cross_configs(spark, sf_dir):
    """A grid of configurations against all candidates: six rows, broadcast."""
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (70, 80, 90)])).alias("floor")).withColumn("least_win", F.explode(F.array(F.lit(0.68), F.lit(0.74))))
    d = c(spark, sf_dir).crossJoin(F.broadcast(grid)).where((F.col("ml_score") >= F.col("floor")) & (F.col("win_probability") >= F.col("least_win")))
    g = d.groupBy("floor", "least_win").agg(
        F.count(F.lit(1)).alias("n"), mt.share(F.col("actual_return") > 0).alias("win_rate"), F.avg("actual_return").alias("avg_return")
    )
    return rounded(g, ["floor", "least_win", "n"], ["win_rate", "avg_return"])


INSIDE = IN.replace("date", "entry_date")


@query(f"""WITH inside AS (SELECT strategy_id, count(*) AS n_inside, 100 * avg((exit_return > 0)::INT::DOUBLE) AS win_rate, 100 * avg(exit_return) AS avg_return,
  CASE WHEN count(*) >= 5 THEN avg(exit_return) / nullif(stddev_samp(exit_return), 0) * sqrt(252 / greatest(avg(days_held), 1)) END AS sharpe_inside FROM trades WHERE {INSIDE} GROUP BY 1),
meta AS (SELECT strategy_id, sector, count(*) AS n_sector, min(holding_days) AS least_days FROM trades GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY strategy_id ORDER BY sector) = 1)
SELECT strategy_id, n_inside, sector, n_sector, least_days, {sq('win_rate')} AS win_rate, {sq('avg_return')} AS avg_return, {sq('sharpe_inside')} AS sharpe_inside FROM inside LEFT JOIN meta USING (strategy_id)""")
def join_strategy_compare(spark, sf_dir):
    """Strategies inside the windows against what is known of them, of which there are several rows each."""
    t = v.trades(spark, sf_dir)
    meta = t.groupBy("strategy_id", "sector").agg(F.count(F.lit(1)).alias("n_sector"), F.min("holding_days").alias("least_days"))
    g = mt.strategies_compared(t, sl.in_windows(F.col("entry_date"), WINDOWS), meta)
    return rounded(g, ["strategy_id", "n_inside", "sector", "n_sector", "least_days"], ["win_rate", "avg_return", "sharpe_inside"])


@query(f"SELECT c.symbol, c.date, c.holding_days, c.direction, {sq('x.from_high')} AS from_high, {sq('x.rvol')} AS rvol FROM candidates c LEFT JOIN (SELECT symbol, date, (close - h) / nullif(h, 0) AS from_high, rvol FROM (SELECT symbol, date, close, CASE WHEN count(close) OVER a >= 20 THEN max(high) OVER a END AS h, volume / CASE WHEN count(volume) OVER b = 20 THEN nullif(avg(volume) OVER b, 0) END AS rvol FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))) x ON c.symbol = x.symbol AND c.date = x.date")
def join_features_by_date(spark, sf_dir):
    f = ts.with_rvol(ts.with_52w(v.bars(spark, sf_dir))).select("symbol", "date", "from_high", F.col("rvol20").alias("rvol"))
    return rounded(c(spark, sf_dir).join(f, ["symbol", "date"], "left"), K, ["from_high", "rvol"])


@query(f"SELECT year(c.date)::INT AS year, count(*) AS n, {sq('avg((a.atr_pct IS NOT NULL)::INT::DOUBLE)')} AS coverage, {sq('avg(a.atr_pct)')} AS mean_atr FROM candidates c LEFT JOIN atrs a ON c.symbol = a.symbol AND c.date = a.date GROUP BY 1")
def join_atr(spark, sf_dir):
    a = ts.with_atr(v.bars(spark, sf_dir)).select("symbol", "date", "atr_pct")
    g = c(spark, sf_dir).join(a, ["symbol", "date"], "left").groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), mt.share(F.col("atr_pct").isNotNull()).alias("coverage"), F.avg("atr_pct").alias("mean_atr")
    )
    return rounded(g, ["year", "n"], ["coverage", "mean_atr"])


PATTERN = "strftime(date - (holding_days % 3)::INT, '%m-%d')"


@query(f"SELECT symbol, date, holding_days, direction, {PATTERN} AS pattern_md, predicted_return, predicted_mfe, actual_return, count(*) OVER () = (SELECT count(*) FROM candidates) AS all_there FROM candidates WHERE holding_days <> 13 AND NOT (holding_days = 17 AND direction = 's')")
def join_predictions(spark, sf_dir):
    """Labels with two models' predictions by their full key, pattern month-day included, which may lie before the entry; each model lacks some rows."""
    from seasonflow.functions.core import shared_path

    d = c(spark, sf_dir).withColumn("pattern_md", F.date_format(F.expr("date_sub(date, holding_days % 3)"), "MM-dd"))
    key, tables = [*K, "pattern_md"], {"labels": "actual_return", "sr": "predicted_return", "mfe": "predicted_mfe"}
    lacks = {"sr": "holding_days <> 13", "mfe": "not (holding_days = 17 and direction = 's')"}
    paths = {k: shared_path(spark, k) for k in tables}
    for k, column in tables.items():
        d.where(lacks.get(k, "true")).select(*key, column).write.parquet(paths[k])
    labels, sr, mfe = (spark.read.parquet(p) for p in paths.values())
    return mt.joined_predictions(labels, {"sr": sr, "mfe": mfe}, key)


@query("""SELECT c.symbol, c.date, c.holding_days, c.direction, f.etf, i.close AS etf_close FROM candidates c LEFT JOIN (SELECT sector, min(symbol) AS etf FROM sectors GROUP BY 1) f USING (sector) ASOF LEFT JOIN bars i ON i.symbol = f.etf AND c.date >= i.date""")
def join_sector_etf(spark, sf_dir):
    """Candidates with their sector's fund (its first brand) and that fund's latest close up to their date."""
    fund = v.sectors(spark, sf_dir).groupBy("sector").agg(F.min("symbol").alias("etf"))  # a row per sector
    b = v.bars(spark, sf_dir).select(F.col("symbol").alias("etf"), "date", "close")
    d = c(spark, sf_dir).join(F.broadcast(fund), "sector", "left")
    spine = d.select("etf", "date").where("etf is not null").distinct().join(b, ["etf", "date"], "full")
    w = Window.partitionBy("etf").orderBy("date")
    at = spine.select("etf", "date", F.last("close", ignorenulls=True).over(w).alias("etf_close"))
    return d.join(at, ["etf", "date"], "left").select(*K, "etf", "etf_close")


def shown_book(book):
    """The book with its equity as the logarithm of its growth: these outcomes compound to values beyond cents."""
    return rounded(book.withColumn("log_growth", F.log(F.col("equity") / 100000)), ["date", "n"], ["ret", "log_growth", "drawdown"])


@query(f"SELECT date, n, {sq('ret')} AS ret, {sq('ln(equity / 100000)')} AS log_growth, {sq('(max(equity) OVER (ORDER BY date) - equity) / max(equity) OVER (ORDER BY date)')} AS drawdown FROM book")
def daily_book(spark, sf_dir):
    """The best five candidates of each day, two of a sector at most, in equal weights."""
    picks = sl.sector_capped(c(spark, sf_dir), 5, 2, [F.desc("ml_score"), F.col("symbol"), F.col("holding_days"), F.col("direction")])
    return shown_book(mt.daily_book(picks.withColumn("trade_return", F.col("actual_return"))))


@query(f"""WITH net AS (SELECT date, actual_return - 0.2::DOUBLE AS x FROM capped),
peaks AS (SELECT ln(equity / 100000) AS g, max(greatest(equity, 100000)) OVER (ORDER BY date) AS peak, equity, ret FROM book)
SELECT count(*) AS days, (SELECT count(*) FROM net) AS n_trades, {sq('coalesce(sqrt(252) * avg(ret) / nullif(stddev_pop(ret), 0), 0)')} AS sharpe, {sq('max((peak - equity) / peak)')} AS max_drawdown,
  {sq('(SELECT avg((x > 0)::INT::DOUBLE) FROM net)')} AS win_rate, {sq('(SELECT avg(x) FROM net)')} AS avg_trade, {sq('sum(ln(1 + greatest(ret, -0.9999::DOUBLE)))')} AS log_growth,
  {sq('sum(ln(1 + greatest(ret, -0.9999::DOUBLE))) / greatest(count(*) / 252.0::DOUBLE, 0.1::DOUBLE)')} AS annual_growth FROM peaks""")
def daily_book_stats(spark, sf_dir):
    """The statistics of daily_book's book in one row."""
    picks = sl.sector_capped(c(spark, sf_dir), 5, 2, [F.desc("ml_score"), F.col("symbol"), F.col("holding_days"), F.col("direction")])
    g = mt.book_statistics(mt.daily_book(picks.withColumn("trade_return", F.col("actual_return"))))
    return rounded(g, ["days", "n_trades"], ["sharpe", "max_drawdown", "win_rate", "avg_trade", "log_growth", "annual_growth"])


def slice_query(spark, sf_dir):
    """From bars to a book: ATR, earnings filter, composite rank, sector caps, equal weights, compounding."""
    atr = ts.with_atr(v.bars(spark, sf_dir)).select("symbol", "date", "atr_pct")
    d = tr.without_events(c(spark, sf_dir), v.earnings(spark, sf_dir)).join(atr, ["symbol", "date"], "left")
    picks = sl.sector_capped(sl.rank_by(d, "CW"), 5, 2, [F.col("rank")])
    profile = tr.stock_profile("target6_atr2", F.col("actual_return"), F.col("actual_mfe"), F.coalesce("atr_pct", F.lit(0.02)) * 100)
    return shown_book(mt.daily_book(picks.withColumn("trade_return", profile)))


QUERIES["flagship_book"] = slice_query
ORACLES["flagship_book"] = sql(f"""WITH e AS (SELECT c.*, a.atr_pct FROM candidates c LEFT JOIN atrs a ON c.symbol = a.symbol AND c.date = a.date WHERE NOT EXISTS (SELECT 1 FROM earnings x WHERE x.symbol = c.symbol AND x.date BETWEEN c.date AND c.date + c.holding_days)),
g AS (SELECT *, predicted_mfe - predicted_return AS gap FROM e),
t AS (SELECT *, {SELECTION['tied'].split('SELECT *, ')[1].split(' FROM gapped')[0]} FROM g),
s AS (SELECT *, floor((a * 0.6::DOUBLE + b * 0.25::DOUBLE + c * 0.15::DOUBLE) * 1e9 + 0.5::DOUBLE) / 1e9 AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol, holding_days, direction) AS rank FROM s),
p AS (SELECT * FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY rank) <= 2) QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank) <= 5),
d AS (SELECT date, count(*) AS n, avg(CASE WHEN actual_mfe >= 6 THEN 6 ELSE greatest(actual_return, -2 * coalesce(atr_pct, 0.02::DOUBLE) * 100) END - 0.2::DOUBLE) / 100 AS ret FROM p GROUP BY date),
k AS (SELECT date, n, ret, 100000 * exp(sum(ln(1 + greatest(ret, -0.9999::DOUBLE))) OVER (ORDER BY date)) AS equity FROM d)
SELECT date, n, {sq('ret')} AS ret, {sq('ln(equity / 100000)')} AS log_growth, {sq('(max(equity) OVER (ORDER BY date) - equity) / max(equity) OVER (ORDER BY date)')} AS drawdown FROM k""", EXTRA)
