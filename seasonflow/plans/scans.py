"""Queries over sources and sinks: tables are written out in the form that is to be read, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonflow.functions.core import q, shared_path
from seasonflow.plans.sqlviews import q as sq
from seasonflow.plans.sqlviews import sql
from seasonflow.sources import files as fl
from seasonflow.sources import views as v
from seasonflow.sources.results import publish, published

QUERIES, ORACLES = {}, {}
TARGET = "2000-06-15"


def query(body: str, extra: dict | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql(body, extra)
        return f

    return keep


@query("SELECT symbol, date, open, high, low, close, volume FROM bars WHERE date BETWEEN '1996-01-01' AND '2000-12-31'")
def scan_bars(spark, sf_dir):
    """CSV files by symbol, read into a table bucketed by symbol, of which a range of dates is read."""
    path, table = shared_path(spark, "bars"), shared_path(spark, "bar_table")
    fl.write_bars_csv(v.bars(spark, sf_dir), path)
    name = table.rsplit("/", 1)[1].replace("-", "_")
    fl.write_bar_table(fl.scan_bars(spark, path), name, table, 8)
    return fl.bar_table(spark, name, first="1996-01-01", last="2000-12-31").select("symbol", "date", "open", "high", "low", "close", "volume")


MARKET = "CASE l_linenumber % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'ETF' WHEN 2 THEN 'INDX' ELSE 'COMM' END"


@query(f"""SELECT symbol, date, market, close FROM (SELECT symbol, date, {MARKET} AS market, max(px) AS close FROM ticks GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY list_position(['US', 'ETF', 'INDX', 'COMM'], market)) = 1""")
def scan_market_fallback(spark, sf_dir):
    rows = v.ticks(spark, sf_dir).groupBy("symbol", "date", F.expr(MARKET).alias("market")).agg(F.max("px").alias("close"))
    return fl.first_market(rows).select("symbol", "date", "market", "close")


@query("SELECT symbol, date, days_out, direction, combo, year1, year2, is_pe, sharpe_ratio, avg_profit, coalesce(avg_profit2, avg_profit) AS avg_profit2 FROM opps WHERE days_out BETWEEN 10 AND 25")
def scan_opps(spark, sf_dir):
    path = shared_path(spark, "opps")
    fl.write_opps_csv(v.opportunities(spark, sf_dir), path)
    return fl.scan_opps(spark, path, (10, 25))


OLD = {"oldest": ["sharpe_ratio2", "avg_profit2"], "older": ["sharpe_ratio2"], "newest": []}
AGE = "CASE WHEN year1 > 25 THEN 'oldest' WHEN year1 > 15 THEN 'older' ELSE 'newest' END"


@query(f"""SELECT symbol, date, days_out, direction, combo, {sq('sharpe_ratio', 3)} AS sharpe_ratio, {sq('avg_profit', 3)} AS avg_profit,
  {sq("CASE WHEN age IN ('oldest', 'older') THEN sharpe_ratio ELSE coalesce(sharpe_ratio2, sharpe_ratio) END", 3)} AS sharpe_ratio2, {sq("CASE WHEN age = 'oldest' THEN avg_profit ELSE coalesce(avg_profit2, avg_profit) END", 3)} AS avg_profit2
FROM (SELECT *, {AGE} AS age FROM opps) WHERE date IN (SELECT (DATE '{TARGET}' + d)::DATE FROM (SELECT unnest([-14, -7, 0, 7, 14])::INT AS d))""")
def scan_opps_by_date(spark, sf_dir):
    """Files of three ages, which lack different columns, by date; five dates' files are read."""
    path = shared_path(spark, "opps")
    o = v.opportunities(spark, sf_dir).withColumn("age", F.expr(AGE))
    o = o.select("age", F.col("direction").alias("LorS"), "date", F.col("days_out").alias("daysOut"), F.col("symbol").alias("sym"), "combo", "sharpe_ratio", "avg_profit", "sharpe_ratio2", "avg_profit2")
    for age, lacks in OLD.items():
        own = o.where(F.col("age") == age).drop("age", *lacks).repartition("date")
        own.write.partitionBy("date").option("header", True).option("compression", "gzip").csv(f"{path}/age={age}")
    df = fl.scan_opps_by_date(spark, path, fl.neighbours(TARGET))
    return df.select(
        F.col("sym").alias("symbol"), "date", F.col("daysOut").cast("int").alias("days_out"), F.col("LorS").alias("direction"), "combo",
        *[q(x, 3).alias(x) for x in ("sharpe_ratio", "avg_profit", "sharpe_ratio2", "avg_profit2")]
    )


CACHE = "SELECT symbol, days_out, direction, combo, sharpe_ratio, CASE WHEN symbol < 'Brand#2' THEN 'US' ELSE 'ETF' END AS market, date::VARCHAR AS target_date FROM opps"


def cache(spark, sf_dir):
    """All opportunities in a cache, written in two goes of which the second brings the first one's dates again."""
    path = shared_path(spark, "cache")
    o = v.opportunities(spark, sf_dir).select(
        "symbol", "days_out", "direction", "combo", "sharpe_ratio",
        F.when(F.col("symbol") < "Brand#2", "US").otherwise("ETF").alias("market"), F.col("date").cast("string").alias("target_date")
    )
    fl.write_cache(o.where(F.col("target_date") < "2000-06-16"), path)
    fl.write_cache(o, path)
    return path


@query(CACHE)
def sink_cache(spark, sf_dir):
    df = spark.read.parquet(cache(spark, sf_dir))
    return df.withColumn("target_date", F.col("target_date").cast("string")).select(
        "symbol", "days_out", "direction", "combo", "sharpe_ratio", "market", "target_date"
    )


@query("SELECT symbol, days_out, direction, combo, sharpe_ratio, market FROM c WHERE target_date = '2000-06-15'", {"c": CACHE})
def scan_cached_candidates(spark, sf_dir):
    df = fl.cached_candidates(spark, cache(spark, sf_dir), TARGET, ["US", "ETF"])
    return df.select("symbol", "days_out", "direction", "combo", "sharpe_ratio", "market")


@query("SELECT symbol, date, ml_score, actual_return, holding_days::DOUBLE AS pat_days_out FROM candidates")
def scan_training_pruned(spark, sf_dir):
    path = shared_path(spark, "training")
    v.candidates(spark, sf_dir).write.parquet(path)
    return fl.training_columns(spark.read.parquet(path), ["symbol", "date", "ml_score", "actual_return", "pat_days_out"], "holding_days")


@query("SELECT symbol, date FROM earnings")
def scan_earnings_json(spark, sf_dir):
    """Earnings as JSON lines {symbol: [dates]}, each with one string that is no date."""
    e = v.earnings(spark, sf_dir).groupBy("symbol").agg(F.collect_list(F.col("date").cast("string")).alias("d"))
    lines = e.select(F.to_json(F.create_map("symbol", F.array_append("d", F.lit("n/a")))).alias("value"))
    path = shared_path(spark, "earnings")
    lines.write.text(path)
    return fl.earnings_of_json(spark.read.text(path))


FORM = "CASE l_linenumber % 3 WHEN 0 THEN '8-K/E' WHEN 1 THEN '8-K' ELSE '10-Q' END"


@query(f"""WITH e AS (SELECT DISTINCT symbol, date FROM ticks WHERE {FORM} = '8-K/E'), o AS (SELECT year(date)::INT AS year, symbol, count(*) AS n FROM e GROUP BY 1, 2)
SELECT year, count(*) AS n_symbols, sum(n)::BIGINT AS n_events, min(n) AS least, {sq('avg(n)')} AS mean, max(n) AS most FROM o GROUP BY 1""")
def earnings_from_filings(spark, sf_dir):
    f = v.ticks(spark, sf_dir).groupBy("symbol").agg(F.collect_list(F.struct(
        F.expr(FORM).alias("form"), F.col("date").cast("string").alias("date")
    )).alias("filings"))
    return fl.coverage(fl.earnings_of_filings(f)).withColumn("mean", q("mean"))


@query(f"""SELECT t.strategy_id, symbol, entry_date, exit_date, exit_return, pnl, n, {sq('ev')} AS ev, (SELECT count(*) FROM equity) AS n_equity
FROM trades t JOIN (SELECT strategy_id, count(*) AS n, avg(exit_return) AS ev FROM trades GROUP BY 1) USING (strategy_id)""")
def sink_results(spark, sf_dir):
    """Trades as CSV, their summary as JSON and the equity as Parquet, published together and read back through the manifest."""
    t = v.trades(spark, sf_dir).select("strategy_id", "symbol", "entry_date", "exit_date", "exit_return", "pnl")
    summary = t.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"), q(F.avg("exit_return")).alias("ev"))
    path = shared_path(spark, "results")
    publish(spark, path, "run-1", {"trades": (t, "csv"), "summary": (summary, "json"), "equity": (v.equity(spark, sf_dir), "parquet")})
    n = published(spark, path, "equity").agg(F.count(F.lit(1)).alias("n_equity"))
    return published(spark, path, "trades").join(published(spark, path, "summary"), "strategy_id").crossJoin(F.broadcast(n))  # one row


@query("""SELECT symbol, date, ml_score, 'short' AS tier FROM candidates WHERE holding_days <= 15 UNION ALL SELECT symbol, date, ml_score, 'long' FROM candidates WHERE holding_days > 15""")
def union_universes(spark, sf_dir):
    c = v.candidates(spark, sf_dir).select("symbol", "date", "ml_score", "holding_days")
    return fl.union_universes({"short": c.where("holding_days <= 15"), "long": c.where("holding_days > 15")}).drop("holding_days")


FRAME = ["atr_14d_pct", "ml_score", "holding_days", "predicted_return", "sector", "p_hit_mfe"]
EXPECTED = ["holding_days", "ml_score", "predicted_return", "win_probability", "atr_14d_pct"]


@query(f"""WITH wanted AS (SELECT unnest({EXPECTED}) AS name, unnest(range({len(EXPECTED)}))::INT AS expected_at), frame AS (SELECT unnest({FRAME}) AS name, unnest(range({len(FRAME)}))::INT AS found_at),
shared AS (SELECT name, row_number() OVER (ORDER BY expected_at) AS a, row_number() OVER (ORDER BY found_at) AS b FROM wanted JOIN frame USING (name)),
filled(name, n_filled) AS (SELECT unnest({FRAME}), unnest([{', '.join(f'count({c})' for c in FRAME)}]) FROM candidates)
SELECT CASE WHEN found_at IS NULL THEN 'missing' WHEN expected_at IS NULL THEN 'extra' WHEN a <> b THEN 'moved' ELSE 'same' END AS kind, name, coalesce(expected_at, -1) AS expected_at, coalesce(found_at, -1) AS found_at, coalesce(n_filled, 0) AS n_filled
FROM wanted FULL JOIN frame USING (name) LEFT JOIN shared USING (name) LEFT JOIN filled USING (name)""")
def feature_diff(spark, sf_dir):
    """The features of a model read from disk against a frame's columns: missing, extra, moved and same ones (-1: no place), with the frame's filled rows."""
    from pyspark.ml import PipelineModel

    from seasonflow.operators import ml

    c, path = v.candidates(spark, sf_dir), shared_path(spark, "model")
    ml.fit_regressor(c, "actual_return", EXPECTED, rounds=1, depth=2).write().save(path)
    diff = ml.feature_differences(spark, ml.model_features(PipelineModel.load(path)), FRAME)
    filled = c.agg(*[F.count(x).alias(x) for x in FRAME]).unpivot([], FRAME, "name", "n_filled")
    both = diff.join(F.broadcast(filled), "name", "left")  # a row for each feature
    return both.select("kind", "name", *[F.coalesce(x, F.lit(-1)).alias(x) for x in ("expected_at", "found_at")], F.coalesce("n_filled", F.lit(0)).alias("n_filled"))
