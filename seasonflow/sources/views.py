"""Market-like views over the relational tables: bars, index series, earnings, patterns, candidates, equity, trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import q

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: a trade of its part's brand on its ship date."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return rows.select(
        "symbol", F.to_date("l_shipdate").alias("date"), q(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("px"),
        F.col("l_quantity").alias("qty"), *KEY, "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, date, open, high, low, close, volume)."""
    key = F.struct(*KEY)
    return ticks(spark, sf_dir).groupBy("symbol", "date").agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"), F.sum("qty").alias("volume")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector); Brand#25 is left out."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), number.alias("n")).distinct().where("n <> 25")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    return brand.join(F.broadcast(region), F.col("n") % 5 == F.col("r_regionkey")).select("symbol", "sector")


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, spx, vix, vix3m, us10y, us2y, irx, advn, decn) by order date; vix3m, us2y and irx are absent on some dates."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    share = F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1.0)).otherwise(F.lit(0.0)))
    return o.groupBy("date").agg(
        q(F.avg("o_totalprice"), 4).alias("spx"), q(10 + 30 * share, 4).alias("vix"), q(F.avg("o_totalprice") / 1e5).alias("us10y"),
        q(F.avg(F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice"))) / 1e5).alias("us2y"),
        q(
            10 + F.avg(F.when(F.col("o_orderpriority") == "3-MEDIUM", F.col("o_totalprice"))) / 2e4, 4
        ).alias("vix3m"), q(F.avg(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))) / 1e5).alias("irx"),
        F.count_if(F.col("o_orderstatus") == "F").alias("advn"), F.count_if(F.col("o_orderstatus") == "O").alias("decn"),
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 37 == 0)).select("symbol", "date").distinct()


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern rows (symbol, date, days_out, direction, combo, year1, year2, is_pe, sharpe_ratio, avg_profit, sharpe_ratio2, avg_profit2)."""
    t = ticks(spark, sf_dir).where(F.year("date") == 2000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    t = t.where((F.col("l_suppkey") + F.col("k")) % 3 != 0)
    year1 = F.when(F.col("k") == 0, 10).otherwise(5 + (F.col("l_partkey") + 5 * F.col("k")) % 31).cast("int")
    t = t.withColumn("year1", year1).withColumn("is_pe", (F.col("l_linenumber") + F.col("k")) % 7 == 0)
    year2 = F.when(F.col("is_pe"), F.col("year1")).otherwise(F.col("year1") - F.col("l_suppkey") % (F.col("year1") - F.floor(F.col("year1") * 0.8) + 1)).cast("int")
    t = t.withColumn("year2", year2).withColumn("combo", F.concat_ws("_", "year1", "year2", F.when(F.col("is_pe"), "PE2")))
    rows = t.select(
        "symbol", "date", (10 + F.col("l_orderkey") % 21).cast("int").alias("days_out"), F.when(F.col("l_linestatus") == "F", "l").otherwise("s").alias("direction"), "combo", "year1", "year2", "is_pe",
        q(20 * F.col("l_discount") + 5 * F.col("l_tax") + 0.1 * F.col("k"), 4).alias("sharpe_ratio"), q(100 * F.col("l_tax"), 4).alias("avg_profit"),
        F.when(F.col("l_linenumber") != 2, q(25 * F.col("l_tax"), 4)).alias("sharpe_ratio2"), F.when(F.col("l_linenumber") != 1, q(100 * F.col("l_discount"), 4)).alias("avg_profit2"), *KEY,
    )
    own = ["symbol", "date", "days_out", "direction", "combo"]
    best = rows.groupBy(*own).agg(F.max_by(
        F.struct("year1", "year2", "is_pe", "sharpe_ratio", "avg_profit", "sharpe_ratio2", "avg_profit2"), F.struct("sharpe_ratio", *KEY)
    ).alias("b"))
    return best.select(*own, "b.*")


def last_ticks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The last tick by KEY of each (symbol, date, holding_days, direction): these, KEY, l_discount, l_tax and `more` of its columns.

    The greatest struct is found by sorting, so the four columns are one whole number: Spark sorts that by radix, four columns
    by comparing rows. It holds the symbol's number, 28 bits for the day, which are enough for every timestamp, 6 for
    the holding days and 1 for the direction; a null day or key is 0. Symbols are numbered as a calendar is, in one small task.
    """
    symbols = table(spark, sf_dir, "part").select(F.col("p_brand").alias("_s")).distinct()
    symbols = symbols.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_s")).cast("long"))
    epoch, days = F.lit("1970-01-01").cast("date"), (10 + F.col("l_orderkey") % 21).cast("int")
    day = F.coalesce(F.datediff("date", epoch) + 2**27, F.lit(0))
    long = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    group = (((F.col("_n") * 2**28 + day) * 64) + F.coalesce(days + 11, F.lit(0))) * 2 + long
    t = ticks(spark, sf_dir).join(F.broadcast(symbols), F.col("symbol").eqNullSafe(F.col("_s")))
    last = t.groupBy(group.alias("_g")).agg(F.max(F.struct(*KEY, "l_discount", "l_tax", *more)).alias("m")).select("_g", "m.*")
    last = last.withColumns({"_n": F.shiftright("_g", 35), "_day": F.shiftright("_g", 7).bitwiseAND(F.lit(2**28 - 1)).cast("int")})
    last = last.join(F.broadcast(symbols), "_n").withColumn("date", F.when(F.col("_day") > 0, F.date_add(epoch, F.col("_day") - 2**27)))
    direction = F.when(F.col("_g") % 2 == 1, "l").otherwise("s")
    return last.select(F.col("_s").alias("symbol"), "date", days.alias("holding_days"), direction.alias("direction"), *KEY, "l_discount", "l_tax", *more)


def closes(last: DataFrame) -> DataFrame:
    """(symbol, date, close) of bars, from last_ticks with px."""
    return last.groupBy("symbol", "date").agg(F.max_by("px", F.struct(*KEY, "l_discount", "l_tax", "px")).alias("close"))


def candidates(spark: SparkSession, sf_dir: str, last: DataFrame | None = None) -> DataFrame:
    """One candidate per (symbol, date, days_out, direction); returns are in percent. last: last_ticks, where they are there already."""
    b = (last_ticks(spark, sf_dir) if last is None else last).withColumn("year", F.year("date"))
    score = (F.col("l_orderkey") * 7919 % 1001) / F.lit(10.0)
    predicted = q(100 * F.col("l_discount") - 2, 4)
    b = b.withColumn("ml_score", score).withColumn("predicted_return", predicted).withColumn(
        "predicted_mfe", q(F.col("predicted_return") + 50 * F.col("l_tax"), 4)
    )
    b = b.withColumn("actual_return", q(F.col("predicted_return") + ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 2001 - 1000) / F.lit(100.0), 4))
    b = b.join(F.broadcast(sectors(spark, sf_dir)), "symbol", "left")
    return b.select(
        "date", "year", "symbol", F.coalesce("sector", F.lit("Unknown")).alias("sector"), "direction", "holding_days", "ml_score", "predicted_return", "predicted_mfe",
        q(0.5 + F.col("ml_score") / 300, 4).alias("win_probability"), q(0.4 + F.col("l_discount"), 4).alias("p_hit_return"), q(0.35 + F.col("l_tax"), 4).alias("p_hit_mfe"),
        "actual_return", q(F.greatest("actual_return", F.lit(0.0)) + F.col("l_partkey") % 500 / F.lit(100.0), 4).alias("actual_mfe"),
        q(0.5 + F.col("l_partkey") % 100 / F.lit(50.0), 4).alias("stock_volatility_20d"), q(0.01 + F.col("l_suppkey") % 40 / F.lit(1000.0), 4).alias("atr_14d_pct"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy_id, date, pnl, equity) by market segment and order date."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("strategy_id"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("strategy_id", F.to_date("o_orderdate").alias("date")).agg(F.sum((F.col("o_totalprice") - 200000) / 100).alias("pnl"))
    run = F.sum("pnl").over(Window.partitionBy("strategy_id").orderBy("date"))
    return o.select("strategy_id", "date", q("pnl").alias("pnl"), q(100000 + run, 4).alias("equity"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: candidates under one of five strategies, (strategy_id, symbol, ..., exit_return as a share); theta and option_return of the same trade by options."""
    c = candidates(spark, sf_dir)
    number = F.col("holding_days") % 5
    held = (1 + F.col("holding_days") * 5 / 7).cast("int")
    return c.select(
        F.concat(F.lit("S"), number).alias("strategy_id"), "symbol", "sector", "direction", F.col("date").alias("entry_date"), F.date_add("date", F.col("holding_days")).alias("exit_date"), "holding_days", held.alias("days_held"),
        "ml_score", q(0.004 * held).alias("theta"), q(F.greatest(
            F.col("actual_return") / 100 * 12 - 0.004 * held, F.lit(-1.0)
        )).alias("option_return"), q(F.col("actual_return") / 100).alias("exit_return"), q(F.col("actual_mfe") / 100).alias("hwm"), q(F.col("actual_return") * 50, 4).alias("pnl"),
    )
