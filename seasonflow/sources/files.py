"""File sources and sinks: bars and opportunity files as CSV, candidate caches as partitioned Parquet, earnings as JSON."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import require_columns, shared_path

BARS = "date date, open double, high double, low double, close double, volume double"
OPPS = "LorS string, date date, daysOut int, sym string, sharpe_ratio double, avg_profit double, avg_profit2 double"
#: Where a symbol is looked for, in this order (fixed values).
MARKETS = ["US", "ETF", "INDX", "COMM"]


def write_bars_csv(bars: DataFrame, path: str) -> None:
    bars.withColumn("file_symbol", F.replace("symbol", F.lit("#"), F.lit("_"))).select(
        "file_symbol", "date", "open", "high", "low", "close", "volume"
    ).write.partitionBy("file_symbol").option("header", True).csv(path)


def scan_bars(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Symbols' CSV files in one scan; bad lines are dropped. Symbols are folders: with a list of them only theirs are read."""
    df = spark.read.schema(f"{BARS}, file_symbol string").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    if symbols is not None:
        df = df.where(F.col("file_symbol").isin([x.replace("#", "_") for x in symbols]))
    df = df.withColumn("symbol", F.replace("file_symbol", F.lit("_"), F.lit("#"))).drop("file_symbol")
    return between_dates(df, first, last).where("date is not null")


def between_dates(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("date") <= F.lit(last).cast("date"))
    return df


def write_bar_table(bars: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """bars as the table `name`, in one file for each bucket of symbols, sorted by symbol and date.

    Reading some symbols opens their buckets only, and what is keyed by the symbol (windows over its days, joins of two
    such tables) needs no shuffle. Tables that are to be joined need the same number of buckets; joins by symbol and more
    need spark.sql.requireAllClusterKeysForCoPartition to be false as well. A bucket holds whole symbols, whose history
    is bounded by the calendar.
    """
    dealt = bars.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "date")
    dealt.option("path", path).saveAsTable(name)


def bar_table(spark: SparkSession, name: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    df = spark.table(name)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    return between_dates(df, first, last)


def first_market(bars: DataFrame, markets: list[str] = MARKETS) -> DataFrame:
    """Of the rows of a (symbol, date) in several markets, the one whose market comes first in the list."""
    rank = F.array_position(F.array(*[F.lit(m) for m in markets]), F.col("market"))
    w = Window.partitionBy("symbol", "date").orderBy("_rank")
    return bars.withColumn("_rank", rank).where(F.col("_rank") > 0).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rank", "_rn")


def write_opps_csv(opps: DataFrame, path: str) -> None:
    out = opps.select(
        "combo", F.col("direction").alias("LorS"), "date", F.col("days_out").alias("daysOut"), F.col("symbol").alias("sym"), "sharpe_ratio",
        "avg_profit", "avg_profit2"
    )
    out.write.partitionBy("combo").option("header", True).option("compression", "gzip").csv(path)


def combo_columns(df: DataFrame) -> DataFrame:
    """year1, year2 and is_pe from a combo such as 10_8 or 6_6_PE2."""
    part = lambda i: F.regexp_extract("combo", r"^(\d+)_(\d+)(_PE2)?$", i)
    return df.withColumns({"year1": part(1).cast("int"), "year2": part(2).cast("int"), "is_pe": part(3) != ""})


def scan_opps(spark: SparkSession, path: str, days: tuple[int, int] = (1, 400)) -> DataFrame:
    """Opportunity files of all combos; avg_profit2 defaults to avg_profit; files without the expected header give no rows."""
    df = spark.read.schema(OPPS).option("header", True).option("enforceSchema", False).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).csv(path)
    df = df.withColumn("combo", F.regexp_extract(F.col("_metadata.file_path"), r"combo=([^/]+)/", 1))
    df = combo_columns(df.where(F.col("daysOut").between(*days)))
    return df.select(
        F.col("sym").alias("symbol"), "date", F.col("daysOut").alias("days_out"), F.col("LorS").alias("direction"), "combo", "year1",
        "year2", "is_pe", "sharpe_ratio", "avg_profit", F.coalesce("avg_profit2", "avg_profit").alias("avg_profit2")
    )


#: Columns of an opportunity file with the types of a cache; the last two are missing in older files, which take the column named.
OPPS_KEPT = {
    "LorS": "string", "date": "date", "daysOut": "smallint", "sym": "string", "combo": "string", "sharpe_ratio": "float", "avg_profit": "float",
    "sharpe_ratio2": "float", "avg_profit2": "float"
}
BACKFILL = {"sharpe_ratio2": "sharpe_ratio", "avg_profit2": "avg_profit"}


def neighbours(target: str, days: tuple[int, ...] = (-14, -7, 0, 7, 14)) -> list[str]:
    """The dates around a target, as text."""
    at = datetime.date.fromisoformat(target)
    return [(at + datetime.timedelta(days=d)).isoformat() for d in days]


def scan_opps_by_date(spark: SparkSession, path: str, dates: list[str]) -> DataFrame:
    """Opportunities of some dates from CSV files (also gzipped) at path/<any folder>/date=<date>/: no other folder is opened.

    Files differ in their header: they are grouped by it, each group is one scan under its own columns, and what older
    files lack is filled in. The headers are read first; they are a line for each file of these dates. combo is a column or
    the first folder's name (combo=...). Ratios and profits come as floats, days as smallint. A file with a header
    that lacks what isn't filled in gives no rows; dates without a file, too.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    # part files only: what a writer leaves beside them is no table
    globs = [f"{path}/*/date={d}/[!_.]*" for d in dates]
    there = [g for g in globs if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(g))]
    kinds = ", ".join(f"{c} {t}" for c, t in OPPS_KEPT.items())
    none = spark.createDataFrame([], kinds)
    out = none
    if there:
        lines = spark.read.text(there).where(F.col("value").startswith("LorS,"))
        heads: dict[str, list[str]] = {}
        for r in lines.select("value", F.col("_metadata.file_path").alias("file")).distinct().collect():
            heads.setdefault(r.value.strip(), []).append(r.file)
        for head, files in sorted(heads.items()):
            names = head.split(",")
            inside = [c for c in OPPS_KEPT if c in names]
            if not {"LorS", "daysOut", "sym", "sharpe_ratio", "avg_profit"} <= set(names):
                continue
            raw = ", ".join(f"`{c}` {OPPS_KEPT.get(c, 'string')}" for c in names)
            df = spark.read.schema(raw).option("header", True).option("mode", "DROPMALFORMED").csv(sorted(files))
            file = F.col("_metadata.file_path")
            own = df.select(*inside, *[
                F.regexp_extract(file, rf"/{c}=([^/]+)/", 1).cast(t).alias(c) for c, t in (("combo", "string"), ("date", "date")) if c not in names
            ])
            own = own.withColumns({c: F.col(c) if c in names else F.col(of) for c, of in BACKFILL.items()})
            own = own.withColumns({c: F.coalesce(c, of) for c, of in BACKFILL.items()})
            out = out.unionByName(own.select(*OPPS_KEPT))
    return out


def write_cache(df: DataFrame, path: str, by: tuple[str, ...] = ("market", "target_date")) -> None:
    """Write the partitions of df that the cache lacks or holds with other rows; the others stay.

    Rows are compared by their number and the sum of their hashes. So what a failed job has left short, or what has
    changed at its source, is written anew, and a job that runs twice changes nothing.
    """
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    df = df.withColumns({c: F.col(c).cast("string") for c in by})
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        kept = spark.read.parquet(path)
        rest = sorted(c for c in df.columns if c not in by)
        # a cache with other columns or types is written anew
        same = {c: t for c, t in kept.dtypes if c in rest} == {c: t for c, t in df.dtypes if c in rest}
        total = F.sum(F.xxhash64(*rest).cast("decimal(20,0)")) if rest else F.lit(0)
        counted = lambda d: d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), total.alias("_h"))
        if same:
            there = counted(kept.select(*rest, *[F.col(c).cast("string").alias(c) for c in by]))
            # written out, as what is read can't be overwritten
            todo = shared_path(spark, "todo")
            counted(df).join(there, [*by, "_n", "_h"], "left_anti").select(*by).write.parquet(todo)
            df = df.join(spark.read.parquet(todo), list(by), "left_semi")
    out = df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "snappy").partitionBy(*by).parquet(path)


def cached_candidates(spark: SparkSession, path: str, target: str, markets: list[str]) -> DataFrame:
    """One date's candidates of several markets: only their partitions are read."""
    df = spark.read.parquet(path)
    return df.where((F.col("target_date") == F.lit(target)) & F.col("market").isin(*markets))


def training_columns(df: DataFrame, needed: list[str], days: str = "days_out") -> DataFrame:
    """The needed columns, which a Parquet scan alone reads; pat_days_out is made from the holding days where it lacks."""
    if "pat_days_out" in needed and "pat_days_out" not in df.columns:
        df = df.withColumn("pat_days_out", F.col(days).cast("double"))
    return require_columns(df, needed).select(*needed)


def earnings_of_json(lines: DataFrame, c: str = "value") -> DataFrame:
    """(symbol, date) from JSON objects {symbol: [dates]}; strings that are no dates are dropped."""
    m = lines.select(F.explode(F.from_json(F.col(c), "map<string, array<string>>")).alias("symbol", "dates"))
    return m.select("symbol", F.explode("dates").alias("d")).select(
        "symbol", F.expr("try_to_date(d, 'yyyy-MM-dd')").alias("date")
    ).where("date is not null").distinct()


def earnings_of_filings(filings: DataFrame, form: str = "8-K/E") -> DataFrame:
    """(symbol, date) of the filings of one form; filings: (symbol, array of (form, date))."""
    return filings.select("symbol", F.inline("filings")).where(F.col("form") == form).select(
        "symbol", F.expr("try_to_date(date, 'yyyy-MM-dd')").alias("date")
    ).where("date is not null").distinct()


def coverage(events: DataFrame) -> DataFrame:
    """(year, n_symbols, n_events, least, mean, most) of events by symbol within each year."""
    one = events.groupBy(F.year("date").alias("year"), "symbol").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("n_events"), F.min("n").alias("least"), F.avg("n").alias("mean"),
        F.max("n").alias("most")
    )


def union_universes(parts: dict[str, DataFrame], tag: str = "tier") -> DataFrame:
    """All parts by column name, with the part's name in a column."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
