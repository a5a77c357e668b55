"""Column and window helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def q(c: Column | str, places: int = 6) -> Column:
    """A double rounded half up at a fixed number of places, the same in every engine (round() differs on ties)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**places)
    return F.floor(c.cast("double") * scale + 0.5 + 1e-6) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def rolling(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def full_mean(c: Column | str, n: int) -> Column:
    """Mean of the last n rows of a symbol, null until there are n values."""
    w = rolling(n)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


#: Rows after which an exponential mean of a span has forgotten its seed to 1e-15 (fixed values).
EMA_ROWS = {5: 86, 9: 155, 12: 207, 26: 449}
#: Rows of a block of an exponential mean: more than any horizon above.
EMA_BLOCK = 512


def with_emas(df: DataFrame, spans: dict[str, int], c: str) -> DataFrame:
    """df with a recursive mean of c for each name: weight 2 / (span + 1), seeded by the first value; nulls are passed over.

    Within a block of a symbol's values the mean is a running sum of c / (1 - a)^k, scaled back by (1 - a)^k; from the
    block before only its last mean counts, as a block is longer than what a mean remembers. So all spans take a few
    running sums over one sort by symbol, and no row carries its past.
    """
    block = Window.partitionBy("symbol", "_block").orderBy("date")
    i = F.count(c).over(by_symbol()) - 1
    df = df.withColumn("_i", i).withColumn("_block", F.floor(F.greatest("_i", F.lit(0)) / EMA_BLOCK)).withColumn("_k", F.pmod("_i", F.lit(EMA_BLOCK)))
    own, means = {}, {}
    for name, span in spans.items():
        a = 2.0 / (span + 1)
        term = F.when(F.col("_i") == 0, F.col(c) / a).otherwise(F.col(c)) * F.pow(F.lit(1 / (1 - a)), F.col("_k"))
        own[f"_own_{name}"] = a * F.pow(F.lit(1 - a), F.col("_k")) * F.sum(term).over(block)
        carried = F.coalesce(F.first(f"_before_{name}").over(block), F.lit(0.0))
        means[name] = F.when(F.col("_i") >= 0, F.col(f"_own_{name}") + carried * F.pow(F.lit(1 - a), F.col("_k") + 1))
    df = df.withColumns(own).withColumns({f"_before_{name}": F.lag(f"_own_{name}").over(by_symbol()) for name in spans})
    return df.withColumns(means).drop("_i", "_block", "_k", *own, *[f"_before_{name}" for name in spans])


def avg_tie_rank(by: list[str], c: str, ascending: bool = True) -> Column:
    """Average rank of ties, divided by the number of rows: 1/n for the first of n distinct values, 1 for the last."""
    order = F.col(c).asc() if ascending else F.col(c).desc()
    whole = Window.partitionBy(*by)
    peers = Window.partitionBy(*by, c)
    return (F.rank().over(whole.orderBy(order)) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(whole)


def prior(*by: str, order: str = "year") -> WindowSpec:
    """All rows of strictly earlier years."""
    return Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)


def day_number(c: Column | str) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: under spark.checkpoint.dir, or in local mode a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str, by: list[str] | tuple = ()) -> DataFrame:
    """df written to the shared folder, with a folder for each value of `by`, and read back: it is computed once, and what follows starts from files that survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """df itself, or an error that names the columns it lacks."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df
