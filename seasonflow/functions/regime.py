"""Market regime and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seasonflow.functions.core import prior, ratio

def calendar() -> WindowSpec:
    """The window of one series by date: it runs over a calendar, not over symbols."""
    return Window.partitionBy("_series").orderBy("date")


def one_series(df: DataFrame) -> DataFrame:
    return df.withColumn("_series", F.lit(0))


def lag(c: str, n: int) -> Column:
    return F.lag(c, n).over(calendar())


def mean(c: str, n: int) -> Column:
    w = calendar().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def vix_features(df: DataFrame, n: int = 60) -> DataFrame:
    """vix_pct, the average-tie rank of vix among the last n, vix_change over 5 rows, vix_bucket (right-closed at 15, 20, 25, 30) and vix_term, vix less the latest vix3m."""
    df = one_series(df).withColumn("_past", F.collect_list("vix").over(calendar().rowsBetween(-(n - 1), 0)))
    below = F.size(F.filter("_past", lambda x: x < F.col("vix")))
    same = F.size(F.filter("_past", lambda x: x == F.col("vix")))
    pct = F.when(F.size("_past") == n, (below + (same + 1) / F.lit(2.0)) / F.lit(float(n)))
    bucket = F.when(F.col("vix") <= 15, 0).when(F.col("vix") <= 20, 1).when(F.col("vix") <= 25, 2).when(F.col("vix") <= 30, 3).when(F.col("vix").isNotNull(), 4)
    return df.withColumns({
        "vix_pct": pct, "vix_change": F.col("vix") - lag("vix", 5), "vix_bucket": bucket,
        "vix_term": F.col("vix") - F.last("vix3m", ignorenulls=True).over(calendar())
    }).drop("_past", "_series")


def rate_features(df: DataFrame) -> DataFrame:
    """Spread of the 10-year over the latest 2-year rate and its change over 5 rows; the latest short rate irx and its change over 60."""
    latest = lambda c: F.last(c, ignorenulls=True).over(calendar())
    df = one_series(df).withColumns({"us2y": latest("us2y"), "fed_rate": latest("irx")}).withColumn("spread", F.col("us10y") - F.col("us2y"))
    return df.withColumns({"spread_slope": F.col("spread") - lag("spread", 5), "rate_direction": F.col("fed_rate") - lag("fed_rate", 60)}).drop("_series")


def ratio_change(df: DataFrame, a: str, b: str, n: int = 20) -> DataFrame:
    """ratio a / b and its change over n rows (credit: high-yield over investment-grade)."""
    df = one_series(df).withColumn("ratio", ratio(F.col(a), F.col(b)))
    return df.withColumn("ratio_change", F.col("ratio") - lag("ratio", n)).drop("_series")


def index_trend(df: DataFrame, c: str = "spx", n: int = 20, long: int = 200) -> DataFrame:
    df = one_series(df).withColumn("_m", mean(c, long))
    return df.withColumns({
        "index_roc": ratio(F.col(c), lag(c, n)) - 1,
        "above_mean": F.when(F.col("_m").isNotNull(), F.when(F.col(c) > F.col("_m"), 1.0).otherwise(0.0))
    }).drop("_m", "_series")


def breadth(df: DataFrame, n: int = 10, momentum: int = 20) -> DataFrame:
    df = one_series(df).withColumn("breadth", ratio(mean("advn", n), mean("decn", n)))
    return df.withColumn("breadth_momentum", F.col("breadth") - lag("breadth", momentum)).drop("_series")


def rotation(df: DataFrame, a: str, b: str, n: int = 20) -> DataFrame:
    df = one_series(df)
    return df.withColumn("rotation", (ratio(F.col(a), lag(a, n)) - 1) - (ratio(F.col(b), lag(b, n)) - 1)).drop("_series")


def filled_roc(df: DataFrame, cols: list[str], n: int = 20) -> DataFrame:
    """n-row returns of series that are first carried forward over the calendar's gaps."""
    df = one_series(df).withColumns({c: F.last(c, ignorenulls=True).over(calendar()) for c in cols})
    return df.withColumns({f"{c}_roc": ratio(F.col(c), lag(c, n)) - 1 for c in cols}).drop("_series")


def cycle_year(year: Column) -> Column:
    """1 to 4 in the four-year cycle that began in 2001."""
    return F.pmod(year - 2001, F.lit(4)) + 1


def calendar_features(date: Column) -> dict[str, Column]:
    year = F.year(date)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    third_friday = F.date_add(F.next_day(F.date_sub(F.trunc(date, "month"), 1), "Fri"), 14)
    return {
        "cal_month": F.month(date), "cal_day_of_year": F.dayofyear(date) / F.when(leap, 366.0).otherwise(365.0), "cal_week_of_month": F.floor((F.dayofmonth(date) - 1) / 7).cast("int") + 1, "cal_quarter": F.quarter(date),
        "cal_month_position": F.when(F.dayofmonth(date) <= 10, 0).when(F.dayofmonth(date) <= 20, 1).otherwise(2), "cal_pe_year": cycle_year(year),
        "cal_is_opex_week": F.when(date.between(F.date_sub(third_friday, 4), third_friday), 1).otherwise(0),
    }


def forward_returns(series: DataFrame, c: str, n: int = 15) -> DataFrame:
    """series with fwd, the percent change to the row n further on, and fwd_date, that row's date."""
    df = one_series(series)
    ahead, at = F.lead(c, n).over(calendar()), F.lead("date", n).over(calendar())
    return df.withColumns({"fwd": 100 * ratio(ahead - F.col(c), F.col(c)), "fwd_date": at}).drop("_series")


def seasonal_lookup(series: DataFrame, c: str, n: int = 15, least: int = 5) -> DataFrame:
    """(week, phase, n, win_rate, mean_return) of forward returns by ISO week and cycle phase."""
    f = forward_returns(series, c, n).where("fwd is not null")
    g = f.groupBy(F.weekofyear("date").alias("week"), cycle_year(F.year("date")).alias("phase")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("fwd").alias("mean_return")
    )
    return g.where(F.col("n") >= least)


def seasonal_expanding(series: DataFrame, c: str, n: int = 15, least: int = 5) -> DataFrame:
    """The lookup for every year, from rows whose forward row lies in an earlier year.

    Sums by the year of the forward date, then running sums over earlier years: one pass for all years. Years come from
    the series; a year without new rows for a week and phase repeats the sums of the one before.
    """
    f = forward_returns(series, c, n).where("fwd is not null")
    own = f.groupBy(F.weekofyear("date").alias("week"), cycle_year(F.year("date")).alias("phase"), F.year("fwd_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("fwd") > 0, 1).otherwise(0)).alias("wins"), F.sum("fwd").alias("total")
    )
    years = series.select(F.year("date").alias("year")).distinct()
    spine = own.select("week", "phase").distinct().crossJoin(F.broadcast(years))
    grid = spine.join(own, ["week", "phase", "year"], "left")
    w = prior("week", "phase")
    run = grid.select("week", "phase", "year", F.sum("n").over(w).alias("n"), F.sum("wins").over(w).alias("wins"), F.sum("total").over(w).alias("total"))
    return run.where(F.col("n") >= least).select(
        "week", "phase", "year", "n", (F.col("wins") / F.col("n")).alias("win_rate"), (F.col("total") / F.col("n")).alias("mean_return")
    )


def seasonal_regime(win_rate: Column, direction: Column) -> tuple[Column, Column]:
    """Five buckets from -2 to 2, and whether a direction agrees with the season outside 45-55 percent."""
    regime = F.when(win_rate < 0.4, -2).when(win_rate < 0.5, -1).when(win_rate < 0.6, 0).when(win_rate < 0.7, 1).when(win_rate.isNotNull(), 2)
    sign = F.when(direction == "l", 1).otherwise(-1)
    return regime, F.when(win_rate >= 0.55, sign).when(win_rate <= 0.45, -sign).when(win_rate.isNotNull(), 0)
