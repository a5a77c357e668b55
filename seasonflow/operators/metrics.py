"""Aggregates and metrics: overviews, calibration, evaluation, equity and strategy statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonflow.functions.core import ratio, written
from seasonflow.operators.prefix import prefix_scan


def share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def safe_log1p(r: Column) -> Column:
    """log(1 + r) with r kept above -0.9999: a short's loss can pass 100 %."""
    return F.log1p(F.greatest(r, F.lit(-0.9999)))


def ranked_counts(df: DataFrame, c: str, by: list[str], parts: int = 64, rows: str | None = None) -> DataFrame:
    """(by, c, n, before, total): each distinct value with its rows, the rows below it, and all rows of its group.

    Values are counted first; the counts are cut into `parts` ranges of about as many values each, at approximate
    percentiles of a group's values, so that no task sees all of a group however its values are spread. A range's offset
    is the total of the ranges before it, from a table of `parts` rows for each group. With rows, a column of whole
    numbers, each row of df stands for so many.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))
    grid = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = counts.groupBy(*by).agg(F.percentile_approx(c, grid, 20 * parts).alias("_cuts"), F.sum("n").alias("total"))
    with_cuts = counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))  # one row
    dealt = with_cuts.withColumn("_part", F.size(F.filter("_cuts", lambda x: x < F.col(c)))).drop("_cuts")
    inner = dealt.withColumn("_b", F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(c)) - F.col("n"))
    totals = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("_t"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(*by, "_part", (F.sum("_t").over(group.orderBy("_part")) - F.col("_t")).alias("_o"))
    return inner.join(offsets, [*by, "_part"]).select(*by, c, "n", (F.col("_o") + F.col("_b")).alias("before"), "total")


def quantiles(df: DataFrame, c: str, probs: list[float], by: list[str] = (), rows: str | None = None) -> DataFrame:
    """(by, p, value): exact quantiles with linear interpolation, from ranked counts; rows as there."""
    return picked(ranked_counts(df, c, list(by), rows=rows), c, probs, by)


def picked(r: DataFrame, c: str, probs: list[float], by: list[str] = ()) -> DataFrame:
    """(by, p, value): quantiles with linear interpolation from distinct values with n, before and total as ranked_counts gives them."""
    by = list(by)
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), ((F.col("total") - 1) * F.lit(float(p))).alias("at")) for p in probs])
    last = F.col("before") + F.col("n") - 1
    near = F.filter(wanted, lambda x: (F.floor(x["at"]) <= last) & (F.floor(x["at"]) + 1 >= F.col("before")))
    hit = r.select(*by, c, "before", last.alias("last"), F.inline(near)).withColumn("k", F.floor("at"))
    own = lambda k: F.max(F.when((k >= F.col("before")) & (k <= F.col("last")), F.col(c)))
    v = hit.groupBy(*by, "p").agg(own(F.col("k")).alias("a"), own(F.col("k") + 1).alias("b"), F.max(F.col("at") - F.col("k")).alias("f"))
    return v.select(*by, "p", (F.col("a") + F.when(F.col("f") > 0, (F.coalesce("b", "a") - F.col("a")) * F.col("f")).otherwise(0.0)).alias("value"))


def pivoted(q: DataFrame, names: dict[float, str], by: list[str] = ()) -> DataFrame:
    """One row per group with a column for each quantile."""
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(n) for p, n in names.items()])


def quantile_edges(df: DataFrame, c: str, n: int) -> DataFrame:
    """One row with the distinct edges of n equal-frequency bins; two neighbours of a tie fall together."""
    return quantiles(df, c, [i / n for i in range(n + 1)]).agg(F.array_sort(F.collect_set("value")).alias("edges"))


def with_bin(df: DataFrame, c: str, n: int, out: str = "bin", edges: DataFrame | None = None) -> DataFrame:
    """df with the number of its equal-frequency bin, from 0; bins are closed on the right, the first one on both sides.

    The edges are one row of at most n + 1 numbers: exact ones, or those given, such as sketches'.
    """
    return df.crossJoin(F.broadcast(edges or quantile_edges(df, c, n))).withColumn(out, bin_of(F.col(c))).drop("edges")


def bin_of(c: Column) -> Column:
    """The bin of a value among sorted edges in the column edges."""
    return F.greatest(F.size(F.filter("edges", lambda e: e < c)) - 1, F.lit(0))


def calibration(df: DataFrame, c: str = "predicted", outcome: str = "actual_return", n: int = 20) -> DataFrame:
    """One row for each of n equal-frequency bins of c: its range and mean, rows, share of wins and of outcomes that reach c, mean outcome.

    df is read once, into sums by distinct value; edges and bins come from these, and the bins are written, as they are
    n rows that several joins may read. Rows without a c don't count.
    """
    values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("actual_return") > 0).alias("_wins"), F.count_if(F.col(outcome) >= F.col(c)).alias("_hits"),
        F.sum(outcome).alias("_sum"), F.count(outcome).alias("_known")
    )
    scan = prefix_scan(values, ["_v"], ["n"]).withColumnsRenamed({"before_n": "before", "all_n": "total"})
    edges = picked(scan, "_v", [i / n for i in range(n + 1)]).agg(F.array_sort(F.collect_set("value")).alias("edges"))
    binned = scan.crossJoin(F.broadcast(edges))  # one row
    out = binned.groupBy(bin_of(F.col("_v")).alias("bin")).agg(
        F.min("_v").alias("pred_min"), F.max("_v").alias("pred_max"), (F.sum(F.col("_v") * F.col("n")) / F.sum("n")).alias("pred_mean"),
        F.sum("n").alias("n_samples"), (F.sum("_wins") / F.sum("n")).alias("win_prob"), (F.sum("_hits") / F.sum("n")).alias("p_hit_pred"),
        ratio(F.sum("_sum"), F.sum("_known")).alias("avg_outcome")
    )
    return written(out, "bins")


def calibrated(df: DataFrame, bins: DataFrame, c: str) -> DataFrame:
    """df with win_prob, p_hit and ml_score (0 to 100, one decimal) by the bin whose pred_max is the first above the prediction; the last bin takes the rest."""
    table = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "pred_min", "pred_max", "win_prob", "p_hit_pred"))).alias("t"))
    d = df.crossJoin(F.broadcast(table))  # one row of some twenty bins
    i = F.least(F.size(F.filter("t", lambda b: b["pred_max"] <= F.col(c))), F.size("t") - 1)
    d = d.withColumn("_i", i).withColumn("_b", F.get("t", F.col("_i"))).withColumn("_n", F.size("t"))
    width = F.col("_b.pred_max") - F.col("_b.pred_min")
    inside = F.when(width > 0, (F.col(c) - F.col("_b.pred_min")) / width).otherwise(0.5)
    score = (F.col("_i") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside))) / F.col("_n") * 100
    return d.select(
        *df.columns, F.col("_i").alias("bin"), F.col("_b.win_prob").alias("win_prob"), F.col("_b.p_hit_pred").alias("p_hit"),
        (F.floor(score * 10 + 0.5 + 1e-6) / 10).alias("calibrated_score")
    )


def scored(df: DataFrame, bins: DataFrame, c: str) -> DataFrame:
    """calibrated, with an error in place of the figures where the prediction isn't finite."""
    bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    out = calibrated(df, bins, c).withColumn("error", F.when(bad, "prediction is not finite"))
    return out.withColumns({x: F.when(F.col("error").isNull(), F.col(x)) for x in ("bin", "win_prob", "p_hit", "calibrated_score")})


def overview(df: DataFrame) -> DataFrame:
    """One row of counts, rates, correlations, means and quantiles of candidates with has_event."""
    g = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), (100 * share(F.col("actual_return") > 0)).alias("win_rate"),
        F.corr("predicted_return", "actual_return").alias("corr_return"), F.corr("predicted_mfe", "actual_mfe").alias("corr_mfe"), F.avg("actual_return").alias("mean"),
        (100 * share(F.col("has_event"))).alias("event_rate"), F.avg("actual_mfe").alias("mfe_mean"),
    )
    of_return = pivoted(quantiles(df, "actual_return", [0.5, 0.05, 0.95]), {0.5: "median", 0.05: "p05", 0.95: "p95"})
    of_mfe = pivoted(quantiles(df, "actual_mfe", [0.5]), {0.5: "mfe_median"})
    return g.crossJoin(F.broadcast(of_return)).crossJoin(F.broadcast(of_mfe))  # one row each


def by_dimension(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, trades, win_rate, avg_return, avg_predicted, avg_mfe) for each of several dimensions, in one pass of grouping sets."""
    d = df.select(*[F.col(c).cast("string").alias(c) for c in dims], "actual_return", "predicted_return", "actual_mfe")
    g = d.groupingSets([[F.col(c)] for c in dims], *[F.col(c) for c in dims]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("trades"), (100 * share(F.col("actual_return") > 0)).alias("win_rate"), F.avg("actual_return").alias("avg_return"), F.avg("predicted_return").alias("avg_predicted"), F.avg("actual_mfe").alias("avg_mfe")
    )
    full = 2 ** len(dims) - 1
    dim, value = F.lit(None), F.lit(None)
    for i, c in enumerate(dims):
        own = F.col("gid") == full - 2 ** (len(dims) - 1 - i)
        dim, value = F.when(own, c).otherwise(dim), F.when(own, F.col(c)).otherwise(value)
    return g.select(dim.cast("string").alias("dim"), value.cast("string").alias("value"), "trades", "win_rate", "avg_return", "avg_predicted", "avg_mfe")


def global_rank(df: DataFrame, c: str, parts: int = 64, by: list[str] = ()) -> DataFrame:
    """df with rank, its average-tie rank over all rows or a group's, without one task seeing all of them; rows with a null c go."""
    r = ranked_counts(df, c, list(by), parts)
    return df.join(r.select(*by, c, (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank")), [*by, c])


def aucs(df: DataFrame, score: str, positives: dict[str, Column], by: list[str]) -> DataFrame:
    """Areas under the ROC curve by group from rank sums of counted scores, a column for each of positives; 0.5 where a class is missing. The scores are ranked once."""
    hits = df.groupBy(*by, score).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(f"_p_{n}") for n, c in positives.items()])
    g, sums = ranked_counts(df, score, by).join(hits, [*by, score]), []
    for n in positives:
        p = F.col(f"_p_{n}")
        sums += [F.sum(p * (F.col("before") + (F.col("n") + 1) / 2)).alias(f"_r_{n}"), F.sum(F.col("n") - p).alias(f"_q_{n}"), F.sum(p).alias(f"_p_{n}")]

    def value(n: str) -> Column:
        r, p, q = F.col(f"_r_{n}"), F.col(f"_p_{n}"), F.col(f"_q_{n}")
        return F.when((p > 0) & (q > 0), (r - p * (p + 1) / 2) / (p * q)).otherwise(0.5)

    return g.groupBy(*by).agg(*sums).select(*by, *[value(n).alias(n) for n in positives])


def auc(df: DataFrame, score: str, positive: Column, by: list[str]) -> DataFrame:
    """aucs of a single class."""
    return aucs(df, score, {"auc": positive}, by)


def above_median(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """df with is_high, whether c is over its group's median."""
    m = pivoted(quantiles(df, c, [0.5], by), {0.5: "_median"}, by)
    return df.join(m, by).withColumn("is_high", F.col(c) > F.col("_median")).drop("_median")


def spearman(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Rank correlation; the first ranks are written, as the second ones read them twice."""
    ra = written(global_rank(df.select(*by, a, b), a, by=by).withColumnRenamed("rank", "_ra"), "ranks")
    return global_rank(ra, b, by=by).groupBy(*by).agg(F.corr("_ra", "rank").alias("spearman"))


def regression(df: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - ratio(F.avg(e * e), F.var_pop(actual))).alias("r2"), F.avg(actual).alias("actual_mean"), F.stddev_pop(actual).alias("actual_std"), F.avg(predicted).alias("pred_mean"), F.stddev_pop(predicted).alias("pred_std")
    )


def binary(df: DataFrame, predicted: str, hit: Column, by: list[str]) -> DataFrame:
    pos = F.col(predicted) > 0
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pos & hit).alias("tp"), F.count_if(pos & ~hit).alias("fp"),
        F.count_if(~pos & hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn")
    )
    p, r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    c = c.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.select(
        *by, "n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), "precision", "recall", f1.alias("f1"),
        ((F.col("tp") + F.col("fn")) / F.col("n")).alias("base_rate")
    )


def lift(df: DataFrame, score: str, positive: Column, key: list[str], floors: tuple[int, ...] = (50, 60, 70, 80, 85, 90), least: int = 10) -> DataFrame:
    """(filter, n, win_rate, avg_return, median_return, avg_mfe, median_mfe, sharpe, max_drawdown, pct_of_trades) of all rows, of those above each percentile of the score, and of the positive ones.

    df is read once and what is needed of it written. Percentiles of the score are turned into cuts of the score, one
    number for each floor, by a prefix scan over the distinct scores; so a row's filters are comparisons with constants.
    Sums are conditional. Medians of all filters come from one prefix scan over the distinct values, which carries each
    filter's count. max_drawdown is that of the returns compounded in the order of key, whose first column is a date.
    Rows without a score count in pct_of_trades' whole only.
    """
    kept = df.select(*key, F.col(score).alias("_score"), F.coalesce(positive, F.lit(False)).alias("_positive"), "actual_return", "actual_mfe")
    base = written(kept, "lifted")
    n_all = base.count()
    scores = prefix_scan(base.where("_score is not null").groupBy("_score").agg(F.count(F.lit(1)).alias("n")), ["_score"], ["n"])
    pct = (F.col("before_n") + (F.col("n") + 1) / 2) / n_all * 100
    cuts = scores.agg(*[F.min(F.when(pct >= f, F.col("_score"))).alias(str(f)) for f in floors]).first()
    flags = {"all": F.lit(True), **{str(f): F.col("_score") >= F.lit(cuts[str(f)]) for f in floors}, "positive": F.col("_positive")}
    r = base.where("_score is not null")
    rows = []
    for k, flag in flags.items():
        x, m = F.when(flag, F.col("actual_return")), F.when(flag, F.col("actual_mfe"))
        sharpe = F.coalesce(ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
        rows.append(F.struct(
            F.lit(k).alias("filter"), F.count(x).alias("n"), F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)).alias("win_rate"),
            F.avg(x).alias("avg_return"), F.avg(m).alias("avg_mfe"), sharpe.alias("sharpe")
        ))
    g = r.agg(F.array(*rows).alias("x")).select(F.inline("x")).where(F.col("n") >= least)
    both = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"actual_{c}").alias("_v")) for c in ("return", "mfe")])
    in_each = [F.coalesce(flag, F.lit(False)).cast("long").alias(f"_n{i}") for i, flag in enumerate(flags.values())]
    values = r.select(F.inline(both), *in_each).where("_v is not null").groupBy("_c", "_v").agg(*[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(flags))])
    scan = prefix_scan(values, ["_v"], [f"_n{i}" for i in range(len(flags))], ["_c"])
    each = F.array(*[F.struct(
        F.lit(k).alias("filter"), F.col(f"_n{i}").alias("n"), F.col(f"before__n{i}").alias("before"), F.col(f"all__n{i}").alias("total")
    ) for i, k in enumerate(flags)])
    medians = picked(scan.select("_c", "_v", F.inline(F.filter(each, lambda e: e["n"] > 0))), "_v", [0.5], ["_c", "filter"])
    medians = medians.groupBy("filter").agg(*[F.max(F.when(F.col("_c") == c, F.col("value"))).alias(f"median_{c}") for c in ("return", "mfe")])
    out = g.join(medians, "filter", "left").join(worst_drawdown(r, "actual_return", flags, key), "filter", "left")
    return out.withColumn("pct_of_trades", F.col("n") / F.lit(n_all) * 100)


def worst_drawdown(df: DataFrame, ret: str, flags: dict[str, Column], key: list[str]) -> DataFrame:
    """(filter, max_drawdown): the deepest fall below the peak, in percent, of percent returns compounded in the order of key, for the rows of each flag.

    Days first: each day's growth, its highest and lowest points and its own deepest fall, all as logarithms. Days are
    then put together in a window over the calendar.
    """
    day = Window.partitionBy(key[0]).orderBy(*key[1:])
    own = {k: F.when(flag, safe_log1p(F.col(ret) / 100)) for k, flag in flags.items()}
    d = df.select(*key, *[x.alias(f"_r{i}") for i, x in enumerate(own.values())])
    d = d.withColumns({f"_c{i}": F.when(F.col(f"_r{i}").isNotNull(), F.sum(f"_r{i}").over(day)) for i in range(len(own))})
    d = d.withColumns({f"_p{i}": F.col(f"_c{i}") - F.max(f"_c{i}").over(day) for i in range(len(own))})
    parts = [F.struct(
        F.lit(k).alias("filter"), F.sum(f"_r{i}").alias("s"), F.max(f"_c{i}").alias("hi"), F.min(f"_c{i}").alias("lo"),
        F.min(f"_p{i}").alias("fall")
    ) for i, k in enumerate(own)]
    days = d.groupBy(key[0]).agg(F.array(*parts).alias("x")).select(key[0], F.inline("x")).where("s is not null")
    w = Window.partitionBy("filter").orderBy(key[0])
    days = days.withColumn("start", F.sum("s").over(w) - F.col("s"))
    days = days.withColumn("peak", F.max(F.col("start") + F.col("hi")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fall = F.least("fall", F.coalesce(F.col("start") + F.col("lo") - F.col("peak"), F.lit(0.0)))
    return days.groupBy("filter").agg(((F.exp(F.min(fall)) - 1) * 100).alias("max_drawdown"))


def drawdown(df: DataFrame, by: list[str], order: list[str], equity: str) -> DataFrame:
    """df with peak, the running maximum, and drawdown, the share below it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("peak", F.max(equity).over(w)).withColumn("drawdown", ratio(F.col("peak") - F.col(equity), F.col("peak")))


def compounded(df: DataFrame, by: list[str], order: list[str], ret: str, start: float = 1.0) -> DataFrame:
    return df.withColumn("equity", start * F.exp(F.sum(safe_log1p(F.col(ret))).over(Window.partitionBy(*by).orderBy(*order))))


def losing_streaks(trades: DataFrame, by: list[str], order: list[str], ret: str = "exit_return", long: int = 3) -> DataFrame:
    """(by, longest, n_long): the longest run of losses and the number of runs of at least `long`.

    Runs are found within months of the first column of order, a date, so that no task sees all of a group. Runs that
    touch an end of their month, two a month at most, are then chained over the months.
    """
    month = [*by, "_month"]
    t = trades.withColumn("_month", F.trunc(order[0], "month")).withColumn("_l", F.col(ret) <= 0)
    w = Window.partitionBy(*month).orderBy(*order)
    t = t.withColumn("_rn", F.row_number().over(w)).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*month)))
    t = t.withColumn("_g", F.col("_rn") - F.row_number().over(Window.partitionBy(*month, "_l").orderBy(*order)))
    runs = t.where("_l").groupBy(*month, "_g").agg(
        F.count(F.lit(1)).alias("n"), F.min("_rn").alias("_a"), F.max("_rn").alias("_z"), F.max("_size").alias("_size")
    )
    runs = runs.withColumn("_starts", F.col("_a") == 1).withColumn("_ends", F.col("_z") == F.col("_size"))
    months = t.select(*month).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_month")))
    edges = runs.where("_starts or _ends").join(months, month)
    chain = Window.partitionBy(*by).orderBy("_k", "_a")
    goes_on = F.col("_starts") & F.lag("_ends").over(chain) & (F.lag("_k").over(chain) == F.col("_k") - 1)
    edges = edges.withColumn("_on", F.coalesce(goes_on, F.lit(False))).withColumn("_chain", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(chain))
    chained = edges.groupBy(*by, "_chain").agg(F.sum("n").alias("n")).drop("_chain")
    every = runs.where("not (_starts or _ends)").select(*by, "n").unionByName(chained)
    found = every.groupBy(*by).agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= long).alias("n_long"))
    zero = F.lit(0).cast("long")
    return months.select(*by).distinct().join(found, by, "left").select(
        *by, F.coalesce("longest", zero).alias("longest"), F.coalesce("n_long", zero).alias("n_long")
    )


def resampled(equity: DataFrame) -> DataFrame:
    """(strategy_id, date, equity) on every weekday from a strategy's first to its last date, the last value carried forward."""
    span = equity.groupBy("strategy_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("strategy_id", F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    both = days.select(
        "strategy_id", "date", F.lit(None).cast("double").alias("equity"), F.lit(True).alias("_w")
    ).unionByName(equity.select("strategy_id", "date", "equity", F.lit(False).alias("_w")))
    one = both.groupBy("strategy_id", "date").agg(F.max("equity").alias("equity"), F.max("_w").alias("_w"))
    w = Window.partitionBy("strategy_id").orderBy("date")
    return one.withColumn("equity", F.last("equity", ignorenulls=True).over(w)).where("_w").drop("_w")


def equity_statistics(equity: DataFrame) -> DataFrame:
    """One row per strategy: total and annual return, monthly Sharpe, daily Sharpe, worst drawdown, years in profit and the worst year."""
    by = Window.partitionBy("strategy_id")
    span = equity.groupBy("strategy_id").agg(
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"),
        F.datediff(F.max("date"), F.min("date")).alias("days")
    )
    month = equity.groupBy("strategy_id", F.trunc("date", "month").alias("m")).agg(F.max_by("equity", "date").alias("e")).withColumn(
        "r", ratio(F.col("e"), F.lag("e").over(by.orderBy("m"))) - 1
    )
    monthly = month.groupBy("strategy_id").agg((F.sqrt(F.lit(12.0)) * ratio(F.avg("r"), F.stddev_samp("r"))).alias("monthly_sharpe"))
    day = resampled(equity).withColumn("r", ratio(F.col("equity"), F.lag("equity").over(by.orderBy("date"))) - 1)
    daily = day.groupBy("strategy_id").agg((F.sqrt(F.lit(252.0)) * ratio(F.avg("r"), F.stddev_pop("r"))).alias("daily_sharpe"))
    down = drawdown(equity, ["strategy_id"], ["date"], "equity").groupBy("strategy_id").agg(F.max("drawdown").alias("max_drawdown"))
    year = equity.groupBy("strategy_id", F.year("date").alias("y")).agg((ratio(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("r"))
    yearly = year.groupBy("strategy_id").agg(F.count_if(F.col("r") > 0).alias("years_profitable"), F.min("r").alias("worst_year"))
    total = ratio(F.col("last"), F.col("first")) - 1
    out = span.select(
        "strategy_id", total.alias("total_return"),
        F.when(total > -1, F.pow(1 + total, 365.25 / F.col("days")) - 1).otherwise(-1.0).alias("annual_return")
    )
    for part in (monthly, daily, down, yearly):
        out = out.join(part, "strategy_id")
    return out


def trade_statistics(trades: DataFrame, by: list[str], years: float, ret: str = "exit_return", total_loss: float = -1.0) -> DataFrame:
    """Win rate, means, gross sums and rates of trades by their column ret; a return of at most total_loss is a total loss."""
    r, p = F.col(ret), F.col("pnl")
    win = r > 0
    g = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(win).alias("win_rate"), F.coalesce(F.avg(F.when(win, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(~win, r)), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.sum(F.when(win, p)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.abs(F.sum(F.when(~win, p))), F.lit(0.0)).alias("gross_loss"), F.min(r).alias("worst"), share(r <= total_loss).alias("total_loss_rate"), F.avg(r).alias("ev"), F.avg("days_held").alias("avg_days"),
    )
    return g.withColumn("profit_factor", ratio(F.col("gross_profit"), F.col("gross_loss"))).withColumn("per_year", F.col("n") / years)


def option_statistics(trades: DataFrame, by: list[str], years: float) -> DataFrame:
    """trade_statistics of option returns, where -90 % is a total loss, with avg_theta and multiplier, the options' sum of returns over the stocks'."""
    extra = trades.groupBy(*by).agg(F.avg("theta").alias("avg_theta"), F.sum("option_return").alias("_o"), F.sum("exit_return").alias("_s"))
    extra = extra.withColumn("multiplier", F.when(F.abs("_s") > 0.001, F.col("_o") / F.col("_s")).otherwise(0.0)).drop("_o", "_s")
    return trade_statistics(trades, by, years, "option_return", -0.90).join(extra, by)


def yearly_dollars(trades: DataFrame, by: list[str], capital: float, share_of: float, haircuts: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """(by, year, n, ev, dollars, and dollars after each haircut): what trades of a share of the capital each earn in a year; year 0 is the mean of the years that have trades."""
    y = trades.groupBy(*by, F.year("entry_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("exit_return").alias("ev"))
    y = y.withColumn("dollars", F.col("ev") * F.col("n") * share_of * capital)
    mean = y.groupBy(*by).agg(
        F.lit(0).alias("year"), F.sum("n").alias("n"), ratio(F.sum(F.col("ev") * F.col("n")), F.sum("n")).alias("ev"),
        F.avg("dollars").alias("dollars")
    )
    return y.unionByName(mean).withColumns({f"after_{round(h * 100)}": F.col("dollars") * (1 - h) for h in haircuts})


def min_max(c: str) -> Column:
    w = Window.partitionBy(F.lit(0))
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))


def weighted_score(summary: DataFrame, years: float) -> DataFrame:
    """0.40 consistency + 0.25 Sharpe + 0.20 (1 - drawdown) + 0.15 return, each scaled over the strategies."""
    s = 0.40 * F.col("years_profitable") / years + 0.25 * min_max("monthly_sharpe") + 0.20 * (1 - min_max("max_drawdown")) + 0.15 * min_max("total_return")
    return summary.withColumn("weighted_score", s)


def brief_score(summary: DataFrame, years: float) -> DataFrame:
    s = 0.5 * F.col("monthly_sharpe") + 0.3 * (1 - F.least(F.col("max_drawdown"), F.lit(1.0))) + 0.2 * F.col("years_profitable") / years
    return summary.withColumn("brief_score", s)


def window_statistics(df: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Counts, win rates and mean returns by direction and score floor, inside and outside the windows and in each of them, in one pass."""
    within = {k: F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for k, (a, b) in windows.items()}
    inside = F.greatest(*within.values(), F.lit(False))
    labels = F.array(F.when(inside, "inside").otherwise("outside"), *[F.when(x, k) for k, x in within.items()])
    d = df.withColumn("period", F.explode(F.filter(labels, lambda x: x.isNotNull())))
    of = lambda floor, way=None: (F.col("ml_score") >= floor) & (F.lit(True) if way is None else F.col("direction") == way)
    win = lambda c: 100 * F.avg(F.when(c, F.when(F.col("actual_return") > 0, 1.0).otherwise(0.0)))
    mean = lambda c: F.avg(F.when(c, F.col("actual_return")))
    floors = {"": (-1, None), "_long": (-1, "l"), "_short": (-1, "s"), "70": (70, None), "85": (85, None), "85_long": (85, "l"), "85_short": (85, "s")}
    r70 = F.when(of(70), F.col("actual_return"))
    return d.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(of(-1, "l")).alias("n_long"), F.count_if(of(-1, "s")).alias("n_short"), *[win(of(*x)).alias(f"wr{k}") for k, x in floors.items()],
        *[mean(of(*floors[k])).alias(f"avg{k}") for k in ("70", "85", "85_long")], F.coalesce(
            ratio(F.avg(r70), F.stddev_samp(r70)) * F.sqrt(F.lit(252.0)), F.lit(0.0)
        ).alias("sharpe70"),
    )


def threshold_grid(df: DataFrame, inside: Column, floors: list[int]) -> DataFrame:
    """(threshold, in_window, n, win_rate, avg_return) of the rows over each floor, inside and outside."""
    d = df.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in floors]))).where(F.col("ml_score") >= F.col("threshold"))
    return d.groupBy("threshold", inside.alias("in_window")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("actual_return") > 0).alias("win_rate"), F.avg("actual_return").alias("avg_return")
    )


def equivalent_threshold(grid: DataFrame, reference: int) -> DataFrame:
    """One row (equivalent, reference_rate): the lowest floor whose win rate inside reaches that of the reference floor outside; null without one."""
    outside = F.broadcast(grid.where(~F.col("in_window") & (F.col("threshold") == reference)).agg(F.max("win_rate").alias("reference_rate")))
    return grid.where("in_window").crossJoin(outside).agg(
        F.min(F.when(F.col("win_rate") >= F.col("reference_rate"), F.col("threshold"))).alias("equivalent"),
        F.max("reference_rate").alias("reference_rate")
    )


def joined_predictions(labels: DataFrame, parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """labels with each part's prediction by their key, and all_there, whether labels and parts have as many rows each.

    Rows that a part lacks go. A key stands once in labels and in each part.
    """
    n = labels.agg(F.count(F.lit(1)).alias("_n0"))
    out, same = labels, F.lit(True)
    for i, p in enumerate(parts.values(), 1):
        out = out.join(p, key)
        n = n.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias(f"_n{i}"))))
        same = same & (F.col(f"_n{i}") == F.col("_n0"))
    return out.crossJoin(F.broadcast(n.select(same.alias("all_there"))))  # one row


def daily_book(picks: DataFrame, slippage: float = 0.2, start: float = 100000.0) -> DataFrame:
    """(date, n, wins, net, ret, equity, drawdown): each day's picks in equal weights, percent returns less slippage, compounded.

    wins are picks that gain after slippage, net is the sum of their percent returns. The last windows run over one row
    per day: a calendar.
    """
    net = F.col("trade_return") - slippage
    day = picks.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(net > 0).alias("wins"), F.sum(net).alias("net"), (F.avg(net) / 100).alias("ret")
    ).withColumn("_book", F.lit(0))
    return drawdown(compounded(day, ["_book"], ["date"], "ret", start), ["_book"], ["date"], "equity").drop("_book", "peak")


def book_statistics(book: DataFrame, start: float = 100000.0) -> DataFrame:
    """One row on a daily_book: days, n_trades, log_growth, annual_growth (a year's logarithm, of a tenth of a year at least), sharpe (0 without a spread), max_drawdown, win_rate, avg_trade.

    The starting capital is the first peak.
    """
    days = Window.partitionBy(F.lit(0)).orderBy("date")  # a calendar
    peak = F.greatest(F.max("equity").over(days), F.lit(start))
    g = book.withColumn("_fall", (peak - F.col("equity")) / peak).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n_trades"), F.sum(safe_log1p(F.col("ret"))).alias("log_growth"),
        F.coalesce(F.sqrt(F.lit(252.0)) * ratio(F.avg("ret"), F.stddev_pop("ret")), F.lit(0.0)).alias("sharpe"),
        F.greatest(F.max("_fall"), F.lit(0.0)).alias("max_drawdown"), ratio(F.sum("wins"), F.sum("n")).alias("win_rate"), ratio(F.sum("net"), F.sum("n")).alias("avg_trade")
    )
    return g.where("days > 0").withColumn("annual_growth", F.col("log_growth") / F.greatest(F.col("days") / 252, F.lit(0.1)))


def strategies_compared(trades: DataFrame, inside: Column, meta: DataFrame, least: int = 5) -> DataFrame:
    """(strategy_id, n_inside, win_rate, avg_return, sharpe_inside, columns of meta) of each strategy's trades inside a window.

    sharpe_inside is by trade, scaled by the mean days held; null for fewer than `least` trades or no spread. meta may
    repeat a strategy: its smallest row by its columns in their order counts. A strategy without one keeps nulls.
    """
    rest = [c for c in meta.columns if c != "strategy_id"]
    one = meta.groupBy("strategy_id").agg(F.min(F.struct(*rest)).alias("_m")).select("strategy_id", "_m.*")
    r = F.col("exit_return")
    held = F.greatest(F.avg("days_held"), F.lit(1.0))
    sharpe = F.when(F.count(F.lit(1)) >= least, ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(252 / held))
    g = trades.where(inside).groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("n_inside"), (100 * share(r > 0)).alias("win_rate"), (100 * F.avg(r)).alias("avg_return"), sharpe.alias("sharpe_inside")
    )
    return g.join(one, "strategy_id", "left")


def compared_by_year(parts: dict[str, DataFrame], score: str, outcome: str, year: str = "val_year", top: float = 0.3) -> DataFrame:
    """(year, name, n, auc, n_top, win_top, sharpe_top) of several models' predictions, and auc_gain over the first one's.

    top: the share of a year's predictions, by rank, whose trades count as taken.
    """
    both = None
    for name, df in parts.items():
        one = df.select(F.col(year).alias("year"), F.lit(name).alias("name"), F.col(score).alias("score"), F.col(outcome).alias("outcome"))
        both = one if both is None else both.unionByName(one)
    by = ["year", "name"]
    both = written(both, "compared")
    cut = pivoted(quantiles(both, "score", [1 - top], by), {1 - top: "_cut"}, by)
    x = F.when(F.col("score") >= F.col("_cut"), F.col("outcome"))
    g = both.join(cut, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(x).alias("n_top"), F.avg(F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)).alias("win_top"),
        F.coalesce(ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe_top")
    ).join(auc(both, "score", F.col("outcome") > 0, by), by)
    first = g.where(F.col("name") == next(iter(parts))).select("year", F.col("auc").alias("_base"))
    return g.join(first, "year", "left").withColumn("auc_gain", F.col("auc") - F.col("_base")).drop("_base")
