"""Learners over candidate features: walk-forward windows, regression pipelines, tuning and batch scoring with MLlib."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonflow.functions.core import require_columns, shared_path, written

#: What the models see, in this order.
FEATURES = [
    "holding_days", "ml_score", "predicted_return", "predicted_mfe", "win_probability", "p_hit_return", "p_hit_mfe", "stock_volatility_20d",
    "atr_14d_pct", "is_long", "month", "day_of_year", "cycle"
]


#: The learners of an ensemble.
MEMBERS = ["gbt", "forest", "linear"]


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_long": F.when(F.col("direction") == "l", 1.0).otherwise(0.0), "month": F.month("date").cast("double"),
        "day_of_year": F.dayofyear("date").cast("double"), "cycle": F.pmod(F.year("date") - 2001, F.lit(4)).cast("double")
    })


def contract(df: DataFrame, features: list[str]) -> DataFrame:
    """(n_features, ok): ok where df's columns are the features, in order; columns that lack raise an error."""
    require_columns(df, features)
    return df.sparkSession.range(1).select(F.lit(len(features)).alias("n_features"), F.lit(df.columns == features).alias("ok"))


def model_features(model: PipelineModel) -> list[str]:
    """The features that a fitted pipeline takes, in its order, from its assembler; an error where its learner takes another number."""
    names = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()
    if (n := model.stages[-1].numFeatures) != len(names):
        raise ValueError(f"the learner takes {n} features, the assembler gives {len(names)}")
    return [x.removesuffix("_i") for x in names if not x.endswith("_missing")]


def feature_differences(spark: SparkSession, expected: list[str], found: list[str]) -> DataFrame:
    """(kind, name, expected_at, found_at) of every feature of a model or column of a frame.

    missing: the frame lacks it; extra: the model doesn't take it; moved: among the shared ones it stands elsewhere; same.
    """
    shared = [x for x in found if x in expected]
    order = [x for x in expected if x in found]
    rows = [(
        "missing" if x not in found else "same" if shared.index(x) == order.index(x) else "moved", x, i, found.index(x) if x in found else None
    ) for i, x in enumerate(expected)]
    rows += [("extra", x, None, i) for i, x in enumerate(found) if x not in expected]
    return spark.createDataFrame(rows, "kind string, name string, expected_at int, found_at int")


def matched(df: DataFrame, model: PipelineModel) -> DataFrame:
    """df with the model's features first, in its order, or an error that names what is missing."""
    wanted = model_features(model)
    return require_columns(df, wanted).select(*wanted, *[c for c in df.columns if c not in wanted])


def walk_forward_windows(df: DataFrame, years: list[int]) -> DataFrame:
    """df with val_year, kind and is_val: for each year, all earlier years, and those of its cycle phase, against the year itself."""
    w = df.withColumn("val_year", F.explode(F.array(*[F.lit(y) for y in years]))).where(F.col("year") <= F.col("val_year"))
    w = w.withColumn("is_val", F.col("year") == F.col("val_year"))
    same = w.where((F.col("val_year") - F.col("year")) % 4 == 0)
    return w.withColumn("kind", F.lit("expanding")).unionByName(same.withColumn("kind", F.lit("same_phase")))


def stages(features: list[str]) -> list:
    """Missing values become the mean, with a flag column each, as the learners take no nulls."""
    return [
        Imputer(inputCols=features, outputCols=[f"{c}_i" for c in features]),
        VectorAssembler(inputCols=[*[f"{c}_i" for c in features], *[f"{c}_missing" for c in features]], outputCol="features")
    ]


def prepared(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    df = df.withColumns({c: F.col(c).cast("double") for c in features})
    return df.withColumns({f"{c}_missing": F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in features})


def fit_regressor(df: DataFrame, label: str, features: list[str] = FEATURES, validation: str | None = None, rounds: int = 10, depth: int = 4) -> PipelineModel:
    """Boosted trees; with a boolean validation column, rounds stop early on its rows."""
    g = GBTRegressor(labelCol=label, featuresCol="features", predictionCol="predicted", maxIter=rounds, maxDepth=depth, seed=42)
    if validation:
        g = g.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*stages(features), g]).fit(prepared(df, features))


def matrix(df: DataFrame, features: list[str] = FEATURES, by: list[str] | tuple = ()) -> DataFrame:
    """df with the assembled vector `features`, written once for all fits that follow, with a folder for each value of `by`.

    A missing value is 0 beside its flag, so the vector depends on no other row and serves every window alike. Fits that
    filter by columns of `by` read the folders that they need.
    """
    filled = {f"_f_{c}": F.col(c).cast("double") for c in features}
    flags = {f"{c}_missing": F.when(F.col(c).cast("double").isNull(), 1.0).otherwise(0.0) for c in features}
    d = df.withColumns({**filled, **flags}).fillna(0.0, list(filled))
    d = VectorAssembler(inputCols=[*filled, *flags], outputCol="features", handleInvalid="error").transform(d)
    return written(d.drop(*filled, *flags), "matrix", by)


def at_once(spark: SparkSession, tasks: list, run: Callable, parallel: int) -> list:
    """run(task) of each task, `parallel` of them at a time as concurrent jobs in one fair pool, which doesn't hold up others."""
    if not tasks:
        return []

    def go(task):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "fits")
        return run(task)

    with ThreadPool(min(parallel, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(spark)(go), tasks, chunksize=1)


def fit_members(train: DataFrame, label: str, rounds: int = 30, depth: int = 3) -> tuple[list, int]:
    """The members' models on an assembled matrix with a column is_val, and the rounds that the boosted trees took.

    Boosting stops where another round no longer helps on the rows of is_val; the other members see the rest only.
    """
    g = GBTRegressor(
        labelCol=label, featuresCol="features", predictionCol="gbt", maxIter=rounds, maxDepth=depth, seed=42, validationIndicatorCol="is_val", validationTol=0.001
    )
    own = train.where(~F.col("is_val"))
    gbt = g.fit(train)
    forest = RandomForestRegressor(labelCol=label, featuresCol="features", predictionCol="forest", numTrees=10, maxDepth=4, seed=42).fit(own)
    linear = LinearRegression(labelCol=label, featuresCol="features", predictionCol="linear", regParam=0.1).fit(own)
    return [gbt, forest, linear], gbt.getNumTrees


def walk_forward(
    df: DataFrame, label: str, years: list[int], by_direction: bool = False, kind: str = "expanding", out: str | None = None, parallel: int = 3
) -> DataFrame:
    """Out-of-sample predictions of each year: df's rows and columns with the members, predicted (their mean), rounds and val_year.

    Members are fitted on all earlier years, or on those of the year's cycle phase (same_phase), optionally long and short
    apart; boosting stops early on the year itself. The feature matrix is written once, by year and direction, and windows,
    `parallel` of them at a time, read those years and directions that they are fitted on. Each window writes its
    predictions, with all columns of df, to its own folder under `out` (default: the shared folder), so the keys stay and a
    window that is run again replaces its rows.
    Years without earlier rows, and rows without a label, give none.
    """
    spark = df.sparkSession
    out = out or shared_path(spark, "walked")
    m = matrix(df.where(F.col(label).isNotNull()).withColumns({"_year": F.col("year"), "_side": F.col("direction")}), FEATURES, ["_year", "_side"])
    there = {(r["_year"], r["_side"]) for r in m.select("_year", "_side").distinct().collect()}

    def window(task: tuple) -> None:
        y, d = task
        part = m if d is None else m.where(F.col("_side") == d)
        year = F.col("_year")
        before = (year < y) if kind == "expanding" else (year < y) & (F.pmod(year - y, F.lit(4)) == 0)
        train = part.where(before | (year == y)).withColumn("is_val", year == y)
        models, rounds = fit_members(train, label)
        p = part.where(year == y)
        for x in models:
            p = x.transform(p)
        mean = sum((F.col(n) for n in MEMBERS[1:]), F.col(MEMBERS[0])) / len(MEMBERS)
        p = p.select(*df.columns, *MEMBERS, mean.alias("predicted"), F.lit(rounds).alias("rounds"), F.lit(y).alias("val_year"))
        p.write.mode("overwrite").parquet(f"{out}/window={y}{d or ''}")

    early = lambda y, d: any(yy < y and (kind == "expanding" or (yy - y) % 4 == 0) and d in (None, dd) for yy, dd in there)
    now = lambda y, d: any(yy == y and d in (None, dd) for yy, dd in there)
    tasks = [(y, d) for y in years for d in (("l", "s") if by_direction else (None,)) if early(y, d) and now(y, d)]
    at_once(spark, tasks, window, parallel)
    empty = df.limit(0).select("*", *[F.lit(None).cast("double").alias(n) for n in (*MEMBERS, "predicted")], F.lit(0).alias("rounds"), F.lit(0).alias("val_year"))
    return spark.read.schema(empty.schema).parquet(*[f"{out}/window={y}{d or ''}" for y, d in tasks]) if tasks else empty


def importances(model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    v = model.stages[-1].featureImportances.toArray().tolist()
    names = [*features, *[f"{c}_missing" for c in features]]
    return SparkSession.active().createDataFrame(list(zip(names, v)), "feature string, gain double").orderBy(F.desc("gain"), "feature")


#: Points, share of the rows and rounds of boosting of each rung.
RUNGS = ((75, 1 / 25, 1), (15, 1 / 5, 3), (3, 1.0, 9))
POINT = "point int, depth int, step double, least_rows int, least_gain double, bins int, row_share double, feature_share double"


def drawn_points(n: int, seed: int = 42) -> list[tuple]:
    """n points of POINT, drawn evenly or evenly in logarithms; the same for the same seed."""
    r = random.Random(seed)
    log = lambda low, high: math.exp(r.uniform(math.log(low), math.log(high)))
    return [(
        k, r.randint(2, 5), log(0.02, 0.5), round(log(1, 200)), log(1e-6, 1e-2), r.choice([16, 32, 64, 128]), r.uniform(0.5, 1.0), r.uniform(0.3, 1.0)
    ) for k in range(n)]


def tune(
    df: DataFrame, label: str, val_year: int, features: list[str] = FEATURES, rungs: tuple = RUNGS, path: str | None = None, most: int = 2_000_000,
    parallel: int = 4, seed: int = 42
) -> DataFrame:
    """(rung, POINT, rows, rounds, rmse) of all trials by successive halving: the best of each rung go on with more rows and rounds.

    Trials learn from rows before val_year, of which a rung takes a share by their hash (of `most` rows at most), and are
    judged on all rows of val_year. The feature matrix is written once; the trials of a rung are concurrent jobs. A rung's
    table is written to `path` (default: the shared folder) when it is done: a driver that starts again with the same
    path and arguments reads the rungs that are there and goes on with the next.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, "tuned")
    named = df.where(F.col(label).isNotNull() & (F.col("year") <= val_year)).withColumn("_u", F.pmod(F.xxhash64(label, *features), F.lit(1_000_003)) / 1_000_003.0)
    m = matrix(named, features).select("features", label, "_u", (F.col("year") == val_year).alias("is_val"))
    train, val = m.where("not is_val"), m.where("is_val")
    whole = min(1.0, most / max(train.count(), 1))
    points, done = drawn_points(rungs[0][0], seed), None
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    schema = f"rung int, {POINT}, rows long, rounds int, rmse double"
    for rung, (n, share, rounds) in enumerate(rungs):
        at = f"{path}/rung={rung}"
        flag = fs(f"{at}/_SUCCESS")
        if not flag.getFileSystem(spark._jsc.hadoopConfiguration()).exists(flag):
            if done is not None:
                best = done.orderBy("rmse", "point").limit(n).collect()
                points = [tuple(r[c] for c in drawn_columns()) for r in best]
            rows = written(train.where(F.col("_u") < whole * share), "rows")
            n_rows = rows.count()

            def trial(point: tuple, rows=rows, n_rows=n_rows, rounds=rounds, rung=rung) -> tuple:
                _, depth, step, least_rows, gain, bins, row_share, feature_share = point
                g = GBTRegressor(
                    labelCol=label, featuresCol="features", predictionCol="p", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=least_rows,
                    minInfoGain=gain, maxBins=bins, subsamplingRate=row_share, featureSubsetStrategy=str(round(feature_share, 6)), seed=42,
                )
                rmse = g.fit(rows).transform(val).agg(F.sqrt(F.avg((F.col("p") - F.col(label)) ** 2))).first()[0]
                return (rung, *point, n_rows, rounds, rmse)

            results = at_once(spark, points, trial, parallel) if n_rows else []
            spark.createDataFrame(results, schema).coalesce(1).write.mode("overwrite").parquet(at)
        done = spark.read.schema(schema).parquet(at)
    return spark.read.schema(schema).parquet(*[f"{path}/rung={k}" for k in range(len(rungs))])


def drawn_columns() -> list[str]:
    return [x.split()[0] for x in POINT.split(", ")]
