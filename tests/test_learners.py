"""Search by successive halving, and walk-forward windows over one matrix."""

import glob
import os

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from seasonflow.operators import ml
from seasonflow.sources import views as v


@pytest.fixture(scope="module")
def data(spark, sf):
    from seasonflow.functions.core import written

    return written(ml.with_features(v.candidates(spark, sf)), "candidates")


def test_search_narrows_and_beats_a_grid(spark, data):
    got = ml.tune(data, "actual_return", 2001).toPandas()
    assert [len(got[got.rung == k]) for k in range(3)] == [75, 15, 3]
    n = data.where("year < 2001").count()
    for k, (_, share, rounds) in enumerate(ml.RUNGS):
        own = got[got.rung == k]
        assert set(own.rounds) == {rounds} and own.rows.nunique() == 1 and abs(own.rows.iloc[0] / n - share) < 0.02
    # the best of a rung go on
    for k in (0, 1):
        best = got[got.rung == k].sort_values(["rmse", "point"]).head(ml.RUNGS[k + 1][0])
        assert set(best.point) == set(got[got.rung == k + 1].point)
    m = ml.matrix(data.where("year <= 2001"))
    train, val = m.where("year < 2001"), m.where("year = 2001")
    grid = []
    for depth in (2, 4):
        g = GBTRegressor(labelCol="actual_return", featuresCol="features", predictionCol="p", maxDepth=depth, maxIter=6, seed=42).fit(train)
        grid.append(g.transform(val).agg(F.sqrt(F.avg((F.col("p") - F.col("actual_return")) ** 2))).first()[0])
    assert got[got.rung == 2].rmse.min() <= min(grid) + 1e-9


def test_search_goes_on_after_a_lost_driver(spark, data, tmp_path, monkeypatch):
    few = ((6, 0.2, 1), (2, 0.5, 2), (1, 1.0, 3))
    first = ml.tune(data, "actual_return", 2001, rungs=few, path=str(tmp_path / "a")).toPandas()
    kept = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/a/rung=[01]/*.parquet")}
    for f in glob.glob(f"{tmp_path}/a/rung=2/_SUCCESS"):
        os.remove(f)  # as if it had died while writing the last rung
    fitted = []
    real = ml.at_once
    monkeypatch.setattr(ml, "at_once", lambda spark, tasks, run, parallel: fitted.append(len(tasks)) or real(spark, tasks, run, parallel))
    again = ml.tune(data, "actual_return", 2001, rungs=few, path=str(tmp_path / "a")).toPandas()
    assert fitted == [1] and {f: os.path.getmtime(f) for f in kept} == kept
    cols = ["rung", "point", "rows"]
    assert first.sort_values(cols)[cols].values.tolist() == again.sort_values(cols)[cols].values.tolist()
    assert ml.tune(data.limit(0), "actual_return", 2001, rungs=few).count() == 0


def test_points_are_drawn_alike():
    assert ml.drawn_points(75) == ml.drawn_points(75) and len({p[1:] for p in ml.drawn_points(75)}) == 75
    assert all(2 <= p[1] <= 5 and 0.02 <= p[2] <= 0.5 and 1 <= p[3] <= 200 for p in ml.drawn_points(200, 7))


def test_windows_share_a_matrix_and_keep_their_keys(spark, data, tmp_path, monkeypatch):
    made = []
    real = ml.matrix
    monkeypatch.setattr(ml, "matrix", lambda *a: made.append(1) or real(*a))
    out = str(tmp_path / "walked")
    got = ml.walk_forward(data, "actual_return", [1994, 1999, 2000, 2001], out=out)
    assert len(made) == 1 and got.columns == [*data.columns, *ml.MEMBERS, "predicted", "rounds", "val_year"]
    rows = got.toPandas()
    want = data.where("year between 1999 and 2001").select("symbol", "date", "holding_days", "direction", "ml_score").toPandas()
    key = ["symbol", "date", "holding_days", "direction"]
    assert rows.sort_values(key)[[*key, "ml_score"]].values.tolist() == want.sort_values(key)[[*key, "ml_score"]].values.tolist()
    assert (rows.val_year == rows.year).all() and rows.groupby("val_year").rounds.nunique().max() == 1
    assert rows.groupby("val_year").rounds.first().nunique() > 1 and rows.rounds.max() < 30
    mean = rows[ml.MEMBERS].mean(axis=1)
    assert (abs(mean - rows.predicted) < 1e-9).all() and rows.predicted.corr(rows.actual_return) > 0.2
    assert sorted(os.path.basename(p) for p in glob.glob(f"{out}/window=*")) == ["window=1999", "window=2000", "window=2001"]
    # a window that is run again replaces its rows
    ml.walk_forward(data, "actual_return", [2001], out=out)
    assert spark.read.parquet(f"{out}/window=2001").count() == (rows.val_year == 2001).sum()


def test_windows_of_one_phase_and_of_no_rows(spark, data):
    got = ml.walk_forward(data, "actual_return", [1998, 2000, 2001], kind="same_phase")
    assert {r.val_year for r in got.select("val_year").distinct().collect()} == {2000, 2001}
    assert ml.walk_forward(data.limit(0), "actual_return", [2000]).count() == 0


def test_scores_read_the_tables_once(spark, sf):
    """What a fitted model scores comes from the written candidates."""
    from seasonflow.plans.learners import fit_regressor

    files = fit_regressor(spark, sf).inputFiles()
    assert files and not any("lineitem" in f or "part.parquet" in f for f in files)


def test_windows_read_their_own_years_and_directions(spark, data, monkeypatch):
    """Fits read the matrix's folders that they need; values that lack and the columns' own types stay as they are."""
    seen, real = [], ml.fit_members
    monkeypatch.setattr(ml, "fit_members", lambda train, *a: seen.append(train) or real(train, *a))
    gaps = data.withColumn("direction", F.when(F.col("holding_days") == 30, F.lit(None)).otherwise(F.col("direction")))
    gaps = gaps.withColumn("ml_score", F.when(F.col("holding_days") == 20, F.lit(None)).when(F.col("holding_days") == 21, float("nan")).otherwise(F.col("ml_score")))
    got = ml.walk_forward(gaps, "actual_return", [2000], by_direction=True)
    assert len(seen) == 2 and got.select(*gaps.columns).dtypes == gaps.dtypes
    for train in seen:
        plan = train._jdf.queryExecution().executedPlan().toString()
        filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
        assert "_year" in filters and "_side" in filters, plan
    count = lambda df: sorted(map(str, df.select("symbol", "date", "holding_days", "direction", "ml_score").collect()))
    assert count(got) == count(gaps.where("year = 2000 and direction is not null"))
    m = ml.matrix(gaps.where("holding_days in (20, 21)"), ["holding_days", "ml_score"]).collect()
    assert {(r.holding_days, tuple(r.features)) for r in m} == {(20, (20.0, 0.0, 0.0, 1.0)), (21, (21.0, 0.0, 0.0, 0.0))}
    assert all(r.ml_score is None or r.ml_score != r.ml_score for r in m)
