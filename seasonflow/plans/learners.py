"""Queries of the learners: rows and schema are checked, not values, as fits differ between machines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from seasonflow.functions.core import shared_path, written
from seasonflow.operators import metrics as mt
from seasonflow.operators import ml
from seasonflow.plans.metrics import K, by_member
from seasonflow.sources import views as v

ORACLES: dict[str, str] = {}
#: Holding days of the tiers; the fixture has 10 to 30 days.
TIERS = {"10_19": (10, 19), "20_30": (20, 30)}


def data(spark, sf_dir):
    """Candidates with features, written once: fits and scores read them many times, the relational tables once."""
    return written(ml.with_features(v.candidates(spark, sf_dir)), "candidates")


def fit_regressor(spark, sf_dir):
    d = data(spark, sf_dir)
    m = ml.fit_regressor(d.where("year <= 2000").withColumn("late", F.col("year") == 2000), "actual_return", validation="late", rounds=5)
    return m.transform(ml.prepared(d.where("year = 2001"))).select(*K, "predicted")


#: The fixture's years that have a year before them.
YEARS = [1998, 1999, 2000, 2001]


def wf_train(spark, sf_dir):
    """Metrics of each member and of their mean by validation year, with the rounds that boosting took there, over expanding windows and those of one cycle phase."""
    d, out = data(spark, sf_dir), None
    for kind in ("expanding", "same_phase"):
        p = ml.walk_forward(d, "actual_return", YEARS, kind=kind)
        rounds = p.groupBy("val_year").agg(F.max("rounds").alias("rounds"))
        one = by_member(p.select("val_year", "actual_return", "actual_mfe", *ml.MEMBERS, "predicted"), [*ml.MEMBERS, "predicted"], "val_year")
        one = one.join(rounds, "val_year").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def wf_train_split(spark, sf_dir):
    """Out-of-sample predictions of models for longs and for shorts; the candidates are read once, by the matrix, which is written."""
    return ml.walk_forward(ml.with_features(v.candidates(spark, sf_dir)), "actual_return", YEARS, by_direction=True).select(*K, "val_year", *ml.MEMBERS, "predicted", "rounds")


def wf_compare_split(spark, sf_dir):
    """Models of both directions against models for longs and for shorts, by year: AUC and the best three tenths' trades."""
    d = data(spark, sf_dir)
    parts = {name: ml.walk_forward(d, "actual_return", YEARS, by_direction=split) for name, split in (("combined", False), ("split", True))}
    return mt.compared_by_year(parts, "predicted", "actual_return")


def fit_final(spark, sf_dir):
    """A model of all but the last year, saved, read again and held out on that year."""
    d = data(spark, sf_dir)
    path = shared_path(spark, "model")
    ml.fit_regressor(d.where("year <= 2000"), "actual_return", rounds=5).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(ml.prepared(d.where("year = 2001")))
    return mt.regression(out, "predicted", "actual_return", ["direction"])


def agg_feature_importance(spark, sf_dir):
    return ml.importances(ml.fit_regressor(data(spark, sf_dir).where("year <= 2000"), "actual_return", rounds=5))


def tune_params(spark, sf_dir):
    """All trials of the search, judged on the last year."""
    return ml.tune(data(spark, sf_dir), "actual_return", 2001)


def score_batch(spark, sf_dir):
    """Candidates of the last year scored by the model of their tier, fitted and calibrated on the years before.

    A prediction that isn't finite gives an error in place of a score.
    """
    d, out = data(spark, sf_dir), None
    for tier, days in TIERS.items():
        own = d.where(F.col("holding_days").between(*days))
        m = ml.fit_regressor(own.where("year <= 1999"), "actual_return", rounds=5)
        bins = mt.calibration(m.transform(ml.prepared(own.where("year = 2000"))), "predicted")
        one = mt.scored(m.transform(ml.prepared(own.where("year = 2001"))).select(*K, "predicted"), bins, "predicted").withColumn("tier", F.lit(tier))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (fit_regressor, wf_train, wf_train_split, wf_compare_split, fit_final, agg_feature_importance, tune_params, score_batch)}
