"""Opportunity files by date with different headers; a saved model's features against a frame."""

import gzip
import os

import pytest
from pyspark.ml import PipelineModel

from seasonflow.operators import ml
from seasonflow.sources import files as fl

FULL = "LorS,daysOut,sym,sharpe_ratio,avg_profit,sharpe_ratio2,avg_profit2,median_profit"


def put(path, combo, date, head, rows):
    at = f"{path}/combo={combo}/date={date}"
    os.makedirs(at, exist_ok=True)
    with gzip.open(f"{at}/part.csv.gz", "wt") as f:
        f.write("\n".join([head, *rows]) + "\n")


def test_only_the_files_of_five_dates_are_opened(spark, tmp_path):
    path, dates = str(tmp_path / "opps"), fl.neighbours("2000-03-07")
    assert dates == ["2000-02-22", "2000-02-29", "2000-03-07", "2000-03-14", "2000-03-21"]
    for combo in ("10_10", "10_8_PE2", "5_5"):
        for d in [*dates, "2000-03-08"]:
            put(path, combo, d, FULL, [f"l,12,A{combo[0]},1.5,2.0,3.0,4.0,9"])
    with open(f"{path}/combo=5_5/date=2000-03-08/part.csv.gz", "wb") as f:
        f.write(b"no gzip")
    got = fl.scan_opps_by_date(spark, path, dates)
    files = got.inputFiles()
    assert len(files) == 15 and not any("2000-03-08" in f for f in files)
    assert dict(got.dtypes) == {c: t for c, t in fl.OPPS_KEPT.items()}
    rows = got.collect()
    assert len(rows) == 15 and {r.combo for r in rows} == {"10_10", "10_8_PE2", "5_5"} and {str(r.date) for r in rows} == set(dates)


def test_older_files_are_filled_in(spark, tmp_path):
    path, d = str(tmp_path / "opps"), "2000-03-07"
    put(path, "a", d, FULL, ["l,12,NEW,1.5,2.0,3.0,4.0,9", "s,13,GAP,1.5,2.0,,,9", "s,x,BAD,1.5,2.0,1,1,9"])
    put(path, "b", d, "LorS,daysOut,sym,sharpe_ratio,avg_profit,sharpe_ratio2", ["l,12,NOPROFIT2,1.5,2.0,3.0"])
    put(path, "c", d, "LorS,avg_profit2,daysOut,sym,avg_profit,sharpe_ratio", ["l,4.0,12,NOSHARPE2,2.0,1.5"])
    put(path, "d", d, "LorS,daysOut,sym,sharpe_ratio", ["l,12,NOTHING,1.5"])
    put(path, "e", d, FULL, [])
    got = {r.sym: (r.combo, r.daysOut, r.sharpe_ratio, r.avg_profit, r.sharpe_ratio2, r.avg_profit2) for r in fl.scan_opps_by_date(spark, path, [d, "1999-01-01"]).collect()}
    assert got == {
        "NEW": ("a", 12, 1.5, 2.0, 3.0, 4.0), "GAP": ("a", 13, 1.5, 2.0, 1.5, 2.0), "NOPROFIT2": ("b", 12, 1.5, 2.0, 3.0, 2.0),
        "NOSHARPE2": ("c", 12, 1.5, 2.0, 1.5, 4.0)
    }
    assert fl.scan_opps_by_date(spark, path, ["1999-01-01"]).count() == 0


def test_a_loaded_models_features_against_frames(spark, tmp_path):
    df = spark.createDataFrame([(float(k), float(k % 3), None if k == 4 else 1.0, float(k)) for k in range(30)], "a double, b double, c double, y double")
    ml.fit_regressor(df, "y", ["a", "b", "c"], rounds=1, depth=2).write().save(f"{tmp_path}/model")
    model = PipelineModel.load(f"{tmp_path}/model")
    assert ml.model_features(model) == ["a", "b", "c"]
    diff = lambda cols: {(r.kind, r.name, r.expected_at, r.found_at) for r in ml.feature_differences(spark, ml.model_features(model), cols).collect()}
    assert diff(["a", "b", "c"]) == {("same", "a", 0, 0), ("same", "b", 1, 1), ("same", "c", 2, 2)}
    assert diff(["b", "x", "a"]) == {("moved", "a", 0, 2), ("moved", "b", 1, 0), ("missing", "c", 2, None), ("extra", "x", None, 1)}
    assert ml.matched(df.select("y", "c", "b", "a"), model).columns == ["a", "b", "c", "y"]
    with pytest.raises(ValueError, match="missing columns: c"):
        ml.matched(df.drop("c"), model)
    model.stages[-2].setInputCols(["a_i", "b_i"])
    with pytest.raises(ValueError, match="takes 6 features, the assembler gives 2"):
        ml.model_features(model)
