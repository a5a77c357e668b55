import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def same_rows(spark_df, duck_df):
    """Both as sorted rows of text by column name; nulls of all kinds look alike."""
    got = spark_df.toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(duck_df.columns)
    assert len(got) == len(duck_df)
    text = lambda d: d[cols].astype(str).replace({"NaT": "nan", "None": "nan", "<NA>": "nan"}).sort_values(cols).reset_index(drop=True)
    a, b = text(got), text(duck_df)
    bad = [c for c in cols if (a[c] != b[c]).any()]
    assert not bad, f"{bad}: {a[a[bad[0]] != b[bad[0]]].head(3)} against {b[a[bad[0]] != b[bad[0]]].head(3)}"
