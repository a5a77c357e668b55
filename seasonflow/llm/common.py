"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions of this package travel to the workers by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules["seasonflow.llm"])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that survive lost executors.

    The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def is_held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def unit_hash(*cols: str | Column) -> Column:
    """A deterministic number in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def drawn_rows(rows: DataFrame, text_col: str, most_rows: int, most_bytes: int, salt: int) -> DataFrame:
    """Of the distinct rows about most_rows, and about most_bytes of text_col, drawn by a hash of the whole row.

    So an id that stands in many rows is drawn row by row; with no more rows and bytes than that, all distinct rows stay.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    share = min(1.0, most_rows / max(total.n, 1), most_bytes / max(total.bytes or 0, 1))
    return rows.where(unit_hash(*rows.columns, F.lit(salt)) < share).distinct()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def added_up(rows: DataFrame, count: Callable[[Iterator[pd.DataFrame]], np.ndarray], size: int, chunk: int = 1 << 12) -> np.ndarray:
    """The sum of the vectors of `size` counts that count() makes of each task's rows; they are added in parts, in Spark."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = count(batches).astype(np.int32)
        if own.any():
            yield pd.DataFrame([(k, own[k * chunk : (k + 1) * chunk].tobytes()) for k in range(-(-size // chunk))], columns=["part", "n"])

    def added(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in g["n"])
        return pd.DataFrame({"part": [key[0]], "n": [total.tobytes()]})

    out = np.zeros(size, np.int64)
    for r in rows.mapInPandas(counted, "part int, n binary").groupBy("part").applyInPandas(added, "part int, n binary").collect():
        out[r.part * chunk : (r.part + 1) * chunk] = np.frombuffer(r.n, np.int64)
    return out


def slices(texts: list, most_bytes: int):
    """Ranges (i, j) of texts that hold at most most_bytes UTF-8 bytes each; a longer text stands alone."""
    i, held = 0, 0
    for j, t in enumerate(texts):
        n = len(t) if t.isascii() else len(t.encode("utf-8", "replace"))
        if j > i and held + n > most_bytes:
            yield i, j
            i, held = j, 0
        held += n
    if i < len(texts):
        yield i, len(texts)
