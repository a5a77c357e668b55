"""Results that belong together, published at once: readers see the old set or the new one, never a mixture."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST = "MANIFEST.json"


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published at path: {"run": its name, "outputs": {name: {"folder", "format", "schema"}}}; None where nothing is."""
    jpath, fs = _files(spark, f"{path}/{MANIFEST}")
    if not fs.exists(jpath):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(str(jpath), wholetext=True).collect()))


def publish(spark: SparkSession, path: str, run: str, outputs: dict[str, tuple[DataFrame, str]]) -> None:
    """Write all outputs, {name: (frame, "parquet", "csv" or "json")}, and make them visible by one rename of the manifest.

    Each run writes to a folder of its own. Where an output fails, the manifest still names the old set, which is whole.
    A run that is already published is left alone; one that failed is written anew from its start. Folders of runs that
    the manifest no longer names stay for readers that began with them; forget() removes them.
    """
    now = manifest(spark, path)
    if now and now["run"] == run:
        return
    found = {}
    for name, (df, form) in outputs.items():
        folder = f"{path}/{run}/{name}"
        out = df.write.mode("overwrite").format(form)
        (out.option("header", True) if form == "csv" else out).save(folder)
        found[name] = {"folder": folder, "format": form, "schema": df.schema.jsonValue()}
    target, fs = _files(spark, f"{path}/{MANIFEST}")
    staged, _ = _files(spark, f"{path}/.{run}.{MANIFEST}")
    stream = fs.create(staged, True)
    stream.write(bytearray(json.dumps({"run": run, "outputs": found}).encode()))
    stream.close()
    jvm = spark._jvm
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, how)


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An output of the published set, under the schema it was written with."""
    now = manifest(spark, path)
    if now is None or name not in now["outputs"]:
        raise ValueError(f"{name} is not published at {path}")
    one = now["outputs"][name]
    reader = spark.read.schema(T.StructType.fromJson(one["schema"])).format(one["format"])
    return (reader.option("header", True) if one["format"] == "csv" else reader).load(one["folder"])


def forget(spark: SparkSession, path: str) -> None:
    """Remove the folders of all runs but the published one."""
    now = manifest(spark, path)
    jpath, fs = _files(spark, path)
    for s in fs.listStatus(jpath):
        if s.isDirectory() and (now is None or s.getPath().getName() != now["run"]):
            fs.delete(s.getPath(), True)
