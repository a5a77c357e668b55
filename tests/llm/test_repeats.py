"""Licence texts that stand in a document several times, in both engines."""

import duckdb
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from seasonflow.llm import licences, registry

BY_ID = {i: s for s, i in sorted(licences.SENTENCES.items(), reverse=True)}


def text_of(ids: list[str]) -> str:
    return "\n".join(f"{BY_ID[i]}." for i in ids) + "\n"


def full_rules() -> list[tuple[str, list[str]]]:
    """Each licence's longest rule."""
    best = {}
    for name, ids in licences.RULES:
        if len(ids) > len(best.get(name, [])):
            best[name] = ids
    return sorted(best.items())


@pytest.mark.parametrize("times", [2, 3])
def test_every_licence_text_repeated(spark, times):
    rules = [r for r in full_rules() if all(i in BY_ID for i in r[1])]
    assert len(rules) > 20
    rows = [(k, text_of(ids) * times) for k, (_, ids) in enumerate(rules)]
    rows += [(1000, text_of(rules[0][1]) + "some words\n" + text_of(rules[1][1]) + text_of(rules[0][1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.recognise(df).collect()}
    for k, (name, ids) in enumerate(rules):
        assert got[k].unmatched == [] and name in got[k].licences, (name, got[k])
    assert got[1000].unmatched == []
    shown = licences.recognise(df).select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences", "unmatched")])
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    same_rows(shown, con.execute(registry.ORACLES["op5_sentence_rules"]).df())
