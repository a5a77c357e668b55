"""The pipeline's stages, each on its predecessor's rows, against plain counterparts."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from seasonflow.llm import byte_bpe

COLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in cp.STAGES:
        from seasonflow.llm.common import cut

        out.append(cut(f(spark, out[-1], sf), "stage"))
    return out


def test_stages_narrow_and_keep_columns(staged):
    docs = staged[0]
    for a, b in zip(staged[:4], staged[1:5]):
        assert b.columns == docs.columns
        assert b.join(a, "doc_id", "left_anti").count() == 0 and b.count() <= a.count()
    assert staged[5].count() == staged[4].count()


def test_each_stage_against_plain_code(spark, sf, staged):
    """What each stage keeps of its predecessor's rows, by models applied text by text, all pairs, and one pass over slots."""
    from test_operators import edf, weighted_classes

    from seasonflow.llm import language, toxicity

    docs, calm, named, single, mixed = ([r.asDict() for r in d.collect()] for d in staged[:5])
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    model = toxicity.train(staged[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(calm) == ids(r for r in docs if toxicity.score_texts(model, [r["text"] or ""])[0] < 0.5)
    coder = language.Coder(language.train(staged[1]))
    kept = [r for r in calm for lang, _, excess in [coder.explain([r["text"]])] if lang[0] != "und" and excess[0] <= cp.UNEXPLAINED_BITS]
    assert ids(named) == ids(kept)
    classes, _ = weighted_classes([(r["doc_id"], r["text"]) for r in named], spark, 0.8)
    assert ids(single) == sorted(i for i, c in classes.items() if i == c)
    sources = sorted({r["source"] for r in single})
    own = {s: sorted((r["doc_id"] for r in single if r["source"] == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in sources}
    order, taken = edf([round(len(own[s]) ** 0.5) for s in sources], [len(own[s]) for s in sources]), dict.fromkeys(sources, 0)
    want = []
    for k in order:
        want.append(own[sources[k]][taken[sources[k]]])
        taken[sources[k]] += 1
    assert [r["doc_id"] for r in mixed][: len(want)] == want and ids(mixed) == ids(single)


def test_copies_are_gone_and_one_stays(staged):
    before, after = staged[2], staged[3]
    assert after.groupBy("text").count().where("count > 1").count() == 0
    lost = before.select("text").distinct().join(before.join(after.select("doc_id"), "doc_id").select("text"), "text", "left_anti")
    assert lost.count() < before.count() * 0.2


def test_ids_are_the_encoder_s(staged):
    enc = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text or "" for r in staged[4].collect()}
    for r in staged[5].collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, enc.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest()


def test_stages_on_odd_rows(spark, sf):
    rows = [
        (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "a b c d e f", "en", "a", 11), (3, "a b c d e f", "en", "a", 11),
        (4, "A b c d e, f", "de", "b", 12), (None, "no id here", "en", "b", 10)
    ]
    df = spark.createDataFrame(rows, COLS).withColumn("score", F.lit(1)).withColumn("found", F.lit(2)).withColumn("kept", F.lit(3))
    for _, f in cp.STAGES[:4]:
        got = f(spark, df, sf)
        assert got.columns == df.columns and got.count() <= len(rows)
        assert f(spark, df.limit(0), sf).count() == 0
    near = cp.drop_near_duplicates(spark, df, sf)
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 2, 3]


def test_run(spark, sf, staged):
    assert cp.run(spark, sf).count() == staged[5].count()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "byte_bpe"]


def test_mixing_keeps_every_row_in_mix_order(spark, sf):
    rows = [(
        i, f"text {i}", "en", "big" if i < 300 else "mid" if i < 340 else None, 6
    ) for i in range(341)] + [(None, "x", "en", "big", 1), (None, "y", None, "mid", 1)]
    df = spark.createDataFrame(rows, COLS)
    got = [r.asDict() for r in cp.mix_sources(spark, df, sf).collect()]
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(key(r.asDict()) for r in df.collect())
    slot = {r.doc_id: r.due if r.slot is None else r.slot for r in cp.mixing.mixed(df).collect()}
    places = [slot[r["doc_id"]] for r in got if r["doc_id"] is not None]
    assert places == sorted(places)


def test_unknown_languages_go_whatever_their_length(spark, sf):
    """Known languages stay, junk and single words among them; scripts that no language has go, short and long."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    known = [r.text for r in docs.where("lang is not null and text rlike '[a-z]'").collect()]
    strange = ["日本語", "日本語のテキスト " * 3, "日本語のテキスト " * 300, "Привет", "Привет, мир! " * 200]
    short = [t.split()[0] for t in known if t.split()[0].isalpha()][:100]
    rows = [(10**9 + k, t, None, "x", len(t)) for k, t in enumerate(strange + short)]
    kept = cp.drop_unknown_language(spark, docs.unionByName(spark.createDataFrame(rows, COLS)), sf)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert not any(10**9 + k in got for k in range(len(strange)))
    assert all(10**9 + len(strange) + k in got for k in range(len(short)))
    assert sorted(t for i, t in got.items() if i < 10**9 and t in set(known)) == sorted(known)
