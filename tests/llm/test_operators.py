"""The operators of seasonflow.llm: against brute force, round trips, held-out accuracy, and on edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seasonflow.llm import byte_bpe, chat, language, licences, media, minhash, mixing, registry, token_counts, toxicity, vectors
from seasonflow.llm.common import cut, fresh, slices
from seasonflow.llm.components import components

DOC = "doc_id long, text string"
NASTY = [
    "", " ", "  a  b ", "a\n\n b", "<|endoftext|> x <|endoftext|>", "don't we'll I'm 12 345", "é" * 50, "日本語 テキスト", "\t  x", "a" * 5000,
    "x   y", "🙂 🙃🙂", "tail   ", "a'  'b", "İstanbul ẞ"
]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(f"{rnd.choice(WORDS)}{rnd.randrange(40)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck.execute(registry.ORACLES[name]).df())


# toxicity


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(1500):
        toxic = rnd.random() < 0.15
        words = prose(i, rnd.randrange(20, 200)).split()
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["vilex", "vilest", "grubby", "snarl"]))
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.6:
            labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.tox_score for r in toxicity.score(docs, toxicity.train(docs, lab)).collect()}
    test = [(t, got[i] >= 0.5) for i, t in labels if held_out(i)]
    assert sum(t == p for t, p in test) / len(test) > 0.97


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "")], DOC).withColumn("label", F.lit("x"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none))
    assert [r.tox_score for r in got.collect()] == [0.0] * 3 and got.columns[-2:] == ["label", "tox_score"]
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
    only_null = spark.createDataFrame([(None, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, only_null)["w"] is None


def test_nnpu_risk_is_corrected():
    g = np.random.default_rng(1)
    x = np.vstack([g.normal(2, 1, (400, 1)), g.normal(2, 1, (300, 1)), g.normal(-2, 1, (1200, 1))])
    toxic = np.arange(1900) < 400
    w = toxicity.fit_nnpu(x, toxic, prior=0.2)
    z = 1 / (1 + np.exp(-(x * w[0] + w[1])))[:, 0]
    assert (z[:700] > 0.5).mean() > 0.85 and (z[700:] < 0.5).mean() > 0.95


def test_nnpu_risk_is_as_small_as_a_plain_search_finds():
    g = np.random.default_rng(2)
    x = np.concatenate([g.normal(1, 1, 300), g.normal(1, 1, 200), g.normal(-1, 1, 800)])[:, None]
    toxic, prior = np.arange(1300) < 300, 0.2

    def risk(w, b):
        zt, zu = x[toxic, 0] * w + b, x[~toxic, 0] * w + b
        return prior * np.logaddexp(0, -zt).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zt).mean())

    least = min(risk(w, b) for w in np.linspace(0, 5, 60) for b in np.linspace(-5, 2, 60))
    assert risk(*toxicity.fit_nnpu(x, toxic, prior)) <= least * 1.03


def test_features_are_counted_over_all_documents(spark):
    texts = ["Ab-cdefg abcdefg", "abcd, x", None, "", "x x abcdefgh"] + [prose(k, 30) for k in range(60)]
    features = ["=x", "abcd", "=abcdefg", "abcdef", "=none", *sorted(toxicity.doc_features(texts[9]))]
    got, n = toxicity.corpus_hits(spark.createDataFrame(list(enumerate(texts)), DOC).repartition(5), features)
    assert n == len(texts) and got == {f: sum(f in toxicity.doc_features(t or "") for t in texts) for f in features}


def test_toxicity_of_odd_rows(spark):
    """Empty and null texts among labels, labels that disagree, a column named like the result."""
    rows = [(i, f"{prose(i, 30)} {'vilex grubby' if i % 5 == 0 else ''}") for i in range(300)] + [(300, ""), (301, None), (302, " "), (302, " ")]
    labels = [(i, int(i % 5 == 0)) for i in range(300)] + [(5, 0), (5, 1), (5, 1), (300, 1), (301, 1), (302, 0), (None, 1), (9, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("tox_score", F.lit("x")).withColumn("toxic", F.lit("x"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.s for r in toxicity.score(docs, model, out="s").collect()}
    assert set(got) == set(range(303)) and got[300] == got[301] == got[302] < 0.5
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in range(300)]) > 0.97


# language


def test_language_code_lengths_are_exact():
    tree = language.grow(["abab abab", "abc"])
    coder = language.Coder({"x": tree})
    text = "abcab zé"
    data, _ = language.joined([text])
    raw = data[language.ORDER :]
    want, padded = 0.0, b"\n" * language.ORDER + raw

    def counts(ctx: bytes) -> dict:
        out = {}
        for t in ("abab abab", "abc"):
            b = b"\n" * language.ORDER + t.encode()
            for i in range(language.ORDER, len(b)):
                if b[i - len(ctx) : i] == ctx:
                    out[b[i]] = out.get(b[i], 0) + 1
        return out

    for i in range(language.ORDER, len(padded)):
        for k in range(language.ORDER, -1, -1):
            c = counts(padded[i - k : i])
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if padded[i] in c:
                want += np.log2(whole / c[padded[i]])
                break
            want += np.log2(whole / len(c))
        else:
            want += 8
    assert abs(coder.code_lengths([text])[0, 0] - want) < 1e-9
    assert abs(coder.code_lengths([text])[0, 0] - want) < 1e-9  # the second time from the table


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [
            (1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 !!", "de"),
            (6, "the hat", None), (6, "the hat", None)
        ],
        DOC + ", lang string"
    )
    both = docs.where("doc_id in (1, 2)")
    model = {r.lang: language.grow([r.text]) for r in both.collect()}
    got = {r.doc_id: r.x.lang_pred for r in language.identify(docs, model, out="x").collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert {r.x.lang_pred for r in language.identify(docs, {}, out="x").collect()} == {"und"}
    assert language.train(docs.limit(0)) == {}
    assert language.Coder(model).predict(["the " * 200_000])[0] == ["en"]


def test_excess_tells_unknown_scripts_from_short_texts(spark):
    rnd = random.Random(3)
    model = {"x": language.grow([prose(k, 200) for k in range(20)])}
    texts = ["Zyx", "q", prose(99, 40), "日本語のテキスト " * 10, bytes(rnd.randrange(161, 256) for _ in range(300)).decode("latin-1") + "a"]
    _, _, excess = language.Coder(model).explain([*texts, None, "12"])
    assert (excess[:2] < 64).all() and excess[2] < -500 and (excess[3:5] > 64).all() and np.isnan(excess[5:]).all()
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("found", F.lit("clash"))
    got = {r.doc_id: r.found_.excess for r in language.identify(docs, model, out="found_").collect()}
    assert all(abs(got[i] - excess[i]) < 1e-6 for i in got)


def test_samples_are_bounded_where_an_id_repeats(spark, monkeypatch):
    """3000 rows of one id: about as many texts are learned from as were asked for, of about as many bytes."""
    rows = [(1, f"{prose(k, 20)} vilex", "en") for k in range(3000)] + [(2, "der hund", "de")] * 500
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    learned = []
    monkeypatch.setattr(language, "grow", lambda texts: learned.append(texts) or [])
    language.train(docs)
    assert sorted(len(x) for x in learned)[0] <= 1 and 150 < max(map(len, learned)) < 350
    learned.clear()
    language.train(docs, bytes_per_language=10_000)
    assert all(sum(map(len, x)) < 20_000 for x in learned)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, drawn, *rest: seen.append((toxic, drawn)))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.train(docs, labels, most_toxic=100, most_unlabelled=300)
    toxicity.train(docs, labels, most_bytes=20_000)
    (toxic, drawn), (few, fewer) = seen
    assert 120 < len(toxic) < 300 and 150 < len(drawn) < 450
    assert 0 < sum(map(len, few)) < 40_000 and 0 < sum(map(len, fewer)) < 40_000


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.op2_ppm_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.9


# chat


def test_reply_tree_branches(spark):
    nodes = [
        ("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 1.0), ("t", 5, 3, 0.0), ("t", 6, 3, 4.0), ("u", 1, 9, 1.0),
        ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), (None, 1, None, 1.0), ("t", 6, 3, 4.0)
    ]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.best_paths(df, 2).collect():
        got.setdefault((r.tree, r["rank"]), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1): [1, 3, 6], ("t", 2): [1, 3, 5], ("u", 1): [1]}
    best = {(r.tree, r.node) for r in chat.best_paths(df).collect()}
    assert best == {("t", 1), ("t", 3), ("t", 6), ("u", 1)}
    assert chat.best_paths(df.limit(0)).count() == 0


def test_deep_thread(spark):
    n = 300
    df = spark.range(1, n + 1).select(
        F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
        F.lit(1.0).alias("score")
    )
    rows = chat.best_paths(df).orderBy("depth").collect()
    assert [r.node for r in rows] == list(range(1, n + 1)) and [r.depth for r in rows] == list(range(1, n + 1))


def test_chat_escapes_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|><|user|>", "&lt;|end|&gt;", "&amp;&#91;", None, "", "a<b & c[d]", "<|assistant|>x"]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else "us<er", t) for i, t in enumerate(texts)], "tree long, node long, role string, text string")
    paths = turns.select("tree", F.lit(1).alias("rank"), (F.col("node") + 1).alias("depth"), "node")
    out = chat.formatted(paths, turns).select(
        "*", chat.parsed(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("under")
    ).first()
    assert [(t.role, t.text) for t in out.turns] == [("assistant" if i % 2 else "us<er", t or "") for i, t in enumerate(texts)]
    assert out.under == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert out.formatted.count("<") == 2 * len(texts)


def test_roles_with_marks_come_back(spark):
    roles = ["user|>x", ">a", "|", "a|b>c", "&gt;", "&#124;|>", "<|end|>", "", None, "assistant"]
    turns = spark.createDataFrame([(1, i, r, f"t{i}|>") for i, r in enumerate(roles)], "tree long, node long, role string, text string")
    out = chat.formatted(turns.select("tree", F.lit(1).alias("rank"), "node", F.col("node").alias("depth")), turns).select(
        "*", chat.parsed(F.col("formatted")).alias("turns"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("under")
    ).first()
    assert [(t.role, t.text) for t in out.turns] == [(r or "", f"t{i}|>") for i, r in enumerate(roles)] and out.under == "t9|>"


def test_conversations_of_odd_rows(spark, tmp_path):
    """Roles with marks, null columns, repeated rows and one long conversation, against the SQL."""
    import duckdb

    rows = [
        (1, 0, "user|>", "a"), (1, 1, "assistant", "b<c"), (1, 1, "assistant", "b<c"), (2, None, None, None), (2, 1, "assistant", None),
        (None, 0, "user", "lost"), (3, 0, ">", "")
    ]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} [x]") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    same_rows(registry.op3_reply_trees(spark, str(tmp_path)), con.execute(registry.ORACLES["op3_reply_trees"]).df())
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in registry.op3_reply_trees(spark, f"{tmp_path}/none").collect()] == [-7]


# mixing


def edf(ps: list[int], ns: list[int]) -> list[int]:
    """The source of each slot, one after the other, until a source has no block left for its turn."""
    q, done, out = sum(ps), [0] * len(ps), []
    while True:
        t = len(out)
        i = min((-(-(done[i] + 1) * q // p), i) for i, p in enumerate(ps) if p and done[i] * q // p <= t)[1]
        if done[i] == ns[i]:
            return out
        done[i] += 1
        out.append(i)


@pytest.mark.parametrize(
    "weights, sizes, frame",
    [
        ({"a": 0.7004, "b": 0.2996}, {"a": 70100, "b": 30100}, 1000),
        ({"big": 0.5, "mid": 0.25, "small": 0.1, "none": 0}, {"big": 900, "mid": 60, "none": 50, "small": 25, None: 40}, 7),
        (None, {"a": 1, "b": 400, "c": 17, "d": 80, None: 30}, 11),
        ({f"s{k:02}": 1 + k * k for k in range(12)}, {f"s{k:02}": 30 + 20 * k for k in range(12)}, 20)
    ]
)
def test_shares_deviate_by_less_than_a_block(spark, weights, sizes, frame):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n long").select(
        "source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("doc_id")
    )
    got = mixing.mixed(df, weights=weights, frame=frame).toPandas()
    assert len(got) == sum(sizes.values())
    given = {s: round(n**0.5) for s, n in sizes.items()} if weights is None else {s: weights.get(s, 0) for s in sizes}
    got["source"] = got["source"].where(got["source"].notna(), None)
    inside = got[got["in_mix"]].sort_values("slot")
    assert list(inside["slot"]) == list(range(len(inside))) and set(got[~got["in_mix"]]["slot"].isna()) <= {True}
    assert ((inside["released"] <= inside["slot"]) & (inside["slot"] < inside["due"])).all()
    names = list(sizes)
    place = np.array([names.index(s) for s in inside["source"]])
    shares = np.array(list(given.values()), float) / sum(given.values())
    seen = np.cumsum(place[:, None] == np.arange(len(names)), axis=0)
    assert np.abs(seen - np.arange(1, len(place) + 1)[:, None] * shares).max() < 1
    whole = mixing.whole({s: w for s, w in given.items()})
    assert list(place) == edf([whole[s] for s in names], list(sizes.values()))
    assert not len(inside[[not given[s] for s in inside["source"]]])


def test_mixing_blocks_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b"), (3, "b"), (4, "b")], "doc_id long, source string").withColumn("slot", F.lit(9))
    got = mixing.mixed(df, block=2, frame=10).toPandas()
    assert len(got) == 6 and sorted(got[got.source == "a"]["nth"]) == [1, 2, 3] and sorted(got[got.source == "b"]["block"]) == [1, 1, 2]
    assert mixing.mixed(df.limit(0)).count() == 0
    assert {r.in_mix for r in mixing.mixed(df, weights={"a": 0}).collect()} == {False}
    with pytest.raises(ValueError):
        mixing.mixed(df, weights={"a": -1})


def test_mixing_splits_a_hot_id(spark):
    df = spark.range(2500).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source")
    ).unionByName(spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("b").alias("source")))
    got = mixing.mixed(df).toPandas()
    assert sorted(got[got.source == "a"]["nth"]) == sorted(got[got.source == "b"]["nth"]) == list(range(1, 2501)) and got["in_mix"].sum() >= 4999


# licences


def test_ordered_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND!"
    rows = [
        (1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, mit),
        (3, "The software is provided as is, without warranty of any kind."), (4, None), (5, ""),
        (6, "All rights reserved. All rights reserved. Released under the MIT License."), (7, "All Rights Reserved for nobody.")
    ]
    df = spark.createDataFrame(rows, DOC).withColumn("_work", F.lit(1)).withColumn("licences", F.lit("old"))
    got = {r.doc_id: (r.licences, r.unmatched) for r in licences.recognise(df).collect()}
    assert got == {1: (["Apache-2.0"], []), 2: (["MIT"], []), 3: ([], ["MIT-as-is"]), 4: ([], []), 5: ([], []), 6: (["MIT", "Proprietary"], []), 7: ([], [])}
    assert "_work" in licences.recognise(df).columns and licences.recognise(df.limit(0)).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
GPL_TEXT = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * More follows.
 */"""
BSD_TEXT = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:
#
# 1. Redistributions of source code"""
APACHE_TEXT = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0"""


def test_wrapped_licences(spark):
    unwrapped = "\n\n".join(" ".join(p.split()) for p in MIT_TEXT.split("\n\n"))
    rows = [
        (1, MIT_TEXT), (2, unwrapped), (3, GPL_TEXT), (4, BSD_TEXT), (5, APACHE_TEXT), (6, MIT_TEXT.replace("\n", "\r\n")),
        (7, "Released under\n\nthe MIT License"), (8, "Released under. the MIT License"), (9, "x\nAll rights\nreserved\ny")
    ]
    got = {r.doc_id: (r.licences, r.unmatched) for r in licences.recognise(spark.createDataFrame(rows, DOC)).collect()}
    mit = (["MIT"], [])
    assert got == {
        1: mit, 2: mit, 3: (["GPL-3.0-or-later"], []), 4: (["BSD"], []), 5: (["Apache-2.0"], []), 6: mit, 7: ([], []), 8: ([], []),
        9: (["Proprietary"], [])
    }


BSD3_TEXT = """Copyright (c) 2021, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)."""
BSD2_TEXT = BSD3_TEXT[: BSD3_TEXT.index("3. Neither")] + BSD3_TEXT[BSD3_TEXT.index("THIS SOFTWARE") :]
NOTICE = """ * This {what} is free software{mark} you can redistribute it and/or
 * modify it under the terms of the GNU {name} Public
 * License as published by the Free Software Foundation{mark2} either
 * version {v} of the License, or (at your option) any later version.
 *
 * This {what} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {name} Public License for more details.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
MPL_TEXT = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


def test_whole_licences_and_their_sql(spark, duck):
    liable = "\nIN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."
    cases = [
        (MIT_TEXT[: MIT_TEXT.index(" IN NO EVENT")] + liable, "MIT"), (BSD3_TEXT, "BSD-3-Clause,Proprietary"), (BSD2_TEXT, "BSD-2-Clause,Proprietary"), (ISC_TEXT, "ISC"), (MPL_TEXT, "MPL-2.0"),
        (
            NOTICE.format(what="program", mark=":", mark2=",", name="General", v="3"), "GPL-3.0-or-later"
        ), (NOTICE.format(what="program", mark=";", mark2=";", name="General", v="2"), "GPL-2.0-or-later"),
        (
            NOTICE.format(what="library", mark=";", mark2=";", name="Lesser General", v="2.1"), "LGPL-2.1-or-later"
        ), (NOTICE.format(what="program", mark=":", mark2=",", name="Affero General", v="3"), "AGPL-3.0-or-later"),
        (
            APACHE_TEXT + "\n//\n// Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n",
            "Apache-2.0"
        ),
        (
            "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"
        ), ("x = 1\n# SPDX-License-Identifier: MIT\n", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"),
        ("released under the" + " " * 400 + "MIT license.", "MIT"), ("Released under the MIT License for now", ""), ("", ""), (None, ""), ("x " * 100_000 + "\nAll rights reserved", "Proprietary"), (
            "... All rights reserved!!\n-- Licensed under CC BY 4.0\n\n", "CC-BY-4.0,Proprietary"
        ),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], DOC)
    rows = licences.recognise(df).select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_known"),
        *[F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences", "unmatched")]
    )
    assert {r.doc_id: r.licences for r in rows.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    import duckdb

    con = duckdb.connect()
    con.register("documents", df.toPandas())
    same_rows(rows, con.execute(registry.ORACLES["op5_sentence_rules"]).df())


# vectors


def brute(ids, vecs, threshold):
    good = [i for i, v in enumerate(vecs) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {}
    for i in good:
        x = np.array(vecs[i], np.float64)
        x /= np.abs(x).max()
        units[i] = x / np.linalg.norm(x)
    near = np.array([[len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold for j in good] for i in good])
    label = [ids[i] for i in good]
    for _ in good:
        label = [min(label[b] for b in np.flatnonzero(near[a])) for a in range(len(good))]
    out = {i: (0, ids[i]) for i in range(len(ids))}
    out.update({i: (int(near[a].sum()) - 1, label[a]) for a, i in enumerate(good)})
    return out


@pytest.mark.parametrize("cells, kind", [(1, "float"), (5, "float"), (12, "double"), (None, "double")])
def test_vectors_against_brute_force(spark, cells, kind):
    g = np.random.default_rng(3)
    base = g.normal(size=(30, 4))
    vecs = [(base[k % 30] + g.normal(size=4) * 0.25).astype(np.float32).tolist() for k in range(250)]
    vecs += [
        vecs[0], vecs[0], None, [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0],
        [2.0, 4.0], [2.0, -4.0], [3.0], [5.0], [-5.0], []
    ]
    if kind == "double":
        vecs += [[1e200, 1e200, 0.0, 0.0], [1e-200, 1e-200, 0.0, 0.0], [1e200, 0.0, 0.0, 0.0], [5e-324, 5e-324, 0.0, 0.0]]
    ids = list(range(1000, 1000 + len(vecs)))
    df = spark.createDataFrame(list(zip(ids, vecs)), f"vec_id long, embedding array<{kind}>").withColumn("key", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, cells=cells, block=20).collect()}
    want = brute(ids, vecs, 0.9)
    assert len(got) == len(vecs)
    for i, (n, c) in want.items():
        assert got[ids[i]] == (n, c, c == ids[i]), i


def test_vectors_at_the_threshold(spark):
    """Cosines of 0.9 but for rounding get one decision, whatever the blocks; 3 : 4 : 5 gives 0.6 and 0.8 in full."""
    vecs = [[3.0, 4.0], [4.0, 3.0], [0.0, 5.0], [6.0, 8.0], [5.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    for block in (1, 2, 50):
        got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df, threshold=0.8, block=block).collect()}
        assert got == {0: 3, 1: 3, 2: 2, 3: 3, 4: 1}


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(None, [1.0]), (3, None)], "vec_id long, embedding array<float>")
    assert sorted((r.n_links, r.kept) for r in vectors.near_duplicates(one).collect()) == [(0, True), (0, True)]


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(None, 3), (4, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for x in parent}


# tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1 \n\t'<|>endoftx.é日🙂s "), max_size=60), max_size=5))
def test_counts_equal_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_counts_equal_the_library, "counter"):
        test_counts_equal_the_library.counter = token_counts.Counter(path)
    c = test_counts_equal_the_library.counter
    assert c.count(texts) == c.lengths(texts)


def test_token_counts(spark):
    df = spark.createDataFrame([*enumerate(NASTY), (99, None)], DOC).withColumn("n", F.lit(1))
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
    assert [got[i] for i in range(len(NASTY))] == token_counts.Counter(path).lengths(NASTY) and got[99] == 0
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


ENC = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abst1 \n\t'.é日🙂 "), max_size=200), st.integers(1, 9))
def test_tree_reduction_equals_tiktoken(text, leaf):
    ids = byte_bpe.encode(ENC, text, leaf=leaf)
    assert ids == ENC.encode_ordinary(text)
    assert byte_bpe.decode(ENC, ids, leaf=leaf) == text.encode()


def test_bpe_columns(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([*enumerate([*NASTY, prose(1, 20_000), "x" * 100_000]), (99, None)], DOC)
    back = byte_bpe.decode_column(byte_bpe.encode_column(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    dig = byte_bpe.digest_column(back, path, public_tokenizers.PATTERN)
    for r in dig.collect():
        t = r.text or ""
        assert r.ids == ENC.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        assert r.bpe.n_tokens == len(r.ids) and r.bpe.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.digest_column(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_slices_cover_everything():
    texts = ["a" * n for n in (5, 1, 50, 2, 2, 9)]
    parts = list(slices(texts, 10))
    assert [x for i, j in parts for x in range(i, j)] == list(range(6)) and list(slices([], 10)) == []


# near-duplicates of texts


def test_near_duplicate_texts(spark):
    rows, rnd = [], random.Random(11)
    for k in range(40):
        words = prose(k, 150).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.randrange(3)):
            w = list(words)
            w[rnd.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w)))
    common = prose(999, 60)
    for k in range(40):  # a long passage in common and nothing else
        rows.append((len(rows), common + " " + prose(2000 + k, 150)))
    n = len(rows)
    rows += [
        (n, rows[0][1].upper() + "!"), (n + 1, None), (n + 2, ""), (n + 3, " ... "), (n + 4, "one two"), (n + 5, "One, two"), (n + 6, ""),
        (None, "x y z"), (n + 4, "one two")
    ]
    df = spark.createDataFrame(rows, DOC).withColumn("key", F.lit(0)).withColumn("c", F.lit(0))
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert set(got) == set(range(n + 7))
    shingled = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows[:n]}
    for a in range(n):
        for b in range(a):
            j = len(shingled[a] & shingled[b]) / len(shingled[a] | shingled[b])
            if j > 0.85:
                assert got[a][0] == got[b][0]
            if j < 0.5:
                assert got[a][0] != got[b][0]
    assert got[n][0] == 0 and got[n + 5][0] == n + 4 and all(got[n + k] == (n + k, True) for k in (1, 2, 3, 6))
    assert all(kept == (c == i) for i, (c, kept) in got.items())
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_alike_texts_link_in_crowded_keys(spark):
    """One band of one sample: most texts have a sample of the common passage for their only key."""
    common, rows = prose(999, 150), []
    for k in range(40):
        own = prose(3000 + k, 60).split()
        rows.append((len(rows), common + " " + " ".join(own)))
        own[20] = own[35] = own[50] = "edited"
        rows.append((len(rows), common + " " + " ".join(own)))
    df = spark.createDataFrame(rows, DOC)
    counts, n = minhash.document_frequencies(df)
    idf = minhash.smoothed_idf(counts, n)
    keys = {r.doc_id: r["keys"][0] for r in minhash.sampled(df, spark.sparkContext.broadcast(idf), 1, 1).collect()}
    members = list(keys.values())
    words = minhash.Words()
    own = [minhash.shingles(words(t), idf) for _, t in rows]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, bands=1, rows=1).collect()}
    pairs = [(i, i + 1) for i in range(0, len(rows), 2) if keys[i] == keys[i + 1] and members.count(keys[i]) > 24 and minhash.similarity(own[i], own[i + 1]) >= 0.8]
    assert len(pairs) > 5
    assert all(got[a] == got[b] for a, b in pairs)


def weighted_classes(rows: list[tuple], spark, threshold: float) -> tuple[dict, list]:
    """Classes by brute force over all pairs of (id, text), and the pairs with their similarities from threshold on."""
    counts, n = minhash.document_frequencies(spark.createDataFrame(rows, DOC))
    idf, words = minhash.smoothed_idf(counts, n), minhash.Words()
    own = {i: minhash.shingles(words(t), idf) for i, t in rows if t}
    label, pairs, ids = {i: i for i, _ in rows}, [], sorted(own)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            weight = {**dict(zip(own[b][0].tolist(), own[b][1].tolist()))}
            less = sum(min(w, weight[h]) for h, w in zip(own[a][0].tolist(), own[a][1].tolist()) if h in weight)
            whole = own[a][1].sum() + own[b][1].sum() - less
            if whole and less / whole >= threshold:
                pairs.append((a, b, less / whole))
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    return label, pairs


@pytest.mark.parametrize("block, block_bytes", [(512, 1 << 22), (3, 3000)])
def test_near_duplicates_equal_brute_force(spark, block, block_bytes):
    """Groups of near copies without their original, so that many pairs lie just above or below 0.8."""
    rows, rnd = [], random.Random(23)
    for k in range(8):
        words = prose(k, 120).split()
        for _ in range(12):
            w = list(words)
            for at in rnd.sample(range(len(w)), rnd.randrange(1, 4)):
                w[at] = f"edit{rnd.randrange(1000)}"
            rows.append((len(rows), " ".join(w + w[: rnd.randrange(3) * 10])))
    want, pairs = weighted_classes(rows, spark, 0.8)
    assert sum(s < 0.85 for *_, s in pairs) > 20
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), block=block, block_bytes=block_bytes).collect()}
    assert sum(got[a] == got[b] for a, b, _ in pairs) / len(pairs) > 0.999 and got == want


def test_repeated_ids_are_one_document(spark):
    a, b = prose(1, 60), prose(2, 60)
    long = prose(3, 60_000)
    rows = [(1, max(a, b)), (1, min(a, b)), (1, None), (2, max(a, b)), (3, min(a, b)), (4, None), (4, None), (5, long), (6, long + " end")]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True), 6: (5, False)}


def test_samples_agree_as_often_as_texts_are_alike():
    idf = np.ones(minhash.WORD_BUCKETS)
    words = minhash.Words()
    a = prose(1, 400).split()
    b = a[:250] + prose(2, 150).split()
    x, y = (minhash.shingles(words(" ".join(t)), idf) for t in (a, b))
    s = minhash.Sampler(2000)
    assert abs((s(*x) == s(*y)).mean() - minhash.similarity(x, y)) < 0.05


# media


def test_html_keeps_order_and_captions():
    page = '<title>T</title><script>no("<p>")</script><p>one <b>two</b></p><figure><img src="sha256:ab" alt="old"><figcaption>new &amp; true</figcaption></figure>tail<img src="http://x"><img>'
    got = [(x["pos"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.sequence(page)]
    assert got == [
        (0, "text", "T", None, None), (1, "text", "one two", None, None), (2, "media", None, "ab", "new & true"),
        (3, "text", "tail", None, None), (4, "media", None, None, None), (5, "media", None, None, None)
    ]


@pytest.mark.parametrize("text", ["", "a", "é" * 288, "é" * 289, "x" * 5000])
def test_payload_round_trip(text):
    data = media.payload(text)
    assert len(data) % 576 == 0 and len(data) > 0 and media.samples(media.stored(data)) == data and data.rstrip(b"\xff") == text.encode()


def test_resolve_keeps_places(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], DOC)
    store = cut(media.media_of_texts(docs), "media")
    d = {r.id: r.digest for r in store.collect()}
    assert d[1] == d[3]
    pages = spark.createDataFrame(
        [(1, f'<p>x</p><img src="sha256:{d[1]}"><img src="sha256:gone" alt="c"><p>y</p>'), (2, None)], "page_id long, html string"
    ).withColumn("text", F.lit("clash"))
    got = media.resolve(media.interleaved(pages), media.features(store)).orderBy("page_id", "pos").collect()
    assert [(r.pos, r.kind, r.caption, r.payload_bytes) for r in got] == [
        (0, "text", None, None), (1, "media", None, 576), (2, "media", "c", None), (3, "text", None, None)
    ]
    assert media.interleaved(pages.limit(0)).count() == 0


def test_media_query_reads_back(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.op10_media_sequences(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows[:200]:
        data = media.payload(texts[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-32:])


def test_media_query_against_plain_code(spark, tmp_path):
    texts = ["", None, "a", "é" * 288, "é" * 289, "x" * 700_000, "a", "𝄞\x00\xff"]
    df = spark.createDataFrame(
        [*[(i, t) for i, t in enumerate(texts)], (None, "no id")], DOC
    ).withColumn("media", F.lit("clash")).withColumn("feature", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op10_media_sequences(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "no id")]:
        raw = (t or "").encode()
        data = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        form = b"P5\n576 " + str(len(data) // 576).encode() + b"\n255\n" + data
        r, x = got[i], list(data)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(data), len(form))
        assert (r.payload_sha256, r.media_sha256, r.tail_crc32) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(form).hexdigest(), zlib.crc32(data[-32:]))
        assert r.feature == f"{len(data) // 576}x576:{sum(x) * 1000 // len(x)}:{sum(abs(a - b) for a, b in zip(x, x[1:])) * 1000 // len(x)}"
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.op10_media_sequences(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["op1_nnpu_toxicity", "op2_ppm_language", "op4_pfair_mixing", "op5_sentence_rules", "op7_token_counts", "op8_byte_bpe"])
def test_document_queries_on_odd_rows(spark, tmp_path, name):
    """Nulls in every column, empty and long texts, repeated rows; then an empty table."""
    rows = [
        (1, "the cat sat", "en", "a"), (1, "the cat sat", "en", "a"), (2, None, None, None), (3, "", "en", None), (None, None, None, "a"),
        (None, "der hund", "de", "b"), (4, "x" * 300_000, "de", "b"), (5, "word " * 60_000, "en", "b"), (6, "12 !!", None, "a")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for at, part in (("some", df), ("none", df.limit(0))):
        part.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{at}/labels.parquet")
    got = registry.QUERIES[name](spark, f"{tmp_path}/some").collect()
    assert len(got) == len(rows) and sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1, 2, 3, 4, 5, 6]
    assert registry.QUERIES[name](spark, f"{tmp_path}/none").count() == 0
    if name == "op7_token_counts":
        count = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json")).lengths
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got if r.doc_id} == {i: (len((t or "").encode()), count([t or ""])[0]) for i, t, *_ in rows if i}


def test_fresh(spark):
    assert fresh(spark.range(1).select(F.lit(1).alias("A"), F.lit(2).alias("a_")), "a") == "a__"


@pytest.mark.parametrize("share", [0, 6])
def test_rows_dealt_in_crowded_keys_grow_with_their_members(spark, share):
    """Texts that quote one passage, a few of them with a near copy; share is the number of members of a component beside them."""
    dealt = []
    for n in (400, 800, 1600):
        common, rows = prose(999, 40), []
        for k in range(n):
            own = prose(5000 + k, 60).split()
            rows.append((len(rows), common + " " + " ".join(own)))
            if k % 100 == 0:
                own[30] = "edited"
                rows.append((len(rows), common + " " + " ".join(own)))
        first = len(rows)
        rows += [(first + k, prose(4999, 100)) for k in range(share)]
        df = spark.createDataFrame(rows, DOC)
        idf = spark.sparkContext.broadcast(minhash.smoothed_idf(*minhash.document_frequencies(df)))
        members = df.select(F.lit(1).cast("long").alias("key"), "doc_id", F.least("doc_id", F.lit(first)).cast("long").alias("c"), F.length("text").cast("long").alias("size"))
        dealt.append(minhash.dealt_members(members, df, idf, 0.8, 64, 1 << 22).count())
        links = {tuple(sorted((r.a, r.b))) for r in minhash.crossing(members, df, idf, 0.8, 64, 1 << 22).collect()}
        assert links == {(101 * k, 101 * k + 1) for k in range(n // 100)}
    assert all(b < 2.5 * a for a, b in zip(dealt, dealt[1:])), dealt


def test_rest_meets_the_whole_main_component(spark):
    """A main component over several blocks and a rest over several: every link between them, and within the rest, is found."""
    rnd, words, rows = random.Random(5), prose(1, 200).split(), []
    for k in range(40):
        w = list(words)
        for at in rnd.sample(range(len(w)), rnd.randrange(1, 5)):
            w[at] = f"edit{rnd.randrange(1000)}"
        rows.append((k, " ".join(w)))
    idf = minhash.smoothed_idf(*minhash.document_frequencies(spark.createDataFrame(rows, DOC)))
    own = [minhash.shingles(minhash.Words()(t), idf) for _, t in rows]
    shared = spark.sparkContext.broadcast(idf)
    df = spark.createDataFrame(rows, DOC)
    members = df.select(F.lit(1).cast("long").alias("key"), "doc_id", F.when(F.col("doc_id") < 22, 0).otherwise(F.col("doc_id")).cast("long").alias("c"), F.length("text").cast("long").alias("size"))
    got = {(r.a, r.b) for r in minhash.crossing(members, df, shared, 0.8, 4, 1 << 22).collect()}

    def joined(links):
        label = {i: 0 if i < 22 else i for i in range(40)}
        for a, b in links:
            x, y = sorted((label[a], label[b]))
            label = {i: x if c == y else c for i, c in label.items()}
        return label

    pairs = [(a, b) for a in range(40) for b in range(a) if minhash.similarity(own[a], own[b]) >= 0.8]
    assert joined(got) == joined(pairs) and all(minhash.similarity(own[a], own[b]) >= 0.8 for a, b in got)
