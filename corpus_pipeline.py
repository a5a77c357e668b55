"""A corpus pipeline: five stages over documents, each written as Parquet and reread by the next one.

toxicity -> language -> near-duplicates -> mixing -> byte-level BPE. The first four return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonflow.llm import byte_bpe, language, minhash, mixing, toxicity
from seasonflow.llm.common import cut, fresh, read

TOXIC_FROM = 0.5
#: A text is in none of the languages where its best code is longer than its plain bytes by more than UNEXPLAINED_RATE bits
#: a byte; UNEXPLAINED_BITS are for its first bytes, which have no context. Documents of sf0.1 take some 5 to 6 bits a byte
#: less than plain ones on average; the worst one of over 2 bytes takes 0.54 more.
UNEXPLAINED_RATE, UNEXPLAINED_BITS = 1.0, 8.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; the classifier learns from the labels table and these documents."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    own = fresh(docs, "score")
    return toxicity.score(docs, model, out=own).where(F.col(own) < TOXIC_FROM).drop(own)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found: those whose text is null, has no letter, or isn't explained by any language go."""
    own = fresh(docs, "found")
    named = language.identify(docs, language.train(docs), out=own)
    explained = F.col(f"{own}.excess") <= UNEXPLAINED_BITS + UNEXPLAINED_RATE * F.octet_length("text")
    return named.where((F.col(f"{own}.lang_pred") != "und") & explained).drop(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates.

    Of rows that repeat an id the one with the smallest text stays, then the smallest by the other columns in their
    order. Rows without an id can't be told apart from others and stay.
    """
    gone = cut(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "gone")
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)
    again = cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    one = F.min(F.struct(F.col("text").isNull().alias("no_text"), "text", F.struct(*docs.columns).alias("row"))).alias("first")
    several = named.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("first.row.*")
    return named.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(several).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix; documents beyond its end follow by the slots at which they would be due.

    So where a source has run out, its slots pass to the others by their shares. Rows that repeat an id take its first place. Rows without an id can't be told apart and are dealt over the mix by
    their texts. The order is that of the written rows, file by file; no column holds it.
    """
    own = fresh(docs, "place")
    places = cut(mixing.mixed(docs).groupBy("doc_id").agg(F.min(F.coalesce("slot", "due")).alias(own)), "places")
    span = fresh(docs, "span")
    last = places.agg((F.coalesce(F.max(own), F.lit(0)) + 1).alias(span))
    # a merge join at every size: the places grow with the documents
    named = docs.where("doc_id is not null").join(places.hint("merge"), "doc_id").select(*docs.columns, own)
    nameless = docs.where("doc_id is null").crossJoin(F.broadcast(last)).select(*docs.columns, F.pmod(F.xxhash64("text"), span).alias(own))
    return named.unionByName(nameless).orderBy(own).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest_column(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "bpe.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Classifiers and similarity joins are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents; each stage's result is written to the shared folder and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
