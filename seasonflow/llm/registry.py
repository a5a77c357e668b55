"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seasonflow.llm import byte_bpe, chat, language, licences, media, minhash, mixing, oracles, page_kit, pages, runs, token_counts, toxicity, vectors, whitening
from seasonflow.llm.common import cut, is_held_out, read


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="score")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs.select("doc_id", "text"), language.train(docs), out="found")
    return named.select("doc_id", is_held_out().alias("held_out"), "found.lang_pred", "found.score")


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are trees whose turns answer the turn before; conversation -7 holds a template's own marks.

    Rows without a conv_id belong to no conversation; null roles and texts are empty.
    """
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = cut(
        rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", F.coalesce("text", F.lit("")).alias("text")),
        "turns"
    )
    nodes = turns.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.log1p(F.char_length("text").cast("double")).alias("score")
    )
    out = chat.formatted(chat.best_paths(nodes), turns)
    said = chat.parsed(F.col("formatted"))
    flat = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.under_loss(F.col("formatted"), F.col("loss"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(said).cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op5_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"), F.array_join("unmatched", ",").alias("unmatched")
    )


def op6_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest_column(docs, path, public_tokenizers.PATTERN).select("doc_id", "bpe.*")


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page that shows its text's stored form; what follows is read back through the page."""
    stored = cut(media.media_of_texts(read(spark, sf_dir, "documents")), "media")
    name = F.concat(F.lit("document "), F.coalesce(F.col("id").cast("string"), F.lit("")))
    page = F.concat(
        F.lit("<article><p>"), name, F.lit(f'</p><figure><img src="{media.REF}'), F.col("digest"), F.lit('"><figcaption>'), name,
        F.lit("</figcaption></figure></article>")
    )
    shown_in = media.interleaved(stored.select(F.col("id").alias("doc_id"), "n_bytes", page.alias("html")))
    shown = media.resolve(shown_in.select("doc_id", "n_bytes", "items"), cut(media.features(stored), "features")).where("kind = 'media'")
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth text, by a hash of its id, repeats its words from a drawn place on with a drawn period."""
    spans = r"([^\x20\x09-\x0D]+)"
    whole = F.coalesce(F.regexp_extract_all("text", F.lit(spans), F.lit(1)), F.array().cast("array<string>"))
    docs = read(spark, sf_dir, "documents").select("doc_id", whole.alias("words"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    sized = docs.select("*", F.size("words").cast("long").alias("n"), F.expr("h div 10").alias("g"))
    drawn = sized.select("*", F.expr("if(h % 10 = 0 and n > 0, g % n, null)").alias("a")).select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    root = F.expr("slice(words, int(a) + 1, int(p))")
    tail = F.slice(F.flatten(F.array_repeat(root, F.expr("int((n - a + p - 1) div p)"))), F.lit(1), F.expr("int(n - a)"))
    planted = F.when(F.col("a").isNull(), F.col("words")).otherwise(F.concat(F.expr("slice(words, 1, int(a))"), tail))
    found = runs.periodic_runs(drawn.select("doc_id", F.array_join(planted, " ").alias("text"))).select("doc_id", "periodic.runs", "periodic.collapsed")
    best = F.expr(
        "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), "
        "(b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "runs"
    )


def op12_crf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field is trained on 600 drawn pages whose main text is known: the table has no labels."""
    model = pages.train(page_kit.labelled_pages(600))
    return pages.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model).select(
        "page_id", "url", "main.text", F.char_length("main.text").cast("long").alias("n_chars"), "main.n_blocks", "main.n_kept"
    )


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = whitening.whiten(vecs, whitening.fit(vecs), out="white").select("vec_id", "white.*")
    by_component = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return by_component.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error", "deviation_exact"
    )


QUERIES = {f.__name__: f for f in (
    op1_nnpu_toxicity, op2_ppm_language, op3_reply_trees, op4_pfair_mixing, op5_sentence_rules, op6_spherical_kmeans, op7_token_counts,
    op8_byte_bpe, op9_weighted_minhash, op10_media_sequences, op11_periodic_runs,
    op12_crf_pages, op13_jacobi_whitening
)}
ORACLES: dict[str, str] = {
    "op3_reply_trees": oracles.REPLY_TREES, "op4_pfair_mixing": oracles.PFAIR,
    "op5_sentence_rules": oracles.sentence_rules(licences.SENTENCES, licences.RULES)
}
