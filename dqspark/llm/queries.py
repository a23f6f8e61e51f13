"""Registered queries of the language-model data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import (
    bpe, language, merkle, negatives, packing, pii, quality, rules, scoring, simhash, toxicity, vectors, warc,
)
from dqspark.llm.text import fold, table

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


@query
def op4_language(spark, d):
    docs = table(spark, d, "documents")
    model = language.train(docs.where(fold(5) != 0))
    return language.predict(docs, model, held_out=F.coalesce(fold(5) == 0, F.lit(False)))


@query
def op5_quality_rules(spark, d):
    judged = rules.judge(table(spark, d, "documents"), table(spark, d, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "anomaly")


@query
def op6_quality_classifier(spark, d):
    docs = table(spark, d, "documents")
    weights = quality.train(docs, table(spark, d, "labels").where(fold(3) != 1))
    return quality.score(docs, weights, held_out=F.coalesce(fold(3) == 1, F.lit(False)))


@query
def op7_toxicity(spark, d):
    docs = table(spark, d, "documents")
    crf = toxicity.train(docs, table(spark, d, "labels").where(fold(4) != 2))
    return toxicity.score(docs, crf, held_out=F.coalesce(fold(4) == 2, F.lit(False)))


@query
def op2_simhash(spark, d):
    grouped = simhash.group(table(spark, d, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_bpe(spark, d):
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, d, "documents"), path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_lm_score(spark, d):
    docs = table(spark, d, "documents")
    return scoring.score(docs, held_out=F.coalesce(fold(7) == 2, F.lit(False)), learn=fold(7) != 2)


@query
def op1_pii(spark, d):
    found = pii.find(table(spark, d, "documents"))
    return found.select(
        "doc_id", *[F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(pii.written(*[F.col(k.name) for k in pii.BASE]), 256).alias("base_sha256"),
        pii.written(*[F.col(k.name) for k in pii.KINDS]).alias("spans"), F.size("iban").cast("bigint").alias("n_iban"),
        F.coalesce(F.array_max(F.transform(F.concat(*[F.col(k.name) for k in pii.KINDS]), lambda s: s["score"])),
                   F.lit(0.0)).alias("top_score"))


@query
def op10_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query
def op8_embedding_dedup(spark, d):
    return vectors.group(table(spark, d, "embeddings"))


@query
def op11_warc(spark, d):
    found = warc.read(warc.write(table(spark, d, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op12_hard_negatives(spark, d):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(table(spark, d, "embeddings"), moved)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query
def op13_merkle(spark, d):
    tampered = F.when(fold(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    made = merkle.build(table(spark, d, "documents"), tampered)
    folded, path = merkle.fold(F.col("altered"), F.col("path")), F.col("path")
    return made.rows.select(
        "doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"),
        F.sha2(merkle.proof(path), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
