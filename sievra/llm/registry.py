"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding, fingerprint, language, license, lm, packing, simhash, suffix, toxicity
from .common import crc_mod, load

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), BYTE_BPE)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), WORD_BPE)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.learn(docs.filter(crc_mod("doc_id", 3) != 1))
    found = language.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(load(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(load(spark, sf_dir, "embeddings"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(load(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(load(spark, sf_dir, "documents"), 200, rest="none")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"), width=4, words64=1, max_bits=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lm.learn(lm.read(load(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2))
    return lm.score(model.coded, model).withColumn("held_out", crc_mod("doc_id", 7) == 2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_round_trip, op2_packing, op3_language_id, op4_license_scan, op5_embedding_near_dedup, op6_fingerprints, op7_suffix_dedup, op8_toxicity, op9_simhash_near_dedup, op10_lm_scoring)
}
ORACLES: dict[str, str] = {"op4_license_scan": license.oracle()}
