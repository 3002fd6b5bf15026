"""Cleaning of a corpus in stages; each stage works on all documents that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs, whatever
other columns there are and however they are called. Null and empty texts: the first stage rejects them, as it does
texts without letters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievra.llm import language, packing, simhash, suffix, toxicity
from sievra.llm.common import load, release, short_batches, stage, staged

#: A document goes if it is toxic with this probability.
TOXIC_SCORE = 0.7


def apart(step: Callable[[SparkSession, DataFrame, str, dict[str, str]], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Calls a step with columns under names of their own, so that none clashes; the step gets {name: name there}."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        return step(spark, docs.toDF(*names.values()), sf_dir, names).select(*names.values()).toDF(*names)

    return run


@apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, at: dict[str, str]) -> DataFrame:
    """Rejects documents without a language and those in which an unknown one prevails; those in several known ones stay.
    Where lang is null, the language found is filled in."""
    text, lang = at["text"], at["lang"]
    model = language.learn(docs, text_col=text, lang_col=lang)
    found = language.identify(docs, model, keep=docs.columns, text_col=text)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("unknown") <= 0.5))
    return kept.withColumn(lang, F.coalesce(lang, "lang_pred"))


@apart
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, at: dict[str, str]) -> DataFrame:
    """Rejects documents that are toxic by a machine trained on the labelled ones among them."""
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), "toxic")
    model = toxicity.learn(docs, labels, id_col=at["doc_id"], text_col=at["text"])
    return toxicity.score(docs, model, keep=docs.columns, text_col=at["text"]).filter(F.col("score") < TOXIC_SCORE)


@apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, at: dict[str, str]) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the document with the smallest id stays;
    of several with that id, the one whose columns hash least, so that it is the same one each time."""
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # maps have no hash
    row = F.struct(F.col(at["doc_id"]).alias("id"), F.xxhash64(at["text"]).alias("key"), F.xxhash64(*plain).alias("all"))
    found = simhash.near_duplicates(docs.select(row.alias("row"), F.col(at["text"]).alias("text")), id_col="row")
    found = stage(found.select("row", "component"), "groups")
    losers = found.filter("row != component").select(F.col("row").alias("lost")).distinct()
    kept = docs.withColumn("row", row).join(losers, F.col("row").eqNullSafe(F.col("lost")), "left_anti")
    return kept.dropDuplicates(["row"]) if found.groupBy("row").count().filter("count > 1").head(1) else kept


@apart
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, at: dict[str, str]) -> DataFrame:
    """Removes strings of 200 bytes that occur twice. A character that is cut goes as a whole."""
    others = [c for c in docs.columns if c not in (at["text"], at.get("n_chars"))]
    found = suffix.remove_repeats(docs, 200, id_col=at["doc_id"], text_col=at["text"], keep=others, rest="text")
    found = found.withColumn(at["text"], F.col("kept_text"))
    return found.withColumn(at["n_chars"], F.length("kept_text").cast(docs.schema[at["n_chars"]].dataType)) if "n_chars" in at else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in sequences of 4096."""
    short_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", remove_repeated_passages),
    ("packing", pack),
]
#: SQL has no counterpart of the trained stages; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs, first = load(spark, sf_dir, "documents"), staged()
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        release(keep=1, first=first)
    return STAGES[-1][1](spark, docs, sf_dir)
