"""Near-duplicate values of a column: a similarity join that meets pairs by shared tokens.

The similarity is 0.4 * edit similarity + 0.6 * token overlap. Values without a common token reach 0.4 at most, so for
any threshold above that (others are refused) the pairs that can qualify share a token, or both have none. Values are compared once however
often they occur; a pair meets under each common token and is kept under the smallest of those it has. Tokens that very
many values share are dealt by both sides' hash chunks, so that no task holds all pairs of a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vocab as V

NONE = "∅"
#: Values of a token that meet in one task.
CHUNK = 2000


def _value(column: str) -> Column:
    """A cell as the join sees it: without blanks and tabs at the ends, empty for null."""
    return F.btrim(F.coalesce(E.col(column).cast("string"), F.lit("")), F.lit(" \t"))


def value_pairs(df: DataFrame, column: str, threshold: float = V.FUZZY_THRESHOLD, case_pairs: bool = False) -> DataFrame:
    """(value_a, value_b, similarity) of different values, value_a < value_b; values that differ in case only don't count."""
    values = df.select(_value(column).alias("v")).distinct()
    values = values.withColumn("norm", E.fuzzy_norm("v"))
    values = values.withColumn("tokens", F.sort_array(E.fuzzy_tokens(F.col("norm"))))
    if threshold <= 0.4:
        raise ValueError("at 0.4 or below, values without a common token can qualify, and all pairs would have to be compared")
    posted = values.withColumn("token", F.explode(F.when(F.size("tokens") == 0, F.array(F.lit(NONE))).otherwise(F.col("tokens"))))
    long_ = posted.groupBy("token").count().filter(F.col("count") > CHUNK).select("token", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    posted = posted.join(long_, "token", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    a = posted.withColumn("i", own).withColumn("j", F.explode(every)).select("token", "i", "j", *(F.col(c).alias(f"{c}_a") for c in values.columns))
    b = posted.withColumn("j", own).withColumn("i", F.explode(every)).select("token", "i", "j", *(F.col(c).alias(f"{c}_b") for c in values.columns))
    pairs = a.join(b, ["token", "i", "j"]).filter("v_a < v_b")
    # under the first common token only, and only where the overlap can be enough
    common = F.array_intersect("tokens_a", "tokens_b")
    pairs = pairs.filter((F.size(common) == 0) | (F.get(common, F.lit(0)) == F.col("token")))
    pairs = pairs.filter(E.jaccard(F.col("tokens_a"), F.col("tokens_b")) >= (threshold - 0.4) / 0.6 - 1e-12)
    if not case_pairs:
        pairs = pairs.filter(F.lower("v_a") != F.lower("v_b"))
    sim = 0.4 * E.edit_similarity(F.col("norm_a"), F.col("norm_b"), F.col("v_a"), F.col("v_b")) + 0.6 * E.jaccard(F.col("tokens_a"), F.col("tokens_b"))
    return pairs.select(F.col("v_a").alias("value_a"), F.col("v_b").alias("value_b"), sim.alias("similarity")).filter(F.col("similarity") >= threshold)


def row_pairs(df: DataFrame, column: str, row_id: str, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """(column, row_a, row_b, value_a, value_b, similarity) of rows, row_a < row_b: value_pairs() for every pair of rows."""
    rows = df.select(E.col(row_id).alias("r"), _value(column).alias("v"))
    pairs = value_pairs(df, column, threshold)
    x = pairs.join(rows.select(F.col("r").alias("r1"), F.col("v").alias("value_a")), "value_a").join(rows.select(F.col("r").alias("r2"), F.col("v").alias("value_b")), "value_b")
    first = F.col("r1") < F.col("r2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return x.select(F.lit(column).alias("column"), pick("r1", "r2").alias("row_a"), pick("r2", "r1").alias("row_b"), pick("value_a", "value_b").alias("v1"), pick("value_b", "value_a").alias("v2"), "similarity").withColumnsRenamed({"v1": "value_a", "v2": "value_b"})


def partner_counts(df: DataFrame, column: str, row_id: str, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """(row id, near_rows): for each row the number of rows whose value is a near-duplicate of its own."""
    counts = df.select(_value(column).alias("v")).groupBy("v").count()
    pairs = value_pairs(df, column, threshold).select("value_a", "value_b")
    both = pairs.unionByName(pairs.select(F.col("value_b").alias("value_a"), F.col("value_a").alias("value_b")))
    near = both.join(counts, F.col("value_b") == F.col("v")).groupBy("value_a").agg(F.sum("count").alias("near_rows"))
    rows = df.select(E.col(row_id), _value(column).alias("_v"))
    return rows.join(near, F.col("_v") == F.col("value_a"), "left").select(E.col(row_id), F.coalesce("near_rows", F.lit(0)).alias("near_rows"))


def pair_counts(df: DataFrame, column: str, threshold: float = V.FUZZY_THRESHOLD, pairs: DataFrame | None = None) -> DataFrame:
    """(column, pairs, similarity): number and mean similarity of row pairs, from the values' counts, without the pairs.

    pairs: value_pairs() of the column, if they are there already.
    """
    counts = df.select(_value(column).alias("v")).groupBy("v").count()
    pairs = value_pairs(df, column, threshold) if pairs is None else pairs
    x = pairs.join(counts.select(F.col("v").alias("value_a"), F.col("count").alias("n1")), "value_a").join(counts.select(F.col("v").alias("value_b"), F.col("count").alias("n2")), "value_b")
    n = F.col("n1") * F.col("n2")
    return x.agg(F.lit(column).alias("column"), F.coalesce(F.sum(n), F.lit(0)).alias("pairs"), (F.sum(n * F.col("similarity")) / F.sum(n)).alias("similarity"))
