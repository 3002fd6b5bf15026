"""Rows that repeat earlier ones, whatever their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..functions import vocab as V
from ..sources.tables import ROW


def compared_columns(columns: list[str]) -> list[str]:
    """All columns but those whose names look like ids."""
    return [c for c in columns if c != ROW and not V.hinted(c, V.ID_HINTS)]


def _keys(df: DataFrame):
    """Compared values without white space at the ends; nulls are equal to each other."""
    return F.struct(*(E.strip(E.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(compared_columns(df.columns))))


def duplicate_flags(df: DataFrame) -> DataFrame:
    """The rows with `_duplicate`: whether an earlier row has the same compared values. df has row ids."""
    if not compared_columns(df.columns):
        return df.withColumn("_duplicate", F.lit(False))
    # the first of each group is an aggregate; a large group is met in a join, which adaptive execution can split
    firsts = df.groupBy(_keys(df).alias("k")).agg(F.min(ROW).alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = df.withColumn("_k", _keys(df)).join(firsts, F.col("_k") == F.col("k"), "left")
    return marked.withColumn("_duplicate", F.coalesce(F.col(ROW) > F.col("first"), F.lit(False))).drop("_k", "k", "first", "n")


def duplicate_flags_by_window(df: DataFrame) -> DataFrame:
    """The same by a window, for tables in which no row repeats very often."""
    if not compared_columns(df.columns):
        return df.withColumn("_duplicate", F.lit(False))
    order = Window.partitionBy(_keys(df)).orderBy(ROW)
    return df.withColumn("_duplicate", F.row_number().over(order) > 1)


def count_duplicates(df: DataFrame) -> int:
    if not compared_columns(df.columns):
        return 0
    return int(df.groupBy(_keys(df)).count().agg(F.sum(F.col("count") - 1)).first()[0] or 0)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Without rows that repeat earlier ones."""
    return duplicate_flags(df).filter("not _duplicate").drop("_duplicate")
