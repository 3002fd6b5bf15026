"""Streams of rows: extensions beyond the rules for files, with the same expressions.

States are bounded by watermarks; nothing is kept for rows older than that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators.duplicates import compared_columns


def clean_rows(stream: DataFrame, dates: list[str] = ()) -> DataFrame:
    """Text without outer white space, null for text that stands for missing, dates in ISO form; row by row."""
    out = {}
    for c, t in stream.dtypes:
        if t == "string":
            x = E.strip(c)
            out[c] = E.normalize_date(x) if c in dates else F.when(~E.is_missing(x), x)
    return stream.withColumns(out)


def windowed_quality(stream: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", columns: list[str] | None = None) -> DataFrame:
    """(window, column, rows, missing, outer_space, numeric) of each tumbling window; rows later than `late` don't count."""
    cols = columns or [c for c, t in stream.dtypes if t == "string"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), E.col(c).alias("v")) for c in cols)))
    flat = stream.withWatermark(time_col, late).select(E.col(time_col).alias("t"), cells.alias("s")).select("t", "s.*")
    count = lambda p: F.count_if(F.coalesce(p, F.lit(False)))
    return flat.groupBy(F.window("t", window), "column").agg(F.count("*").alias("rows"), count(E.is_missing("v")).alias("missing"), count(E.has_outer_space("v")).alias("outer_space"), count(E.num("v").isNotNull()).alias("numeric"))


def drop_repeats(stream: DataFrame, time_col: str, late: str = "10 minutes") -> DataFrame:
    """Without rows that repeat an earlier one of the last `late`, ids and the time left out."""
    cols = [c for c in compared_columns(stream.columns) if c != time_col]
    key = F.xxhash64(*(E.strip(E.col(c).cast("string")) for c in cols))
    return stream.withWatermark(time_col, late).withColumn("_repeat", key).dropDuplicatesWithinWatermark(["_repeat"]).drop("_repeat")


def each_batch(stream: DataFrame, analyse: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a full analysis on each micro-batch; returns the query."""
    return stream.writeStream.foreachBatch(analyse).option("checkpointLocation", checkpoint).start()
