"""Reading and writing tables of text, and numbering their rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E

ROW = "_row_id"


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without white space at their ends."""
    return df.toDF(*(c.strip() for c in df.columns))


def nulls_from_tokens(df: DataFrame) -> DataFrame:
    return df.select(*(E.na_to_null(c).alias(c) if t == "string" else E.col(c) for c, t in df.dtypes))


def read_csv(spark: SparkSession, path: str, row_ids: bool = False, multi_line: bool = True) -> DataFrame:
    """All columns as text. Usual null tokens are null, names are stripped, quoted line ends belong to their field.

    multi_line=False lets large files be split among tasks; fields must then not hold line ends.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)
    df = nulls_from_tokens(clean_headers(df))
    return with_row_ids(df) if row_ids else df


def read_parquet(spark: SparkSession, path: str, row_ids: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return with_row_ids(df) if row_ids else df


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, as the CSV reader gives them."""
    return df.select(*(E.col(c).cast("string").alias(c) for c in df.columns))


def with_row_ids(df: DataFrame, exact: bool = True) -> DataFrame:
    """The place of each row, from 0. exact=False: numbers that only rise with the place, without a job.

    Rows are counted per partition; the driver holds one number for each partition.
    """
    marked = df.withColumn(ROW, F.monotonically_increasing_id())
    if not exact:
        return marked
    part = F.shiftright(ROW, 33)
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part.alias("p")).count().collect())
    before, pairs = 0, []
    for p, n in counts:
        pairs.append((int(p), before))
        before += n
    if not pairs:
        return marked
    start = F.create_map(*(F.lit(x) for pair in pairs for x in pair)) if len(pairs) <= 256 else None
    inside = F.col(ROW).bitwiseAND(F.lit((1 << 33) - 1))
    if start is not None:
        return marked.withColumn(ROW, F.element_at(start, part) + inside)
    offsets = df.sparkSession.createDataFrame(pairs, "_part long, _before long")  # one row a partition
    return marked.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(ROW, F.col("_before") + inside).drop("_part", "_before")


def texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text, null as empty text."""
    return df.select(*(F.coalesce(E.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers, null where a value is none."""
    return df.select(*(E.num(E.col(c).cast("string")).alias(c) for c in columns))


def complete_rows(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows whose listed columns are all numbers, as numbers."""
    rows = df.select(*(E.col(c) for c in keep or []), *(E.num(E.col(c).cast("string")).alias(c) for c in columns))
    return rows.dropna(subset=columns)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; null is empty, white space and quotes come back as they are."""
    df.write.mode(mode).csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="", escape='"')


def write_json(df: DataFrame, path: str, places: int = 6, mode: str = "overwrite") -> None:
    """One JSON object a row; doubles rounded."""
    cols = [F.round(E.col(c), places).alias(c) if t == "double" else E.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).json(path)


def check_upload(path: str, most_bytes: int = 100 << 20) -> None:
    """Refuses files that aren't named .csv or are too large; for callers that take files from users."""
    if not path.endswith(".csv"):
        raise ValueError("only .csv files are taken")
    if os.path.isfile(path) and os.path.getsize(path) > most_bytes:
        raise ValueError(f"the file has over {most_bytes >> 20} MB")


def labels_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, label) from {"row": ["label", ...]}."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(int(k), x) for k, v in json.loads(text).items() for x in v], "row_id long, label string")
