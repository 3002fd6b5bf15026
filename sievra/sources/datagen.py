"""A dirty table of people with known errors, for benchmarks: every value is a hash of its row, so any size is made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ROW

FIRST = ["Anouk", "Bela", "Chiara", "Dmitri", "Edda", "Farid", "Greta", "Hiro", "Ines", "Jovan", "Keiko", "Lars", "Mina", "Nils", "Oona", "Pavel", "Runa", "Sven", "Thea", "Umar", "Vera", "Wim", "Yara", "Zeno"]
LAST = ["Almeida", "Bergstrom", "Castellan", "Dvorak", "Eriksen", "Fontaine", "Gruber", "Horvat", "Ivanova", "Jansen", "Kowalski", "Lindqvist", "Moreau"]
DEPARTMENTS = ["Research", "Logistics", "Legal", "Support", "Design"]
STATUSES = ["current", "former", "on leave"]
COLUMNS = "id name email age salary join_date department status".split()
# What errors put in, and the labels of the errors.
NULL_TEXT = ["N/A", "NULL", "none", "?", "-"]
ODD_AGES = ["0", "999", "-5", "200"]
ODD_SALARIES = ["-5000", "-1", "9999999"]
BAD_DATES = ["9999-99-99", "not-a-date", "32/13/2020", "2020-13-01"]
AGE_TEXT = ["thirty", "twenty-five", "n/a", "old"]
KINDS = ["missing_value", "missing_value", "anomaly", "anomaly", "negative_value", "bad_date", "mixed_type", "whitespace", "case_inconsistency"]


def _draw(salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("i"), F.lit(salt)), F.lit(n))


def _pick(salt: int, options: list[str]) -> Column:
    return F.get(F.array(*(F.lit(x) for x in options)), _draw(salt, len(options)).cast("int"))


def generate(spark: SparkSession, rows: int, error_share: float = 0.2, duplicate_share: float = 0.03, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(table of text with row ids, truth (row_id, label)): `rows` rows, a share with one error each, copies behind them."""
    s = seed * 1000
    copies = max(1, int(rows * duplicate_share))
    at = spark.range(rows).select(F.col("id").alias(ROW), F.col("id").alias("i"))
    # copies of rows that are drawn by a step through the table
    step = max(1, (rows - copies) // copies)
    again = spark.range(copies).select((F.col("id") + rows).alias(ROW), (F.col("id") * step).alias("i"))
    base = at.unionByName(again)
    first, last = _pick(s + 1, FIRST), _pick(s + 2, LAST)
    base = base.withColumns({
        "name": F.concat_ws(" ", first, last),
        "email": F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@example.com")),
        "age": (22 + _draw(s + 3, 39)).cast("string"),
        "pay": 40000 + _draw(s + 4, 110001),
        "join_date": F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), _draw(s + 5, 1827).cast("int")), "yyyy-MM-dd"),
        "department": _pick(s + 6, DEPARTMENTS),
        "status": _pick(s + 7, STATUSES),
        "kind": F.when(_draw(s + 8, 1_000_000) < int(error_share * 1_000_000), _draw(s + 9, len(KINDS)).cast("int")),
        "which": _draw(s + 10, 4),
    })
    k, w = F.col("kind"), F.col("which")
    text = NULL_TEXT
    out = base.select(
        ROW,
        "i",
        "kind",
        (F.col(ROW) + 1).cast("string").alias("id"),
        F.when((k == 0) & (w == 0), None).when(k == 7, F.concat(F.lit("  "), "name", F.lit("  "))).otherwise(F.col("name")).alias("name"),
        F.when((k == 0) & (w == 1), None).otherwise(F.col("email")).alias("email"),
        F.when((k == 0) & (w == 2), None).when((k == 1) & (w == 0), _pick(s + 11, text)).when(k == 2, _pick(s + 12, ODD_AGES)).when(k == 6, _pick(s + 13, AGE_TEXT)).otherwise(F.col("age")).alias("age"),
        F.when((k == 0) & (w == 3), None).when((k == 1) & (w == 1), _pick(s + 11, text)).when(k == 3, _pick(s + 14, ODD_SALARIES)).when(k == 4, (-F.col("pay")).cast("string")).otherwise(F.col("pay").cast("string")).alias("salary"),
        F.when(k == 5, _pick(s + 15, BAD_DATES)).otherwise(F.col("join_date")).alias("join_date"),
        "department",
        F.when((k == 1) & (w >= 2), _pick(s + 11, text)).when(k == 7, F.concat(F.lit(" "), "status", F.lit(" "))).when(k == 8, F.upper("status")).otherwise(F.col("status")).alias("status"),
    )
    label = F.get(F.array(*(F.lit(x) for x in KINDS)), F.col("kind"))
    truth = out.select(F.col(ROW).alias("row_id"), F.when(F.col(ROW) >= rows, F.lit("duplicate")).otherwise(label).alias("label")).filter("label is not null")
    return out.select(ROW, *COLUMNS), truth
