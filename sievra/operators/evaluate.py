"""Precision and recall of detected labels against known ones, and threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vocab as V
from ..sources.tables import ROW
from . import duplicates
from .detect import Table

# Labels of the truth for kinds of issues.
LABELS = {
    V.MISSING: "missing_value",
    V.DUPLICATES: "duplicate",
    V.DATES: "bad_date",
    V.MIXED: "mixed_type",
    V.WHITESPACE: "whitespace",
    V.NEGATIVE: "negative_value",
    V.ANOMALY: "anomaly",
}


def row_labels(table: Table, issues, compat: bool = False) -> DataFrame:
    """(row_id, label) of all rows that the issues are about.

    compat counts as the published figures do: repeated rows only if they repeat with their ids, date issues under
    their type's name and on the first rows. Else repeats are those found, and dates those that need a change.
    """
    df, parts = table.df, []
    for i in issues:
        c = i.column
        if i.issue_type == V.DUPLICATES:
            if compat:
                firsts = df.groupBy(*(E.col(x) for x in table.columns)).agg(F.min(ROW).alias(ROW))
                rows = df.select(ROW).join(firsts.select(ROW), ROW, "left_anti")
            else:
                rows = duplicates.duplicate_flags(df).filter("_duplicate").select(ROW)
        elif i.issue_type == V.ANOMALY:
            rows = table.found["anomalies"].select(ROW)
        elif c is None or c not in df.columns:
            continue
        elif i.issue_type == V.MISSING:
            rows = df.filter(E.is_missing(c)).select(ROW)
        elif i.issue_type == V.NEGATIVE:
            rows = df.filter(E.num(c) < 0).select(ROW)
        elif i.issue_type == V.WHITESPACE:
            rows = df.filter(E.has_outer_space(c)).select(ROW)
        elif i.issue_type == V.MIXED:
            rows = df.filter(~E.is_blank(c) & E.num(c).isNull()).select(ROW)
        elif i.issue_type == V.DATES and not compat:
            rows = df.filter(~E.is_blank(c) & (F.coalesce(E.parse_date(c).isNull(), F.lit(True)) | (E.date_signature(c) != "YYYY-MM-DD"))).select(ROW)
        else:
            rows = df.filter(F.col(ROW) < i.affected_rows).select(ROW)
        label = i.issue_type if compat and i.issue_type == V.DATES else LABELS.get(i.issue_type, i.issue_type)
        parts.append(rows.select(F.col(ROW).alias("row_id"), F.lit(label).alias("label")))
    if not parts:
        return df.sparkSession.createDataFrame([], "row_id long, label string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def compare(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two sets of (row_id, label)."""
    a = detected.select("row_id", "label").distinct().withColumn("d", F.lit(1))
    b = truth.select("row_id", "label").distinct().withColumn("t", F.lit(1))
    counts = a.join(b, ["row_id", "label"], "full_outer").agg(
        F.count_if(F.col("d").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("d").isNull()).alias("fn"),
    )
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def sweep(scores: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of `score` against truth rows, in one pass. scores: row id, score."""
    own = truth.select(F.col("row_id").alias("_t")).distinct()
    rows = scores.select(F.col(ROW).alias("_r"), "score").join(own, F.col("_r") == F.col("_t"), "full_outer")
    hit = lambda t: F.coalesce(F.col("score") > t, F.lit(False))
    real = F.col("_t").isNotNull()
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(hit(t) & real).alias("tp"), F.count_if(hit(t) & ~real).alias("fp"), F.count_if(~hit(t) & real).alias("fn")) for t in thresholds]
    return with_scores(rows.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row with the best f1, the lowest threshold of equals."""
    return swept.agg(F.max_by(F.struct("*"), F.struct("f1", -F.col("threshold"))).alias("s")).select("s.*")


def latency_percentiles(df: DataFrame, value: Column | str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """p50, p95, ... as values that occur."""
    v = E.col(value) if isinstance(value, str) else value
    cells = [F.expr(f"percentile_disc({s}) within group (order by _v)").alias(f"p{round(s * 100)}") for s in shares]
    return df.select(v.alias("_v")).agg(*cells)


def summary(results: DataFrame) -> DataFrame:
    """Of (rows, rows_per_s, speedup, f1): best throughput, mean speedup, best and mean f1, rows of the best f1."""
    return results.agg(F.max("rows_per_s").alias("max_rows_per_s"), F.avg("speedup").alias("mean_speedup"), F.max("f1").alias("best_f1"), F.avg("f1").alias("mean_f1"), F.max_by("rows", "f1").alias("rows_of_best_f1"))

