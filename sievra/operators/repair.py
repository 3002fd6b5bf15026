"""Repairs: projections and filters over the table, chained lazily in a fixed order.

White space first, then repeated rows and dates, then what the user has chosen, issue by issue, then rows without the
required name, then number formats. A fill looks at the rows that are left when its turn comes.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vocab as V
from ..plans.report import Issue
from ..sources.tables import ROW, clean_headers
from . import duplicates
from .profile import data_columns, medians, modes

REQUIRED = "Name"
_NUMBER = "_number"  # a column of its own, so that the parsed value is computed once


def strip_column(df: DataFrame, c: str) -> DataFrame:
    """Without outer white space; nulls stay null."""
    return df.withColumn(c, E.strip(c)) if c in df.columns else df


def normalize_dates(df: DataFrame, c: str, swap_iso: bool = False) -> DataFrame:
    return df.withColumn(c, E.normalize_date(c, swap_iso)) if c in df.columns else df


def null_missing(df: DataFrame, c: str) -> DataFrame:
    """Null for text that stands for a missing value."""
    return df.withColumn(c, F.when(~E.is_missing(c), E.col(c)))


FILLS = ("fill_median", "fill_mean", "fill_mode")


def fill_values(df: DataFrame, actions: dict[str, str]) -> dict[str, str | None]:
    """The texts that fills put in: each column's median, mean (whole or with two places) or most common value.

    All columns of a kind are looked at together.
    """
    present = {c: F.when(~E.is_missing(c), E.col(c)) for c in actions}
    of = lambda kind: [c for c, a in actions.items() if a == kind]
    means = of("fill_mean")

    def averages() -> dict[str, float | None]:
        row = df.agg(*(F.avg(E.num(present[c])).alias(f"a{i}") for i, c in enumerate(means))).first() if means else ()
        return dict(zip(means, row))

    with ThreadPoolExecutor(3) as pool:  # the jobs don't wait for each other
        texts = pool.submit(modes, df, {c: present[c] for c in of("fill_mode")})
        middle = pool.submit(medians, df, {c: E.num(present[c]) for c in of("fill_median")})
        found: dict = averages() | middle.result()
        numbers, found = found, dict(texts.result())
    for c, x in numbers.items():
        found[c] = None if x is None else str(int(x)) if float(x).is_integer() else str(round(x, 2))
    return found


def fix_missing(df: DataFrame, c: str, action: str, value: str | None = None) -> DataFrame:
    """value: what a fill puts in, if it is known."""
    if c not in df.columns:
        return df
    if action in FILLS:
        value = value if value is not None else fill_values(df, {c: action})[c]
        df = null_missing(df, c)
        return df if value is None else df.withColumn(c, F.coalesce(E.col(c), F.lit(value)))
    df = null_missing(df, c)
    return df.filter(E.col(c).isNotNull()) if action == "drop_rows" else df


def fix_mixed(df: DataFrame, c: str, action: str) -> DataFrame:
    if c not in df.columns:
        return df
    if action == "coerce_null":
        return df.withColumn(_NUMBER, E.num_fixed(c)).withColumn(c, E.number_text(F.col(_NUMBER), 6)).drop(_NUMBER)
    return df.filter(E.is_numeric_fixed(c)) if action == "drop_rows" else df


def fix_negative(df: DataFrame, c: str, action: str) -> DataFrame:
    if c not in df.columns:
        return df
    if action == "drop_rows":
        return df.filter(F.coalesce(E.num(c) >= 0, F.lit(True)))
    if action != "abs_values":
        return df
    x = F.col(_NUMBER)
    return df.withColumn(_NUMBER, E.num(c)).withColumn(c, F.when(x < 0, E.number_text(F.abs(x))).otherwise(E.col(c))).drop(_NUMBER)


def fix_anomalies(df: DataFrame, action: str, rows: DataFrame | None) -> DataFrame:
    """Without the anomalous rows, all of them, by row id."""
    if action != "drop_rows" or rows is None:
        return df
    return df.join(rows.select(ROW).distinct(), ROW, "left_anti")


def require_name(df: DataFrame, column: str = REQUIRED) -> DataFrame:
    return df.filter(~E.is_missing(column)) if column in df.columns else df


def format_numbers(df: DataFrame) -> DataFrame:
    """34.0 -> 34 in columns whose numbers are all whole; one aggregation for all columns."""
    cols = [c for c in data_columns(df) if dict(df.dtypes)[c] == "string"]
    if not cols:
        return df
    cells = df.select(F.posexplode(F.array(*(E.col(c) for c in cols))).alias("i", "t")).select("i", E.num("t").alias("n"))
    found = {r.i: r.whole for r in cells.groupBy("i").agg(F.bool_and(F.col("n") == F.floor("n")).alias("whole")).collect()}
    whole = [c for i, c in enumerate(cols) if found.get(i)]
    return df.withColumns({c: E.whole_text(c) for c in whole})


def apply_fixes(df: DataFrame, issues: list[Issue], selections: dict[str, str] | None = None, anomalies: DataFrame | None = None, swap_iso: bool = False, keep: bool = True) -> DataFrame:
    """The repaired table. df has row ids; issues come in the order of the report; selections: {"column:TYPE": action}.

    swap_iso reads yyyy-a-b day first where it can be. keep holds tables in memory and on disk: the one without repeated
    rows while fills look at it, then the one with all choices, which number formats and the caller read;
    unpersist() of the session's cache frees it.
    """
    selections = selections or {}
    df = clean_headers(df)
    auto = [i for i in issues if i.fix_tier == V.AUTO]
    for i in auto:
        if i.issue_type == V.WHITESPACE:
            df = strip_column(df, i.column)
    for i in auto:
        if i.issue_type == V.DUPLICATES:
            df = duplicates.drop_duplicates(df)
        elif i.issue_type == V.DATES:
            df = normalize_dates(df, i.column, swap_iso)
    todo = [(i, selections.get(i.key) or (selections.get(f"null:{i.issue_type}") if i.column is None else None)) for i in issues if i.fix_tier == V.SUGGEST]
    todo = [(i, a) for i, a in todo if a and (i.column is None or i.column in df.columns)]
    fills = any(i.issue_type == V.MISSING and a in FILLS for i, a in todo)
    early = df.persist() if keep and fills and not _held(df) else None
    known: dict[str, str | None] = {}
    for k, (i, action) in enumerate(todo):
        if i.issue_type == V.MISSING:
            if action in FILLS and i.column not in known:
                # fills up to the next action that drops rows or changes a column of theirs see the same values
                ahead: dict[str, str] = {}
                changed: set[str | None] = set()
                for j, a in todo[k:]:
                    if a == "drop_rows":
                        break
                    if j.issue_type == V.MISSING and a in FILLS and j.column not in changed:
                        ahead[j.column] = a
                    changed.add(j.column)
                known = fill_values(df, ahead)
            df = fix_missing(df, i.column, action, known.get(i.column))
        elif i.issue_type == V.MIXED:
            df = fix_mixed(df, i.column, action)
        elif i.issue_type == V.NEGATIVE:
            df = fix_negative(df, i.column, action)
        elif i.issue_type == V.ANOMALY:
            df = fix_anomalies(df, action, anomalies)
        if action == "drop_rows":
            known = {}
    df = require_name(df)
    if keep and not _held(df):
        df = df.persist()
        out = format_numbers(df)
        if early is not None and out is not df:  # the number formats have read the later table as a whole
            early.unpersist()
        return out
    return format_numbers(df)


def _held(df: DataFrame) -> bool:
    """Whether the caller holds this very table already."""
    level = df.storageLevel
    return level.useMemory or level.useDisk
