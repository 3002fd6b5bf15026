"""What the rules need to know of every column, in one pass over the table; exact medians and modes at any size."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vocab as V
from ..sources.tables import ROW

#: Values between bounds that the driver takes to find medians, of all columns together.
MEDIAN_ROWS = 400_000


@dataclass
class ColumnProfile:
    COUNTS: ClassVar[tuple[str, ...]] = ("nulls", "disguised", "missing", "not_null", "filled", "numeric_detected", "numeric_present", "numeric_role", "outer_space", "negative", "dates")
    name: str
    rows: int
    nulls: int
    disguised: int
    missing: int
    not_null: int
    filled: int
    numeric_detected: int
    numeric_present: int
    numeric_role: int
    outer_space: int
    negative: int
    dates: int
    signatures: dict[str, int]
    whole: bool
    mean: float | None
    low: float | None
    high: float | None
    std: float | None

    @property
    def present(self) -> int:
        return self.rows - self.missing

    @property
    def mostly_numeric(self) -> bool:
        """More than 0.7 of the values that aren't missing are numbers: how fills are chosen."""
        return self.numeric_present / max(self.present, 1) > V.NUMERIC_SHARE

    @property
    def numeric_for_models(self) -> bool:
        """More than 0.7 of the values that aren't blank are numbers, phone numbers and dates left out."""
        return self.filled > 0 and self.numeric_role / self.filled > V.NUMERIC_SHARE

    @property
    def date_share(self) -> float:
        return self.dates / self.filled if self.filled else 0.0


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


SIGNATURES = ("YYYY-MM-DD", "MM/DD/YYYY", "YYYY/MM/DD", "MONTH DD YYYY", "OTHER")


def profile_columns(df: DataFrame) -> DataFrame:
    """A row for each column (`i`, its place) with every count that a rule needs, in one aggregation.

    Columns are turned into rows first, so that the plan is as small for many columns as for one and compiles as a whole;
    each task sends one row a column. What several counts share is computed once a value.
    """
    yes = lambda p: F.coalesce(p, F.lit(False))
    cells = df.select(F.posexplode(F.array(*(E.col(c).cast("string") for c in data_columns(df)))).alias("i", "t"))
    cells = cells.select("i", "t", E.strip("t").alias("s"), E.num("t").alias("n"))
    t, s, n = F.col("t"), F.col("s"), F.col("n")
    filled = yes(s != "")
    cells = cells.select("i", "t", "s", "n", E.is_missing(s).alias("m"), filled.alias("f"), yes(filled & (n.isNotNull() | E.is_numeric_detected(s))).alias("d"), yes(filled & E.is_date(s)).alias("y"), F.when(filled, E.date_signature(s)).alias("g"))
    m = F.col("m")
    return cells.groupBy("i").agg(
        F.count("*").alias("rows"),
        F.count_if(t.isNull()).alias("nulls"),
        F.count_if(t.isNotNull() & m).alias("disguised"),
        F.count_if(m).alias("missing"),
        F.count(t).alias("not_null"),
        F.count_if("f").alias("filled"),
        F.count_if("d").alias("numeric_detected"),
        F.count_if(~m & n.isNotNull()).alias("numeric_present"),
        F.count_if(n.isNotNull() & ~E.has_middle_dash(s)).alias("numeric_role"),
        F.count_if(yes(t != s)).alias("outer_space"),
        F.count_if(yes(n < 0)).alias("negative"),
        F.count_if("y").alias("dates"),
        *(F.count_if(yes(F.col("g") == x)).alias(f"g{k}") for k, x in enumerate(SIGNATURES)),
        F.coalesce(F.bool_and(n == F.floor(n)), F.lit(False)).alias("whole"),
        F.avg(F.when(~m, n)).alias("mean"),
        F.min(n).alias("low"),
        F.max(n).alias("high"),
        F.stddev_pop(n).alias("std"),
    )


def profile(df: DataFrame) -> dict[str, ColumnProfile]:
    columns = data_columns(df)
    found = {r["i"]: r.asDict() for r in profile_columns(df).collect()} if columns else {}
    out = {}
    for i, c in enumerate(columns):
        d = found.get(i) or {"rows": 0} | dict.fromkeys(ColumnProfile.COUNTS, 0) | dict.fromkeys(("mean", "low", "high", "std")) | {"whole": False}
        signatures = {x: d[f"g{k}"] for k, x in enumerate(SIGNATURES) if d.get(f"g{k}")}
        out[c] = ColumnProfile(name=c, signatures=signatures, **{k: v for k, v in d.items() if k != "i" and not (k[0] == "g" and k[1:].isdigit())})
    return out


def medians(df: DataFrame, values: dict[str, Column]) -> dict[str, float | None]:
    """Exact medians. Each pass narrows the bounds of all columns by their approximate quantiles and counts what lies
    outside; when few values are left between, they come to the driver as counts. No buffer grows with the table.
    The values are held in memory and on disk meanwhile, so that each text is read as a number once and not in every pass."""
    if not values:
        return {}
    data = df.select(*(x.alias(f"v{i}") for i, x in enumerate(values.values()))).persist()
    try:
        return _narrowed(data, list(values))
    finally:
        data.unpersist()


def _narrowed(data: DataFrame, names: list[str]) -> dict[str, float | None]:
    """The medians of columns v0, v1, ... under their names."""
    first = data.agg(*(F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))), *(F.min(f"v{i}").alias(f"a{i}") for i in range(len(names))), *(F.max(f"v{i}").alias(f"b{i}") for i in range(len(names)))).first()
    sizes = [first[f"n{i}"] for i in range(len(names))]
    low, high = [first[f"a{i}"] for i in range(len(names))], [first[f"b{i}"] for i in range(len(names))]
    below, inside, margin = [0] * len(names), list(sizes), [0.002] * len(names)
    most = max(10, MEDIAN_ROWS // len(names))
    for _ in range(12):
        wide = [i for i in range(len(names)) if inside[i] > most and low[i] < high[i]]
        if not wide:
            break
        near = lambda i: F.when(F.col(f"v{i}").between(low[i], high[i]), F.col(f"v{i}"))
        share = lambda i: min(1.0, max(0.0, ((sizes[i] - 1) / 2 - below[i]) / inside[i]))
        q = data.agg(*(F.percentile_approx(near(i), [max(0.0, share(i) - margin[i]), min(1.0, share(i) + margin[i])], 2000).alias(f"q{i}") for i in wide)).first()
        cut = {i: (q[f"q{i}"][0], q[f"q{i}"][1]) for i in wide}
        n = data.agg(*(F.count_if(F.col(f"v{i}") < cut[i][0]).alias(f"l{i}") for i in wide), *(F.count_if(F.col(f"v{i}").between(*cut[i])).alias(f"m{i}") for i in wide)).first()
        for i in wide:
            l, m = n[f"l{i}"], n[f"m{i}"]
            if l <= (sizes[i] - 1) // 2 and l + m > sizes[i] // 2:
                if (low[i], high[i]) == cut[i]:
                    inside[i] = min(inside[i], most)  # one value fills the bounds, or nearly
                low[i], high[i], below[i], inside[i] = *cut[i], l, min(m, inside[i])
            else:
                margin[i] *= 8  # the estimate missed; the bounds before stand
    some = [i for i in range(len(names)) if sizes[i]]
    out: dict[str, float | None] = dict.fromkeys(names)
    if not some:
        return out
    stacked = None
    for i in some:
        part = data.filter(F.col(f"v{i}").between(low[i], high[i])).select(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))
        stacked = part if stacked is None else stacked.unionByName(part)
    counts = stacked.groupBy("i", "v").count().toArrow()
    column, value, number = (counts.column(k).to_numpy() for k in ("i", "v", "count"))
    for i in some:
        own = column == i
        v, n = value[own], number[own]
        order = np.argsort(v)
        ends = below[i] + np.cumsum(n[order])
        found = [float(v[order][np.searchsorted(ends, at, side="right")]) for at in ((sizes[i] - 1) // 2, sizes[i] // 2)]
        out[names[i]] = sum(found) / len(found)
    return out


def modes(df: DataFrame, values: dict[str, Column]) -> dict[str, str | None]:
    """The most frequent value of each expression, the smallest of equals; nulls don't count."""
    if not values:
        return {}
    stack = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), x.cast("string").alias("v")) for i, x in enumerate(values.values()))))
    counts = df.select(stack.alias("s")).select("s.*").filter("v is not null").groupBy("i", "v").count()
    top = counts.groupBy("i").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v")).collect()
    found = {r.i: r.v for r in top}
    return {name: found.get(i) for i, name in enumerate(values)}


def sample_values(df: DataFrame, column: str, n: int = 5) -> list[str]:
    """Up to n different values that aren't blank, those that come first by row id."""
    rows = df.filter(~E.is_blank(column)).groupBy(E.col(column).alias("v")).agg(F.min(ROW).alias("r"))
    return [r.v for r in rows.orderBy("r").limit(n).collect()]


def baseline(df: DataFrame) -> DataFrame:
    """(column, nulls, disguised, not_numeric) for each column, and whole-row repeats under `_rows`."""
    cols = data_columns(df)
    count = lambda p: F.count_if(F.coalesce(p, F.lit(False)))
    per = [F.struct(F.lit(c).alias("column"), count(E.col(c).isNull()).alias("nulls"), count(E.is_disguised(c) & E.col(c).isNotNull()).alias("disguised"), count(E.col(c).isNotNull() & E.num(c).isNull()).alias("not_numeric")) for c in cols]
    repeats = df.groupBy(*(E.col(c) for c in cols)).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    zero = F.lit(0).cast("long")
    return df.agg(F.array(*per).alias("a")).select(F.explode("a").alias("s")).select("s.*").unionByName(repeats.select(F.lit("_rows").alias("column"), F.col("n").cast("long").alias("nulls"), zero.alias("disguised"), zero.alias("not_numeric")))
