"""Detectors: rules and models that tell issues from a table's profile.

All rules read one profile, made in one pass; values are looked at again for examples only, a bounded number per issue.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..functions import vocab as V
from ..plans.report import FixOption, Issue, Report, by_severity
from ..sources.tables import ROW, read_csv, with_row_ids
from . import duplicates, fuzzy, models
from .profile import ColumnProfile, data_columns, medians, modes, profile


@dataclass
class Table:
    """A table with row ids and what has been found out about it."""

    df: DataFrame
    models: bool = True
    anomaly_threshold: float = V.ANOMALY_THRESHOLD
    fuzzy_threshold: float = V.FUZZY_THRESHOLD
    found: dict = field(default_factory=dict)

    @cached_property
    def columns(self) -> list[str]:
        return data_columns(self.df)

    @cached_property
    def profile(self) -> dict[str, ColumnProfile]:
        return profile(self.df)

    @cached_property
    def rows(self) -> int:
        return next(iter(self.profile.values())).rows if self.columns else self.df.count()

    @cached_property
    def medians(self) -> dict[str, float | None]:
        wanted = [c for c, p in self.profile.items() if p.missing and p.mostly_numeric]
        return medians(self.df, {c: F.when(~E.is_missing(E.col(c).cast("string")), E.num(E.col(c).cast("string"))) for c in wanted})

    @cached_property
    def modes(self) -> dict[str, str | None]:
        wanted = [c for c, p in self.profile.items() if p.missing and not p.mostly_numeric]
        return modes(self.df, {c: F.when(~E.is_missing(E.col(c).cast("string")), E.col(c).cast("string")) for c in wanted})

    @cached_property
    def examples(self) -> dict[tuple[str, str], list]:
        """(kind, column) -> the first few values in question."""
        wanted: dict[str, list[int]] = {}
        for i, c in enumerate(self.columns):
            p = self.profile[c]
            for kind, some in (
                ("missing", p.disguised),
                ("mixed", p.filled >= V.MIXED_LEAST and V.MIXED_SHARE * p.filled <= p.numeric_detected < p.filled),
                ("space", p.outer_space),
                ("negative", p.negative and _priced(c)),
                ("date", p.date_share >= V.DATE_SHARE and len(p.signatures) > 1),
            ):
                if some:
                    wanted.setdefault(kind, []).append(i)
        if not wanted:
            return {}
        # columns as rows, so that the plan doesn't grow with their number
        cells = self.df.select(E.col(ROW).alias("r"), F.posexplode(F.array(*(E.col(c).cast("string") for c in self.columns))).alias("i", "t"))
        cells = cells.filter(F.col("t").isNotNull() & F.col("i").isin(*sorted({i for x in wanted.values() for i in x})))
        cells = cells.select("r", "i", "t", E.strip("t").alias("s"), E.num("t").alias("n"))
        asked = {
            "missing": E.is_missing("s"),
            "mixed": (F.col("s") != "") & F.col("n").isNull() & ~E.is_numeric_detected("s"),
            "space": F.col("t") != F.col("s"),
            "negative": F.col("n") < 0,
            "date": F.col("s") != "",
        }
        place = {"date": F.xxhash64("r", F.lit(1))}
        kinds = [F.when(F.col("i").isin(*at) & F.coalesce(asked[k], F.lit(False)), F.struct(F.lit(k).alias("kind"), place.get(k, F.col("r")).cast("long").alias("o"))) for k, at in wanted.items()]
        flat = cells.select("i", "r", F.col("t").alias("v"), F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("i", "r", "v", "x.*")
        rest = flat.filter("kind != 'missing'")
        if "missing" in wanted:
            rest = rest.unionByName(flat.filter("kind = 'missing'").groupBy("kind", "i", "v").agg(F.min("o").alias("o"), F.min("r").alias("r")))
        # row_number() <= k is applied to each part before the shuffle
        top = rest.withColumn("k", F.row_number().over(Window.partitionBy("kind", "i").orderBy("o"))).filter("k <= 5")
        shown = F.when(F.col("kind") == "space", E.display("v")).otherwise(F.col("v"))
        out: dict[tuple[str, str], list] = {}
        for x in sorted(top.select("kind", "i", "r", "k", shown.alias("v")).collect(), key=lambda x: x.k):
            c = self.columns[x.i]
            out.setdefault((x.kind, c), []).append(V.text("row", row=x.r, column=c, value=x.v) if x.kind == "negative" else x.v)
        return out

    @cached_property
    def duplicates(self) -> tuple[int, list[str]]:
        """How many rows repeat earlier ones, and the first three of them."""
        n = duplicates.count_duplicates(self.df)
        if not n:
            return 0, []
        rows = duplicates.duplicate_flags(self.df).filter("_duplicate").orderBy(ROW).select(E.first_values(self.columns).alias("v")).limit(3).collect()
        return n, [r.v for r in rows]

    def look(self) -> None:
        """Finds out what the rules ask for, with jobs that don't wait for each other side by side."""
        with ThreadPoolExecutor(4) as pool:
            repeats = pool.submit(lambda: self.duplicates)
            _ = self.profile
            for job in [repeats, *(pool.submit(getattr, self, name) for name in ("examples", "medians", "modes"))]:
                job.result()


def _priced(column: str) -> bool:
    return V.hinted(column, V.PRICE_HINTS) or V.hinted(column, V.QUANTITY_HINTS)


def severity_of(share: float) -> str:
    return V.HIGH if share > 0.3 else V.MEDIUM if share > 0.05 else V.LOW


def missing_options(table: Table, c: str) -> list[FixOption]:
    """Ways to deal with missing values; the first is the recommended one."""
    p = table.profile[c]
    drop = FixOption(V.text("drop_missing"), "drop_rows", V.text("removes", n=p.missing))
    leave = FixOption(V.text("leave_empty"), "leave_empty", "")
    if p.mostly_numeric:
        median, mean = round(table.medians[c], 2), round(p.mean, 2)
        return [FixOption(V.text("fill_median", value=median), "fill_median", str(median)), FixOption(V.text("fill_mean", value=mean), "fill_mean", str(mean)), leave, drop]
    mode = table.modes[c]
    fill = [FixOption(V.text("fill_mode", value=mode), "fill_mode", mode)] if mode else []
    return [drop, *fill] if V.hinted(c, V.PERSON_HINTS) else [*fill, leave, drop]


def detect_missing(table: Table) -> list[Issue]:
    out = []
    for c, p in table.profile.items():
        if p.missing:
            examples = table.examples.get(("missing", c)) or [V.text("empty")]
            out.append(Issue(V.MISSING, c, severity_of(p.missing / p.rows), V.SUGGEST, p.missing, p.rows, examples, V.text("missing", n=p.missing, column=c), 0.99, missing_options(table, c)))
    return out


def detect_duplicates(table: Table) -> list[Issue]:
    n, examples = table.duplicates
    if not n:
        return []
    return [Issue(V.DUPLICATES, None, V.HIGH, V.AUTO, n, table.rows, examples, V.text("duplicates", n=n), 1.0)]


def detect_dates(table: Table) -> list[Issue]:
    out = []
    for c, p in table.profile.items():
        if p.date_share >= V.DATE_SHARE and len(p.signatures) > 1:
            n = p.filled - max(p.signatures.values())
            out.append(Issue(V.DATES, c, V.HIGH, V.AUTO, n, p.rows, table.examples.get(("date", c), []), V.text("dates", column=c), round(p.date_share, 2)))
    return out


def detect_mixed(table: Table) -> list[Issue]:
    out = []
    for c, p in table.profile.items():
        share = p.numeric_detected / p.filled if p.filled else 0.0
        if p.filled >= V.MIXED_LEAST and V.MIXED_SHARE <= share < 1:
            n = p.filled - p.numeric_detected
            options = [FixOption(V.text("coerce_null"), "coerce_null", V.text("blank")), FixOption(V.text("drop_text"), "drop_rows", V.text("removes", n=n)), FixOption(V.text("keep_as_text"), "keep_as_text", V.text("no_change"))]
            out.append(Issue(V.MIXED, c, V.HIGH, V.SUGGEST, n, p.rows, table.examples.get(("mixed", c), []), V.text("mixed", column=c, share=round(share * 100), n=n), round(share, 2), options))
    return out


def detect_whitespace(table: Table) -> list[Issue]:
    return [
        Issue(V.WHITESPACE, c, V.LOW, V.AUTO, p.outer_space, p.rows, table.examples.get(("space", c), []), V.text("whitespace", n=p.outer_space, column=c), 1.0)
        for c, p in table.profile.items()
        if p.outer_space
    ]


def detect_negative(table: Table) -> list[Issue]:
    out = []
    for c, p in table.profile.items():
        if p.negative and _priced(c):
            options = [FixOption(V.text("drop_negative"), "drop_rows", V.text("removes", n=p.negative)), FixOption(V.text("abs_values"), "abs_values", V.text("abs_preview")), FixOption(V.text("keep"), "keep", V.text("no_change"))]
            out.append(Issue(V.NEGATIVE, c, V.HIGH, V.SUGGEST, p.negative, p.rows, table.examples.get(("negative", c), [])[:3], V.text("negative", n=p.negative, column=c), 0.95, options))
    return out


def numeric_columns(table: Table) -> list[str]:
    return [c for c, p in table.profile.items() if p.numeric_for_models]


def detect_anomalies(table: Table) -> list[Issue]:
    cols = numeric_columns(table)
    model = models.fit_autoencoder(table.df, cols, table.anomaly_threshold) if table.rows >= models.LEAST_ROWS else None
    if not model:
        return []
    rows = models.anomalies(table.df, model)
    table.found["anomalies"] = rows
    total = rows.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    if not total.n:
        return []
    some = rows.orderBy(ROW).limit(5).collect()
    options = [FixOption(V.text("drop_anomalies"), "drop_rows", V.text("removes", n=total.n)), FixOption(V.text("keep"), "keep", V.text("no_change"))]
    return [Issue(V.ANOMALY, None, V.HIGH, V.SUGGEST, total.n, table.rows, [V.text("score", row=r[ROW], score=round(r.score, 3)) for r in some], V.text("anomalies", n=total.n, columns=", ".join(cols)), round(total.least, 3), options)]


def detect_fuzzy(table: Table) -> list[Issue]:
    out = []
    for c, p in table.profile.items():
        if V.hinted(c, V.ENTITY_HINTS) and not p.numeric_for_models:
            pairs = fuzzy.value_pairs(table.df, c, table.fuzzy_threshold).persist()  # joined once, read twice
            try:
                total = fuzzy.pair_counts(table.df, c, table.fuzzy_threshold, pairs).first()
                top = pairs.orderBy(F.desc("similarity"), "value_a", "value_b").limit(4).collect() if total.pairs else []
            finally:
                pairs.unpersist()
            if total.pairs:
                examples = [V.text("pair", a=r.value_a, b=r.value_b, percent=round(r.similarity * 100)) for r in top]
                out.append(Issue(V.FUZZY, c, V.MEDIUM, V.FLAG_ONLY, total.pairs * 2, table.rows, examples, V.text("fuzzy", n=total.pairs, column=c), round(total.similarity, 3)))
    return out


#: Rules in the order in which their issues are reported within a severity; more can be registered.
RULES: list[Callable[[Table], list[Issue]]] = [detect_missing, detect_duplicates, detect_dates, detect_mixed, detect_whitespace, detect_negative]
MODELS: list[Callable[[Table], list[Issue]]] = [detect_anomalies, detect_fuzzy]


def register(detector: Callable[[Table], list[Issue]]) -> Callable[[Table], list[Issue]]:
    """Adds a detector behind the others; usable as a decorator."""
    RULES.append(detector)
    return detector


def detect(table: Table) -> list[Issue]:
    """All issues, by severity and then in the order of the detectors. An empty table has none."""
    if not table.columns:
        return []
    table.look()
    if not table.rows:
        return []
    return by_severity([i for d in [*RULES, *(MODELS if table.models else [])] for i in d(table)])


def analyze(df: DataFrame, filename: str = "", job_id: str | None = None, **options) -> tuple[Report, Table]:
    """The report of a table (row ids are given if it has none), and the table with what is known of it."""
    start = time.time()
    table = Table(df if ROW in df.columns else with_row_ids(df), **options)
    issues = detect(table)
    return Report(job_id or str(uuid.uuid4()), filename, table.rows, len(table.columns), issues, int((time.time() - start) * 1000)), table


def analyze_csv(spark: SparkSession, path: str, filename: str = "", job_id: str | None = None, **options) -> tuple[Report, Table]:
    return analyze(read_csv(spark, path), filename or path.rsplit("/", 1)[-1], job_id, **options)
