"""The queries of the data-quality engine over the driver's tables, each with the SQL that DuckDB answers alike.

The tables are clean, so most queries work on `dirty_customer`: a projection of customer into text with errors at known
rows, written once as SQL that both engines read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vocab as V
from ..operators import duplicates, evaluate, fuzzy, models, repair
from ..operators.detect import Table, analyze
from ..operators.profile import baseline, medians, modes, profile_columns, sample_values
from ..sources import datagen
from ..sources.tables import ROW, complete_rows, doubles, read_csv, texts, with_row_ids, write_csv, write_json
from ..streaming import quality
from .report import issues_frame, recommended

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BAL = "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING)"
_Y, _M, _D = "CAST(2019 + c_custkey % 5 AS STRING)", "lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0')", "lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')"
_MON = "substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * (c_custkey % 12) + 1 AS INT), 3)"
DIRTY = {
    "id": "CAST(c_custkey AS STRING)",
    "name": "CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN concat('  ', c_name, ' ') WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END",
    "acct_amount": f"CASE WHEN c_custkey % 19 = 0 THEN 'unknown' WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN concat('$', {_BAL}) ELSE {_BAL} END",
    "age": "CASE WHEN c_custkey % 31 = 0 THEN 'thirty' WHEN c_custkey % 37 = 0 THEN ' ' ELSE CAST(18 + c_custkey % 60 AS STRING) END",
    "segment": "CASE WHEN c_custkey % 7 = 0 THEN concat(' ', c_mktsegment) WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END",
    "nation": "CASE WHEN c_custkey % 9 = 0 THEN '?' ELSE concat('N', CAST(c_nationkey AS STRING)) END",
    "join_date": f"CASE WHEN c_custkey % 41 = 0 THEN '9999-99-99' WHEN c_custkey % 3 = 0 THEN concat({_Y}, '-', {_M}, '-', {_D}) WHEN c_custkey % 3 = 1 THEN concat({_M}, '/', {_D}, '/', {_Y}) ELSE concat({_MON}, ' ', {_D}, ' ', {_Y}) END",
}
COLUMNS = list(DIRTY)
CTE = "WITH dirty AS (SELECT c_custkey AS k, " + ", ".join(f"{sql} AS {c}" for c, sql in DIRTY.items()) + " FROM customer)"
_TOKENS = ", ".join(f"'{t}'" for t in V.DISGUISED_NULLS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns and the row id, which is the customer's key."""
    return load(spark, sf_dir, "customer").selectExpr(f"c_custkey AS {ROW}", *(f"{sql} AS {c}" for c, sql in DIRTY.items()))


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL it is compared with."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- SQL pieces


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def s_missing(x: str) -> str:
    return f"({x} IS NULL OR lower({s_strip(x)}) IN ({_TOKENS}))"


def s_num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[ \\t\\r\\n]*[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?[ \\t\\r\\n]*$') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def s_filled(x: str) -> str:
    return f"({x} IS NOT NULL AND {s_strip(x)} <> '')"


def s_signature(x: str) -> str:
    v = s_strip(x)
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN strpos({v}, '-') = 5 THEN 'YYYY-MM-DD' WHEN contains({v}, '/') THEN "
        f"CASE WHEN len(string_split({v}, '/')) = 3 AND length(string_split({v}, '/')[3]) = 4 THEN 'MM/DD/YYYY' "
        f"WHEN len(string_split({v}, '/')) = 3 AND length(string_split({v}, '/')[1]) = 4 THEN 'YYYY/MM/DD' ELSE 'OTHER' END "
        f"WHEN contains({v}, ' ') THEN 'MONTH DD YYYY' ELSE 'OTHER' END"
    )


def s_date(x: str) -> str:
    """ISO text of the three ways in which dirty dates are written (a/b/yyyy is day first unless b can't be a month)."""
    p = f"string_split({x}, '/')"
    w = f"string_split({x}, ' ')"
    month = f"lpad(CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower({w}[1])) + 2) // 3 AS VARCHAR), 2, '0')"
    return (
        f"CASE WHEN {x} IS NULL OR contains({x}, '9999') THEN {x} "
        f"WHEN contains({x}, '/') THEN CASE WHEN CAST({p}[2] AS INT) <= 12 THEN concat({p}[3], '-', {p}[2], '-', {p}[1]) ELSE concat({p}[3], '-', {p}[1], '-', {p}[2]) END "
        f"WHEN contains({x}, ' ') THEN concat({w}[3], '-', {month}, '-', {w}[2]) ELSE {x} END"
    )


def s_union(make: Callable[[str], str], columns: list[str] = COLUMNS) -> str:
    return f"{CTE} " + " UNION ALL ".join(make(c) for c in columns)


def s_number_text(x: str, places: int = 2) -> str:
    """As E.number_text."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE regexp_replace(CAST(CAST(round({x}, {places}) AS DECIMAL(30,{places})) AS VARCHAR), '0+$', '') END"


# --- missing values


@query(s_union(lambda c: f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NOT NULL AND {s_missing(c)}) AS disguised, count(*) FILTER ({s_missing(c)}) AS missing, count(*) AS total FROM dirty"))
def profile_missing(spark, sf_dir):
    names = F.array(*(F.lit(c) for c in COLUMNS))
    return profile_columns(dirty_customer(spark, sf_dir)).select(F.get(names, F.col("i")).alias("column"), "nulls", "disguised", "missing", F.col("rows").alias("total"))


@query(f"WITH p AS ({s_union(lambda c: f'''SELECT '{c}' AS col, count(*) FILTER ({s_missing(c)}) AS n, count(*) AS total FROM dirty''')}) SELECT col AS \"column\", CASE WHEN n > 0.3 * total THEN 'HIGH' WHEN n > 0.05 * total THEN 'MEDIUM' ELSE 'LOW' END AS severity, n AS affected FROM p WHERE n > 0")
def missing_severity(spark, sf_dir):
    share = F.col("missing") / F.col("total")
    rank = F.when(share > 0.3, V.HIGH).when(share > 0.05, V.MEDIUM).otherwise(V.LOW)
    return profile_missing(spark, sf_dir).filter("missing > 0").select("column", rank.alias("severity"), F.col("missing").alias("affected"))


def _fixed(c: str, action: str, spark, sf_dir) -> DataFrame:
    return repair.fix_missing(dirty_customer(spark, sf_dir), c, action).select("id", F.col(c).alias("fixed"))


def s_fill(c: str, value: str) -> str:
    return f"{CTE}, f AS ({value}) SELECT id, CASE WHEN {s_missing(c)} THEN (SELECT v FROM f) ELSE {c} END AS fixed FROM dirty"


@query(s_fill("acct_amount", f"SELECT {s_number_text('m')} AS v FROM (SELECT median({s_num('acct_amount')}) AS m FROM dirty WHERE NOT {s_missing('acct_amount')})"))
def fill_median(spark, sf_dir):
    return _fixed("acct_amount", "fill_median", spark, sf_dir)


@query(s_fill("age", f"SELECT {s_number_text('m')} AS v FROM (SELECT avg({s_num('age')}) AS m FROM dirty WHERE NOT {s_missing('age')})"))
def fill_mean(spark, sf_dir):
    return _fixed("age", "fill_mean", spark, sf_dir)


@query(s_fill("nation", f"SELECT nation AS v FROM dirty WHERE NOT {s_missing('nation')} GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1"))
def fill_mode(spark, sf_dir):
    return _fixed("nation", "fill_mode", spark, sf_dir)


@query(f"{CTE} SELECT id, name AS fixed FROM dirty WHERE NOT {s_missing('name')}")
def drop_missing(spark, sf_dir):
    return _fixed("name", "drop_rows", spark, sf_dir)


@query(f"{CTE} SELECT id, CASE WHEN NOT {s_missing('name')} THEN name END AS fixed FROM dirty")
def null_out_tokens(spark, sf_dir):
    return _fixed("name", "leave_empty", spark, sf_dir)


@query(f"{CTE} SELECT median({s_num('acct_amount')}) AS acct_amount, median({s_num('age')}) AS age FROM dirty")
def exact_medians(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    found = medians(df, {c: E.num(c) for c in ("acct_amount", "age")})
    return spark.createDataFrame([tuple(found.values())], "acct_amount double, age double")


@query(f"{CTE} SELECT 'segment' AS \"column\", (SELECT segment FROM dirty GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) AS mode UNION ALL SELECT 'nation', (SELECT nation FROM dirty GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1)")
def exact_modes(spark, sf_dir):
    found = modes(dirty_customer(spark, sf_dir), {c: E.col(c) for c in ("segment", "nation")})
    return spark.createDataFrame(list(found.items()), "column string, mode string")


# --- white space


@query(s_union(lambda c: f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} <> {s_strip(c)}) AS affected FROM dirty"))
def detect_whitespace(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(E.has_outer_space(c)).alias("affected")) for c in COLUMNS))
    return df.agg(cells.alias("a")).select(F.explode("a").alias("s")).select("s.*")


@query(f"{CTE} SELECT id, {s_strip('name')} AS name, {s_strip('segment')} AS segment FROM dirty")
def fix_whitespace(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    return repair.strip_column(repair.strip_column(df, "name"), "segment").select("id", "name", "segment")


@query(f"{CTE} SELECT id, concat('''', segment, '''') AS shown FROM dirty WHERE segment <> {s_strip('segment')}")
def display_examples(spark, sf_dir):
    return dirty_customer(spark, sf_dir).filter(E.has_outer_space("segment")).select("id", E.display("segment").alias("shown"))


# --- repeated rows


@query("SELECT doc_id, row_number() OVER (PARTITION BY " + s_strip("text") + ", lang ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dup_rows_flag(spark, sf_dir):
    df = load(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "doc_id", "text", "lang")
    return duplicates.duplicate_flags(df).select("doc_id", F.col("_duplicate").alias("is_duplicate"))


@query("SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    df = load(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), "p_partkey", "p_name", "p_brand")
    return duplicates.drop_duplicates(df).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS r FROM part) WHERE r > 1")
def dup_rows_by_window(spark, sf_dir):
    df = load(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), "p_partkey", "p_name", "p_brand")
    return duplicates.duplicate_flags_by_window(df).filter("_duplicate").select("p_partkey", "p_name", "p_brand")


# --- dates


@query(f"{CTE} SELECT {s_signature('join_date')} AS signature, count(*) AS n FROM dirty GROUP BY 1")
def date_signature_hist(spark, sf_dir):
    return dirty_customer(spark, sf_dir).groupBy(E.date_signature("join_date").alias("signature")).agg(F.count("*").alias("n"))


@query(f"{CTE}, h AS (SELECT {s_signature('join_date')} AS s, count(*) AS n FROM dirty GROUP BY 1) SELECT CAST(sum(n) - max(n) AS BIGINT) AS affected, count(*) AS formats FROM h")
def date_inconsistent(spark, sf_dir):
    return date_signature_hist(spark, sf_dir).agg((F.sum("n") - F.max("n")).alias("affected"), F.count("*").alias("formats"))


@query(f"{CTE} SELECT id, {s_date('join_date')} AS join_date FROM dirty")
def normalize_dates(spark, sf_dir):
    return repair.normalize_dates(dirty_customer(spark, sf_dir), "join_date").select("id", "join_date")


@query(f"{CTE}, n AS (SELECT id, {s_date('join_date')} AS d FROM dirty) SELECT id, CASE WHEN d LIKE '9999%' THEN d WHEN CAST(substring(d, 9, 2) AS INT) <= 12 THEN concat(substring(d, 1, 4), '-', substring(d, 9, 2), '-', substring(d, 6, 2)) ELSE d END AS join_date FROM n")
def normalize_dates_swapped(spark, sf_dir):
    df = repair.normalize_dates(dirty_customer(spark, sf_dir), "join_date")
    return repair.normalize_dates(df, "join_date", swap_iso=True).select("id", "join_date")


# --- numbers


def s_detected(c: str) -> str:
    return f"regexp_matches({s_strip(f'''translate({c}, ',$%', '')''')}, '^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$')"


@query(f"WITH p AS ({s_union(lambda c: f'''SELECT '{c}' AS col, count(*) FILTER ({s_filled(c)} AND {s_detected(c)}) AS n, count(*) FILTER ({s_filled(c)}) AS filled FROM dirty''')}) SELECT col AS \"column\", n AS numeric_values, filled, filled >= 5 AND n >= 0.5 * filled AND n < filled AS is_mixed FROM p")
def mixed_types_ratio(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(~E.is_blank(c) & E.is_numeric_detected(c)).alias("numeric_values"), F.count_if(~E.is_blank(c)).alias("filled")) for c in COLUMNS))
    flat = df.agg(cells.alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return flat.withColumn("is_mixed", (F.col("filled") >= 5) & (F.col("numeric_values") >= 0.5 * F.col("filled")) & (F.col("numeric_values") < F.col("filled")))


@query(f"{CTE} SELECT id, {s_number_text(s_num('''translate(acct_amount, ',$', '')'''), 6)} AS acct_amount FROM dirty")
def coerce_null(spark, sf_dir):
    return repair.fix_mixed(dirty_customer(spark, sf_dir), "acct_amount", "coerce_null").select("id", "acct_amount")


@query(f"{CTE} SELECT id, age FROM dirty WHERE age IS NULL OR ({s_num('age')}) IS NOT NULL")
def drop_non_numeric(spark, sf_dir):
    return repair.fix_mixed(dirty_customer(spark, sf_dir), "age", "drop_rows").select("id", "age")


@query(f"{CTE} SELECT id, acct_amount FROM dirty WHERE ({s_num('acct_amount')}) < 0")
def negative_flag(spark, sf_dir):
    return dirty_customer(spark, sf_dir).filter(E.num("acct_amount") < 0).select("id", "acct_amount")


@query(f"{CTE} SELECT id, acct_amount FROM dirty WHERE coalesce(({s_num('acct_amount')}) >= 0, true)")
def negative_drop(spark, sf_dir):
    return repair.fix_negative(dirty_customer(spark, sf_dir), "acct_amount", "drop_rows").select("id", "acct_amount")


@query(f"{CTE}, n AS (SELECT id, acct_amount, {s_num('acct_amount')} AS x FROM dirty) SELECT id, CASE WHEN x < 0 THEN {s_number_text('abs(x)')} ELSE acct_amount END AS acct_amount FROM n")
def negative_abs(spark, sf_dir):
    return repair.fix_negative(dirty_customer(spark, sf_dir), "acct_amount", "abs_values").select("id", "acct_amount")


@query(f"WITH p AS ({s_union(lambda c: f'''SELECT '{c}' AS col, count(*) FILTER ({s_filled(c)} AND NOT regexp_matches({s_strip(c)}, '^.+[-/].+$') AND ({s_num(c)}) IS NOT NULL) AS n, count(*) FILTER ({s_filled(c)}) AS filled FROM dirty''')}) SELECT col AS \"column\", round(n / filled, 6) AS share, n > 0.7 * filled AS is_numeric FROM p")
def numeric_role_inference(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(~E.is_blank(c) & E.num_role(c).isNotNull()).alias("n"), F.count_if(~E.is_blank(c)).alias("filled")) for c in COLUMNS))
    flat = df.agg(cells.alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return flat.select("column", F.round(F.col("n") / F.col("filled"), 6).alias("share"), (F.col("n") > 0.7 * F.col("filled")).alias("is_numeric"))


@query("SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, count(*) AS n FROM lineitem GROUP BY 1")
def float_format(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("string").alias("quantity"))
    return repair.format_numbers(df).groupBy("quantity").agg(F.count("*").alias("n"))


@query(f"{CTE} SELECT id, regexp_extract(join_date, '^\\s*([-+]?(\\d+\\.?\\d*|\\.\\d+))', 1) <> '' AS has_number, TRY_CAST(nullif(regexp_extract(join_date, '^\\s*([-+]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE) AS number, regexp_matches(join_date, '^.+[-/].+$') AS middle_dash FROM dirty")
def number_prefixes(spark, sf_dir):
    x = E.num_prefix("join_date")
    return dirty_customer(spark, sf_dir).select("id", x.isNotNull().alias("has_number"), x.alias("number"), E.has_middle_dash("join_date").alias("middle_dash"))


# --- models


@query(f"{CTE} SELECT id, round({s_num('acct_amount')}, 6) AS acct_amount, round({s_num('age')}, 6) AS age FROM dirty WHERE ({s_num('acct_amount')}) IS NOT NULL AND ({s_num('age')}) IS NOT NULL")
def complete_case_matrix(spark, sf_dir):
    df = complete_rows(dirty_customer(spark, sf_dir), ["acct_amount", "age"], keep=["id"])
    return df.select("id", F.round("acct_amount", 6).alias("acct_amount"), F.round("age", 6).alias("age"))


@query(f"{CTE} SELECT 'numbers' AS kind, count({s_num('age')}) AS n FROM dirty UNION ALL SELECT 'empty', count(*) FILTER (coalesce(name, '') = '') FROM dirty")
def text_and_number_columns(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    numbers = doubles(df, ["age"]).agg(F.lit("numbers").alias("kind"), F.count("age").alias("n"))
    return numbers.unionByName(texts(df, ["name"]).agg(F.lit("empty").alias("kind"), F.count_if(F.col("name") == "").alias("n")))


@query("SELECT l_returnflag, round(avg((l_extendedprice - a) / (b - a)), 6) AS price, round(avg((l_quantity - c) / (d - c)), 6) AS quantity, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c, max(l_quantity) AS d FROM lineitem) GROUP BY 1")
def minmax_norm(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    lim = df.agg(F.min("l_extendedprice"), F.max("l_extendedprice"), F.min("l_quantity"), F.max("l_quantity")).first()
    price = E.min_max(F.col("l_extendedprice"), F.lit(lim[0]), F.lit(lim[1]))
    quantity = E.min_max(F.col("l_quantity"), F.lit(lim[2]), F.lit(lim[3]))
    return df.groupBy("l_returnflag").agg(F.round(F.avg(price), 6).alias("price"), F.round(F.avg(quantity), 6).alias("quantity"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(sum(((l_extendedprice - m) / s) * ((l_extendedprice - m) / s)), 3) AS squares, count(*) AS n FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) GROUP BY 1")
def zscore_norm(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    m, s = df.agg(F.avg("l_extendedprice"), F.stddev_pop("l_extendedprice")).first()
    z = E.z_score(F.col("l_extendedprice"), F.lit(m), F.lit(s))
    return df.groupBy("l_returnflag").agg(F.round(F.sum(z * z), 3).alias("squares"), F.count("*").alias("n"))


_WORDS = "len(string_split(text, ' '))"


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS n FROM documents), f AS (SELECT regr_slope(n, w) AS a, regr_intercept(n, w) AS b FROM d WHERE n IS NOT NULL) SELECT doc_id, round(a * w + b, 2) AS predicted_value FROM d, f WHERE n IS NULL")
def regress_impute(spark, sf_dir):
    df = load(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("words"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("n"))
    model = models.fit_regressor(df, "n", ["words"])
    return models.impute(df, model).select("doc_id", F.round("predicted_value", 2).alias("predicted_value"))


_NET = models.Autoencoder(
    ["l_quantity", "l_extendedprice", "l_discount"], [1.0, 0.0, 0.0], [50.0, 100000.0, 0.1],
    [models.Dense(np.array([[0.5, -0.25], [0.75, 0.5], [-0.5, 1.0]]), np.array([0.1, 0.0])), models.Dense(np.array([[0.5, 0.25, 1.0], [0.125, 0.75, -0.5]]), np.array([0.05, 0.0, 0.1]), "linear")],
)


@query(
    "WITH x AS (SELECT l_returnflag, (l_quantity - 1) / 49.0 AS a, l_extendedprice / 100000.0 AS b, l_discount / 0.1 AS c FROM lineitem), "
    "h AS (SELECT *, greatest(0, 0.1 + 0.5 * a + 0.75 * b - 0.5 * c) AS p, greatest(0, -0.25 * a + 0.5 * b + 1.0 * c) AS q FROM x), "
    "s AS (SELECT l_returnflag, (power(0.05 + 0.5 * p + 0.125 * q - a, 2) + power(0.25 * p + 0.75 * q - b, 2) + power(0.1 + 1.0 * p - 0.5 * q - c, 2)) / 3 AS score FROM h) "
    "SELECT l_returnflag, count(*) AS n, round(avg(score), 6) AS score, count(*) FILTER (score > 0.15) AS anomalies FROM s GROUP BY 1"
)
def anomaly_score(spark, sf_dir):
    """The forward pass of a given network."""
    df = models.anomaly_scores(load(spark, sf_dir, "lineitem"), _NET, keep=["l_returnflag"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.count_if(F.col("score") > 0.15).alias("anomalies"))


@query()
def anomaly_rows(spark, sf_dir):
    """Rows that a network trained on the table doesn't reproduce; training has no SQL."""
    df = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ROW), F.when(F.col("c_custkey") % 97 == 0, 999).otherwise(18 + F.col("c_custkey") % 60).alias("age"), "c_acctbal")
    model = models.fit_autoencoder(df, ["age", "c_acctbal"])
    return models.anomalies(df, model)


@query()
def network_impute(spark, sf_dir):
    """regress_impute by a network with hidden layers; training has no SQL."""
    df = load(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).alias("words"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("n"))
    return models.impute(df, models.fit_regressor(df, "n", ["words"], hidden=True)).select("doc_id", F.round("predicted_value", 2).alias("predicted_value"))


# --- near-duplicate values

_NAMES = "names AS (SELECT DISTINCT p_name AS v FROM part)"
_NORM = "ltrim(regexp_replace(lower(regexp_replace(v, '[^A-Za-z0-9 ]', ' ', 'g')), ' +', ' ', 'g'))"
_TOK = f"list_distinct(list_filter(string_split({_NORM}, ' '), lambda x: x <> ''))"
_PAIRS = (
    f"{_NAMES}, n AS (SELECT v, {_NORM} AS z, {_TOK} AS t FROM names), p AS (SELECT a.v AS value_a, b.v AS value_b, "
    "1 - levenshtein(a.z, b.z) / greatest(strlen(a.v), strlen(b.v)) AS edit, "
    "CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END AS jac FROM n a JOIN n b ON a.v < b.v)"
)


def s_norm(v: str) -> str:
    return _NORM.replace("(v,", f"({v},")


def s_tokens(v: str) -> str:
    return _TOK.replace("(v,", f"({v},")


_EDIT = f"1 - levenshtein({s_norm('p_name')}, {s_norm('p_type')}) / greatest(strlen(p_name), strlen(p_type))"
_JAC = f"len(list_intersect({s_tokens('p_name')}, {s_tokens('p_type')})) / len(list_distinct(list_concat({s_tokens('p_name')}, {s_tokens('p_type')})))"


def _rows_compared(spark, sf_dir, similarity) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.round(similarity, 6).alias("similarity"))


@query(f"SELECT p_partkey, round({_EDIT}, 6) AS similarity FROM part")
def levenshtein_sim(spark, sf_dir):
    return _rows_compared(spark, sf_dir, E.edit_similarity(E.fuzzy_norm("p_name"), E.fuzzy_norm("p_type"), F.col("p_name"), F.col("p_type")))


@query(f"SELECT p_partkey, round({_JAC}, 6) AS similarity FROM part")
def token_jaccard(spark, sf_dir):
    return _rows_compared(spark, sf_dir, E.jaccard(E.fuzzy_tokens(E.fuzzy_norm("p_name")), E.fuzzy_tokens(E.fuzzy_norm("p_type"))))


@query(f"SELECT p_partkey, round(0.4 * ({_EDIT}) + 0.6 * ({_JAC}), 6) AS similarity FROM part")
def fuzzy_sim(spark, sf_dir):
    return _rows_compared(spark, sf_dir, E.fuzzy_similarity("p_name", "p_type"))


@query(f"WITH {_PAIRS} SELECT value_a, value_b, round(0.4 * edit + 0.6 * jac, 6) AS similarity FROM p WHERE 0.4 * edit + 0.6 * jac >= 0.45 AND lower(value_a) <> lower(value_b)")
def fuzzy_pairs(spark, sf_dir):
    found = fuzzy.value_pairs(load(spark, sf_dir, "part"), "p_name")
    return found.select("value_a", "value_b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS}, c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), q AS (SELECT a.n * b.n AS n, 0.4 * edit + 0.6 * jac AS s FROM p JOIN c a ON a.v = value_a JOIN c b ON b.v = value_b) SELECT 'p_name' AS \"column\", CAST(sum(n) AS BIGINT) AS pairs, round(sum(n * s) / sum(n), 6) AS similarity FROM q WHERE s >= 0.45")
def fuzzy_summary(spark, sf_dir):
    found = fuzzy.pair_counts(load(spark, sf_dir, "part"), "p_name")
    return found.select("column", "pairs", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS}, c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), q AS (SELECT value_a, value_b FROM p WHERE 0.4 * edit + 0.6 * jac >= 0.45), u AS (SELECT value_a AS v, value_b AS w FROM q UNION ALL SELECT value_b, value_a FROM q), m AS (SELECT u.v, CAST(sum(c.n) AS BIGINT) AS n FROM u JOIN c ON c.v = u.w GROUP BY 1) SELECT p_partkey, coalesce(m.n, 0) AS near_rows FROM part LEFT JOIN m ON m.v = p_name")
def fuzzy_row_counts(spark, sf_dir):
    """For each row the number of rows with a near-duplicate name; pairs of equal rows aren't spelled out."""
    found = fuzzy.partner_counts(load(spark, sf_dir, "part"), "p_name", "p_partkey")
    return found.select("p_partkey", "near_rows")


# --- reports


def s_issue(kind: str, column: str, severity: str, n: str, where: str = "n > 0") -> str:
    return f"SELECT '{kind}' AS issue_type, {column} AS \"column\", {severity} AS severity, n AS affected_rows, total AS total_rows FROM ({n}) WHERE {where}"


def s_issues() -> str:
    sev = "CASE WHEN n > 0.3 * total THEN 'HIGH' WHEN n > 0.05 * total THEN 'MEDIUM' ELSE 'LOW' END"
    parts = []
    for c in COLUMNS:
        parts.append(s_issue(V.MISSING, f"'{c}'", sev, f"SELECT count(*) FILTER ({s_missing(c)}) AS n, count(*) AS total FROM dirty"))
        parts.append(s_issue(V.WHITESPACE, f"'{c}'", "'LOW'", f"SELECT count(*) FILTER ({c} <> {s_strip(c)}) AS n, count(*) AS total FROM dirty"))
        parts.append(s_issue(V.MIXED, f"'{c}'", "'HIGH'", f"SELECT filled - num AS n, filled, num, total FROM (SELECT count(*) FILTER ({s_filled(c)} AND {s_detected(c)}) AS num, count(*) FILTER ({s_filled(c)}) AS filled, count(*) AS total FROM dirty)", "filled >= 5 AND num >= 0.5 * filled AND num < filled"))
    compared = ", ".join(s_strip(c) for c in COLUMNS if c != "id")
    parts.append(s_issue(V.DUPLICATES, "CAST(NULL AS VARCHAR)", "'HIGH'", f"SELECT CAST(sum(m - 1) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS total FROM (SELECT count(*) AS m FROM dirty GROUP BY {compared})"))
    parts.append(s_issue(V.NEGATIVE, "'acct_amount'", "'HIGH'", f"SELECT count(*) FILTER (({s_num('acct_amount')}) < 0) AS n, count(*) AS total FROM dirty"))
    parts.append(s_issue(V.DATES, "'join_date'", "'HIGH'", f"SELECT CAST(sum(m) - max(m) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS total FROM (SELECT {s_signature('join_date')} AS s, count(*) AS m FROM dirty GROUP BY 1)"))
    return f"{CTE} " + " UNION ALL ".join(parts)


@query(s_issues())
def issue_report(spark, sf_dir):
    """All issues that the rules find."""
    report, _ = analyze(dirty_customer(spark, sf_dir), models=False)
    return issues_frame(spark, report.issues).select("issue_type", "column", "severity", "affected_rows", "total_rows")


@query()
def issue_report_with_models(spark, sf_dir):
    """Issues of rules and models with examples and options; training has no SQL."""
    df = load(spark, sf_dir, "part").selectExpr(f"p_partkey AS {ROW}", "p_name AS name", "p_brand AS brand", "CASE WHEN p_partkey % 89 = 0 THEN '999' ELSE CAST(p_size AS STRING) END AS size", "CASE WHEN p_partkey % 83 = 0 THEN '-1' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS price")
    report, _ = analyze(df)
    return issues_frame(spark, report.issues)


_CLEANED = (
    f"{CTE}, w AS (SELECT k, id, {s_strip('name')} AS name, acct_amount, {s_strip('age')} AS age, {s_strip('segment')} AS segment, nation, {s_date('join_date')} AS join_date FROM dirty), "
    f"f AS (SELECT (SELECT {s_number_text('m')} FROM (SELECT median({s_num('acct_amount')}) AS m FROM w WHERE NOT {s_missing('acct_amount')} AND NOT {s_missing('name')})) AS amount), "
    f"g AS (SELECT id, name, CASE WHEN {s_missing('acct_amount')} THEN amount ELSE acct_amount END AS acct_amount, age, segment, nation, join_date FROM w, f), "
    f"h AS (SELECT id, name, {s_num('''translate(acct_amount, ',$', '')''')} AS x, {s_num('age')} AS a, age, segment, nation, join_date FROM g), "
    f"n AS (SELECT * FROM h WHERE NOT {s_missing('name')} AND coalesce(x >= 0, true)) "
)


@query(_CLEANED + f"SELECT id, name, {s_number_text('x', 6)} AS acct_amount, CASE WHEN a IS NOT NULL THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE age END AS age, segment, nation, join_date FROM n")
def apply_fixes_pipeline(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    report, table = analyze(df, models=False)
    chosen = {"acct_amount:MISSING_VALUES": "fill_median", "name:MISSING_VALUES": "drop_rows", "acct_amount:MIXED_TYPES": "coerce_null", "acct_amount:NEGATIVE_VALUES": "drop_rows"}
    order = [V.WHITESPACE, V.DUPLICATES, V.DATES, V.MISSING, V.MIXED, V.NEGATIVE]
    issues = sorted(report.issues, key=lambda i: order.index(i.issue_type))
    return repair.apply_fixes(table.df, issues, chosen).drop(ROW)


@query(f"{CTE}, t AS (SELECT k AS row_id, 'missing_value' AS label FROM dirty WHERE k % 11 = 0 OR k % 20 = 0), d AS (SELECT k AS row_id, 'missing_value' AS label FROM dirty WHERE {s_missing('name')}), j AS (SELECT d.row_id AS a, t.row_id AS b FROM d FULL OUTER JOIN t ON d.row_id = t.row_id AND d.label = t.label), c AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (b IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM j) SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS \"precision\", round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 4) AS f1 FROM c")
def eval_labels(spark, sf_dir):
    df = dirty_customer(spark, sf_dir)
    truth = df.filter(f"{ROW} % 11 = 0 or {ROW} % 20 = 0").select(F.col(ROW).alias("row_id"), F.lit("missing_value").alias("label"))
    found = df.filter(E.is_missing("name")).select(F.col(ROW).alias("row_id"), F.lit("missing_value").alias("label"))
    return evaluate.compare(found, truth)


_SWEEP = " UNION ALL ".join(f"SELECT {t} AS threshold, count(*) FILTER (x > {t} AND y) AS tp, count(*) FILTER (x > {t} AND NOT y) AS fp, count(*) FILTER (NOT x > {t} AND y) AS fn FROM s" for t in (0.05, 0.25, 0.5, 0.75))
_SCORED = f"WITH s AS (SELECT (c_custkey % 100) / 100.0 AS x, c_custkey % 100 >= 60 OR c_custkey % 7 = 0 AS y FROM customer), c AS ({_SWEEP}), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS q FROM c), e AS (SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, round(p, 4) AS \"precision\", round(q, 4) AS recall, round(2 * p * q / (p + q), 4) AS f1 FROM r)"


def _swept(spark, sf_dir) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    scores = df.select(F.col("c_custkey").alias(ROW), ((F.col("c_custkey") % 100) / 100.0).cast("double").alias("score"))
    truth = df.filter("c_custkey % 100 >= 60 or c_custkey % 7 = 0").select(F.col("c_custkey").alias("row_id"))
    return evaluate.sweep(scores, truth, [0.05, 0.25, 0.5, 0.75])


@query(f"{_SCORED} SELECT * FROM e")
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir)


@query(f"{_SCORED} SELECT * FROM e ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(_swept(spark, sf_dir))


@query(
    s_union(lambda c: f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NOT NULL AND {s_missing(c)}) AS disguised, count(*) FILTER ({c} IS NOT NULL AND ({s_num(c)}) IS NULL) AS not_numeric FROM dirty")
    + f" UNION ALL SELECT '_rows', CAST(sum(n - 1) AS BIGINT), 0, 0 FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(COLUMNS)})"
)
def baseline_profile(spark, sf_dir):
    return baseline(dirty_customer(spark, sf_dir))


@query(f"{CTE}, r AS (SELECT k, segment, row_number() OVER (ORDER BY k) AS r FROM dirty WHERE segment <> {s_strip('segment')}) SELECT concat('''', segment, '''') AS example, r AS place FROM r WHERE r <= 5")
def topk_examples(spark, sf_dir):
    """The first five examples that a report shows."""
    table = Table(dirty_customer(spark, sf_dir))
    shown = table.examples[("space", "segment")]
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(shown)], "example string, place long")


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency_percentiles(load(spark, sf_dir, "events"), "value")


@query(f"WITH i AS ({s_issues()}) SELECT \"column\", issue_type FROM i WHERE issue_type IN ('MISSING_VALUES', 'MIXED_TYPES', 'NEGATIVE_VALUES')")
def recommended_selection(spark, sf_dir):
    """What the user has to decide; each has a recommended action."""
    report, _ = analyze(dirty_customer(spark, sf_dir), models=False)
    rows = [tuple(k.rsplit(":", 1)) for k in recommended(report.issues)]
    return spark.createDataFrame(rows, "column string, issue_type string")


@query(f"{CTE} SELECT id, name FROM dirty WHERE NOT {s_missing('name')}")
def required_name(spark, sf_dir):
    return repair.require_name(dirty_customer(spark, sf_dir), "name").select("id", "name")


@query(f"{CTE}, n AS (SELECT {s_date('join_date')} AS d FROM dirty) SELECT count(*) AS filled, count(*) FILTER (TRY_CAST(d AS DATE) IS NOT NULL) AS dates, count(*) FILTER (TRY_CAST(d AS DATE) IS NOT NULL) >= 0.7 * count(*) AS is_date_column FROM n")
def date_role(spark, sf_dir):
    df = dirty_customer(spark, sf_dir).filter(~E.is_blank("join_date"))
    counts = df.agg(F.count("*").alias("filled"), F.count_if(E.is_date("join_date")).alias("dates"))
    return counts.withColumn("is_date_column", F.col("dates") >= V.DATE_SHARE * F.col("filled"))


@query(f"SELECT p_partkey, {s_norm('p_name')} AS norm, CAST(len({s_tokens('p_name')}) AS INTEGER) AS tokens FROM part")
def fuzzy_normalised(spark, sf_dir):
    df = load(spark, sf_dir, "part").select("p_partkey", E.fuzzy_norm("p_name").alias("norm"))
    return df.select("p_partkey", "norm", F.size(E.fuzzy_tokens(F.col("norm"))).alias("tokens"))


@query("SELECT c_custkey, round(greatest(0, x), 6) AS relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round((1 / (1 + exp(-x))) * (1 - 1 / (1 + exp(-x))), 6) AS slope, round((x * x + (x - 1) * (x - 1)) / 2, 6) AS mse FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def activations(spark, sf_dir):
    x = F.col("c_acctbal") / 1000
    cells = {"relu": E.relu(x), "sigmoid": E.sigmoid(x), "slope": E.sigmoid_slope(x), "mse": E.mse([x, x], [F.lit(0.0), F.lit(1.0)])}
    return load(spark, sf_dir, "customer").select("c_custkey", *(F.round(v, 6).alias(k) for k, v in cells.items()))


@query(f"{CTE} SELECT id, age FROM dirty WHERE coalesce({s_num('acct_amount')}, 0) <= 9000")
def drop_listed_rows(spark, sf_dir):
    """An anti-join by row id, as for anomalous rows."""
    df = dirty_customer(spark, sf_dir)
    return repair.fix_anomalies(df, "drop_rows", df.filter(E.num("acct_amount") > 9000).select(ROW)).select("id", "age")


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS n FROM documents), f AS (SELECT regr_slope(n, w) AS a, regr_intercept(n, w) AS b FROM d WHERE n IS NOT NULL) SELECT doc_id, coalesce(CAST(n AS DOUBLE), round(a * w + b, 1)) AS n_chars FROM d, f")
def fill_predicted(spark, sf_dir):
    """Imputed cells joined back to their rows."""
    df = load(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), F.size(F.split("text", " ")).cast("string").alias("words"), F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).cast("string").alias("n"))
    found = models.impute(df, models.fit_regressor(df, "n", ["words"])).select(F.col(ROW).alias("row"), F.lit("n").alias("column"), "predicted_value")
    return models.fill_imputed(df, found).select(F.col(ROW).alias("doc_id"), F.round(F.col("n").cast("double"), 1).alias("n_chars"))


@query(f"{CTE}, r AS (SELECT segment, min(k) AS k FROM dirty WHERE {s_filled('segment')} GROUP BY 1) SELECT segment AS example, row_number() OVER (ORDER BY k) AS place FROM r ORDER BY k LIMIT 5")
def first_distinct_values(spark, sf_dir):
    found = sample_values(dirty_customer(spark, sf_dir), "segment")
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(found)], "example string, place long")


# --- files, generator, streams


@query(f"{CTE} SELECT id, " + ", ".join(f"CASE WHEN {c} IN ('N/A', '') THEN NULL ELSE {c} END AS {c}" for c in COLUMNS[1:]) + " FROM dirty")
def csv_round_trip(spark, sf_dir):
    """Written as CSV and read again: null tokens are null then, white space stays."""
    path = f"{_folder(spark)}/csv"
    write_csv(dirty_customer(spark, sf_dir).drop(ROW), path)
    return read_csv(spark, path)


@query("SELECT l_returnflag, round(avg(l_extendedprice), 6) AS price, count(*) AS n FROM lineitem GROUP BY 1")
def json_round_trip(spark, sf_dir):
    path = f"{_folder(spark)}/json"
    write_json(load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("price"), F.count("*").alias("n")), path)
    return spark.read.schema("l_returnflag string, n long, price double").json(path).select("l_returnflag", "price", "n")


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.rstrip('/')}/sievra-files" if named else "file://" + tempfile.mkdtemp(prefix="sievra-")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS low, CAST(count(*) - 1 AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS ids FROM lineitem")
def row_positions(spark, sf_dir):
    df = with_row_ids(load(spark, sf_dir, "lineitem").select("l_orderkey"))
    return df.agg(F.count("*").alias("n"), F.min(ROW).alias("low"), F.max(ROW).alias("high"), F.countDistinct(ROW).alias("ids"))


@query()
def generated_rows(spark, sf_dir):
    """A generated dirty table as large as customer, with its errors' labels; values are hashes of Spark's."""
    df, truth = datagen.generate(spark, load(spark, sf_dir, "customer").count())
    labels = truth.groupBy("row_id").agg(F.min("label").alias("label"))
    return df.join(labels, df[ROW] == labels.row_id, "left").drop("row_id")


@query()
def generated_accuracy(spark, sf_dir):
    """The rules against the labels of a generated table, counted anew and as in the published figures."""
    df, truth = datagen.generate(spark, load(spark, sf_dir, "customer").count())
    report, table = analyze(df, models=False)
    fixed = evaluate.compare(evaluate.row_labels(table, report.issues), truth)
    compat = evaluate.compare(evaluate.row_labels(table, report.issues, compat=True), truth)
    return fixed.withColumn("counting", F.lit("fixed")).unionByName(compat.withColumn("counting", F.lit("compat")))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, 'event_type' AS \"column\", count(*) AS total, count(*) FILTER (" + s_missing("event_type") + ") AS missing FROM events GROUP BY 1")
def windowed_events(spark, sf_dir):
    """Quality per day; the same plan runs on a stream."""
    df = quality.windowed_quality(load(spark, sf_dir, "events"), "ts", "1 day", columns=["event_type"])
    return df.select(F.col("window.start").alias("start"), "column", F.col("rows").alias("total"), "missing")

