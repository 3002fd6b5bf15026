"""Rules of single values; cases are small and written out."""

import datetime

import pytest
from pyspark.sql import functions as F

from sievra.functions import exprs as E


def values(spark, expr, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


CASES = [
    (E.strip, ["\t a ", " x ", "a", "", None, " a b\n", "\x1cq\x1f"], ["a", "x", "a", "", None, "a b", "q"]),
    (E.is_missing, [None, "", " - ", "Unknown", "N/A", "0", "x", "nil", "na"], [True, True, True, True, True, False, False, True, True]),
    (E.num, [" 5 ", "1e3", "-2.5", ".5", "5.", "5d", "0x10", "1,000", "nan", "1_000", "$5", "", None], [5, 1000, -2.5, 0.5, 5, None, None, None, None, None, None, None, None]),
    (E.num_fixed, ["$1,000", "50%", "x"], [1000, None, None]),
    (E.num_detected, ["$1,000", "50%", "x"], [1000, 50, None]),
    (E.is_numeric_detected, ["50%", "$5", "1_000", "nan", "inf", "thirty", "1_", "5 0"], [True, True, True, True, True, False, False, False]),
    (E.is_numeric_fixed, ["50%", "$5", None, "nan", "x"], [False, True, True, True, False]),
    (E.num_prefix, ["15abc", "555.234.5678", "x1", " 7", None], [15, 555.234, None, 7, None]),
    (E.has_middle_dash, ["2020-01-02", "-5", "5-", "1/2", "555-123", None], [True, False, False, True, True, False]),
    (E.has_outer_space, [" a", "a", None, "a\t"], [True, False, False, True]),
    (E.display, [" a", "it's", "a\tb", 'q"\''], ["' a'", '"it\'s"', "'a\\tb'", "'q\"\\''"]),
    (E.date_signature, ["2023-01-15", "01/16/2023", "2022/11/30", "Jan 17 2023", "01-08-2018", "a/b", "x", None], ["YYYY-MM-DD", "MM/DD/YYYY", "YYYY/MM/DD", "MONTH DD YYYY", "OTHER", "OTHER", "OTHER", None]),
    (E.normalize_date, ["15/04/2020", "01/02/2023", "01/16/2023", "Jan 17 2023", "17 January 2023", "January 17, 2023", "9999-99-99", "2021-03-05", "2022/11/30", "01-08-2018", "not-a-date", "2020-13-01", "32/13/2020", "1850-01-01", "2021-03-05 10:30", None],
     ["2020-04-15", "2023-02-01", "2023-01-16", "2023-01-17", "2023-01-17", "2023-01-17", "9999-99-99", "2021-03-05", "2022-11-30", "2018-08-01", "not-a-date", "2020-13-01", "32/13/2020", "1850-01-01", "2021-03-05", None]),
    (lambda c: E.normalize_date(c, swap_iso=True), ["2021-03-05", "2020-13-01", "2021-06-30", "2022/11/30"], ["2021-05-03", "2020-01-13", "2021-06-30", "2022-11-30"]),
    (E.fuzzy_norm, ["Jane. Doe!", "  A--b ", "É x", ""], ["jane doe ", "a b ", "x", ""]),
    (E.whole_text, ["34.0", "007", "x", None, "n/a", "-5"], ["34", "7", "x", None, "n/a", "-5"]),
    (E.na_to_null, ["N/A", "none", "-", "", "x", None], [None, "none", "-", None, "x", None]),
    (lambda c: E.number_text(E.num(c)), ["27.5", "30.0", "2.345", "-15.00", "1e3", None], ["27.5", "30", "2.35", "-15", "1000", None]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_values(spark, k):
    expr, texts, want = CASES[k]
    assert values(spark, expr, texts) == want


def test_dates_are_calendar_dates(spark):
    assert values(spark, E.parse_date, ["29/02/2020", "29/02/2021", "31 Apr 2020"]) == [datetime.date(2020, 2, 29), None, None]


def similarity(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(E.fuzzy_similarity("a", "b")).first()[0]


def test_similarity(spark):
    assert round(similarity(spark, "Liam Jackson", "liam.jackson@email.com"), 6) == 0.518182
    assert similarity(spark, "--", "..") == 1.0
    assert similarity(spark, "abc", "abc") == 1.0
    assert similarity(spark, "abc def", "def abc") < 1.0


def test_model_expressions(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    x = F.col("x")
    one = F.lit(1.0)
    got = df.select(E.min_max(x, one, F.lit(5.0)), E.min_max(x, x, x), E.z_score(x, one, F.lit(2.0)), E.z_score(x, one, F.lit(0.0)), E.from_z(one, one, F.lit(2.0)), E.relu(-x), E.relu_slope(x), E.sigmoid(x - x), E.sigmoid_slope(x - x), E.mse([x, one], [one, one]), E.mse_slope(x, one, 2)).first()
    assert list(got) == [0.5, 0.5, 1.0, 2.0, 3.0, 0.0, 1.0, 0.5, 0.25, 2.0, 2.0]
