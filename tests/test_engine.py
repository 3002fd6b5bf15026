"""Reports and repairs of whole tables, against results worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievra.api import Service
from sievra.functions import exprs as E
from sievra.functions import vocab as V
from sievra.operators import duplicates, evaluate, fuzzy, models, repair
from sievra.operators.detect import Table, analyze, analyze_csv, numeric_columns
from sievra.operators.profile import baseline, medians, modes, profile
from sievra.plans.report import issues_frame, recommended, undecided
from sievra.sources import datagen
from sievra.sources.tables import ROW, labels_from_json, read_csv, with_row_ids, write_csv

# Two sample files whose reports are known.
BASIC = """name,email,age,created_at,salary
John Smith ,john@gmail.com,25,2023-01-15,50000
Jane Doe,jane@gmail.com,N/A,01/16/2023,60000
John Smith ,john@gmail.com,25,2023-01-15,50000
Bob Jones,N/A,30,Jan 17 2023,not available
Alice Brown,alice@gmail.com,none,2023-01-18,75000
"""
MESSY = """id,  Name ,email,Age,  Phone  ,salary,join_date,Department,status
1,John Smith,john.smith@email.com,34,555-123-4567,75000,2021-03-15,Engineering,active
2,  Jane Doe  ,JANE.DOE@EMAIL.COM,29,  (555) 987-6543  ,82000.00,15/04/2020,  Marketing  ,Active
3,Bob Johnson,bob.johnson@email,45,5551234567,NULL,2019-07-01,Engineering,ACTIVE
4,Alice Brown,alice.brown@email.com,,555.234.5678,91000,01-08-2018,HR,active
5,Charlie Wilson,charlie@wilson@email.com,38,+1-555-345-6789,67500,2022/11/30,Sales,inactive
6,Emily Davis,emily.davis@email.com,27,555-456-7890,N/A,2023-01-10,Marketing,Active
7,  ,frank.miller@email.com,52,555-567-8901,105000,2017-05-22,Engineering,active
8,Grace Lee,grace.lee@email.com,31,555-678-9012,78000,2020-09-14,HR,
9,Henry Taylor,henry.taylor@email.com,999,555-789-0123,88000,2021-06-30,Sales,active
10,Isabella Martinez,isabella.martinez@email.com,41,555-890-1234,-5000,2019-12-01,Marketing,active
11,James Anderson,,36,555-901-2345,72000,2022-04-17,Engineering,active
12,Karen Thomas,karen.thomas@email.com,44,555-012-3456,95000,2018-08-09,HR,INACTIVE
13,Liam Jackson,liam.jackson@email.com,28,555-111-2222,61000,2023-07-25,Sales,active
14,Mia White,mia.white@email.com,33,555-222-3333,84000,2020-02-28,Marketing,Active
15,liam.jackson@email.com,noah.harris@email.com,39,555-333-4444,77000,2021-10-05,Engineering,active
16,Olivia Martin,olivia.martin@email.com,26,555-444-5555,58000,2023-03-12,Sales,active
17,Olivia Martin,olivia.martin@email.com,26,555-444-5555,58000,2023-03-12,Sales,active
18,Peter Garcia,peter.garcia@email.com,47,555-555-6666,112000,2016-11-18,HR,active
19,Quinn Rodriguez,quinn.rodriguez@email.com,thirty,555-666-7777,69000,2022-08-14,Marketing,active
20,Rachel Lewis,rachel.lewis@email.com,35,,83000,2020-06-21,Engineering,active
21,Samuel Robinson,samuel.robinson@email.com,42,555-777-8888,97000,9999-99-99,Sales,active
22,Tara Clark,tara.clark@email.com,30,555-888-9999,71000,2021-12-03,HR,active
23,Umar Wright,umar.wright@email.com,38,555-999-0000,86000,2019-04-16,Engineering,active
,Victoria Hill,victoria.hill@email.com,29,555-000-1111,63000,2023-05-07,Sales,active
25,William Scott,william.scott@email.com,55,555-123-9876,120000,2015-09-30,Engineering,  active  
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    (d / "basic.csv").write_text(BASIC)
    (d / "messy.csv").write_text(MESSY)
    return d


def rows(df):
    return [tuple(r) for r in df.orderBy(ROW).drop(ROW).collect()]


def test_basic_report_and_repair(spark, files):
    report, table = analyze_csv(spark, str(files / "basic.csv"), models=False)
    found = {i.key: i for i in report.issues}
    assert set(found) == {"email:MISSING_VALUES", "age:MISSING_VALUES", "None:DUPLICATE_ROWS", "created_at:DATE_FORMAT_INCONSISTENT", "salary:MIXED_TYPES", "name:WHITESPACE"}
    assert report.rows_analyzed == 5 and report.cols_analyzed == 5
    age = found["age:MISSING_VALUES"]
    assert (age.severity, age.affected_rows, age.examples) == (V.HIGH, 2, ["none"])
    assert [o.action for o in age.fix_options] == ["fill_median", "fill_mean", "leave_empty", "drop_rows"] and age.fix_options[0].preview == "25.0"
    assert found["email:MISSING_VALUES"].examples == ["(empty)"] and found["email:MISSING_VALUES"].affected_pct == 20.0
    assert found["None:DUPLICATE_ROWS"].affected_rows == 1 and found["None:DUPLICATE_ROWS"].examples == ["John Smith  | john@gmail.com | 25 | 2023-01-15"]
    assert found["created_at:DATE_FORMAT_INCONSISTENT"].affected_rows == 2
    assert found["salary:MIXED_TYPES"].examples == ["not available"] and found["salary:MIXED_TYPES"].confidence == 0.8
    assert found["name:WHITESPACE"].examples == ["'John Smith '", "'John Smith '"]
    assert [i.severity for i in report.issues] == sorted((i.severity for i in report.issues), key=["HIGH", "MEDIUM", "LOW"].index)
    chosen = {"age:MISSING_VALUES": "fill_median", "email:MISSING_VALUES": "fill_mode", "salary:MIXED_TYPES": "coerce_null"}
    assert {i.key for i in undecided(report.issues, {})} == set(chosen) and not undecided(report.issues, chosen)
    assert rows(repair.apply_fixes(table.df, report.issues, chosen)) == [
        ("John Smith", "john@gmail.com", "25", "2023-01-15", "50000"),
        ("Jane Doe", "jane@gmail.com", "27.5", "2023-01-16", "60000"),
        ("Bob Jones", "alice@gmail.com", "30", "2023-01-17", None),
        ("Alice Brown", "alice@gmail.com", "27.5", "2023-01-18", "75000"),
    ]


def test_messy(spark, files):
    report, table = analyze_csv(spark, str(files / "messy.csv"))
    assert table.columns == ["id", "Name", "email", "Age", "Phone", "salary", "join_date", "Department", "status"]
    found = {i.key: i for i in report.issues}
    assert found["None:DUPLICATE_ROWS"].affected_rows == 1
    assert found["Age:MIXED_TYPES"].examples == ["thirty"]
    assert found["salary:NEGATIVE_VALUES"].examples == ["Row 9 (salary=-5000)"]
    assert numeric_columns(table) == ["id", "Age", "salary"]
    assert found["None:ANOMALY"].examples[0].startswith("Row 8 ")
    fuzzy_issue = found["Name:FUZZY_DUPLICATE"]
    assert fuzzy_issue.affected_rows == 2 and fuzzy_issue.confidence == 0.518 and fuzzy_issue.fix_tier == V.FLAG_ONLY
    pairs = fuzzy.row_pairs(table.df, "Name", ROW).collect()
    assert [(p.row_a, p.row_b, p.value_a, round(p.similarity, 6)) for p in pairs] == [(12, 14, "Liam Jackson", 0.518182)]
    cells = models.imputations(table.df, numeric_columns(table)).collect()
    assert {(c.row, c.column) for c in cells} == {(23, "id"), (3, "Age"), (18, "Age"), (2, "salary"), (5, "salary")}
    filled = models.fill_imputed(table.df, models.imputations(table.df, numeric_columns(table), hidden=True))
    assert filled.count() == 25 and filled.filter("Age is null or salary is null").count() == 0
    clean = repair.apply_fixes(table.df, report.issues, recommended(report.issues) | {"null:ANOMALY": "drop_rows"}, table.found["anomalies"])
    names = [r["Name"] for r in clean.collect()]
    assert "Henry Taylor" not in names and None not in names and names.count("Olivia Martin") == 1
    assert issues_frame(spark, report.issues).count() == len(report.issues)


def test_service_and_files(spark, files, tmp_path):
    service = Service(spark, str(tmp_path))
    job = service.submit(str(files / "basic.csv"), models=False)
    assert service.health() == {"status": "ok"} and service.report(job)["total_issues"] == 6
    with pytest.raises(ValueError):
        service.download(job)
    with pytest.raises(KeyError):
        service.report("none")
    with pytest.raises(ValueError):
        service.submit("x.CSV")
    chosen = service.recommended(job)
    assert service.can_fix(job, chosen) and not service.can_fix(job, {})
    assert service.fix(job, chosen) == {"job_id": job, "rows_in": 5, "rows_out": 4, "rows_removed": 1}
    assert read_csv(spark, service.download(job)).count() == 4
    json.dumps(service.report(job))


def test_csv_keeps_odd_fields(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'say "x"', "two\nlines", None), ("b", "c,d", "", "N/A")], "p string, q string, r string, s string")
    write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "t")).collect())) == [(" a ", 'say "x"', "two\nlines", None), ("b", "c,d", None, None)]


def test_row_ids(spark):
    df = spark.range(1000).repartition(7).select("id")
    got = [r[ROW] for r in with_row_ids(df).collect()]
    assert sorted(got) == list(range(1000))


def test_medians_and_modes(spark, monkeypatch):
    from sievra.operators import profile as p

    monkeypatch.setattr(p, "MEDIAN_ROWS", 10)
    rng = random.Random(1)
    data = [(rng.choice([None, rng.random() * 1e6, float(rng.randrange(5))]), float(rng.randrange(3)), rng.choice(["b", "a", None])) for _ in range(5001)]
    df = spark.createDataFrame(data, "x double, y double, z string")
    import statistics

    got = medians(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None).cast("double")})
    assert got == {"x": statistics.median(v[0] for v in data if v[0] is not None), "y": statistics.median(v[1] for v in data), "none": None}
    tie = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "z string")
    assert modes(tie, {"z": F.col("z"), "n": F.lit(None).cast("string")}) == {"z": "a", "n": None}


def test_duplicates(spark):
    df = with_row_ids(spark.createDataFrame([("1", "x", None), ("2", "x ", None), ("3", "y", None), ("4", "x", "q")], "id string, a string, b string").coalesce(1))
    for flags in (duplicates.duplicate_flags, duplicates.duplicate_flags_by_window):
        assert [r._duplicate for r in flags(df).orderBy(ROW).collect()] == [False, True, False, False]
    assert duplicates.count_duplicates(df) == 1
    ids = df.select(ROW, "id")
    assert duplicates.count_duplicates(ids) == 0 and not any(r._duplicate for r in duplicates.duplicate_flags(ids).collect())
    assert duplicates.compared_columns(["id", "width", "paid", "monkey", "name"]) == ["name"]


def test_severities(spark):
    for missing, want in ((5, V.LOW), (6, V.MEDIUM), (30, V.MEDIUM), (31, V.HIGH)):
        df = with_row_ids(spark.createDataFrame([("?" if i < missing else f"v{i}",) for i in range(100)], "a string"))
        (issue,) = [i for i in analyze(df, models=False)[0].issues if i.issue_type == V.MISSING]
        assert issue.severity == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert analyze(empty)[0].issues == []
    assert analyze(spark.createDataFrame([(None, None)] * 3, "a string, b string"))[0].rows_analyzed == 3
    assert repair.apply_fixes(with_row_ids(empty), [], {}).count() == 0
    assert baseline(empty).count() == 3 and profile(empty)["a"].rows == 0


def test_repairs(spark):
    df = with_row_ids(spark.createDataFrame([("5", "-2.50"), ("50%", None), ("x", "7"), (None, "abc")], "a string, b string").coalesce(1))
    assert rows(repair.fix_mixed(df, "a", "drop_rows").select(ROW, "a")) == [("5",), (None,)]
    assert rows(repair.fix_mixed(df, "a", "keep_as_text").select(ROW, "a")) == [("5",), ("50%",), ("x",), (None,)]
    assert rows(repair.fix_negative(df, "b", "abs_values").select(ROW, "b")) == [("2.5",), (None,), ("7",), ("abc",)]
    assert rows(repair.fix_negative(df, "b", "drop_rows").select(ROW, "b")) == [(None,), ("7",), ("abc",)]
    assert rows(repair.fix_missing(df, "b", "fill_mean").select(ROW, "b")) == [("-2.50",), ("2.25",), ("7",), ("abc",)]
    assert repair.fix_missing(df, "none", "drop_rows") is df


def test_generator_and_evaluation(spark, tmp_path):
    df, truth = datagen.generate(spark, 2000)
    assert df.count() == 2060 and df.columns == [ROW, *datagen.COLUMNS]
    assert 340 < truth.filter("label != 'duplicate'").count() < 520 and truth.filter("label = 'duplicate'").count() == 60
    again, _ = datagen.generate(spark, 2000)
    assert df.exceptAll(again).count() == 0
    report, table = analyze(df, models=False)
    got = evaluate.compare(evaluate.row_labels(table, report.issues), truth).first()
    compat = evaluate.compare(evaluate.row_labels(table, report.issues, compat=True), truth).first()
    assert got.precision > 0.7 and got.recall > 0.5 and got.tp > compat.tp
    (tmp_path / "t.json").write_text(json.dumps({"3": ["a", "b"], "5": ["a"]}))
    assert sorted(map(tuple, labels_from_json(spark, str(tmp_path / "t.json")).collect())) == [(3, "a"), (3, "b"), (5, "a")]
    model = models.fit_autoencoder(df, ["age", "salary"])
    scores = models.anomaly_scores(df, model)
    swept = evaluate.sweep(scores, truth.filter("label = 'anomaly'"), [0.05, 0.15, 0.3])
    assert swept.count() == 3 and evaluate.best_threshold(swept).first().precision > 0.5
    assert evaluate.summary(spark.createDataFrame([(10, 5.0, 0.5, 0.2), (20, 9.0, 1.0, 0.4)], "rows long, rows_per_s double, speedup double, f1 double")).first().rows_of_best_f1 == 20


def test_fuzzy_join_loses_nothing(spark, monkeypatch):
    rng = random.Random(3)
    words = ["ann", "bob", "cat", "dog", "", "--", "x1"]
    vals = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) + rng.choice(["", ".", "!"]) for _ in range(120)} | {"ANN", "ann"})
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v string")
    bare = sorted({v.strip(" ") for v in vals} | {""})
    all_pairs = spark.createDataFrame([(a, b) for a in bare for b in bare if a < b and a.lower() != b.lower()], "a string, b string")
    whole = {(r.a, r.b) for r in all_pairs.filter(E.fuzzy_similarity("a", "b") >= 0.45).collect()}
    with pytest.raises(ValueError):
        fuzzy.value_pairs(df, "v", 0.4)
    assert {(r.value_a, r.value_b) for r in fuzzy.value_pairs(df, "v").collect()} == whole
    monkeypatch.setattr(fuzzy, "CHUNK", 7)
    assert {(r.value_a, r.value_b) for r in fuzzy.value_pairs(df, "v").collect()} == whole
    total = fuzzy.pair_counts(df, "v").first()
    assert total.pairs == fuzzy.row_pairs(with_row_ids(df), "v", ROW).count() and fuzzy.row_pairs(with_row_ids(df), "v", ROW).count() >= len(whole)


def test_networks(spark):
    import numpy as np

    layers = models.network([2, 3, 1])
    x = np.random.default_rng(1).normal(size=(50, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    got = np.array([r.o[0] for r in models.with_network(df, layers, [F.col("a"), F.col("b")], "o").collect()])
    assert np.allclose(np.sort(got), np.sort(models.predict(layers, x)[:, 0]))
    y = (x[:, :1] * 2 - x[:, 1:]) / 2
    assert models.train(layers, x, y, 0.02, 300) < 0.05
    assert models.autoencoder_sizes(3) == [3, 2, 2, 2, 3] and models.fit_autoencoder(df, []) is None
    assert models.fit_regressor(df.limit(3), "a", ["b"]) is None


def test_detectors_can_be_registered(spark):
    from sievra.operators import detect
    from sievra.plans.report import Issue

    @detect.register
    def header_issue(table: Table):
        return [Issue("HEADER_ISSUES", c, V.LOW, V.FLAG_ONLY, 0, table.rows, [], "odd name", 1.0) for c in table.columns if c != c.lower()]

    try:
        df = with_row_ids(spark.createDataFrame([("x",)], "Odd string"))
        assert [i.issue_type for i in analyze(df, models=False)[0].issues] == ["HEADER_ISSUES"]
    finally:
        detect.RULES.remove(header_issue)
