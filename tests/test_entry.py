"""The driver's contract, and every query of the rules against its SQL."""

import datetime
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from sievra.plans import queries as rules

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns == ["issue_type", "column", "severity", "affected_rows", "total_rows"]


def test_names():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(rules.QUERIES) <= set(q) and set(o) <= set(q) and set(rules.ORACLES) <= set(o)


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(rules.ORACLES))
def test_query_and_sql(spark, con, name):
    df = rules.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = con.execute(rules.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(rules.QUERIES) - set(rules.ORACLES)))
def test_query_without_sql(spark, name):
    assert rules.QUERIES[name](spark, DATA).columns


def test_library_does_without_the_corpus_operators(tmp_path):
    for f in ROOT.rglob("*.py"):
        part = f.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'issue_report' in q and not any(k.startswith('op') for k in q), list(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
