"""The driver's contract, and the engine's queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from palisade import catalog

DATA = "/root/testdata/sf0.001"
#: The dearest queries share their operators with others that run here.
SAMPLE = ["nearest_in_scope", "nearest_int8", "text_words", "text_numbers", "guard_numeric", "guard_substitution", "lookup_decisions", "lookup_shadow", "stats_by_scope", "admission_rates", "adaptive_thresholds", "score_by_guard", "calibrate_outcomes", "cache_answers", "stats_spans", "store_log", "store_bytes", "store_recent", "stream_metrics", "stream_answers"]


def cells(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(cells, x))
    return x


def test_names_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("embeddings", "events", "orders", "conversations", "documents", "customer", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((cells(tuple(r[c] for c in columns)) for r in df.collect()), key=str)
    found = con.execute(catalog.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted((cells(tuple(r[i] for i in at)) for r in found.fetchall()), key=str)
