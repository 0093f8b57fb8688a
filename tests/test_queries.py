"""Every query of the library against its SQL in DuckDB, over the smallest test tables."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from gleanery import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    """A value as both engines print it; floats to nine digits."""
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    rows = [[plain(r[c]) for c in sorted(found.columns)] for r in found.collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = [[plain(r[names.index(c)]) for c in sorted(names)] for r in cursor.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_names_and_sql_are_known_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
