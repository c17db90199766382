"""Every registered query with an oracle agrees with DuckDB on sf0.001."""
import math

import pytest

import __spark_entry__ as entry
from conftest import SF

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "cui", "label", "n", "concept"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    sd = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    oc = [d[0] for d in cur.description]
    od = cur.fetchall()
    assert sorted(df.columns) == sorted(oc)
    assert _rows(df.columns, sd) == _rows(oc, od)
