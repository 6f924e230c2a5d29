"""Every named query against DuckDB on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from fluxmere.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in catalog.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = [tuple(map(plain, r)) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert found
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    at = [df.columns.index(n) for n in names]
    assert sorted((tuple(r[k] for k in at) for r in found), key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_int_gt"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_quantiles_are_exact(spark, tmp_path):
    """Normal values, few values, one value for most rows, NaN and infinities: by DuckDB's discrete quantiles."""
    from fluxmere.operators.statistics import quantiles

    db = duckdb.connect()
    db.execute("SELECT setseed(0.5)")
    db.execute(
        "CREATE TABLE t AS SELECT sqrt(-2 * ln(random() + 1e-12)) * cos(2 * pi() * random()) AS normal, floor(random() * 50) AS few, CASE WHEN random() < 0.95 THEN 0 ELSE random() END AS most, "
        "CASE WHEN random() < 0.3 THEN 'nan'::double WHEN random() < 0.2 THEN 'inf'::double WHEN random() < 0.2 THEN '-inf'::double WHEN random() < 0.9 THEN random() END AS odd FROM range(200000)"
    )
    db.execute(f"COPY t TO '{tmp_path}/t.parquet' (FORMAT parquet)")
    qs = ["0", "0.0001", "0.25", "0.5", "0.5001", "0.69", "0.71", "0.9", "0.95", "0.9999", "1"]
    found = quantiles([spark.read.parquet(f"{tmp_path}/t.parquet").repartition(7)], {"probabilities": ";".join(qs)}).collect()
    want = {(c, float(q)): db.execute(f"SELECT quantile_disc({c}, {q}) FROM t").fetchone()[0] for c in ("normal", "few", "most", "odd") for q in qs}
    assert {(r.column_name, r.q): repr(r.value) for r in found} == {k: repr(v) for k, v in want.items()}
    empty = quantiles([spark.sql("SELECT cast(null AS double) AS a, 1.5D AS b")], {"probabilities": "0.5"}).collect()
    assert [tuple(r) for r in empty] == [("a", 0.5, None), ("b", 0.5, 1.5)]
