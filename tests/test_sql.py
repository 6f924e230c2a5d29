"""The grammar of the extended SQL."""

import pytest

from fluxmere.errors import EngineError
from fluxmere.sql import parse, where_is_safe
from fluxmere.sql.desugar import granular, named_channels, time_range, time_ranges


def test_operator_and_destination():
    q = parse("SELECT * FROM tpch.lineitem USING statistic.hist WITH bins=12 INTO dataframe.hist")
    assert (q.sources, [c.full for c in q.operators], q.with_params, q.dest, q.columns) == (["tpch.lineitem"], ["statistic.hist"], {"bins": "12"}, "dataframe.hist", [])


def test_without_operator():
    q = parse("select * from orders_today into postgresql.warehouse.orders")
    assert (q.sources, q.operators, q.dest) == (["orders_today"], [], "postgresql.warehouse.orders")
    assert parse("SELECT p_brand, p_size, p_type FROM tpch.part USING sample.row_count").columns == ["p_brand", "p_size", "p_type"]


def test_several_sources():
    q = parse("SELECT * FROM dataframe.east, dataframe.west USING builtin.hstack INTO dataframe.wide")
    assert q.sources == ["dataframe.east", "dataframe.west"]
    assert q.body == "SELECT * FROM dataframe.east, dataframe.west"


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("EXPLAIN tpch.part", "expected SELECT"),
        ("", "expected SELECT"),
        ("SELECT FROM tpch.part", "expected column name or * after SELECT"),
        ("SELECT p_size", "expected FROM"),
        ("SELECT p_size FROM", "expected source channel name after FROM"),
        ("SELECT * FROM dataframe.east,", "expected source channel name after ','"),
        ("SELECT * FROM tpch.part WHERE p_size = 1; DROP TABLE part", "WHERE clause contains forbidden keywords"),
        ("SELECT * FROM tpch.part USING histogram", "expected category.name format after USING/THEN, got: histogram"),
        ("SELECT * FROM tpch.part USING filter.threshold WITH threshold=9 WITH column=p_size", "global WITH is not supported; use WITH after each operator"),
        ("SELECT * FROM tpch.part INTO", "expected destination channel name after INTO"),
        ("SELECT '" + "y" * 65_536 + "' FROM tpch.part", "SQL too long (max 64KB)"),
    ],
)
def test_errors(sql, message):
    with pytest.raises(EngineError, match=None) as e:
        parse(sql)
    assert e.value.message == message
    assert e.value.status == 400


@pytest.mark.parametrize(
    ("sql", "body"),
    [
        ("SELECT p_brand, max(p_size) FROM tpch.part GROUP BY p_brand ORDER BY max(p_size) USING sample.row_count", "SELECT p_brand, max(p_size) FROM tpch.part GROUP BY p_brand ORDER BY max(p_size)"),
        ("SELECT p_brand FROM tpch.part WHERE p_size < 7 GROUP BY p_brand", "SELECT p_brand FROM tpch.part WHERE p_size < 7 GROUP BY p_brand"),
        ("SELECT p_brand, p_size FROM tpch.part WHERE p_size < 7 WITH limit=3 INTO dataframe.small", "SELECT p_brand, p_size FROM tpch.part WHERE p_size < 7"),
        ("SELECT o_custkey, sum(o_totalprice) FROM tpch.orders WHERE o_orderkey < 9 GROUP BY o_custkey HAVING sum(o_totalprice) < 4 ORDER BY 2 LIMIT 6 USING statistic.basic WITH columns=o_custkey INTO dataframe.s", "SELECT o_custkey, sum(o_totalprice) FROM tpch.orders WHERE o_orderkey < 9 GROUP BY o_custkey HAVING sum(o_totalprice) < 4 ORDER BY 2 LIMIT 6"),
        # Words of the extension inside SQL of its own stay there.
        ("SELECT * FROM a JOIN b USING (k) USING x.y", "SELECT * FROM a JOIN b USING (k)"),
        ("SELECT a FROM t GROUP BY a WITH ROLLUP INTO dataframe.r", "SELECT a FROM t GROUP BY a WITH ROLLUP"),
        ("SELECT CASE WHEN a THEN 1 END AS x FROM t USING o.p", "SELECT CASE WHEN a THEN 1 END AS x FROM t"),
        ("SELECT ' using x.y into z ' AS s FROM t", "SELECT ' using x.y into z ' AS s FROM t"),
        ("SELECT a FROM t WHERE reusing = 1 -- INTO nowhere", "SELECT a FROM t WHERE reusing = 1 -- INTO nowhere"),
    ],
)
def test_body(sql, body):
    assert parse(sql).body == body


def test_chain_has_its_own_parameters():
    q = parse("SELECT * FROM tpch.part USING filter.threshold WITH column=p_size,threshold='1, 5' THEN statistic.hist WITH bins=4 INTO dataframe.h")
    assert [(c.full, c.params) for c in q.operators] == [("filter.threshold", {"column": "p_size", "threshold": "1, 5"}), ("statistic.hist", {"bins": "4"})]


def test_label_granularity_and_operator_first():
    q = parse("model.train bps, rss FROM ts.x WHERE a > 1 GROUP BY application GRANULARITY 60 HAVING count(*) > 1 LABEL kind INTO dataframe.m")
    assert (q.operators[0].full, q.granularity, q.label, q.dest) == ("model.train", 60, "kind", "dataframe.m")
    assert q.body == "SELECT bps, rss FROM ts.x WHERE a > 1 GROUP BY application HAVING count(*) > 1"


def test_references_anywhere():
    q = parse("WITH c AS (SELECT * FROM a.x) SELECT * FROM c JOIN b.y AS t ON c.k = t.k WHERE k IN (SELECT k FROM d.z) AND extract(year FROM ts) > 1")
    assert [r.name for r in q.references] == ["a.x", "b.y", "d.z"]
    made = named_channels(q, lambda n: n.replace(".", "_"))
    assert "`a_x` AS `x`" in made and "`b_y` AS t" in made and "FROM c JOIN" in made


@pytest.mark.parametrize(
    ("clause", "safe"),
    [
        ("p_size < 4", True),
        ("p_brand = 'Brand#12' OR p_size IN (1, 2)", True),
        ("p_size < 4; DROP TABLE part", False),
        ("p_size < 4 -- ; DELETE FROM part", True),
        ("p_size /* UPDATE part */ < 4", True),
        ("p_size = 4 DELETE FROM part", False),
        ("TRUNCATE part", False),
        ("dropped = 1 AND inserted = 2", True),
        ("p_name = 'drop; truncate'", True),
    ],
)
def test_where_safety(clause, safe):
    assert where_is_safe(clause) is safe


def test_time_ranges():
    assert time_range("[2024/07/14 00:00:00 - ]") == ("2024-07-14 00:00:00", None)
    assert time_ranges("a.ts = '[2024/07/14 00:00:00 - 2024/07/15 00:00:00]' AND b = '[x]'") == "(a.ts >= timestamp'2024-07-14 00:00:00' AND a.ts <= timestamp'2024-07-15 00:00:00') AND b = '[x]'"
    assert time_ranges("ts = '[ - ]'") == "ts IS NOT NULL"
    with pytest.raises(EngineError):
        time_range("yesterday")


def test_granular():
    made = granular("SELECT a, count(*) AS n FROM t GROUP BY a HAVING n > 1", 60, "ts")
    assert made == "SELECT window(ts, '60 seconds').start AS time_bucket, a, count(*) AS n FROM t GROUP BY window(ts, '60 seconds'), a HAVING n > 1"


def test_granular_with_distinct_and_union():
    made = granular("SELECT DISTINCT a FROM t UNION ALL SELECT b FROM u GROUP BY b", 60, "ts")
    w = "window(ts, '60 seconds')"
    assert made == f"SELECT DISTINCT {w}.start AS time_bucket, a FROM t UNION ALL SELECT {w}.start AS time_bucket, b FROM u GROUP BY {w}, b"
