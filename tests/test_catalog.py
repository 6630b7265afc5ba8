"""Every catalog query against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from strata.plans import catalog  # noqa: E402

SF = os.environ.get("STRATA_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_predicates_reach_the_scan(spark, tmp_path):
    from strata.table import KVTable

    t = KVTable.open(spark, str(tmp_path / "t"))
    t.put([(b"k%03d" % i, b"v" * 50) for i in range(300)])
    plan = t.scan(b"k100", b"k200", keys_only=True)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert t.scan(b"k100", b"k200").count() == 100
