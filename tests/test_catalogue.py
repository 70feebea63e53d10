"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from orrery.operators import lsh
from orrery.plans import catalogue

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def row_key(r):
    return tuple((x is None, f"{x + 0.0:.9f}" if isinstance(x, float) else str(x)) for x in r)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    if name not in catalogue.oracle_sql():
        assert rows
        return
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(row_key, rows)) == sorted(row_key([r[i] for i in at]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_filters_reach_the_scan(spark):
    from orrery.functions import filters

    df = spark.read.parquet(f"{DATA}/documents.parquet").filter(filters.on_columns({"lang": "de", "n_chars": {"$gt": 500}})).select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_lsh_recall_is_of_others(spark):
    r = catalogue.queries()["lsh_recall"](spark, DATA).first()
    # of five queries all fifty neighbours may be found; that none is the query itself is held below
    assert 0.9 <= r.recall <= 1 and r.n_queries == 5
    e = catalogue.emb(spark, DATA)
    found = lsh.query(catalogue.as_queries(e.filter("vec_id < 10")), e, lsh.CrossPolytope(64, 20, 7), 10, 6, keep_self=False)
    assert found.count() == 100 and found.filter("query_id = vec_id").count() == 0
    found = lsh.query_all(catalogue.asked(e), e, lsh.CrossPolytope(64, 20, 7), 10, 6, keep_self=False)
    assert found.count() == 50 and found.filter("query_id = vec_id").count() == 0


@pytest.mark.skipif(not os.path.exists(LARGER), reason="no tables here")
def test_ivf_recall_is_of_others(spark):
    r = catalogue.queries()["ivf_kmeans_recall"](spark, LARGER).first()
    assert 0.9 <= r.recall <= 1 and r.n_queries == 20


def test_entry_imports_without_the_training_operations():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
