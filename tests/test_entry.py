import duckdb
import pandas as pd
import pytest

from ledgerfold import plans
from ledgerfold.catalog import TABLES
from tests.conftest import DATA


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


SLOW = {"network_resilience", "clusters_of_vectors", "small_world_index", "p2_paths", "p2_descendants"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(plans.collect()[1]) - SLOW))
def test_against_sql(spark, duck, name):
    queries, sql = plans.collect()
    want = duck.execute(sql[name]).fetchdf()
    have = queries[name](spark, DATA).toPandas()
    assert sorted(have.columns) == sorted(want.columns)
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else round(float(v), 4) + 0.0 if isinstance(v, float) else v
    key = lambda f: sorted(str([plain(v) for v in r]) for r in f.astype(object).itertuples(index=False, name=None))
    assert key(have[list(want.columns)]) == key(want)


@pytest.mark.parametrize("name", ["link_levels", "audit_hash_chain", "portfolio_value_at_risk", "npv_of_firms", "text_to_clusters"])
def test_runs(spark, name):
    assert plans.collect()[0][name](spark, DATA).count() >= 0
