"""Every query of the catalog that has SQL against it, run by DuckDB over the same tables; the others give stable columns."""

import duckdb
import pytest

from millrace import catalog
from millrace.operators import evaluation, fitted, linear, metrics, models, preprocessing, series, tensors, vectors  # noqa: F401
from millrace.plans.sqltext import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_query_equals_sql(spark, con, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    key = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert key(ours).equals(key(theirs))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
