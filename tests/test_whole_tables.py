"""Queries that must cover whole tables, against brute force."""

import numpy as np

from millrace.operators import fitted, series, vectors  # noqa: F401
from millrace.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_searchsorted_all(spark):
    values = np.sort([float(r[0]) for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_acctbal").collect()])
    keys = spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey", "s_acctbal").collect()
    assert {r["s_suppkey"]: r["pos"] for r in QUERIES["searchsorted"](spark, SF).collect()} == {k: int(np.searchsorted(values, float(v))) for k, v in keys}


def test_dbscan_core_flags(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    e = np.array([r[1] for r in rows], np.float64)
    want = {r[0]: int((((e - x) ** 2).sum(1) <= 1.2).sum() >= 3) for r, x in zip(rows, e)}
    for block in (2000, 150):
        assert {r["vec_id"]: r["core"] for r in vectors.dbscan_core_flags(spark, SF, block).collect()} == want
