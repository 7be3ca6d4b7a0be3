"""Names of all queries of the engine, their DataFrames and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under a name, with equivalent SQL if there is any."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query(
    "standard_scaler",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS q_scaled
FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)""",
)
def standard_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    stats = x.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return x.crossJoin(F.broadcast(stats)).select("l_orderkey", "l_linenumber", F.round((F.col("l_quantity") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 6).alias("q_scaled"))
