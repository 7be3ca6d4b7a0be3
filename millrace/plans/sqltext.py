"""Operators written as SQL text that Spark runs and DuckDB can check.

A statement names tables in braces. twin() gives the same statement for DuckDB; where function names differ between
the two engines the differences are listed in RENAMED, and a statement with another shape has its own text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Spark's name and DuckDB's name of the same function.
RENAMED = (("percentile(", "quantile_cont("), ("collect_list(", "list("), ("char_length(", "length("), ("unix_timestamp(", "epoch("))


def twin(sql: str) -> str:
    for ours, theirs in RENAMED:
        sql = sql.replace(ours, theirs)
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def statement(name: str, sql: str, other: str | None = None) -> None:
    """Register a statement as a query, with its twin (or `other`) as SQL for the check."""

    def fn(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, sql)

    fn.__name__ = name
    query(name, twin(other or sql))(fn)
