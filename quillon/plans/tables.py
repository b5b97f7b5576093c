"""The test tables as DataFrames, and queries that are one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL in which {name} stands for a table."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL with {table} placeholders; the oracle is the same text unless the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, text)

    run.__name__, run.__doc__ = name, text
    query(name, re.sub(r"\{(\w+)\}", r"\1", oracle or text))(run)
