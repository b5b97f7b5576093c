"""A user's own functions, by name in SQL: scalar, aggregate (also over windows) and table functions.

They run in Python over Arrow batches. A built-in expression is faster wherever one says the same; an
aggregate's group, or a window's frame, is held by one task, so that unbounded groups need a built-in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, f: Callable[..., Any], returns: str, deterministic: bool = True) -> None:
    """f(value, ...) for each row; nulls reach it as None."""

    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*(x.astype(object).where(x.notna(), None) for x in columns), strict=True)
        return pd.Series([f(*r) for r in rows], dtype=object)

    made = F.pandas_udf(run, returns)
    spark.udf.register(name, made if deterministic else made.asNondeterministic())


def register_aggregate(spark: SparkSession, name: str, start: Callable[[], Any], step: Callable[[Any, Any], Any], final: Callable[[Any], Any], returns: str) -> None:
    """final of the steps over a group's values, from start() on; nulls reach step as None."""

    def run(values: pd.Series) -> Any:
        state = start()
        for v in values.astype(object).where(values.notna(), None):
            state = step(state, v)
        return final(state)

    spark.udf.register(name, F.pandas_udf(run, returns))


def register_table(spark: SparkSession, name: str, f: Callable[..., Iterable[tuple]], returns: str) -> None:
    """The rows that f(argument, ...) yields, in FROM or LATERAL."""

    class Rows:
        def eval(self, *arguments: Any) -> Iterable[tuple]:
            yield from f(*arguments)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))
