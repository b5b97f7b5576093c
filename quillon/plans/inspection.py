"""What plans and tables can be asked: plans, files, statistics, normalised SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan's text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def tables_used(df: DataFrame) -> list[str]:
    """Files that a query reads."""
    return sorted(df.inputFiles())


def table_info(df: DataFrame) -> DataFrame:
    """cid, name, type and notnull of each column."""
    rows = [(i, f.name, f.dataType.simpleString(), int(not f.nullable)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string, `notnull` int")


def statistics(df: DataFrame) -> DataFrame:
    """name, rows, distinct (estimated) and nulls of each column, in one pass."""
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    parts = [F.struct(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.col(n)).alias("distinct"), F.count_if(F.col(n).isNull()).alias("nulls")) for n in names]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def normalize_sql(sql: str) -> str:
    """A statement with literals as ?, words outside quotes in upper case and single spaces."""
    out = []
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|[xX]'[^']*'|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\w+|\s+|.", sql, re.S):
        t = m[0]
        if t.isspace() or t.startswith(("--", "/*")):
            out.append(" ")
        elif t.startswith("'") or t[:2].lower() == "x'" or t[0].isdigit():
            out.append("?")
        else:
            out.append(t if t.startswith('"') else t.upper())
    return re.sub(r" *([(),;=<>]) *", r"\1", re.sub(" +", " ", "".join(out))).strip()


def run_script(spark: SparkSession, text: str) -> list[DataFrame]:
    """The results of statements that semicolons separate; semicolons in quotes don't."""
    parts = re.findall(r"(?:'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[^;'\"])+", text)
    return [spark.sql(p) for p in parts if p.strip()]
