"""Sources that are functions of their arguments: series, CSV text and files, unions, folders, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def generate_series(spark: SparkSession, start: int, stop: int = 4294967295, step: int = 1) -> DataFrame:
    """value from start to stop, both included; a step of 0 counts as 1. Rows are made by the executors."""
    step = step or 1
    n = (stop - start) // step + 1 if (stop - start) * step >= 0 else 0
    return spark.range(max(0, n)).select((F.lit(start) + F.col("id") * F.lit(step)).alias("value"))


def wholenumber(spark: SparkSession, low: int = 1, high: int = 4294967295) -> DataFrame:
    return generate_series(spark, max(1, low), high)


def series_of(df: DataFrame, start: str, stop: str, step: str = "1") -> DataFrame:
    """A lateral series: df's rows with each value from its start to its stop."""
    s = f"CASE WHEN ({step}) = 0 THEN 1 ELSE ({step}) END"
    return df.select("*", F.explode(F.expr(f"CASE WHEN (({stop}) - ({start})) * ({s}) >= 0 THEN sequence(CAST({start} AS BIGINT), CAST({stop} AS BIGINT), CAST({s} AS BIGINT)) ELSE array() END")).alias("value"))


def csv_rows(spark: SparkSession, filename: str | None = None, data: str | None = None, schema: str | None = None, header: bool = False, columns: int | None = None) -> DataFrame:
    """Rows of a CSV file or text, all columns text, named c1, c2, ... without a header or schema."""
    if data is not None:
        import csv

        rows = [r for r in csv.reader(io.StringIO(data.lstrip("\n"))) if r]
        names = rows.pop(0) if header and rows else None
        width = columns or max([len(names or []), *map(len, rows)], default=1)
        names = (names or []) + [f"c{i + 1}" for i in range(len(names or []), width)]
        shape = T.StructType([T.StructField(n, T.StringType()) for n in names[:width]])
        df = spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows], shape)
        return df if schema is None else df.toDF(*T._parse_datatype_string(schema).names)
    reader = spark.read.option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True)
    if schema is not None:
        return reader.schema(schema).csv(filename)
    df = reader.csv(filename)
    return df if header else df.toDF(*[f"c{i + 1}" for i in range(len(df.columns))])


def bound_values(spark: SparkSession, values: Sequence, kind: str = "bigint") -> DataFrame:
    """A bound array as a table of one column, value."""
    return spark.createDataFrame([(v,) for v in values], f"value {kind}")


def union_tables(*parts: tuple[DataFrame, int | None, int | None], key: str) -> DataFrame:
    """Tables that hold ranges of one key as a single one; each part is cut to its range, so that a
    predicate on the key reaches only the parts that can satisfy it."""
    out = None
    for df, low, high in parts:
        if low is not None:
            df = df.filter(F.col(key) >= low)
        if high is not None:
            df = df.filter(F.col(key) <= high)
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no table to unite")
    return out


def folder(spark: SparkSession, path: str) -> DataFrame:
    """name, mtime and size of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """name and data of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("name"), F.col("content").alias("data"))


_MEMBER = "archive string, name string, sz long, method int, data binary"


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of the zip files at a path, each archive read by one task."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["data"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(name, i.filename, i.file_size, i.compress_type, z.read(i)) for i in z.infolist() if not i.is_dir()]
                yield pd.DataFrame(rows, columns=["archive", "name", "sz", "method", "data"])

    return files(spark, path).mapInPandas(run, _MEMBER)


def zip_bytes(name: Column, data: Column) -> Column:
    """An aggregate: a zip archive of the members of a group."""

    @F.pandas_udf("binary")
    def build(names: pd.Series, datas: pd.Series) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in sorted(zip(names, datas, strict=True)):
                z.writestr(zipfile.ZipInfo(n), bytes(d) if not isinstance(d, str) else d)
        return out.getvalue()

    return build(name, data)


class _Range(InputPartition):
    def __init__(self, low: int, high: int, step: int):
        self.low, self.high, self.step = low, high, step


class SeriesSource(DataSource):
    """The series as a named source: spark.read.format("series").option("start", 1).option("stop", 9)."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "value bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SeriesReader(self.options)


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", 4294967295))
        self.step, self.parts = int(options.get("step", 1)) or 1, int(options.get("partitions", 4))

    def partitions(self) -> list[_Range]:
        n = (self.stop - self.start) // self.step + 1 if (self.stop - self.start) * self.step >= 0 else 0
        size = -(-n // self.parts) or 1
        return [_Range(self.start + i * self.step, self.start + (min(n, i + size) - 1) * self.step, self.step) for i in range(0, n, size)]

    def read(self, partition: _Range) -> Iterator[tuple[int]]:
        for v in range(partition.low, partition.high + (1 if partition.step > 0 else -1), partition.step):
            yield (v,)
