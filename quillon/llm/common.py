"""Helpers that the training-data operators share: written tables, batches of rows, words."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Everything but ASCII white space, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder of its own.
    """
    global _own_dir
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quillon-")
    return _own_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs nothing that has been written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*written: DataFrame) -> None:
    """Remove tables that materialize() wrote and that nothing reads any more; other tables stay."""
    for df in written:
        if not hasattr(df, "_written_to"):
            continue
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their names, whatever characters these hold."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def fresh(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_owner: list = ["", None]


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Say that this Python worker now works for an operator: what another one has remembered in it is
    forgotten, so that a worker that Spark uses again and again holds one operator's memory only."""
    if _owner[0] != owner:
        if _owner[1] is not None:
            _owner[1]()
            gc.collect()
        _owner[:] = [owner, clear]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
