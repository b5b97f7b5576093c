"""Column affinities: how loosely typed text becomes typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def affinity(declared: str) -> str:
    """The affinity of a declared type, by the words in its name."""
    name = declared.upper()
    if "INT" in name:
        return "integer"
    if any(w in name for w in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not name or "BLOB" in name:
        return "blob"
    return "real" if any(w in name for w in ("REAL", "FLOA", "DOUB")) else "numeric"


def store(x: Column, declared: str) -> Column:
    """A text value as a column of the declared type; text that is no number becomes null."""
    kind = affinity(declared)
    if kind == "text":
        return x.cast("string")
    if kind == "blob":
        return x.cast("binary")
    if kind == "integer":
        return F.coalesce(F.trim(x).try_cast("bigint"), F.when(F.floor(F.trim(x).try_cast("double")) == F.trim(x).try_cast("double"), F.trim(x).try_cast("double").try_cast("bigint")))
    return F.trim(x).try_cast("double")


def ingest(df: DataFrame, declared: dict[str, str], strict: bool = False) -> DataFrame:
    """Text columns as declared. In strict mode a value that doesn't fit raises an error when it is read."""
    out = []
    for name, kind in declared.items():
        value = store(F.col(name), kind)
        if strict:
            value = F.when(F.col(name).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"cannot store in {name}: "), F.col(name)))).otherwise(value)
        out.append(value.alias(name))
    return df.select(*out)


def mixed_key(rank: Column, number: Column, text: Column, binary: Column) -> Column:
    """A sort key across types: null, then numbers, then text, then bytes. rank is 0 to 3."""
    return F.struct(rank.alias("rank"), number.alias("number"), text.alias("text"), F.hex(binary).alias("bytes"))
