"""Recursion that removes duplicates, which WITH RECURSIVE cannot express, by rounds of joins.

Each round joins the newest rows alone and keeps those not seen before, so that cycles end. Rounds are
written to the session's checkpoint directory: lineage stays short and lost executors recover.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10_000


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names (a temporary one in local tests)."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint(eager=True)


def distinct_recursion(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """WITH RECURSIVE t AS (seed UNION step(t)): all rows that step reaches, each once. No column may
    be null."""
    seen = settled(seed.distinct())
    front = seen
    names = seen.columns
    for _ in range(rounds):
        new = step(front).toDF(*names).distinct().join(seen, names, "left_anti")
        front = settled(new)
        if front.isEmpty():
            return seen
        seen = settled(seen.unionByName(front))
    raise RuntimeError(f"more than {rounds} rounds")


def closure(edges: DataFrame, source: str, target: str, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth): every node below the roots (one column) with its least depth."""
    links = settled(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).filter("_from is not null and _to is not null").distinct())
    seen = settled(roots.toDF("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("depth")))
    front = seen
    for level in range(1, (depth if depth is not None else ROUNDS) + 1):
        new = front.join(links, front["id"] == links["_from"]).select("root", F.col("_to").alias("id")).distinct()
        front = settled(new.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front))
    return seen


def walk(edges: DataFrame, source: str, target: str, roots: DataFrame, depth_first: bool = True) -> DataFrame:
    """(id, depth, path) of every path below the roots (one column), in the order of a recursion whose queue
    is ordered: children by id, each node before its children (depth first) or level by level. A limit on
    the result is the recursion's LIMIT. The edges must have no cycle."""
    links = settled(edges.select(F.col(source).alias("_from"), F.col(target).alias("_to")).filter("_from is not null and _to is not null"))
    found = settled(roots.toDF("id").select("id", F.lit(0).alias("depth"), F.array("id").alias("path")))
    levels, front = [found], found
    for level in range(1, ROUNDS + 1):
        below = front.join(links, front["id"] == links["_from"])
        front = settled(below.select(F.col("_to").alias("id"), F.lit(level).alias("depth"), F.concat("path", F.array("_to")).alias("path")))
        if front.isEmpty():
            break
        levels.append(front)
    else:
        raise RuntimeError(f"more than {ROUNDS} rounds")
    whole = levels[0]
    for more in levels[1:]:
        whole = whole.unionByName(more)
    return whole.orderBy("path") if depth_first else whole.orderBy("depth", "path")
