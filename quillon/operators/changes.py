"""Changes to tables as new DataFrames: insert with conflict rules, upsert, update, delete, audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rounds in which upsert() applies new rows that repeat a key.
ROUNDS = 64


def _keyless(rows: DataFrame, key: Sequence[str]) -> Column:
    """Whether a row's key holds a null: such keys never conflict."""
    found = F.lit(False)
    for k in key:
        found = found | F.col(k).isNull()
    return found


def one_for_each_key(rows: DataFrame, key: Sequence[str], order: Column | None = None, last: bool = False) -> DataFrame:
    """The first (or last) of the rows with one key, by order or else as they come; rows with a null in their
    key all stay. Aggregated before the shuffle, so that a frequent key costs one row a task."""
    numbered = rows.withColumn("_order", order if order is not None else F.monotonically_increasing_id())
    whole = F.struct(*rows.columns)
    pick = F.max_by if last else F.min_by
    found = numbered.filter(~_keyless(rows, key)).groupBy(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(key)]).agg(pick(whole, "_order").alias("_row")).select("_row.*")
    return rows.filter(_keyless(rows, key)).unionByName(found)


def inserted(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """INSERT OR IGNORE .. RETURNING: the rows that go in. Of several with one key the first does."""
    return one_for_each_key(rows, key, order).join(table.select(*key), list(key), "left_anti").select(*rows.columns)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows whose key the table doesn't hold are added, of several with one key the first; null keys never conflict."""
    return table.unionByName(inserted(table, rows, key, order))


def insert_or_replace(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows take the place of those with their key, of several with one key the last; null keys never conflict."""
    return table.join(rows.select(*key), list(key), "left_anti").select(*table.columns).unionByName(one_for_each_key(rows, key, order, last=True))


def insert_or_abort(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows, or an error if one repeats a key (ABORT, FAIL and ROLLBACK: a table that is made anew is whole or not there)."""
    whole = table.unionByName(rows)
    clash = whole.filter(~_keyless(whole, key)).groupBy(*key).count().filter("count > 1").first()
    if clash is not None:
        raise ValueError(f"the key {clash[:-1]} would not be unique")
    return whole


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], update: dict[str, Callable[[Column, Column], Column]], where: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, order: Column | None = None, repeats: bool = False) -> DataFrame:
    """ON CONFLICT (key) DO UPDATE SET name = f(old value, excluded value) [WHERE]: one full join by key.

    Null keys never conflict. With repeats, new rows may share a key: they are applied one after another by
    order, in as many rounds as the most frequent key has rows (ROUNDS at most)."""
    if repeats:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(order if order is not None else F.monotonically_increasing_id()))
        most = rows.filter(~_keyless(rows, key)).groupBy(*key).count().agg(F.max("count")).first()[0] or 1
        if most > ROUNDS:
            raise ValueError(f"a key has {most} new rows; {ROUNDS} can be applied one after another")
        numbered = rows.filter(~_keyless(rows, key)).withColumn("_place", place)
        for n in range(1, most + 1):
            table = upsert(table, numbered.filter(F.col("_place") == n).drop("_place"), key, update, where)
        return upsert(table, rows.filter(_keyless(rows, key)), key, update, where)
    # Marks tell which side a row of the join has; keys cannot, since they may be null.
    old, new = table.withColumn("_there", F.lit(True)).alias("old"), rows.withColumn("_there", F.lit(True)).alias("new")
    pairs = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full")
    has_old, has_new = F.col("old._there").isNotNull(), F.col("new._there").isNotNull()
    both = has_old & has_new
    if where is not None:
        both = both & F.coalesce(where(lambda c: F.col(f"old.{c}"), lambda c: F.col(f"new.{c}")), F.lit(False))
    out = []
    for c in table.columns:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}") if c in rows.columns else F.lit(None)
        out.append(F.when(both, update[c](a, b) if c in update else a).when(has_old, a).otherwise(b).alias(c))
    return pairs.select(*out)


def update_from(table: DataFrame, changes: DataFrame, key: Sequence[str], assignments: dict[str, str]) -> DataFrame:
    """UPDATE table SET name = changes.other FROM changes WHERE keys agree; keys of changes are distinct."""
    given = changes.select(*key, *[F.col(b).alias(f"_new_{a}") for a, b in assignments.items()], F.lit(True).alias("_hit"))
    joined = table.join(given, list(key), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in table.columns])


def update(table: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """A condition that is null changes nothing."""
    return table.select(*[F.when(condition, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in table.columns])


def update_returning(table: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    """UPDATE .. RETURNING: the changed rows with their new values."""
    return update(table.filter(condition), F.lit(True), assignments)


def delete(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go): a condition that is null deletes nothing."""
    gone = F.coalesce(condition, F.lit(False))
    return table.filter(~gone), table.filter(gone)


def delete_first(table: DataFrame, condition: Column, order: Sequence[Column], limit: int, key: Sequence[str]) -> DataFrame:
    """DELETE .. ORDER BY .. LIMIT: the first rows by order go. Only their keys, null ones as well, are shuffled."""
    gone = table.filter(condition).orderBy(*order).limit(limit).select(*[F.col(k).alias(f"_gone_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in key]
    return table.join(gone, same, "left_anti")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows that break a foreign key; null refers to nothing."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").select(*child.columns)


def duplicates(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their counts; null keys are distinct from each other."""
    known = table.dropna(subset=list(key))
    return known.groupBy(*key).count().filter("count > 1")


def first_of_each(table: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return table.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
