"""Keyed-table changes as plans: each takes the rows of a table and gives those after the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prepare import checked
from ..plans.schema import TableSpec
from ..plans.session import stored


class KeyConflict(ValueError):
    """A null or repeated key."""


def conform(spec: TableSpec, rows: DataFrame) -> DataFrame:
    """The declared columns of rows in order and type, vectors checked when they are read; a missing one has its default,
    or null."""
    have, defaults, out = set(rows.columns), dict(spec.defaults), []
    vectors = {v.name: v for v in spec.vectors}
    for f in spec.schema():
        value = F.col(f"`{f.name}`") if f.name in have else F.lit(defaults.get(f.name))
        value = value.cast(f.dataType)
        if f.name in vectors:
            value = checked(value, vectors[f.name].lengths, vectors[f.name].nullable, f.name)
        out.append(value.alias(f.name))
    return rows.select(*out)


def verify(rows: DataFrame) -> None:
    """Evaluates rows once, so that their checks are made before anything changes."""
    rows.write.format("noop").mode("overwrite").save()


def add_range(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new together; an error, before anything else happens, for a null key, one that new has twice or one that
    old has. old is only filtered by new's keys, which Spark broadcasts where they are few."""
    bad = new.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise KeyConflict("a key is null" if bad[0][key] is None else f"key {bad[0][key]!r} is in the batch twice")
    bad = old.select(key).join(new.select(key), key, "left_semi").limit(1).collect()
    if bad:
        raise KeyConflict(f"key {bad[0][key]!r} exists")
    return old.unionByName(new)


def last_of_each(new: DataFrame, key: str, order: str | Column) -> DataFrame:
    """For each key the row of the largest order."""
    w = Window.partitionBy(key).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return new.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert_range(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """new's rows in place of old's of equal key; of rows of new with equal keys the last by order stays. order is no
    column of the result; without it the order is that in which new is read, once, and stored."""
    if new.where(F.col(key).isNull()).limit(1).collect():
        raise KeyConflict("a key is null")
    ordered = new if order else read_once(new)
    last = last_of_each(ordered, key, order or ORDER).drop(order or ORDER)
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


#: The place at which a row of a batch was read.
ORDER = "_order"


def read_once(new: DataFrame) -> DataFrame:
    """new with the order in which it was read, stored, so that every plan over it, and a task that is run again, sees the
    same order."""
    return stored(new.withColumn(ORDER, F.monotonically_increasing_id()), "batch")


def remove_keys(old: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    return old.join(dead.select(key), key, "left_anti").select(*old.columns)


def find(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, by a filter that reaches the files' statistics."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)


def exists(rows: DataFrame, predicate: Column | str) -> bool:
    return not rows.where(predicate).limit(1).isEmpty()


def clear(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def merge(sources: list[DataFrame], key: str, policy: str, order: str | None = None) -> DataFrame:
    """append: all rows. last, first: for each key the row of the last or first source that has it, of equal keys in one
    source the one that order, a column, puts last or first, or else a hash of the row; null keys are dropped."""
    if policy not in {"append", "last", "first"}:
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "append":
        out = sources[0]
        for s in sources[1:]:
            out = out.unionByName(s)
        return out
    tagged = [s.withColumns({"_source": F.lit(i), "_row": F.col(order) if order else F.xxhash64(*[F.col(f"`{c}`") for c in s.columns])}) for i, s in enumerate(sources)]
    every = tagged[0]
    for s in tagged[1:]:
        every = every.unionByName(s)
    by = [F.col("_source"), F.col("_row")]
    w = Window.partitionBy(key).orderBy(*([c.desc() for c in by] if policy == "last" else by))
    return every.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_source", "_row")
