"""Checks that are part of a plan: a job fails closed, with a code, when it runs, and nothing runs when it is planned.

Each guard gives back its rows as they are. It filters them by a condition that is true or raises, so no optimisation can drop it. Keys are
counted with partial aggregates, so a key that repeats a million times is a row a task. A failing job ends with
``guard failed: <code>`` and, where there is one, the first offending key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.operators.trees import fresh

PREFIX = "guard failed: "


def holds(condition: Column, code: str, *shown: Column) -> Column:
    """True where the condition is; else (null too) the job fails."""
    told = F.concat_ws(" ", F.lit(PREFIX + code), *[c.cast("string") for c in shown])
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))


def require(df: DataFrame, condition: Column, code: str, *shown: Column) -> DataFrame:
    """Rows that all meet a condition."""
    return df.filter(holds(condition, code, *shown))


def unique(df: DataFrame, keys: Sequence[str], code: str = "duplicate_key") -> DataFrame:
    """Rows whose key no other has; a key with a null part is one that is missing."""
    n, names = fresh(df, "n"), [fresh(df, f"key_{i}") for i in range(len(keys))]
    groups = df.groupBy(*[df[k].alias(name) for k, name in zip(keys, names, strict=True)]).agg(F.count("*").alias(n))
    whole = F.forall(F.array(*[F.col(name).isNotNull() for name in names]), lambda x: x)
    once = require(require(groups, whole, "missing_key"), F.col(n) == 1, code, *[F.col(name) for name in names])
    # null-safe, as an equality would drop null keys before they are looked at
    return df.join(once, reduce(Column.__and__, [df[k].eqNullSafe(once[name]) for k, name in zip(keys, names, strict=True)]), "left_semi")


def no_orphans(children: DataFrame, parents: DataFrame, keys: Sequence[str], code: str = "orphan") -> DataFrame:
    """Children that all have a parent of the same key."""
    mark = fresh(children, "known")
    known = parents.select(*keys).distinct().withColumn(mark, F.lit(True))
    return require(children.join(known, list(keys), "left"), F.col(mark), code, *[F.col(k) for k in keys]).select(*children.columns)


def adds_up(parents: DataFrame, children: DataFrame, keys: Sequence[str], declared: str, amount: Column | None = None, code: str = "wrong_sum") -> DataFrame:
    """Parents whose declared number is what their children sum up to (without ``amount``: how many they are)."""
    mark = fresh(parents, "total")
    totals = children.groupBy(*keys).agg((F.count("*") if amount is None else F.sum(amount)).alias(mark))
    both = parents.join(totals, list(keys), "left")
    return require(both, F.coalesce(F.col(mark), F.lit(0)).eqNullSafe(F.col(declared)), code, *[F.col(k) for k in keys]).select(*parents.columns)


def counted(df: DataFrame, declared: DataFrame, code: str = "wrong_count") -> DataFrame:
    """All rows, if there are as many as ``declared`` (one row, one column) says; an empty table and an empty declaration are checked too.

    The check is a branch of its own that ends without rows, so no join can skip it where one side is empty.
    """
    told = df.agg(F.count("*").alias("n")).join(declared.toDF("want").agg(F.max("want").alias("want")), how="cross")  # one row by one row
    wrong = told.filter(~holds(F.col("n").eqNullSafe(F.col("want")), code, F.col("n"), F.col("want")))
    return df.union(wrong.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]))
