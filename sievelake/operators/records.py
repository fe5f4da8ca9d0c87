"""Row-level relational operators: first-wins dedup, last-wins merge, keys, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.operators.trees import fresh


def first_wins(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """A1: of rows of equal keys the first by ``order``; rows with an empty key all stay.

    A grouped minimum with partial aggregation, so a key that a third of all rows share is one row a task. Rows with an empty key are told
    apart by a number of their own, so the input is read once.
    """
    rest, own, row = [c for c in df.columns if c not in keys], fresh(df, "own"), fresh(df, "row")
    empty = reduce(Column.__or__, [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
    groups = df.withColumn(own, F.when(empty, F.monotonically_increasing_id() + 1).otherwise(0)).groupBy(*keys, own)
    return groups.agg(F.min_by(F.struct(*rest), order).alias(row)).select(*keys, f"{row}.*").select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of rows of equal keys the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row; a caller fails closed when any come back."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a parent."""
    return child.join(parent.select(*on).distinct(), list(on), "left_anti")


def two_tier_lookup(terms: DataFrame, vocabulary: DataFrame, term: str, label: str, code: str, normal) -> DataFrame:
    """The exact label, else the normalised one, else a code made from the term's digest."""
    exact = vocabulary.groupBy(F.col(label).alias(term)).agg(F.min(code).alias("exact_code"))
    loose = vocabulary.groupBy(normal(F.col(label)).alias("__normal")).agg(F.min(code).alias("loose_code"))
    out = terms.join(exact, term, "left").withColumn("__normal", normal(F.col(term))).join(loose, "__normal", "left").drop("__normal")
    made = F.concat(F.lit("unresolved:"), F.substring(F.sha2(F.col(term).cast("binary"), 256), 1, 16))
    method = F.when(F.col("exact_code").isNotNull(), "exact").when(F.col("loose_code").isNotNull(), "normalized").otherwise("unresolved")
    return out.select(*terms.columns, F.coalesce(F.col("exact_code").cast("string"), F.col("loose_code").cast("string"), made).alias("code"), method.alias("match_method"))
