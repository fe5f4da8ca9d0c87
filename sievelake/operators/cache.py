"""A persistent cache of lookups as a table (S8, S11): what was looked up once isn't looked up again.

Entries lie below a folder by the first digits of their key (``prefix=ab``), as Parquet. A key is the digest of a term without regard to case and white space, so
spellings share an entry. A run joins its terms with the entries of their prefixes, looks up the misses alone (each key once, whatever
the number of rows that ask for it), appends what was found (nothing found is an entry too) and reads the answer back.

The append is one write of a run; a run that fails before leaves no entries, one that fails later leaves entries that the next one uses. Two runs
that write a key at a time leave two equal entries; one of them is read. Filters are applied when entries are read, not when they are
written: a rule that changes needs no new lookup.

Defined results: null and blank terms have no entry and no answer; an empty table looks nothing up; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.text import space_form
from sievelake.operators.trees import fresh
from sievelake.operators.vocabulary import cache_key
from sievelake.plans.stage import Stage

DIGITS = 2


class LookupCache:
    """``found`` is the type of an answer, as an array element, such as ``struct<code:string,name:string>``."""

    def __init__(self, spark: SparkSession, path: str, found: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"key string, term string, found array<{found}>, prefix string"

    def entries(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        every = self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)
        return every.groupBy("prefix", "key").agg(F.min("term").alias("term"), F.first("found").alias("found"))

    def lookup(self, rows: DataFrame, term: str, ask: Callable[[DataFrame], DataFrame], keep: Callable[[Column], Column] | None = None, into: str = "found") -> tuple[DataFrame, int]:
        """The rows with their answers in ``into``, and how many keys had to be looked up.

        ``ask`` gets the missing terms (key, term) and returns (key, found); a key that it doesn't return counts as nothing found.
        ``keep`` says which elements of an answer are let through.
        """
        key, prefix = fresh(rows, "key"), fresh(rows, "prefix")
        asked = rows.withColumn(key, F.when(F.trim(F.coalesce(F.col(term), F.lit(""))) != "", cache_key(F.col(term))))
        wanted = asked.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(space_form(F.col(term))).alias("term")).withColumn("prefix", F.substring("key", 1, DIGITS))
        missing = Stage(self.spark, "misses").keep(wanted.join(self.entries().select("prefix", "key"), ["prefix", "key"], "left_anti"))  # looked up once
        answers = missing.join(ask(missing.select("key", "term")).select("key", "found"), "key", "left")
        n = self._append(answers)
        known = self.entries().select(F.col("prefix").alias(prefix), F.col("key").alias(key), F.col("found").alias(into))
        if keep is not None:
            known = known.withColumn(into, F.filter(into, keep))
        out = asked.withColumn(prefix, F.substring(key, 1, DIGITS)).join(known, [prefix, key], "left")
        return out.select(*rows.columns, into), n

    def _append(self, answers: DataFrame) -> int:
        seen, empty = Observation(), F.expr(f"cast(array() as {self.spark.createDataFrame([], self.schema).schema['found'].dataType.simpleString()})")
        new = answers.select("key", "term", F.coalesce("found", empty).alias("found"), "prefix").observe(seen, F.count(F.lit(1)).alias("n"))
        new.write.mode("append").partitionBy("prefix").parquet(self.path)
        return seen.get["n"]
