"""Snapshots as documents: load, gates, scope, review sources, unmatched records, identity.

A snapshot is one JSON object with topic, query, schema_version and a list of articles. Its articles are rows; what is
said of the snapshot as a whole is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.operators.diff import ComparisonError

#: Versions that a comparison accepts (fixed values).
ACCEPTED_VERSIONS = ("b5",)
REVIEW_SOURCES = ("relevance", "study", "integrity", "extraction")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot as one row (``doc`` variant), or an error that says what is wrong with the file."""
    try:
        found = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc")).limit(2).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ComparisonError("snapshot_not_found", f"no snapshot at {path}") from e
        raise
    if len(found) != 1 or found[0].doc is None:
        raise ComparisonError("snapshot_unreadable", f"not one JSON document: {path}")
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    if not doc.select(F.schema_of_variant("doc")).first()[0].startswith("OBJECT"):
        raise ComparisonError("malformed_snapshot", f"not an object: {path}")
    return doc


def check_versions(*snapshots: DataFrame) -> None:
    """Every snapshot has a list of articles and a version that is known."""
    for doc in snapshots:
        version, kind = doc.select(F.try_variant_get("doc", "$.schema_version", "string"), F.schema_of_variant(F.try_variant_get("doc", "$.articles", "variant"))).first()
        if not (kind or "").startswith("ARRAY"):
            raise ComparisonError("malformed_snapshot", "no list of articles")
        if version not in ACCEPTED_VERSIONS:
            raise ComparisonError("unsupported_version", str(version))


def scope_of(topic0: Column, topic1: Column, query0: Column, query1: Column) -> Column:
    """D3: what can be said of two snapshots' scopes: {scope, query_status}; ``incomparable`` where both topics are known and differ."""
    known = lambda t: F.nullif(F.trim(t), F.lit(""))
    a, b = known(topic0), known(topic1)
    scope = F.when(a.isNull() & b.isNull(), "topic_unavailable").when(a.isNull() | b.isNull(), "topic_partially_unavailable").when(a != b, "incomparable").otherwise("same_topic")
    query = F.when(query0.isNull() | query1.isNull(), "unavailable").when(query0 != query1, "changed").otherwise("same")
    return F.struct(scope.alias("scope"), F.when(a == b, query).alias("query_status"))


def require_comparable(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """D3 for two loaded snapshots: one row, or an error where the topics differ."""
    get = lambda doc, name: doc.select(F.try_variant_get("doc", "$.topic", "string").alias(f"{name}_topic"), F.try_variant_get("doc", "$.query", "string").alias(f"{name}_query"))
    both = get(baseline, "baseline").join(get(target, "target"), how="cross")  # one row by one row
    both = both.select("*", scope_of(F.col("baseline_topic"), F.col("target_topic"), F.col("baseline_query"), F.col("target_query")).alias("s")).select("*", "s.*").drop("s")
    if both.first().scope == "incomparable":
        raise ComparisonError("incomparable_snapshots", "the snapshots are of different topics")
    return both


def review_changes(baseline: DataFrame, target: DataFrame, key: str, sources: Sequence[str] = REVIEW_SOURCES) -> DataFrame:
    """Rows whose need of review changed, as a whole or in one of its sources (boolean columns, null: not available)."""
    any_of = lambda side: F.coalesce(F.greatest(*[F.coalesce(F.col(f"{side}_{s}"), F.lit(False)) for s in sources]), F.lit(False))
    named = lambda df, side: df.select(key, *[F.col(s).cast("boolean").alias(f"{side}_{s}") for s in sources])
    both = named(baseline, "b").join(named(target, "t"), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"b_{s}").eqNullSafe(F.col(f"t_{s}")), F.lit(s)) for s in sorted(sources)]))
    return both.select(key, any_of("b").alias("was"), any_of("t").alias("now"), differ.alias("sources")).filter(F.size("sources") > 0)


def occurrences(unmatched: DataFrame, snapshot: str, digest: str, order: Sequence[Column], name: str = "occurrence") -> DataFrame:
    """Numbers identical unmatched records of a snapshot."""
    return unmatched.withColumn(name, F.row_number().over(Window.partitionBy(snapshot, digest).orderBy(*order)))


def comparison_id(baseline_id: Column, target_id: Column, versions: Sequence[str]) -> Column:
    """The digest of both snapshots' ids and of all policy versions."""
    return F.sha2(F.concat_ws(":", baseline_id, target_id, *[F.lit(v) for v in versions]).cast("binary"), 256)


def to_document(columns: Sequence[str]) -> Column:
    """Columns as a JSON object that keeps its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
