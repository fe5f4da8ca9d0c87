"""Comparison of two snapshots: membership, block availability, leaf and field changes, content-addressed records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions.text import abstains, lookup

CHANGE = "struct<category:string,change_type:string,field_path:string,baseline:string,target:string>"


class ComparisonError(ValueError):
    """A comparison that must not be made; ``code`` says why."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(text or code)
        self.code = code


def index(snapshot: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows by trimmed key, and the rows without one. Repeated keys are an error."""
    snapshot = snapshot.withColumn(key, F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    keyed = snapshot.filter(F.col(key) != "")
    if not keyed.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ComparisonError("duplicate_key")
    return keyed, snapshot.filter(F.col(key) == "")


def membership(baseline: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Which rows are in both, were added or were removed - one full outer join."""
    b = baseline.select(F.col(key), F.lit(True).alias("in_baseline"))
    t = target.select(F.col(key), F.lit(True).alias("in_target"))
    kind = F.when(F.col("in_baseline").isNull(), "added").when(F.col("in_target").isNull(), "removed").otherwise("both")
    return b.join(t, key, "full_outer").select(key, kind.alias("membership"))


def field_changes(baseline: DataFrame, target: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """One record for each field (of a category) that differs; values as text, nulls kept."""
    b = baseline.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    t = target.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("t"))
    found = [
        F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"t.{f}")), F.struct(F.lit(category).alias("category"), F.lit("changed").alias("change_type"), F.lit(f).alias("field_path"), F.col(f"b.{f}").alias("baseline"), F.col(f"t.{f}").alias("target")))
        for f, category in fields.items()
    ]
    return b.join(t, key).select(key, F.inline(F.array_compact(F.array(*found))))


def leaf_changes(baseline: DataFrame, target: DataFrame, key: str, leaves: Sequence[str], provenance: Sequence[str] = ()) -> DataFrame:
    """Leaves by what became of them; a leaf that is null is absent, abstaining words count as values."""
    b = baseline.select(key, F.struct(*[F.col(x).cast("string").alias(x) for x in leaves]).alias("b"))
    t = target.select(key, F.struct(*[F.col(x).cast("string").alias(x) for x in leaves]).alias("t"))
    rows = b.join(t, key).select(key, F.inline(F.array(*[F.struct(F.lit(x).alias("field_path"), F.col(f"b.{x}").alias("baseline"), F.col(f"t.{x}").alias("target")) for x in leaves])))
    rows = rows.filter(~F.col("baseline").eqNullSafe(F.col("target")))
    was, now = abstains(F.col("baseline")), abstains(F.col("target"))
    kind = (
        F.when(F.col("baseline").isNull(), "added")
        .when(F.col("target").isNull(), "removed")
        .when(F.col("field_path").isin(*provenance) if provenance else F.lit(False), "provenance_only")
        .when(was & ~now, "abstention_to_accepted")
        .when(~was & now, "accepted_to_abstention")
        .otherwise("changed")
    )
    return rows.withColumn("change_type", kind)


def block_changes(baseline: DataFrame, target: DataFrame, key: str, blocks: Mapping[str, str | None]) -> DataFrame:
    """Blocks (name to parent) whose state differs; states are columns of present, null or absent. A block whose parent's state changed is left out."""
    b, t = baseline.select(key, *[F.col(x).alias(f"b_{x}") for x in blocks]), target.select(key, *[F.col(x).alias(f"t_{x}") for x in blocks])
    differ = {x: ~F.col(f"b_{x}").eqNullSafe(F.col(f"t_{x}")) for x in blocks}
    kind = lambda x: F.when((F.col(f"b_{x}") != "present") & (F.col(f"t_{x}") == "present"), "became_comparable").when((F.col(f"b_{x}") == "present") & (F.col(f"t_{x}") != "present"), "became_not_comparable").otherwise("state_changed")
    found = [F.when(differ[x] & (~differ[p] if p else F.lit(True)), F.struct(F.lit(x).alias("block"), kind(x).alias("change_type"))) for x, p in blocks.items()]
    return b.join(t, key).select(key, F.inline(F.array_compact(F.array(*found))))


def with_identity(changes: DataFrame, key: str) -> DataFrame:
    """The category's priority, and the first 16 digits of the digest of the record's content."""
    text = F.concat_ws("|", "category", "change_type", F.col(key).cast("string"), "field_path", F.coalesce("baseline", F.lit("<null>")), F.coalesce("target", F.lit("<null>")))
    return changes.withColumn("priority", lookup(rules.CHANGE_PRIORITY, F.col("category"), 9)).withColumn("change_id", F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def change_order() -> list[Column]:
    """O5."""
    return [F.col(c) for c in ("priority", "category", "change_type")]
