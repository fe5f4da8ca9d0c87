"""Publication integrity from structured metadata alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions.text import lookup, space_form


def _policy(table: dict, key: Column, part: int) -> Column:
    return lookup({k: v[part] for k, v in table.items()}, key, None)


def with_integrity(articles: DataFrame, relations: str = "integrity_relations", types: str = "publication_types") -> DataFrame:
    """Adds ``integrity``: status, record_role, needs_review, report_eligible, reason_codes, supporting_signals, final_decision.

    All in array functions on the row itself: no explode, no exchange.
    """
    known = F.lit(list(rules.RELATION_POLICY))
    used = F.filter(relations, lambda r: ~r["normalized_relation"].isin(*rules.IGNORED_RELATIONS))
    of_relations = F.transform(
        used,
        lambda r: F.struct(
            F.coalesce(_policy(rules.RELATION_POLICY, r["normalized_relation"], 0), F.lit("unknown")).alias("status"),
            F.coalesce(_policy(rules.RELATION_POLICY, r["normalized_relation"], 1), F.lit("unknown")).alias("role"),
            F.concat(F.lit("RefType:"), F.coalesce(F.nullif(r["raw_ref_type"], F.lit("")), F.when(F.array_contains(known, r["normalized_relation"]), "").otherwise("<missing>"))).alias("text"),
        ),
    )
    of_types = F.transform(
        F.filter(types, lambda t: space_form(t).isin(*rules.TYPE_POLICY)),
        lambda t: F.struct(_policy(rules.TYPE_POLICY, space_form(t), 0).alias("status"), _policy(rules.TYPE_POLICY, space_form(t), 1).alias("role"), F.concat(F.lit("PublicationType:"), t).alias("text")),
    )
    empty = F.expr("cast(array() as array<struct<status:string,role:string,text:string>>)")
    df = articles.withColumn("__s", F.concat(F.coalesce(of_relations, empty), F.coalesce(of_types, empty)))
    odd = F.coalesce(F.exists(used, lambda r: ~r["normalized_relation"].isin(*rules.RELATION_POLICY)), F.lit(False))
    bare = F.coalesce(F.exists(used, lambda r: (F.coalesce(r["related_pmid"], F.lit("")) == "") & (F.coalesce(r["related_doi"], F.lit("")) == "")), F.lit(False))
    statuses = F.array_distinct(F.transform(F.filter("__s", lambda s: s["status"] != "unknown"), lambda s: s["status"]))
    notices = F.array_distinct(F.transform(F.filter("__s", lambda s: ~s["role"].isin("primary_article", "unknown")), lambda s: s["role"]))
    df = df.select("*", odd.alias("__odd"), bare.alias("__bare"), statuses.alias("__statuses"), notices.alias("__notices"))
    none, conflict, roles = F.size("__s") == 0, F.size("__statuses") > 1, F.size("__notices") > 1
    worst = F.array_max(F.transform("__statuses", lambda s: F.struct(lookup(rules.INTEGRITY_PRECEDENCE, s, -1).alias("p"), s.alias("s"))))["s"]
    status = F.when(none, "no_signal").otherwise(F.coalesce(worst, F.lit("unknown")))
    role = F.when(none, "primary_article").when(F.col("__odd") | roles, "unknown").when(F.size("__notices") == 1, F.get("__notices", 0)).otherwise("primary_article")
    df = df.select("*", status.alias("__status"), role.alias("__role"))
    s, r = F.col("__status"), F.col("__role")
    review = ~none & (F.col("__odd") | F.col("__bare") | conflict | s.isin("expression_of_concern", "unknown"))
    eligible = (s == "no_signal") | ((s == "corrected_or_updated") & (r == "primary_article"))
    codes = F.array_compact(
        F.array(
            F.when(none, F.lit("NO_STRUCTURED_INTEGRITY_SIGNAL")),
            F.when(F.col("__odd"), F.lit("UNKNOWN_REF_TYPE")),
            F.when(F.col("__bare"), F.lit("INCOMPLETE_STRUCTURED_RELATION")),
            F.when(conflict, F.lit("CONFLICTING_STRUCTURED_SIGNALS")),
            F.when(roles, F.lit("CONFLICTING_RECORD_ROLES")),
            F.when(s == "retracted", F.lit("RETRACTED_STRUCTURED_METADATA"))
            .when(s == "expression_of_concern", F.lit("EXPRESSION_OF_CONCERN_STRUCTURED_METADATA"))
            .when(s == "corrected_or_updated", F.lit("CORRECTION_OR_UPDATE_STRUCTURED_METADATA"))
            .when(s == "unknown", F.lit("UNRESOLVED_STRUCTURED_METADATA")),
        )
    )
    out = F.struct(
        s.alias("status"),
        r.alias("record_role"),
        review.alias("needs_review"),
        eligible.alias("report_eligible"),
        F.array_sort(codes).alias("reason_codes"),
        F.array_sort(F.array_distinct(F.transform("__s", lambda x: x["text"]))).alias("supporting_signals"),
        F.when(eligible, "eligible_for_report").otherwise("excluded_integrity").alias("final_decision"),
    )
    return df.withColumn("integrity", out).drop("__s", "__odd", "__bare", "__statuses", "__notices", "__status", "__role")
