"""Total orders, top-k with an audit of what was left out, and placement with a running cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake import rules
from sievelake.functions.text import lookup
from sievelake.operators.trees import fresh


def total_rank(df: DataFrame, prefix: Sequence[Column], rest: Sequence[Column], name: str = "rank", group: Sequence[str] = ()) -> DataFrame:
    """Each row's place (in its group) in the order of ``prefix`` then ``rest``, without sorting the table or a group in one task.

    Rows are numbered within each value of the prefix and the counts of lesser prefixes are added. Only those
    counts, one row for each prefix value, are summed in one task a group; so the prefix should have a bounded domain, and
    enough values that none holds too many rows.
    """
    keys = [f"__p{i}" for i in range(len(prefix))]
    df = df.select("*", *[c.alias(k) for c, k in zip(prefix, keys, strict=True)])
    counts = df.groupBy(*group, *keys).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    placed = df.withColumn("__at", F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*rest)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*group, *keys)]
    out = placed.alias("l").join(before.alias("r"), same)
    return out.select(*[F.col(f"l.{c}") for c in df.columns if c not in keys], (F.col("__before") + F.col("__at")).alias(name))


def evidence_rank(df: DataFrame, group: Sequence[str], name: str = "rank") -> DataFrame:
    """The evidence rank within each group: class, shared intent, tier and design first, which have a few hundred values."""
    keys = evidence_keys()
    return total_rank(df, keys[:4], keys[4:], name, group)


def legacy_keys() -> list[Column]:
    """O1: the older order: section, tier, overall score, date, id."""
    day = F.unix_date(F.coalesce("publication_date", F.to_date(F.lit("0001-01-01"))))
    return [lookup(rules.SECTION_ORDER, F.col("section"), 3), lookup(rules.TIER_ORDER, F.col("evidence_tier"), 6), -F.col("overall_score"), -day, F.col("pmid")]


def evidence_keys(row: str = "") -> list[Column]:
    """The eleven components of the evidence rank, all ascending."""
    c = lambda n: F.col(f"{row}{n}")
    shared = F.arrays_overlap(c("query_intents"), c("article_intents"))
    sample = F.when((c("sample_size_status") == "reported") & (c("sample_size") > 0), F.least(c("sample_size"), F.lit(rules.SAMPLE_CAP))).otherwise(0)
    return [
        lookup(rules.CLASS_ORDER, c("relevance_class"), 3),
        -F.coalesce(shared, F.lit(False)).cast("int"),
        lookup(rules.TIER_ORDER, c("evidence_tier"), 6),
        lookup(rules.DESIGN_RANK, c("design_family"), 99),
        F.coalesce(F.size("limitation_codes"), F.lit(99)),
        -sample,
        -F.coalesce(c("relevance_score"), F.lit(0)),
        lookup(rules.SECTION_ORDER, c("section"), 3),
        -c("overall_score"),
        -F.unix_date(F.coalesce(c("publication_date"), F.to_date(F.lit("0001-01-01")))),
        c("pmid"),
    ]


#: The components of the evidence rank, in order (fixed values).
COMPONENTS = ("class_order", "intent_mismatch_order", "tier_order", "design_order", "limitations", "sample_size", "relevance", "section_order", "overall_score", "published", "pmid")


def ranking_audit(row: str = "") -> Column:
    """What a rank was made of, each component by its name; rows sort by the struct as they are ranked."""
    return F.struct(*[key.alias(name) for key, name in zip(evidence_keys(row), COMPONENTS, strict=True)])


def audit(df: DataFrame, eligible: Column, rank: str, limit: int, rule_reason: Column) -> DataFrame:
    """What became of each candidate: included, beyond the report's limit, or excluded by a rule."""
    return df.withColumn("decision", F.when(~eligible, rule_reason).when(F.col(rank) <= limit, "included").otherwise("excluded_report_limit"))


def place_with_cap(df: DataFrame, group: Sequence[str], order: Sequence[Column], section: Column, principal: str, cap: int) -> DataFrame:
    """Rows of the principal section beyond the cap go, collapsed, to the additional section; counted by group."""
    df = df.withColumn("section", section)
    running = F.sum((F.col("section") == principal).cast("int")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    over = (F.col("section") == principal) & (F.col("__running") > cap)
    df = df.withColumn("__running", running)
    return df.withColumn("display", F.when(over, "collapsed").otherwise("full")).withColumn("section", F.when(over, "additional_selected_evidence").otherwise(F.col("section"))).drop("__running")


def effective_placement(df: DataFrame, group: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """The report's sections with the cap; a group of which no row was judged for relevance (older data) keeps the section that its assessment gave, all
    rows in full and none counted against the cap.

    Whether a group was judged is one row a group, found before the rows are placed.
    """
    mark = fresh(df, "judged")
    kind = df.groupBy(*group).agg(F.max(F.col("relevance_class").isNotNull()).alias(mark))
    df = df.join(kind, list(group))
    placed = place_with_cap(df.filter(mark), group, order, report_route(), "key_evidence", cap)
    return placed.unionByName(df.filter(~F.col(mark)).withColumn("display", F.lit("full"))).drop(mark)


def report_route(row: str = "") -> Column:
    """The report's section of an article, by the first rule that holds."""
    c = lambda n: F.col(f"{row}{n}")
    wanted = c("relevance_class").isin("direct", "class_level")
    efficacy_only = F.array_contains(c("query_intents"), "efficacy") & ~F.array_contains(c("query_intents"), "safety")
    return (
        F.when(c("population_scope") == "preclinical_only", "audit_only")
        .when(c("design_family").isin("case_report", "case_series"), "early_safety_signals")
        .when(c("design_family") == "pharmacovigilance_disproportionality", "pharmacovigilance_signals")
        .when(c("content_role").isin("emerging_mechanism", "research_enabler"), "emerging_mechanisms_and_research_trends")
        .when(c("design_family") == "narrative_review", "clinical_background_and_overview")
        .when(wanted & (c("sample_size") < 30), "clinical_background_and_overview")
        .when(wanted & efficacy_only & (c("comparator_status") == "not_reported"), "clinical_background_and_overview")
        .when(wanted, "key_evidence")
        .when(c("relevance_class") == "contextual", "clinical_background_and_overview")
        .otherwise("audit_only")
    )
