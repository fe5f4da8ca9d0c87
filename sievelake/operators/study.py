"""Study design, scope, status, flags and tier from titles, abstracts and publication types (C3-C16), as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions.text import tri_state, type_form
from sievelake.operators.spans import first_match

PLANNING = r"(?i)\b(?:planned|future|propos(?:e|ed)|will\s+(?:be\s+assigned|enroll?|randomi[sz]e)|aims?\s+to|recruit(?:ment)?|enrollment)\b"
METHODS = r"(?i)\b(?:methods?|experiments?|assays?|cells?\s+(?:were\s+)?(?:cultured|incubated|treated)|cultured|incubat(?:ed|ion)|performed)\b"
TYPE_RULES = (
    ("systematic_review_meta_analysis", lambda t: t.contains("meta analysis")),
    ("systematic_review_without_meta_analysis", lambda t: t.contains("systematic review")),
    ("scoping_review", lambda t: t.contains("scoping review")),
    ("guideline_or_consensus", lambda t: t.isin("practice guideline", "guideline", "consensus development conference")),
    ("protocol", lambda t: t.contains("protocol")),
    ("case_series", lambda t: t == "case series"),
    ("case_report", lambda t: t == "case reports"),
    ("randomized_controlled_trial", lambda t: t.isin("randomized controlled trial", "randomised controlled trial", "controlled clinical trial")),
    ("diagnostic_accuracy", lambda t: t == "diagnostic accuracy"),
    ("case_control", lambda t: t == "case control studies"),
    ("cross_sectional", lambda t: t == "cross sectional studies"),
    ("prospective_cohort", lambda t: t == "observational study"),
    ("animal_preclinical", lambda t: t.isin("animal", "animals")),
    ("narrative_review", lambda t: t == "review"),
    ("editorial_commentary_letter", lambda t: t.isin("editorial", "comment", "letter")),
)


def design_of_type(kind: Column) -> Column:
    """The family that a publication type names, or null."""
    t, out = type_form(kind), None
    for family, test in TYPE_RULES:
        out = F.when(test(t), family) if out is None else out.when(test(t), family)
    return out


def subtype_of_type(kind: Column) -> Column:
    """What a publication type says beyond its family: a network meta-analysis; else the family itself."""
    return F.when(type_form(kind).contains("network meta analysis"), "network_meta_analysis").otherwise(design_of_type(kind))


def design_of_text(text: Column, source: str) -> Column:
    """C4: the first family whose words a text has; plans and laboratory words count in their context only."""
    out = None
    for family, pattern in rules.DESIGN_TEXT:
        hit = text.rlike(f"(?i){pattern}")
        if family == "protocol" and source != "title":
            hit = hit & F.regexp_extract(text, rf"(?is).{{0,80}}(?:{pattern}).{{0,160}}", 0).rlike(PLANNING)
        if family == "in_vitro":
            hit = hit & F.regexp_extract(text, rf"(?is).{{0,100}}(?:{pattern}).{{0,120}}", 0).rlike(METHODS)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def with_design(articles: DataFrame, title: str = "title", abstract: str = "abstract", types: str = "publication_types", sections: str = "abstract_sections", keywords: str = "keywords") -> DataFrame:
    """Adds design_family, design_subtype, design_conflict and design_spans. A protocol type decides; else the strongest signals must agree."""
    signal = lambda family, source, text: F.struct(F.lit(rules.DESIGN_STRENGTH[source]).alias("strength"), family.alias("family"), F.lit(source).alias("source"), text.alias("text"))
    every = F.concat(
        F.transform(types, lambda t: signal(design_of_type(t), "publication_type", t)),
        F.transform(sections, lambda s: signal(design_of_text(s["text"], "structured_abstract"), "structured_abstract", s["text"])),
        F.array(signal(design_of_text(F.col(title), "title"), "title", F.col(title)), signal(design_of_text(F.col(abstract), "abstract"), "abstract", F.col(abstract))),
        F.transform(keywords, lambda k: signal(design_of_text(k, "keyword"), "keyword", k)),
    )
    df = articles.withColumn("__signals", F.filter(every, lambda s: s["family"].isNotNull()))
    most = F.array_max(F.transform("__signals", lambda s: s["strength"]))
    df = df.withColumn("__best", F.array_distinct(F.transform(F.filter("__signals", lambda s: s["strength"] == most), lambda s: s["family"])))
    protocol = F.exists(types, lambda t: design_of_type(t) == "protocol")
    agree = F.size("__best") == 1
    for pair in rules.COMPATIBLE_DESIGNS:
        agree = agree | ((F.size("__best") == 2) & (F.size(F.array_except("__best", F.lit(list(pair)))) == 0))
    first = F.get(F.filter(F.lit(list(rules.DESIGN_ORDER)), lambda f: F.array_contains("__best", f)), 0)
    none = F.size("__signals") == 0
    family = F.when(none, "unknown").when(protocol, "protocol").when(agree, first).otherwise("unknown")
    df = df.withColumn("__family", family)
    told = F.get(F.filter("__signals", lambda s: (s["strength"] == most) & (s["family"] == F.col("__family"))), 0)
    subtype = F.when((told["source"] == "publication_type") & (F.col("__family") != "protocol"), subtype_of_type(told["text"])).otherwise(F.col("__family"))
    return df.select("*", F.col("__family").alias("design_family"), subtype.alias("design_subtype"), (~none & ~protocol & ~agree).alias("design_conflict"), F.transform("__signals", supporting_span).alias("design_spans")).drop("__signals", "__best", "__family")


def supporting_span(s: Column) -> Column:
    """What a signal was read from, with its place there: the words of the family's pattern, or the publication type itself."""
    whole = F.struct(F.lit(0).alias("start"), F.char_length(s["text"]).alias("stop"), s["text"].alias("span"))
    words = F.coalesce(*[F.when(s["family"] == family, first_match(s["text"], f"(?i){pattern}")) for family, pattern in rules.DESIGN_TEXT], whole)
    at = F.when(s["source"] == "publication_type", whole).otherwise(words)
    return F.struct(s["source"].alias("source"), s["family"].alias("family"), at["span"].alias("span"), at["start"].alias("start"), at["stop"].alias("stop"))


def reasons(family: Column, tier: Column, status: Column, scope: Column, sample: Column, comparator: Column, conflict: Column) -> Column:
    """Why an assessment is as it is, in order."""
    said = (
        (F.lit(True), F.concat(F.lit("design: "), family, F.lit(", from publication types and explicit words, the strongest source first"))),
        (F.lit(True), F.concat(F.lit("tier: "), tier, F.lit(", a triage by abstract and metadata and no appraisal of quality"))),
        (status != "reported", F.lit("results are not sufficiently reported in the abstract")),
        (scope.isin("preclinical_only", "mixed"), F.concat(F.lit("population: "), scope, F.lit(", not taken as human evidence"))),
        (sample != "reported", F.lit("no number in the text is tied to a study population alone")),
        (comparator == "not_reported", F.lit("no comparator is reported in the abstract")),
        (conflict, F.lit("equally strong sources name designs that exclude each other; needs review")),
    )
    return F.array_compact(F.array(*[F.when(test, text) for test, text in said]))


def flags(text: Column) -> Column:
    """What a text says of its design, each true, false or unknown."""
    return F.struct(
        tri_state(text, r"\b(?:randomi[sz]ed|randomization|random allocation)\b", r"\bnon[- ]?randomi[sz]ed\b").alias("randomized"),
        tri_state(text, r"\b(?:double|triple|single)[- ]blind(?:ed)?\b|\bblinded\b", r"\b(?:open[- ]label|unblinded)\b").alias("blinded"),
        tri_state(text, r"\bprospective\b", r"\bnon[- ]?prospective\b").alias("prospective"),
        tri_state(text, r"\bretrospective\b", r"\bnon[- ]?retrospective\b").alias("retrospective"),
        tri_state(text, r"\bmulti[- ]?center\b", r"\bsingle[- ]center\b").alias("multicenter"),
    )


def evidence_tier(family: Column, status: Column, scope: Column, has_abstract: Column) -> Column:
    """C13."""
    reported = status == "reported"
    return (
        F.when((scope == "preclinical_only") | family.isin("animal_preclinical", "in_vitro", "mixed_human_preclinical"), "preclinical")
        .when(family == "pharmacovigilance_disproportionality", "signal_only")
        .when(family.isin("protocol", "editorial_commentary_letter", "unknown", "guideline_or_consensus") | ~has_abstract, "not_assessable")
        .when(family.isin("systematic_review_meta_analysis", "randomized_controlled_trial"), F.when(reported, "higher_strength").otherwise("moderate_strength"))
        .when(family == "systematic_review_without_meta_analysis", "moderate_strength")
        .when(
            family.isin("prospective_cohort", "retrospective_cohort", "case_control", "cross_sectional", "diagnostic_accuracy", "nonrandomized_interventional_study", "pharmacokinetic_pharmacodynamic"),
            F.when(reported, "moderate_strength").otherwise("limited_strength"),
        )
        .when(family.isin("case_report", "case_series", "narrative_review", "scoping_review"), "limited_strength")
        .otherwise("not_assessable")
    )


#: Families by what they lack or say (fixed values).
OBSERVATIONAL = ("prospective_cohort", "retrospective_cohort", "case_control", "cross_sectional", "diagnostic_accuracy")
SECONDARY = ("editorial_commentary_letter", "narrative_review", "systematic_review_meta_analysis", "systematic_review_without_meta_analysis")
PRIMARY = (*OBSERVATIONAL, "randomized_controlled_trial", "nonrandomized_interventional_study", "pharmacokinetic_pharmacodynamic", "case_report", "case_series")
ANIMAL_WORK, PEOPLE = f"(?i){rules.one_of(rules.ANIMAL_WORDS)}", f"(?i){rules.one_of(rules.PEOPLE_WORDS)}"
METHOD_WORDS = r"(?i)\b(?:methods?|methodology|performed|conducted|randomi[sz]ed|enrolled|included)\b"
RESULT_WORDS = r"(?i)\b(?:results?|findings?|found|demonstrated|observed|concluded|conclusions?)\b"


def article_text() -> Column:
    """Title, abstract, labelled sections and keywords, as the study rules read them."""
    parts = F.transform("abstract_sections", lambda s: F.concat(s["label"], F.lit(": "), s["text"]))
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (F.col("title"), F.col("abstract"), F.array_join(parts, " "), F.array_join("keywords", " "))])


def population_scope(family: Column, text: Column) -> Column:
    """Whom a study is about; primary studies are read in their title, methods and results."""
    main = F.filter("abstract_sections", lambda s: F.lower(s["label"]).isin("methods", "results", "patients", "participants"))
    before = F.get(F.split(F.coalesce("abstract", F.lit("")), r"(?i)\b(?:in conclusion|conclusion|conclusions)\b", 2), 0)
    primary = F.concat_ws(" ", F.col("title"), F.when(F.size(main) > 0, F.array_join(F.transform(main, lambda s: s["text"]), " ")).otherwise(before))
    own, mixed = family.isin(*PRIMARY), f"(?i){rules.MIXED}"
    animal, people = text.rlike(ANIMAL_WORK), text.rlike(PEOPLE)
    return (
        F.when(family.isin(*SECONDARY), "not_applicable")
        .when(own & primary.rlike(mixed), "mixed")
        .when(own & primary.rlike(PEOPLE), "human")
        .when(own & primary.rlike(ANIMAL_WORK), "preclinical_only")
        .when(animal & people & text.rlike(mixed), "mixed")
        .when(people, "human")
        .when(animal, "preclinical_only")
        .otherwise("unclear")
    )


def result_status(family: Column, text: Column) -> Column:
    """C7."""
    none = (F.coalesce("abstract", F.lit("")) == "") & (F.coalesce(F.size("abstract_sections"), F.lit(0)) == 0)
    plan = text.rlike(r"(?i)\bpropos(?:e|ed)\b|\bwill\s+(?:be\s+assigned|enroll?|randomi[sz]e)\b") | ~text.rlike(r"(?i)\bresults?\b")
    marked = F.exists("abstract_sections", lambda s: F.lower(s["label"]).isin("results", "conclusions", "findings"))
    return F.when(none, "not_reported").when((family == "protocol") & plan, "not_reported").when(marked | text.rlike(RESULT_WORDS), "reported").otherwise("unclear")


def limitations(text: Column, family: Column, scope: Column, status: Column, sample: Column, comparator: Column, follow_up: Column, multicenter: Column, conflict: Column) -> Column:
    """C14: codes in their order, without repeats."""
    none = (F.coalesce("abstract", F.lit("")) == "") & (F.coalesce(F.size("abstract_sections"), F.lit(0)) == 0)
    signal = family == "pharmacovigilance_disproportionality"
    tests = (
        (none, "abstract_missing"),
        (~text.rlike(METHOD_WORDS), "methods_not_reported"),
        (sample != "reported", "sample_size_not_reported"),
        (comparator == "not_reported", "comparator_not_reported"),
        (family.isin("randomized_controlled_trial", *OBSERVATIONAL) & follow_up.isNull(), "follow_up_not_reported"),
        (family.isin("nonrandomized_interventional_study", *OBSERVATIONAL), "nonrandomized"),
        (family == "retrospective_cohort", "retrospective_design"),
        (multicenter == "false", "single_center"),
        (family.isin("case_report", "case_series"), "case_report_or_series"),
        (family == "protocol", "protocol_no_results"),
        (scope == "preclinical_only", "preclinical_only"),
        (scope == "mixed", "mixed_population"),
        (signal, "pharmacovigilance_reporting_bias"),
        (signal, "pharmacovigilance_no_incidence"),
        (signal, "pharmacovigilance_no_causality"),
        (comparator == "not_applicable", "uncontrolled_study"),
        (family == "unknown", "design_unclear"),
        (conflict, "conflicting_design_signals"),
        (status == "unclear", "methods_not_reported"),
        (sample == "ambiguous", "design_unclear"),
    )
    return F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(code)) for t, code in tests])))


def with_study(articles: DataFrame) -> DataFrame:
    """Adds ``study``; needs with_extraction's ``extraction`` for sample size, comparator and follow-up."""
    df = with_design(articles).withColumn("__text", article_text())
    df = df.select("*", population_scope(F.col("design_family"), F.col("__text")).alias("__scope"), result_status(F.col("design_family"), F.col("__text")).alias("__status"), flags(F.col("__text")).alias("__flags"))
    x = F.col("extraction")
    codes = limitations(F.col("__text"), F.col("design_family"), F.col("__scope"), F.col("__status"), x["sample_size_status"], x["comparator"]["status"], x["follow_up"], F.col("__flags.multicenter"), F.col("design_conflict"))
    df = df.withColumn("__codes", codes)
    has = ~F.array_contains("__codes", "abstract_missing")
    df = df.withColumn("__tier", evidence_tier(F.col("design_family"), F.col("__status"), F.col("__scope"), has))
    review = (F.col("design_family") == "unknown") | F.col("design_conflict") | ~has | (x["sample_size_status"] == "ambiguous")
    out = F.struct(
        F.col("design_family").alias("design_family"),
        F.col("design_subtype").alias("design_subtype"),
        F.col("__scope").alias("population_scope"),
        F.col("__status").alias("result_status"),
        F.col("__tier").alias("evidence_tier"),
        F.when(F.col("design_family") == "unknown", "low").when(review, "medium").otherwise("high").alias("confidence"),
        review.alias("needs_review"),
        x["sample_size"].alias("sample_size"),
        x["sample_size_status"].alias("sample_size_status"),
        x["comparator"]["status"].alias("comparator_status"),
        F.col("__flags").alias("flags"),
        F.col("__codes").alias("limitation_codes"),
        F.col("design_spans").alias("supporting_spans"),
        reasons(F.col("design_family"), F.col("__tier"), F.col("__status"), F.col("__scope"), x["sample_size_status"], x["comparator"]["status"], F.col("design_conflict")).alias("reasons"),
    )
    return df.withColumn("study", out).drop("__text", "__scope", "__status", "__flags", "__codes", "__tier")
