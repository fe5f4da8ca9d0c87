"""Term discovery, scoring, incremental profiles and concepts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions.numbers import round_half_even
from sievelake.functions.text import lookup, recency_score, space_form, tokens
from sievelake.operators.ranking import total_rank
from sievelake.plans.stage import spread


def document_frequency(occurrences: DataFrame, term: str, doc: str, order: Column, source: str | None = None, stop: Iterable[str] = ()) -> DataFrame:
    """Documents of each normalised term, and the source that had it first. Stop terms and empty ones go."""
    df = occurrences.withColumn("term", space_form(F.col(term))).filter("term <> ''")
    stop = list(stop)
    if stop:
        df = df.filter(~F.col("term").isin(*stop))
    out = [F.countDistinct(doc).alias("document_frequency")]
    if source:
        out.append(F.min_by(source, order).alias("source"))
    return df.groupBy("term").agg(*out)


def term_score(df: Column, most: Column, evidence: Column, days: Column, overlap: Column, boost: Column) -> Column:
    """The weighted score, not rounded."""
    return F.least(F.lit(100.0), 0.40 * df / most * 100 + 0.30 * evidence + 0.20 * recency_score(days) + 0.10 * overlap * 100 + boost)


def accepted(frequency: Column, score: Column) -> Column:
    """Q6."""
    return (frequency >= rules.LEAST_FREQUENCY) & (score >= rules.ACCEPT_SCORE)


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows are term, score, accepted. Of two accepted the higher score stays (the old one of equals); a
    rejected term that is accepted now is upgraded; a newly rejected one counts only if unseen; nothing is removed."""
    o = old.select("term", F.struct("score", "accepted").alias("o"))
    n = new.select("term", F.struct("score", "accepted").alias("n"))
    take_new = F.col("o").isNull() | (F.col("n.accepted") & (~F.col("o.accepted") | (F.col("n.score") > F.col("o.score"))))
    pick = F.when(F.col("n").isNull(), F.col("o")).when(take_new, F.col("n")).otherwise(F.col("o"))
    return o.join(n, "term", "full_outer").select("term", pick.alias("p")).select("term", "p.score", "p.accepted")


def merge_concepts(concepts: DataFrame, keys: list[str], documents: str, confidence: str) -> DataFrame:
    """One row for each concept: greatest confidence, documents in order without repeats."""
    return concepts.groupBy(*keys).agg(F.max(confidence).alias(confidence), F.array_sort(F.collect_set(documents)).alias("documents"))


def candidate_terms(articles: DataFrame) -> DataFrame:
    """A row for each normalised term of each article: term, pmid, where it was first seen, whether title or abstract hold it.

    ``articles`` are rows of pmid, rank, title, abstract, headings, keywords (arrays), evidence_level and published (a date). An article's headings come
    before its keywords; a term that repeats within an article counts once. Stop terms and empty ones go; articles without an id have no terms.
    """
    place = lambda values, source, kind: F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda x, i: F.struct(space_form(x).alias("term"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), i.alias("i")))
    told = F.filter(F.concat(place(F.col("headings"), "mesh", 0), place(F.col("keywords"), "keyword", 1)), lambda t: (t["term"] != "") & ~t["term"].isin(*rules.STOP_TERMS))
    title, abstract = (space_form(F.coalesce(c, F.lit(""))) for c in ("title", "abstract"))
    # an article's terms are looked for in its texts before they are spread, so that texts don't travel with terms
    told = F.transform(told, lambda t: F.struct(t["term"].alias("term"), t["source"].alias("source"), t["kind"].alias("kind"), t["i"].alias("i"), title.contains(t["term"]).alias("in_title"), abstract.contains(t["term"]).alias("in_abstract")))
    # dealt by article first: then an article's terms meet where they are made, and no task gathers those of a whole file
    rows = spread(articles.filter("pmid is not null"), "pmid").select("pmid", "rank", "evidence_level", "published", F.inline(told))
    first = F.struct("rank", "kind", "i", "pmid").alias("at")
    return rows.groupBy("term", "pmid").agg(F.min(F.struct("rank", "kind", "i", "pmid")).alias("at"), F.min_by("source", first).alias("source"), *[F.max(c).alias(c) for c in ("in_title", "in_abstract", "published")], F.min_by("evidence_level", first).alias("evidence_level"))


def topic_overlap(term: Column, topic: str) -> Column:
    """The share of a term's words that the topic has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(term), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, tokens(F.lit(topic)))) / F.size(words))


def scored_terms(articles: DataFrame, topic: str, on: str) -> DataFrame:
    """Candidate terms with their score (one place, rounded as the exact value says) and what it was made of.

    The greatest document frequency is one row, which every task gets.
    """
    pairs = candidate_terms(articles)
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.EVIDENCE_ORDINAL.items() for x in kv]), F.col("evidence_level")), F.lit(0))
    by = pairs.groupBy("term").agg(
        F.count("*").alias("document_frequency"), F.min("at").alias("first"), F.min_by("source", "at").alias("source"), F.max(order).alias("evidence_order"),
        F.max("published").alias("latest"), F.max("in_title").alias("in_title"), F.max(~F.col("in_title") & F.col("in_abstract")).alias("in_abstract"),
    )
    by = by.withColumns({
        "evidence_max": lookup({v: k for k, v in rules.EVIDENCE_ORDINAL.items()}, F.col("evidence_order"), "other"),
        "recency_days": F.coalesce(F.greatest(F.lit(0), F.datediff(F.lit(on).cast("date"), "latest")), F.lit(rules.NO_DATE_DAYS)),
        "overlap": topic_overlap(F.col("term"), topic),
        "boost": F.least(F.lit(rules.BOOST_CAP), F.when(F.col("in_title"), rules.TITLE_BOOST).when(F.col("in_abstract"), rules.ABSTRACT_BOOST).otherwise(0)),
    })
    by = by.join(F.broadcast(by.agg(F.max("document_frequency").alias("most"))), how="cross")
    bonus = lookup(rules.EVIDENCE_BONUS, F.col("evidence_max"), 20)
    score = round_half_even(term_score(F.col("document_frequency"), F.col("most"), bonus, F.col("recency_days"), F.col("overlap"), F.col("boost")), 1)
    return by.select("term", "source", "document_frequency", "evidence_max", "recency_days", round_half_even(F.col("overlap"), 2).alias("direct_topic_overlap"), "boost", score.alias("score"), "first")


def build_profile(scored: DataFrame, topic: str) -> DataFrame:
    """The profile of a topic: of each term the best score, whether it is accepted, and its place: accepted ones first, then by score, then as first seen
    (by term where rows don't say). The query stays the topic.
    """
    if "first" not in scored.columns:
        scored = scored.withColumn("first", F.col("term"))
    keep = ["score", "document_frequency", "first", *[c for c in scored.columns if c not in ("term", "score", "document_frequency", "first")]]
    best = scored.groupBy("term").agg(F.max_by(F.struct(*keep), F.struct("score", "document_frequency")).alias("b"))
    rows = best.select(F.lit(topic).alias("topic"), F.lit(topic).alias("query"), "term", "b.*", accepted(F.col("b.document_frequency"), F.col("b.score")).alias("accepted"))
    place = F.floor(F.col("score")).cast("int")
    return total_rank(rows, [~F.col("accepted"), -place], [-F.col("score"), F.col("first"), F.col("term")], "position").drop("first")


def save_profile(profile: DataFrame, path: str) -> None:
    """K5: overwrites the topic's profile."""
    profile.write.mode("overwrite").json(path)


def load_profile(spark, path: str) -> DataFrame | None:
    """The saved profile, or None where there is none or it can't be read as one."""
    schema = "topic string, query string, term string, score double, document_frequency bigint, accepted boolean"
    try:
        found = spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return None if found.filter("topic is null or term is null").limit(1).count() else found


def concept_totals(concepts: DataFrame, method: str = "match_method") -> DataFrame:
    """How many concepts were found by which kind of match."""
    m = F.col(method)
    return concepts.agg(F.count("*").alias("total"), *[F.count_if(m == k).alias(k) for k in ("exact", "normalized", "unresolved")])
