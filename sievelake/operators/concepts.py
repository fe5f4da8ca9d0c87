"""Concepts of terms and headings, and the edges between articles and concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import space_form
from sievelake.operators.records import last_wins, two_tier_lookup

#: Fields in the order in which they are named (fixed values), and the confidence of a match.
FIELDS = ("title", "abstract", "mesh_headings", "keywords")
CONFIDENCE = {"exact": 1.0, "normalized": 0.9, "unresolved": 0.0}


MENTION = ["vocabulary", "concept_id", "label", "original_term", "confidence", "pmid"]


def heading_mentions(articles: DataFrame) -> DataFrame:
    """A row for each heading id of each article, with the id's first label. A concept's articles stay rows, however many they are."""
    rows = articles.select("pmid", F.posexplode("mesh_descriptors").alias("at", "m")).filter("m.ui <> ''").select("pmid", "at", F.col("m.ui").alias("concept_id"), F.col("m.text").alias("text"))
    labels = rows.groupBy("concept_id").agg(F.min_by("text", F.struct("pmid", "at")).alias("label"))
    named = rows.select("concept_id", "pmid").distinct().join(labels, "concept_id")
    return named.select(F.lit("mesh").alias("vocabulary"), "concept_id", "label", F.col("label").alias("original_term"), F.lit(1.0).alias("confidence"), "pmid")


def term_mentions(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows of (term, pmid), each term resolved once: exactly, after normalising, or to a made id."""
    found = two_tier_lookup(terms.select("term").distinct(), vocabulary, "term", "label", "code", space_form)
    confidence = F.element_at(F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))]), F.col("match_method"))
    kind = F.when(F.col("match_method") == "unresolved", "unresolved").otherwise("rxnorm")
    found = found.select("term", kind.alias("vocabulary"), F.col("code").alias("concept_id"), confidence.alias("confidence"))
    return terms.select("term", "pmid").distinct().join(found, "term").select("vocabulary", "concept_id", F.col("term").alias("label"), F.col("term").alias("original_term"), "confidence", "pmid")


def merge(mentions: DataFrame) -> DataFrame:
    """One row for each vocabulary, id and original term: greatest confidence, least label, number of articles. Which they are say the mentions."""
    key = ["vocabulary", "concept_id", "original_term"]
    each = mentions.groupBy(*key, "pmid").agg(F.max("confidence").alias("confidence"), F.min("label").alias("label"))
    return each.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.min("label").alias("label"), F.count("pmid").alias("articles"))


def concept_order() -> list[Column]:
    """O4."""
    return [F.col("vocabulary"), F.lower("label"), F.col("concept_id")]


def links(mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """An edge for each article, concept and field of the article in which the concept's term stands; of several terms the last names it."""
    rows = mentions.groupBy("vocabulary", "concept_id", "original_term", "pmid").agg(F.max("confidence").alias("confidence"))
    joined = rows.join(articles.select("pmid", *FIELDS), "pmid").withColumn("t", space_form(F.col("original_term")))
    inside = lambda c: space_form(F.coalesce(c, F.lit(""))).contains(F.col("t"))
    equal = lambda c: F.array_contains(F.transform(c, space_form), F.col("t"))
    found = [F.when(inside(F.col("title")), F.lit("title")), F.when(inside(F.col("abstract")), F.lit("abstract")), F.when(equal("mesh_headings"), F.lit("mesh_headings")), F.when(equal("keywords"), F.lit("keywords"))]
    edges = joined.select("pmid", "vocabulary", "concept_id", "original_term", "confidence", F.explode(F.array_compact(F.array(*found))).alias("source_field"))
    return last_wins(edges, ["pmid", "vocabulary", "concept_id", "source_field"], F.col("original_term")).withColumn("edge_type", F.lit("ARTICLE_MENTIONS_CONCEPT"))
