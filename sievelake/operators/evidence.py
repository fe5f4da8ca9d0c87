"""Evidence level, lexical relevance, overall score and section of an article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions.text import evidence_level, lookup, overall_score, section_of, tokens

#: Words that say nothing of a topic.
STOPWORDS = tuple(
    "a about after all also an and any are as at be been before between both but by can compared do does during each effect effects evidence for from had has have how if in into is it its may more most no not of on or other our over "
    "patients per role same so some study such than that the their them then there these they this those to treatment trial under until up use used using vs was we were what when where which who will with within without".split()
)


def with_evidence(articles: DataFrame, fetched_at: str, topic: str) -> DataFrame:
    """Adds ``assessment``: level, evidence, relevance and overall score, section, reasons and limitations."""
    wanted = tokens(F.lit(topic), STOPWORDS)
    title, abstract = tokens(F.coalesce("title", F.lit("")), STOPWORDS), tokens(F.coalesce("abstract", F.lit("")), STOPWORDS)
    in_title, in_abstract = F.size(F.array_intersect(title, wanted)), F.size(F.array_intersect(abstract, wanted))
    relevance = 50 + F.when(in_title > 0, 10).otherwise(F.when(in_abstract > 0, 5).otherwise(0)) + F.when(in_title >= 2, 10).otherwise(0)
    level = evidence_level("publication_types")
    future = F.coalesce(F.col("publication_date") > F.to_date(F.lit(fetched_at)), F.lit(False))
    has = F.coalesce("abstract", F.lit("")) != ""
    evidence = F.least(F.lit(100), F.greatest(F.lit(0), lookup(rules.EVIDENCE_SCORE, level, 30) + F.when(has, 5).otherwise(0) - F.when(future, 20).otherwise(0)))
    df = articles.select("*", level.alias("__level"), evidence.alias("__evidence"), relevance.alias("__relevance"), future.alias("__future"), has.alias("__has"))
    overall = overall_score(F.col("__evidence"), F.col("__relevance"))
    lv, epub = F.col("__level"), F.coalesce(F.col("is_epub_ahead_of_print"), F.lit(False)) if "is_epub_ahead_of_print" in articles.columns else F.lit(False)
    codes = lambda *tests: F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in tests]))
    limits = codes((~F.col("__has"), "no_abstract"), (F.col("__future"), "future_dated"), (epub, "ahead_of_print"), (lv == "observational", "observational_design"), (lv == "narrative_review", "no_primary_study"), (lv == "other", "unclassified_design"))
    why = codes((lv.isin("guideline", "systematic_review", "randomized_trial"), "high_evidence_level"), (F.col("__relevance") >= 60, "topic_in_title_or_abstract"), (F.col("__has"), "abstract_available"))
    out = F.struct(
        F.col("__level").alias("evidence_level"),
        F.col("__evidence").alias("evidence_score"),
        F.col("__relevance").alias("relevance_score"),
        overall.alias("overall_score"),
        section_of(overall, F.col("__future")).alias("section"),
        F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("retrieved_by_topic"))).alias("reasons"),
        limits.alias("limitations"),
    )
    return df.withColumn("assessment", out).drop("__level", "__evidence", "__relevance", "__future", "__has")
