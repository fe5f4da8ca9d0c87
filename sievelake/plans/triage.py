"""The literature pipeline end to end: candidates to ranked, audited and placed articles.

Cheap structured tests come first, integrity and relevance filter before texts go to the extraction UDF, and
only rows that stay are ranked. Each stage is written once and read by what follows: rule expressions are long, and Spark would
otherwise plan and run them once for each use. Articles are ranked within their topic by counts of coarse keys, so that no
task sorts a whole topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievelake.operators import ranking
from sievelake.operators.evidence import with_evidence
from sievelake.operators.extraction import with_extraction
from sievelake.operators.integrity import with_integrity
from sievelake.operators.records import first_wins, repeated_keys
from sievelake.operators.relevance import Target, with_relevance
from sievelake.operators.study import with_study
from sievelake.plans.stage import Stage, spread

KEY = ["topic_id"]
DECISIONS = ("included_direct", "included_class_level", "included_contextual", "excluded_irrelevant", "excluded_integrity", "excluded_report_limit")


class Counters:
    """A3: the counters of a search, observed in flight: what passes a point of the plan is counted where it passes, so nothing is read for them.

    ``summary`` waits for the job that computes the decisions. A task that is repeated because an executor was lost counts once, unless its
    stage had ended.
    """

    def __init__(self, query: str = "", total_count: int | None = None, candidate_limit: int | None = None, report_limit: int | None = None):
        self.given = {"query": query, "total_count": total_count, "candidate_limit": candidate_limit, "report_limit": report_limit}
        self.raw, self.unique, self.decided = Observation(), Observation(), Observation()

    def at_source(self, df: DataFrame) -> DataFrame:
        return df.observe(self.raw, F.count(F.lit(1)).alias("raw_candidate_count"))

    def after_dedup(self, df: DataFrame) -> DataFrame:
        return df.observe(self.unique, F.count(F.lit(1)).alias("candidate_count"))

    def at_the_end(self, df: DataFrame) -> DataFrame:
        return df.observe(self.decided, *counts())

    def summary(self) -> dict:
        """All counters; the repeated ids themselves, which may be many, are ``duplicates``."""
        raw, unique, ends = self.raw.get, self.unique.get, self.decided.get
        return self.given | raw | unique | {"duplicate_count": raw["raw_candidate_count"] - unique["candidate_count"]} | ends


def counts() -> list:
    """What became of candidates (decision, relevance_class, eligible), as aggregates."""
    n, decision, kind = (lambda test, name: F.count_if(test).alias(name)), F.col("decision"), F.col("relevance_class")
    return [
        n(decision.startswith("included_"), "included_count"),
        n(decision.isin("excluded_irrelevant", "excluded_report_limit"), "excluded_count"),
        *[n(kind == k, f"{k}_count") for k in ("direct", "class_level", "contextual", "irrelevant")],
        n(decision == "excluded_irrelevant", "excluded_irrelevant_count"),
        n(decision == "excluded_report_limit", "excluded_report_limit_count"),
        n(~F.col("eligible"), "excluded_integrity_count"),
    ]


def duplicates(articles: DataFrame) -> DataFrame:
    """A2: ids that more than one candidate of a topic has."""
    return repeated_keys(articles.filter("pmid <> ''"), [*KEY, "pmid"]).select(*KEY, "pmid")


def candidates(stage: Stage, articles: DataFrame, target: Target, counters: Counters) -> DataFrame:
    """First article of each id (in order of retrieval), with integrity and relevance."""
    rows = counters.after_dedup(first_wins(counters.at_source(articles), [*KEY, "pmid"], F.col("retrieval_pos")))
    rows = stage.keep(with_integrity(rows), "integrity")
    every = stage.keep(with_relevance(rows, target), "relevance")
    stage.drop("integrity")
    return every


def triage(articles: DataFrame, target: Target, fetched_at: str, topic: str, *, limit: int = 10, cap: int = 10, counters: Counters | None = None) -> DataFrame:
    """One row a candidate: decision, rank, section and display; excluded rows have a null rank. ``counters`` are filled when the rows are computed.

    ``articles`` has the article columns, topic_id and retrieval_pos.
    """
    stage, counters = Stage(articles.sparkSession, "triage"), counters or Counters()
    every = candidates(stage, articles, target, counters)
    ok = (F.col("relevance.relevance_class") != "irrelevant") & F.col("integrity.report_eligible")
    extracted = stage.keep(with_extraction(spread(every.filter(ok))), "extracted")
    studied = stage.keep(with_study(extracted), "studied")
    stage.drop("extracted")
    judged = with_evidence(studied, fetched_at, topic).select(
        *KEY, "pmid", "publication_date", "relevance.relevance_class", "relevance.query_intents", "relevance.article_intents", "relevance.content_role", "relevance.relevance_score",
        "study.evidence_tier", "study.design_family", "study.limitation_codes", "study.sample_size", "study.sample_size_status", "study.population_scope", "study.comparator_status",
        "assessment.section", "assessment.overall_score",
    )
    judged = stage.keep(judged, "judged")
    stage.drop("studied")
    told = every.select(*KEY, "pmid", F.col("relevance.decision").alias("said"), F.col("relevance.relevance_class").alias("relevance_class"), F.col("integrity.report_eligible").alias("eligible"))
    return counters.at_the_end(decide(told, judged, limit=limit, cap=cap, stage=stage)).drop("relevance_class", "eligible")


def decide(every: DataFrame, judged: DataFrame, *, limit: int = 10, cap: int = 10, stage: Stage | None = None) -> DataFrame:
    """Ranks what was judged within its topic, places the first ``limit`` with the running cap, and says of every candidate what became of it.

    ``every`` has topic_id, pmid, said (the decision of relevance), relevance_class and eligible; ``judged`` the columns that ``evidence_keys`` and
    ``report_route`` read. Ranks are written once; of a topic only ``limit`` rows are placed.
    """
    stage = stage or Stage(every.sparkSession, "decide")
    ranked = ranking.evidence_rank(judged, KEY)
    route = F.when(F.col("rank") <= limit, ranking.report_route())
    ranked = stage.keep(ranked.select(*KEY, "pmid", "rank", route.alias("route")), "ranked")
    chosen = ranking.place_with_cap(ranked.filter(F.col("rank") <= limit), KEY, [F.col("rank")], F.col("route"), "key_evidence", cap)
    rest = ranked.filter(F.col("rank") > limit).select(*KEY, "pmid", "rank", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("display"))
    rows = every.join(chosen.select(*KEY, "pmid", "rank", "section", "display").union(rest), [*KEY, "pmid"], "left")
    decision = F.when(~F.col("eligible"), "excluded_integrity").when(F.col("rank") > limit, "excluded_report_limit").otherwise(F.col("said"))
    return rows.select(*KEY, "pmid", decision.alias("decision"), "rank", "section", "display", "relevance_class", "eligible")


def quality(decisions: DataFrame) -> DataFrame:
    """A3: how many candidates ended in each decision."""
    return decisions.groupBy(*KEY).agg(
        F.count("*").alias("candidates"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS],
    )
