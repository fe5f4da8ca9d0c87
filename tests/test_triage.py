import random

from pyspark.sql import functions as F

from sievelake.operators.relevance import parse_target
from sievelake.plans.triage import quality, triage
from sievelake.sources.articles import ARTICLE

TARGET = parse_target("acyclovir for herpes safety", "acyclovir", "herpes")


def row(pmid, title, abstract, types=(), relation=None, pos=0):
    rel = [(relation, relation, "9", None, "")] if relation else []
    return (pmid, title, abstract, [], "J", None, "", None, False, list(types), "", "", [], [], [], [], rel, "t1", pos)


ROWS = [
    row("1", "Acyclovir in herpes: a randomized controlled trial", "Safety in 200 patients; 200 patients were randomized. Results improved versus placebo.", ["Randomized Controlled Trial"]),
    row("2", "Acyclovir for herpes: case report", "Adverse events in a patient.", ["Case Reports"], pos=1),
    row("3", "Acyclovir in herpes", "Safety in patients.", [], "retraction_in", pos=2),
    row("4", "Weather", "Rain.", pos=3),
    row("1", "Copy", "Copy", pos=4),
    row("5", "Herpes care", "Patients were seen.", pos=5),
]


def test_end_to_end(spark):
    schema, want = f"{ARTICLE}, topic_id string, retrieval_pos int", None
    for seed in (1, 2):
        rows = list(ROWS)
        random.Random(seed).shuffle(rows)
        got = triage(spark.createDataFrame(rows, schema).repartition(3), TARGET, "2024-01-01", "acyclovir herpes")
        by = {r.pmid: (r.decision, r["rank"], r.section) for r in got.collect()}
        assert want in (None, by)
        want = by
    assert by["1"] == ("included_direct", 1, "key_evidence") and by["2"] == ("included_direct", 2, "early_safety_signals")
    assert by["3"] == ("excluded_integrity", None, None) and by["4"][0] == "excluded_irrelevant" and by["5"] == ("included_contextual", 3, "clinical_background_and_overview")
    q = quality(got).first()
    assert (q.candidates, q.included_direct, q.excluded_integrity) == (5, 2, 1)
    cut = triage(spark.createDataFrame(ROWS, schema), TARGET, "2024-01-01", "acyclovir herpes", limit=1)
    assert cut.filter(F.col("decision") == "excluded_report_limit").count() == 2


def test_counters_are_observed_without_a_scan_of_their_own(spark):
    from sievelake.plans.triage import Counters, duplicates

    schema = f"{ARTICLE}, topic_id string, retrieval_pos int"
    rows = spark.createDataFrame(ROWS, schema)
    counters = Counters("herpes", total_count=99, candidate_limit=50, report_limit=1)
    got = triage(rows, TARGET, "2024-01-01", "acyclovir herpes", limit=1, counters=counters)
    plain = triage(rows, TARGET, "2024-01-01", "acyclovir herpes", limit=1)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(got) == scans(plain) <= 4
    by = [r.decision for r in got.collect()]
    said = counters.summary()
    assert len(said) == 16 and (said["query"], said["total_count"], said["candidate_limit"], said["report_limit"]) == ("herpes", 99, 50, 1)
    assert (said["raw_candidate_count"], said["candidate_count"], said["duplicate_count"]) == (6, 5, 1) and [r.pmid for r in duplicates(rows).collect()] == ["1"]
    assert said["included_count"] == sum(d.startswith("included_") for d in by) == 1 and said["excluded_report_limit_count"] == by.count("excluded_report_limit") == 2
    assert said["excluded_integrity_count"] == by.count("excluded_integrity") == 1 and said["excluded_irrelevant_count"] == by.count("excluded_irrelevant") == 1
    assert said["excluded_count"] == 3 and said["direct_count"] + said["class_level_count"] + said["contextual_count"] + said["irrelevant_count"] == 5


def test_a_stage_is_computed_once(spark):
    from sievelake.plans.stage import Stage, cut

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    stage = Stage(spark)
    rows = spark.range(1000).mapInArrow(count, "id long")
    for keep in (stage.keep, cut):
        before = seen.value
        kept = keep(rows)
        assert kept.filter("id % 2 = 0").count() + kept.filter("id % 2 = 1").count() == 1000 and seen.value == before + 1000
    path = kept.inputFiles()[0]
    stage.drop("t1")
    assert "/tmp/checkpoints/sievelake/" in path and not stage._at("t1")[0].exists(stage._at("t1")[1])


def test_relevance_keeps_the_callers_columns_and_says_where_a_role_was_read(spark):
    from sievelake.operators.relevance import with_relevance

    rows = [row("1", "Herpes today", "First. Patients received acyclovir for herpes! End."), row("2", "Acyclovir versus placebo", ""), row("3", "Rain", None)]
    articles = spark.createDataFrame(rows, f"{ARTICLE}, topic_id string, retrieval_pos int").withColumns({"__f": F.lit("mine"), "__mine": F.lit(1), "__t": F.lit(2)})
    got = {r.pmid: r for r in with_relevance(articles, TARGET).collect()}
    assert all(r["__f"] == "mine" and r["__mine"] == 1 and r["__t"] == 2 for r in got.values())
    one = got["1"].relevance
    assert (one.requested_role, one.role_rule, one.role_span.source) == ("primary_intervention", "ROLE_EVALUATED_TREATMENT", "abstract")
    assert rows[0][2][one.role_span.start : one.role_span.stop] == one.role_span.text == "Patients received acyclovir for herpes!"
    two = got["2"].relevance
    assert (two.requested_role, two.role_rule, two.role_span.start, two.role_span.stop) == ("primary_intervention", "ROLE_TITLE_PRIMARY", 0, 24)
    assert got["3"].relevance.role_rule == "ROLE_UNRESOLVED" and got["3"].relevance.role_span is None
