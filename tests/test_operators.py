import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions import text as X
from sievelake.operators import diff, ranking, records, regulatory, study
from sievelake.operators.integrity import with_integrity
from sievelake.sources.articles import month, parse_articles

RELATION = "array<struct<normalized_relation:string,raw_ref_type:string,related_pmid:string,related_doi:string>>"


def integrity(spark, relations, types):
    df = spark.createDataFrame([([(r, r.title(), p, None) for r, p in relations], types)], f"integrity_relations {RELATION}, publication_types array<string>")
    return with_integrity(df).first().integrity


@pytest.mark.parametrize(
    "relations, types, status, role, eligible, review",
    [
        ([], ["Journal Article"], "no_signal", "primary_article", True, False),
        ([("retraction_in", "1")], [], "retracted", "primary_article", False, False),
        ([("retraction_of", "1")], ["Retraction of Publication"], "retracted", "retraction_notice", False, False),
        ([("erratum_in", "1")], [], "corrected_or_updated", "primary_article", True, False),
        ([("erratum_for", "1")], ["Published  Erratum"], "corrected_or_updated", "correction_notice", False, False),
        ([("expression_of_concern_in", "1")], [], "expression_of_concern", "primary_article", False, True),
        ([("comment_in", "1"), ("cites", "")], [], "no_signal", "primary_article", True, False),
        ([("something_new", "1")], [], "unknown", "unknown", False, True),
        ([("erratum_in", ""), ("retraction_in", "2")], [], "retracted", "primary_article", False, True),
    ],
)
def test_integrity(spark, relations, types, status, role, eligible, review):
    got = integrity(spark, relations, types)
    assert (got.status, got.record_role, got.report_eligible, got.needs_review) == (status, role, eligible, review)


def test_integrity_conflicts(spark):
    got = integrity(spark, [("retraction_of", "1"), ("erratum_for", "2")], [])
    assert got.record_role == "unknown" and "CONFLICTING_RECORD_ROLES" in got.reason_codes and "CONFLICTING_STRUCTURED_SIGNALS" in got.reason_codes


DESIGN = "title string, abstract string, publication_types array<string>, abstract_sections array<struct<label:string,text:string>>, keywords array<string>"


@pytest.mark.parametrize(
    "row, family, conflict",
    [
        (("A meta-analysis of x", "", [], [], []), "systematic_review_meta_analysis", False),
        (("A randomized controlled trial", "", [], [], []), "randomized_controlled_trial", False),
        (("Effects", "A case series.", ["Review"], [], []), "narrative_review", False),
        (("x", "", ["Case Reports", "Randomized Controlled Trial"], [], []), "unknown", True),
        (("x", "", ["Systematic Review", "Meta-Analysis"], [], []), "systematic_review_meta_analysis", False),
        (("x", "", ["Clinical Trial Protocol", "Case Reports"], [], []), "protocol", False),
        (("x", "mechanisms in vitro are known", [], [], []), "unknown", False),
        (("x", "Cells were cultured in vitro", [], [], []), "in_vitro", False),
        (("x", "the study protocol was followed", [], [], []), "unknown", False),
        (("x", "", [], [], []), "unknown", False),
    ],
)
def test_design(spark, row, family, conflict):
    got = study.with_design(spark.createDataFrame([row], DESIGN)).first()
    assert (got.design_family, got.design_conflict) == (family, conflict)


def test_text_functions(spark):
    df = spark.createDataFrame([("Beta-Blocker / ACE  inhibitor's", "1,234", "a <b> & \"c\"", "Randomized double-blind trial")], "a string, b string, c string, d string")
    f = study.flags(F.col("d"))
    r = df.select(X.relevance_form(F.col("a")).alias("a"), X.thousands(F.col("b")).alias("b"), X.html_escape(F.col("c")).alias("c"), f.alias("f"), X.intents(F.lit("Safety and efficacy")).alias("i"), X.has_phrase(F.lit("one two three"), F.lit("two")).alias("p"), X.has_phrase(F.lit("one twofold"), F.lit("two")).alias("q"), X.slug(F.lit("x y " * 60)).alias("s")).first()
    assert (r.a, r.b, r.c) == ("beta blocker ace inhibitor s", 1234, "a &lt;b&gt; &amp; &quot;c&quot;")
    assert (r.f.randomized, r.f.blinded, r.f.prospective) == ("true", "true", "unknown")
    assert r.i == ["safety", "efficacy"] and r.p and not r.q and len(r.s) == 120


def test_evidence_level(spark):
    rows = [(["Review", "Randomized Controlled Trial"],), (["Practice Guideline", "Review"],), ([],), (["Letter"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "types array<string>").select(X.evidence_level(F.col("types"))).collect()]
    assert got == ["randomized_trial", "guideline", "other", "narrative_review"]


def test_rank_does_not_depend_on_input_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 3), rng.random()) for i in range(200)] + [(200, None, 0.5)]
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], str(r[0]))), 1)}
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "id long, a int, b double").repartition(5)
        got = ranking.total_rank(df, [F.col("a")], [F.col("b"), F.col("id").cast("string")])
        assert {r.id: r["rank"] for r in got.collect()} == want


def test_evidence_keys_order(spark):
    cols = "pmid string, relevance_class string, query_intents array<string>, article_intents array<string>, evidence_tier string, design_family string, limitation_codes array<string>, sample_size int, sample_size_status string, relevance_score int, section string, overall_score int, publication_date date"
    base = ("1", "direct", ["safety"], ["safety"], "higher_strength", "randomized_controlled_trial", [], 100, "reported", 50, "key_evidence", 90, datetime.date(2020, 1, 1))
    change = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(cols.split(", "), base, strict=True))
    rows = [change(pmid="b", relevance_class="contextual"), change(pmid="10"), change(pmid="9"), change(pmid="c", sample_size=20_000), change(pmid="d", sample_size=30_000, publication_date=None), change(pmid="e", article_intents=["unknown"])]
    got = [r.pmid for r in spark.createDataFrame(rows, cols).orderBy(*ranking.evidence_keys()).collect()]
    assert got == ["c", "d", "10", "9", "e", "b"]


def test_first_wins_keeps_empty_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), ("", 4), (None, 5)], "k string, at int")
    assert sorted(r["at"] for r in records.first_wins(df, ["k"], F.col("at")).collect()) == [1, 3, 4, 5]


def test_diff_rejects_repeated_keys(spark):
    df = spark.createDataFrame([(" 1", "a"), ("1 ", "b"), ("", "c")], "pmid string, x string")
    with pytest.raises(diff.ComparisonError) as e:
        diff.index(df, "pmid")
    assert e.value.code == "duplicate_key"
    same = diff.field_changes(df.limit(1), df.limit(1), "pmid", {"x": "study"})
    assert same.count() == 0


def test_xml(spark):
    xml = """<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>Plain <i>it</i> tail</ArticleTitle>
    <Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year><Month>Feb</Month></PubDate></JournalIssue></Journal>
    <Abstract><AbstractText Label="METHODS"> a </AbstractText><AbstractText> </AbstractText><AbstractText>b</AbstractText></Abstract>
    <AuthorList><Author><LastName>Li</LastName><Initials>A</Initials></Author><Author><CollectiveName>G</CollectiveName></Author><Author/></AuthorList>
    <PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article>
    <CommentsCorrectionsList><CommentsCorrections RefType="ErratumIn"><RefSource>r</RefSource><PMID>8</PMID></CommentsCorrections><CommentsCorrections RefType="New"/></CommentsCorrectionsList>
    </MedlineCitation></PubmedArticle></S>"""
    r = parse_articles(spark.createDataFrame([(xml,)], "value string")).first()
    assert (r.pmid, r.title, r.abstract, r.authors) == ("7", "Plain", "a b", ["Li A", "G"])
    assert r.publication_date == datetime.date(2020, 2, 1) and [s.label for s in r.abstract_sections] == ["METHODS"]
    assert [x.normalized_relation for x in r.integrity_relations] == ["erratum_in", "unknown"]
    assert [month(m) for m in ("March", "sep", "12", "13", "", None)] == [3, 9, 12, None, None, None]


def test_regulatory(spark):
    good = '{"application_number":"N1","sponsor_name":"","products":[{"product_number":"2","marketing_status":"Prescription","active_ingredients":[{"name":"b"},{"name":"a"}]},{"product_number":"1","marketing_status":"Odd"}],"submissions":[{"submission_type":"S","submission_number":"1","submission_status":"AP","submission_status_date":"20240230"}]}'
    bad = '{"products":[{"product_number":"1"},{"product_number":"1"}]}'
    a, b = regulatory.normalize_applications(spark.createDataFrame([(good,), (bad,)], "value string")).collect()
    assert [p.product_number for p in a.products] == ["1", "2"] and [i.name for i in a.products[1].active_ingredients] == ["a", "b"]
    assert a.review_reasons == ["missing_sponsor", "unknown_marketing_status"] and a.submissions[0].submission_status_date is None and a.violations == []
    assert b.violations == ["missing_application_number", "duplicate_product"]
    import json

    assert a.record_digest == regulatory.canonical_digest(json.loads(good))


@pytest.mark.parametrize("raw, code", [(b'{"a":1,"a":2}', "duplicate_json_key"), (b"[NaN]", "non_finite_number"), (b"{", "malformed_json"), (b"[" * 101 + b"]" * 101, "json_too_large")])
def test_strict_json(raw, code):
    with pytest.raises(regulatory.RegulatoryError) as e:
        regulatory.strict_json(raw)
    assert e.value.code == code


def test_zip():
    def packed(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members.items():
                z.writestr(name.replace("_", "."), data)
        return out.getvalue()

    assert regulatory.unzip_json(packed(a_json="[1]")) == b"[1]"
    for bad in (packed(a_json="1", b_json="2"), packed(a_txt="1"), packed(a_json="0" * 10**6), b"no"):
        with pytest.raises(regulatory.RegulatoryError):
            regulatory.unzip_json(bad)


def test_rules_are_complete():
    assert set(rules.EVIDENCE_SCORE) == set(rules.EVIDENCE_BONUS) == set(rules.EVIDENCE_ORDINAL)
    assert {f for f, _ in rules.DESIGN_TEXT} <= set(rules.DESIGN_ORDER)


def test_study(spark):
    from sievelake.operators.extraction import with_extraction

    parts = [("METHODS", "A retrospective cohort of 20 patients at a single center; 20 patients were included."), ("RESULTS", "All improved.")]
    rows = [("Title", "", [], parts, []), ("Title", "", [], [], []), ("Rats", "Rats in vitro; cells were cultured.", [], [], [])]
    a, b, c = [r.study for r in study.with_study(with_extraction(spark.createDataFrame(rows, DESIGN))).collect()]
    assert (a.design_family, a.population_scope, a.result_status, a.evidence_tier, a.sample_size) == ("retrospective_cohort", "human", "reported", "moderate_strength", 20)
    assert a.limitation_codes == ["comparator_not_reported", "follow_up_not_reported", "nonrandomized", "retrospective_design", "single_center"] and a.confidence == "high"
    assert b.limitation_codes[0] == "abstract_missing" and b.evidence_tier == "not_assessable" and b.confidence == "low" and b.needs_review
    assert c.evidence_tier == "preclinical"


def test_older_groups_keep_their_sections_and_rank_components_sort_as_ranks(spark):
    from pyspark.sql import functions as F

    from sievelake.operators import ranking

    schema = """topic_id string, pmid string, relevance_class string, query_intents array<string>, article_intents array<string>, content_role string, relevance_score int, evidence_tier string, design_family string,
    limitation_codes array<string>, sample_size int, sample_size_status string, population_scope string, comparator_status string, section string, overall_score int, publication_date date"""
    row = lambda topic, pmid, kind, section="important_updates", n=100: (topic, pmid, kind, ["safety"], ["safety"] if int(pmid) % 2 else [], "clinical_evidence", int(pmid), "higher_strength", "randomized_controlled_trial", [], n, "reported", "human", "reported", section, 50, None)
    rows = spark.createDataFrame([row("new", str(i), "direct") for i in range(4)] + [row("new", "4", None)] + [row("old", str(i), None, "key_evidence") for i in range(4)], schema)
    got = {(r.topic_id, r.pmid): (r.section, r.display) for r in ranking.effective_placement(rows, ["topic_id"], [F.col("pmid")], 2).collect()}
    assert [got["new", str(i)] for i in range(5)] == [("key_evidence", "full")] * 2 + [("additional_selected_evidence", "collapsed")] * 2 + [("audit_only", "full")]
    assert all(got["old", str(i)] == ("key_evidence", "full") for i in range(4))
    ranked = ranking.evidence_rank(rows.filter("relevance_class is not null"), ["topic_id"]).withColumn("why", ranking.ranking_audit())
    by_struct = [r.pmid for r in ranked.orderBy("topic_id", "why").collect()]
    assert by_struct == [r.pmid for r in ranked.orderBy("topic_id", "rank").collect()] and ranked.select("why.*").columns == list(ranking.COMPONENTS)
