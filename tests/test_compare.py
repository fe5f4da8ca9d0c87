import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelake.operators import compare as C
from sievelake.operators.guards import adds_up, counted, no_orphans, require, unique
from sievelake.operators.trees import leaf_table
from sievelake.plans.stage import Stage


def text(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def leaves(value, path=""):
    """Plain recursion over the rules in the docstring of ``trees``."""
    if isinstance(value, dict):
        inner = {k: v for k, v in value.items() if k not in ("pmid", "assessed_at", "fetched_at")}
        return [x for k, v in inner.items() for x in leaves(v, f"{path}.{k}" if path else k)] or [(path, "{}")]
    if isinstance(value, list) and any(isinstance(x, list) for x in value) or isinstance(value, list) and len({isinstance(x, dict) for x in value}) > 1:
        return [y for i, x in enumerate(value) for y in leaves(x, f"{path}[{i}]")]
    if isinstance(value, list):
        each = sorted(text(x) for x in value)
        return [(path, text(each) if value and isinstance(value[0], dict) else "[" + ",".join(each) + "]")]
    return [(path, text(value))]


TREES = [
    {"a": {"b": {"c": [{"y": 2, "x": [1, [2]]}, {"x": 1}]}}, "pmid": 3, "n": None, "t": True},
    [1, [2, {"k": []}], {"z": {}}], [3, 1, "b", None, "a"], "plain", 7, None, {}, {"fetched_at": 1}, {"e": [], "o": {"assessed_at": 2}},
    {"deep": [[[{"x": [0, {"y": ["é\"\\\n", "é"]}]}]]], "mixed": [{"a": 1}, 2, {"a": 1}]},
]


def variants(spark, rows, name="doc"):
    return spark.createDataFrame([(k, None if v is Ellipsis else json.dumps(v)) for k, v in rows], "key string, text string").select("key", F.parse_json("text").alias(name))


def test_leaves_against_recursion(spark):
    rows = [(str(i), x) for i, x in enumerate([*TREES, *TREES, ...])]
    got = Counter(tuple(r) for r in leaf_table(variants(spark, rows), ["key"], "doc").collect())
    assert got == Counter((k, p, v) for k, x in rows if x is not ... for p, v in leaves(x))


def test_leaves_keep_clashing_names_and_empty_tables(spark):
    docs = variants(spark, [("1", {"a": [[1]]})]).withColumns({"path": F.lit("mine"), "pos": F.lit(9), "leaf": F.lit("own"), "node": F.lit(0)})
    got = leaf_table(docs, ["key", "path", "pos", "leaf", "node"], "doc", path="at", leaf="is").collect()
    assert [tuple(r) for r in got] == [("1", "mine", 9, "own", 0, "a[0]", "[1]")]
    assert leaf_table(docs.filter("false"), ["key"], "doc").count() == 0


def test_levels_are_opened_in_few_passes_and_skipped_names_may_be_any(spark):
    deep = {"x": 1}
    for i in range(11):
        deep = {"a": deep, "l": [[i], {"pmid": 1}]} if i % 2 else [[deep], {}, i]
    stage = Stage(spark, "test")
    got = Counter(tuple(r) for r in leaf_table(variants(spark, [("1", deep), ("2", TREES[0])]), ["key"], "doc", stage=stage).collect())
    assert got == Counter((k, p, v) for k, x in (("1", deep), ("2", TREES[0])) for p, v in leaves(x))
    assert stage.n <= 5  # of 17 levels; one table a level before
    odd = {"a`b": 1, "c'd": {"e\"f.g": 2}, "h": {"e\"f.g": 1, "i": {}}, "": [{"a`b": 1}]}
    got = leaf_table(variants(spark, [("1", odd)]), ["key"], "doc", skip=["a`b", "e\"f.g", "a`b"]).collect()
    assert sorted((r.path, r.value) for r in got) == [("", '[' + text('{"a`b":1}') + "]"), ("c'd", "{}"), ("h.i", "{}")]
    got = leaf_table(variants(spark, [("1", {"pmid": {}, "x": {"pmid": 1}})]), ["key"], "doc", skip=[]).collect()
    assert sorted((r.path, r.value) for r in got) == [("pmid", "{}"), ("x.pmid", "1")]


def article(**more):
    base = {
        "title": "T", "clinical_relevance": {"relevance_class": "direct", "decision": "include", "relevance_score": 5, "needs_review": False},
        "assessment": {"study_assessment": {"design_family": "trial", "design_subtype": "rct", "result_status": "final", "evidence_tier": 1, "needs_review": False}},
        "publication_integrity": {"status": "ok", "record_role": "article", "final_decision": "keep", "report_eligible": True, "needs_review": False},
        "structured_clinical_extraction": {"x": "unclear", "l": [2, 1], "o": [{"b": 1}, {"a": 2}], "provenance": {"page": 1}, "needs_review": False},
        "final_evidence_rank": 3, "report_placement": {"section": "signals", "visible": True, "display_mode": "full"},
    }
    for path, value in more.items():
        at, names = base, path.split("__")
        for n in names[:-1]:
            at = at[n]
        if value is ...:
            del at[names[-1]]
        else:
            at[names[-1]] = value
    return base


CASES = {
    "same": (article(), article(structured_clinical_extraction__l=[1, 2], structured_clinical_extraction__o=[{"a": 2}, {"b": 1}]), []),
    "relevance": (article(), article(clinical_relevance__relevance_score=6), [("relevance", "relevance_changed", "", '{"relevance_score":5}', '{"relevance_score":6}')]),
    "design": (article(), article(assessment__study_assessment__design_subtype="cohort"), [("study", "study_design_changed", "", '{"design_subtype":"rct"}', '{"design_subtype":"cohort"}')]),
    "result": (article(), article(assessment__study_assessment__evidence_tier=...), [("study", "study_result_changed", "", '{"evidence_tier":1}', '{"evidence_tier":null}')]),
    "integrity": (article(), article(publication_integrity__status="retracted", publication_integrity__report_eligible=False), [("integrity", "integrity_changed", "", '{"report_eligible":true,"status":"ok"}', '{"report_eligible":false,"status":"retracted"}')]),
    "review": (article(), article(clinical_relevance__needs_review=True), [("review", "review_required_changed", "", "false", "true")]),
    "key": (article(), article(report_placement__section="key_evidence"), [("placement", "became_key_evidence", "", '{"section":"signals"}', '{"section":"key_evidence"}')]),
    "placement": (article(), article(report_placement__visible=False), [("placement", "placement_changed", "", '{"visible":true}', '{"visible":false}')]),
    "rank": (article(), article(final_evidence_rank=4), [("ranking", "rank_changed", "", "3", "4")]),
    "rank_gone": (article(), article(final_evidence_rank=None), [("comparability", "block_became_not_comparable", "final_evidence_rank", "3", "null")]),
    "leaf": (article(), article(structured_clinical_extraction__x="now"), [("extraction", "extraction_abstention_to_accepted", "x", '"unclear"', '"now"')]),
    "page": (article(), article(structured_clinical_extraction__provenance__page=2), [("extraction", "extraction_provenance_only", "provenance.page", "1", "2")]),
    "leaves": (article(structured_clinical_extraction__g=1), article(structured_clinical_extraction__x=..., structured_clinical_extraction__l=[], structured_clinical_extraction__g=0),
               [("extraction", "extraction_removed", "x", '"unclear"', "null"), ("extraction", "extraction_accepted_to_abstention", "l", "[1,2]", "[]"), ("extraction", "extraction_changed", "g", "1", "0")]),
    "parent": (article(assessment=None), article(), [("comparability", "block_became_comparable", "assessment", "null", text(article()["assessment"])), ("review", "review_required_changed", "", "false", "false")]),
    "kind": (article(report_placement=...), article(report_placement="x"), [("comparability", "block_state_changed", "report_placement", "null", '"x"')]),
    "gone": (article(), None, [("membership", "removed", "", '"T"', "null")]),
    "new": (None, article(title=...), [("membership", "added", "", "null", '""')]),
}


def sides(spark):
    return [variants(spark, [(k, c[i]) for k, c in CASES.items() if c[i] is not None]) for i in (0, 1)]


def test_every_kind_of_change(spark):
    got = C.compare_articles(*sides(spark)).collect()
    want = Counter((k, *x) for k, (_, _, found) in CASES.items() for x in found)
    assert Counter((r.key, r.category, r.change_type, r.field_path, r.baseline, r.target) for r in got) == want
    by_key = {(r.key, r.category): r for r in got}
    seed = {"category": "ranking", "change_type": "rank_changed", "pmid": "rank", "field_path": "", "baseline": {"present": True, "value": 3}, "target": {"present": True, "value": 4}}
    import hashlib

    rank = by_key["rank", "ranking"]
    assert rank.change_id == hashlib.sha256(text(seed).encode()).hexdigest()[:16] and rank.priority == 7 and json.loads(rank.detail) == {"candidate_set_changed": True}
    assert not by_key["new", "membership"].in_baseline and not by_key["kind", "comparability"].in_baseline
    assert by_key["page", "extraction"].priority == 7 and by_key["leaf", "extraction"].priority == 5
    assert json.loads(by_key["review", "review"].detail)["sources"]["relevance"] == [False, True]
    assert all(json.loads(r.detail) is not None and json.loads(r.baseline) is not ... for r in got)


def snapshot(spark, tmp_path, name, articles, **more):
    from sievelake.operators.snapshots import load_snapshot

    (tmp_path / name).write_text(json.dumps({"topic": "t", "query": "q", "schema_version": "b5", "articles": articles} | more))
    return load_snapshot(spark, f"file://{tmp_path}/{name}")


def test_snapshots_as_wholes(spark, tmp_path):
    a = [article() | {"pmid": f" {i}"} for i in range(3)] + [{"title": "no id"}] * 2
    base = snapshot(spark, tmp_path, "a", a)
    other = snapshot(spark, tmp_path, "b", a[::-1][:2] + [article(structured_clinical_extraction__l=[1, 2]) | {"pmid": f"{i} "} for i in (2, 0, 1)])
    changed = snapshot(spark, tmp_path, "c", a[:2] + [article(final_evidence_rank=9) | {"pmid": "2"}], query="other")
    found, ids = C.comparison_of(base, other)
    assert found.count() == 0 and ids.first().identical_content
    found, ids = C.comparison_of(base, changed)
    assert sorted((r.category, r.key) for r in found.orderBy(*C.change_order()).collect()) == [("comparability", ""), ("ranking", "2")] and not ids.first().identical_content
    found, _ = C.comparison_of(base, snapshot(spark, tmp_path, "d", a, topic=" "))
    assert [(r.change_type, r.in_target, r.target) for r in found.collect()] == [("scope_unverifiable", True, '" "')]
    assert sorted(r.occurrence for r in C.unmatched(C.articles_of(base), "baseline").collect()) == [1, 2]


def failing(df, code):
    with pytest.raises(Exception, match=code):
        df.collect()


def test_comparison_fails_closed(spark, tmp_path):
    twice = C.articles_of(snapshot(spark, tmp_path, "e", [{"pmid": "1"}, {"pmid": "1 "}]))
    with pytest.raises(Exception, match="guard failed: duplicate_key"):
        C.compare_articles(twice, twice)
    failing(C.articles_of(snapshot(spark, tmp_path, "f", [{"pmid": "1"}, 5])), "guard failed: malformed_snapshot 1")


def test_guards(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "c", 0)], "k int, n string, total int")
    kids = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, v int")
    assert unique(rows, ["k", "n"]).count() == 3 and no_orphans(kids, rows, ["k"]).count() == 3 and adds_up(rows, kids, ["k"], "total").count() == 3
    assert adds_up(rows.withColumn("s", F.expr("case k when 1 then 11 when 2 then 7 else 0 end")), kids, ["k"], "s", F.col("v")).columns == ["k", "n", "total", "s"]
    failing(unique(kids, ["k"]), "guard failed: duplicate_key 1")
    failing(unique(rows.select(F.lit(None).cast("int").alias("k")), ["k"]), "guard failed: missing_key")
    failing(unique(rows.selectExpr("nullif(k, 2) as k", "n"), ["k", "n"]), "guard failed: missing_key")
    failing(no_orphans(kids.selectExpr("nullif(k, 2) as k"), rows, ["k"]), "guard failed: orphan")
    failing(no_orphans(kids.union(kids.selectExpr("k + 9", "v")), rows, ["k"]), "guard failed: orphan 1[01]")
    failing(adds_up(rows.withColumn("total", F.lit(1)), kids, ["k"], "total"), "guard failed: wrong_sum")
    failing(require(rows, F.col("k") < 3, "too_many", F.col("k")), "guard failed: too_many 3")
    assert counted(rows, spark.range(1).selectExpr("3")).count() == 3
    failing(counted(rows, spark.range(1).selectExpr("4")), "guard failed: wrong_count 3 4")
    failing(counted(rows.filter("false"), spark.range(1).selectExpr("1")), "guard failed: wrong_count 0 1")


def test_guards_run_nothing_at_plan_time_and_are_not_dropped(spark):
    kids = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    bad = unique(kids, ["k"])  # no error yet
    failing(bad.select(F.lit(1).alias("one")), "duplicate_key")
    with pytest.raises(Exception, match="duplicate_key"):
        bad.count()
