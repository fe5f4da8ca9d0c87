import pytest

from sievelake.operators import concepts, publish


def test_generation(spark, tmp_path):
    df = spark.createDataFrame([("1", None), ("2", "b")], "pmid string, x string")
    path = f"file://{tmp_path}/g"
    publish.publish(df, path, ["pmid"])
    assert publish.load_published(spark, path, "pmid string, x string", ["pmid"]).count() == 2
    with pytest.raises(Exception):
        publish.publish(df, path, ["pmid"])
    with open(next((tmp_path / "g").glob("part-*")), "a") as f:
        f.write('{"pmid":"3"}\n')
    for crc in (tmp_path / "g").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="digest_mismatch"):
        publish.load_published(spark, path, "pmid string, x string", ["pmid"])
    df.write.json(f"file://{tmp_path}/h")
    with pytest.raises(ValueError, match="incomplete_generation"):
        publish.load_published(spark, f"file://{tmp_path}/h", "pmid string, x string", ["pmid"])


def test_tables_escape():
    rows = [{"a": "<b>|x\ny", "b": None}]
    assert "&lt;b&gt;\\|x y" in publish.markdown_table(rows, ["a", "b"]) and "<td>&lt;b&gt;|x\ny</td><td></td>" in publish.html_table(rows, ["a", "b"], "<t>")


def test_concepts(spark):
    articles = spark.createDataFrame([("1", "On Beta Blockers", "", ["Heart"], ["beta  blockers"], [("Heart", "D1", True, "1"), ("None", "", False, "1")]), ("2", "x", "heart", ["Heart"], [], [("Heart!", "D1", False, "2")])], "pmid string, title string, abstract string, mesh_headings array<string>, keywords array<string>, mesh_descriptors array<struct<text:string,ui:string,major_topic:boolean,supporting_pmid:string>>")
    vocabulary = spark.createDataFrame([("Beta blockers", "7")], "label string, code string")
    terms = spark.createDataFrame([("beta  blockers", "1"), ("beta  blockers", "1"), ("zzz", "2")], "term string, pmid string")
    every = concepts.heading_mentions(articles).union(concepts.term_mentions(terms, vocabulary))
    rows = {r.original_term: r for r in concepts.merge(every).orderBy(*concepts.concept_order()).collect()}
    assert rows["Heart"].articles == 2 and rows["beta  blockers"].confidence == 0.9 and rows["beta  blockers"].articles == 1 and rows["zzz"].concept_id.startswith("unresolved:")
    edges = {(r.pmid, r.concept_id, r.source_field) for r in concepts.links(every, articles).collect()}
    assert {("1", "7", "title"), ("1", "7", "keywords"), ("1", "D1", "mesh_headings"), ("2", "D1", "abstract")} <= edges
