"""Rows are dealt evenly before costly work, and what is shuffled again is small: both are seen in plans, at any size."""

from pyspark.sql import functions as F

from sievelake.operators import reconcile as R
from sievelake.plans import nested

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_children_leave_before_the_windows(spark):
    rows = R.with_reading(R.paired(nested._lines_with_sources(spark, DATA), ["k"], nested._LINE), nested._LINE)
    assert not {"child", "original"} & set(rows.columns)
    assert not [f.name for f in rows.schema if f.dataType.typeName() == "variant"]
    found = R.reconcile(nested._lines_with_sources(spark, DATA), ["k"], nested._LINE)
    assert sum("Window" in line for line in plan(found).splitlines()) >= 2


def test_children_meet_where_their_records_are(spark):
    from sievelake.plans import registry

    found = registry.queries()["reconciled_children"](spark, DATA)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    rows = R.own_faults(R.sides(nested._lines_with_sources(spark, DATA), ["k"], nested._LINE, doc="doc", raw="raw", place="place"), ["k"], nested._LINE)
    assert "variant" not in rows.schema.simpleString() and rows.filter("name is null").select(F.max(F.length(F.to_json("has")))).first()[0] < 80


def test_long_raw_values_meet_by_digest(spark):
    import json

    c, long = R.Container("parts", ("name",), "name"), "x" * 500
    doc = lambda raw: json.dumps({"parts": [{"name": raw, "source_fields": {"name": {"state": "present", "path": "r.parts[0].name", "raw_value": raw}}}]})
    cases = [(0, doc(long), long), (1, doc(long), long + "y"), (2, doc("#"), "#"), (3, doc("a"), "b")]
    records = spark.createDataFrame([(k, d, json.dumps({"parts": [{"name": raw}]})) for k, d, raw in cases], "k int, d string, r string").select("k", F.parse_json("d").alias("doc"), F.parse_json("r").alias("raw"), F.lit("r").alias("place"))
    assert sorted((r.k, r.code) for r in R.reconcile(records, ["k"], c).collect()) == [(1, "raw_differs"), (3, "raw_differs")]


def test_orders_are_spread_before_documents_are_made(spark):
    assert "Repartition" in plan(nested._orders_as_articles(spark, DATA, False)) and "Repartition" in plan(nested._orders_as_articles(spark, DATA, True))


def test_documents_are_neither_sorted_nor_read_member_by_member(spark):
    from sievelake.operators.compare import Side

    turned = plan(nested._orders_as_articles(spark, DATA, False, turned=True)).lower().replace("_", "").splitlines()
    assert next(i for i, x in enumerate(turned) if "parsejson" in x) < next(i for i, x in enumerate(turned) if "sort" in x)
    told = plan(nested._orders_as_articles(spark, DATA, False).select(Side.reading(F.col("doc")).alias("r")))
    assert "$.publication_integrity" not in told and "to_json(variant_get(doc" not in told


def test_spans_from_texts_are_those_of_the_token_table(spark):
    from sievelake.operators import spans as S

    docs = spark.createDataFrame([(1, "Ab, ß-cd  12é3\nx"), (2, None), (3, "")], "doc_id long, text string")
    places = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 2, 3), (1, "c", 4, 1), (1, "d", 4, 2), (2, "e", 0, 1)], "doc_id long, name string, first int, n int")
    tokens = S.token_table(docs, ["doc_id"], "text")
    want = sorted(tuple(r) for r in S.word_spans(places, tokens, ["doc_id"], words=F.col("n")).select("name", "start", "stop").collect())
    got = S.spans_in_texts(places, docs, ["doc_id"], "text", words=F.col("n"))
    assert sorted(tuple(r) for r in got.select("name", "start", "stop").collect()) == want and [w[0] for w in want] == ["a", "b", "c"]
    spans = got.select("doc_id", "name", "start", "stop")
    spans = spans.union(spans.selectExpr("doc_id", "name || '+'", "start + 1", "stop + 1"))
    known = {(r.start, None) for r in tokens.collect()} | {(None, r.stop) for r in tokens.collect()}
    asked = {(r.start, None) for r in spans.collect()} | {(None, r.stop) for r in spans.collect()}
    assert {(r.start, r.stop) for r in S.edges_at(spans, docs, ["doc_id"], "text").collect()} == known & asked


def test_a_line_is_not_copied_to_its_buckets(spark):
    from sievelake.operators import spans as S

    docs = spark.createDataFrame([(1, "ab " * 5)], "doc_id long, text string")
    spans = docs.selectExpr("doc_id", "'n' as name", "0 as start", "2 as stop", "'ab' as span")
    found = S.span_faults(spans, S.line_table(docs, ["doc_id"], "text"), S.edges_at(spans, docs, ["doc_id"], "text"), ["doc_id"], ["name"])
    told = plan(found).splitlines()
    spread = next(x for x in told if "Generate explode(sequence" in x)
    assert "line" not in spread and found.count() == 0


def test_texts_of_spans_are_exchanged_once(spark):
    from sievelake.plans import registry

    for name in ("span_invariants", "phrase_spans"):
        told = plan(registry.queries()[name](spark, DATA))
        assert sum("Relation [doc_id" in line for line in told.splitlines()) == 1 and "Window" not in told


def test_faults_in_a_text_are_those_of_sections_and_tokens(spark):
    from sievelake.operators import spans as S

    texts = {1: "Ab, c1\nd \u00c9 ef--g\n\n h", 2: "x", 3: "\n\nlo\U0001f600ng fin\n", 4: "a\nb"}
    docs = spark.createDataFrame(list(texts.items()), "k int, pos string")
    rows = [(k, i, a, b, w) for k, t in texts.items() for i, (a, b, w) in enumerate((a, b, w) for a in range(-1, len(t) + 2) for b in range(a - 2, min(a + 6, len(t) + 3)) for w in {t[max(a, 0) : max(b, 0)], "zz"})]
    spans = spark.createDataFrame(rows, "k int, n int, start int, stop int, span string").filter("start >= 0 and stop >= 0")
    want = S.span_faults(spans, S.line_table(docs, ["k"], "pos"), S.token_table(docs, ["k"], "pos"), ["k"], ["n"])
    got = spans.join(docs, "k").select("k", "n", F.explode(S.faults_in_text(F.col("pos"), F.struct("start", "stop", "span"))).alias("code"))
    assert sorted(map(tuple, got.collect())) == sorted(set(map(tuple, want.collect())))


def test_copies_of_a_text_count_for_themselves(spark):
    from sievelake.operators.phrases import phrase_matches

    docs = spark.createDataFrame([(1, "a b a b c")] * 2 + [(1, "b c"), (2, None), (2, "")], "k int, text string")
    phrases = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "b a b c"), (4, "c a"), (5, None)], "n int, label string")
    got = sorted(tuple(r) for r in phrase_matches(docs, ["k"], "text", phrases, ["n"], "label").select("n", "first", "times").collect())
    assert got == sorted([(1, 0, 2), (2, 4, 1), (3, 1, 1)] * 2 + [(2, 1, 1)])


def test_articles_are_dealt_by_id_before_terms(spark):
    from sievelake.plans import registry

    found = plan(registry.queries()["article_topic_profile"](spark, DATA))
    assert "RepartitionByExpression [pmid" in found


def test_batches_of_texts_are_bounded(spark):
    from sievelake.plans import registry

    registry.queries()["text_normalize_whole"](spark, DATA)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") == str(4 << 20)
