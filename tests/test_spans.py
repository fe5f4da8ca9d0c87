import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sievelake.operators.spans import first_match, line_table, placement_faults, points_within, span_faults, token_table, word_spans, words_form

TEXTS = {1: "Ab, c1\nd É ef--g\n\n h", 2: "", 3: None, 4: "...", 5: "x", 6: "\n\nlong " * 300 + "end\U0001f600 fin"}


def frames(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "k int, pos string").withColumn("end", F.lit(1))
    return docs, token_table(docs, ["k"], "pos"), line_table(docs, ["k"], "pos")


def test_tokens_and_lines_have_their_places(spark):
    docs, tokens, lines = frames(spark)
    want = [(k, i, m.start(), m.end(), m[0]) for k, t in TEXTS.items() for i, m in enumerate(re.finditer("[A-Za-z0-9]+", t or ""))]
    assert sorted(tuple(r) for r in tokens.collect()) == want
    got = sorted(tuple(r) for r in lines.collect())
    assert all(TEXTS[k][a:b] == text for k, _, a, b, text in got)
    assert {k: "".join(x[4] for x in got if x[0] == k) for k in TEXTS} == {k: t or "" for k, t in TEXTS.items()}
    assert docs.filter("k = 1").select(words_form(F.col("pos"))).first()[0] == "ab c1 d ef g h"


def test_points_within_against_all_pairs(spark):
    rng = random.Random(2)
    points = [(rng.randint(0, 3), rng.randint(0, 900), i) for i in range(400)]
    intervals = [(rng.randint(0, 3), a := rng.randint(0, 900), a + rng.choice([0, 1, 5, 300, 700]), j) for j in range(120)]
    p, q = spark.createDataFrame(points, "k int, at int, i int"), spark.createDataFrame(intervals, "k int, start int, stop int, j int")
    want = Counter((k, i, j) for k, at, i in points for m, a, b, j in intervals if k == m and a <= at < b)
    for width in (7, 256):
        got = points_within(p, q, ["k"], at="at", width=width)
        assert Counter((r.k, r.i, r.j) for r in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_faults(spark):
    docs, tokens, lines = frames(spark)
    spans = [
        (1, 1, 0, 2, "Ab"), (1, 2, 4, 6, "c1"), (1, 3, 1, 3, "b,"), (1, 4, 4, 8, "c1\nd"), (1, 5, 0, 2, "Ac"), (1, 6, 5, 5, ""), (1, 7, 99, 101, "zz"), (6, 8, 2, 6, "long"), (2, 9, 0, 1, "x"),
    ]
    got = span_faults(spark.createDataFrame(spans, "k int, n int, start int, stop int, span string"), lines, tokens, ["k"], ["n"]).collect()
    want = {(3, "off_token"), (4, "outside"), (5, "text_differs"), (6, "empty"), (6, "off_token"), (7, "outside"), (7, "off_token"), (9, "outside"), (9, "off_token")}
    assert {(r.n, r.code) for r in got} == want


def test_word_spans_and_first_match(spark):
    docs, tokens, _ = frames(spark)
    places = spark.createDataFrame([(1, 1, 3), (1, 0, 6), (6, 300, 2)], "k int, first int, words int")
    got = {(r.k, r["first"]): (r.start, r.stop) for r in word_spans(places, tokens, ["k"], words=F.col("words")).collect()}
    assert TEXTS[1][slice(*got[1, 1])] == "c1\nd É ef" and TEXTS[1][slice(*got[1, 0])] == TEXTS[1] and TEXTS[6][slice(*got[6, 300])] == "end\U0001f600 fin"
    row = spark.createDataFrame([("É randomised, then a randomized trial",), ("none",), (None,)], "t string").select(first_match(F.col("t"), r"(?i)randomi[sz]ed(?=.{0,9}trial)").alias("m")).collect()
    assert row[0].m.span == "randomized" and row[0].m.start == 21 and row[0].m.stop == 31 and row[1].m is None and row[2].m is None


def test_placement_faults(spark):
    ranked = [("a", "1", 1, "direct", "x", "reported"), ("a", "2", 2, "irrelevant", "protocol", "reported"), ("a", "3", 3, "irrelevant", "x", "reported"), ("b", "1", 1, "direct", "x", "y"), ("b", "2", 3, "direct", "x", "y")]
    placed = [("a", "1"), ("a", "1"), ("b", "1"), ("b", "9")]
    r, p = spark.createDataFrame(ranked, "t string, pmid string, rank int, relevance_class string, design_family string, result_status string"), spark.createDataFrame(placed, "t string, pmid string")
    got = {x.t: x.asDict() for x in placement_faults(r, p, ["t"], "pmid", 2).collect()}
    assert got["a"] == {"t": "a", "selected_disappearance": 1, "duplicate_placement": 1, "irrelevant_in_key_evidence": 1, "protocol_as_results": 1, "ranking_reconstruction_failure": 0}
    assert got["b"]["selected_disappearance"] == 1 and got["b"]["ranking_reconstruction_failure"] == 1
