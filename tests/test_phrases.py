import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelake.functions.numbers import round_half_even
from sievelake.operators.phrases import phrase_matches, signal_rows, signal_scores


def brute(texts, phrases, unit):
    out = Counter()
    for k, t in texts:
        u = (t.split(" ") if unit == "word" else list(t)) if t else []
        for p, words in phrases:
            w = (words.split(" ") if unit == "word" else list(words)) if words else []
            at = [i for i in range(len(u) - len(w) + 1) if w and u[i : i + len(w)] == w]
            if at:
                out[k, p, words, at[0], len(at)] += 1
    return out


@pytest.mark.parametrize("unit", ["word", "char"])
@pytest.mark.parametrize("gram", [1, 2, 3])
def test_against_all_positions(spark, unit, gram):
    rng = random.Random(gram)
    texts = [(i % 90, " ".join(rng.choices("a b c d ab bc x".split(), weights=[30, 9, 5, 2, 2, 1, 1], k=rng.randint(0, 25)))) for i in range(120)] + [(500, None), (501, "")]
    phrases = [(i, " ".join(rng.choices("a b c d ab q".split(), k=rng.randint(1, 4)))) for i in range(80)] + [(900, ""), (901, None), (902, "zz top")]
    left = spark.createDataFrame(texts, "k int, phrase string").withColumn("row", F.lit("mine")).repartition(3)
    right = spark.createDataFrame(phrases, "gram int, t string").repartition(2)
    got = phrase_matches(left, ["k"], "phrase", right, ["gram"], "t", unit=unit, gram=gram)
    assert Counter(tuple(r) for r in got.collect()) == brute(texts, phrases, unit)


def test_empty_sides(spark):
    texts, phrases = spark.createDataFrame([(1, "a b")], "k int, t string"), spark.createDataFrame([], "p int, q string")
    assert phrase_matches(texts, ["k"], "t", phrases, ["p"], "q").count() == 0
    assert phrase_matches(texts.filter("k > 1"), ["k"], "t", spark.createDataFrame([(1, "a")], "p int, q string"), ["p"], "q").count() == 0


def test_a_hundred_thousand_labels(spark):
    labels = spark.range(100_000).select(F.col("id").alias("p"), F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), (F.col("id") % 500).cast("string")), F.concat(F.lit("v"), F.floor(F.col("id") / 500).cast("string"))).alias("q"))
    texts = spark.range(2_000).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("of the"), F.concat(F.lit("w"), (F.col("id") % 700).cast("string")), F.concat(F.lit("v"), (F.col("id") % 211).cast("string")), F.lit("the the")).alias("t"))
    got = phrase_matches(texts, ["k"], "t", labels, ["p"], "q")
    assert sorted(tuple(r) for r in got.select("k", "p", "first", "times").collect()) == [(k, (k % 700) + 500 * (k % 211), 1, 1) for k in range(2000) if k % 700 < 500 and k % 211 < 200]
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_text(spark):
    text = "a " * 300_000 + "needle in it"
    got = phrase_matches(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t", spark.createDataFrame([(1, "a needle in"), (2, "needle"), (3, "it a")], "p int, q string"), ["p"], "q")
    assert sorted((r.p, r["first"], r.times) for r in got.collect()) == [(1, 299_999, 1), (2, 300_000, 1)]


def test_signals(spark):
    fields = [
        (1, "title", 0, "acyclovir in herpes", "Acyclovir in herpes", ""), (1, "mesh", 1, "other", "Other", "D1"), (1, "mesh", 2, "herpes simplex", "Herpes Simplex", "D2"),
        (1, "mesh_major", 3, "herpes", "Herpes", "D2"), (1, "abstract", 4, "herpes treated with acv", "...", ""), (2, "abstract", 0, "acv and acyclovir", "...", ""), (3, "title", 0, "rain", "Rain", ""),
    ]
    fields = spark.createDataFrame(fields, "article int, source string, ord int, text string, raw string, ui string")
    labels = spark.createDataFrame([("drug", 0, "acyclovir"), ("drug", 1, "acv"), ("condition", 0, "herpes")], "role string, ord int, label string")
    ids = spark.createDataFrame([("condition", "D1"), ("condition", "D2")], "role string, ui string")
    found = signal_rows(fields, labels, "article", ids=ids)
    got = {(r.article, r.role, r.source): (r.label, r.ui) for r in found.collect()}
    assert got == {
        (1, "drug", "title"): ("acyclovir", None), (1, "drug", "abstract"): ("acv", None), (2, "drug", "abstract"): ("acyclovir", None), (1, "condition", "title"): ("herpes", None),
        (1, "condition", "mesh"): ("Other", "D1"), (1, "condition", "mesh_major"): ("herpes", "D2"), (1, "condition", "abstract"): ("herpes", None),
    }
    scores = {(r.article, r.role): (r.score, r.signals) for r in signal_scores(found, "article").collect()}
    assert scores[1, "condition"][1] == 4 and scores[1, "condition"][0] <= 50


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(5)
    values = [62.25, 62.45, 0.05, 0.15, 0.25, 0.35, -0.25, -0.35, 2.675, 1e300, 1e15 + 0.5, 4503599627370495.5, 2.0**50 + 0.25, 2.0**51 + 0.5, 5e-324, 0.0, 1e-300, 9007199254740993.0]
    values += [rng.randrange(10**6) / 20 for _ in range(300_000)] + [rng.randrange(10**9) / 16 for _ in range(200_000)] + [rng.random() * 10 ** rng.randint(-6, 17) for _ in range(300_000)]
    values += [(rng.randrange(10**8) + 0.5) / 10 ** rng.randint(1, 3) for _ in range(200_000)]
    import pandas as pd

    for digits in (1, 2):
        df = spark.createDataFrame(pd.DataFrame({"x": values})).select("x", round_half_even(F.col("x"), digits).alias("r"), round_half_even(-F.col("x"), digits).alias("m")).toPandas()
        want = df.x.map(lambda v: round(v, digits))
        assert (df.r == want).all() and (df.m == -want).all(), df[df.r != want].head()
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(round_half_even(F.col("x")).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r and odd[2].r == float("inf") and odd[3].r == float("-inf")
