"""Which texts hold which phrases, both sides tables (J7-J9, F7, W6): a join on postings, no literals and no nested loop.

1. Texts and phrases (in normal form) are cut into units: words, or characters where a phrase may begin and end inside a word.
2. Units in a row, ``gram`` of them (fewer in shorter phrases), are a gram. Grams of phrases are found in the texts, kept and counted, with partial aggregates;
   a phrase with a gram that no text has goes at once.
3. A phrase is posted under the rarest of its grams, so common words make no candidates as long as a phrase has a rarer one.
   Candidates come from an equi-join of the texts' grams with the postings; both sides are exchanged, so AQE splits a hot gram.
4. A candidate says where in the text the phrase would begin. Candidates of a text meet it, and the units there are compared: the only
   time that texts are exchanged, and no copy of them is written. They meet by a hash of keys and text; if two texts share one, each only gets
   candidates more.

Defined results: empty and null texts and phrases match nothing; a phrase given twice matches under each of its keys; rows that repeat a text's
keys are texts of their own, and so give rows of their own; other columns are ignored. Texts are read twice, so they must come out the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake import rules
from sievelake.functions.text import lookup
from sievelake.operators.trees import fresh, once
from sievelake.plans.stage import Stage

SIGNAL = ["source", "label", "weight"]


def units(text: Column, unit: str) -> Column:
    if unit == "word":
        return F.split(text, " ", -1)
    if unit == "char":
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    raise ValueError(f"unit is word or char, not {unit}")


def grams(cut: Column, sizes: Sequence[int]) -> Column:
    """{pos, gram} of every run of units of the given sizes."""
    of = lambda n: F.when(F.size(cut) >= n, F.transform(F.sequence(F.lit(0), F.size(cut) - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), *[F.get(cut, i + j) for j in range(n)]).alias("gram")))).otherwise(F.expr("cast(array() as array<struct<pos:int,gram:bigint>>)"))
    return F.concat(*[of(n) for n in sizes])


def texts_with_phrases(texts: DataFrame, keys: Sequence[str], text: str, phrases: DataFrame, *, form: Callable[[Column], Column] | None = None, unit: str = "word", gram: int = 2, stage: Stage | None = None) -> DataFrame:
    """``keys``, ``text`` and found ({phrase, first, times} of each) of every text that holds some of the ``phrases`` (one column), and of some that hold none; ``form`` makes a text's normal form."""
    stage, form = stage or Stage(texts.sparkSession, "phrases"), form or (lambda t: t)
    # names of our own for everything, so that keys may be called anything
    theirs = [f"k{i}" for i in range(len(keys))]
    whole = texts.select(*[texts[n].alias(k) for n, k in zip(keys, theirs, strict=True)], texts[text].alias("t")).filter("t is not null")
    whole = whole.withColumn("row", F.xxhash64(*theirs, "t"))
    cut = units(form(F.col("t")), unit)
    each = phrases.toDF("phrase").filter("phrase <> ''").distinct().withColumn("u", units(F.col("phrase"), unit)).withColumn("n", F.least(F.size("u"), F.lit(gram)))
    each = stage.keep(each)
    sizes = sorted(r.n for r in each.select("n").distinct().collect())  # ``gram`` rows at most
    if not sizes:
        sizes = [1]

    offered = F.concat(*[F.when(F.col("n") == n, grams(F.col("u"), [n])).otherwise(F.expr("cast(array() as array<struct<pos:int,gram:bigint>>)")) for n in sizes])
    offered = stage.keep(each.select("phrase", F.size("u").alias("size"), F.inline(offered)))
    # grams that no phrase has go before anything is counted or kept, so a text's grams are made once and hardly any is exchanged
    places = stage.keep(whole.select("row", F.inline(once(cut, lambda u: grams(u, sizes)))).join(offered.select("gram").distinct(), "gram", "left_semi"))
    counts = places.groupBy("gram").agg(F.count("*").alias("times"))
    counts = stage.keep(counts)
    rated = offered.join(counts, "gram", "left").groupBy("phrase").agg(F.min(F.struct("times", "pos", "gram")).alias("best"), F.count_if(F.col("times").isNull()).alias("absent"))
    posted = stage.keep(rated.filter("absent = 0").select("phrase", F.col("best.gram").alias("gram"), F.col("best.pos").alias("off")))

    found = places.join(posted, "gram").filter("pos >= off").select("row", (F.col("pos") - F.col("off")).alias("at"), "phrase")
    # dealt by row at once, so that neither grouping nor the join with the texts exchanges candidates again; copies of a text have the same
    found = found.repartition("row").groupBy("row", "phrase").agg(F.collect_set("at").alias("ats")).groupBy("row").agg(F.collect_list(F.struct("phrase", "ats")).alias("cs"))
    there = lambda u, c: once(units(c["phrase"], unit), lambda w: F.filter(c["ats"], lambda at: F.slice(u, at + 1, F.size(w)) == w))
    told = lambda c, at: F.struct(c["phrase"].alias("phrase"), F.array_min(at).alias("first"), F.size(at).cast("long").alias("times"))
    held = once(cut, lambda u: F.transform("cs", lambda c: once(there(u, c), lambda at: told(c, at))))
    return whole.join(found, "row").select(*[F.col(k).alias(n) for k, n in zip(theirs, keys, strict=True)], F.col("t").alias(text), F.filter(held, lambda c: c["times"] > 0).alias("found"))


def phrase_matches(texts: DataFrame, keys: Sequence[str], text: str, phrases: DataFrame, phrase_keys: Sequence[str], phrase: str, *, unit: str = "word", gram: int = 2, stage: Stage | None = None) -> DataFrame:
    """``keys``, ``phrase_keys``, phrase, first (number of the unit where it first begins) and times, for each phrase that a text holds."""
    theirs, ours = [f"k{i}" for i in range(len(keys))], [f"p{i}" for i in range(len(phrase_keys))]
    stage = stage or Stage(texts.sparkSession, "phrases")
    named = texts.select(*[texts[n].alias(k) for n, k in zip(keys, theirs, strict=True)], texts[text].alias("t")).filter("t <> ''")
    known = stage.keep(phrases.select(*[phrases[n].alias(k) for n, k in zip(phrase_keys, ours, strict=True)], phrases[phrase].alias("phrase")).filter("phrase <> ''"))
    held = texts_with_phrases(named, theirs, "t", known.select("phrase"), unit=unit, gram=gram, stage=stage).select(*theirs, F.inline("found"))
    out = held.join(known, "phrase")
    return out.select(*[F.col(a).alias(n) for a, n in zip(theirs, keys, strict=True)], *[F.col(a).alias(n) for a, n in zip(ours, phrase_keys, strict=True)], "phrase", "first", "times")


def signal_rows(fields: DataFrame, labels: DataFrame, key: str, *, ids: DataFrame | None = None, stage: Stage | None = None) -> DataFrame:
    """For each article, role and kind of field the first field that holds a label of that role (or has one of its ids), with the first such label.

    ``fields`` are rows (key, source, ord, text in normal form, raw, ui), ``labels`` (role, ord, label in normal form), ``ids`` (role, ui).
    Gives key, role, source, label, ui (of a known id, else null) and weight.
    """
    fields = fields.select(key, "source", F.col("ord").alias("field_ord"), "text", "raw", "ui")
    marks = labels.select("role", F.col("ord").alias("label_ord"), "label")
    hits = phrase_matches(fields, [key, "source", "field_ord"], "text", marks, ["role", "label_ord"], "label", stage=stage)
    hits = hits.select(key, "role", "source", F.struct("field_ord", "label_ord", F.col("phrase").alias("label"), F.lit(None).cast("string").alias("ui")).alias("hit"))
    if ids is not None:
        by_id = fields.filter("ui <> ''").join(ids.select("role", "ui").distinct(), "ui")
        last = F.lit((1 << 31) - 1)  # a label names the signal before the field's own words do
        hits = hits.union(by_id.select(key, "role", "source", F.struct("field_ord", last.cast(hits.schema["hit"].dataType["label_ord"].dataType).alias("label_ord"), F.col("raw").alias("label"), "ui").alias("hit")))
    best = hits.groupBy(key, "role", "source").agg(F.min("hit").alias("hit"), F.max(F.struct(-F.col("hit.field_ord"), F.col("hit.ui"))).alias("known"))
    same = -F.col("known").getField("col1") == F.col("hit.field_ord")
    return best.select(key, "role", "source", "hit.label", F.when(same, F.col("known.ui")).alias("ui"), lookup(rules.SIGNAL_WEIGHTS, F.col("source"), 10).alias("weight"))


def signal_scores(signals: DataFrame, key: str) -> DataFrame:
    """The weights of an article's signals by role, capped."""
    return signals.groupBy(key, "role").agg(F.least(F.lit(rules.SIGNAL_CAP), F.sum("weight")).cast("int").alias("score"), F.count("*").alias("signals"))


def numbered(labels: DataFrame, role: str, order: Column, label: str, name: str = "ord") -> DataFrame:
    """Labels of a role in order; of repeated ones the first counts."""
    place = F.row_number().over(Window.partitionBy(role).orderBy(order, label))
    return labels.withColumn(fresh(labels, name), place)
