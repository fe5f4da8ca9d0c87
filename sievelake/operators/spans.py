"""Positional spans: where in a source a value was read, and the proof that it stands there.

``token_table`` gives every token of a text with its place; ``word_spans`` turns places of words into offsets; ``points_within`` joins points with the
intervals that hold them; ``span_faults`` checks spans against sections and tokens. Offsets count code points from 0, the end exclusive.

Where spans of a text stand in its row, ``spans_at`` and ``faults_in_text`` find their offsets and faults there, and the text isn't exchanged.

An interval join would compare every point of a key with every interval of it. Here places are cut in buckets of ``width``; an interval goes
to the buckets that it reaches, a point to its own, and the rest is an equi-join on (key, bucket), which a long text can't make
quadratic unless its intervals overlap.

Defined results: null and empty texts have no tokens; a span of no length, or one that isn't within one section, is a fault; rows that
repeat a key are told apart by nothing, so keys must be unique (``guards.unique``); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from sievelake.operators.trees import fresh, once

#: A token is a run of ASCII letters and digits; all else stands between tokens.
TOKEN = "[A-Za-z0-9]+"
WIDTH = 256


def words_form(text: Column) -> Column:
    """A text's tokens in lower case, joined by blanks: what phrases are matched against, token by token."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower), " ")


def token_table(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys``, ord (from 0), start, stop and token (as it stands) of every token."""
    piece, pos, end, size = (fresh(texts, n) for n in ("piece", "pos", "end", "size"))
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{TOKEN}|[^A-Za-z0-9]+"), F.lit(0))
    rows = texts.select(*keys, F.posexplode(pieces).alias(pos, piece)).withColumn(size, F.char_length(piece))
    before = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    is_token = F.col(piece).rlike(f"^{TOKEN}$")
    rows = rows.withColumns({end: F.sum(size).over(before), "ord": F.sum(is_token.cast("int")).over(before) - 1}).filter(is_token)
    return rows.select(*keys, F.col("ord").cast("int").alias("ord"), (F.col(end) - F.col(size)).cast("int").alias("start"), F.col(end).cast("int").alias("stop"), F.col(piece).alias("token"))


def line_table(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys``, section (number of the line), start, stop and text of every line, its end included."""
    piece, pos, end = (fresh(texts, n) for n in ("piece", "pos", "end"))
    rows = texts.filter(F.col(text) != "").select(*keys, F.posexplode(F.split(F.col(text), r"(?<=\n)", -1)).alias(pos, piece)).filter(F.col(piece) != "")
    before = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(end, F.sum(F.char_length(piece)).over(before))
    return rows.select(*keys, F.col(pos).alias("section"), (F.col(end) - F.char_length(piece)).cast("int").alias("start"), F.col(end).cast("int").alias("stop"), F.col(piece).alias("text"))


def word_spans(places: DataFrame, tokens: DataFrame, keys: Sequence[str], *, first: str = "first", words: Column) -> DataFrame:
    """Adds start and stop to rows that say at which token (``first``) a phrase of so many ``words`` begins: two equi-joins, no search."""
    last = fresh(places, "last")
    begins = tokens.select(*keys, F.col("ord").alias(first), "start")
    ends = tokens.select(*keys, F.col("ord").alias(last), "stop")
    return places.withColumn(last, (F.col(first) + words - 1).cast("int")).join(begins, [*keys, first]).join(ends, [*keys, last]).drop(last)


@pandas_udf(ArrayType(IntegerType()))
def token_edges(text: pd.Series) -> pd.Series:
    """Start and stop of every token of a text, one after the other: running sums in a row, which no built-in gives."""
    return text.map(lambda t: [] if t is None else [edge for m in re.finditer(TOKEN, t) for edge in m.span()])


def spans_in_texts(places: DataFrame, texts: DataFrame, keys: Sequence[str], text: str, *, first: str = "first", words: Column) -> DataFrame:
    """As ``word_spans``, from the texts themselves: their edges stay in the row, so no token is shuffled; texts without places are left out."""
    rest, size, held, edges = [c for c in places.columns if c not in keys], *(fresh(places, n) for n in ("size", "held", "edges"))
    grouped = places.withColumn(size, words).groupBy(*keys).agg(F.collect_list(F.struct(*rest, size)).alias(held))
    rows = texts.select(*keys, text).join(grouped, list(keys)).select(*keys, held, token_edges(F.col(text)).alias(edges))
    span = lambda c: F.struct(*[c[n].alias(n) for n in rest], F.get(edges, 2 * c[first]).alias("start"), F.get(edges, 2 * (c[first] + c[size]) - 1).alias("stop"))
    return rows.select(*keys, F.inline(F.transform(held, span))).filter("start is not null and stop is not null")


def spans_at(edges: Column, found: Column, size: Callable[[Column], Column]) -> Column:
    """{phrase, start, stop} of phrases found in a text (phrase, first), from its ``edges`` and the number of tokens that ``size`` makes of a phrase."""
    span = lambda c: F.struct(c["phrase"].alias("phrase"), F.get(edges, 2 * c["first"]).alias("start"), F.get(edges, 2 * (c["first"] + size(c["phrase"])) - 1).alias("stop"))
    return F.filter(F.transform(found, span), lambda s: s["start"].isNotNull() & s["stop"].isNotNull())


def faults_in_text(text: Column, span: Column) -> Column:
    """The codes of ``span_faults`` for one span {start, stop, span} of a text whose sections are its lines; the text is cut once, one sign wider on both sides."""
    s0, s1 = span["start"], span["stop"]
    n = s1 - s0
    around = F.when(s0 > 0, F.substring(text, s0, n + 2)).otherwise(F.concat(F.lit(" "), F.substring(text, F.lit(1), n + 1)))
    sign = lambda at: (at >= 0) & F.substring(text, at + 1, F.lit(1)).rlike("^[A-Za-z0-9]$")
    plain = (s0 >= 0) & (n >= 0)

    def codes(c: Column) -> Column:
        length, own = F.char_length(c), F.substring(c, F.lit(2), n)
        begins = F.when(plain, c.rlike("^[^A-Za-z0-9][A-Za-z0-9]")).otherwise(sign(s0) & ~sign(s0 - 1))
        ends = F.when(plain, F.substring(c, n + 1, F.lit(2)).rlike("^[A-Za-z0-9](?![A-Za-z0-9])")).otherwise(sign(s1 - 1) & ~sign(s1))
        within = F.when(n > 0, (s0 >= 0) & (length > n) & (F.instr(F.substring(c, F.lit(2), n - 1), "\n") == 0)).otherwise((s0 >= 0) & (s0 < F.char_length(text)))
        there = F.when(within, F.when(n > 0, own).otherwise(""))
        tests = [(n <= 0, "empty"), (~within & (n > 0), "outside"), (there != span["span"], "text_differs"), (~(begins & ends), "off_token")]
        return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in tests]))

    return once(around, codes)


def edges_at(spans: DataFrame, texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys``, start and stop of token edges at which spans begin or end (one of both a row): as much of a token table as ``span_faults`` looks at."""
    sign = lambda at: (at >= 0) & F.substring(text, at + 1, 1).rlike("^[A-Za-z0-9]$")
    both = spans.select(*keys, "start", "stop").join(texts.select(*keys, text), list(keys))
    s0, s1, none = F.col("start"), F.col("stop"), F.lit(None).cast("int")
    begins, ends = sign(s0) & ~sign(s0 - 1), sign(s1 - 1) & ~sign(s1)
    found = F.array_compact(F.array(F.when(begins, F.struct(s0.alias("start"), none.alias("stop"))), F.when(ends, F.struct(none.alias("start"), s1.alias("stop")))))
    return both.select(*keys, F.inline(found)).distinct()


def first_match(text: Column, pattern: str) -> Column:
    """{start, stop, span} of the first place where a pattern holds, or null."""
    at = F.regexp_instr(text, F.lit(pattern))
    span = F.regexp_extract(text, pattern, 0)
    return F.when(text.isNotNull() & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.char_length(span)).alias("stop"), span.alias("span")))


def points_within(points: DataFrame, intervals: DataFrame, keys: Sequence[str], *, at: str, start: str = "start", stop: str = "stop", width: int = WIDTH) -> DataFrame:
    """Each pair of a point and an interval [start, stop) of the same key that holds it, all columns; names must differ but for the keys."""
    bucket = fresh(points, fresh(intervals, "bucket"))
    reach = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))
    spread = intervals.filter(F.col(stop) > F.col(start)).withColumn(bucket, F.explode(reach))
    own = points.withColumn(bucket, F.floor(F.col(at) / width))
    return own.join(spread, [*keys, bucket]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop(bucket)


def span_faults(spans: DataFrame, sections: DataFrame, tokens: DataFrame, keys: Sequence[str], span_keys: Sequence[str]) -> DataFrame:
    """``keys``, ``span_keys`` and code for each span that isn't what it says.

    ``outside``: no section holds all of it; ``text_differs``: the section has other words there; ``off_token``: it doesn't begin and end where tokens do;
    ``empty``: it has no length. A span has start, stop and span (its text).
    """
    every = [*keys, *span_keys]
    s = spans.select(*every, F.col("start").alias("s0"), F.col("stop").alias("s1"), "span")
    lines = sections.select(*keys, F.col("start").alias("l0"), F.col("stop").alias("l1"), F.col("text").alias("line"))
    # a line goes to every bucket that it reaches, so its text stays behind and is joined to the spans found in it
    inside = points_within(s.drop("span"), lines.drop("line"), keys, at="s0", start="l0", stop="l1").filter("s1 <= l1")
    inside = inside.join(lines.drop("l1"), [*keys, "l0"]).select(*every, "s0", "s1", F.substring("line", F.col("s0") - F.col("l0") + 1, F.col("s1") - F.col("s0")).alias("there"))
    begins = tokens.select(*keys, F.col("start").alias("s0"), F.lit(True).alias("begins"))
    ends = tokens.select(*keys, F.col("stop").alias("s1"), F.lit(True).alias("ends"))
    rows = s.join(inside, [*every, "s0", "s1"], "left").join(begins, [*keys, "s0"], "left").join(ends, [*keys, "s1"], "left")
    tests = [
        (F.col("s1") <= F.col("s0"), "empty"),
        (F.col("there").isNull() & (F.col("s1") > F.col("s0")), "outside"),
        (F.col("there") != F.col("span"), "text_differs"),
        (F.col("begins").isNull() | F.col("ends").isNull(), "off_token"),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in tests]))
    return rows.select(*every, F.explode(codes).alias("code"))


def placement_faults(ranked: DataFrame, placed: DataFrame, keys: Sequence[str], row: str, limit: int) -> DataFrame:
    """Per key how often a report breaks its own rules, all in one grouping: selected rows that have no place (or one that nobody selected), rows of two
    places, irrelevant rows shown as evidence, protocols shown with results, ranks that don't count up.

    ``ranked`` has rank, relevance_class, design_family, result_status; ``placed`` a row for each place in the report.
    """
    places = placed.groupBy(*keys, row).agg(F.count("*").alias("places"))
    both = ranked.join(places, [*keys, row], "full_outer")
    chosen, shown = F.coalesce(F.col("rank") <= limit, F.lit(False)), F.coalesce(F.col("places"), F.lit(0))
    n = lambda test, name: F.count_if(test).alias(name)
    out = both.groupBy(*keys).agg(
        n(chosen != (shown > 0), "selected_disappearance"),
        n(shown > 1, "duplicate_placement"),
        n(chosen & (F.col("relevance_class") == "irrelevant"), "irrelevant_in_key_evidence"),
        n(chosen & (F.col("design_family") == "protocol") & (F.col("result_status") == "reported"), "protocol_as_results"),
        F.count("rank").alias("__ranked"), F.coalesce(F.max("rank"), F.lit(0)).alias("__last"), F.countDistinct("rank").alias("__ranks"),
    )
    broken = (F.col("__ranked") != F.col("__last")) | (F.col("__ranks") != F.col("__last"))
    return out.withColumn("ranking_reconstruction_failure", broken.cast("long")).drop("__ranked", "__last", "__ranks")
