"""Queries that match tables of phrases with tables of texts, and topic profiles from article rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake import rules
from sievelake.functions.text import type_form
from sievelake.operators import terms
from sievelake.operators.phrases import phrase_matches, signal_rows, signal_scores, texts_with_phrases
from sievelake.operators.spans import faults_in_text, spans_at, token_edges, words_form
from sievelake.operators.trees import once
from sievelake.plans.catalog import query, t

_AT = "list_filter(range(len(words)), lambda i: array_to_string(words[i + 1 : i + len(string_split(label, ' '))], ' ') = label)"
_FORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _phrases(spark, d):
    """Labels drawn from the benchmark: its items' second to fifth word, and the seventh."""
    items = t(spark, d, "benchmark").select("item_id", F.split(type_form(F.col("text")), " ").alias("w"))
    some = F.array(F.array_join(F.slice("w", 2, 4), " "), F.coalesce(F.get("w", 6), F.lit("")))
    return items.select("item_id", F.explode(some).alias("label"))


@query(
    f"""with b as (select item_id, string_split({_FORM.format('text')}, ' ') as w from benchmark),
l as (select item_id, label from (select item_id, unnest([array_to_string(w[2:5], ' '), coalesce(w[7], '')]) as label from b) where label <> ''),
d as (select doc_id, string_split({_FORM.format('text')}, ' ') as words, ' ' || {_FORM.format('text')} || ' ' as padded from documents),
m as (select doc_id, item_id, label, {_AT} as spots from d join l on contains(padded, ' ' || label || ' '))
select doc_id, item_id, label as phrase, cast(spots[1] as integer) as first, cast(len(spots) as bigint) as times from m"""
)
def benchmark_phrases(spark, d):
    """Phrases of the benchmark in whole documents, with where they first stand and how often."""
    docs = t(spark, d, "documents").select("doc_id", type_form(F.col("text")).alias("text"))
    return phrase_matches(docs, ["doc_id"], "text", _phrases(spark, d), ["item_id"], "label")


@query(
    """with n as (select p_partkey, p_name || ' ' || lower(p_type) || ' ' || p_size as name from part), l as (select distinct p_type, lower(p_type) as label from part union all select distinct p_type, p_name || ' ' || lower(p_type) from part where p_size < 10)
select p_partkey, p_type, label as phrase from n join l on contains(' ' || name || ' ', ' ' || label || ' ')"""
)
def part_labels(spark, d):
    """Labels drawn from the parts themselves, of one word and of three, against all names - no literal, no nested loop."""
    p = t(spark, d, "part")
    names = p.select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string")).alias("name"))
    labels = p.select("p_type", F.lower("p_type").alias("label")).distinct().union(p.filter("p_size < 10").select("p_type", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("label")).distinct())
    return phrase_matches(names, ["p_partkey"], "name", labels, ["p_type"], "label").select("p_partkey", "p_type", "phrase")


_PART_FIELDS = """f as (select p_partkey, 'title' as source, 0 as ord, p_name as text, p_name as raw, '' as ui from part
union all select p_partkey, case when p_size > 25 then 'mesh_major' else 'mesh' end, 1, lower(p_type), p_type, p_brand from part union all select p_partkey, 'abstract', 2, 'a ' || p_name || ' of ' || lower(p_type), '', '' from part),
l as (select 'intervention' as role, cast(substr(p_brand, 7) as integer) as ord, lower(p_type) as label from (select distinct p_brand, p_type from part where p_size = 7) union select 'condition', min(p_partkey), regexp_extract(p_name, '[a-z]+$') from part where p_size < 4 group by 3),
i as (select 'condition' as role, p_brand as ui from part where p_size = 3 group by 2)"""


@query(
    f"""with {_PART_FIELDS},
h as (select p_partkey, role, source, f.ord as field_ord, l.ord as label_ord, label, null as ui from f join l on contains(' ' || text || ' ', ' ' || label || ' ')
  union all select p_partkey, role, source, f.ord, 2147483647, raw, i.ui from f join i using (ui)),
b as (select p_partkey, role, source, min(struct_pack(f := field_ord, l := label_ord, t := label)) as hit from h group by all),
w as (select *, case source when 'title' then {rules.SIGNAL_WEIGHTS['title']} when 'mesh_major' then {rules.SIGNAL_WEIGHTS['mesh_major']} when 'mesh' then {rules.SIGNAL_WEIGHTS['mesh']} else {rules.SIGNAL_WEIGHTS['abstract']} end as weight from b)
select p_partkey, role, cast(least({rules.SIGNAL_CAP}, sum(weight)) as integer) as score, cast(count(*) as bigint) as signals, string_agg(source || '=' || hit.t, ';' order by source) as told from w group by 1, 2"""
)
def label_signals(spark, d):
    """Signals by role from tables of labels and of known ids, with their capped scores."""
    p = t(spark, d, "part")
    field = lambda source, n, text, raw, ui: p.select("p_partkey", source.alias("source"), F.lit(n).alias("ord"), text.alias("text"), raw.alias("raw"), ui.alias("ui"))
    none, kind = F.lit(""), F.lower("p_type")
    fields = field(F.lit("title"), 0, F.col("p_name"), F.col("p_name"), none).union(field(F.when(F.col("p_size") > 25, "mesh_major").otherwise("mesh"), 1, kind, F.col("p_type"), F.col("p_brand")))
    fields = fields.union(field(F.lit("abstract"), 2, F.concat(F.lit("a "), F.col("p_name"), F.lit(" of "), kind), none, none))
    drugs = p.filter("p_size = 7").select("p_brand", "p_type").distinct().select(F.lit("intervention").alias("role"), F.substring("p_brand", 7, 9).cast("int").alias("ord"), F.lower("p_type").alias("label"))
    conditions = p.filter("p_size < 4").groupBy(F.regexp_extract("p_name", "[a-z]+$", 0).alias("label")).agg(F.min("p_partkey").cast("int").alias("ord"))
    labels = drugs.union(conditions.select(F.lit("condition").alias("role"), "ord", "label"))
    ids = p.filter("p_size = 3").select(F.lit("condition").alias("role"), F.col("p_brand").alias("ui")).distinct()
    found = signal_rows(fields, labels, "p_partkey", ids=ids)
    told = found.groupBy("p_partkey", "role").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", "label"))), ";").alias("told"))
    return signal_scores(found, "p_partkey").join(told, ["p_partkey", "role"])


_LEVELS = ("guideline", "systematic_review", "randomized_trial", "observational", "narrative_review", "other")
_BONUS = " ".join(f"when {rules.EVIDENCE_ORDINAL[k]} then {rules.EVIDENCE_BONUS[k]}" for k in _LEVELS)


@query(
    f"""with a as (select p_partkey, p_size, p_name, lower(p_type) as kind, [p_brand, p_type, 'Humans'] as headings, list_concat(string_split(p_name, ' '), [p_name || '  X']) as keywords, date '2024-01-01' - p_size * 12 as published,
  {rules.EVIDENCE_ORDINAL['guideline']} - p_partkey % 6 as level from part),
o as (select *, 'mesh' as source, 0 as k, unnest(headings) as raw, unnest(range(3)) as i from a union all select *, 'keyword', 1, unnest(keywords), unnest(range(len(keywords))) from a),
n as (select *, trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) as term from o),
s as (select term, count(distinct p_partkey) as df, arg_min(source, (p_partkey, k, i)) as source, min((p_partkey, k, i)) as seen, max(level) as level, max(published) as latest, max(contains(p_name, term)::int) as in_title, max((contains('a ' || kind || ' thing', term))::int) as in_abstract
  from n where term not in ('humans') group by term),
x as (select *, greatest(0, date '2024-06-01' - latest) as days, len(list_intersect(list_distinct(regexp_extract_all(term, '[a-z0-9]+')), ['red', 'widget', 'economy'])) / len(list_distinct(regexp_extract_all(term, '[a-z0-9]+'))) as overlap,
  case when in_title = 1 then 5 when in_abstract = 1 then 3 else 0 end as boost from s),
y as (select *, least(100.0, 0.40::double * df / (select max(df) from s) * 100 + 0.30::double * (case level {_BONUS} end) + 0.20::double * (case when days <= 90 then 100 when days <= 180 then 80 when days <= 365 then 60 else 40 end) + 0.10::double * overlap * 100 + boost) as raw from x),
z as (select *, round_even(raw, 1) as score from y)
select term, source, df as document_frequency, cast(days as integer) as recency_days, round_even(overlap, 2) as direct_topic_overlap, score, df >= 2 and score >= 60 as accepted,
  row_number() over (order by (df >= 2 and score >= 60) desc, score desc, seen, term) as position from z"""
)
def article_topic_profile(spark, d):
    """A profile from articles: headings, then keywords, first seen first; scores rounded as their exact value says."""
    p = t(spark, d, "part")
    level = F.element_at(F.array(*[F.lit(x) for x in _LEVELS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    articles = p.select(
        F.col("p_partkey").alias("pmid"), F.col("p_partkey").alias("rank"), F.upper("p_name").alias("title"), F.concat(F.lit("A  "), F.col("p_type"), F.lit(" thing")).alias("abstract"), F.array("p_brand", "p_type", F.lit("Humans")).alias("headings"),
        F.concat(F.split("p_name", " "), F.array(F.concat("p_name", F.lit("  X")))).alias("keywords"), level.alias("evidence_level"), F.date_sub(F.lit("2024-01-01").cast("date"), F.col("p_size") * 12).alias("published"),
    )
    found = terms.build_profile(terms.scored_terms(articles, "Red widget, economy!", "2024-06-01"), "Red widget, economy!")
    return found.select("term", "source", F.col("document_frequency").alias("document_frequency"), "recency_days", "direct_topic_overlap", "score", "accepted", F.col("position").cast("long").alias("position"))


# ---- where phrases stand

_SPANS = f"""t as (select doc_id, text, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) as piece, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+')))) as pos from documents),
o as (select doc_id, piece, pos, sum(length(piece)) over w as stop, regexp_full_match(piece, '[A-Za-z0-9]+') as token, sum(regexp_full_match(piece, '[A-Za-z0-9]+')::int) over w - 1 as ord from t window w as (partition by doc_id order by pos rows unbounded preceding)),
k as (select doc_id, ord, cast(stop - length(piece) as bigint) as start, cast(stop as bigint) as stop, piece from o where token),
b as (select item_id, string_split({_FORM.format('text')}, ' ') as w from benchmark),
l as (select distinct item_id, label from (select item_id, unnest([array_to_string(w[2:5], ' '), coalesce(w[7], '')]) as label from b) where label <> ''),
d as (select doc_id, list(lower(piece) order by ord) as words, ' ' || string_agg(lower(piece), ' ' order by ord) || ' ' as padded from k group by 1),
m as (select doc_id, item_id, label, {_AT}[1] as place from d join l on contains(padded, ' ' || label || ' ')),
s as (select m.doc_id, item_id, label, x.start, y.stop from m join k x on x.doc_id = m.doc_id and x.ord = place join k y on y.doc_id = m.doc_id and y.ord = place + len(string_split(label, ' ')) - 1)"""


def _spans(spark, d):
    """Texts that hold phrases, with the spans {phrase, start, stop} of each in its row; and the items that have a phrase."""
    docs, items = t(spark, d, "documents").select("doc_id", "text"), _phrases(spark, d).distinct().withColumnRenamed("label", "phrase")
    found = texts_with_phrases(docs, ["doc_id"], "text", items.select("phrase"), form=words_form)
    rows = found.withColumn("edges", token_edges("text"))
    return rows.select("doc_id", "text", spans_at(F.col("edges"), F.col("found"), lambda p: F.size(F.split(p, " "))).alias("spans")), items


@query(f"with {_SPANS} select doc_id, item_id, label as phrase, cast(start as integer) as start, cast(stop as integer) as stop, substr(text, start + 1, stop - start) as span from s join documents using (doc_id)")
def phrase_spans(spark, d):
    """Where benchmark phrases first stand in whole documents, in code points of the text as it is."""
    rows, items = _spans(spark, d)
    span = lambda s: F.struct(*[s[c].alias(c) for c in ("phrase", "start", "stop")], F.substring("text", s["start"] + 1, s["stop"] - s["start"]).alias("span"))
    return rows.select("doc_id", F.inline(F.transform("spans", span))).join(items, "phrase").select("doc_id", "item_id", "phrase", "start", "stop", "span")


@query(
    f"""with {_SPANS}, x as (select doc_id, item_id, label as phrase, start + (doc_id % 7 = 0)::int as start, stop + (doc_id % 7 = 0)::int as stop, substr(text, start + 1, stop - start) as span, text from s join documents using (doc_id)),
f as (select *, substr(text, start + 1, stop - start) as there, contains(substr(text, start + 1, stop - start - 1), chr(10)) or length(text) < stop as crosses from x)
select doc_id, item_id, phrase, 'outside' as code from f where crosses
union all select doc_id, item_id, phrase, 'text_differs' from f where not crosses and there <> span
union all select f.doc_id, item_id, phrase, 'off_token' from f left join k a on a.doc_id = f.doc_id and a.start = f.start left join k z on z.doc_id = f.doc_id and z.stop = f.stop where a.start is null or z.stop is null"""
)
def span_invariants(spark, d):
    """Spans against lines and tokens: what crosses a line, and a shift by one that is planted in every seventh document, is found; all else holds."""
    rows, items = _spans(spark, d)
    shift = (F.col("doc_id") % 7 == 0).cast("int")
    moved = lambda s: F.struct((s["start"] + shift).alias("start"), (s["stop"] + shift).alias("stop"), F.substring("text", s["start"] + 1, s["stop"] - s["start"]).alias("span"))
    told = lambda s: F.transform(once(moved(s), lambda m: faults_in_text(F.col("text"), m)), lambda code: F.struct(s["phrase"].alias("phrase"), code.alias("code")))
    return rows.select("doc_id", F.inline(F.flatten(F.transform("spans", told)))).join(items, "phrase").select("doc_id", "item_id", "phrase", "code")
