"""Queries that run the study, evidence and regulatory rules on rows that plain projections make of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import publish, regulatory, study
from sievelake.operators.cache import LookupCache
from sievelake.operators.evidence import with_evidence
from sievelake.plans.catalog import query, t
from sievelake.plans.nested import num, obj, word
from sievelake.plans.stage import Stage

_FAMILIES = ("randomized_controlled_trial", "retrospective_cohort", "case_report", "protocol", "pharmacovigilance_disproportionality", "unknown", "nonrandomized_interventional_study", "narrative_review")
_STUDIES = f"""s as (select c_custkey as k, c_acctbal < 0 as bare, c_nationkey % 2 = 0 as methods, {list(_FAMILIES)}[c_custkey % 8 + 1] as family, ['human', 'preclinical_only', 'mixed'][c_custkey % 3 + 1] as scope, ['reported', 'unclear'][c_custkey % 2 + 1] as status,
  ['reported', 'not_reported', 'ambiguous'][c_nationkey % 3 + 1] as sample, ['reported', 'not_reported', 'not_applicable'][(c_custkey + c_nationkey) % 3 + 1] as comparator, c_nationkey % 4 = 0 as no_follow_up, ['true', 'false', 'unknown'][c_nationkey % 3 + 1] as multicenter, c_custkey % 5 = 0 as conflict from customer)"""
_COHORTS = "('retrospective_cohort')"


def _studies(spark, d):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda i, *values: F.get(F.lit(list(values)), i.cast("int"))
    text = F.when(n % 2 == 0, "Patients were enrolled.").otherwise("Nothing is said.")
    return t(spark, d, "customer").select(
        "c_custkey", text.alias("text"), F.when(F.col("c_acctbal") >= 0, text).alias("abstract"), F.expr("cast(array() as array<struct<label:string,text:string>>)").alias("abstract_sections"),
        pick(c % 8, *_FAMILIES).alias("family"), pick(c % 3, "human", "preclinical_only", "mixed").alias("scope"), pick(c % 2, "reported", "unclear").alias("status"), pick(n % 3, "reported", "not_reported", "ambiguous").alias("sample"),
        pick((c + n) % 3, "reported", "not_reported", "not_applicable").alias("comparator"), F.when(n % 4 != 0, "1 year").alias("follow_up"), pick(n % 3, "true", "false", "unknown").alias("multicenter"), (c % 5 == 0).alias("conflict"),
    )


@query(
    f"""with {_STUDIES} select k as c_custkey, concat_ws(',', case when bare then 'abstract_missing' end, case when not methods or status = 'unclear' and not methods then 'methods_not_reported' end, case when sample <> 'reported' then 'sample_size_not_reported' end,
  case when comparator = 'not_reported' then 'comparator_not_reported' end, case when family in ('randomized_controlled_trial', 'retrospective_cohort') and no_follow_up then 'follow_up_not_reported' end,
  case when family in ('nonrandomized_interventional_study', 'retrospective_cohort') then 'nonrandomized' end, case when family = 'retrospective_cohort' then 'retrospective_design' end, case when multicenter = 'false' then 'single_center' end,
  case when family = 'case_report' then 'case_report_or_series' end, case when family = 'protocol' then 'protocol_no_results' end, case when scope = 'preclinical_only' then 'preclinical_only' end, case when scope = 'mixed' then 'mixed_population' end,
  case when family like 'pharmaco%' then 'pharmacovigilance_reporting_bias,pharmacovigilance_no_incidence,pharmacovigilance_no_causality' end, case when comparator = 'not_applicable' then 'uncontrolled_study' end,
  case when family = 'unknown' then 'design_unclear' end, case when conflict then 'conflicting_design_signals' end, case when status = 'unclear' and methods then 'methods_not_reported' end, case when sample = 'ambiguous' and family <> 'unknown' then 'design_unclear' end) as codes from s"""
)
def ordered_unique_codes(spark, d):
    """C14: limitation codes in their order, each once, by the rules themselves."""
    c = F.col
    codes = study.limitations(c("text"), c("family"), c("scope"), c("status"), c("sample"), c("comparator"), c("follow_up"), c("multicenter"), c("conflict"))
    return _studies(spark, d).select("c_custkey", F.array_join(codes, ",").alias("codes"))


@query(
    f"""with {_STUDIES} select k as c_custkey, concat_ws('|', 'design: ' || family || ', from publication types and explicit words, the strongest source first', 'tier: ' || scope || ', a triage by abstract and metadata and no appraisal of quality',
  case when status <> 'reported' then 'results are not sufficiently reported in the abstract' end, case when scope <> 'human' then 'population: ' || scope || ', not taken as human evidence' end,
  case when sample <> 'reported' then 'no number in the text is tied to a study population alone' end, case when comparator = 'not_reported' then 'no comparator is reported in the abstract' end,
  case when conflict then 'equally strong sources name designs that exclude each other; needs review' end) as reasons from s"""
)
def study_reasons(spark, d):
    """Why an assessment is as it is, in order (the scope stands for the tier)."""
    c = F.col
    return _studies(spark, d).select("c_custkey", F.array_join(study.reasons(c("family"), c("scope"), c("status"), c("scope"), c("sample"), c("comparator"), c("conflict")), "|").alias("reasons"))


_TYPES = ("Practice Guideline", "Meta-Analysis", "Network Meta-Analysis", "Randomized Controlled Trial", "Observational Study", "Review", "Study Protocol", "Letter", "Dataset")
_LEVELS = ("guideline", "systematic_review", "systematic_review", "randomized_trial", "observational", "narrative_review", "other", "narrative_review", "other")
_DESIGNS = ("guideline_or_consensus", "systematic_review_meta_analysis", "systematic_review_meta_analysis", "randomized_controlled_trial", "prospective_cohort", "narrative_review", "protocol", "editorial_commentary_letter", "unknown")


def _parts_as_articles(spark, d):
    p, none = F.col("p_partkey"), F.expr("cast(array() as array<struct<label:string,text:string>>)")
    kind = F.get(F.lit(list(_TYPES)), (p % 9).cast("int"))
    return t(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.concat(F.lit("on the "), F.lower("p_type"))).alias("abstract"), F.array(kind).alias("publication_types"), none.alias("abstract_sections"),
        F.expr("cast(array() as array<string>)").alias("keywords"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("publication_date"), (p % 7 == 0).alias("is_epub_ahead_of_print"),
    )


@query(
    f"""with a as (select p_partkey, string_split(p_name, ' ') as title, p_size > 10 as has, lower(p_type) as kind, p_size > 30 as future, p_partkey % 7 = 0 as epub, {list(_LEVELS)}[p_partkey % 9 + 1] as level from part),
n as (select *, len(list_intersect(title, ['red', 'widget', 'economy'])) as t, has and kind = 'economy' as b from a),
s as (select *, 50 + case when t > 0 then 10 when b then 5 else 0 end + case when t >= 2 then 10 else 0 end as relevance,
  greatest(0, least(100, case level when 'guideline' then 95 when 'systematic_review' then 90 when 'randomized_trial' then 85 when 'observational' then 65 when 'narrative_review' then 45 else 30 end + case when has then 5 else 0 end - case when future then 20 else 0 end)) as evidence from n),
o as (select *, cast(round(0.6 * evidence + 0.4 * relevance) as integer) as overall from s)
select p_partkey, level, evidence, relevance, overall, case when future then 'exploratory_evidence' when overall >= 75 then 'key_evidence' when overall >= 55 then 'important_updates' else 'exploratory_evidence' end as section,
  coalesce(nullif(concat_ws(',', case when level in ('guideline', 'systematic_review', 'randomized_trial') then 'high_evidence_level' end, case when relevance >= 60 then 'topic_in_title_or_abstract' end, case when has then 'abstract_available' end), ''), 'retrieved_by_topic') as reasons,
  concat_ws(',', case when not has then 'no_abstract' end, case when future then 'future_dated' end, case when epub then 'ahead_of_print' end, case when level = 'observational' then 'observational_design' end, case when level = 'narrative_review' then 'no_primary_study' end, case when level = 'other' then 'unclassified_design' end) as limitations from o"""
)
def evidence_scores(spark, d):
    """Level, scores, section, reasons and limitations of parts laid out as articles."""
    a = with_evidence(_parts_as_articles(spark, d), "2024-01-31", "Red widget, economy").select("p_partkey", "assessment.*")
    return a.select(
        "p_partkey", F.col("evidence_level").alias("level"), F.col("evidence_score").cast("int").alias("evidence"), F.col("relevance_score").cast("int").alias("relevance"), F.col("overall_score").cast("int").alias("overall"), "section",
        F.array_join("reasons", ",").alias("reasons"), F.array_join("limitations", ",").alias("limitations"),
    )


@query(
    f"""select p_partkey, {list(_DESIGNS)}[p_partkey % 9 + 1] as design_family, case when p_partkey % 9 = 2 then 'network_meta_analysis' else {list(_DESIGNS)}[p_partkey % 9 + 1] end as design_subtype, false as design_conflict,
  case when p_partkey % 9 = 8 then '' else {list(_TYPES)}[p_partkey % 9 + 1] || '@0-' || length({list(_TYPES)}[p_partkey % 9 + 1]) end as spans from part"""
)
def design_signals(spark, d):
    """Family, subtype and the spans they were read from."""
    found = study.with_design(_parts_as_articles(spark, d))
    spans = F.array_join(F.transform("design_spans", lambda s: F.concat(s["span"], F.lit("@"), s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ";")
    return found.select("p_partkey", "design_family", "design_subtype", "design_conflict", spans.alias("spans"))


@query(
    """with u as (select *, ['https://x.example/p', 'http://x.example:80/?q=1&n=2', 'https://me@x.example/p', 'ftp://x.example/p', 'https:///p', 'https://x.example/p?a=1&api-key=5', 'http://x.example/p?SIG=1', 'http://x.example/p?design=1', null][c_custkey % 9 + 1] as link from customer),
w as (select *, strftime(date '2024-02-27' + cast(c_nationkey % 5 as integer), '%Y-%m-%d') as day, c_custkey % 11 as v from u),
x as (select *, case when v = 0 then '2024-02-30' when v = 1 then day || ' ' else day end as shown, case when v = 0 then day || 'T24:00:00Z' when v = 1 then day || 'T10:00:60Z' when v = 2 then day || 'T10:00:00' when v = 3 then day || ' 10:00:00Z' else day || 'T23:59:59Z' end as moment from w)
select c_custkey, c_custkey % 9 in (0, 1, 7, 8) as link_ok, case when v in (0, 1) then null else day end as day, case when v <= 3 then null else day || ' 23:59:59' end as moment from x"""
)
def strict_fields(spark, d):
    """Links without credentials, days and times in just their form."""
    k = F.col("c_custkey")
    links = ("https://x.example/p", "http://x.example:80/?q=1&n=2", "https://me@x.example/p", "ftp://x.example/p", "https:///p", "https://x.example/p?a=1&api-key=5", "http://x.example/p?SIG=1", "http://x.example/p?design=1")
    day = F.date_add(F.lit("2024-02-27").cast("date"), (F.col("c_nationkey") % 5).cast("int")).cast("string")
    shown = F.when(k % 11 == 0, "2024-02-30").when(k % 11 == 1, F.concat(day, F.lit(" "))).otherwise(day)
    moment = F.when(k % 11 == 0, F.concat(day, F.lit("T24:00:00Z"))).when(k % 11 == 1, F.concat(day, F.lit("T10:00:60Z"))).when(k % 11 == 2, F.concat(day, F.lit("T10:00:00"))).when(k % 11 == 3, F.concat(day, F.lit(" 10:00:00Z"))).otherwise(F.concat(day, F.lit("T23:59:59Z")))
    link = F.get(F.lit(list(links)), (k % 9).cast("int"))
    return t(spark, d, "customer").select("c_custkey", regulatory.source_link_ok(link).alias("link_ok"), regulatory.strict_iso_day(shown).cast("string").alias("day"), F.date_format(regulatory.strict_utc(moment), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query(
    """with l as (select l_orderkey as k, list_sort(list(distinct lpad(cast(l_linenumber as varchar), 3, '0') || case l_returnflag when 'A' then 'Prescription' when 'N' then 'Discontinued' else 'Other' end)) as p, count(distinct lpad(cast(l_linenumber as varchar), 3, '0') || l_returnflag) <> count(distinct l_linenumber) as twice, bool_or(l_returnflag = 'R') as unknown from lineitem group by 1),
o as (select o_orderkey as k, case when o_orderkey % 6 = 0 then '' else o_orderpriority end as sponsor, coalesce(p, []) as p, coalesce(twice, false) as twice, coalesce(unknown, false) as unknown from orders left join l on k = o_orderkey),
j as (select *, '{"application_number":"N' || k || '","products":[' || array_to_string(list_transform(p, lambda x: '{"marketing_status":"' || substr(x, 4) || '","product_number":"' || substr(x, 1, 3) || '"}'), ',') || '],"sponsor_name":"' || sponsor || '"}' as raw from o)
select 'N' || k as application_number, nullif(sponsor, '') as sponsor_name, cast(len(p) as integer) as products, concat_ws(',', case when sponsor = '' then 'missing_sponsor' end, case when unknown then 'unknown_marketing_status' end) as review_reasons,
  case when twice then 'duplicate_product' else '' end as violations, sha256(raw) as record_digest from j"""
)
def normalized_applications(spark, d):
    """Orders with their lines as application records: reasons, violations, digests of the canonical text."""
    kind = F.when(F.col("l_returnflag") == "A", "Prescription").when(F.col("l_returnflag") == "N", "Discontinued").otherwise("Other")
    product = F.struct(F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("n"), kind.alias("s"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(product)).alias("p"))
    listed = F.array_join(F.transform(F.coalesce("p", F.expr("cast(array() as array<struct<n:string,s:string>>)")), lambda x: obj(product_number=word(x["n"]), marketing_status=word(x["s"]))), ",")
    sponsor = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.col("o_orderpriority"))
    raw = obj(sponsor_name=word(sponsor), products=F.concat(F.lit("["), listed, F.lit("]")), application_number=word(F.concat(F.lit("N"), num(F.col("o_orderkey")))))
    found = regulatory.normalize_applications(t(spark, d, "orders").join(lines, "o_orderkey", "left").select(raw.alias("value")))
    return found.select("application_number", "sponsor_name", F.size("products").alias("products"), F.array_join("review_reasons", ",").alias("review_reasons"), F.array_join("violations", ",").alias("violations"), "record_digest")


# ---- concepts

_MENTIONS = """a as (select p_partkey as pmid, p_name, lower(p_type) as kind, p_type, 'D' || substr(p_brand, 7) as ui, regexp_extract(p_name, '[a-z]+$') as word from part),
l as (select ui, arg_min(p_type, pmid) as label from a group by 1),
v as (select word, min('R' || pmid) as code from (select word, pmid from a join part on p_partkey = pmid where p_size < 3) group by 1),
w as (select distinct unnest(string_split(p_name, ' ')) as term, pmid from a),
m as (select 'mesh' as vocabulary, ui as concept_id, label as original_term, 1.0::double as confidence, pmid from a join l using (ui)
  union all select case when code is null then 'unresolved' else 'rxnorm' end, coalesce(code, 'unresolved:' || substr(sha256(term), 1, 16)), term, case when code is null then 0.0 else 1.0 end, pmid from w left join v on v.word = term)"""


def _mentions(spark, d):
    from sievelake.operators import concepts

    p = t(spark, d, "part")
    heading = F.struct(F.col("p_type").alias("text"), F.concat(F.lit("D"), F.substring("p_brand", 7, 9)).alias("ui"), F.lit(False).alias("major_topic"), F.lit("").alias("supporting_pmid"))
    last = F.regexp_extract("p_name", "[a-z]+$", 0)
    articles = p.select(F.col("p_partkey").alias("pmid"), F.col("p_name").alias("title"), F.lower("p_type").alias("abstract"), F.array("p_type").alias("mesh_headings"), F.array(last).alias("keywords"), F.array(heading).alias("mesh_descriptors"))
    vocabulary = p.filter("p_size < 3").groupBy(last.alias("label")).agg(F.min(F.concat(F.lit("R"), F.col("p_partkey").cast("string"))).alias("code"))
    terms = p.select(F.explode(F.split("p_name", " ")).alias("term"), F.col("p_partkey").alias("pmid"))
    return concepts.heading_mentions(articles).union(concepts.term_mentions(terms, vocabulary)), articles


@query(f"with {_MENTIONS} select vocabulary, concept_id, original_term, max(confidence) as confidence, count(distinct pmid) as articles from m group by 1, 2, 3")
def concept_rows(spark, d):
    """Concepts of headings and terms, counted over their mentions."""
    from sievelake.operators import concepts

    return concepts.merge(_mentions(spark, d)[0]).drop("label")


@query(
    f"""with {_MENTIONS}, j as (select m.*, lower(original_term) as t, p_name, kind, word from m join a using (pmid)),
e as (select *, unnest(list_filter([case when contains(p_name, t) then 'title' end, case when contains(kind, t) then 'abstract' end, case when kind = t then 'mesh_headings' end, case when word = t then 'keywords' end], lambda x: x is not null)) as source_field from j)
select pmid, vocabulary, concept_id, source_field, max(original_term) as original_term from e group by 1, 2, 3, 4"""
)
def concept_edges(spark, d):
    """Which article mentions which concept in which field."""
    from sievelake.operators import concepts

    return concepts.links(*_mentions(spark, d)).select("pmid", "vocabulary", "concept_id", "source_field", "original_term")


# ---- sinks


@query("select c_custkey, c_name, n_name, 0 as looked_up_again from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20")
def cached_lookups(spark, d):
    """Nations looked up through a cache that is a table; the second run looks nothing up."""
    rows = t(spark, d, "customer").select("c_custkey", "c_name", F.concat(F.lit(" Nation  "), F.col("c_nationkey").cast("string")).alias("term"))
    known = t(spark, d, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("label"), "n_name")
    ask = lambda missing: missing.join(known, F.col("term") == F.col("label")).groupBy("key").agg(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("found"))
    cache = LookupCache(spark, f"{Stage(spark, 'cache').root}/entries", "struct<name:string>")
    cache.lookup(rows, "term", ask)
    found, n = cache.lookup(rows.withColumn("term", F.upper("term")), "term", ask)
    return found.select("c_custkey", "c_name", F.get("found", 0)["name"].alias("n_name"), F.lit(n).cast("int").alias("looked_up_again"))


@query("select c_custkey, c_name, c_nationkey from customer where c_custkey % 10 <> 3")
def published_generation(spark, d):
    """The second generation of a publication, read by its pointer and checked against its marker."""
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    p = publish.Publication(spark, f"{Stage(spark, 'publication').root}/p", "c_custkey long, c_name string, c_nationkey long", ["c_custkey"])
    p.publish(rows)
    p.publish(rows.filter("c_custkey % 10 <> 3"))
    return p.load().withColumn("c_nationkey", F.col("c_nationkey").cast(rows.schema["c_nationkey"].dataType))


@query(
    """with s as (select c_custkey, lower(c_mktsegment) as slug, c_nationkey as n, c_mktsegment || ' ' || c_custkey % 3 as text from customer),
r as (select *, slug || '_' || c_custkey % 3 as base from s), p as (select *, row_number() over (partition by base order by n, text, c_custkey) as a, row_number() over (partition by base, n order by text, c_custkey) as b from r)
select base, n as stamp, count(*) as rows, count(distinct case when a = 1 then base when b = 1 then base || '_' || n else base || '_' || n || '_' || b end) as names from p group by 1, 2"""
)
def file_names(spark, d):
    """K6: names of reports: slugs, with a stamp only where they collide."""
    c = t(spark, d, "customer").select(F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 3).cast("string")).alias("text"), F.col("c_nationkey").alias("stamp"))
    named = publish.unique_names(c, "text", "stamp").withColumn("base", F.regexp_replace(F.lower("text"), " ", "_"))
    return named.groupBy("base", "stamp").agg(F.count("*").alias("rows"), F.countDistinct("name").alias("names"))
