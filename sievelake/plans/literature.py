"""Queries that lay the driver's tables out as articles, snapshots, labels or class rows and run the library's operators on them.

The rows are made by plain projections; every rule is the operator's own, and the SQL beside it states what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as X
from sievelake.operators import metrics, ranking, records, snapshots, vocabulary
from sievelake.operators.trees import leaf_table
from sievelake.plans.catalog import query, t

# ---- the flagship: triage of candidates to placed evidence

_TRIAGE = """
with f as (select min(doc_id) as doc_id from documents group by text),
e as (
  select d.source as topic_id, cast(d.doc_id as varchar) as pmid, d.doc_id, n_chars, lang, toxic = 0 as eligible,
    case lang when 'en' then 'included_direct' when 'de' then 'included_class_level' when 'fr' then 'included_contextual' else 'excluded_irrelevant' end as decision
  from documents d join f using (doc_id) join labels l on l.doc_id = d.doc_id
),
r as (
  select *, row_number() over (partition by topic_id order by case lang when 'en' then 0 when 'de' then 1 else 2 end, n_chars % 2, case when n_chars >= 2000 then 0 when n_chars >= 500 then 1 else 2 end,
    case doc_id % 4 when 0 then 1 when 1 then 3 when 2 then 8 else 10 end, doc_id % 3, -least(n_chars, 10000), -(n_chars % 60), case when n_chars >= 1000 then 0 else 1 end, -(doc_id % 100), -(doc_id % 365), pmid) as rank
  from e where eligible and lang in ('en', 'de', 'fr')
),
s as (
  select *, case when doc_id % 4 = 2 then 'early_safety_signals' when doc_id % 4 = 3 or lang = 'fr' or n_chars < 30 then 'clinical_background_and_overview' else 'key_evidence' end as route from r where rank <= 10
),
p as (select *, route = 'key_evidence' and sum((route = 'key_evidence')::int) over (partition by topic_id order by rank rows unbounded preceding) > 3 as beyond from s)
select e.topic_id, e.pmid, case when not e.eligible then 'excluded_integrity' when r.rank > 10 then 'excluded_report_limit' else e.decision end as decision, r.rank,
  case when beyond then 'additional_selected_evidence' else route end as section, case when p.pmid is null then null when beyond then 'collapsed' else 'full' end as display
from e left join r on e.topic_id = r.topic_id and e.pmid = r.pmid left join p on e.topic_id = p.topic_id and e.pmid = p.pmid
"""


def _decided(spark, d, counters=None):
    """Documents as candidates: first of each text, labelled, judged, ranked and placed; the rows that both sides read are written once."""
    from sievelake.plans.stage import Stage
    from sievelake.plans.triage import Counters, decide

    stage, counters = Stage(spark, "triage"), counters or Counters()
    docs = counters.at_source(t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")))
    rows = counters.after_dedup(records.first_wins(docs, ["h1", "h2"], F.col("doc_id"))).join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    kind = X.lookup({"en": "direct", "de": "class_level", "fr": "contextual"}, F.col("lang"), "irrelevant")
    rows = rows.select("doc_id", "n_chars", F.col("source").alias("topic_id"), F.col("doc_id").cast("string").alias("pmid"), (F.col("toxic") == 0).alias("eligible"), kind.alias("relevance_class"))
    rows = rows.withColumn("said", F.when(F.col("relevance_class") == "irrelevant", "excluded_irrelevant").otherwise(F.concat(F.lit("included_"), "relevance_class")))
    rows = stage.keep(rows, "rows")
    n, i = F.col("n_chars"), F.col("doc_id")
    judged = rows.filter("eligible and relevance_class <> 'irrelevant'").select(
        "topic_id",
        "pmid",
        "relevance_class",
        F.lit(["safety"]).alias("query_intents"),
        F.when(n % 2 == 0, F.lit(["safety"])).otherwise(F.lit(["efficacy"])).alias("article_intents"),
        F.lit("clinical_evidence").alias("content_role"),
        (n % 60).cast("int").alias("relevance_score"),
        F.when(n >= 2000, "higher_strength").when(n >= 500, "moderate_strength").otherwise("limited_strength").alias("evidence_tier"),
        F.get(F.lit(["randomized_controlled_trial", "prospective_cohort", "case_report", "narrative_review"]), (i % 4).cast("int")).alias("design_family"),
        F.slice(F.lit(["small_sample", "single_center"]), 1, (i % 3).cast("int")).alias("limitation_codes"),
        n.cast("int").alias("sample_size"),
        F.lit("reported").alias("sample_size_status"),
        F.lit("human").alias("population_scope"),
        F.lit("reported").alias("comparator_status"),
        F.when(n >= 1000, "key_evidence").otherwise("important_updates").alias("section"),
        (i % 100).cast("int").alias("overall_score"),
        F.date_add(F.to_date(F.lit("2020-01-01")), (i % 365).cast("int")).alias("publication_date"),
    )
    out = decide(rows.select("topic_id", "pmid", "said", "relevance_class", "eligible"), judged, limit=10, cap=3, stage=stage)
    return counters.at_the_end(out.withColumn("rank", F.col("rank").cast("long")))


@query(_TRIAGE)
def evidence_triage(spark, d):
    """The flagship (J1-J4, W1, W3, C26-C28, O2): first of each text, eligibility, the eleven keys within a topic, ten rows, placement with a cap."""
    return _decided(spark, d).drop("relevance_class", "eligible")


@query(
    f"""with x as ({_TRIAGE}), c as (select x.*, e.lang, l.toxic from x join documents e on cast(e.doc_id as varchar) = x.pmid join labels l using (doc_id))
select 'documents' as query, 10 as report_limit, (select count(*) from documents) as raw_candidate_count, (select count(distinct text) from documents) as candidate_count, (select count(*) - count(distinct text) from documents) as duplicate_count,
count(*) filter (decision like 'included%') as included_count, count(*) filter (decision in ('excluded_irrelevant', 'excluded_report_limit')) as excluded_count, count(*) filter (lang = 'en') as direct_count,
count(*) filter (lang = 'de') as class_level_count, count(*) filter (lang = 'fr') as contextual_count, count(*) filter (lang not in ('en', 'de', 'fr')) as irrelevant_count,
count(*) filter (decision = 'excluded_irrelevant') as excluded_irrelevant_count, count(*) filter (decision = 'excluded_report_limit') as excluded_report_limit_count, count(*) filter (toxic <> 0) as excluded_integrity_count from c"""
)
def observed_quality(spark, d):
    """A3: all counters of the triage, observed while it runs; SQL counts its rows afterwards."""
    from sievelake.plans.triage import Counters

    counters = Counters("documents", report_limit=10)
    _decided(spark, d, counters).write.format("noop").mode("overwrite").save()
    found = {k: v for k, v in counters.summary().items() if v is not None}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'string' if k == 'query' else 'int' if k == 'report_limit' else 'long'}" for k in found))


@query(
    """select count(*) as candidates, count_if(o_orderstatus = 'F') as included_direct, count_if(o_orderstatus = 'O') as excluded_report_limit, count_if(o_orderstatus = 'P') as excluded_integrity,
o_orderpriority as topic_id from orders group by o_orderpriority"""
)
def quality_counters(spark, d):
    """A3: candidates by what became of them."""
    from sievelake.plans.triage import quality

    decision = X.lookup({"F": "included_direct", "O": "excluded_report_limit", "P": "excluded_integrity"}, F.col("o_orderstatus"), "excluded_irrelevant")
    return quality(t(spark, d, "orders").select(F.col("o_orderpriority").alias("topic_id"), decision.alias("decision"))).select("topic_id", "candidates", "included_direct", "excluded_report_limit", "excluded_integrity")


@query(
    """with s as (select user_id, max(case event_type when 'error' then 3 when 'purchase' then 2 when 'click' then 1 else 0 end) as p,
  count(distinct case when event_type in ('error', 'purchase', 'click') then event_type end) as kinds from events group by 1)
select user_id, case p when 3 then 'retracted' when 2 then 'expression_of_concern' when 1 then 'corrected_or_updated' else 'no_signal' end as status, 'primary_article' as record_role,
  kinds > 1 or p = 2 as needs_review, p <= 1 as eligible, cast(kinds as integer) as signals from s"""
)
def integrity_rollup(spark, d):
    """Each user's events as the integrity relations of one article."""
    from sievelake.operators.integrity import with_integrity

    kinds = {"error": "retraction_in", "purchase": "expression_of_concern_in", "click": "erratum_in"}
    relation = F.struct(X.lookup(kinds, F.col("event_type"), "comment_in").alias("normalized_relation"), F.col("event_type").alias("raw_ref_type"), F.lit("1").alias("related_pmid"), F.lit("").alias("related_doi"))
    rows = t(spark, d, "events").groupBy("user_id").agg(F.collect_set(relation).alias("integrity_relations")).withColumn("publication_types", F.lit(["journal article"]))
    out = with_integrity(rows)
    return out.select("user_id", "integrity.status", "integrity.record_role", "integrity.needs_review", F.col("integrity.report_eligible").alias("eligible"), F.size("integrity.supporting_signals").alias("signals"))


_MESH = "array<struct<text:string,ui:string,major_topic:boolean,supporting_pmid:string>>"


@query(
    """with p as (select p_partkey, ' ' || lower(p_name) || ' ' as n from part), c as (select p_partkey, n like '% red %' as drug, n like '% widget %' as condition from p)
select p_partkey, case when drug and condition then 'direct' when condition then 'contextual' else 'irrelevant' end as relevance_class,
  cast(case when drug and condition then 30 else 0 end + case when condition then 30 else 0 end as integer) as relevance_score,
  case when drug then 'target_intervention_primary' else 'unknown' end as focus, case when drug and condition then 'coherent' when condition then 'background_only' else 'not_established' end as coherence,
  'human' as population, case when drug then 'primary_intervention' else 'unresolved' end as requested_role from c"""
)
def score_caps(spark, d):
    """Names as titles, judged against one target."""
    from sievelake.operators.relevance import parse_target, with_relevance

    p = t(spark, d, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        F.lit("Efficacy in patients.").alias("abstract"),
        F.array(F.lit("Journal Article")).alias("publication_types"),
        F.expr("cast(array() as array<struct<label:string,text:string>>)").alias("abstract_sections"),
        F.expr("cast(array() as array<string>)").alias("keywords"),
        F.expr(f"cast(array() as {_MESH})").alias("mesh_descriptors"),
    )
    out = with_relevance(p, parse_target("red for widget efficacy", "red", "widget", query_intents=("efficacy",)))
    return out.select("p_partkey", *[F.col(f"relevance.{c}").alias(c) for c in ("relevance_class", "relevance_score", "focus", "coherence", "population", "requested_role")])


@query("select p_partkey, case when p_type like '%PROMO%' then 'guideline' when p_type like '%ECONOMY%' then 'systematic_review' when p_size < 10 then 'observational' else 'other' end as level from part")
def first_rule_wins(spark, d):
    """The first level that one of the publication types names."""
    kind = F.col("p_type")
    types = F.array_compact(F.array(F.when(F.col("p_size") < 10, "Observational Study"), F.when(kind.contains("ECONOMY"), "Systematic Review"), F.when(kind.contains("PROMO"), "Practice Guideline"), F.lit("Journal Article")))
    return t(spark, d, "part").select("p_partkey", X.evidence_level(types).alias("level"))


@query(
    """with c as (select o_orderkey, o_orderkey % 9 as f, case o_orderstatus when 'F' then 'reported' else 'unclear' end as status, case when o_totalprice > 300000 then 'preclinical_only' else 'human' end as scope, o_orderkey % 5 <> 0 as has from orders)
select o_orderkey, case when scope = 'preclinical_only' or f = 0 then 'preclinical' when f = 1 then 'signal_only' when f = 2 or not has then 'not_assessable' when f in (3, 4) then case status when 'reported' then 'higher_strength' else 'moderate_strength' end
  when f = 5 then 'moderate_strength' when f in (6, 7) then case status when 'reported' then 'moderate_strength' else 'limited_strength' end else 'limited_strength' end as tier from c"""
)
def study_tiers(spark, d):
    """C13."""
    from sievelake.operators.study import evidence_tier

    families = ["in_vitro", "pharmacovigilance_disproportionality", "protocol", "randomized_controlled_trial", "systematic_review_meta_analysis", "systematic_review_without_meta_analysis", "case_control", "prospective_cohort", "case_report"]
    k = F.col("o_orderkey")
    family, status, scope = F.get(F.lit(families), (k % 9).cast("int")), F.when(F.col("o_orderstatus") == "F", "reported").otherwise("unclear"), F.when(F.col("o_totalprice") > 300000, "preclinical_only").otherwise("human")
    return t(spark, d, "orders").select("o_orderkey", evidence_tier(family, status, scope, k % 5 != 0).alias("tier"))


@query(
    """select p_partkey, cast(p_size + 100 as integer) as sample_size, 'reported' as sample_size_status, 'placebo' as comparator, 'Acyclovir' as name, cast(p_size as varchar) as dose, 'twice daily' as frequency,
  'received Acyclovir ' || p_size || ' mg oral twice daily for ' || p_size || ' days' as treatment_duration, 'followed for ' || p_size || ' weeks' as follow_up, 'or' as measure,
  case when p_size % 2 = 0 then 1 else 0 end as safety from part"""
)
def extracted_fields(spark, d):
    """Sections made of each part's size, read by the extraction."""
    from sievelake.operators.extraction import with_extraction
    from sievelake.plans.stage import spread

    n = F.col("p_size").cast("string")
    methods = F.concat(
        (F.col("p_size") + 100).cast("string"), F.lit(" patients were enrolled. They received Acyclovir "), n, F.lit(" mg oral twice daily for "), n, F.lit(" days compared with placebo. Patients were followed for "), n, F.lit(" weeks.")
    )
    results = F.concat(F.lit("Overall healing time improved OR 1.5, p < 0.05."), F.when(F.col("p_size") % 2 == 0, " Nausea was seen in two.").otherwise(""))
    parts = F.array(F.struct(F.lit("METHODS").alias("label"), methods.alias("text")), F.struct(F.lit("RESULTS").alias("label"), results.alias("text")))
    articles = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.lit("").alias("abstract"), parts.alias("abstract_sections"))
    x = with_extraction(spread(articles))
    drug, e = F.get("extraction.interventions", 0), "extraction"
    return x.select(
        "p_partkey", f"{e}.sample_size", f"{e}.sample_size_status", F.col(f"{e}.comparator.kind").alias("comparator"), drug["name"].alias("name"), drug["dose"].alias("dose"), drug["frequency"].alias("frequency"),
        f"{e}.treatment_duration", f"{e}.follow_up", F.get(f"{e}.outcomes", 0)["measure"].alias("measure"), F.size(f"{e}.safety").alias("safety"),
    )


@query(
    """select o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, case when o_totalprice > 300000 then 0 else 2 end, -floor(o_totalprice / 1000), -(o_orderkey % 30), cast(o_orderkey as varchar)) as rank from orders"""
)
def legacy_rank(spark, d):
    """O1."""
    o = t(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        X.lookup({"F": "key_evidence", "O": "important_updates"}, F.col("o_orderstatus"), "exploratory_evidence").alias("section"),
        F.when(F.col("o_totalprice") > 300000, "higher_strength").otherwise("limited_strength").alias("evidence_tier"),
        F.floor(F.col("o_totalprice") / 1000).alias("overall_score"),
        F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("o_orderkey") % 30).cast("int")).alias("publication_date"),
        F.col("o_orderkey").cast("string").alias("pmid"),
    )
    keys = ranking.legacy_keys()
    return ranking.total_rank(o, keys[:2], keys[2:], group=["o_custkey"]).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


# ---- snapshots

_SCOPES = "c as (select c_custkey, case c_custkey % 4 when 0 then null when 1 then ' a ' when 2 then 'b' else '' end as t0, case c_custkey % 3 when 0 then 'a' when 1 then 'b' end as t1, case when c_custkey % 5 > 0 then 'q' || c_custkey % 5 end as q0, case when c_custkey % 2 = 0 then 'q1' else 'q2' end as q1 from customer)"


@query(
    f"""with {_SCOPES}, k as (select *, nullif(trim(t0), '') as a, nullif(trim(t1), '') as b from c)
select c_custkey, case when a is null and b is null then 'topic_unavailable' when a is null or b is null then 'topic_partially_unavailable' when a <> b then 'incomparable' else 'same_topic' end as scope,
  case when a = b then case when q0 is null or q1 is null then 'unavailable' when q0 <> q1 then 'changed' else 'same' end end as query_status from k"""
)
def snapshot_scopes(spark, d):
    """D3: what can be compared."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").select(
        "c_custkey",
        F.when(k % 4 == 1, " a ").when(k % 4 == 2, "b").when(k % 4 == 3, "").alias("t0"),
        F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").alias("t1"),
        F.when(k % 5 > 0, F.concat(F.lit("q"), (k % 5).cast("string"))).alias("q0"),
        F.when(k % 2 == 0, "q1").otherwise("q2").alias("q1"),
    )
    return c.select("c_custkey", snapshots.scope_of(F.col("t0"), F.col("t1"), F.col("q0"), F.col("q1")).alias("s")).select("c_custkey", "s.scope", "s.query_status")


@query(
    """with b as (select o_orderkey, o_orderkey % 2 = 0 as relevance, case when o_orderkey % 3 > 0 then o_orderkey % 3 = 1 end as study from orders), n as (select o_orderkey, o_orderkey % 4 = 0 as relevance, case when o_orderkey % 6 > 0 then o_orderkey % 3 = 1 end as study from orders)
select o_orderkey, b.relevance or coalesce(b.study, false) as was, n.relevance or coalesce(n.study, false) as now, concat_ws(',', case when b.relevance is distinct from n.relevance then 'relevance' end, case when b.study is distinct from n.study then 'study' end) as sources
from b join n using (o_orderkey) where b.relevance is distinct from n.relevance or b.study is distinct from n.study"""
)
def review_requirements(spark, d):
    """D7."""
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select("o_orderkey")
    b = o.select("o_orderkey", (k % 2 == 0).alias("relevance"), F.when(k % 3 > 0, k % 3 == 1).alias("study"))
    n = o.select("o_orderkey", (k % 4 == 0).alias("relevance"), F.when(k % 6 > 0, k % 3 == 1).alias("study"))
    r = snapshots.review_changes(b, n, "o_orderkey", ("relevance", "study"))
    return r.select("o_orderkey", "was", "now", F.array_join("sources", ",").alias("sources"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag, l_orderkey order by l_linenumber, l_partkey) as occurrence from lineitem")
def unmatched_occurrences(spark, d):
    """W7, O6."""
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return snapshots.occurrences(rows, "l_returnflag", "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", F.col("occurrence").cast("long").alias("occurrence"))


@query("select c_custkey, sha256(c_name || ':' || c_mktsegment || ':v1:v2') as comparison_id from customer")
def comparison_ids(spark, d):
    """D11."""
    return t(spark, d, "customer").select("c_custkey", snapshots.comparison_id(F.col("c_name"), F.col("c_mktsegment"), ("v1", "v2")).alias("comparison_id"))


@query("select event_id, 1 as n_leaves, 'k' as path, cast(json_extract(props, '$.k') as varchar) as value from events")
def json_leaf_rows(spark, d):
    """the leaves of each event's properties."""
    rows = leaf_table(t(spark, d, "events").select("event_id", F.parse_json("props").alias("doc")), ["event_id"], "doc")
    return rows.groupBy("event_id").agg(F.count("*").cast("int").alias("n_leaves"), F.min("path").alias("path"), F.min("value").alias("value"))


@query("""select c_custkey, '{"c_custkey":' || c_custkey || ',"segment":' || case when c_nationkey > 5 then '"' || c_mktsegment || '"' else 'null' end || '}' as document from customer""")
def documents_with_nulls(spark, d):
    """P12."""
    c = t(spark, d, "customer").withColumn("segment", F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")))
    return c.select("c_custkey", snapshots.to_document(["c_custkey", "segment"]).alias("document"))


@query("select c_custkey, case when v is null or v in ('', 'unknown', 'unclear', 'not_reported', 'not_extractable', 'not_applicable') then 'Not reported' else upper(substr(replace(v, '_', ' '), 1, 1)) || lower(substr(replace(v, '_', ' '), 2)) end as shown from (select c_custkey, case c_custkey % 5 when 0 then null when 1 then '' when 2 then 'not_reported' when 3 then 'usual_CARE' else c_mktsegment end as v from customer)")
def displayed_values(spark, d):
    """F24, P18."""
    k = F.col("c_custkey")
    v = F.when(k % 5 == 1, "").when(k % 5 == 2, "not_reported").when(k % 5 == 3, "usual_CARE").when(k % 5 == 4, F.col("c_mktsegment"))
    return t(spark, d, "customer").select("c_custkey", X.display_value(v).alias("shown"))


# ---- evaluation

_FIELDS = {"population": 3, "comparator": 5}


@query(
    "with j as ("
    + " union all ".join(f"select '{f}' as field, o_orderkey % {m} > 0 as scored, o_orderkey % {m + 1} > 0 as correct, o_orderkey % {m + 2} > 0 as accepted, o_orderkey % {m + 4} > 0 as sourced, o_orderkey % {m + 6} = 0 as malformed from orders" for f, m in _FIELDS.items())
    + """), v as (select *, correct and sourced and not malformed as valid from j),
c as (select field, count_if(scored) as applicable, count_if(accepted) as accepted, count_if(not accepted) as abstained, count_if(accepted and valid) as correct, count_if(not accepted and valid) as correct_abstentions, count_if(not valid) as incorrect,
  count_if(accepted and (not correct or not sourced)) as unsupported, count_if(malformed) as malformed, count_if(not sourced) as provenance_failures from v group by field)
select *, round(coalesce(correct / nullif(accepted, 0), 1.0), 6) as precision, round(coalesce(correct / nullif(applicable, 0), 1.0), 6) as coverage from c"""
)
def evaluation_counters(spark, d):
    """A20."""
    k = F.col("o_orderkey")
    cols = [x for f, m in _FIELDS.items() for x in ((k % m > 0).alias(f"{f}_scored"), (k % (m + 1) > 0).alias(f"{f}_correct"), (k % (m + 2) > 0).alias(f"{f}_accepted"), (k % (m + 4) > 0).alias(f"{f}_sourced"), (k % (m + 6) == 0).alias(f"{f}_malformed"))]
    r = metrics.field_counters(t(spark, d, "orders").select(*cols), list(_FIELDS))
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "coverage")})


@query("select 'o_orderstatus' as field, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2")
def frequency_tables(spark, d):
    """A21."""
    return metrics.frequencies(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select doc_id, case when quality = 1 then 'direct' end as gold from labels where toxic = 0 and quality = 1")
def label_choice(spark, d):
    """Q10: adjudicated rows with a class."""
    rows = t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, "adjudicated").otherwise("draft").alias("status"), F.when(F.col("quality") == 1, "direct").alias("gold"))
    return metrics.chosen_labels(rows, "status", "gold").select("doc_id", "gold")


@query("select l_orderkey, l_linenumber, l_returnflag as predicted, coalesce(m.g, o_orderstatus) as expected from lineitem join orders on l_orderkey = o_orderkey left join (select o_orderkey as k, o_orderpriority as g from orders where o_orderkey % 7 = 0) m on m.k = l_orderkey")
def gold_with_override(spark, d):
    """J15, J20."""
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("predicted"))
    orders = t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    gold, more = orders.withColumn("value", F.col("o_orderstatus")), orders.filter("l_orderkey % 7 = 0").withColumn("value", F.col("o_orderpriority"))
    return metrics.with_override(lines, gold, more, ["l_orderkey"], "value")


# ---- vocabulary

_CLASSES = "c as (select l_suppkey as member, l_partkey % 20 as class_id, l_orderkey, l_linenumber, 'class ' || l_linenumber as label, case l_returnflag when 'A' then 'atc' when 'N' then 'MEDRT' else 'VA' end as source, case when l_quantity > 25 then 'ISA' else 'may_treat' end as relation from lineitem)"


@query(f"with {_CLASSES} select member, class_id, arg_max(label, (l_orderkey, l_linenumber)) as label, arg_max(source, (l_orderkey, l_linenumber)) as source from c where upper(source) in ('ATC', 'MEDRT') and lower(relation) in ('has_member', 'isa', 'part_of') group by 1, 2")
def approved_parent_classes(spark, d):
    """S10, Q8, A12."""
    source = X.lookup({"A": "atc", "N": "MEDRT"}, F.col("l_returnflag"), "VA")
    c = t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("member"), (F.col("l_partkey") % 20).alias("class_id"), "l_orderkey", "l_linenumber", F.concat(F.lit("class "), F.col("l_linenumber").cast("string")).alias("label"),
        source.alias("source"), F.when(F.col("l_quantity") > 25, "ISA").otherwise("may_treat").alias("relation"),
    )
    return vocabulary.parent_classes(c, "member", "class_id", "label", "source", "relation", F.struct("l_orderkey", "l_linenumber")).select("member", "class_id", "label", "source")


@query(
    """with f as (select l_orderkey, l_partkey, min(l_linenumber) as nr from lineitem group by 1, 2)
select l_orderkey, cast(row_number() over (partition by l_orderkey order by nr, l_partkey) - 1 as integer) as position, l_partkey, p_name from f left join part on l_partkey = p_partkey"""
)
def term_properties(spark, d):
    """S9."""
    found = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    names = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return vocabulary.lookup_ids(found, names, "l_orderkey", "l_partkey", F.col("l_linenumber")).select("l_orderkey", "position", "l_partkey", "p_name")


@query("select c_custkey, sha256(lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g')))) as key from customer")
def lookup_cache_keys(spark, d):
    """S11."""
    return t(spark, d, "customer").select("c_custkey", vocabulary.cache_key(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("key"))


# ---- regulatory rows


@query(
    """with c as (select l_orderkey, l_linenumber, case when l_quantity > 48 then ' ' else cast(l_partkey % 50 as varchar) end as key, case when l_linenumber = 7 then 'odd' else 'present' end as state, l_returnflag as value, case when l_discount > 0.09 then 'X' else l_returnflag end as raw from lineitem),
g as (select l_orderkey, bool_or(trim(key) = '') as blank, count(distinct trim(key)) < count(*) as twice, bool_or(state = 'odd') as odd, bool_or(case when state = 'present' then value <> raw else true end) as mapped from c group by 1)
select l_orderkey, 'lines' as place, unnest(list_filter([case when blank then 'blank_key' end, case when twice then 'duplicate_key' end, case when odd then 'unknown_state' end, case when mapped then 'raw_mapping' end], lambda x: x is not null)) as fault from g"""
)
def regulatory_violations(spark, d):
    """Faults of each order's lines as the children of one record."""
    from sievelake.operators.regulatory import child_faults, violations

    line = F.struct(
        F.when(F.col("l_quantity") > 48, " ").otherwise((F.col("l_partkey") % 50).cast("string")).alias("key"), F.when(F.col("l_linenumber") == 7, "odd").otherwise("present").alias("state"),
        F.col("l_returnflag").alias("value"), F.when(F.col("l_discount") > 0.09, "X").otherwise(F.col("l_returnflag")).alias("raw"),
    )
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    return violations(rows, "l_orderkey", {"lines": child_faults(F.col("lines"), "key", "value", "state", "raw")})


@query(
    """with c as (select 'whole' as case_name, source, doc_id from documents union all select 'short', source, doc_id from documents where doc_id % 50 <> 7 union all select 'source lost', source, doc_id from documents where source <> (select min(source) from documents)),
e as (select count(*) as n, count(distinct source) as k from documents)
select case_name, count(*) as rows, count(distinct source) as ids, any_value(n) as declared_rows, any_value(k) as declared_ids, count(*) = any_value(n) and count(distinct source) = any_value(k) as verified from c, e group by case_name"""
)
def generation_check(spark, d):
    """What was published against the envelope that was declared: the whole table, one that lost rows, one that lost a source."""
    from sievelake.operators.regulatory import envelope, verify_generation

    docs = t(spark, d, "documents").select("doc_id", "source")
    declared = envelope(docs.select("source"), "documents", "2020-01-01")
    first = docs.agg(F.min("source").alias("least"))
    cases = {"whole": docs, "short": docs.filter("doc_id % 50 <> 7"), "source lost": docs.join(F.broadcast(first), docs["source"] != F.col("least")).drop("least")}  # one row
    out = None
    for name, published in cases.items():
        row = verify_generation(published, declared, "source", "source").select(F.lit(name).alias("case_name"), "rows", "ids", "declared_rows", "declared_ids", "verified")
        out = row if out is None else out.union(row)
    return out


@query(
    """with w as (select p_partkey, p_size, lower(unnest(string_split(p_name, ' '))) as term from part), s as (select term, p_size % 3 as part, count(distinct p_partkey) as df, cast(max(p_size) * 2 as double) as score from w group by 1, 2)
select term, max(score) as score, arg_max(df, (score, df)) as document_frequency, arg_max(df, (score, df)) >= 2 and max(score) >= 60 as accepted, 'topic' as query from s group by 1"""
)
def topic_profile(spark, d):
    """The best score of each term."""
    from sievelake.operators.terms import build_profile

    w = t(spark, d, "part").select("p_partkey", "p_size", F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    scored = w.groupBy("term", F.col("p_size") % 3).agg(F.countDistinct("p_partkey").alias("document_frequency"), (F.max("p_size") * 2).cast("double").alias("score"))
    return build_profile(scored, "topic").select("term", "score", "document_frequency", "accepted", "query")


# ---- reports

_PLACED = "p as (select source as topic_id, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank, lang, case doc_id % 3 when 0 then 'key_evidence' when 1 then 'audit_only' else 'early_safety_signals' end as section from documents), k as (select * from p where rank <= 10)"
_PLACE = "case section when 'key_evidence' then 0 when 'early_safety_signals' then 2 else 8 end"
_NAME = "case section when 'key_evidence' then 'Key evidence' when 'early_safety_signals' then 'Early safety signals' else 'Audit only' end"


@query(
    f"""with {_PLACED} select topic_id, {_PLACE} as section_place, 1 as kind, rank, '- **Document \\_' || doc_id || '\\_** Language: ' || upper(substr(lang, 1, 1)) || substr(lang, 2) as line from k
union all select topic_id, {_PLACE}, 0, 0, '## ' || {_NAME} || ' (' || count(*) || ')' from k group by topic_id, section"""
)
def report_lines(spark, d):
    """K2, K3, section 2.17: headings and cards of ten rows a topic."""
    from sievelake.operators.report import section_lines

    docs = t(spark, d, "documents").select(F.col("source").alias("topic_id"), "doc_id", "n_chars", "lang", F.get(F.lit(["key_evidence", "audit_only", "early_safety_signals"]), (F.col("doc_id") % 3).cast("int")).alias("section"))
    best = metrics.top_k(docs, ["topic_id"], [F.col("n_chars").desc(), F.col("doc_id")], 10, "rank")
    return section_lines(best.withColumn("title", F.concat(F.lit("Document _"), F.col("doc_id").cast("string"), F.lit("_"))), ["topic_id"], "title", {"Language": "lang"})


@query("select c_mktsegment as code, '- ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' (' || count(*) || ')' as line from customer group by 1")
def warning_section(spark, d):
    """Section 2.17: warnings with their counts."""
    from sievelake.operators.report import warning_lines

    return warning_lines(t(spark, d, "customer").select(F.col("c_mktsegment").alias("code")), "code")
