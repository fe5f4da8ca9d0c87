"""The reference operators on the driver's tables: one query each, with the SQL that must give the same rows.

Each query names in its docstring the operators that it exercises.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.functions import text as X
from sievelake.operators import diff, metrics, ranking, records, terms
from sievelake.plans import clinical, literature, matching, nested  # noqa: F401  they register their queries
from sievelake.plans.catalog import QUERIES, SQL, Query, query, t
from sievelake.plans.stage import small_batches

evidence_triage = literature.evidence_triage


# ---- dedup, keys, lookups


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by text order by doc_id) as n from documents) where n = 1")
def dedup_first_wins(spark, d):
    """A1: the first document of each text."""
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return records.first_wins(docs.drop("text"), ["digest"], F.col("doc_id")).select("doc_id", "source", "n_chars")


@query("select min(doc_id) as first_id, count(*) as n from documents group by text having count(*) > 1")
def duplicate_key_list(spark, d):
    """Texts of more than one document, with their first."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return records.repeated_keys(docs, ["digest"]).join(records.first_wins(docs, ["digest"], F.col("doc_id")), "digest").select(F.col("doc_id").alias("first_id"), "n")


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by all")
def edge_dedup_last_wins(spark, d):
    """The last event of each user and type."""
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return records.last_wins(e, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size > 2)")
def orphan_check(spark, d):
    """Lines whose part isn't among those that count."""
    parts = t(spark, d, "part").filter("p_size > 2").select(F.col("p_partkey").alias("l_partkey"))
    return records.orphans(t(spark, d, "lineitem"), parts, ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query(
    """with terms as (select distinct p_partkey, case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then '  ' || lower(p_type) || ' ' else 'no ' || p_type end as term from part),
vocab as (select p_type as label, min(p_partkey) as code from part group by 1)
select p_partkey, term, coalesce(cast(e.code as varchar), cast(l.code as varchar), 'unresolved:' || substr(sha256(term), 1, 16)) as code,
  case when e.code is not null then 'exact' when l.code is not null then 'normalized' else 'unresolved' end as match_method
from terms left join vocab e on e.label = term left join vocab l on lower(trim(l.label)) = lower(trim(term))"""
)
def vocab_two_tier_lookup(spark, d):
    """Exact, then normalised, then a made code."""
    p = t(spark, d, "part")
    term = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("  "), F.lower("p_type"), F.lit(" "))).otherwise(F.concat(F.lit("no "), F.col("p_type")))
    vocab = p.groupBy(F.col("p_type").alias("label")).agg(F.min("p_partkey").alias("code"))
    return records.two_tier_lookup(p.select("p_partkey", term.alias("term")).distinct(), vocab, "term", "label", "code", X.space_form)


# ---- ranking, limits, placement

_PRIORITY = "cast(substr(o_orderpriority, 1, 1) as integer)"


@query(
    f"select o_orderkey, row_number() over (order by {_PRIORITY}, least(floor(o_totalprice / 1000), 10000) desc, o_orderdate desc, cast(o_orderkey as varchar)) as rank from orders"
)
def rank_total_order(spark, d):
    """Priority, bounded price, newest, key as text."""
    o = t(spark, d, "orders")
    price = -F.least(F.floor(F.col("o_totalprice") / 1000), F.lit(10_000))
    return ranking.total_rank(o, [F.substring("o_orderpriority", 1, 1).cast("int"), price], [F.col("o_orderdate").desc(), F.col("o_orderkey").cast("string")]).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"select o_orderkey, o_totalprice from orders order by {_PRIORITY}, o_totalprice desc, cast(o_orderkey as varchar) limit 10")
def topk_report_limit(spark, d):
    """The report's ten rows; Spark takes the ten best of every task."""
    return t(spark, d, "orders").orderBy(F.substring("o_orderpriority", 1, 1).cast("int"), F.col("o_totalprice").desc(), F.col("o_orderkey").cast("string")).limit(10).select("o_orderkey", "o_totalprice")


@query(
    """with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders where o_orderstatus <> 'F')
select o.o_orderkey, case when o.o_orderstatus = 'F' then 'excluded_rule' when r.n <= 3 then 'included' else 'excluded_report_limit' end as decision from orders o left join r using (o_orderkey)"""
)
def exclusion_audit(spark, d):
    """Every order with what became of it, three a customer."""
    ok = F.col("o_orderstatus") != "F"
    place = F.row_number().over(Window.partitionBy("o_custkey", ok).orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return ranking.audit(t(spark, d, "orders").withColumn("place", place), ok, "place", 3, F.lit("excluded_rule")).select("o_orderkey", "decision")


@query(
    """with s as (select *, case when p_size < 5 then 'audit_only' when p_type = 'PROMO' then 'signals' else 'key_evidence' end as s0 from part),
r as (select *, sum(case when s0 = 'key_evidence' then 1 else 0 end) over (partition by p_brand order by p_retailprice desc, p_partkey rows unbounded preceding) as run from s)
select p_partkey, case when s0 = 'key_evidence' and run > 10 then 'additional_selected_evidence' else s0 end as section, case when s0 = 'key_evidence' and run > 10 then 'collapsed' else 'full' end as display from r"""
)
def placement_running_cap(spark, d):
    """Ten principal rows a brand, the rest collapsed."""
    section = F.when(F.col("p_size") < 5, "audit_only").when(F.col("p_type") == "PROMO", "signals").otherwise("key_evidence")
    return ranking.place_with_cap(t(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], section, "key_evidence", 10).select("p_partkey", "section", "display")


@query(
    """with p as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as n from part)
select p_brand, p_partkey, case when n <= 3 then 'core' else 'related' end as kind from p where n <= 8"""
)
def concept_summary_topn(spark, d):
    """Three core rows, then five related ones."""
    best = metrics.top_k(t(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 8)
    return best.select("p_brand", "p_partkey", F.when(F.col("position") <= 3, "core").otherwise("related").alias("kind"))


# ---- filters and joins


@query("select d.doc_id, d.lang from documents d join labels l using (doc_id) where quality = 1 and toxic = 0 and n_chars >= 200")
def filter_eligible(spark, d):
    """Q1, Q4."""
    return t(spark, d, "documents").filter("n_chars >= 200").join(t(spark, d, "labels").filter("quality = 1 and toxic = 0"), "doc_id").select("doc_id", "lang")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_supporting(spark, d):
    """J10."""
    return t(spark, d, "documents").join(t(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def anti_unlabelled(spark, d):
    """J4."""
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("select c_custkey, coalesce(n_name, '?') as n_name, coalesce(n_nationkey, 999) as position from customer left join (select * from nation where n_nationkey < 20) n on c_nationkey = n_nationkey")
def left_join_coalesce_order(spark, d):
    """Rows without a place go last."""
    n = t(spark, d, "nation").filter("n_nationkey < 20").select("n_nationkey", "n_name")
    return t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("?")).alias("n_name"), F.coalesce("n_nationkey", F.lit(999)).alias("position"))


@query("select l.l_orderkey, l.l_linenumber, g.gold from lineitem l join (select l_orderkey, l_linenumber, l_returnflag || l_linestatus as gold from lineitem where l_quantity > 45) g using (l_orderkey, l_linenumber)")
def composite_key_join(spark, d):
    """J5."""
    lines = t(spark, d, "lineitem")
    gold = lines.filter("l_quantity > 45").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("gold"))
    return lines.select("l_orderkey", "l_linenumber").join(gold, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "gold")


@query("select s_suppkey, count(l_orderkey) as n from supplier left join lineitem on s_suppkey = l_suppkey and l_quantity > 49 group by 1")
def link_counts(spark, d):
    """Counts, none being 0; lines are counted before the join."""
    n = t(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return t(spark, d, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


_LABELS = ("red", "blue widget", "ring", "bolt")


@query(
    "select p_partkey, case " + " ".join(f"when ' ' || p_name || ' ' like '% {x} %' then '{x}'" for x in _LABELS) + " end as label from part where " + " or ".join(f"' ' || p_name || ' ' like '% {x} %'" for x in _LABELS)
)
def theta_containment_join(spark, d):
    """The first label that a name holds, as one projection rather than a nested loop."""
    name = X.relevance_form(F.col("p_name"))
    label = F.coalesce(*[F.when(X.has_phrase(name, F.lit(x)), F.lit(x)) for x in _LABELS])
    return t(spark, d, "part").select("p_partkey", label.alias("label")).filter("label is not null")


# ---- comparison of snapshots


def _versions(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    base = o.filter("o_orderkey % 10 <> 0")
    new = o.filter("o_orderkey % 10 <> 1")
    new = new.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "unclear").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")))
    return base, new


_VERSIONS = """base as (select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey % 10 <> 0),
new as (select o_orderkey, case when o_orderkey % 7 = 0 then 'unclear' else o_orderstatus end as o_orderstatus, case when o_orderkey % 11 <> 0 then o_orderpriority end as o_orderpriority from orders where o_orderkey % 10 <> 1)"""


@query(f"with {_VERSIONS} select coalesce(b.o_orderkey, n.o_orderkey) as o_orderkey, case when b.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' else 'both' end as membership from base b full join new n on b.o_orderkey = n.o_orderkey")
def full_outer_membership(spark, d):
    """J6, U1, D4."""
    return diff.membership(*_versions(spark, d), "o_orderkey")


_CHANGES = f"""with {_VERSIONS}, j as (select b.o_orderkey, b.o_orderstatus as bs, n.o_orderstatus as ns, b.o_orderpriority as bp, n.o_orderpriority as np from base b join new n using (o_orderkey)),
c as (select o_orderkey, 'study' as category, 'changed' as change_type, 'o_orderstatus' as field_path, bs as baseline, ns as target, 4 as priority from j where bs is distinct from ns
union all select o_orderkey, 'ranking', 'changed', 'o_orderpriority', bp, np, 7 from j where bp is distinct from np)"""
_FIELDS = {"o_orderstatus": "study", "o_orderpriority": "ranking"}


@query(f"{_CHANGES} select *, substr(sha256(category || '|' || change_type || '|' || o_orderkey || '|' || field_path || '|' || coalesce(baseline, '<null>') || '|' || coalesce(target, '<null>')), 1, 16) as change_id from c")
def field_change_records(spark, d):
    """D6, D9, D10, D12, O5."""
    return diff.with_identity(diff.field_changes(*_versions(spark, d), "o_orderkey", _FIELDS), "o_orderkey")


@query(f"{_CHANGES}, k as (select unnest(['integrity', 'membership', 'relevance', 'study', 'extraction', 'review', 'ranking', 'placement', 'comparability']) as category) select k.category, count(c.category) as n from k left join c using (category) group by 1")
def change_counts_zero_filled(spark, d):
    """A15, D11."""
    from sievelake.rules import CHANGE_PRIORITY

    found = diff.field_changes(*_versions(spark, d), "o_orderkey", _FIELDS).groupBy("category").agg(F.count("*").alias("n"))
    return metrics.zero_filled(found, "category", list(CHANGE_PRIORITY))


@query(
    f"""with {_VERSIONS}, j as (select o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) as field_path, unnest([b.o_orderstatus, b.o_orderpriority]) as baseline, unnest([n.o_orderstatus, n.o_orderpriority]) as target from base b join new n using (o_orderkey))
select *, case when baseline is null then 'added' when target is null then 'removed' when baseline not in ('unclear') and target in ('unclear') then 'accepted_to_abstention' else 'changed' end as change_type from j where baseline is distinct from target"""
)
def leaf_diff_types(spark, d):
    """D8, F31, J14, Q11."""
    return diff.leaf_changes(*_versions(spark, d), "o_orderkey", list(_FIELDS))


@query(
    """with b as (select c_custkey, case when c_custkey % 3 = 0 then 'present' when c_custkey % 3 = 1 then 'null' else 'absent' end as study, case when c_custkey % 2 = 0 then 'present' else 'absent' end as size from customer),
n as (select c_custkey, case when c_custkey % 4 = 0 then 'null' else 'present' end as study, 'present' as size from customer),
j as (select c_custkey, b.study as bs, n.study as ns, b.size as bz, n.size as nz from b join n using (c_custkey)),
c as (select c_custkey, 'study' as block, bs as x, ns as y from j where bs <> ns union all select c_custkey, 'size', bz, nz from j where bz <> nz and bs = ns)
select c_custkey, block, case when x <> 'present' and y = 'present' then 'became_comparable' when x = 'present' and y <> 'present' then 'became_not_comparable' else 'state_changed' end as change_type from c"""
)
def block_availability(spark, d):
    """A block below one whose state changed is left out."""
    c = t(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    base = c.select("c_custkey", F.when(k % 3 == 0, "present").when(k % 3 == 1, "null").otherwise("absent").alias("study"), F.when(k % 2 == 0, "present").otherwise("absent").alias("size"))
    new = c.select("c_custkey", F.when(k % 4 == 0, "null").otherwise("present").alias("study"), F.lit("present").alias("size"))
    return diff.block_changes(base, new, "c_custkey", {"study": None, "size": "study"})


# ---- metrics

_CLASSES = ("direct", "class_level", "contextual", "irrelevant")


def _judged(spark, d):
    o = t(spark, d, "orders")
    price = F.col("o_totalprice")
    gold = F.when(F.col("o_orderkey") % 4 == 0, "direct").when(F.col("o_orderkey") % 4 == 1, "class_level").otherwise("contextual")
    predicted = F.when(price > 400000, "direct").when(price > 250000, "class_level").when(price > 50000, "contextual").otherwise("irrelevant")
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", gold.alias("gold"), predicted.alias("predicted"))


_JUDGED = """j as (select *, case when o_orderkey % 4 = 0 then 'direct' when o_orderkey % 4 = 1 then 'class_level' else 'contextual' end as gold,
case when o_totalprice > 400000 then 'direct' when o_totalprice > 250000 then 'class_level' when o_totalprice > 50000 then 'contextual' else 'irrelevant' end as predicted from orders)"""
_EACH = "k as (select unnest(['direct', 'class_level', 'contextual', 'irrelevant']) as class)"
_PRF = f"""with {_JUDGED}, {_EACH}, s as (select class, cast(count_if(gold = class and predicted = class) as bigint) as tp, cast(count_if(predicted = class) as bigint) as p, cast(count_if(gold = class) as bigint) as support from k, j group by 1),
r as (select class, support, tp / nullif(p, 0) as precision, tp / nullif(support, 0) as recall from s), f as (select *, 2 * precision * recall / nullif(precision + recall, 0) as f1 from r)"""


@query(f"with {_JUDGED}, {_EACH} select class as gold, " + ", ".join(f"count(*) filter (where predicted = '{c}') as predicted_{c}" for c in _CLASSES) + " from k left join j on gold = class group by 1")
def confusion_matrix(spark, d):
    """A16."""
    return metrics.confusion(_judged(spark, d), "gold", "predicted", _CLASSES)


@query(f"{_PRF} select class, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f")
def per_class_prf(spark, d):
    """A17, F28."""
    r = metrics.per_class(_judged(spark, d), "gold", "predicted", _CLASSES)
    return r.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_PRF} select round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round((select count_if(gold = predicted) / count(*) from j), 6) as micro_f1 from f")
def macro_micro(spark, d):
    """A17."""
    j = _judged(spark, d)
    r = metrics.macro_micro(metrics.per_class(j, "gold", "predicted", _CLASSES), j, "gold", "predicted")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


_TOP = "p as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as n from (select d.*, l.quality from documents d join labels l using (doc_id)))"


@query(f"with {_TOP} select source, count(*) as n, round(count_if(quality = 1) / count(*), 6) as precision_at_10 from p where n <= 10 group by 1")
def precision_at_10(spark, d):
    """W4."""
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels"), "doc_id")
    r = metrics.precision_at_k(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], F.col("quality") == 1)
    return r.select("source", "n", F.round("precision_at_k", 6).alias("precision_at_10"))


@query("select count(*) as n, round(count_if(quality = 1) / count(*), 6) as precision_at_10 from (select quality from documents join labels using (doc_id) order by n_chars desc, doc_id limit 10)")
def pooled_precision_at_10(spark, d):
    """W4, over all sources."""
    docs = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id")
    return docs.orderBy(F.col("n_chars").desc(), "doc_id").limit(10).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if(F.col("quality") == 1), F.count("*")), 6).alias("precision_at_10"))


@query(
    f"""with {_TOP}, i as (select *, row_number() over (partition by source order by quality desc) as b from p)
select source, round(sum(case when n <= 10 then quality / log2(n + 1) else 0 end) / nullif(sum(case when b <= 10 then quality / log2(b + 1) else 0 end), 0), 6) as ndcg from i group by 1"""
)
def ndcg_at_10(spark, d):
    """W5."""
    docs = t(spark, d, "documents").select("doc_id", "source", "n_chars").join(t(spark, d, "labels"), "doc_id")
    return metrics.ndcg_at_k(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], F.col("quality").cast("double")).select("source", F.round("ndcg", 6).alias("ndcg"))


@query(
    """with j as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos, cast(substr(o_orderpriority, 1, 1) as integer) - 1 as deg from orders),
p as (select a.o_custkey, count_if(a.deg < b.deg) as concordant, count(*) as pairs from j a join j b on a.o_custkey = b.o_custkey and a.pos < b.pos and a.deg <> b.deg group by 1)
select o.o_custkey, cast(coalesce(concordant, 0) as bigint) as concordant, cast(coalesce(pairs, 0) as bigint) as pairs, round(concordant / nullif(pairs, 0), 6) as accuracy from (select distinct o_custkey from orders) o left join p using (o_custkey)"""
)
def pairwise_order_accuracy(spark, d):
    """Without making pairs."""
    o = t(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("pos"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("deg"))
    r = metrics.pairwise_order(o, ["o_custkey"], "pos", "deg", 5)
    return r.select("o_custkey", F.col("concordant").cast("long").alias("concordant"), F.col("pairs").cast("long").alias("pairs"), F.round("accuracy", 6).alias("accuracy"))


@query(
    """with s as (select l_orderkey, list(distinct l_returnflag) as a, list(distinct case when l_quantity > 25 then 'A' when l_discount > 0.05 then 'N' else 'R' end) as b from lineitem group by 1),
m as (select sum(len(list_intersect(a, b))) as c, sum(len(a)) as g, sum(len(b)) as p, count_if(list_sort(a) = list_sort(b)) as e, count(*) as n from s)
select round(c / p, 6) as precision, round(c / g, 6) as recall, round(e / n, 6) as exact, round(2 * (c / p) * (c / g) / (c / p + c / g), 6) as f1 from m"""
)
def set_match_micro(spark, d):
    """A18, A19, U5."""
    guess = F.when(F.col("l_quantity") > 25, "A").when(F.col("l_discount") > 0.05, "N").otherwise("R")
    s = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("gold"), F.collect_set(guess).alias("guess"))
    r = metrics.set_match(s, "gold", "guess")
    return r.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "exact", "f1")])


@query("select round(count_if(quality = 0 and toxic = 0) / nullif(count_if(toxic = 0), 0), 6) as leakage, round(count_if(toxic = 1 and quality = 1) / nullif(count_if(quality = 1), 0), 6) as class_fpr, cast(count_if(quality = toxic) as bigint) as needs_review, bool_or(toxic = 1 and quality = 1) as any_conflict from labels")
def rates_and_needs_review(spark, d):
    """A19, A28."""
    q, x = F.col("quality"), F.col("toxic")
    labels = t(spark, d, "labels")
    shares = metrics.rates(labels, {"leakage": (q == 0, x == 0), "class_fpr": (x == 1, q == 1)})
    counts = labels.agg(F.count_if(q == x).alias("needs_review"), F.bool_or((x == 1) & (q == 1)).alias("any_conflict"))
    return shares.join(counts, how="cross").select(F.round("leakage", 6).alias("leakage"), F.round("class_fpr", 6).alias("class_fpr"), "needs_review", "any_conflict")  # one row by one row


# ---- terms and concepts


def _words(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_size", "p_brand", F.posexplode(F.split("p_name", " ")).alias("at", "word"))


_WORDS = "w as (select p_partkey, p_size, p_brand, unnest(string_split(p_name, ' ')) as term, unnest(range(len(string_split(p_name, ' ')))) as pos from part)"


@query(f"with {_WORDS} select lower(term) as term, count(distinct p_partkey) as document_frequency, arg_min(p_brand, (p_partkey, pos)) as source from w where lower(term) not in ('red', 'blue') group by 1")
def term_document_frequency(spark, d):
    """A4, T1, Q5."""
    return terms.document_frequency(_words(spark, d), "word", "p_partkey", F.struct("p_partkey", "at"), "p_brand", ("red", "blue"))


@query(
    f"""with {_WORDS}, s as (select lower(term) as term, count(distinct p_partkey) as df, max(p_size) as evidence, min(p_size) * 10 as days from w group by 1),
x as (select *, least(100.0, 0.40 * df / (select max(df) from s) * 100 + 0.30 * (evidence * 2) + 0.20 * (case when days <= 90 then 100 when days <= 180 then 80 when days <= 365 then 60 else 40 end) + 0.10 * 0.5 * 100 + 3) as score from s)
select term, df, cast(round(score, 4) as double) as score, df >= 2 and score >= 60 as accepted from x"""
)
def term_score_accept(spark, d):
    """The greatest frequency is one row, joined on."""
    s = _words(spark, d).groupBy(F.lower("word").alias("term")).agg(F.countDistinct("p_partkey").alias("df"), F.max("p_size").alias("evidence"), (F.min("p_size") * 10).alias("days"))
    most = s.agg(F.max("df").alias("most"))
    score = terms.term_score(F.col("df"), F.col("most"), F.col("evidence") * 2, F.col("days"), F.lit(0.5), F.lit(3))
    s = s.join(F.broadcast(most), how="cross").withColumn("score", score)  # most is one row
    return s.select("term", "df", F.round("score", 4).alias("score"), terms.accepted(F.col("df"), F.col("score")).alias("accepted"))


@query(
    """with o as (select p_brand as term, cast(sum(p_size) as double) as score, sum(p_size) % 2 = 0 as accepted from part where p_partkey % 3 <> 0 and p_brand <> 'Brand#1' group by 1),
n as (select p_brand as term, cast(sum(p_size) as double) as score, sum(p_size) % 2 = 1 as accepted from part where p_partkey % 3 <> 1 and p_brand <> 'Brand#2' group by 1)
select coalesce(o.term, n.term) as term,
case when n.term is null then o.score when o.term is null or (n.accepted and (not o.accepted or n.score > o.score)) then n.score else o.score end as score,
case when n.term is null then o.accepted when o.term is null or (n.accepted and (not o.accepted or n.score > o.score)) then n.accepted else o.accepted end as accepted
from o full join n on o.term = n.term"""
)
def profile_merge(spark, d):
    """T4, J17."""
    p = t(spark, d, "part")
    side = lambda keep, odd: p.filter(keep).groupBy(F.col("p_brand").alias("term")).agg(F.sum("p_size").cast("double").alias("score"), (F.sum("p_size") % 2 == odd).alias("accepted"))
    return terms.merge_profiles(side("p_partkey % 3 <> 0 and p_brand <> 'Brand#1'", 0), side("p_partkey % 3 <> 1 and p_brand <> 'Brand#2'", 1))


@query("select p_brand, p_type, max(p_size) as confidence, array_to_string(list_sort(list(distinct cast(p_partkey as varchar))), ',') as documents from part group by all")
def concept_group_merge(spark, d):
    """A9, A10, U7."""
    p = t(spark, d, "part").select("p_brand", "p_type", F.col("p_size").alias("confidence"), F.col("p_partkey").cast("string").alias("doc"))
    r = terms.merge_concepts(p, ["p_brand", "p_type"], "doc", "confidence")
    return r.select("p_brand", "p_type", "confidence", F.array_join("documents", ",").alias("documents"))


# ---- scores, rules, flags


@query("select p_partkey, case when regexp_matches(p_name, '(?i)\\bred\\b') then 'true' when regexp_matches(p_name, '(?i)\\b(blue|green)\\b') then 'false' else 'unknown' end as flag from part")
def tri_state_flags(spark, d):
    """F16, C16."""
    return t(spark, d, "part").select("p_partkey", X.tri_state(F.col("p_name"), r"\bred\b", r"\b(blue|green)\b").alias("flag"))


@query("select o_orderkey, case when days <= 90 then 100 when days <= 180 then 80 when days <= 365 then 60 else 40 end as recency, future from (select o_orderkey, greatest(0, date_diff('day', cast(o_orderdate as date), date '2001-08-01')) as days, cast(o_orderdate as date) > date '2001-07-01' as future from orders)")
def recency_bucket(spark, d):
    """A7, F14, F27."""
    day = F.col("o_orderdate").cast("date")
    days = F.greatest(F.lit(0), F.datediff(F.to_date(F.lit("2001-08-01")), day))
    return t(spark, d, "orders").select("o_orderkey", X.recency_score(days).alias("recency"), (day > F.to_date(F.lit("2001-07-01"))).alias("future"))


@query("select o_custkey, arg_max(o_orderpriority, (-cast(substr(o_orderpriority, 1, 1) as integer), o_orderkey)) as best, max(o_orderkey) as last from orders group by 1")
def evidence_max_by(spark, d):
    """A6, A23."""
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct(-F.substring("o_orderpriority", 1, 1).cast("int"), "o_orderkey")).alias("best"), F.max("o_orderkey").alias("last"))


@query("select l_orderkey, array_to_string(list_slice(list(cast(l_partkey as varchar) order by l_linenumber, l_partkey), 1, 3), ',') as first_parts from lineitem group by 1")
def slice_caps(spark, d):
    """W9."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: r["l_partkey"].cast("string")), ",").alias("first_parts"))


@query("select count(*) as orders, cast(sum(n) as bigint) as lines, (select count(*) from lineitem) as total, sum(n) = (select count(*) from lineitem) as equal from (select l_orderkey, count(*) as n from lineitem group by 1)")
def count_reconciliation(spark, d):
    """Parts against the whole, from one scan."""
    per = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    total = t(spark, d, "lineitem").agg(F.count("*").alias("total"))
    r = per.agg(F.count("*").alias("orders"), F.sum("n").alias("lines")).join(total, how="cross")  # one row by one row
    return r.withColumn("equal", F.col("lines") == F.col("total"))


# ---- texts

@query("select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-_/]+', ' ', 'g'), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))) as digest from documents")
def text_normalize(spark, d):
    """F1-F5."""
    return t(spark, d, "documents").select("doc_id", F.sha2(X.relevance_form(F.col("text")).cast("binary"), 256).alias("digest"))


@query("select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n_tokens, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'and', 'der', 'les', 'los'])) as overlap from documents")
def tokens_overlap(spark, d):
    """F9, U3."""
    words = X.tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_intersect(words, F.lit(["the", "and", "der", "les", "los"]))).cast("long").alias("overlap"))


# Whole texts of every language. No SQL: DuckDB has no case folding and its patterns can't look around.


@query()
def text_normalize_whole(spark, d):
    """F1-F5."""
    small_batches(spark)  # a batch of texts, its four forms and what is sent back are in Python at once
    forms = t(spark, d, "documents").select("doc_id", X.whole_forms(F.col("text")).alias("form"))
    return forms.select("doc_id", *[F.sha2(F.col(f"form.{name}").cast("binary"), 256).alias(name) for name in X.FORMS])


@query()
def first_sentence_whole(spark, d):
    """The first sentence that has one of the words, trimmed; null without one."""
    word = f"(?iu)(?<![{X.WORD}])(?:the|der|les|los)(?![{X.WORD}])"
    found = F.get(F.filter(X.sentences(F.col("text")), lambda x: x.rlike(word)), 0)
    return t(spark, d, "documents").select("doc_id", F.regexp_replace(found, f"^[{X.SPACES}]+|[{X.SPACES}]+\\z", "").alias("sentence"))


_EMAIL, _CREDENTIAL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "(?i)(api[_-]?key|password|secret|token) *[:=]"


@query(f"select doc_id, regexp_matches(text, '{_EMAIL}') as email, regexp_matches(text, '{_CREDENTIAL}') as credential from documents where regexp_matches(text, '{_EMAIL}') or regexp_matches(text, '{_CREDENTIAL}')")
def pii_scope_screen(spark, d):
    """Q13 in part: e-mail and credentials."""
    text = F.col("text")
    email = text.contains("@") & text.rlike(_EMAIL)
    credential = text.rlike(_CREDENTIAL)
    # as the rows of a generator, the flags are computed once; a filter on them would be pushed down and compute them again
    found = F.filter(F.array(F.struct(email.alias("email"), credential.alias("credential"))), lambda x: x["email"] | x["credential"])
    return t(spark, d, "documents").select("doc_id", F.inline(found))


@query()
def query_scope_screen(spark, d):
    """Q13: every reason to refuse. No SQL: DuckDB's patterns can't look around."""
    from sievelake.operators.regulatory import scope_flags

    return t(spark, d, "documents").select("doc_id", *[flag.alias(name) for name, flag in scope_flags(F.col("text")).items()])


@query("select page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 2) as host, regexp_matches(url, '^https://') as secure, regexp_matches(url, '[?]') as has_query, not regexp_matches(url, '[?#@]') and regexp_matches(url, '^https?://[a-z0-9.-]+/') as allowed from pages")
def url_allowlist(spark, d):
    """Q14, Q15."""
    from sievelake.operators.regulatory import allowed_url, host_of

    u = F.col("url")
    return t(spark, d, "pages").select("page_id", host_of(u).alias("host"), u.startswith("https://").alias("secure"), u.contains("?").alias("has_query"), allowed_url(u).alias("allowed"))


@query("select page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') as escaped from pages")
def html_escape(spark, d):
    """F22."""
    return t(spark, d, "pages").select("page_id", X.html_escape(F.col("url")).alias("escaped"))


@query("select conv_id, count(*) as sections, sha256(string_agg(role || ': ' || text, ' ' order by turn)) as flat from conversations group by 1")
def section_array_projection(spark, d):
    """Ordered sections to one text."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("label"), "text")))
    flat = X.flat_sections(rows)
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("sections"), F.sha2(flat.cast("binary"), 256).alias("flat"))


_SENTENCES = "string_split(regexp_replace(text, '([.!?])[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"select doc_id, list_filter({_SENTENCES}, lambda x: contains(lower(x), ' the '))[1] as sentence from documents where contains(lower(text), ' the ')")
def first_sentence_match(spark, d):
    """The first sentence that has the word."""
    found = F.get(F.filter(X.sentences(F.col("text")), lambda x: F.lower(x).contains(" the ")), 0)
    return t(spark, d, "documents").filter(F.lower("text").contains(" the ")).select("doc_id", found.alias("sentence"))


@query(
    """with n as (select doc_id, regexp_extract_all(text, '[0-9]+') as runs from documents), z as (select *, list_transform(runs, lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) as plain from n)
select doc_id, len(runs) as n_numbers, list_max(list_transform(plain, lambda x: struct_pack(n := length(x), x := x))).x as most from z"""
)
def regex_number_extract(spark, d):
    """Runs of digits, and the greatest as it is written without leading zeros, whatever its length."""
    runs = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    plain = F.transform(F.transform(runs, lambda x: F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    return t(spark, d, "documents").select("doc_id", F.size(runs).cast("long").alias("n_numbers"), F.array_max(plain)["x"].alias("most"))


@query("select event_id, case when json_extract(props, '$.k') is null then 'absent' when json_extract(props, '$.k') = 'null' then 'null' else 'present' end as k, case when json_extract(props, '$.missing') is null then 'absent' else 'present' end as missing, cast(json_extract(props, '$.k') as bigint) as value from events")
def json_field_state(spark, d):
    """Absent, null or present, read from a variant."""
    from sievelake.operators.regulatory import field_state

    e = t(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", field_state(F.col("v"), "$.k").alias("k"), field_state(F.col("v"), "$.missing").alias("missing"), F.try_variant_get("v", "$.k", "bigint").alias("value"))


@query("select o_orderkey, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') as day, try_strptime(strftime(o_orderdate, '%Y') || '0230', '%Y%m%d') is null as rejected from orders")
def date_strict_parse(spark, d):
    """P8, F25."""
    from sievelake.operators.regulatory import strict_day

    day = F.date_format("o_orderdate", "yyyyMMdd")
    never = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("0230"))
    return t(spark, d, "orders").select("o_orderkey", strict_day(day).cast("string").alias("day"), strict_day(never).isNull().alias("rejected"))


@query("select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') as slug, substr(sha256(c_name), 1, 12) as digest from customer")
def slug_digest(spark, d):
    """K6, F21."""
    return t(spark, d, "customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug"), F.substring(F.sha2(F.col("c_name").cast("binary"), 256), 1, 12).alias("digest"))


@query("select source, lang, count(*) as n, string_agg(cast(doc_id as varchar), ',' order by n_chars desc, doc_id) as doc_ids from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) as p from documents) where p <= 5 group by all")
def sections_report(spark, d):
    """Section 2.17: the rows of a report by section, five each."""
    best = metrics.top_k(t(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")], 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda r: r["doc_id"].cast("string"))
    return best.groupBy("source", "lang").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("doc_ids"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
