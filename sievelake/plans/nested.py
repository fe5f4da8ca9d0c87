"""Queries over nested documents that Spark makes of the given tables: leaves, snapshot changes, reconciled children, guarded joins.

The documents are laid out by plain projections with rules in the rows' numbers; the SQL states from the same rules what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.operators import guards
from sievelake.operators.compare import article_states, compare_articles, multiset_digest
from sievelake.operators.reconcile import Container, reconcile
from sievelake.operators.trees import leaf_table
from sievelake.plans.catalog import query, t
from sievelake.plans.stage import spread


def obj(**members: Column | None) -> Column:
    """A JSON object of texts that are JSON already; a member that is null is left out."""
    each = [F.concat(F.lit(f'"{k}":'), v) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))


def num(value: Column) -> Column:
    return value.cast("string")


def word(value: Column | str) -> Column:
    return F.concat(F.lit('"'), F.lit(value) if isinstance(value, str) else value, F.lit('"'))


# ---- leaves


@query(
    """with l as (select l_orderkey as k, list_sort(list('"' || l_returnflag || '"')) as flags, list_sort(list('{"n":' || l_linenumber || ',"part":' || l_partkey || '}')) as lines from lineitem group by 1),
o as (select o_orderkey as k, o_orderstatus as s, o_custkey as c, flags, lines from orders join l on o_orderkey = k)
select 'event' as kind, event_id as k, 'k' as path, cast(json_extract(props, '$.k') as varchar) as value from events
union all select 'order', k, 'head.by.customer', cast(c as varchar) from o
union all select 'order', k, 'head.status', '"' || s || '"' from o
union all select 'order', k, 'flags', '[' || array_to_string(flags, ',') || ']' from o
union all select 'order', k, 'lines', cast(to_json(lines) as varchar) from o
union all select 'order', k, 'mixed[0]', cast(k as varchar) from o
union all select 'order', k, 'mixed[1][0].status', '"' || s || '"' from o
union all select 'order', k, 'mixed[1][1]', '[1,2]' from o
union all select 'order', k, 'mixed[1][2].none', '{}' from o"""
)
def nested_leaves(spark, d):
    """Leaves of every event's properties and of orders with their lines, four levels deep, mixed lists by place."""
    lines = spread(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", F.struct(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("n")).alias("line")), "o_orderkey")
    lines = lines.groupBy("o_orderkey").agg(F.to_json(F.collect_list("l_returnflag")).alias("flags"), F.to_json(F.collect_list("line")).alias("lines"))
    listed = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    k, s = num(F.col("o_orderkey")), word(F.col("o_orderstatus"))
    inner = F.concat_ws(",", obj(status=s), F.lit("[2,1]"), obj(none=obj(fetched_at=word("now"))))
    doc = obj(head=obj(status=s, by=obj(customer=num(F.col("o_custkey")), pmid=k)), flags=F.col("flags"), lines=F.col("lines"), mixed=listed(F.concat_ws(",", k, listed(inner))), assessed_at=word("now"))
    orders = t(spark, d, "orders").join(lines, "o_orderkey").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.parse_json(doc).alias("doc"))
    events = spread(t(spark, d, "events").select("event_id", "props")).select(F.lit("event").alias("kind"), F.col("event_id").alias("k"), F.parse_json("props").alias("doc"))
    return leaf_table(events.union(orders), ["kind", "k"], "doc")


# ---- snapshots of orders as articles


def _orders_as_articles(spark, d: str, target: bool, turned: bool = False) -> DataFrame:
    """Every order as an article; the target differs from the baseline by rules in the order's number. ``turned``: in falling order of keys, with a multiset's items turned round."""
    o, k = t(spark, d, "orders").filter("o_orderkey % 10 <> 1" if target else "o_orderkey % 10 <> 0").select("o_orderkey", "o_orderpriority", "o_orderstatus"), F.col("o_orderkey")
    o = o.orderBy(num(k).desc()) if turned else spread(o)  # before documents are made, so that none is sorted
    when = lambda n, then, other: F.when(k % n == 0, then).otherwise(other) if target else F.lit(other) if isinstance(other, str) else other  # noqa: E731  the baseline has what is otherwise
    text = lambda n, then, other: when(n, F.lit(f'"{then}"'), f'"{other}"')
    relevance = obj(relevance_class=text(7, "contextual", "direct"), decision=word("include"), relevance_score=num(k % 100), needs_review=when(9, F.lit("true"), "false"))
    relevance = F.when(k % 17 == 0, "null").otherwise(relevance) if target else F.when(k % 13 != 0, relevance)
    study = obj(design_family=word("trial"), design_subtype=word(F.col("o_orderstatus")), result_status=text(11, "draft", "final"), evidence_tier=F.lit("1"), needs_review=F.lit("false"))
    integrity = obj(status=text(19, "retracted", "ok"), record_role=word("article"), final_decision=word("keep"), report_eligible=when(19, F.lit("false"), "true"), needs_review=F.lit("false"))
    unclear = k % 5 == (3 if target else 2)
    outcome = obj(value=F.when(k % 5 == (3 if target else 2), '"unclear"').otherwise(num(k % 50)), provenance=obj(page=num(k % 4 + when(23, F.lit(1), F.lit(0)))))
    only_here = {"added": F.when(k % 29 == 0, "1")} if target else {"gone": F.when(k % 31 == 0, "[]")}
    sizes, fetched = ("[1,3,2]", "later") if target else ("[1,2,3]" if turned else "[3,2,1]", "now")
    extraction = obj(outcome=outcome, codes=F.lit('["b",["x"],{"k":1}]'), sizes=F.lit(sizes), fetched_at=word(fetched), **only_here)
    rank = num(k % 1000 + F.when(k % 37 == 0, 1).otherwise(0)) if target else num(k % 1000)
    section = F.when(k % 41 == 0, '"key_evidence"').when(k % 43 == 0, '"audit_only"').otherwise('"signals"') if target else word("signals")
    doc = obj(
        title=word(F.col("o_orderpriority")), clinical_relevance=relevance, assessment=obj(study_assessment=study), publication_integrity=integrity, structured_clinical_extraction=extraction,
        final_evidence_rank=rank, report_placement=obj(section=section, visible=F.lit("true"), display_mode=word("full")),
    )
    return o.select(num(k).alias("key"), F.parse_json(doc).alias("doc"))


def _said(category: str, kind: str, was: str, now: str, where: str, path: str = "", had: str = "true", has: str = "true", priority: int = 0) -> str:
    return f"select k, '{category}' as category, {kind} as change_type, '{path}' as field_path, {had} as in_baseline, {was} as baseline, {has} as in_target, {now} as target, {priority} as priority from b where {where}"


_RELEVANCE = """'{"decision":"include","needs_review":' || {review} || ',"relevance_class":"' || {kind} || '","relevance_score":' || k % 100 || '}'"""
_WAS, _NOW = (_RELEVANCE.replace("{review}", r).replace("{kind}", c) for r, c in (("'false'", "'direct'"), ("case when k % 9 = 0 then 'true' else 'false' end", "case when k % 7 = 0 then 'contextual' else 'direct' end")))
_CHANGES = " union all ".join((
    "select k, 'membership', 'added', '', false, 'null', true, '\"' || p || '\"', 2 from o where k % 10 = 0",
    "select k, 'membership', 'removed', '', true, '\"' || p || '\"', false, 'null', 2 from o where k % 10 = 1",
    _said("comparability", "case when k % 17 = 0 then 'block_state_changed' else 'block_became_comparable' end", "'null'", f"case when k % 17 = 0 then 'null' else {_NOW} end", "k % 13 = 0", "clinical_relevance", had="false", priority=8),
    _said("comparability", "'block_became_not_comparable'", _WAS, "'null'", "k % 13 <> 0 and k % 17 = 0", "clinical_relevance", priority=8),
    _said("relevance", "'relevance_changed'", "'{\"relevance_class\":\"direct\"}'", "'{\"relevance_class\":\"contextual\"}'", "k % 7 = 0 and k % 13 <> 0 and k % 17 <> 0", priority=3),
    _said("study", "'study_result_changed'", "'{\"result_status\":\"final\"}'", "'{\"result_status\":\"draft\"}'", "k % 11 = 0", priority=4),
    _said("integrity", "'integrity_changed'", "'{\"report_eligible\":true,\"status\":\"ok\"}'", "'{\"report_eligible\":false,\"status\":\"retracted\"}'", "k % 19 = 0", priority=1),
    _said("review", "'review_required_changed'", "'false'", "case when k % 9 = 0 and k % 17 <> 0 then 'true' else 'false' end",
          "(case when k % 13 = 0 then 'null' else 'false' end) <> (case when k % 17 = 0 then 'null' when k % 9 = 0 then 'true' else 'false' end)", priority=6),
    _said("ranking", "'rank_changed'", "cast(k % 1000 as varchar)", "cast(k % 1000 + 1 as varchar)", "k % 37 = 0", priority=7),
    _said("placement", "case when k % 41 = 0 then 'became_key_evidence' else 'placement_changed' end", "'{\"section\":\"signals\"}'", "case when k % 41 = 0 then '{\"section\":\"key_evidence\"}' else '{\"section\":\"audit_only\"}' end", "k % 41 = 0 or k % 43 = 0", priority=7),
    _said("extraction", "case when k % 5 = 2 then 'extraction_abstention_to_accepted' else 'extraction_accepted_to_abstention' end", "case when k % 5 = 2 then '\"unclear\"' else cast(k % 50 as varchar) end",
          "case when k % 5 = 3 then '\"unclear\"' else cast(k % 50 as varchar) end", "k % 5 in (2, 3)", "outcome.value", priority=5),
    _said("extraction", "'extraction_provenance_only'", "cast(k % 4 as varchar)", "cast(k % 4 + 1 as varchar)", "k % 23 = 0", "outcome.provenance.page", priority=7),
    _said("extraction", "'extraction_added'", "'null'", "'1'", "k % 29 = 0", "added", had="false", priority=5),
    _said("extraction", "'extraction_removed'", "'[]'", "'null'", "k % 31 = 0", "gone", has="false", priority=5),
))


@query(
    f"""with o as (select o_orderkey as k, o_orderpriority as p from orders), b as (select * from o where k % 10 not in (0, 1)),
c (k, category, change_type, field_path, in_baseline, baseline, in_target, target, priority) as ({_CHANGES})
select category, change_type, cast(k as varchar) as key, field_path, in_baseline, baseline, in_target, target, priority,
substr(sha256('{{"baseline":{{"present":' || in_baseline || ',"value":' || baseline || '}},"category":"' || category || '","change_type":"' || change_type || '","field_path":"' || field_path || '","pmid":"' || k || '","target":{{"present":' || in_target || ',"value":' || target || '}}}}'), 1, 16) as change_id from c"""
)
def snapshot_changes(spark, d):
    """Every kind of change between two snapshots, with ids; 1.5 million articles at sf100, one join and one grouping."""
    return compare_articles(_orders_as_articles(spark, d, False), _orders_as_articles(spark, d, True)).drop("detail")


@query("select cast(count(*) as bigint) as articles, true as same from orders where o_orderkey % 10 <> 0")
def snapshot_identity(spark, d):
    """A snapshot's digest is that of its articles in any order and partitioning, with lists that are multisets turned round."""
    rows = _orders_as_articles(spark, d, False)
    turned = _orders_as_articles(spark, d, False, turned=True)
    ids = multiset_digest(article_states(rows)).toDF("a").join(multiset_digest(article_states(turned)).toDF("b"), how="cross")  # one row by one row
    return rows.agg(F.count("*").alias("articles")).join(ids, how="cross").select("articles", (F.col("a") == F.col("b")).alias("same"))


# ---- children and the raw records that they come from

_LINE = Container("lines", ("code", "flag", "ship"), "code", required=("code",), days=("ship",), words={"flag": ("A", "N", "R")})


def _lines_with_sources(spark, d: str) -> DataFrame:
    """Orders with their lines as children and as raw children; faults are planted by rules in the number of the line's place and order."""
    k, i = F.col("l_orderkey"), F.col("i")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    rows = spread(lines, "l_orderkey").withColumn("i", F.row_number().over(place) - 1)
    code, ship = F.concat(F.lit("c"), num(i)), F.date_format("l_shipdate", "yyyyMMdd")
    flag = F.when((k + i) % 13 == 0, "X").otherwise(F.col("l_returnflag"))
    at = F.concat(F.lit("results["), num(k), F.lit("].lines["), num(i), F.lit("]."))
    source = lambda name, value, state="present", raw=None: obj(state=word(state), path=word(F.concat(at, F.lit(name))), raw_value=word(value) if raw is None else raw)
    raw = obj(code=word(code), flag=word(flag), ship=word(ship))
    shown_flag = F.when((k + i) % 11 == 0, "other").otherwise(flag)
    state = F.when((k + i) % 7 == 0, "lost").otherwise("present")
    path = F.when((k + i) % 17 == 0, F.concat(at, F.lit("ships"))).otherwise(F.concat(at, F.lit("ship")))
    fields = obj(code=source("code", code), flag=obj(state=word(state), path=word(F.concat(at, F.lit("flag"))), raw_value=word(flag)), ship=obj(state=word("present"), path=word(path), raw_value=word(F.when((k + i) % 19 == 0, "19990101").otherwise(ship))))
    more = F.when((k + i) % 23 == 0, "1")
    child = obj(code=word(code), flag=word(shown_flag), ship=word(F.date_format("l_shipdate", "yyyy-MM-dd")), source_fields=fields, more=more)
    child = F.when((k + i) % 29 != 0, child)  # a raw child that no child comes from
    rows = rows.select(k.alias("k"), "i", raw.alias("raw"), child.alias("child"))
    grouped = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "raw"))).alias("raws"), F.collect_list("child").alias("children"))
    listed = lambda c: F.concat(F.lit('{"lines":['), F.array_join(c, ","), F.lit("]}"))
    return grouped.select("k", F.parse_json(listed(F.col("children"))).alias("doc"), F.parse_json(listed(F.col("raws.raw"))).alias("raw"), F.concat(F.lit("results["), num(F.col("k")), F.lit("]")).alias("place"))


_FAULTS = (
    ("''", "bad_shape", "n % 23 = 0"), ("'flag'", "bad_state", "n % 7 = 0"), ("'flag'", "raw_differs", "n % 7 = 0"), ("'flag'", "value_differs", "n % 11 = 0 or n % 7 = 0"),
    ("'flag'", "bad_value", "n % 11 = 0 or n % 13 = 0"), ("'ship'", "bad_path", "n % 17 = 0"), ("'ship'", "raw_differs", "n % 19 = 0 and day <> '19990101'"), ("'ship'", "value_differs", "n % 19 = 0 and day <> '19990101'"),
)


@query(
    """with l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as i, strftime(l_shipdate, '%Y%m%d') as day from lineitem),
c as (select *, k + i as n from l) select k, i as index, '' as field, 'no_child' as code from c where n % 29 = 0
union all """
    + " union all ".join(f"select k, i, {field}, '{code}' from c where n % 29 <> 0 and ({where})" for field, code, where in _FAULTS)
)
def reconciled_children(spark, d):
    """Lines nested by order against their raw lines, a planted fault of each code."""
    return reconcile(_lines_with_sources(spark, d), ["k"], _LINE).select("k", F.col("index").cast("long").alias("index"), "field", "code")


# ---- guards in the data path


@query("select n_name, cast(count(*) as bigint) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def guarded_totals(spark, d):
    """Orders by nation, where the job fails on a repeated key, an order without a customer, a customer without a nation, a lost row."""
    orders, customers, nations = (t(spark, d, n) for n in ("orders", "customer", "nation"))
    orders = guards.unique(orders, ["o_orderkey"]).withColumn("c_custkey", F.col("o_custkey"))
    customers = guards.no_orphans(guards.unique(customers, ["c_custkey"]).withColumn("n_nationkey", F.col("c_nationkey")), nations, ["n_nationkey"])
    orders = guards.no_orphans(orders, customers, ["c_custkey"])
    return orders.join(customers.select("c_custkey", "n_nationkey"), "c_custkey").join(nations, "n_nationkey").groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """with l as (select l_orderkey, cast(count(*) as bigint) as n, sum(cast(l_quantity as bigint)) as quantity from lineitem group by 1)
select o_orderkey, coalesce(n, 0) as n, coalesce(quantity, 0) as quantity from orders left join l on l_orderkey = o_orderkey"""
)
def reconciled_totals(spark, d):
    """What orders declare (written beside them when they are landed) against their lines, count and sum, in one plan."""
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("quantity"))
    declared = lines.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    orders = t(spark, d, "orders").select("o_orderkey").join(declared, "o_orderkey", "left").fillna(0)
    orders = guards.adds_up(orders, lines, ["o_orderkey"], "n", code="wrong_count")
    return guards.adds_up(orders, guards.no_orphans(lines, orders, ["o_orderkey"]), ["o_orderkey"], "quantity", F.col("quantity"))
