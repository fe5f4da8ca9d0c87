"""What changed between two snapshots, as one table.

A snapshot's articles are rows (key, doc), the document a VARIANT. One full outer join by key brings the two sides together; every
kind of change is an entry of one array that is exploded. Leaves of extractions come from ``leaf_table`` and meet in one grouping.
A change says what it is about (category, change_type, key, field_path), what was and what is (in_baseline, baseline, in_target,
target; canonical JSON), its priority, and further detail. Its id is a digest of all but the last two.

Defined results: a repeated key, or an article that isn't an object, fails the job; articles without a key aren't matched (``unmatched``); a
block that is missing, null or of another kind on either side has no changes of its fields, only of its state; two empty snapshots
have no changes. Numbers are compared by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.operators.guards import require, unique
from sievelake.operators.snapshots import occurrences
from sievelake.operators.trees import canonical, leaf_change, leaf_differences, leaf_table, once, provenance_path, quoted
from sievelake.plans.stage import Stage

# Blocks of an article, their compared fields, the parent whose state comes first, and policy versions.
RELEVANCE, STUDY, INTEGRITY, EXTRACTION, RANK, PLACEMENT = "clinical_relevance", "assessment.study_assessment", "publication_integrity", "structured_clinical_extraction", "final_evidence_rank", "report_placement"
BLOCKS = {RELEVANCE: None, "assessment": None, STUDY: "assessment", INTEGRITY: None, EXTRACTION: None, RANK: None, PLACEMENT: None}
FIELDS = {
    "relevance": (RELEVANCE, "relevance_changed", ("decision", "relevance_class", "relevance_score")),
    "study_design": (STUDY, "study_design_changed", ("design_family", "design_subtype")),
    "study_result": (STUDY, "study_result_changed", ("evidence_tier", "result_status")),
    "integrity": (INTEGRITY, "integrity_changed", ("final_decision", "record_role", "report_eligible", "status")),
    "placement": (PLACEMENT, "placement_changed", ("display_mode", "section", "visible")),
}
REVIEWED = {"extraction": EXTRACTION, "integrity": INTEGRITY, "relevance": RELEVANCE, "study": STUDY}
POLICIES = ("b6/1.0", "1.0", "1.0", "1.0", "1.0")

COLUMNS = ["category", "change_type", "key", "field_path", "in_baseline", "baseline", "in_target", "target", "detail"]
NULL = "null"


def articles_of(snapshot: DataFrame) -> DataFrame:
    """(key, doc) of a loaded snapshot's articles; an article without an id has the key ``''``."""
    rows = snapshot.select(F.try_variant_get("doc", "$.articles", "variant").alias("articles"))
    rows = rows.lateralJoin(snapshot.sparkSession.tvf.variant_explode(F.col("articles").outer())).select("pos", F.col("value").alias("doc"))
    return require(rows, canonical(F.col("doc")).startswith("{"), "malformed_snapshot", F.col("pos")).select(key_of(F.col("doc")).alias("key"), "doc")


def key_of(doc: Column) -> Column:
    text = canonical(F.try_variant_get(doc, "$.pmid", "variant"))
    return F.when(text.startswith('"'), F.trim(F.try_variant_get(doc, "$.pmid", "string"))).otherwise("")


def part(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "variant")


def text_of(value: Column) -> Column:
    return F.coalesce(canonical(value), F.lit(NULL))


#: Members whose text is compared, and a name for each.
TOLD = ["title", RANK, *[f"{block}.{f}" for block, _, names in FIELDS.values() for f in names], *[f"{block}.needs_review" for block in REVIEWED.values()]]


@dataclass(frozen=True)
class Side:
    """An article's document, and what is read of it again and again: states of blocks and texts of members, as one struct."""

    doc: Column
    read: Column

    @staticmethod
    def reading(doc: Column) -> Column:
        """States and texts by one cast of the document and one of each block, not by a path each."""
        wanted = {block: [path.removeprefix(f"{block}.") for path in TOLD if path.startswith(f"{block}.")] for block in BLOCKS if block != RANK}
        below = {block: block.removeprefix(f"{parent}.") for block, parent in BLOCKS.items() if parent}
        for block, name in below.items():
            wanted[BLOCKS[block]].append(name)
        opened = lambda v, names: F.try_variant_get(v, "$", "struct<" + ", ".join(f"`{n}`: variant" for n in names) + ">")
        state = lambda v, is_there: F.when(v.isNull(), "absent").when(F.is_variant_null(v), NULL).when(is_there, "present").otherwise("invalid")

        def told(top: Column, upper: Column, lower: Column) -> Column:
            value = {block: upper[parent][below[block]] if parent else top[block] for block, parent in BLOCKS.items()}
            held = {block: (lower if parent else upper)[block] for block, parent in BLOCKS.items() if block != RANK}
            states = [state(value[block], F.lit(True) if block == RANK else held[block].isNotNull()).alias("state " + block.replace(".", " ")) for block in BLOCKS]
            at = lambda path: held[path.rpartition(".")[0]][path.rpartition(".")[2]] if "." in path else top[path]
            return F.struct(*states, *[text_of(at(path)).alias(path.replace(".", " ")) for path in TOLD])

        uppers = [block for block, parent in BLOCKS.items() if not parent and block != RANK]
        of_lower = lambda upper: F.struct(*[opened(upper[BLOCKS[block]][name], wanted[block]).alias(block) for block, name in below.items()])
        of_upper = lambda top: F.struct(*[opened(top[block], wanted[block]).alias(block) for block in uppers])
        return once(opened(doc, ["title", RANK, *uppers]), lambda top: once(of_upper(top), lambda upper: once(of_lower(upper), lambda lower: told(top, upper, lower))))

    def state(self, block: str) -> Column:
        return self.read["state " + block.replace(".", " ")]

    def text(self, path: str) -> Column:
        return self.read[path.replace(".", " ")]


def change(category: str, kind: Column | str, *, was: Column, now: Column, path: str = "", had: Column | None = None, has: Column | None = None, detail: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    had, has = (F.lit(True) if x is None else x for x in (had, has))
    detail = F.lit("{}") if detail is None else detail
    values = (F.lit(category), kind, F.lit(path), had, was, has, now, detail)
    return F.struct(*[v.alias(n) for v, n in zip(values, [c for c in COLUMNS if c != "key"], strict=True)])


def members(values: dict[str, Column], chosen: dict[str, Column]) -> Column:
    """The JSON object of the chosen members, in the order given."""
    each = [F.when(chosen[f], F.concat(F.lit(f'"{f}":'), v)) for f, v in values.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*each)), ","), F.lit("}"))


def names_json(chosen: dict[str, Column]) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(f'"{f}"')) for f, c in chosen.items()])), ","), F.lit("]"))


def membership_changes(b: Column, t: Column) -> list[Column]:
    title = lambda doc: F.coalesce(canonical(part(doc, "title")), F.lit('""'))
    added = change("membership", "added", had=F.lit(False), was=F.lit(NULL), now=title(t))
    removed = change("membership", "removed", was=title(b), has=F.lit(False), now=F.lit(NULL))
    return [F.when(b.isNull(), added), F.when(t.isNull(), removed)]


def block_changes(b: Side, t: Side) -> list[Column]:
    """Blocks whose state changed; one below another whose state changed is left out."""
    out = []
    for block, parent in BLOCKS.items():
        was, now = b.state(block), t.state(block)
        differs = was != now
        if parent:
            differs = differs & (b.state(parent) == t.state(parent))
        kind = F.when((was != "present") & (now == "present"), "block_became_comparable").when((was == "present") & (now != "present"), "block_became_not_comparable").otherwise("block_state_changed")
        detail = F.concat(F.lit('{"baseline_state":"'), was, F.lit(f'","block":"{block}","target_state":"'), now, F.lit('"}'))
        out.append(F.when(differs, change("comparability", kind, path=block, had=was != "absent", was=text_of(part(b.doc, block)), has=now != "absent", now=text_of(part(t.doc, block)), detail=detail)))
    return out


def field_changes(b: Side, t: Side) -> list[Column]:
    """One record for each group of fields of which some differ."""
    out = []
    for group, (block, kind, fields) in FIELDS.items():
        old, new = ({f: side.text(f"{block}.{f}") for f in fields} for side in (b, t))
        differs = {f: old[f] != new[f] for f in fields}
        some = F.exists(F.array(*differs.values()), lambda x: x)
        if group == "placement":
            kind = F.when((new["section"] == '"key_evidence"') & (old["section"] != '"key_evidence"'), "became_key_evidence").otherwise(kind)
        found = change(group.split("_")[0], kind, was=members(old, differs), now=members(new, differs), detail=F.concat(F.lit('{"differing":'), names_json(differs), F.lit("}")))
        out.append(F.when((b.state(block) == "present") & (t.state(block) == "present") & some, found))
    return out


def review_change(b: Side, t: Side) -> Column:
    """Whether a review is needed, over all sources, or what any source says of it."""
    old, new = ({name: side.text(f"{block}.needs_review") for name, block in REVIEWED.items()} for side in (b, t))
    any_of = lambda values: F.exists(F.array(*values.values()), lambda v: v == "true").cast("string")
    some = F.exists(F.array(*[old[n] != new[n] for n in REVIEWED]), lambda x: x)
    each = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":['), old[n], F.lit(","), new[n], F.lit("]")) for n in REVIEWED])
    return F.when(some, change("review", "review_required_changed", was=any_of(old), now=any_of(new), detail=F.concat(F.lit('{"sources":{'), each, F.lit("}}"))))


def rank_change(b: Side, t: Side, moved: Column) -> Column:
    old, new = b.text(RANK), t.text(RANK)
    return F.when((old != new) & (old != NULL) & (new != NULL), change("ranking", "rank_changed", was=old, now=new, detail=F.concat(F.lit('{"candidate_set_changed":'), moved.cast("string"), F.lit("}"))))


def with_identity(changes: DataFrame) -> DataFrame:
    """Priority, and the first 16 digits of the digest of what the record says."""
    side = lambda has, value: F.concat(F.lit('{"present":'), has.cast("string"), F.lit(',"value":'), value, F.lit("}"))
    c = F.col
    seed = F.concat(
        F.lit('{"baseline":'), side(c("in_baseline"), c("baseline")), F.lit(',"category":'), quoted(c("category")), F.lit(',"change_type":'), quoted(c("change_type")),
        F.lit(',"field_path":'), quoted(c("field_path")), F.lit(',"pmid":'), quoted(c("key")), F.lit(',"target":'), side(c("in_target"), c("target")), F.lit("}"),
    )
    by_category = F.element_at(F.create_map(*[F.lit(x) for kv in rules.CHANGE_PRIORITY.items() for x in kv]), c("category"))
    priority = F.when((c("category") == "extraction") & provenance_path(c("field_path")), 7).otherwise(by_category)
    return changes.withColumns({"priority": priority.cast("int"), "change_id": F.substring(F.sha2(seed.cast("binary"), 256), 1, 16)})


def change_order() -> list[Column]:
    """O5."""
    return [F.col(c) for c in ("priority", "category", "change_type", "key", "field_path")]


def compare_articles(baseline: DataFrame, target: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """All changes between two tables of articles (key, doc); ``scope`` adds rows that are about the snapshots as wholes."""
    stage = Stage(baseline.sparkSession, "compare")
    side = lambda df, name: unique(df.filter("key <> ''"), ["key"]).select("key", F.col("doc").alias(name), Side.reading(F.col("doc")).alias(f"{name}_read"))
    both = stage.keep(side(baseline, "b").join(side(target, "t"), "key", "full_outer"), "both")
    b, t = F.col("b"), F.col("t")
    sides = Side(b, F.col("b_read")), Side(t, F.col("t_read"))
    moved = both.agg(F.coalesce(F.max(b.isNull() | t.isNull()), F.lit(False)).alias("moved"))  # one row
    met = b.isNotNull() & t.isNotNull()
    pairs = [*block_changes(*sides), *field_changes(*sides), review_change(*sides), rank_change(*sides, F.col("moved"))]
    found = F.array_compact(F.array(*membership_changes(b, t), *[F.when(met, x) for x in pairs]))
    changes = both.join(F.broadcast(moved), how="cross").select("key", F.inline(found)).select(*COLUMNS)

    comparable = both.filter((sides[0].state(EXTRACTION) == "present") & (sides[1].state(EXTRACTION) == "present"))
    docs = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), part(x, EXTRACTION).alias("doc")) for name, x in (("b", b), ("t", t))]))
    opened = leaf_table(comparable.select("key", docs.alias("d")).select("key", "d.side", "d.doc"), ["key", "side"], "doc", stage=stage)
    leaves_of = [opened.filter(F.col("side") == name).drop("side") for name in ("b", "t")]
    path, was, now = F.col("path"), F.col("baseline"), F.col("target")
    leaves = leaf_differences(*leaves_of, ["key"]).select(
        F.lit("extraction").alias("category"), leaf_change(path, was, now).alias("change_type"), "key", path.alias("field_path"),
        was.isNotNull().alias("in_baseline"), F.coalesce(was, F.lit(NULL)).alias("baseline"), now.isNotNull().alias("in_target"), F.coalesce(now, F.lit(NULL)).alias("target"), F.lit("{}").alias("detail"),
    )
    changes = changes.union(leaves)
    return with_identity(changes if scope is None else changes.union(scope))


def scope_changes(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """D3: changes of the snapshots' scope: a topic that can't be verified, a query that changed. Different topics are an error (``require_comparable``)."""
    both = baseline.select(F.col("doc").alias("b")).join(target.select(F.col("doc").alias("t")), how="cross")  # one row by one row
    b, t = F.col("b"), F.col("t")
    known = lambda doc: F.nullif(F.trim(F.when(canonical(part(doc, "topic")).startswith('"'), F.try_variant_get(doc, "$.topic", "string"))), F.lit(""))
    is_text = lambda doc: F.coalesce(canonical(part(doc, "query")).startswith('"'), F.lit(False))
    has = lambda doc, name: canonical(part(doc, name)).isNotNull()
    presence = F.concat(F.lit('{"baseline_topic_present":'), known(b).isNotNull().cast("string"), F.lit(',"target_topic_present":'), known(t).isNotNull().cast("string"), F.lit("}"))
    unsure = change("comparability", "scope_unverifiable", path="topic", had=has(b, "topic"), was=text_of(part(b, "topic")), has=has(t, "topic"), now=text_of(part(t, "topic")), detail=presence)
    queried = change("comparability", "query_changed", path="query", was=text_of(part(b, "query")), now=text_of(part(t, "query")))
    differs = known(b).isNotNull() & known(t).isNotNull() & is_text(b) & is_text(t) & (text_of(part(b, "query")) != text_of(part(t, "query")))
    found = F.array_compact(F.array(F.when(known(b).isNull() | known(t).isNull(), unsure), F.when(differs, queried)))
    return both.select(F.lit("").alias("key"), F.inline(found)).select(*COLUMNS)


def unmatched(articles: DataFrame, snapshot: str) -> DataFrame:
    """Articles without a key, by digest, identical ones numbered."""
    rows = articles.filter("key = ''").select(F.lit(snapshot).alias("snapshot"), F.substring(F.sha2(canonical(F.col("doc")).cast("binary"), 256), 1, 16).alias("record_digest"))
    return occurrences(rows, "snapshot", "record_digest", [F.col("record_digest")])


def article_states(articles: DataFrame) -> DataFrame:
    """(key, digest) of what a comparison looks at in each article, and of nothing else."""
    side = Side(F.col("doc"), F.col("read"))
    stage = Stage(articles.sparkSession, "states")
    read = articles.filter("key <> ''").select("key", "doc", Side.reading(F.col("doc")).alias("read"))
    fields = [side.text(f"{block}.{f}") for block, _, names in FIELDS.values() for f in names]
    reviews = [side.text(f"{block}.needs_review") for block in REVIEWED.values()]
    told = F.concat_ws("\x1f", "key", side.text("title"), *[side.state(block) for block in BLOCKS], *fields, *reviews, side.text(RANK))
    # documents are read once, and of them only what leaves are made of is written
    rows = stage.keep(read.select(F.monotonically_increasing_id().alias("row"), "key", told.alias("told"), F.when(side.state(EXTRACTION) == "present", part(side.doc, EXTRACTION)).alias("doc")), "articles")
    leaves = leaf_table(rows.filter("doc is not null").select("row", "doc"), ["row"], "doc", stage=stage).groupBy("row").agg(F.array_sort(F.collect_list(F.concat_ws("\x1f", "path", "value"))).alias("leaves"))
    rows = rows.select("row", "key", "told").join(leaves, "row", "left")
    return rows.select("key", F.sha2(F.concat_ws("\x1e", "told", "leaves").cast("binary"), 256).alias("digest"))


def multiset_digest(rows: DataFrame, digest: str = "digest") -> DataFrame:
    """One row, ``digest``: of a multiset of sha256 digests, whatever their order: sums of their eight 32-bit parts, and their number."""
    parts = [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    sums = F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts])
    return rows.agg(F.sha2(sums.cast("binary"), 256).alias("digest"))


def semantic_id(snapshot: DataFrame) -> DataFrame:
    """One row, ``digest``: of a loaded snapshot's version, topic, query and articles, as far as they are compared."""
    head = snapshot.select(*[text_of(part(F.col("doc"), name)).alias(name) for name in ("schema_version", "topic", "query")])
    both = head.join(multiset_digest(article_states(articles_of(snapshot))), how="cross")  # one row by one row
    return both.select(F.sha2(F.concat_ws("\x1f", "schema_version", "topic", "query", "digest").cast("binary"), 256).alias("digest"))


def comparison_of(baseline: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The change table of two loaded snapshots, and one row about the comparison: ids of both and of the comparison, whether they say the same."""
    ids = semantic_id(baseline).toDF("baseline_id").join(semantic_id(target).toDF("target_id"), how="cross")  # one row by one row
    policies: Sequence[Column] = [F.lit(p) for p in POLICIES]
    ids = ids.withColumns({"comparison_id": F.sha2(F.concat_ws(":", "baseline_id", "target_id", *policies).cast("binary"), 256), "identical_content": F.col("baseline_id") == F.col("target_id")})
    return compare_articles(articles_of(baseline), articles_of(target), scope_changes(baseline, target)), ids
