"""Nested values as rows: the leaves of VARIANT documents of any depth.

Containers are opened level by level with ``variant_explode``: a leaf's row passes, a container's becomes its members', until none is left.
``LEVELS`` levels are one narrow pass that ends in a written table, and containers that it leaves open take another; nothing is shuffled,
and no row holds more than its document does. A document of depth n takes n / ``LEVELS`` passes.

Rules: members named in ``skip`` are left out; an object without others is a leaf ``{}``. A list of objects, or of scalars, is one
leaf, a multiset: sorted by canonical text, so that order makes no difference. A list that holds lists, or both kinds, goes by place.

Defined results: a null document has no leaves, a scalar one has the path ``''``; a value that is JSON's null is a leaf ``null``; repeated
keys of rows give repeated leaves; an empty table gives no rows. Numbers are compared by value (1.0 is 1, 1e2 is 100.0 as a double).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake import rules
from sievelake.plans.stage import Stage

#: Members that only audits use (fixed values).
AUDIT_ONLY = ("assessed_at", "fetched_at", "pmid")
#: Levels that are opened between two written tables.
LEVELS = 4


def canonical(value: Column) -> Column:
    """The canonical text of a variant: members sorted, no blanks."""
    return F.to_json(value)


#: What JSON writes as it stands.
SIMPLE = r"^[ !#-\[\]-~]*$"


def is_list(value: Column) -> Column:
    """Whether a variant is a list, without writing out what it holds."""
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def quoted(text: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.char_length(inside) - 2)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_text(value: Column, skip: Sequence[str] = ()) -> Column:
    """A leaf's canonical text: of a scalar, of a list that is one leaf, of an object that has members, all of them in ``skip``; null for what is to be opened.

    What is opened isn't written out, as the engine makes a JSON writer for every name and string in it, nor asked for members by path, as one
    that isn't there costs an exception: one cast to a struct tells objects and their members to skip.
    """
    texts = lambda i: F.transform(i, lambda x: F.coalesce(canonical(x), F.lit("null")))
    scalars = lambda i: F.concat(F.lit("["), F.array_join(F.array_sort(i), ","), F.lit("]"))
    kinds = lambda i: F.when(F.forall(i, lambda x: ~x.startswith("{")), scalars(i)).when(F.forall(i, lambda x: x.startswith("{")), F.to_json(F.array_sort(i)))
    listed = lambda i: F.when(~F.exists(i, is_list), once(texts(i), kinds))
    names = list(skip) or ["x"]
    some = F.try_variant_get(value, "$", "struct<" + ", ".join("`" + n.replace("`", "``") + "`: variant" for n in names) + ">")
    members = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    none_open = F.forall(members, lambda m: m.isin(*names))
    held = lambda s: reduce(lambda a, b: a | b, [s.getField(n).isNotNull() for n in names])
    # an object with none of the names goes on, or is empty, which shows when it is opened
    as_object = lambda s: F.when(s.isNull(), canonical(value)).when(held(s) & none_open if skip else F.lit(False), "{}")
    return once(F.try_variant_get(value, "$", "array<variant>"), lambda i: F.when(i.isNotNull(), listed(i)).otherwise(once(some, as_object)))


def once(value: Column, f) -> Column:
    """``f(value)``, where value is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def leaf_table(docs: DataFrame, keys: Sequence[str], value: str, *, skip: Sequence[str] = AUDIT_ONLY, path: str = "path", leaf: str = "value", stage: Stage | None = None) -> DataFrame:
    """``keys``, path and canonical text of every leaf of the variant column ``value``."""
    stage, skip = stage or Stage(docs.sparkSession, "leaves"), list(dict.fromkeys(skip))
    named = docs.select(*[docs[k] for k in keys])
    at, text, node, pos, member, inner = (fresh(named, n) for n in ("path", "leaf", "node", "pos", "key", "inner"))
    own = [F.col(k) for k in keys]

    def told(level: DataFrame) -> DataFrame:
        level = level.select(*own, at, F.when(F.col(node).isNull(), F.col(text)).otherwise(as_text(F.col(node), skip)).alias(text), node)
        return level.select(*own, at, text, F.when(F.col(text).isNull(), F.col(node)).alias(node))

    def opened(level: DataFrame) -> DataFrame:
        """A container's members or items in its place; leaves pass, and so does an empty object, whose text is made now."""
        rows = level.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col(node).outer())).toDF(*keys, at, text, node, pos, member, inner)
        if skip:
            rows = rows.filter(F.col(member).isNull() | ~F.col(member).isin(*skip))
        place = F.when(F.col(member).isNull(), F.concat(F.lit("["), F.col(pos).cast("string"), F.lit("]"))).when(F.col(at) == "", F.col(member)).otherwise(F.concat(F.lit("."), member))
        whole = F.col(pos).isNull()
        return rows.select(*own, F.when(whole, F.col(at)).otherwise(F.concat(at, place)).alias(at), F.when(whole, F.coalesce(F.col(text), F.lit("{}"))).alias(text), F.col(inner).alias(node))

    level, found = told(docs.filter(docs[value].isNotNull()).select(*[docs[k] for k in keys], F.lit("").alias(at), F.lit(None).cast("string").alias(text), docs[value].alias(node))), []
    while True:
        for _ in range(LEVELS):
            level = told(opened(level))
        level = stage.keep(level, f"{stage.n}-levels-{len(found)}")
        found.append(level.filter(F.col(text).isNotNull()).select(*own, F.col(at).alias(path), F.col(text).alias(leaf)))
        level = level.filter(F.col(text).isNull())
        if level.isEmpty():
            return reduce(DataFrame.union, found)


def leaf_differences(baseline: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves (keys, path, value) of two sides whose texts differ, as baseline and target (null: not there) - one exchange, no join."""
    side = lambda df, name: df.select(*keys, "path", F.lit(name).alias("side"), "value")
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("value")))
    both = side(baseline, "b").union(side(target, "t")).groupBy(*keys, "path").agg(of("b").alias("baseline"), of("t").alias("target"))
    return both.filter(~F.col("baseline").eqNullSafe(F.col("target")))


def leaf_change(path: Column, baseline: Column, target: Column) -> Column:
    """What became of a leaf; texts are canonical."""
    abstains = lambda v: v.isin("null", '""', "[]", *[f'"{w}"' for w in rules.ABSTENTIONS])
    was, now = abstains(baseline), abstains(target)
    return (
        F.when(baseline.isNull(), "extraction_added")
        .when(target.isNull(), "extraction_removed")
        .when(provenance_path(path), "extraction_provenance_only")
        .when(was & ~now, "extraction_abstention_to_accepted")
        .when(~was & now, "extraction_accepted_to_abstention")
        .otherwise("extraction_changed")
    )


def provenance_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, r"\."), F.array(F.lit("provenance"), F.lit("warnings")))
