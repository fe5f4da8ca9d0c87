"""Children of records against the raw records that they say they come from.

A record is a VARIANT with lists of children; each child has its values and, in ``source_fields``, for every field the state
(present, null, absent), the path and the raw value that were read. Children and raw children are exploded together, with their places;
a child's index is parsed from its path; both are read before they meet, and what a child says of itself is judged then. So what meets, by
(record, index) in one grouping, is codes and the short texts that a raw child must have, and where records are dealt by their keys already
nothing is exchanged. What is wrong comes out as rows: (record, child, index, field, code), none for a valid record.

| code | what is wrong |
|-|-|
| bad_shape | the child or an entry of its source fields isn't an object of just the members that it should have |
| bad_path | the path isn't ``<record>.<container>[<index>].<field>``, or differs in its index from the child's other paths |
| no_raw, no_child | there is no raw child of that index; no child says that it comes from a raw one |
| repeated_index, repeated_key | two children of a record say that they come from one raw child; two have one key |
| bad_state | no known state, or one that the raw value contradicts |
| raw_differs | state or raw value are not those of the raw child |
| value_differs | the value isn't what the raw one maps to (text as it is, empty text: null; a day from yyyyMMdd; a required one: not blank) |
| bad_value | not one of the allowed words |

Defined results: a record whose list is null, absent or empty has no children; a list that isn't one is ``bad_shape`` of the record; a record
without a raw one has no_raw for each child; rows that repeat a record's key count as one record, so their children are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.operators.regulatory import strict_day
from sievelake.operators.trees import SIMPLE, canonical, is_list, once

STATES = ("present", "null", "absent")
ENTRY = ("path", "raw_value", "state")
NULL = "null"


@dataclass(frozen=True)
class Container:
    """How children of one list look: their fields, which of them is the key, which are required or days, which words a field may have; lists below them."""

    name: str
    fields: tuple[str, ...]
    key: str
    required: tuple[str, ...] = ()
    days: tuple[str, ...] = ()
    words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lists: tuple[str, ...] = ()


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def exploded(records: DataFrame, keys: Sequence[str], value: Column, *more: Column) -> DataFrame:
    """``keys``, ``more``, pos and value of each element of a list."""
    rows = records.select(*keys, *more, F.when(is_list(value), value).alias("list"))
    return rows.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("list").outer())).drop("list", "key")


def index_of(child: Column, place: Column, c: Container) -> Column:
    """The index that the path of a child's key says, or null."""
    path, before = text(member(child, f"source_fields.{c.key}.path")), F.concat(place, F.lit(f".{c.name}["))
    rest = F.when(F.startswith(path, before), F.substring(path, F.char_length(before) + 1, F.char_length(path)))
    return F.when(rest.rlike(rf"^(0|[1-9][0-9]{{0,8}})\]\.{c.key}$"), F.regexp_extract(rest, "^[0-9]+", 0).cast("int"))


def paired(records: DataFrame, keys: Sequence[str], c: Container, *, doc: str = "doc", raw: str = "raw", place: str = "place") -> DataFrame:
    """Children and raw children by (record, index): keys, place, at (the child's place in its list), child, index, original."""
    children = exploded(records, keys, member(F.col(doc), c.name), F.col(place).alias("place")).withColumnRenamed("pos", "at").withColumnRenamed("value", "child")
    children = children.withColumn("index", index_of(F.col("child"), F.col("place"), c))
    raws = exploded(records, keys, member(F.col(raw), c.name), F.col(place).alias("raw_place")).withColumnRenamed("pos", "index").withColumnRenamed("value", "original")
    both = children.join(raws, [*keys, "index"], "full_outer")
    return both.select(*keys, F.coalesce("place", "raw_place").alias("place"), "at", "child", "index", "original")


def text(value: Column) -> Column:
    """The string that a variant is; null if it is none."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def has_members(value: Column, names: Sequence[str]) -> Column:
    found = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.array_sort(found) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def regular(value: Column, shape: dict) -> Column:
    """A variant as a struct, if it is an object of just these members, all of them strings that JSON writes as they stand (nested: shapes of their own); else null."""
    told = lambda x: "OBJECT<" + ", ".join(f"{n}: {told(x[n]) if x[n] else 'STRING'}" for n in sorted(x)) + ">"
    kind = lambda x: "struct<" + ", ".join(f"{n}: {kind(x[n]) if x[n] else 'string'}" for n in sorted(x)) + ">"
    each = lambda at, x: [y for n in x for y in (each(at[n], x[n]) if x[n] else [at[n]])]
    found = F.when(F.schema_of_variant(value) == told(shape), F.try_variant_get(value, "$", kind(shape)))
    return once(found, lambda s: F.when(F.concat(*each(s, shape)).rlike(SIMPLE), s))


def with_reading(both: DataFrame, c: Container) -> DataFrame:
    """Pairs with what the tests of every field look at, each read once; children and raw children themselves go, so that they aren't shuffled again.

    Regular ones, as nearly all are, are read by one cast; the others member by member.
    """
    child, original = F.col("child"), F.col("original")
    kept = [x for x in both.columns if x not in ("child", "original")]
    names = all(re.fullmatch("[a-z][a-z0-9_]*", n) for n in c.fields)
    none = F.lit(None).cast("struct<" + ", ".join(f"`{n}`: string" for n in c.fields) + ">")
    shape = dict.fromkeys(c.fields)
    easy = regular(child, shape | {"source_fields": {n: dict.fromkeys(ENTRY) for n in c.fields}}) if names else none
    rows = both.select(*kept, "child", "original", easy.alias("easy"), (regular(original, shape) if names else none).alias("easy_raw"))
    is_easy, as_json = F.col("easy").isNotNull(), lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    either = lambda fast, slow: F.when(is_easy, fast).otherwise(slow) if names else slow
    first = ["easy", either(F.lit(False), ~has_members(child, (*c.fields, "source_fields"))).alias("odd_child"), either(F.lit(False), ~has_members(member(child, "source_fields"), c.fields)).alias("odd_sources")]
    for i, name in enumerate(c.fields):
        own, fast = member(child, name), F.col("easy")[name]
        theirs = F.coalesce(as_json(F.col("easy_raw")[name]), canonical(member(original, name)))
        first += [F.when(~is_easy, member(child, f"source_fields.{name}")).alias(f"entry_{i}"), either(as_json(fast), canonical(own)).alias(f"value_{i}"), either(fast, text(own)).alias(f"word_{i}"), theirs.alias(f"found_{i}")]
    rows = rows.select(*kept, *first)
    second = []
    for i, name in enumerate(c.fields):
        entry = F.col(f"entry_{i}")
        raw = member(entry, "raw_value")
        said = (lambda x, name=name: F.col("easy")["source_fields"][name][x]) if names else (lambda x: None)
        second += [F.col(f"{x}_{i}") for x in ("value", "word", "found")]
        second += [
            either(F.lit(False), ~has_members(entry, ENTRY)).alias(f"odd_{i}"), either(said("state"), text(member(entry, "state"))).alias(f"state_{i}"), either(said("path"), text(member(entry, "path"))).alias(f"path_{i}"),
            either(as_json(said("raw_value")) if names else None, canonical(raw)).alias(f"raw_{i}"), either(said("raw_value"), F.try_variant_get(raw, "$", "string")).alias(f"text_{i}"),
        ]
    return rows.select(*kept, "odd_child", "odd_sources", *second)


def field_faults(c: Container, i: int) -> Column:
    """The faults of one field of a child by itself, as an array of codes; columns are those of ``with_reading``. Only ``raw_differs`` needs the raw child."""
    name, place = c.fields[i], F.col("place")
    state, as_text = F.col(f"state_{i}"), F.col(f"text_{i}")
    raw, value = (F.coalesce(f"{x}_{i}", F.lit("null")) for x in ("raw", "value"))
    path = F.concat(place, F.lit(f".{c.name}["), F.col("index").cast("string"), F.lit(f"].{name}"))
    known = F.coalesce(state.isin(*STATES), F.lit(False))
    tests = [
        (F.col(f"odd_{i}"), "bad_shape"),
        (F.col("index").isNotNull() & ~path.eqNullSafe(F.col(f"path_{i}")), "bad_path"),
        (~known | ((state == "present") == (raw == "null")), "bad_state"),
    ]
    if name not in c.lists:
        is_text = raw.startswith('"')
        if name in c.required:
            right = (state == "present") & is_text & (F.trim(as_text) != "") & (value == raw)
        else:
            mapped = F.concat(F.lit('"'), strict_day(as_text).cast("string"), F.lit('"')) if name in c.days else F.when(raw != '""', raw)
            right = F.when(state == "present", is_text & (value == F.coalesce(mapped, F.lit("null"))) & (mapped.isNotNull() | (raw == '""'))).otherwise(value == "null")
        tests.append((~F.coalesce(right, F.lit(False)), "value_differs"))
    if name in c.words:
        tests.append((~F.coalesce(F.col(f"word_{i}").isin(*c.words[name]), F.lit(False)) & (value != "null"), "bad_value"))
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in tests]))


def brief(text: Column) -> Column:
    """A canonical text, or the digest of a long one (which no canonical text looks like): equal where the texts are."""
    return F.when(F.char_length(text) > 40, F.concat(F.lit("#"), F.sha2(text.cast("binary"), 256))).otherwise(text)


def sides(records: DataFrame, keys: Sequence[str], c: Container, *, doc: str, raw: str, place: str) -> DataFrame:
    """``keys``, place, broken (the list isn't one), at (null: a raw child), index, and child or original, of children and raw children as rows."""
    listed = member(F.col(doc), c.name)
    broken = F.when(~is_list(listed) & (canonical(listed) != NULL), F.parse_json(F.lit("[0]")))  # one row that is neither side's
    lists = F.array(*[F.struct(F.lit(ours).cast("boolean").alias("ours"), value.alias("list")) for ours, value in ((True, listed), (False, member(F.col(raw), c.name)), (None, broken))])
    both = records.select(*keys, F.col(place).alias("place"), F.explode(lists).alias("side"))
    rows = exploded(both, keys, F.col("side.list"), F.col("place"), F.col("side.ours").alias("ours"))
    child, original = F.when(F.col("ours"), F.col("value")), F.when(~F.col("ours"), F.col("value"))
    rows = rows.select(*keys, "place", F.col("ours").isNull().alias("broken"), F.when(F.col("ours"), F.col("pos")).alias("at"), F.when(~F.col("ours"), F.col("pos")).alias("pos"), child.alias("child"), original.alias("original"))
    return rows.select(*keys, "place", "broken", "at", F.when(F.col("at").isNull(), F.col("pos")).otherwise(index_of(F.col("child"), F.col("place"), c)).alias("index"), "child", "original")


def own_faults(rows: DataFrame, keys: Sequence[str], c: Container) -> DataFrame:
    """Children judged by themselves (whole and fields, arrays of codes) with their key's text and what their raw child must have; of raw children, what they have."""
    read = with_reading(rows, c)
    there = F.col("at").isNotNull()
    shape = F.when(there & (F.col("odd_child") | F.col("odd_sources")), "bad_shape")
    path = F.when(there & F.col("index").isNull(), "bad_path")
    kept, has = [*keys, "broken", "at", "index", F.col(f"word_{c.fields.index(c.key)}").alias("name")], []
    for i in range(len(c.fields)):
        state, raw, found = F.col(f"state_{i}"), F.coalesce(f"raw_{i}", F.lit(NULL)), F.col(f"found_{i}")
        must = F.when((state == "absent") & (raw == NULL), "").when((state == "null") & (raw == NULL), NULL).when((state == "present") & (raw != NULL), brief(raw))
        has.append(F.when(there, must).otherwise(F.coalesce(brief(found), F.lit(""))).alias(f"f{i}"))
    fields = F.when(there, F.array(*[field_faults(c, i) for i in range(len(c.fields))]))
    return read.select(*kept, F.array_compact(F.array(shape, path)).alias("whole"), fields.alias("fields"), F.struct(*has).alias("has"))


def reconcile(records: DataFrame, keys: Sequence[str], c: Container, *, doc: str = "doc", raw: str = "raw", place: str = "place") -> DataFrame:
    """``keys``, at, index, field (``''``: the child as a whole) and code of everything that is wrong with the children of one list."""
    rows = own_faults(sides(records, keys, c, doc=doc, raw=raw, place=place), keys, c)
    there, by_index = F.col("at").isNotNull(), Window.partitionBy(*keys, "index")
    # a child pairs with each raw child of its index (more than one only where a record's rows repeat), a raw one without a child stands alone
    rows = rows.withColumns({"raws": F.collect_list(F.when(~there & ~F.col("broken"), F.col("has"))).over(by_index), "children": F.count_if(there).over(by_index)})
    pairs = F.when(there, F.greatest(F.size("raws"), F.lit(1))).otherwise(0)
    rows = rows.filter(there | F.col("broken") | (F.col("children") == 0)).withColumn("pairs", pairs)
    rows = rows.withColumn("named", F.when(F.col("name").isNotNull(), F.sum("pairs").over(Window.partitionBy(*keys, "name"))))
    rows = rows.select("*", F.explode_outer(F.when(there, F.col("raws"))).alias("original"))
    as_whole = [
        (there & F.col("index").isNotNull() & F.col("original").isNull(), "no_raw"),
        (~there, "no_child"),
        (there & F.col("index").isNotNull() & (F.col("children") * F.col("pairs") > 1), "repeated_index"),
        (there & (F.col("named") > 1), "repeated_key"),
    ]
    one = lambda name, codes: F.transform(codes, lambda code: F.struct(F.lit(name).alias("field"), code.alias("code")))
    whole = one("", F.concat("whole", F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in as_whole]))))
    differs = lambda i: F.when(F.col("original").isNotNull() & ~F.col(f"has.f{i}").eqNullSafe(F.col(f"original.f{i}")), "raw_differs")
    each = reduce(F.concat, [F.when(there, one(f, F.concat(F.get("fields", i), F.array_compact(F.array(differs(i)))))).otherwise(F.expr("cast(array() as array<struct<field:string,code:string>>)")) for i, f in enumerate(c.fields)])
    found = F.when(F.col("broken"), one(c.name, F.array(F.lit("bad_shape")))).otherwise(F.concat(whole, each))
    return rows.select(*keys, "at", "index", F.inline(found))


def below(records: DataFrame, keys: Sequence[str], c: Container, *, at: str, doc: str = "doc", raw: str = "raw", place: str = "place") -> DataFrame:
    """Children as records of their own (``keys`` and ``at``, doc, raw, place), for the lists that they hold."""
    both = paired(records, keys, c, doc=doc, raw=raw, place=place).filter("child is not null")
    own = F.concat("place", F.lit(f".{c.name}["), F.coalesce(F.col("index").cast("string"), F.lit("?")), F.lit("]"))
    return both.select(*keys, F.col("at").alias(at), F.col("child").alias("doc"), F.col("original").alias("raw"), own.alias("place"))
