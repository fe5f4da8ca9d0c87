"""Vocabulary lookups over landed responses: ids and properties of a term, approved classes, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import space_form
from sievelake.operators.records import last_wins

#: Vocabularies and relations that a class must come from (fixed values).
CLASS_SOURCES, CLASS_RELATIONS = ("ATC", "MEDRT"), ("has_member", "isa", "part_of")


def cache_key(term: Column) -> Column:
    """The digest of the term without regard to case and white space."""
    return F.sha2(space_form(term).cast("binary"), 256)


def lookup_ids(found: DataFrame, properties: DataFrame, term: str, code: str, order: Column) -> DataFrame:
    """For each term its different ids, numbered in the order of the response, with each id's properties."""
    first = found.groupBy(term, code).agg(F.min(order).alias("__at"))
    ids = first.groupBy(term).agg(F.array_sort(F.collect_list(F.struct("__at", code))).alias("__ids"))
    return ids.select(term, F.posexplode("__ids").alias("position", "x")).select(term, "position", F.col(f"x.{code}").alias(code)).join(properties, code, "left")


def approved(classes: DataFrame, source: str, relation: str) -> DataFrame:
    """Q8: rows of an approved vocabulary and of a structural relation."""
    return classes.filter(F.upper(source).isin(*CLASS_SOURCES) & F.lower(relation).isin(*CLASS_RELATIONS))


def parent_classes(classes: DataFrame, member: str, class_id: str, label: str, source: str, relation: str, order: Column) -> DataFrame:
    """The approved classes of each member; of repeated ones the last, to be ordered by ``class_order``."""
    return last_wins(approved(classes, source, relation), [member, class_id], order).select(member, class_id, label, source, relation)


def class_order(source: str, label: str, class_id: str) -> list[Column]:
    return [F.col(source), F.col(label), F.col(class_id)]
