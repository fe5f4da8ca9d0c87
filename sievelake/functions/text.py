"""Text functions as Columns: normal forms, whole-word tests, tokens, sentences, flags, slugs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from sievelake import rules

FORMS = ["relevance", "space", "lower", "type"]
#: Blanks and word characters as in Python's re, for character classes; Java's short ones are ASCII.
SPACES, WORD = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", r"\p{L}\p{N}_"


def relevance_form(text: Column) -> Column:
    """F1 for ASCII letters: lower case, signs and white space to single spaces - which one pass does, as every run of either becomes one space."""
    return type_form(text)


def space_form(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def type_form(text: Column) -> Column:
    """runs of other signs than letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


@pandas_udf(StructType([StructField(name, StringType()) for name in FORMS]))
def whole_forms(text: pd.Series) -> pd.DataFrame:
    """F1, F2 (and F4), F3 and F5 of texts in any alphabet: no built-in has NFKC or case folding."""

    def forms(t):
        folded = t.casefold()
        relevance = re.sub(r"[^a-z0-9\s]+", " ", re.sub(r"[-_/]+", " ", unicodedata.normalize("NFKC", t).casefold()))
        return " ".join(relevance.split()), " ".join(folded.split()), " ".join(t.lower().split()), re.sub("[^a-z0-9]+", " ", folded).strip()

    return pd.DataFrame([(None,) * 4 if t is None else forms(t) for t in text], columns=FORMS)


def has_phrase(normal_text: Column, normal_phrase: Column) -> Column:
    """a phrase in whole words; both sides are in relevance form, so padding with spaces decides it without a regex."""
    return (normal_phrase != "") & F.concat(F.lit(" "), normal_text, F.lit(" ")).contains(F.concat(F.lit(" "), normal_phrase, F.lit(" ")))


def any_phrase(normal_text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [has_phrase(normal_text, F.lit(p)) for p in phrases], F.lit(False))


def tokens(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """distinct ASCII words, in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    stop = list(stopwords)
    return F.array_except(found, F.lit(stop)) if stop else found


def sentences(text: Column) -> Column:
    """pieces after a full stop, exclamation or question mark."""
    return F.split(text, f"(?<=[.!?])[{SPACES}]+")


def tri_state(text: Column, yes: str, no: str) -> Column:
    """F16: "true" before "false" before "unknown"."""
    return F.when(text.rlike(f"(?i){yes}"), "true").when(text.rlike(f"(?i){no}"), "false").otherwise("unknown")


def thousands(text: Column) -> Column:
    """an integer with thousands separators."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def intents(text: Column) -> Column:
    """F32: the intents whose trigger phrases appear, or unknown."""
    normal = relevance_form(text)
    found = F.array_compact(F.array(*[F.when(any_phrase(normal, phrases), F.lit(name)) for name, phrases in rules.INTENTS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def html_escape(text: Column) -> Column:
    """F22."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slug(text: Column, most: int = 120) -> Column:
    """K6: lower-case words joined by underscores; too long ones end in 12 digits of their digest."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    plain = F.when(plain == "", "query").otherwise(plain)
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most - 13), F.lit("_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 12)))


def shorten(text: Column, most: int = 120) -> Column:
    """F29."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def abstains(value: Column) -> Column:
    """Q11: null, empty, or a word that says that nothing was found."""
    return value.isNull() | (value == "") | value.isin(*rules.ABSTENTIONS)


def evidence_level(types: Column) -> Column:
    """The first level any of whose phrases is part of any publication type."""
    def named(phrases):
        return lambda t: reduce(lambda a, b: a | b, [F.lower(t).contains(x) for x in phrases])

    out = None
    for level, phrases in rules.EVIDENCE_LEVELS:
        hit = F.exists(types, named(phrases))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("other")


def lookup(values: dict, key: Column, default) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def recency_score(days: Column) -> Column:
    """F14."""
    out = None
    for most, score in rules.RECENCY:
        out = F.when(days <= most, score) if out is None else out.when(days <= most, score)
    return out.otherwise(rules.RECENCY_LEAST)


def overall_score(evidence: Column, relevance: Column) -> Column:
    """0.6 and 0.4 of scores that are multiples of five, so in whole numbers."""
    return (3 * F.floor(evidence / 5) + 2 * F.floor(relevance / 5)).cast("int")


def section_of(overall: Column, future: Column) -> Column:
    """F13."""
    return F.when(future, "exploratory_evidence").when(overall >= 75, "key_evidence").when(overall >= 55, "important_updates").otherwise("exploratory_evidence")


def display_value(value: Column, default: str = "Not reported") -> Column:
    """a value for people: the default where nothing is known, else words with a capital."""
    plain = F.replace(value.cast("string"), F.lit("_"), F.lit(" "))
    unknown = value.isNull() | value.cast("string").isin("", *rules.NOT_SHOWN)
    return F.when(unknown, default).otherwise(F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 30))))


def flat_sections(parts: Column) -> Column:
    """Labelled sections (structs of label and text) as one text."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["label"], F.lit(": "), p["text"])), " ")
