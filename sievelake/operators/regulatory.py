"""Nested regulatory JSON: field states, strict parsing, normal rows with digests, validation."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import SPACES, WORD

#: Limits and enumerations of the source (fixed values).
DEPTH, NODES, RATIO = 100, 10_000_000, 200
MARKETING = ("Prescription", "Discontinued", "None (Tentative Approval)", "Over-the-counter")
SUBMISSION = ("AP", "TA")


class RegulatoryError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def field_state(variant: Column, path: str) -> Column:
    """absent, null or present: a variant tells a missing field from one that holds null."""
    got = F.try_variant_get(variant, path, "variant")
    return F.when(got.isNull(), "absent").when(F.is_variant_null(got), "null").otherwise("present")


def strict_json(raw: bytes):
    """UTF-8 JSON without repeated keys, NaN or infinities, within depth and size."""

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise RegulatoryError("duplicate_json_key")
        return out

    def never(_):
        raise RegulatoryError("non_finite_number")

    try:
        value = json.loads(raw.decode("utf-8"), object_pairs_hook=once, parse_constant=never)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise RegulatoryError("malformed_json") from e
    seen, open_ = 0, [(value, 1)]
    while open_:
        node, depth = open_.pop()
        seen += 1
        if depth > DEPTH or seen > NODES:
            raise RegulatoryError("json_too_large")
        open_ += [(x, depth + 1) for x in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ())]
    return value


def unzip_json(raw: bytes) -> bytes:
    """The one JSON member of an archive that isn't encrypted, linked or too dense."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            members = z.infolist()
            if len(members) != 1 or not members[0].filename.endswith(".json") or members[0].is_dir():
                raise RegulatoryError("unexpected_member")
            m = members[0]
            if m.flag_bits & 1 or (m.external_attr >> 16) & 0o170000 == 0o120000 or m.file_size > RATIO * max(1, m.compress_size):
                raise RegulatoryError("unsafe_member")
            data = z.read(m)
    except zipfile.BadZipFile as e:
        raise RegulatoryError("malformed_zip") from e
    if len(data) != m.file_size:
        raise RegulatoryError("size_mismatch")
    return data


def canonical_json(text: Column) -> Column:
    """sorted keys, no spaces, letters as they are, numbers by value; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    """F21."""
    return F.sha2(text.cast("binary"), 256)


def canonical_digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


APPLICATION = "struct<application_number:string,sponsor_name:string,products:array<struct<product_number:string,brand_name:string,marketing_status:string,active_ingredients:array<struct<name:string,strength:string>>>>,submissions:array<struct<submission_type:string,submission_number:string,submission_status:string,submission_status_date:string>>>"


def normalize_applications(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """A row for each application record (JSON text): sorted children, review reasons, raw and content digests.

    Repeated applications, products or submissions come back in ``violations`` so that a caller can fail closed.
    """
    df = raw.select(F.col(text_col).alias("raw"), F.try_variant_get(F.try_parse_json(text_col), "$", APPLICATION).alias("a"))
    df = df.select("raw", "a.application_number", F.nullif("a.sponsor_name", F.lit("")).alias("sponsor_name"), F.coalesce("a.products", F.expr("cast(array() as " + APPLICATION.split("products:")[1].split(",submissions")[0] + ")")).alias("p"), F.coalesce("a.submissions", F.expr("cast(array() as array<struct<submission_type:string,submission_number:string,submission_status:string,submission_status_date:string>>)")).alias("s"))
    products = F.array_sort(F.transform("p", lambda p: F.struct(p["product_number"].alias("product_number"), F.nullif(p["brand_name"], F.lit("")).alias("brand_name"), p["marketing_status"].alias("marketing_status"), F.array_sort(p["active_ingredients"]).alias("active_ingredients"))))
    submissions = F.array_sort(F.transform("s", lambda s: F.struct(s["submission_type"].alias("submission_type"), s["submission_number"].alias("submission_number"), s["submission_status"].alias("submission_status"), F.try_to_timestamp(s["submission_status_date"], F.lit("yyyyMMdd")).cast("date").alias("submission_status_date"))))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.when(F.col("sponsor_name").isNull(), F.lit("missing_sponsor")),
        F.when(F.exists("p", lambda p: ~p["marketing_status"].isin(*MARKETING)), F.lit("unknown_marketing_status")),
        F.when(F.exists("s", lambda s: ~s["submission_status"].isin(*SUBMISSION)), F.lit("unknown_submission_status")),
    ))))
    twice = lambda items, key: F.size(items) != F.size(F.array_distinct(F.transform(items, key)))
    violations = F.array_compact(F.array(
        F.when(F.col("application_number").isNull(), F.lit("missing_application_number")),
        F.when(twice(F.col("p"), lambda p: p["product_number"]), F.lit("duplicate_product")),
        F.when(twice(F.col("s"), lambda s: F.struct(s["submission_type"], s["submission_number"])), F.lit("duplicate_submission")),
    ))
    out = df.select("application_number", "sponsor_name", products.alias("products"), submissions.alias("submissions"), reasons.alias("review_reasons"), violations.alias("violations"), canonical_json(F.col("raw")).alias("canonical"))
    content = F.to_json(F.struct("application_number", "sponsor_name", "products", "submissions"), {"ignoreNullFields": "false"})
    return out.select("*", digest(F.col("canonical")).alias("record_digest"), digest(content).alias("content_digest")).drop("canonical")


# ---- Q13: what a query expression must not hold. Letters, digits, blanks and word edges as in Python's re, so not as in Java's short classes.

_W, _D, _S = f"[{WORD}]", r"\p{Nd}", SPACES
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# Names of parameters that carry a credential and of fields that tell of a patient (a hyphen or an underscore may stand between their words),
# groups of digits of a personal number and of a phone number, and what may stand between the latter's.
CREDENTIALS = (("api", "key"), ("access", "token"), ("authorization",), ("token",), ("client", "secret"), ("password",), ("signature",), ("sig",))
PATIENT_FIELDS = (
    ("patient",), ("patient", "name"), ("patient", "id"), ("name",), ("email",), ("e", "mail"), ("ssn",), ("social", "security"), ("dob",), ("date", "of", "birth"), ("phone",), ("telephone",),
)
PERSONAL_NUMBER, PHONE_GROUPS, PHONE_SIGNS, COUNTRY = (3, 2, 4), (3, 3, 4), " .-", "1"


def names(listed: tuple[tuple[str, ...], ...]) -> str:
    return "(?:" + "|".join("[_-]?".join(words) for words in sorted(listed, key=len, reverse=True)) + ")"


def alone(inner: str) -> str:
    """With no word character before or after."""
    return f"(?<!{_W}){inner}(?!{_W})"


def digits(n: int) -> str:
    return f"{_D}{{{n}}}"


def phone_number() -> str:
    """A country and the first group (in brackets, if at all) may be followed by a sign, the second group is."""
    sign = f"[{PHONE_SIGNS}]"
    area, middle, last = map(digits, PHONE_GROUPS)
    return rf"(?:\+?{COUNTRY}{sign}?)?\(?{area}\)?{sign}?{middle}{sign}{last}"


def mail_address() -> str:
    part = f"[^{_S}@]+"
    return _EDGE + part + "@" + part + r"\." + part + _EDGE


SCOPE = {
    "credential": f"(?iu){names(CREDENTIALS)}[{_S}]*=",
    "patient_field": f"(?iu)(?<!{_W}){names(PATIENT_FIELDS)}[{_S}]*:",
    "email": mail_address(),
    "ssn": alone("-".join(map(digits, PERSONAL_NUMBER))),
    "phone": alone(phone_number()),
    "control": r"[\x00-\x1f\x7f]",
}
SCOPE_LENGTH = 2048


def scope_flags(text: Column) -> dict[str, Column]:
    """Q13: the reasons to refuse a query expression, by name, and ``safe``, which none of them leaves."""
    text = F.coalesce(text, F.lit(""))
    found = {name: text.rlike(pattern) for name, pattern in SCOPE.items()}
    found |= {"too_long": F.char_length(text) > SCOPE_LENGTH, "blank": ~text.rlike(f"[^{_S}]")}
    refused = F.lit(False)
    for flag in found.values():
        refused = refused | flag
    return found | {"safe": ~refused}


def allowed_url(url: Column, hosts: tuple[str, ...] = ()) -> Column:
    """Q14, Q15: a plain http address without query, fragment or user, of one of the hosts if any are given."""
    plain = ~url.rlike("[?#@]") & url.rlike("^https?://[a-z0-9.-]+/")
    return plain & host_of(url).isin(*hosts) if hosts else plain


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, "^(https?)://([^/?#]+)", 2)


def strict_day(text: Column) -> Column:
    """yyyyMMdd as a date; null unless it is a day of the calendar in just that form."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def source_link_ok(url: Column) -> Column:
    """Q15: a link that may be kept as text: none, or http(s) with a host, without a user, and without a credential among its parameters."""
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":[0-9]*$", "")
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return url.isNull() | ((host != "") & ~authority.contains("@") & ~asked.rlike(f"(?i)(?:^|[&;]){names(CREDENTIALS)}="))


def strict_iso_day(text: Column) -> Column:
    """yyyy-MM-dd as a date; null unless it is a day of the calendar in just that form."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def strict_utc(text: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ as a time; null unless it is one in just that form."""
    shaped = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(text, "[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss ")))


def mapping_fault(value: Column, state: Column, raw: Column) -> Column:
    """Whether a mapped value, the state of its field and the raw value contradict each other."""
    return F.coalesce(((state == "present") & ~value.eqNullSafe(raw)) | ((state != "present") & (value.isNotNull() | raw.isNotNull())), F.lit(True))


def child_faults(children: Column, key: str, value: str, state: str, raw: str) -> Column:
    """What is wrong with the children of a row (an array of structs): codes in order; empty for a valid row.

    Keys must be there and differ, states must be known, and values must be what their raw fields say.
    """
    keys = F.transform(children, lambda c: F.trim(F.coalesce(c[key].cast("string"), F.lit(""))))
    tests = (
        (F.exists(keys, lambda k: k == ""), "blank_key"),
        (F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_key"),
        (F.exists(children, lambda c: ~F.coalesce(c[state].isin("present", "null", "absent"), F.lit(False))), "unknown_state"),
        (F.exists(children, lambda c: mapping_fault(c[value], c[state], c[raw])), "raw_mapping"),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(code)) for t, code in tests]))


def violations(rows: DataFrame, key: str, faults: dict[str, Column]) -> DataFrame:
    """One row for each fault of each place; none means valid."""
    named = lambda place: lambda c: F.struct(F.lit(place).alias("place"), c.alias("fault"))
    found = F.concat(*[F.transform(codes, named(place)) for place, codes in faults.items()])
    return rows.select(key, F.inline(found))


def envelope(rows: DataFrame, source: str, fetched_at: str) -> DataFrame:
    """One row that says what a snapshot holds: source, time, rows, different ids, and a digest that no order changes."""
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.select(F.col(rows.columns[0]).alias("id"), each.alias("d")).agg(
        F.lit(source).alias("source"), F.lit(fetched_at).alias("fetched_at"), F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.sum("d").cast("string").alias("content")
    )


def verify_generation(published: DataFrame, declared: DataFrame, text: str, key: str) -> DataFrame:
    """One row: whether a published generation has the declared rows and ids, and how many of its texts hold a credential marker."""
    flags = scope_flags(F.col(text))
    found = published.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.count_if(flags["credential"]).alias("credential_markers"))
    both = found.join(declared.select(F.col("rows").alias("declared_rows"), F.col("ids").alias("declared_ids")), how="cross")  # one row by one row
    return both.withColumn("verified", (F.col("rows") == F.col("declared_rows")) & (F.col("ids") == F.col("declared_ids")) & (F.col("credential_markers") == 0))
