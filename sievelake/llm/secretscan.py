"""Secrets in texts: three patterns, and sliding-window Shannon entropy per character class over candidate strings.

Everything is one projection over the documents, in built-in functions: no exchange and no Python.

A candidate is a maximal run of at least ``WINDOW`` characters of the base-64 and file-name safe alphabets that
has a digit and that the allow-list doesn't name. Its class is that of its rarest character (hex, alnum, base64).
A piece of a candidate between its signs is judged as it would be alone, by its own digit, allow-list and class, so
``key=`` or ``/v1/`` before a secret doesn't hide it; its span is given unless another entropy span covers it.
A window of ``WINDOW`` characters slides over it with the count of every symbol and the sum of n log2 n kept from
step to step; the span reaches from the first to the last window whose entropy is at least the class's bound.

Defined results: a null text is an empty one; empty texts have no spans; offsets are code points, ends exclusive;
repeated rows give equal values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import let, text_or_empty

#: Patterns of the three kinds (fixed values).
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
LANES = 12
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_-="
CANDIDATE = rf"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*[0-9])[0-9A-Za-z+/_=-]{{{WINDOW},}}"
PIECE = rf"(?<![0-9A-Za-z])(?=[A-Za-z]*[0-9])[0-9A-Za-z]{{{WINDOW},}}"
#: Bits of entropy in a window of 20 characters from which a class's string counts as random.
BOUNDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.9}
#: Strings that look random and aren't: numbers, UUIDs, paths and slugs of words, the same few symbols again. Quantifiers of
#: groups are possessive: those run in a loop, while others recurse once a repeat and overflow the stack on long tokens.
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/*+(?:[A-Za-z]{2,}+|[0-9]{1,4}+)(?:[/_=-]++(?:[A-Za-z]{2,}+|[0-9]{1,4}+))*+/*+$",
    r"^(.{1,4}?)\1++$",
)
SPANS = "array<struct<start:long,kind:int,stop:long>>"


def located(text: Column, pattern: str, found: Column, chunk: int = 256) -> Column:
    """Start and text of every match: what lies between the matches and the matches themselves, laid end to end.

    Ends are summed in chunks, so that the copies of a growing array stay short however many matches there are.
    """
    none = F.expr("cast(array() as array<struct<start:bigint,text:string>>)")
    pairs = F.arrays_zip(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda b: F.char_length(b).cast("long")).alias("before"), found.alias("text"))
    start = lambda at, z: at["end"] + z["before"]
    step = lambda at, z: F.struct((start(at, z) + F.char_length(z["text"])).alias("end"), F.concat(at["all"], F.array(F.struct(start(at, z).alias("start"), z["text"].alias("text")))).alias("all"))
    part = lambda p, c, at: F.aggregate(F.slice(p, c * chunk + 1, chunk), F.struct(at["end"].alias("end"), none.alias("all")), step)
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.expr("cast(array() as array<array<struct<start:bigint,text:string>>>)").alias("all"))
    join = lambda at, r: F.struct(r["end"].alias("end"), F.concat(at["all"], F.array(r["all"])).alias("all"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / chunk).cast("int"))
    every = let(pairs, lambda p: F.flatten(F.aggregate(chunks, begin, lambda at, c: let(part(p, c, at), lambda r: join(at, r)), lambda at: at["all"])))
    return F.when(F.size(found) > 0, every).otherwise(none)


def window_entropy(text: Column, bound: Column, window: int = WINDOW) -> Column:
    """First and last start (from 0) of a window of at least so many bits: {first, last}, nulls without one.

    The counts of all symbols are kept from step to step, ``LANES`` of five bits in a long.
    """
    if not 2 <= window <= 31:
        raise ValueError("a window has 2 to 31 characters")
    logs = F.lit([0.0] + [n * math.log2(n) for n in range(1, window + 2)])
    begin = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // LANES)).alias("count"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    lane = lambda code: F.floor(code / LANES).cast("int")
    place = lambda code: 5 * (code % LANES)
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), place(code))
    held = lambda count, code: F.call_function("shiftright", F.get(count, lane(code)), place(code)).bitwiseAND(F.lit(31)).cast("int")

    def bits(total):
        return F.lit(math.log2(window)) - total / F.lit(float(window))

    def moved(at, new, old, i, least):
        n_new, n_old = held(at["count"], new), held(at["count"], old)
        change = F.when(new == old, F.lit(0.0)).otherwise(F.get(logs, n_new + 1) - F.get(logs, n_new) + F.when(old >= 0, F.get(logs, n_old - 1) - F.get(logs, n_old)).otherwise(F.lit(0.0)))
        total = at["sum"] + change
        high = (i >= window - 1) & (bits(total) >= least)
        count = F.transform(at["count"], lambda n, j: n + F.when(j == lane(new), one(new)).otherwise(F.lit(0)) - F.when((old >= 0) & (j == lane(old)), one(old)).otherwise(F.lit(0)))
        return F.struct(
            count.alias("count"),
            total.alias("sum"),
            F.when(at["first"].isNull() & high, i - (window - 1)).otherwise(at["first"]).cast("int").alias("first"),
            F.when(high, i - (window - 1)).otherwise(at["last"]).cast("int").alias("last"),
        )

    def step(codes, least, at, i):
        return moved(at, F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1)), i, least)

    def slide(codes, least):
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, lambda at, i: step(codes, least, at, i), lambda at: F.struct(at["first"].alias("first"), at["last"].alias("last")))

    # the bound is taken from the whole string, so it is bound to a variable too, else every step would read the string again
    return let(bound, lambda least: let(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda codes: slide(codes, least)))


def spans_of(found: Column, kind: str, keep=lambda m: F.lit(True)) -> Column:
    return F.transform(F.filter(found, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.char_length(m["text"])).cast("long").alias("stop")))


def scan_secrets(docs: DataFrame, *, allowed: tuple[str, ...] = ALLOWED, bounds: dict[str, float] = BOUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``base`` (spans of the three patterns) and ``spans`` (those of the entropy windows too), each by start and kind."""
    text, every = F.col("text"), lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    none = F.expr("cast(array() as array<string>)")
    has = lambda word: text.contains(word)
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    df = df.select("*", every(ASSIGN).alias("m0"), F.when(has("AKIA"), every(ACCESS)).otherwise(none).alias("m1"), every(HEX).alias("m2"), every(CANDIDATE).alias("m3"))
    df = df.select(
        "doc_id",
        F.when(F.size("m0") > 0, every(ASSIGN, 2)).otherwise(none).alias("values"),
        located(text, ASSIGN, F.col("m0")).alias("f0"),
        located(text, ACCESS, F.col("m1")).alias("f1"),
        located(text, HEX, F.col("m2")).alias("f2"),
        located(text, CANDIDATE, F.col("m3")).alias("f3"),
    )
    assign = F.filter(F.arrays_zip(F.col("f0").alias("f"), F.col("values").alias("value")), lambda z: F.char_length(z["value"]) >= 6)
    known = lambda t: ~_any([t.rlike(p) for p in allowed])
    judged = F.transform(F.filter("f3", lambda m: known(m["text"])), lambda m: judge(m, known, bounds))
    df = df.select(
        "doc_id",
        F.array_sort(
            F.concat(
                spans_of(F.transform(assign, lambda z: z["f"]), "assign"),
                spans_of(F.col("f1"), "access", lambda m: F.char_length(m["text"]) >= 20),
                spans_of(F.col("f2"), "hex"),
            )
        )
        .cast(SPANS)
        .alias("base"),
        F.when(F.size("f3") > 0, F.flatten(judged)).cast(SPANS).alias("more"),
    )
    return df.select("doc_id", "base", F.when(F.col("more").isNull() | (F.size("more") == 0), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def judge(m: Column, known, bounds: dict[str, float]) -> Column:
    """The entropy spans of a candidate: its own and those of its pieces between signs that no other one covers."""
    bound = lambda t: F.when(t.rlike("^[0-9a-fA-F]+$"), bounds["hex"]).when(t.rlike("^[0-9A-Za-z]+$"), bounds["alnum"]).otherwise(bounds["base64"])
    span = lambda x: let(window_entropy(x["text"], bound(x["text"])), lambda w: F.struct((m["start"] + x["start"] + w["first"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + x["start"] + w["last"] + WINDOW).alias("stop")))
    none = F.expr("cast(array() as array<struct<start:bigint,text:string>>)")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), m["text"].alias("text")))
    cut = let(F.regexp_extract_all(m["text"], F.lit(PIECE), F.lit(0)), lambda f: located(m["text"], PIECE, f))
    parts = F.when(m["text"].rlike("[+/_=-]"), F.filter(cut, lambda p: known(p["text"]))).otherwise(none)
    found = lambda xs: F.filter(F.transform(xs, span), lambda s: s["start"].isNotNull())
    covers = lambda a, b: (a["start"] <= b["start"]) & (a["stop"] >= b["stop"])
    # pieces lie apart, so only the candidate's own span can cover one, and only a single one its
    merged = lambda own, more: F.concat(F.filter(own, lambda o: ~F.exists(more, lambda s: covers(s, o) & (s != o))), F.filter(more, lambda s: ~F.exists(own, lambda o: covers(o, s))))
    return let(found(whole), lambda own: let(found(parts), lambda more: merged(own, more)))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def joined(spans: Column) -> Column:
    name = lambda s: F.get(F.lit(list(KINDS)), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
