"""Q13 against a scan by hand, on hand-made expressions and on the driver's documents."""

import unicodedata

from sievelake.operators.regulatory import scope_flags
from sievelake.plans import registry

TEXTS = [
    None, "", " \x1c　", "aspirin AND heart", "a\tb", "x\x7f", "é" * 2048, "é" * 2049, "𝄞" * 2048,
    "call 555-867-5309 now", "(555) 867-5309", "+1 555.867.5309", "555 8675309", "é555-867-5309", "555-867-5309é", "²555-867-5309", "٥٥٥-٨٦٧-٥٣٠٩",
    "123-45-6789", "x123-45-6789", "123-45-67890", "ä123-45-6789", "٠١٢-٣٤-٥٦٧٨",
    "patient_id: 7", "PATIENT: x", "inpatient: x", "épatient: x", "e-mail :x", "dob :", "ſſn: 1", "tradename:x", "brand_name:x",
    "api key=1", "api-key =1", "ſig=1", "toKen=1", "author=1", "PASSWORD\x1c=1", "sıg=1", "sİg=1",
    "a@b.c", "ä@ö.ü", "!@b.c", "a!@b.c", "a@b.!", "a@b", "x@@b.c", *[f"sig{chr(c)}=" for c in (0x85, 0xA0, 0x1680, 0x2000, 0x2005, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)],
]


def word(text, i):
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def digit(c):
    return unicodedata.category(c) == "Nd"


def edge(text, i):
    return word(text, i - 1) != word(text, i)


def folded(text):
    """One character for one, as matching without regard to case has it: long s is s, the dotted and the dotless i are i, the Kelvin sign is k."""
    return "".join({"\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k"}.get(c, c.lower() if len(c.lower()) == 1 else c) for c in text)


def named(text, entries, sign, alone):
    """Whether one of some names stands before a sign, blanks between them aside; names' words may be joined by a hyphen or an underscore."""
    text = folded(text)
    for i in range(len(text)):
        if alone and word(text, i - 1):
            continue
        for words in entries:
            ends = {i}
            for n, w in enumerate(words):
                ends = {e + len(w) for e in ends | ({e + 1 for e in ends if text[e : e + 1] in ("-", "_")} if n else set()) if text.startswith(w, e)}
            for e in ends:
                while e < len(text) and text[e].isspace():
                    e += 1
                if text[e : e + 1] == sign:
                    return True
    return False


def groups(text, i, *steps):
    """Where a row of steps can end that begins at i; a step is a number of digits, or a string of signs of which one stands (a leading ``?``: or none)."""
    ends = {i}
    for step in steps:
        after = set()
        for e in ends:
            if isinstance(step, int):
                after |= {e + step} if len(text) >= e + step and all(map(digit, text[e : e + step])) else set()
            else:
                after |= {e + 1} if text[e : e + 1] and text[e] in step.removeprefix("?") else set()
                after |= {e} if step.startswith("?") else set()
        ends = after
    return ends


def stands_alone(text, *rows):
    return any(not word(text, e) for i in range(len(text)) if not word(text, i - 1) for steps in rows for e in groups(text, i, *steps))


def mail(text):
    inside = lambda c: not c.isspace() and c != "@"
    for at in (i for i, c in enumerate(text) if c == "@"):
        left, right = at, at + 1
        while left and inside(text[left - 1]):
            left -= 1
        while right < len(text) and inside(text[right]):
            right += 1
        starts = any(edge(text, i) for i in range(left, at))
        stops = any(edge(text, e) for e in range(at + 4, right + 1) if "." in text[at + 2 : e - 1])
        if starts and stops:
            return True
    return False


CREDENTIALS = [x.split() for x in ("api key", "access token", "authorization", "token", "client secret", "password", "signature", "sig")]
FIELDS = [x.split() for x in ("patient", "patient name", "patient id", "name", "email", "e mail", "ssn", "social security", "dob", "date of birth", "phone", "telephone")]
LOCAL = ("?(", 3, "?)", "? .-", 3, " .-", 4)
PHONES = (LOCAL, ("?+", "1", "? .-", *LOCAL))


def brute(t):
    t = t or ""
    out = {"credential": named(t, CREDENTIALS, "=", False), "patient_field": named(t, FIELDS, ":", True), "email": mail(t), "ssn": stands_alone(t, (3, "-", 2, "-", 4)), "phone": stands_alone(t, *PHONES)}
    out |= {"control": any(ord(c) < 32 or ord(c) == 127 for c in t), "too_long": len(t) > 2048, "blank": not t.strip()}
    return out | {"safe": not any(out.values())}


def test_against_a_scan(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in df.select("text", *[f.alias(n) for n, f in scope_flags(df["text"]).items()]).collect():
        assert {k: v for k, v in r.asDict().items() if k != "text"} == brute(r.text), r.text


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in registry.queries()["query_scope_screen"](spark, d).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}
    n = {k: sum(g[k] for g in got.values()) for k in next(iter(got.values()))}
    assert [n[k] for k in ("credential", "email", "phone")] == [12, 11, 18]
