"""Secrets next to signs of the wider alphabet are found as they are alone."""

import random

from sievelake.llm import secretscan as S
from tests.llm.test_secretscan import entropy

SIGNS = ["sig={}", "/v1/{}", "key-{}", "a_{}", "{}/x", "https://h/p/{}?a", "+{}+", "to=/{}-end"]


def test_alone_or_not(spark):
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    secrets = [make("0123456789ABCDEF", n) for n in (20, 32, 40, 64)] + [make("0123456789abcdef", 40), make("abcdefghijklmnopqrstuvwxyz0123456789", 32), "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"]
    secrets = [s for s in secrets if entropy(s)]
    docs = [(i, x.format(s), s) for i, (s, x) in enumerate((s, x) for s in secrets for x in SIGNS)]
    df = spark.createDataFrame(docs, "doc_id long, text string, s string")
    got = {r.doc_id: r.spans for r in S.scan_secrets(df).collect()}
    for i, t, s in docs:
        (a, _, b), at = entropy(s)[0], t.index(s)
        assert any(x.kind == 3 and x.start <= at + a and x.stop >= at + b for x in got[i]), t
    assert len(secrets) >= 5


def test_what_stays_silent(spark):
    texts = ["/v1/00000000-1111-2222-3333-444444444444", "id=12345678901234567890", "/x1y/characteristicallyunbelievable/z", "id=AAAAAAAAAAAAAAAAAAAA1111", "a_1/b-2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.spans == [] for r in S.scan_secrets(df).collect())
    only = spark.createDataFrame([(1, "/v1/9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B")], "doc_id long, text string")
    assert S.scan_secrets(only, allowed=("^/v1/",)).collect()[0].spans == []
