"""Documents of fewer words than an item, against brute force."""

import random
from collections import Counter

from sievelake.llm.decontam import contaminated, drop_contaminated
from tests.llm.test_decontam import words


def brute(docs, items, k=5, similarity=0.8):
    """Best similarity and the first start of it, by document and item; a text shorter than the item is one window."""
    out = {}
    for d, t in docs:
        for i, x in items:
            w, q = words(t), words(x)
            n, kk = len(q), min(k, len(q))
            bag = lambda v: Counter(tuple(v[j : j + kk]) for j in range(len(v) - kk + 1))
            for s in range(max(1, len(w) - n + 1)):
                a, b = bag(w[s : s + n]), bag(q)
                found = sum((a & b).values()) / max(1, sum((a | b).values()))
                if found >= similarity and found > out.get((d, i), (0,))[0]:
                    out[d, i] = (found, s, len(w[s : s + n]))
    return out


def test_short_documents(spark):
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    long, short = prose(50), prose(20)
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, "one two three")]
    cuts = [long[:-1], long[1:], long[4:-4], long[:40], long[:42], long[:25], ["odd", *long[:-3]], short[:18], short[1:17], short, ["one", "two"], ["one"], []]
    docs = [(i, " ".join(x)) for i, x in enumerate(cuts)] + [(90, None), (91, " ".join(short[:-1] + long[:-2])), (92, " ".join(long[:-1]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(0, 1), (1, 1), (7, 2), (92, 1)} <= set(want) and (5, 1) not in want
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.words) for r in contaminated(d, b).collect()}
    assert got == want
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}
