import math
import random
import re
from collections import Counter

from sievelake.llm.decontam import BLOCKS, contaminated, masks, drop_contaminated, simhash


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, k=5, similarity=0.8):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            q = words(x)
            n, kk = len(q), min(k, len(q))
            if not n:
                continue
            bag = lambda v: Counter(tuple(v[j : j + kk]) for j in range(len(v) - kk + 1))
            b = bag(q)
            for s in range(len(w) - n + 1):
                a = bag(w[s : s + n])
                if sum((a & b).values()) / sum((a | b).values()) >= similarity:
                    out.add((d, i))
                    break
    return out


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéf") for _ in range(rng.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice([15, 20, 21, 40]))) for i in range(20)] + [(90, "one two"), (91, ""), (92, None), (93, "Zz " * 12)]
    docs = []
    for i in range(60):
        x = rng.choice(items[:20])[1].split(" ")
        if i % 3 == 0:
            x[rng.randrange(len(x))] = word()
        body = " ".join(x).upper() if i % 4 == 0 else ",\n".join(x)
        docs.append((i, prose(rng.randint(0, 50)) + " " + (body if i % 5 else " ".join(x[: len(x) // 2])) + ". " + prose(rng.randint(0, 50))))
    docs += [(100, None), (101, ""), (102, "One, two"), (103, "zz " * 500), (104, docs[1][1]), (105, docs[1][1]), (106, " ".join(items[1][1].split() + items[2][1].split()) * 2)]
    return docs, items


def test_against_all_windows(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, size int").repartition(4)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}
    assert got == want and len(want) > 20
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(d, none).collect() == [] and contaminated(d.limit(0), b).collect() == []


def test_fingerprint_and_blocks(spark):
    rng = random.Random(1)
    bags = [[rng.getrandbits(64) - 2**63 for _ in range(rng.randint(1, 40))] for _ in range(10)]
    got = {r.i: r.print for r in simhash(spark.createDataFrame(list(enumerate(bags)), "i int, bag array<long>"), ["i"]).collect()}
    for i, bag in enumerate(bags):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in bag) > len(bag))
        assert got[i] % 2**64 == want
    for radius, most in ((3, 0), (11, 2), (15, 3)):
        assert len(set(masks(radius // BLOCKS))) == sum(math.comb(16, n) for n in range(most + 1))


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2), (2, "q", 3, 4), (None, None, 5, 6)], "doc_id long, text string, __k1 int, k2 int")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert sorted((r[0] or 0, r[2], r[3]) for r in drop_contaminated(docs, items).collect()) == [(0, 5, 6), (2, 3, 4)]


def test_recall_near_the_threshold(spark):
    """Passages of similarity 0.8 to 0.95: single words replaced in items of 57 to 100 words, or near the end of shorter ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(57, 100) if i % 2 else 40))) for i in range(60)]
    docs = []
    for i in range(240):
        x = items[i % 60][1].split(" ")
        x[rng.randrange(5, len(x) - 5) if i % 2 else len(x) - rng.randint(1, 4)] = word()
        docs.append((i, " ".join([word() for _ in range(rng.randint(0, 60))] + x + [word() for _ in range(30)])))
    want = {x for i, t in docs for x in brute([(i, t)], [items[i % 60]])}
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.9 * len(want)
