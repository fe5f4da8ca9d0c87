import random
import re
from itertools import combinations

import pytest

from sievelake.llm.minhash import least_matches, near_duplicates


def brute(rows, percent=85, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def corpus(seed, families=6, copies=30, edits=0.01):
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    line = " ".join(word() for _ in range(9))
    for _ in range(families):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(copies):
            out.append(" ".join(word() if rng.random() < edits else w.upper() if rng.random() < 0.1 else w for w in base))
    out += [line + " " + " ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(80)]
    out += [None, "", " \n\t", "a", "A", "a b c d", "a  b\tc  d", "a b c d e", "x" * 3000]
    out += out[:9]
    rng.shuffle(out)
    return list(enumerate(out, 5))


@pytest.mark.parametrize("block, edits", [(128, 0.01), (4, 0.015)])
def test_against_all_pairs(spark, block, edits):
    rows = corpus(block, edits=edits)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, rep int, h1 string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, block=block).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, False), (3, 3, True), (3, 3, True)]


def test_count_threshold():
    assert 36 <= least_matches(64, 0.85) <= 44


def watched(monkeypatch):
    """Row counts of the tables that an operator writes."""
    from sievelake.llm import minhash

    seen, keep = {}, minhash.Workspace.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Workspace, "keep", kept)
    return seen


def test_loose_cluster_stays_linear(spark, monkeypatch):
    """A chain of texts that overlap by half is one cluster; nothing links but its copy."""
    n, words = 400, [f"w{i}" for i in range(400 * 12 + 100)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 60])) for i in range(n)] + [(n, " ".join(words[24:84]) + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = watched(monkeypatch)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, block=16).collect()}
    assert got[n] == 2 and sum(i != c for i, c in got.items()) == 1
    assert 0 < seen["pairs"] <= 4 * n  # a text overlaps with eight others


@pytest.mark.parametrize("n, own", [(300, 20), (600, 20), (1200, 20), (600, 9)])
def test_template_texts_make_no_pairs(spark, monkeypatch, n, own):
    """Texts of one template with words of their own: all agree in their sketches, none links (similarity 0.71 and 0.78), and none meets another."""
    common = [f"c{i}" for i in range(104)]
    rows = [(i, " ".join(common + [f"o{i}x{j}" for j in range(own)])) for i in range(n)]
    seen = watched(monkeypatch)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85 if own == 20 else 90, block=32).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == n
    assert seen["members"] == n and seen["held"] == n and seen["pairs"] <= n


def test_pairs_at_the_threshold_meet(spark):
    """Every pair of parts at or over the threshold is a candidate, against all pairs of random sets of many sizes."""
    from sievelake.llm.common import Workspace
    from sievelake.llm.minhash import candidate_pairs

    rng = random.Random(4)
    base = [rng.sample(range(10**6), rng.randint(5, 60)) for _ in range(12)]
    sets = {}
    for i in range(260):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 2 else s.add(rng.randrange(3000))
        sets[i] = s
    rows = [(i, i % 90, i % 90 > 7, sorted(s)) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "rep long, part long, rest boolean, hashes array<long>")
    for percent in (80, 85, 50):
        want = {(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and a % 90 != b % 90 and (a % 90 > 7 or b % 90 > 7)}
        got = {(r.a, r.b) for r in candidate_pairs(Workspace(spark, "t"), df, percent).collect()}
        assert want <= got and len(want) > 20


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (9, b + " tail"), (9, b + " tail"), (12, a + " tail"), (20, b + " end")]
    want = None
    for k in (1, 3):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(k)).collect())
        assert want in (None, got)
        want = got
    assert {(d, c) for d, _, c in got} == {(5, 5), (9, 5), (20, 5), (12, 12)}  # b has fewer shingles, and so stands for 5


def test_names_that_clash(spark):
    from sievelake.llm.minhash import drop_near_duplicates

    docs = spark.createDataFrame([(1, "a b", 1), (2, "a b", 2), (None, "a b", 3)], "doc_id long, text string, __gone int")
    assert sorted((r[0] or 0, r[2]) for r in drop_near_duplicates(docs).collect()) == [(0, 3), (1, 1)]
