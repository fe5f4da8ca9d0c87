import random
import zlib
from itertools import product

import numpy as np
import pytest

from sievelake.llm.toxicity import CLASS, SIDE, Channel, Restorer, letter_counts, score_toxicity

TEXTS = ["the idiot is a loser and the class is a list of items"] * 40 + ["moron assist still silly idiots loses the toast"] * 20


def counts(texts):
    out = np.zeros(SIDE**3, np.int64)
    for t in texts:
        c = [26, 26, *(CLASS[b] for b in t.encode()), 26, 26]
        for a, b, d in zip(c, c[1:], c[2:]):
            out[(a * SIDE + b) * SIDE + d] += 1
    return out


CHANNEL = Channel(counts(TEXTS))


def brute(token):
    """The best of all paths."""
    runs, at = [], 0
    while at < len(token):
        n = len(token[at:]) - len(token[at:].lstrip(token[at]))
        runs.append(CHANNEL.options(token[at], n))
        at += n
    best = (-1e9, "")
    for path in product(*runs):
        text, score, a, b = "".join(p[0] for p in path), sum(p[1] for p in path), 26, 26
        for c in text + " ":
            code = ord(c) - 97 if "a" <= c <= "z" else 26
            score += CHANNEL.log[a][b][code]
            a, b = b, code
        best = max(best, (score, text))
    return best[1]


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("l0s3r", "loser"), ("iiiddiooot", "idiot"), ("m-o-r-0-n", "moron"), ("id!ot", "idiot")])
def test_decodes(token, word):
    assert CHANNEL.decode(token) == word == brute(token)


def test_best_path():
    rng = random.Random(2)
    for _ in range(60):
        token = "".join(rng.choice("aeiost1!5$|.-") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))
        got, want = CHANNEL.decode(token), brute(token)
        assert got == want, token


def test_words():
    r = Restorer(CHANNEL)
    assert {"idiot", "loser", "list"} <= r.words("An 1D10T!! (l o s e r), list$$$")
    assert r.words("") == set()


def docs_and_labels(spark, n=600):
    rng, rows, labels = random.Random(4), [], []
    word = lambda: "".join(rng.choice(["la", "ti", "on", "er", "th", "es"]) for _ in range(rng.randint(1, 4)))
    bad = ["idiot", "moron", "loser"]
    for i in range(n):
        w, toxic = [word() for _ in range(40)], rng.random() < 0.3
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad)
        if i % 11 == 0 and toxic:
            w = [x.replace("o", "0").replace("i", "1") if x in bad else x for x in w]
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(n, None, "x"), (n + 1, "", "x"), (None, "idiot", "x"), (0, rows[0][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = docs_and_labels(spark)
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 604
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert sum(right) / len(right) > 0.97
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_letter_counts(spark):
    docs = spark.createDataFrame([(t,) for t in [*TEXTS[:3], None, ""]], "text string")
    want = counts(TEXTS[:3])
    assert (letter_counts(docs)[: 26 * SIDE * SIDE][want[: 26 * SIDE * SIDE] > 0] == want[: 26 * SIDE * SIDE][want[: 26 * SIDE * SIDE] > 0]).all()


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_toxicity(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect()
    assert got[0].predicted == 0
    assert score_toxicity(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []


def test_one_id_of_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    from sievelake.llm import toxicity

    rows = [(7, f"text {i} of idiots" if i else None) for i in range(3000)] + [(i, "a calm text") for i in range(20, 60)]
    labels = spark.createDataFrame([(7, 1)] * 50 + [(i, 0) for i in range(20, 60)], "doc_id long, toxic int")
    seen, keep = {}, toxicity.Workspace.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(toxicity.Workspace, "keep", kept)
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels, fit_rows=100)
    assert got.count() == 3040 and 0 < seen["sample"] <= 41
