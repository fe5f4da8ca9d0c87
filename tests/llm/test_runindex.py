import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sievelake.llm.runindex import RunLengthIndex, anchors, remove_repeats


def brute(rows, n):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a : a + n] for _, t in texts for a in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for a in range(len(t) - n + 1):
            if seen[t[a : a + n]] > 1:
                gone[a : a + n] = 1
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), len(t) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base, rows = prose(90), prose(200).split(" "), []
    for i in range(25):
        w = [word() if rng.random() < 0.01 else x for x in base]
        rows.append(" ".join(w))
        rows.append(prose(rng.randint(0, 60)) + passage[: rng.randint(150, len(passage))] + prose(rng.randint(0, 60)))
    rows += [None, "", "x" * 199, "x" * 200, "x" * 201, "ab" * 300, prose(40), rows[3], rows[3], "é" * 150]
    return [(i if i % 9 else None, t) for i, t in enumerate(rows)] + [(4, rows[4])]


@pytest.mark.parametrize("seed, group", [(1, 200), (2, 3)])
def test_against_all_strings(spark, seed, group):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int").repartition(4)
    got = [tuple(r) for r in remove_repeats(docs, group=group).collect()]
    assert sorted(got, key=str) == brute(rows, 200)


def test_kept_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).collect() == []
    r = remove_repeats(spark.createDataFrame([(1, "a" * 100 + "b" * 300)], "doc_id long, text string"), keep_text=True).first()
    assert bytes(r.kept) == b"a" * 100 and [(s.start, s.stop) for s in r.removed] == [(100, 400)]


def test_index_lengths():
    rng = random.Random(3)
    for _ in range(20):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(6)]
        index = RunLengthIndex(texts)
        flat = [c for k, t in enumerate(texts) for c in [*t, 256 + k]]
        order = sorted(range(len(flat)), key=lambda i: flat[i:])
        assert index.order.tolist() == order
        want = np.zeros(len(flat), int)
        for a, b in zip(order, order[1:]):
            while flat[a + want[b]] == flat[b + want[b]]:
                want[b] += 1
        assert index.lengths().tolist() == want.tolist()
        assert len(index.heads) == 1 + sum(flat[a - 1] != flat[b - 1] for a, b in zip(order, order[1:]))


def test_every_string_has_an_anchor():
    texts = [b"abc" * 100, b"", b"short", bytes(range(256)) * 2]
    found = anchors(texts, 200)
    for d, t in enumerate(texts):
        mine = [s for lo, hi, k in zip(found["lo"], found["hi"], found["doc"]) if k == d for s in range(lo, hi + 1)]
        assert mine == list(range(max(0, len(t) - 199)))
