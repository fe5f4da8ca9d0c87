"""The pipeline's stages against brute-force versions, each on its own input, and the run as a whole."""

import random
from collections import defaultdict

import pytest
from test_decontam import brute as brute_items
from test_lines import brute_winnow, kept_text
from test_minhash import brute as brute_links
from test_packing import whole

import corpus_pipeline

BAD = ["idiot", "moron", "loser"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng, root = random.Random(9), tmp_path_factory.mktemp("data")
    word = lambda: "".join(rng.choice(["la", "ti", "on", "er", "th", "es", "ou"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(18)) for i in range(6)]
    shared = "\n".join(prose(12) for _ in range(4))
    docs, labels = [], []
    for i in range(300):
        lines, toxic = [prose(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))], rng.random() < 0.25
        if toxic:
            lines[0] += " " + " ".join(rng.choice(BAD) for _ in range(2)) + " " + prose(3)
        if i % 10 == 3:
            lines.append(shared)
        if i % 17 == 4:
            lines.append(items[i % 6][1])
        docs.append((i, "\n".join(lines), toxic))
        labels.append((i, 1, int(toxic)))
    base = prose(150).split(" ")
    for i in range(300, 312):
        w = list(base)
        w[rng.randrange(150)] = word()
        docs.append((i, " ".join(w), False))
    docs += [(400, docs[2][1], docs[2][2]), (401, None, False), (402, "", False)]
    frame = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t, _ in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), {i: x for i, _, x in docs}, items


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, data):
    root, toxic, items = data
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = rows(docs), stage(spark, docs, root)
        if name == "packing":
            pieces = defaultdict(int)
            for p in out.collect():
                pieces[p.doc_id] += p.length
            assert pieces == {i: len(whole(t)) for i, t in before}
            break
        assert out.columns == docs.columns
        after = rows(out)
        if name == "toxicity":
            assert {i for i, _ in after} == {i for i in toxic if not toxic[i]}
        elif name == "line_dedup":
            gone = brute_winnow(before)
            want = {i: kept_text(t, gone[i]) if gone[i] else t for i, t in before}
            assert dict(after) == {i: t for i, t in want.items() if not gone[i] or t.strip()}
        elif name == "near_dedup":
            assert {i for i, _ in after} == {i for i, (_, _, kept) in brute_links(before, 80).items() if kept}
        else:
            assert {i for i, _ in after} == {i for i, _ in before} - {i for i, _ in brute_items(before, items)}
        assert sorted(after, key=str) != sorted(before, key=str)  # every stage takes something out
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_run(spark, data):
    root, toxic, _ = data
    got = corpus_pipeline.run(spark, root).collect()
    ids = {r.doc_id for r in got}
    assert ids and not ids & {i for i in toxic if toxic[i]} and 401 in ids
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 4096 for s in by.values())
