import zlib
from collections import defaultdict

import pytest

from sievelake.llm.sharding import histogram_sort


def held(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    return [sum(r.size for r in by[i]) for i in range(shards)]


@pytest.mark.parametrize("hot", [0, 4000])
def test_near_equal_bytes(spark, hot):
    texts = [("é" if i % 3 else "ab ") * (i * 37 % 300) for i in range(3000)] + ["hot text " * 3] * hot + [None, ""] * 5
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(7)
    rows = histogram_sort(docs, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sizes = held(rows, 8)
    assert max(sizes) - min(sizes) <= 2 * 0.001 * sum(sizes) / 8 + 2 * max(r.size for r in rows)


def test_small_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert histogram_sort(none, 8).collect() == []
    few = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = histogram_sort(few, 8).collect()
    assert len(rows) == 3
    held(rows, 8)


def test_one_giant(spark):
    docs = spark.createDataFrame([(i, "x" * (100_000 if i == 5 else 10)) for i in range(400)], "doc_id long, text string")
    sizes = held(histogram_sort(docs, 4).collect(), 4)
    assert sorted(sizes)[-1] >= 100_001 and sum(sizes) == 100_001 + 399 * 11


def plain_borders(rows, shards):
    """Bytes in each shard by plain Python: rows in the order of their keys, cut where the bytes below come nearest to a target."""
    rows = sorted(rows)
    total, at, below = sum(r[2] for r in rows), 0, [0]
    for r in rows:
        at += r[2]
        below.append(at)
    cuts = [0] + [min(range(len(below)), key=lambda i: abs(below[i] - total * k / shards)) for k in range(1, shards)] + [len(rows)]
    return [below[b] - below[a] for a, b in zip(cuts, cuts[1:])]


def test_borders_against_plain_python(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x" * (i * 7919 % 501)) for i in range(3000)], "doc_id long, text string").repartition(5)
    half = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    keys = docs.select(half("text").alias("a"), half("doc_id").alias("b"), (F.octet_length("text") + 1).alias("n")).collect()
    want = plain_borders([tuple(r) for r in keys], 8)
    got = held(histogram_sort(docs, 8, tolerance=0.0).collect(), 8)
    assert max(abs(a - b) for a, b in zip(got, want)) <= 2 * 502


def test_many_ranges_and_few_probes(spark, monkeypatch):
    from sievelake.llm import sharding

    docs = spark.createDataFrame([(i, "abc" * (i % 40)) for i in range(6000)], "doc_id long, text string")
    want = {r.doc_id: (r.shard, r.slot) for r in histogram_sort(docs, 4).collect()}
    seen, refine = [], sharding.refine
    monkeypatch.setattr(sharding, "refine", lambda *a: seen.append(refine(*a)) or seen[-1])
    monkeypatch.setattr(sharding, "PROBES", 4096)
    rows = histogram_sort(docs, 4, range_bytes=90).collect()
    assert seen[0].rounds > 1 and max(seen[0].counted) <= 2 * 4096
    sizes = held(rows, 4)
    assert max(sizes) - min(sizes) <= 600 and {r.doc_id for r in rows} == set(want)
