import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sievelake.llm.merkle import lowered, merkle_manifest, tampering
from sievelake.llm.registry import oracle_sql

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The top of some digests, and for each of them the sides (left, right) of its siblings on the way up."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                for leaf in owner[i]:
                    paths[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes, owner = [h(*(nodes[j] for j in run)) for run in runs], [[x for j in run for x in owner[j]] for run in runs]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        now = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            now = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
        by[r[1]].append((r[0], h(*map(field, r)), h(*map(field, now))))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found[s] = climb([x[1] for x in by[s]])
    root, above = climb([found[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for (doc, leaf, now), own in zip(by[s], found[s][1], strict=True):
            folded = now
            for left, right in own + up:
                folded = h(left, folded, right)
            out.append((doc, leaf, found[s][0], root, h(*(x for step in own + up for x in step)), folded, folded == root))
    return out


def run(spark, rows, **settings):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "g": F.lit("x"), "src": F.lit(None).cast("int")}).repartition(3)
    return merkle_manifest(docs, altered=tampering(docs["doc_id"]), text_now=lowered(docs["text"]), **settings)


def rows_of(sizes):
    rows = []
    for source, n in sizes:
        for i in range(n):
            k = len(rows)
            rows.append((k, source, "en" if k % 3 else None, None if k % 7 == 0 else k % 50, None if k % 11 == 0 else "" if k % 13 == 0 else f"Text É {k % 17} ß" * (k % 4)))
    return rows


@pytest.mark.parametrize("sizes", [[("one", 1)], [("b", 1), ("a", 17)], [(None, 16), ("", 1), ("é", 273), ("z", 33), ("Z", 2)], [(f"s{i}", 1 + i % 3) for i in range(40)]])
def test_against_plain_trees(spark, sizes):
    rows = rows_of(sizes)
    got = [tuple(r) for r in run(spark, rows).collect()]
    assert Counter(got) == Counter(brute(rows))
    if any(s is not None for s, _ in sizes) and len(rows) > 30:
        assert {r[6] for r in got} == {True, False}


def test_repeated_rows_null_ids_long_text(spark):
    rows = [(None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (5, None, None, None, None), (5, None, None, None, "Q" * 3_000_000), (7, "a", "de", 3, "same")] + [(7, "a", "de", 3, "same")] * 40
    got = [tuple(r) for r in run(spark, rows).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_empty_table(spark):
    assert run(spark, []).count() == 0


def test_paths_lead_to_the_root(spark):
    rows = rows_of([("a", 300), ("b", 5)])
    for r in run(spark, rows, with_proof=True).collect():
        folded = r.leaf
        for step in r.path:
            folded = h(step.left, folded, step.right)
        assert folded == r.root and h(*(x for step in r.path for x in step)) == r.proof_sha256


def test_a_changed_row_alone_fails(spark):
    rows = rows_of([("a", 40)])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle_manifest(docs, altered=docs["doc_id"] == 21, text_now=F.lit("forged"))
    assert [r.doc_id for r in got.filter("not verified").collect()] == [21]


def test_sql(spark):
    rows = [r for r in rows_of([(None, 16), ("é", 273), ("z", 1)])]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars int, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert Counter(con.execute(oracle_sql()["op12_merkle_manifest"]).fetchall()) == Counter(brute(rows))
