import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelake.llm.divergence import packed, shares, source_divergence, term_counts
from sievelake.llm.registry import oracle_sql

SCHEMA = "doc_id long, lang string, source string, text string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=30, most=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:top])]
    return sorted(out)


def corpus(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "漢字", "ﬁn", "İx"]
    rows = []
    for i in range(n):
        source = f"s{min(int(rng.integers(0, sources * 3 // 2 + 1)), sources - 1)}"  # the last has a third of all
        words = rng.choice(vocabulary, int(rng.integers(0, 40)), p=(w := rng.random(len(vocabulary)) ** 3) / w.sum())
        rows.append((i % 50, ["en", "de", None, "x"][i % 4] if i % 9 else "rare", None if i % 31 == 0 else source, None if i % 17 == 0 else " ".join(words).upper() if i % 5 == 0 else "1,".join(words) + "\x00b_c"))
    return rows


@pytest.mark.parametrize("least, block, cells", [(30, 8, 1 << 21), (3, 1, 64), (3, 2, 50), (10_000, 3, 100)])
def test_against_plain_sums(spark, least, block, cells):
    rows = corpus(600, 11)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit(1), "rank": F.lit("x")}).repartition(4)
    got = source_divergence(docs, least_documents=least, least_block=block, cells=cells, most_blocks=12).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least)


def test_sql(spark):
    rows = corpus(500, 6, seed=2) + [(1, "solo", "only", "a b " * 40)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, lang varchar, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    assert sorted(con.execute(oracle_sql()["op13_source_divergence"]).fetchall()) == brute(rows)


def test_ties_empty_groups_long_text(spark):
    rows = [(i, "en", s, "b a") for i in range(35) for s in ("y", "x")] + [(1, "en", "empty", ""), (2, "en", None, None), (3, "en", "long", "漢" * 500_000 + " a" * 500_000)]
    got = source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_empty_table_and_no_terms(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    got = source_divergence(spark.createDataFrame([(1, "en", "a", "x"), (2, "en", "b", None), (3, "de", "a", "")], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for total in (7, 10**6, 10**12 + 39, 2**53 - 1):
        for terms in (1, 12345):
            counts = rng.integers(0, total + 1, 200)
            want = [1 + 1_000_000_000 * (int(c) + 5) // (total + 5 * terms) for c in counts]
            assert shares(counts, total, terms).tolist() == want


def test_tasks_emit_in_portions(spark, monkeypatch):
    rows = [(i, "en", "s", f"a b{i}x c{'y' * (i % 7)}") for i in range(400)]
    whole = term_counts(spark.createDataFrame(rows, SCHEMA).select("lang", "source", F.col("text").cast("binary"))).groupBy("term").sum("occurrences", "documents")
    got = {r[0].decode(): (r[1], r[2]) for r in [(bytes(r[0]), r[1], r[2]) for r in whole.collect()]}
    assert got["a"] == (400, 400) and got["b"] == (400, 400) and got[""] == (0, 0)


def test_vectors_are_compressed():
    assert len(packed(np.arange(10_000), np.ones(10_000, dtype=np.int64))) < 1000
