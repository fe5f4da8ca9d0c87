import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sievelake.llm import registry
from sievelake.llm.common import normal_pieces
from sievelake.llm.linededup import drop_repeated_lines, selected, winnow_lines
from sievelake.llm.substring import repeated_units


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") * rng.randint(1, 3)
    some = lambda: " ".join(word() + (rng.choice(",.;") if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 30)))
    pool = [some() for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own {i}, {some()}. {rng.random()}" for _ in range(rng.randint(0, 12))]
        rows.append((i * 3 % 61, "\n".join(x.upper() if rng.random() < 0.1 else "  " + x + "\t " if rng.random() < 0.1 else x for x in lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "w " * 3000), (104, "w " * 3000 + "\n" + "w " * 3000), (105, rows[3][1]), (106, rows[3][1]), (107, "a b. " * 2000), (108, "x\n" * 500)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("name", ["op4_line_winnowing", "op7_line_hash_dedup"])
def test_against_sql(spark, tmp_path, name, seed):
    docs = spark.createDataFrame([(i, t, "x") for i, t in corpus(seed)], "doc_id long, text string, print string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(want)
    assert sum(r[2] for r in got) > 100


def brute_winnow(rows, gram=3, window=3, per=12):
    """Numbers of the pieces that go, per document; ids must differ."""
    docs, prints, out = {}, {}, {}
    for i, t in sorted(rows):
        cut = re.split(r"(?<=\n)|(?<=[.!?;:,])(?= )", t or "")
        clean = [re.sub(r"\s+", " ", p.lower()).strip() for p in cut]
        units = [(f"{c}\n{j}", n) for n, c in enumerate(clean) if c for j in range((len(c.split(" ")) - 1) // per + 1)]
        grams = [tuple(u[0] for u in units[a : a + gram]) for a in range(len(units) - gram + 1)]
        key = [(lambda t, j: hashlib.md5(t.encode()).hexdigest() + (j if j != "0" else ""))(*g[gram // 2].split("\n")) for g in grams]
        w = min(window, len(grams))
        docs[i] = units, {min(range(a, a + w), key=lambda p: (key[p], p)) for a in range(len(grams) - w + 1) if w}, grams
    for i, (units, chosen, grams) in docs.items():
        last, gone = {}, set()
        for p in sorted(chosen):
            g = grams[p]
            j, q = (i, last[g]) if g in last else prints.setdefault(g, (i, p))
            last[g] = p
            if (j, q) != (i, p):
                same = [0 <= a - p + q < len(docs[j][0]) and docs[j][0][a - p + q][0] == units[a][0] for a in range(len(units))]
                for a in range(len(units) - gram + 1):
                    if all(same[a : a + gram]):
                        gone |= {u[1] for u in units[a : a + gram]}
        out[i] = sorted(gone)
    return out


def kept_text(t, gone):
    out, broken = "", False
    for n, p in enumerate(re.split(r"(?<=\n)|(?<=[.!?;:,])(?= )", t or "")):
        if n in gone:
            broken = broken or p.endswith("\n")
        else:
            out += ("\n" if broken and out and not out.endswith("\n") else "") + p
            broken = False
    return out


@pytest.mark.parametrize("seed", [4])
def test_winnowing_against_plain_python(spark, seed):
    rows = corpus(seed)
    want = brute_winnow(rows)
    for r in winnow_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        assert r.removed == want[r.doc_id] and r.kept == kept_text(dict(rows)[r.doc_id], want[r.doc_id])


PASSAGE = "the river rose in the night and the old bridge fell, but no one in the village heard it. In the morning they found the stones on the bank. It was cold; the water had gone back, and nobody spoke. They went home by the upper road, past the mill, and shut their doors before noon."


def test_passages_inside_lines(spark):
    rng = random.Random(3)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{own(40)}\n{own(20)} {PASSAGE} {own(30)}\n{own(10)}" for _ in range(5)] + [own(60), f"{own(9)}. yes, of course"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for found in (winnow_lines(docs), repeated_units(docs)):
        kept = {r.doc_id: r.kept for r in found.collect()}
        assert kept[0] == texts[0] and kept[5] == texts[5] and kept[6] == texts[6]
        for i in range(1, 5):
            left = set(re.findall(r"\w+", PASSAGE)) & set(re.findall(r"\w+", kept[i]))
            assert "village" not in left and "stones" not in left and "upper" not in left and len(kept[i].split()) <= 100 + 25
    assert [r.n_passages for r in repeated_units(docs).orderBy("doc_id").collect()] == [0, 1, 1, 1, 1, 0, 0]


def test_paragraphs(spark):
    texts = ["A b\nc\n\n\nd e", "x\n\na  B\nc\n\ny", "d e"]
    got = repeated_units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), unit="paragraph").orderBy("doc_id").collect()
    assert [[(s.start, s.stop) for s in r.removed] for r in got] == [[], [(3, 9)], [(0, 3)]]
    assert texts[1][3:9] == "a  B\nc" and got[1].kept == "x\n\ny"


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert winnow_lines(none).collect() == [] and repeated_units(none).collect() == [] and drop_repeated_lines(none).collect() == []
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (1, "z\na\nb\nc")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.kept) for r in winnow_lines(twice).collect())
    assert got[0] == (0, "") and len(got) == 4 and [k for _, k in got].count("a\nb\nc") in (0, 2)


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 1, 2, 3), (2, "a\nb\nc", 4, 5, 6), (3, "q", 7, 8, 9)], "doc_id long, text string, __gone int, __k1 int, `gone.x` int")
    assert [tuple(r) for r in drop_repeated_lines(docs).orderBy("doc_id").collect()] == [(1, "a\nb\nc", 1, 2, 3), (3, "q", 7, 8, 9)]


def test_normal_pieces_against_plain_python(spark):
    rng = random.Random(7)
    texts = ["", " ", "\n", ". ", " .", "a. ", " a", "a ", "a \nb", "a\n b", "A. \nB", "a.  b", "a.\tb", "! ? x", "., x", "a\n\nb\n", "\x01a. b", "a;\x01 b", "\u0130: \u00c4, \u00a0. x", "a.\rb", "1.5, 2"]
    texts += ["".join(rng.choice(["a", "B", " ", "\n", ". ", ", ", ":", "\t"][: 8 if i % 3 == 0 else 7]) for _ in range(rng.randrange(30))) for i in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", normal_pieces(F.col("text")).alias("p")).collect()
    for r in got:
        assert r.p == [re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ") for x in re.split(r"(?<=\n)|(?<=[.!?;:,])(?= )", texts[r.i])], repr(texts[r.i])


@pytest.mark.parametrize(("gram", "window"), [(3, 3), (1, 1), (2, 4), (3, 2)])
def test_selected_against_plain_python(spark, gram, window):
    rng = random.Random(window)
    rows = [(i, [(rng.randrange(5), rng.choice("abcd"), 0) for _ in range(rng.randrange(12))]) for i in range(200)]
    docs = spark.createDataFrame(rows, "i int, units array<struct<h:bigint,key:string,piece:int>>")
    for r in docs.select("i", selected(F.col("units"), gram, window).alias("prints")).collect():
        keys = [u[1] for u in rows[r.i][1]][gram // 2 :][: max(0, len(rows[r.i][1]) - gram + 1)]
        w = min(window, len(keys))
        assert [p.pos for p in r.prints] == sorted({min(range(a, a + w), key=lambda p: (keys[p], p)) for a in range(len(keys) - w + 1) if w})


def test_plain_texts_take_no_step_a_piece(spark):
    plan = spark.createDataFrame([(1, "a. b")], "i int, text string").select(normal_pieces(F.col("text")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(") == 1  # of texts with other white space
