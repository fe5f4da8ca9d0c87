"""Divergence of sources within a language, all pairs met by systolic rotation.

1. Counts. A task maps a text's bytes to lower-case letters and blanks in one pass, splits it and counts terms for its (language,
   source) groups; what a task has gathered is emitted in portions and summed by a shuffle, with the number of documents
   that hold the term. Each language keeps the terms of ``least_documents`` or more of its documents.
2. Vectors. A language's terms are cut by hash into slices and its groups into blocks, so that a block's dense vectors of a
   slice have a bounded size. A group's vector of a slice is a compressed list of (term number, count).
3. Tournament. A block of a slice stays in its partition. In each round the visiting vectors move on by one block, round the
   ring; whoever meets is evaluated for both directions at once, and after half the ring every pair has met once. So there are
   at most ``most_blocks`` / 2 rounds, whatever the number of groups. Distances over a slice are whole numbers and are added up by pair.
4. Heaps. What ranks a group's terms needs its own vector and the language's only; each slice keeps its best ``terms`` in a
   heap, and the heaps of a group's slices are merged.

A share is 1 + floor(1e9 * (count + 5) / (total + 5 * terms)), in whole numbers (the division is done in three digits of a thousand,
so counts up to 2^53 stay exact).

Defined results: null text, language and source are empty ones; every (language, source) that occurs is a group, even without
terms; repeated rows and ids count as documents of their own; a language without kept terms has distance 0 everywhere and no term rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.llm.common import Workspace, give_back

LEAST_DOCUMENTS, TERMS, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Blocks of the ring at most, groups of a block at least, and cells (groups times terms) that a block's dense vectors have at most.
MOST_BLOCKS, LEAST_BLOCK, CELLS = 16, 8, 1 << 21
#: Parts that a slice's terms are numbered in.
PARTS = 64
#: Different (group, term) pairs that a counting task holds at most, and bytes of their terms.
HELD, HELD_BYTES = 400_000, 32 << 20
#: ASCII letters to lower case, bytes of other letters as they are, all else to a blank.
LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, occurrences, documents), summed within tasks only; an empty term stands for the group itself."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple, Counter] = defaultdict(Counter)
        in_docs: dict[tuple, Counter] = defaultdict(Counter)
        groups: set[tuple] = set()

        def rows():
            cols = [[], [], [], [], []]
            for group, counts in held.items():
                seen = in_docs[group]
                for c, v in zip(cols, ([group[0]] * len(counts), [group[1]] * len(counts), counts, counts.values(), map(seen.__getitem__, counts)), strict=True):
                    c.extend(v)
            held.clear()
            in_docs.clear()
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            for at in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000], k) for c, k in zip(cols, kinds, strict=True)], names)

        names, size, cells = ["lang", "source", "term", "occurrences", "documents"], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for lang, source, text in zip(*(some.column(i).to_pylist() for i in range(3)), strict=True):
                    group = (lang, source)
                    own, words = held[group], text.translate(LETTERS).split()
                    before = len(own)
                    if group not in groups:
                        groups.add(group)
                        own[b""] += 0
                    counts = Counter(words)
                    own.update(counts)
                    in_docs[group].update(counts.keys())
                    cells += len(own) - before
                    size += sum(map(len, counts)) if len(own) > before else 0
                if cells > HELD or size > HELD_BYTES:
                    yield from rows()
                    size = cells = 0
        yield from rows()
        give_back()

    return docs.mapInArrow(run, "lang string, source string, term binary, occurrences long, documents long")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), in whole numbers."""
    whole, rest = np.divmod(np.asarray(counts, dtype=np.int64) + SMOOTH, total + SMOOTH * terms)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total + SMOOTH * terms)
        out = out * 1000 + digit
    return out + 1


def packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Term numbers (ascending) and counts, as differences, compressed."""
    return zlib.compress(np.concatenate((np.diff(numbers, prepend=0), counts)).astype("<i8").tobytes(), 1)


def dense(vector: bytes | None, total: int, terms: int, width: int) -> np.ndarray:
    """A group's shares of all ``width`` terms of a slice."""
    counts = np.zeros(width, dtype=np.int64)
    if vector:
        flat = np.frombuffer(zlib.decompress(vector), "<i8")
        counts[np.cumsum(flat[: len(flat) // 2])] = flat[len(flat) // 2 :]
    return shares(counts, total, terms)


def settle(key, rows, most: int):
    """A group's vector of a slice, and the heap of the terms that it uses more than its language does."""
    total, all_total, terms = (int(rows[c].iloc[0]) for c in ("total", "all_total", "terms"))
    rows = rows.sort_values("number")
    own = rows["count"].to_numpy()
    more = shares(own, total, terms) - shares(rows["all_count"].to_numpy(), all_total, terms)
    best = heapq.nsmallest(most, ((-int(v), t.encode()) for v, t in zip(more, rows["term"], strict=True) if v > 0))
    return (*key, packed(rows["number"].to_numpy(), own), [-v for v, _ in best], [t.decode() for _, t in best])


def meeting(residents: list[tuple], visitors: list[tuple], same: bool, terms: int, width: int):
    """Distances of residents and visitors (or of residents among themselves): a row for each pair, in both directions."""
    at_home = [(g, dense(vector, total, terms, width)) for g, total, vector in residents]
    for k, (g, total, vector) in enumerate(visitors):
        there = dense(vector, total, terms, width)
        for h, here in at_home[:k] if same else at_home:
            value = int(np.abs(here - there).sum())
            yield g, h, value
            yield h, g, value


def source_divergence(
    docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, terms: int = TERMS, most_blocks: int = MOST_BLOCKS, least_block: int = LEAST_BLOCK, cells: int = CELLS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """lang, source, part (pair: every other source of the language; term: the ``terms`` best terms), item, value, rank."""
    ws = Workspace(docs.sparkSession, "divergence")
    or_empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    docs = docs.select(or_empty(lang_col).alias("lang"), or_empty(source_col).alias("source"), or_empty(text_col).cast("binary").alias("text"))
    counted = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("count"), F.sum("documents").alias("documents"))
    counted = ws.keep(counted.withColumn("term", F.col("term").cast("string")), "counted")
    kept = counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("all_count")).filter(F.col("documents") >= least_documents)
    kept = ws.keep(kept.drop("documents"), "kept")
    used = ws.keep(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "all_count"), "used")

    # languages: terms, groups, how they are cut; groups: number, block, total
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_count").alias("all_total"))
    names = counted.filter("term = ''").select("lang", "source").distinct()
    names = ws.keep(names, "names")
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = names.groupBy("lang").agg(F.count("*").alias("groups")).join(langs, "lang", "left").fillna(0, ["terms", "all_total"])
    groups = groups.withColumn("block_size", F.greatest(F.lit(least_block), F.ceil(F.col("groups") / most_blocks)).cast("int"))
    groups = groups.withColumns({"blocks": F.ceil(F.col("groups") / F.col("block_size")).cast("int"), "slices": F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("block_size") / cells)).cast("int")})
    groups = ws.keep(groups, "languages")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    members = names.join(groups, "lang").join(totals, ["lang", "source"], "left").fillna(0, ["total"]).withColumn("member", number)
    members = ws.keep(members.withColumn("block", F.floor(F.col("member") / F.col("block_size")).cast("int")), "members")

    # terms: slice and number there
    slice_of = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    placed = kept.join(groups.select("lang", "slices"), "lang").select("lang", "term", slice_of)
    # numbers without gaps, dealt over parts of a slice, so that no task has to see a language's terms
    placed = ws.keep(placed.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(PARTS)).cast("int")), "sliced")
    sizes = placed.groupBy("lang", "slice", "part").agg(F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.partitionBy("lang", "slice").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("lang", "slice", "part").orderBy("term")) - 1
    placed = placed.withColumn("own", own).join(sizes.select("lang", "slice", "part", begin.alias("begin")), ["lang", "slice", "part"])
    placed = ws.keep(placed.select("lang", "term", "slice", (F.col("own") + F.col("begin")).alias("number")), "placed")
    widths = ws.keep(placed.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("width")), "widths")

    cells_of = used.join(placed, ["lang", "term"]).join(members.select("lang", "source", "member", "block", "total", "all_total", "terms"), ["lang", "source"])
    shape = "lang string, source string, slice int, vector binary, values array<long>, items array<string>"

    def vectors_of(pdf):
        import pandas as pd

        key = tuple(pdf[c].iloc[0] for c in ("lang", "source", "slice"))
        lang, source, part, vector, values, items = settle(key, pdf, terms)
        return pd.DataFrame({"lang": [lang], "source": [source], "slice": [part], "vector": [vector], "values": [values], "items": [items]})

    vectors = ws.keep(cells_of.groupBy("lang", "source", "slice").applyInPandas(vectors_of, shape), "vectors")
    best = vectors.select("lang", "source", F.explode(F.arrays_zip("values", "items")).alias("x")).select("lang", "source", F.col("x.items").alias("item"), F.col("x.values").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    term_rows = ranked(best).filter(F.col("rank") <= terms)

    pair_rows = ranked(tournament(ws, members, vectors, widths))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named(pair_rows, "pair").union(named(term_rows, "term"))


def tournament(ws: Workspace, members: DataFrame, vectors: DataFrame, widths: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's groups."""
    seats = members.filter("groups > 1").withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    seats = seats.join(vectors.select("lang", "source", "slice", "vector"), ["lang", "source", "slice"], "left").join(widths, ["lang", "slice"], "left").fillna(0, ["width"])
    seats = ws.keep(seats.select("lang", "slice", "block", "blocks", "terms", "width", "member", "total", "vector"), "seats")
    rounds = seats.agg(F.max("blocks")).first()[0]
    if rounds is None:
        return ws.spark.createDataFrame([], "lang string, source string, item string, value long")
    tasks = max(1, min(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), seats.select("lang", "slice", "block").distinct().count()))

    def play(block, residents, visitors, turn):
        """What a block evaluates in a turn; residents and visitors are lists of (blocks, terms, width, (member, total, vector))."""
        blocks, terms, width, _ = residents[0]
        own = [x[3] for x in residents]
        if turn == 0:
            return meeting(own, own, True, terms, width)
        if 2 * turn < blocks or 2 * turn == blocks and block < turn:  # on the last turn of an even ring both would meet twice
            return meeting(own, [x[3] for x in visitors], False, terms, width)
        return ()

    def turn_of(turn):
        def rows(entry):
            (lang, part, block), (home, guests) = entry
            for residents in home:
                for visitors in guests:
                    for a, b, value in play(block, residents, visitors, turn):
                        yield lang, part, a, b, value

        return rows

    def moved(turn):
        def step(entry):
            (lang, part, place), vectors = entry
            if 2 * turn <= vectors[0][0]:  # shorter rings have gone half round
                yield (lang, part, (place + 1) % vectors[0][0]), vectors

        return step

    resident = seats.rdd.map(lambda r: ((r[0], r[1], r[2]), (r[3], r[4], r[5], (r[6], r[7], r[8])))).groupByKey(tasks).mapValues(list)
    visiting, told = resident, []
    for turn in range(rounds // 2 + 1):
        if turn:
            visiting = visiting.flatMap(moved(turn)).partitionBy(tasks)
        rows = resident.cogroup(visiting, tasks).flatMap(turn_of(turn))
        told.append(ws.keep(ws.spark.createDataFrame(rows, "lang string, slice int, a int, b int, value long", verifySchema=False), f"round-{turn}"))
    found = told[0]
    for df in told[1:]:
        found = found.union(df)
    found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    who = lambda m, name: members.select("lang", F.col("member").alias(m), F.col("source").alias(name))
    return found.join(who("a", "source"), ["lang", "a"]).join(who("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
