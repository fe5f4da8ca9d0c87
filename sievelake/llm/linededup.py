"""Winnowing over line hashes: runs of lines that an earlier place has already are deleted.

A line is cut into pieces where one of ``. ! ? ; : ,`` stands before a blank, so that a passage that begins or ends
inside a line still shares its inner pieces. Blank ones aside, a piece is normalised and counts as one unit for each
``unit_words`` words begun. ``gram`` units in a row are a gram; grams are ordered by the MD5 of their middle unit.

1. Each window of ``window`` grams selects its least one (the leftmost of equals): a fingerprint. Two runs of
   ``window + gram - 1`` equal units have a window in common, and so share a fingerprint for certain. Only selected
   grams leave a document; those that one place alone has selected are dropped by a count over all documents.
2. Positions are joined: each place of a fingerprint with the one before it in its own document, or else with the
   fingerprint's earliest place of all, by (document id, key of the row, position). So a place makes one pair, however
   many documents hold the passage, and a text that repeats itself stays on few diagonals.
3. Matches are extended both ways: along the diagonal of a pair the units of both documents are compared, and runs of
   ``gram`` equal units or more count as repeated.
4. A piece goes with any of its units that is repeated; the earliest place stays.

A hot passage's join has one row on one side and is split by AQE on the other; both sides are written tables. Where one side has
one narrow row a fingerprint, that side is hashed, so the positions on the other aren't sorted.

Defined results: null and empty texts have no lines; rows without an id rank last; rows that repeat both id and
text count as one place and are treated alike; an empty table gives no rows; documents with nothing deleted keep
their text as it is; other columns, whatever their names, are kept by ``drop_repeated_lines`` and ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.llm.common import KEY, Workspace, first_id, fresh, keyed, let, normal_pieces, pieces, with_key, without, word_count

GRAM, WINDOW, UNIT_WORDS = 3, 3, 12


def units_of(cut_text: Column, unit_words: int) -> Column:
    """The units of a text's normal pieces: {h, key, piece}: hash, what orders it, number of its piece."""
    unit = lambda h, key, i: F.struct(h.alias("h"), key.alias("key"), i.alias("piece"))
    one = lambda t, i: F.array(unit(F.xxhash64(t), F.md5(t.cast("binary")), i))
    more = lambda t, i: let(F.struct(F.xxhash64(t).alias("h"), F.md5(t.cast("binary")).alias("m")), lambda x: F.transform(F.sequence(F.lit(0), F.floor((word_count(t) - 1) / unit_words).cast("int")), lambda j: unit(F.when(j == 0, x["h"]).otherwise(F.xxhash64(x["h"], j)), F.concat(x["m"], F.when(j == 0, "").otherwise(j.cast("string"))), i)))
    # so many words need at least as many letters and blanks between them, and most other pieces end before so many blanks: both need no count
    short = lambda t: (F.octet_length(t) <= 2 * unit_words) | (F.substring_index(t, " ", unit_words) == t)
    cut = lambda t, i: F.when(t == "", none).when(short(t), one(t, i)).otherwise(more(t, i))
    none = F.expr("cast(array() as array<struct<h:bigint,key:string,piece:int>>)")
    return F.flatten(F.transform(cut_text, cut))


def selected(units: Column, gram: int, window: int) -> Column:
    """The grams that some window selects: {print, pos}. Fewer grams than a window are one window."""
    n = F.size(units) - (gram - 1)
    keys = F.slice(units, gram // 2 + 1, n)["key"]

    def is_least(k, i):
        """Of so many grams around i as make a window: those before it are greater, those after it not less."""
        before = lambda m: reduce(lambda a, b: a & b, [F.get(k, i - j) > F.get(k, i) for j in range(1, m + 1)])
        steps = [(F.get(k, i + j) < F.get(k, i), before(window - j)) for j in range(1, window)]
        return reduce(lambda done, step: done.when(*step), steps, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(True))

    # behind the last key stands one that is less than all; before the first there are nulls, which are never greater
    chosen = let(F.concat(keys, F.array(F.lit(""))), lambda k: F.filter(F.sequence(F.lit(0), n - 1), lambda i: is_least(k, i)))
    chosen = F.when(n < window, let(keys, lambda k: F.array((F.array_position(k, F.array_min(k)) - 1).cast("int")))).otherwise(chosen)
    name = lambda hs, i: F.xxhash64(*[F.get(hs, i + k) for k in range(gram)])
    none = F.expr("cast(array() as array<struct<print:bigint,pos:int>>)")
    return F.when(n > 0, let(units["h"], lambda hs: F.transform(chosen, lambda i: F.struct(name(hs, i).alias("print"), i.alias("pos"))))).otherwise(none)


def repeated_lines(docs: DataFrame, *, gram: int = GRAM, window: int = WINDOW, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 and the sorted numbers of the pieces to delete, for documents that have any."""
    return _repeated(docs, gram, window, unit_words, id_col, text_col)[1]


def _repeated(docs: DataFrame, gram: int, window: int, unit_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, n: the number of pieces) of all documents, and what ``repeated_lines`` returns."""
    ws = Workspace(docs.sparkSession, "winnow")
    # no filter on the units: it would be pushed down and cut every text a second time
    docs = keyed(docs, id_col, text_col).select(*KEY, first_id().alias("doc_id"), let(normal_pieces(F.col("text")), lambda p: F.struct(F.size(p).alias("n"), units_of(p, unit_words).alias("units"))).alias("u"))
    docs = docs.select(*KEY, "doc_id", F.col("u.n").alias("n"), F.col("u.units").alias("units"))
    told = docs.select(*KEY, "doc_id", "n", F.col("units.h").alias("hs"), F.col("units.piece").alias("ps"), selected(F.col("units"), gram, window).alias("prints"))
    told = ws.keep(told, "units")
    several = ws.keep(told.select(F.explode("prints.print").alias("print")).groupBy("print").count().filter("count > 1").select("print"), "several")
    shared = ws.keep(told.select(*KEY, "doc_id", F.inline("prints")).join(several.hint("shuffle_hash"), "print"), "shared")
    ws.drop("several")
    first = ws.keep(shared.groupBy("print").agg(F.min(F.struct("doc_id", *KEY, "pos")).alias("first")), "first")

    before = F.lag("pos").over(Window.partitionBy(*KEY, "print").orderBy("pos"))
    placed = shared.select("print", *KEY, "pos", before.alias("before")).join(first.hint("shuffle_hash"), "print")
    same = F.col("before").isNotNull()
    pairs = placed.select(*KEY, F.when(same, F.col("k1")).otherwise(F.col("first.k1")).alias("p1"), F.when(same, F.col("k2")).otherwise(F.col("first.k2")).alias("p2"), (F.col("pos") - F.coalesce("before", "first.pos")).alias("off"))
    pairs = pairs.filter((F.col("k1") != F.col("p1")) | (F.col("k2") != F.col("p2")) | (F.col("off") != 0))
    pairs = ws.keep(pairs.groupBy(*KEY, "p1", "p2").agg(F.collect_set("off").alias("offs")), "pairs")
    ws.drop("shared", "first")

    theirs = told.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("hs").alias("theirs")).join(pairs.select("p1", "p2").distinct(), ["p1", "p2"], "left_semi")
    both = pairs.join(ws.keep(theirs.dropDuplicates(["p1", "p2"]), "theirs"), ["p1", "p2"]).join(told.select(*KEY, "hs", "ps"), KEY)
    # the places where gram units of both texts are equal, all of them inside both
    equal = lambda a, b, off, i: reduce(lambda x, y: x & y, [F.get(a, i + k) == F.get(b, i - off + k) for k in range(gram)])
    none = F.expr("cast(array() as array<int>)")
    starts = lambda a, b, off, low, last: F.when(last >= low, F.filter(F.sequence(low, last), lambda i: equal(a, b, off, i))).otherwise(none)
    along = lambda a, b, off: starts(a, b, off, F.greatest(F.lit(0), off), F.least(F.size(a), F.size(b) + off) - gram)
    hits = let(F.col("hs"), lambda a: let(F.col("theirs"), lambda b: F.array_distinct(F.flatten(F.transform("offs", lambda off: along(a, b, off))))))
    gone = both.select(*KEY, "ps", hits.alias("hits")).filter(F.size("hits") > 0)
    gone = gone.select(*KEY, F.array_distinct(F.flatten(F.transform("hits", lambda i: F.slice("ps", i + 1, gram)))).alias("gone"))
    gone = ws.keep(gone.groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")
    return told.select(*KEY, "n"), gone


def winnow_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Per document: doc_id, n_units (pieces), removed (numbers of the deleted pieces, from 0) and kept (the text without them)."""
    counts, gone = _repeated(docs, settings.get("gram", GRAM), settings.get("window", WINDOW), settings.get("unit_words", UNIT_WORDS), id_col, text_col)
    told = counts.distinct().join(gone, KEY, "left")  # one row for rows that repeat both id and text
    out = keyed(docs, id_col, text_col).join(told, KEY)
    # only texts that lose something are cut again
    return out.select(
        "doc_id",
        F.when(F.col("text") == "", 0).otherwise(F.col("n")).alias("n_units"),
        F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(pieces(F.col("text")), F.col("gone"))).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents, all columns, without repeated lines; those of which nothing but blanks is left go."""
    out, key = with_key(docs, id_col, text_col)
    mark = fresh(out, "__gone")
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **settings)
    out = out.join(gone.select(*[F.col(k).alias(n) for k, n in zip(KEY, key, strict=True)], F.col("gone").alias(mark)), key, "left")
    out = out.withColumn(text_col, F.when(F.col(mark).isNull(), out[text_col]).otherwise(without(pieces(out[text_col]), F.col(mark))))
    return out.filter(F.col(mark).isNull() | (F.trim(F.regexp_replace(out[text_col], r"\s+", " ")) != "")).drop(*key, mark)
