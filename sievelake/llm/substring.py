"""Line or paragraph hashing: repeated units of text are removed but for their earliest ranked occurrence.

A unit is a line, or a piece of one (cut where one of ``. ! ? ; : ,`` stands before a blank), so that a passage that
begins or ends inside a line still shares its inner units; or a paragraph between blank lines. It is normalised -
lower case, white space runs to one space, trimmed - and hashed to 128 bits. Units are grouped by digest over all
documents with partial aggregates, so a unit that a third of all documents hold is one row a task; the earliest
occurrence by (document id, key of the row, unit number) stays, and later ones go with their offsets in the original
text: whole lines and paragraphs of ``min_words`` words or more always, pieces of a line where the run of later
occurrences that they stand in has ``run_words`` words or more, as a few words alone are no repetition. A ``passage``
is such a run of ``passage_words`` words or more.

Defined results: null and empty texts have no units; rows without an id rank last; rows that repeat both id and
text count as one occurrence and are treated alike; within a document a later repeat goes too; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import KEY, Workspace, first_id, keyed, let, normal_pieces, pieces, without, word_count

SPAN = "struct<unit:int,start:long,stop:long>"


def cut_of(unit: str) -> tuple:
    """How a text is cut into units, and their normal forms."""
    if unit == "line":
        return pieces, normal_pieces
    if unit == "paragraph":
        cut = lambda text: F.split(text, r"(?<=\n\n)(?!\n)", -1)
        return cut, lambda text: F.transform(cut(text), lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")))
    raise ValueError(f"unit is line or paragraph, not {unit}")


def running(values: Column, chunk: int = 256) -> Column:
    """Sums of all values up to each one, in chunks, so that the copies of a growing array stay short."""
    inner = lambda c, begin: F.aggregate(c, F.struct(begin.alias("at"), F.expr("cast(array() as array<long>)").alias("all")), lambda a, x: _add(a, x))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<long>>)").alias("all"))
    step = lambda v: lambda a, c: let(inner(F.slice(v, c * chunk + 1, chunk), a["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(a["all"], F.array(r["all"])).alias("all")))
    return let(values, lambda v: F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), begin, step(v), lambda a: a["all"])))


def _add(a: Column, x: Column) -> Column:
    return F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"] + x)).alias("all"))


def repeated_units(docs: DataFrame, *, unit: str = "line", min_words: int = 1, run_words: int = 8, passage_words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text, n_units, removed (array of unit number, start, stop in code points), n_passages and kept text."""
    ws, (cut, forms) = Workspace(docs.sparkSession, "units"), cut_of(unit)
    docs = keyed(docs, id_col, text_col)
    units = docs.select(*KEY, "doc_id", F.posexplode(forms(F.col("text"))).alias("unit", "clean")).filter("clean <> ''")
    units = ws.keep(units.select(*KEY, "doc_id", "unit", F.xxhash64("clean").alias("h1"), F.xxhash64(F.lit(7), "clean").alias("h2")), "units")
    # the grouped sides are tables of their own, so that both sides of a join are exchanged and a hot unit's part can be split
    several = ws.keep(units.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "several")
    shared = ws.keep(units.join(several, ["h1", "h2"]), "shared")
    ws.drop("units", "several")
    place = F.struct(first_id().alias("doc_id"), *KEY, "unit")
    first = ws.keep(shared.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first")
    later = shared.join(first, ["h1", "h2"]).filter(place != F.col("first"))
    later = ws.keep(later.groupBy(*KEY).agg(F.array_sort(F.collect_set("unit")).alias("later")), "later")
    ws.drop("shared", "first")

    hit = docs.join(later, KEY, "left").withColumns({"parts": cut(F.col("text")), "clean": F.when(F.col("later").isNotNull(), forms(F.col("text")))})
    told = F.transform("later", lambda i: F.struct(i.alias("i"), word_count(F.get("clean", i)).alias("words"), whole_line(F.col("parts"), i).alias("whole")))
    hit = hit.withColumn("told", told).withColumn("told", with_runs(F.col("told"), F.col("clean")))
    goes = lambda x: F.when(x["whole"], x["words"] >= min_words).otherwise(x["run"] >= run_words)
    none = F.expr("cast(array() as array<int>)")
    hit = hit.withColumn("gone", F.coalesce(F.transform(F.filter("told", goes), lambda x: x["i"]), none))
    passages = F.size(F.array_distinct(F.transform(F.filter("told", lambda x: (x["run"] >= passage_words) & goes(x)), lambda x: x["head"])))
    return hit.select(
        "doc_id",
        "text",
        F.when(F.col("text") == "", 0).otherwise(F.size("parts")).alias("n_units"),
        spans(F.col("parts"), F.col("gone")).alias("removed"),
        F.coalesce(passages, F.lit(0)).alias("n_passages"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(without(F.col("parts"), F.col("gone"))).alias("kept"),
    )


def whole_line(parts: Column, i: Column) -> Column:
    """Whether unit i begins and ends where a line does."""
    begins = (i == 0) | F.endswith(F.get(parts, i - 1), F.lit("\n"))
    return begins & (F.endswith(F.get(parts, i), F.lit("\n")) | (i == F.size(parts) - 1))


def with_runs(told: Column, clean: Column) -> Column:
    """Adds the first unit (head) and the words (run) of the run of later occurrences that each stands in; blank units don't end a run."""

    def apart(t, k, x):
        last = F.get(t, k - 1)["i"]
        return (k == 0) | ((last < x["i"] - 1) & F.exists(F.slice(clean, last + 2, x["i"] - last - 1), lambda c: c != ""))

    heads = lambda t: F.filter(F.transform(t, lambda x, k: F.when(apart(t, k, x), k)), lambda k: k.isNotNull())
    stop = lambda t, h, j: F.coalesce(F.get(h, j + 1), F.size(t))
    run = lambda t, h: F.flatten(F.transform(h, lambda a, j: let(F.slice(t, a + 1, stop(t, h, j) - a), lambda r: run_of(r))))
    return let(told, lambda t: let(heads(t), lambda h: run(t, h)))


def run_of(r: Column) -> Column:
    total = F.aggregate(r, F.lit(0), lambda a, x: a + x["words"])
    head = F.get(r, 0)["i"]
    return let(F.struct(total.alias("run"), head.alias("head")), lambda s: F.transform(r, lambda x: F.struct(x["i"].alias("i"), x["words"].alias("words"), x["whole"].alias("whole"), s["run"].alias("run"), s["head"].alias("head"))))


def spans(parts: Column, gone: Column) -> Column:
    """Unit number, start and stop of the units that go; a line's end isn't part of them."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    ends = running(F.transform(parts, lambda p: F.char_length(p).cast("long")))
    start = lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get(e, i - 1)).cast("long")
    bare = lambda p: F.char_length(F.rtrim(p, F.lit("\n"))).cast("long")
    found = let(ends, lambda e: F.transform(gone, lambda i: F.struct(i.alias("unit"), start(e, i).alias("start"), (start(e, i) + bare(F.get(parts, i))).alias("stop"))))
    return F.when(F.size(gone) == 0, none).otherwise(found)
