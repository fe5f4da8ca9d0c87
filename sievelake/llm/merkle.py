"""Merkle manifest of a dataset, by supersteps in the manner of Pregel over RDDs.

Leaves are hashes of rows; a source's leaves in order of their ids, ``fanout`` in a row, are the children of a vertex, and so on
up to one vertex a source (its subroot); the subroots, in order of their sources, go up to the root in the same way.

1. Leaves are hashed by built-in functions (no text leaves the JVM) and sorted by (source, id, leaf) over ranges. A leaf's
   place in its source is its row in its range less the source's first row there, plus the source's counts in earlier ranges: so a
   source of any size is numbered without a task that sees all of it.
2. Upward: in a superstep every vertex sends (place, digest) to its parent; a parent that has all its children hashes them and
   sends in the next one. A message group has ``fanout`` rows at most. Sources that have come to one vertex stop.
3. Downward: the root's path is empty; every vertex sends to each child the child's siblings and its own path. The last step
   isn't sent leaf by leaf: a run of leaves takes one path and each leaf adds its own siblings there.
4. Each leaf, or what it has become, is folded with its path; equal to the root, it is verified.

Every superstep's vertices are written to the shared folder, so a lost executor costs a part of one superstep.

Defined results: a null in a field is hashed as ``-``, other values as their count of UTF-8 bytes, ``:`` and the value; rows without an
id come first in their source and are never taken as altered; rows that repeat an id stand in order of their leaves, and whole rows that
repeat are leaves of their own, side by side; rows without a source are a source of their own, before all others; a lone leaf is
its source's subroot, a lone subroot the root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.llm.common import Workspace

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_A_TASK = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERTEX = "g long, at long, n long, digest string, "
PATH = "array<struct<left:string,right:string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(values: Sequence[Column]) -> Column:
    """The hash of a row's fields."""
    each = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*each).cast("binary"), 256)


def digest_of(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def numbered(ws: Workspace, leaves: DataFrame) -> DataFrame:
    """Adds the number of each leaf's source (g), its place there (at) and the source's number of leaves (n)."""
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["src", "doc_id", "leaf", "tie"]
    placed = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ws.keep(placed.drop("tie").select("*", F.spark_partition_id().alias("part"), row.alias("row")), "sorted")
    runs = ws.keep(placed.groupBy("src", "part").agg(F.min("row").alias("begin"), F.count("*").alias("c")), "runs")
    own = Window.partitionBy("src").orderBy("part")
    runs = runs.withColumns({"before": F.coalesce(F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("src"))})
    heads = runs.filter("before = 0").select("src", "part", "begin")
    news = heads.groupBy("part").agg(F.count("*").alias("c"))  # a row for each range
    base = news.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    sources = heads.join(base, "part").select("src", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("begin")) - 1).alias("g"))
    runs = ws.keep(runs.join(sources, "src").select("src", "part", "begin", "before", "n", "g"), "numbers")
    return placed.join(runs, ["src", "part"]).withColumn("at", F.col("row") - F.col("begin") + F.col("before")).drop("part", "row", "begin", "before")


class Supersteps:
    """The vertices of a forest as written tables, a level each; level 0 are its leaves."""

    def __init__(self, ws: Workspace, fanout: int, name: str):
        self.ws, self.fanout, self.name, self.levels = ws, fanout, name, []

    def tasks(self, rows: int) -> int:
        return max(1, min(int(self.ws.spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_TASK + 1))

    def keep(self, vertices: RDD, schema: str, name: str) -> DataFrame:
        return self.ws.keep(self.ws.spark.createDataFrame(vertices, schema, verifySchema=False), f"{self.name}-{name}")

    def step_up(self, children: RDD, rows: int, kid: str) -> None:
        """A superstep: messages ((group, place), (digest, children in all, payload)) to parents, which hash when they are complete."""
        fanout = self.fanout

        def parent(message):
            (g, at), got = message
            got = sorted(got, key=lambda x: x[0])
            n = got[0][2]
            if [x[0] for x in got] != list(range(min(fanout, n - fanout * at))):
                raise ValueError(f"vertex {at} of group {g} has not heard of all its children")
            return g, at, -(-n // fanout), got[0][1] if n == 1 else digest_of(x[1] for x in got), [x[3] for x in got]

        sent = children.map(lambda x: ((x[0], x[1] // fanout), (x[1] % fanout, x[2], x[3], x[4])))
        parents = sent.groupByKey(self.tasks(rows)).map(parent)
        self.levels.append(self.keep(parents, f"{VERTEX}kids array<{kid}>", f"level-{len(self.levels) + 1}"))

    def climb(self) -> None:
        """Supersteps until each group has come to one vertex."""
        while True:
            below = self.levels[-1].filter("n > 1")
            rows = below.count()
            if not rows:
                return
            self.step_up(below.select("g", "at", "digest", "n").rdd.map(lambda r: (r[0], r[1], r[2], r[3], r[2])), rows, "string")

    def tops(self) -> DataFrame:
        """The last vertex of each group and its level."""
        each = [level.filter("n = 1").select("g", "digest", F.lit(i).alias("level")) for i, level in enumerate(self.levels)]
        out = each[0]
        for df in each[1:]:
            out = out.union(df)
        return out

    def descend(self, given: DataFrame, down_to: int) -> DataFrame:
        """Reverse supersteps: ``given`` (g, level, subroot, path) reaches the tops; returns (g, at, subroot, path) of the level's vertices.

        Level -1 are the children of the first level's vertices.
        """
        fanout, sent = self.fanout, None

        def to_children(message):
            (g, at), (kids, (subroot, path)) = message
            for i in range(len(kids)):
                step = [("".join(kids[:i]), "".join(kids[i + 1 :]))] if len(kids) > 1 or at else []
                yield g, at * fanout + i, subroot, step + [(p[0], p[1]) for p in path]

        for i in range(len(self.levels) - 1, down_to, -1):
            got = given.filter(F.col("level") == i).select("g", F.lit(0).cast("long").alias("at"), "subroot", "path")
            got = got if sent is None else got.union(sent)
            vertices = self.levels[i].select("g", "at", "kids")
            tasks = self.tasks(vertices.count())
            paths = got.rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3])))
            met = vertices.rdd.map(lambda r: ((r[0], r[1]), r[2])).join(paths, tasks).flatMap(to_children)
            sent = self.keep(met, f"g long, at long, subroot string, path {PATH}", f"paths-{i}")
        last = given.filter(F.col("level") == down_to).select("g", F.lit(0).cast("long").alias("at"), "subroot", "path")
        return last if sent is None else last.union(sent)


def merkle_manifest(
    docs: DataFrame, *, altered: Column | None = None, text_now: Column | None = None, fields: Sequence[str] = FIELDS, fanout: int = FANOUT, with_proof: bool = False, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with ``with_proof`` also its path of siblings.

    ``altered`` and ``text_now`` say which rows are to be checked as changed and what their text is now.
    """
    ws = Workspace(docs.sparkSession, "merkle")
    values = [docs[f] for f in fields]
    now = [text_now if f == text_col and text_now is not None else docs[f] for f in fields]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("")).alias("src"),
        docs[id_col].cast("long").alias("doc_id"),
        leaf_hash(values).alias("leaf"),
        F.when(F.coalesce(altered, F.lit(False)), leaf_hash(now)).alias("now") if altered is not None else F.lit(None).cast("string").alias("now"),
    )
    leaves = ws.keep(leaves, "leaves")
    placed = ws.keep(numbered(ws, leaves).select("g", "at", "n", "doc_id", "leaf", "now"), "placed")
    ws.drop("leaves", "sorted")
    rows = placed.count()
    result = RESULT + f", path {PATH}" * with_proof
    if not rows:
        return ws.spark.createDataFrame([], result)

    below = Supersteps(ws, fanout, "source")
    below.step_up(placed.rdd.map(lambda r: (r[0], r[1], r[4], r[2], (r[3], r[4], r[5]))), rows, "struct<doc_id:long,leaf:string,now:string>")
    below.climb()
    ws.drop("placed")
    tops = ws.keep(below.tops(), "tops")
    sources = tops.count()

    above = Supersteps(ws, fanout, "root")
    above.step_up(tops.rdd.map(lambda r: (0, r[0], r[1], sources, r[1])), sources, "string")
    above.climb()
    root = above.levels[-1].filter("n = 1").first().digest
    start = ws.spark.createDataFrame([(0, len(above.levels) - 1, root, [])], f"g long, level int, subroot string, path {PATH}")
    roots = above.descend(start, -1).select(F.col("at").alias("g"), "path")
    given = ws.keep(tops.join(roots, "g").select("g", "level", F.col("digest").alias("subroot"), "path"), "given")
    paths = below.descend(given, 0)

    def leaves_of(message):
        (g, at), ((kids, alone), (subroot, path)) = message
        above = [(p[0], p[1]) for p in path]
        for i, (doc, leaf, now) in enumerate(kids):
            own = [] if alone else [("".join(k[1] for k in kids[:i]), "".join(k[1] for k in kids[i + 1 :]))]
            folded = now or leaf
            for left, right in own + above:
                folded = digest_of((left, folded, right))
            proof = digest_of(s for step in own + above for s in step)
            yield (doc, leaf, subroot, root, proof, folded, folded == root, *[own + above] * with_proof)

    first = below.levels[0].select("g", "at", "kids", (F.col("n") == 1) & (F.size("kids") == 1)).rdd.map(lambda r: ((r[0], r[1]), ([tuple(k) for k in r[2]], r[3])))
    met = first.join(paths.rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3]))), below.tasks(rows)).flatMap(leaves_of)
    return ws.spark.createDataFrame(met, result, verifySchema=False)


def lowered(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, UPPER, LOWER)


def tampering(id_column: Column, share: int = 5) -> Column:
    """Whether ``share`` divides the CRC-32 of the decimal id."""
    return F.crc32(id_column.cast("long").cast("string").cast("binary")) % share == 0
