"""Histogram sort: shards of near-equal bytes from exact counts below refined key boundaries, then one exchange.

The sort key of a row is (hash of its text, hash of its id), 63 bits each, so equal texts are neighbours and a
group of equal texts can still be cut between two of its rows. Every round counts the exact bytes and rows in
equal parts of each interval that still holds an unsettled splitter; a splitter is settled when its bytes
below are within the tolerance of its target, or when its interval holds a single row or key. Each round reads
(key, size) only. The probes of a round are shared out among its intervals - at most ``PROBES`` in all, or two an
interval - so what the driver gets is bounded by that and the number of ranges, whatever the input's size.

Besides the borders of the shards, borders inside them are settled on bytes and rows together, so that the
one exchange deals out many ranges of bounded size and no task sorts a whole shard. The rows below each
border are known exactly, so positions in a shard follow from positions in a range. A row finds its interval and its
range by binary search in a sorted array, so neither plan nor code grows with their number.

Defined results: a null text has size 1 and is sorted as an empty one; a null id is allowed; equal (text, id)
rows are neighbours in any order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievelake.llm.common import Workspace

HALF = 63  # bits of each of the two hashes
BITS, PROBES = 9, 1 << 17  # probes of an interval at most, and of a round
RESULT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


@dataclass
class Splitter:
    """A border being searched: rows of keys below (a, b) lie under it. ``depth`` bits of its key are known."""

    target: float
    tolerance: float
    by_weight: bool
    a: int = 0
    b: int = 0
    depth: int = 0
    bytes_below: int = 0
    rows_below: int = 0
    settled: bool = False

    def below(self, size: int, rows: int, mean: float) -> float:
        return size + rows * mean if self.by_weight else size


def reached(keys: list[tuple[int, int]]) -> Column:
    """How many of the sorted keys a row's (k1, k2) has reached, by binary search."""
    first, second = F.lit([k[0] for k in keys]).cast("array<long>"), F.lit([k[1] for k in keys]).cast("array<long>")
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    under = lambda m: (F.col("k1") < F.get(first, m)) | ((F.col("k1") == F.get(first, m)) & (F.col("k2") < F.get(second, m)))

    def step(s, _):
        m, open_ = middle(s), s["low"] < s["high"]
        return F.struct(F.when(open_ & ~under(m), m + 1).otherwise(s["low"]).alias("low"), F.when(open_ & under(m), m).otherwise(s["high"]).alias("high"))

    rounds = F.sequence(F.lit(0), F.lit(len(keys).bit_length()))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(len(keys)).alias("high")), step, lambda s: s["low"])


@dataclass
class Histogram:
    keyed: DataFrame
    rounds: int = 0
    counted: list[int] = field(default_factory=list)

    def count(self, intervals: list[tuple[int, int, int]]) -> tuple[dict, int]:
        """Bytes, rows and the keys' range in each part of the (sorted, disjoint) intervals (a, b, depth), and the bits of a part."""
        bits = max(1, min(BITS, (PROBES // len(intervals)).bit_length() - 1))
        k1, k2, which = F.col("k1"), F.col("k2"), F.col("which")
        pick = lambda values: F.get(F.lit(values).cast("array<long>"), which)
        shift = lambda v, n: F.call_function("shiftright", v, n.cast("int"))
        # bits of each hash that the interval leaves open; a part takes its bits from one of them alone
        open1 = [max(0, HALF - depth) for _, _, depth in intervals]
        open2 = [HALF - max(0, depth - HALF) for _, _, depth in intervals]
        found = self.keyed if intervals == [(0, 0, 0)] else self.keyed.withColumn("which", reached([(a, b) for a, b, _ in intervals]) - 1).filter("which >= 0")
        if intervals == [(0, 0, 0)]:
            found = found.withColumn("which", F.lit(0))
        inside = (shift(k1, pick(open1)) == shift(pick([a for a, _, _ in intervals]), pick(open1))) & ((pick(open1) > 0) | (shift(k2, pick(open2)) == shift(pick([b for _, b, _ in intervals]), pick(open2))))
        mask = F.lit((1 << bits) - 1)
        part = F.when(pick(open1) > 0, shift(k1, F.greatest(pick(open1) - bits, F.lit(0))).bitwiseAND(mask)).otherwise(shift(k2, F.greatest(pick(open2) - bits, F.lit(0))).bitwiseAND(mask))
        rows = (
            found.filter(inside)
            .select("which", part.alias("part"), "size", "k1", "k2")
            .groupBy("which", "part")
            .agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("k1").alias("least"), F.max("k1").alias("most"), F.min("k2").alias("least2"), F.max("k2").alias("most2"))
            .collect()
        )
        self.rounds += 1
        self.counted.append(len(rows))
        out: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r.least, r.least2)):
            out.setdefault(r.which, []).append(r)
        return out, bits


def refine(keyed: DataFrame, splitters: list[Splitter], mean: float) -> Histogram:
    """Settles all splitters; every splitter then has its border and the exact bytes and rows below it."""
    hist = Histogram(keyed)
    while open_ := [s for s in splitters if not s.settled]:
        intervals = sorted({(s.a, s.b, s.depth) for s in open_})
        number = {x: i for i, x in enumerate(intervals)}
        parts, bits = hist.count(intervals)
        for s in open_:
            own = parts[number[s.a, s.b, s.depth]]
            size, rows = s.bytes_below, s.rows_below
            for r in own:
                if s.below(size + r["size"], rows + r["rows"], mean) > s.target:
                    break
                size, rows = size + r["size"], rows + r["rows"]
            else:  # all of the interval lies below
                r = own[-1]
                size, rows = size - r["size"], rows - r["rows"]
            short = s.target - s.below(size, rows, mean)
            over = s.below(size + r["size"], rows + r["rows"], mean) - s.target
            lone = r["rows"] == 1 or (r["least"] == r["most"] and r["least2"] == r["most2"])
            upper = over < short
            if min(short, over) <= s.tolerance or lone:
                # the first key of the part, or the first key beyond its last
                s.a, s.b = (r["most"], r["most2"] + 1) if upper and r["least"] == r["most"] else (r["most"] + 1, 0) if upper else (r["least"], r["least2"] if r["least"] == r["most"] else 0)
                s.bytes_below, s.rows_below = (size + r["size"], rows + r["rows"]) if upper else (size, rows)
                s.settled = True
                continue
            s.bytes_below, s.rows_below = size, rows
            if s.depth < HALF and r["least"] == r["most"]:
                s.a, s.b, s.depth = r["least"], 0, HALF  # one text alone: go on by the second hash
            elif s.depth < HALF:
                s.depth = min(HALF, s.depth + bits)
                s.a = r["least"] >> (HALF - s.depth) << (HALF - s.depth)
            else:
                s.depth = min(2 * HALF, s.depth + bits)
                s.b = r["least2"] >> (2 * HALF - s.depth) << (2 * HALF - s.depth)
    return hist


def histogram_sort(docs: DataFrame, shards: int = 8, *, tolerance: float = 0.001, range_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals rows into shards by ranges of the sort key: id, size, CRC-32 of the text, shard, slot in the shard.

    ``tolerance`` is the allowed miss of a shard border in parts of a shard's bytes; ``range_bytes`` bounds what
    one task of the exchange sorts (at least 8 ranges a shard are made); the driver holds a few longs a range.
    """
    spark, text = docs.sparkSession, F.coalesce(docs[text_col].cast("string"), F.lit(""))
    half = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    keyed = Workspace(spark, "histogram-sort").keep(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            half(text).alias("k1"),
            half(docs[id_col].cast("long")).alias("k2"),
        ),
        "keyed",
    )
    total, rows = keyed.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], T.StructType.fromDDL(RESULT)).select("doc_id", "size", "text_crc32", "shard", "slot")
    inner = max(8, -(-total // (shards * range_bytes)))
    mean, n = total / rows, shards * inner
    outer = [Splitter(total * i / shards, tolerance * total / shards, False) for i in range(1, shards)]
    fine = [Splitter(2 * total * i / n, 0.25 * 2 * total / n, True) for i in range(1, n)]
    refine(keyed, outer + fine, mean)
    borders = sorted(outer + fine, key=lambda s: (s.a, s.b))
    starts, shard_of, shard_start, shard, at = [0], [0], [0], 0, 0
    edges = sorted((s.a, s.b) for s in outer)
    for s in borders:
        while shard < len(edges) and edges[shard] <= (s.a, s.b):
            shard, at = shard + 1, s.rows_below
        starts.append(s.rows_below)
        shard_of.append(shard)
        shard_start.append(at)
    pick = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("range") + 1)
    place = F.row_number().over(Window.partitionBy("range").orderBy("k1", "k2", "doc_id")).cast("long")
    return (
        keyed.withColumn("range", reached([(s.a, s.b) for s in borders]))
        .withColumn("place", place)
        .select("doc_id", "size", "text_crc32", pick(shard_of, "int").alias("shard"), (pick([s - b for s, b in zip(starts, shard_start, strict=True)], "long") + F.col("place") - 1).alias("slot"))
    )
