"""Long repeated byte strings by a run-length compressed Burrows-Wheeler index of the places that can repeat.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too.

1. Anchors. Every string of ``length`` bytes chooses its least 32-byte gram (the leftmost of equals) as its anchor.
   Equal strings choose the same anchor at the same place, so only strings of one anchor need comparing. A task
   emits, for each anchor, the range of strings that choose it and a digest of all bytes that they span.
2. Anchors at one place only are dropped by a grouped count. Where all that two anchors' strings span is equal, all
   these strings repeat. Only different spans of an anchor are compared byte by byte: their bytes are read again,
   cut in a left and a right half, and grouped by the 116 bytes that all strings of a half share.
3. Index. Groups are streamed in batches of bounded size into a run-length BWT with the text's matching lengths
   sampled at run ends; the lengths between samples follow by counting down along the text. Two strings that meet
   in the index over ``length`` bytes are a repeat.
4. A group of more than ``group`` spans isn't put in one task. Its spans are halved again and again, by place against the
   anchor: the strings of a part share more and more bytes, so groups shrink; parts that are equal as a whole are settled
   at once. At the end a part is one string. So hot groups are resolved by grouped counts, whatever their size.

Defined results: a null text is an empty one; texts under ``length`` bytes lose nothing; equal texts of that length
lose everything, in rows that repeat an id too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import BROADCAST_BYTES, KEY, Workspace, give_back, keyed, small_batches
from sievelake.llm.minhash import mix, powers

GRAM = 32
BATCH = 1 << 20


class Rolling:
    """Hashes of any range of a byte array (a polynomial, finalised)."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64))


def anchors(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Of texts laid end to end: per anchor its text, the first and last string that choose it (places in the text),
    the anchor's place, its gram's hash and the digest of all bytes from the first string to the last one's end."""
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    width = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return dict.fromkeys(("doc", "lo", "hi", "at", "gram", "digest"), none)
    roll = Rolling(raw)
    n = len(raw) - GRAM + 1
    place = np.arange(n, dtype=np.uint64)
    gram = roll.of(np.arange(n), np.arange(GRAM, len(raw) + 1))
    key = (gram & np.uint64(0xFFFFFFFF_00000000)) | place
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    start = np.arange(n - width + 1)
    chosen = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(first, start, "right") - 1
    inside = start + length <= first[doc + 1]
    start, chosen, doc = start[inside], chosen[inside], doc[inside]
    if not len(start):
        return dict.fromkeys(("doc", "lo", "hi", "at", "gram", "digest"), none)
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]))))
    lo, hi = start[new], start[np.concatenate((new[1:] - 1, [len(start) - 1]))]
    at, doc = chosen[new], doc[new]
    base = first[doc]
    return {"doc": doc, "lo": lo - base, "hi": hi - base, "at": at - base, "gram": gram[at].view(np.int64), "digest": roll.of(lo, hi + length).view(np.int64)}


class RunLengthIndex:
    """The run-length BWT of byte strings, each closed by a mark of its own, with matching lengths at run ends."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        n = int(size.sum()) + len(texts)
        text = np.zeros(n, np.int64)
        marks = self.start + size
        text[marks] = 256 + np.arange(len(texts))
        inner = np.ones(n, bool)
        inner[marks] = False
        text[inner] = np.frombuffer(b"".join(texts), np.uint8)
        self.text, self.n = text, n
        self.levels: list[tuple[int, np.ndarray]] = []
        rank, depth = text, 1
        self.levels.append((1, text))
        while True:
            ahead = np.full(n, -1, np.int64)
            ahead[: n - depth] = rank[depth:]
            key = rank * (n + 258) + (ahead + 1)
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            depth *= 2
            if new[-1] == n - 1:
                break
            self.levels.append((depth, rank))
        self.order, self.rank = order, rank
        before = text[order - 1]  # the text is taken as a circle
        self.heads = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.symbols = before[self.heads]
        self.samples = np.zeros(len(self.heads), np.int64)
        self.samples[1:] = self.common(order[self.heads[1:] - 1], order[self.heads[1:]])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths that pairs of places have in common, from the ranks of the sorting rounds."""
        got = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.levels):
            x, y = a + got, b + got
            same = (x < self.n) & (y < self.n)
            same[same] = rank[x[same]] == rank[y[same]]
            got[same] += depth
        return got

    def lengths(self) -> np.ndarray:
        """The length that each place has in common with the one before it in the order: samples, counted down along the text."""
        known = np.zeros(self.n, bool)
        value = np.zeros(self.n, np.int64)
        at = self.order[self.heads]
        known[at], value[at] = True, self.samples
        known[0] = True
        if self.rank[0]:
            value[0] = self.common(self.order[self.rank[:1] - 1], np.zeros(1, np.int64))[0]
        last = np.maximum.accumulate(np.where(known, np.arange(self.n), -1))
        return np.maximum(value[last] - (np.arange(self.n) - last), 0)

    def repeated(self, own: np.ndarray, length: int) -> np.ndarray:
        """Which of the first ``own`` places of each text start a string of that length that another such place starts."""
        lcp = self.lengths()[self.order]
        group = np.cumsum(lcp < length)
        mine = np.zeros(self.n + 1, np.int64)
        np.add.at(mine, self.start, 1)
        np.add.at(mine, self.start + own, -1)
        mine = np.cumsum(mine)[: self.n] > 0
        counted = np.bincount(group[mine[self.order]], minlength=int(group[-1]) + 1)
        out = np.zeros(self.n, bool)
        out[self.order] = counted[group] > 1
        return out & mine


def runs(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


SCAN = "row_key binary, tid long, n_bytes long, anchors array<struct<gram:long,pos:long,digest:long,pack:long>>"
PART = "core long, row_key binary, pos long, lo long, own long, at long, p long, q long, bytes binary, open boolean"
PART_NAMES = [c.split()[0] for c in PART.split(", ")]


def scan(docs: DataFrame, length: int) -> DataFrame:
    """Anchors of every document. Every byte of the table has a place: the task's number, then its bytes so far."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 44
        kind = pa.struct([("gram", pa.int64()), ("pos", pa.int64()), ("digest", pa.int64()), ("pack", pa.int64())])

        def out(rows):
            nonlocal place
            texts = [t for _, t in rows]
            found = anchors(texts, length)
            size = np.array([len(t) for t in texts], dtype=np.int64)
            tid = place + np.concatenate(([0], np.cumsum(size + 1)))[:-1]
            place += int(size.sum()) + len(rows)
            pos = tid[found["doc"]] + found["lo"]
            pack = found["lo"] << 20 | (found["hi"] - found["lo"]) << 10 | (found["at"] - found["lo"])
            items = pa.StructArray.from_arrays([pa.array(found["gram"]), pa.array(pos), pa.array(found["digest"]), pa.array(pack)], fields=list(kind))
            border = np.searchsorted(found["doc"], np.arange(len(rows) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(border), items)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array(tid), pa.array(size), lists], ["row_key", "tid", "n_bytes", "anchors"])

        from sievelake.llm.minhash import portions

        for rows in portions(batches, BATCH):
            yield out(rows)
        give_back()

    return docs.mapInArrow(run, SCAN)


def cut(row: dict, p: int, q: int, length: int) -> dict | None:
    """The strings of a span whose distance to the anchor is p to q, by the bytes that all strings so placed share.

    The distances are the same for every span, so equal strings always come to one part.
    """
    first, last = max(0, row["at"] - q), min(row["own"] - 1, row["at"] - p)
    if first > last:
        return None
    shared = row["bytes"][row["at"] - p : row["at"] - q + length]
    core = hashlib.blake2b(shared, digest_size=8, key=b"%d-%d" % (p, q)).digest()
    return row | {
        "core": int.from_bytes(core, "little", signed=True),
        "pos": row["pos"] + first,
        "lo": row["lo"] + first,
        "own": last - first + 1,
        "at": row["at"] - first,
        "p": p,
        "q": q,
        "bytes": row["bytes"][first : last + length],
    }


def part_batch(rows: list[dict]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 6, pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(PART_NAMES, kinds, strict=True)], PART_NAMES)


def halves_of(q: int, p: int = 0) -> tuple[tuple[int, int], tuple[int, int]]:
    return (p, (p + q) // 2), ((p + q) // 2 + 1, q)


def read_parts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the spans to compare, in two parts each."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(i, 64).to_pylist():
                    raw = (r["text"] or "").encode()
                    for w in r["spans"]:
                        lo, more = w["pack"] >> 20, w["pack"] >> 10 & 1023
                        span = {"row_key": r["row_key"], "pos": w["pos"], "lo": lo, "own": more + 1, "at": w["pack"] & 1023, "bytes": raw[lo : lo + more + length], "open": w["open"]}
                        out += [x for ends in halves_of(length - GRAM) if (x := cut(span, *ends, length))]
                yield part_batch(out)

    return docs.join(wanted, "row_key").select("row_key", "text", "spans").mapInArrow(run, PART)


def split_parts(parts: DataFrame, length: int) -> DataFrame:
    """Each part in two, which share more bytes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield part_batch([x for r in batch.slice(i, 256).to_pylist() for ends in halves_of(r["q"], r["p"]) if (x := cut(r, *ends, length))])

    return parts.select(*PART_NAMES).mapInArrow(run, PART)


def index_groups(halves: DataFrame, length: int) -> DataFrame:
    """Repeated strings of small groups: each task lays whole groups into batches and indexes these."""

    def run(batches):
        import pyarrow as pa

        def out(rows):
            index = RunLengthIndex([r["bytes"] for r in rows])
            hit = index.repeated(np.array([r["own"] for r in rows]), length)
            found = [(r["row_key"], r["lo"] + int(a), r["lo"] + int(b) - 1 + length) for r, s in zip(rows, index.start, strict=True) if r["open"] for a, b in runs(hit[s : s + r["own"]])]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["row_key", "start", "stop"])

        rows, size, core = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if size > BATCH // 4 and r["core"] != core:
                    yield out(rows)
                    rows, size = [], 0
                core = r["core"]
                rows.append(r)
                size += len(r["bytes"])
        if rows:
            yield out(rows)
        give_back()

    return halves.repartition("core").sortWithinPartitions("core").mapInArrow(run, "row_key binary, start long, stop long")


def repeated_strings(docs: DataFrame, length: int, group: int = 200) -> DataFrame:
    """row_key, start, stop of byte ranges made of repeated strings (ranges may overlap). ``docs`` has row_key and text."""
    spark = docs.sparkSession
    ws = Workspace(spark, "runindex")
    scanned = ws.keep(scan(docs.select("row_key", "text"), length), "scanned")
    every = scanned.select("row_key", F.inline("anchors"))
    # grouped sides are written before a join: then a hot key's part of the other side can be split
    several = ws.keep(every.groupBy("gram").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).filter("a <> b").select("gram"), "several")
    shared = ws.keep(every.join(several, "gram"), "shared")
    ws.drop("scanned")
    shape = F.col("pack").bitwiseAND(F.lit((1 << 20) - 1)).alias("shape")
    kinds = shared.select("*", shape).groupBy("gram", "shape", "digest").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min(F.struct("pos", "row_key", "pack")).alias("one"))
    kinds = ws.keep(kinds, "kinds")
    same = kinds.filter("a <> b").select("gram", "shape", "digest")
    lo = F.shiftright("pack", 20)
    found = [shared.select("*", shape).join(same, ["gram", "shape", "digest"]).select("row_key", lo.alias("start"), (lo + F.shiftright("pack", 10).bitwiseAND(F.lit(1023)) + length).alias("stop"))]

    mixed = kinds.groupBy("gram").agg(F.count("*").alias("n"), F.max((F.col("a") == F.col("b")).cast("int")).alias("single")).filter("n > 1 and single = 1").select("gram")
    mixed = ws.keep(mixed, "mixed")
    wanted = kinds.join(mixed, "gram").select("one.row_key", F.struct("one.pos", "one.pack", (F.col("a") == F.col("b")).alias("open")).alias("span"))
    wanted = ws.keep(wanted.groupBy("row_key").agg(F.collect_list("span").alias("spans")), "wanted")
    ids = wanted.select("row_key")
    texts = docs.select("row_key", "text")
    texts = texts.join(F.broadcast(ids) if 64 * wanted.count() <= BROADCAST_BYTES else ids, "row_key", "left_semi")
    parts, small, level = read_parts(texts.dropDuplicates(["row_key"]), wanted, length), [], 0
    while True:
        parts = ws.keep(parts, f"parts-{level}")
        if level:  # parts that are equal as a whole are settled; one of them stays for others to meet
            twins = parts.groupBy("core", F.md5("bytes").alias("digest")).agg(F.min("pos").alias("a"), F.max("pos").alias("b")).filter("a <> b").drop("b")
            twins = ws.keep(twins, f"twins-{level}")
            marked = ws.keep(parts.withColumn("digest", F.md5("bytes")).join(twins, ["core", "digest"], "left"), f"marked-{level}")
            found.append(marked.filter("a is not null and open").select("row_key", F.col("lo").alias("start"), (F.col("lo") + F.col("own") - 1 + length).alias("stop")))
            parts = marked.filter("a is null or a = pos").withColumn("open", F.col("open") & F.col("a").isNull()).select(*PART_NAMES)
        size = parts.groupBy("core").agg(F.count("*").alias("n"), F.max(F.col("open").cast("int")).alias("any")).filter("n > 1 and any = 1").drop("any")
        sized = ws.keep(parts.join(ws.keep(size, f"size-{level}"), "core"), f"sized-{level}")
        small.append(sized.filter(F.col("n") <= group).select(*PART_NAMES))
        large = sized.filter(F.col("n") > group)
        if large.isEmpty():
            break
        parts, level = split_parts(large, length), level + 1
    found.append(index_groups(reduce(DataFrame.union, small), length))
    return ws.keep(reduce(DataFrame.union, found).groupBy("row_key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")


def remove_repeats(docs: DataFrame, *, length: int = 200, group: int = 200, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` the removed spans and the bytes that stay."""
    small_batches(docs.sparkSession)
    half = lambda k: F.lpad(F.hex(k), 16, "0")
    docs = keyed(docs, id_col, text_col).select("doc_id", "text", F.unhex(F.concat(*[half(k) for k in KEY])).alias("row_key"))
    ranges = repeated_strings(docs, length, group)
    more = ", removed array<struct<start:long,stop:long>>, kept binary" * keep_text

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema  # noqa: F401

        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = [[] for _ in range(7)]
                for doc, text, found in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    raw, spans = (text or "").encode(), []
                    for r in sorted(found or (), key=lambda r: r["start"]):
                        if spans and r["start"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r["stop"])
                        else:
                            spans.append([r["start"], r["stop"]])
                    at, kept = 0, []
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    kept = b"".join([*kept, raw[at:]])
                    row = (doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in spans], kept)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())[: 7 if keep_text else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: len(kinds)])

    return docs.join(ranges, "row_key", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
