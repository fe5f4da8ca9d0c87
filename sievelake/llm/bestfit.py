"""Best-fit packing by linear grouping: few sizes are packed optimally, documents take their places, small ones fill up.

1. Each task tokenises its documents, cuts those over a sequence's length from the end (so the first piece may be
   shorter) and numbers its pieces of each length. The table of pieces is written once; token ids leave a task only if
   they are asked for.
2. All that placement depends on is how many pieces there are of each length: at most ``window`` counts, whatever the
   size of the corpus. From them the driver plans:
   a. lengths over ``large`` of a sequence are put, in descending order, in ``groups`` groups of equal cardinality, and
      rounded up to the greatest of their group (no more lengths than groups: each is its own);
   b. which configurations of these few sizes, and how often each, is a linear program solved by column generation (the
      pricing problem is a knapsack); counts are rounded down;
   c. the configurations' places go to actual lengths, the greatest first, so that only bins in a row are alike;
   d. pieces that got no place and small ones follow in descending order, each into the bin that it fits best; bins that are
      alike are filled together.
   Rounding costs room that only small pieces can use, so how many are small decides which ``large`` serves best: each of those
   given is planned, and the plan of the fewest bins is carried out. It says of the pieces of a length, by their number, which bin and place there they get. Its rows depend on the number
   of lengths, not of documents.
3. A piece's number among all of its length is its number in its task and the counts of the tasks before; with that it
   looks its place up in the plan.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows and ids are packed as
documents of their own; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.llm.bytebpe import byte_encoder
from sievelake.llm.common import Workspace, give_back

WINDOW, END_ID, GROUPS = 2048, 0, 32
LARGE = (1 / 8, 1 / 4, 1 / 3, 2 / 5, 1 / 2)


# ---- the plan


def grouped(counts: dict[int, int], least: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)]) of groups of equal cardinality, from the greatest length down to ``least``."""
    if sum(s >= least for s in counts) <= groups:
        return [(s, [(s, counts[s])]) for s in sorted(counts, reverse=True) if s >= least]
    share, out, room = -(-sum(n for s, n in counts.items() if s >= least) // groups), [], 0
    for size in sorted((s for s in counts if s >= least), reverse=True):
        n = counts[size]
        while n:
            if not room:
                out.append((size, []))
                room = share
            part = min(n, room)
            out[-1][1].append((size, part))
            n, room = n - part, room - part
    merged: dict[int, list] = {}
    for size, held in out:  # groups that are rounded to the same size are one
        merged.setdefault(size, []).extend(held)
    return list(merged.items())


def best_configuration(sizes: np.ndarray, worth: np.ndarray, window: int) -> np.ndarray:
    """The numbers of each size that are worth most within a sequence."""
    best, taken = np.zeros(window + 1), np.full(window + 1, -1)
    for c in range(int(sizes.min()), window + 1):
        fits = np.flatnonzero(sizes <= c)
        got = best[c - sizes[fits]] + worth[fits]
        i = int(np.argmax(got))
        best[c] = best[c - 1]
        if got[i] > best[c] + 1e-12:
            best[c], taken[c] = got[i], fits[i]
    out, c = np.zeros(len(sizes)), window
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[taken[c]] += 1
            c -= sizes[taken[c]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, window: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each: the basis of the linear program, rounded down."""
    basis = np.diag((window // sizes).astype(float))
    for _ in range(50 * len(sizes)):  # a plan that stops early is still one
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, worth, window)
        if worth @ column <= 1 + 1e-9:
            break
        step, now = np.linalg.solve(basis, column), np.linalg.solve(basis, demand)
        ratio = np.where(step > 1e-12, now / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    often = np.floor(np.linalg.solve(basis, demand) + 1e-9).astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(n)) for j, n in enumerate(often) if n > 0]


class Bins:
    """Classes of bins that hold the same lengths: {room left: [(count, content)]}; a content is (content before, length, copies)."""

    def __init__(self, window: int):
        self.window, self.by_room = window, defaultdict(list)
        self.rooms = np.zeros(window + 1, dtype=bool)

    def put(self, room: int, count: int, content) -> None:
        if count:
            self.by_room[room].append((count, content))
            self.rooms[room] = True

    def number(self) -> int:
        return sum(count for held in self.by_room.values() for count, _ in held)

    def fill(self, size: int, n: int) -> None:
        """Places n pieces of a size, each where it leaves least room."""
        while n:
            fits = np.flatnonzero(self.rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                count, content = self.by_room[room].pop()
                self.rooms[room] = bool(self.by_room[room])
            else:
                room, count, content = self.window, n, None
            copies = room // size
            full = min(count, n // copies)
            self.put(room - copies * size, full, (content, size, copies))
            n, count = n - full * copies, count - full
            if count and n < copies and n:
                self.put(room - n * size, 1, (content, size, n))
                n, count = 0, count - 1
            if content is not None:
                self.put(room, count, content)


def plan(counts: dict[int, int], window: int = WINDOW, large: tuple[float, ...] = LARGE, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first, bin, offset, copies), sorted: from number ``first`` on, pieces of a length go ``copies`` to a bin, from ``bin`` on."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    return placements(min((filled(counts, window, share, groups) for share in large), key=lambda bins: bins.number()), counts)


def filled(counts: dict[int, int], window: int, large: float, groups: int) -> Bins:
    """All pieces in bins, those of the configurations first."""
    found, bins, left = grouped(counts, int(window * large) + 1, groups), Bins(window), dict(counts)
    chosen = configurations(np.array([s for s, _ in found]), np.array([sum(n for _, n in held) for _, held in found], dtype=float), window) if found else []
    queues = [list(reversed(held)) for _, held in found]
    for places, often in chosen:
        slots = []
        for i in np.repeat(np.arange(len(found)), places):  # each place of a configuration gets the next ``often`` documents of its group
            run, need = [], often
            while need and queues[i]:
                size, n = queues[i].pop()
                part = min(n, need)
                run.append((size, part))
                left[size] -= part
                need -= part
                if part < n:
                    queues[i].append((size, n - part))
            slots.append(run + [(0, need)] * (need > 0))
        borders = sorted({0, often}.union(*[accumulate(n for _, n in run) for run in slots]))
        at = [iter([(stop, size) for (size, _), stop in zip(run, accumulate(n for _, n in run), strict=True)]) for run in slots]
        now = [next(x) for x in at]
        for a, b in zip(borders, borders[1:], strict=False):
            now = [next(x) if stop <= a else (stop, size) for x, (stop, size) in zip(at, now, strict=True)]
            content = None
            for size in sorted((size for _, size in now if size), reverse=True):
                content = (content, size, 1)
            if content:
                bins.put(window - sum(size for _, size in now), b - a, content)
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        bins.fill(size, left[size])
    return bins


def placements(bins: Bins, counts: dict[int, int]) -> np.ndarray:
    rows, number, used = [], 0, defaultdict(int)
    for room in sorted(bins.by_room):
        for count, content in bins.by_room[room]:
            held = []
            while content:
                content, size, copies = content
                held.append((size, copies))
            offset = 0
            for size, copies in reversed(held):
                rows.append((size, used[size], number, offset, copies))
                used[size] += count * copies
                offset += size * copies
            number += count
    assert dict(used) == counts, "every piece has one place"
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---- the job


def tokenised(docs: DataFrame, tokenizer: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of all documents, with their task (part) and number among its pieces of that length (nth)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, part, seen = byte_encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                some = batch.slice(at, 256)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = memoryview(words.encode(text or "") + end)
                    total = len(ids) // 4
                    borders = [0, *range(total % window or window, total + 1, window)]
                    for piece, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc, piece, a, b - a, zlib.crc32(own), part, seen[b - a], *[bytes(own)] * with_ids))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids binary" * with_ids)


def pack_best_fit(
    docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, large: tuple[float, ...] = LARGE, groups: int = GROUPS, with_ids: bool = False, doc_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, on request, its ids.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read.
    """
    ws = Workspace(docs.sparkSession, "bestfit")
    docs = docs.select(docs[doc_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = ws.keep(tokenised(docs, tokenizer, window, end_id, with_ids), "pieces")
    held = ws.keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "held")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    rows = plan(counts, window, large, groups)
    sent = docs.sparkSession.sparkContext.broadcast(rows)  # as many rows as lengths and their splits give, whatever the number of documents

    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # its rows grow with the tasks, so it is never broadcast
    before = held.select("length", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    placed = pieces.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")
    last = ["ids"] * with_ids

    def place(batches):
        import pyarrow as pa

        found = sent.value
        sizes, starts = np.unique(found[:, 0], return_index=True)
        of = {int(size): (a, b) for size, a, b in zip(sizes, starts, [*starts[1:], len(found)], strict=False)}
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = np.empty(len(rank), dtype=np.int64)
            for size in np.unique(length):
                own, (a, b) = length == size, of[int(size)]
                row[own] = a + np.searchsorted(found[a:b, 1], rank[own], "right") - 1
            _, first, number, offset, copies = found[row].T
            deep = rank - first
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(number + deep // copies), pa.array(offset + deep % copies * length)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in last], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *last])

    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
