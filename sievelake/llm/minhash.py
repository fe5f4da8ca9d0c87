"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Each document gets the set of its distinct word shingles (64-bit hashes), a MinHash signature of
   ``coordinates`` values and a 128-bit digest of the set. Documents of equal sets form a class; only a
   class's least document goes on.
2. Classes are posted under each (coordinate, value). Values that one class alone has are dropped. Two classes
   of a similarity at the threshold agree in ``matches`` coordinates or more (but for a chance below one in a
   million), so a class with fewer shared values is done, and of the others only the rarest values are joined:
   all but ``matches`` - 1 of them, since agreeing pairs must meet in one of those.
3. Classes that meet form candidate clusters (each posting links its members to its least one, so a posting
   costs its length). Clusters are cut into blocks of a bounded number of members and bytes; a task counts the agreeing
   coordinates of the pairs of a block and of its cluster's first block, skips pairs that are connected already, and
   confirms the rest on full sets.
4. What then isn't connected to its cluster's largest part meets the others once more, by an exact prefix join on full sets: shingles are
   ordered by rarity, and a pair can only link if it shares one of the first few of each. Pairs of that kind are confirmed on full
   sets by a join. So each link that could connect two parts is tested, and texts that share much but not enough make no pairs.
5. Links give components; a class's component holds for all its documents.

Defined results: documents without words have no shingles and stand alone; a null text is an empty one; rows
without an id have no component (null) and are not kept; rows that repeat an id count as one document for
linking, with the text whose set has fewest shingles (of equals the least digest); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Workspace, fresh, give_back
from sievelake.llm.graph import components

SHINGLE = 5
#: Up to so many ids (8 bytes each) are sent to all executors; more are joined by an exchange.
BROADCAST_IDS = 1 << 20
BATCH_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
FACTORS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BATCH_BYTES + (1 << 17))
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, dtype=np.uint64)))) for b in (BASE, INVERSE)]
    return _powers


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the border of each text among them."""
    joined = b" ".join(texts).lower() + b" "  # bytes.lower() changes A-Z alone
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    raw = np.frombuffer(joined, np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    up, down = powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    word = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * ODD)
    border = np.searchsorted(start, first)
    n = np.diff(border)
    owner = np.repeat(np.arange(len(texts)), n)
    if len(word) >= k:
        hashed = np.zeros(len(word) - k + 1, np.uint64)
        for j in range(k):
            hashed += word[j : len(word) - k + 1 + j] * FACTORS[j]
        same = owner[: len(hashed)] == owner[k - 1 :]
        hashed, owner = mix(hashed[same]), owner[: len(same)][same]
    else:
        hashed, owner = np.zeros(0, np.uint64), owner[:0]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = []
    for i in range(len(texts)):
        if 0 < n[i] < k:
            words = word[border[i] : border[i + 1]]
            sets.append(mix((words * FACTORS[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))))
        else:
            sets.append(np.unique(hashed[cut[i] : cut[i + 1]]))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def signatures(values: np.ndarray, border: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash values of each (non-empty) set; empty sets get zeros."""
    out = np.zeros((len(border) - 1, coordinates), np.uint32)
    full = np.flatnonzero(np.diff(border))
    if len(full):
        at = border[full]
        for c in range(coordinates):
            salt, factor = mix(np.array([2 * c + 1, 2 * c + 2], np.uint64) * ODD)
            out[full, c] = np.minimum.reduceat((values ^ salt) * (factor | np.uint64(1)), at) >> np.uint64(32)
    return out


def portions(batches, most: int = BATCH_BYTES):
    """Lists of rows (id, text as bytes) of bounded size from Arrow batches of two columns."""
    rows, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                if rows and size + len(raw) > most:
                    yield rows
                    rows, size = [], 0
                rows.append((key, raw))
                size += len(raw) + 1
    if rows:
        yield rows


def digests(values: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two numbers; zeros for empty ones."""
    n = np.diff(border)
    h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(full := np.flatnonzero(n)):
        h1[full] = np.add.reduceat(mix(values + ODD), border[full])
        h2[full] = np.bitwise_xor.reduceat(mix(values ^ ODD), border[full])
    return h1, h2


def sign(docs: DataFrame, coordinates: int, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for rows in portions(batches):
            values, border = shingle_sets([r[1] for r in rows], k)
            n, (h1, h2) = np.diff(border), digests(values, border)
            flat = pa.array(signatures(values, border, coordinates).view(np.int32).ravel())
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * coordinates, pa.int32()), flat)
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), sig]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "h1", "h2", "sig"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for rows in portions(batches):
            values, border = shingle_sets([r[1] for r in rows], k)
            sets = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(values.view(np.int64)))
            h1, h2 = digests(values, border)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), sets], ["rep", "h1", "h2", "hashes"])
        give_back()

    return docs.mapInArrow(run, "rep long, h1 long, h2 long, hashes array<long>")


def least_matches(coordinates: int, similarity: float, miss: float = 1e-6) -> int:
    """The largest count that a pair at the threshold reaches but for a chance of ``miss``."""
    chance, t = 0.0, 0
    while True:
        chance += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if chance > miss:
            return max(1, t)
        t += 1


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of equal coordinates of every pair of rows."""
    out = np.zeros((len(left), len(right)), np.int16)
    for c in range(left.shape[1]):
        out += left[:, c, None] == right[None, :, c]
    return out


def alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of set sizes that the threshold allows."""
    return 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])


def linker(coordinates: int, matches: int, percent: int):
    """The task that links a block of a cluster (side 1) within itself and with the cluster's first block (side 0)."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        sig = np.array(pdf.sig.tolist(), dtype=np.int32).reshape(len(pdf), coordinates)
        sets = [np.asarray(h, dtype=np.int64) for h in pdf.hashes]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        rep, side = pdf.rep.to_numpy(), pdf.side.to_numpy()
        up: dict[int, int] = {}

        def root(x):
            while x in up:
                x = up[x]
            return x

        agree = agreeing(sig, sig)
        wanted = np.triu(agree >= matches, 1) & alike(n, n, percent) & (rep[:, None] != rep[None, :])
        wanted &= (side[:, None] == 1) | (side[None, :] == 1)
        i, j = np.nonzero(wanted)
        found = []
        for at in np.argsort(-agree[i, j], kind="stable"):
            a, b = i[at], j[at]
            ra, rb = root(rep[a]), root(rep[b])
            if ra == rb:
                continue
            both = np.concatenate((sets[a], sets[b]))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (n[a] + n[b] - common):
                up[max(ra, rb)] = min(ra, rb)
                found.append((int(rep[a]), int(rep[b])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, *, percent: int = 85, k: int = SHINGLE, coordinates: int = 64, block: int = 128, block_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of distinct shingles, component (its least id) and whether it is that one.

    Linked are documents whose sets' intersection is at least ``percent`` hundredths of their union.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    matches = least_matches(coordinates, percent / 100)
    signed = ws.keep(sign(docs, coordinates, k), "signed")
    classes = ws.keep(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    # rows of one id but different texts: the class of the least digest stands for the id
    twice = classes.groupBy("rep").agg(F.count("*").alias("k"), F.min(F.struct("n_shingles", "h1", "h2")).alias("best")).filter("k > 1").drop("k")
    twice = ws.keep(twice, "twice")
    one_each = classes.join(twice, "rep", "left").filter(F.col("best").isNull() | (F.struct("n_shingles", "h1", "h2") == F.col("best"))).drop("best")

    posted = one_each.select("rep", F.posexplode("sig").alias("coordinate", "value"))
    posted = posted.select("rep", (F.shiftleft(F.col("coordinate").cast("long"), 32) + F.col("value").cast("long") + (1 << 31)).alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    shared = ws.keep(shared, "shared")  # grouped sides are written before a join: then a hot key's part of the other side can be split
    rare_first = posted.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("tokens"))
    prefix = rare_first.filter(F.size("tokens") >= matches).select("rep", F.explode(F.expr(f"slice(tokens, 1, size(tokens) - {matches - 1}).token")).alias("token"))
    prefix = ws.keep(prefix, "prefix")
    hubs = prefix.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = ws.keep(hubs, "hubs")
    meet = prefix.join(hubs, "token").filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    cluster = ws.keep(components(ws, meet, "cluster").select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "cluster")

    ws.drop("shared", "hubs")
    ids = cluster.select(F.col("rep").alias("doc_id")).distinct()
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = full_sets(docs.join(wanted, "doc_id", "left_semi"), k)
    known = cluster.join(one_each.select("rep", "sig", "n_shingles", "h1", "h2"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(8 * F.sum("n_shingles") / block_bytes)).cast("int")
    size = ws.keep(known.groupBy("cluster").agg(blocks.alias("blocks")), "size")
    members = known.join(size, "cluster").join(sets.dropDuplicates(["rep", "h1", "h2"]), ["rep", "h1", "h2"]).drop("h1", "h2")
    members = ws.keep(members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "members")

    # each block within itself and against its cluster's first block
    shape = lambda df, side: df.select("cluster", "left", F.lit(side).alias("side"), "rep", "sig", "hashes")
    own = shape(members.withColumn("left", F.col("block")), 1)
    lead = shape(members.filter("block = 0 and blocks > 1").withColumn("left", F.explode(F.expr("sequence(1, blocks - 1)"))), 0)
    links = ws.keep(own.union(lead).groupBy("cluster", "left").applyInPandas(linker(coordinates, matches, percent), "a long, b long"), "links-1")

    large = members.filter("blocks > 1").select("rep", "cluster")
    if not large.isEmpty():
        links = links.union(ws.keep(rest_links(ws, large, members, links, percent), "links-2"))
    final = components(ws, links, "final").select(F.col("node").alias("rep"), F.col("root").alias("component_id"))
    named = classes.select("h1", "h2", "n_shingles", "rep").join(final, "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    own_or = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own_or.alias("component_id"), F.coalesce(F.col("doc_id") == own_or, F.lit(False)).alias("kept"))


def rest_links(ws: Workspace, large: DataFrame, members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between members outside their cluster's largest part and members of other parts."""
    part = components(ws, links, "first").select(F.col("node").alias("rep"), F.col("root").alias("part"))
    large = ws.keep(large.join(part, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "large")
    main = large.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    main = ws.keep(main, "main")
    held = ws.keep(large.join(main, "cluster").select("rep", "part", (F.col("part") != F.col("main")).alias("rest")), "held")
    pairs = ws.keep(candidate_pairs(ws, held.join(members.select("rep", "hashes"), "rep"), percent), "pairs")
    sets = lambda x: members.select(F.col("rep").alias(x), F.col("hashes").alias(f"{x}s"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", F.size("as").alias("n"), F.size("bs").alias("m"), F.size(F.array_intersect("as", "bs")).alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def candidate_pairs(ws: Workspace, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different parts, one of them a rest, whose sets (rep, part, rest, hashes) can be as similar as asked. None that are is left out.

    Shingles are ordered by how many sets hold them, rare ones first. Let r be the larger set of a pair, s the smaller. With overlap
    of ``percent`` / (100 + ``percent``) of both sizes or more, one of the first |r| - percent |r| / 100 + 1 shingles of r is one of the first
    |s| - 2 percent |s| / (100 + percent) + 1 of s, and behind it enough are left in both. Texts of one template that differ in more than the
    threshold allows have that many shingles of their own, which no other set holds: they are posted nowhere, so such a corpus makes no pairs.
    """
    tokens = sets.select("rep", F.explode("hashes").alias("token"))
    known = ws.keep(tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1"), "frequencies")
    ordered = tokens.join(known, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("shared"))
    n = F.size("hashes")
    probe = n - F.ceil(percent * n / 100).cast("int") + 1
    index = n - F.ceil(2 * percent * n / (100 + percent)).cast("int") + 1
    rows = sets.withColumns({"n": n, "probe": probe, "index": index}).drop("hashes").join(ordered, "rep").withColumn("own", F.col("n") - F.size("shared"))
    rows = rows.select("rep", "part", "rest", "n", "index", "own", F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("probe") - F.col("own")))).alias("at", "x"))
    rows = ws.keep(rows.select("rep", "part", "rest", "n", F.col("x.token").alias("token"), (F.col("own") + F.col("at")).alias("at"), (F.col("own") + F.col("at") < F.col("index")).alias("indexed")), "prefixes")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("rep", "part", "rest", "n", "at")]
    r, s = rows.select("token", *side("r")), rows.filter("indexed").select("token", *side("s"))
    left = F.least(F.col("r_n") - F.col("r_at"), F.col("s_n") - F.col("s_at"))
    fits = (F.col("r_n") >= F.col("s_n")) & (100 * F.col("s_n") >= percent * F.col("r_n")) & ((100 + percent) * left >= percent * (F.col("r_n") + F.col("s_n")))
    met = r.join(s, "token").filter((F.col("r_part") != F.col("s_part")) & (F.col("r_rest") | F.col("s_rest")) & fits)
    return met.select(F.least("r_rep", "s_rep").alias("a"), F.greatest("r_rep", "s_rep").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents, all columns, of which each component keeps its least id; rows without an id stay."""
    ws, mark = Workspace(docs.sparkSession, "near-drop"), fresh(docs, "__gone")
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings).filter("not kept and doc_id is not null").select(F.col("doc_id").alias(mark))
    gone = ws.keep(gone.distinct(), "gone")
    wanted = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(wanted, docs[id_col].cast("long") == F.col(mark), "left_anti")
