"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

A benchmark item of n words is looked for in windows of n words; a text of fewer words is one window. Windows are bags of ``k``-word shingles; their
similarity to the item is the sum of the lesser counts over the sum of the greater counts (the weights are counts).

1. A window of any similarity to an item shares a shingle with it, so windows are laid around such places only:
   for each shared shingle every window of the item's size that holds it.
2. Each window gets a 64-bit SimHash of its weighted shingles. The bits' sums are kept three to a long, so one
   grouped aggregate in generated code makes them.
3. Multi-index Hamming blocks: a fingerprint has ``BLOCKS`` blocks of 16 bits; two that differ in up to ``radius`` bits
   differ in one block by ``radius // BLOCKS`` bits at most. An item is posted under all values so near to its own in
   each block, and a window is looked up under its own values; so none within the radius is missed, and at radius 11
   an unrelated fingerprint meets an item with a chance under one in a hundred. A pair is taken in the first block that is
   near enough, and by its true distance.
4. The windows of these pairs are cut out of their documents, and their full shingle bags are compared with the items'.

At a similarity of 0.8 two fingerprints differ in nine bits on average, and less at higher ones; a window beyond the radius is
mostly one of several around its passage. The recall against all windows is in the README, and ``radius`` is a parameter.

Defined results: words are runs of letters and digits in lower case; null or wordless texts and items match
nothing; an item of fewer than ``k`` words is one shingle; repeated rows are found alike; rows without an id have a null
id in the result; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import BROADCAST_BYTES, KEY, Workspace, keyed, with_key

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 11
BLOCKS, BLOCK_BITS = 4, 16
LANES, LANE_BITS = 22, 21  # 22 longs hold the sums of 66 bits, up to two million shingles each


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of all k words in a row. The words are bound to a variable first, else each step would split the text again."""
    none = F.expr("cast(array() as array<long>)")
    rows = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(none)
    return F.get(F.transform(F.array(words), rows), 0)


def bounded(df: DataFrame, array: str | None = None) -> DataFrame:
    """The table, to be sent to all executors if its rows and their arrays are small; else its join is an exchange."""
    row = F.lit(48) + (8 * F.size(array) if array else F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows has keys and ``bag`` (array of hashes): keys and ``print``, the signs of the bits' sums over the bag."""
    bit = lambda i: F.shiftright(F.col("h"), i).bitwiseAND(F.lit(1)) if i < 64 else F.lit(0)
    lanes = [(bit(j) + F.shiftleft(bit(j + LANES).cast("long"), LANE_BITS) + F.shiftleft(bit(j + 2 * LANES).cast("long"), 2 * LANE_BITS)).alias(f"lane{j}") for j in range(LANES)]
    each = rows.select(*keys, F.explode("bag").alias("h")).select(*keys, *lanes)
    sums = each.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f"lane{j}").alias(f"lane{j}") for j in range(LANES)])
    ones = lambda i: F.shiftright(F.col(f"lane{i % LANES}"), LANE_BITS * (i // LANES)).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
    value = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft((2 * ones(i) > F.col("n")).cast("long"), i) for i in range(64)])
    return sums.select(*keys, value.alias("print"))


def masks(radius: int) -> list[int]:
    """All values of a block with up to so many bits set."""
    return [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(BLOCK_BITS), n)]


def block_of(value: Column, i: int) -> Column:
    return F.shiftright(value, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def in_blocks(df: DataFrame) -> DataFrame:
    return df.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("block"), block_of(F.col("print"), i).alias("bits")) for i in range(BLOCKS)])))


def near_blocks(df: DataFrame, radius: int) -> DataFrame:
    """Rows of every value that a block may have within its part of the radius."""
    return in_blocks(df).withColumn("mask", F.explode(F.lit(masks(radius // BLOCKS)))).withColumn("bits", F.col("bits").bitwiseXOR(F.col("mask"))).drop("mask")


def first_block(a: Column, b: Column, radius: int) -> Column:
    near = [F.when(F.bit_count(block_of(a.bitwiseXOR(b), i)) <= radius // BLOCKS, i) for i in range(BLOCKS)]
    return F.coalesce(*near)


def bag_similarity(a: Column, b: Column) -> Column:
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def contaminated(docs: DataFrame, items: DataFrame, *, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found there: doc_id, k1, k2, item_id, similarity, and the best (then first) window's start in words and length."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontam")
    docs = keyed(docs, id_col, text_col)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("w")).filter("size(w) > 0")
    items = ws.keep(items.select("item_id", F.size("w").alias("size"), F.least(F.size("w"), F.lit(k)).alias("k"), "w"), "items")
    found = []
    for kk in sorted(r["k"] for r in items.select("k").distinct().collect()):
        own = items.filter(F.col("k") == kk).select("item_id", "size", shingles(F.col("w"), kk).alias("bag"))
        own = ws.keep(own, f"bags-{kk}")
        sizes = own.select(F.explode("bag").alias("h"), "size").groupBy("h").agg(F.collect_set("size").alias("sizes"))
        places = docs.select(*KEY, F.posexplode(shingles(words(F.col("text")), kk)).alias("at", "h")).join(bounded(sizes, "sizes"), "h")
        places = places.select(*KEY, "at", F.explode("sizes").alias("size"))
        places = places.groupBy(*KEY, "size").agg(F.collect_set("at").alias("ats")).groupBy(*KEY).agg(F.collect_list(F.struct("size", "ats")).alias("near"))
        places = ws.keep(places, f"places-{kk}")
        texts = docs.join(bounded(places.select(*KEY)), KEY, "left_semi").dropDuplicates(KEY)
        bags = texts.join(places, KEY).select(*KEY, "doc_id", "near", words(F.col("text")).alias("w"))
        bags = ws.keep(bags.select(*KEY, "doc_id", "near", F.size("w").alias("n"), shingles(F.col("w"), kk).alias("sh")), f"matched-{kk}")

        # every window of the size that holds a shared shingle: starts from the shingle's place back; of a shorter text, the whole (a slice ends with it)
        starts = lambda x: F.array_distinct(F.flatten(F.transform(x["ats"], lambda at: F.sequence(F.greatest(F.lit(0), at - (x["size"] - kk)), F.greatest(F.lit(0), F.least(at, F.col("n") - x["size"]))))))
        cut = lambda start, size: F.slice("sh", start + 1, size - (kk - 1))
        at = F.flatten(F.transform("near", lambda x: F.transform(starts(x), lambda s: F.struct(x["size"].alias("size"), s.alias("start"), cut(s, x["size"]).alias("bag")))))
        windows = in_blocks(simhash(bags.select(*KEY, F.inline(at)), [*KEY, "size", "start"]))
        prints = ws.keep(near_blocks(simhash(own, ["item_id", "size"]), radius).withColumnRenamed("print", "item_print"), f"prints-{kk}")
        near = windows.join(bounded(prints), ["size", "block", "bits"])
        near = near.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).filter(first_block(F.col("print"), F.col("item_print"), radius) == F.col("block"))
        # a document's array is read once for all of its windows, and only the windows go on to the items
        near = ws.keep(near.groupBy(*KEY).agg(F.collect_list(F.struct("item_id", "size", "start")).alias("hits")), f"near-{kk}")
        pairs = near.join(bags.select(*KEY, "doc_id", "n", "sh"), KEY)
        pairs = pairs.select(*KEY, "doc_id", F.inline(F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), F.least(x["size"], F.col("n")).alias("size"), x["start"].alias("start"), cut(x["start"], F.least(x["size"], F.col("n"))).alias("window")))))
        pairs = pairs.join(bounded(own.select("item_id", "bag"), "bag"), "item_id").select(*KEY, "doc_id", "item_id", "size", "start", bag_similarity(F.col("window"), F.col("bag")).alias("similarity"))
        found.append(pairs.filter(F.col("similarity") >= similarity))
    if not found:
        return spark.createDataFrame([], "doc_id long, k1 long, k2 long, item_id long, similarity double, start long, words long")
    best = reduce(DataFrame.union, found).groupBy(*KEY, "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("best"))
    return best.select("doc_id", *KEY, "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start"), F.col("best.size").cast("long").alias("words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents, all columns, without those that hold an item."""
    out, key = with_key(docs, id_col, text_col)
    hit = contaminated(docs, items, id_col=id_col, text_col=text_col, **settings).select(*[F.col(k).alias(n) for k, n in zip(KEY, key, strict=True)]).distinct()
    return out.join(hit, key, "left_anti").drop(*key)
