"""Helpers that the operators of this package share: tables, the shared folder, row keys, units of text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent to all executors only if so many bytes bound it.
BROADCAST_BYTES = 32 << 20
#: What a row is known by: 128 bits of its id and text, as two longs.
KEY = ["k1", "k2"]
#: After one of these and before a blank a line is cut into pieces.
STOPS = ".!?;:,"
_MARK = "\x01"


#: Operators read whole columns in order, so vectored reads save nothing here, and on file systems without a native form of
#: them every reading thread keeps direct buffers of the size of a column chunk, outside the heap.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}
#: Rows of texts in an Arrow batch (10,000 by default: tens of MB on both sides of the pipe).
BATCH_ROWS = "1024"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READ).parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, but where the session has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in tests on one machine, a folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    They cut the lineage: a lost executor costs the recomputation of unfinished tasks only. A table that no later
    step reads is dropped by the operator; the folder goes when the session's file system closes, as the results
    that an operator returns are still to be computed from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/sievelake/{name}-{uuid.uuid4().hex}"
        path = self._path("")
        self._files(path).mkdirs(path)
        self._files(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.options(**READ).schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            path = self._path(name)
            self._files(path).delete(path, True)


def give_back() -> None:
    """Returns what a task has freed to the system: workers are used again, and their allocators hold on to it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A name that none of the columns has, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key_of(doc_id: Column, text: Column) -> tuple[Column, Column]:
    known = F.coalesce(doc_id, F.lit(-1))
    return F.xxhash64(known, doc_id.isNull(), text), F.xxhash64(F.lit(0x5851F42D4C957F2D), text, doc_id.isNull(), known)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty), and the key that tells rows of equal ids but different texts apart."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return docs.select("*", *[k.alias(name) for name, k in zip(KEY, key_of(F.col("doc_id"), F.col("text")), strict=True)])


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """The documents, all columns, with their key under names that are free."""
    found = key_of(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    names = [fresh(docs, f"__{k}") for k in KEY]
    return docs.withColumns(dict(zip(names, found, strict=True))), names


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def first_id() -> Column:
    """Orders by document id, rows without one last."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not in every step that uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def pieces(text: Column) -> Column:
    """A text cut behind line feeds, and in a line where a stop stands before a blank; end to end they are the text."""
    marked = F.replace(text, F.lit("\n"), F.lit("\n" + _MARK))
    for stop in STOPS:
        marked = F.replace(marked, F.lit(stop + " "), F.lit(stop + _MARK + " "))
    return F.when(text.contains(_MARK), F.split(text, rf"(?<=\n)|(?<=[{STOPS}])(?= )", -1)).otherwise(F.split(marked, _MARK, -1))


def normal_pieces(text: Column) -> Column:
    """The pieces as they are compared: lower case, white space runs to one space, trimmed; as many as ``pieces`` gives."""
    odd = text.startswith(" ") | text.endswith(" ")
    for sign in ("  ", " \n", "\n ", "\t", "\r", "\f", "\x0b"):
        odd = odd | text.contains(sign)
    # elsewhere a cut takes the line feed or the blank with it, and nothing is left to be trimmed
    plain = F.split(F.lower(text), rf"[\n ](?<=\n|[{STOPS}] )", -1)
    return F.when(odd, F.transform(pieces(F.lower(text)), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))).otherwise(plain)


def word_count(normal: Column) -> Column:
    return F.char_length(normal) - F.char_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1


def without(cut: Column, gone: Column) -> Column:
    """The pieces but for those of the numbers ``gone``, end to end; where a line's end goes with them, two lines stay two."""

    def before(p, kept, k, i):
        last = F.get(kept, k - 1)
        between = F.slice(p, last + 2, i - last - 1)
        parted = (k > 0) & (last < i - 1) & ~F.endswith(F.get(p, last), F.lit("\n")) & F.exists(between, lambda x: F.endswith(x, F.lit("\n")))
        return F.when(parted, F.concat(F.lit("\n"), F.get(p, i))).otherwise(F.get(p, i))

    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone)
    return let(cut, lambda p: let(stay(p), lambda kept: F.array_join(F.transform(kept, lambda i, k: before(p, kept, k, i)), "")))
