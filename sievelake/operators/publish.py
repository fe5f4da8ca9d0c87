"""Sinks and reports of the rows that were selected (K1-K9, section 2.17): published whole or not at all.

``Publication`` keeps generations of a table below one folder, of which one is current (K8, S18):

    generations/<id>/...            rows, and last of all _COMPLETE.json: rows, different keys, a digest of the content
    CURRENT                         the id of the generation that readers get

A generation is staged, read back and compared with what was written, marked, and then made current by one rename of the pointer. Whatever
step a crash interrupts, readers get the generation before, and ``recover`` removes what was left; a pointer to something that isn't a whole
generation goes back to the last whole one. One writer at a time is assumed. On stores without an atomic rename the pointer is a
window as short as its copy.
"""

from __future__ import annotations

import hashlib
import html
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievelake.functions.text import slug
from sievelake.operators.trees import fresh

MARKER = "_COMPLETE.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, keys: Sequence[str]) -> str:
    """K8: writes a new generation and, last, a marker with its row count and a digest of its content.

    The digest is a sum of row digests, so it needs no order and no exchange. An existing generation is never overwritten; one without
    a marker isn't valid and may be removed.
    """
    df.write.mode("errorifexists").json(path)
    spark = df.sparkSession
    manifest = json.dumps(content(spark.read.schema(df.schema).json(path), keys), sort_keys=True)
    fs, p = _fs(spark, f"{path}/{MARKER}")
    out = fs.create(p, False)
    out.write(bytearray(manifest.encode()))
    out.close()
    return manifest


def content(df: DataFrame, keys: Sequence[str]) -> dict:
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("rows"), F.countDistinct(*keys).alias("keys"), F.coalesce(F.sum(part), F.lit(0)).alias("sum")).first()
    return {"rows": r["rows"], "keys": r["keys"], "digest": hashlib.sha256(str(r["sum"]).encode()).hexdigest()}


def load_published(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """A generation whose marker agrees with its rows; anything else is an error."""
    fs, p = _fs(spark, f"{path}/{MARKER}")
    if not fs.exists(p):
        raise ValueError("incomplete_generation")
    said = _read(fs, p)
    df = spark.read.schema(schema).json(path)
    if content(df, keys) != said:
        raise ValueError("digest_mismatch")
    return df


def _read(fs, p) -> dict:
    stream = fs.open(p)
    try:
        raw = bytes(b & 255 for b in stream.readAllBytes())
    finally:
        stream.close()
    return json.loads(raw)


class Publication:
    """Generations of a table below ``root``; ``keep`` of the former ones stay."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], keep: int = 1):
        self.spark, self.root, self.schema, self.keys, self.kept = spark, root.rstrip("/"), schema, list(keys), keep

    # the steps, in the order that they are taken

    def stage(self, df: DataFrame, name: str) -> int:
        """Writes the rows and counts them in flight."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").json(self.folder(name))
        return seen.get["rows"]

    def verify(self, name: str, rows: int) -> dict:
        """Reads a staged generation back: as many rows as were written, and no key twice."""
        found = content(self.rows(name), self.keys)
        if found["rows"] != rows:
            raise ValueError("row_mismatch")
        if found["keys"] != rows:
            raise ValueError("duplicate_key")
        return found

    def mark(self, name: str, found: dict) -> None:
        self.write(f"{self.folder(name)}/{MARKER}", json.dumps(found, sort_keys=True))

    def swap(self, name: str) -> None:
        """Makes a whole generation the current one: the pointer is written beside its place and renamed over it."""
        self.write(f"{self.root}/CURRENT.new", name)
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        new, old = (_fs(self.spark, f"{self.root}/{n}")[1] for n in ("CURRENT.new", "CURRENT"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(new, old, options)

    def publish(self, df: DataFrame) -> str:
        """A new generation, current when this returns; on any failure the one before stays and nothing of the new one is left."""
        self.recover()
        name, before = f"g{time.time_ns():020d}", self.current()
        try:
            self.mark(name, self.verify(name, self.stage(df, name)))
            self.swap(name)
            if self.load_content(name) is None:
                raise ValueError("incomplete_generation")
        except Exception:
            self.roll_back(name, before)
            raise
        self.recover()
        return name

    def roll_back(self, name: str, before: str | None) -> None:
        if self.current() == name:
            self.swap(before) if before else self.delete(f"{self.root}/CURRENT")
        self.delete(self.folder(name))

    # what is there

    def folder(self, name: str) -> str:
        return f"{self.root}/generations/{name}"

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.folder(name))

    def current(self) -> str | None:
        fs, p = _fs(self.spark, f"{self.root}/CURRENT")
        return _text(fs, p) if fs.exists(p) else None

    def generations(self) -> list[str]:
        fs, p = _fs(self.spark, f"{self.root}/generations")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def load_content(self, name: str) -> dict | None:
        """What a generation's marker says, or None where it isn't whole."""
        fs, p = _fs(self.spark, f"{self.folder(name)}/{MARKER}")
        try:
            return json.loads(_text(fs, p)) if fs.exists(p) else None
        except ValueError:
            return None

    def load(self) -> DataFrame:
        """The current generation, if its rows are those of its marker."""
        name = self.current()
        said = self.load_content(name) if name else None
        if said is None:
            raise ValueError("incomplete_generation")
        if content(self.rows(name), self.keys) != said:
            raise ValueError("digest_mismatch")
        return self.rows(name)

    def recover(self) -> list[str]:
        """Puts right what an interrupted publication left, and returns what was removed."""
        whole = [g for g in self.generations() if self.load_content(g) is not None]
        now = self.current()
        if now is not None and now not in whole:
            self.swap(whole[-1]) if whole else self.delete(f"{self.root}/CURRENT")
            now = whole[-1] if whole else None
        older = [g for g in whole if now is not None and g < now]
        stay = {now, *older[len(older) - self.kept :]} if self.kept else {now}
        gone = [g for g in self.generations() if g not in stay]
        for g in gone:
            self.delete(self.folder(g))
        self.delete(f"{self.root}/CURRENT.new")
        return gone

    def write(self, path: str, text: str) -> None:
        fs, p = _fs(self.spark, path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()

    def delete(self, path: str) -> None:
        fs, p = _fs(self.spark, path)
        fs.delete(p, True)


def _text(fs, p) -> str:
    stream = fs.open(p)
    try:
        return bytes(b & 255 for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def unique_names(rows: DataFrame, text: str, stamp: str, name: str = "name") -> DataFrame:
    """K6: a file name for each row: the slug of its text; of rows with one slug the first by ``stamp`` has it as it is, the others add their stamp (and their
    place where that repeats too)."""
    slugs = rows.withColumn(name, slug(F.col(text)))
    order = [F.col(stamp), F.col(text)]
    at, again = F.row_number().over(Window.partitionBy(name).orderBy(*order)), F.row_number().over(Window.partitionBy(name, stamp).orderBy(*order))
    first, mark = fresh(slugs, "first"), fresh(slugs, "again")
    slugs = slugs.withColumns({first: at, mark: again})
    with_stamp = F.concat_ws("_", name, F.regexp_replace(F.col(stamp).cast("string"), "[^0-9A-Za-z]+", ""))
    shown = F.when(F.col(first) == 1, F.col(name)).when(F.col(mark) == 1, with_stamp).otherwise(F.concat_ws("_", with_stamp, F.col(mark).cast("string")))
    return slugs.withColumn(name, shown).drop(first, mark)


def markdown_table(rows: Sequence[dict], columns: Sequence[str]) -> str:
    """A report's rows as Markdown; the rows are few by then, and every cell is escaped."""
    cell = lambda v: html.escape("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def html_table(rows: Sequence[dict], columns: Sequence[str], title: str) -> str:
    cell = lambda v: html.escape("" if v is None else str(v))
    body = "".join("<tr>" + "".join(f"<td>{cell(r.get(c))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1><table><tr>{''.join(f'<th>{cell(c)}</th>' for c in columns)}</tr>{body}</table></body></html>"
