"""A source of bulk partitions that a manifest announces (S13, S15, S22, S24), as a Python ``DataSource``.

A manifest is a JSON object: ``total_records`` and ``partitions``, each with a ``file`` (beside the manifest, or a full path) and its number of ``records``. A partition is a
JSON document {meta, results}, plain, gzipped, or the one member of a ZIP archive. The manifest is checked when a read is planned; each file
is one Spark partition, read by the task that gets it, so nothing but the manifest passes the driver.

Counts are checked on every level: files against the manifest's total when planning, the results and the numbers in ``meta`` of each file
against its entry in the task, and all rows against the total by ``verified``, a guard inside the plan. A file that can't be read or parsed is tried
once more; then the task fails with a code. ``spark.task.maxFailures`` applies on top of it, as for any task.

    spark.dataSource.register(Partitions)
    spark.read.format("announced").option("manifest", path).load()      # file, index, locator, record (JSON text), file_digest, meta

``limit`` (an option) reads only as many files as are needed and no more rows of the last; it is exact, and counts of files that are not
read in full are still checked.

Defined results: an empty results list gives no rows; a repeated file, a wrong sum, a file that isn't one document, more members, encrypted, linked or
too dense archives are errors; keys of records that clash are kept as the text has them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import time
import zipfile
from dataclasses import dataclass
from posixpath import dirname, join

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievelake.operators.guards import counted, holds

SCHEMA = "file string, index long, locator string, record string, file_digest string, meta string"
#: Bounds of one file (fixed values): bytes as landed, bytes of its JSON, how much denser an archive may be.
MOST_LANDED, MOST_JSON, MOST_RATIO = 40_000_000, 200_000_000, 100


class SourceError(ValueError):
    """``code`` says what is wrong with a source."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


@dataclass
class Announced(InputPartition):
    file: str
    records: int
    take: int


def read_bytes(path: str) -> bytes:
    """A landed file, by a path that every executor can open; ``file:`` may lead it."""
    with open(path.removeprefix("file://"), "rb") as f:
        raw = f.read(MOST_LANDED + 1)
    if len(raw) > MOST_LANDED:
        raise SourceError("file_too_large", path)
    return raw


def document(raw: bytes, path: str) -> dict:
    """The JSON object of a landed file."""
    if raw[:2] == b"PK":
        raw = single_member(raw, path)
    elif raw[:2] == b"\x1f\x8b":
        with gzip.open(io.BytesIO(raw)) as g:
            raw = g.read(MOST_JSON + 1)
    if len(raw) > MOST_JSON:
        raise SourceError("document_too_large", path)
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise SourceError("malformed_source", path) from e
    if not isinstance(found, dict):
        raise SourceError("malformed_source", path)
    return found


def single_member(raw: bytes, path: str) -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            inside = z.infolist()
            if len(inside) != 1 or inside[0].is_dir() or not inside[0].filename.endswith(".json"):
                raise SourceError("unexpected_member", path)
            m = inside[0]
            if m.flag_bits & 1 or (m.external_attr >> 16) & 0o170000 == 0o120000 or m.file_size > min(MOST_JSON, MOST_RATIO * max(1, m.compress_size)):
                raise SourceError("unsafe_member", path)
            return z.read(m)
    except zipfile.BadZipFile as e:
        raise SourceError("malformed_zip", path) from e


def whole_number(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def announced(manifest: str) -> tuple[int, list[Announced]]:
    """The total and the files of a manifest whose numbers agree."""
    said = document(read_bytes(manifest), manifest)
    total, parts = said.get("total_records"), said.get("partitions")
    if not whole_number(total) or not isinstance(parts, list) or not parts:
        raise SourceError("malformed_manifest", manifest)
    if not all(isinstance(p, dict) and whole_number(p.get("records")) and isinstance(p.get("file"), str) for p in parts):
        raise SourceError("malformed_manifest", manifest)
    if sum(p["records"] for p in parts) != total or len({p["file"] for p in parts}) < len(parts):
        raise SourceError("incomplete_ingestion", manifest)
    where = dirname(manifest.removeprefix("file://"))
    return total, [Announced(join(where, p["file"].removeprefix("file://")), p["records"], p["records"]) for p in parts]


class PartitionReader(DataSourceReader):
    def __init__(self, options: dict):
        if "manifest" not in options:
            raise SourceError("malformed_manifest", "the option manifest is missing")
        self.manifest, self.limit, self.wait = options["manifest"], options.get("limit"), float(options.get("retryseconds", options.get("retrySeconds", 0.5)))

    def partitions(self):
        _, files = announced(self.manifest)
        if self.limit is None:
            return files
        left, chosen = int(self.limit), []
        for f in files:
            if left > 0:
                chosen.append(Announced(f.file, f.records, min(left, f.records)))
                left -= f.records
        return chosen or [Announced(files[0].file, files[0].records, 0)]

    def read(self, partition: Announced):
        raw, body = self._tried(partition.file)
        results, meta = body.get("results"), body.get("meta")
        if not isinstance(results, list) or not isinstance(meta, dict):
            raise SourceError("malformed_source", partition.file)
        numbers = meta.get("results")
        if len(results) != partition.records or not isinstance(numbers, dict) or (numbers.get("total"), numbers.get("limit"), numbers.get("skip")) != (len(results), len(results), 0):
            raise SourceError("incomplete_ingestion", partition.file)
        digest = hashlib.sha256(raw).hexdigest()
        about = json.dumps({k: v for k, v in meta.items() if k != "results"}, sort_keys=True, ensure_ascii=False)
        for i, record in enumerate(results[: partition.take]):
            yield partition.file, i, f"{partition.file}#results[{i}]", json.dumps(record, ensure_ascii=False), digest, about

    def _tried(self, path: str):
        for last in (False, True):
            try:
                raw = read_bytes(path)
                return raw, document(raw, path)
            except (OSError, SourceError) as e:
                if last:
                    raise e if isinstance(e, SourceError) else SourceError("unreadable_source", path) from e
                time.sleep(self.wait)


class Partitions(DataSource):
    @classmethod
    def name(cls):
        return "announced"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PartitionReader(self.options)


def announced_records(spark: SparkSession, manifest: str, limit: int | None = None) -> DataFrame:
    """The records that a manifest announces."""
    spark.dataSource.register(Partitions)
    reader = spark.read.format("announced").option("manifest", manifest)
    return (reader if limit is None else reader.option("limit", str(limit))).load()


def verified(records: DataFrame, manifest: str) -> DataFrame:
    """The records, in a plan that fails unless there are as many as the manifest says and all files say the same of themselves."""
    total, _ = announced(manifest)
    declared = records.sparkSession.range(1).select(F.lit(total))
    several = records.agg(F.countDistinct("meta").alias("n"))  # one row
    wrong = several.filter(~holds(F.col("n") <= 1, "inconsistent_meta", F.col("n")))  # no row, or the job fails
    return counted(records, declared, "incomplete_ingestion").union(wrong.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema]))
