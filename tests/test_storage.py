import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelake.operators.cache import LookupCache
from sievelake.operators.publish import Publication, unique_names
from sievelake.sources.partitions import SourceError, announced, announced_records, verified

DATA = "/root/testdata/sf0.001"


def land(spark, folder, files=4):
    """The customers of a given table as announced partitions: plain, zipped and gzipped files, and their manifest."""
    rows = [json.loads(r) for r in spark.read.parquet(f"{DATA}/customer.parquet").orderBy("c_custkey").toJSON().collect()]
    parts, size = [], -(-len(rows) // files)
    for i in range(files):
        own = rows[i * size : (i + 1) * size]
        body = json.dumps({"meta": {"license": "x", "results": {"total": len(own), "limit": len(own), "skip": 0}}, "results": own}).encode()
        name = f"part{i}.json" + ("", ".zip", ".gz")[i % 3]
        if name.endswith(".zip"):
            with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("part.json", body)
        else:
            (folder / name).write_bytes(gzip.compress(body) if name.endswith(".gz") else body)
        parts.append({"file": name, "records": len(own)})
    write(folder, parts, len(rows))
    return rows, parts


def write(folder, parts, total):
    (folder / "manifest.json").write_text(json.dumps({"total_records": total, "partitions": parts}))


def failing(run, code):
    with pytest.raises(Exception, match=code):
        run()


def test_partitions_are_read_by_tasks(spark, tmp_path):
    rows, parts = land(spark, tmp_path)
    manifest = f"{tmp_path}/manifest.json"
    df = announced_records(spark, manifest)
    assert df.rdd.getNumPartitions() == 4
    got = verified(df, manifest).collect()
    assert sorted(json.dumps(json.loads(r.record), sort_keys=True) for r in got) == sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert all(r.locator == f"{r.file}#results[{r['index']}]" and len(r.file_digest) == 64 for r in got)
    first = announced_records(spark, manifest, limit=parts[0]["records"] + 3)
    assert first.rdd.getNumPartitions() == 2 and first.count() == parts[0]["records"] + 3 and announced_records(spark, manifest, limit=0).count() == 0


def test_a_wrong_source_fails_with_a_code(spark, tmp_path):
    rows, parts = land(spark, tmp_path)
    manifest = f"file://{tmp_path}/manifest.json"
    write(tmp_path, parts, len(rows) + 1)
    with pytest.raises(SourceError, match="incomplete_ingestion"):
        announced(manifest)
    write(tmp_path, [parts[0], *parts[2:], parts[0]], len(rows))
    failing(lambda: announced(manifest), "incomplete_ingestion")
    write(tmp_path, [{"file": "part0.json", "records": True}], 1)
    failing(lambda: announced(manifest), "malformed_manifest")
    write(tmp_path, [{**parts[0], "records": parts[0]["records"] + 1}, *parts[1:]], len(rows) + 1)
    failing(lambda: announced_records(spark, manifest).collect(), "incomplete_ingestion")
    write(tmp_path, parts, len(rows))
    (tmp_path / "part0.json").write_text('{"meta": ')
    failing(lambda: announced_records(spark, manifest).collect(), "malformed_source")
    (tmp_path / "part0.json").unlink()
    failing(lambda: announced_records(spark, manifest).collect(), "unreadable_source")
    with zipfile.ZipFile(tmp_path / "part1.json.zip", "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b.json", "{}")
    write(tmp_path, parts[1:2], parts[1]["records"])
    failing(lambda: announced_records(spark, manifest).collect(), "unexpected_member")


def test_one_retry_a_partition(tmp_path, monkeypatch):
    from sievelake.sources import partitions as P

    calls = []
    (tmp_path / "a.json").write_text(json.dumps({"meta": {"results": {"total": 1, "limit": 1, "skip": 0}}, "results": [{}]}))
    write(tmp_path, [{"file": "a.json", "records": 1}], 1)
    real = P.read_bytes

    def flaky(path):
        calls.append(path)
        if path.endswith("a.json") and len(calls) < 3:
            raise OSError("lost")
        return real(path)

    monkeypatch.setattr(P, "read_bytes", flaky)
    reader = P.PartitionReader({"manifest": f"{tmp_path}/manifest.json", "retryseconds": "0"})
    (part,) = reader.partitions()
    assert [r[3] for r in reader.read(part)] == ["{}"] and len(calls) == 3  # the manifest, the file, the file again
    monkeypatch.setattr(P, "read_bytes", lambda path: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(SourceError, match="unreadable_source"):
        list(reader.read(part))


def test_files_that_disagree(spark, tmp_path):
    rows, parts = land(spark, tmp_path, files=2)
    body = json.loads((tmp_path / "part0.json").read_text())
    body["meta"]["license"] = "y"
    (tmp_path / "part0.json").write_text(json.dumps(body))
    manifest = f"{tmp_path}/manifest.json"
    failing(lambda: verified(announced_records(spark, manifest), manifest).collect(), "inconsistent_meta")
    failing(lambda: verified(announced_records(spark, manifest, limit=5), manifest).collect(), "incomplete_ingestion")


def versions(spark):
    return [spark.createDataFrame([(f"{i}", v) for i in range(5)], "pmid string, x string") for v in "ab"]


@pytest.mark.parametrize("step", ["stage", "verify", "mark", "swap", "load_content"])
@pytest.mark.parametrize("crash", [True, False])
def test_publication_survives_a_stop_at_every_step(spark, tmp_path, step, crash):
    old, new = versions(spark)
    path = f"file://{tmp_path}/p"
    p = Publication(spark, path, "pmid string, x string", ["pmid"])
    first = p.publish(old)
    assert p.load().select("x").distinct().collect()[0].x == "a"

    class Stop(BaseException if crash else Exception):
        pass

    q = Publication(spark, path, "pmid string, x string", ["pmid"])
    real, after = getattr(q, step), {"stage", "mark", "swap"}

    def stopping(*args):
        if step == "load_content" and args[0] == first:  # only what is asked of the new generation
            return real(*args)
        if step in after:
            real(*args)  # the step is done when the process dies
        raise Stop

    setattr(q, step, stopping)
    with pytest.raises(Stop):
        q.publish(new)  # BaseException passes the rollback by, as a crash would
    r = Publication(spark, path, "pmid string, x string", ["pmid"])
    swapped = crash and step in ("swap", "load_content")
    assert r.load().select("x").distinct().collect()[0].x == ("b" if swapped else "a")  # never nothing, never half
    r.recover()
    assert r.current() == (r.generations()[-1] if swapped else first) and len(r.generations()) == 1 + swapped
    r.publish(new)
    assert r.load().select("x").distinct().collect()[0].x == "b" and len(r.generations()) == 2


def test_publication_refuses_and_goes_back(spark, tmp_path):
    old, new = versions(spark)
    p = Publication(spark, f"file://{tmp_path}/p", "pmid string, x string", ["pmid"], keep=2)
    with pytest.raises(ValueError, match="incomplete_generation"):
        p.load()
    first = p.publish(old)
    with pytest.raises(ValueError, match="duplicate_key"):
        p.publish(new.union(new))
    assert p.current() == first and p.generations() == [first]
    second = p.publish(new)
    (tmp_path / "p/generations" / second / "_COMPLETE.json").write_text("{")
    (tmp_path / "p/generations" / second / "._COMPLETE.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="incomplete_generation"):
        p.load()
    assert p.recover() == [second] and p.current() == first and p.load().count() == 5


def test_names_collide(spark):
    rows = [("A b", "2024-01-02"), ("a  B!", "2024-01-01"), ("a-b", "2024-01-02"), ("other", "2024-01-01"), ("A b", "2024-01-02")]
    got = sorted((r.t, r.name) for r in unique_names(spark.createDataFrame(rows, "t string, day string"), "t", "day").collect())
    assert got == [("A b", "a_b_20240102"), ("A b", "a_b_20240102_2"), ("a  B!", "a_b"), ("a-b", "a_b_20240102_3"), ("other", "other")]


def test_cache_looks_up_once(spark, tmp_path):
    vocabulary = spark.createDataFrame([("red ring", "1", "ATC"), ("red ring", "2", "X"), ("blue bolt", "3", "ATC")], "label string, code string, source string")
    asked = []

    def ask(missing):
        asked.append(sorted(r.term for r in missing.collect()))
        return missing.join(vocabulary, missing.term == vocabulary.label).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("code", "source"))).alias("found"))

    rows = spark.createDataFrame([(1, "Red  ring"), (2, "red ring "), (3, "nothing"), (4, None), (5, " ")], "k int, t string").withColumn("key", F.lit("mine"))
    cache = LookupCache(spark, f"file://{tmp_path}/c", "struct<code:string,source:string>")
    got, n = cache.lookup(rows, "t", ask)
    by = {r.k: r.found and [x.code for x in r.found] for r in got.collect()}
    assert by == {1: ["1", "2"], 2: ["1", "2"], 3: [], 4: None, 5: None} and n == 2 and asked == [["nothing", "red ring"]] and got.columns == ["k", "t", "key", "found"]
    again, n = cache.lookup(rows, "t", ask, keep=lambda x: x["source"] == "ATC")
    assert n == 0 and asked[-1] == [] and {r.k: r.found and [x.code for x in r.found] for r in again.collect()}[1] == ["1"]
    more, n = cache.lookup(rows.union(rows.select(F.lit(6), F.lit("BLUE bolt"), F.lit(""))), "t", ask)
    assert n == 1 and asked[-1] == ["blue bolt"] and {r.k: len(r.found or []) for r in more.collect()}[6] == 1
    none, n = cache.lookup(rows.filter("false"), "t", ask)
    assert n == 0 and none.count() == 0
