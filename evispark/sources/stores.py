"""Sinks: an append-only ledger, rebuilt tables, bundles and archives."""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def _newest(spark: SparkSession, folder: str) -> int:
    """The largest number among the pointers in a folder, 0 for none; a pointer that is still empty is being written."""
    fs, where, _ = _files(spark, folder)
    return max([int(s.getPath().getName()) for s in fs.listStatus(where) if s.getLen()], default=0) if fs.exists(where) else 0


def _publish(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """Write a pointer under a number that nobody has taken; pointers are never overwritten.

    The file is created only where none is, which HDFS and local disks decide
    for one writer; a store without exclusive creation cannot hold a ledger.
    """
    fs, _, path = _files(spark, folder)
    try:
        out = fs.create(path(f"{folder}/{number}"), False)
    except Py4JJavaError as error:
        raise RuntimeError("another writer took the number") from error
    out.write(bytearray(text.encode()))
    out.close()


def revision(spark: SparkSession, ledger: str) -> int:
    """The newest revision of a ledger, 0 for none."""
    return _newest(spark, f"{ledger}/heads")


def read_ledger(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """All records of the committed revisions, in one scan; files of a commit that never ended are not read."""
    newest = revision(spark, ledger)
    if not newest:
        return spark.createDataFrame([], f"{schema}, revision int")
    heads = spark.read.option("wholetext", True).text(f"{ledger}/heads").select(F.col("value").alias("part"), F.regexp_extract("_metadata.file_path", r"(\d+)$", 1).cast("int").alias("revision")).where("part <> ''")
    names = [r.part for r in heads.select("part").collect()]  # one short name per commit
    part = F.regexp_extract("_metadata.file_path", r"(part-[0-9a-f]{32})/", 1)
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    held = spark.read.schema(schema).parquet(*[f"{ledger}/{n}" for n in names]).select(*columns, part.alias("part"))
    return held.join(F.broadcast(heads), "part").select(*columns, "revision")  # as many rows as commits


def commit(records: DataFrame, ledger: str, expected: int) -> int:
    """Append (identity, payload_hash, ...) if the ledger stands at ``expected``; the new revision.

    Identities that are there with the same hash are left out; with another
    hash they are a collision.  Two writers cannot both take a revision, see
    ``_publish``.
    """
    spark = records.sparkSession
    if revision(spark, ledger) != expected:
        raise RuntimeError("the ledger has moved on")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    known = read_ledger(spark, ledger, schema).select("identity", F.col("payload_hash").alias("known_hash"))
    clash = records.join(known, "identity").where("payload_hash <> known_hash")
    twice = records.groupBy("identity").agg(F.count_distinct("payload_hash").alias("n")).where("n > 1")
    if clash.limit(1).count() or twice.limit(1).count():
        raise ValueError("an identity stands for two contents")
    name = f"part-{uuid.uuid4().hex}"
    records.dropDuplicates(["identity"]).join(known, "identity", "left_anti").write.parquet(f"{ledger}/{name}")
    _publish(spark, f"{ledger}/heads", expected + 1, name)
    return expected + 1


def rebuild(table: DataFrame, store: str) -> str:
    """Write a derived table beside its older versions and point to it last; the new path.

    Pointers are numbered and none is overwritten, so a reader finds a whole
    version at any moment.
    """
    spark = table.sparkSession
    path = f"{store}/version-{uuid.uuid4().hex}"
    table.write.parquet(path)
    _publish(spark, f"{store}/current", _newest(spark, f"{store}/current") + 1, path)
    return path


def current(spark: SparkSession, store: str) -> DataFrame:
    """The version a store points to."""
    return spark.read.parquet(spark.read.option("wholetext", True).text(f"{store}/current/{_newest(spark, f'{store}/current')}").first().value)


def _entry(name: str) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


def bundle(records: DataFrame, path: str) -> str:
    """A zip of canonical.json (one record a line, by identity) and manifest.json; its content identity.

    Rows stream through the driver into the file, one partition at a time.
    """
    digest, n = hashlib.sha256(), 0
    with zipfile.ZipFile(path, "w") as out:
        with out.open(_entry("canonical.json"), "w", force_zip64=True) as lines:
            for row in records.orderBy("identity").toLocalIterator():
                line = json.dumps(row.asDict(True), sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode() + b"\n"
                digest.update(line)
                lines.write(line)
                n += 1
        identity = f"sha256:{digest.hexdigest()}"
        out.writestr(_entry("manifest.json"), json.dumps({"identity": identity, "records": n}, sort_keys=True))
    return identity


def _digest(held: zipfile.ZipFile, name: str) -> str:
    """The hash of an entry, read in pieces."""
    with held.open(name) as entry:
        return hashlib.file_digest(entry, "sha256").hexdigest()


def verify_bundle(path: str) -> bool:
    """Whether a bundle's content has the identity its manifest states."""
    with zipfile.ZipFile(path) as held:
        return json.loads(held.read("manifest.json"))["identity"] == f"sha256:{_digest(held, 'canonical.json')}"


def archive(files: DataFrame, path: str) -> None:
    """A zip of captured files (path, content, sha256), each content once, with a manifest of their hashes.

    Contents stream through the driver one partition at a time, unsorted; only
    paths and hashes are sorted, and stream into the manifest.
    """
    written: set[str] = set()
    with zipfile.ZipFile(path, "w") as out:
        for row in files.select("content", "sha256").toLocalIterator():
            if row.sha256 not in written:
                written.add(row.sha256)
                out.writestr(_entry(f"files/{row.sha256}"), bytes(row.content))
        with out.open(_entry("manifest.json"), "w", force_zip64=True) as listed:
            for n, row in enumerate(files.select("path", "sha256").orderBy("path").toLocalIterator()):
                listed.write((",\n" if n else "[").encode() + json.dumps({"path": row.path, "sha256": row.sha256}).encode())
            listed.write(b"]" if written else b"[]")


def archive_defects(path: str) -> list[str]:
    """The paths of archived files whose content is missing or has another hash."""
    with zipfile.ZipFile(path) as held:
        names = set(held.namelist())
        return [f["path"] for f in json.loads(held.read("manifest.json")) if f"files/{f['sha256']}" not in names or _digest(held, f"files/{f['sha256']}") != f["sha256"]]


def dump(artifact: dict, path: str) -> None:
    """Canonical JSON and a line feed."""
    Path(path).write_text(json.dumps(artifact, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n", "utf-8")
