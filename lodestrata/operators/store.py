"""Immutable snapshots in a folder: publish, compare-and-set head, load, sweep, export."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.integrity import equal_tables, generation_hash


class Conflict(RuntimeError):
    """The head moved, or a snapshot id exists with other contents."""


class Store:
    """Tables of snapshots under one shared folder, through Hadoop's file system (local, HDFS, object stores).

    A snapshot's tables lie in ``snapshots/<id>/<family>``; a family is written to a staging folder and moved
    into place, so a lost executor or a failed run leaves no half-written table. ``heads/<repository>`` holds
    one numbered file per generation, created exclusively: of two writers of a generation one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, p):
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        p = self._path(*parts)
        return self._fs(p).exists(p)

    def names(self, *parts: str) -> list[str]:
        p = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs(p).listStatus(p)) if self.exists(*parts) else []

    def publish(self, snapshot_id: str, families: dict[str, DataFrame]) -> None:
        """Write the tables of a snapshot. Publishing it again with equal tables does nothing; else it conflicts."""
        for name, df in families.items():
            if self.exists("snapshots", snapshot_id, name):
                old = self.load(snapshot_id, name)
                if sorted(old.columns) != sorted(df.columns) or any(r["n"] for r in equal_tables(old, df).collect()):
                    raise Conflict(f"{snapshot_id}/{name} exists with other contents")
                continue
            staged = f"staging/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{staged}")
            target = self._path("snapshots", snapshot_id, name)
            self._fs(target).mkdirs(target.getParent())
            if not self._fs(target).rename(self._path(staged), target):
                raise Conflict(f"{snapshot_id}/{name} can't be put into place")

    def load(self, snapshot_id: str, family: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshots/{snapshot_id}/{family}")

    def head(self, repository: str) -> tuple[str | None, int]:
        """(snapshot id, generation) of a repository; (None, 0) before the first."""
        key = uuid.uuid5(uuid.NAMESPACE_URL, repository).hex
        names = [n for n in self.names("heads", key) if n.isdigit()]
        if not names:
            return None, 0
        p = self._path("heads", key, max(names))
        stream = self._fs(p).open(p)
        try:
            text = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)["snapshot_id"], int(max(names))

    def compare_and_set(self, repository: str, expected: str | None, snapshot_id: str) -> int:
        """Move the head from ``expected`` to ``snapshot_id``; the generation after it. Setting it to what it is changes nothing."""
        now, generation = self.head(repository)
        if now == snapshot_id:
            return generation
        if now != expected:
            raise Conflict(f"head of {repository} is {now}, not {expected}")
        key = uuid.uuid5(uuid.NAMESPACE_URL, repository).hex
        p = self._path("heads", key, f"{generation + 1:012d}")
        try:
            out = self._fs(p).create(p, False)
        except Exception as e:
            raise Conflict(f"generation {generation + 1} of {repository} was taken") from e
        out.write(bytearray(json.dumps({"repository": repository, "snapshot_id": snapshot_id}, sort_keys=True).encode()))
        out.close()
        return generation + 1

    def sweep(self, keep: set[str]) -> list[str]:
        """Remove staged leftovers and the snapshots that no head has and that are not in ``keep``; the removed ids."""
        held = set(keep)
        for key in self.names("heads"):
            for n in self.names("heads", key):
                p = self._path("heads", key, n)
                stream = self._fs(p).open(p)
                held.add(json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())["snapshot_id"])
                stream.close()
        gone = [s for s in self.names("snapshots") if s not in held]
        for s in gone:
            self._fs(self._path("snapshots", s)).delete(self._path("snapshots", s), True)
        if self.exists("staging"):
            self._fs(self._path("staging")).delete(self._path("staging"), True)
        return gone


class Corrupt(RuntimeError):
    """Stored bytes are not those that their digest names, or a document's folder is not ours."""


#: The file that marks a folder of generated documents as owned.
OWNED = "_generated"


class Blobs:
    """Bytes by their digest: written once, moved into place, and held against digest and length when read."""

    def __init__(self, store: Store):
        self.store = store

    def put(self, rows: DataFrame, column: str) -> DataFrame:
        """Store the distinct values (binary) of a column; their sha256 and byte_length. Values already stored are not written again."""
        values = rows.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("sha256"), F.octet_length(column).cast("long").alias("byte_length"), F.col(column).alias("bytes")).dropDuplicates(["sha256"])
        new = values.join(self.all().select("sha256"), "sha256", "left_anti") if self.store.exists("blobs") else values
        staged = f"staging/{uuid.uuid4().hex}"
        new.write.parquet(f"{self.store.root}/{staged}")
        target = self.store._path("blobs", uuid.uuid4().hex)
        self.store._fs(target).mkdirs(target.getParent())
        if not self.store._fs(target).rename(self.store._path(staged), target):
            raise Conflict("blobs can't be put into place")
        return values.select("sha256", "byte_length")

    def all(self) -> DataFrame:
        return self.store.spark.read.schema("sha256 string, byte_length long, bytes binary").parquet(f"{self.store.root}/blobs/*")

    def get(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (sha256) with bytes and state: sound, corrupt (bytes are not what digest and length say; no bytes then) or missing."""
        rows = wanted.select("sha256").distinct().join(self.all(), "sha256", "left")
        sound = (F.sha2("bytes", 256) == F.col("sha256")) & (F.octet_length("bytes") == F.col("byte_length"))
        state = F.when(F.col("byte_length").isNull(), "missing").when(F.coalesce(sound, F.lit(False)), "sound").otherwise("corrupt")
        return rows.select("sha256", F.when(state == "sound", F.col("bytes")).alias("bytes"), state.alias("state"))


def publish_documents(store: Store, name: str, documents: DataFrame) -> DataFrame:
    """Put generated documents (path, body) in place of those published before under ``name``; what is there now.

    The new folder is written beside the old one, with an owner's mark, and takes its place by renaming. A folder
    without the mark is not ours and is never replaced.
    """
    target = store._path("documents", name)
    fs = store._fs(target)
    if fs.exists(target) and not store.exists("documents", name, OWNED):
        raise Corrupt(f"{name} is no folder of generated documents")
    staged = f"staging/{uuid.uuid4().hex}"
    documents.select("path", "body").write.parquet(f"{store.root}/{staged}/files")
    fs.create(store._path(staged, OWNED), False).close()
    fs.mkdirs(target.getParent())
    old = store._path("staging", uuid.uuid4().hex)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(store._path(staged), target):
        raise Conflict(f"{name} can't be put into place")
    fs.delete(old, True)
    return store.spark.read.parquet(f"{store.root}/documents/{name}/files")


def stage_cache(store: Store, entries: DataFrame) -> DataFrame:
    """Append analysis-cache entries (entry_id, others) that are not staged yet; all that are staged now, sound or not.

    An entry whose id is not the one derived from its key is kept out of what a refresh may reuse (``sound`` false).
    """
    once = entries.dropDuplicates(["entry_id"])
    path = f"{store.root}/analysis-cache"
    if store.exists("analysis-cache"):
        once = once.join(store.spark.read.parquet(path).select("entry_id"), "entry_id", "left_anti")
    once.write.mode("append").parquet(path)
    return store.spark.read.parquet(path)


def self_consistent(entries: DataFrame, derived) -> DataFrame:
    """``entries`` with ``sound``: whether entry_id is the id that their key derives (a column expression)."""
    return entries.withColumn("sound", F.col("entry_id").eqNullSafe(derived))


def read_portable(store: Store, path: str, families: dict[str, str]) -> dict[str, DataFrame]:
    """The families of an exported graph (JSON lines per family, schema given), read strictly: a line of another shape raises."""
    return {name: store.spark.read.schema(shape).option("mode", "FAILFAST").json(f"{store.root}/{path}/{name}") for name, shape in families.items()}


def canonical_lines(rows: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Rows as JSON lines with sorted member names, in key order: the form of an export; ``keep`` stays outside the JSON."""
    own = sorted(c for c in rows.columns if c not in (keep or ()))
    return rows.orderBy(key).select(*(keep or ()), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("value"))


def export(rows: DataFrame, key: str, path: str) -> None:
    """Write the canonical lines as text files whose order of names is the order of keys."""
    canonical_lines(rows, key).write.text(path)


def portable_graph(families: dict[str, DataFrame]) -> DataFrame:
    """family, rows, digest of every family of a graph: the manifest of an export."""
    out = None
    for name, df in sorted(families.items()):
        part = generation_hash(df.withColumn("__f", F.lit(name)), ["__f"], "id", sorted(c for c in df.columns if c != "id")).select(F.col("__f").alias("family"), "rows", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def unreferenced(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Objects that no reference names: what a sweep may remove."""
    return objects.join(references.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
