"""Git objects as a Spark data source, from the object files themselves: no git program is run.

``spark.read.format("git_objects").option("path", repo).option("revision", "refs/heads/main").load()`` gives one
row per tree entry: path, mode, blob_oid, byte_length, bytes (null for nested repositories), commit_oid,
tree_oid. Loose objects and packs (index version 2, offset and reference deltas) are read, and every
object's digest is checked. The tree is walked once for planning; blobs are read in the tasks. The folder
must be readable on every executor.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
#: Deltas that may stand one on another.
MAX_CHAIN = 64


class GitError(ValueError):
    """An object is missing, damaged or of another kind than needed."""


class Pack:
    """One pack and its index, both read at need."""

    def __init__(self, index: str):
        self.path = index[:-4] + ".pack"
        with open(index, "rb") as f:
            data = f.read()
        if data[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise GitError("pack index version")
        n = struct.unpack(">I", data[8 + 255 * 4 : 8 + 256 * 4])[0]
        at = 8 + 256 * 4
        self.oids = [data[at + 20 * i : at + 20 * (i + 1)] for i in range(n)]
        at += 24 * n
        small = struct.unpack(f">{n}I", data[at : at + 4 * n])
        large = at + 4 * n
        self.offsets = [o if not o & 0x80000000 else struct.unpack(">Q", data[large + 8 * (o & 0x7FFFFFFF) : large + 8 * (o & 0x7FFFFFFF) + 8])[0] for o in small]

    def find(self, oid: bytes) -> int | None:
        i = bisect.bisect_left(self.oids, oid)
        return self.offsets[i] if i < len(self.oids) and self.oids[i] == oid else None


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object a delta makes of its base."""

    def size(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = delta[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return n, at

    have, at = size(0)
    want, at = size(at)
    if have != len(base):
        raise GitError("delta base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            offset = length = 0
            for k in range(4):
                if op & (1 << k):
                    offset |= delta[at] << (8 * k)
                    at += 1
            for k in range(3):
                if op & (0x10 << k):
                    length |= delta[at] << (8 * k)
                    at += 1
            length = length or 0x10000
            if offset + length > len(base):
                raise GitError("delta copy")
            out += base[offset : offset + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise GitError("delta op")
    if len(out) != want:
        raise GitError("delta size")
    return bytes(out)


class Repository:
    def __init__(self, path: str):
        inner = os.path.join(path, ".git")
        self.dir = inner if os.path.isdir(inner) else path
        folder = os.path.join(self.dir, "objects", "pack")
        names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        self.packs = [Pack(os.path.join(folder, n)) for n in names if n.endswith(".idx")]

    def resolve(self, revision: str) -> str:
        """The object id of a full ref name or of a 40-digit id."""
        if re.fullmatch(r"[0-9a-f]{40}", revision):
            return revision
        if not re.fullmatch(r"(?:HEAD|refs/[\w./-]+)", revision) or ".." in revision:
            raise GitError(f"revision {revision!r}")
        p = os.path.join(self.dir, revision)
        if os.path.isfile(p):
            with open(p) as f:
                text = f.read().strip()
            return self.resolve(text[5:] if text.startswith("ref: ") else text)
        packed = os.path.join(self.dir, "packed-refs")
        if os.path.isfile(packed):
            with open(packed) as f:
                for line in f:
                    oid, _, name = line.strip().partition(" ")
                    if name == revision:
                        return oid
        raise GitError(f"no revision {revision!r}")

    def read(self, oid: str, kind: str) -> bytes:
        """An object's content; its digest and kind are checked."""
        got, data = self._object(bytes.fromhex(oid), 0)
        if hashlib.sha1(f"{got} {len(data)}\0".encode() + data).hexdigest() != oid:
            raise GitError(f"digest of {oid}")
        if got != kind:
            raise GitError(f"{oid} is a {got}")
        return data

    def _object(self, oid: bytes, depth: int) -> tuple[str, bytes]:
        h = oid.hex()
        loose = os.path.join(self.dir, "objects", h[:2], h[2:])
        if os.path.isfile(loose):
            with open(loose, "rb") as f:
                raw = zlib.decompress(f.read())
            head, _, data = raw.partition(b"\0")
            kind, _, size = head.decode().partition(" ")
            if int(size) != len(data):
                raise GitError(f"size of {h}")
            return kind, data
        for p in self.packs:
            at = p.find(oid)
            if at is not None:
                return self._packed(p, at, depth)
        raise GitError(f"no object {h}")

    def _packed(self, pack: Pack, at: int, depth: int) -> tuple[str, bytes]:
        if depth > MAX_CHAIN:
            raise GitError("delta chain")
        with open(pack.path, "rb") as f:
            f.seek(at)
            b = f.read(1)[0]
            kind, size, shift = (b >> 4) & 7, b & 15, 4
            while b & 0x80:
                b = f.read(1)[0]
                size |= (b & 0x7F) << shift
                shift += 7
            base = None
            if kind == 6:
                b = f.read(1)[0]
                back = b & 0x7F
                while b & 0x80:
                    b = f.read(1)[0]
                    back = ((back + 1) << 7) | (b & 0x7F)
                base = ("offset", at - back)
            elif kind == 7:
                base = ("oid", f.read(20))
            d, data = zlib.decompressobj(), b""
            while len(data) < size or not d.eof:
                chunk = f.read(65536)
                if not chunk:
                    break
                data += d.decompress(chunk)
        if len(data) != size:
            raise GitError("packed size")
        if base is None:
            if kind not in TYPES:
                raise GitError("packed kind")
            return TYPES[kind], data
        under = self._packed(pack, base[1], depth + 1) if base[0] == "offset" else self._object(base[1], depth + 1)
        return under[0], apply_delta(under[1], data)

    def bind(self, revision: str) -> tuple[str, str]:
        """(commit, tree) ids of a revision."""
        commit = self.resolve(revision)
        m = re.match(rb"tree ([0-9a-f]{40})\n", self.read(commit, "commit"))
        if not m:
            raise GitError("commit without tree")
        return commit, m.group(1).decode()

    def walk(self, tree: str, prefix: str = "") -> Iterator[tuple[str, str, str]]:
        """(path, mode, object id) of every entry but trees, in byte order of paths within a folder."""
        data, at = self.read(tree, "tree"), 0
        while at < len(data):
            space, end = data.index(b" ", at), data.index(b"\0", at)
            mode, name, oid = data[at:space].decode(), data[space + 1 : end].decode("utf-8"), data[end + 1 : end + 21].hex()
            at = end + 21
            if name in ("", ".", "..") or "/" in name:
                raise GitError("tree entry")
            if mode in ("40000", "040000"):
                yield from self.walk(oid, f"{prefix}{name}/")
            else:
                yield f"{prefix}{name}", mode, oid


class _Part(InputPartition):
    def __init__(self, entries: list[tuple[str, str, str]]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.revision = options["path"], options.get("revision", "HEAD")
        self.per_task = int(options.get("filesPerTask", "2000"))

    def partitions(self):
        repo = Repository(self.path)
        self.commit, self.tree = repo.bind(self.revision)
        entries = sorted(repo.walk(self.tree), key=lambda e: e[0].encode())
        return [_Part(entries[i : i + self.per_task]) for i in range(0, max(len(entries), 1), self.per_task)]

    def read(self, partition):
        repo = Repository(self.path)
        commit, tree = repo.bind(self.revision)
        for path, mode, oid in partition.entries:
            data = None if mode == "160000" else repo.read(oid, "blob")
            yield path, mode, oid, None if data is None else len(data), data, commit, tree


class GitObjects(DataSource):
    """Register with ``spark.dataSource.register(GitObjects)``."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return "path string, mode string, blob_oid string, byte_length long, bytes binary, commit_oid string, tree_oid string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
