"""Queries over small inputs given in the query: sources and operators that the driver's tables hold no case for.

Each writes or builds its own input, runs the same operator as the queries over whole tables, and is held
against rows worked out by hand.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import answers, federation, integrity, inventory, reports, resolve
from lodestrata.operators.store import Blobs, Conflict, Store, publish_documents, read_portable, self_consistent, stage_cache
from lodestrata.plans import extraction as E
from lodestrata.plans.scalars import values
from lodestrata.runtime import shared_dir
from lodestrata.sources import contracts, git, manifests, scip
from lodestrata.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(columns: str, rows: list[tuple]):
    """Register a query whose rows are known."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = values(columns, rows)
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestrata/given-{uuid.uuid4().hex}"


def _sources(spark: SparkSession, files: list[tuple[str, str | None]]) -> str:
    """A folder with a source_files table of the texts given."""
    d = _folder(spark)
    rows = [(i, p, t) for i, (p, t) in enumerate(files, 1)]
    spark.createDataFrame(rows, "file_id long, canonical_source_path string, source_text string").write.parquet(f"{d}/source_files.parquet")
    return d


# ---------------------------------------------------------------- Rust

RUST = """use crate::a::{Shape, other as o};
const BASE: u32 = 2 + 3 * 4;
const OFFSET: u32 = BASE - 5;
const TARGET_WIDTH: usize = 8;
#[repr(u8)]
pub enum Mode { Off, Warm = 3, Hot }
pub enum Free { One }
pub struct Shape { pub x: u64 }
fn choose(a: u64) -> u64 {
    let mut total = a;
    if a > 3 { total = total + 1; } else { total = 0; }
    total
}
fn outer() { choose(1); far::away(2); }
fn app() { Router::new().route("/x", get(outer)).service(far::gone); }
impl Shape { #[cfg(unix)] fn go() {} #[cfg(windows)] fn go() {} fn other() {} }
"""


@query("kind, n", [("rust.enum_variant", 4), ("rust.field", 1), ("rust.constant", 3), ("rust.function", 3), ("rust.import", 2), ("rust.method", 3), ("rust.struct", 1), ("rust.enum", 2), ("rust.syntax_basic_block", 7)])
def given_rust_facts(spark, d):
    """How many facts of each kind a small crate has."""
    kinds = ["rust.enum_variant", "rust.field", "rust.constant", "rust.function", "rust.import", "rust.method", "rust.struct", "rust.enum", "rust.syntax_basic_block"]
    return E.rust_facts(spark, _sources(spark, [("src/lib.rs", RUST), ("src/b.rs", None), ("src/c.rs", "")])).where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("name, value, problem", [("BASE", "14", None), ("OFFSET", "9", None), ("TARGET_WIDTH", None, "type usize"), ("Off", "0", None), ("Warm", "3", None), ("Hot", "4", None), ("One", None, "no fixed representation")])
def given_rust_constants(spark, d):
    """Constants in the order of their dependencies, and discriminants: the one before plus one, in a fixed type only."""
    return E.rust_constants(spark, _sources(spark, [("src/lib.rs", RUST)])).select("name", "value", "problem")


@query("source, target", [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 4), (3, 4)])
def given_flow_reaches(spark, d):
    """The closure of the flow of a callable with two branches: nine pairs of its five blocks."""
    text = RUST[: RUST.index("fn outer")]
    return E.rust_flow_reaches(spark, _sources(spark, [("src/lib.rs", text)])).select("source", "target")


@query("line, mode, definitions", [(10, "must", 1), (11, "must", 2), (12, "may", 2)])
def given_reaching_definitions(spark, d):
    """Reads by their line: how many definitions surely or perhaps reach them, over branches that join."""
    text = RUST[: RUST.index("fn outer")]
    folder = _sources(spark, [("src/lib.rs", text)])
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    at = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("at")))
    spots = E._whole(spark, folder).select(F.col("id").alias("read_id"), F.col("start_byte").alias("at"))
    rows = E.rust_reaching_definitions(spark, folder).join(spots, "read_id").select(at.alias("line"), "mode", "read_id", "definition_id")
    return rows.groupBy("line", "mode").agg(F.count_distinct("read_id", "definition_id").alias("definitions"))


@query("start_block, blocks, definitions", [(0, "0", 1), (0, "0,1", 1), (0, "0,1,2", 1), (1, "1,2,3,4", 2)])
def given_read_derivations(spark, d):
    """The slice of blocks that explains each read: from the block where its definitions meet."""
    text = RUST[: RUST.index("fn outer")]
    r = E.rust_read_derivations(spark, _sources(spark, [("src/lib.rs", text)]))
    return r.select("start_block", F.array_join(F.transform("blocks", lambda b: b.cast("string")), ",").alias("blocks"), F.size("definitions").alias("definitions"))


@query("tier, n", [("exact", 1), ("unresolved", 3)])
def given_rust_calls(spark, d):
    """Path calls that name a function of the file, and those that do not."""
    return E.rust_calls(spark, _sources(spark, [("src/lib.rs", RUST)])).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("path, resolution", [("Shape", "resolved"), ("other", "unresolved")])
def given_rust_imports(spark, d):
    folder = _sources(spark, [("src/lib.rs", RUST)])
    names = E._whole(spark, folder).where("kind = 'rust.import'").select(F.col("id").alias("import_id"), F.element_at(F.split("name", "::"), -1).alias("path"))
    return E.rust_imports(spark, folder).join(names, "import_id").select("path", "resolution")


@query("kind, n", [("READS", 4), ("WRITES", 2)])
def given_rust_accesses(spark, d):
    """Reads and writes bound to the narrowest binding in scope."""
    text = RUST[: RUST.index("fn outer")]
    return E.rust_accesses(spark, _sources(spark, [("src/lib.rs", text)])).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("name, alternatives", [("go", 2)])
def given_rust_alternatives(spark, d):
    return E.rust_alternatives(spark, _sources(spark, [("src/lib.rs", RUST)])).select("name", "alternatives")


@query("role, detail, state", [("route", '"/x"|get(outer)', "resolved_unique"), ("service", "|far::gone", "unresolved_external")])
def given_rust_registrations(spark, d):
    return E.rust_registrations(spark, _sources(spark, [("src/lib.rs", RUST)])).select("role", "detail", "state")


# ---------------------------------------------------------------- manifests and contracts

ROOT_TOML = '[workspace]\nmembers = ["app"]\n[workspace.dependencies]\nserde = "1"\n'
APP_TOML = '[package]\nname = "app-x"\nversion.workspace = true\n[dependencies]\nserde = { workspace = true }\nlost = { workspace = true }\nown = { path = "../own" }\nfar = { git = "https://user:secret@host/x" }\n[target."cfg(unix)".dev-dependencies]\nlibc = "0.2"\n[features]\ndefault = ["dep:serde", "serde?/std"]\n[[bin]]\nname = "tool"\npath = "src/tool.rs"\n[[bin]]\nname = "gone"\npath = "src/gone.rs"\n'


@query("kind, section, name, value", [
    ("cargo.manifest", "", "standalone", ""), ("cargo.package", "package", "name", "app-x"), ("cargo.package", "package", "version", "workspace"), ("cargo.target", "bin", "tool", "src/tool.rs"), ("cargo.target", "bin", "gone", "src/gone.rs"),
    ("cargo.dependency", "normal", "serde", "workspace"), ("cargo.dependency", "normal", "lost", "workspace"), ("cargo.dependency", "normal", "own", "path"), ("cargo.dependency", "normal", "far", "git"), ("cargo.dependency", "dev:cfg(unix)", "libc", "registry"),
    ("cargo.feature", "default", "dep:serde", ""), ("cargo.feature", "default", "serde?/std", ""),
])
def given_cargo_facts(spark, d):
    return E.cargo_facts(spark, _sources(spark, [("app/Cargo.toml", APP_TOML)])).select("kind", "section", "name", "value")


@query("name, target, gap", [("serde", "2:serde", None), ("lost", None, "cargo.workspace_inheritance_not_materialized")])
def inherited_dependencies(spark, d):
    """Dependencies that inherit from their workspace, and the declaration there that they name."""
    facts = E.cargo_facts(spark, _sources(spark, [("app/Cargo.toml", APP_TOML), ("Cargo.toml", ROOT_TOML)])).where("kind = 'cargo.dependency'")
    deps = facts.where("value = 'workspace' AND section <> 'workspace'").select(F.lit("w").alias("workspace"), F.col("file_id").cast("string").alias("package"), "name")
    own = facts.where("section = 'workspace'").select(F.lit("w").alias("workspace"), "name", F.concat_ws(":", F.col("file_id").cast("string"), "name").alias("id"))
    return resolve.inherited_dependencies(deps, own).select("name", "target", "gap")


@query("name, crate_id", [("tool", "crate/tool"), ("gone", None)])
def materialised_targets(spark, d):
    """Cargo targets and the crates that their root sources make."""
    facts = E.cargo_facts(spark, _sources(spark, [("app/Cargo.toml", APP_TOML)])).where("kind = 'cargo.target'")
    targets = facts.select(F.lit("w").alias("workspace"), F.lit("app-x").alias("package"), F.col("section").alias("kind"), "name", F.col("value").alias("path"))
    crates = spark.createDataFrame([("w", "src/tool.rs", "crate/tool"), ("v", "src/gone.rs", "crate/elsewhere")], "workspace string, root_path string, id string")
    return resolve.materialised_targets(targets, crates).select("name", "crate_id")


@query("kind, name, path", [("lib", "a_b", "src/lib.rs"), ("bin", "a", "src/bin/a.rs"), ("ambiguous", "b", "src/bin/b.rs")])
def conventional_targets(spark, d):
    return spark.createDataFrame(manifests.conventional_targets(["src/lib.rs", "src/bin/a.rs", "src/bin/b.rs", "src/bin/b/main.rs"], "a-b"), "kind string, name string, path string")


@query("path, url, start, stop, unsupported", [("libs/x", "../x.git", 0, 62, "branch"), ("y", "", 69, 95, "")])
def given_gitmodules(spark, d):
    """Submodule sections with their byte spans and the keys that are not read."""
    data = b'[submodule "x"]\n\tpath = libs/x\n\turl = ../x.git\n\tbranch = main\n# note\n[submodule "y"]\n path = y\n'
    rows = [(p, u, a, b, ",".join(k)) for _, p, u, a, b, k in manifests.gitmodules(data)]
    return spark.createDataFrame(rows, "path string, url string, start long, stop long, unsupported string")


OPENAPI = """{"openapi": "3.1.0", "info": {"title": "Users"}, "paths": {"/users/{id}": {"get": {"operationId": "getUser", "callbacks": {"x": {}}, "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/User"}}, "text/plain": {}}}}}}},
"components": {"schemas": {"User": {"required": ["id"], "properties": {"id": {"type": "string"}, "a/b": {"type": "object", "properties": {"deep": {"type": "integer"}}}}}}}}"""
YAML = """openapi: 3.1.0
info: {title: Users}
paths:
  /users/{id}:
    get:
      operationId: getUser
      callbacks: {x: {}}
      responses:
        "200":
          content:
            application/json:
              schema: {$ref: '#/components/schemas/User'}
            text/plain: {}
components:
  schemas:
    User:
      required: [id]
      properties:
        id: {type: string}
        'a/b': {type: object, properties: {deep: {type: integer}}}
"""


@query("kind, method, path, name, pointer, detail", [
    ("service", "", "", "Users", "", ""), ("operation", "GET", "/users/{id}", "getUser", "", "Users"), ("gap", "GET", "/users/{id}", "contract.callbacks_unsupported", "", ""), ("gap", "GET", "/users/{id}", "contract.media_type_unsupported", "", "text/plain"),
    ("field", "GET", "/users/{id}", "optional", "/a~1b", "200:object"), ("field", "GET", "/users/{id}", "optional", "/a~1b/deep", "200:integer"), ("field", "GET", "/users/{id}", "required", "/id", "200:string"),
])
def given_contract_facts(spark, d):
    return E.contract_facts(spark, _sources(spark, [("api/openapi.json", OPENAPI)])).drop("file_id")


@query("forms, hashes", [(2, 1)])
def contract_formats(spark, d):
    """A contract as YAML and as JSON: its facts have one digest, whichever form it is in."""
    facts = E.contract_facts(spark, _sources(spark, [("a/openapi.json", OPENAPI), ("b/openapi.yaml", YAML)]))
    key = F.to_json(F.array("kind", "method", "path", "name", "pointer", "detail"))
    hashes = integrity.generation_hash(facts.select("file_id", key.alias("k")), ["file_id"], "k", [])
    return hashes.agg(F.count(F.lit(1)).alias("forms"), F.count_distinct("digest").alias("hashes"))


_BAD = {"a: &x 1\nb: *x\n": "alias", "a: 1\na: 2\n": "duplicate_key", "a: !t 1\n": "custom_tag", "a: 1\n---\nb: 2\n": "multiple_documents", "{": "malformed", "openapi: 3.0.0\n": "unsupported_openapi", YAML.replace("#/components/schemas/User", "http://x"): "remote_ref", YAML.replace("required: [id]", "$ref: '#/components/schemas/User'"): "ref_cycle"}


@query("file_id, problem", [(i, code) for i, code in enumerate(_BAD.values(), 1)])
def contract_problems(spark, d):
    """Contracts that are refused, each with its reason."""
    return E.contract_facts(spark, _sources(spark, [(f"x{i}/openapi.yaml", t) for i, t in enumerate(_BAD)])).where("kind = 'error'").select("file_id", F.col("name").alias("problem"))


@query("kind, function, name, detail", [("assumption", "a", "x", "requires_present"), ("assumption", "a", "y", "handles_absent"), ("assumption", "a", "z", "unknown"), ("call", "b", "/users/{id}", "")])
def given_client_facts(spark, d):
    text = 'fun a(payload: Map<String, Any?>) { payload.getValue("x"); payload["y"]?.toString(); payload["z"] /* payload.getValue("no") */ }\nfun b() = get("/users/$id")'
    return E.client_facts(spark, _sources(spark, [("A.kt", text)])).drop("file_id")


@query("field, presence", [("a", "guaranteed_present"), ("b", "unsupported"), ("d", "may_be_absent"), ("*", "unknown")])
def given_provider_facts(spark, d):
    text = 'fn f() { m.insert("a", 1); if x { m.insert("b", 2); } else { y(); } if z { m.insert("d", 3); } m.extend(q); // m.insert("c", 1)\n }'
    return E.provider_facts(spark, _sources(spark, [("src/p.rs", text)])).drop("file_id")


# ---------------------------------------------------------------- compiler indexes


def _vint(n: int) -> bytes:
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def _field(n: int, v: int | bytes) -> bytes:
    return _vint(n << 3) + _vint(v) if isinstance(v, int) else _vint(n << 3 | 2) + _vint(len(v)) + v


def _index() -> bytes:
    def occurrence(span, symbol, roles, outer=(), syntax=15):
        return _field(2, _field(1, b"".join(map(_vint, span))) + _field(2, symbol.encode()) + _field(3, roles) + _field(5, syntax) + (_field(7, b"".join(map(_vint, outer))) if outer else b""))

    doc = _field(1, b"src/a.rs") + occurrence((1, 3, 6), "rust cargo own 1 f().", 1, (1, 0, 9, 1)) + occurrence((4, 8, 12), "rust cargo far 2 g().", 8) + occurrence((20, 0, 4), "rust cargo far 2 h().", 8)
    doc += occurrence((0, 4, 8), "rust cargo far 2 m/T#", 2) + occurrence((5, 0, 4), "rust cargo own 1 k().", 8)
    related = lambda s, n: _field(4, _field(1, s) + _field(n, 1))
    doc += _field(3, _field(1, b"rust cargo own 1 S#") + related(b"rust cargo far 2 m/T#", 3) + related(b"rust cargo own 1 U#", 4))
    return _field(2, doc)


def _scip(spark: SparkSession) -> DataFrame:
    return scip.scip_facts(spark.createDataFrame([(bytearray(_index()),), (bytearray(b"\xff\xff"),), (None,)], "d binary"), "d")


@query("kind, n", [("gap", 1), ("occurrence", 5), ("relationship", 2), ("symbol", 1)])
def given_scip_facts(spark, d):
    """Rows of an index; bytes that are none give one gap."""
    return _scip(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("kind, source, target", [
    ("RESOLVES_TO", "src/a.rs", "rust cargo far 2 m/T#"), ("REFERENCES", "rust cargo own 1 f().", "rust cargo far 2 g()."), ("IMPLEMENTS", "rust cargo own 1 S#", "rust cargo far 2 m/T#"), ("TYPE_DEFINITION", "rust cargo own 1 S#", "rust cargo own 1 U#"),
])
def compiler_overlay(spark, d):
    """The four kinds of edges of an index: a read of the own package is no reference, one outside every definition has no owner."""
    return scip.overlay_edges(_scip(spark)).select("kind", "source", "target")


@query("symbol, target, state", [("rust cargo own 1 a/b/f().", "1", "bound"), ("rust cargo own 1 a/T#go().", "2", "bound"), ("rust cargo own 1 a/U#go().", None, "missing"), ("rust cargo own 1 a/twice().", None, "ambiguous"), ("rust cargo own 1 T#", "5", "bound")])
def symbol_entities(spark, d):
    """Symbols and the entities that their descriptors name; a method's owner must agree."""
    ents = spark.createDataFrame([("a::b", None, "f", "1"), ("a", "T", "go", "2"), ("a", None, "twice", "3"), ("a", None, "twice", "4"), (None, None, "T", "5")], "module_path string, owner string, name string, id string")
    symbols = spark.createDataFrame([(s,) for s in ("rust cargo own 1 a/b/f().", "rust cargo own 1 a/T#go().", "rust cargo own 1 a/U#go().", "rust cargo own 1 a/twice().", "rust cargo own 1 T#")], "symbol string")
    return scip.symbol_entities(symbols, ents)


@query("path, state", [("a.rs", "bound"), ("b.rs", "differs"), ("c.rs", "missing"), ("d.rs", "ambiguous")])
def bound_documents(spark, d):
    """Documents of an index against the inventory: path, object, length and digest must agree."""
    shape = "path string, blob_oid string, byte_length long, sha256 string"
    bound = spark.createDataFrame([("a.rs", "1", 3, "x"), ("b.rs", "2", 4, "y"), ("c.rs", "3", 5, "z"), ("d.rs", "4", 6, "w")], shape)
    inv = spark.createDataFrame([("a.rs", "1", 3, "x"), ("b.rs", "2", 9, "y"), ("d.rs", "4", 6, "w"), ("d.rs", "5", 6, "w")], shape)
    return answers.bind_documents(bound, inv)


@query("id, subject_id, state", [("s1", "alt1", "moved"), ("s2", "d2", "kept"), (None, "alt3", "missing")])
def alternatives_and_signatures(spark, d):
    signatures = spark.createDataFrame([("s1", "d1"), ("s2", "d2")], "id string, subject_id string")
    alternatives = spark.createDataFrame([("alt1", "d1"), ("alt3", "d3")], "alternative_id string, declaration_id string")
    return resolve.move_signatures(signatures, alternatives)


@query("name, alternatives, state", [("apart", 2, "sound"), ("meets", 3, "overlapping"), ("many", 33, "too_many")])
def alternative_rules(spark, d):
    """Alternatives must not overlap, and there may be no more than 32 of one declaration."""
    rows = [("apart", 0, 5), ("apart", 5, 9), ("meets", 0, 50), ("meets", 60, 70), ("meets", 65, 80), ("alone", 0, 1), *[("many", i, i + 1) for i in range(33)]]
    df = spark.createDataFrame([("f", "o", "k", n, f"{n}{a}", a, b) for n, a, b in rows], "file string, owner string, kind string, name string, id string, start long, end long")
    return resolve.alternatives(df).select("name", "alternatives", "state")


# ---------------------------------------------------------------- git


def _loose(root: str, kind: str, data: bytes) -> str:
    raw = f"{kind} {len(data)}\0".encode() + data
    oid = hashlib.sha1(raw).hexdigest()
    folder = os.path.join(root, ".git", "objects", oid[:2])
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, oid[2:]), "wb") as f:
        f.write(zlib.compress(raw))
    return oid


def _blob_id(data: bytes) -> str:
    return hashlib.sha1(f"blob {len(data)}\0".encode() + data).hexdigest()


_MAIN, _NOTE = b"fn main() {}\n", "Größe\n".encode()


@query("path, mode, blob_oid, text", [("main.rs", "100644", _blob_id(_MAIN), _MAIN.decode()), ("nested", "160000", "1" * 40, None), ("src/note.txt", "100755", _blob_id(_NOTE), _NOTE.decode())])
def given_git_objects(spark, d):
    """The files of a revision, read from a repository's objects; a nested repository has no bytes."""
    folder = _folder(spark)
    if "://" in folder.removeprefix("file://"):
        raise ValueError("the repository given here is written as files; the shared folder must be one")
    root = folder.removeprefix("file://").removeprefix("file:")
    entry = lambda mode, name, oid: f"{mode} {name}\0".encode() + bytes.fromhex(oid)
    sub = _loose(root, "tree", entry("100755", "note.txt", _loose(root, "blob", _NOTE)))
    top = _loose(root, "tree", entry("100644", "main.rs", _loose(root, "blob", _MAIN)) + entry("160000", "nested", "1" * 40) + entry("40000", "src", sub))
    commit = _loose(root, "commit", f"tree {top}\nauthor a <a> 0 +0000\n\nx\n".encode())
    os.makedirs(f"{root}/.git/refs/heads")
    with open(f"{root}/.git/refs/heads/main", "w") as f:
        f.write(commit + "\n")
    spark.dataSource.register(git.GitObjects)
    rows = spark.read.format("git_objects").option("path", root).option("revision", "refs/heads/main").load()
    return rows.select("path", "mode", F.col("oid" if "oid" in rows.columns else "blob_oid").alias("blob_oid"), F.decode("bytes", "UTF-8").alias("text"))


_BASE, _DELTA = b"line one\n" * 20, _vint(180) + _vint(185) + bytes([0x80 | 0x10, 180]) + bytes([5]) + b"more\n"


@query("sha256, byte_length", [(hashlib.sha256(_BASE + b"more\n").hexdigest(), 185)])
def given_delta(spark, d):
    """A packed object as its base and a delta: a copy of the base, then five new bytes."""
    rows = spark.createDataFrame([(bytearray(_BASE), bytearray(_DELTA))], "base binary, delta binary")

    @F.udf("binary")
    def undo(base, delta):
        return bytearray(git.apply_delta(bytes(base), bytes(delta)))

    return rows.select(undo("base", "delta").alias("b")).select(F.sha2("b", 256).alias("sha256"), F.octet_length("b").cast("long").alias("byte_length"))


# ---------------------------------------------------------------- documents in JSON

_OID = "0123456789" * 4


@query("row, broken, baseline, clients", [(1, False, "r0", 2), (2, True, None, None), (3, True, None, None)])
def impact_manifest(spark, d):
    """Workspace manifests of an impact analysis; one that is no JSON, or of another type, is broken."""
    texts = [(1, '{"baseline": {"revision": "r0", "source_path": "p.rs"}, "target": {"revision": "r1", "source_path": "p.rs"}, "clients": [{"path": "a.kt"}, {"path": "b.kt"}], "federation_report": "f.json"}'), (2, "{"), (3, '{"clients": 3}')]
    rows = reports.read_documents(spark.createDataFrame(texts, "row int, t string"), "t", reports.IMPACT)
    return rows.select("row", "broken", F.col("document.baseline.revision").alias("baseline"), F.size("document.clients").alias("clients")).withColumn("clients", F.when(~F.col("broken"), F.col("clients")))


@query("row, broken, workspace, provider, clients", [(1, False, "w", "p", 1), (2, True, None, None, None)])
def workspace_manifest(spark, d):
    texts = [(1, '{"workspace_identity": "w", "provider": {"repository_identity": "p"}, "clients": [{"role": "strict"}], "more": 1}'), (2, None)]
    rows = reports.read_documents(spark.createDataFrame(texts, "row int, t string"), "t", reports.WORKSPACE)
    return rows.select("row", "broken", F.col("document.workspace_identity").alias("workspace"), F.col("document.provider.repository_identity").alias("provider"), F.when(~F.col("broken"), F.size("document.clients")).alias("clients"))


@query("row, path, revision", [(1, "libs/x", _OID), (2, None, None)])
def nested_manifest(spark, d):
    texts = [(1, f'{{"repositories": [{{"path": "libs/x", "root": "r", "revision": "{_OID}"}}]}}'), (2, '{"repositories": {}}')]
    rows = reports.read_documents(spark.createDataFrame(texts, "row int, t string"), "t", reports.NESTED)
    return rows.select("row", F.explode_outer("document.repositories").alias("r")).select("row", "r.path", "r.revision")


@query("row, commit, indexed, omitted", [(1, _OID, 1, 1)])
def binding_document(spark, d):
    texts = [(1, f'{{"repository": {{"identity": "i", "commit_oid": "{_OID}"}}, "artifact": {{"sha256": "s", "byte_length": 3}}, "documents": {{"coverage_mode": "declared", "indexed": [{{"path": "a.rs", "byte_length": 1}}], "omitted": ["b.rs"]}}}}')]
    rows = reports.read_documents(spark.createDataFrame(texts, "row int, t string"), "t", reports.BINDING)
    return rows.select("row", F.col("document.repository.commit_oid").alias("commit"), F.size("document.documents.indexed").alias("indexed"), F.size("document.documents.omitted").alias("omitted"))


def _client(**more) -> str:
    import json

    return json.dumps({"repository_identity": "c", "revision": _OID, "source_path": "a/b.kt", "symbol_identity": "f", **more})


@query("row, problem", [(1, None), (2, "explicit_binding"), (3, "heuristic_binding"), (4, "revision"), (5, "source_path"), (6, "malformed"), (7, "binding_kind")])
def client_declarations(spark, d):
    """Client documents and the first fault of each."""
    explicit = {"kind": "explicit", "method": "GET", "path_template": "/users/{id}"}
    texts = [_client(binding=explicit), _client(binding={**explicit, "path_template": "users"}), _client(binding={"kind": "heuristic", "service_hint": "S"}), _client(binding=explicit, revision="x"), _client(binding=explicit, source_path="../a"), "[", _client(binding={"kind": "other"})]
    docs = reports.read_documents(spark.createDataFrame(list(enumerate(texts, 1)), "row int, t string"), "t", reports.CLIENT)
    return reports.client_bindings(docs, keep=["row"]).select("row", "problem")


# ---------------------------------------------------------------- impact

_FIELDS = "operation_id string, json_pointer string, required boolean"
_PRESENCE = "operation_id string, json_pointer string, presence string"


def _impact(spark: SparkSession):
    old = spark.createDataFrame([("op", "/nickname", False), ("op", "/displayName", False), ("op", "/id", True), ("op", "/gone", False)], _FIELDS)
    new = spark.createDataFrame([("op", "/nickname", False), ("op", "/displayName", False), ("op", "/id", True)], _FIELDS)
    before = spark.createDataFrame([("op", "/nickname", "guaranteed_present"), ("op", "/id", "guaranteed_present"), ("op", "*", "unknown")], _PRESENCE)
    after = spark.createDataFrame([("op", "/nickname", "may_be_absent"), ("op", "/id", "guaranteed_present"), ("op", "*", "unknown")], _PRESENCE)
    changes = federation.provider_changes(old, new, before, after)
    clients = spark.createDataFrame(
        [("strict", "s1", "confirmed", "op", "/users/{id}", {"/nickname": "requires_present"}), ("safe", "s2", "confirmed", "op", "/users/{id}", {"/nickname": "handles_absent"}), ("vague", "s3", "confirmed", "op", "/users/{id}", {"/nickname": "unknown"}), ("decoy", "s4", "rejected", "far", "/others", {}), ("odd", "s5", "confirmed", "op", "/others", {"/nickname": "handles_absent"})],
        "client_id string, call_site_id string, federation string, operation_id string, path_template string, assumptions map<string,string>",
    )
    contract = spark.createDataFrame([("op", "/users/{id}")], "operation_id string, path_template string")
    return changes, clients, federation.classify_clients(clients, changes, contract)


@query("json_pointer, baseline, target, classification, rule_id, gap", [
    ("/nickname", "guaranteed_present", "may_be_absent", "breaking", federation.REMOVED_RULE, None), ("/displayName", "unknown", "unknown", "unresolved", None, "provider.custom_mapping"),
    ("/id", "guaranteed_present", "guaranteed_present", "none", None, None), ("/gone", "unknown", "unknown", "unsupported", None, None),
])
def provider_changes(spark, d):
    """Fields of a contract and their presence in two revisions of its provider."""
    return _impact(spark)[0].drop("operation_id")


@query("client_id, state, baseline_risk, target_impact, affected, rule_ids", [
    ("strict", "assessed", "potentially_breaking", "breaking", True, f"{federation.STRICT_RULE},{federation.REMOVED_RULE}"), ("safe", "assessed", "compatible", "compatible", False, federation.SAFE_RULE),
    ("vague", "unsupported", None, None, None, None), ("decoy", "rejected_candidate", None, None, None, None), ("odd", "invalid_authority", None, None, None, None),
])
def client_classes(spark, d):
    """What a breaking change means for clients that rely on the field, handle its absence, or call something else."""
    return _impact(spark)[2].drop("call_site_id")


@query("json_pointer, affected_client_ids", [("/nickname", "strict")])
def affected_clients(spark, d):
    changes, clients, assessments = _impact(spark)
    return federation.affected_clients(changes, clients, assessments).select("json_pointer", F.array_join("affected_client_ids", ",").alias("affected_client_ids"))


@query("family, rows", [("assessments", 2), ("changes", 4), ("rejected_candidates", 1)])
def impact_report(spark, d):
    """The impact report's families as rows of JSON."""
    changes, _, assessments = _impact(spark)
    families = {"changes": changes, "assessments": assessments.where("state = 'assessed'"), "rejected_candidates": assessments.where("state = 'rejected_candidate'")}
    r = reports.report(families, {"changes": "json_pointer", "assessments": "client_id", "rejected_candidates": "client_id"})
    return r.where("get_json_object(body, '$') IS NOT NULL").groupBy("family").agg(F.count(F.lit(1)).alias("rows"))


@query("operation_id, problem", [("op", None), ("same", "same_revision"), ("moved", "path_template_differs"), ("post", "method"), ("none", "not_one_breaking_change"), ("lost", "no_target")])
def impact_guard(spark, d):
    """Which operations' comparisons may be made."""
    shape = "operation_id string, revision string, contract_sha256 string, service_id string, path_template string, method string, response_status string"
    side = lambda o, rev, path="/p", method="GET": (o, rev, "c", "s", path, method, "200")
    base = spark.createDataFrame([side("op", "r0"), side("same", "r0"), side("moved", "r0"), side("post", "r0", method="POST"), side("none", "r0"), side("lost", "r0")], shape)
    target = spark.createDataFrame([side("op", "r1"), side("same", "r0"), side("moved", "r1", "/q"), side("post", "r1", method="POST"), side("none", "r1")], shape)
    changes = spark.createDataFrame([("op", "breaking"), ("same", "breaking"), ("moved", "breaking"), ("post", "breaking"), ("none", "none")], "operation_id string, classification string")
    return federation.impact_guard(base, target, changes)


@query("plan_id, path, state", [(1, "libs/a", "explicitly_bound"), (1, "libs/b", "invalid"), (1, "libs/c", "declared_unbound"), (1, "libs/d", "undeclared_unbound"), (1, "libs/e", "orphan_declaration")])
def boundary_states(spark, d):
    """Nested repositories by gitlink, declaration and the revision they are bound to."""
    links = spark.createDataFrame([("libs/a", "1"), ("libs/b", "2"), ("libs/c", "3"), ("libs/d", "4")], "path string, oid string")
    declared = spark.createDataFrame([("libs/a",), ("libs/b",), ("libs/c",), ("libs/e",)], "path string")
    nested = spark.createDataFrame([("libs/a", "1"), ("libs/b", "9")], "path string, oid string")
    return inventory.boundary_report(links, declared, nested).select(F.lit(1).alias("plan_id"), "path", "state")


# ---------------------------------------------------------------- the store


@query("step, outcome, rows", [("publish", "published", 5), ("publish again", "unchanged", 5), ("publish other", "conflict", 5), ("head", "1:a", 5), ("head again", "1:a", 5), ("head stale", "conflict", 5), ("head next", "2:b", 5), ("sweep", "c", 5)])
def store_steps(spark, d):
    """Publishing, moving the head and sweeping, step by step: what each did, and the rows of the first snapshot."""
    store = Store(spark, _folder(spark))
    t, other = table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "region").select("r_regionkey", F.lit("x").alias("r_name"))
    out = []

    def step(name, run):
        try:
            outcome = run()
        except Conflict:
            outcome = "conflict"
        out.append((name, str(outcome), store.load("a", "region").count()))

    step("publish", lambda: store.publish("a", {"region": t}) or "published")
    step("publish again", lambda: store.publish("a", {"region": t}) or "unchanged")
    step("publish other", lambda: store.publish("a", {"region": other}))
    store.publish("b", {"region": other})
    store.publish("c", {"region": other})
    head = lambda expected, to: (store.compare_and_set("r", expected, to), ":".join(map(str, reversed(store.head("r")))))[1]
    step("head", lambda: head(None, "a"))
    step("head again", lambda: head("x", "a"))
    step("head stale", lambda: head("x", "b"))
    step("head next", lambda: head("a", "b"))
    step("sweep", lambda: ",".join(store.sweep(set())))
    return spark.createDataFrame(out, "step string, outcome string, rows long")


@query("text, state", [("alpha", "sound"), ("beta", "sound"), ("", "sound"), (None, "missing"), (None, "corrupt")])
def blob_store(spark, d):
    """Bytes by digest: stored once, read back, held against digest and length."""
    store = Store(spark, _folder(spark))
    blobs = Blobs(store)
    rows = spark.createDataFrame([(bytearray(b"alpha"),), (bytearray(b"beta"),), (bytearray(b""),), (bytearray(b"alpha"),), (None,)], "b binary")
    known = blobs.put(rows, "b")
    blobs.put(rows, "b")
    spark.createDataFrame([("f" * 64, 3, bytearray(b"abc"))], "sha256 string, byte_length long, bytes binary").write.parquet(f"{store.root}/blobs/{uuid.uuid4().hex}")
    wanted = known.select("sha256").unionByName(spark.createDataFrame([("0" * 64,), ("f" * 64,)], "sha256 string"))
    return blobs.get(wanted).select(F.decode("bytes", "UTF-8").alias("text"), "state")


@query("path, body", [("index.md", "# new\n"), ("a/b.md", "text\n")])
def published_documents(spark, d):
    """Generated documents that took the place of those published before."""
    store = Store(spark, _folder(spark))
    publish_documents(store, "docs", spark.createDataFrame([("index.md", "# old\n"), ("gone.md", "x")], "path string, body string"))
    return publish_documents(store, "docs", spark.createDataFrame([("index.md", "# new\n"), ("a/b.md", "text\n")], "path string, body string"))


@query("entry_id, payload, sound", [(hashlib.sha256(b"k1").hexdigest(), "p1", True), (hashlib.sha256(b"k2").hexdigest(), "p2", True), ("forged", "p3", False)])
def staged_cache(spark, d):
    """Cache entries staged twice are there once; one whose id its key does not give is not sound."""
    store = Store(spark, _folder(spark))
    rows = spark.createDataFrame([("k1", "p1", None), ("k2", "p2", None), ("k3", "p3", "forged")], "key string, payload string, forged string")
    entries = rows.select(F.coalesce("forged", F.sha2("key", 256)).alias("entry_id"), "key", "payload")
    stage_cache(store, entries.where("key <> 'k2'"))
    return self_consistent(stage_cache(store, entries), F.sha2("key", 256)).select("entry_id", "payload", "sound")


@query("family, rows", [("nation", 25), ("region", 5)])
def portable_round_trip(spark, d):
    """A graph exported as canonical lines and read back under its schema: rows equal to those exported."""
    from lodestrata.operators.store import export

    store = Store(spark, _folder(spark))
    families = {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}
    for name, df in families.items():
        export(df, df.columns[0], f"{store.root}/graph/{name}")
    back = read_portable(store, "graph", {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) for n, df in families.items()})
    out = None
    for name, df in families.items():
        part = back[name].select(*df.columns).intersect(df).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("family"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("relation, n", [("assumptions", 2), ("calls", 1)])
def client_shapes(spark, d):
    """What the Kotlin reader takes for assumptions and calls."""
    rows = contracts.kotlin_assumptions('fun a(p: Map<String, Any?>) = p.getValue("x")\nfun c(payload: Map<String, Any?>) = payload["y"] ?: 1\nfun b() = fetch("/a/$b/c")')
    kinds = {"assumption": "assumptions", "call": "calls"}
    return spark.createDataFrame([(kinds[r[0]],) for r in rows], "relation string").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
