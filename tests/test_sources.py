import hashlib
import os
import struct
import zlib

from lodestrata.sources import constants, contracts, git, manifests, rust, scip

RUST = '''
use crate::a::{B, c as d};
const BASE: u32 = 2 + 3 * 4;
const NEXT: u32 = BASE - 5;
const LOOP_A: u8 = LOOP_B;
const LOOP_B: u8 = LOOP_A;
const BIG: u8 = 200 + 100;
#[derive(Clone)]
pub struct P<T> { pub x: u64, y: Vec<u8> }
#[repr(u8)]
pub enum M { Off, Warm = 3, Hot }
enum Free { One, Two }
#[repr(i8)]
enum Far { Near, Over = 127, Past }
trait T0 { fn go(&self); }
impl T0 for P<u8> { fn go(&self) { helper(1); } }
fn helper(a: u64) -> u64 {
    let mut total = a;
    if a > 3 { total = total + 1; } else { total = 0; }
    let café = total;
    café
}
fn looping() { for i in 0..3 { println!("{}", i); } }
'''


def facts(text):
    return [dict(zip(rust.Facts.COLUMNS, r)) for r in rust.extract(text)]


def test_rust_declarations_and_members():
    f = facts(RUST)
    names = lambda k: [x["name"] for x in f if x["kind"] == k]
    assert names("rust.import") == ["crate::a::B", "crate::a::c"] and names("rust.field") == ["x", "y"] and names("rust.enum_variant") == ["Off", "Warm", "Hot", "One", "Two", "Near", "Over", "Past"]
    assert names("rust.function") == ["helper", "looping"] and names("rust.method") == ["go", "go"] and names("rust.parameter") == ["&self", "&self", "a"]
    assert [x["detail"] for x in f if x["kind"] == "rust.callable_signature"][2] == "fn helper(a: u64) -> u64"
    span = next(x for x in f if x["kind"] == "rust.expression" and x["name"] == "café")
    assert RUST.encode()[span["start_byte"] : span["end_byte"]].decode() == "café"
    assert [x["visibility"] for x in f if x["kind"] == "rust.method"][1] == "inherited_trait"


def test_rust_flow_blocks():
    f = facts(RUST)
    own = next(x["local_id"] for x in f if x["kind"] == "rust.function" and x["name"] == "helper")
    blocks = [x["name"] for x in f if x["kind"] == "rust.syntax_basic_block" and x["owner"] == own]
    arcs = {(x["ordinal"], int(x["detail"]), x["name"]) for x in f if x["kind"] == "flow_edge" and x["owner"] == own}
    assert blocks == ["entry", "condition", "then_branch", "else_branch", "join"]
    assert arcs == {(0, 1, "SYNTAX_NEXT"), (1, 2, "SYNTAX_TRUE_BRANCH"), (1, 3, "SYNTAX_FALSE_BRANCH"), (2, 4, "SYNTAX_NEXT"), (3, 4, "SYNTAX_NEXT")}
    assert any(x["kind"] == "gap" and x["name"] == "rust.local_flow_unsupported" for x in f)
    assert facts("fn x( {") == [{**dict.fromkeys(rust.Facts.COLUMNS, ""), "kind": "gap", "local_id": "gap@0-7", "name": "rust.malformed_source", "ordinal": None, "start_byte": 0, "end_byte": 7}]
    assert rust.extract(None) == [] and rust.extract("") == []


def test_flow_queries_on_a_fixture(spark, tmp_path):
    from lodestrata.plans import extraction as E

    d = str(tmp_path)
    spark.createDataFrame([(1, "src/a.rs", RUST), (2, "src/b.rs", None), (3, "src/c.rs", "")], "file_id long, canonical_source_path string, source_text string").write.parquet(f"{d}/source_files.parquet")
    pairs = {(r["source"], r["target"]) for r in E.rust_flow_reaches(spark, d).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 4), (3, 4)}
    t = E._whole(spark, d)
    start = {r["id"]: RUST.encode()[r["start_byte"] :][:24].decode() for r in t.collect()}
    reach = {(start[r["read_id"]][:5], start[r["definition_id"][:-1]][:9], r["mode"]) for r in E.rust_reaching_definitions(spark, d).collect()}
    assert ("total", "total = t", "may") in reach and ("total", "total = 0", "may") in reach and ("a > 3", "a: u64) -", "must") in reach and ("total", "total = a", "must") in reach
    why = {start[r["read_id"]][:12]: r for r in E.rust_read_derivations(spark, d).collect()}
    tail = next(r for k, r in why.items() if k.startswith("total;") and len(r["definitions"]) == 2)
    assert tail["start_block"] == 1 and tail["blocks"] == [1, 2, 3, 4]
    only = next(r for k, r in why.items() if k.startswith("a > 3"))
    assert only["start_block"] == 0 and only["blocks"] == [0, 1] and len(only["definitions"]) == 1
    values = {r["name"]: r["value"] for r in E.rust_constants(spark, d).collect()}
    assert values == {"BASE": "14", "NEXT": "9", "LOOP_A": None, "LOOP_B": None, "BIG": None, "Off": "0", "Warm": "3", "Hot": "4", "One": None, "Two": None, "Near": None, "Over": None, "Past": None}
    calls = {(r["tier"]) for r in E.rust_calls(spark, d).collect()}
    assert calls == {"exact"}
    kinds = {r["kind"] for r in E.rust_accesses(spark, d).collect()}
    assert kinds == {"READS", "WRITES"}


def test_registrations_and_alternatives(spark, tmp_path):
    from lodestrata.plans import extraction as E

    text = 'fn app() { Router::new().route("/x", get(show)).service(far::away).layer("only"); }\nfn show() {}\n#[get("/y")]\nfn y() {}\nimpl A { #[cfg(unix)] fn go() {} #[cfg(windows)] fn go() {} fn other() {} }\n'
    d = str(tmp_path)
    spark.createDataFrame([(1, "a.rs", text)], "file_id long, canonical_source_path string, source_text string").write.parquet(f"{d}/source_files.parquet")
    got = {(r["role"], r["detail"], r["state"]) for r in E.rust_registrations(spark, d).collect()}
    assert got == {("route", '"/x"|get(show)', "resolved_unique"), ("service", "|far::away", "unresolved_external"), ("layer", '"only"|', "unresolved_external"), ("get", "candidate_unresolved", "unresolved_external")}
    assert [(r["name"], r["alternatives"]) for r in E.rust_alternatives(spark, d).collect()] == [("go", 2)]


def test_constant_rules():
    ev = lambda t, p, **k: constants.evaluate(constants.parse(t), p, k)
    assert ev("1 + 2 * 3 == 7 && !false", "bool") is True and ev("-7 / 2", "i32") == -3 and ev("-7 % 2", "i32") == -1 and ev("!0", "u8") == 255 and ev("0xFF & 0b1010", "u8") == 10 and ev("-128", "i8") == -128
    for text, prim in (("1 / 0", "i8"), ("128", "i8"), ("a", "i8"), ("f(1)", "i8"), ("1", "usize"), ("1 + true", "i8"), ("255 + 1 - 1", "u8")):
        try:
            ev(text, prim)
            raise AssertionError(text)
        except constants.Refused:
            pass


def test_manifests():
    text = '[package]\nname = "a-b"\nversion.workspace = true\n[dependencies]\nserde = { version = "1", optional = true }\nown = { path = "../own" }\nfar = { git = "https://user:secret@host/x" }\nw = { workspace = true }\n[target."cfg(unix)".dev-dependencies]\nlibc = "0.2"\n[features]\ndefault = ["dep:serde", "serde?/std"]\n[[bin]]\nname = "tool"\n'
    f = manifests.manifest_facts(text)
    deps = {x[2]: (x[1], x[3]) for x in f if x[0] == "cargo.dependency"}
    assert deps == {"serde": ("normal", "registry"), "own": ("normal", "path"), "far": ("normal", "git"), "w": ("normal", "workspace"), "libc": ("dev:cfg(unix)", "registry")}
    assert "secret" not in str(f) and f[0][2] == "standalone" and [x[2] for x in f if x[0] == "cargo.feature"] == ["dep:serde", "serde?/std"]
    assert manifests.manifest_facts("[x")[0][2] == "cargo.malformed_manifest"
    assert manifests.conventional_targets(["src/lib.rs", "src/bin/a.rs", "src/bin/b.rs", "src/bin/b/main.rs"], "a-b") == [("lib", "a_b", "src/lib.rs"), ("bin", "a", "src/bin/a.rs"), ("ambiguous", "b", "src/bin/b.rs")]
    g = manifests.gitmodules(b'[submodule "x"]\n\tpath = libs/x\n\turl = ../x.git\n\tbranch = main\n# note\n[submodule "y"]\n path = y\n')
    assert [(m[1], m[2], m[3], m[5]) for m in g] == [("libs/x", "../x.git", 0, ["branch"]), ("y", "", 69, [])]


YAML = """openapi: 3.1.0
info: {title: Users}
paths:
  /users/{id}:
    get:
      operationId: getUser
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


def test_contracts():
    import json

    import yaml

    got = contracts.contract_facts(YAML)
    assert got == contracts.contract_facts(json.dumps(yaml.safe_load(YAML)))
    assert ("operation", "GET", "/users/{id}", "getUser", "", "Users") in got and ("field", "GET", "/users/{id}", "required", "/id", "200:string") in got
    assert ("field", "GET", "/users/{id}", "optional", "/a~1b/deep", "200:integer") in got and ("gap", "GET", "/users/{id}", "contract.media_type_unsupported", "", "text/plain") in got
    bad = {"a: &x 1\nb: *x\n": "alias", "a: 1\na: 2\n": "duplicate_key", "a: !t 1\n": "custom_tag", "a: 1\n---\nb: 2\n": "multiple_documents", "{": "malformed", "openapi: 3.0.0\n": "unsupported_openapi", YAML.replace("#/components/schemas/User", "http://x"): "remote_ref", YAML.replace("required: [id]", "$ref: '#/components/schemas/User'"): "ref_cycle"}
    for text, code in bad.items():
        assert contracts.contract_facts(text)[0][:4] == ("error", "", "", code), text


def test_clients_and_providers():
    k = contracts.kotlin_assumptions('fun a(payload: Map<String, Any?>) { payload.getValue("x"); payload["y"]?.toString(); payload["z"] /* payload.getValue("no") */ }\nfun b() = get("/users/$id")')
    assert k == [("assumption", "a", "x", "requires_present"), ("assumption", "a", "y", "handles_absent"), ("assumption", "a", "z", "unknown"), ("call", "b", "/users/{id}", "")]
    p = contracts.provider_presence('fn f() { m.insert("a", 1); if x { m.insert("b", 2); } else { y(); } // m.insert("c", 1)\n }')
    assert p == [("a", "guaranteed_present"), ("b", "unsupported")]
    assert contracts.provider_presence('if x { m.insert("b", 2); } m.insert("d", {1});') == [("b", "may_be_absent"), ("d", "guaranteed_present")]
    assert contracts.kotlin_assumptions('fun a(p: Map<String, Any?>) = p.getValue("x")') == [("assumption", "a", "x", "requires_present")] and contracts.provider_presence("m.extend(x);") == [("*", "unknown")]


def vint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(n, v):
    return vint(n << 3) + vint(v) if isinstance(v, int) else vint(n << 3 | 2) + vint(len(v)) + v


def test_compiler_index(spark):
    occ = lambda r, sym, roles, outer=(), syntax=15: field(2, field(1, b"".join(map(vint, r))) + field(2, sym.encode()) + field(3, roles) + field(5, syntax) + (field(7, b"".join(map(vint, outer))) if outer else b""))
    doc = field(1, b"src/a.rs") + occ((1, 3, 6), "rust cargo own 1 f().", 1, (1, 0, 9, 1)) + occ((4, 8, 12), "rust cargo far 2 g().", 8) + occ((20, 0, 4), "rust cargo far 2 h().", 8) + field(3, field(1, b"rust cargo own 1 S#") + field(4, field(1, b"rust cargo far 2 T#") + field(3, 1)))
    df = spark.createDataFrame([(bytearray(field(2, doc)),), (bytearray(b"\xff\xff"),), (None,)], "d binary")
    rows = scip.scip_facts(df, "d")
    kinds = sorted(r["kind"] for r in rows.collect())
    assert kinds == ["gap", "occurrence", "occurrence", "occurrence", "relationship", "symbol"]
    assert [(r["owner"], r["symbol"]) for r in scip.reference_owners(rows).collect()] == [("rust cargo own 1 f().", "rust cargo far 2 g().")]


def _loose(root, kind, data):
    raw = f"{kind} {len(data)}\0".encode() + data
    oid = hashlib.sha1(raw).hexdigest()
    p = os.path.join(root, ".git", "objects", oid[:2])
    os.makedirs(p, exist_ok=True)
    with open(os.path.join(p, oid[2:]), "wb") as f:
        f.write(zlib.compress(raw))
    return oid


def _pack(root, objects):
    """A pack of (oid, type number, header extra, body): version 2 with its index."""
    body, offsets = b"PACK" + struct.pack(">II", 2, len(objects)), {}
    for oid, kind, size, extra, data in objects:
        offsets[oid] = len(body)
        first, rest = (kind << 4) | (size & 15), size >> 4
        head = b""
        while rest:
            head += bytes([first | 0x80])
            first, rest = rest & 0x7F, rest >> 7
        body += head + bytes([first]) + (extra(offsets, len(body)) if callable(extra) else extra) + zlib.compress(data)
    oids = sorted(offsets)
    fan = [sum(int(o[:2], 16) <= i for o in oids) for i in range(256)]
    idx = b"\xfftOc" + struct.pack(">I", 2) + struct.pack(">256I", *fan) + b"".join(bytes.fromhex(o) for o in oids) + b"\0" * 4 * len(oids) + struct.pack(f">{len(oids)}I", *[offsets[o] for o in oids])
    folder = os.path.join(root, ".git", "objects", "pack")
    os.makedirs(folder, exist_ok=True)
    for ext, data in ((".pack", body), (".idx", idx)):
        with open(os.path.join(folder, "pack-x" + ext), "wb") as f:
            f.write(data)


def _oid(kind, data):
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()


def test_git_objects(spark, tmp_path):
    root = str(tmp_path / "r")
    base, changed, third = b"line one\n" * 20, b"line one\n" * 20 + b"more\n", b"XX" + b"line one\n" * 20
    delta = vint(len(base)) + vint(len(changed)) + bytes([0x80 | 0x10, len(base)]) + bytes([5]) + b"more\n"
    delta3 = vint(len(base)) + vint(len(third)) + bytes([2]) + b"XX" + bytes([0x80 | 0x10, len(base)])
    ids = [_oid("blob", x) for x in (base, changed, third)]
    back = lambda offsets, at: bytes([at - offsets[ids[0]]]) if at - offsets[ids[0]] < 128 else None
    _pack(root, [(ids[0], 3, len(base), b"", base), (ids[1], 6, len(delta), back, delta), (ids[2], 7, len(delta3), bytes.fromhex(ids[0]), delta3)])
    loose = _loose(root, "blob", b"fn main() {}\n")
    entry = lambda mode, name, oid: f"{mode} {name}\0".encode() + bytes.fromhex(oid)
    sub = _loose(root, "tree", entry("100644", "main.rs", loose) + entry("100644", "n.txt", ids[1]))
    top = _loose(root, "tree", entry("100644", "a.txt", ids[0]) + entry("160000", "nested", "1" * 40) + entry("40000", "src", sub) + entry("100755", "t.sh", ids[2]))
    commit = _loose(root, "commit", f"tree {top}\nauthor a <a> 0 +0000\n\nx\n".encode())
    os.makedirs(f"{root}/.git/refs/heads")
    with open(f"{root}/.git/refs/heads/main", "w") as f:
        f.write(commit + "\n")
    spark.dataSource.register(git.GitObjects)
    got = {r["path"]: r for r in spark.read.format("git_objects").option("path", root).option("revision", "refs/heads/main").option("filesPerTask", "2").load().collect()}
    assert sorted(got) == ["a.txt", "nested", "src/main.rs", "src/n.txt", "t.sh"]
    assert bytes(got["src/n.txt"]["bytes"]) == changed and bytes(got["t.sh"]["bytes"]) == third and got["nested"]["bytes"] is None and got["t.sh"]["mode"] == "100755" and got["a.txt"]["commit_oid"] == commit
    repo = git.Repository(root)
    for bad in ("refs/heads/none", "../x", "0" * 40):
        try:
            repo.read(repo.resolve(bad), "commit")
            raise AssertionError(bad)
        except git.GitError:
            pass
