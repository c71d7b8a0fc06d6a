import ast
import json
import os
import pathlib
import tomllib

import pytest

from lodestrata.llm import syntax as S

RUST = '''//! A crate
#![allow(dead_code)]
use std::{fmt, collections::{BTreeMap as Map, *}};
pub(crate) const N: [u8; 2] = [b'{', 0xF_u8];
static mut S: &str = r#"{"a": [1"#;
macro_rules! add { ($x:expr, $($y:tt)*) => { $x + 1 }; () => {}; }
#[derive(Clone, Debug)]
pub struct P<'a, T: Clone + 'a> where T: Sized { pub x: Vec<Option<&'a T>>, #[serde(default)] y: fn(u8) -> u8 }
struct U(pub u8, String);
struct Z;
pub enum E { A, B(u8), C { x: i32 } = 3, }
pub trait T0: Send { const K: usize = 1; type O; fn go(&self, n: &mut u8) -> Self::O; fn d(self) {} }
impl<'a, T: Clone> P<'a, T> {
    pub const fn new(x: u64) -> Result<Self, Box<dyn fmt::Display>> { todo!() }
    async unsafe fn f(&mut self, (a, b): (u8, u8), _: &[u8]) -> impl Iterator<Item = u8> + '_ {
        let mut total = 0u64; /* a /* nested { */ b */
        let c = |x: u64| -> u64 { x.wrapping_mul(7) };
        let chars = ['(', '\\'', '"', '\\u{1F600}'];
        'outer: for (i, v) in self.x.iter().enumerate() { if i > 3 && v.is_some() { continue 'outer; } else if let Some(q) = v { total += *q as u64; } else { break; } }
        let Some(z) = Some(1) else { return Err("no } {".to_owned())?; };
        match total % 3 { 0 => total += 1, 1 | 2 if z > 1 => {} x @ 3..=5 => { drop(x) } _ => unreachable!(), }
        while total < 10 { total <<= 1; }
        let s = Q { a: 1, ..Default::default() };
        let v = vec![1, 2, 3]; let t = (1, "a",); let e = &v[1..]; let r = ..5;
        loop { break }
        unsafe { *p = -1; }
        println!("{} {x}", total, x = 1);
        if a == b { 1 } else { 2 };
        (0..5).map(move |x| x * 2).filter(|&y| y != 3).collect::<Vec<_>>()
    }
}
extern "C" { fn ext(x: i32); }
type A<T> = Map<String, T>;
mod inner { pub use super::*; fn x() where u8: Copy {} }
fn empty() {}
'''

KOTLIN = '''@file:JvmName("X")
package org.sample.a
import org.sample.b.C as D
import org.sample.e.*
/* outer /* nested { */ */
const val K = 0x1F
data class A(val id: Long, var label: String? = "x {", private val m: Map<String, List<Int>> = mapOf()) : Base(1), I {
    companion object { const val LIMIT = 3; val mark = '}' }
    init { require(id > 0) { "bad ${id + 1} ${m["k"]} (" } }
    override fun toString(): String = "A($id, ${label ?: "none"})"
    val size: Int
        get() = label!!.length
}
sealed interface I
enum class E(val n: Int) { ONE(1), TWO(2); fun f() = n }
object O { val t = """raw "quotes" ${K} { """ }
fun <T : Any> List<T>.second(): T? {
    val n = size - 1
    if (n < 1) return null else println("x")
    for (i in 0 until n step 2) { println(i) }
    when (n) { 1 -> return this[0]; in 2..5 -> {} else -> Unit }
    val r = listOf(1, 2).map { it * 2 }
        .filter { x -> x > 1 }
    while (true) { break }
    try { f() } catch (e: Exception) { throw e } finally { g() }
    return if (r.isEmpty()) null else this as? T
}
fun loadIt(payload: Map<String, Any?>): String {
    val count = payload.size + 42
    if (count > 91) {
        println("got ${payload["window"]} (")
    }
    return payload.getValue("validator").toString() // uniform }
}
'''
TOML = "[a]\nb = \"x\" # [\nc = '''\n[no\n'''\nd = { e = [1, 2] }\n[[f]]\n"
PY = 'import x\n\ndef f(a, *b):\n    """doc {"""\n    return f"{a!r:>{3}}" + r\'\\d(\' # (\n\nx = {\n  1: [2],\n}\n'
JSON = '{"a": [1, -2.5e3, "x\\u00e9{["], "b": {}, "c": null}'


@pytest.mark.parametrize("lang,text", [("rust", RUST), ("kotlin", KOTLIN), ("toml", TOML), ("python", PY), ("json", JSON), ("rust", ""), ("kotlin", ""), ("python", ""), ("toml", ""), ("rust", RUST.replace("\n", "\r\n")), ("kotlin", KOTLIN.replace("\n", "\r\n")), ("json", " 3 ")])
def test_valid_texts(lang, text):
    assert S.fault(text, lang) is None


VALID_RUST = [
    'fn a() -> Self { Self { a, } }',
    'fn a() -> Self { Self { a: 1, } }',
    'fn a() { let x = B { a: c.collect::<Result<_, _>>()?, }; }',
    'fn a() { let x = Foo { a: x < y, b: z > w, }; }',
    'fn a() { match x { A => c.collect::<HashMap<_, _>>(), B => d, } }',
    'fn a() { let v = if let Some(x) = self.path { x } else { y }; }',
    'fn a() { if match x { A => true, _ => false } { b } }',
    'fn a() { let x = <T as Tr<A, B>>::f(1, 2); let z = a as Map<K, V>; }',
]
VALID_KOTLIN = [
    'fun interface F { fun x() }',
    'fun a() { run label@{ 1 } }',
    'fun a() { outer@ for (i in 1..2) { break@outer } }',
    'fun a(x: Int): Int { return when (x) { 1, 2 -> 3\n in 3..4 -> { 5 }\n is Int -> 6\n !in a -> 7\n else -> if (x > 1) 2\n else 3 } }',
    'val f: (Int) -> Int = { x: Int -> x + 1 }',
    'val g = { a, (b, c) -> a + b }',
    'fun a() { x.let { it -> y(it) }\n z.map { (k, v) -> k to v } }',
    'val x by lazy { 1 }',
    'fun a() = listOf(1).forEach { f: (Int) -> Int -> f(1) }',
    'class A<out T : Any>(val x: T) where T : B { constructor() : this(1) { x() } }',
    'fun a() { val x = object : B(1), C { override fun y() {} } }',
    'fun a() { return@foo 1 }',
    'fun a() { if (x) y else z\n val q = if (a) b\n else c }',
    'inline fun <reified T> a(crossinline b: () -> T): T = b()',
    'fun a() { x?.y?.z ?: return\n a!!.b()\n val (c, d) = e }',
    'annotation class A\n@A @B(1) class C',
    'enum class E { A { override fun f() = 1 }, B; abstract fun f(): Int }',
    'val x: Int get() = 1\nvar y = 1\n private set',
    'fun a() { when { x > 1 -> y()\n else -> z() } }',
    'fun a() { do { x() } while (y) }',
    'typealias X = Map<String, Int>',
    'fun A.b(c: D.() -> Unit = {}) = apply { c() }',
    'fun a() { x[1] = 2; x += 3; i++\n --j }',
    'fun a() { val s = "a${if (b) "c" else "d"}" }',
    'fun a() { try { b() } catch (e: E) { } finally { } }',
    'fun a() { a shl 2 or 3; x in y; x !is Z; x as? W }',
    'object A : B by c',
    'interface X { val a: Int; fun b() = 1 }',
    'fun a() { foo(::bar, A::class.java, *args, b = 1) }',
    'val x = fun(a: Int): Int { return a }',
    'fun a() { listOf(1)\n .map { it }\n // c\n .filter { true } }',
    'fun a() { val x = when (val y = z()) { is A -> y.b\n "q" -> { }\n null -> throw E("x") } }',
    'class A { init { x() }\n companion object { val y = 1 } }',
    'fun a() { if (x) { 1 } else if (y) { 2 } else { 3 } }',
    'fun a() { x = { 1 }() }',
    'fun <T> a() where T : B, T : C { }',
    'fun a() { throw X("y") }',
    'fun a() { while (x) y() }',
    'suspend fun a() = coroutineScope { launch { b() } }',
    'fun a() { return this@A.x }',
    'class A { var x: Int = 1\n get() = field\n set(value) { field = value } }',
    'fun a() { when (x) { 1 -> { } 2 -> { } else -> { } } }',
    'fun a() { when (x) { A.B -> return 1; else -> { } } }',
    'fun a() = when (x) { is A -> b\n  .c()\n else -> d }',
    'fun a() { x.map { val f: (Int) -> Int = g\n f(it) } }',
    'fun a() { buildList { if (a) { b } } }',
    'fun a() { when (x) { 1 -> if (y) 2 else 3\n else -> 4 } }',
    'fun a() { when (x) { 1 ->\n foo()\n else ->\n bar() } }',
    'fun a() { f(*a, b = *c) }',
    'fun a() { try { } catch (_: E) { } }',
    'fun a() { x.forEach inner@{ if (it) return@inner } }',
    'fun a() { val r = a < b && c > d }',
    'fun a() { x ?: error("y") }',
    'fun a() { val a: List<Map<K, V?>>? = null }',
    'fun a() { when (x) { in 1..2, !in b -> c\n is A, is B -> d\n else -> Unit } }',
    'fun a() { when (x) { is A if y > 1 -> 2\n else -> 3 } }',
    'fun a(vararg x: Int, b: (A, B) -> Unit) {}',
    'fun a() { val x = a as List<B> }',
    '@Test fun `a b c`() { }',
    'data object A',
    'value class A(val x: Int)',
    'fun a() { for ((k, v) in m) { } ; for (i in 10 downTo 1 step 2) x() }',
]


@pytest.mark.parametrize("lang,text", [("rust", t) for t in VALID_RUST] + [("kotlin", t) for t in VALID_KOTLIN])
def test_valid_forms(lang, text):
    assert S.fault(text, lang) is None


@pytest.mark.parametrize("text", [
    "fun a() { when (x) { 1 -> } }", "fun a() { when (x) { 1 2 -> 3 } }", "fun a() { x.map { a -> b c } }", "fun a() { if (x) { y -> 1 + } }", "fun a() { when (x) { 1 -> a\n b } }",
    "fun a() { when (x) { -> 1 } }", "fun a() { when (x) { 1, -> } }", "class A { val x: Int get() }", "fun a() { return@ }",
])
def test_faults_in_branches_lambdas_and_accessors(text):
    assert S.fault(text, "kotlin")


def test_a_folder_of_valid_sources_has_no_finding():
    """VALID_SOURCES names a folder whose Rust and Kotlin files are known to compile; they are read as text."""
    folder = os.environ.get("VALID_SOURCES")
    if not folder:
        pytest.skip("VALID_SOURCES is not set")
    found = {str(p): S.fault(p.read_text(), S.EXTENSIONS[p.suffix[1:]]) for p in pathlib.Path(folder).rglob("*") if p.suffix in (".rs", ".kt") and p.is_file()}
    assert found and not {p: f for p, f in found.items() if f}


CONFLICT = "<<<<<<< ours\n{a}\n=======\n{b}\n>>>>>>> theirs\n"


@pytest.mark.parametrize("lang,text", [
    ("rust", RUST[:-40] + "fn x("), ("rust", RUST + "fn y"), ("rust", RUST + "let x = 5;"), ("rust", "fn a() { let x = 5 }"), ("rust", "fn a() { foo bar; }"), ("rust", "fn a() { if x > 1 }"), ("rust", "fn a() { x + ; }"), ("rust", 'const A: &str = "x'), ("rust", 'const A: &str = r#"x"'), ("rust", "/* /* */"),
    ("rust", "pub struct A { x: u8 y: u8 }"), ("rust", "use a::;"), ("rust", "Some prose here."), ("rust", PY), ("rust", JSON), ("rust", TOML), ("rust", KOTLIN), ("rust", CONFLICT.format(a="fn a() {}", b="fn b() {}")), ("rust", "fn a() { match x { 1 2 => 3 } }"), ("rust", "}"), ("rust", "fn a(x) {}"),
    ("kotlin", KOTLIN[:-30]), ("kotlin", KOTLIN + "fun tuple"), ("kotlin", RUST), ("kotlin", PY), ("kotlin", JSON), ("kotlin", TOML), ("kotlin", "The gap stays open until it ends"), ("kotlin", 'val a = "x'), ("kotlin", 'val a = "${b"'), ("kotlin", "class A(val x Long)"), ("kotlin", "fun f() { a b }"), ("kotlin", CONFLICT.format(a="val a = 1", b="val a = 2")),
    ("python", "def f(:\n"), ("python", "x = (1"), ("python", "x = '''a"), ("python", "def f():\n"), ("python", RUST), ("python", CONFLICT.format(a="x = 1", b="x = 2")),
    ("json", ""), ("json", "{"), ("json", '{"a": 1,}'), ("json", "{'a': 1}"), ("json", '{"a": NaN}'), ("json", '{"a" 1}'), ("json", "1 2"), ("json", CONFLICT.format(a="{}", b="{}")), ("json", '["a\nb"]'), ("json", "01"),
    ("toml", "a = "), ("toml", "a = 'x"), ("toml", "a = 1\na = 2"), ("toml", "prose here"), ("toml", "[a"), ("toml", CONFLICT.format(a="a = 1", b="a = 2")),
])
def test_invalid_texts(lang, text):
    assert S.fault(text, lang)


def test_markers_inside_literals_and_comments_are_text():
    assert S.fault('const A: &str = r##"' + CONFLICT + '"##;\n', "rust") is None
    assert S.fault("/*\n" + CONFLICT + "*/\nfn a() {}\n", "rust") is None
    assert S.fault('val a = """\n' + CONFLICT + '"""\n', "kotlin") is None
    assert S.fault('A = """\n' + CONFLICT + '"""\n', "python") is None
    assert S.fault("a = '''\n" + CONFLICT + "'''\n", "toml") is None


def test_every_truncation_of_a_text_agrees_with_the_exact_parser():
    def ok(f, t):
        try:
            f(t)
            return True
        except (ValueError, SyntaxError):
            return False

    for lang, text, parse in (("json", JSON, json.loads), ("toml", TOML, tomllib.loads), ("python", PY, ast.parse)):
        for i in range(len(text)):
            assert (S.fault(text[:i], lang) is None) == ok(parse, text[:i]), (lang, text[:i])


def test_truncated_rust_is_found_wherever_a_group_is_open():
    body = RUST[RUST.index("impl<'a") : RUST.index('extern "C"')]
    for i in range(10, len(body) - 3, 7):
        assert S.fault(body[:i], "rust"), body[:i][-40:]


def test_faults_on_spark(spark):
    rows = [(1, "a/B.RS ", "fn a() {}"), (2, "a.rs", "fn"), (3, "a.rs", None), (4, "a.txt", "x"), (5, None, "x"), (6, "b.json", ""), (7, "b.json", "1"), (8, "noext", "x"), (9, "c.kt", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id int, p string, t string, fault string")
    got = {r["file_id"]: r["fault"] is not None for r in S.syntax_faults(df, ["file_id"], "p", "t").collect()}
    assert got == {1: False, 2: True, 6: True, 7: False, 9: False}
    assert S.syntax_faults(df.limit(0), ["file_id"], "p", "t").count() == 0
