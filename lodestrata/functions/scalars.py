"""Scalar functions of the evidence graph as column expressions; all but NFC stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of every id made here; the digest is SHA-256 of the canonical JSON array of the components.
URN = "urn:lodestrata"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_array(*parts: Column | str) -> Column:
    """The JSON array of strings an id is the digest of; a null component gives null."""
    cols = [_c(p).cast("string") for p in parts]
    return F.when(F.concat(*cols).isNotNull(), F.to_json(F.array(*cols)))


def stable_id(family: str, *parts: Column | str) -> Column:
    """An id that is a pure function of its components."""
    return F.concat(F.lit(f"{URN}:{family}:sha256:"), F.sha2(canonical_array(*parts), 256))


def canonical_json(**members: Column) -> Column:
    """A JSON object with its members in code-point order of their names."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]))


def module_slug(col: Column | str) -> Column:
    """Lower-case ASCII slug of a module id; null for an empty one or one with other characters.

    A leading ``workspace_`` goes, runs of ``_ : -`` become one ``-``, none at the ends.
    """
    bare = F.regexp_replace(F.lower(_c(col)), r"^workspace_", "")
    slug = F.regexp_replace(F.regexp_replace(bare, r"[_:\-]+", "-"), r"^-+|-+$", "")
    return F.when(slug.rlike(r"^[a-z0-9-]+$"), slug)


def markdown_code(col: Column | str) -> Column:
    """Text with the characters that Markdown reads replaced by entities."""
    out = _c(col)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("`", "&#96;"), ("[", "&#91;"), ("]", "&#93;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def squeeze(col: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(_c(col), r"\s+", " "))


def display_signature(declared: Column, visibility: Column, qualifiers: Column, name: Column, parameters: Column, returns: Column) -> Column:
    """The declared signature, else one put together; ``qualifiers`` and ``parameters`` are arrays."""
    built = F.concat(
        F.concat_ws(" ", F.nullif(visibility, F.lit("")), F.nullif(F.concat_ws(" ", qualifiers), F.lit("")), F.concat(F.lit("fn "), name)),
        F.lit("("), F.concat_ws(", ", parameters), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), F.nullif(returns, F.lit(""))), F.lit("")),
    )
    return F.coalesce(declared, built)


def line_column(data: Column, offset: Column) -> Column:
    """struct(line, column) of a byte offset, both from 1; the column counts code points. Null outside or inside a character."""
    head = F.decode(F.substring(data, F.lit(1), offset.cast("int")), "UTF-8")
    whole = is_char_boundary(data, offset)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(head, "\n", -1)) + 1
    return F.when(whole & offset.between(F.lit(0), F.octet_length(data)), F.struct(line.cast("long").alias("line"), column.cast("long").alias("column")))


def is_char_boundary(data: Column, offset: Column) -> Column:
    """Whether a byte offset of UTF-8 data is the start of a character, or the data's end."""
    byte = F.conv(F.hex(F.substring(data, offset.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (offset == F.octet_length(data)) | (byte.bitwiseAND(0xC0) != 0x80)


def byte_offset(text: Column, line: Column, character: Column) -> Column:
    """The byte offset of a (line, character) position, both from 0; null past the text's lines."""
    lines = F.split(text, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line.cast("int")), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    own = F.try_element_at(lines, line.cast("int") + 1)
    return before + F.octet_length(F.substring(own, F.lit(1), character.cast("int")))


def excerpt_lines(text: Column, first: Column, last: Column) -> Column:
    """The lines from ``first`` to ``last``, both included, from 1."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first.cast("int"), (last - first + 1).cast("int")), "\n")


def url_kind(col: Column | str) -> Column:
    """One of nine kinds of a repository URL, by its form."""
    u = _c(col)
    return (
        F.when(u.startswith("./") | u.startswith("../"), "relative")
        .when(u.startswith("/"), "absolute_path")
        .when(u.startswith("file:"), "file")
        .when(u.startswith("ssh:"), "ssh")
        .when(u.startswith("https:"), "https")
        .when(u.startswith("http:"), "http")
        .when(u.startswith("git:"), "git")
        .when(u.rlike(r"^[^/@:\s]+@[^/:\s]+:.+$"), "scp_like")
        .when(u.isNotNull(), "other")
    )


def normal_path(col: Column | str) -> Column:
    """A relative path with ``.`` and ``..`` resolved; null where it leaves its root, is absolute or has a backslash."""
    start = F.array().cast("array<string>")
    parts = F.filter(F.split(_c(col), "/", -1), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts, F.struct(start.alias("p"), F.lit(True).alias("ok")),
        lambda a, p: F.when(p != "..", F.struct(F.array_append(a["p"], p).alias("p"), a["ok"].alias("ok")))
        .otherwise(F.struct(F.when(F.size(a["p"]) > 0, F.slice(a["p"], F.lit(1), F.size(a["p"]) - 1)).otherwise(start).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))),
    )
    return F.when(~_c(col).startswith("/") & ~_c(col).contains("\\") & folded["ok"], F.array_join(folded["p"], "/"))


def pointer_escape(col: Column | str) -> Column:
    return F.replace(F.replace(_c(col), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def is_json_pointer(col: Column | str) -> Column:
    return _c(col).rlike(r"^(/([^~/]|~0|~1)*)*$")


def http_path(col: Column | str) -> Column:
    """A quoted path template with ``$name`` as ``{name}``; null with braces, backslashes or empty segments."""
    bare = F.regexp_extract(_c(col), r'^"(/[^"]*)"$', 1)
    sound = (bare != "") & ~bare.rlike(r"[{}\\]|//") & ((bare == "/") | ~bare.endswith("/"))
    return F.when(sound, F.regexp_replace(bare, r"\$([A-Za-z_][A-Za-z0-9_]*)", "{$1}"))


def integer_literal(col: Column | str) -> Column:
    """struct(sign, radix, digits, suffix) of an integer literal; null for anything else."""
    t = F.lower(F.btrim(_c(col)))
    body = F.regexp_replace(t, r"^-", "")
    suffix = F.regexp_extract(body, r"([iu](?:8|16|32|64|128|size))$", 1)
    core = F.regexp_replace(F.regexp_replace(body, r"([iu](?:8|16|32|64|128|size))$", ""), "_", "")
    radix = F.when(core.startswith("0x"), 16).when(core.startswith("0o"), 8).when(core.startswith("0b"), 2).otherwise(10)
    digits = F.regexp_replace(core, r"^0[xob]", "")
    ok = F.when(radix == 16, digits.rlike("^[0-9a-f]+$")).when(radix == 8, digits.rlike("^[0-7]+$")).when(radix == 2, digits.rlike("^[01]+$")).otherwise(digits.rlike("^[0-9]+$"))
    return F.when(ok, F.struct(F.when(t.startswith("-"), "-").otherwise("+").alias("sign"), radix.cast("int").alias("radix"), digits.alias("digits"), F.nullif(suffix, F.lit("")).alias("suffix")))


#: Widths of the primitive integer types that are evaluated.
WIDTHS = {"i8": 8, "i16": 16, "i32": 32, "i64": 64, "u8": 8, "u16": 16, "u32": 32, "u64": 64}


def in_range(value: Column, primitive: Column) -> Column:
    """Whether a Decimal(38,0) value fits a primitive type of up to 64 bits; null for other types."""
    low = high = F.lit(None).cast("decimal(38,0)")
    for t, w in WIDTHS.items():
        a, b = (-(1 << (w - 1)), (1 << (w - 1)) - 1) if t[0] == "i" else (0, (1 << w) - 1)
        low = F.when(primitive == t, F.lit(str(a)).cast("decimal(38,0)")).otherwise(low)
        high = F.when(primitive == t, F.lit(str(b)).cast("decimal(38,0)")).otherwise(high)
    return value.between(low, high)


_WIDE = "decimal(38,0)"


def _unsigned(primitive: Column) -> Column:
    return primitive.startswith("u")


def _as_bits(x: Column) -> Column:
    """A value of up to 64 bits as the long with the same bits."""
    top = F.lit(str(1 << 63)).cast(_WIDE)
    return F.when(x >= top, x - F.lit(str(1 << 64)).cast(_WIDE)).otherwise(x).cast("long")


def _from_bits(x: Column, primitive: Column) -> Column:
    return F.when(_unsigned(primitive) & (x < 0), x.cast(_WIDE) + F.lit(str(1 << 64)).cast(_WIDE)).otherwise(x.cast(_WIDE)).cast(_WIDE)


def checked(op: str, a: Column, b: Column, primitive: Column) -> Column:
    """``a op b`` as Decimal(38,0); null on overflow of the type, division by zero or an unknown operator.

    Operators are + - * / % and the bitwise & | ^. Division and remainder cut toward zero. Exact for types of
    up to 64 bits.
    """
    x, y = a.cast(_WIDE), b.cast(_WIDE)
    nonzero = F.nullif(y, F.lit(0).cast(_WIDE))
    made = {
        "+": lambda: F.try_add(x, y), "-": lambda: F.try_subtract(x, y), "*": lambda: F.try_multiply(x, y),
        "/": lambda: F.call_function("div", x, nonzero), "%": lambda: F.try_mod(x, nonzero),
        "&": lambda: _from_bits(_as_bits(x).bitwiseAND(_as_bits(y)), primitive), "|": lambda: _from_bits(_as_bits(x).bitwiseOR(_as_bits(y)), primitive),
        "^": lambda: _from_bits(_as_bits(x).bitwiseXOR(_as_bits(y)), primitive),
    }[op]().cast(_WIDE)
    return F.when(in_range(x, primitive) & in_range(y, primitive) & in_range(made, primitive), made)


def negated(a: Column, primitive: Column) -> Column:
    """``-a``; null on overflow, and for unsigned types."""
    made = F.try_subtract(F.lit(0).cast(_WIDE), a.cast(_WIDE)).cast(_WIDE)
    return F.when(~_unsigned(primitive) & in_range(made, primitive), made)


def complement(a: Column, primitive: Column) -> Column:
    """All bits of ``a`` flipped, within its type."""
    x = a.cast(_WIDE)
    top = F.lit(None).cast(_WIDE)
    for t, w in WIDTHS.items():
        top = F.when(primitive == t, F.lit(str((1 << w) - 1 if t[0] == "u" else -1)).cast(_WIDE)).otherwise(top)
    return F.when(in_range(x, primitive), F.try_subtract(top, x).cast(_WIDE))


def import_paths(col: Column | str) -> Column:
    """array<struct(path, alias)> of a use path with at most one brace list: ``a::{b, c as d}``."""
    t = squeeze(F.regexp_replace(_c(col), r"^\s*use\s+|;\s*$", ""))
    prefix = F.when(t.contains("{"), F.regexp_extract(t, r"^([^{]*)\{", 1)).otherwise(F.lit(""))
    inner = F.when(t.contains("{"), F.regexp_extract(t, r"\{([^}]*)\}", 1)).otherwise(t)
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.btrim(p)), lambda p: p != "")
    one = lambda p: F.struct(
        F.when(F.regexp_replace(p, r"\s+as\s+.*$", "") == "self", F.regexp_replace(prefix, "::$", "")).otherwise(F.concat(prefix, F.regexp_replace(p, r"\s+as\s+.*$", ""))).alias("path"),
        F.nullif(F.regexp_extract(p, r"\s+as\s+(\w+)$", 1), F.lit("")).alias("alias"),
    )
    return F.transform(parts, one)


def scip_symbol(col: Column | str) -> Column:
    """struct(scheme, manager, package, version, descriptors, local) of a compiler index symbol."""
    s = _c(col)
    part = lambda i: F.nullif(F.regexp_extract(s, r"^(\S*) (\S*) (\S*) (\S*) (.*)$", i), F.lit(""))
    return F.struct(part(1).alias("scheme"), part(2).alias("manager"), part(3).alias("package"), part(4).alias("version"), part(5).alias("descriptors"), s.startswith("local ").alias("local"))


def feature_member(col: Column | str) -> Column:
    """struct(kind, dependency, feature, weak) of a feature's member: ``dep:x``, ``x/f``, ``x?/f`` or a feature."""
    m = _c(col)
    return (
        F.when(m.startswith("dep:"), F.struct(F.lit("dependency").alias("kind"), F.substring(m, 5, 1 << 20).alias("dependency"), F.lit(None).cast("string").alias("feature"), F.lit(False).alias("weak")))
        .when(m.contains("/"), F.struct(F.lit("dependency_feature").alias("kind"), F.regexp_extract(m, r"^([^/?]*)\??/", 1).alias("dependency"), F.regexp_extract(m, r"/(.*)$", 1).alias("feature"), m.contains("?/").alias("weak")))
        .otherwise(F.struct(F.lit("feature").alias("kind"), F.lit(None).cast("string").alias("dependency"), m.alias("feature"), F.lit(False).alias("weak")))
    )


def visibility(col: Column | str) -> Column:
    """The visibility a declaration's text begins with: public, restricted:..., or private."""
    t = F.btrim(_c(col))
    scope = F.regexp_extract(t, r"^pub\s*\(([^)]*)\)", 1)
    return F.when(scope != "", F.concat(F.lit("restricted:"), squeeze(scope))).when(t.rlike(r"^pub\b"), "public").otherwise("private")


def receiver(col: Column | str) -> Column:
    """How a method's text takes its receiver: value, shared_reference, mutable_reference, typed, or none."""
    first = F.btrim(F.regexp_extract(_c(col), r"\bfn\s+\w+(?:<[^(]*>)?\s*\(([^,)]*)", 1))
    return (
        F.when(first.rlike(r"^&\s*(?:'\w+\s+)?mut\s+self$"), "mutable_reference").when(first.rlike(r"^&\s*(?:'\w+\s+)?self$"), "shared_reference")
        .when(first.rlike(r"^(?:mut\s+)?self$"), "value").when(first.rlike(r"^(?:mut\s+)?self\s*:"), "typed").otherwise("none")
    )


def abi(col: Column | str) -> Column:
    """The binary interface that a function's text names: C where ``extern`` names none; null without ``extern``."""
    head = F.regexp_extract(_c(col), r"^(.*?)\bfn\b", 1)
    named = F.regexp_extract(head, r'\bextern\s*"([^"]*)"', 1)
    return F.when(named != "", named).when(head.rlike(r"\bextern\b"), "C")


def is_constructor(col: Column | str) -> Column:
    """Whether a call's last path segment is spelled like a type or variant."""
    return F.element_at(F.split(_c(col), "::"), -1).rlike("^[A-Z]")


#: The role bits of an occurrence in a compiler index.
ROLE_BITS = {"definition": 1, "import": 2, "write": 4, "read": 8, "generated": 16}


def symbol_roles(col: Column) -> dict[str, Column]:
    """Which roles the bits of an occurrence give it."""
    return {n: col.bitwiseAND(F.lit(b)) != 0 for n, b in ROLE_BITS.items()}


def rfc3339(seconds: Column) -> Column:
    """Epoch seconds as an RFC 3339 time in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def nfc(col: Column | str) -> Column:
    """Text in composed form; ASCII never reaches Python's side of the conversion."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    c = _c(col)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(composed(c))


def is_safe_path(col: Column | str) -> Column:
    """A canonical relative path: no empty, ``.`` or ``..`` part, no backslash, no control character."""
    p = _c(col)
    return (p != "") & ~p.rlike(r"[\\\x00-\x1f\x7f]") & ~F.exists(F.split(p, "/", -1), lambda x: x.isin("", ".", ".."))


def is_object_id(col: Column | str) -> Column:
    return _c(col).rlike(r"^[0-9a-f]{40}$")


def is_path_template(col: Column | str) -> Column:
    return _c(col).rlike(r"^(/([A-Za-z0-9._~-]+|\{[A-Za-z_][A-Za-z0-9_]*\}))+$|^/$")


def is_operation_name(col: Column | str) -> Column:
    return _c(col).rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*$")


def is_authority(col: Column | str) -> Column:
    """A lower-case host with an optional port."""
    return _c(col).rlike(r"^[a-z0-9]([a-z0-9.-]*[a-z0-9])?(:[0-9]{1,5})?$")


#: The eleven legal transitions of a claim's state.
TRANSITIONS = [
    ("deterministic_fact", "superseded"), ("derived_fact", "superseded"), ("confirmed", "superseded"), ("rejected", "superseded"),
    ("candidate", "reviewed_inference"), ("candidate", "confirmed"), ("candidate", "rejected"), ("candidate", "superseded"),
    ("reviewed_inference", "confirmed"), ("reviewed_inference", "rejected"), ("reviewed_inference", "superseded"),
]


def is_transition(source: Column, target: Column) -> Column:
    return F.concat_ws(">", source, target).isin([f"{a}>{b}" for a, b in TRANSITIONS])
