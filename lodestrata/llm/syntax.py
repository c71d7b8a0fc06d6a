"""Source files that do not parse: language lexers with a pushdown stack.

Each language has a lexer that knows its literals and comments, and a stack of open delimiters. A text is
invalid when a literal or comment does not end, a delimiter is unbalanced, the text ends too early, or a
merge-conflict marker stands outside literals and comments. On the groups that the stack closes, further
checks find what balanced damage leaves: top-level text that is no item of the language, operands without
an operator between them, operators without operand. Python, JSON and TOML, whose parsers are at hand,
are parsed exactly once the lexer has passed them.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language by path extension.
EXTENSIONS = {"rs": "rust", "py": "python", "pyi": "python", "json": "json", "toml": "toml", "kt": "kotlin", "kts": "kotlin"}

CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: |$)|={7}$", re.M)

CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Invalid(Exception):
    """Why a text is not valid: the first fault found."""


class Group:
    """What stands between two delimiters; ``line`` is where it opens, ``close`` where it ends."""

    __slots__ = ("delim", "nodes", "line", "close")

    def __init__(self, delim: str, line: int):
        self.delim, self.nodes, self.line, self.close = delim, [], line, line


class Token:
    __slots__ = ("kind", "text", "line")

    def __init__(self, kind: str, text: str, line: int):
        self.kind, self.text, self.line = kind, text, line


# ---------------------------------------------------------------- lexing


def _conflict(text: str, at: int) -> bool:
    return (at == 0 or text[at - 1] == "\n") and text[at] in "<>=|" and CONFLICT.match(text, at) is not None


#: What tells that a text may hold a conflict marker at all.
MARKERS = ("<<<<<<<", "=======", ">>>>>>>", "|||||||")

RUST_TOKEN = re.compile(
    r"""(?:\s|//[^\n]*+)*+(?:(?P<bc>/\*)|(?P<raw>(?:b|c|br|cr|r)?r(?P<h>\#*)"|(?:r)(?P<h2>\#*)")|(?P<str>[bc]?")"""
    r"""|(?P<chr>b?'(?:[^'\\\n]|\\(?:[nrt0\\'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')|(?P<life>'[^\W\d]\w*)"""
    r"""|(?P<num>\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?\w*|\d\w*)|(?P<id>r\#[^\W\d]\w*|[^\W\d]\w*)"""
    r"""|(?P<op><<=|>>=|\.\.\.|\.\.=|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|::|\.\.|[-+*/%^!&|=<>@.,;:\#$?~])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>\Z))""",
    re.X,
)
RUST_NUM = re.compile(r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?$")

KOTLIN_TOKEN = re.compile(
    r"""(?:\s|//[^\n]*+|\#![^\n]*+)*+(?:(?P<bc>/\*)|(?P<tri>\"{3})|(?P<str>")"""
    r"""|(?P<chr>'(?:[^'\\\n]|\\(?:[tbrn'"\\$]|u[0-9a-fA-F]{4}))')"""
    r"""|(?P<num>\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?[fF]?|\d[\d_]*[eE][+-]?\d+[fF]?|0[xX][\da-fA-F_]+[uUL]*|0[bB][01_]+[uUL]*|\d[\d_]*[uUfFL]*)(?!\w)|(?P<id>[^\W\d]\w*|`[^`\n]+`)"""
    r"""|(?P<op>===|!==|\?\.|\?:|!!|\.\.<|\.\.|->|=>|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|::|[-+*/%!=<>@.,;:?&|])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>\Z))""",
    re.X,
)


def _block_comment(text: str, at: int) -> int:
    """The end of a nested block comment that begins at ``at``."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    raise Invalid("unterminated comment")


RUST_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def rust_tree(text: str) -> list:
    """Tokens of a Rust text as a tree of delimiter groups."""
    root = Group("", 0)
    stack, at = [root], 0
    nodes = root.nodes
    marked = any(m in text for m in MARKERS)
    match = RUST_TOKEN.match
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        at = text.find("\n") if "\n" in text else len(text)
    size = len(text)
    while at < size:
        m = match(text, at)
        if not m:
            rest = text[at:].lstrip()
            raise Invalid("merge conflict" if marked and CONFLICT.match(rest) else f"stray character {rest[:1]!r}")
        kind = m.lastgroup
        if kind == "h" or kind == "h2":
            kind = "raw"
        at, end, tok = m.start(kind), m.end(), m.group(kind)
        if marked and at < size and _conflict(text, at):
            raise Invalid("merge conflict")
        if kind == "id" or kind == "op" or kind == "life":
            nodes.append(Token(kind, tok, at))
        elif kind == "open":
            stack.append(Group(tok, at))
            nodes = stack[-1].nodes
        elif kind == "close":
            if len(stack) == 1 or CLOSERS[stack[-1].delim] != tok:
                raise Invalid(f"unbalanced {tok}")
            g = stack.pop()
            nodes = stack[-1].nodes
            nodes.append(g)
        elif kind == "str":
            s = RUST_STRING.match(text, m.end())
            if not s:
                raise Invalid("unterminated string")
            end = s.end()
            nodes.append(Token("lit", "s", at))
        elif kind == "chr":
            nodes.append(Token("lit", "c", at))
        elif kind == "num":
            if not RUST_NUM.match(tok):
                raise Invalid(f"bad number {tok}")
            nodes.append(Token("lit", tok, at))
        elif kind == "bc":
            end = _block_comment(text, at)
        elif kind == "raw":
            close = '"' + "#" * (tok.count("#"))
            end = text.find(close, m.end())
            if end < 0:
                raise Invalid("unterminated raw string")
            end += len(close)
            nodes.append(Token("lit", "s", at))
        at = end
    if len(stack) > 1:
        raise Invalid(f"unclosed {stack[-1].delim}")
    return root.nodes


def kotlin_tree(text: str) -> list:
    """Tokens of a Kotlin text as a tree; string templates are lexed through the same stack."""
    root = Group("", 0)
    stack: list = [root]
    at, line = 0, 0
    modes: list[str] = []  # for each open template: the kind of string to go back to

    def in_string(at: int, tri: bool) -> tuple[int, bool]:
        """From inside a string to its end, or to the opening of a template (True)."""
        while at < len(text):
            c = text[at]
            if c == "$" and text[at + 1 : at + 2] == "{":
                return at + 2, True
            if tri:
                if text.startswith('"""', at):
                    at += 3
                    while text[at : at + 1] == '"':
                        at += 1
                    return at, False
                at += 1
            elif c == "\\":
                if text[at + 1 : at + 2] not in tuple("tbrn'\"\\$u"):
                    raise Invalid("bad escape")
                at += 2
            elif c == '"':
                return at + 1, False
            elif c == "\n":
                raise Invalid("unterminated string")
            else:
                at += 1
        raise Invalid("unterminated string")

    marked = any(m in text for m in MARKERS)
    while at < len(text):
        m = KOTLIN_TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip()
            raise Invalid("merge conflict" if marked and CONFLICT.match(rest) else f"stray character {rest[:1]!r}")
        kind = m.lastgroup
        start, end, tok = m.start(kind), m.end(), m.group(kind)
        line += text.count("\n", at, start)
        at = start
        if marked and at < len(text) and _conflict(text, at):
            raise Invalid("merge conflict")
        if kind == "bc":
            end = _block_comment(text, at)
        elif kind in ("str", "tri"):
            stack[-1].nodes.append(Token("lit", "s", line))
            end, template = in_string(m.end(), kind == "tri")
            if template:
                stack.append(Group("${", line))
                modes.append(kind)
        elif kind in ("chr", "num"):
            stack[-1].nodes.append(Token("lit", tok, line))
        elif kind in ("id", "op"):
            stack[-1].nodes.append(Token(kind, tok, line))
        elif kind == "open":
            stack.append(Group(tok, line))
        elif kind == "close":
            top = stack[-1]
            if top.delim == "${":
                if tok != "}":
                    raise Invalid(f"unbalanced {tok}")
                stack.pop()
                kotlin_statements(top.nodes)
                mode = modes.pop()
                end, template = in_string(end, mode == "tri")
                if template:
                    stack.append(Group("${", line))
                    modes.append(mode)
            else:
                if len(stack) == 1 or CLOSERS[top.delim] != tok:
                    raise Invalid(f"unbalanced {tok}")
                g = stack.pop()
                g.close = line
                stack[-1].nodes.append(g)
        line += text.count("\n", at, end)
        at = end
    if len(stack) > 1:
        raise Invalid(f"unclosed {stack[-1].delim}")
    return root.nodes


# ---------------------------------------------------------------- Rust structure

RUST_KEYWORDS = set("as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await".split())
RUST_OPERAND_WORDS = {"self", "Self", "super", "crate", "true", "false", "await"}
RUST_ITEMS = {"use", "mod", "fn", "struct", "enum", "trait", "impl", "const", "static", "type", "extern", "pub", "macro_rules", "union"}
#: Macros whose arguments are expressions.
RUST_CALLS = {"println", "print", "eprintln", "eprint", "format", "panic", "vec", "assert", "assert_eq", "assert_ne", "debug_assert", "write", "writeln", "unreachable", "todo", "unimplemented", "matches"}
BINARY_ONLY = {"+", "/", "%", "^", "==", "!=", "<=", ">=", "=>", "=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>=", "@", "?"}


def is_group(n, delim: str) -> bool:
    return isinstance(n, Group) and n.delim == delim


def is_tok(n, *texts: str) -> bool:
    return isinstance(n, Token) and n.text in texts


def split(nodes: list, *seps: str, angles: bool = False) -> list[list]:
    parts: list[list] = [[]]
    depth = 0
    for k, n in enumerate(nodes):
        if angles and isinstance(n, Token) and n.kind == "op":
            depth += (n.text == "<") - (n.text == ">")
        if depth <= 0 and is_tok(n, *seps) and n.kind == "op":
            parts.append([])
        else:
            parts[-1].append(n)
    return parts


def rust_angles(nodes: list, i: int) -> int:
    """The index after the generic arguments that begin at ``i``; ``i`` itself where ``<`` there is a comparison.

    In an expression they begin behind ``::``, behind the type of a cast, and where an operand must come.
    """
    if not is_tok(nodes[i], "<"):
        return i
    prev = nodes[i - 1] if i else None
    opens = prev is None or is_tok(prev, "::") or (isinstance(prev, Token) and (prev.text not in (">", "?") if prev.kind == "op" else prev.text in RUST_KEYWORDS and prev.text not in RUST_OPERAND_WORDS))
    if not opens and isinstance(prev, Token) and prev.kind == "id":
        k = i - 1
        while k >= 2 and is_tok(nodes[k - 1], "::"):
            k -= 2
        opens = k >= 1 and is_tok(nodes[k - 1], "as")
    if not opens:
        return i
    depth = 0
    for k in range(i, len(nodes)):
        if is_tok(nodes[k], "<", ">"):
            depth += 1 if nodes[k].text == "<" else -1
            if not depth:
                return k + 1
    return i


def rust_commas(nodes: list) -> list[list]:
    """The parts of expressions between commas; those between generic arguments separate nothing."""
    parts, start, i = [], 0, 0
    while i < len(nodes):
        if is_tok(nodes[i], ","):
            parts.append(nodes[start:i])
            start = i + 1
        i = max(rust_angles(nodes, i), i + 1)
    return [*parts, nodes[start:]]


def rust_parts(nodes: list, what: str, angles: bool | None = False) -> list[list]:
    """The parts between commas; only the last may be empty. ``angles``: of types; None: of expressions."""
    parts = rust_commas(nodes) if angles is None else split(nodes, ",", angles=angles)
    if not parts[-1]:
        parts.pop()
    if any(not p for p in parts):
        raise Invalid(f"empty {what}")
    return parts


def rust_attributes(nodes: list, i: int) -> int:
    while i < len(nodes) and is_tok(nodes[i], "#"):
        i += 1
        if i < len(nodes) and is_tok(nodes[i], "!"):
            i += 1
        if i >= len(nodes) or not is_group(nodes[i], "["):
            raise Invalid("attribute without brackets")
        first = nodes[i].nodes[:1]
        if not first or not isinstance(first[0], Token) or first[0].kind != "id":
            raise Invalid("empty attribute")
        i += 1
    return i


def rust_generics(nodes: list, i: int) -> int:
    if i < len(nodes) and is_tok(nodes[i], "<"):
        depth = 0
        while i < len(nodes):
            if isinstance(nodes[i], Token) and nodes[i].kind == "op":
                depth += (nodes[i].text == "<") - (nodes[i].text == ">")
            i += 1
            if not depth:
                return i
        raise Invalid("generics do not end")
    return i


def rust_expression(nodes: list) -> None:
    """Operands and operators alternate, in expressions and types alike; groups are checked inside."""
    if not nodes:
        raise Invalid("expression missing")
    state = "op"  # op: an operand must come; end: an operand is complete; any: either
    arms = False
    i = 0
    while i < len(nodes):
        n = nodes[i]
        prev = nodes[i - 1] if i else None
        if isinstance(n, Group):
            if n.delim == "{":
                if arms:
                    rust_arms(n.nodes)
                    arms = False
                elif isinstance(prev, Token) and prev.kind == "id" and (prev.text not in RUST_KEYWORDS or prev.text == "Self") and state == "end" and not _control(nodes[:i]):
                    rust_fields(n.nodes)
                else:
                    rust_block(n.nodes)
                state = "any"
            else:
                if state == "op" or state == "any" or n.delim in "([":
                    for p in ([q for q in split(n.nodes, ",", ";") if q] if n.nodes else []):
                        rust_expression(p)
                    parts = split(n.nodes, ",", ";")
                    if len(parts) > 1 and any(not p for p in parts[:-1]):
                        raise Invalid("empty element")
                state = "end"
        elif n.kind == "lit":
            if state == "end":
                raise Invalid(f"literal after an operand, at {n.line}")
            state = "end"
        elif n.kind == "life":
            state = "any"
        elif n.kind == "id" and (n.text not in RUST_KEYWORDS or n.text in RUST_OPERAND_WORDS):
            if state == "end":
                raise Invalid(f"name after an operand, at {n.line}")
            state = "end"
            if i + 2 < len(nodes) and is_tok(nodes[i + 1], "!") and isinstance(nodes[i + 2], Group):
                if n.text in RUST_CALLS:
                    for p in split(nodes[i + 2].nodes, ",", ";"):
                        if p and n.text != "matches":
                            rust_expression(p)
                i += 2
        elif n.kind == "id":
            w = n.text
            if w == "match":
                arms = True
            if w in ("as", "in", "where"):
                if state == "op":
                    raise Invalid(f"{w} without operand")
                state = "op"
            elif w in ("else", "if"):
                state = "any"
            elif w in ("return", "break", "continue"):
                if state == "end":
                    raise Invalid(f"{w} after an operand")
                state = "any"
            else:
                if state == "end" and w not in ("for", "mut", "const", "unsafe", "async", "extern", "fn", "impl", "dyn"):
                    raise Invalid(f"{w} after an operand")
                state = "any" if w in ("loop", "unsafe", "async", "const", "move", "ref", "mut", "extern", "fn", "dyn", "impl", "for") else "op"
        else:
            t = n.text
            if t in ("=", "=>") and state == "op" and prev is not None and not is_tok(prev, ">"):
                raise Invalid(f"{t} after an operator")
            if t in BINARY_ONLY and state == "op":
                raise Invalid(f"{t} without operand, at {n.line}")
            if t == ".":
                nxt = nodes[i + 1] if i + 1 < len(nodes) else None
                if state == "op" or not (isinstance(nxt, Token) and (nxt.kind == "id" or nxt.kind == "lit")):
                    raise Invalid("dot without a name")
            if t == "::":
                nxt = nodes[i + 1] if i + 1 < len(nodes) else None
                if not (is_group(nxt, "{") or (isinstance(nxt, Token) and (nxt.kind == "id" or nxt.text in ("<", "*")))):
                    raise Invalid("path without a name")
            if t == ";":
                raise Invalid("statement inside an expression")
            if t == "~" or t == "$":
                raise Invalid(f"stray {t}")
            if t == "?":
                state = "end"
            elif t == ">":
                state = "any"
            elif t in ("..", "..=", "|", "||"):
                state = "any"
            elif t == "!":
                state = "any" if state == "op" else "op"
            elif t == "*" and prev is not None and is_tok(prev, "::"):
                state = "end"
            else:
                state = "op"
        i += 1
    if state == "op":
        raise Invalid("expression ends early")


def _control(before: list) -> bool:
    """Whether the brace after these nodes is the block of a control expression, not a struct literal."""
    for n in reversed(before):
        if isinstance(n, Group) and n.delim == "{":
            return False
        if is_tok(n, "if", "while", "for", "match", "in"):
            return True
        if is_tok(n, "->", "let"):
            return True
        if is_tok(n, ";", ",", "=>", "return"):
            return False
    return False


def rust_fields(nodes: list) -> None:
    for p in rust_parts(nodes, "field", angles=None):
        p = p[rust_attributes(p, 0) :]
        if is_tok(p[0], ".."):
            continue
        if not (isinstance(p[0], Token) and p[0].kind in ("id", "lit")) or (len(p) > 1 and not is_tok(p[1], ":")):
            raise Invalid("bad field")
        if len(p) > 1:
            rust_expression(p[2:])


def rust_arms(nodes: list) -> None:
    """Arms of a match: pattern [if guard] => body, separated by commas unless the body is a block."""
    i = 0
    while i < len(nodes):
        i = rust_attributes(nodes, i)
        start = i
        while i < len(nodes) and not is_tok(nodes[i], "=>"):
            if is_tok(nodes[i], ",", ";"):
                raise Invalid("arm without =>")
            i += 1
        if i >= len(nodes) or i == start:
            raise Invalid("arm without =>")
        rust_expression(nodes[start:i])
        i += 1
        if i < len(nodes) and is_group(nodes[i], "{"):
            rust_block(nodes[i].nodes)
            i += 1
            if i < len(nodes) and is_tok(nodes[i], ","):
                i += 1
            continue
        start = i
        while i < len(nodes) and not is_tok(nodes[i], ","):
            i = max(rust_angles(nodes, i), i + 1)
        rust_expression(nodes[start:i])
        i += 1


def _rust_control(nodes: list, i: int) -> int:
    """A control expression that begins a statement at ``i``; the index after it."""
    w = nodes[i].text
    if w in ("loop", "unsafe"):
        i += 1
    else:
        i += 1
        start = i
        inner = 0  # blocks of a match or unsafe that the head itself holds
        while i < len(nodes) and (inner or not is_group(nodes[i], "{")):
            if is_tok(nodes[i], ";"):
                raise Invalid(f"{w} without block")
            inner += is_tok(nodes[i], "match", "unsafe") - is_group(nodes[i], "{")
            i += 1
        head = nodes[start:i]
        if w == "for":
            if not any(is_tok(x, "in") for x in head):
                raise Invalid("for without in")
        elif is_tok(head[0] if head else None, "let"):
            head = head[1:]
        rust_expression(head)
    if i >= len(nodes) or not is_group(nodes[i], "{"):
        raise Invalid(f"{w} without block")
    (rust_arms if w == "match" else rust_block)(nodes[i].nodes)
    i += 1
    if w == "if" and i < len(nodes) and is_tok(nodes[i], "else"):
        i += 1
        if i < len(nodes) and is_tok(nodes[i], "if"):
            return _rust_control(nodes, i)
        if i >= len(nodes) or not is_group(nodes[i], "{"):
            raise Invalid("else without block")
        rust_block(nodes[i].nodes)
        i += 1
    return i


def rust_block(nodes: list) -> None:
    i = 0
    while i < len(nodes):
        n = nodes[i]
        if is_tok(n, ";"):
            i += 1
            continue
        i = rust_attributes(nodes, i)
        if i >= len(nodes):
            raise Invalid("attribute of nothing")
        n = nodes[i]
        if is_tok(n, "let"):
            start = i + 1
            while i < len(nodes) and not is_tok(nodes[i], ";"):
                i += 1
            if i >= len(nodes):
                raise Invalid("let without ;")
            parts = nodes[start:i]
            eq = next((k for k, x in enumerate(parts) if is_tok(x, "=")), None)
            left = parts if eq is None else parts[:eq]
            if not left:
                raise Invalid("let without name")
            for p in split(left, ":"):
                rust_expression(p)
            if eq is not None:
                rust_expression(parts[eq + 1 :])
            continue
        if isinstance(n, Token) and n.kind == "id":
            nxt = nodes[i + 1] if i + 1 < len(nodes) else None
            item = n.text in RUST_ITEMS and not (n.text in ("union", "type") and not (isinstance(nxt, Token) and nxt.kind == "id"))
            item = item and not (n.text == "const" and is_group(nxt, "{")) and not (n.text == "macro_rules" and not is_tok(nxt, "!"))
            if item or (n.text in ("unsafe", "async") and is_tok(nxt, "fn", "impl", "trait", "extern")):
                i = rust_item(nodes, i)
                continue
            if n.text in ("if", "while", "for", "match", "loop") or (n.text == "unsafe" and is_group(nxt, "{")):
                i = _rust_control(nodes, i)
                if i < len(nodes) and is_tok(nodes[i], ".", "?"):
                    start = i
                    while i < len(nodes) and not is_tok(nodes[i], ";"):
                        i += 1
                    rust_expression([Token("lit", "0", 0), *nodes[start:i]])
                continue
        if is_group(n, "{"):
            rust_block(n.nodes)
            i += 1
            continue
        start = i
        while i < len(nodes) and not is_tok(nodes[i], ";"):
            i += 1
        rust_expression(nodes[start:i])


def _name(nodes: list, i: int, what: str) -> int:
    if i >= len(nodes) or not isinstance(nodes[i], Token) or nodes[i].kind != "id" or (nodes[i].text in RUST_KEYWORDS):
        raise Invalid(f"{what} without name")
    return i + 1


def _until(nodes: list, i: int, *ends: str) -> int:
    while i < len(nodes) and not is_tok(nodes[i], *ends):
        i += 1
    if i >= len(nodes):
        raise Invalid(f"missing {ends[0]}")
    return i


def rust_item(nodes: list, i: int) -> int:
    """One item that begins at ``i`` (attributes skipped); the index after it."""
    if is_tok(nodes[i], "pub"):
        i += 1
        if i < len(nodes) and is_group(nodes[i], "(") and nodes[i].nodes and is_tok(nodes[i].nodes[0], "crate", "super", "self", "in"):
            i += 1
    while i < len(nodes) and (
        is_tok(nodes[i], "default", "async", "unsafe")
        or (is_tok(nodes[i], "const") and i + 1 < len(nodes) and is_tok(nodes[i + 1], "fn", "unsafe", "async", "extern"))
        or (is_tok(nodes[i], "extern") and i + 1 < len(nodes) and not is_tok(nodes[i + 1], "crate") and not is_group(nodes[i + 1], "{"))
    ):
        if is_tok(nodes[i], "extern") and i + 1 < len(nodes) and isinstance(nodes[i + 1], Token) and nodes[i + 1].kind == "lit":
            i += 1
        i += 1
        if i < len(nodes) and is_group(nodes[i], "{"):  # extern "C" { ... }
            rust_items(nodes[i].nodes)
            return i + 1
    if i >= len(nodes) or not isinstance(nodes[i], Token) or nodes[i].kind != "id":
        raise Invalid("no item")
    w = nodes[i].text
    nxt = nodes[i + 1] if i + 1 < len(nodes) else None
    if w == "use":
        end = _until(nodes, i, ";")
        rust_use(nodes[i + 1 : end])
        return end + 1
    if w == "mod":
        i = _name(nodes, i + 1, "mod")
        if i < len(nodes) and is_group(nodes[i], "{"):
            rust_items(nodes[i].nodes)
            return i + 1
        return _expect(nodes, i, ";")
    if w == "extern":
        if is_group(nxt, "{"):
            rust_items(nxt.nodes)
            return i + 2
        return _until(nodes, i, ";") + 1
    if w == "fn":
        i = rust_generics(nodes, _name(nodes, i + 1, "fn"))
        if i >= len(nodes) or not is_group(nodes[i], "("):
            raise Invalid("fn without parameters")
        for p in rust_parts(nodes[i].nodes, "parameter", angles=True):
            p = p[rust_attributes(p, 0) :]
            if not any(is_tok(x, ":") for x in p) and not is_tok(p[-1], "self", "..."):
                raise Invalid("parameter without type")
            for q in split(p, ":"):
                rust_expression(q) if not is_tok(q[0] if q else None, "...") else None
        i += 1
        start = i
        while i < len(nodes) and not is_group(nodes[i], "{") and not is_tok(nodes[i], ";"):
            i += 1
        if i >= len(nodes):
            raise Invalid("fn without body")
        head = nodes[start:i]
        if head:
            if not is_tok(head[0], "->", "where"):
                raise Invalid("fn with a bad header")
            if is_tok(head[0], "->") and not any(is_tok(x, "where") for x in head):
                rust_expression(head[1:])
        if is_group(nodes[i], "{"):
            rust_block(nodes[i].nodes)
        return i + 1
    if w in ("struct", "union"):
        i = rust_generics(nodes, _name(nodes, i + 1, w))
        while i < len(nodes) and not is_group(nodes[i], "{") and not is_tok(nodes[i], ";"):
            if is_group(nodes[i], "("):
                for p in rust_parts(nodes[i].nodes, "field", angles=True):
                    rust_field_type(p)
            elif not (is_tok(nodes[i], "where") or any(is_tok(x, "where") for x in nodes[max(0, i - 40) : i])):
                raise Invalid("struct with a bad header")
            i += 1
        if i >= len(nodes):
            raise Invalid("struct without body")
        if is_group(nodes[i], "{"):
            for p in rust_parts(nodes[i].nodes, "field", angles=True):
                p = p[rust_attributes(p, 0) :]
                k = 1 if p and is_tok(p[0], "pub") else 0
                if k < len(p) and is_group(p[k], "("):
                    k += 1
                k = _name(p, k, "field")
                if k >= len(p) or not is_tok(p[k], ":"):
                    raise Invalid("field without type")
                rust_expression(p[k + 1 :])
        return i + 1
    if w == "enum":
        i = rust_generics(nodes, _name(nodes, i + 1, "enum"))
        while i < len(nodes) and not is_group(nodes[i], "{"):
            if not (is_tok(nodes[i], "where") or any(is_tok(x, "where") for x in nodes[max(0, i - 40) : i])):
                raise Invalid("enum with a bad header")
            i += 1
        if i >= len(nodes):
            raise Invalid("enum without body")
        for p in rust_parts(nodes[i].nodes, "variant"):
            k = _name(p, rust_attributes(p, 0), "variant")
            if k < len(p) and isinstance(p[k], Group):
                k += 1
            if k < len(p):
                if not is_tok(p[k], "="):
                    raise Invalid("bad variant")
                rust_expression(p[k + 1 :])
        return i + 1
    if w in ("trait", "impl"):
        start = i + 1
        while i < len(nodes) and not is_group(nodes[i], "{"):
            if is_tok(nodes[i], ";"):
                raise Invalid(f"{w} without body")
            i += 1
        if i >= len(nodes) or i == start:
            raise Invalid(f"{w} without body")
        k = rust_generics(nodes, start)
        if w == "trait":
            k = rust_generics(nodes, _name(nodes, k, "trait"))
        elif k < i and not any(is_tok(x, "where") for x in nodes[k:i]):
            for p in split([x if not is_tok(x, "for") else Token("op", ";", 0) for x in nodes[k:i]], ";"):
                rust_expression(p)
        rust_items(nodes[i].nodes)
        return i + 1
    if w in ("const", "static"):
        i += 1
        if i < len(nodes) and is_tok(nodes[i], "mut"):
            i += 1
        if not (i < len(nodes) and is_tok(nodes[i], "_")):
            _name(nodes, i, w)
        end = _until(nodes, i, ";")
        body = nodes[i + 1 : end]
        if not body or not is_tok(body[0], ":"):
            raise Invalid(f"{w} without type")
        eq = next((k for k, x in enumerate(body) if is_tok(x, "=")), None)
        rust_expression(body[1:eq])
        if eq is not None:
            rust_expression(body[eq + 1 :])
        return end + 1
    if w == "type":
        i = rust_generics(nodes, _name(nodes, i + 1, "type"))
        end = _until(nodes, i, ";")
        if end > i and not is_tok(nodes[i], "=", ":", "where"):
            raise Invalid("bad type")
        if end > i:
            rust_expression(nodes[i + 1 : end])
        return end + 1
    # a macro: path ! [name] group [;]
    while i + 1 < len(nodes) and is_tok(nodes[i + 1], "::"):
        i += 2
    if i + 1 < len(nodes) and is_tok(nodes[i + 1], "!"):
        i += 2
        if i < len(nodes) and isinstance(nodes[i], Token) and nodes[i].kind == "id":
            i += 1
        if i >= len(nodes) or not isinstance(nodes[i], Group):
            raise Invalid("macro without body")
        if w == "macro_rules":
            rust_macro(nodes[i].nodes)
        curly = nodes[i].delim == "{"
        i += 1
        if i < len(nodes) and is_tok(nodes[i], ";"):
            return i + 1
        if not curly:
            raise Invalid("macro without ;")
        return i
    raise Invalid(f"no item: {w}, at {nodes[i].line}")


def rust_field_type(p: list) -> None:
    p = p[rust_attributes(p, 0) :]
    k = 1 if p and is_tok(p[0], "pub") else 0
    if k and k < len(p) and is_group(p[k], "(") and k + 1 < len(p):
        k += 1
    rust_expression(p[k:])


def rust_macro(nodes: list) -> None:
    """Rules of a macro: matcher => transcriber, separated by semicolons."""
    rules = split(nodes, ";")
    if not rules[-1]:
        rules.pop()
    if not rules:
        raise Invalid("macro without rules")
    for r in rules:
        if len(r) != 3 or not isinstance(r[0], Group) or not is_tok(r[1], "=>") or not isinstance(r[2], Group):
            raise Invalid("bad macro rule")


def rust_use(nodes: list) -> None:
    if not nodes:
        raise Invalid("empty use")
    want = True
    for i, n in enumerate(nodes):
        if isinstance(n, Group):
            if n.delim != "{" or not want or i + 1 < len(nodes):
                raise Invalid("bad use")
            for p in rust_parts(n.nodes, "use"):
                rust_use(p)
            return
        if n.kind == "id" and n.text != "as":
            if not want:
                raise Invalid("bad use")
            want = False
        elif n.text == "*" and want and i + 1 == len(nodes):
            return
        elif n.text == "::" or n.text == "as":
            if want and not (n.text == "::" and i == 0):
                raise Invalid("bad use")
            want = True
        else:
            raise Invalid("bad use")
    if want:
        raise Invalid("bad use")


def _expect(nodes: list, i: int, text: str) -> int:
    if i >= len(nodes) or not is_tok(nodes[i], text):
        raise Invalid(f"missing {text}")
    return i + 1


def rust_items(nodes: list) -> None:
    i = 0
    while i < len(nodes):
        if is_tok(nodes[i], ";"):
            i += 1
            continue
        inner = is_tok(nodes[i], "#") and i + 1 < len(nodes) and is_tok(nodes[i + 1], "!")
        i = rust_attributes(nodes, i)
        if i >= len(nodes):
            if inner:
                return
            raise Invalid("attribute of nothing")
        i = rust_item(nodes, i)


# ---------------------------------------------------------------- Kotlin structure

KOTLIN_MODIFIERS = set("public private internal protected open abstract final sealed data enum inner annotation value inline infix operator suspend override lateinit const external tailrec noinline crossinline vararg reified expect actual companion fun".split())
KOTLIN_HARD = set("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias val var when while".split())
KOTLIN_OPERANDS = {"null", "true", "false", "this", "super"}
KOTLIN_DECLARATIONS = {"class", "interface", "object", "fun", "val", "var", "typealias", "init", "constructor"}
KOTLIN_JOIN_NEXT = {".", "?.", "?:", "&&", "||", "->", ":", "::"}


def kotlin_statements(nodes: list, top: bool = False) -> None:
    """Statements or declarations, ended by ; or a line's end where the text can't go on."""
    i = 0
    first = True
    while i < len(nodes):
        if is_tok(nodes[i], ";"):
            i += 1
            continue
        start = i
        i += 1
        while i < len(nodes) and not is_tok(nodes[i], ";"):
            a, b = nodes[i - 1], nodes[i]
            if _last_line(a) != b.line and not _joined(a, b, nodes, start, i):
                break
            i += 1
        kotlin_statement(nodes[start:i], top, first)
        first = False


def _last_line(n) -> int:
    return n.close if isinstance(n, Group) else n.line


def _joined(a, b, nodes: list, start: int, i: int) -> bool:
    """Whether the statement goes on over a line's end between ``a`` and ``b``."""
    if isinstance(b, Token) and (b.text in KOTLIN_JOIN_NEXT or (b.text in ("else", "catch", "finally", "while") and is_group(a, "{"))):
        return True
    if is_tok(b, "else") and any(is_tok(x, "if") for x in nodes[start:i]):
        return True
    if isinstance(a, Group):
        head = nodes[start]
        # if (...) <newline> statement, and a header whose body follows
        return is_group(a, "(") and is_tok(head, "if", "while", "for") and i - start == 2
    if a.kind == "op" and a.text not in ("++", "--", "!!", "?", ">", "*"):
        return True
    if a.text == "else":
        return True
    return start + 1 == i and is_tok(a, "@")


def _annotations(s: list) -> int:
    i = 0
    while i < len(s) and is_tok(s[i], "@"):
        i += 1
        if i >= len(s) or not isinstance(s[i], Token) or s[i].kind != "id":
            raise Invalid("bad annotation")
        i += 1
        while i + 1 < len(s) and is_tok(s[i], ".", ":"):
            i += 2
        if i < len(s) and is_group(s[i], "("):
            i += 1
    return i


def kotlin_statement(s: list, top: bool, first: bool) -> None:
    i = _annotations(s)
    if i >= len(s):
        return
    while i < len(s) and isinstance(s[i], Token) and s[i].text in KOTLIN_MODIFIERS and s[i].text != "fun" and i + 1 < len(s) and isinstance(s[i + 1], Token) and s[i + 1].kind == "id":
        i += 1
    if is_tok(s[i], "fun") and i + 1 < len(s) and is_tok(s[i + 1], "interface"):
        i += 1
    n = s[i]
    w = n.text if isinstance(n, Token) and n.kind == "id" else ""
    if w in ("package", "import"):
        if not top:
            raise Invalid(f"{w} inside")
        kotlin_path(s[i + 1 :], w)
        return
    if w in ("class", "interface", "object"):
        k = i + 1
        if not (w == "object" and k < len(s) and (is_group(s[k], "{") or is_tok(s[k], ":"))):
            if k >= len(s) or not isinstance(s[k], Token) or s[k].kind != "id" or s[k].text in KOTLIN_HARD:
                if not (w == "object" and any(is_tok(x, "companion") for x in s[:i])):
                    raise Invalid(f"{w} without name")
            else:
                k += 1
        k = rust_generics(s, k)
        seen = False
        while k < len(s):
            x = s[k]
            if is_group(x, "("):
                kotlin_parameters(x.nodes, True) if not seen else kotlin_arguments(x.nodes)
            elif is_group(x, "{"):
                if k + 1 != len(s):
                    raise Invalid("text after a body")
                kotlin_statements(x.nodes)
            elif is_tok(x, ":", "where"):
                seen = True
            elif not seen and not (isinstance(x, Token) and x.text in ("private", "internal", "protected", "public", "constructor", "@", "where")):
                raise Invalid(f"{w} with a bad header")
            k += 1
        return
    if w == "fun":
        k = rust_generics(s, i + 1)
        par = next((j for j in range(k, len(s)) if is_group(s[j], "(")), None)
        if par is None or (par == k and top):
            raise Invalid("fun without parameters")
        kotlin_expression(s[k:par]) if par > k else None
        kotlin_parameters(s[par].nodes, False)
        rest = s[par + 1 :]
        body = next((j for j, x in enumerate(rest) if is_group(x, "{") or is_tok(x, "=")), None)
        head = rest if body is None else rest[:body]
        if head:
            if not is_tok(head[0], ":", "where"):
                raise Invalid("fun with a bad header")
            kotlin_expression(head[1:])
        if body is not None:
            if is_tok(rest[body], "="):
                kotlin_expression(rest[body + 1 :])
            else:
                kotlin_statements(rest[body].nodes)
                if body + 1 != len(rest):
                    raise Invalid("text after a body")
        return
    if w in ("val", "var"):
        k = rust_generics(s, i + 1)
        own = next((j for j in range(k + 1, len(s)) if is_tok(s[j], "get", "set") and j + 1 < len(s) and is_group(s[j + 1], "(") and not is_tok(s[j - 1], ".", "?.", "::", "=", ":", "by")), len(s))
        if own < len(s):
            kotlin_accessor(s[own:])
            s = s[:own]
        eq = next((j for j in range(k, len(s)) if is_tok(s[j], "=", "by")), len(s))
        left = s[k:eq]
        if not left:
            raise Invalid("val without name")
        for p in split(left, ":"):
            if not is_group(p[0] if p else None, "("):
                kotlin_expression(p)
        if eq < len(s):
            kotlin_expression(s[eq + 1 :])
        return
    if w == "typealias":
        if not any(is_tok(x, "=") for x in s):
            raise Invalid("bad typealias")
        return
    if w in ("init", "constructor") and not top:
        for x in s[i + 1 :]:
            if is_group(x, "{"):
                kotlin_statements(x.nodes)
        return
    if w in ("get", "set") and i + 1 < len(s) and is_group(s[i + 1], "("):
        kotlin_accessor(s[i:])
        return
    if w in ("get", "set") and i + 1 == len(s):
        return
    if top:
        raise Invalid(f"no declaration: {w or 'text'}, at {n.line}")
    kotlin_expression(s[i:])


def kotlin_accessor(s: list) -> None:
    """get() or set(value) of a property, with its body."""
    body = next((j for j, x in enumerate(s) if is_group(x, "{") or is_tok(x, "=")), None)
    if body is None:
        raise Invalid("accessor without body")
    if is_tok(s[body], "="):
        kotlin_expression(s[body + 1 :])
    else:
        kotlin_statements(s[body].nodes)


def kotlin_path(s: list, what: str) -> None:
    want = True
    for i, n in enumerate(s):
        if not isinstance(n, Token):
            raise Invalid(f"bad {what}")
        if n.kind == "id" and n.text != "as":
            if not want:
                raise Invalid(f"bad {what}")
            want = False
        elif n.text in (".", "as") and not want:
            want = True
        elif n.text == "*" and want and i + 1 == len(s):
            want = False
        else:
            raise Invalid(f"bad {what}")
    if want:
        raise Invalid(f"bad {what}")


def kotlin_parameters(nodes: list, constructor: bool) -> None:
    for p in rust_parts(nodes, "parameter", angles=True):
        k = _annotations(p)
        while k < len(p) and isinstance(p[k], Token) and (p[k].text in KOTLIN_MODIFIERS or p[k].text in ("val", "var")) and k + 1 < len(p) and isinstance(p[k + 1], Token) and p[k + 1].kind == "id":
            k += 1
        if k + 1 >= len(p) or not isinstance(p[k], Token) or p[k].kind != "id" or p[k].text in KOTLIN_HARD or not is_tok(p[k + 1], ":"):
            raise Invalid("bad parameter")
        rest = p[k + 2 :]
        eq = next((j for j, x in enumerate(rest) if is_tok(x, "=")), None)
        kotlin_expression(rest[:eq])
        if eq is not None:
            kotlin_expression(rest[eq + 1 :])


def kotlin_arguments(nodes: list) -> None:
    for p in rust_parts(nodes, "argument"):
        if len(p) > 2 and is_tok(p[1], "=") and isinstance(p[0], Token) and p[0].kind == "id":
            p = p[2:]
        kotlin_expression(p)


def kotlin_expression(s: list) -> None:
    """Operands and operators alternate; two operands may stand side by side only around an infix name."""
    if not s:
        raise Invalid("expression missing")
    state, run = "op", 0  # run: operands in a row without an operator between
    skip = 0
    for i, n in enumerate(s):
        if i < skip:
            continue
        prev = s[i - 1] if i else None
        if isinstance(n, Token) and n.kind == "id" and i + 1 < len(s) and is_tok(s[i + 1], "@"):
            after = s[i + 2] if i + 2 < len(s) else None
            if n.text in ("return", "break", "continue", "this", "super"):
                if not isinstance(after, Token) or after.kind != "id":
                    raise Invalid("label missing")
                state, run, skip = ("any" if n.text == "return" else "end"), (0 if n.text == "return" else 1), i + 3
                continue
            if n.text not in KOTLIN_HARD and (is_group(after, "{") or is_tok(after, "for", "while", "do", "when", "if")):
                skip = i + 2
                continue
        if isinstance(n, Group):
            if n.delim == "{":
                of_when = is_tok(prev, "when") or (is_group(prev, "(") and i > 1 and is_tok(s[i - 2], "when"))
                (kotlin_branches if of_when else kotlin_lambda)(n.nodes)
                state, run = "any", 1
            else:
                if n.delim == "(" and is_tok(prev, "catch"):
                    pass
                elif n.nodes and not (is_tok(prev, "for")):
                    kotlin_arguments(n.nodes)
                elif is_tok(prev, "for") and not any(is_tok(x, "in") for x in n.nodes):
                    raise Invalid("for without in")
                # after if (...), while (...) the statement's body follows
                state = "any" if is_tok(prev, "if", "while", "for", "when", "catch") else "end"
                run = 0 if state == "any" else max(run, 1)
        elif n.kind == "lit" or (n.kind == "id" and (n.text not in KOTLIN_HARD or n.text in KOTLIN_OPERANDS)):
            if state == "end":
                run += 1
                if n.kind == "lit" and (isinstance(prev, Token) and prev.kind == "lit"):
                    raise Invalid(f"literal after a literal, at {n.line}")
                if run % 2 == 0 and n.kind == "lit":
                    raise Invalid(f"literal after an operand, at {n.line}")
            else:
                run = 1
            state = "end"
        elif n.kind == "id" and n.text == "class" and is_tok(prev, "::"):
            state, run = "end", 1
        elif n.kind == "id":
            w = n.text
            if w in ("as", "in", "is"):
                if state == "op" and not (prev is None or is_tok(prev, "!", ",", "->")):
                    raise Invalid(f"{w} without operand")
                state = "op"
            elif w in ("return", "break", "continue"):
                if state == "end":
                    raise Invalid(f"{w} after an operand")
                state = "any"
            elif w in ("else", "do", "try", "when", "object", "fun"):
                state = "any"
            else:
                if state == "end":
                    raise Invalid(f"{w} after an operand")
                state = "op"
            run = 0
        else:
            t = n.text
            if t in ("*", "/", "%", "=", "==", "!=", "===", "!==", "<=", ">=", "&&", "||", "?:", "+=", "-=", "*=", "/=", "%=", ".", "?.", ",", "..") and state == "op" and not (t == "*" and (prev is None or is_tok(prev, "<", ",", "="))):
                raise Invalid(f"{t} without operand, at {n.line}")
            if run % 2 == 0 and run:
                raise Invalid(f"operands without operator, at {n.line}")
            run = 0
            state = {"++": "any", "--": "any", "!!": "end", "?": "any", ">": "any", "*": "any"}.get(t, "op")
    if run and run % 2 == 0:
        raise Invalid(f"operands without operator, at {s[-1].line}")
    if state == "op":
        raise Invalid("expression ends early")


def kotlin_lambda(nodes: list) -> None:
    """A block, or a lambda: parameters up to an arrow, if it has any, then statements."""
    at = 0
    for k, n in enumerate(nodes):
        if is_tok(n, "->"):
            # behind a parameter's type in brackets the arrow is the type's own: { f: (Int) -> Int -> ... }
            part = split(nodes[at:k], ",")[-1]
            if not (len(part) > 2 and is_tok(part[1], ":") and is_group(part[-1], "(") and is_group(nodes[k - 1], "(")):
                kotlin_statements(nodes[k + 1 :])
                return
        elif not (is_group(n, "(") or (isinstance(n, Token) and ((n.kind == "id" and n.text not in KOTLIN_HARD - {"in"}) or n.text in (",", ":", "<", ">", ".", "?", "*")))):
            break
    kotlin_statements(nodes)


def kotlin_branches(nodes: list) -> None:
    """Branches of a when: conditions between commas, an arrow, and one statement or block each."""
    i = 0
    while i < len(nodes):
        if is_tok(nodes[i], ";"):
            i += 1
            continue
        start = i
        while i < len(nodes) and not is_tok(nodes[i], "->"):
            i += 1
        if i >= len(nodes):
            raise Invalid("branch without ->")
        for p in rust_parts(nodes[start:i], "condition", angles=None):
            if is_tok(p[0], "else"):
                p = p[2:] if is_tok(p[1] if len(p) > 1 else None, "if") else p[1:]
                if p:
                    kotlin_expression(p)
                continue
            guard = next((k for k, x in enumerate(p) if k and is_tok(x, "if") and not is_tok(p[k - 1], "else")), len(p))
            kotlin_expression(p[:guard])
            if guard < len(p):
                kotlin_expression(p[guard + 1 :])
        i += 1
        if i >= len(nodes):
            raise Invalid("branch without statement")
        if start == i - 1:
            raise Invalid("branch without condition")
        start = i
        i += 1
        while i < len(nodes) and not is_tok(nodes[i], ";"):
            a, b = nodes[i - 1], nodes[i]
            last = is_tok(b, "else") and is_tok(nodes[i + 1] if i + 1 < len(nodes) else None, "->")
            if _last_line(a) != b.line and (last or not _joined(a, b, nodes, start, i)):
                break
            # a block or a finished statement may be followed by the next branch on its line
            if last or (i == start + 1 and is_group(nodes[start], "{") and not (isinstance(b, Token) and b.text in KOTLIN_JOIN_NEXT)):
                break
            i += 1
        if is_group(nodes[start], "{") and i == start + 1:
            kotlin_lambda(nodes[start].nodes)
        else:
            kotlin_statement(nodes[start:i], False, False)


# ---------------------------------------------------------------- the other languages

PY_TOKEN = re.compile(r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r?\n|\r)|(?P<c>\#[^\r\n]*)|(?P<str>(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?P<q>\"{3}|'{3}|"|'))|(?P<w>\w+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<o>.)""", re.X)
_PY_BODY = {q: re.compile(rf"(?:[^\\{'' if len(q) == 3 else q + chr(92) + 'n'}]|\\(?:\r\n|.))*?{q}", re.S) for q in ('"""', "'''", '"', "'")}


def python_lex(text: str) -> None:
    stack, at = [], 0
    while at < len(text):
        if _conflict(text, at):
            raise Invalid("merge conflict")
        m = PY_TOKEN.match(text, at)
        end = m.end()
        if m.lastgroup == "q" or m.group("str"):
            body = _PY_BODY[m.group("q")].match(text, m.end())
            if not body:
                if "f" in m.group("str").lower() or "t" in m.group("str").lower():
                    return  # a nested quote of a formatted string: the parser decides
                raise Invalid("unterminated string")
            end = body.end()
        elif m.lastgroup == "open":
            stack.append(CLOSERS[m.group()])
        elif m.lastgroup == "close":
            if not stack or stack.pop() != m.group():
                raise Invalid(f"unbalanced {m.group()}")
        at = end
    if stack:
        raise Invalid(f"missing {stack[-1]}")


JSON_TOKEN = re.compile(r'[ \t\r\n]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)(?!\w)|[\[\]{},:]')


def json_lex(text: str) -> None:
    """A JSON text by a pushdown automaton: what may come next follows from the open container."""
    stack: list[str] = []
    want = "value"
    at = 0
    while at < len(text):
        if _conflict(text, at):
            raise Invalid("merge conflict")
        m = JSON_TOKEN.match(text, at)
        if not m:
            raise Invalid("unterminated string" if text[at] == '"' else f"stray text at {at}")
        t, at = m.group(), m.end()
        if t[0] in " \t\r\n":
            continue
        if want == "end":
            raise Invalid("text after the value")
        if t in "{[" and want in ("value", "value]"):
            stack.append(t)
            want = "key}" if t == "{" else "value]"
            continue
        if (t == "}" and stack[-1:] == ["{"] and want in ("key}", ",")) or (t == "]" and stack[-1:] == ["["] and want in ("value]", ",")):
            stack.pop()
        elif t == "," and want == ",":
            want = "key" if stack[-1] == "{" else "value"
            continue
        elif t == ":" and want == ":":
            want = "value"
            continue
        elif t[0] == '"' and want in ("key", "key}"):
            want = ":"
            continue
        elif t[0] in ",:}]{[" or want not in ("value", "value]"):
            raise Invalid(f"unexpected {t[:10]}")
        want = "," if stack else "end"
    if stack or want != "end":
        raise Invalid("premature end")


TOML_TOKEN = re.compile(r"""(?P<c>\#[^\r\n]*)|(?P<ml>\"{3}|'{3})|(?P<bs>"(?:[^"\\\r\n]|\\.)*")|(?P<ls>'[^'\r\n]*')|(?P<bad>["'])|(?P<open>[\[{])|(?P<close>[\]}])|(?P<o>[^\#"'\[\]{}\r\n]+|\r?\n|\r)""", re.X)


def toml_lex(text: str) -> None:
    stack, at = [], 0
    while at < len(text):
        if _conflict(text, at):
            raise Invalid("merge conflict")
        m = TOML_TOKEN.match(text, at)
        end = m.end()
        if m.lastgroup == "bad":
            raise Invalid("unterminated string")
        if m.lastgroup == "ml":
            q = m.group()
            body = re.compile(r'(?:[^\\]|\\.)*?"{3,5}' if q[0] == '"' else r".*?'{3,5}", re.S).match(text, m.end())
            if not body:
                raise Invalid("unterminated string")
            end = body.end()
        elif m.lastgroup == "open":
            stack.append(CLOSERS[m.group()])
        elif m.lastgroup == "close":
            if not stack or stack.pop() != m.group():
                raise Invalid(f"unbalanced {m.group()}")
        at = end
    if stack:
        raise Invalid(f"missing {stack[-1]}")


def _no_constant(x: str):
    raise ValueError(x)


def fault(text: str, language: str) -> str | None:
    """Why ``text`` is no valid text of ``language``; None where it is. An empty text is judged alike."""
    try:
        if language == "rust":
            rust_items(rust_tree(text.removeprefix("﻿")))
        elif language == "kotlin":
            kotlin_statements(kotlin_tree(text.removeprefix("﻿")), top=True)
        elif language == "python":
            python_lex(text)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            json_lex(text)
            json.loads(text, parse_constant=_no_constant)
        elif language == "toml":
            toml_lex(text)
            tomllib.loads(text)
        else:
            raise ValueError(f"unknown language {language}")
    except Invalid as e:
        return str(e)
    except (SyntaxError, ValueError) as e:
        if language not in ("python", "json", "toml"):
            raise
        return str(e)[:120] or "invalid"
    except (RecursionError, MemoryError):
        return "nested too deep"
    return None


# ---------------------------------------------------------------- on Spark


def path_language(path: Column) -> Column:
    """The language a path's extension names; null where it names none."""
    ext = F.regexp_extract(F.lower(F.btrim(path)), r"\.([^./\\]+)$", 1)
    lang = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        lang = F.when(ext == e, name).otherwise(lang)
    return lang


def syntax_faults(files: DataFrame, keep: list[str], path: str, text: str) -> DataFrame:
    """``keep`` columns, language and fault (null: valid) of every file with a text and a known extension.

    Files whose text is null or whose extension names no known language are no cases and are left out.
    Repeated files are judged alike; whole texts are read; an empty table gives an empty result. A map over
    rows: nothing is shuffled.
    """
    rows = files.select(*keep, F.col(text).alias("__text"), path_language(F.col(path)).alias("language")).where("__text IS NOT NULL AND language IS NOT NULL")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep), "language string, fault string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("language").to_pylist()
            out = [fault(t, lang) for t, lang in zip(b.column("__text").to_pylist(), langs)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("language"), pa.array(out, pa.string())], names=[*keep, "language", "fault"])

    return rows.mapInArrow(run, schema)
