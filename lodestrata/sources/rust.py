"""Facts of Rust source text: declarations, members, callables, calls, controls, bindings, flow blocks.

A lexer and a tree of delimiter groups with byte spans; facts come out as flat rows, and everything after
that - resolution, edges, closures - is done with DataFrame joins. Text that the closed subset does not
cover gives gap rows, never guesses. Text that does not lex gives one gap for the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<lc>//[^\n]*)|(?P<bc>/\*)|(?P<raw>(?:b|c)?r(?P<h>\#*)")|(?P<str>[bc]?"(?:[^"\\]|\\.)*")"""
    r"""|(?P<chr>b?'(?:[^'\\\n]|\\(?:[^u]|u\{[^}]*\}|x[0-9a-fA-F]{2}))')|(?P<life>'[^\W\d]\w*)|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<id>(?:r\#)?[^\W\d]\w*)"""
    r"""|(?P<op><<=|>>=|\.\.=|\.\.\.|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|::|\.\.|[-+*/%^!&|=<>@.,;:\#$?~])|(?P<open>[(\[{])|(?P<close>[)\]}])""",
    re.X | re.S,
)
PAIR = {"(": ")", "[": "]", "{": "}"}
#: The control constructs that are recorded.
CONTROLS = {"if", "match", "while", "for", "loop", "return", "break", "continue", "await", "async", "unsafe"}
KEYWORDS = set("as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await".split())
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
#: Constructs that make a callable's flow unsupported.
NO_FLOW = {"match", "while", "for", "loop", "return", "break", "continue", "await", "async", "unsafe", "const"}


#: Builder methods that register parts of a service, and attributes that may.
BUILDERS = {"component", "service", "layer", "route_layer", "handler", "with_state", "configuration", "endpoint", "route", "group", "nest"}
MARKS = {"route", "component", "service", "configuration", "command", "get", "post", "put", "delete", "patch", "head"}


class Unlexable(ValueError):
    pass


_SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\", "'": "'", '"': '"'}
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F_]{1,8})\}|x([0-9a-fA-F]{2})|\r?\n\s*|(.))", re.S)


def decode_literal(text: str) -> str | None:
    """The value of a quoted string or character literal; None where it is none or has an unknown escape."""
    m = re.fullmatch(r"[bc]?r(#*)\"(.*)\"\1", text, re.S)
    if m:
        return m.group(2)
    m = re.fullmatch(r"[bc]?([\"'])((?:[^\\]|\\.)*)\1", text, re.S)
    if not m:
        return None
    try:
        return _ESCAPE.sub(lambda e: chr(int(e[1].replace("_", ""), 16)) if e[1] else chr(int(e[2], 16)) if e[2] else _SIMPLE[e[3]] if e[3] else "", m.group(2))
    except (KeyError, ValueError, OverflowError):
        return None


class Tok:
    __slots__ = ("kind", "text", "a", "b")

    def __init__(self, kind: str, text: str, a: int, b: int):
        self.kind, self.text, self.a, self.b = kind, text, a, b


class Grp:
    __slots__ = ("kind", "text", "nodes", "a", "b")

    def __init__(self, text: str, a: int):
        self.kind, self.text, self.nodes, self.a, self.b = "group", text, [], a, a


def tree(text: str) -> list:
    """Tokens and groups of a text with byte spans."""
    offsets = None
    if not text.isascii():
        offsets, at = [], 0
        for c in text:
            offsets.append(at)
            at += len(c.encode("utf-8"))
        offsets.append(at)
    pos = (lambda i: i) if offsets is None else offsets.__getitem__
    root = Grp("", 0)
    stack, at = [root], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Unlexable(f"at {at}")
        kind, end = m.lastgroup, m.end()
        if kind == "bc":
            depth = 0
            for x in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if x.group() == "/*" else -1
                if not depth:
                    end = x.end()
                    break
            else:
                raise Unlexable("comment")
        elif kind in ("raw", "h"):
            close = '"' + m.group("h")
            end = text.find(close, m.end())
            if end < 0:
                raise Unlexable("raw string")
            end += len(close)
            stack[-1].nodes.append(Tok("lit", text[at:end], pos(at), pos(end)))
        elif kind == "open":
            stack.append(Grp(m.group(), pos(at)))
        elif kind == "close":
            if len(stack) == 1 or PAIR[stack[-1].text] != m.group():
                raise Unlexable("delimiter")
            g = stack.pop()
            g.b = pos(end)
            stack[-1].nodes.append(g)
        elif kind not in ("ws", "lc"):
            stack[-1].nodes.append(Tok("lit" if kind in ("str", "chr", "num") else kind, m.group(), pos(at), pos(end)))
        at = end
    if len(stack) > 1:
        raise Unlexable("delimiter")
    return root.nodes


def is_(n, *texts: str) -> bool:
    return n is not None and n.kind != "group" and n.text in texts


def group(n, delim: str) -> bool:
    return n is not None and n.kind == "group" and n.text == delim


def parts(nodes: list, sep: str = ",") -> list[list]:
    out, depth = [[]], 0
    for n in nodes:
        if n.kind == "op":
            depth += (n.text == "<") - (n.text == ">")
        if depth <= 0 and is_(n, sep):
            out.append([])
        else:
            out[-1].append(n)
    return [p for p in out if p]


class Facts:
    """Collects the rows of one file."""

    COLUMNS = ("kind", "local_id", "owner", "name", "visibility", "ordinal", "start_byte", "end_byte", "detail", "module_path")

    def __init__(self, text: str):
        self.data = text.encode("utf-8")
        self.rows: list[tuple] = []

    def text(self, nodes: list) -> str:
        return re.sub(r"\s+", " ", self.data[nodes[0].a : nodes[-1].b].decode("utf-8")).strip() if nodes else ""

    def add(self, kind: str, a: int, b: int, owner: str = "", name: str = "", visibility: str = "", ordinal: int | None = None, detail: str = "", module: str = "") -> str:
        local = f"{kind}@{a}-{b}" + (f"#{name}" if kind in ("rust.pattern_binding", "rust.import") else "")
        self.rows.append((kind, local, owner, name, visibility, ordinal, a, b, detail, module))
        return local

    def gap(self, code: str, a: int, b: int, owner: str = "") -> None:
        self.add("gap", a, b, owner, code)


def attributes(nodes: list, i: int) -> tuple[int, list[str], bool]:
    """(index after them, their first names, whether one is cfg)."""
    names, cfg = [], False
    while is_(nodes[i] if i < len(nodes) else None, "#"):
        i += 1
        if i < len(nodes) and is_(nodes[i], "!"):
            i += 1
        if i < len(nodes) and group(nodes[i], "["):
            first = nodes[i].nodes[0].text if nodes[i].nodes and nodes[i].nodes[0].kind == "id" else ""
            names.append(first)
            cfg = cfg or first in ("cfg", "cfg_attr")
            i += 1
    return i, names, cfg


def visibility_at(f: Facts, nodes: list, i: int) -> tuple[int, str]:
    if i < len(nodes) and is_(nodes[i], "pub"):
        i += 1
        if i < len(nodes) and group(nodes[i], "(") and nodes[i].nodes and is_(nodes[i].nodes[0], "crate", "super", "self", "in"):
            return i + 1, "restricted:" + f.text(nodes[i].nodes)
        return i, "public"
    return i, "private"


def _find(nodes: list, i: int, stop) -> int:
    while i < len(nodes) and not stop(nodes[i]):
        i += 1
    return i


def items(f: Facts, nodes: list, module: str, owner: str, inherited: str = "") -> None:
    """Rows of the items in a list of nodes."""
    i = 0
    while i < len(nodes):
        start = i
        i, names, cfg = attributes(nodes, i)
        if i >= len(nodes):
            break
        a = nodes[start].a
        for mark in names:
            if mark in MARKS:
                f.add("framework.candidate", a, nodes[i].b, owner, mark, detail="candidate_unresolved", module=module)
        presence = "conditional_unknown" if cfg else "unconditional"
        i, vis = visibility_at(f, nodes, i)
        vis = vis if vis != "private" else (inherited or vis)
        quals = []
        while i < len(nodes) and nodes[i].kind in ("id", "lit") and (is_(nodes[i], "default", "async", "unsafe", "extern") or nodes[i].kind == "lit" or (is_(nodes[i], "const") and i + 1 < len(nodes) and is_(nodes[i + 1], "fn", "unsafe", "async", "extern"))):
            if is_(nodes[i], "extern") and i + 1 < len(nodes) and is_(nodes[i + 1], "crate"):
                break
            quals.append(nodes[i].text)
            i += 1
        if i >= len(nodes):
            break
        w, nxt = nodes[i].text if nodes[i].kind == "id" else "", nodes[i + 1] if i + 1 < len(nodes) else None
        name = nxt.text if nxt is not None and nxt.kind == "id" else ""
        if w == "mod" and name:
            body = nodes[i + 2] if i + 2 < len(nodes) else None
            own = f.add("rust.module", a, (body or nxt).b, owner, name, vis, detail=presence, module=module)
            if group(body, "{"):
                items(f, body.nodes, f"{module}::{name}" if module else name, own)
            i += 3
        elif w == "use":
            end = _find(nodes, i, lambda n: is_(n, ";"))
            for path, alias in use_paths(nodes[i + 1 : end]):
                f.add("rust.import", a, nodes[min(end, len(nodes) - 1)].b, owner, path, vis, detail=alias, module=module)
            i = end + 1
        elif w == "fn" and name:
            i = function(f, nodes, i, a, vis, quals, module, owner, presence)
        elif w in ("struct", "union", "enum") and name:
            end = _find(nodes, i + 2, lambda n: group(n, "{") or is_(n, ";"))
            own = f.add(f"rust.{'enum' if w == 'enum' else 'struct'}", a, nodes[min(end, len(nodes) - 1)].b, owner, name, vis, detail=presence, module=module)
            if end < len(nodes) and group(nodes[end], "{"):
                for k, p in enumerate(parts(nodes[end].nodes)):
                    member(f, p, k, own, w, module)
            if w == "enum" and (prim := representation(nodes[start:i])):
                f.add("rust.enum_representation", a, nodes[i].b, own, prim, module=module)
            i = end + 1
        elif w in ("trait", "impl"):
            end = _find(nodes, i + 1, lambda n: group(n, "{") or is_(n, ";"))
            head = nodes[i + 1 : end]
            b = nodes[min(end, len(nodes) - 1)].b
            if w == "trait":
                own = f.add("rust.trait", a, b, owner, name, vis, detail=presence, module=module)
                inner = "public"
            else:
                spot = next((k for k, n in enumerate(head) if is_(n, "for")), None)
                generic = bool(head) and is_(head[0], "<")
                target = f.text(head[spot + 1 :] if spot is not None else head)
                own = f.add("rust.impl", a, b, owner, target, vis, detail=f.text(head[:spot]) if spot is not None else "", module=module)
                inner = "inherited_trait" if spot is not None else ""
                if generic or (head and is_(head[0], "!")):
                    f.gap("rust.unsupported_impl_header", a, b, own)
            if end < len(nodes) and group(nodes[end], "{"):
                items(f, nodes[end].nodes, module, own, inner)
            i = end + 1
        elif w in ("const", "static"):
            end = _find(nodes, i, lambda n: is_(n, ";"))
            k = i + 1 + (1 if is_(nxt, "mut") else 0)
            body = nodes[k:end]
            eq = next((j for j, n in enumerate(body) if is_(n, "=")), None)
            colon = next((j for j, n in enumerate(body) if is_(n, ":")), None)
            kind = f.text(body[colon + 1 : eq]) if colon is not None else ""
            own = f.add("rust.constant" if w == "const" else "rust.static", a, nodes[min(end, len(nodes) - 1)].b, owner, body[0].text if body else "", vis, detail=kind, module=module)
            if eq is not None and body[eq + 1 :]:
                f.add("rust.declared_value", body[eq + 1].a, body[-1].b, own, body[0].text, detail=f.text(body[eq + 1 :]), module=module)
            i = end + 1
        elif w == "type":
            end = _find(nodes, i, lambda n: is_(n, ";"))
            f.add("rust.type_alias" if not inherited else "rust.associated_type", a, nodes[min(end, len(nodes) - 1)].b, owner, name, vis, detail=f.text(nodes[i + 2 : end]), module=module)
            i = end + 1
        elif w == "extern":
            i = _find(nodes, i, lambda n: is_(n, ";") or group(n, "{")) + 1
        elif w and is_(nxt, "!"):
            end = _find(nodes, i + 2, lambda n: n.kind == "group")
            f.gap("rust.macro_not_expanded", a, nodes[min(end, len(nodes) - 1)].b, owner)
            i = end + 2 if end + 1 < len(nodes) and is_(nodes[end + 1], ";") else end + 1
        else:
            i += 1


def representation(nodes: list) -> str:
    """The integer type that a repr attribute among these nodes fixes; empty without one."""
    for n in nodes:
        if group(n, "[") and len(n.nodes) == 2 and is_(n.nodes[0], "repr") and group(n.nodes[1], "("):
            for x in n.nodes[1].nodes:
                if re.fullmatch(r"[iu](?:8|16|32|64|128|size)", x.text):
                    return x.text
    return ""


def use_paths(nodes: list, prefix: str = "") -> list[tuple[str, str]]:
    """(path, alias) of every name a use tree brings in."""
    path, i = prefix, 0
    while i < len(nodes):
        n = nodes[i]
        if group(n, "{"):
            return [x for p in parts(n.nodes) for x in use_paths(p, path)]
        if is_(n, "as"):
            return [(path.removesuffix("::self"), nodes[i + 1].text if i + 1 < len(nodes) else "")]
        path += n.text
        i += 1
    return [(path.removesuffix("::self"), "")] if path else []


def member(f: Facts, p: list, k: int, owner: str, of: str, module: str) -> None:
    i, _, cfg = attributes(p, 0)
    i, vis = visibility_at(f, p, i)
    if i >= len(p) or p[i].kind != "id":
        return
    if of == "enum":
        eq = next((j for j, n in enumerate(p) if is_(n, "=")), None)
        own = f.add("rust.enum_variant", p[0].a, p[-1].b, owner, p[i].text, "inherited", k, f.text(p[eq + 1 :]) if eq is not None else "", module)
        if eq is not None:
            f.add("rust.declared_value", p[eq + 1].a, p[-1].b, own, p[i].text, detail=f.text(p[eq + 1 :]), module=module)
    else:
        f.add("rust.field", p[0].a, p[-1].b, owner, p[i].text, vis, k, f.text(p[i + 2 :]), module)


def function(f: Facts, nodes: list, i: int, a: int, vis: str, quals: list[str], module: str, owner: str, presence: str) -> int:
    name = nodes[i + 1].text
    par = _find(nodes, i + 2, lambda n: group(n, "(") or group(n, "{") or is_(n, ";"))
    end = _find(nodes, par, lambda n: group(n, "{") or is_(n, ";"))
    last = nodes[min(end, len(nodes) - 1)]
    kind = "rust.method" if owner.startswith(("rust.impl", "rust.trait")) else "rust.function"
    own = f.add(kind, a, last.b, owner, name, vis, detail=presence, module=module)
    sig = nodes[i : end if end < len(nodes) else len(nodes)]
    f.add("rust.callable_signature", nodes[i].a, sig[-1].b, own, name, vis, detail=" ".join([*quals, f.text(sig)]), module=module)
    scope_end = last.b
    if par < len(nodes) and group(nodes[par], "("):
        for k, p in enumerate(parts(nodes[par].nodes)):
            colon = next((j for j, n in enumerate(p) if is_(n, ":")), None)
            f.add("rust.parameter", p[0].a, p[-1].b, own, f.text(p[:colon] if colon is not None else p), ordinal=k, detail=f.text(p[colon + 1 :]) if colon is not None else "", module=module)
            for n in pattern_names(p[:colon] if colon is not None else p):
                f.add("rust.pattern_binding", n.a, n.b, own, n.text, ordinal=scope_end, detail=f"parameter:{last.a}", module=module)
    if end < len(nodes) and group(nodes[end], "{"):
        body = nodes[end]
        Body(f, own, module).block(body)
        flow(f, body, own, module)
    return end + 1


def pattern_names(nodes: list) -> list:
    """The identifiers a pattern binds: lower-case names that are no paths, calls or keywords."""
    out = []
    for k, n in enumerate(nodes):
        if n.kind == "group":
            out += pattern_names(n.nodes)
        elif n.kind == "id" and n.text not in KEYWORDS | {"_"} and not n.text[0].isupper():
            nxt, prev = nodes[k + 1] if k + 1 < len(nodes) else None, nodes[k - 1] if k else None
            if not is_(nxt, "::", "!") and not is_(prev, "::", ".") and not group(nxt, "(") and not is_(nxt, ":"):
                out.append(n)
    return out


class Body:
    """Facts inside a callable: local bindings, call sites, controls, identifier uses with their spans."""

    def __init__(self, f: Facts, own: str, module: str):
        self.f, self.own, self.module, self.n = f, own, module, 0

    def fact(self, kind: str, a: int, b: int, name: str, detail: str = "") -> None:
        self.f.add(kind, a, b, self.own, name, ordinal=self.n, detail=detail, module=self.module)
        self.n += 1

    def block(self, g: Grp) -> None:
        self.walk(g.nodes, g)

    def walk(self, nodes: list, scope: Grp) -> None:
        i = 0
        while i < len(nodes):
            n = nodes[i]
            nxt, prev = nodes[i + 1] if i + 1 < len(nodes) else None, nodes[i - 1] if i else None
            if n.kind == "group":
                self.walk(n.nodes, n if n.text == "{" else scope)
            elif is_(n, "let"):
                stop = _find(nodes, i, lambda x: is_(x, ";", "=") or group(x, "{"))
                end = _find(nodes, i, lambda x: is_(x, ";"))
                pat = nodes[i + 1 : stop]
                colon = next((j for j, x in enumerate(pat) if is_(x, ":")), None)
                names = pattern_names(pat[:colon] if colon is not None else pat)
                for x in names:
                    self.fact("rust.local_binding", x.a, x.b, x.text)
                    start = nodes[end].b if end < len(nodes) else n.b
                    self.f.add("rust.pattern_binding", x.a, x.b, self.own, x.text, ordinal=scope.b, detail=f"let:{start}", module=self.module)
                i = stop
                continue
            elif is_(n, "fn"):
                self.f.gap("rust.nested_function", n.a, n.b, self.own)
                i = _find(nodes, i, lambda x: group(x, "{") or is_(x, ";"))
            elif n.kind == "id" and n.text in CONTROLS:
                self.fact("rust.control", n.a, n.b, n.text)
                if n.text == "for":
                    spot = _find(nodes, i, lambda x: is_(x, "in"))
                    body = _find(nodes, spot, lambda x: group(x, "{"))
                    if body < len(nodes):
                        for x in pattern_names(nodes[i + 1 : spot]):
                            self.f.add("rust.pattern_binding", x.a, x.b, self.own, x.text, ordinal=nodes[body].b, detail=f"for:{nodes[body].a}", module=self.module)
                    i = spot
            elif is_(n, "?"):
                self.fact("rust.control", n.a, n.b, "try")
            elif n.kind == "id" and n.text not in KEYWORDS:
                if is_(nxt, "!") and i + 2 < len(nodes) and nodes[i + 2].kind == "group":
                    self.f.gap("rust.macro_not_expanded", n.a, nodes[i + 2].b, self.own)
                    i += 3
                    continue
                if group(nxt, "("):
                    first = i
                    while first >= 2 and is_(nodes[first - 1], "::") and nodes[first - 2].kind == "id":
                        first -= 2
                    method = is_(nodes[first - 1] if first else None, ".")
                    spelling = "".join(x.text for x in nodes[first : i + 1])
                    if method:
                        self.fact("rust.call_site", n.a, nxt.b, spelling, "method")
                        if n.text in BUILDERS:
                            args = parts(nxt.nodes)
                            key = args[0][0].text if args and len(args[0]) == 1 and args[0][0].kind == "lit" else ""
                            target = self.f.text(args[-1]) if args and not (key and len(args) == 1) else ""
                            self.f.add("framework.registration", n.a, nxt.b, self.own, n.text, detail=f"{key}|{target}", module=self.module)
                    elif not n.text[:1].isupper():
                        self.fact("rust.call_site", nodes[first].a, nxt.b, spelling, "path")
                elif not is_(prev, ".", "::") and not is_(nxt, "::"):
                    use = "write" if is_(nxt, "=") else "read_write" if nxt is not None and nxt.kind == "op" and nxt.text in ASSIGN else "read"
                    # a write takes effect at its statement's end
                    done = _find(nodes, i, lambda x: is_(x, ";"))
                    at = None if use == "read" else nodes[min(done, len(nodes) - 1)].b
                    self.f.add("rust.expression", n.a, n.b, self.own, n.text, ordinal=at, detail=use, module=self.module)
            i += 1


def flow(f: Facts, body: Grp, own: str, module: str) -> None:
    """Basic blocks and edges of a callable of plain statements and if/else; anything else is a gap for it all."""
    blocks: list[tuple[int, int, str]] = []
    arcs: list[tuple[int, int, str]] = []

    class Stop(Exception):
        pass

    def new(role: str, a: int, b: int) -> int:
        blocks.append((a, b, role))
        return len(blocks) - 1

    def refuse(nodes: list) -> None:
        for k, n in enumerate(nodes):
            if n.kind == "group":
                refuse(n.nodes)
            elif n.kind == "id" and n.text in NO_FLOW | {"if"} or is_(n, "?", "||", "#") or n.kind == "life" or (is_(n, "!") and k + 1 < len(nodes) and nodes[k + 1].kind == "group" and k and nodes[k - 1].kind == "id") or (is_(n, "|") and (k == 0 or nodes[k - 1].kind == "op")):
                raise Stop

    def run(g: Grp, role: str, exits: list[tuple[int, str]]) -> list[tuple[int, str]]:
        """Blocks of a group's statements; the open exits after it."""
        i, nodes, first = 0, g.nodes, True
        while i < len(nodes):
            if is_(nodes[i], ";"):
                i += 1
                continue
            if is_(nodes[i], "if"):
                b = _find(nodes, i, lambda n: group(n, "{"))
                if b >= len(nodes) or is_(nodes[i + 1], "let") or b + 2 >= len(nodes) or not is_(nodes[b + 1], "else") or not group(nodes[b + 2], "{"):
                    raise Stop
                refuse(nodes[i + 1 : b])
                cond = new("condition", nodes[i].a, nodes[b - 1].b)
                arcs.extend((x, cond, k) for x, k in exits)
                then = run(nodes[b], "then_branch", [(cond, "SYNTAX_TRUE_BRANCH")])
                other = run(nodes[b + 2], "else_branch", [(cond, "SYNTAX_FALSE_BRANCH")])
                exits, role, first = then + other, "join", True
                i = b + 3
                continue
            start = i
            while i < len(nodes) and not is_(nodes[i], "if"):
                i += 1
            plain = nodes[start:i]
            if i < len(nodes) and plain and not (is_(plain[-1], ";") or group(plain[-1], "{")):
                raise Stop  # an if inside an expression
            refuse(plain)
            at = new(role if first else "join", plain[0].a, plain[-1].b)
            arcs.extend((x, at, k) for x, k in exits)
            exits, first = [(at, "SYNTAX_NEXT")], False
        return exits

    try:
        run(body, "entry", [])
    except (Stop, IndexError):
        f.gap("rust.local_flow_unsupported", body.a, body.b, own)
        return
    for k, (a, b, role) in enumerate(blocks):
        f.add("rust.syntax_basic_block", a, b, own, role, ordinal=k, module=module)
    for x, y, kind in arcs:
        f.add("flow_edge", blocks[x][0], blocks[y][1], own, kind, ordinal=x, detail=str(y), module=module)


def extract(text: str | None) -> list[tuple]:
    """The fact rows of one text; a null text gives none, one that does not lex a single gap."""
    if text is None:
        return []
    f = Facts(text)
    try:
        items(f, tree(text), "", "")
    except (Unlexable, RecursionError):
        f.rows = []
        f.gap("rust.malformed_source", 0, len(f.data))
    return f.rows


SCHEMA = "kind string, local_id string, owner string, name string, visibility string, ordinal long, start_byte long, end_byte long, detail string, module_path string"


def rust_facts(files: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and the fact columns for every fact of every text. A map over rows: nothing is shuffled.

    ``keep`` must not hold a fact column's name.
    """
    rows = files.select(*keep, files[text].alias("__text"))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields if x.name in keep), SCHEMA])
    types = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("__text").to_pylist()):
                got = extract(t)
                at += [i] * len(got)
                out += got
            picked = b.take(pa.array(at, pa.int64()))
            cols = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*keep, *Facts.COLUMNS])

    return rows.mapInArrow(run, schema)
