"""Safe evaluation of constants: checked integers and booleans, in the order of their dependencies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import materialize

#: Levels of dependencies that are followed, and nodes of one expression.
MAX_LEVELS = 64
MAX_NODES = 256

RANGES = {f"{s}{w}": ((-(1 << (w - 1)), (1 << (w - 1)) - 1) if s == "i" else (0, (1 << w) - 1)) for s in "iu" for w in (8, 16, 32, 64, 128)}
TOKEN = re.compile(r"\s*(?:(?P<num>\d[\w]*)|(?P<name>[A-Za-z_]\w*)|(?P<op><<|>>|&&|\|\||==|!=|<=|>=|[-+*/%&|^!<>()]))")
#: Binding strength of the binary operators, weakest first.
STRENGTH = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8}


class Refused(ValueError):
    """The expression is outside the evaluated subset, or its value is not defined."""


def literal(text: str) -> int:
    m = re.fullmatch(r"(0x[0-9a-f_]+|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*)([iu](?:8|16|32|64|128))?", text.lower())
    if not m:
        raise Refused(f"literal {text}")
    return int(m.group(1).replace("_", ""), 0) if m.group(1)[:2] in ("0x", "0o", "0b") else int(m.group(1).replace("_", ""))


def parse(text: str):
    """Expression tree of a constant: nested tuples."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Refused(f"text at {at}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    if len(tokens) > MAX_NODES:
        raise Refused("too many nodes")
    pos = 0

    def take(*ops):
        nonlocal pos
        if pos < len(tokens) and tokens[pos][0] == "op" and tokens[pos][1] in ops:
            pos += 1
            return tokens[pos - 1][1]
        return None

    def unary():
        nonlocal pos
        if op := take("-", "!"):
            return ("un", op, unary())
        if take("("):
            e = binary(1)
            if not take(")"):
                raise Refused("parenthesis")
            return e
        if pos >= len(tokens) or tokens[pos][0] == "op":
            raise Refused("operand missing")
        kind, t = tokens[pos]
        pos += 1
        if kind == "num":
            return ("lit", literal(t))
        return ("lit", t == "true") if t in ("true", "false") else ("name", t)

    def binary(least: int):
        nonlocal pos
        left = unary()
        while pos < len(tokens) and tokens[pos][0] == "op" and STRENGTH.get(tokens[pos][1], 0) >= least:
            op = tokens[pos][1]
            pos += 1
            left = ("bin", op, left, binary(STRENGTH[op] + 1))
        return left

    e = binary(1)
    if pos < len(tokens):
        raise Refused("text after the expression")
    return e


def names(e) -> set[str]:
    return {e[1]} if e[0] == "name" else set() if e[0] == "lit" else set().union(*(names(x) for x in e[2:]))


def evaluate(e, primitive: str, known: dict[str, int | bool]) -> int | bool:
    """The value of a tree as ``primitive``; every intermediate value is checked against its range."""

    def fit(v):
        if isinstance(v, bool):
            return v
        low, high = RANGES[primitive] if primitive in RANGES else RANGES["i128"]
        if not low <= v <= high:
            raise Refused("out of range")
        return v

    def run(x):
        if x[0] == "lit":
            return fit(x[1])
        if x[0] == "name":
            if x[1] not in known:
                raise Refused(f"unknown {x[1]}")
            return known[x[1]]
        if x[0] == "un":
            if x[1] == "-" and x[2][0] == "lit" and not isinstance(x[2][1], bool):
                return fit(-x[2][1])
            v = run(x[2])
            if x[1] == "!":
                return (not v) if isinstance(v, bool) else fit(~v if primitive[0] == "i" else RANGES[primitive][1] ^ v)
            if isinstance(v, bool):
                raise Refused("type")
            return fit(-v)
        op, a, b = x[1], run(x[2]), run(x[3])
        if isinstance(a, bool) != isinstance(b, bool):
            raise Refused("type")
        if op in ("&&", "||"):
            if not isinstance(a, bool):
                raise Refused("type")
            return (a and b) if op == "&&" else (a or b)
        if op in ("==", "!=", "<", ">", "<=", ">="):
            return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if op in ("&", "|", "^"):
            v = {"&": a & b, "|": a | b, "^": a ^ b}[op]
            return bool(v) if isinstance(a, bool) else fit(v)
        if isinstance(a, bool):
            raise Refused("type")
        if op in ("/", "%"):
            if b == 0:
                raise Refused("division by zero")
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return fit(q if op == "/" else a - q * b)
        return fit({"+": a + b, "-": a - b, "*": a * b}[op])

    if primitive != "bool" and primitive not in RANGES:
        raise Refused(f"type {primitive}")
    v = run(e)
    if isinstance(v, bool) != (primitive == "bool"):
        raise Refused("type")
    return v


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        value, problem = [], []
        for text, prim, known in zip(b.column("expression").to_pylist(), b.column("primitive").to_pylist(), b.column("known").to_pylist()):
            got = {k: (v == "true" if v in ("true", "false") else int(v)) for k, v in (known or [])}
            try:
                v = evaluate(parse(text), prim, got)
                value.append(str(v).lower() if isinstance(v, bool) else str(v))
                problem.append(None)
            except Refused as e:
                value.append(None)
                problem.append(str(e))
        yield pa.RecordBatch.from_arrays([b.column("owner"), b.column("name"), b.column("primitive"), pa.array(value, pa.string()), pa.array(problem, pa.string())], names=["owner", "name", "primitive", "value", "problem"])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column("expression").to_pylist():
            try:
                out.append(sorted(names(parse(text))))
            except Refused:
                out.append([])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names, "needs"])


def evaluate_constants(constants: DataFrame) -> DataFrame:
    """``constants`` (owner, name, primitive, expression): owner, name, primitive, value (decimal text, true, false), level, problem.

    A name stands for the only constant of the same owner, name and primitive type. Constants are evaluated
    level by level over all owners together, from those without dependencies on; what no level reaches hangs
    on a cycle, an unknown name or a refused constant and has a problem instead of a value.
    """
    unique = constants.groupBy("owner", "name", "primitive").agg(F.count(F.lit(1)).alias("n"), F.min("expression").alias("expression")).where("n = 1 AND expression IS NOT NULL").drop("n")
    todo = materialize(unique.mapInArrow(_needs, "owner string, name string, primitive string, expression string, needs array<string>"), "const")
    solved = None
    waiting = todo
    for level in range(MAX_LEVELS):
        if solved is None:
            ready = waiting.where("size(needs) = 0").withColumn("known", F.lit(None).cast("array<struct<k:string,v:string>>"))
        else:
            values = solved.where("value IS NOT NULL").select("owner", F.col("name").alias("need"), "primitive", "value")
            have = waiting.select("owner", "name", "primitive", F.explode("needs").alias("need")).join(values, ["owner", "need", "primitive"]).groupBy("owner", "name", "primitive").agg(F.collect_list(F.struct(F.col("need").alias("k"), F.col("value").alias("v"))).alias("known"))
            ready = waiting.join(have, ["owner", "name", "primitive"]).where("size(known) = size(needs)")
        known = F.map_from_entries("known")
        now = materialize(ready.select("owner", "name", "primitive", "expression", known.alias("known")).mapInArrow(_step, "owner string, name string, primitive string, value string, problem string").withColumn("level", F.lit(level)), "level")
        if not now.head(1):
            break
        solved = now if solved is None else solved.unionByName(now)
        waiting = materialize(waiting.join(now.select("owner", "name", "primitive"), ["owner", "name", "primitive"], "left_anti"), "waiting")
    left = waiting.select("owner", "name", "primitive", F.lit(None).cast("string").alias("value"), F.lit("dependency not evaluated").alias("problem"), F.lit(None).cast("int").alias("level"))
    repeated = constants.groupBy("owner", "name", "primitive").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("owner", "name", "primitive", F.lit(None).cast("string").alias("value"), F.lit("not unique").alias("problem"), F.lit(None).cast("int").alias("level"))
    out = left.unionByName(repeated)
    return out.unionByName(solved) if solved is not None else out
