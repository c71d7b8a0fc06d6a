"""Compiler indexes (SCIP): the protocol-buffer wire format into occurrence and symbol rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an occurrence's roles.
DEFINITION, IMPORT, WRITE, READ, GENERATED = 1, 2, 4, 8, 16


class WireError(ValueError):
    """Bytes that are no message."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("varint")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return n, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of every field of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        field, wire = key >> 3, key & 7
        if field == 0:
            raise WireError("field")
        if wire == 0:
            v, at = varint(data, at)
        elif wire == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise WireError("length")
            v, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            if at + n > len(data):
                raise WireError("length")
            v, at = data[at : at + n], at + n
        else:
            raise WireError("wire type")
        yield field, v


def packed(v) -> list[int]:
    """A repeated integer, packed or single."""
    if isinstance(v, int):
        return [v]
    out, at = [], 0
    while at < len(v):
        n, at = varint(v, at)
        out.append(n)
    return out


def read_range(r: list[int]) -> tuple[int, int, int, int]:
    """(start line, start character, end line, end character) of a range of three or four numbers."""
    if len(r) == 3:
        return r[0], r[1], r[0], r[2]
    if len(r) == 4:
        return tuple(r)
    raise WireError("range")


def index_rows(data: bytes) -> list[tuple]:
    """(kind, document, symbol, roles, syntax_kind, range, enclosing range, related, relation) rows of an index."""
    out: list[tuple] = []
    none = (None,) * 4
    for field, doc in message(data):
        if field == 2 and isinstance(doc, bytes):
            path, parts = "", []
            for f, v in message(doc):
                if f == 1:
                    path = v.decode("utf-8")
                elif f in (2, 3):
                    parts.append((f, v))
            for f, v in parts:
                if f == 2:
                    span, roles, symbol, syntax, outer = [], 0, "", 0, []
                    for g, x in message(v):
                        if g == 1:
                            span += packed(x)
                        elif g == 2:
                            symbol = x.decode("utf-8")
                        elif g == 3:
                            roles = x
                        elif g == 5:
                            syntax = x
                        elif g == 7:
                            outer += packed(x)
                    out.append(("occurrence", path, symbol, roles, syntax, *read_range(span), *(read_range(outer) if outer else none), "", ""))
                else:
                    symbol, related = "", []
                    for g, x in message(v):
                        if g == 1:
                            symbol = x.decode("utf-8")
                        elif g == 4:
                            rel = dict(message(x))
                            kinds = [n for k, n in ((2, "reference"), (3, "implementation"), (4, "type_definition"), (5, "definition")) if rel.get(k)]
                            related.append((rel.get(1, b"").decode("utf-8"), ",".join(kinds)))
                    out.append(("symbol", path, symbol, 0, 0, *none, *none, "", ""))
                    out += [("relationship", path, symbol, 0, 0, *none, *none, r, k) for r, k in related]
    return out


COLUMNS = ("kind", "document", "symbol", "roles", "syntax_kind", "start_line", "start_char", "end_line", "end_char", "outer_start_line", "outer_start_char", "outer_end_line", "outer_end_char", "related", "relation")
SCHEMA = ", ".join(f"{c} {'string' if c in ('kind', 'document', 'symbol', 'related', 'relation') else 'long'}" for c in COLUMNS)


def scip_facts(files: DataFrame, data: str) -> DataFrame:
    """Rows of every index in a binary column; one that is no message gives a single row of kind gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                if x is None:
                    continue
                try:
                    out += index_rows(x)
                except (WireError, UnicodeDecodeError, AttributeError, TypeError):
                    out.append(("gap", "", "compiler_index.malformed", 0, 0, *(None,) * 8, "", ""))
            cols = list(zip(*out)) if out else [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("kind", "document", "symbol", "related", "relation") else pa.int64()) for n, c in zip(COLUMNS, cols)], names=list(COLUMNS))

    return files.select(data).mapInArrow(run, SCHEMA)


def package_of(symbol: str) -> F.Column:
    """The package part of a symbol: its second to fourth words; null for a local one."""
    return F.when(~F.col(symbol).startswith("local "), F.array_join(F.slice(F.split(symbol, " "), F.lit(2), F.lit(3)), " "))


#: Lines of a cell that brings references and definitions together.
CELL_LINES = 64
#: Fixed value: the syntax kind of a function's identifier.
FUNCTION_IDENTIFIER = 15


def reference_owners(rows: DataFrame, syntax_kind: int | None = FUNCTION_IDENTIFIER) -> DataFrame:
    """REFERENCES: each read occurrence of another package's symbol and the only definition whose range encloses it.

    Gives document, owner, symbol. A reference with no or several owners gives none; ``syntax_kind`` None takes
    every kind of occurrence. Definitions meet references only in the cells of lines that they cover.
    """
    at = lambda line, char: F.col(line) * F.lit(1 << 20) + F.col(char)
    cell = lambda line: F.floor(F.col(line) / CELL_LINES)
    occ = rows.where("kind = 'occurrence'")
    is_def = F.col("roles").bitwiseAND(DEFINITION) != 0
    defs = occ.where(is_def & F.col("outer_start_line").isNotNull() & ~F.col("symbol").startswith("local ")).select(
        "document", F.col("symbol").alias("owner"), at("outer_start_line", "outer_start_char").alias("a"), at("outer_end_line", "outer_end_char").alias("b"), F.explode(F.sequence(cell("outer_start_line"), cell("outer_end_line"))).alias("cell")
    )
    read = (F.col("roles").bitwiseAND(READ) != 0) & ~is_def
    refs = occ.where(read & (F.col("syntax_kind") == syntax_kind if syntax_kind is not None else F.lit(True))).select("document", "symbol", at("start_line", "start_char").alias("x"), at("end_line", "end_char").alias("y"), cell("start_line").alias("cell"))
    inside = refs.join(defs, ["document", "cell"]).where("a <= x AND y <= b AND symbol <> owner").where(~package_of("symbol").eqNullSafe(package_of("owner")))
    owners = inside.groupBy("document", "symbol", "x", "y").agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("n")).where("n = 1")
    return owners.select("document", "owner", "symbol").distinct()


def overlay_edges(rows: DataFrame) -> DataFrame:
    """RESOLVES_TO, REFERENCES, IMPLEMENTS and TYPE_DEFINITION of an index: kind, source, target, document; each once.

    An occurrence with the import role resolves its document to the symbol; references are those of
    :func:`reference_owners`; the rest comes from the symbols' own relationships.
    """
    imports = rows.where("kind = 'occurrence'").where((F.col("roles").bitwiseAND(IMPORT) != 0) & ~F.col("symbol").startswith("local ")).select(F.lit("RESOLVES_TO").alias("kind"), F.col("document").alias("source"), F.col("symbol").alias("target"), "document")
    reads = reference_owners(rows).select(F.lit("REFERENCES").alias("kind"), F.col("owner").alias("source"), F.col("symbol").alias("target"), "document")
    kinds = F.split("relation", ",")
    named = rows.where("kind = 'relationship'").select(F.explode(kinds).alias("r"), F.col("symbol").alias("source"), F.col("related").alias("target"), "document")
    related = named.where("r IN ('implementation', 'type_definition')").select(F.when(F.col("r") == "implementation", "IMPLEMENTS").otherwise("TYPE_DEFINITION").alias("kind"), "source", "target", "document")
    return imports.unionByName(reads).unionByName(related).distinct()


def symbol_entities(symbols: DataFrame, entities: DataFrame) -> DataFrame:
    """Symbols (symbol) and the source entity (id, module_path, owner, name) that each names: symbol, target, state.

    The descriptors give the module (``a/b/``), the owner of a member (``T#``) and the name; a method's owner must
    agree. State is bound, missing or ambiguous. Modules are joined with ``::``; a null owner or module is none.
    """
    d = F.regexp_extract("symbol", r"^\S+ \S+ \S+ \S+ (.*)$", 1)
    module = F.regexp_replace(F.regexp_replace(F.regexp_extract(d, r"^((?:[^/]+/)*)", 1), "/$", ""), "/", "::")
    rest = F.regexp_replace(d, r"^(?:[^/]+/)*", "")
    owner = F.regexp_extract(rest, r"^(?:impl#)?\[?(\w+)\]?#(?=\w)", 1)
    name = F.regexp_extract(rest, r"(\w+)(?:\(\)\.|#|\.|!)?$", 1)
    s = symbols.select("symbol").distinct().select("symbol", module.alias("module_path"), owner.alias("owner"), name.alias("name"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    e = entities.select(blank("module_path"), blank("owner"), "name", "id").groupBy("module_path", "owner", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("hit"))
    out = s.join(e, ["module_path", "owner", "name"], "left")
    return out.select("symbol", F.when(F.col("n") == 1, F.col("hit")).alias("target"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "bound").otherwise("ambiguous").alias("state"))
