"""Schemas that drift between files: rescue-column ingestion.

A JSON body is read against a fixed target schema. Fields of the schema whose value has the declared JSON
type become typed columns; every other field - unknown, or of another type - is kept as JSON text in the
``rescued`` map under its dotted path, so nothing is lost. Approved fields are later promoted: their rescued
values are replayed into typed columns. The list of changes between files is derived from the typed and the
rescued fields together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import id16
from lodestrata.operators.skew import hot_keys, skew_join
from lodestrata.runtime import BROADCAST_LIMIT_BYTES, materialize, stored_bytes

#: JSON type of a field -> Spark type of its column. An array stays JSON text: it is one value.
SPARK_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "array": "string"}


def column_name(path: str) -> str:
    return path.replace(".", "__")


def _bad(token: str):
    raise ValueError(token)


def _json_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    return {int: "integer", float: "number", str: "string", list: "array"}[type(v)]


def _leaves(node: dict, prefix: str, out: dict) -> None:
    for k, v in node.items():
        if isinstance(v, dict):
            _leaves(v, f"{prefix}{k}.", out)
        else:
            out[prefix + k] = v


def parse_body(body: str | None) -> dict | None:
    """Dotted path -> value of every field of a JSON object; None where it is no valid JSON object."""
    try:
        doc = json.loads(body, parse_constant=_bad)
        if not isinstance(doc, dict):
            return None
        out: dict = {}
        _leaves(doc, "", out)
        return out
    except (ValueError, TypeError, RecursionError):
        return None


def _typed(v, want: str):
    """The value for a typed column, or None where it must be rescued."""
    if _json_type(v) != want or (want == "integer" and not -(2**63) <= v < 2**63):
        return None
    return json.dumps(v, sort_keys=True, ensure_ascii=False) if want == "array" else v


def ingest(records: DataFrame, target: dict[str, str], body: str = "body") -> DataFrame:
    """``records`` with its body replaced by typed columns, ``rescued``, ``body_state`` and ``broken_body``.

    ``target``: dotted path -> JSON type (a key of SPARK_TYPES). A body that is null or no JSON object is
    ``broken``: all typed columns null, its text kept in ``broken_body``. Explicit nulls are no values. Of a
    member written twice the last counts. Typed columns are named by their path with ``__`` for the dot; a column
    of ``records`` that has the name of an output column comes out as ``record_`` and its name.
    """
    taken = {column_name(p) for p in target} | {"rescued", "body_state", "broken_body"}
    for c in records.columns:
        if c in taken and c != body:
            records = records.withColumnRenamed(c, f"record_{c}")
    keep = [f for f in records.schema.fields if f.name != body]
    arrow = {"string": pa.string(), "integer": pa.int64(), "number": pa.float64(), "boolean": pa.bool_(), "array": pa.string()}
    kept = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {p: [] for p in target}
            rescued, state, broken = [], [], []
            for text in b.column(body).to_pylist():
                fields = parse_body(text)
                state.append("ok" if fields is not None else "broken")
                broken.append(None if fields is not None else text)
                rest = []
                fields = fields or {}
                for p, want in target.items():
                    v = fields.get(p)
                    typed = None if v is None else _typed(v, want)
                    cols[p].append(typed)
                    if typed is not None:
                        del fields[p]
                for p, v in fields.items():
                    if v is not None:
                        rest.append((p, json.dumps(v, sort_keys=True, ensure_ascii=False)))
                rescued.append(rest)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept]
                + [pa.array(cols[p], arrow[t]) for p, t in target.items()]
                + [pa.array(rescued, pa.map_(pa.string(), pa.string())), pa.array(state, pa.string()), pa.array(broken, pa.string())],
                names=kept + [column_name(p) for p in target] + ["rescued", "body_state", "broken_body"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{column_name(p)}` {SPARK_TYPES[t]}" for p, t in target.items()]
    schema = ", ".join([*fields, "rescued map<string,string>", "body_state string", "broken_body string"])
    return records.mapInArrow(run, schema)


def _decoded(raw: Column) -> Column:
    """The text of a JSON string; other JSON text as it is."""
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)


def promote(table: DataFrame, approved: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Replay rescued values into typed columns: column path -> (JSON type, rescued paths in order).

    A column that exists keeps its own values and takes rescued ones where it is null; a new column is added.
    Values that can't be cast stay rescued, as do those of paths not named.
    """
    out = table
    for path, (kind, sources) in approved.items():
        name, spark = column_name(path), SPARK_TYPES[kind]
        found = [F.col("rescued")[s] for s in sources]
        values = [_decoded(r).try_cast(spark) for r in found]
        have = F.col(name) if name in out.columns else F.lit(None).cast(spark)
        used = F.coalesce(have, *values)
        taken = F.array_compact(F.array(*[F.when(have.isNull() & v.isNotNull() & F.coalesce(*[x.isNull() for x in values[:i]], F.lit(True)), F.lit(s)) for i, (s, v) in enumerate(zip(sources, values))]))
        out = out.withColumn("__taken", taken).withColumn(name, used)
        out = out.withColumn("rescued", F.map_filter("rescued", lambda k, _: ~F.array_contains(F.col("__taken"), k))).drop("__taken")
    return out


def approved_renames(changes: DataFrame, target: dict[str, str]) -> dict[str, tuple[str, list[str]]]:
    """What :func:`promote` may replay: the other names that a target's fields had, by the ``renamed`` rows of :func:`field_changes`.

    Names are followed from rename to rename, in both directions, up to other fields of the target. What reaches
    the driver are pairs of field names, as many as a stream's schema has renames.
    """
    near: dict[str, set[str]] = {}
    for r in changes.where("change_kind = 'renamed'").select("field_path", "detail").distinct().toLocalIterator():
        near.setdefault(r["field_path"], set()).add(r["detail"])
        near.setdefault(r["detail"], set()).add(r["field_path"])
    out = {}
    for path, kind in target.items():
        seen, todo = {path}, [path]
        while todo:
            for n in sorted(near.get(todo.pop(), ())):
                if n not in seen and n not in target:
                    seen.add(n)
                    todo.append(n)
        if len(seen) > 1:
            out[path] = (kind, sorted(seen - {path}))
    return out


def rescued_json(col: str = "rescued") -> Column:
    """The rescued map as one JSON object; null where nothing was rescued."""
    parts = F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), e["value"]))
    return F.when(F.size(F.map_keys(col)) > 0, F.concat(F.lit("{"), F.concat_ws(",", parts), F.lit("}")))


def field_values(table: DataFrame, target: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per record and field: ``keep``, field_path, kind (JSON type), value (canonical text)."""
    typed = []
    for p, t in target.items():
        c = F.col(column_name(p))
        typed.append(F.when(c.isNotNull(), F.struct(F.lit(p).alias("field_path"), F.lit(t).alias("kind"), c.cast("string").alias("value"))))
    raw = F.col("e.value")
    kind = (
        F.when(raw.startswith('"'), "string")
        .when(raw.startswith("["), "array")
        .when(raw.isin("true", "false"), "boolean")
        .when(raw.rlike("^-?[0-9]+$"), "integer")
        .otherwise("number")
    )
    text = F.when(kind == "string", _decoded(raw)).when(kind == "number", raw.try_cast("double").cast("string")).otherwise(raw)
    known = table.select(*keep, F.explode(F.array_compact(F.array(*typed))).alias("f")).select(*keep, "f.*") if typed else None
    other = table.select(*keep, F.explode(F.map_entries("rescued")).alias("e")).select(*keep, F.col("e.key").alias("field_path"), kind.alias("kind"), text.alias("value"))
    return known.unionByName(other) if known is not None else other


def field_changes(values: DataFrame, files: DataFrame) -> DataFrame:
    """One row per change of a stream's file against the one before.

    ``values``: stream, file_no, subject_key, field_path, kind, value (see :func:`field_values`).
    ``files``: stream, file_no of all files, also those without a valid record. Gives stream, file_no (the
    later), change_kind (added, removed, type_changed, renamed), field_path, detail. A field is renamed when
    it went, another came, and every subject that gives the old one before and the new one now has equal
    values, at least one of them; several partners each come out. Rows without stream or file_no have no
    order and are left out; a null subject_key is no subject.
    """
    w = Window.partitionBy("stream").orderBy("file_no")
    order = materialize(
        files.select("stream", "file_no").where("stream IS NOT NULL AND file_no IS NOT NULL").distinct()
        .select("stream", "file_no", F.lag("file_no").over(w).alias("prev"), F.lead("file_no").over(w).alias("next")), "order"
    )
    profile = values.groupBy("stream", "file_no", "field_path").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).join(order, ["stream", "file_no"])
    now = profile.where("prev IS NOT NULL").select("stream", "file_no", "field_path", F.col("kinds").alias("new"), F.lit(None).cast("array<string>").alias("old"))
    then = profile.where("next IS NOT NULL").select("stream", F.col("next").alias("file_no"), "field_path", F.lit(None).cast("array<string>").alias("new"), F.col("kinds").alias("old"))
    both = now.unionByName(then).groupBy("stream", "file_no", "field_path").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "type_changed")
    # the changes are read four times below; they are few, so they are written once
    changes = both.select("stream", "file_no", "field_path", kind.alias("change_kind"), F.when(kind == "type_changed", F.concat(F.concat_ws("|", "old"), F.lit("->"), F.concat_ws("|", "new"))).otherwise("").alias("detail")).where("change_kind IS NOT NULL")
    changes = materialize(changes, "changes")

    # a subject's value of a field that went or came: its least and greatest digest, equal when it has one value
    moved = changes.where("change_kind IN ('added', 'removed')").select("stream", "file_no", "field_path", "change_kind")
    spots = moved.join(order.select("stream", "file_no", "prev"), ["stream", "file_no"]).select(
        "stream", F.when(F.col("change_kind") == "added", F.col("file_no")).otherwise(F.col("prev")).alias("at"), "field_path", "change_kind", F.col("file_no").alias("later")
    )
    digest = F.md5(F.concat(F.col("kind"), F.lit(":"), F.col("value")))
    # a file may hold a third of all records: its few changes go to its values, or hot files are salted
    given = values.where("subject_key IS NOT NULL")
    spots = spots.withColumnRenamed("at", "file_no")
    if stored_bytes(changes) * 4 <= BROADCAST_LIMIT_BYTES:
        at_spots = given.join(F.broadcast(spots), ["stream", "file_no", "field_path"])
    else:
        key = id16(F.concat_ws("\x1f", "stream", F.col("file_no").cast("string"), "field_path"))
        keyed = given.withColumn("__k", key)
        at_spots = skew_join(keyed, spots.select(key.alias("__k"), "change_kind", "later"), "__k", "inner", hot_keys(keyed, F.col("__k")), F.col("subject_key"))
    per_subject = (
        at_spots.groupBy("stream", "later", "change_kind", "field_path", "subject_key")
        .agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    )
    old = per_subject.where("change_kind = 'removed'").select("stream", "later", "subject_key", F.col("field_path").alias("old_path"), F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
    new = per_subject.where("change_kind = 'added'").select("stream", "later", "subject_key", F.col("field_path").alias("new_path"), "lo", "hi")
    renames = materialize(
        old.join(new, ["stream", "later", "subject_key"])
        .groupBy("stream", "later", "old_path", "new_path")
        .agg(F.bool_and((F.col("lo") == F.col("hi")) & (F.col("old_lo") == F.col("old_hi")) & (F.col("lo") == F.col("old_lo"))).alias("same"))
        .where("same")
        .select("stream", F.col("later").alias("file_no"), "old_path", "new_path"),
        "renames",
    )
    gone = renames.select("stream", "file_no", F.col("old_path").alias("field_path"), F.lit("removed").alias("change_kind")).unionByName(
        renames.select("stream", "file_no", F.col("new_path").alias("field_path"), F.lit("added").alias("change_kind"))
    )
    rest = changes.join(gone, ["stream", "file_no", "field_path", "change_kind"], "left_anti")
    named = renames.select("stream", "file_no", F.lit("renamed").alias("change_kind"), F.col("old_path").alias("field_path"), F.col("new_path").alias("detail"))
    return rest.select("stream", "file_no", "change_kind", "field_path", "detail").unionByName(named)
