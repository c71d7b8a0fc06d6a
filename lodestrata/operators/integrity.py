"""Invariants of a graph as one table of violations, and hashes over whole generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.scalars import is_transition

#: Hexadecimal digits of a key's digest that name the part a row is hashed in, and those of the part's own part:
#: 16.7 million parts in 4,096, so that 10^11 rows of one group still make lists of some 6,000.
PART_DIGITS, UPPER_DIGITS = 6, 3


def violations(entities: DataFrame, relationships: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """rule, subject_id of every broken invariant; no row means the graph is sound.

    entities (id), relationships (id, source, target), claims (id, subject_id), evidence (id, path, start_byte, end_byte).
    """
    known = entities.select("id").distinct()
    twice = lambda df, rule: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col("id").alias("subject_id"))
    dangling = lambda side: relationships.select(F.col("id").alias("subject_id"), F.col(side).alias("id")).join(known, "id", "left_anti").select(F.lit(f"relationship.{side}_missing").alias("rule"), "subject_id")
    subjects = known.unionByName(relationships.select("id")).distinct()
    parts = [
        twice(entities, "entity.duplicate_id"), twice(relationships, "relationship.duplicate_id"), twice(claims, "claim.duplicate_id"),
        dangling("source"), dangling("target"),
        claims.select(F.col("id").alias("subject_id"), F.col("subject_id").alias("id")).join(subjects, "id", "left_anti").select(F.lit("claim.subject_missing").alias("rule"), "subject_id"),
        evidence.where("start_byte < 0 OR end_byte < start_byte OR start_byte IS NULL OR end_byte IS NULL").select(F.lit("evidence.bad_span").alias("rule"), F.col("id").alias("subject_id")),
        evidence.where("path IS NULL OR path = ''").select(F.lit("evidence.no_path").alias("rule"), F.col("id").alias("subject_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Rows of ``history`` (subject_id, old_state, new_state) that are no legal transition of a claim."""
    return history.where(~is_transition(F.col("old_state"), F.col("new_state")) | F.col("old_state").isNull() | F.col("new_state").isNull())


def generation_hash(rows: DataFrame, group: list[str], key: str, payload: list[str]) -> DataFrame:
    """One digest per group over its rows in key order, as a three-level hash: ``group``, digest, rows.

    Rows are hashed in parts by their key's digest, parts in larger parts, and these give the group's digest,
    always in part order. No group is gathered whole in one task, and equal contents give equal digests.
    """
    part = F.substring(F.sha2(F.col(key), 256), 1, PART_DIGITS)
    entry = F.to_json(F.array(F.col(key), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload]))
    parts = rows.select(*group, part.alias("__part"), entry.alias("__entry")).groupBy(*group, "__part").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("__entry")), "\n"), 256).alias("__h"), F.count(F.lit(1)).alias("__n")
    )
    joined = lambda p, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(p, h))), lambda x: x[h]), "\n"), 256)
    upper = parts.groupBy(*group, F.substring("__part", 1, UPPER_DIGITS).alias("__up")).agg(joined("__part", "__h").alias("__uh"), F.sum("__n").alias("__un"))
    return upper.groupBy(*group).agg(joined("__up", "__uh").alias("digest"), F.sum("__un").alias("rows"))


def equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: the rows that only one of two tables has; both 0 when they are equal as bags."""
    cols = sorted(a.columns)
    only = lambda x, y, side: x.select(*cols).exceptAll(y.select(*cols)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return only(a, b, "only_left").unionByName(only(b, a, "only_right"))


def identity_union(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(union by id, conflicts): rows of one id must be equal; those that differ are conflicts and not in the union."""
    both = a.unionByName(b).distinct()
    twice = both.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return both.join(twice, key, "left_anti"), twice


class LimitExceeded(ValueError):
    """A table has more rows than its limit allows."""


def within_limit(rows: DataFrame, limit: int, name: str) -> DataFrame:
    """``rows`` if there are at most ``limit``; else an error, never a cut table. Counting stops after the limit."""
    if rows.limit(limit + 1).count() > limit:
        raise LimitExceeded(f"{name}: more than {limit}")
    return rows


def denied_fields(schema: T.StructType, denied: set[str]) -> list[str]:
    """Dotted paths of the fields, at any depth, whose name is denied: a privacy check of what is to be published."""
    out: list[str] = []

    def walk(t: T.DataType, at: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                path = f"{at}.{f.name}" if at else f.name
                if f.name.lower() in denied:
                    out.append(path)
                walk(f.dataType, path)
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, at)
        elif isinstance(t, T.MapType):
            walk(t.valueType, at)

    walk(schema, "")
    return out
