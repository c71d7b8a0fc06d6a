"""Workspace manifests and client declarations in, reports out: strict JSON on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import is_object_id, is_path_template, is_safe_path

#: Shapes of the JSON documents that are read; unknown members are ignored, missing ones are null.
WORKSPACE = "workspace_identity string, provider struct<repository_identity:string,revision:string,root:string,contract_path:string,contract_sha256:string,service_authority:string>, clients array<struct<role:string,root:string,declaration_path:string,declaration_sha256:string>>"
CLIENT = "role string, repository_identity string, revision string, source_path string, symbol_identity string, binding struct<kind:string,service_authority:string,method:string,path_template:string,operation_id:string,service_hint:string,operation_hint:string>"
NESTED = "repositories array<struct<path:string,root:string,revision:string>>"
BINDING = "repository struct<identity:string,commit_oid:string,tree_oid:string>, artifact struct<sha256:string,byte_length:bigint>, documents struct<coverage_mode:string,indexed:array<struct<path:string,blob_oid:string,byte_length:bigint,sha256:string>>,omitted:array<string>>"
IMPACT = "baseline struct<revision:string,source_path:string>, target struct<revision:string,source_path:string>, clients array<struct<path:string>>, federation_report string"


def read_documents(texts: DataFrame, text: str, shape: str) -> DataFrame:
    """``texts`` with ``document`` (a struct of ``shape``) and ``broken``: whether the text is no such document.

    Null text is broken. Nothing is inferred; a value of another type breaks the document.
    """
    doc = F.from_json(F.col(text), f"{shape}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = texts.withColumn("__d", doc)
    broken = F.col("__d").isNull() | F.col("__d._corrupt").isNotNull()
    return rows.select(*texts.columns, F.when(~broken, F.col("__d").dropFields("_corrupt")).alias("document"), broken.alias("broken"))


def client_bindings(clients: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of client documents (document of shape CLIENT) with the faults of their declarations: ``keep``, client columns, problem.

    An explicit binding needs a method and a path template, a heuristic one its two hints.
    """
    d, b = F.col("document"), F.col("document.binding")
    explicit, hints = b["kind"] == "explicit", b["kind"] == "heuristic"
    problem = (
        F.when(F.col("broken"), "malformed")
        .when(~F.coalesce(is_object_id(d["revision"]), F.lit(False)), "revision")
        .when(~F.coalesce(is_safe_path(d["source_path"]), F.lit(False)), "source_path")
        .when(explicit & ~F.coalesce(is_path_template(b["path_template"]) & b["method"].isNotNull(), F.lit(False)), "explicit_binding")
        .when(hints & (b["service_hint"].isNull() | b["operation_hint"].isNull()), "heuristic_binding")
        .when(~F.coalesce(explicit | hints, F.lit(False)), "binding_kind")
    )
    return clients.select(*(keep or ()), d["repository_identity"].alias("client_id"), d["source_path"].alias("source_path"), d["symbol_identity"].alias("symbol"), b.alias("binding"), problem.alias("problem"))


def report(families: dict[str, DataFrame], key: dict[str, str]) -> DataFrame:
    """One table of a report: family, id, body (the row as JSON with sorted members)."""
    out = None
    for name, df in sorted(families.items()):
        part = df.select(F.lit(name).alias("family"), F.col(key[name]).cast("string").alias("id"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def summary(families: dict[str, DataFrame]) -> DataFrame:
    """family, rows: the counters of a report; a family without rows counts 0."""
    out = None
    for name, df in sorted(families.items()):
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("family"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def unresolved(families: dict[str, DataFrame], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """family, id: values of (family, column) that are not in (other family, its column); no row means the report is closed."""
    out = None
    for name, column, other, its in references:
        known = families[other].select(F.col(its).alias("id")).distinct()
        part = families[name].select(F.lit(name).alias("family"), F.col(column).alias("id")).where("id IS NOT NULL").join(known, "id", "left_anti").select("family", "id")
        out = part if out is None else out.unionByName(part)
    return out


def family_of(one: Column) -> Column:
    """The family that an id's form names; null for a text that is no id: what tells an unknown id from an invalid one."""
    return F.nullif(F.regexp_extract(one, r"^urn:[a-z][a-z0-9-]*:([a-z-]+):(?:sha256|blake3):[0-9a-f]{64}$", 1), F.lit(""))
