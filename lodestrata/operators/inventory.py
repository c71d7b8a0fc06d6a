"""Inventory of files: classification, consecutive revisions, boundaries of nested repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(files: DataFrame) -> DataFrame:
    """``files`` (path, mode, bytes, others) with roles, languages, rules, recognized_kind, sentinel, unsupported, content_kind.

    Roles, languages and rules are sorted and distinct. A null path is classified as unsupported; null bytes
    are no text.
    """
    path = F.coalesce("path", F.lit(""))
    base = F.substring_index(path, "/", -1)
    rust, shell = path.endswith(".rs"), path.endswith(".sh")
    cargo = base == "Cargo.toml"
    contract = base.isin("openapi.yaml", "openapi.yml") & F.coalesce(F.substring("bytes", 1, 8) == F.lit(b"openapi:"), F.lit(False))
    rustfmt, owners, readme = base == "rustfmt.toml", path == ".github/CODEOWNERS", base == "README.md"
    build, script = path == "build.rs", shell & F.coalesce(F.col("mode") == "100755", F.lit(False))
    pick = lambda pairs: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, v) for c, v in pairs]))))
    roles = pick([(rust | shell, "source"), (cargo, "manifest"), (contract, "contract"), (rustfmt, "configuration"), (owners, "ownership"), (readme, "documentation"), (build | script, "sentinel")])
    rules = pick(
        [
            (F.lit(True), "git-tree-entry"), (rust, "language:rust"), (shell, "language:shell"), (cargo, "manifest:cargo"), (contract, "contract:openapi"),
            (rustfmt, "configuration:rustfmt"), (owners, "ownership:github-codeowners"), (readme, "documentation:readme"),
            (build, "sentinel:build-script"), (script, "sentinel:executable-script"), (F.size(roles) == 0, "unsupported:fallback"),
        ]
    )
    kind = F.when(cargo, "cargo_manifest").when(contract, "openapi_contract").when(rustfmt, "rustfmt_configuration").when(owners, "github_codeowners").when(readme, "readme_documentation")
    text = (F.size(roles) > 0) & F.coalesce(F.is_valid_utf8("bytes"), F.lit(False))
    return files.select(
        "*", F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("unsupported"))).alias("roles"), pick([(rust, "rust"), (shell, "shell")]).alias("languages"), rules.alias("rules"),
        kind.alias("recognized_kind"), (build | script).alias("sentinel"), (F.size(roles) == 0).alias("unsupported"), F.when(text, "text_utf8").otherwise("binary_or_unknown").alias("content_kind"),
    )


def inventory_diff(baseline: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Added, modified and deleted ``keys`` between two inventories, with both sides' ``values`` (old_, new_).

    Values are compared null-safely; each side must hold a key once. Equal rows do not come out.
    """
    old = baseline.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("__old"))
    new = target.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("__new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(~same, "modified")
    both = old.join(new, keys, "full_outer")
    return both.select(*keys, kind.alias("change_kind"), *[f"old_{v}" for v in values], *[f"new_{v}" for v in values]).where("change_kind IS NOT NULL")


def identity_delta(baseline: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: whether it is in both, added or removed, and whether it is invalidated (gone or other value)."""
    old = baseline.select(key, F.col(value).alias("__o"), F.lit(True).alias("__old"))
    new = target.select(key, F.col(value).alias("__n"), F.lit(True).alias("__new"))
    both = old.join(new, key, "full_outer")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("retained")
    invalid = F.col("__old").isNotNull() & (F.col("__new").isNull() | ~F.col("__o").eqNullSafe(F.col("__n")))
    return both.select(key, status.alias("status"), invalid.alias("invalidated"))


def boundary_report(gitlinks: DataFrame, declared: DataFrame, nested: DataFrame) -> DataFrame:
    """State and gap codes of every boundary path: ``gitlinks`` (path, oid), ``declared`` (path), ``nested`` (path, oid).

    A path is unique in each. A declaration without gitlink is an orphan; a nested revision that is not the
    gitlink's is state ``invalid``.
    """
    g = gitlinks.select("path", F.col("oid").alias("__link"))
    d = declared.select("path", F.lit(True).alias("__declared"))
    n = nested.select("path", F.col("oid").alias("__nested"))
    rows = g.join(d, "path", "full_outer").join(n, "path", "left")
    link, dec, bound = F.col("__link").isNotNull(), F.coalesce("__declared", F.lit(False)), F.col("__nested").isNotNull()
    state = F.when(~link, "orphan_declaration").when(bound & (F.col("__nested") != F.col("__link")), "invalid").when(bound, "explicitly_bound").when(dec, "declared_unbound").otherwise("undeclared_unbound")
    codes = F.array_sort(
        F.array_compact(
            F.array(
                F.when(link & bound, "boundary.nested_repository_not_analyzed"), F.when(link & ~bound, "boundary.nested_repository_unbound"),
                F.when(link & ~dec, "boundary.gitmodules_declaration_missing"), F.when(~link, "boundary.gitmodules_declaration_orphan"),
            )
        )
    )
    return rows.select("path", state.alias("state"), codes.alias("gaps"))
