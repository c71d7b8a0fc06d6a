"""Cargo manifests and .gitmodules files into fact rows."""

from __future__ import annotations

import hashlib
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = ("kind", "section", "name", "value", "detail")


def _digest(v: str) -> str:
    return hashlib.sha256(v.encode()).hexdigest()


def dependency(name: str, spec, kind: str, target: str = "") -> tuple:
    """One dependency: its source kind, and where it comes from as a digest where it is a locator."""
    s = {"version": spec} if isinstance(spec, str) else spec if isinstance(spec, dict) else {}
    if s.get("workspace"):
        source, where = "workspace", ""
    elif "path" in s:
        source, where = "path", str(s["path"])
    elif "git" in s:
        source, where = "git", _digest(str(s["git"]))
    else:
        source, where = "registry", str(s.get("version", ""))
    package = str(s.get("package", name))
    return ("cargo.dependency", f"{kind}{':' + target if target else ''}", name, source, f"{package}|{where}|{'optional' if s.get('optional') else ''}|{','.join(map(str, s.get('features', [])))}")


def manifest_facts(text: str) -> list[tuple]:
    """Packages, targets, dependencies, features, patches and workspace members of a manifest, in order; broken text one gap."""
    try:
        t = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return [("gap", "", "cargo.malformed_manifest", "", "")]
    out: list[tuple] = []
    pkg, ws = t.get("package"), t.get("workspace")
    shape = "non_virtual" if pkg and ws else "standalone" if pkg else "virtual" if ws else "none"
    out.append(("cargo.manifest", "", shape, "", ""))
    if isinstance(pkg, dict):
        for k in ("name", "version", "edition", "build", "links"):
            v = pkg.get(k)
            if isinstance(v, dict) and v.get("workspace"):
                out.append(("cargo.package", "package", k, "workspace", ""))
            elif isinstance(v, (str, bool)):
                out.append(("cargo.build_script" if k == "build" else "cargo.package", "package", k, str(v).lower() if isinstance(v, bool) else v, ""))
    for kind in ("lib", "bin", "example", "test", "bench"):
        for x in [t[kind]] if isinstance(t.get(kind), dict) else t.get(kind, []) if isinstance(t.get(kind), list) else []:
            out.append(("cargo.target", kind, str(x.get("name", "")), str(x.get("path", "")), ""))

    def deps(section: dict, target: str = "") -> None:
        for key, kind in (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for name, spec in (section.get(key) or {}).items():
                out.append(dependency(name, spec, kind, target))

    deps(t)
    for cfg, section in (t.get("target") or {}).items():
        if isinstance(section, dict):
            deps(section, cfg)
    for name, members in (t.get("features") or {}).items():
        for m in members if isinstance(members, list) else []:
            out.append(("cargo.feature", name, str(m), "", ""))
        if not members:
            out.append(("cargo.feature", name, "", "", ""))
    for registry, section in (t.get("patch") or {}).items():
        for name, spec in (section if isinstance(section, dict) else {}).items():
            out.append(("cargo.patch", _digest(registry) if "://" in registry else registry, *dependency(name, spec, "patch")[2:]))
    if isinstance(ws, dict):
        for key in ("members", "exclude"):
            for m in ws.get(key, []):
                out.append(("cargo.workspace_member", key, str(m), "", ""))
        for k, v in (ws.get("package") or {}).items():
            out.append(("cargo.workspace_package_defaults", "workspace.package", k, str(v), ""))
        for name, spec in (ws.get("dependencies") or {}).items():
            out.append(dependency(name, spec, "workspace"))
    return out


def conventional_targets(paths: list[str], package: str) -> list[tuple[str, str, str]]:
    """(kind, name, path) of the targets a package has by its files' places; a bin in both forms is ambiguous."""
    have, out = set(paths), []
    if "src/lib.rs" in have:
        out.append(("lib", package.replace("-", "_"), "src/lib.rs"))
    if "src/main.rs" in have:
        out.append(("bin", package, "src/main.rs"))
    bins: dict[str, list[str]] = {}
    for p in sorted(have):
        if m := re.fullmatch(r"src/bin/([^/]+)\.rs", p) or re.fullmatch(r"src/bin/([^/]+)/main\.rs", p):
            bins.setdefault(m.group(1), []).append(p)
    for name, places in bins.items():
        out.append(("bin" if len(places) == 1 else "ambiguous", name, places[0]))
    return out


def gitmodules(data: bytes) -> list[tuple]:
    """(name digest, path, url, start, end, unsupported keys) of every submodule section, with byte spans."""
    out: list[list] = []
    at = 0
    for raw in data.splitlines(keepends=True):
        line = raw.decode("utf-8", "replace").strip()
        if m := re.fullmatch(r'\[submodule "((?:[^"\\]|\\.)*)"\]', line):
            out.append([_digest(m.group(1)), "", "", at, at + len(raw), []])
        elif line and line[0] not in "#;" and out:
            key, _, value = (x.strip() for x in line.partition("="))
            if key == "path":
                out[-1][1] = value
            elif key == "url":
                out[-1][2] = value
            else:
                out[-1][5].append(key)
            out[-1][4] = at + len(raw)
        at += len(raw)
    return [tuple(x[:5]) + (sorted(x[5]),) for x in out]


def cargo_facts(files: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and the fact columns for every fact of every manifest text; null texts give none."""
    rows = files.select(*keep, files[text].alias("__text")).where("__text IS NOT NULL")
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields if x.name in keep), *(f"{c} string" for c in FACTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("__text").to_pylist()):
                got = manifest_facts(t)
                at += [i] * len(got)
                out += got
            picked = b.take(pa.array(at, pa.int64()))
            cols = list(zip(*out)) if out else [()] * len(FACTS)
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in keep), *(pa.array(c, pa.string()) for c in cols)], names=[*keep, *FACTS])

    return rows.mapInArrow(run, schema)
