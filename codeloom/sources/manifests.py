"""Reading manifests: packages, path aliases, workspaces, crates. They are few and small, so they are parsed one text at a time."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
# a string, a comment, or a comma with only white space and comments before its closing bracket
JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?(?:\*/|$)|,(?=(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*[}\]])')
ROOT_ALIASES = "array<struct<scope_dir:string,ord:int,prefix:string,target:string>>"


def package_deps(manifests: DataFrame, sections=SECTIONS) -> DataFrame:
    """package_json, section, package from manifests (path, source); unreadable JSON has no packages."""
    kinds = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    parsed = manifests.select(F.col("path").alias("package_json"), F.from_json("source", kinds).alias("m"))
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), F.map_keys(F.col(f"m.{s}")).alias("names")) for s in sections])
    return parsed.select("package_json", F.explode(pairs).alias("p")).select("package_json", "p.section", F.explode("p.names").alias("package"))


def strip_jsonc(text: str) -> str:
    """Without comments and trailing commas, in one pass; strings stay as they are."""
    return JSONC.sub(lambda m: m[1] or ("" if m[0] == "," else " "), text)


def load_json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def tsconfig_aliases(path: str, text: str) -> list[tuple[str | None, int, str, str]]:
    """(scope_dir, ord, prefix, target) of ``compilerOptions.paths``.

    The root configuration gives global aliases (scope_dir None), others are
    scoped to their folder and rebased on it and ``baseUrl``. Absolute targets
    and targets that climb out are refused.
    """
    data = load_json(strip_jsonc(text))
    options = (data or {}).get("compilerOptions") if isinstance(data, dict) else None
    paths = (options or {}).get("paths") if isinstance(options, dict) else None
    if not isinstance(paths, dict):
        return []
    here = posixpath.dirname(path)
    base = options.get("baseUrl") or "."
    out: list[tuple[str | None, int, str, str]] = []
    for key, targets in paths.items():
        for t in targets if isinstance(targets, list) else []:
            if not isinstance(t, str) or t.startswith("/") or ".." in t.split("/"):
                continue
            full = posixpath.normpath(posixpath.join(here, base, t.removesuffix("*")))
            if full.startswith(".."):
                continue
            full = "" if full == "." else full
            out.append((here or None, len(out), key.removesuffix("*"), full + "/" if t.endswith("*") and full else full))
    return out


def _first_string(value) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        for k in ("import", "default"):
            if k in value and (s := _first_string(value[k])):
                return s
        for v in value.values():
            if s := _first_string(v):
                return s
    return None


def workspace_aliases(path: str, text: str) -> list[tuple[str, str]]:
    """(prefix, target) of a scoped package in the tree: its name, its name with a slash, and each key of ``exports``."""
    data = load_json(text)
    name = data.get("name") if isinstance(data, dict) else None
    if not isinstance(name, str) or not (name.startswith("@") or "/" in name):
        return []
    here = posixpath.dirname(path)
    place = here + "/" if here else ""
    out = []
    exported = data.get("exports")
    if isinstance(exported, dict):
        for key, value in exported.items():
            target = _first_string(value)
            if target and key.startswith("."):
                sub, target = key[1:].split("*")[0], target.removeprefix("./")
                target = target.split("*")[0] if "*" in key else target
                out.append((name + sub, place + target))
    main = [(name, place + data["main"].removeprefix("./"))] if isinstance(data.get("main"), str) else []
    return [*out, (name + "/", place), *main, (name, here)]


def is_published(path: str, text: str) -> bool:
    """A named package below ``packages/`` that is not private."""
    data = load_json(text)
    return path.startswith("packages/") and isinstance(data, dict) and isinstance(data.get("name"), str) and data.get("private") is not True


def declared_crates(manifests: DataFrame) -> DataFrame:
    """path, class of the targets that crates name."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [x for path, text in zip(pdf["path"], pdf["source"]) for x in cargo_targets(path, text)]
            yield pd.DataFrame(out, columns=["path", "class"])

    rows = manifests.where(F.col("path").rlike(r"(^|/)Cargo\.toml$") & F.col("source").isNotNull())
    return rows.select("path", "source").mapInPandas(run, "path string, class string").distinct()


def crate_names(manifests: DataFrame) -> DataFrame:
    """root, name: the source folder of a crate and the name in its ``[package]``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["source"]):
                try:
                    name = (tomllib.loads(text).get("package") or {}).get("name")
                except (tomllib.TOMLDecodeError, AttributeError):
                    name = None
                if isinstance(name, str):
                    here = posixpath.dirname(path)
                    out.append((f"{here}/src" if here else "src", name))
            yield pd.DataFrame(out, columns=["root", "name"])

    rows = manifests.where(F.col("path").rlike(r"(^|/)Cargo\.toml$") & F.col("source").isNotNull())
    return rows.select("path", "source").mapInPandas(run, "root string, name string").distinct()


def cargo_targets(path: str, text: str) -> list[tuple[str, str]]:
    """(path, class): the library and binaries of a crate are framework entries, its tests, benches and examples implicit ones."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    here = posixpath.dirname(path)
    join = lambda p: posixpath.normpath(posixpath.join(here, p))
    out = [(join(data["lib"]["path"]), "framework")] if isinstance(data.get("lib"), dict) and "path" in data["lib"] else []
    for b in data.get("bin", []):
        if "path" in b or "name" in b:
            out.append((join(b.get("path") or f"src/bin/{b['name']}.rs"), "framework"))
    for kind in ("test", "bench", "example"):
        out += [(join(x["path"]), "implicit") for x in data.get(kind, []) if "path" in x]
    return out


def workspace_globs(text: str) -> list[str]:
    """Folders of the ``packages:`` list of a workspace YAML, in block or flow form; ``x/*`` gives ``x/``, exclusions are dropped."""
    m = re.search(r"^packages:[^\S\n]*(\[[^\]]*\]|(?:[^\S\n]*(?:#[^\n]*)?\n(?:\s*-[^\n]*|[ \t]*#[^\n]*|\s*$)?)+)", text, re.M)
    if not m:
        return []
    items = m[1].strip("[]").split(",") if m[1].startswith("[") else [x.strip()[1:] for x in m[1].split("\n") if x.strip().startswith("-")]
    found = [x.strip().strip("\"").strip("'") for x in items]
    return [re.sub(r"/\*\*?/?$", "/", g) for g in found if g and not g.startswith("!")]


TSCONFIG_DEPTH, PACKAGE_DEPTH = 6, 5
# Parts of paths of configurations that are generated or belong to fixtures.
UNREAD_CONFIGS = ("node_modules", ".svelte-kit", "dist/", ".next/", ".nuxt/", "fixtures/", "test-fixtures", "__test__")


def _configures(path: Column) -> Column:
    """Whether aliases are read from a manifest: not too deep, generated or a fixture's."""
    depth = F.size(F.split(path, "/"))
    config = path.rlike(r"(^|/)tsconfig[^/]*\.json$") & (depth <= TSCONFIG_DEPTH)
    for part in UNREAD_CONFIGS:
        config = config & ~path.contains(part)
    return (path == "tsconfig.json") | config | (path.rlike(r"(^|/)package\.json$") & (depth <= PACKAGE_DEPTH) & ~path.contains("node_modules"))


def aliases(manifests: DataFrame) -> DataFrame:
    """scope_dir, ord, prefix, target from all configuration files (path, source), scoped ones with their folder, in the order that resolution tries them."""
    rows = manifests.where(F.col("source").isNotNull() & _configures(F.col("path")))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["source"]):
                if path.endswith("package.json"):
                    out += [(None, 100_000 + i, p, t) for i, (p, t) in enumerate(workspace_aliases(path, text))]
                else:
                    out += tsconfig_aliases(path, text)
            yield pd.DataFrame(out, columns=["scope_dir", "ord", "prefix", "target"])

    return rows.select("path", "source").mapInPandas(run, "scope_dir string, ord int, prefix string, target string")
