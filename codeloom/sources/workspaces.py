"""Discovery of a project: the kind of monorepo, its packages, frameworks and declared entry points.

All of it reads manifests (path, source) and the paths of the tree. Only the
texts of the root's own configuration, five at most, and one row of flags reach
the driver; packages stay tables.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import location
from codeloom.functions.text import normalize_entry, parent_dir
from codeloom.operators.entries import PROFILES
from codeloom.sources.manifests import is_published, load_json, workspace_globs

ROOT_FILES = ("package.json", "pnpm-workspace.yaml", "pnpm-workspace.yml", "turbo.json", "nx.json")
# Default entry files of a workspace package.
PACKAGE_ENTRIES = ("src/index.ts", "src/index.tsx", "src/main.ts", "src/main.tsx", "index.ts", "main.ts", "src/main.rs", "src/lib.rs")
# Default files below the source root of an Nx project.
NX_ENTRIES = ("index.ts", "index.tsx", "main.ts", "main.tsx")
# First-level folders that are not looked into for frameworks.
UNSEEN_DIRS = ("node_modules", "dist", "build", "target", "benchmarks", "fixtures", "tools")
# Packages of Nx plug-ins and the names reported for them.
NX_PLUGINS = {
    "@nx/react": "nx-react", "@nx/next": "nx-next", "@nx/angular": "nx-angular", "@nx/vue": "nx-vue", "@nx/express": "nx-express", "@nx/nest": "nx-nest", "@nx/node": "nx-node", "@nx/web": "nx-web", "@nx/js": "nx-js", "@nx/storybook": "nx-storybook",
    "@nrwl/react": "nx-react", "@nrwl/angular": "nx-angular", "@nrwl/vue": "nx-vue", "@nrwl/express": "nx-express", "@nrwl/nest": "nx-nest", "@nrwl/node": "nx-node", "@nrwl/web": "nx-web",
}
MOST_PUBLISHED_DEPTH = 4


def glob_prefix(pattern: str) -> str:
    """The folder of a workspace pattern: ``x/*``, ``x/**`` and ``x/**/`` give ``x/``, anything else stays."""
    m = re.fullmatch(r"(.*)/(?:\*|\*\*|\*\*/)", pattern)
    return m[1] + "/" if m else pattern


def package_workspaces(text: str | None) -> list[str] | None:
    """The prefixes in a package's ``workspaces``, a list or an object with ``packages``; None if it has no such field."""
    data = load_json(text) if text else None
    if not isinstance(data, dict) or "workspaces" not in data:
        return None
    found = data["workspaces"]
    if isinstance(found, dict):
        found = found.get("packages")
    return [glob_prefix(x) for x in found if isinstance(x, str)] if isinstance(found, list) else []


def package_names(text: str | None) -> set[str]:
    """A package's own name and those of its dependencies and devDependencies."""
    data = load_json(text) if text else None
    if not isinstance(data, dict):
        return set()
    own = {data["name"]} if isinstance(data.get("name"), str) else set()
    return own.union(*(d.keys() for k in ("dependencies", "devDependencies") if isinstance(d := data.get(k), dict)))


def monorepo(manifests: DataFrame) -> tuple[str | None, list[str]]:
    """(kind, prefixes of the packages): pnpm, turborepo, nx or npm/yarn, the first that the root's files show; no kind and no prefixes otherwise."""
    at = {r["path"]: r["source"] for r in manifests.where(F.col("path").isin(*ROOT_FILES)).select("path", "source").collect()}
    yaml = next((at[p] for p in ("pnpm-workspace.yaml", "pnpm-workspace.yml") if at.get(p) is not None), None)
    listed = package_workspaces(at.get("package.json"))
    if yaml is not None:
        return "pnpm", workspace_globs(yaml)
    if "turbo.json" in at:
        return "turborepo", listed or []
    if "nx.json" in at or {"nx", "@nrwl/workspace"} & package_names(at.get("package.json")):
        return "nx", listed or []
    return ("npm/yarn", listed) if listed is not None else (None, [])


def nx_plugins(manifests: DataFrame) -> list[str]:
    """Names of the Nx plug-ins that the root package depends on, once each, in the order of the table."""
    row = manifests.where("path = 'package.json'").select("source").first()
    deps = package_names(row["source"]) if row else set()
    return list(dict.fromkeys(v for k, v in NX_PLUGINS.items() if k in deps))


def _below(prefixes: list[str], path):
    """The folder directly below the first matching prefix that a path lies in, null for other paths."""
    safe = [p.rstrip("/") for p in prefixes if not p.startswith("/") and ".." not in re.split(r"[/\\]", p) and "*" not in p]
    at = [F.when(path.startswith(p + "/"), F.regexp_extract(path, "^(" + re.escape(p) + r"/[^/]+)/", 1)) for p in safe if p]
    found = F.coalesce(*at) if at else F.lit(None).cast("string")
    return F.when(found == "", None).otherwise(found)


def package_dirs(paths: DataFrame, prefixes: list[str]) -> DataFrame:
    """dir of the workspace packages: a prefix with a manifest of its own, else every folder below it; hidden folders and node_modules are none."""
    own = [p.rstrip("/") for p in prefixes]
    leaves = paths.where(F.col("path").isin(*[f"{p}/package.json" for p in own])).select(parent_dir(F.col("path")).alias("dir")).distinct() if own else None
    if leaves is None:
        return paths.select(F.lit("").alias("dir")).limit(0)
    inner = paths.select(_below(prefixes, F.col("path")).alias("dir")).where("dir is not null").distinct()
    inner = inner.where(~F.substring_index("dir", "/", -1).rlike(r"^(\.|node_modules$)")).withColumn("parent", parent_dir(F.col("dir")))
    inner = inner.join(leaves.select(F.col("dir").alias("parent")), "parent", "left_anti").select("dir")
    return leaves.union(inner).distinct()


def _flags(paths: DataFrame, names: DataFrame) -> set[str]:
    """The profiles that a marker file (path below its folder) or a package (name) shows."""
    known = [n for n in PROFILES if n != "generic"]
    any_of = lambda c, xs: F.coalesce(F.bool_or(F.col(c).isin(*xs)), F.lit(False)) if xs else F.lit(False)
    by_file = paths.agg(*[any_of("path", PROFILES[n]["markers"]).alias(n) for n in known]).first()
    by_name = names.agg(*[any_of("name", PROFILES[n]["deps"]).alias(n) for n in known]).first()
    return {n for n in known if by_file[n] or by_name[n]}


def manifest_names(manifests: DataFrame) -> DataFrame:
    """dir, name: every package manifest's own name and the packages it depends on."""
    kinds = "name string, dependencies map<string,string>, devDependencies map<string,string>"
    rows = manifests.where(F.col("path").rlike(r"(^|/)package\.json$")).select(F.when(F.col("path").contains("/"), parent_dir(F.col("path"))).otherwise(F.lit("")).alias("dir"), F.from_json("source", kinds).alias("m"))
    empty = F.array().cast("array<string>")
    names = F.concat(F.array("m.name"), F.coalesce(F.map_keys("m.dependencies"), empty), F.coalesce(F.map_keys("m.devDependencies"), empty))
    return rows.where("m is not null").select("dir", F.explode(names).alias("name")).where("name is not null")


def detect_frameworks(paths: DataFrame, manifests: DataFrame) -> list[str]:
    """Names of the profiles that apply, the generic one last.

    A profile applies if one of its marker files or packages is at the root. If
    that shows one profile at most, the packages of a monorepo are looked at, and
    if there is still one at most, the first-level folders.
    """
    names = manifest_names(manifests)
    found = _flags(paths.select("path"), names.where("dir = ''"))
    order = [n for n in PROFILES if n in found]
    below = paths.where("path is not null").select("path")

    def look(dirs: DataFrame) -> None:
        spread = reduce(lambda a, b: a.union(b), [below.select(F.regexp_extract("path", r"^((?:[^/]+/){%d})" % k, 1).alias("dir"), "path") for k in (1, 2, 3)]).where("dir <> ''")
        inside = spread.withColumn("dir", F.expr("substring(dir, 1, length(dir) - 1)")).join(dirs, "dir", "left_semi")
        hits = _flags(inside.select(F.expr("substring(path, length(dir) + 2)").alias("path")), names.join(dirs, "dir", "left_semi"))
        order.extend(n for n in PROFILES if n in hits and n not in order)

    if len(order) <= 1:
        kind, prefixes = monorepo(manifests)
        if kind:
            look(package_dirs(below, prefixes))
        if len(order) <= 1:
            look(below.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("dir")).distinct().where(~F.col("dir").startswith(".") & ~F.col("dir").isin(*UNSEEN_DIRS)))
    return [*order, "generic"]


def published_dirs(manifests: DataFrame) -> DataFrame:
    """prefix: the folders of named packages below ``packages/`` that are not private, up to MOST_PUBLISHED_DEPTH names deep."""
    rows = manifests.where(F.col("path").rlike(r"^packages/(?:[^/]+/)*package\.json$") & ~F.col("path").contains("node_modules") & (F.size(F.split("path", "/")) <= MOST_PUBLISHED_DEPTH))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p.rsplit("/", 1)[0],) for p, t in zip(pdf["path"], pdf["source"]) if t is not None and is_published(p, t)], columns=["prefix"])

    return rows.select("path", "source").mapInPandas(run, "prefix string").distinct()


def probed(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(…, base) → with ``path``, the first that is a file: the base, with ``.js`` as ``.ts``, or an index.ts in it; the others are dropped."""
    base = F.col("base")
    typed = F.regexp_replace(F.regexp_replace(base, r"\.js", ".ts"), r"\.jsx", ".tsx")
    tried = bases.select(*bases.columns, F.posexplode(F.array(base, typed, F.concat(F.regexp_replace(F.regexp_replace(base, r"(\.ts)+$", ""), r"(\.js)+$", ""), F.lit("/index.ts")))).alias("_o", "path"))
    hit = tried.join(files.select("path").distinct(), "path", "left_semi")
    return hit.groupBy(*bases.columns).agg(F.min_by("path", "_o").alias("path"))


def _strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    return [s for v in value.values() for s in _strings(v)] if isinstance(value, dict) else []


def _named(batches):
    """dir, kind (main, exports, build, source, library), value of what the manifests of packages and projects name."""
    for pdf in batches:
        out = []
        for path, text in zip(pdf["path"], pdf["source"]):
            data = load_json(text) if text is not None else None
            here, _, name = path.rpartition("/")
            if not isinstance(data, dict):
                continue
            if name == "package.json":
                fields = ("main", "module") if here else ("main", "module", "browser")
                out += [(here, "main", data[k]) for k in fields if isinstance(data.get(k), str)]
                out += [(here, "exports", x) for x in _strings(data.get("exports"))]
            elif name == "tsconfig.json" and not here:
                out += [(here, "files", f) for f in data.get("files") or [] if isinstance(f, str)] if isinstance(data.get("files"), list) else []
            elif name == "project.json":
                options = data
                for k in ("targets", "build", "options"):
                    options = options.get(k) if isinstance(options, dict) else None
                kind = "library" if data.get("projectType") == "library" else "project"
                if isinstance(options, dict) and isinstance(options.get("main"), str):
                    out.append((here, f"build {kind}", options["main"]))
                elif isinstance(data.get("sourceRoot"), str):
                    out.append((here, f"source {kind}", data["sourceRoot"]))
        yield pd.DataFrame(out, columns=["dir", "kind", "value"])


def declared_by_manifests(manifests: DataFrame, files: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """path, class of what manifests make an entry, of files only.

    The root's ``main``, ``module`` and ``browser`` are framework entries, as are
    its ``exports`` and the ``files`` of its tsconfig where they are spelled like
    paths of the tree. A workspace package's ``main`` and ``module`` are framework
    entries and public API, its ``exports`` public API, its default files framework
    entries, and so is the main file of its Nx project, of a library public API too.
    """
    named = manifests.where(F.col("path").rlike(r"(^|/)(package|project|tsconfig)\.json$")).select("path", "source").mapInPandas(_named, "dir string, kind string, value string").distinct()
    known = files.select("path").distinct()
    root = named.where("dir = ''")
    top = probed(root.where("kind = 'main'").select(normalize_entry(F.col("value")).alias("base")).distinct(), known).select("path", F.lit("framework").alias("class"))
    raw = root.where("kind in ('exports', 'files')").select(F.col("value").alias("path")).join(known, "path", "left_semi").select("path", F.lit("framework").alias("class"))
    dirs = package_dirs(known.union(manifests.select("path")), prefixes or [])
    inner = named.join(dirs, "dir", "left_semi").withColumn("base", location(F.concat("dir", F.lit("/"), F.regexp_replace("value", r"^(\./)+", ""))))
    hits = probed(inner.where("kind in ('main', 'exports', 'build project', 'build library')").select("kind", "base").distinct(), known)
    roots = inner.where("kind like 'source %'").select("kind", "base", F.posexplode(F.array(*[F.lit(x) for x in NX_ENTRIES])).alias("o", "file"))
    nx = roots.withColumn("path", F.concat_ws("/", "base", "file")).join(known, "path", "left_semi").groupBy("kind", "base").agg(F.min_by("path", "o").alias("path"))
    every = hits.select("kind", "path").union(nx.select("kind", "path"))
    runs = every.where("kind <> 'exports'").select("path", F.lit("framework").alias("class"))
    api = every.where("kind in ('main', 'exports') or kind like '% library'").select("path", F.lit("public_api").alias("class"))
    defaults = dirs.select(F.explode(F.transform(F.array(*[F.lit(x) for x in PACKAGE_ENTRIES]), lambda x: F.concat("dir", F.lit("/"), x))).alias("path")).join(known, "path", "left_semi").select("path", F.lit("framework").alias("class"))
    return top.union(raw).union(runs).union(api).union(defaults).distinct()
