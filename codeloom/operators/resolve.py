"""Resolving import specifiers to files, by candidates and equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import location
from codeloom.functions.predicates import within_root
from codeloom.functions.text import parent_dir
from codeloom.operators.prefix import prefix_join

EXTENSIONS = ("ts", "tsx", "js", "jsx", "rs")
# First segments of Rust paths that name other crates.
EXTERN_CRATES = (
    "std", "core", "alloc", "proc_macro", "test", "serde", "tokio", "hyper", "clap", "log", "env_logger", "regex", "anyhow", "thiserror", "tracing", "futures", "async_trait", "derive_more", "num_traits", "itertools",
    "rayon", "crossbeam", "parking_lot", "once_cell", "lazy_static", "indexmap", "hashbrown", "smallvec", "bytes", "http", "url", "time", "chrono", "serde_json", "serde_derive", "toml", "yaml", "walkdir", "glob",
    "tempfile", "dirs", "libc", "nix", "winapi", "windows",
)


def candidates(base):
    """The paths tried for a base, in order: itself, with an extension added, with its extension replaced, an index file in it."""
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    return F.array(base, *[F.concat(base, F.lit(f".{e}")) for e in EXTENSIONS], *[F.concat(stem, F.lit(f".{e}")) for e in EXTENSIONS], *[F.concat(base, F.lit(f"/index.{e}")) for e in EXTENSIONS])


def try_extensions(bases: DataFrame, files: DataFrame) -> DataFrame:
    """bases (…, base) → with ``path``, the first candidate that is a file; bases without one are dropped."""
    keys = bases.columns
    known = files.select("path").distinct()
    tried = bases.select(*keys, F.posexplode(candidates(F.col("base"))).alias("ord", "path"))
    hits = tried.join(known, "path", "left_semi")
    return hits.groupBy(*keys).agg(F.min_by("path", "ord").alias("path"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports (importer, spec) → importer, spec, target (null where nothing matches).

    In this order, the first that is a file wins: relative to the importer (a
    miss is final, and so is a path that leaves the root); the aliases of the
    nearest scope, that is the longest scope_dir that the importer's directory
    starts with; global aliases (scope_dir null) in their order; relative to the
    root. aliases: scope_dir, ord, prefix, target; they meet the specifiers by
    equal beginnings.
    """
    ask = imports.select("importer", "spec").where("importer is not null and spec is not null").distinct().withColumn("dir", parent_dir(F.col("importer")))
    relative = F.col("spec").rlike(r"^[./]")
    joined = F.when(F.col("spec").startswith("/"), F.col("spec")).when(F.col("dir") == ".", F.col("spec")).otherwise(F.concat("dir", F.lit("/"), "spec"))
    near = ask.where(relative & within_root(joined)).select("importer", "spec", F.lit(0).alias("rank"), location(joined).alias("base"))
    far = ask.where(~relative).select("importer", "spec", F.lit(3_000_000).alias("rank"), location(F.col("spec")).alias("base"))
    bases = near.unionByName(far)
    if aliases is not None:
        scoped, outer = aliases.where("scope_dir is not null"), ask.where(~relative)
        mine = prefix_join(outer.select("dir").distinct(), "dir", scoped.select("scope_dir").distinct(), "scope_dir")
        best = mine.groupBy("dir").agg(F.max_by("scope_dir", F.length("scope_dir")).alias("scope_dir"))
        rest = F.concat_ws("/", F.col("target"), F.expr("substring(spec, length(prefix) + 1)"))
        hits = prefix_join(outer.select("spec").distinct(), "spec", aliases.drop("spec"), "prefix").select("spec", "scope_dir", "ord", location(rest).alias("base"))
        by_scope = outer.join(best, "dir").join(hits.where("scope_dir is not null"), ["spec", "scope_dir"]).select("importer", "spec", (F.lit(1_000_000) + F.col("ord")).alias("rank"), "base")
        everywhere = outer.join(hits.where("scope_dir is null").drop("scope_dir"), "spec").select("importer", "spec", (F.lit(2_000_000) + F.col("ord")).alias("rank"), "base")
        bases = bases.unionByName(by_scope).unionByName(everywhere)
    found = try_extensions(bases, files).groupBy("importer", "spec").agg(F.min_by("path", "rank").alias("target"))
    return ask.select("importer", "spec").join(found, ["importer", "spec"], "left")


def crate_root(path):
    """The directory that ``crate`` names: the path up to the last ``src`` folder, or the file's own directory without one."""
    src = F.regexp_extract(path, r"^((?:.*/)?src)/", 1)
    return F.when(src == "", parent_dir(path)).otherwise(src)


def resolve_rust(uses: DataFrame, files: DataFrame, crates: DataFrame | None = None) -> DataFrame:
    """uses (importer, module) with ``::`` paths → importer, module, target.

    The longest prefix of the path that is a module file wins: ``p.rs``,
    ``p/mod.rs`` or ``p/lib.rs``. ``crate`` and the crate's own name (crates:
    root, name) start at the crate's root; ``self`` and bare paths in the importer's
    directory; ``super`` too from a file that is no mod.rs, lib.rs or main.rs, and
    one directory up from those and for each further ``super``. ``mod::x`` is a
    declared child, found beside such a root file and below the folder named after
    any other file; ``mod::@p`` one with a path of its own. Paths that start with
    the name of a known external crate find nothing, even where a file has that name.
    """
    ask = uses.select("importer", "module").where("importer is not null and module is not null").distinct()
    path, module = F.col("importer"), F.col("module")
    here, root_file = parent_dir(path), path.rlike(r"(^|/)(mod|lib|main)\.rs$")
    first = F.substring_index(module, "::", 1)
    asked = ask.withColumn("root", crate_root(path))
    if crates is not None:
        names = crates.select(F.col("root"), F.regexp_replace("name", "-", "_").alias("own")).dropDuplicates(["root"])
        asked = asked.join(names, "root", "left")
    else:
        asked = asked.withColumn("own", F.lit(None).cast("string"))
    in_crate = (first == "crate") | first.eqNullSafe(F.col("own"))
    supers = F.size(F.split(F.regexp_extract(module, r"^(?:super::)*", 0), "::")) - 1
    ups = F.when(root_file, supers).otherwise(F.greatest(supers - 1, F.lit(0)))
    base = (
        F.when(in_crate, F.col("root"))
        .when(first == "super", F.concat(here, F.repeat(F.lit("/.."), ups)))
        .when((first == "mod") & ~module.startswith("mod::@") & ~root_file, F.regexp_replace(path, r"\.rs$", ""))
        .otherwise(here)
    )
    tail = F.when(in_crate | first.isin("self", "mod"), F.expr("substring(module, length(substring_index(module, '::', 1)) + 3)")).otherwise(F.regexp_replace(module, "^(super::)+", ""))
    near = in_crate | ~first.isin(*EXTERN_CRATES)
    placed = asked.where(near).select("importer", "module", base.alias("base"), tail.alias("tail"))
    own = placed.where("tail like '@%'").select("importer", "module", location(F.concat("base", F.lit("/"), F.expr("substring(tail, 2)"))).alias("path"), F.lit(0).alias("short"), F.lit(0).alias("k"))
    parts = F.split("tail", "::")
    cut = placed.where("tail not like '@%' and tail <> ''").select("importer", "module", "base", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("short", "rel"))
    tried = cut.select("importer", "module", "short", F.posexplode(F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs"), F.lit("/lib.rs")), lambda e: location(F.concat("base", F.lit("/"), "rel", e)))).alias("k", "path"))
    hit = tried.unionByName(own).join(files.select("path").distinct(), "path", "left_semi")
    found = hit.groupBy("importer", "module").agg(F.min_by("path", F.col("short") * 3 + F.col("k")).alias("target"))
    return ask.join(found, ["importer", "module"], "left")


def crate_children(files: DataFrame) -> DataFrame:
    """importer, module, target: what lies in the directory of a lib.rs or main.rs counts as its modules, as macros may declare them: files, and folders with a mod.rs or lib.rs."""
    paths = files.select("path").where("path is not null").distinct()
    path = F.col("path")
    roots = paths.where(path.rlike(r"(^|/)(lib|main)\.rs$")).select(path.alias("importer"), parent_dir(path).alias("dir"))
    plain = paths.where(path.endswith(".rs") & ~path.rlike(r"(^|/)(lib|main|mod)\.rs$")).select(parent_dir(path).alias("dir"), F.regexp_extract(path, r"([^/]+)\.rs$", 1).alias("name"), path.alias("target"))
    folders = paths.where(path.rlike(r"[^/]+/(mod|lib)\.rs$")).select(parent_dir(parent_dir(path)).alias("dir"), F.regexp_extract(path, r"([^/]+)/(?:mod|lib)\.rs$", 1).alias("name"), path.alias("target"))
    children = plain.union(folders).groupBy("dir", "name").agg(F.min_by("target", F.when(F.col("target").endswith("/mod.rs"), 1).when(F.col("target").endswith("/lib.rs"), 2).otherwise(0)).alias("target"))
    return roots.join(children, "dir").select("importer", F.concat(F.lit("mod::"), "name").alias("module"), "target")
