"""Entry points: framework conventions as rules, and the union of all that makes a file an entry."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import file_name, normalize_entry
from codeloom.operators.prefix import prefix_join

# Matcher kinds: file (exact name anywhere), prefix, file_has, path_has, dir_stems (folder and stem), prefix_file.
Matcher = tuple

# What frameworks look for. The generic profile always applies.
PROFILES = {
    "nextjs": {
        "markers": ("next.config.ts", "next.config.js", "next.config.mjs"), "deps": ("next",),
        "entry": (
            ("file", "next.config.ts"), ("file", "next.config.js"), ("file", "next.config.mjs"), ("file", "middleware.ts"), ("file", "middleware.js"),
            ("dir_stems", "app", ("page", "layout", "route", "loading", "error", "not-found", "template", "default", "global-error")),
            ("path_has", "/pages/"), ("prefix", "pages/"), ("prefix", "src/pages/"),
        ),
        "implicit": (
            ("file_has", ".test."), ("file_has", ".spec."), ("prefix", "e2e/"), ("prefix", "tests/e2e/"), ("prefix", "scripts/"), ("prefix", "examples/"),
            ("file", "playwright.config.ts"), ("file", "playwright.config.js"), ("file", "postcss.config.js"), ("file", "postcss.config.ts"), ("file", "tailwind.config.ts"), ("file", "tailwind.config.js"),
            ("path_has", "/generated/"), ("path_has", "payload-types"), ("file_has", ".stories."), ("file_has", ".story."), ("path_has", "/drizzle/"), ("file", "schema.prisma"),
            ("file", ".storybook/preview.tsx"), ("file", ".storybook/preview.ts"), ("file", ".storybook/main.ts"), ("file", "instrumentation.ts"), ("file", "instrumentation.js"),
        ),
    },
    "payload": {
        "markers": ("payload.config.ts", "payload.config.js", "src/payload.config.ts", "src/payload.config.js"), "deps": ("payload",), "entry": (("file", "payload.config.ts"), ("file", "payload.config.js")),
        "implicit": (
            ("prefix_file", "src/collections/", ("index.ts", "config.ts")), ("prefix_file", "src/globals/", ("index.ts", "config.ts")), ("prefix_file", "src/blocks/", ("index.ts", "config.ts")),
            ("prefix", "src/endpoints/"), ("prefix", "endpoints/"), ("path_has", "migrations/"), ("path_has", "seed"), ("path_has", "payload-generated"), ("path_has", "payload-types"),
        ),
    },
    "shadcn": {
        "markers": ("components.json",), "deps": ("shadcn",), "entry": (("prefix", "registry/"), ("path_has", "/registry/"), ("path_has", "/styles/")),
        "implicit": (("prefix", "scripts/"), ("path_has", "/scripts/"), ("prefix", "examples/"), ("path_has", "/examples/"), ("path_has", "/blocks/"), ("path_has", "/generated/"), ("prefix", "styles/"), ("path_has", "/styles/"), ("file", "source.config.ts")),
    },
    "angular": {
        "markers": ("angular.json",), "deps": ("@angular/core",), "entry": (("file", "main.ts"), ("file", "main.server.ts"), ("prefix", "environments/"), ("file_has", ".module."), ("file", "routes.ts"), ("file", "polyfills.ts")),
        "implicit": (("file_has", ".spec."), ("file_has", ".stories."), ("file", "test.ts"), ("file", "karma.conf.js"), ("file", "proxy.conf.json"), ("path_has", "/generated/"), ("prefix", "e2e/")),
    },
    "nestjs": {
        "markers": ("nest-cli.json",), "deps": ("@nestjs/core", "@nestjs/common", "@nestjs/platform-express", "@nestjs/apollo", "@nestjs/graphql"), "entry": (("file", "main.ts"), ("file_has", ".module."), ("prefix", "environments/")),
        "implicit": (("file_has", ".spec."), ("file_has", ".e2e-spec."), ("prefix", "test/"), ("file", "jest-e2e.json"), ("file", "jest.config.ts"), ("file", "nest-cli.json"), ("path_has", "/generated/")),
    },
    "vue": {
        "markers": ("vue.config.ts", "vue.config.js"), "deps": ("vue",), "entry": (("file", "main.ts"), ("file", "main.js"), ("dir_stems", "router", ("index",)), ("prefix_file", "src/stores/", ("index.ts", "index.js"))),
        "implicit": (("file_has", ".test."), ("file_has", ".spec."), ("prefix", "e2e/"), ("prefix", "stories/")),
    },
    "svelte": {
        "markers": ("svelte.config.js",), "deps": ("@sveltejs/kit", "svelte"), "entry": (("dir_stems", "routes", ("+page", "+layout", "+error", "+loading")), ("file", "+page.ts"), ("file", "+layout.ts")),
        "implicit": (("file_has", ".test."), ("file_has", ".spec."), ("prefix", "e2e/")),
    },
    "remix": {
        "markers": ("remix.config.js", "remix.config.ts"), "deps": ("@remix-run/react", "@remix-run/node"), "entry": (("prefix", "app/routes/"), ("file", "root.tsx"), ("file", "root.ts"), ("file", "entry.server.tsx"), ("file", "entry.client.tsx")),
        "implicit": (("file_has", ".test."), ("file_has", ".spec."), ("prefix", "e2e/")),
    },
    "astro": {
        "markers": ("astro.config.mjs", "astro.config.ts"), "deps": ("astro",), "entry": (("prefix", "src/pages/"), ("prefix", "src/content/")),
        "implicit": (("file_has", ".test."), ("file_has", ".spec."), ("prefix", "e2e/"), ("path_has", "/generated/")),
    },
    "generic": {
        "markers": (), "deps": (), "entry": (),
        "implicit": (
            ("file_has", ".test."), ("file_has", ".spec."), ("prefix", "e2e/"), ("prefix", "tests/e2e/"), ("prefix", "cypress/"), ("prefix", "scripts/"), ("prefix", "examples/"),
            ("file", "jest.config.ts"), ("file", "jest.config.js"), ("file", "vitest.config.ts"), ("file", "vitest.config.js"), ("file_has", "vitest."), ("file_has", ".setup."),
            ("file", "playwright.config.ts"), ("file", "playwright.config.js"), ("file", "postcss.config.js"), ("file", "postcss.config.ts"), ("file", "tailwind.config.ts"), ("file", "tailwind.config.js"),
            ("file", "webpack.config.ts"), ("file", "webpack.config.js"), ("file", "vite.config.ts"), ("file", "vite.config.js"), ("file", "eslint.config.js"), ("file", "eslint.config.ts"), ("file", "eslint.config.mjs"),
            ("file", "prettier.config.js"), ("file", "prettier.config.ts"), ("path_has", "migrations/"), ("path_has", "/generated/"), ("prefix", "tests/"), ("prefix", "__mocks__/"),
            ("file_has", ".stories."), ("file_has", ".story."), ("path_has", "/drizzle/"), ("file", "schema.prisma"),
        ),
    },
}
# Beginnings of lower-case paths that tools load, and the files that are entries by default.
TOOLING_PREFIXES = (".claude/hooks", ".claude/skills", "eslint-plugins", "eslint-rules", ".eslint-rules", "scripts", "tools", "gulpfile", "gruntfile")
DEFAULT_ENTRIES = (
    "src/index.ts", "src/index.tsx", "src/index.js", "src/index.jsx", "src/main.ts", "src/main.tsx", "index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "src/main.rs", "src/lib.rs",
)


def matches(path: Column, matcher: Matcher) -> Column:
    kind, what = matcher[0], matcher[1]
    if kind == "file":
        return (path == what) | path.endswith(f"/{what}")
    if kind == "prefix":
        return path.startswith(what)
    if kind == "file_has":
        return file_name(path).contains(what)
    if kind == "path_has":
        return path.contains(what)
    if kind == "dir_stems":
        return F.array_contains(F.split(path, "/"), what) & F.substring_index(file_name(path), ".", 1).isin(*matcher[2])
    if kind == "prefix_file":
        return path.startswith(what) & file_name(path).isin(*matcher[2])
    raise ValueError(f"unknown matcher {kind}")


def matches_any(path: Column, matchers) -> Column:
    return reduce(lambda a, m: a | matches(path, m), matchers, F.lit(False))


def entry_points(files: DataFrame, profiles: list[str], declared: DataFrame | None = None, public: DataFrame | None = None) -> DataFrame:
    """path, class (framework, implicit, public_api), one row for each class of a file.

    ``declared`` (path, class) holds what manifests name; ``public`` (prefix)
    the folders of published packages, whose files are public API.
    """
    paths, path = files.select("path").distinct(), F.col("path")
    entry = [m for p in profiles for m in PROFILES[p]["entry"]]
    implicit = [m for p in profiles for m in PROFILES[p]["implicit"]]
    tooling = F.lower(path).rlike(r"^(\./)?(" + "|".join(re.escape(t) for t in TOOLING_PREFIXES) + ")")
    rust = path.rlike(r"(^|/)(build\.rs$|tests/.*\.rs$|benches/.*\.rs$|examples/.*\.rs$|fuzz/.*\.rs$)")
    classes = F.array(
        F.when(matches_any(path, entry) | path.isin(*DEFAULT_ENTRIES) | path.rlike(r"(^|/)src/bin/.*\.rs$"), F.lit("framework")),
        F.when(matches_any(path, implicit) | tooling | rust, F.lit("implicit")),
    )
    found = paths.select("path", F.explode(F.filter(classes, lambda x: x.isNotNull())).alias("class"))
    if declared is not None:
        found = found.unionByName(declared.select(normalize_entry(F.col("path")).alias("path"), "class").join(paths, "path", "left_semi"))
    if public is not None:
        found = found.unionByName(prefix_join(paths, "path", public.select("prefix").distinct(), "prefix", "left_semi").select("path", F.lit("public_api").alias("class")))
    return found.distinct()


def implicit_only(entries: DataFrame) -> DataFrame:
    """Entries of any class that are no framework entries."""
    return entries.select("path").distinct().join(entries.where(F.col("class") == "framework").select("path"), "path", "left_anti")
