"""A small project, written here, in which every rule and every kind of manifest has a case; queries read it beside the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NESTED = "export function deep(a: number[]) {\n  for (const x of a) {\n    if (x) {\n      while (x) {\n        try {\n          go(x);\n        } catch (e) {\n          if (e) {\n            stop();\n          }\n        }\n      }\n    }\n  }\n}\n"
BRANCHES = "export function many(a: number) {\n" + "".join(f"  if (a === {i}) {{\n    return {i * i};\n  }}\n" for i in range(20)) + "  return 0;\n}\n"
TWIN = "export function total(items) {\n  let sum = 0;\n  for (const item of items) {\n    sum = sum + item.price * item.count;\n  }\n  const tax = sum * 0.19 + fees(items);\n  return sum + tax;\n}\n"

# path, language, source
FILES = [
    (
        "src/lint/rules.ts", "typescript",
        "const a = x == y;\nconst b = x != y;\nif (x === y && x !== z) f(a, b);\neval(code);\nnode.innerHTML = text;\nconst c = { dangerouslySetInnerHTML: text };\nlet d: any = 1;\nlet e = d as any;\nlet g = <any>d;\nconsole.log(d);\n// TODO: later\n"
        "const h = process.env.HOME;\nconst i = process.env.HOME || 'x';\nload().then(run);\nconst j = 1;\nload().then(run)\n  .catch(stop);\ntry { f(); } catch (e) { }\n// eval(code) in a comment\n",
    ),
    ("src/lint/rules.test.ts", "typescript", "eval(code);\n"),
    ("src/lint/promise.ts", "typescript", "load().then(run);\nconst a = 1;\nload().then(run).catch(stop);\n// load().then(run)\n\n\nload().then(run);\n"),
    ("src/bin/rules.ts", "typescript", "console.log(1 == 2);\neval(code);\n"),
    (
        "src/lint/danger.rs", "rust",
        "fn main() {\n    let a = b.unwrap();\n    panic!(\"x\");\n    let s = \"panic!(no)\";\n    c.unwrap_or_else(|| panic!(\"y\"));\n    todo!();\n    unimplemented!();\n    println!(\"x\");\n    dbg!(a);\n    my_dbg!(a);\n    // panic!(\"z\")\n}\n",
    ),
    ("src/app/types.tsx", "tsx", "'use client'\nexport type A = { a: string };\nexport interface B { b: string }\n"),
    ("src/app/head.tsx", "tsx", "'use client'\nexport const metadata = { title: 'x' };\n"),
    ("src/app/params.ts", "typescript", "export function generateStaticParams() {\n  return [];\n}\n"),
    ("src/api/users.ts", "typescript", "export class Users {\n  add(@Body() user: User) {\n    return save(user);\n  }\n}\n"),
    ("src/lint/hell.ts", "typescript", "one(() => {\n  two(() => {\n    three(() => {\n      four(() => {\n        five(() => {\n          done();\n        });\n      });\n    });\n  });\n});\n"),
    ("src/lint/nested.ts", "typescript", NESTED),
    ("src/lint/branches.ts", "typescript", BRANCHES),
    ("src/names/index.ts", "typescript", "export * from './first';\nexport { second as Other } from './second';\nexport type { Shape } from './first';\n"),
    ("src/names/mixed.ts", "typescript", "export { a } from './first';\nexport { b } from './second';\nexport * as all from './first';\nconst c = 1;\nexport default c;\n"),
    ("src/names/first.ts", "typescript", "export const a = 1, first = 2;\nexport interface Shape { x: number }\nexport type Kind = 'a' | 'b';\nexport async function* walk() {}\n"),
    ("src/names/second.ts", "typescript", "import Base, { a as alias, first } from './first';\nimport * as ns from './first';\nimport type { Shape } from './first';\nimport './side';\nexport const second = new Base(alias, first, ns);\nconst lazy = import('./later');\nconst old = require('left-pad');\nnew Worker(new URL('./work', import.meta.url));\n"),
    ("src/names/user.ts", "typescript", "import { deepest } from './index2';\nimport x from '@scope/pkg/sub';\nimport y from 'plain/deep';\n"),
    ("src/names/index2.ts", "typescript", "export * from './far';\n"),
    ("src/names/far.ts", "typescript", "export const deepest = 1;\nexport const idle = 2;\n"),
    ("src/twin/a.ts", "typescript", TWIN),
    ("src/twin/b.ts", "typescript", TWIN.replace("total", "summed")),
    ("src/ring/a.ts", "typescript", "import { b } from './b';\nexport const a = b;\n"),
    ("src/ring/b.ts", "typescript", "import { a } from './a';\nexport const b = a;\n"),
    ("src/index.ts", "typescript", "import './names/second';\nimport './names/user';\nimport './gone';\nimport react from 'react';\n"),
    ("crate/src/lib.rs", "rust", "pub mod parse;\nmod store;\n#[path = \"odd/place.rs\"]\nmod placed;\nuse crate::parse::{self, Tree as T};\npub use store::*;\npub struct Root;\npub(crate) async fn run() {}\n"),
    ("crate/src/parse/mod.rs", "rust", "use super::store::Store;\npub mod inner;\npub struct Tree;\nimpl Tree { pub const fn new() -> Tree { Tree } }\n"),
    ("crate/src/parse/inner.rs", "rust", "use super::Tree;\nuse serde::Serialize;\nuse demo_crate::store::Store;\npub enum Leaf { A }\n"),
    ("crate/src/store.rs", "rust", "use std::fs;\nmod below;\npub struct Store;\npub static mut COUNT: u8 = 1;\n"),
    ("crate/src/store/below.rs", "rust", "pub trait Low {}\n"),
    ("crate/src/odd/place.rs", "rust", "pub type Odd = u8;\n"),
    ("crate/src/serde.rs", "rust", "pub fn own() {}\n"),
]

# path, source
MANIFESTS = [
    ("package.json", '{"name": "root", "main": "./lib/start.js", "exports": {".": "src/kept.ts", "./x": "./src/raw.ts"}, "workspaces": ["packages/*"], "dependencies": {"react": "19", "unused": "1"}, "devDependencies": {"idle": "2"}, "peerDependencies": {"left-pad": "1"}}'),
    ("tsconfig.json", '{\n  // the root\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "~abs": ["/etc/x"], "~up": ["../x"], "text": ["x,]y"],},},\n  "files": ["src/named.ts"]\n}'),
    ("packages/web/tsconfig.app.json", '{"compilerOptions": {"baseUrl": "code", "paths": {"#/*": ["lib/*"]}}}'),
    ("dist/tsconfig.json", '{"compilerOptions": {"paths": {"no": ["no"]}}}'),
    ("a/b/c/d/e/f/tsconfig.json", '{"compilerOptions": {"paths": {"deep": ["deep"]}}}'),
    ("packages/ui/package.json", '{"name": "@r/ui", "module": "./dist/main.js", "exports": {".": {"import": "./src/api.js"}, "./parts/*": {"default": "./src/parts/*.ts"}}, "dependencies": {"vue": "3"}}'),
    ("packages/app/package.json", '{"name": "app", "private": true, "main": "src/start"}'),
    ("packages/app/project.json", '{"projectType": "library", "targets": {"build": {"options": {"main": "./src/nx.ts"}}}}'),
    ("packages/tool/project.json", '{"sourceRoot": "code"}'),
    ("packages/bad/package.json", "{"),
    ("crate/Cargo.toml", '[package]\nname = "demo-crate"\n[lib]\npath = "src/lib.rs"\n[[bin]]\nname = "tool"\n[[bin]]\nname = "other"\npath = "src/other.rs"\n[[test]]\nname = "t"\npath = "checks/t.rs"\n'),
]
WORKSPACE_FILES = ["lib/start.ts", "src/kept.ts", "src/raw.ts", "src/named.ts", "packages/ui/dist/main.ts", "packages/ui/src/api.ts", "packages/ui/src/index.ts", "packages/ui-kit/x.ts", "packages/app/src/start/index.ts", "packages/app/src/nx.ts", "packages/tool/code/main.ts", "packages/.hidden/m.ts"]
# the roots of monorepos of each kind: name, path, source
ROOTS = [
    ("pnpm", "pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n  # tools\n  - tools/**\nother: 1\n"), ("pnpm", "turbo.json", "{}"), ("flow", "pnpm-workspace.yaml", 'packages: ["a/*", "b"]\n'),
    ("turborepo", "turbo.json", "{}"), ("turborepo", "package.json", '{"workspaces": {"packages": ["libs/*"]}}'), ("nx", "nx.json", "{}"), ("nx", "package.json", '{"workspaces": ["mods/**"], "devDependencies": {"@nx/react": "1", "@nrwl/node": "1"}}'),
    ("nx by package", "package.json", '{"dependencies": {"nx": "1"}}'), ("npm", "package.json", '{"workspaces": ["x/*", "y"]}'), ("lock file only", "package-lock.json", "{}"), ("lock file only", "package.json", "{}"),
]
# paths that only one profile's rules reach
PROFILE_PATHS = [
    "next.config.mjs", "middleware.ts", "src/app/blog/page.tsx", "web/pages/about.tsx", ".storybook/main.ts", "instrumentation.ts", "payload.config.ts", "src/collections/Users/index.ts", "src/globals/Nav/config.ts", "src/blocks/Hero/fields.ts", "src/endpoints/seed.ts", "payload-types.ts",
    "registry/ui/button.tsx", "apps/v4/styles/base.tsx", "source.config.ts", "src/main.server.ts", "src/app/app.module.ts", "environments/prod.ts", "src/polyfills.ts", "src/test.ts", "karma.conf.js", "test/app.e2e-spec.ts", "jest-e2e.json", "src/router/index.ts", "src/stores/index.js", "stories/a.ts",
    "src/routes/+page.ts", "src/routes/about/+layout.ts", "app/routes/_index.tsx", "app/root.tsx", "app/entry.server.tsx", "src/pages/index.astro", "src/content/config.ts", "cypress/a.ts", "vite.config.ts", "jest.setup.ts", "db/migrations/1.ts", "src/generated/x.ts", "src/a.story.tsx", "lib/drizzle/s.ts", "schema.prisma",
    "build.rs", "benches/b.rs", "examples/e.rs", "src/bin/t.rs", "eslint-rules/x.js", "gulpfile.js", "src/plain.ts", "samples/a.ts", "web/Demo/b.ts", "crate/src/lib.rs", "my-lib.rs", "src/lib.rs.bak",
]
# files of a tree to scan: path, text
TREE = {
    "src/a.ts": "export const a = 1\n", "src/b.d.ts": "x", "node_modules/m/i.js": "x", "lib/c.py": "x = 1\n", "README.md": "x", "package.json": "{}", "turbo.json": "{}", "sub/turbo.json": "{}", "vendor/v.rs": "x", "web/d.jsx": "x\n", "web/e.tsx": "x\n", "web/f.js": "", "src/g.rs": "fn g() {}\n",
    "/".join("d" * 19) + "/near.ts": "x", "/".join("d" * 20) + "/deep.ts": "x",
}


def sample_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, language string, source string")


def sample_manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFESTS, "path string, source string")
