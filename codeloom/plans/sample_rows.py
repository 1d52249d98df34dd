"""The rows expected of the sample project, checked by hand against the samples."""

from __future__ import annotations

# query → (schema, rows)
EXPECTED = {
    "block_findings": (
        "file string, line bigint, rule string, severity string, confidence double", [
            ('src/lint/branches.ts', 1, 'high-complexity', 'warning', 1.0), ('src/lint/nested.ts', 1, 'deep-nesting', 'warning', 1.0), ('src/lint/rules.ts', 18, 'empty-catch', 'warning', 0.95),
        ],
    ),
    "sample_facts": (
        "path string, fact string, name string, detail string", [
            ('crate/src/lib.rs', 'export', 'Root', ''), ('crate/src/lib.rs', 'export', 'parse', ''), ('crate/src/lib.rs', 'export', 'run', ''), ('crate/src/lib.rs', 'import', 'crate', ''),
            ('crate/src/lib.rs', 'import', 'crate::parse', ''), ('crate/src/lib.rs', 'import', 'store', ''), ('crate/src/lib.rs', 'module', '@odd/place.rs', ''), ('crate/src/lib.rs', 'module', 'parse', ''),
            ('crate/src/lib.rs', 'module', 'store', ''), ('crate/src/lib.rs', 'named', '*', 'store'), ('crate/src/lib.rs', 'named', 'Tree', 'crate::parse'), ('crate/src/lib.rs', 'named', 'parse', 'crate'),
            ('crate/src/odd/place.rs', 'export', 'Odd', ''), ('crate/src/parse/inner.rs', 'export', 'Leaf', ''), ('crate/src/parse/inner.rs', 'import', 'demo_crate::store', ''),
            ('crate/src/parse/inner.rs', 'import', 'serde', ''), ('crate/src/parse/inner.rs', 'import', 'super', ''), ('crate/src/parse/inner.rs', 'named', 'Serialize', 'serde'),
            ('crate/src/parse/inner.rs', 'named', 'Store', 'demo_crate::store'), ('crate/src/parse/inner.rs', 'named', 'Tree', 'super'), ('crate/src/parse/mod.rs', 'export', 'Tree', ''),
            ('crate/src/parse/mod.rs', 'export', 'inner', ''), ('crate/src/parse/mod.rs', 'export', 'new', ''), ('crate/src/parse/mod.rs', 'import', 'super::store', ''), ('crate/src/parse/mod.rs', 'module', 'inner', ''),
            ('crate/src/parse/mod.rs', 'named', 'Store', 'super::store'), ('crate/src/serde.rs', 'export', 'own', ''), ('crate/src/store.rs', 'export', 'COUNT', ''), ('crate/src/store.rs', 'export', 'Store', ''),
            ('crate/src/store.rs', 'import', 'std', ''), ('crate/src/store.rs', 'module', 'below', ''), ('crate/src/store.rs', 'named', 'fs', 'std'), ('crate/src/store/below.rs', 'export', 'Low', ''),
            ('src/api/users.ts', 'block', 'Users', 'class 1 5'), ('src/api/users.ts', 'block', 'add', 'method 2 4'), ('src/api/users.ts', 'export', 'Users', ''), ('src/lint/nested.ts', 'block', 'deep', 'function 1 15'),
            ('src/lint/nested.ts', 'export', 'deep', ''), ('src/names/far.ts', 'export', 'deepest', ''), ('src/names/far.ts', 'export', 'idle', ''), ('src/names/first.ts', 'export', 'Kind', ''),
            ('src/names/first.ts', 'export', 'Shape', ''), ('src/names/first.ts', 'export', 'a', ''), ('src/names/first.ts', 'export', 'first', ''), ('src/names/first.ts', 'export', 'walk', ''),
            ('src/names/first.ts', 'type', 'Kind', 'type'), ('src/names/first.ts', 'type', 'Shape', 'interface'), ('src/names/index.ts', 'export', 'Other', ''), ('src/names/index.ts', 'export', 'Shape', ''),
            ('src/names/index.ts', 'import', './first', ''), ('src/names/index.ts', 'import', './second', ''), ('src/names/index.ts', 'named', 'Shape', './first'), ('src/names/index.ts', 'named', 'second', './second'),
            ('src/names/index.ts', 'reexport', '*', './first'), ('src/names/index.ts', 'reexport', 'Other', './second'), ('src/names/index.ts', 'reexport', 'Shape', './first'), ('src/names/index.ts', 'type', 'Other', 'reexport'),
            ('src/names/index.ts', 'type', 'Shape', 'type'), ('src/names/index2.ts', 'import', './far', ''), ('src/names/index2.ts', 'reexport', '*', './far'), ('src/names/mixed.ts', 'export', 'a', ''),
            ('src/names/mixed.ts', 'export', 'b', ''), ('src/names/mixed.ts', 'export', 'default', ''), ('src/names/mixed.ts', 'import', './first', ''), ('src/names/mixed.ts', 'import', './second', ''),
            ('src/names/mixed.ts', 'named', 'a', './first'), ('src/names/mixed.ts', 'named', 'b', './second'), ('src/names/mixed.ts', 'reexport', 'a', './first'), ('src/names/mixed.ts', 'reexport', 'all', './first'),
            ('src/names/mixed.ts', 'reexport', 'b', './second'), ('src/names/second.ts', 'export', 'second', ''), ('src/names/second.ts', 'import', './first', ''), ('src/names/second.ts', 'import', './later', ''),
            ('src/names/second.ts', 'import', './side', ''), ('src/names/second.ts', 'import', './work', ''), ('src/names/second.ts', 'import', 'left-pad', ''), ('src/names/second.ts', 'named', 'Base', './first'),
            ('src/names/second.ts', 'named', 'Shape', './first'), ('src/names/second.ts', 'named', 'a', './first'), ('src/names/second.ts', 'named', 'first', './first'), ('src/names/second.ts', 'named', 'ns', './first'),
            ('src/names/user.ts', 'import', './index2', ''), ('src/names/user.ts', 'import', '@scope/pkg/sub', ''), ('src/names/user.ts', 'import', 'plain/deep', ''), ('src/names/user.ts', 'named', 'deepest', './index2'),
            ('src/names/user.ts', 'named', 'x', '@scope/pkg/sub'), ('src/names/user.ts', 'named', 'y', 'plain/deep'), ('src/twin/a.ts', 'block', 'total', 'function 1 8'), ('src/twin/a.ts', 'export', 'total', ''),
            ('src/twin/b.ts', 'block', 'summed', 'function 1 8'), ('src/twin/b.ts', 'export', 'summed', ''),
        ],
    ),
    "sample_metrics": (
        "path string, loc bigint, total_lines bigint, functions bigint, classes bigint, complexity bigint, max_nesting_depth bigint", [
            ('crate/src/lib.rs', 8, 8, 1, 0, 1, 0), ('crate/src/parse/mod.rs', 4, 4, 1, 0, 1, 0), ('src/api/users.ts', 5, 5, 0, 1, 1, 0), ('src/lint/branches.ts', 63, 63, 1, 0, 21, 1), ('src/lint/nested.ts', 15, 15, 1, 0, 6, 5),
            ('src/twin/a.ts', 8, 8, 1, 0, 2, 1), ('tool.py', 3, 3, 0, 0, 0, 0),
        ],
    ),
    "rust_imports": (
        "importer string, module string, target string", [
            ('crate/src/lib.rs', 'crate::parse', 'crate/src/parse/mod.rs'), ('crate/src/lib.rs', 'crate::parse::Tree', 'crate/src/parse/mod.rs'), ('crate/src/lib.rs', 'mod::@odd/place.rs', 'crate/src/odd/place.rs'),
            ('crate/src/lib.rs', 'mod::parse', 'crate/src/parse/mod.rs'), ('crate/src/lib.rs', 'mod::serde', 'crate/src/serde.rs'), ('crate/src/lib.rs', 'mod::store', 'crate/src/store.rs'),
            ('crate/src/lib.rs', 'store::*', 'crate/src/store.rs'), ('crate/src/parse/inner.rs', 'demo_crate::store::Store', 'crate/src/store.rs'), ('crate/src/parse/inner.rs', 'serde::Serialize', '-'),
            ('crate/src/parse/inner.rs', 'super::Tree', '-'), ('crate/src/parse/mod.rs', 'mod::inner', 'crate/src/parse/inner.rs'), ('crate/src/parse/mod.rs', 'super::store::Store', 'crate/src/store.rs'),
            ('crate/src/store.rs', 'mod::below', 'crate/src/store/below.rs'), ('crate/src/store.rs', 'std::fs', '-'),
        ],
    ),
    "implicit_entries": (
        "path string", [
            ('benches/b.rs',), ('build.rs',), ('cypress/a.ts',), ('db/migrations/1.ts',), ('eslint-rules/x.js',), ('examples/e.rs',), ('gulpfile.js',), ('instrumentation.ts',), ('jest-e2e.json',), ('jest.setup.ts',),
            ('karma.conf.js',), ('lib/drizzle/s.ts',), ('payload-types.ts',), ('schema.prisma',), ('source.config.ts',), ('src/a.story.tsx',), ('src/blocks/Hero/fields.ts',), ('src/collections/Users/index.ts',),
            ('src/endpoints/seed.ts',), ('src/generated/x.ts',), ('src/globals/Nav/config.ts',), ('src/plain.ts',), ('src/test.ts',), ('stories/a.ts',), ('test/app.e2e-spec.ts',), ('vite.config.ts',),
        ],
    ),
    "manifest_packages": (
        "package_json string, section string, package string", [
            ('package.json', 'dependencies', 'react'), ('package.json', 'dependencies', 'unused'), ('package.json', 'devDependencies', 'idle'), ('package.json', 'peerDependencies', 'left-pad'),
            ('packages/ui/package.json', 'dependencies', 'vue'),
        ],
    ),
    "config_aliases": (
        "scope_dir string, prefix string, target string", [
            ('-', '@/', 'src/'), ('-', '@r/ui', 'packages/ui'), ('-', '@r/ui', 'packages/ui/src/api.js'), ('-', '@r/ui/', 'packages/ui/'), ('-', '@r/ui/parts/', 'packages/ui/src/parts/'), ('-', 'text', 'x,]y'),
            ('packages/web', '#/', 'packages/web/code/lib/'),
        ],
    ),
    "scoped_resolution": (
        "importer string, spec string, target string", [
            ('packages/app/z.ts', '#/a', '-'), ('packages/app/z.ts', '@r/ui/parts/p', 'packages/ui/src/parts/p.ts'), ('packages/app/z.ts', '@r/ui/src/api', 'packages/ui/src/api.ts'),
            ('packages/app/z.ts', 'lib/start', 'lib/start.ts'), ('packages/ui/src/index.ts', '@/kept', 'src/kept.ts'), ('packages/web/code/y.ts', '#/b', 'packages/web/code/lib/b/index.tsx'),
            ('packages/web/x.ts', '#/a', 'packages/web/code/lib/a.ts'), ('src/kept.ts', '../../out', '-'), ('src/kept.ts', './none', '-'), ('src/kept.ts', './raw.js', 'src/raw.ts'),
        ],
    ),
    "published_folders": (
        "prefix string", [
            ('packages/ui',),
        ],
    ),
    "public_files": (
        "path string", [
            ('packages/ui-kit/x.ts',), ('packages/ui/dist/main.ts',), ('packages/ui/src/api.ts',), ('packages/ui/src/index.ts',),
        ],
    ),
    "crate_targets": (
        "path string, class string", [
            ('crate/checks/t.rs', 'implicit'), ('crate/src/bin/tool.rs', 'framework'), ('crate/src/lib.rs', 'framework'), ('crate/src/other.rs', 'framework'),
        ],
    ),
    "declared_entries": (
        "path string, class string", [
            ('lib/start.ts', 'framework'), ('packages/app/src/nx.ts', 'framework'), ('packages/app/src/nx.ts', 'public_api'), ('packages/app/src/start/index.ts', 'framework'), ('packages/app/src/start/index.ts', 'public_api'),
            ('packages/tool/code/main.ts', 'framework'), ('packages/ui/dist/main.ts', 'framework'), ('packages/ui/dist/main.ts', 'public_api'), ('packages/ui/src/api.ts', 'public_api'), ('packages/ui/src/index.ts', 'framework'),
            ('src/kept.ts', 'framework'),
        ],
    ),
    "monorepo_kinds": (
        "root string, kind string, packages string, plugins string", [
            ('flow', 'pnpm', 'a/,b', ''), ('lock file only', '-', '', ''), ('npm', 'npm/yarn', 'x/,y', ''), ('nx by package', 'nx', '', ''), ('nx', 'nx', 'mods/', 'nx-react,nx-node'), ('pnpm', 'pnpm', 'packages/,tools/', ''),
            ('turborepo', 'turborepo', 'libs/', ''),
        ],
    ),
    "detected_frameworks": (
        "project string, frameworks string", [
            ('folder', 'astro,generic'), ('nothing', 'generic'), ('own name', 'shadcn,generic'), ('root file', 'nextjs,payload,generic'), ('root package', 'nestjs,svelte,generic'), ('workspace', 'vue,generic'),
        ],
    ),
    "scanned_tree": (
        "path string, kind string, language string", [
            ('bad.ts', 'source', 'typescript'), ('big.ts', 'source', 'typescript'), ('d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/near.ts', 'read', 'typescript'),
            ('d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/d/near.ts', 'source', 'typescript'), ('lib/c.py', 'read', 'python'), ('lib/c.py', 'source', 'python'), ('package.json', 'config', '-'), ('src/a.ts', 'read', 'typescript'),
            ('src/a.ts', 'source', 'typescript'), ('src/g.rs', 'read', 'rust'), ('src/g.rs', 'source', 'rust'), ('turbo.json', 'config', '-'), ('web/d.jsx', 'read', 'jsx'), ('web/d.jsx', 'source', 'jsx'),
            ('web/e.tsx', 'read', 'tsx'), ('web/e.tsx', 'source', 'tsx'),
        ],
    ),
    "issue_identities": (
        "category string, key string, fingerprint string", [
            ('circular_dependency', 'a→b', 'circular_dep::a->b'), ('dead_code', 'a.ts', 'dead_code::a.ts'), ('duplicate_code', 'a:L1-5::b:L2-6', '-'), ('duplicate_export', 'x::a,b', 'duplicate_export::x::a|b'),
            ('gotcha', 'a.ts:3:eval-usage', 'gotcha::a.ts::3::eval-usage'), ('unlisted_dependency', 'a::p', 'unlisted_dep::a::p'), ('unresolved_import', 'a::./b', 'unresolved_import::a::./b'),
            ('unused_dependency', 'p', 'unused_dep::dependencies::p'), ('unused_export', 'a.ts::x', 'unused_export::a.ts::x'), ('unused_type', 'a.ts::T', 'unused_type::a.ts::T'),
        ],
    ),
    "reexport_chains": (
        "path string, name string", [
            ('src/names/far.ts', 'deepest'),
        ],
    ),
    "star_types": (
        "path string, name string, kind string", [
            ('src/names/first.ts', 'Kind', 'type'), ('src/names/first.ts', 'Shape', 'interface'), ('src/names/index.ts', 'Kind', 'type'), ('src/names/index.ts', 'Other', 'reexport'), ('src/names/index.ts', 'Shape', 'interface'),
            ('src/names/index.ts', 'Shape', 'type'),
        ],
    ),
    "imported_names": (
        "target string, name string, importer string", [
            ('src/names/first.ts', 'Base', 'src/names/second.ts'), ('src/names/first.ts', 'Shape', 'src/names/index.ts'), ('src/names/first.ts', 'Shape', 'src/names/second.ts'), ('src/names/first.ts', 'a', 'src/names/mixed.ts'),
            ('src/names/first.ts', 'a', 'src/names/second.ts'), ('src/names/first.ts', 'first', 'src/names/second.ts'), ('src/names/first.ts', 'ns', 'src/names/second.ts'), ('src/names/index2.ts', 'deepest', 'src/names/user.ts'),
            ('src/names/second.ts', 'b', 'src/names/mixed.ts'), ('src/names/second.ts', 'second', 'src/names/index.ts'),
        ],
    ),
    "plugin_results": (
        "hook string, path string, rule string", [
            ('analyze_file', 'src/ring/a.ts', 'plugin-error'), ('analyze_file', 'src/twin/a.ts', 'marked'), ('analyze_file', 'src/twin/b.ts', 'marked'), ('discover_entries', 'src/ring/a.ts', 'implicit'),
            ('discover_entries', 'src/ring/b.ts', 'implicit'), ('discover_entries', 'x.ts', 'framework'), ('post_analysis', 'a', 'first'), ('post_analysis', 'a', 'seen after'), ('post_analysis', 'b', 'kept'),
            ('resolve_import', './gone', 'src/names/far.ts'), ('resolve_import', './lost', '-'),
        ],
    ),
    "fix_plan": (
        "path string, name string, status string, line bigint, before string, after string", [
            ('src/api/users.ts', 'Users', 'planned', 1, 'export class Users {', 'class Users {'),
            ('src/app/params.ts', 'generateStaticParams', 'planned', 1, 'export function generateStaticParams() {', 'function generateStaticParams() {'),
            ('src/names/far.ts', 'idle', 'planned', 2, 'export const idle = 2;', 'const idle = 2;'), ('src/names/first.ts', 'Kind', 'planned', 3, "export type Kind = 'a' | 'b';", "type Kind = 'a' | 'b';"),
            ('src/names/first.ts', 'first', 'not-found', 0, '', ''), ('src/names/first.ts', 'walk', 'not-found', 0, '', ''), ('src/names/index.ts', 'Other', 'not-found', 0, '', ''),
        ],
    ),
    "bracket_errors": (
        "path string, message string, line bigint, column bigint", [
            ('a.ts', 'unexpected token: }', 2, 1), ('b.tsx', 'missing }', 2, 8),
        ],
    ),
    "sample_summary": (
        "total_files bigint, total_lines bigint, total_exports bigint, dead_code bigint, unused_exports bigint, unused_types bigint, duplicate_code bigint, gotchas bigint, circular_dependencies bigint, unused_dependencies bigint, duplicate_exports bigint, unresolved_imports bigint, unlisted_dependencies bigint, plugin_issues bigint, duplication_percentage double, total_types bigint, health_score double", [
            (31, 210, 36, 17, 13, 5, 1, 27, 2, 2, 3, 3, 2, 3, 7.4074074074074066, 5, 76.2),
        ],
    ),
    "sample_issues": (
        "category string, file string, reason string", [
            ('circular_dependencies', 'src/ring/a.ts', 'cycle: src/ring/a.ts → src/ring/b.ts'), ('circular_dependencies', 'src/ring/a.ts', 'seen after'), ('dead_code', 'src/api/users.ts', 'not reachable from any entry point'),
            ('dead_code', 'src/app/head.tsx', 'not reachable from any entry point'), ('dead_code', 'src/app/params.ts', 'not reachable from any entry point'),
            ('dead_code', 'src/app/types.tsx', 'not reachable from any entry point'), ('dead_code', 'src/bin/rules.ts', 'not reachable from any entry point'),
            ('dead_code', 'src/lint/branches.ts', 'not reachable from any entry point'), ('dead_code', 'src/lint/danger.rs', 'not reachable from any entry point'),
            ('dead_code', 'src/lint/hell.ts', 'not reachable from any entry point'), ('dead_code', 'src/lint/nested.ts', 'not reachable from any entry point'),
            ('dead_code', 'src/lint/promise.ts', 'not reachable from any entry point'), ('dead_code', 'src/lint/rules.ts', 'not reachable from any entry point'),
            ('dead_code', 'src/names/index.ts', 'not reachable from any entry point'), ('dead_code', 'src/names/mixed.ts', 'not reachable from any entry point'),
            ('dead_code', 'src/ring/a.ts', 'implicit entry point not reachable from runtime'), ('dead_code', 'src/ring/b.ts', 'implicit entry point not reachable from runtime'),
            ('dead_code', 'src/twin/a.ts', 'not reachable from any entry point'), ('dead_code', 'src/twin/b.ts', 'not reachable from any entry point'),
            ('duplicate_exports', 'src/names/first.ts', "export 'Shape' stands in src/names/first.ts, src/names/index.ts"),
            ('duplicate_exports', 'src/names/first.ts', "export 'a' stands in src/names/first.ts, src/names/mixed.ts, src/ring/a.ts"),
            ('duplicate_exports', 'src/names/mixed.ts', "export 'b' stands in src/names/mixed.ts, src/ring/b.ts"), ('plugin_issues', 'src/ring/a.ts', 'demo/plugin-error: ValueError: no'),
            ('plugin_issues', 'src/twin/a.ts', 'demo/marked: '), ('plugin_issues', 'src/twin/b.ts', 'demo/marked: '), ('unlisted_dependencies', 'src/names/user.ts', "package '@scope/pkg' is imported but not listed"),
            ('unlisted_dependencies', 'src/names/user.ts', "package 'plain' is imported but not listed"), ('unresolved_imports', 'src/names/second.ts', "import './later' is not resolved"),
            ('unresolved_imports', 'src/names/second.ts', "import './side' is not resolved"), ('unresolved_imports', 'src/names/second.ts', "import './work' is not resolved"),
            ('unused_dependencies', 'package.json', "package 'idle' is listed but never imported"), ('unused_dependencies', 'package.json', "package 'unused' is listed but never imported"),
            ('unused_exports', 'src/api/users.ts', "export 'Users' is never imported"), ('unused_exports', 'src/app/head.tsx', "export 'metadata' is never imported"),
            ('unused_exports', 'src/app/params.ts', "export 'generateStaticParams' is never imported"), ('unused_exports', 'src/app/types.tsx', "export 'A' is never imported"),
            ('unused_exports', 'src/app/types.tsx', "export 'B' is never imported"), ('unused_exports', 'src/lint/branches.ts', "export 'many' is never imported"),
            ('unused_exports', 'src/lint/nested.ts', "export 'deep' is never imported"), ('unused_exports', 'src/names/far.ts', "export 'deepest' is never imported"),
            ('unused_exports', 'src/names/far.ts', "export 'idle' is never imported"), ('unused_exports', 'src/names/first.ts', "export 'Kind' is never imported"),
            ('unused_exports', 'src/names/first.ts', "export 'walk' is never imported"), ('unused_exports', 'src/twin/a.ts', "export 'total' is never imported"),
            ('unused_exports', 'src/twin/b.ts', "export 'summed' is never imported"), ('unused_types', 'src/app/types.tsx', "interface 'B' is never imported"), ('unused_types', 'src/app/types.tsx', "type 'A' is never imported"),
            ('unused_types', 'src/names/first.ts', "type 'Kind' is never imported"), ('unused_types', 'src/names/index.ts', "reexport 'Other' is never imported"),
            ('unused_types', 'src/names/index.ts', "type 'Kind' is never imported"),
        ],
    ),
    "sarif_rows": (
        "rule string, level string, places string", [
            ('circular_dependency', 'warning', 'a:1'), ('dead_code', 'note', 'b/c.ts:1'), ('dead_code', 'warning', 'a.ts:1'), ('duplicate_code', 'note', 'a:1,b:2'), ('duplicate_export', 'warning', 'a:1,b:1'),
            ('gotcha', 'note', 'a.ts:3'), ('gotcha', 'warning', 'a.ts:4'), ('unlisted_dependency', 'warning', 'a:1'), ('unresolved_import', 'warning', 'a:1'), ('unused_dependency', 'note', 'package.json:1'),
            ('unused_export', 'note', 'a.ts:1'), ('unused_type', 'note', 'a.ts:1'),
        ],
    ),
    "failing": (
        "category string, fails boolean, fails_empty boolean", [
            ('circular_dependencies', True, False), ('dead_code', True, False), ('duplicate_code', False, False), ('duplicate_exports', True, False), ('gotchas', True, False), ('plugin_issues', False, False),
            ('unlisted_dependencies', False, False), ('unresolved_imports', True, False), ('unused_dependencies', False, False), ('unused_exports', True, False), ('unused_types', False, False),
        ],
    ),
    "ordered_findings": (
        "place int, file string, line bigint, rule string", [
            (1, 'src/bin/rules.ts', 2, 'eval-usage'), (10, 'src/lint/rules.ts', 8, 'as-any-cast'), (11, 'src/lint/rules.ts', 9, 'any-cast-angle'), (12, 'src/lint/danger.rs', 8, 'rust-println'),
            (13, 'src/lint/danger.rs', 9, 'rust-dbg'), (14, 'src/lint/rules.ts', 1, 'loose-equality'), (15, 'src/lint/rules.ts', 2, 'loose-inequality'), (16, 'src/lint/rules.ts', 10, 'console-statement'),
            (17, 'src/lint/rules.ts', 11, 'unresolved-comment'), (18, 'src/lint/rules.ts', 12, 'env-no-fallback'), (2, 'src/lint/rules.ts', 4, 'eval-usage'), (3, 'src/lint/rules.ts', 5, 'xss-innerhtml'),
            (4, 'src/lint/rules.ts', 6, 'xss-dangerously-set'), (5, 'src/lint/danger.rs', 2, 'rust-unwrap'), (6, 'src/lint/danger.rs', 3, 'rust-panic'), (7, 'src/lint/danger.rs', 6, 'rust-todo'),
            (8, 'src/lint/danger.rs', 7, 'rust-unimplemented'), (9, 'src/lint/rules.ts', 7, 'any-type'),
        ],
    ),
}
