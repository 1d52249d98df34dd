"""Extension points: functions that add facts, entries, resolutions, issues or output formats.

Hooks take and give DataFrames, except ``analyze_file`` and ``resolve_import``,
which are Python functions run over Arrow batches. A hook is added to the
built-in result, or overrides it; two overrides of one hook cancel each other.
"""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOOKS = ("analyze_file", "resolve_import", "discover_entries", "post_analysis", "format_output")
MOST_SETTINGS_BYTES = 65_536
MOST_SOURCE_BYTES, MOST_SECONDS = 10_000_000, 30.0  # of one call of ``analyze_file``
PLUGIN_ISSUES = "plugin string, file string, line bigint, rule string, severity string, message string, confidence double"


@dataclass
class Plugin:
    name: str
    languages: tuple[str, ...] = ()
    mode: str = "add"  # add or override
    settings: dict = field(default_factory=dict)
    hooks: dict[str, Callable] = field(default_factory=dict)

    def hook(self, kind: str) -> Callable:
        """Decorator that registers a function under a hook."""
        if kind not in HOOKS:
            raise ValueError(f"unknown hook {kind}")

        def add(fn: Callable) -> Callable:
            self.hooks[kind] = fn
            return fn

        return add


class _Late(Exception):
    """A call took too long."""


def limited(fn: Callable, seconds: float, *args):
    """The list that a call gives; a call that takes longer than ``seconds`` is broken off. Python workers run calls in their main thread."""

    def ring(signum, frame):
        raise _Late(f"no answer in {seconds:g} s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return list(fn(*args))
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


class Registry:
    def __init__(self, seconds: float = MOST_SECONDS) -> None:
        self.seconds = seconds
        self.plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> Plugin:
        if len(repr(plugin.settings).encode()) > MOST_SETTINGS_BYTES:
            raise ValueError(f"{plugin.name}: settings are larger than {MOST_SETTINGS_BYTES} bytes")
        if plugin.mode not in ("add", "override"):
            raise ValueError(f"{plugin.name}: mode {plugin.mode}")
        self.plugins[plugin.name] = plugin
        return plugin

    def active(self, kind: str) -> list[Plugin]:
        """The plugins with a hook; where several override it, none of these counts."""
        having = [p for p in self.plugins.values() if kind in p.hooks]
        overriding = [p for p in having if p.mode == "override"]
        return having if len(overriding) <= 1 else [p for p in having if p.mode != "override"]

    def file_issues(self, files: DataFrame) -> DataFrame | None:
        """Issues of the ``analyze_file`` hooks over the files of their languages; a hook that fails, or a call that takes too long, gives an issue of its own, not a failed job. Larger texts than MOST_SOURCE_BYTES are not handed to hooks."""
        out = None
        for plugin in self.active("analyze_file"):
            fn, name, seconds = plugin.hooks["analyze_file"], plugin.name, self.seconds
            rows = files.where("path is not null and source is not null").where(F.octet_length("source") <= MOST_SOURCE_BYTES).select("path", "source", "language")
            if plugin.languages:
                rows = rows.where(F.col("language").isin(*plugin.languages))

            def run(batches: Iterator[pd.DataFrame], fn=fn, name=name, seconds=seconds) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    found = []
                    for path, source, language in zip(pdf["path"], pdf["source"], pdf["language"]):
                        try:
                            for i in limited(fn, seconds, path, source, language):
                                found.append((name, path, i.get("line"), i["rule"], i.get("severity", "info"), i.get("message", ""), float(i.get("confidence", 1.0))))
                        except Exception as e:  # noqa: BLE001
                            found.append((name, path, None, "plugin-error", "warning", f"{type(e).__name__}: {e}"[:200], 1.0))
                    yield pd.DataFrame(found, columns=["plugin", "file", "line", "rule", "severity", "message", "confidence"]).astype({"line": "Int64"})

            part = rows.mapInPandas(run, PLUGIN_ISSUES)
            out = part if out is None else out.unionByName(part)
        return out

    def resolve(self, missing: DataFrame) -> DataFrame:
        """missing (importer, spec) → importer, spec, target: the first plugin with an answer wins; null where none has one."""
        fns = [p.hooks["resolve_import"] for p in self.active("resolve_import")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(target=[next((t for f in fns if (t := f(i, s)) is not None), None) for i, s in zip(pdf["importer"], pdf["spec"])])

        return missing.select("importer", "spec").mapInPandas(run, "importer string, spec string, target string")

    def entries(self, files: DataFrame, entries: DataFrame) -> DataFrame:
        """Entry points with those of the ``discover_entries`` hooks (files → path, class)."""
        for plugin in self.active("discover_entries"):
            mine = plugin.hooks["discover_entries"](files)
            entries = mine if plugin.mode == "override" else entries.unionByName(mine).distinct()
        return entries

    def post(self, issues: DataFrame) -> DataFrame:
        """Unified issues with those of the ``post_analysis`` hooks, which take and give unified issues."""
        for plugin in self.active("post_analysis"):
            mine = plugin.hooks["post_analysis"](issues)
            issues = mine if plugin.mode == "override" else issues.unionByName(mine, allowMissingColumns=True)
        return issues

    def format(self, kind: str, built_in: Callable, *args) -> str:
        """The output of the built-in format, followed by, or replaced by, that of the hooks."""
        plugins = self.active("format_output")
        parts = [] if any(p.mode == "override" for p in plugins) else [built_in(*args)]
        parts += [p.hooks["format_output"](kind, *args) for p in plugins]
        return "\n".join(x for x in parts if x)
