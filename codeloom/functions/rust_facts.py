"""Facts of Rust files: public items, imports and modules, from a light scan of the tokens."""

from __future__ import annotations

import re

from codeloom.functions.lexers import PAIR, RS_TOKEN

ITEM_KINDS = ("fn", "struct", "enum", "trait", "type", "const", "static", "mod")
QUALIFIERS = {"async", "unsafe", "extern", "const", "default"}
OPEN_LINE = re.compile(r"(?<!\\)(?<!\\\r)\n")  # a line end that no backslash carries on


def rust_tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) without white space and comments; nested comments are skipped whole.

    A quote without a partner turns what is inside and outside of all strings
    after it around. So a text that holds a bad token or whose brackets don't
    match is read again, with strings that end on their line, or go on after a
    backslash; a quote that opens no such string is bad.
    """
    out = _scan(source, False)
    return _scan(source, True) if _broken(out) else out


def _broken(tokens: list[tuple[str, str, int]]) -> bool:
    stack: list[str] = []
    for kind, text, _ in tokens:
        if kind == "bad":
            return True
        if text in PAIR.values():
            stack.append(text)
        elif text in PAIR and (not stack or stack.pop() != PAIR[text]):
            return True
    return bool(stack)


def _scan(source: str, short: bool) -> list[tuple[str, str, int]]:
    """The tokens of rust_tokens; ``short``: strings don't go over line ends."""
    out, pos, line, end = [], 0, 1, len(source)
    while pos < end:
        if source.startswith("/*", pos):
            depth, at = 1, pos + 2
            while depth and (m := re.compile(r"/\*|\*/").search(source, at)):
                depth += 1 if m[0] == "/*" else -1
                at = m.end()
            at = at if not depth else end
            line += source.count("\n", pos, at)
            pos = at
            continue
        m = RS_TOKEN.match(source, pos)
        if short and m.lastgroup == "str" and OPEN_LINE.search(m[0]):
            out.append(("bad", source[pos], line))
            pos += 1
            continue
        if m.lastgroup not in ("ws", "nl"):
            out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
        pos = m.end()
    return out


def use_tree(words: list[str], prefix: str = "") -> list[tuple[str, str]]:
    """(module, name) pairs of a use tree given as its tokens; ``*`` is a glob, ``self`` names the module itself."""
    out: list[tuple[str, str]] = []
    path: list[str] = []
    i = 0
    while i < len(words):
        w = words[i]
        if w == "{":
            depth, j, part = 1, i + 1, []
            base = "::".join(x for x in [prefix, *path] if x)
            while j < len(words) and depth:
                depth += (words[j] == "{") - (words[j] == "}")
                if depth and not (words[j] == "," and depth == 1):
                    part.append(words[j])
                elif part:
                    out += use_tree(part, base)
                    part = []
                j += 1
            return out
        if w == "as":
            break
        if w != "::":
            path.append(w)
        i += 1
    if path:
        full = [x for x in prefix.split("::") if x] + path
        if full[-1] == "self":
            full = full[:-1]
        if full:  # self alone names nothing
            out.append(("::".join(full[:-1]), full[-1]) if len(full) > 1 else (full[0], full[0]))
    return out


def _own_path(words: list[str], i: int) -> str | None:
    """The path that an attribute gives to the module declared at token i."""
    j = i - 1
    while j >= 0 and words[j] in ("pub", "(", ")", "crate", "super", "self", "in"):
        j -= 1
    while j >= 0 and words[j] == "]":
        start = j
        while start > 0 and words[start] != "#":
            start -= 1
        if words[start : start + 4] == ["#", "[", "path", "="] and j - start == 5:
            return words[start + 4].strip('"')
        j = start - 1
    return None


def rust_facts(source: str) -> tuple[list[str], list[tuple[str, str]], list[str], int]:
    """(public names, (module, name) imports, child modules, number of public functions). A module with a path of its own is ``@`` and that path."""
    toks = rust_tokens(source)
    words = [t[1] for t in toks]
    exports, imports, mods, functions, depth = [], [], [], 0, 0
    i = 0
    while i < len(words):
        w = words[i]
        depth += (w == "{") - (w == "}")
        if w == "pub":
            j = i + 1
            if j < len(words) and words[j] == "(":
                while j < len(words) and words[j] != ")":
                    j += 1
                j += 1
            while j + 1 < len(words) and words[j] in QUALIFIERS and words[j + 1] in (*QUALIFIERS, "fn", '"C"'):
                j += 1
            if j + 1 < len(words) and words[j] in ITEM_KINDS:
                name = words[j + 1] if words[j + 1] != "mut" else "".join(words[j + 2 : j + 3])
                exports += [name] if name else []
                functions += words[j] == "fn"
        if w == "use" and depth == 0:
            j = i + 1
            while j < len(words) and words[j] != ";":
                j += 1
            imports += use_tree(words[i + 1 : j])
            i = j
        elif w == "mod" and i + 2 < len(words) and words[i + 2] == ";":
            own = _own_path(words, i)
            mods.append(f"@{own}" if own else words[i + 1])
        i += 1
    return exports, imports, mods, functions
