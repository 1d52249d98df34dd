"""Token streams of source files: chunks of terminals, one per source line or statement.

A lexer yields (line number, terminals). A terminal that begins with ``\\n``
stands first on its line. The terminal ERR fits no rule, so a character or
literal that no token may contain is an error where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

ERR = "ERR"
Chunk = tuple[int, tuple[str, ...]]

JS_WORDS = set(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "async of get set static from as let yield await target accessor".split()
)
TS_WORDS = set("type interface namespace module declare abstract readonly is keyof infer satisfies asserts unique override public private protected global implements out require".split())
# after these a slash begins a regular expression and, with JSX, < an element
VALUE_ENDS = {"NAME", "NUM", "STR", "REGEX", "TPL", "TPLTAIL", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"} | (JS_WORDS & {"of", "get", "set", "static", "from", "as", "let", "async", "target", "accessor"}) | TS_WORDS - {"keyof", "is", "satisfies", "readonly"}

JS_TOKEN = re.compile(
    r"""(?P<ws>[ \t\v\f ﻿  -   　]+|//[^\n\r  ]*)
|(?P<nl>\r\n|[\n\r  ])
|(?P<word>(?:[^\W\d]|[$])(?:\w|[$‌‍])*)
|(?P<block>/\*(?:[^*]|\*(?!/))*\*/)
|(?P<num>(?:0[xX][0-9a-fA-F][0-9a-fA-F_]*n?|0[bB][01][01_]*n?|0[oO][0-7][0-7_]*n?|(?:\d[\d_]*n|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?))(?![\w$]))
|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
|(?P<punct>\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|\*\*|<<|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|%=|&=|\|=|\^=|[{}()\[\];,<:?.=+\-*%&|^!~@])
|(?P<gt>>=?)
|(?P<slash>/)
|(?P<tick>`)
|(?P<private>\#(?:[^\W\d]|[$])(?:\w|[$])*)
|(?P<bad>[\s\S])""",
    re.X,
)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(?:[a-zA-Z]*)")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)?")
JSX_TEXT = re.compile(r"[^{}<>]+")
JSX_TAG = re.compile(r"(?P<ws>[ \t\r\f﻿ ]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<nl>\n)|(?P<name>(?:[^\W\d]|[$])(?:[\w$-])*)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<close>/>)|(?P<punct>[>={.:<])|(?P<bad>[\s\S])")
RESTRICTED = {"return", "break", "continue", "yield"}


def js_chunks(src: str, ts: bool, jsx: bool, marks: list[tuple[str, int, int]] | None = None) -> Iterator[Chunk]:
    """Chunks of a script; ``marks`` receives (terminal, start, line) of every token outside JSX markup and of braces inside it."""
    words = JS_WORDS | TS_WORDS if ts else JS_WORDS
    match = JS_TOKEN.match
    pos, end, line, first_line = 0, len(src), 1, 1
    out: list[str] = []
    prev, fresh = ";", True  # fresh: a line break since the last token
    nest: list[str] = []  # open braces: "{", "t" of a template, "j" of a JSX child, "a" of a JSX attribute; and "e" open elements
    jsx_mode = ""  # "", "tag", "end" or "text"
    if src.startswith("﻿"):
        pos = 1
    if src.startswith("#!", pos):
        pos = len(src) if (n := src.find("\n", pos)) < 0 else n
    track = "`" in src or jsx
    while pos < end:
        if jsx_mode == "text":
            m = JSX_TEXT.match(src, pos)
            if m:
                out.append("JSXTEXT")
                line += m[0].count("\n")
                pos = m.end()
                continue
            c = src[pos]
            pos += 1
            if c == "{":
                if marks is not None:
                    marks.append(("{", pos - 1, line))
                nest.append("j")
                out.append("{")
                prev, jsx_mode = "{", ""
            elif c == "<":
                if src.startswith("/", pos):
                    pos += 1
                    out.append("</J")
                    jsx_mode = "end"
                else:
                    out.append("<J")
                    jsx_mode = "tag"
            else:
                out.append(ERR)
            continue
        if jsx_mode:
            m = JSX_TAG.match(src, pos)
            kind, text, pos = m.lastgroup, m[0], m.end()
            if kind == "ws" or kind == "nl":
                line += text.count("\n")
                continue
            if kind == "name":
                out.append("JNAME")
            elif kind == "str":
                out.append("JSTR")
                line += text.count("\n")
            elif kind == "close" or text == ">":
                out.append("/>J" if kind == "close" else ">J")
                if kind != "close" and jsx_mode == "tag":
                    nest.append("e")
                    jsx_mode = "text"
                    continue
                if jsx_mode == "end":
                    if nest and nest[-1] == "e":
                        nest.pop()
                    else:
                        out.append(ERR)
                if nest and nest[-1] == "e":
                    jsx_mode = "text"
                elif nest and nest[-1] == "v":  # an element as the value of an attribute
                    nest.pop()
                    jsx_mode = "tag"
                else:
                    prev, jsx_mode = ")", ""
            elif text == "{":
                if marks is not None:
                    marks.append(("{", pos - 1, line))
                nest.append("a" if jsx_mode == "tag" else "j")
                out.append("{")
                prev, jsx_mode = "{", ""
            elif text == "<":
                nest.append("v")
                out.append("<J")
            else:
                out.append(text if kind == "punct" else ERR)
            continue
        m = match(src, pos)
        kind = m.lastgroup
        pos = m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            line += 1
            if not fresh:
                fresh = True
            if out:
                yield first_line, tuple(out)
                out = []
            first_line = line
            continue
        text = m[0]
        if kind == "word":
            term = text if text in words else "NAME"
            if prev == "." or prev == "?.":
                term_prev = "NAME"
            else:
                term_prev = term
        elif kind == "punct":
            term = term_prev = text
            if text == "{":
                if track:
                    nest.append("{")
            elif text == "}":
                if nest:
                    top = nest.pop()
                    if top == "t":
                        t = TEMPLATE.match(src, pos)
                        line += t[0].count("\n")
                        pos = t.end()
                        if t[1] == "`":
                            term = term_prev = "TPLTAIL"
                        elif t[1]:
                            term = term_prev = "TPLMID"
                            nest.append("t")
                        else:
                            term = term_prev = ERR
                    elif top == "j":
                        if marks is not None:
                            marks.append(("}", m.start(), line))
                        out.append("\n}" if fresh else "}")
                        fresh, jsx_mode = False, "text"
                        continue
                    elif top == "a":
                        if marks is not None:
                            marks.append(("}", m.start(), line))
                        out.append("\n}" if fresh else "}")
                        fresh, jsx_mode = False, "tag"
                        continue
                    elif top != "{":
                        term = term_prev = ERR
            elif text == "<" and jsx and prev not in VALUE_ENDS and re.match(r"[A-Za-z_$>]", src[pos : pos + 1]) and not (ts and re.match(r"\w+\s*(?:,|\s+extends\b)", src[pos : pos + 80])):
                if marks is not None:
                    marks.append(("JSX", m.start(), line))
                out.append("\n<J" if fresh else "<J")
                fresh, jsx_mode = False, "tag"
                continue
            elif fresh and (text == "++" or text == "--"):
                term = text + "n"
        elif kind == "num" or kind == "private":
            term = term_prev = kind.upper()
        elif kind == "str":
            term = term_prev = "STR"
            line += text.count("\n")
        elif kind == "gt":
            term = term_prev = text + "+" if src[m.start() - 1 : m.start()] == ">" and prev in (">", ">+") else text
        elif kind == "slash":
            r = None if prev in VALUE_ENDS and not (prev == "}" and fresh) else REGEX.match(src, m.start())
            if r:
                term = term_prev = "REGEX"
                pos = r.end()
            elif src.startswith("=", pos):
                term = term_prev = "/="
                pos += 1
            else:
                term = term_prev = "/" if not src.startswith("*", pos) else ERR
        elif kind == "tick":
            t = TEMPLATE.match(src, pos)
            line += t[0].count("\n")
            pos = t.end()
            if t[1] == "`":
                term = term_prev = "TPL"
            elif t[1]:
                term = term_prev = "TPLHEAD"
                nest.append("t")
            else:
                term = term_prev = ERR
        elif kind == "block":
            n = text.count("\n")
            if n:
                line += n
                fresh = True
            continue
        else:
            term = term_prev = ERR
        if marks is not None:
            marks.append((term, m.start(), line if kind == "word" else line - src.count("\n", m.start(), pos)))
        if fresh:
            if prev in RESTRICTED and out == []:
                term = "\n" + term
                yield first_line, ("\n" + "ASI",)
                first_line = line
                out.append(term)
            else:
                out.append("\n" + term)
            fresh = False
        else:
            out.append(term)
        prev = term_prev
    if jsx_mode:
        out.append(ERR)
    if out:
        yield first_line, tuple(out)


PY_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split())
PY_TOKEN = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n|\#[^\n\r]*)
|(?P<nl>\r\n|\n|\r)
|(?P<long>(?:[bB]|[bB][rR]|[rR][bB]|[fF]|[fF][rR]|[rR][fF]|[rRuU])?(?:\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''))
|(?P<str>(?:[bB]|[bB][rR]|[rR][bB]|[fF]|[fF][rR]|[rR][fF]|[rRuU])?(?:"(?:[^"\\\n\r]|\\\r\n|\\[\s\S])*"(?!")|""(?!")|'(?:[^'\\\n\r]|\\\r\n|\\[\s\S])*'(?!')|''(?!')|"(?:[^"\\\n\r]|\\[\s\S])+"|'(?:[^'\\\n\r]|\\[\s\S])+'))
|(?P<word>[^\W\d]\w*)
|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w))
|(?P<punct>\*\*=|//=|<<=|>>=|\.\.\.|->|:=|\*\*|//|<<|>>|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[{}()\[\];,<>:.=+\-*/%&|^~@])
|(?P<bad>[\s\S])""",
    re.X,
)
PAIR = {")": "(", "]": "[", "}": "{"}


def py_chunks(src: str) -> Iterator[Chunk]:
    """One chunk for each logical line, with INDENT or DEDENT before and NEWLINE after it."""
    match = PY_TOKEN.match
    pos, end, line = 1 if src.startswith("﻿") else 0, len(src), 1
    levels, alts, depth = [0], [0], 0
    out: list[str] = []
    first_line, blank = 1, True
    while pos < end:
        if blank and not depth:  # at the start of a logical line
            m = re.compile(r"[ \t\f]*").match(src, pos)
            col = alt = 0
            for ch in m[0]:
                col, alt = (col // 8 * 8 + 8, alt + 1) if ch == "\t" else (0, 0) if ch == "\f" else (col + 1, alt + 1)
            pos = m.end()
            rest = src[pos : pos + 1]
            if rest in ("\n", "\r", "#", ""):
                m = re.compile(r"(?:#[^\n\r]*)?(\r\n|\n|\r)?").match(src, pos)
                line += bool(m[1])
                pos = m.end()
                continue
            first_line, blank = line, False
            if col == levels[-1]:
                if alt != alts[-1]:
                    out.append(ERR)
            elif col > levels[-1]:
                out.append("INDENT" if alt > alts[-1] else ERR)
                levels.append(col)
                alts.append(alt)
            else:
                while len(levels) > 1 and col < levels[-1]:
                    levels.pop()
                    alts.pop()
                    out.append("DEDENT")
                if col != levels[-1] or alt != alts[-1]:
                    out.append(ERR)
            continue
        m = match(src, pos)
        kind, text = m.lastgroup, m[0]
        pos = m.end()
        if kind == "ws":
            line += text[0] == "\\"
        elif kind == "nl":
            line += 1
            if not depth:
                out.append("NEWLINE")
                yield first_line, tuple(out)
                out, blank = [], True
        elif kind == "word":
            out.append(text if text in PY_WORDS else "NAME")
        elif kind == "punct":
            if text in "([{":
                depth += 1
            elif text in ")]}":
                depth = max(0, depth - 1)
            out.append(text)
        elif kind == "str" or kind == "long":
            line += text.count("\n")
            out.append("STR")
        elif kind == "num":
            out.append("NUM")
        else:
            out.append(ERR)
    if depth:
        out.append(ERR)  # a bracket is never closed
    if not blank:
        out.append("NEWLINE")
    out.extend(["DEDENT"] * (len(levels) - 1))
    if out:
        yield (first_line if not blank else line), tuple(out)


RS_TOKEN = re.compile(
    r"""(?P<ws>[ \t\v\f  ‎‏]+|//[^\n]*|\r)
|(?P<nl>\n)
|(?P<raw>(?:b|c)?r(?P<hashes>\#*)"[\s\S]*?"(?P=hashes))
|(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')
|(?P<life>'(?:[^\W\d]\w*)(?!'))
|(?P<str>(?:b|c)?"(?:[^"\\]|\\[\s\S])*")
|(?P<word>(?:r\#)?[^\W\d]\w*)
|(?P<num>(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.\d[\d_]*(?:[eE][+-]?[\d_]+)?|[eE][+-]?[\d_]+|\.(?![.\w]))?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))
|(?P<punct><<=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|&&|\|\||<<|\+=|-=|\*=|/=|%=|\^=|&=|\|=|\.\.|[{}()\[\]+\-*/%^!&|=<@.,;:\#$?~])
|(?P<gt>>=?)
|(?P<bad>[\s\S])""",
    re.X,
)
RS_WORDS = set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while auto default macro_rules".split())
COMMENT = re.compile(r"/\*|\*/")


def rs_chunks(src: str) -> Iterator[Chunk]:
    match = RS_TOKEN.match
    pos, end, line, first_line = 1 if src.startswith("﻿") else 0, len(src), 1, 1
    if src.startswith("#!", pos) and not re.match(r"#!\s*\[", src[pos : pos + 40]):
        pos = len(src) if (n := src.find("\n", pos)) < 0 else n
    out: list[str] = []
    last = -1  # end of the last token, if it was >
    while pos < end:
        if src.startswith("/*", pos):
            depth, at = 1, pos + 2
            while depth and (m := COMMENT.search(src, at)):
                depth += 1 if m[0] == "/*" else -1
                at = m.end()
            if depth:
                out.append(ERR)
                at = end
            line += src.count("\n", pos, at)
            pos = at
            continue
        m = match(src, pos)
        kind = m.lastgroup
        at, pos = pos, m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            line += 1
            if out:
                yield first_line, tuple(out)
                out = []
            first_line = line
            continue
        text = m[0]
        if kind == "word":
            out.append("_" if text == "_" else text if text in RS_WORDS else "NAME")
        elif kind == "punct":
            out.append(text)
        elif kind == "gt":
            out.append(text + "+" if last == at else text)
            last = pos
        elif kind == "num":
            out.append("NUM")
        elif kind == "str" or kind == "raw":
            line += text.count("\n")
            out.append("STR")
        elif kind == "char":
            out.append("CHAR")
        elif kind == "life":
            out.append("LIFETIME")
        else:
            out.append(ERR)
    if out:
        yield first_line, tuple(out)
