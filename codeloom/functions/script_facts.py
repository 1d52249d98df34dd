"""Facts of JavaScript and TypeScript files, read from their tokens in one pass per file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.functions.lexers import JS_TOKEN, js_chunks

LANG_FLAGS = {"typescript": (True, False), "tsx": (True, True), "javascript": (False, False), "jsx": (False, True)}
NAME_AT = re.compile(r"#?(?:[^\W\d]|[$])(?:\w|[$])*")
TYPE_WORDS = ("interface", "type")
NESTS = {"if", "for", "do", "while", "catch", "case", "default"}
TELLS = NESTS | {"import", "require", "NAME", "new", "export", "function", "=>", "class", "const", "let", "var", "else", "&&", "||", "??", "?"}  # tokens that a fact may begin at
LEAST_BLOCK_LINES, MOST_PREVIEW = 3, 80
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
CONTINUES = {".", "?.", ",", "=", "=>", "?", ":", "+", "-", "*", "/", "%", "&&", "||", "??", "&", "|", "^", "==", "===", "!=", "!==", "<", ">", "<=", "(", "[", "instanceof", "in", "as"}


@dataclass
class Facts:
    imports: list[str] = field(default_factory=list)
    named_imports: list[tuple[str, str]] = field(default_factory=list)  # (spec, name)
    exports: list[str] = field(default_factory=list)
    type_exports: list[tuple[str, str]] = field(default_factory=list)  # (name, kind)
    reexports: list[tuple[str, str]] = field(default_factory=list)  # (spec, exported name or *)
    blocks: list[tuple[str, str, int, int, int, int]] = field(default_factory=list)  # name, kind, first and last line, start and end in the text
    empty_catches: list[int] = field(default_factory=list)
    parse_errors: list[tuple[str, int, int]] = field(default_factory=list)  # message, line, column of brackets that don't match
    functions: int = 0
    classes: int = 0
    complexity: int = 1
    max_nesting_depth: int = 0


class Tokens:
    def __init__(self, source: str, ts: bool, jsx: bool):
        self.src = source
        self.marks: list[tuple[str, int, int]] = []
        for _ in js_chunks(source, ts, jsx, self.marks):
            pass
        self.term = [m[0] for m in self.marks]
        if not ts:  # types are declared in scripts of any language
            self.term = [m[0] if m[0] != "NAME" or not source.startswith(TYPE_WORDS, m[1]) or (word := NAME_AT.match(source, m[1])[0]) not in TYPE_WORDS else word for m in self.marks]
        self.n = len(self.term)
        self.errors: list[tuple[str, int, int]] = []
        self.match = [self.n] * (self.n + 1)
        stack: list[int] = []
        for i, t in enumerate(self.term):
            if t in OPEN or t == "TPLHEAD":
                stack.append(i)
            elif t in CLOSE or t == "TPLTAIL":
                if not stack or OPEN.get(self.term[stack[-1]], "TPLTAIL") != t:
                    self.errors.append((f"unexpected token: {self.text(i)[:MOST_PREVIEW]}", *self.place(i)))
                if stack:
                    self.match[stack.pop()] = i
        self.errors += [(f"missing {OPEN.get(self.term[i], 'end of template')}", *self.place(i)) for i in stack]

    def close(self, i: int) -> int:
        """The partner of the bracket at i; the end where it has none or i is no token, as in a text that breaks off."""
        return self.match[i] if i < self.n else self.n

    def text(self, i: int) -> str:
        if i >= self.n:
            return ""
        start = self.marks[i][1]
        m = NAME_AT.match(self.src, start)
        return m[0] if m else JS_TOKEN.match(self.src, start)[0]

    def place(self, i: int) -> tuple[int, int]:
        """(line, column), both from 1."""
        start = self.marks[i][1]
        return self.marks[i][2], start - self.src.rfind("\n", 0, start)

    def string(self, i: int) -> str:
        return JS_TOKEN.match(self.src, self.marks[i][1])[0][1:-1]

    def is_name(self, i: int) -> bool:
        return i < self.n and NAME_AT.match(self.src, self.marks[i][1]) is not None and self.term[i] not in ("STR", "NUM", "TPL", "TPLHEAD", "REGEX")

    def at(self, i: int) -> str:
        return self.term[i] if 0 <= i < self.n else ""


def names_in_braces(t: Tokens, i: int) -> list[tuple[str, str, bool]]:
    """(first name, last name, type-only) of each specifier between braces at i."""
    out, j, end = [], i + 1, t.close(i)
    while j < end:
        part = []
        while j < end and t.term[j] != ",":
            part.append(j)
            j += 1
        j += 1
        words = [k for k in part if t.is_name(k) and not (t.term[k] == "as" and k != part[0] and k != part[-1])]
        typed = len(words) > 1 and t.term[words[0]] == "type" and t.at(words[0] + 1) != "as"
        if typed:
            words = words[1:]
        if words:
            out.append((t.text(words[0]), t.text(words[-1]), typed))
    return out


def declarators(t: Tokens, i: int) -> list[int]:
    """Token numbers of the plain names declared from token i on."""
    out, expect, j = [], True, i
    while j < t.n:
        x = t.term[j]
        if x == ";" or x in CLOSE:
            break
        if expect and t.is_name(j):
            out.append(j)
        expect = x == ","
        if x in OPEN or x == "TPLHEAD":
            j = t.close(j)
        elif j > i and t.marks[j][2] > t.marks[j - 1][2] and x not in CONTINUES and t.at(j - 1) not in CONTINUES and not expect:
            break
        j += 1
    return out


def arrow_start(t: Tokens, k: int) -> int:
    """The first token of the function whose ``=>`` is token k."""
    j = k - 1
    back = j
    while back > 0 and t.term[back] not in (";", "{", "(", "=", ",", "=>"):  # over a return type, however long
        if t.term[back] == ":" and t.term[back - 1] == ")":
            j = back - 1
            break
        back -= 1
    if t.at(j) == ")":
        depth = 0
        while j >= 0:
            depth += (t.term[j] == ")") - (t.term[j] == "(")
            if not depth:
                break
            j -= 1
    return j - 1 if t.at(j - 1) == "async" else j


def statement_end(t: Tokens, i: int) -> int:
    """The token after the statement that starts at i."""
    heads: list[str] = []  # conditionals and do loops whose statement is being read
    while True:
        x = t.at(i)
        if x in ("if", "for", "while", "with"):
            if x == "if":
                heads.append(x)
            i = t.close(i + 1 + (t.at(i + 1) == "await")) + 1
            continue
        if x == "do":
            heads.append(x)
            i += 1
            continue
        end = _simple_end(t, i)
        while heads:
            if heads.pop() == "do":
                end = t.close(end + 1) + 1
                end += t.at(end) == ";"
            elif t.at(end) == "else":
                i = end + 1
                break
        else:
            return end


def _simple_end(t: Tokens, i: int) -> int:
    """The token after the statement at i that no other statement ends."""
    x = t.at(i)
    if x == "{":
        return t.close(i) + 1
    if x == "try":
        end = t.close(i + 1) + 1
        if t.at(end) == "catch":
            brace = end + 1 if t.at(end + 1) == "{" else t.close(end + 1) + 1
            end = t.close(brace) + 1
        return t.close(end + 1) + 1 if t.at(end) == "finally" else end
    if x == "switch":
        return t.close(t.close(i + 1) + 1) + 1
    j = i
    while j < t.n:
        y = t.term[j]
        if y == ";":
            return j + 1
        if y in CLOSE:
            return j
        if j > i and t.marks[j][2] > t.marks[j - 1][2] and y not in CONTINUES and t.at(j - 1) not in CONTINUES:
            return j
        j = t.close(j) + 1 if y in OPEN or y == "TPLHEAD" else j + 1
    return j


def nesting(t: Tokens) -> int:
    """The greatest number of conditionals, loops, catches and cases around any of them, itself included."""
    spans: list[tuple[int, int]] = []  # what adds one level
    for i, x in enumerate(t.term):
        if x not in NESTS or t.at(i - 1) in (".", "?.") or t.at(i + 1) == ":" and x != "default":
            continue
        if x == "if" or x == "for" or x == "do" or (x == "while" and not _ends_do(t, i)):
            spans.append((i, statement_end(t, i)))
        elif x == "catch" and t.at(i + 1) in ("(", "{"):
            brace = i + 1 if t.at(i + 1) == "{" else t.close(i + 1) + 1
            spans.append((i, t.close(brace) + 1))
        elif x == "case" or (x == "default" and t.at(i + 1) == ":"):
            j = i + 1
            while j < t.n and t.term[j] not in ("case", "default", "}"):
                j = t.close(j) + 1 if t.term[j] in OPEN or t.term[j] == "TPLHEAD" else j + 1
            spans.append((i, j))
    most, open_ends = 0, []
    for a, b in sorted(spans):
        while open_ends and open_ends[-1] <= a:
            open_ends.pop()
        open_ends.append(b)
        most = max(most, len(open_ends))
    return most


def _ends_do(t: Tokens, i: int) -> bool:
    """Whether the ``while`` at i closes a do statement."""
    if t.at(i - 1) != "}" and t.at(i - 1) != ";":
        return False
    j = i - 1
    depth = 0
    while j >= 0:
        depth += (t.term[j] == "}") - (t.term[j] == "{")
        if not depth and t.term[j] == "{":
            return t.at(j - 1) == "do"
        j -= 1
    return False


def is_type_arrow(t: Tokens, k: int) -> bool:
    """Whether ``=>`` belongs to a function type: its list follows a colon, ``type … =``, a bar or an angle bracket outside an expression."""
    s = arrow_start(t, k)
    before = t.at(s - 1)
    if before in ("|", "<", "&") or (before == "=" and t.at(s - 3) == "type"):
        return True
    if before != ":":
        return False
    # a colon after a name inside an object literal or a ternary starts a value, elsewhere a type
    j, depth = s - 2, 0
    while j >= 0:
        x = t.term[j]
        if x in CLOSE:
            depth += 1
        elif x in OPEN:
            if not depth:
                return x == "(" or _is_type_brace(t, j)
            depth -= 1
        elif not depth and x == "?":
            return t.at(j + 1) == ":"
        elif not depth and x in (";", "const", "let", "var"):
            return True
        j -= 1
    return True


def _is_type_brace(t: Tokens, j: int) -> bool:
    k = j - 1
    while k >= 0 and t.term[k] not in (";", "}", "{", "(", "=", ",", ":"):
        if t.term[k] in ("interface", "class"):
            return True
        k -= 1
    return t.at(k) == ":" or (t.at(k) == "=" and "type" in (t.at(k - 2), t.at(k - 3)))


def script_facts(source: str, language: str) -> Facts:
    ts, jsx = LANG_FLAGS[language]
    t = Tokens(source, ts, jsx)
    f = Facts(parse_errors=t.errors)
    line = lambda i: t.marks[min(i, t.n - 1)][2]

    def block(name: str, kind: str, a: int, b: int) -> None:
        if b < t.n and line(b) - line(a) + 1 >= LEAST_BLOCK_LINES:
            f.blocks.append((name, kind, line(a), line(b), t.marks[a][1], t.marks[b][1] + 1))

    class_bodies: list[tuple[int, int]] = []
    for i, x in enumerate(t.term):
        if x not in TELLS:
            continue
        prev = t.at(i - 1)
        if prev == "." or prev == "?.":
            continue
        nxt = t.at(i + 1)
        if x == "import":
            if nxt == "(":
                if t.at(i + 2) in ("STR", "TPL"):
                    f.imports.append(t.string(i + 2))
            elif nxt == "STR":
                f.imports.append(t.string(i + 1))
            elif nxt != ".":
                j, names = i + 1, []
                while j < t.n and t.term[j] not in ("STR", ";"):
                    if t.term[j] == "{":
                        names += [a for a, _, typed in names_in_braces(t, j) if not typed]
                        j = t.close(j)
                    elif t.term[j] == "*" and t.at(j + 1) == "as":
                        if t.is_name(j + 2):
                            names.append(t.text(j + 2))
                        j += 2
                    elif t.is_name(j) and t.term[j] != "from" and not (t.term[j] == "type" and j == i + 1 and t.at(j + 1) not in ("from", ",")):
                        names.append(t.text(j))
                    j += 1
                if t.at(j) == "STR" and t.at(j - 1) == "from":
                    spec = t.string(j)
                    f.imports.append(spec)
                    f.named_imports += [(spec, n) for n in names]
        elif x == "require" or (x == "NAME" and nxt == "(" and t.at(i + 2) == "STR" and t.text(i) == "require"):
            if nxt == "(" and t.at(i + 2) == "STR":
                f.imports.append(t.string(i + 2))
        elif x == "new" and nxt == "NAME" and t.at(i + 2) == "(" and t.at(i + 3) == "new" and t.at(i + 5) == "(" and t.at(i + 6) == "STR" and t.text(i + 1) == "Worker" and t.text(i + 4) == "URL":
            f.imports.append(t.string(i + 6))
        elif x == "export":
            _export(t, i, f)
        elif x == "function" and nxt != ":":
            f.functions += 1
            star = nxt == "*"
            at = i + 1 + star
            if t.is_name(at) and t.at(at) != "(":
                j = at
                while j < t.n and t.term[j] != "(":
                    j += 1
                body = _body_after(t, t.close(j) + 1)
                declared = prev not in ("=", "(", ",", ":", "return", "=>", "?", "new", "!", "&&", "||", "??")
                if prev == "async":
                    declared = t.at(i - 2) not in ("=", "(", ",", ":", "return", "=>", "?")
                if body < t.n and declared:
                    block(t.text(at), "function", i - (prev == "async"), t.close(body))
        elif x == "=>":
            if not (ts and is_type_arrow(t, i)):
                f.functions += 1
        elif x == "class" and nxt != ":" and (t.is_name(i + 1) or nxt == "{"):
            f.classes += 1
            j = i + 1
            while j < t.n and t.term[j] != "{":
                j = t.close(j) + 1 if t.term[j] in "([" else j + 1
            class_bodies.append((j, t.close(j)))
            if t.is_name(i + 1) and t.at(i + 1) != "extends" and prev not in ("=", "(", ","):
                start = i - 1 if prev == "abstract" else i
                block(t.text(i + 1), "class", start, t.close(j))
        elif x in ("const", "let", "var"):
            for d in declarators(t, i + 1):
                _function_value(t, d, block)
        if x in ("if", "else", "for", "do") and nxt != ":":
            f.complexity += 1
        elif x == "while" and nxt == "(" and not _ends_do(t, i):
            f.complexity += 1
        elif x == "catch" and nxt in ("(", "{"):
            f.complexity += 1
            brace = i + 1 if nxt == "{" else t.close(i + 1) + 1
            inner = t.src[t.marks[brace][1] + 1 : t.marks[t.close(brace)][1]] if brace < t.n and t.close(brace) < t.n else "x"
            if not inner.strip():
                f.empty_catches.append(line(i))
        elif x == "case" and nxt != ":" or x == "default" and nxt == ":" and prev not in ("{", ",") or x in ("&&", "||", "??"):
            f.complexity += 1
        elif x == "?" and nxt not in (":", ")", ",", "(", "=") and (not ts or _is_ternary(t, i)):
            f.complexity += 1
    for a, b in class_bodies:
        _methods(t, a, b, block)
    f.max_nesting_depth = nesting(t)
    f.imports = sorted(set(f.imports))
    f.blocks.sort(key=lambda x: (x[2], -x[3]))
    return f


def _is_ternary(t: Tokens, i: int) -> bool:
    """Whether a colon for the question mark at i follows before its statement or bracket ends."""
    j, depth = i + 1, 0
    while j < t.n:
        x = t.term[j]
        if x in CLOSE or x == ";":
            return False
        if x == "?" and t.at(j + 1) != ":":
            depth += 1
        elif x == ":":
            if not depth:
                return True
            depth -= 1
        j = t.close(j) + 1 if x in OPEN or x == "TPLHEAD" else j + 1
    return False


def _body_after(t: Tokens, j: int) -> int:
    """The brace of the body after a parameter list, over a return type; the end if there is none."""
    if t.at(j) == ":":
        j += 1
        value = True
        while j < t.n:
            x = t.term[j]
            if x == "{" and not value:
                return j
            if x == ";":
                return t.n
            value = x in (":", "|", "&", "=>", "<", ",", "is", "keyof", "readonly", "extends", "?")
            j = t.close(j) + 1 if x in OPEN else j + 1
        return t.n
    return j if t.at(j) == "{" else t.n


def _function_value(t: Tokens, d: int, block) -> None:
    """A declarator whose value is a function: the block is the value, named after the declarator."""
    j = d + 1
    if t.at(j) == ":":
        while j < t.n and t.term[j] not in ("=", ";"):
            j = t.close(j) + 1 if t.term[j] in OPEN else j + 1
    if t.at(j) != "=":
        return
    start = j + 1
    k = start + (t.at(start) == "async")
    if t.at(k) == "function" and t.at(k + 1) != "*":
        while k < t.n and t.term[k] != "(":
            k += 1
        body = _body_after(t, t.close(k) + 1)
        if body < t.n:
            block(t.text(d), "arrow_function", start, t.close(body))
        return
    if t.at(k) == "<":
        while k < t.n and t.term[k] != "(":
            k += 1
    k = t.close(k) + 1 if t.at(k) == "(" else k + 1
    if t.at(k) == ":":
        while k < t.n and t.term[k] not in ("=>", ";", "="):
            k = t.close(k) + 1 if t.term[k] in OPEN else k + 1
    if t.at(k) == "=>":
        end = t.close(k + 1) if t.at(k + 1) == "{" else _last_of(t, k + 1)
        block(t.text(d), "arrow_function", start, end)


def _last_of(t: Tokens, i: int) -> int:
    """The last token of the expression that starts at i."""
    j = last = i
    while j < t.n:
        x = t.term[j]
        if x in (";", ",") or x in CLOSE:
            break
        if j > i and t.marks[j][2] > t.marks[j - 1][2] and x not in CONTINUES and t.at(j - 1) not in CONTINUES:
            break
        last = t.close(j) if x in OPEN or x == "TPLHEAD" else j
        j = last + 1
    return last


def _methods(t: Tokens, a: int, b: int, block) -> None:
    """The methods with a body, and fields with a function, of the class body between braces a and b."""
    j = a + 1
    while j < b:
        start = j
        while t.at(j) == "@":
            j += 2
            while t.at(j) == ".":
                j += 2
            if t.at(j) == "(":
                j = t.close(j) + 1
        begin = j
        while t.at(j) in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor", "*") and t.at(j + 1) not in ("(", "=", ";", ":", "?", "!"):
            j += 1
        if t.at(j) == ";":
            j += 1
            continue
        name = j
        if t.at(j) == "[":
            j = t.close(j)
        j += 1
        if t.at(j) in ("?", "!"):
            j += 1
        if t.at(j) == "<":
            while j < b and t.term[j] != "(":
                j += 1
        if t.at(j) == "(":
            body = _body_after(t, t.close(j) + 1)
            if body < b:
                block(t.text(name) if t.is_name(name) else "anonymous", "method", begin, t.close(body))
                j = t.close(body) + 1
                continue
        if t.at(name) != "{" and t.is_name(name):
            _function_value(t, name, block)
        j = max(statement_end(t, j), start + 1)


def _export(t: Tokens, i: int, f: Facts) -> None:
    j = i + 1
    if t.at(j) == "*":
        alias = t.text(j + 2) if t.at(j + 1) == "as" else None
        k = j + (3 if alias else 1)
        if t.at(k) == "from" and t.at(k + 1) == "STR":
            spec = t.string(k + 1)
            f.imports.append(spec)
            f.reexports.append((spec, alias or "*"))
        return
    typed = t.at(j) == "type" and t.at(j + 1) == "{"
    if typed:
        j += 1
    if t.at(j) == "{":
        names = names_in_braces(t, j)
        f.exports += [b for _, b, _ in names]
        k = t.close(j) + 1
        if t.at(k) == "from" and t.at(k + 1) == "STR":
            spec = t.string(k + 1)
            f.imports.append(spec)
            f.named_imports += [(spec, a) for a, _, _ in names]
            f.reexports += [(spec, b) for _, b, _ in names]
            f.type_exports += [(b, "type" if typed or only else "reexport") for _, b, only in names if typed or only or b[:1].isupper()]
        return
    default = t.at(j) == "default"
    if default:
        j += 1
    k = j + (t.at(j) == "async")
    word = t.at(k)
    if word == "function":
        k += 1 + (t.at(k + 1) == "*")
        f.exports.append(t.text(k) if t.is_name(k) else "default")
    elif word in ("class", "interface", "type") and t.is_name(k + 1) and t.at(k + 1) != "extends":
        f.exports.append(t.text(k + 1))
        if word != "class":
            f.type_exports.append((t.text(k + 1), word))
    elif default:
        f.exports.append("default")
    elif word in ("const", "let", "var") and t.at(k + 1) != "enum":
        f.exports += [t.text(d) for d in declarators(t, k + 1)]
