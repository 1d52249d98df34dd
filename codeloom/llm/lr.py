"""Table-driven parsing: LALR(1) tables from grammar text and a recogniser that follows every action of a conflict.

Grammar text has one rule per line, ``Name: alternative | alternative``; lines
that start with blanks continue a rule. Quoted symbols and symbols in capitals
are terminals. ``x?``, ``x*``, ``x+`` and ``x % 'sep'`` (one or more, parted
by the separator) and groups in parentheses may be used; ``@flag`` at the head
of a line keeps the line only for languages with the flag, ``@!flag`` only for
those without.
"""

from __future__ import annotations

import re
from collections import defaultdict

EOF = "<end>"
LEX = re.compile(r"\s*('[^']+'|\w+|[|()?*+%:])")


def read_grammar(text: str, flags: set[str]) -> tuple[str, list[tuple[str, tuple[str, ...]]]]:
    """(start symbol, productions). A quoted terminal loses its quotes."""
    lines: list[str] = []
    dropped = False
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0].isspace() and dropped:
            continue
        m = re.match(r"(\s*)@(!?)(\w+)\s(.*)", line)
        out = bool(m) and (m[3] in flags) == bool(m[2])
        if not line[0].isspace():
            dropped = out
        if out:
            continue
        if m:
            line = m[1] + m[4]
        if line[0].isspace() and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    rules: list[tuple[str, tuple[str, ...]]] = []
    made: dict[tuple, str] = {}

    def helper(kind: str, *parts) -> str:
        if (key := (kind, *parts)) in made:
            return made[key]
        name = made[key] = f"_{kind}{len(made)}"
        if kind == "plus":
            rules.extend([(name, (parts[0],)), (name, (name, parts[0]))])
        elif kind == "list":
            rules.extend([(name, (parts[0],)), (name, (name, parts[1], parts[0]))])
        else:
            rules.extend((name, alt) for alt in parts)
        return name

    def alternatives(tokens: list[str], at: int) -> tuple[list[tuple[str, ...]], int]:
        # what may be absent is written out both ways: an empty rule would force a choice too early
        alts: list[tuple[str, ...]] = []
        now: list[tuple[str, bool]] = []

        def close():
            ways: list[tuple[str, ...]] = [()]
            for x, optional in now:
                ways = [w + (x,) for w in ways] + (ways if optional else [])
            alts.extend(ways)
            now.clear()

        while at < len(tokens) and tokens[at] != ")":
            t = tokens[at]
            if t == "|":
                close()
            elif t == "(":
                inner, at = alternatives(tokens, at + 1)
                now.append((helper("group", *inner), False))
            elif t in "?*+":
                x = now[-1][0]
                now[-1] = (x if t == "?" else helper("plus", x), t != "+")
            elif t == "%":
                at += 1
                now[-1] = (helper("list", now[-1][0], tokens[at].strip("'")), False)
            else:
                now.append((t.strip("'"), False))
            at += 1
        close()
        return alts, at

    start = ""
    names = {LEX.findall(line)[0] for line in lines}
    for line in lines:
        tokens = LEX.findall(line)
        if missing := [t for t in tokens[2:] if re.fullmatch(r"[A-Z]\w*[a-z]\w*", t) and t not in names]:
            raise ValueError(f"no rule for {missing}")
        name = tokens[0]
        start = start or name
        alts, _ = alternatives(tokens[2:], 0)
        rules.extend((name, a) for a in alts)
    return start, list(dict.fromkeys(rules))


class Tables:
    """LALR(1) actions and gotos; an entry with several actions is a conflict to be followed in all ways.

    ``action[state][terminal]`` is a tuple of codes: n >= 0 shifts to state n,
    -1 - p reduces by production p. ``accept`` holds the states that accept at
    the end.
    """

    def __init__(self, start: str, rules: list[tuple[str, tuple[str, ...]]]):
        rules = [("", (start, EOF)), *rules]
        heads = {h for h, _ in rules}
        by_head: dict[str, list[int]] = defaultdict(list)
        for i, (h, _) in enumerate(rules):
            by_head[h].append(i)
        self.rules = rules
        self.terminals = {s for _, b in rules for s in b if s not in heads}
        nullable = self._nullable(rules, heads)
        states, goto = self._automaton(rules, by_head, heads)
        look = self._lookaheads(rules, heads, nullable, states, goto)
        self.goto: list[dict[str, int]] = [{} for _ in states]
        action: list[dict[str, list[int]]] = [defaultdict(list) for _ in states]
        self.accept: set[int] = set()
        for (p, x), q in goto.items():
            if x in heads:
                self.goto[p][x] = q
            elif x == EOF:
                self.accept.add(p)
                action[p][EOF].append(0)
            else:
                action[p][x].append(q)
        for (p, i), terms in look.items():
            for t in terms:
                action[p][t].append(-1 - i)
        self.action = [{t: tuple(codes) for t, codes in row.items()} for row in action]
        self.size = [len(b) for _, b in rules]
        self.head = [h for h, _ in rules]

    @staticmethod
    def _nullable(rules, heads) -> set[str]:
        out: set[str] = set()
        grew = True
        while grew:
            grew = False
            for h, b in rules:
                if h not in out and all(s in out for s in b):
                    out.add(h)
                    grew = True
        return out

    @staticmethod
    def _automaton(rules, by_head, heads):
        closure_of: dict[str, tuple[int, ...]] = {}

        def reach(x: str) -> tuple[int, ...]:
            if x not in closure_of:
                seen, todo = {x}, [x]
                while todo:
                    for i in by_head[todo.pop()]:
                        b = rules[i][1]
                        if b and b[0] in heads and b[0] not in seen:
                            seen.add(b[0])
                            todo.append(b[0])
                closure_of[x] = tuple(i for h in seen for i in by_head[h])
            return closure_of[x]

        first = ((0, 0),)
        number, states, goto = {first: 0}, [first], {}
        at = 0
        while at < len(states):
            moves: dict[str, set] = defaultdict(set)
            expanded: set[str] = set()
            for i, d in states[at]:
                b = rules[i][1]
                if d < len(b):
                    moves[b[d]].add((i, d + 1))
                    if b[d] in heads:
                        expanded.add(b[d])
            done: set[int] = set()
            for x in expanded:
                for i in reach(x):
                    if i not in done:
                        done.add(i)
                        if rules[i][1]:
                            moves[rules[i][1][0]].add((i, 1))
            for x, kernel in moves.items():
                key = tuple(sorted(kernel))
                if key not in number:
                    number[key] = len(states)
                    states.append(key)
                goto[at, x] = number[key]
            at += 1
        return states, goto

    @staticmethod
    def _lookaheads(rules, heads, nullable, states, goto):
        """Lookahead sets of all reductions, by the relations reads, includes and lookback."""
        trans = [k for k in goto if k[1] in heads]
        out_of: dict[int, list[str]] = defaultdict(list)
        for p, x in goto:
            out_of[p].append(x)
        reads: dict = defaultdict(list)
        direct: dict = {}
        for k in trans:
            r = goto[k]
            direct[k] = {x for x in out_of[r] if x not in heads}
            reads[k] = [(r, x) for x in out_of[r] if x in nullable]
        by_head: dict[str, list[int]] = defaultdict(list)
        for i, (h, _) in enumerate(rules):
            by_head[h].append(i)
        includes, lookback = defaultdict(list), defaultdict(list)
        for p, h in trans:
            for i in by_head[h]:
                body, q = rules[i][1], p
                for n, x in enumerate(body):
                    if x in heads and all(s in nullable for s in body[n + 1 :]):
                        includes[q, x].append((p, h))
                    q = goto[q, x]
                lookback[q, i].append((p, h))

        def spread(rel, base):
            """Smallest sets with f(x) ⊇ base(x) and f(x) ⊇ f(y) for x rel y, by strongly connected components."""
            f = {k: set(v) for k, v in base.items()}
            depth, stack = dict.fromkeys(f, 0), []
            for root in f:
                if depth[root]:
                    continue
                stack.append(root)
                depth[root] = len(stack)
                work = [(root, len(stack), iter(rel[root]))]
                while work:
                    x, d, it = work[-1]
                    for y in it:
                        if not depth[y]:
                            stack.append(y)
                            depth[y] = len(stack)
                            work.append((y, len(stack), iter(rel[y])))
                            break
                        depth[x] = min(depth[x], depth[y])
                        f[x] |= f[y]
                    else:
                        work.pop()
                        if depth[x] == d:
                            while True:
                                y = stack.pop()
                                depth[y] = float("inf")
                                if y == x:
                                    break
                                f[y] = f[x]
                        if work:
                            up = work[-1][0]
                            depth[up] = min(depth[up], depth[x])
                            f[up] |= f[x]
            return f

        follow = spread(includes, spread(reads, direct))
        look: dict = {}
        for (q, i), ks in lookback.items():
            look[q, i] = set().union(*(follow[k] for k in ks))
        return look


class Recognizer:
    """Feeds chunks of terminals to the tables and remembers what a chunk did to the top of the stack.

    A stack is a chain of nodes (state, node below, depth). What a chunk does
    depends only on the part of the stack that its reductions look at, so the
    outcome of a chunk is kept under its terminals and that part, and a chunk
    that comes again in the same surroundings costs one look-up. Chunks that
    leave more than one stack alive are not kept.
    """

    MOST_KEPT = 300_000

    def __init__(self, tables: Tables, asi: str | None = None):
        self.t, self.asi = tables, asi
        self.kept: dict[tuple, list] = {}
        self.held = 0

    def start(self) -> list:
        return [(0, None, 0)]

    def step(self, stacks: list, term: str, low: list[int]) -> list:
        """All stacks after ``term``; low[0] falls to the least depth that was looked at."""
        action, goto, size, head = self.t.action, self.t.goto, self.t.size, self.t.head
        if len(stacks) == 1:
            node, least = stacks[0], low[0]
            while (codes := action[node[0]].get(term)) is not None and len(codes) == 1:
                c = codes[0]
                if c >= 0:
                    low[0] = least
                    return [(c, node, node[2] + 1)]
                base, n = node, size[-1 - c]
                while n:
                    base = base[1]
                    n -= 1
                if base[2] < least:
                    least = base[2]
                node = (goto[base[0]][head[-1 - c]], base, base[2] + 1)
            low[0] = least
            if codes is None:
                return []
            stacks = [node]
        # made holds every node of this step by state and node below, so that derivations that meet become one
        made = {(n[0], id(n[1])): n for n in stacks}
        todo, done = list(made.values()), []
        while todo:
            node = todo.pop()
            for c in action[node[0]].get(term, ()):
                if c >= 0:
                    done.append((c, node, node[2] + 1))
                    continue
                base = node
                for _ in range(size[-1 - c]):
                    base = base[1]
                if base[2] < low[0]:
                    low[0] = base[2]
                state = goto[base[0]][head[-1 - c]]
                if (state, id(base)) not in made:
                    made[state, id(base)] = new = (state, base, base[2] + 1)
                    todo.append(new)
        return done

    def feed(self, stacks: list, terms: tuple[str, ...]) -> tuple[list, int]:
        """(stacks after all terminals, -1), or ([], number of the terminal that no stack takes).

        A terminal that starts with a newline mark ``\\n`` may have a statement
        end put before it where nothing else fits; so may ``}`` and the end.
        """
        if len(stacks) == 1:
            top = stacks[0]
            options = self.kept.get((top[0], terms))
            if options is not None:
                for below, pushed in options:
                    node = top
                    for state in below:
                        if node is None or node[0] != state:
                            break
                        node = node[1]
                    else:
                        if below:
                            node = top
                            for _ in range(len(below) - 1):
                                node = node[1]
                        for state in pushed:
                            node = (state, node, node[2] + 1)
                        return [node], -1
        low = [min(s[2] for s in stacks)]
        first = stacks
        for i, raw in enumerate(terms):
            newline = raw[0] == "\n" and len(raw) > 1
            term = raw[1:] if newline else raw
            after = self.step(stacks, term, low)
            if not after and self.asi and (newline or term in ("}", EOF)):
                ended = self.step(stacks, self.asi, low)
                after = self.step(ended, term, low) if ended else []
            if not after:
                return [], i
            stacks = after
        if len(first) == 1 and len(stacks) == 1:
            below, node = [], first[0]
            while node is not None and node[2] >= low[0]:
                below.append(node[0])
                node = node[1]
            pushed, node = [], stacks[0]
            while node[2] > low[0]:
                pushed.append(node[0])
                node = node[1]
            self.held += 1
            if self.held > self.MOST_KEPT:  # outcomes, not keys: a key may have many
                self.kept.clear()
                self.held = 1
            self.kept.setdefault((first[0][0], terms), []).append((tuple(below), tuple(reversed(pushed))))
        return stacks, -1

    def finish(self, stacks: list) -> bool:
        low = [0]
        after = self.step(stacks, EOF, low)
        if not after and self.asi:
            ended = self.step(stacks, self.asi, low)
            after = self.step(ended, EOF, low) if ended else []
        return bool(after)
