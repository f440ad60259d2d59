"""Generalised LL recognition over a graph-structured stack, with memoised steps.

A grammar is written in EBNF; each rule becomes a small automaton whose edges are tokens or calls of
other rules. A *descriptor* is a pair (automaton state, stack node). All descriptors alive at one input
position form a :class:`Config`; consuming a token runs every descriptor in lock step, as GLL does: a call
creates (or shares) a node of the graph-structured stack, a finished rule pops along every edge of its
node, and alternatives that agree again share their suffix. Several dialects run together because each is
just another descriptor in the start configuration; input is rejected when no descriptor of any dialect is
left.

Two things keep this fast in Python. Stack nodes are interned by content instead of by input position, so
equal configurations of different files are the same object and their successor on a token is looked up in
a dict (the step is computed once per worker process). And at an opening bracket the configuration is set
aside and recognition goes on from fresh bracket roots, to be joined again at the closing bracket; so the
number of distinct configurations does not grow with the nesting depth.
"""

from __future__ import annotations

import re
from collections import defaultdict

_TOKENS = re.compile(r"'[^']*'|[A-Za-z_]\w*|[=|;()\[\]{}@]")
EOF, BAD = "EOF", "BAD"
#: Configurations kept per language before the memo is dropped (a memory bound; results don't depend on it).
MEMO_LIMIT = 60_000


class Node:
    """A stack node: where to go on (state, parent) when the called rule ends. Interned by content."""

    __slots__ = ("edges",)

    def __init__(self, edges):
        self.edges = edges


class Config(dict):
    """All live descriptors at a position; maps a token to the next configuration, computed on first use."""

    __slots__ = ("kernel", "lang", "hook", "mark", "_inner", "joins", "twin", "base")

    def __init__(self, kernel, lang):
        self.kernel, self.lang, self._inner, self.joins, self.twin, self.base = kernel, lang, None, {}, None, None
        marks = {lang.marks[s] for s, _ in kernel if s in lang.marks}
        self.mark = min(marks) if marks else None

    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other

    def __bool__(self):
        return bool(self.kernel)

    def __missing__(self, token):
        self[token] = r = self.lang.advance(self, token)
        return r

    def inner(self):
        """The configuration just inside the bracket that this configuration has opened."""
        if self._inner is None:
            lang = self.lang
            self._inner = lang.config(frozenset((s, lang.root(s)) for s, _ in self.kernel)) if self.kernel else self
        return self._inner

    def join(self, closed):
        """Go on behind the closing bracket, from what was set aside at the opening one."""
        r = self.joins.get(closed)
        if r is None:
            back = defaultdict(list)
            for s, n in closed.kernel:
                back[n].append(s)
            lang = self.lang
            r = lang.config(frozenset((t, u) for s, u in self.kernel for t in back.get(lang.root(s), ())))
            self.joins[closed] = r
        return r


class Grammar:
    """EBNF text compiled to rule automata.

    ``'x'`` is a literal token, UPPER a token class, other names are rules; ``[ ]`` is optional, ``{ }``
    repeats, ``@m`` marks the configuration behind an element (used to find declarations). ``start`` maps a
    dialect to its start rule. ``soft`` are literals that may also stand as NAME; WORD is any name or word.
    """

    def __init__(self, text, start, classes, soft=(), pairs=(("(", ")"), ("[", "]"), ("{", "}")), word=True):
        self.rules, self.start = self._read(text), start
        literals = sorted({t[1 : t.rindex("'")] for r in self.rules.values() for t in self._leaves(r) if t[0] == "'"} | {x for p in pairs for x in p if x.isascii()})
        opens, closes = [a for a, _ in pairs], [b for _, b in pairs]
        names = [*opens, *closes]
        names += [x for x in literals if x not in names] + [c for c in (*classes, EOF, BAD) if c not in names]
        self.ids = {x: i for i, x in enumerate(names)}
        self.names, self.n_open, self.n_bracket = names, len(opens), len(names) and len(opens) + len(closes)
        words = [x for x in literals if re.match(r"[A-Za-z_]", x)] if word else []
        self.literals = set(literals) - {x for p in pairs for x in p if x.isalpha()}  # INDENT and the like are no spellings
        self.classes = {c: {self.ids[c]} for c in (*classes, EOF)}
        for c, spelled in classes.items() if isinstance(classes, dict) else ():
            if isinstance(spelled, (list, tuple, set)):  # spellings that are literals of the grammar too
                self.classes[c] |= {self.ids[x] for x in spelled if x in self.ids}
        for k in ("NAME",):
            if k in self.classes:
                self.classes[k] |= {self.ids[x] for x in soft if x in self.ids}
        if "NAME" in self.classes:
            self.classes["WORD"] = {self.ids["NAME"]} | {self.ids[x] for x in words}
        self._compile()
        self.memo_clear()

    # -- reading -----------------------------------------------------------------------------------------
    @staticmethod
    def _leaves(t):
        if isinstance(t, str):
            yield t
        else:
            for x in t[1:]:
                yield from Grammar._leaves(x)

    @staticmethod
    def _read(text):
        text = re.sub(r"(?m)^\s*#.*$", "", text)
        toks, at, rules = _TOKENS.findall(text), 0, {}

        def alt():
            nonlocal at
            out = ["|", seq()]
            while toks[at] == "|":
                at += 1
                out.append(seq())
            return tuple(out) if len(out) > 2 else out[1]

        def seq():
            nonlocal at
            out = [","]
            while toks[at] not in ("|", ";", ")", "]", "}"):
                t = toks[at]
                at += 1
                if t in "([{":
                    e = alt()
                    at += 1
                    e = e if t == "(" else ("?" if t == "[" else "*", e)
                else:
                    e = t
                    if toks[at] == "@":
                        e = f"{t}@{toks[at + 1]}"
                        at += 2
                out.append(e)
            return tuple(out)

        while at < len(toks):
            name = toks[at]
            assert toks[at + 1] == "=", f"rule {name}: '=' expected, found {toks[at + 1]}"
            at += 2
            body = alt()
            assert toks[at] == ";", f"rule {name}: ';' expected, found {toks[at]}"
            at += 1
            rules[name] = ("|", rules[name], body) if name in rules else ("|", body)
        return rules

    # -- compilation ---------------------------------------------------------------------------------------
    def _compile(self):
        nfa: list[list[tuple[str | None, int]]] = []

        def new():
            nfa.append([])
            return len(nfa) - 1

        def build(t, a, b):
            if isinstance(t, str):
                nfa[a].append((t, b))
            elif t[0] == "|":
                for x in t[1:]:
                    build(x, a, b)
            elif t[0] == ",":
                for x in t[1:]:
                    m = new()
                    build(x, a, m)
                    a = m
                nfa[a].append((None, b))
            elif t[0] == "?":
                build(t[1], a, b)
                nfa[a].append((None, b))
            else:
                m = new()
                nfa[a].append((None, m))
                nfa[m].append((None, b))
                build(t[1], m, m)

        def closure(states):
            seen, todo = set(states), list(states)
            while todo:
                for sym, b in nfa[todo.pop()]:
                    if sym is None and b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(seen)

        self.entry, self.edges, self.calls, self.final, self.marks = {}, [], [], [], {}
        for name, body in self.rules.items():
            a, z = new(), new()
            build(body, a, z)
            first, number, todo = closure([a]), {}, []

            def state(s, mark=None, number=number, todo=todo, z=z):
                if (s, mark) not in number:
                    number[s, mark] = len(self.edges)
                    self.edges.append({})
                    self.calls.append([])
                    self.final.append(z in s)
                    if mark:
                        self.marks[number[s, mark]] = mark
                    todo.append((s, mark))
                return number[s, mark]

            self.entry[name] = state(first)
            while todo:
                s, mark = todo.pop()
                me, out = number[s, mark], defaultdict(set)
                for q in s:
                    for sym, b in nfa[q]:
                        if sym is not None:
                            out[sym].add(b)
                for sym, bs in out.items():
                    base, m = re.fullmatch(r"('[^']*'|\w+)(?:@(\w+))?", sym).groups()
                    to = state(closure(bs), m or None)
                    if base in self.rules:
                        self.calls[me].append((base, to))
                    else:
                        assert base[0] == "'" or base in self.classes, f"{name}: unknown {base}"
                        for t in [self.ids[base[1:-1]]] if base[0] == "'" else self.classes[base]:
                            self.edges[me].setdefault(t, []).append(to)
        self.first = {x: set() for x in self.rules}
        self.nullable = {x: False for x in self.rules}
        members = {}
        for x in self.rules:
            seen, todo = {self.entry[x]}, [self.entry[x]]
            while todo:
                s = todo.pop()
                for b in [b for bs in self.edges[s].values() for b in bs] + [b for _, b in self.calls[s]]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            members[x] = seen
        changed = True
        while changed:
            changed = False
            for x in self.rules:
                front, seen = [self.entry[x]], {self.entry[x]}
                f, nul = set(), False
                while front:
                    s = front.pop()
                    nul |= self.final[s]
                    f |= set(self.edges[s])
                    for y, b in self.calls[s]:
                        f |= self.first[y]
                        if self.nullable[y] and b not in seen:
                            seen.add(b)
                            front.append(b)
                if f != self.first[x] or nul != self.nullable[x]:
                    self.first[x], self.nullable[x], changed = f, nul, True

    # -- the memo --------------------------------------------------------------------------------------------
    def memo_clear(self):
        self.configs, self.nodes, self.roots = {}, {}, {}
        self.dead = Config(frozenset(), self)
        self.configs[frozenset()] = self.dead

    def root(self, s):
        r = self.roots.get(s)
        if r is None:
            r = self.roots[s] = Node(())
        return r

    def node(self, rule, edges):
        key = (rule, frozenset(edges))
        n = self.nodes.get(key)
        if n is None:
            n = self.nodes[key] = Node(tuple(edges))
        return n

    def config(self, kernel):
        c = self.configs.get(kernel)
        if c is None:
            c = self.configs[kernel] = Config(kernel, self)
        return c

    def begin(self, rules=None):
        """The start configuration of the given start rules (all dialects by default)."""
        if len(self.configs) > MEMO_LIMIT:
            self.memo_clear()
        return self.config(frozenset((self.entry[r], self.root(("start", r))) for r in rules or self.start.values()))

    # -- one token -------------------------------------------------------------------------------------------
    def advance(self, config, t):
        return self.step(config, t)

    def step(self, config, t):
        """Run every descriptor of the configuration over token t."""
        out = set()
        fresh: dict[str, list] = {}  # rule called at this position -> its edges
        ended: dict[str, bool] = {}  # rule that ended at once, without a token
        todo, seen = list(config.kernel), set(config.kernel)

        def add(s, u):
            if (s, u) not in seen:
                seen.add((s, u))
                todo.append((s, u))

        def lead(u):
            return fresh[u] if isinstance(u, str) else u.edges

        while todo:
            s, u = todo.pop()
            for b in self.edges[s].get(t, ()):
                out.add((b, u))
            for rule, b in self.calls[s]:
                if t in self.first[rule] or self.nullable[rule]:
                    if rule not in fresh:
                        fresh[rule] = []
                        add(self.entry[rule], rule)
                    if (b, u) not in fresh[rule]:
                        fresh[rule].append((b, u))
                    if self.nullable[rule] or ended.get(rule):
                        add(b, u)
            if self.final[s]:
                if isinstance(u, str):
                    ended[u] = True
                for b, v in list(lead(u)):
                    add(b, v)
        made: dict[str, Node] = {}

        def real(u, path=()):
            if not isinstance(u, str):
                return u
            if u in made:
                return made[u]
            if u in path:  # a left-recursive call: a node of its own, tied to this step
                made[u] = n = Node(())
                n.edges = tuple((b, real(v, path)) for b, v in fresh[u] if v != u) + tuple((b, n) for b, v in fresh[u] if v == u)
                return n
            edges = []
            for b, v in fresh[u]:
                if self.final[b] and not self.edges[b] and not self.calls[b] and not isinstance(v, str) and v.edges:
                    edges += v.edges  # a call in last place: go straight to the caller's caller
                else:
                    edges.append((b, real(v, (*path, u))))
            if u not in made:
                made[u] = self.node(u, edges)
            return made[u]

        return self.config(frozenset((b, real(u)) for b, u in out))

    # -- whole inputs ------------------------------------------------------------------------------------------
    def accepts(self, tokens, rules=None):
        """Whether some dialect derives the token sequence (without its EOF, which is added)."""
        return self.fails_at(tokens, rules) < 0

    def fails_at(self, tokens, rules=None):
        """Index of the token at which the last dialect dies, -1 if one accepts."""
        d, stack, n_open, n_bracket = self.begin(rules), [], self.n_open, self.n_bracket
        for i, t in enumerate(tokens):
            d = d[t]
            if t < n_bracket:
                if t < n_open:
                    stack.append(d)
                    d = d.inner()
                elif stack:
                    d = stack.pop().join(d)
                else:
                    return i
            if not d.kernel:
                return i
        return -1 if not stack and d[self.ids[EOF]].kernel else len(tokens)


class Newlines(Grammar):
    """A grammar with newline tokens that matter only sometimes.

    ``mode`` "asi": a newline, a closing brace or the end stands for the token ASI where the next token
    would otherwise be an error (or is one of ``forced``). ``mode`` "line": a newline is the token NL where
    the grammar takes one and white space elsewhere; before one of ``joins`` it is white space.
    """

    def __init__(self, *a, mode="asi", newline="NL", forced=(), joins=(), **k):
        self.mode, self.newline = mode, newline
        super().__init__(*a, **k)
        self.nl, self.forced, self.joins = self.ids[newline], {self.ids[x] for x in forced if x in self.ids}, {self.ids[x] for x in joins if x in self.ids}
        self.virtual = self.ids.get("ASI")
        self.closers = {self.ids["}"], self.ids[EOF]}

    def _twin(self, config):
        if config.twin is None:
            config.twin = Config(config.kernel, self)
            config.twin.base = config
            config.twin.mark = None
        return config.twin

    def advance(self, config, t):
        base = config.base
        if t == self.nl:
            return config if base is not None else self._twin(config) if config.kernel else config
        if base is None:
            r = self.step(config, t)
            if self.mode == "asi" and not r.kernel and t in self.closers and config.kernel and (a := self.step(config, self.virtual)).kernel:
                r = self.step(a, t)
            return r
        if self.mode == "asi":
            if t in self.forced and (a := base[self.virtual]).kernel and (r := a[t]).kernel:
                return r
            r = base[t]
            return r if r.kernel or not (a := base[self.virtual]).kernel else a[t]
        if t in self.joins and (r := base[t]).kernel:
            return r
        a = self.step(base, self.nl)
        if a.kernel and (r := a[t]).kernel:
            return r
        return base[t]
