"""Tokens of the supported languages, as ids of the grammars' terminals.

One regular expression per language splits a text in C; the spelling of a token alone decides its class, so
each spelling is classified once per worker and looked up afterwards. Rules that need context (indentation,
inserted semicolons, heredocs) work on the token list.
"""

from __future__ import annotations

import re
from functools import cache

from depgraph.llm import grammars
from depgraph.llm.gll import Grammar, Newlines

TABLE_LIMIT = 300_000


class _Table(dict):
    """Spelling -> terminal id."""

    def __init__(self, classify):
        self.classify = classify

    def __missing__(self, text):
        if len(self) > TABLE_LIMIT:
            self.clear()
        self[text] = r = self.classify(text)
        return r


class Language:
    """Grammar plus lexer of one language.

    ``pattern`` has one group, the token; what it matches before the group is white space and comments.
    ``classes`` maps a terminal class to a regular expression or a set of spellings; the first that fits a
    spelling wins, spellings of grammar literals come before that.
    """

    def __init__(self, name, grammar, pattern, classes, reserved=(), heredoc=None, post=None, frag="Frag"):
        self.name, self.grammar, self.heredoc, self.post, self.frag = name, grammar, heredoc, post, frag
        self.pattern = re.compile(pattern)
        self.tests = [(grammar.ids[c], re.compile(t) if isinstance(t, str) else frozenset(t)) for c, t in classes.items()]
        self.reserved = frozenset(reserved)
        self.table = _Table(self._classify)
        self.bad, self.eof = grammar.ids["BAD"], grammar.ids["EOF"]

    def _classify(self, text):
        g = self.grammar
        if not text:
            return self.eof
        if text in g.literals:
            return g.ids[text]
        for i, t in self.tests:
            if isinstance(t, frozenset) and text in t:
                return i
        if text in self.reserved:
            return self.bad
        return next((i for i, t in self.tests if not isinstance(t, frozenset) and t.fullmatch(text)), self.bad)

    def spellings(self, text):
        if self.heredoc and "<<" in text:
            return _with_heredocs(self.heredoc, text)
        return self.pattern.findall(text)

    def tokens(self, text):
        """Terminal ids of a text, the end not included."""
        ids = list(map(self.table.__getitem__, self.spellings(text)))
        while ids and ids[-1] == self.eof:
            ids.pop()
        return self.post(self, ids) if self.post else ids

    def placed(self, text):
        """(terminal id, start, end) of each token, for finding declarations; inserted ones have no width."""
        table, regex = self.table, self.grammar.ids.get("REGEX")
        if self.heredoc and "<<" in text:
            out = []
            for m in self.heredoc.finditer(text):
                s, e = m.span(1)
                rest = m.groupdict().get("rest")
                out.append((table[m[1]], s, e if rest is None else m.start("rest")))
                if rest is not None:
                    out += [(t, m.start("rest") + a, m.start("rest") + b) for t, a, b in self.placed(rest)] if rest else []
                    out.append((table["\n"], e, e))
        else:
            out = [(table[m[1]], *m.span(1)) for m in self.pattern.finditer(text)]
        if regex is not None:  # white space may lead a regular expression
            out = [(t, e - len(text[s:e].lstrip()), e) if t == regex else (t, s, e) for t, s, e in out]
        while out and out[-1][0] == self.eof:
            out.pop()
        return self.place(out, text) if self.place else out

    place = None

    def valid(self, text):
        """Whether some dialect accepts the whole text."""
        text = text.removeprefix("\ufeff")
        return self.grammar.accepts(self.tokens(text))


def _with_heredocs(pattern, text):
    out = []
    for m in pattern.finditer(text):
        g = m.groupdict()
        out.append(m[1])
        if g.get("rest"):
            out += [x for x in _with_heredocs(pattern, g["rest"]) if x]
        if g.get("nl"):
            out.append("\n")
    return out


def _ops(*ops):
    return "|".join(map(re.escape, sorted(ops, key=len, reverse=True)))


_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_COMMENT = rf"//[^\n]*+|{_BLOCK}"
_DQ, _SQ = r'"[^"\\\r\n]*+(?:\\(?:\r\n|[\s\S])[^"\\\r\n]*+)*+"', r"'[^'\\\r\n]*+(?:\\(?:\r\n|[\s\S])[^'\\\r\n]*+)*+'"
_IDENT = r"[^\W\d]\w*"
#: The commonest tokens, tried first: plain words that don't begin something longer, and single marks.
_FAST = r"[A-Za-z_]\w*+(?![\"'`$])|[;,(){}\[\]]"
_NAME = r"[^\W\d]\w*"


# -- Python ------------------------------------------------------------------------------------------------------
#: Fixed values of the language.
_PY_RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()


def _python_indent(lang, spelled, where=None):
    """Newline tokens become NEWLINE, INDENT and DEDENT, by the rules for tabs that the language has.

    where: gets, for each token returned, the index of its spelling; then a line that starts a declaration
    also ends what brackets are open (an error that only the search for declarations goes beyond).
    """
    g, table = lang.grammar, lang.table
    newline, indent, dedent, bad = (g.ids[x] for x in ("NEWLINE", "INDENT", "DEDENT", "BAD"))
    out, depth, stack = [], 0, [(0, 0)]
    n_open, n_bracket = g.n_open, g.n_bracket
    last = len(spelled) - 1
    for i, s in enumerate(spelled):
        if s and s[0] in "\r\n":
            if depth and not (where is not None and i < last and spelled[i + 1] in ("def", "class", "@")):
                continue
            depth = 0
            if out and out[-1] != newline and out[-1] != dedent:
                out.append(newline)
            if i + 1 >= last and (i == last or not spelled[last]):
                break
            w = s[max(s.rfind("\n"), s.rfind("\r")) + 1 :]
            a = b = len(w)
            if "\t" in w or "\f" in w:
                a = b = 0
            for ch in w if not (a or b) else "":
                if ch == "\t":
                    a, b = (a // 8 + 1) * 8, b + 1
                elif ch == "\f":
                    a = b = 0
                else:
                    a, b = a + 1, b + 1
            if (a == stack[-1][0]) != (b == stack[-1][1]):
                out.append(bad)
            elif a > stack[-1][0]:
                out += [indent] if b > stack[-1][1] else [bad]
                stack.append((a, b))
            else:
                while a < stack[-1][0]:
                    stack.pop()
                    out.append(dedent)
                if (a, b) != stack[-1]:
                    out.append(bad)
            continue
        t = table[s]
        if t < n_bracket:
            depth += 1 if t < n_open else -1
            depth = max(depth, 0)
        if where is not None:
            where += [i - 1] * (len(out) - len(where)) + [i]
        out.append(t)
    while out and out[-1] == lang.eof:
        out.pop()
    if out and out[-1] not in (newline, dedent):
        out.append(newline)
    return out + [dedent] * (len(stack) - 1)


class _Python(Language):
    def placed(self, text):
        found = [(m.span(1), m[1]) for m in self.pattern.finditer("\n" + text)]
        where: list[int] = []
        ids = _python_indent(self, [t for _, t in found], where)
        where += [len(found) - 1] * (len(ids) - len(where))
        inserted = {self.grammar.ids[x] for x in ("NEWLINE", "INDENT", "DEDENT")}
        return [(t, found[i][0][1] - 1, found[i][0][1] - 1) if t in inserted else (t, found[i][0][0] - 1, found[i][0][1] - 1) for t, i in zip(ids, where)]

    def tokens(self, text):
        return _python_indent(self, self.spellings("\n" + text))  # so that the first line's indentation is seen


@cache
def python():
    classes = {"STR": None, "NUM": None, "NAME": None, "AUG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "BINOP": "/ // % @ & ^ >> << < > <= >= == !=".split()}
    g = Grammar(grammars.PYTHON, {"file": "File"}, classes | dict.fromkeys(("NEWLINE", "INDENT", "DEDENT")), soft=("match", "case", "type"), pairs=(("(", ")"), ("[", "]"), ("{", "}"), ("INDENT", "DEDENT")))
    p = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
    fs = r"(?:[fFtT][rR]?|[rR][fFtT])"
    inner = r"\{(?:[^{}\r\n]|\{[^{}\r\n]*\})*\}"
    string = rf"{fs}\"(?!\"\")(?:[^\"\\{{}}\r\n]|\\[\s\S]|\{{\{{|\}}\}}|{inner})*+\"|{fs}'(?!'')(?:[^'\\{{}}\r\n]|\\[\s\S]|\{{\{{|\}}\}}|{inner})*+'|{p}(?:'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''|\"\"\"[^\"\\]*+(?:(?:\\[\s\S]|\"(?!\"\"))[^\"\\]*+)*+\"\"\"|(?!'''|\"\"\"){_DQ}|(?!'''|\"\"\"){_SQ})"
    num = r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![^\W_]|_)"
    nl = r"(?:[ \t\f]*+(?:#[^\r\n]*+)?+(?:\r\n?|\n))++[ \t\f]*+"
    ops = _ops("**=", "//=", ">>=", "<<=", "...", "!=", "->", ":=", "**", "//", "<<", ">>", "<=", ">=", "==", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=")
    pattern = rf"(?:[ \t\f]+|\\(?:\r\n?|\n)|#[^\r\n]*)*+({_FAST}|{nl}|{string}|{num}|{_IDENT}|{ops}|[\s\S]|\Z)"
    return _Python("python", g, pattern, {
        "STR": string, "NUM": r"(?!0[0_]*[1-9][\d_]*$)" + num, "NAME": _NAME,
        "AUG": classes["AUG"], "BINOP": classes["BINOP"],
    }, _PY_RESERVED)


# -- C -------------------------------------------------------------------------------------------------------------
#: Fixed values of the language.
_C_BASIC = "void char short int long float double signed unsigned bool _Bool _Complex _Decimal32 _Decimal64 _Decimal128 __int128 _BitInt __builtin_va_list".split()
_C_QUAL = "const volatile restrict static extern inline register typedef _Noreturn _Thread_local thread_local constexpr __inline __inline__ __restrict __restrict__ __volatile__ __extension__ __const _Atomic".split()
_C_RESERVED = "break case continue default do else enum for goto if return sizeof struct switch union while".split()


#: Conditions whose value is fixed in C. Their other branches are never compiled, so they need not parse.
_C_KNOWN = {"0": False, "1": True, "__cplusplus": False}
_C_DIRECTIVE = re.compile(r"\s*#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error)\b([\s\S]*)")
_C_DEFINED = re.compile(r"(!?)\s*defined\s*(?:\(\s*(\w+)\s*\)|(\w+))")
_C_COMMENT = re.compile(rf"({_DQ}|{_SQ})|{_COMMENT}")


class _Branch:
    """A branch of a conditional: lines and chains of branches in ``items``; the whole text is one, too."""

    def __init__(self, up=None, key=None, holds=True):
        self.up, self.key, self.holds, self.items, self.dead = up, key, holds, [], False

    def needs(self):
        """Variants until each branch inside was taken once."""
        return max((sum(b.needs() for b in c) for c in self.items if isinstance(c, list)), default=1) or 1

    def inner(self):
        for c in self.items:
            for b in c if isinstance(c, list) else ():
                yield b
                yield from b.inner()


def _c_condition(word, rest):
    rest = " ".join(rest.replace("\\\n", " ").replace("\\\r\n", " ").split())
    if word.endswith("def"):
        return rest.split(" ")[0], not word.endswith("ndef")
    m = _C_DEFINED.fullmatch(rest)
    return (m[2] or m[3], not m[1]) if m else (rest, True)


def _c_tree(text):
    """The whole text as a branch, without comments and branches that are never compiled; None if directives don't balance."""
    text = _C_COMMENT.sub(lambda m: m[1] or " ", text)
    root = at = _Branch()
    chains = []
    for line in re.split(r"(?<!\\)(?<!\\\r)\n", text):
        m = _C_DIRECTIVE.match(line)
        if not m:
            at.items.append(line)
        elif m[1] == "error":
            at.dead = at is not root
        elif m[1].startswith("if"):
            chains.append([_Branch(at, *_c_condition(m[1], m[2]))])
            at.items.append(chains[-1])
            at = chains[-1][0]
        elif not chains or m[1] != "endif" and chains[-1][-1].key is None:
            return None
        elif m[1] == "endif":
            at, chain = at.up, chains.pop()
            live = []
            for b in chain:
                value = b.key is None or _C_KNOWN.get(b.key)
                value = value if value is None or b.key is None else value == b.holds
                if value is not False and not b.dead:
                    live.append(b)
                if value:
                    break
            chain[:] = live
        else:
            key, holds = (None, True) if m[1] == "else" else _c_condition(m[1], m[2])
            at = _Branch(at.up, key, holds)
            chains[-1].append(at)
    return None if chains else root


def _c_cover(branch, k, lines, taken):
    """The k-th variant of those that take every branch once; no chain is left out."""
    taken.add(branch)
    for c in branch.items:
        if isinstance(c, str):
            lines.append(c)
            continue
        needs = [b.needs() for b in c]
        i = min(k, sum(needs) - 1)
        for b, n in zip(c, needs):
            if i < n:
                _c_cover(b, i, lines, taken)
                break
            i -= n


def _c_around(branch, forced, truth, lone, last, lines, taken):
    """A variant that takes the ``forced`` branches, in which equal conditions have equal values."""
    taken.add(branch)
    for c in branch.items:
        if isinstance(c, str):
            lines.append(c)
            continue
        pick = next((b for b in c if b in forced), None)
        if not pick:
            free = []
            for b in c:
                value = True if b.key is None else truth.get(b.key)
                if value is not None and b.key is not None:
                    value = value == b.holds
                if value is not False:
                    free.append(b)
                if value:
                    break
            pick = free[-1 if last else 0] if free and (lone or truth.get(free[0].key) is not None or free[-1].key is None) else None
        for b in c:
            if b.key is not None:
                truth.setdefault(b.key, b.holds == (b is pick))
            if b is pick:
                _c_around(b, forced, truth, lone, last, lines, taken)
                break


class _C(Language):
    def valid(self, text):
        """Whether every branch of the conditionals is part of a text that is accepted.

        Conditionals without #else are kept as long as that parses. Of a branch that fails, texts are tried in
        which other conditionals are left out or take another branch; what stands in it is part of all of them.
        """
        if "#" not in text or "if" not in text and "#el" not in text.replace(" ", ""):
            return super().valid(text)
        root = _c_tree(text.removeprefix("\ufeff"))
        if root is None:
            return False
        seen, covered = {}, set()

        def accepts(make, *how):
            lines, taken = [], set()
            make(root, *how, lines, taken)
            t = "\n".join(lines)
            if t not in seen:
                seen[t] = self.grammar.accepts(self.tokens(t))
            if seen[t]:
                covered.update(taken)
            return seen[t]

        for k in range(root.needs()):
            accepts(_c_cover, k)
        for branch in (*root.inner(), root):
            own = "\n".join(x for x in branch.items if isinstance(x, str))
            if branch in covered or branch is not root and not self.tokens(own):
                continue
            forced, truth, b = set(), {}, branch
            while b.up:
                forced.add(b)
                chain = next(c for c in b.up.items if isinstance(c, list) and b in c)
                for x in chain[: chain.index(b) + 1]:
                    if x.key is not None:
                        truth[x.key] = x.holds == (x is b)
                b = b.up
            if not any(accepts(_c_around, forced, dict(truth), lone, last) for lone in (True, False) for last in (False, True)):
                return False
        return True


@cache
def c():
    classes = {"STR": rf"(?:u8|[uUL])?{_DQ}", "CHAR": rf"(?:u8|[uUL])?'(?:[^'\\\r\n]|\\[^\r\n])(?:[^'\\\r\n]|\\[^\r\n])*'", "NUM": r"(?:0[xX][\da-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]|[wW][bB]|[iIjJ]|DF|DD|DL)*", "BASIC": _C_BASIC, "QUAL": _C_QUAL, "ASM": ["asm", "__asm__", "__asm"], "TYPEOF": ["typeof", "typeof_unqual", "__typeof__", "__typeof"], "ALIGNOF": ["_Alignof", "alignof", "__alignof__"], "MACRO": r"[A-Z_][A-Z\d_]{2,}", "NAME": _NAME,
        "INCDEC": ["++", "--"], "ASSIGN": "+= -= *= /= %= &= |= ^= <<= >>=".split(), "PREFIX": "! ~".split(), "BINOP": "/ % ^ < > <= >= == != && || << >> |".split()}
    text = grammars.C.replace("PREFIX |", "PREFIX | '&' | '-' | '+' | '&&' | INCDEC |").replace("( BINOP | ASSIGN | '*' | '=' )", "( BINOP | ASSIGN | '*' | '=' | '&' | '-' | '+' | '&&' )")
    g = Grammar(text, {"file": "File"}, classes)
    g.classes["NAME"].add(g.ids["MACRO"])
    g._compile()
    directive = r"^[ \t]*#[ \t]*(?:(?:include|include_next|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|pragma|line|embed|import|ident|\d+)\b(?:[^\n\\]|\\\r?\n|\\)*|\r?$)"
    pattern = rf"(?m)(?:{directive}|\n|[^\S\n]+|{_COMMENT}|\\\r?\n)*+({_FAST}|(?:u8|[uUL])?{_DQ}|(?:u8|[uUL])?{_SQ}|\.?\d(?:[eEpP][+-]|[\w.]|'\w)*|{_IDENT}|/\*|{_ops('...', '<<=', '>>=', '->', '++', '--', '<<', '>>', '<=', '>=', '==', '!=', '&&', '||', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=', '::')}|[\s\S]|\Z)"
    return _C("c", g, pattern, classes, _C_RESERVED)


# -- Java ------------------------------------------------------------------------------------------------------------
#: Fixed values of the language.
_JAVA_RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()


@cache
def java():
    classes = {"STR": r'"""[\s\S]*"""|' + _DQ, "CHAR": r"'(?:[^'\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4}))'", "NUM": r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?", "PRIMITIVE": "boolean byte char short int long float double".split(), "MODIFIER": "public protected private native strictfp transient volatile sealed".split(),
        "NAME": _NAME.replace(r"[^\W\d]", r"(?:[^\W\d]|\$)").replace(r"\w*", r"[\w$]*"), "INCDEC": ["++", "--"], "ASSIGN": "+= -= *= /= %= &= |= ^= <<= >>= >>>=".split(), "PREFIX": "! ~ +".split(), "BINOP": "* / % ^ <= >= == != && || <<".split()}
    text = grammars.JAVA.replace("BinOp = BINOP |", "BinOp = BINOP | '+' |").replace("{ PREFIX | '-' | INCDEC }", "{ PREFIX | '+' | '-' | INCDEC }")
    g = Grammar(text, {"file": "File"}, classes, soft=("open", "module", "record", "permits", "yield", "when", "non", "sealed"))
    g.classes["NAME"] |= {g.ids["record"]}
    g._compile()
    pattern = rf"(?:\s+|{_COMMENT})*+({_FAST}|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|{_DQ}|{_SQ}|\.?\d(?:(?<=[eE])[+-](?=\d)(?<!0x\de[+-])|[\w.])*|[^\W\d][\w$]*|\$[\w$]*|/\*|{_ops('...', '->', '::', '++', '--', '<<', '<=', '>=', '==', '!=', '&&', '||', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=', '<<=', '>>=', '>>>=')}|[\s\S]|\Z)"
    return Language("java", g, pattern, classes, _JAVA_RESERVED)


# -- Go ----------------------------------------------------------------------------------------------------------------
#: Fixed values of the language.
_GO_RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()


def _go_semicolons(lang, ids):
    g = lang.grammar
    nl, semi = g.ids["NL"], g.ids[";"]
    ends = {g.ids[x] for x in ("NAME", "NUM", "STR", "CHAR", "INCDEC", "break", "continue", "fallthrough", "return", ")", "]", "}")}
    if ids and ids[-1] != nl:
        ids = [*ids, nl]
    out = [semi if b == nl else b for a, b in zip([nl, *ids], ids) if b != nl or a in ends]
    return out


class _Go(Language):
    def place(self, out, text):
        g = self.grammar
        nl, semi = g.ids["NL"], g.ids[";"]
        ends = {g.ids[x] for x in ("NAME", "NUM", "STR", "CHAR", "INCDEC", "break", "continue", "fallthrough", "return", ")", "]", "}")}
        return [(semi, y[1], y[1]) if y[0] == nl else y for x, y in zip([(nl, 0, 0), *out], out) if y[0] != nl or x[0] in ends]


@cache
def go():
    esc = r"\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8})"
    classes = {"STR": rf"`[^`]*`|\"(?:[^\"\\\r\n]|{esc})*\"", "CHAR": rf"'(?:[^'\\\r\n]|{esc})'", "NUM": r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?", "NL": r"\n", "NAME": _NAME, "INCDEC": ["++", "--"], "ASSIGN": "+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "PREFIX": "! ^ &".split(), "BINOP": "/ % < > <= >= == != && || << >> &^".split()}
    text = grammars.GO.replace("( BINOP | '*'", "( BINOP | '&' | '^' | '*'").replace("{ PREFIX | '*'", "{ PREFIX | '&' | '^' | '*'")
    g = Grammar(text, {"file": "File"}, classes, soft=())
    pattern = rf"(?:[^\S\n]+|//[^\n]*|/\*[^*\n]*+(?:\*(?!/)[^*\n]*+)*+\*/)*+({_FAST}|\n(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/)*+|/\*[\s\S]*?\*/|`[^`]*`|{_DQ}|{_SQ}|\.?\d(?:[eEpP][+-]|[\w.])*|{_IDENT}|{_ops('...', ':=', '<-', '&^=', '&^', '++', '--', '<<=', '>>=', '<<', '>>', '<=', '>=', '==', '!=', '&&', '||', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=')}|[\s\S]|\Z)"
    lang = _Go("go", g, pattern, classes | {"NL": r"\n(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/)*|/\*[\s\S]*\n[\s\S]*\*/"}, _GO_RESERVED, post=_go_semicolons)
    return lang


# -- PHP -----------------------------------------------------------------------------------------------------------------
#: Fixed values of the language.
_PHP_RESERVED = "abstract and array as break callable case catch class clone const continue declare default die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public require require_once return static switch throw trait try unset use var while xor yield".split()


class _Php(Language):
    def spellings(self, text):
        if not re.search(r"<\?(?:php\b|=)", text, re.I):
            return ["?>"]  # all of it stands outside the tags
        return super().spellings(text)

    def _classify(self, text):
        low = text.lower() if text[:1].isalpha() or text[:1] == "_" else text
        return super()._classify({"die": "exit"}.get(low, low) if low in self.grammar.literals or low in self.reserved else text)


@cache
def php():
    g_inline = r"\?>[^<]*+(?:<(?!\?(?:[pP][hH][pP]\b|=))[^<]*+)*+(?:<\?(?:[pP][hH][pP]\b|=)|\Z)"
    dq = r'[bB]?"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
    sq = r"[bB]?'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
    start = r"\A[^<]*+(?:<(?!\?(?:[pP][hH][pP]\b|=))[^<]*+)*+(?:<\?(?:[pP][hH][pP]\b|=)|\Z)"
    cast = r"\(\s*(?:int|integer|bool|boolean|float|double|string|array|object|unset|binary)\s*\)"
    classes = {"INLINE": r"(?:\?>[\s\S]*|(?:[^<]|<(?!\?))[\s\S]*<\?(?:[pP][hH][pP]|=)|<\?(?:[pP][hH][pP]|=))", "STR": rf"{dq}|{sq}|`(?:[^`\\]|\\[\s\S])*`|<<<[\s\S]*", "NUM": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)", "VAR": r"\$" + _NAME, "CAST": cast, "MODIFIER": "public protected private abstract final readonly var".split(), "NAME": _NAME,
        "INCDEC": ["++", "--"], "ASSIGN": "+= -= *= /= .= %= **= &= |= ^= <<= >>= ??=".split(), "PREFIX": "! ~ @".split(), "BINOP": "* / % . ** ^ < > <= >= == != <> === !== <=> && || << >> ?? |>".split()}
    soft = ("self", "null", "true", "false", "enum", "namespace", "from", "readonly", "static")
    text = grammars.PHP
    g = Grammar(text, {"file": "File"}, classes, soft=("self", "null", "true", "false", "enum", "from", "match", "parent"))
    g.classes["WORD"] |= {g.ids["MODIFIER"]}
    g._compile()
    body = rf"(?:\s+|(?://|\#(?!\[))[^\n?]*+(?:\?(?!>)[^\n?]*+)*+|{_BLOCK})*+"
    toks = rf"\$[A-Za-z_]\w*+|[;,)}}\[\]{{]|[A-Za-z_]\w*+(?![\"'])|{start}|{g_inline}|{dq}|{sq}|`(?:[^`\\]|\\[\s\S])*+`|{cast}|\$?{_IDENT}|\.?\d(?:(?<=[eE])[+-](?=\d)|[\w]|\.(?!\.))*|/\*|{_ops('<=>', '**=', '...', '===', '!==', '??=', '?->', '<<=', '>>=', '#[', '->', '=>', '::', '++', '--', '<<', '>>', '<=', '>=', '==', '!=', '<>', '&&', '||', '??', '+=', '-=', '*=', '/=', '.=', '%=', '&=', '|=', '^=', '**', '|>')}|[\s\S]|\Z"
    here = r"<<<[ \t]*(?P<q>['\"]?)(?P<tag>[^\W\d]\w*)(?P=q)\r?\n(?:[^\n]*\n)*?[ \t]*(?P=tag)\b"
    del soft
    return _Php("php", g, rf"{body}({toks})", classes, _PHP_RESERVED, heredoc=re.compile(rf"{body}({here}|{toks})"))


# -- Ruby ------------------------------------------------------------------------------------------------------------------
#: Fixed values of the language.
_RUBY_RESERVED = "BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split()


@cache
def ruby():
    pct = r"%[wWiIqQxrs]?(?:\((?:[^()\\]|\\[\s\S]|\([^()]*\))*+\)|\[(?:[^\[\]\\]|\\[\s\S]|\[[^\[\]]*\])*+\]|\{(?:[^{}\\]|\\[\s\S]|\{[^{}]*\})*+\}|<(?:[^<>\\]|\\[\s\S])*+>|\|(?:[^|\\]|\\[\s\S])*+\||!(?:[^!\\]|\\[\s\S])*+!)"
    interp = r"\#\{(?:[^{}]|\{[^{}]*\})*\}"
    dq = rf"\"(?:[^\"\\#]++|\\[\s\S]|{interp}|\#)*+\""
    sq, bq = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'", rf"`(?:[^`\\#]|\\[\s\S]|{interp}|\#)*+`"
    rex = rf"/(?![\s=*])(?:[^/\\\r\n\[#]|\\.|\[(?:[^\]\\\r\n]|\\.)*+\]|{interp}|\#)*+/[imxounse]*"
    sym = rf":(?:{dq}|{sq}|[^\W\d]\w*[?!=]?(?![\w:])|\[\]=?|<=>|===?|=~|[!+\-~]@|\*\*|<<|>>|<=|>=|[+\-*/%<>!~^&|])"
    label = r"(?:[^\W\d]\w*[?!]?|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'):(?!:)"
    nl = r"\n(?:\s|\#[^\n]*|=begin\b[\s\S]*?\n=end\b[^\n]*)*+"
    num = r"\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?r?i?|0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+"
    classes = {"NL": r"\n[\s\S]*", "LABEL": label, "SYM": sym, "STR": rf"{dq}|{sq}|{bq}|%[wWiIqQxs]?[^\w\s][\s\S]*|<<[~-]?[\s\S]*|\?[^\s]", "REGEX": r"/[\s\S]+/[imxounse]*|%r[\s\S]+", "NUM": num, "FUNC": r"[^\W\d]\w*[?!]", "CONST": r"[A-Z]\w*", "NAME": _NAME, "IVAR": r"@@?[^\W\d]\w*", "GVAR": r"\$(?:[^\W\d]\w*|[!@&~0-9$?:\"<>,./\;*+`']|-\w)",
        "RANGE": ["..", "..."], "ASSIGN": "+= -= *= /= %= **= ||= &&= |= &= ^= <<= >>=".split(), "OPNAME": ["[]", "[]=", "+@", "-@"], "BINOP": "/ % + == != === =~ !~ <=> > <= >= && || << >> ^".split()}
    text = grammars.RUBY.replace("'...' | RANGE", "RANGE").replace("| BINOP ) | '::'", "| BINOP | '<' | '<<' ) | '::'").replace("Op = BINOP |", "Op = BINOP | '<<' | '||' | '^' | '+' |").replace("( BINOP | '-' | '*' | '+' ) Unary", "( BINOP | '-' | '*' | '+' | '<<' ) Unary").replace("BINOP@d |", "BINOP@d | '<<'@d | '^'@d |")
    g = Newlines(text, {"file": "File"}, classes, mode="line", joins=(".", "&."), soft=())
    g.classes["WORD"] |= {g.ids["CONST"]}
    g._compile()
    body = r"(?:[^\S\n]+|\\\r?\n|\#[^\n]*|(?m:^)=begin\b[\s\S]*?\n=end\b[^\n]*)*+"
    before = r"(?:\A|(?<=[=(,\[!|&{;\n~?:])|(?<=\bif)|(?<=\bunless)|(?<=\bwhen)|(?<=\band)|(?<=\bor)|(?<=\bnot)|(?<=\breturn)|(?<=\bsplit)|(?<=\bin))[^\S\n]*"
    toks = rf"__END__\r?\n[\s\S]*|{nl}|{label}|{sym}|{dq}|{sq}|{bq}|{num}|@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|[!@&~0-9$?:\"<>,./\;*+`']|-\w)|defined\?|[^\W\d]\w*(?:[?!](?![=~])|\?(?==[=~]))?|\?[a-zA-Z](?!\w)|{_ops('...', '..', '**=', '||=', '&&=', '<=>', '===', '<<=', '>>=', '&.', '->', '=>', '::', '==', '!=', '=~', '!~', '>=', '<=', '&&', '||', '<<', '>>', '+=', '-=', '*=', '/=', '%=', '|=', '&=', '^=', '**')}|[\s\S]|\Z"
    pctb = rf"(?:(?<![\w)\]}}\"'])|(?<=\s)){pct}"
    here = r"<<(?P<sq>[~-]?)(?P<q>[\"'`]?)(?P<tag>[A-Z_a-z]\w*)(?P=q)(?<=[A-Z_a-z\d\"'`])(?P<rest>[^\n]*)(?P<nl>\n)(?:[^\n]*\n)*?[ \t]*(?P=tag)(?=\r?\n|\Z)"
    code = rf"(?:(?=[^\S\n]*/)(?={before}{rex})|{body})"
    lang = _Ruby("ruby", g, rf"{code}([A-Za-z_]\w*+(?![\"'?!:])|[;,(){{}}]|{pctb}|{before}{rex}|{toks})", classes, [*_RUBY_RESERVED, "__END__"])
    lang.heredoc = re.compile(rf"{code}({here}|{pctb}|{before}{rex}|{toks})")
    return lang


class _Ruby(Language):
    def _classify(self, text):
        t = text.strip(" \t") if "/" in text else text
        if t.startswith("__END__\n") or t.startswith("__END__\r"):
            return self.eof
        return super()._classify(t)

    def spellings(self, text):
        if text.startswith("\n"):
            text = text.lstrip()
        if re.search(r"<<[~-]?[\"'`]?[A-Z_a-z]", text):
            return _with_heredocs(self.heredoc, text)
        return [x if isinstance(x, str) else x[0] for x in self.pattern.findall(text)]


# -- JavaScript and TypeScript -----------------------------------------------------------------------------------------------
#: Fixed values of the language.
_JS_RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
_JS_SOFT = "let static async of get set yield await from as type using assert".split()
_TS_SOFT = "abstract accessor asserts constructor declare implements infer interface is keyof module namespace override out readonly require global satisfies unique enum".split()


class _Script(Language):
    """Substitutions inside template literals are checked as expressions of their own."""

    def valid(self, text):
        """Whether a dialect accepts the text; in scripts, also with HTML-like comments. A slash behind the head of a statement begins a regular expression."""
        text = text.removeprefix("\ufeff")
        if self.grammar.accepts(self.tokens(text)):
            return True
        heads = self._regex_behind_heads(text)
        if heads != text and self.grammar.accepts(self.tokens(heads)):
            return True
        if self.name == "javascript" and ("<!--" in text or "-->" in text):
            plain = re.sub(r"(?m)<!--|^(?:\s|/\*(?:[^*\n]|\*(?!/))*\*/)*-->", "//", heads)
            return plain != heads and self.grammar.accepts(self.tokens(plain), ["Script"])
        return False

    def _regex_behind_heads(self, text):
        """The text with a ``!`` before each slash that follows the closing parenthesis of if, while, for or with, so that it's read as a regular expression."""
        at, stack, last, behind = 0, [], "", False
        while True:
            for m in self.pattern.finditer(text, at):
                t = m[1]
                if behind and t[:1] == "/":
                    text, at, behind = text[: m.start(1)] + "!" + text[m.start(1) :], m.start(1), False
                    break
                if t == "(":
                    stack.append(last in ("if", "while", "for", "with"))
                behind = t == ")" and bool(stack) and stack.pop() or behind and t.isspace()
                last = last if t.isspace() else t
            else:
                return text

    def _classify(self, text):
        r = super()._classify(text)
        if r == self.grammar.ids["TPL"] and "${" in text:
            for m in re.finditer(_SUBST, re.sub(r"\\.", "", text)):
                if not self.grammar.accepts(self.tokens("(" + m[0][2:-1] + ")"), [self.expression]):
                    return self.bad
        return r


def _nested(depth):
    if not depth:
        return r"[^{}`]"
    deeper = _nested(depth - 1)
    return rf"(?:[^{{}}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|\{{{deeper}*\}})"


_SUBST = rf"\$\{{{_nested(3)}*\}}"
_TPL = rf"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|{_SUBST})*+`"


def _script(name, typed, jsx):
    any_ = ["ANY"] if jsx else []
    classes = {"STR": r'"(?:[^"\\\r\n]|\\[\s\S])*"|' + r"'(?:[^'\\\r\n]|\\[\s\S])*'", "NL": r"\n", "TPL": _TPL, "REGEX": r"/[\s\S]+/\w*", "NUM": r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?", "PRIVATE": r"#(?:[^\W\d]|\$)[\w$]*", "MODIFIER": ["public", "private", "protected"] if typed else [],
        "NAME": r"(?:[^\W\d]|\$)[\w$]*", "INCDEC": ["++", "--"], "ASSIGN": "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split(), "PREFIX": "! ~ typeof void delete".split(), "BINOP": "/ % ** ^ <= >= == != === !== && || ?? <<".split()}
    text = grammars.script(typed, jsx) + "Expression = '(' Expr ')' EOF ;"
    start = {"module": "Module"} if typed else {"module": "Module", "script": "Script"}
    g = Newlines(text, start, classes | {"ASI": None} | dict.fromkeys(any_), mode="asi", forced=("INCDEC",), soft=[*_JS_SOFT, *(_TS_SOFT if typed else ["constructor", "get"])])
    g.classes["NAME"].add(g.ids["MODIFIER"])
    g.classes["WORD"] |= {g.ids["MODIFIER"], g.ids["PREFIX"]}
    if jsx:
        g.classes["ANY"] = {i for n, i in g.ids.items() if n not in {"<", "{", "}", "(", ")", "[", "]", "EOF", "ANY"}}
    g._compile()
    g.memo_clear()
    g.forced = {g.ids["INCDEC"]}
    before = r"(?:\A|(?<=[=(,\[!|&{;?:+\-*%<>~^\n}])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=\bin)|(?<=\bof)|(?<=\bdelete)|(?<=\bvoid)|(?<=\bthrow)|(?<=\bnew)|(?<=\belse)|(?<=\bdo))(?:\s|/\*[^*]*\*/)*"
    rex = r"/(?![*/])(?:[^/\\\r\n\[]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*+\])++/\w*"
    nl = r"(?<![;{,(\[])\n\s*+"
    space = r"(?:[^\S\n]+|(?<=[;{,(\[])\n\s*+|//[^\n]*|/\*[^*\n]*+(?:\*(?!/)[^*\n]*+)*+\*/|\A\#![^\n]*)*+"
    pattern = rf"(?:(?=\s*+/)(?={before}{rex})|{space})({_FAST}|{before}{rex}|{nl}|{_BLOCK}|{_TPL}|{_DQ}|{_SQ}|\.?\d(?:(?<=[eE])[+-](?=\d)|[\w.])*|[\#]?(?:[^\W\d]|\$)[\w$]*|{_ops('...', '=>', '?.', '===', '!==', '**=', '<<=', '>>=', '>>>=', '&&=', '||=', '??=', '++', '--', '**', '<<', '<=', '>=', '==', '!=', '&&', '||', '??', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=')}|[\s\S]|\Z)"
    if not jsx:
        pattern = pattern.replace(r"\?\.", r"\?\.(?!\d)")
    lang = _Script(name, g, pattern, classes | {"NL": r"\n\s*|/\*[\s\S]*\n[\s\S]*\*/"}, [*_JS_RESERVED])
    lang.expression = "Expression"
    base = lang._classify

    def classify(t):
        if t[:1] in "\n \t" and "/" in t and not t.startswith("/*"):
            t = t.strip()
        if t in ("typeof", "void", "delete"):
            return g.ids["void"] if t == "void" and "void" in g.ids else g.ids["typeof"] if t == "typeof" and "typeof" in g.ids else g.ids["PREFIX"]
        if t.startswith("/*"):
            return g.ids["NL"] if t.endswith("*/") and "\n" in t else g.ids["BAD"]
        return base(t)

    lang.table = _Table(classify)
    return lang


@cache
def javascript(jsx=False):
    return _script("javascript", False, jsx)


@cache
def typescript(jsx=False):
    return _script("typescript", True, jsx)


def of(language: str | None, path: str | None = None) -> list[Language]:
    """The dialects of a language, most usual first; [] if it isn't supported."""
    name = (language or "").lower()
    ext = (path or "").rsplit(".", 1)[-1].lower()
    if name in ("javascript", "typescript"):
        make = javascript if name == "javascript" else typescript
        return [make(), make(True)] if ext in ("jsx", "tsx") else [make()]
    return [LANGUAGES[name]()] if name in LANGUAGES else []


LANGUAGES = {"python": python, "c": c, "java": java, "go": go, "php": php, "ruby": ruby, "javascript": javascript, "typescript": typescript}
