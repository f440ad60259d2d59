"""Extraction: nodes and raw edges from source texts of thirteen languages.

Python is read by its own parser (files that it rejects give an error and no rows); the other languages by a
scanner that blanks out comments and strings, pairs brackets and finds declarations by one table of patterns
per language. Its time grows in proportion to the file. All of it runs in one Arrow pass over the files.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class LanguageSpec:
    """How declarations look: patterns with the groups ``name`` (and ``bases``, ``owner``), and imports as (pattern, relation, rule)."""

    classes: str
    functions: str
    imports: list[tuple[str, str, Callable[[str], str]]] = field(default_factory=list)
    line_comment: str = "//"
    block_comment: bool = True
    ends: bool = False  # bodies end with the word end
    keywords: frozenset = frozenset("if for while switch catch return sizeof function new else do match with foreach elseif until unless when typeof await yield throw case in of and or not fn func def class super this self".split())


def _last(sep: str) -> Callable[[str], str]:
    return lambda s: s.strip().strip("'\"").rstrip(sep).split(sep)[-1].strip("*{} ")


_ID = r"[^\W\d]\w*"
_HEAD = rf"(?:[\w<>\[\],.?*&:\s]|@\w+)*?"
_C_IMPORT = [(r"^[ \t]*\#[ \t]*include[ \t]*[<\"]([^>\"\n]+)", "imports", lambda s: s.split("/")[-1].split(".")[0])]
_JS = LanguageSpec(
    rf"\bclass[ \t]+(?P<name>{_ID})(?:[ \t]+extends[ \t]+(?P<bases>[\w.]+))?[^{{;]*\{{",
    rf"\bfunction[ \t]*\*?[ \t]*(?P<name>{_ID})[ \t]*(?:<[^>(]*>)?[ \t]*\(|(?:^|(?<=[{{;}}]))[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)[ \t]+|\*[ \t]*)*(?P<method>{_ID})[ \t]*(?:<[^>(]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{}};=]+)?\{{)",
    [(r"^[ \t]*(?:import|export)\b[^;\n]*?from[ \t]*(['\"][^'\"\n]+['\"])", "imports_from", _last("/")), (r"^[ \t]*import[ \t]*(['\"][^'\"\n]+['\"])", "imports_from", _last("/"))],
)
_C = LanguageSpec(r"\b(?:struct|union|enum|class)[ \t]+(?P<name>[^\W\d]\w*)(?:[ \t]*:[^{;]*)?\s*\{", rf"^(?:[\w*&:<>,~\[\]]+[ \t\n*&]+)+(?P<owner>{_ID}::)?(?P<name>~?{_ID})[ \t]*\((?=[^;{{}}]*\)[^;{{}}()]*\{{)", _C_IMPORT)
#: Fixed values of the language: modifiers of members, and words that begin a statement rather than a type.
_CS_MODIFIERS = "public|protected|private|internal|static|virtual|override|abstract|async|sealed|extern|unsafe|partial|readonly|new"
_CS_NO_TYPE = "return|else|throw|await|using|namespace|class|interface|struct|enum|record|delegate|event|operator|implicit|explicit|if|while|for|foreach|switch|case|lock|do|in|out|ref|is|as|yield|goto|var"
_JAVA_NO_TYPE = "return|else|throw|new|assert|case|record|enum|class|interface|import|package|yield|do"
SPECS: dict[str, LanguageSpec] = {
    "javascript": _JS,
    "typescript": _JS,
    "go": LanguageSpec(rf"^[ \t]*type[ \t]+(?P<name>{_ID})[ \t]+(?:struct|interface)\b[^{{\n]*\{{", rf"^func[ \t]+(?:\([^)]*?\*?(?P<owner>{_ID})(?:\[[^\]]*\])?\)[ \t]*)?(?P<name>{_ID})[ \t]*[(\[]"),
    "java": LanguageSpec(rf"(?<!@)\b(?:class|interface)[ \t]+(?P<name>{_ID})[^{{;()]*(?:\([^)]*\))?[^{{;]*\{{", rf"(?:^|(?<=[{{;}}]))[ \t]*(?:@[\w.]+(?:\([^()]*\))?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>(]+>[ \t]*)?(?:(?!(?:{_JAVA_NO_TYPE})\b){_ID}[\w.<>\[\],? ]*[ \t]+(?P<name>{_ID})[ \t]*\((?=[^;{{}}]*\)\s*(?:throws[^{{;]*)?[{{;])|(?P<method>{_ID})[ \t]*\((?=[^;{{}}]*\)\s*(?:throws[^{{;]*)?\{{))", [(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)", "imports", lambda s: s.rstrip(".*").split(".")[-1])]),
    "rust": LanguageSpec(rf"\b(?:struct|trait)[ \t]+(?P<name>{_ID})[^{{;(]*\{{|\bimpl\b(?:<[^>]*>)?[ \t]+(?:[\w:<>]+[ \t]+for[ \t]+)?(?P<impl>{_ID})[^{{;]*\{{", rf"\bfn[ \t]+(?P<name>{_ID})[ \t]*[(<]"),
    "php": LanguageSpec(rf"\bclass[ \t]+(?P<name>{_ID})(?:[ \t]+extends[ \t]+(?P<bases>[\w\\, ]+?))?(?:[ \t]+implements[ \t]+(?P<ifaces>[\w\\, ]+?))?\s*\{{", rf"\bfunction[ \t]*&?[ \t]*(?P<name>{_ID})[ \t]*\(", [(r"^[ \t]*use[ \t]+(?!function\b|const\b)([\w\\]+)", "imports", _last("\\"))]),
    "csharp": LanguageSpec(rf"\b(?:class|interface)[ \t]+(?P<name>{_ID})[^{{;]*\{{", rf"(?:^|(?<=[{{;}}\]]))[ \t]*(?:(?:{_CS_MODIFIERS})[ \t]+)*(?!(?:{_CS_MODIFIERS}|{_CS_NO_TYPE})\b){_ID}(?:[\w.?]|<[^;(){{}}]*?>|\[[\s,]*\])*[ \t]+(?P<name>{_ID})[ \t]*(?:<[^>(]*>)?\((?=[^;{{}}]*\)[^;{{}}=]*(?:\{{|=>|;))", [(r"^[ \t]*using[ \t]+([\w.]+)[ \t]*;", "imports", _last("."))]),
    "kotlin": LanguageSpec(rf"\b(?:class|interface|object)[ \t]+(?P<name>{_ID})[^{{\n]*\{{", rf"\bfun[ \t]+(?:<[^>]*>[ \t]*)?(?:{_ID}\.)?(?P<name>{_ID})[ \t]*\(", [(r"^[ \t]*import[ \t]+([\w.]+)", "imports", _last("."))]),
    "scala": LanguageSpec(rf"\b(?:class|object)[ \t]+(?P<name>{_ID})[^{{\n]*\{{", rf"\bdef[ \t]+(?P<name>{_ID})", [(r"^[ \t]*import[ \t]+([\w.{{}}, ]+)", "imports", _last("."))]),
    "ruby": LanguageSpec(rf"^[ \t]*class[ \t]+(?P<name>{_ID})(?:[ \t]*<[ \t]*(?P<bases>[\w:]+))?", rf"^[ \t]*def[ \t]+(?:self\.)?(?P<name>{_ID}[?!]?)", [], "#", False, True),
    "c": LanguageSpec(_C.classes.replace("|class)", ")"), _C.functions, _C.imports),
    "cpp": LanguageSpec(_C.classes.replace("|enum|", "|").replace(r"\b(?:", r"(?<!enum)(?<!enum )\b(?:"), _C.functions, _C.imports),
}
_STRINGS = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"


def _mask_pattern(language: str) -> re.Pattern:
    spec = SPECS.get(language)
    line = "#" if language == "python" else spec.line_comment
    parts = [r"<<<['\"]?(?P<tag>\w+)['\"]?\n[\s\S]*?\n[ \t]*(?P=tag)\b"] if language == "php" else [r"<<[~-]?['\"]?(?P<tag>[A-Z]\w*)['\"]?[^\n]*\n[\s\S]*?\n[ \t]*(?P=tag)\b"] if language == "ruby" else []
    parts += [r"/\*[\s\S]*?\*/"] if spec.block_comment else [r"^=begin\b[\s\S]*?^=end\b"]
    parts += [rf"{re.escape(line)}[^\n]*"] + ([r"\#(?!\[)[^\n]*"] if language == "php" else [])
    parts += [r"\"\"\"[\s\S]*?\"\"\""] if language in ("java", "kotlin", "scala") else [r"`(?:[^`\\]|\\[\s\S])*`"] if language in ("javascript", "typescript", "go") else []
    parts += [r"(?<=[=(,:])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[[^\]\n]*\])+/"] if language in ("javascript", "typescript", "ruby") else []
    return re.compile("(?m)" + "|".join([*parts, _STRINGS]))


_MASKS: dict[str, re.Pattern] = {}


def _mask(language: str, text: str) -> str:
    """The text with comments and strings blanked out, at the same positions."""
    p = _MASKS.setdefault(language, _mask_pattern(language))
    return p.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _pairs(masked: str) -> dict[int, int]:
    """Position of each opening brace and that of its partner (the end of the text if it has none)."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | {a: len(masked) for a in stack}


def _comment_above(lines: list[str], n: int) -> tuple[str | None, list[str]]:
    """The cleaned comment that ends directly above line n (from 0), and the annotations and attributes between the two, in order."""
    marks: list[str] = []
    i = n - 1
    while i >= 0 and (m := re.match(r"\s*(?:@(?!interface\b)([\w.]+)|#?\[(?:\w+:\s*)?(\w[\w.:]*))[^\n]*$", lines[i])):
        marks.insert(0, "@" + (m[1] or m[2]))
        i -= 1
    block: list[str] = []
    if i >= 0 and re.search(r"\*/\s*$", lines[i]):
        while i >= 0:
            block.append(lines[i])
            i -= 1
            if "/*" in block[-1]:
                break
    else:
        while i >= 0 and re.match(r"\s*(?://|#(?!\[|\s*(?:include|define|if|endif|pragma)))", lines[i]):
            block.append(lines[i])
            i -= 1
    out = [re.sub(r"\*+/\s*$", "", re.sub(r"^\s*(?:/\*+|\*+(?!/)|//+[/!]?|#+)\s?", "", x)).strip() for x in reversed(block)]
    return "\n".join(out).strip() or None, marks


#: Languages in which a function's body may be an expression, and what stands before it.
_EXPRESSION_BODY = {"csharp": "=>", "kotlin": "=", "scala": "="}


def _body(language: str, masked: str, at: int, pairs: dict[int, int]) -> tuple[int, int]:
    """(begin, end) of the body of a function whose name ends at a position; an empty stretch if it has none."""
    i, n, mark = at, len(masked), _EXPRESSION_BODY.get(language)
    depth = 0
    while i < n:
        c = masked[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth < 0:
                return i, i
        elif not depth:
            if c == "{":
                return i, pairs.get(i, n)
            if c in ";}" or c == "\n" and language in ("kotlin", "scala") and not re.match(r"\s*[{:=]", masked[i:n][:200]):
                return i, i
            if mark and masked.startswith(mark, i) and (mark != "=" or masked[i + 1 : i + 2] not in ("=", ">")):
                begin = i + len(mark)
                while begin < n and masked[begin].isspace():
                    begin += 1
                if masked[begin : begin + 1] == "{":
                    return begin, pairs.get(begin, n)
                end, depth = begin, 0
                while end < n:
                    c = masked[end]
                    if c in "([{":
                        depth += 1
                    elif c in ")]}":
                        depth -= 1
                        if depth < 0:
                            break
                    elif not depth and (c == ";" or c == "\n" and mark == "="):
                        break
                    end += 1
                return begin, end
        i += 1
    return n, n


def _arrows(masked: str, begin: int, stop: int) -> list[tuple[int, int]]:
    """Stretches of arrow function bodies between two positions: a block, or an expression up to the end of its argument or statement."""
    out = []
    at = begin
    while (a := masked.find("=>", at, stop)) >= 0:
        i, depth = a + 2, 0
        while i < stop and masked[i].isspace():
            i += 1
        block = i < stop and masked[i] == "{"
        while i < stop:
            c = masked[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0 or block and not depth:
                    break
            elif c in ",;" and not depth:
                break
            i += 1
        out.append((a, i))
        at = max(i, a + 2)
    return out


class _File:
    """Collects the nodes and raw edges of one file."""

    def __init__(self, repo: str, path: str, language: str, text: str):
        self.repo, self.path, self.language = repo, path, language
        self.root = f"{repo}::{path}"
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.lines = text.split("\n")
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.seen: set[str] = set()
        self.names: dict[str, str] = {}
        self.calls: list[tuple[str, str, int]] = []
        self.node(self.root, "file", path.split("/")[-1], 1, text.count("\n") + 1)

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def node(self, id_, type_, name, first, last, doc=None, decorators=()):
        if id_ in self.seen:  # the first one stays; edges and calls of the others are kept
            return
        self.seen.add(id_)
        self.nodes.append({"id": id_, "repo_id": self.repo, "type": type_, "name": name, "file_path": self.path, "language": self.language, "line_start": first, "line_end": last, "docstring": doc, "decorators": list(decorators), "ord": len(self.nodes)})

    def edge(self, src, relation, line, tgt=None, name=None, confidence="EXTRACTED"):
        self.edges.append({"repo_id": self.repo, "file_path": self.path, "src": src, "tgt": tgt, "tgt_name": name, "relation": relation, "confidence": confidence, "line": line, "n": len(self.edges)})

    def function(self, cls, name, first, last, doc, decorators):
        id_, label = (f"{self.root}::{cls}::{name}", f"{cls}::{name}") if cls else (f"{self.root}::{name}", name)
        self.node(id_, "function", label, first, last, doc, decorators)
        self.edge(f"{self.root}::{cls}" if cls else self.root, "method" if cls else "contains", first, id_)
        return id_

    def klass(self, name, first, last, doc, decorators):
        self.node(f"{self.root}::{name}", "class", name, first, last, doc, decorators)
        self.edge(self.root, "contains", first, f"{self.root}::{name}")

    def finish(self):
        """Calls go to a node of the file with that name (its whole name before its last part), else stay open by name."""
        full = {n["name"].lower(): n["id"] for n in self.nodes}
        short: dict[str, str] = {}
        for n in self.nodes:
            short.setdefault(n["name"].split("::")[-1].lower(), n["id"])
        done = set()
        for src, name, line in self.calls:
            target = full.get(name.lower()) or short.get(name.lower())
            if target and target != src:
                if (src, target) not in done:
                    done.add((src, target))
                    self.edge(src, "calls", line, target)
            else:
                self.edge(src, "calls", line, None, name, "INFERRED")
        return self.nodes, self.edges


def _python(f: _File, text: str):
    tree = ast.parse(text)

    def names(decorated):
        return ["@" + ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in decorated]

    def calls(src, fn):
        todo = list(fn.body)
        while todo:
            n = todo.pop(0)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                todo = [*n.decorator_list, *todo]
                continue
            if isinstance(n, ast.Call):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                if name:
                    f.calls.append((src, name, n.lineno))
            todo = [*ast.iter_child_nodes(n), *todo]

    def visit(body, cls):
        for n in body:
            if isinstance(n, ast.ClassDef):
                f.klass(n.name, n.lineno, n.end_lineno, ast.get_docstring(n), names(n.decorator_list))
                for b in n.bases:
                    if isinstance(b, ast.Name):
                        f.edge(f"{f.root}::{n.name}", "inherits", n.lineno, None, b.id)
                visit(n.body, n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                calls(f.function(cls, n.name, n.lineno, n.end_lineno, ast.get_docstring(n), names(n.decorator_list)), n)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    f.edge(f.root, "imports", n.lineno, None, a.name)
            elif isinstance(n, ast.ImportFrom):
                f.edge(f.root, "imports_from", n.lineno, None, n.module or "")
            else:
                for part in ("body", "orelse", "finalbody"):
                    visit([x for x in getattr(n, part, []) if isinstance(x, ast.stmt)], cls)
                for h in getattr(n, "handlers", []):
                    visit(h.body, cls)

    visit(tree.body, None)


_DECORATED = ("javascript", "typescript", "java", "csharp")
_CALL = re.compile(rf"(?:({_ID})[ \t]*(?:::)[ \t]*)?({_ID})[ \t]*\(")


def _scan(f: _File, text: str, spec: LanguageSpec):
    masked = _mask(f.language, text)
    pairs = _pairs(masked) if not spec.ends else {}
    ruby_end = lambda at: next((m.end() for m in [re.compile(rf"(?m)^{re.escape(re.match(r'[ \t]*', masked[masked.rfind(chr(10), 0, at) + 1 :])[0])}end\b").search(masked, at)] if m), len(text))
    found = []
    for m in re.finditer("(?m)" + spec.classes, masked):
        name = m.groupdict().get("name") or m.groupdict().get("impl")
        begin = m.end() - 1 if not spec.ends else m.end()
        stop = ruby_end(m.end()) if spec.ends else pairs.get(begin, len(text))
        found.append((m.start() + len(m[0]) - len(m[0].lstrip()), "class", name, begin, stop, m))
    for m in re.finditer("(?m)" + spec.functions, masked):
        name = m.groupdict().get("name") or m.groupdict().get("method")
        if name in spec.keywords:
            continue
        if spec.ends:
            begin, stop = m.end(), ruby_end(m.end())
        else:
            begin, stop = _body(f.language, masked, m.end(m.lastgroup) if m.lastgroup in ("name", "method") else m.end() - 1, pairs)
            if begin == stop and f.language not in ("java", "csharp", "kotlin", "php", "go"):
                continue  # only a signature
        found.append((m.start() + len(m[0]) - len(m[0].lstrip()), "function", name, begin, stop, m))
    found.sort(key=lambda x: x[0])
    bodies = [(at, stop) for at, kind, _, _, stop, _ in found if kind == "function"]
    firsts = [b[0] for b in bodies]
    classes, last_function = [], -1
    for at, kind, name, begin, stop, m in found:
        if at < last_function:  # inside the body of a function: not visited
            continue
        classes = [c for c in classes if c[1] > at]
        groups = m.groupdict()
        first, last = f.line(at), f.line(max(at, min(stop, len(text)) - (1 if spec.ends or stop > at and text[stop - 1 : stop + 1].endswith("\n") else 0)))
        doc, decorators = _comment_above(f.lines, first - 1)
        decorators = decorators if f.language in _DECORATED else []
        if kind == "class":
            if not groups.get("impl"):
                f.klass(name, first, last, doc, decorators)
            for relation, part in (("inherits", groups.get("bases")), ("implements", groups.get("ifaces"))):
                for b in (part or "").split(",") if f.language == "php" else ():
                    if b.strip():
                        f.edge(f"{f.root}::{name}", relation, first, None, b.strip().split("\\")[-1])
            classes.append((name, stop))
            continue
        owner = (groups.get("owner") or "").rstrip(":") or (classes[-1][0] if classes else None)
        src = f.function(owner, name, first, last, doc, decorators)
        last_function = max(stop, at + 1)
        # calls in nested functions, and where arrow functions are functions, in those, aren't the outer one's
        holes = [b for b in bodies[bisect_right(firsts, at) :][: bisect_right(firsts, stop) - bisect_right(firsts, at)]]
        holes = sorted(holes + (_arrows(masked, begin, stop) if f.language in ("javascript", "typescript") else []))
        k, end = 0, -1
        for c in _CALL.finditer(masked, begin, stop):
            while k < len(holes) and holes[k][0] <= c.start():
                end, k = max(end, holes[k][1]), k + 1
            called = c[1] if c[1] and f.language == "php" else c[2]
            if c.start() >= end and called not in spec.keywords:
                f.calls.append((src, called, f.line(c.start())))
    for pattern, relation, rule in spec.imports:
        for m in re.finditer("(?m)" + pattern, text):
            if masked[m.start() : m.start() + 3].strip() or text[m.start() : m.start() + 1] in " \t#":
                f.edge(f.root, relation, f.line(m.start()), None, rule(m[1]))


def extract(repo: str, path: str, language: str, text: str) -> tuple[list[dict], list[dict], str | None]:
    """(nodes, raw edges, error) of one file; never raises. A file that can't be read gives no rows and its error."""
    try:
        f = _File(repo, path, language, text)
        if language == "python":
            _python(f, text)
        elif language in SPECS:
            _scan(f, text, SPECS[language])
        return *f.finish(), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], f"{type(e).__name__}: {e}"[:300]


NODE_TYPE = "struct<id:string,repo_id:string,type:string,name:string,file_path:string,language:string,line_start:int,line_end:int,docstring:string,decorators:array<string>,ord:bigint>"
EDGE_TYPE = "struct<repo_id:string,file_path:string,src:string,tgt:string,tgt_name:string,relation:string,confidence:string,line:int,n:bigint>"
_NODE_ARROW = pa.struct([("id", pa.string()), ("repo_id", pa.string()), ("type", pa.string()), ("name", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("docstring", pa.string()), ("decorators", pa.list_(pa.string())), ("ord", pa.int64())])
_EDGE_ARROW = pa.struct([("repo_id", pa.string()), ("file_path", pa.string()), ("src", pa.string()), ("tgt", pa.string()), ("tgt_name", pa.string()), ("relation", pa.string()), ("confidence", pa.string()), ("line", pa.int32()), ("n", pa.int64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [extract(*r) if r[3] is not None else ([], [], "no content") for r in zip(*(b.column(i).to_pylist() for i in range(4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(_NODE_ARROW)), pa.array([r[1] for r in rows], pa.list_(_EDGE_ARROW)), pa.array([r[2] for r in rows], pa.string())], ["repo_id", "file_path", "nodes", "edges", "error"])


def extract_files(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, nodes, edges, error) per file; input columns repo_id, file_path, language, content."""
    return files.select("repo_id", "file_path", F.lower("language").alias("language"), "content").mapInArrow(_batches, f"repo_id string, file_path string, nodes array<{NODE_TYPE}>, edges array<{EDGE_TYPE}>, error string")


def extracted_nodes(extracted: DataFrame) -> DataFrame:
    """One row per node; ord orders the nodes of a repository by file and place in it."""
    n = extracted.select(F.explode("nodes").alias("n")).select("n.*")
    return n.withColumn("ord", F.struct("file_path", "ord")).withColumn("metadata", F.struct("decorators")).drop("decorators")


def extracted_edges(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.explode("edges").alias("e")).select("e.*").withColumn("seq", F.struct("file_path", "n")).drop("n")
