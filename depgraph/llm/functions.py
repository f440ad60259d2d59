"""Problem 2: functions paired with their documentation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm import lexers
from depgraph.sources.shared import kept

#: A description that at least one of so many documented functions of the corpus has, and at least so many of them, is a template.
TEMPLATE_SHARE, TEMPLATE_LEAST = 190, 10
#: Words of prose, besides the function's name, that a description must have.
MIN_WORDS = 5


@dataclass
class Function:
    """A function found in a source: its names, 1-based lines, comment above and string in the body, and whether it's free of errors."""

    name: str
    owner: str | None
    line: int
    end_line: int
    start: int
    end: int
    comment: str
    docstring: str
    valid: bool


_LINE_COMMENT = {"python": "#", "ruby": "#", "php": r"//|\#(?!\[)"}


@lru_cache(None)
def _comments(name):
    line = _LINE_COMMENT.get(name, "//")
    block = "" if name == "python" else r"|^=begin\b[\s\S]*?^=end\b[^\n]*" if name == "ruby" else r"|/\*[\s\S]*?\*/"
    return re.compile(rf"(?m)(?:{line})[^\n]*{block}")


def _above(language: str, gap: str, whole: bool) -> str:
    """The comment that ends directly above what follows the gap (blanks and comments between two tokens)."""
    block, last = [], 0
    for m in _comments(language).finditer(gap):
        between = gap[last : m.start()]
        if between.strip() or between.count("\n") > 1:
            block = []
        if "\n" in gap[: m.start()] or whole and not gap[: m.start()].strip():
            block.append(m[0])
        last = m.end()
    rest = gap[last:]
    return "" if rest.strip() or rest.count("\n") > 1 else "\n".join(block)


def find_functions(language: lexers.Language, text: str) -> list[Function]:
    """Every function and method with a recognisable head, also in files with errors.

    The grammar runs over the file; where the last descriptor dies, the rest of the line is skipped and
    parsing goes on from the island grammar (declarations, members and statements in any order), with
    whatever brackets were open forgotten.
    """
    g, toks = language.grammar, language.placed(text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text)
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(lines, at)
    ids = g.ids
    n_open, n_bracket = g.n_open, g.n_bracket
    python, ruby = language.name == "python", language.name == "ruby"
    by_line = language.name in ("python", "ruby", "javascript", "typescript")
    ends = {ids[x] for x in (";", "{", "}", "INLINE") if x in ids}
    blank = {ids[x] for x in ("NL", "NEWLINE", "INDENT", "DEDENT") if x in ids}
    call = {ids[x] for x in ("(", "<", "?") if x in ids}
    indent, dedent = ids.get("INDENT"), ids.get("DEDENT")

    d = g.begin()
    stack, errors, found, owners = [], [], [], []
    pending: dict[int, int] = {}
    open_bodies: list[tuple[int, int]] = []
    i, n, island = 0, len(toks), False

    def add(at):
        found.append([at, owners[-1][1] if owners else None, None])
        return len(found) - 1

    while i < n:
        t, s, e = toks[i]
        depth = len(stack)
        if island and (n_open <= t < n_bracket and not stack or t == indent and not stack):
            i += 1
            continue
        nd = d[t]
        if n_open <= t < n_bracket:
            nd = stack.pop().join(nd) if stack and nd.kernel else g.dead
        if not nd.kernel:
            errors.append(i)
            here = line(s)
            i += 1
            while i < n and line(toks[i][1]) <= here:
                i += 1
            d, stack, island, pending = g.begin([language.frag]), [], True, {}
            continue
        mark = nd.mark
        if mark:
            if mark == "m":
                if i + 1 < n and toks[i + 1][0] in call:
                    pending[depth] = i
            elif mark == "d":
                k = add(i)
                if not (python or ruby):
                    pending[depth] = -k - 1
                elif python:
                    open_bodies.append((depth, k))
            elif mark == "b":
                k = pending.pop(depth, None)
                if k is not None:
                    open_bodies.append((depth, add(k) if k >= 0 else -k - 1))
            elif mark == "c":
                while owners and owners[-1][0] >= depth:
                    owners.pop()
                owners.append((depth, text[s:e]))
        d = nd
        if t < n_open:
            stack.append(d)
            d = d.inner()
        elif t < n_bracket:
            depth -= 1
            while owners and owners[-1][0] > depth:
                owners.pop()
            if t == dedent or t == ids.get("}"):
                while open_bodies and open_bodies[-1][0] >= depth:
                    dd, k = open_bodies.pop()
                    if dd == depth:
                        found[k][2] = i
        elif t in ends:
            pending.pop(depth, None)
        i += 1
    out = []
    for at, owner, last in found:
        s, e = toks[at][1:]
        name = text[s:e]
        head = at  # the first token of the declaration
        while head and toks[head - 1][0] not in ends and (not by_line or toks[head - 1][0] not in blank) and not (by_line and line(toks[head - 1][2] - 1) < line(toks[head][1])):
            head -= 1
        while head and by_line:  # decorator lines
            k = head - 1
            while k and toks[k][0] in blank:
                k -= 1
            first = k
            while first and toks[first - 1][0] not in ends | blank and line(toks[first - 1][2] - 1) == line(toks[first][1]):
                first -= 1
            if toks[first][0] == ids.get("@") and first < head:
                head = first
            else:
                break
        k = head - 1
        while k >= 0 and (toks[k][0] in blank or toks[k][1] == toks[k][2]):
            k -= 1
        a = toks[k][2] if k >= 0 else 0
        comment = _above(language.name, text[a : toks[head][1]], k < 0)
        doc = ""
        if python:
            k, level = at + 1, 0
            while k < n and not (toks[k][0] == ids[":"] and level == 0):
                level += (toks[k][0] < n_open) - (n_open <= toks[k][0] < n_bracket)
                k += 1
                if level < 0 or toks[min(k, n - 1)][0] == dedent:
                    break
            k += 1
            while k < n and toks[k][0] in (ids["NEWLINE"], indent):
                k += 1
            if k < n and toks[k][0] == ids["STR"] and text[toks[k][1]].lower() not in "fb":
                doc = text[toks[k][1] : toks[k][2]]
        if ruby:
            m = re.compile(rf"(?m)^[ \t]{{{s - lines[line(s) - 1] - 4 if s - lines[line(s) - 1] >= 4 else 0}}}end\b").search(text, e)
            stop = m.end() if m else e
        else:
            stop = toks[last][2] if last is not None else e
        bad = any(at <= x and toks[x][1] <= stop for x in errors)
        out.append(Function(name, owner, line(s), line(max(s, stop - 1)), toks[head][1], stop, comment, doc, not bad and (last is not None or ruby)))
    return out


# -- what a comment says ---------------------------------------------------------------------------------------------
_TAG = re.compile(r"^(?:[@\\]\w+\b|:\w[^:]*:|\.\. \w+::|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Exceptions?)\s*:\s*$|</?(?:param|returns?|summary|exception)\b)")
_RULER = re.compile(r"^[\W_]*$")
#: Directives of tools, and notes that say only that documentation is missing.
_DIRECTIVE = re.compile(r"^(?:go:\w+|noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|isort:|fmt:\s*o|yapf:|ruff:|eslint\b|jshint\b|jslint\b|tslint:|ts-\w+|@ts-\w+|prettier-|istanbul |c8 |webpack\w+:|phpcs:|@?phpstan|psalm|@codingStandards|checkstyle:|nolint\b|nolintnextline|nosonar|clang-format|clang-tidy|rubocop:|frozen_string_literal|lint:|sourcery|coverage:|pragma\b|spellchecker|cspell|codespell|golint|lgtm|#region|#endregion|!\S+/bin|suppress|noinspection|language=|@formatter:|\$\w+\$|vim:|-\*-)", re.I)
_MISSING = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|hack)\b.*\b(?:doc\w*|descri\w*|comment\w*|stub|explain|write|fill)\b|auto-?generated (?:method|function|constructor|class)? ?stub|^\W*(?:no|missing|without|needs?|lacks?|insert|add|write|put|enter|your|place)\b.*\b(?:documentation|docs?|docstrings?|descriptions?|comments?)\b|\b(?:description|documentation|docs?|docstring|comment)\b.{0,40}\b(?:goes here|here|missing|pending|to be (?:written|added|done)|to follow|not available|unavailable|tbd|todo)\b|"
    r"^\W*(?:undocumented|not documented|to be documented|see above|same as above|inheritdoc|\{@inheritdoc\}|placeholder|lorem ipsum|work in progress|wip|n/?a)\b",
    re.I,
)
_CODE = re.compile(
    r"(?:[=(){}$\[\]]|->|::|\breturn\b).*[;{}]\s*$|^\s*[\w$.]*\s*[;{}]+\s*$|^\s*[\w.$\->:\[\]'\"]+\s*(?:[-+*/%|&^]|\?\?)?:?=(?!=)\s*\S|^\s*(?:return|const|let|var|import|from|def|func|function|class|if|elif|else|for|foreach|while|switch|case|print|echo|throw|raise|end|puts|yield|await|new|public|private|protected|static)\b.*(?:[()\[\]{};=<>$]|:\s*$|\w\.\w)|^\s*\$?[\w.:>\-$]+\s*\([^)]*\)\s*;?\s*$|^\s*(?:end|else|pass|break|continue)\s*$|^\s*<\?|^\s*#include|^\s*@\w+\("
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def clean(comment: str, docstring: str = "") -> list[str]:
    """The lines that a comment and a docstring say, without their marks."""
    out = []
    for raw in comment.split("\n") if comment else ():
        s = raw.strip()
        s = re.sub(r"^(?:/\*+|\*+/|\*+(?=\s|/|$)|//+[!<]?|#+!?|=begin\b|=end\b|<!--)", "", s)
        s = re.sub(r"\*+/\s*$|-->\s*$", "", s).strip()
        s = re.sub(r"^\*+\s", "", s)
        out.append(s.strip())
    if docstring:
        m = re.match(r"[a-zA-Z]*('''|\"\"\"|'|\")([\s\S]*)\1$", docstring)
        out += [x.strip() for x in (m[2] if m else docstring).split("\n")]
    return out


@lru_cache(20_000)
def _name_words(name: str) -> frozenset:
    parts = [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", name)]
    return frozenset([*parts, *(p + "s" for p in parts), *(p + "es" for p in parts), *(p[:-1] for p in parts if p.endswith("s")), *(p[:-1] + "ies" for p in parts if p.endswith("y")), re.sub(r"[\W_\d]", "", name).lower()])


def is_code(line: str, language: str | None = None) -> bool:
    """Whether a comment line is commented-out code: by its shape, or because the language's island grammar takes it."""
    if _CODE.search(line):
        return True
    if re.search(r"[()\[\]{}=;<>]", line) and language in lexers.LANGUAGES:
        lang = lexers.LANGUAGES[language]()
        return bool(lang.grammar.accepts(lang.tokens(("<?php " if language == "php" else "") + line), [lang.frag]))
    return False


def is_note(text: str) -> bool:
    """Whether a short text only says that documentation is missing."""
    return bool(_MISSING.search(text)) and len(_WORD.findall(text)) <= 12


def prose(lines: list[str], language: str | None = None, notes: bool = False) -> str:
    """What is left without tag lines and what continues them, directives, rulers and code; without ``notes``, nothing is left of a note that documentation is missing."""
    out, tag = [], False
    for s in lines:
        if not s:
            tag = False
            continue
        if _TAG.match(s) and not _DIRECTIVE.match(s):
            # a tag line goes on until a blank line or the next tag; summary tags carry prose
            m = re.match(r"^[@\\](?:brief|summary|desc(?:ription)?|details|note|remarks?)\b\s*(.*)", s)
            tag = not m
            if m and m[1]:
                out.append(m[1])
            continue
        if tag or _RULER.match(s) or _DIRECTIVE.match(s):
            continue
        out.append(s)
    kept = [s for s in out if not is_code(s, language)]
    text = " ".join(kept)
    return "" if not notes and is_note(text) else text


def template_hash(text: str, name: str) -> int:
    """Hash of a description whose words of the function's own name are masked; case and white space don't matter."""
    own = _name_words(name)
    masked = _WORD.sub(lambda m: "_" if m[0].lower() in own else m[0].lower(), text)
    return xxhash.xxh3_64_intdigest(" ".join(masked.split())) - (1 << 63)


def prose_words(text: str, name: str) -> int:
    """Words of the prose that the function's name doesn't hold (an added s aside); in scripts without blanks, characters."""
    own = _name_words(name)
    n = 0
    for w in _WORD.findall(text):
        cjk = len(_CJK.findall(w))
        if cjk:
            n += cjk
        elif w.lower() not in own and not (len(p := re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", w)) > 1 and all(x.lower() in own for x in p)):
            n += 1
    return n


# -- over tables ----------------------------------------------------------------------------------------------------------
def _extract(with_code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, path, language, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not text:
                    continue
                for dialect in lexers.of(language, path)[:1]:
                    unix = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
                    for f in find_functions(dialect, unix):
                        said = prose(clean(f.comment, f.docstring), dialect.name, notes=True) if f.comment or f.docstring else ""
                        words = prose_words(said, f.name) if said else 0
                        code = unix[f.start : f.end] if with_code and words >= MIN_WORDS else None
                        rows.append((repo, path, dialect.name, f.name, f.owner, f.line, f.end_line, said, words, bool(said) and is_note(said), template_hash(said, f.name) if said else None, f.valid, code))
            cols = list(zip(*rows)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])

    return run


_FIELDS = [("repo_id", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("description", pa.string()), ("n_words", pa.int32()), ("note", pa.bool_()), ("doc_hash", pa.int64()), ("valid", pa.bool_()), ("code", pa.string())]


def functions(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Every function of every source file with what its documentation says.

    Columns: repo_id, file_path, language, name, owner (enclosing class, null if none), line, end_line,
    description (prose only, "" if there is none), n_words (of it, without the function's own name), note (it
    only says that documentation is missing), doc_hash (of it, the function's own name masked), valid (false:
    the function itself holds an error), code (null unless asked for and described in MIN_WORDS words). Null,
    empty and unsupported files give nothing; a file delivered twice gives its functions twice. Extra columns
    are ignored.
    """
    schema = "repo_id string, file_path string, language string, name string, owner string, line int, end_line int, description string, n_words int, note boolean, doc_hash bigint, valid boolean, code string"
    return files.select("repo_id", "file_path", "language", "content").mapInArrow(_extract(with_code), schema)


def templates(found: DataFrame, share: int = TEMPLATE_SHARE, least: int = TEMPLATE_LEAST) -> DataFrame:
    """Hashes (column doc_hash) of the descriptions that recur over the corpus as fill-in text.

    Descriptions are counted by hash over all functions, and the counts alone decide: one is a template if at
    least one of ``share`` documented functions has it, and at least ``least`` of them. So at most ``share``
    rows come out, whatever the size of the corpus.
    """
    counts = found.where("doc_hash IS NOT NULL").groupBy("doc_hash").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where((F.col("n") * share >= F.col("total")) & (F.col("n") >= least)).select("doc_hash")


def document_nodes(nodes: DataFrame, files: DataFrame, with_code: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """Nodes of type function joined with their source and its documentation; only documented ones.

    Columns: id, repo_id, file_path, language, name, line, description, n_words, valid, code. Of repeated node
    rows the latest updated_at counts. A node belongs to the function of its file with its name (the last part
    after ``::``) whose head is nearest to line_start; without line_start, to one in the class that its id
    names, else the first. Descriptions with fewer than min_words words of prose, templates, and the rarer notes that
    documentation is missing are dropped.
    """
    last = F.max_by(F.struct("repo_id", "file_path", "name", "line_start"), F.struct("updated_at", "line_start"))
    wanted = nodes.where("id IS NOT NULL AND lower(type) = 'function'").groupBy("id").agg(last.alias("r")).select("id", "r.repo_id", "r.file_path", F.element_at(F.split("r.name", "::"), -1).alias("name"), F.element_at(F.split("id", "::"), -2).alias("owner_name"), "r.line_start")
    found = kept(functions(files, with_code), "functions")  # parsed once, read for the counts and for the pairs
    bad = templates(found)
    f = found.select("repo_id", "file_path", "name", F.struct("owner", "line", "end_line", "description", "n_words", "note", "doc_hash", "valid", "language", "code").alias("f"))
    pairs = wanted.join(f, ["repo_id", "file_path", "name"])
    off = F.when(F.col("line_start").isNull(), F.when(F.col("f.owner") == F.col("owner_name"), 0).when(F.col("f.owner").isNull(), 1).otherwise(2)).otherwise(F.abs(F.col("f.line") - F.col("line_start")))
    best = pairs.groupBy("id", "repo_id", "file_path", "name").agg(F.min_by("f", F.struct(off, "f.line", -F.col("f.n_words"))).alias("f"))
    said = best.where((F.col("f.n_words") >= min_words) & ~F.col("f.note")).withColumn("doc_hash", F.col("f.doc_hash")).join(F.broadcast(bad), "doc_hash", "left_anti")
    return said.select("id", "repo_id", "file_path", "f.language", "name", "f.line", "f.description", "f.n_words", "f.valid", "f.code")
