"""Problems 1, 2 and 5."""

import ast
import glob
import sysconfig
import warnings
from datetime import datetime

import pytest

from depgraph.llm import functions as fn
from depgraph.llm import lexers, origin, syntax
from depgraph.llm.gll import Grammar

VALID = {
    "python": ["", "x = 1", "def f(a, /, *b, c=1, **d) -> int:\n\treturn a if b else (yield)\n", "match x:\n    case [1, *_] | {'a': b} if b: pass\n", "async def f():\n  async with a as b, c: await d\n", "f'{x!r:>{w}}'\n", "class A[T](B, k=1): x: int = 3\n", "try:\n a\nexcept* E as e:\n b\nfinally:\n c", "x = [a for b in c if d if e]\nprint(*a, **b)\nlambda *a, b=1: (a, b)\n@d\ndef g(): ...\n", "if x:\n\tpass\n# end\n  # odd\nelse:\n\tpass"],
    "javascript": ["", "a\n++b\n", "const f = async (a, {b, c: [d]} = {}, ...e) => { for await (const x of y) z?.[1]?.(2) }", "let r = /[/]\"/g, t = `a${`b${c}`}d`\nvar {x = 1, ...y} = z", "class A extends B { #p = 1; static { } get x() { return this.#p } async *[k]() {} 'q'() {} }", "export default class {}\nimport a, {b as c} from 'd'\n", "x = a ? b : c => d, e\nif (a) b = /b/.test(c)\nl: for (;;) continue l", "({a, b: 1, c() {}, get d() { return 1 }, ...e})"],
    "typescript": ["interface A<T extends B = C> extends D { readonly a?: string; [k: string]: any; (x: number): void; m<T>(): T }", "type U = A | B & { [K in keyof T]?: T[K] } extends infer X ? X[] : never\n", "abstract class A<T> implements B { private readonly x!: number; constructor(public a: string, b?: number) { super() } abstract m(): void; get y(): T { return <T>this.z! as unknown as T } }", "declare module 'x' { export const a: number }\nenum E { A = 1, B }\nfunction f(this: A, x): x is string\nfunction f(x: any) { return f<number>(x) }", "let v = (a: number, ...b: string[]): Promise<Map<string, Array<number>>> => g(a)!.h"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `x`\n\t*E\n}\n\nfunc (t *T[K, V]) F(a int, b ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && (P{1}) == q {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i := range xs {\n\t\tswitch y := z.(type) {\n\t\tcase int, *T:\n\t\tdefault:\n\t\t}\n\t}\n\treturn []int{1, 2: 3}[0], nil\n}\n"],
    "java": ["", "package a.b;\nimport static x.Y.*;\n@A(x = {1, 2}) public final class C<T extends D & E> extends F<G<H>> implements I { int[] a = {1, 2}, b; C() throws X { this(1); } <R> R m(final int x, String... y) { for (var z : y) { z.q(); } return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; } enum K { A(1) { }, B; } record L(int x) { L { } } }", "class A { Runnable r = () -> { int x = a > b ? c >>> 2 : d[1]; x++; new B<>() { void f() {} }.g(H::i); if (o instanceof P(int y, var z) && y > 1) throw (E) e; try (var s = t()) { } catch (F | G h) { } } ; String s = \"\"\"\n  a \"q\" \n  \"\"\"; }"],
    "php": ["", "text <b>only</b>", "<?php namespace A; use B\\{C, D as E}; abstract class F extends G implements H { use I; public function __construct(private readonly ?int $x = null, A|B $y) {} const A = 1; public static function f(): static { return new static(...$a); } }\n$f = fn($x) => $x?->y::Z[1] ?? [...$a, 'k' => &$b];\nif ($a): ?><p><?php elseif ($b): echo 1; else: endif; foreach ($a as $k => [$b, $c]) {}\n$h = <<<\"X\"\n it's { (\n X;\necho match(true) { 1, 2 => 'a', default => throw new E() };", "<?= $a ?> b <?php function &g(array $a = [], int ...$b) { static $c = 1; yield $a => $b; }"],
    "c": ["", "#include <a.h>\n#define X(a) \\\n a {\ntypedef struct s { int a : 3; union { char b[2]; } u; } s_t, *p_t;\nstatic const char *const t[] = { [0] = \"a\" \"b\", };\nint (*fp(int, ...))(void);\nint main(int argc, char **argv) { size_t n = sizeof(struct s) * (unsigned long)argc; for (int i = 0; i < n; i++) { if (!a->b.c[i]) goto end; } do x--; while (x); switch (y) { case 1: default: break; } end: return (s_t){ .a = 1 }.a ? 1 : 0; }", "#if A\nint f(void) {\n#else\nint g(void) {\n#endif\n return 1; }"],
    "ruby": ["", "class A < B::C\n  attr_reader :a, :b\n  def self.f(a, b = 1, *c, d:, e: 2, **g, &h)\n    return if a.nil? && !b\n    @x ||= c.map { |y, (z, w)| y + z }.select(&:ok?)\n  rescue E => e\n    puts \"a#{b[\"c\"]}\", e\n  ensure\n    yield a unless b\n  end\nend\n", "x = <<~T + y\n  it's {\nT\nfoo.bar 1, :a => 2 do |k|\n  case k\n  when 1, 2 then 3\n  else nil\n  end\nend\nz = a ? b : c\nputs %w[a b].map do |q| q =~ /r\\/[\"']/ end\n", "module M\n  X = { a: 1, 'b' => 2, \"c\": 3 }.freeze\n  def y = 1\n  while x do break end\n  v = if a then 1 else 2 end\n  a.b&.c\n    .d\nend", "def f(a)\n  a -1\n  [1, 2,\n   3].each do |x| p x end\nend\n=begin\nclass {\n=end\n"],
}
INVALID = {
    "python": ["def f(:\n pass", "if x:\npass", "print 'a'", "x = = 1", "<<<<<<< HEAD\n", "a +", "f() = 1", "\tx\n", "if a:\n  b\n c\n", "'abc", "x = 012", "(]", "class A\n  pass"],
    "javascript": ["{ \"a\": 1 }", "function f( {", "const x;", "a b", "if (a { }", "let s = 'x\n'", "f(1,,2)", "1 = x", "function f(a: number) {}", "}", "`${", "class A { x y }"],
    "typescript": ["let x: = 1", "interface A { a: }", "{ \"a\": 1 }", "type = ", "function f(a: number { }"],
    "go": ["", "package a\nfunc f() { x := }\n", "package a\nfunc f() {\n", "{}", "package a\nfunc f( {}\n", "package a\nfunc f() { '{{' }\n"],
    "java": ["class A {", "class A { int x }", "class A { void f() { a + b; } }", "class A { void f() { return 1 } }", "package a", "class A { void f( { } }", "{ \"a\": 1 }"],
    "php": ["<?php $a = ;", "<?php function f( { }", "<?php if ($a) {", "<?php $a = 'x", "<?php class A { function }", "<?php foreach ($a) {}", "<?php echo 1 echo 2;"],
    "c": ["int f( {", "int x", "int f(void) { return 1 }", "package main;\nimport x", "}", "int a[] = { 1, 2;", "#if A\nint x;\n", "char *s = \"a;"],
    "ruby": ["def f(", "class A\n def f\n end", "end", "x = [1, 2", "if a\n", "def f\n <<<<<<< HEAD\nend", "foo(1, ", "import re\nfrom a import b", "a = }"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_accepts(language, text):
    assert syntax.is_valid(text, language)
    assert syntax.is_valid(text.replace("\n", "\r\n"), language.upper())


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in INVALID.items() for t in v])
def test_rejects(language, text):
    assert syntax.is_valid(text, language) is False


def test_agrees_with_the_language_itself():
    warnings.simplefilter("ignore")
    language, wrong, n = lexers.python(), [], 0
    for path in sorted(glob.glob(sysconfig.get_path("stdlib") + "/*.py"))[:150]:
        text = open(path, encoding="utf-8").read()
        for t in (text, text[: len(text) * 2 // 3], text.replace(":\n", "\n", 1)):
            try:
                ast.parse(t)
                want = True
            except (SyntaxError, ValueError):
                want = False
            n += 1
            wrong += [path] if language.valid(t) is not want else []
    assert len(wrong) <= 0.01 * n, wrong


def test_grammars_may_be_ambiguous_and_left_recursive():
    g = Grammar("S = S 'a' | 'a' | S S 'b' ; T = S EOF ;", {"x": "T"}, [], pairs=())
    ok = lambda s: g.accepts([g.ids[c] for c in s])
    assert [ok(x) for x in ("a", "aaa", "aab", "b", "ab", "aaab", "aba")] == [True, True, True, False, False, True, False]
    nested = Grammar("S = '(' [ S ] ')' [ S ] ; T = S EOF ;", {"x": "T"}, [], pairs=(("(", ")"),))
    deep = [nested.ids["("]] * 50_000 + [nested.ids[")"]] * 50_000
    assert nested.accepts(deep) and not nested.accepts(deep[:-1]) and len(nested.configs) < 50


def test_long_files_and_memo_limit():
    assert syntax.is_valid("x = [" + "1, " * 300_000 + "]\n", "python")
    assert syntax.is_valid("(" * 20_000 + "1" + ")" * 20_000, "javascript")
    assert not syntax.is_valid("/*" + "a" * 1_000_000, "c")


FILE = "file_id bigint, repo_id string, file_path string, language string, modification_time timestamp, n_bytes bigint, content string, valid string, salt string"
T = datetime(2026, 1, 1)


def test_syntax_over_tables(spark):
    rows = [(1, "r", "a.py", "Python", T, 1, "x =", "", ""), (1, "r", "a.py", "Python", T, 1, "x =", "", ""), (2, "r", "b.py", "python", None, 1, None, "", ""), (3, None, None, None, None, None, "x", "", ""), (4, "r", "c.go", "GO", T, 0, "", "", ""), (None, "r", "d.py", "python", T, 1, "(", "", ""), (5, "q", "e.js", "javascript", T, 1, "", "", ""), (6, "q", "f.zz", "cobol", T, 1, "x", "", "")]
    v = syntax.check_syntax(spark.createDataFrame(rows, FILE))
    assert {r["file_id"]: r["valid"] for r in v.collect()} == {1: False, 2: None, 3: None, 4: False, 5: True, 6: None}
    rates = {(r["repo_id"], r["language"]): (r["n_files"], r["n_unread"], r["n_invalid"], r["invalid_rate"]) for r in syntax.invalid_rates(v, "repo_id", "language").collect()}
    assert rates["r", "python"] == (2, 1, 1, 1.0) and rates["q", "cobol"] == (1, 1, 0, None)
    assert syntax.check_syntax(spark.createDataFrame([], FILE)).collect() == []


@pytest.mark.parametrize(
    "language, text, valid",
    [
        ("javascript", "if (a) /x/.test(b)", True), ("javascript", "if (a) /x/.test(b); while (c)\n /[)]/g.exec(d)\nfoo();", True), ("javascript", "x = f(a) / b / c;", True), ("javascript", "if (a) /x", False),
        ("javascript", "<!-- x\nvar a = 1;\n--> y\nvar b;", True), ("javascript", "<!-- x\nimport a from 'b';", False), ("javascript", "var s = '<!--';\nvar t = ;", False), ("typescript", "if (a) /x/.test(b)", True),
        ("c", "class A { public: int x; };", False), ("c", "namespace a { int x; }", False), ("c", "int x { }", False), ("c", "TEST(foo) { int a; }", True), ("c", "int (*g(int a))(int) { return 0; }", True), ("c", "static int *(f(int a)) { return 0; }", True),
    ],
)
def test_heads_comments_and_declarators(language, text, valid):
    assert syntax.is_valid(text, language) is valid


DOCUMENTED = {
    "python": ("# Adds two small numbers and returns their sum.\n@cached(1)\ndef add(a, b):\n    return a + b\n\nclass A:\n    def other(self):\n        '''Walks over every open ticket of the queue.'''\n        return 1\n\n    # todo\n    def bare(self): pass\n", {"add", "other"}),
    "javascript": ("/**\n * Adds two small numbers and returns their sum.\n * @param a the first of the two given numbers\n */\nexport function add(a, b) { return a + b }\nclass A {\n  /** @inheritdoc */\n  bare() {}\n  // Walks over every open ticket of the queue.\n  other() {}\n}\n", {"add", "other"}),
    "java": ("class A {\n  /** Adds two small numbers and returns their sum. */\n  @Override\n  public int add(int a) { return a; }\n  // int x = compute(1, 2, 3); return x;\n  void bare() { }\n  int y = 1; // Walks over every open ticket of the queue.\n  void next() { }\n}\n", {"add"}),
    "go": ("package a\n\n// add returns the sum of two small numbers.\nfunc add() {}\n\n// Separated by a blank line, so it is no documentation.\n\nfunc bare() {}\n\n//go:noinline\nfunc next() {}\n", {"add"}),
    "c": ("#include <a.h>\n/* Adds two small numbers and returns their sum.\n */\nstatic int add(int a)\n{ return a; }\n/* =========================== */\nint bare(void) { return 1; }\n", {"add"}),
    "php": ("<?php\n/** Adds two small numbers and returns their sum. */\n#[Pure]\nfunction add($a) {}\nclass A {\n  # Walks over every open ticket of the queue.\n  public static function other() { }\n  /** No description available for this. */\n  function bare() { }\n}\n", {"add", "other"}),
    "ruby": ("# Adds two small numbers and returns their sum.\ndef add(a)\n  a\nend\nclass A\n  # rubocop:disable Metrics/AbcSize because of reasons here\n  def bare\n  end\nend\n", {"add"}),
}


@pytest.mark.parametrize("language", sorted(DOCUMENTED))
@pytest.mark.parametrize("broken", [False, True])
def test_documentation(language, broken):
    text, want = DOCUMENTED[language]
    if broken:
        text += "<<<<<<< HEAD\nfunction ( { [\n"
    got = {f.name for f in fn.find_functions(lexers.of(language)[0], text) if fn.prose_words(fn.prose(fn.clean(f.comment, f.docstring), language), f.name) >= 5}
    assert got == want


def test_islands_in_a_broken_file():
    text = "class A {\n  int a() { return (1; }\n  /** x */\n  int b(int q) { return q; }\n<<<<<<< HEAD\n  int c() { return 2; }\n=======\n  int d() { return 3; }\n>>>>>>> x\n}\n"
    got = {f.name: f.valid for f in fn.find_functions(lexers.java(), text)}
    assert got == {"a": False, "b": True, "c": True, "d": True}


def test_words_of_prose():
    assert fn.prose_words("Parses the parse tree of trees", "parseTree") == 2
    assert fn.prose_words("将数据表写入磁盘", "f") == 8
    assert fn.prose(["Description of the function goes here"]) == "" and fn.prose(["TODO: write documentation for this method later"]) == ""
    assert fn.prose(["Gives the sum.", "", "@param x the", "  second line of it", "", "And more."]) == "Gives the sum. And more."


NODE = "id string, repo_id string, type string, name string, file_path string, language string, line_start int, updated_at timestamp, code string, f string"


def test_pairs_over_tables(spark):
    text = DOCUMENTED["python"][0]
    files = spark.createDataFrame([(1, "r", "a.py", "python", T, 1, text, "", ""), (1, "r", "a.py", "python", T, 1, text, "", ""), (2, "r", "b.py", "python", T, 1, None, "", "")], FILE)
    n = lambda i, name, line, t=T: (i, "r", "function", name, "a.py", "PYTHON", line, t, "", "")
    nodes = spark.createDataFrame([n("r::a.py::add", "add", 3), n("r::a.py::add", "add", 99, None), n("r::a.py::A::other", "A::other", None), n("r::a.py::A::bare", "A::bare", 12), n("r::b.py::z", "z", 1), n(None, "add", 3)], NODE)
    got = {r["id"]: r for r in fn.document_nodes(nodes, files).collect()}
    assert set(got) == {"r::a.py::add", "r::a.py::A::other"} and got["r::a.py::add"]["code"].startswith("@cached") and got["r::a.py::add"]["description"].startswith("Adds two")
    assert fn.document_nodes(nodes.where("false"), files).collect() == [] and fn.document_nodes(nodes, files.where("false")).collect() == []


def test_templates_by_counts_alone(spark):
    rows = [("Gives back what f stands for here", 30), ("Walks over every open ticket of the queue.", 3)] + [(f"Something of its own number {'abcdefghij'[i % 10] * (i // 10 + 1)}", 1) for i in range(40)]
    df = spark.createDataFrame([(fn.template_hash(d, "g"),) for d, k in rows for _ in range(k)] + [(None,)], "doc_hash bigint")
    assert [r[0] for r in fn.templates(df, 10).collect()] == [fn.template_hash(rows[0][0], "g")]
    assert fn.templates(df.where("false")).collect() == []
    assert fn.template_hash("Gets the  total price", "getTotal") == fn.template_hash("gets THE speed price", "getSpeed") != fn.template_hash("Gets the total price", "getSpeed")


OWN = "import x from 'y';\n\nexport function {0}(a) {{\n  const {1} = a + {2};\n  if ({1} > {3}) {{ return {0}({1}); }}\n  return {1} * {2};\n}}\n"


def own(i):
    return OWN.format(f"walk{i}", f"v{i}", i * 7, i * 13)


def test_marks_and_shapes():
    spelled = lambda t, lang="javascript": [x for x in lexers.of(lang)[0].spellings(t) if x.strip()]
    assert origin.comment_marks("// Code generated by tool. DO NOT EDIT.\npackage a\n") == (True, False)
    assert origin.comment_marks("// reads the generated report\nvar a = 'DO NOT EDIT'\n") == (False, False)
    assert origin.comment_marks("x = 1\n# END OF AUTOMATICALLY GENERATED FILE\n")[0]
    assert origin.comment_marks("/**\n * lib v2.1\n * Copyright (c) 2019 the lib authors\n * Released under the MIT license\n */\nx")[1]
    assert not origin.comment_marks("# Part of the own tools.\n# Licensed under the terms in LICENSE.\nx")[1]
    small = "".join(f"function f{i}(a,b){{return a+b*{i}}}" for i in range(60))
    assert origin.shape(small, spelled(small)) == (True, False)
    data = "module.exports = [\n" + ",\n".join(map(str, range(100))) + "\n];\n"
    assert origin.shape(data, spelled(data)) == (False, True)
    assert origin.shape(own(1), spelled(own(1))) == (False, False)
    assert origin.checkout("/srv/mirrors/upstream/x") and not origin.checkout("/srv/code/vendor-portal")
    assert origin.vendored_path("a/node_modules/x/y.js") and origin.vendored_path("vendor/x/src/y.py") and not origin.vendored_path("app/vendors/y.go") and not origin.vendored_path("app/vendor_portal/y.js")


def test_winnowing_finds_copied_runs():
    a, b = [f"t{i}" for i in range(200)], [f"u{i}" for i in range(100)]
    run = origin.K + origin.W - 1
    shared = set(origin.winnow(a)) & set(origin.winnow(b + a[50 : 50 + run] + b))
    assert shared and not set(origin.winnow(a)) & set(origin.winnow(b)) and len(origin.winnow(a[:5])) == 0


def test_origin_over_tables(spark):
    copy = own(1) + own(2) + own(3)
    rows = [(i, f"r{i}", "lib/x.js", "javascript", T, 1, copy, "", "") for i in range(3)] + [(10 + i, f"r{i % 3}", f"src/{i}.js", "javascript", T, 1, own(50 + i) + own(90 + i), "", "") for i in range(6)]
    rows += [rows[0], (20, "m", "a.js", "javascript", T, 1, None, "", ""), (21, "r1", "b.js", None, None, None, "", "", ""), (22, None, None, None, None, None, None, "", ""), (23, "r1", "q.pb.go", "go", T, 1, "package a\n", "", "")]
    files = spark.createDataFrame(rows, FILE)
    repos = spark.createDataFrame([(f"r{i}", f"/srv/code/r{i}") for i in range(3)] + [("m", "/srv/mirrors/m"), (None, None)], "id string, path string")
    got = {r["file_id"]: r["reasons"] for r in origin.not_handwritten(files, repos).collect()}
    assert got == {0: "copied", 1: "copied", 2: "copied", 20: "checkout", 23: "generated"}
    assert origin.not_handwritten(files.where("false"), repos).collect() == []


GUARD = "#ifndef X_H\n#define X_H\n%s\n#endif\n"


@pytest.mark.parametrize("text", [
    GUARD % "int f( {", GUARD % "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b", "int x;\n#ifdef A\nint f( {\n#endif\n", "#if A\nint x;\n#elif B\nint f( {\n#endif\n", "#if A\nint f( {\n#else\nint x;\n#endif\n",
    "#if A\nint x;\n#else\nint f( {\n#endif\n", "#if A\n#if B\nint x;\n#else\nint y\n#endif\n#else\nint z;\n#endif\n", "#if A\nint x;\n#elif B\nint y;\n#elif C\nint z\n#else\nint w;\n#endif\n", "#else\nint x;\n",
])
def test_c_errors_in_conditionals(text):
    assert syntax.is_valid(text, "c") is False
    assert syntax.is_valid(text.replace("\n", "\r\n"), "c") is False


@pytest.mark.parametrize("text", [
    GUARD % "int f(void);", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n", "#if 0\nit's not {\n#else\nint x;\n#endif\n", "#ifdef A\nint f(int x) {\n#endif\n#ifdef B\nint f(long x) {\n#endif\n return 1; }\n",
    "#if A\nint f(int x) {\n#elif B\nint f(long x) {\n#else\n#error neither\n#endif\n return 1; }\n", "int f(int a) {\n#ifdef A\n if (a) {\n#endif\n#ifndef A\n {\n#endif\n a++; } return a; }\n", "/*\n#if 0\n*/\nint x;\n", "#if A && \\\n    B\nint x;\n#endif /* A\n and B */\n",
])
def test_c_conditionals_that_parse(text):
    assert syntax.is_valid(text, "c") and syntax.is_valid(text.replace("\n", "\r\n"), "c")
