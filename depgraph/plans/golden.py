"""Small sources of every language and what extraction must find in them, checked by hand."""

from __future__ import annotations

#: (language, path, text).
SOURCES = [
    ('python', 'a.py', 'import os.path as p\nfrom lib.x import y\n\nclass A(B):\n    """Doc."""\n    @wraps(x)\n    def m(self):\n        s = "class Z: pass"\n        return helper(1)\n\ndef helper(n):\n    def inner():\n        pass\n    return helper(n - 1)\n'),
    ('javascript', 'a.js', "import { x } from './lib/util';\n/** Does it. */\nexport function helper(a) { return other(a); }\nclass A extends B {\n  m(q) { if (q) { helper(q); } return 'class Z {'; }\n}\n"),
    ('typescript', 'a.ts', "import { x } from '../util';\nfunction helper(a: number): number { return a; }\nexport class A { m(q: string): void { helper(1); } }\n"),
    ('go', 'a.go', 'package p\n\n// helper does.\nfunc helper() int { return 1 }\n\ntype A struct {\n\tx int\n}\n\nfunc (a *A) m() int { return helper() }\n'),
    ('java', 'A.java', 'import java.util.List;\npublic class A {\n  /* class Z { */\n  @Override\n  public int m(int q) { return helper(q); }\n  static int helper(int q) { return 1; }\n}\n'),
    ('rust', 'a.rs', 'use std::io;\nstruct A { x: i32 }\nimpl A { fn m(&self) -> i32 { helper() } }\nfn helper() -> i32 { 1 }\n'),
    ('php', 'a.php', '<?php\nuse App\\Models\\User;\nclass A extends B implements C, D {\n  public function m($q) { return helper($q); }\n}\nfunction helper($q) { return User::find($q); }\n'),
    ('csharp', 'A.cs', 'using System.Linq;\nclass A {\n  public int m(int q) { return helper(q); }\n  private int helper(int q) { return 1; }\n}\n'),
    ('kotlin', 'a.kt', 'import a.b.C\nclass A {\n  fun m(q: Int): Int { return helper(q) }\n}\nfun helper(q: Int): Int { return 1 }\n'),
    ('scala', 'a.scala', 'import a.b.C\nclass A {\n  def m(q: Int): Int = { helper(q) }\n}\nobject O { def helper(q: Int): Int = { 1 } }\n'),
    ('ruby', 'a.rb', 'class A < B\n  # Does it.\n  def m(q)\n    if q\n      helper(q)\n    end\n  end\nend\n\ndef helper(q)\n  1\nend\n'),
    ('c', 'a.c', '#include "lib/util.h"\nstruct A { int x; };\nstatic int helper(int q) { return 1; }\nint m(int q)\n{\n  return helper(q);\n}\n'),
    ('cpp', 'a.cpp', '#include <vector>\nclass A { int x; };\nint helper(int q) { return 1; }\nint A::m(int q) { return helper(q); }\n'),
    ('csharp', 'B.cs', 'using System.Linq;\n[Route("a")]\nclass A {\n  /// Doc line.\n  [HttpGet]\n  void M() { helper(1); }\n  public A(int x) { }\n  public async Task<List<int>> N(int q) => helper(q);\n  private int helper(int q) { return q; }\n  int P { get { return helper(2); } }\n}\nenum E { X }\nstruct S { int y; }\ninterface I { void Q(); }\n'),
    ('javascript', 'b.js', 'function outer(a) {\n  inner1(a);\n  const f = x => skipped(x);\n  a.map((y) => { skipped2(y); });\n  after(a);\n  function nested() { skipped3(); }\n  tail();\n}\n'),
    ('typescript', 'b.ts', "interface I { a(): void }\nenum E { A }\n@Injectable()\nexport class A {\n  @Get('x')\n  m(q: string): void { helper(1); }\n}\nfunction helper(a: number): number { return 1; }\n"),
    ('java', 'B.java', 'public class A {\n  enum E { X }\n  record R(int a) {}\n  @interface N {}\n  @Override\n  @Deprecated\n  public int m(int q) { return 1; }\n}\ninterface I { int z(); }\n'),
    ('cpp', 'b.cpp', 'enum class C { A };\nenum D { B };\nstruct S { int x; };\nclass K { int y; };\nint S::f(int q) { return g(q); }\n'),
    ('c', 'b.c', 'enum D { B };\nunion U { int x; };\n'),
    ('ruby', 'b.rb', 'module M\n  class A\n    def m\n      go(1)\n    end\n  end\nend\n'),
    ('scala', 'b.scala', 'trait T { def a(): Int }\nclass A {\n  def m(q: Int): Int = { helper(q) }\n}\n'),
    ('rust', 'b.rs', 'enum E { A }\ntrait T { fn t(&self); }\nstruct A { x: i32 }\nimpl A { #[inline]\n fn m(&self) -> i32 { helper() } }\n'),
    ('kotlin', 'b.kt', 'interface I { fun z(): Int }\nobject O { fun m(): Int { return helper() } }\n'),
    ('python', 'b.py', 'class A:\n    class B:\n        x = call1()\n    def m(self):\n        @deco(call2())\n        def inner():\n            call3()\n        class C:\n            y = call4()\n        return call5()\n'),
    ('go', 'b.go', 'package p\ntype A struct { x int }\nfunc (a *A) m() int { f := func() { g() }; return helper() }\n'),
    ('php', 'b.php', '<?php\ninterface I {}\ntrait T {}\nclass A { function m() { $x = fn($y) => h($y); } }\n'),
]
#: Per node: path | type | name | first line | last line | documentation | decorators.
NODES = """
a.py|file|a.py|1|15||
a.py|class|A|4|9|Doc.|
a.py|function|A::m|7|9||@wraps
a.py|function|helper|11|14||
a.js|file|a.js|1|7||
a.js|function|helper|3|3|Does it.|
a.js|class|A|4|6||
a.js|function|A::m|5|5||
a.ts|file|a.ts|1|4||
a.ts|function|helper|2|2||
a.ts|class|A|3|3||
a.ts|function|A::m|3|3||
a.go|file|a.go|1|11||
a.go|function|helper|4|4|helper does.|
a.go|class|A|6|8||
a.go|function|A::m|10|10||
A.java|file|A.java|1|8||
A.java|class|A|2|7||
A.java|function|A::m|5|5|class Z {|@Override
A.java|function|A::helper|6|6||
a.rs|file|a.rs|1|5||
a.rs|class|A|2|2||
a.rs|function|A::m|3|3||
a.rs|function|helper|4|4||
a.php|file|a.php|1|7||
a.php|class|A|3|5||
a.php|function|A::m|4|4||
a.php|function|helper|6|6||
A.cs|file|A.cs|1|6||
A.cs|class|A|2|5||
A.cs|function|A::m|3|3||
A.cs|function|A::helper|4|4||
a.kt|file|a.kt|1|6||
a.kt|class|A|2|4||
a.kt|function|A::m|3|3||
a.kt|function|helper|5|5||
a.scala|file|a.scala|1|6||
a.scala|class|A|2|4||
a.scala|function|A::m|3|3||
a.scala|class|O|5|5||
a.scala|function|O::helper|5|5||
a.rb|file|a.rb|1|13||
a.rb|class|A|1|8||
a.rb|function|A::m|3|7|Does it.|
a.rb|function|helper|10|12||
a.c|file|a.c|1|8||
a.c|class|A|2|2||
a.c|function|helper|3|3||
a.c|function|m|4|7||
a.cpp|file|a.cpp|1|5||
a.cpp|class|A|2|2||
a.cpp|function|helper|3|3||
a.cpp|function|A::m|4|4||
B.cs|file|B.cs|1|15||
B.cs|class|A|3|11||@Route
B.cs|function|A::M|6|6|Doc line.|@HttpGet
B.cs|function|A::N|8|8||
B.cs|function|A::helper|9|9||
B.cs|class|I|14|14||
B.cs|function|I::Q|14|14||
b.js|file|b.js|1|9||
b.js|function|outer|1|8||
b.ts|file|b.ts|1|9||
b.ts|class|A|4|7||@Injectable
b.ts|function|A::m|6|6||@Get
b.ts|function|helper|8|8||
B.java|file|B.java|1|10||
B.java|class|A|1|8||
B.java|function|A::m|7|7||@Override @Deprecated
B.java|class|I|9|9||
B.java|function|I::z|9|9||
b.cpp|file|b.cpp|1|6||
b.cpp|class|S|3|3||
b.cpp|class|K|4|4||
b.cpp|function|S::f|5|5||
b.c|file|b.c|1|3||
b.c|class|D|1|1||
b.c|class|U|2|2||
b.rb|file|b.rb|1|8||
b.rb|class|A|2|6||
b.rb|function|A::m|3|5||
b.scala|file|b.scala|1|5||
b.scala|class|A|2|4||
b.scala|function|A::m|3|3||
b.rs|file|b.rs|1|6||
b.rs|class|T|2|2||
b.rs|class|A|3|3||
b.rs|function|A::m|5|5||
b.kt|file|b.kt|1|3||
b.kt|class|I|1|1||
b.kt|function|I::z|1|1||
b.kt|class|O|2|2||
b.kt|function|O::m|2|2||
b.py|file|b.py|1|11||
b.py|class|A|1|10||
b.py|class|B|2|3||
b.py|function|A::m|4|10||
b.go|file|b.go|1|4||
b.go|class|A|2|2||
b.go|function|A::m|3|3||
b.php|file|b.php|1|5||
b.php|class|A|4|4||
b.php|function|A::m|4|4||
""".strip()
#: Per edge: source | relation | target | name of an open target | confidence | line. Ids are without the repository.
EDGES = """
a.py|imports||os.path|EXTRACTED|1
a.py|imports_from||lib.x|EXTRACTED|2
a.py|contains|a.py::A||EXTRACTED|4
a.py::A|inherits||B|EXTRACTED|4
a.py::A|method|a.py::A::m||EXTRACTED|7
a.py|contains|a.py::helper||EXTRACTED|11
a.py::A::m|calls|a.py::helper||EXTRACTED|9
a.py::helper|calls||helper|INFERRED|14
a.js|contains|a.js::helper||EXTRACTED|3
a.js|contains|a.js::A||EXTRACTED|4
a.js::A|method|a.js::A::m||EXTRACTED|5
a.js|imports_from||util|EXTRACTED|1
a.js::helper|calls||other|INFERRED|3
a.js::A::m|calls|a.js::helper||EXTRACTED|5
a.ts|contains|a.ts::helper||EXTRACTED|2
a.ts|contains|a.ts::A||EXTRACTED|3
a.ts::A|method|a.ts::A::m||EXTRACTED|3
a.ts|imports_from||util|EXTRACTED|1
a.ts::A::m|calls|a.ts::helper||EXTRACTED|3
a.go|contains|a.go::helper||EXTRACTED|4
a.go|contains|a.go::A||EXTRACTED|6
a.go::A|method|a.go::A::m||EXTRACTED|10
a.go::A::m|calls|a.go::helper||EXTRACTED|10
A.java|contains|A.java::A||EXTRACTED|2
A.java::A|method|A.java::A::m||EXTRACTED|5
A.java::A|method|A.java::A::helper||EXTRACTED|6
A.java|imports||List|EXTRACTED|1
A.java::A::m|calls|A.java::A::helper||EXTRACTED|5
a.rs|contains|a.rs::A||EXTRACTED|2
a.rs::A|method|a.rs::A::m||EXTRACTED|3
a.rs|contains|a.rs::helper||EXTRACTED|4
a.rs::A::m|calls|a.rs::helper||EXTRACTED|3
a.php|contains|a.php::A||EXTRACTED|3
a.php::A|inherits||B|EXTRACTED|3
a.php::A|implements||C|EXTRACTED|3
a.php::A|implements||D|EXTRACTED|3
a.php::A|method|a.php::A::m||EXTRACTED|4
a.php|contains|a.php::helper||EXTRACTED|6
a.php|imports||User|EXTRACTED|2
a.php::A::m|calls|a.php::helper||EXTRACTED|4
a.php::helper|calls||User|INFERRED|6
A.cs|contains|A.cs::A||EXTRACTED|2
A.cs::A|method|A.cs::A::m||EXTRACTED|3
A.cs::A|method|A.cs::A::helper||EXTRACTED|4
A.cs|imports||Linq|EXTRACTED|1
A.cs::A::m|calls|A.cs::A::helper||EXTRACTED|3
a.kt|contains|a.kt::A||EXTRACTED|2
a.kt::A|method|a.kt::A::m||EXTRACTED|3
a.kt|contains|a.kt::helper||EXTRACTED|5
a.kt|imports||C|EXTRACTED|1
a.kt::A::m|calls|a.kt::helper||EXTRACTED|3
a.scala|contains|a.scala::A||EXTRACTED|2
a.scala::A|method|a.scala::A::m||EXTRACTED|3
a.scala|contains|a.scala::O||EXTRACTED|5
a.scala::O|method|a.scala::O::helper||EXTRACTED|5
a.scala|imports||C|EXTRACTED|1
a.scala::A::m|calls|a.scala::O::helper||EXTRACTED|3
a.rb|contains|a.rb::A||EXTRACTED|1
a.rb::A|method|a.rb::A::m||EXTRACTED|3
a.rb|contains|a.rb::helper||EXTRACTED|10
a.rb::A::m|calls|a.rb::helper||EXTRACTED|5
a.c|contains|a.c::A||EXTRACTED|2
a.c|contains|a.c::helper||EXTRACTED|3
a.c|contains|a.c::m||EXTRACTED|4
a.c|imports||util|EXTRACTED|1
a.c::m|calls|a.c::helper||EXTRACTED|6
a.cpp|contains|a.cpp::A||EXTRACTED|2
a.cpp|contains|a.cpp::helper||EXTRACTED|3
a.cpp::A|method|a.cpp::A::m||EXTRACTED|4
a.cpp|imports||vector|EXTRACTED|1
a.cpp::A::m|calls|a.cpp::helper||EXTRACTED|4
B.cs|contains|B.cs::A||EXTRACTED|3
B.cs::A|method|B.cs::A::M||EXTRACTED|6
B.cs::A|method|B.cs::A::N||EXTRACTED|8
B.cs::A|method|B.cs::A::helper||EXTRACTED|9
B.cs|contains|B.cs::I||EXTRACTED|14
B.cs::I|method|B.cs::I::Q||EXTRACTED|14
B.cs|imports||Linq|EXTRACTED|1
B.cs::A::M|calls|B.cs::A::helper||EXTRACTED|6
B.cs::A::N|calls|B.cs::A::helper||EXTRACTED|8
b.js|contains|b.js::outer||EXTRACTED|1
b.js::outer|calls||inner1|INFERRED|2
b.js::outer|calls||map|INFERRED|4
b.js::outer|calls||after|INFERRED|5
b.js::outer|calls||tail|INFERRED|7
b.ts|contains|b.ts::A||EXTRACTED|4
b.ts::A|method|b.ts::A::m||EXTRACTED|6
b.ts|contains|b.ts::helper||EXTRACTED|8
b.ts::A::m|calls|b.ts::helper||EXTRACTED|6
B.java|contains|B.java::A||EXTRACTED|1
B.java::A|method|B.java::A::m||EXTRACTED|7
B.java|contains|B.java::I||EXTRACTED|9
B.java::I|method|B.java::I::z||EXTRACTED|9
b.cpp|contains|b.cpp::S||EXTRACTED|3
b.cpp|contains|b.cpp::K||EXTRACTED|4
b.cpp::S|method|b.cpp::S::f||EXTRACTED|5
b.cpp::S::f|calls||g|INFERRED|5
b.c|contains|b.c::D||EXTRACTED|1
b.c|contains|b.c::U||EXTRACTED|2
b.rb|contains|b.rb::A||EXTRACTED|2
b.rb::A|method|b.rb::A::m||EXTRACTED|3
b.rb::A::m|calls||go|INFERRED|4
b.scala|contains|b.scala::A||EXTRACTED|2
b.scala::A|method|b.scala::A::m||EXTRACTED|3
b.scala::A::m|calls||helper|INFERRED|3
b.rs|contains|b.rs::T||EXTRACTED|2
b.rs|contains|b.rs::A||EXTRACTED|3
b.rs::A|method|b.rs::A::m||EXTRACTED|5
b.rs::A::m|calls||helper|INFERRED|5
b.kt|contains|b.kt::I||EXTRACTED|1
b.kt::I|method|b.kt::I::z||EXTRACTED|1
b.kt|contains|b.kt::O||EXTRACTED|2
b.kt::O|method|b.kt::O::m||EXTRACTED|2
b.kt::O::m|calls||helper|INFERRED|2
b.py|contains|b.py::A||EXTRACTED|1
b.py|contains|b.py::B||EXTRACTED|2
b.py::A|method|b.py::A::m||EXTRACTED|4
b.py::A::m|calls||deco|INFERRED|5
b.py::A::m|calls||call2|INFERRED|5
b.py::A::m|calls||call4|INFERRED|9
b.py::A::m|calls||call5|INFERRED|10
b.go|contains|b.go::A||EXTRACTED|2
b.go::A|method|b.go::A::m||EXTRACTED|3
b.go::A::m|calls||g|INFERRED|3
b.go::A::m|calls||helper|INFERRED|3
b.php|contains|b.php::A||EXTRACTED|4
b.php::A|method|b.php::A::m||EXTRACTED|4
b.php::A::m|calls||h|INFERRED|4
""".strip()


def rows(text: str) -> list[list[str]]:
    return [line.split("|") for line in text.split("\n")]
