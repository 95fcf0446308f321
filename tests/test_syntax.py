"""Tokens, comment removal, scopes, blocks, calls and terminating statements on literal sources."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import syntax as S

CPP = r'''// top {
#define X {
namespace a::b {
namespace {
class Foo final : public Bar {
 public:
  Foo(int x) : x_(x), y_{0} { y = "}{"; }
  ~Foo() {}
  int get() const noexcept { return R"q(}})q"[0]; }
  bool operator==(const Foo& o) const {
    if (x) { for (int i = f(0); i < n; g(i)) { } }
    auto l = [&](int z) { return z; };
    return true;
  }
};
}
template <typename T>
T Foo::bar(T x)
{
  /* } */
  return 1'000'000 + x;
}
struct S { int v; };
}
int main() { return 0; }
int main(int c) { return 0; }
struct S * make(struct S q) { return 0; }
'''

JAVA = """package x;
@Service("a{b")
public class A extends B<C> {
  @Override
  public int f(int x) throws E { return x; }
  public A() { this.x = new Runnable() { public void run() { } }; }
  static class In { void g() { if (x) { } else if (y(2)) { } } }
  interface I { default void h() { } }
  @Test(timeout = (1)) void t() { }
}
"""

TS = """export class W<T> extends Q {
  private async m(x: number): Promise<void> { const s = `}{ ${x}`; }
  get v(): number { return /[{]/.test("a") ? 1 : 2; }
}
export const arrow = async (x: number): Promise<number> => {
  return x;
};
function* gen(a, b = {}) { yield 1; }
namespace N { export function inner(x) { return x; } }
if (x) { y(); }
"""

RUST = """impl<T> Foo<T> { pub fn new(a: &'a str) -> Self { let c = '{'; Foo {} } }
impl Display for Foo { fn fmt(&self) -> R { /* a /* } */ } */ x } }
mod m { #[test] fn t() { }
  #[inline]
  pub(crate) async unsafe fn u() { } }
"""

GO = """package p
func (r *T) Method(a int) (int, error) { return 1, nil }
func plain[T any](x T) { s := `{`
  go func() { }() }
type S struct { a int }
"""

SOURCES = [("a.cpp", "cpp", CPP), ("A.java", "java", JAVA), ("t.ts", "typescript", TS), ("r.rs", "rust", RUST), ("g.go", "go", GO)]


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, lang string, content string").repartition(2)


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tokens_cover_every_source(spark):
    odd = [("e", "c", ""), ("n", "c", None), (None, "c", "x"), ("u", "cobol", "A = 'b' // c\n"), ("l", None, "x{\r\n}"), ("a.cpp", "cpp", CPP)]
    rows = S.tokens(table(spark, SOURCES + odd)).collect()
    texts = {p: c for p, _, c in SOURCES + odd}
    for path in {r["path"] for r in rows}:
        mine = sorted((r for r in rows if r["path"] == path), key=lambda r: r["at"])
        for r in mine:
            assert texts[path][r["start"] : r["end"]] == r["text"]
            assert r["line"] == len(re.findall("\r\n|\n|\r", texts[path][: r["start"]]))
        between = "".join(texts[path][a["end"] : b["start"]] for a, b in zip(mine, mine[1:], strict=False))
        assert not between.strip(" \t")
    assert {r["path"] for r in rows} == {p for p, _, _ in SOURCES} | {"u", "l"}
    depth = {r["path"]: r["depth"] for r in sorted(rows, key=lambda r: r["at"])}
    assert set(depth.values()) == {0}


def test_functions_of_brace_languages(spark):
    assert found(S.brace_functions(table(spark, SOURCES)), "path", "ident", "start_idx", "end_idx") == sorted([
        ("a.cpp", "a::b::Foo::Foo", 6, 6), ("a.cpp", "a::b::Foo::~Foo", 7, 7), ("a.cpp", "a::b::Foo::get", 8, 8), ("a.cpp", "a::b::Foo::operator==", 9, 13),
        ("a.cpp", "a::b::Foo::bar", 16, 21), ("a.cpp", "main", 24, 24), ("a.cpp", "main_1", 25, 25), ("a.cpp", "make", 26, 26),
        ("A.java", "A::f", 3, 4), ("A.java", "A::A", 5, 5), ("A.java", "A::In::g", 6, 6), ("A.java", "A::I::h", 7, 7), ("A.java", "A::t", 8, 8),
        ("t.ts", "W::m", 1, 1), ("t.ts", "W::v", 2, 2), ("t.ts", "arrow", 4, 6), ("t.ts", "gen", 7, 7), ("t.ts", "N::inner", 8, 8),
        ("r.rs", "Foo::new", 0, 0), ("r.rs", "Foo::fmt", 1, 1), ("r.rs", "m::u", 4, 4), ("g.go", "Method", 1, 1), ("g.go", "plain", 2, 3),
    ])


def test_open_braces_repeats_and_empty_tables(spark):
    rows = [("o.c", "c", "int f(void) {\n  if (x) {\n"), ("d.c", "c", "int g(void) { }"), ("d.c", "c", "int g(void) { }"), ("z.c", "c", None), ("p.py", "python", "def f(): {}")]
    assert found(S.brace_functions(table(spark, rows)), "path", "ident", "start_idx", "end_idx") == [("d.c", "g", 0, 0), ("o.c", "f", 0, 1)]
    assert S.brace_functions(table(spark, rows).filter("false")).collect() == []
    assert S.split_blocks(table(spark, rows).filter("false")).collect() == []


def test_comments_become_blanks(spark):
    rows = [
        ("1", "c", "int a;/* é😀 */b // x\\\n y\nc = \"/* no */\"; '//'"),
        ("2", "python", "x = 1  # é\ns = '''# no\n'''\nt = \"#\""),
        ("3", "cpp", "int/**/v; auto r = R\"(// no)\";"),
        ("4", "c", "a /* open"), ("5", "c", "f(]"), ("6", "c", "int a??/\n;"), ("7", "java", "s = \"open\n;"), ("8", "rust", "a /* b /* c */ d */ e 'x"), ("9", "c", None),
    ]
    got = dict(found(S.without_comments(table(spark, rows)), "path", "code"))
    assert got["1"] == "int a;" + " " * len("/* é😀 */".encode()) + "b      \n  \nc = \"/* no */\"; '//'"
    assert got["2"] == "x = 1  " + " " * len("# é".encode()) + "\ns = '''# no\n'''\nt = \"#\""
    assert got["3"] == "int    v; auto r = R\"(// no)\";"
    assert got["8"] == "a" + " " * 19 + "e 'x"
    assert [got[k] for k in "45679"] == [None] * 5


def test_code_lines(spark):
    rows = [("1", "c", "/* a */\nint x; // b\n\n  \ny;"), ("2", "c", "f(] // a\n/* b\nc */ d \"// e\"\n#if 1 # g\n"), ("3", "c", None)]
    assert dict(found(S.code_lines(table(spark, rows)), "path", "code")) == {"1": "int x;     \ny;", "2": "f(] \n d \"// e\"\n#if 1 ", "3": None}


def lines_of(df, path):
    return [(r["first"], r["last"]) for r in df.filter(F.col("path") == path).orderBy("block").collect()]


def test_blocks_end_with_statements(spark):
    c = ["int f(int a)", "{"] + ["  int b0 = 1;", "  struct T t = {", "    1,", "  };", "  if (a) {", "    x();", "  }", "  else {", "    y();", "  }", "  do {", "    z();", "  } while (a);", "  // } ;", "  g(1,", "    2);"] * 3 + ["  return 1;", "}"]
    ts = ["function f() {"] + ["  const a = [1,", "    2]", "  foo(() => {", "    bar()", "  })", "  if (a)", "  {", "    b()", "  }", "  return a", "    .b()"] * 4 + ["}"]
    python = ["def f():"] + ["    x = {"] * 25
    prefixed = [f"Line {i + 1}: {line}" for i, line in enumerate(c)]
    broken = ["int f() {"] + ["  if (a) {", "    b();", "  }"] * 10 + ["  \"open", "}"]
    rows = [("c", "c", "\n".join(c)), ("t", "typescript", "\n" + "\n".join(ts) + "\n"), ("p", "python", "\n".join(python)), ("l", "c", "\n".join(prefixed)), ("b", "c", "\n".join(broken)), ("n", "c", None), ("s", "c", "int g;"), ("d", "go", "x\n" * 25)]
    got = S.split_blocks(table(spark, rows), 6).cache()
    ends = [i for i, line in enumerate(c) if line in ("  int b0 = 1;", "  };", "  } while (a);", "    2);", "  return 1;") or line == "  }" and c[i + 1] != "  else {"]

    def greedy(ends, total, size=6):
        out, start = [], 0
        while total - start > 2 * size:
            end = next((e for e in ends if e >= start + size), None)
            if end is None or end >= total - 1:
                break
            out.append((start, end))
            start = end + 1
        return [*out, (start, total - 1)]

    assert lines_of(got, "c") == greedy(ends, len(c)) == lines_of(got, "l")
    ts_ends = [i for i, line in enumerate(ts) if line in ("    2]", "  })", "  }", "    .b()")]
    assert lines_of(got, "t") == greedy(ts_ends, len(ts))
    assert lines_of(got, "p") == [(0, 5), (6, 11), (12, 17), (18, 25)]
    assert lines_of(got, "b") == greedy([i for i, line in enumerate(broken) if line == "  }"], len(broken))
    assert lines_of(got, "d") == [(0, 5), (6, 11), (12, 17), (18, 24)]
    assert lines_of(got, "n") == lines_of(got, "s") == [(0, 0)]
    assert "\n".join(r["text"] for r in got.filter("path = 'l'").orderBy("block").collect()) == "\n".join(prefixed)


def test_blocks_of_random_functions(spark):
    rnd, rows, want = random.Random(3), [], {}
    for n in range(25):
        body, ends = ["int f() {"], []
        for _ in range(rnd.randrange(40)):
            body += rnd.choice([["  a = b;"], ["  if (x) {", "    y(); }"], ["  f(\"}\",", "    '{');"], ["  while (1)", "    z();"], ["  // ;", "  b = 1; /* } */"], ["  for (i = 0; i < n; i++) {", "    if (q) { w(); } else {", "  }", "  }"]])
            ends.append(len(body) - 1)
        body.append("}")
        rows.append((str(n), "java", "\n".join(body)))
        total, start, cuts = len(body), 0, []
        while total > 5 and total - start > 10:
            end = next((e for e in ends if e >= start + 5), None)
            if end is None or end >= total - 1:
                break
            cuts.append((start, end))
            start = end + 1
        want[str(n)] = [*cuts, (start, total - 1)]
    got = S.split_blocks(table(spark, rows), 5).cache()
    assert {p: lines_of(got, p) for p in want} == want


def test_calls_by_language(spark):
    rows = [
        ("c", "c", "int f() { if (a) g(1); /* h(2) */ s = \"k(3)\"; sizeof(x); printf(y); m<int>(4); }"), ("r", "rust", "fn f() { a::<T>(1); b(2); match (c) { } vec(d); e<T>(3); }"),
        ("g", "go", "func f() { A[int](1); defer B(2); make(c) }"), ("p", "python", "def f():\n  a(1) # b(2)\n  '''c(3)'''\n  print(d(4))\n  e[0](5)"), ("x", "cobol", "foo (1) bar<T>(2)"), ("n", "c", None),
    ]
    got = found(S.call_sites(table(spark, rows).withColumnRenamed("path", "caller")), "caller", "name")
    assert got == [("c", "f"), ("c", "g"), ("c", "m"), ("g", "A"), ("g", "B"), ("g", "f"), ("p", "a"), ("p", "d"), ("p", "f"), ("r", "a"), ("r", "b"), ("r", "f"), ("x", "foo")]


@pytest.mark.parametrize(("lang", "text", "ends"), [("cpp", "std::exit (1);", True), ("c", "throw x;", False), ("python", "raise X", True), ("go", "log.Fatalf(1)", True), ("erlang", "return", False), ("cobol", "abort()", True), ("Java", "throw x;", True), (None, "x = returned", False), ("c", None, False)])
def test_terminating(spark, lang, text, ends):
    assert S.terminating(spark.createDataFrame([(lang, text)], "lang string, text string")).first()["terminating"] is ends
