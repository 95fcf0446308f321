import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(("path", "want"), [("tests/a.py", True), ("foo_test.go", True), ("FooTest.java", True), ("x.spec.ts", True), ("contest.py", False), ("src/testing/x.c", True), ("mocks/a.go", True), ("spec/a.py", False), ("a_test.hpp", True), ("FooTestCase.java", True), ("TestFoo.java", False), ("x.test.ets", True), ("m_tests.erl", True)])
def test_test_files(spark, path, want):
    assert one(spark, X.is_test_file(F.lit(path))) is want


def test_scope_and_paths(spark):
    assert one(spark, X.in_scope(F.lit("./src/core/x.py"), ["src/core"]))
    assert not one(spark, X.in_scope(F.lit("src/core2/x.py"), ["src/core"]))
    assert one(spark, X.directory_name(F.lit(".bashrc"))) == ".bashrc"
    assert one(spark, X.fqn(F.lit("src/a.c"), F.lit("f"))) == "src::a-c::f"
    assert one(spark, X.fqn_source(F.lit("src::a-c::C::f"))) == "src/a.c"
    assert one(spark, X.fqn_source(F.lit("src::a::f"))) is None
    assert one(spark, X.language(F.lit("x/y.h"))) == "cpp"
    assert one(spark, X.bare_name(F.lit("ns::C<int>::~run(int a)"))) == "run"
    assert one(spark, X.bug_id(F.lit("a/b/c.json"))) == "a--b--c"


USAGE = [
    ({"input_tokens": 100, "output_tokens": 20, "cache_read_input_tokens": 30, "cache_creation_input_tokens": 5}, (100, 20, 30, 5), (100, 20, 30, 5), (100, 20, 30, 5)),
    ({"prompt_tokens": 100, "completion_tokens": 20}, (100, 20, 0, 0), (100, 20, 0, 0), (100, 20, 0, 0)),
    ({"prompt_tokens": 100, "completion_tokens": 20, "prompt_tokens_details": {"cached_tokens": 40}}, (60, 20, 40, 0), (100, 20, 0, 0), (100, 20, 40, 0)),
    ({"prompt_tokens": 100, "completion_tokens": 20, "prompt_cache_hit_tokens": 40, "prompt_cache_miss_tokens": 60}, (60, 20, 40, 0), (60, 20, 40, 0), (60, 20, 40, 0)),
]


@pytest.mark.parametrize(("raw", "estimate", "native", "agent"), USAGE)
def test_usage(spark, raw, estimate, native, agent):
    df = spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.parse_json("j").alias("u"))
    for f, want in ((X.usage_estimate, estimate), (X.usage_native, native), (X.usage_agent, agent)):
        assert tuple(df.select(f("u").alias("x")).first()[0]) == want


@pytest.mark.parametrize(("raw", "want"), [
    ('{"signature":"f()","pre_condition":"","post_condition":"x"}', True), ('{"signature":"f()","pre_condition":""}', False),
    ('{"signature":"f()","pre_condition":"","post_condition":"x","y":"z"}', False), ('{"signature":"f()","pre_condition":"","post_condition":1}', False), ("nonsense", False),
])
def test_spec(spark, raw, want):
    assert one(spark, X.valid_spec(F.col("j")), j=raw) is want


def test_token_labels_round_as_the_binary_quotient_does(spark):
    ns = [*range(1000, 20_000, 50), *range(1_000_000, 9_000_000, 5_000), 999, 0, 999_950, 123_456_750, 2**52 + 1]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", X.token_label(F.col("n")).alias("label")).collect()
    want = lambda n: f"{n / 1_000_000:.2f}M" if n >= 1_000_000 else f"{n / 1_000:.1f}K" if n >= 1_000 else str(n)
    assert [r for r in got if r["label"] != want(r["n"])] == []
    assert [one(spark, X.token_label(F.lit(n))) for n in (1150, 1050)] == ["1.1K", "1.1K"]
    assert one(spark, X.token_label(F.lit(None).cast("long"))) == one(spark, X.duration_label(F.lit(None).cast("long"))) == "—"


def test_labels(spark):
    assert [one(spark, X.token_label(F.lit(n))) for n in (12, 1250, 2_345_678)] == ["12", "1.2K", "2.35M"]
    assert [one(spark, X.duration_label(F.lit(n))) for n in (5, 65, 3700)] == ["5s", "1m 05s", "1h 01m 40s"]
    assert [one(spark, X.cost_label(F.lit(n))) for n in (0.1234, 12.345, 123.45, 12345.6)] == ["$0.123", "$12.35", "$123.5", "$12346"]
    assert T.terminates("if x:\n    raise ValueError", "Python") and not T.terminates("x = 1\nbreak", "rust") and T.terminates("abort()", "fortran")


PYTHON = """import x

@deco
def f(a):
    return g(a)  # def no():

class C:
    def f(self):
        '''Makes something.
def hidden(): pass'''
        raise ValueError(1)

    async def h(self):
        pass
def f(b): return 1
"""

C = """#include <x>
// int no() {
namespace n {
int add(int a, int b)
{
  if (a) { return b; }
  return a + '{';
}
void C::run(const char *s) { puts("}"); }
}
struct S { int x; };
"""

RUST = """pub fn a<T>(x: T) -> T { x }
#[test]
fn t() { assert!(true); }
impl S {
    fn b(&self) -> i32 {
        if true { 1 } else { 2 }
    }
}
"""

GO = """package m
func (s *S) Run(a int) error {
    return nil
}
func main() { go func() {}() }
"""

JS = """export async function walk(a) {
  if (a) { return 1 }
}
class A {
  run(x) {
    return `${x}`
  }
}
"""


def names(source, lang):
    return [(n, a, b) for n, a, b in T.functions_in(source, lang)]


def test_extraction():
    assert names(PYTHON, "python") == [("f", 2, 4), ("C::f", 7, 10), ("f_1", 14, 14)]
    assert names(C, "c") == [("add", 3, 7), ("C::run", 8, 8)]
    assert names(RUST, "rust") == [("a", 0, 0), ("b", 4, 6)]
    assert [n for n, _, _ in names(GO, "go")] == ["Run", "main"]
    assert [n for n, _, _ in names(JS, "javascript")] == ["walk", "run"]


def test_mask_keeps_positions():
    for source, hashes in ((PYTHON, True), (C, False)):
        masked = T.mask(source, hashes)
        assert len(masked) == len(source) and masked.count("\n") == source.count("\n")
    assert "hidden" not in T.mask(PYTHON, True)


def test_names():
    assert set(T.name_parts("dmp_clear_denoms")) == {"dmp", "clear", "denoms", "dmp_clear", "clear_denoms", "dmp_clear_denoms"}
    assert T.similar("compute_total", "compute_totals") and not T.similar("alpha", "omega") and not T.similar("abc", "abc")


def test_json_recovery_and_merge():
    assert T.recover_json('Here: {"a": [1]} done') == {"a": [1]}
    assert T.recover_json('{"a": 1} and {"b": 2}') is None
    assert T.recover_json("none") is None
    assert T.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert T.utf16_offset("a\r\n😀b", 1, 2) == 4


def test_block_split():
    assert T.blocks(["x"] * 81, 40, False) == [(0, 40), (40, 81)]
    lines = ["{"] + ["x"] * 60 + ["}"] + ["y"] * 40
    assert T.blocks(lines, 40) == [(0, 62), (62, 102)]


def test_signals():
    s = {r["name"]: r for r in T.python_signals(PYTHON)}
    assert s["f"]["calls"] or s["h"]["calls"] == []
    assert T.python_signals("def (") == []
    assert T.generic_signals(C, "c")[1]["calls"] == ["puts", "run"]


def test_tables_of_functions(spark):
    df = spark.createDataFrame([("a.py", "python", PYTHON), ("b.c", "c", C), ("e.c", "c", "")], "path string, lang string, content string")
    assert T.functions_of(df).count() == 5
    assert T.signals_of(df).filter("path = 'a.py'").count() == 4


def test_similar_names_is_whole(spark):
    words = ["compute", "computed", "compare", "comparer", "reader", "header", "loader", "leader", "apple", "maple"]
    df = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r.a, r.b) for r in T.similar_names(df, df, "name").collect()}
    assert got == {(a, b) for a in words for b in words if T.similar(a, b)}


def test_usage_beyond_the_fixture(spark):
    cases = [
        ({"input_tokens": 100, "input_tokens_details": {"cached_tokens": 40}}, (100, 0, 40, 0)),
        ({"prompt_tokens": 100, "input_tokens_details": {"cached_tokens": 40}, "prompt_tokens_details": {"cached_tokens": 0}}, (60, 0, 40, 0)),
        ({"prompt_tokens": 100, "prompt_cache_miss_tokens": 70}, (100, 0, 0, 0)),
        ({"prompt_tokens": 10, "prompt_cache_hit_tokens": 40}, (0, 0, 40, 0)),
        ({}, (0, 0, 0, 0)),
    ]
    import json

    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string").select("i", F.parse_json("j").alias("u"))
    got = {r.i: tuple(r.x) for r in df.select("i", X.usage_estimate("u").alias("x")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
