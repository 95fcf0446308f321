"""Joins and windows that have to hold on larger tables: same rows as plain versions, and plans without the step that grew."""

from __future__ import annotations

import random

from siltstone.operators import relations as R
from siltstone.sources import records


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def _names(spark, seed):
    rng = random.Random(seed)
    sites = [(rng.choice([None, *range(9)]), rng.choice([None, "a", "b", "c", "if"])) for _ in range(40)]
    definitions = [(i, "abc"[i % 3]) for i in range(12)] + [(i, rng.choice("abc")) for i in range(4)] + [(None, "a"), (7, None), (7, "b")]
    return sites, definitions, spark.createDataFrame(sites, "caller int, name string"), spark.createDataFrame(definitions, "callee int, name string")


def test_cleared_broadcasts_no_targets(spark):
    artifacts = spark.createDataFrame([("v/1/f.json",), ("v/2/f.json",), ("w/probe_v--1--f.bug-001.py",), (None,)], "path string")
    targets = spark.createDataFrame([("v/1/f.json",), ("v/1/f.json",), (None,)], "file string")
    got = records.cleared(artifacts, targets)
    assert "Broadcast" not in _plan(got, "executedPlan")
    assert sorted(r[0] or "" for r in got.collect()) == ["", "v/2/f.json"]


def test_call_sites_form_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(R, "DEALT", 5)
    sites, definitions, s, d = _names(spark, 1)
    got = R.resolve_call_sites(s, d, ["if"])
    assert _plan(got).startswith("Union")  # pairs of callees with one name are never made distinct
    want = {(a, b) for a, n in sites for b, m in definitions if n and n == m and a is not None and b is not None and a != b}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _shuffled(spark, since=-1):
    """(last stage, rows that stages after ``since`` wrote for shuffles)."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, *none)
    stages = [stages.apply(i) for i in range(stages.size())]
    return max((x.stageId() for x in stages), default=-1), sum(x.shuffleWriteRecords() for x in stages if x.stageId() > since)


def test_hot_names_move_arrays_and_not_a_copy_for_each_task(spark, monkeypatch):
    for name, value in (("DEALT", 36), ("RUN", 4), ("SOME", 3)):
        monkeypatch.setattr(R, name, value)
    sites = spark.createDataFrame([(i, "ab"[i % 20 == 0]) for i in range(80)], "caller int, name string")
    definitions = spark.createDataFrame([(i, "a") for i in range(90)] + [(7, "b"), (300, "b")], "callee int, name string")
    since, _ = _shuffled(spark)
    got = sorted(map(tuple, R.resolve_call_sites(sites, definitions, []).collect()))
    assert _shuffled(spark, since)[1] < 2500
    want = {(i, j) for i in range(80) for j in ((7, 300) if i % 20 == 0 else range(90)) if i != j}
    assert got == sorted(want)


def test_supplemental_edges_share_no_edge(spark):
    sites, definitions, s, d = _names(spark, 2)
    exact, known = [(0, 3), (0, 3), (1, 1), (2, 99), (5, 4), (None, 4)], [(x,) for x in range(10)] * 2
    got = R.supplemental_edges(spark.createDataFrame(exact, "caller int, callee int"), d, s, spark.createDataFrame(known, "callee int"))
    assert _plan(got).startswith("Union")
    named = {(a, b) for a, n in sites for b, m in definitions if n and n == m and a is not None and b is not None}
    want = {(a, b) for a, b in named | set(exact) if a is not None and b in range(10) and a != b}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_dual_key_makes_no_pair_twice(spark):
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("a",), ("a_1",), ("a_1",), ("b_2",), ("c",), (None,)], "name string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b_2"), (4, None)], "item int, k string")
    got = R.dual_key(names, "name", items, "item", F.array("k", F.concat("k", F.lit("_1")), "k"))
    assert _plan(got).startswith("Union")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a_1", 1), ("b_2", 3)]


def _odd_sources(rng):
    """Texts of parts that go on over lines and from part to part; some have no brace behind which they can be cut."""
    cpp = ["class C%d : B {\n int f(int x) const {\n  if (x) { g(\"}{\"); } // {\n }\n};\n", "int v%d[] = {1, 2};\n", "X::X(int a) : a_{a}, b_{%d} { }\n", "/* }\n}\n */ int h%d(int x)\n{ return 0; }\n", "# define M {\r\n", "struct S%d { int v; } s = { 1 };\n", "auto r%d = R\"(\n}} /* )\";\n", "s = \"open\n", "f(]\n"]
    ts = ["namespace N%d {\n export function inner(x: number, o = {}): number {\n  const s = `}\n} ${x}`\n }\n}\n", "export const a%d = async (x) => {\n  /[{]/.test(x)\n  const y = x\n}\n", "x = [\n /}/g, {a: %d}]\n", "class W { m() { if (a) { b() } } }\n"]
    text = lambda forms, n: "".join(f.replace("%d", str(i)) for i, f in enumerate(rng.choices(forms, k=n)))
    return [(f"{k}{i}", lang, text(forms, 25)) for i in range(8) for k, lang, forms in (("a", "cpp", cpp), ("b", "typescript", ts))] + [("flat", "c", "int x = {1};\n" * 30), ("end", "java", "class A { void f() { } }\n\n// {" + "\n" * 9)]


def test_long_files_are_cut_and_read_alike(spark, monkeypatch):
    from siltstone.operators import syntax as S

    sources = spark.createDataFrame(_odd_sources(random.Random(7)), "path string, lang string, content string")
    columns = ["path", "at", "start", "end", "line", "last_line", "kind", "text", "depth", "bracket"]
    whole, scopes = sorted(map(tuple, S.tokens(sources).select(columns).collect())), sorted(map(str, S.scopes(sources).collect()))
    monkeypatch.setattr(S, "UNCUT", 5)
    monkeypatch.setattr(S, "CHUNK_LINES", 2)
    cut = S.tokens(sources, cut=True)
    assert sorted(map(tuple, cut.select(columns).collect())) == whole
    assert cut.select("path", "segment").distinct().count() > 60
    assert sorted(map(str, S.scopes(sources).collect())) == scopes


def test_blocks_by_statements_need_no_depths(spark, monkeypatch):
    from siltstone.operators import syntax as S

    statement = "  if (x) {\n    y('}'); // {\n  }\n"
    rows = [(f"s{i}", "c", "int f(int x) {\n" + statement * 9 + "}") for i in range(3)] + [("u", "c", "int f(int x) {\n" + statement * 9 + "  f(]\n}"), ("g", "go", "func f() {\n" + "\tx()\n" * 30 + "}"), ("n", None, "x\n" * 30)]
    read, depths = set(), S._depth_ends
    monkeypatch.setattr(S, "_depth_ends", lambda code: (read.update(r[0] for r in code.select("path").distinct().collect()), depths(code))[1])
    got = S.split_blocks(spark.createDataFrame(rows, "path string, lang string, content string"), 10)
    assert read == {"u", "g"}
    blocks = {p: sorted((r["first"], r["last"]) for r in got.collect() if r["path"] == p) for p, _, _ in rows}
    assert blocks["s0"] == blocks["s1"] == [(0, 12), (13, 28)] and blocks["g"] == [(0, 10), (11, 21), (22, 31)]


def test_calls_keep_the_language_and_read_the_lines_once(spark):
    import __spark_entry__ as entry
    from siltstone.operators import syntax as S

    rows = [("f", "c", 'g(1); /* h( */ u8"k(1)"; R"(m())"; s(\n)'), ("f", "rust", 'r"q()"; t::<u8>(1); b"v("; { w() }'), ("f", "c", "g(2)"), ("n", "c", None)]
    got = S.call_sites(spark.createDataFrame(rows, "caller string, lang string, content string"), "lang")
    assert sorted(map(tuple, got.collect())) == [("f", "c", "g"), ("f", "c", "s"), ("f", "rust", "t"), ("f", "rust", "w")]
    plan = _plan(entry.queries()["calls_by_language"](spark, "/root/testdata/sf0.001"))
    assert plan.count("l_linenumber") and plan.count("Relation [l_orderkey") == 1


def test_chains_of_small_pieces_need_no_rounds(spark, monkeypatch):
    from siltstone.operators import graph as G

    rng = random.Random(3)
    edges = [(f"{p}:{rng.randrange(9)}", f"{p}:{rng.randrange(9)}") for p in range(40) for _ in range(12)] + [("line:%d" % i, "line:%d" % (i + 1)) for i in range(60)] + [(None, "0:1")]
    nodes = sorted({x for e in edges for x in e if x})
    starts, ends = [(x,) for x in nodes if x[-1] in "01"] + [("away",), (None,)], [(x,) for x in nodes if x[-1] in "57"] + [("0:1",)]

    def reach(pairs, seen):
        while new := {b for a, b in pairs if a in seen} - seen:
            seen = seen | new
        return seen

    real = {(a, b) for a, b in edges if a and b and a != b}
    forward = reach(real, {x for (x,) in starts})
    both = forward & reach({(b, a) for a, b in real}, {x for (x,) in ends} & forward)
    want = sorted((a, b) for a, b in real if (a,) not in ends and a in both and b in both)
    assert len(want) > 50
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = table(edges, "src string, dst string"), table(starts, "node string"), table(ends, "node string")
    rounds, ran = G._chain_rounds, []
    monkeypatch.setattr(G, "_chain_rounds", lambda *a: ran.append(1) or rounds(*a))
    assert sorted(map(tuple, G.chains(*args).collect())) == want and not ran
    monkeypatch.setattr(G, "LOCAL", 11)
    assert sorted(map(tuple, G.chains(*args).collect())) == want and ran
    assert G.chains(args[0].filter("false"), *args[1:]).collect() == []


def test_overlaps_are_counted_where_the_document_is(spark, monkeypatch):
    import __spark_entry__ as entry
    from siltstone.plans import texts

    monkeypatch.setattr(texts, "DEALT", 20)
    plan = _plan(entry.queries()["overlap_score"](spark, "/root/testdata/sf0.001"), "executedPlan")
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(item_id#" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(item_id" in x and "doc_id" in x]  # pairs aren't shuffled
