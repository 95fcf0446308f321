"""Small literal cases with results derived by hand."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import aggregates as A
from siltstone.operators import graph as G
from siltstone.operators import ordered as O
from siltstone.operators import plan_rules as P
from siltstone.operators import relations as R
from siltstone.operators import reports as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_history_keeps_the_last_record_at_the_first_place(spark):
    df = spark.createDataFrame([(0, "r1", "v1"), (1, "r2", "v"), (2, "r1", "v2"), (3, None, "x"), (4, "", "y")], "i int, id string, v string")
    assert rows(A.last_wins(df, ["id"], ["i"], ["v"])) == [("r1", "v2", 0), ("r2", "v", 1)]


def test_ranges(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("b", 200.0)], "g string, v double")
    assert rows(A.historical_range(df, ["g"], "v")) == [("a", 1, 75.0, 125.0), ("b", 2, 90.0, 220.0)]
    whole = spark.createDataFrame([("a", 3000), ("z", 0)], "g string, v long")
    assert [(r["g"], int(r["low"]), int(r["high"])) for r in A.historical_range(whole, ["g"], "v", True).orderBy("g").collect()] == [("a", 2250, 3750), ("z", 0, 1)]


def test_scale(spark):
    df = spark.createDataFrame([(100, 5, 1, 1), (0, 5, 3, 2), (0, 0, 0, 0)], "t long, s long, tf long, sf long")
    assert [r[0] for r in df.select(A.scale_factor(*map(F.col, ("t", "s", "tf", "sf")))).collect()] == [10.0, 1.5, 1.0]


def test_prefixes(spark):
    df = spark.createDataFrame([(p,) for p in (".", "a", "a/b", "ab", "x/y/z", "x/y")], "path string")
    assert rows(A.minimal_prefixes(df, "path")) == [(".",), ("a",), ("ab",), ("x/y",)]


def test_edge_merge(spark):
    df = spark.createDataFrame([("c", "d", 0, "s1", "x"), ("c", "d", 1, "s2", "y"), ("c", "d", 2, "s2", "y"), ("c", "d", 3, "s2", "z")], "a string, b string, i int, source string, n string")
    assert rows(A.merge_edges(df, ["a", "b"], "i", "source", "n")) == [("c", "d", "s1", ["x", "y", "z"])]


def test_dedupe_keeps_rows_without_place(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", None)], "c string, line int")
    assert A.dedupe_located(df, ["c", "line"], F.col("line") > 0).count() == 3


def test_outcomes_read_not_first(spark):
    r = spark.createDataFrame([("k", "not_confirmed"), ("k", "Confirmed"), ("k", "error")], "k string, s string")
    c = spark.createDataFrame([("k",)] * 5 + [("q",)], "k string")
    assert rows(A.outcome_counts(r, c, "k", "s")) == [("k", 1, 2, 2), ("q", 0, 0, 1)]


def test_renumber_over_ranges(spark):
    df = spark.range(1000).filter("id % 3 <> 0").repartition(5)
    got = O.renumber(df, "id").orderBy("id").collect()
    assert [r["number"] for r in got] == list(range(1, len(got) + 1))


def test_blocks(spark):
    df = spark.createDataFrame([(n,) for n in (1, 40, 60, 80, 81, 200)], "n int")
    assert [r[0] for r in df.select(O.block_sizes(F.col("n"), 40)).collect()] == [[1], [40], [60], [80], [40, 41], [40, 40, 40, 80]]


def test_rank_merge(spark):
    chosen = spark.createDataFrame([("f", "b", 0), ("f", "z", 1)], "file string, name string, place int")
    ranked = spark.createDataFrame([("f", "a", 0), ("f", "b", 1), ("f", "c", 2)], "file string, name string, place int")
    assert rows(O.rank_merge(chosen, ranked, "file", "name", 3)) == [("f", "a", 3), ("f", "b", 1), ("f", "z", 2)]


def test_diff_is_empty_on_itself_and_mirrors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert rows(R.revision_diff(a, a, ["k"], F.col("v"))) == []
    assert rows(R.revision_diff(a, b, ["k"], F.col("v"))) == [(1, "removed"), (2, "modified"), (4, "added")]
    assert rows(R.revision_diff(b, a, ["k"], F.col("v"))) == [(1, "added"), (2, "modified"), (4, "removed")]


def test_pending(spark):
    c = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    v = spark.createDataFrame([("c1", "confirmed", 1), ("c2", "confirmed", 0), ("z", "error", 1)], "id string, status string, attempts int")
    got = R.pending_rows(c, v, "id", "status", F.col("attempts") > 0)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("c1", "confirmed", None), ("c2", "pending", "invalid_result"), ("c3", "pending", "missing_or_invalid_result")]
    assert S.summary(got).first().asDict() == {"total_reported": 3, "total_confirmed": 1, "total_not_confirmed": 0, "total_error": 0, "total_pending": 2}


def test_ordered_coverage(spark):
    table = lambda rows: spark.createDataFrame([(p, i, n, b) for p, items in rows.items() for i, (n, b) in enumerate(items)], "path string, at int, ident string, body string")
    ours = [("A::f_1", "1\r\n"), ("g", "2"), ("B.h", "3"), ("f", "1\n"), ("n", None)]
    got = R.ordered_coverage(
        table({"in": ours, "out": ours, "twice": ours, "thrice": ours, "body": ours, "alone": ours, "null": ours}),
        table({"in": [("f", "1\n"), ("x::h_2", "3")], "out": [("h", "3"), ("g", "2")], "twice": [("f", "1\n"), ("f", "1\n")], "thrice": [("f", "1\n")] * 3, "body": [("g", "3")], "gone": [("f", "1")], "null": [("n", None)]}),
    )
    assert rows(got) == [("alone", True), ("body", False), ("gone", False), ("in", True), ("null", True), ("out", False), ("thrice", False), ("twice", True)]


def test_ordered_coverage_equals_two_pointers(spark):
    rnd, left, right, want = random.Random(4), [], [], []
    for path in range(60):
        ours = [rnd.choice("abc") for _ in range(rnd.randrange(12))]
        theirs = [x for x in ours if rnd.random() < 0.5] if path % 2 else [rnd.choice("abc") for _ in range(rnd.randrange(5))]
        left += [(path, i, x, "b") for i, x in enumerate(ours)]
        right += [(path, i, x, "b") for i, x in enumerate(theirs)]
        it = iter(ours)
        if ours or theirs:
            want.append((path, all(any(x == y for x in it) for y in theirs)))
    schema = "path int, at int, ident string, body string"
    assert rows(R.ordered_coverage(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))) == want


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f")]


def graph(spark, edges, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")


def test_layers(spark):
    nodes, edges = graph(spark, EDGES, "abcdefg")
    want = [("a", 0, False), ("b", 1, False), ("c", 1, False), ("d", 2, True), ("e", 2, True), ("f", 3, False), ("g", 0, False)]
    assert rows(G.layers(nodes, edges)) == want


def test_reach_and_chains(spark):
    nodes, edges = graph(spark, EDGES, "abcdefg")
    assert "".join(sorted(r[0] for r in G.reachable(edges, nodes.filter("node = 'a'")).collect())) == "abcdef"
    got = rows(G.chains(edges, nodes.filter("node = 'a'"), nodes.filter("node = 'd'")))
    assert sorted((r.src, r.dst) for r in G.chains(edges, nodes.filter("node = 'a'"), nodes.filter("node = 'd'")).collect()) == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("e", "d")] or got == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    assert G.chains(edges, nodes.filter("node = 'a'"), nodes.filter("node = 'g'")).isEmpty()


def test_strong_components_against_closure(spark):
    rnd = random.Random(1)
    names = [f"n{i}" for i in range(12)]
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(18)})
    reach = {a: {a} for a in names}
    for _ in names:
        for a, b in edges:
            for x in names:
                if a in reach[x]:
                    reach[x] |= reach[b]
    want = [(a, min(b for b in names if b in reach[a] and a in reach[b])) for a in sorted(names)]
    assert rows(G.strong_components(*graph(spark, edges, names))) == want


def test_pieces_in_one_task_equal_rounds(spark, monkeypatch):
    """One piece has a cycle, what leads to it and what follows, one has no cycle; both go by rounds with the limit of 3."""
    cyclic = [("a1", "a0"), ("a0", "a2"), ("a2", "a3"), ("a3", "a2"), ("a3", "a4"), ("gone", "a1"), (None, "a0")]
    nodes, edges = graph(spark, [*cyclic, ("b0", "b1"), ("b1", "b2"), ("b0", "b2"), ("b3", "b2"), ("c0", "c1")], ["a0", "a1", "a2", "a3", "a4", "b0", "b1", "b2", "b3", "c0", "c1", "d0"])
    want = [("a0", 1, False), ("a1", 0, False), ("a2", 3, True), ("a3", 3, True), ("a4", 4, False), ("b0", 0, False), ("b1", 1, False), ("b2", 2, False), ("b3", 0, False), ("c0", 0, False), ("c1", 1, False), ("d0", 0, False)]
    assert rows(G.layers(nodes, edges)) == want
    monkeypatch.setattr(G, "LOCAL", 3)
    assert rows(G.layers(nodes, edges)) == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    times = []
    monkeypatch.setattr(G, "written", lambda df, name, write=G.written: times.append(name) or write(df, name))
    nodes, edges = graph(spark, [(f"{i:03}", f"{i + 1:03}") for i in range(99)], [f"{i:03}" for i in range(100)])
    assert rows(G.longest_path(nodes, edges)) == [(f"{i:03}", i) for i in range(100)]
    assert len(times) < 50
    with pytest.raises(ValueError, match="cycle"):
        G.longest_path(nodes, edges.union(edges.selectExpr("'099'", "'000'")))


def test_frontier(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "a"), ("b", "c")], "abc")
    assert rows(G.frontier(nodes, edges, ["node"])) == [("a",)]
    assert rows(G.frontier_rounds(nodes, edges, ["node"])) == [("a", 0), ("b", 1), ("c", 2)]


def test_plan_rules(spark):
    plan = spark.createDataFrame([(1, "m", 0, "a.py"), (2, "m", 0, "a.py"), (3, "m", 0, "b.py")], "phase int, module string, at int, path string")
    phases = spark.createDataFrame([(1, []), (2, []), (3, [1, 2])], "phase int, depends_on_phases array<int>")
    owned = P.one_owner(plan)
    assert sorted((r.phase, r.path) for r in owned.collect()) == [(1, "a.py"), (3, "b.py")]
    assert rows(P.compacted(phases, owned)) == [(1, 1, []), (2, 3, [1])]
    kept, removed = P.in_scope(plan.withColumn("path", F.concat(F.lit("src/"), "path")), ["src/a.py"])
    assert kept.count() == 2 and rows(removed) == [(3, "m", "src/b.py")]
    faults = P.coverage_faults(plan, spark.createDataFrame([("a.py",), ("c.py",)], "path string"), [])
    assert rows(faults) == [("b.py", "missing"), ("c.py", "not listed")]


def test_plan_violations(spark):
    def messages(*plans):
        got = P.violations(spark.createDataFrame(list(enumerate(plans)), "plan int, json string"))
        return [r["message"] for r in got.orderBy("plan", "at").collect()]

    assert messages('{"phases": [{"modules": [{"source_files": ["a"]}]}]}', '{"phases": []}') == []
    assert messages('{"phases": 3}', "{}", "[1]", "7", "no", None) == ['top-level field "phases" must be an array'] * 2 + ["the top-level value must be an object"] * 2 + ["phases.json is not valid JSON"] * 2
    assert messages('{"phases": [{"modules": [{"source_files": [1, "a", null]}, {}, {"source_files": null}]}, {}, 4, {"modules": ["x"]}]}') == [
        "phases[0].modules[0].source_files[0] must be a string", "phases[0].modules[0].source_files[2] must be a string", "phases[0].modules[1].source_files is missing", "phases[0].modules[2].source_files must be an array",
        "phases[1].modules must be an array", "phases[2] must be an object", "phases[3].modules[0] must be an object",
    ]
    names = ['"it\'s"', '"a\\\\b"', '""', "0", "5", "true"]
    assert messages(*(f'{{"phases": [{{"modules": [{{"name": {n}}}]}}]}}' for n in names)) == [
        f"phases[0].modules[0]{x}.source_files is missing" for x in (' ("it\'s")', " ('a\\\\b')", "", "", " (5)", " (True)")
    ]


def test_complete_results(spark):
    v = spark.createDataFrame([("f", "MISMATCH", True, 2, True), ("g", "MISMATCH", True, 2, True), ("h", "MISMATCH", True, 0, True), ("i", "MATCH", False, None, None)], "file string, verdict string, all_bugs boolean, bug_count int, reasoning_complete boolean")
    c = spark.createDataFrame([("f", 1, "a", "b", "c", "d"), ("f", 2, "a", "b", "c", "d"), ("g", 1, "a", "b", "c", "d"), ("g", 3, "a", "b", "c", "d")], "file string, n int, spec_claim string, actual_behavior string, code_evidence string, trigger_condition string")
    got = S.complete_results(v, c)
    assert [(r.file, r.complete) for r in got.orderBy("file").collect()] == [("f", True), ("g", False), ("h", False), ("i", True)]
    assert S.mismatches(v).first()[0] == 4
    left = S.incomplete(v.select("file"), got, spark.createDataFrame([("x",)], "file string"))
    assert rows(left) == [("f",), ("g",), ("h",)]


def test_report_order_and_filter(spark):
    items = spark.createDataFrame([("bug", "2", "pending", "T", "s.py", "f"), ("analysis", "1", "ERROR", "U", "s.py", "g"), ("analysis", "0", "MATCH", "V", "t.py", "h"), ("bug", "3", "odd", "W", "", "f")], "kind string, id string, status string, title string, source_file string, function_name string")
    assert [r.id for r in S.in_order(items).collect()] == ["0", "1", "2", "3"]
    assert [r.id for r in S.filtered(items, ["bug", "analysis"], text=" S.PY ").orderBy("id").collect()] == ["1", "2"]
    assert rows(S.options(items, "source_file")) == [("s.py",), ("t.py",)]
