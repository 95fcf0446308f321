import json

from pyspark.sql import functions as F

from siltstone.session import Settings
from siltstone.sources import traces, tree, workspace
from siltstone.streaming import telemetry


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_source_tree(spark, tmp_path):
    root = tmp_path / "proj"
    put(root / "src/a.py", "def f():\n    return 1\n\ndef f():\n    return 2\n")
    put(root / "src/b.c", "int g(void) { return 0; }\n")
    put(root / "tests/t.py", "def t(): pass\n")
    put(root / "node_modules/x.js", "function q() {}\n")
    put(root / ".hidden/y.py", "def y(): pass\n")
    put(root / "README.txt", "no")
    put(root / "src/__init__.py", "")
    got = {r.path: (r.lang, r.included, r.reason) for r in tree.source_files(spark, str(root)).collect()}
    assert got == {"src/a.py": ("python", True, None), "src/b.c": ("c", True, None), "src/__init__.py": ("python", True, None), "tests/t.py": ("python", False, "test file")}
    assert [tuple(r) for r in tree.pruned_directories(spark, str(root)).collect()] == [(".hidden", ".hidden"), ("node_modules", "node_modules")]
    functions = tree.extract(spark, str(root))
    assert sorted(r.fqn for r in functions.collect()) == ["src::a-py::f", "src::a-py::f_1", "src::b-c::g"]
    assert tree.extraction_faults(functions).isEmpty()
    assert tree.has_sources(spark, str(root))
    assert tree.source_files(spark, str(root), ["src/b.c"]).filter("included").count() == 1
    backend = spark.createDataFrame([("src/a.py", "python", "only", 0, 1, "x")], "path string, lang string, ident string, start_idx int, end_idx int, body string")
    assert sorted(r.fqn for r in tree.extract(spark, str(root), backend=backend).collect()) == ["src::a-py::only", "src::b-c::g"]


def test_index(spark):
    nodes = spark.createDataFrame([(1, "method", "f", "C::f", "a.cpp", "cpp", 1, 2, 0), (2, "method", "f", "C::f", "a.cpp", "cpp", 3, 3, 0), (3, "class", "C", "C", "a.cpp", "cpp", 1, 9, 0), (4, "method", "C", "C::C", "a.cpp", "cpp", 4, 4, 0)], "id int, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int")
    texts = spark.createDataFrame([("a.cpp", "l1\nl2\nl3\nl4")], "path string, content string")
    f = tree.index_functions(nodes, texts)
    assert sorted((r.ident, r.body) for r in f.collect()) == [("C::C", "l4"), ("C::f", "l1\nl2"), ("C::f_1", "l3")]
    edges = spark.createDataFrame([(1, 2, "calls", 5, 1), (1, 2, "calls", 5, 1), (1, 2, "calls", 6, 1), (1, 3, "instantiates", None, 0), (3, 4, "contains", None, None), (1, 9, "calls", 7, 0)], "source int, target int, kind string, line int, col int")
    got = [(r.dst.split("::")[-1], r.kind, r.line) for r in tree.index_edges(nodes, edges, f).collect()]
    assert got == [("C", "constructor", 1), ("f_1", "call", 5), ("f_1", "call", 6)]
    assert tree.index_is_complete(spark.createDataFrame([("index_state", "complete")], "key string, value string"), nodes)


def test_workspace(spark, tmp_path):
    put(tmp_path / "plan.json", json.dumps({"phases": [{"phase": 1, "name": "p", "modules": [{"name": "m", "source_files": ["a.py", "b.py"]}]}]}))
    assert [(r.phase, r.module, r.path) for r in workspace.plan_files(spark, str(tmp_path / "plan.json")).orderBy("at").collect()] == [(1, "m", "a.py"), (1, "m", "b.py")]
    put(tmp_path / "res/a/f.json", json.dumps({"function": "f", "verdict": "MATCH"}))
    put(tmp_path / "res/a/f.bug-001.json", json.dumps({"function": "f", "verdict": "MISMATCH"}))
    put(tmp_path / "res/a/bad.json", "{")
    assert workspace.results(spark, str(tmp_path / "res")).count() == 1
    assert workspace.results(spark, str(tmp_path / "res"), True).count() == 1
    put(tmp_path / "edges/1.json", json.dumps({"edges": [{"caller": {"function": "src/a.c::f"}, "callee": {"function": "src/b.c::g", "info_names": ["x", "y"]}, "source": "s1"}, {"caller": {"function": "src/a.c::f"}, "callee": {"function": "src/b.c::g", "info_names": ["y", "z"]}, "source": "s2"}]}))
    merged = workspace.merged_call_edges(workspace.call_edges(spark, str(tmp_path / "edges"))).collect()
    assert [(r.caller, r.callee, r.names, r.source) for r in merged] == [("src::a-c::f", "src/b.c::g", ["x", "y", "z"], "s1")]
    put(tmp_path / "history.jsonl", "\n".join(json.dumps(x) for x in ({"run_id": "r1", "tokens": 1}, {"run_id": "r2", "tokens": 2}, {"run_id": "r1", "tokens": 3}, {"tokens": 9})) + "\n")
    assert [(r.run_id, r.tokens) for r in workspace.history(spark, str(tmp_path / "history.jsonl")).orderBy("first__f", "first__i").collect()] == [("r1", 3), ("r2", 2)]
    put(tmp_path / "version.log", "a\nb\n\n")
    assert workspace.last_version(spark, str(tmp_path / "version.log")) == "b"
    put(tmp_path / "k.md", "# K\n")
    assert workspace.knowledge(spark, [str(tmp_path / "k.md")] * 2) == "# K"


def test_documents_of_many_lines(spark, tmp_path):
    put(tmp_path / "v/f.json", json.dumps({"function": "f", "verdict": "MATCH", "all_bugs": False}, indent=2))
    put(tmp_path / "v/bad.json", "{\n")
    put(tmp_path / "k.md", "# a\n\nb\n")
    assert [(r.file.rpartition("/")[2], r.verdict) for r in workspace.results(spark, str(tmp_path / "v")).collect()] == [("f.json", "MATCH")]
    assert workspace.json_tree(spark, str(tmp_path / "v"), "*.json").count() == 2
    assert workspace.knowledge(spark, [str(tmp_path / "k.md")]) == "# a\n\nb"


def test_readiness(spark):
    f = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    ok = '{"signature":"f()","pre_condition":"","post_condition":"x"}'
    specs = spark.createDataFrame([("a", ok), ("b", ok), ("c", "{}"), ("d", ok)], "file string, json string")
    entry = '{"name":"g","signature":"","pre_condition":"","post_condition":""}'
    infos = spark.createDataFrame([("a", '{"callees":[%s]}' % entry), ("b", '{"callees":{}}'), ("c", '{"callees":[]}')], "file string, json string")
    assert [r.file for r in workspace.sidecar_ready(f, specs, infos).collect()] == ["a"]


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([("bug", "1", "error", "</script>&", "s", "f")], "kind string, id string, status string, title string, source_file string, function_name string")
    for name in "ab":
        workspace.write_report(items, str(tmp_path / name))
    page = (tmp_path / "a").read_text()
    assert page == (tmp_path / "b").read_text() and "</script>&" not in page
    layers = spark.createDataFrame([(1, 0, False, "b"), (1, 0, False, "a"), (1, 1, True, "c")], "phase int, layer int, cycle_resolution boolean, name string")
    assert json.loads(workspace.layer_documents(layers).first().json)["layers"][0]["functions"] == ["a", "b"]
    assert workspace.fingerprint(layers, "name", "layer") == workspace.fingerprint(layers.orderBy("name"), "name", "layer")
    workspace.write_json(str(tmp_path / "x.json"), {"a": 1})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1}


def test_tail(spark, tmp_path):
    f = tmp_path / "t/events.jsonl"
    put(f, '{"a": 1}\nbroken\n\n{"a": 2')
    tail = traces.Tail()
    assert tail.read(str(f)) == [{"a": 1}]
    with f.open("a") as out:
        out.write('}\n{"a": 3}\n')
    assert traces.Tail(tail.offsets).read(str(f)) == [{"a": 2}, {"a": 3}]
    put(f, '{"a": 4}\n')
    assert tail.read(str(f)) == [{"a": 4}]
    traces.tail_source(spark)
    stream = spark.readStream.format("jsonl_tail").option("path", str(f)).load().writeStream.format("memory").queryName("tailed").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert [r.value for r in spark.table("tailed").collect()] == ['{"a": 4}']


def test_traces(spark, tmp_path):
    put(tmp_path / "e.jsonl", json.dumps({"event_id": "1", "stage": "s", "start_time": "2024-01-01T00:00:00Z", "metadata": "{\"k\": 1}"}) + "\nnot json\n\n")
    assert [(r.event_id, str(r.start_time)) for r in traces.events(spark, str(tmp_path / "e.jsonl")).collect()] == [("1", "2024-01-01 00:00:00")]
    put(tmp_path / "a/x.jsonl", json.dumps({"*_kind": "response", "+_id": "7", "model": "v/m", "usage": "{\"input_tokens\": 3}"}) + "\n")
    r = traces.agent_records(spark, str(tmp_path / "a")).select("file", "kind", "id", "model").first()
    assert tuple(r) == ("x.jsonl", "response", "7", "v/m")
    usage = spark.createDataFrame([("v/m", 10, 1, 0, 0), ("q", 1, 1, 0, 0)], "model string, input long, output long, cache_read long, cache_write long")
    prices = spark.createDataFrame([("m", 0.5, 1.0, None, None)], "model string, input_cost_per_token double, output_cost_per_token double, cache_read_input_token_cost double, cache_creation_input_token_cost double")
    assert [(r.model, r.cost) for r in traces.priced(usage, prices).orderBy("model").collect()] == [("q", None), ("v/m", 6.0)]


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(20)], "event_id long, event_type string, value double")
    for k in range(2):
        df.filter(f"event_id % 2 = {k} or event_id < 4").repartition(2).write.mode("append").parquet(str(tmp_path / "s"))
    want = sorted(map(tuple, telemetry.counts(spark.read.parquet(str(tmp_path / "s"))).collect()))
    assert sorted(map(tuple, telemetry.drained_counts(spark, str(tmp_path / "s")).collect())) == want
    last = telemetry.last_n_per_batch(telemetry.event_stream(spark, str(tmp_path / "s")), ["event_id"], 3, "last")
    assert sorted(r.event_id for r in last.collect()) == sorted([19, 18, 17])


def test_request_matching_stream(spark, tmp_path):
    spark.createDataFrame([("f", "1", "request", 1.0, "m"), ("f", "1", "response", 2.0, None), ("f", "2", "response", 3.0, "n")], "file string, id string, kind string, at double, model string").write.parquet(str(tmp_path / "r"))
    got = telemetry.drain(telemetry.match_requests(telemetry.event_stream(spark, str(tmp_path / "r"))), "matched")
    assert sorted((r.id, r.model) for r in got.collect()) == [("1", "m"), ("2", "n")]


def test_watcher(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("x",)], "file string").write.parquet(str(tmp_path / "w"))
    seen = []
    done = telemetry.watch_ready(telemetry.event_stream(spark, str(tmp_path / "w")), spark.createDataFrame([("a",), ("b",)], "file string"), lambda df: seen.extend(r.file for r in df.collect()), "watch")
    assert done and sorted(seen) == ["a", "b"]


def test_settings():
    assert Settings.layered({"batch_size": 3}, {"batch_size": 5, "granularity": 10}) == Settings(granularity=10, batch_size=3)
    for bad in ({"batch_size": 0}, {"batch_size": True}, {"nope": 1}):
        try:
            Settings.layered(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
