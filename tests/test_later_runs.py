"""Relevance, later runs and stages: literal cases, and brute force on sources of their own."""

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siltstone.functions import artifacts as A
from siltstone.functions import text as T
from siltstone.operators import incremental as I
from siltstone.operators import relevance as V
from siltstone.plans.stages import Stages, spec_update_rules, validated

INTENT = """It fails in load_disk
 with `py:class Reader.open_all` and

```
def parse_header(x)
```
DiskReader.load_all raises a TimeoutError, the mmap_cache écrit long paragraps."""

SOURCE = '''
class DiskReader:
    """Keeps the cache."""
    def load_all(self, path):
        for p in path:
            load_disk(p)

    def close(self):
        raise IOError("paragraphs")

def load_disk(p):
    try:
        return p.mmap_cache
    except errors.TimeoutError:
        return None

def paragraphs(x):
    return x
'''


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_signals(spark):
    s = V.signals(INTENT)
    assert s["traceback"] == ["load_disk"]
    assert s["quoted"] == ["open_all", "parse_header", "reader"]  # 'def' is noise
    assert s["dotted"] == ["all", "load", "load_all", "open", "open_all"] and s["dotted_class"] == ["diskreader", "reader"]
    assert {"mmap_cache", "mmap", "cache", "diskreader", "disk", "reader", "load_disk", "timeouterror"} <= set(s["plain"])
    assert s["exception"] == ["timeouterror"]
    assert "with" not in s["prose"] and "crit" not in s["prose"] and {"fails", "raises", "long", "paragraps"} <= set(s["prose"])
    for text in (INTENT, "", "`` ` ``", "in x\nin X\n A.b_c"):
        row = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in V.tier_columns(F.col("t")).items())).first()
        assert {k: sorted(row[k]) for k in row.asDict()} == V.signals(text)


def test_name_parts_agree(spark):
    names = ["dmp_clear_denoms", "_parse_annotation", "DiskReader", "loadAll_x", "a", "", "__init__"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", V.name_parts(F.col("n")).alias("p")).collect()
    assert {r.n: sorted(r.p) for r in got} == {n: sorted(T.name_parts(n)) for n in names}
    assert set(T.name_parts("_parse_annotation")) == {"parse", "annotation", "parse_annotation", "_parse_annotation"}


def brute(functions, classes, intent):
    """The whole score by loops over pairs of functions."""
    s = {k: list(v) for k, v in V.signals(intent).items()}
    base = []
    for f in functions:
        parts = set(T.name_parts(f["name"]))
        x = 10 * sum(w in parts for w in s["traceback"]) + 5 * len(parts & set(s["quoted"])) + 2 * len(set(f["idents"]) & set(s["quoted"]))
        x += 15 * len(parts & set(s["dotted"])) + 3 * len(parts & set(s["plain"])) + 1.5 * len({p for p in parts if len(p) > 4} & set(s["prose"]))
        x += 4 * len(set(f["exceptions"]) & set(s["exception"])) + len(set(f["words"]) & set(s["prose"])) / (f["last"] - f["first"] + 1) ** 0.5
        idle = set(V.STOP) | set(V.NOISE)
        wanted = {w for k in ("quoted", "plain", "dotted", "prose") for w in s[k] if len(w) > 4} - idle
        own = {p for p in parts if len(p) > 4} - idle
        for w in wanted - own:
            best = max((SequenceMatcher(None, w, p).ratio() for p in own - wanted), default=0)
            x += 1.4 * best if best >= 0.75 else 0
        base.append(x)
    total = list(base)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            total[j] += 0.3 * base[i] * (g["name"] in f["calls"]) + 0.2 * base[i] * (f["name"] in g["calls"])
    for c in classes:
        parts = set(T.name_parts(c["name"]))
        doc = {w for w in T._prose(c["docstring"])}
        y = 5 * len(parts & set(s["quoted"])) + 6 * len(parts & set(s["plain"])) + 6 * len(parts & set(s["prose"])) + 15 * len(parts & set(s["dotted_class"])) + 2 * len(doc & set(s["prose"]))
        for i, f in enumerate(functions):
            total[i] += min(0.4 * y, 8) * (f["first"] in c["method_lines"])
    return {f["name"]: round(x, 3) for f, x in zip(functions, total, strict=True)}


def test_ranking_equals_brute_force(spark):
    sources = spark.createDataFrame([("a.py", "python", SOURCE), ("e.py", "python", "x = 1"), ("n.py", "python", None)], "path string, lang string, content string")
    want = brute(T.python_signals(SOURCE), T.python_classes(SOURCE), INTENT)
    got = V.ranked(T.signals_of(sources), T.classes_of(sources), INTENT, 3).orderBy("rank").collect()
    assert [(r.name, r.score) for r in got] == sorted(want.items(), key=lambda x: -x[1])[:3]
    assert V.ranked(T.signals_of(sources), T.classes_of(sources), "", 9).agg(F.max("score")).first()[0] == 0


def test_source_signals():
    s = {f["name"]: f for f in T.python_signals(SOURCE)}
    assert s["load_disk"]["exceptions"] == ["timeouterror"] and "mmap_cache" in s["load_disk"]["idents"] and "p" in s["load_disk"]["idents"]
    assert s["close"]["exceptions"] == ["ioerror"] and "paragraphs" in s["close"]["idents"] and s["load_all"]["calls"] == ["load_disk"]
    assert T.python_classes(SOURCE) == [{"name": "DiskReader", "docstring": "Keeps the cache.", "method_lines": [4, 8]}]


def test_paths_of_artifacts(spark):
    f = lambda c, p: one(spark, c(F.col("p")), p=p)
    assert f(A.identity, "/x/fm/extracted_functions/src/a-py/f.py") == "src/a-py/f.py" and f(A.identity, "src/a.py") is None
    assert f(A.source_of, "C:\\w\\extracted_functions\\src\\a-py\\f.py") == "src/a.py" and f(A.source_of, "/src/a-cpp/C/f.cpp") == "src/a.cpp"
    assert f(A.source_of, "src/a.py") == "src/a.py" and f(A.source_of, "my-dir/f.py") == "my-dir/f.py" and f(A.source_of, None) == ""
    assert f(A.is_sidecar, "f.py.spec.json") is True and f(A.is_sidecar, "f.json") is False
    stored = spark.createDataFrame([("/a/extracted_functions/m-py/f.py", 1), ("other", 2)], "function string, n int")
    now = spark.createDataFrame([("w/extracted_functions/m-py/f.py",)], "function string")
    assert sorted(map(tuple, I.rebind(stored, now).collect())) == [("other", 2), ("w/extracted_functions/m-py/f.py", 1)]


def test_texts_of_specifications(spark):
    spec = one(spark, A.spec_text(F.lit("f()"), F.lit("x > 0"), F.lit(None)))
    assert spec == "f()\n\nPre-condition:\nx > 0\n\nPost-condition:\n"
    assert tuple(one(spark, A.conditions(F.col("s")), s=spec + "y\nz ")) == ("x > 0", "y\nz")
    assert tuple(one(spark, A.conditions(F.col("s")), s="nothing")) == (None, None)
    info = json.dumps({"callees": [{"name": "a", "signature": "a()", "pre_condition": "p", "post_condition": "q"}, 3, {"name": "b", "signature": "b()"}, {"name": "a", "signature": "a2()", "x": 1}]})
    clean = A.supported_info(F.col("s"))
    assert [c["name"] for c in one(spark, clean, s=info)] == ["a", "b", "a"] and one(spark, clean, s="{}") == []
    assert one(spark, A.info_text(clean), s=info) == "a2()\nPre-condition: \nPost-condition: \n\nb()\nPre-condition: \nPost-condition: "
    assert tuple(one(spark, A.supported_spec(F.col("s")), s='{"signature": "f", "other": 1}')) == ("f", "", "")


def test_gaps(spark):
    text = "Statements triggering the violation:\n a = 1\n\nPost-condition:\nb\n\nReason for violation:\n c\nd "
    r = one(spark, A.gaps(F.col("t"), F.lit("claim")), t=text)
    assert r["verdict"] == "MISMATCH" and tuple(r["gaps"]) == ("claim", "b", "a = 1", "c\nd")
    assert tuple(one(spark, A.gaps(F.col("t"), F.lit(None)), t="odd")["gaps"]) == ("", "", "", "")
    assert one(spark, A.gaps(F.col("t"), F.lit("c")), t="Failed to parse")["error"] == "Failed to parse"
    listed = F.from_json(F.lit('[{"statements": "s", "reason": "r"}]'), "array<struct<statements:string,post_condition:string,reason:string>>")
    assert [tuple(g) for g in one(spark, A.gaps_of(listed, F.lit("c")))] == [("c", "", "s", "r")]
    cases = [("MATCH", True, 0, "MATCH"), ("MISMATCH", True, 2, "MISMATCH"), ("MATCH", False, 0, "ERROR"), ("MISMATCH", True, 0, "ERROR"), ("ERROR", True, 1, "ERROR")]
    got = spark.createDataFrame(cases, "s string, d boolean, n int, w string").select("w", A.all_bugs_verdict(F.col("s"), F.col("d"), F.col("n")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_small_columns(spark):
    df = spark.createDataFrame([({"k": ["é1", None]}, "ü")], "m map<string, array<string>>, s string")
    m, s = df.select(*(A.ascii_nested(F.col(f.name), f.dataType) for f in df.schema.fields)).first()
    assert m == {"k": ["1", None]} and s == ""
    merge = lambda a, b: one(spark, A.merged_description(F.lit(a), F.lit(b)))
    assert [merge("abc", " b "), merge("abc", None), merge("", "x"), merge("abc", "x")] == ["abc", "abc", "x", "abc\n\nx"]
    ranges = [one(spark, A.layer_range(F.col("t"), F.lit(5)), t=t) for t in ("3", " 1 - 4", "4-1", "0-5", "x", "99999999999")]
    assert [r and tuple(r) for r in ranges] == [(3, 3), (1, 4), None, None, None, None]
    assert one(spark, A.zipped(F.array(F.lit(".PY"), F.lit("c"), F.lit("py")), F.array(F.lit("a"), F.lit("b"), F.lit("p"), F.lit("q")))) == {"c": "b", "py": "p"}
    assert [one(spark, A.is_http_error(F.col("s")), s=x) for x in ("200", "500", "", None)] == [False, True, False, False]


def test_later_runs(spark):
    make = spark.createDataFrame
    files = make([("a.py",), ("b.erl",), ("c.txt",), ("tests/d.py",), ("d/e.py",)], "path string")
    counted = make([("a.py", 3), ("tests/d.py", 2), ("d/e.py", 1)], "path string, n int")
    assert {r.reason: (r.files, r.functions, r.uncounted) for r in I.counts(files, counted, []).collect()} == {None: (4, 4, ["b.erl"]), "test file": (1, 2, [])}
    ready = make([("src/f.py", True), ("src/f.py.spec.json", None), ("x/g.py", False)], "path string, ready boolean")
    assert [I.run_complete(ready, "ready", s).first()[0] for s in ([], ["src"], ["none"])] == [False, True, False]
    names = make([("engine_overview.txt",), ("phase_01_types.txt",)], "name string")
    assert [I.context_complete(make(p, "phase int"), names).first()[0] for p in ([(1,)], [(1,), (2,)], [(None,)])] == [True, False, False]
    order = I.topdown(make([(n,) for n in "zabc"], "name string"), make([("a", 2, 0, 0), ("b", 1, 1, 5), ("c", 1, 1, 4), ("c", 3, 0, 0)], "name string, phase int, layer int, position int"))
    assert [r.name for r in order.collect()] == ["c", "b", "a", "z"]
    moved = I.renamed(make([(1,), (2,), (3,)], "old_phase int"), make([(2, 1), (3, 2)], "old int, phase int"), "phase_%02d_types.txt")
    assert {(r.old, r.new) for r in moved.collect()} == {("phase_01_types.txt", None), ("phase_02_types.txt", "phase_01_types.txt"), ("phase_03_types.txt", "phase_02_types.txt")}
    results = make([("a", "MATCH"), ("b", None), ("c", "MATCH")], "path string, verdict string")
    left = I.to_resume(make([(x,) for x in "abcda"], "path string"), results, F.col("verdict").isNotNull(), make([("c",)], "path string"))
    assert sorted(r.path for r in left.collect()) == ["b", "c", "d"]
    match = I.first_match(make([("i",), ("j",)], "id string"), make([("i", "late", 2), ("i", "early", 1)], "id string, symbol string, n int"), "n")
    assert sorted(map(tuple, match.collect())) == [("i", "early"), ("j", None)]


def test_stages(spark):
    add = lambda n: lambda df: df.withColumn("n", F.col("n") + n)
    df = spark.createDataFrame([(0,)], "n int")
    assert Stages(a=add(1), b=add(10)).run(df).first()[0] == 11
    s = Stages(a=add(1), b=add(10), c=add(100)).register("a", "pass").register("b", "replace", add(20)).register("b", "modify", add(3))
    assert s.run(df).first()[0] == 123
    for stage, mode, hook in (("x", "pass", None), ("c", "keep", None), ("c", "modify", None), ("a", "replace", add(1))):
        with pytest.raises(ValueError):
            s.register(stage, mode, hook)
    with pytest.raises(TypeError):
        s.register("c", "modify", lambda a, b: a)
    with pytest.raises(TypeError):
        Stages(a=lambda df: None).run(df)


def test_rules_of_updates(spark):
    good = {"spec_updated": False, "new_spec": None, "info_updated": True, "new_info": {}, "updated_callees": ["a"]}
    cases = [(good, None), ([], "must be an object"), ({}, "missing fields"), (good | {"spec_updated": 1}, "flags must be booleans"), (good | {"updated_callees": [" "]}, "updated_callees must be an array of texts"), (good | {"spec_updated": True}, "new_spec must be an object"), (good | {"new_info": None}, "new_info must be an object")]
    df = spark.createDataFrame([(json.dumps(c), w) for c, w in cases], "j string, want string").withColumn("v", F.parse_json("j"))
    for r in validated(df, spec_update_rules("v")).select("j", "want", "error").collect():
        assert r.want == r.error, r
