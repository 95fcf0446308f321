"""The writer of function files under failures and repeats; histories rewritten at once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import function_files as W
from siltstone.sources import workspace


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, ident string, content string").repartition(3)


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8", newline="").read() for d, _, ns in os.walk(root) for n in ns}


ROWS = [("src/a.b.cpp", "N::C::f", "int f;\r\n"), ("src/a.b.cpp", "main_1", "é"), ("m.py", "operator/", None), ("src/x.go", "", "g"), ("noext", "f", "x")]


def test_files_by_function(spark, tmp_path):
    out = str(tmp_path / "out")
    W.write_function_files(table(spark, ROWS), out)
    want = {"src/a.b-cpp/N/C/f.cpp": "int f;\r\n", "src/a.b-cpp/main_1.cpp": "é", "m-py/operator_.py": "", "src/x-go/_function.go": "g", "noext/f.": "x"}
    assert tree(out) == want
    assert os.listdir(tmp_path) == ["out"]
    got = {r["file"]: r["content"] for r in W.read_function_files(spark, out).collect()}
    assert got == want
    W.write_function_files(table(spark, [("m.py", "g", "2")]), f"file://{out}", "append")
    assert tree(out) == want | {"m-py/g.py": "2"}
    W.write_function_files(table(spark, [("m.py", "g", "3")]), out)
    assert tree(out) == {"m-py/g.py": "3"}
    W.write_function_files(table(spark, ROWS).filter("false"), out)
    assert tree(out) == {}


def test_a_failed_write_leaves_the_old_tree(spark, tmp_path):
    out = str(tmp_path / "out")
    W.write_function_files(table(spark, [("m.py", "g", "old")]), out)
    for bad in ([*ROWS, ("../x.py", "../../f", "out")], [*ROWS, ("m.py", "operator_", "same file")], [(*ROWS[0][:2], "twice"), *ROWS]):
        with pytest.raises(Exception, match="not a file below|two functions|exists"):
            W.write_function_files(table(spark, bad), out)
        assert tree(out) == {"m-py/g.py": "old"}
        assert os.listdir(tmp_path) == ["out"]
    failing = table(spark, ROWS).withColumn("content", F.when(F.col("path") == "noext", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        W.write_function_files(failing, out)
    assert tree(out) == {"m-py/g.py": "old"}
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="mounted"):
        W.write_function_files(table(spark, ROWS), "s3a://bucket/x")


def test_an_attempt_that_ran_twice_counts_once(tmp_path):
    from pyspark.sql import Row

    writer = W.FunctionFilesWriter(str(tmp_path / "out"), True)
    lost = writer.write(iter([Row(file="a/f.c", content="1")]))
    kept = writer.write(iter([Row(file="a/f.c", content="1")]))
    assert lost.folder != kept.folder
    writer.commit([kept, None])
    assert tree(tmp_path / "out") == {"a/f.c": "1"}
    assert os.listdir(tmp_path) == ["out"]


def test_histories_are_rewritten(spark, tmp_path):
    def put(folder, *records):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / "history.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))

    put("analysis", {"run_id": "r1", "tokens": 1}, {"run_id": "r2", "tokens": 2}, {"run_id": "r1", "tokens": 3})
    put("analysis-old", {"run_id": "r0", "tokens": 9}, {"run_id": "r2", "tokens": 4})
    put("analysis-estimate", {"run_id": "e", "tokens": 0})
    put("other", {"run_id": "o", "tokens": 0})
    found = W.archived_histories(spark, str(tmp_path), apart="analysis-estimate")
    assert [p.split("/")[-2] for p in found] == ["analysis", "analysis-old"]
    own = found[0]
    assert W.rewrite_history(workspace.history(spark, *found), own) == 3
    rows = [(r["run_id"], r["tokens"]) for r in workspace.history(spark, own).orderBy("first__f", "first__i").collect()]
    assert rows == [("r1", 3), ("r2", 4), ("r0", 9)]
    assert W.rewrite_history(workspace.history(spark, own).filter("false"), own) == 0
    assert len(workspace.history(spark, own).collect()) == 3
    assert sorted(os.listdir(tmp_path / "analysis")) == ["history.jsonl"]
