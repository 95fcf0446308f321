"""Settings by layers, and writers of run records."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone import settings as S
from siltstone.sources import records as R


def test_layers(tmp_path):
    toml, env = tmp_path / "s.toml", tmp_path / ".env"
    toml.write_text("[runtime]\ngranularity = 30\nmax_workers = 3\n[scope]\ntop_k = 7\n")
    env.write_text("# x\nexport SILTSTONE_RUNTIME_MAX_WORKERS='4'\nSILTSTONE_SCOPE_TOP_K=8\nno value\n")
    got = S.load(str(toml), str(env), {"SILTSTONE_SCOPE_TOP_K": "9"})
    assert (got.runtime.granularity, got.runtime.max_workers, got.scope.top_k, got.runtime.max_spec_iter) == (30, 4, 9, 5)
    assert S.load(str(tmp_path / "none"), None, {}) == S.Settings()
    assert S.load(environment={"SILTSTONE_RUNTIME_BUG_VALIDATION_MAX_RETRIES": "0"}).runtime.bug_validation_max_retries == 0


@pytest.mark.parametrize("text", ["[runtime]\ngranularity = 0", "[runtime]\nx = 1", "[other]\nx = 1", "[runtime]\ngranularity = 'a'", "[runtime]\ngranularity = true", "[runtime]\ngranularity = 1.5"])
def test_wrong_settings(tmp_path, text):
    path = tmp_path / "s.toml"
    path.write_text(text)
    with pytest.raises(ValueError):
        S.load(str(path), None, {})


def test_payloads(spark, tmp_path):
    events = spark.createDataFrame([("e1",), ("e2",), ("e1",)], "event_id string")
    contents = spark.createDataFrame([("e1", "req.json", "a"), ("e2", "req.json", None), ("lost", "x", "b")], "event_id string, name string, content string")
    rows = R.payloads(events, contents)
    assert sorted(r.content_ref for r in rows.collect()) == ["payloads/e1_req.json", "payloads/e2_req.json"]
    place = str(tmp_path / "p")
    R.write_payloads(rows, place)
    R.write_payloads(rows.filter("event_id = 'e1'").withColumn("name", F.lit("resp.json")), place)
    assert sorted(r.name for r in R.read_payload(spark, place, "e1").collect()) == ["req.json", "resp.json"]
    plan = R.read_payload(spark, place, "e1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan


def test_file_list_and_versions(spark, tmp_path):
    files = spark.createDataFrame([("b.py",), ("a.py",), ("b.py",), ("b.py.info.json",)], "path string")
    assert [r.path for r in R.file_list(files).collect()] == ["a.py", "b.py"]
    R.write_file_list(files, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    place = str(tmp_path / "v")
    for v in ("c1", "", None, "c2"):
        R.append_version(spark, v, place)
    assert [r.version for r in R.versions(spark, place).collect()] == ["c1", "c2"]


def test_clearing(spark):
    keep = ["r/m-py/g.json", "r/m-py/f2.json", "r/m-py/f2.bug-001.json", "v/r--m-py--g.bug-001.result.json", "v/notes.md"]
    gone = ["r/m-py/f.json", "r/m-py/f.bug-001.json", "r/m-py/f.bug-012.json", "v/r--m-py--f.bug-001.result.json", "v/r--m-py--f.bug-001.md", "v/bug_validator_r--m-py--f.bug-002.md", "v/probe_r--m-py--f.bug-001.py"]
    artifacts = spark.createDataFrame([(p,) for p in keep + gone], "path string")
    targets = spark.createDataFrame([("r/m-py/f.json",)], "file string")
    assert sorted(r.path for r in R.cleared(artifacts, targets).collect()) == sorted(keep)
    assert R.cleared(artifacts, targets.limit(0)).count() == len(keep + gone)


def test_estimate(spark, tmp_path):
    good = {"schema_version": 2, "project": "p", "scope": {}, "analysis_stages": [], "estimate": {"low": 1}}
    for i, doc in enumerate((good, good | {"schema_version": 1}, good | {"scope": []}, good | {"project": None})):
        (tmp_path / f"e{i}.json").write_text(json.dumps(doc))
    at = datetime.datetime(2024, 1, 1, 12)
    os.utime(tmp_path / "e0.json", (at.timestamp(),) * 2)
    found = R.newer_estimate(spark, str(tmp_path), 2).collect()
    assert [(r.project, json.loads(r.estimate)) for r in found] == [("p", {"low": 1})]
    assert R.newer_estimate(spark, str(tmp_path), 2, found[0].modified - datetime.timedelta(seconds=5)).count() == 1
    assert R.newer_estimate(spark, str(tmp_path), 2, found[0].modified).count() == 0
