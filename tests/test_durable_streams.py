"""Streams that are killed and started again, ticks over files that shrink, producers and consumers at once."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import durable as D


def name(what):
    return f"{what}-{uuid.uuid4().hex}"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def files(spark, path):
    return spark.readStream.schema("file string").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_watcher_goes_on_after_a_kill(spark, tmp_path):
    expected = spark.createDataFrame([(x,) for x in "abcde"], "file string")
    for batch in ("ab", "ac", "bd"):
        put(spark, tmp_path / "in", [(x,) for x in batch] + [("other",), (None,)], "file string")
    me, seen = name("watch"), []

    def once(df):
        rows = sorted(r.file for r in df.collect())
        if len(seen) == 1:
            seen.append("killed")
            raise RuntimeError("killed")
        seen.append(rows)

    with pytest.raises(Exception, match="killed"):
        D.watch_ready(files(spark, tmp_path / "in"), expected, once, me)
    assert D.watch_ready(files(spark, tmp_path / "in"), expected, once, me) is False
    assert [x for x in seen if x != "killed"] == [["a", "b"], ["c"], ["d"]]
    put(spark, tmp_path / "in", [("a",), ("e",)], "file string")
    assert D.watch_ready(files(spark, tmp_path / "in"), expected, once, me) is True
    assert seen[-1] == ["e"]
    assert sorted(r.file for r in D.handed(spark, me).collect()) == list("abcde")


REQUESTS = "file string, id string, kind string, at double, model string"


@pytest.mark.parametrize("forget", [None, 3600])
def test_requests_across_batches_and_restarts(spark, tmp_path, forget):
    me, batches = name("match"), [
        [("f", "1", "request", 1.0, "m"), ("f", "1", "response", 0.5, None), ("f", "2", "response", 3.0, "n")],
        [("f", "1", "response", 4.0, None), ("f", "1", "request", 5.0, None), ("f", "1", "response", 5.0, None), ("g", "1", "response", 4.0, None)],
        [("f", "1", "response", 6.0, "own"), ("f", "1", "request", 7.0, "p"), ("f", "1", "response", 8.0, None), ("f", "1", "request", 9.0, "q"), ("f", "1", "response", 9.5, None)],
    ]
    for rows in batches:
        put(spark, tmp_path / "r", rows, REQUESTS)
        stream = D.match_requests(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "r")), forget)
        D.append_to(stream, me).awaitTermination()
    got = D.appended(spark, me, "file string, id string, at double, request_at double, model string")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted([
        ("f", "1", 0.5, None, None), ("f", "2", 3.0, None, "n"), ("f", "1", 4.0, 1.0, "m"), ("f", "1", 5.0, 5.0, None), ("g", "1", 4.0, None, None), ("f", "1", 6.0, 5.0, "own"),
        ("f", "1", 8.0, 7.0, "p"), ("f", "1", 9.5, 9.0, "q"),
    ], key=key)


def test_old_requests_are_forgotten(spark, tmp_path):
    me = name("forget")
    for rows in ([("f", "1", "request", 1.0, "m")], [("f", "2", "request", 10_000.0, "n")], [("f", "3", "response", 10_001.0, None)], [("f", "1", "response", 10_002.0, None), ("f", "2", "response", 10_002.0, None)]):
        put(spark, tmp_path / "r", rows, REQUESTS)
        D.append_to(D.match_requests(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "r")), 60), me).awaitTermination()
    got = {(r.id, r.model) for r in D.appended(spark, me, "file string, id string, at double, request_at double, model string").collect()}
    assert got == {("3", None), ("1", None), ("2", "n")}


def counts(df):
    return df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


def test_ticks_count_files_as_they_are(spark, tmp_path):
    me, at = name("tick"), str(tmp_path / "log.jsonl")
    read = lambda: spark.read.schema("k string, v long").option("mode", "DROPMALFORMED").json(at)
    rows = lambda: {tuple(r) for r in D.current(spark, me).collect()}
    assert D.current(spark, me) is None
    for text, want in (('{"k":"a","v":1}\n{"k":"a","v":2}\n', {("a", 2, 3)}), ('{"k":"a","v":1}\n{"k":"a","v":2}\n{"k":"b","v":5}\n{"k":"b', {("a", 2, 3), ("b", 1, 5)}), ('{"k":"c","v":7}\n', {("c", 1, 7)}), ("", set())):
        (tmp_path / "log.jsonl").write_text(text)
        version = D.tick(spark, read, counts, me)
        assert rows() == want
    assert version == 4
    assert len(D._parts(spark, f"{D.place_of(spark, me)}/versions")) == 2


def test_ticks_run_as_a_stream(spark, tmp_path):
    me, at = name("clock"), tmp_path / "log.jsonl"
    at.write_text('{"k":"a","v":1}\n')
    query = D.ticks(spark, lambda: spark.read.schema("k string, v long").json(str(at)), counts, me, "200 milliseconds")
    try:
        query.processAllAvailable()
        at.write_text('{"k":"b","v":4}\n')
        for _ in range(100):
            found = D.current(spark, me)
            if found is not None and found.first() is not None and found.first()["k"] == "b":
                break
            threading.Event().wait(0.2)
    finally:
        query.stop()
    assert {tuple(r) for r in D.current(spark, me).collect()} == {("b", 1, 4)}


def test_consumer_runs_while_the_producer_does(spark, tmp_path):
    for i in range(6):
        put(spark, tmp_path / "s", [(i, 10 * i)], "k long, v long")
    me, seen, active = name("both"), [], []
    source = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))

    def handle(batch, i):
        seen.append((i, sorted(r.k for r in batch.collect())))
        active.append(len(spark.streams.active))
        if len(seen) == 3 and not any(x == "killed" for x in seen):
            seen[-1] = "killed"
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        D.overlapped(source, handle, me, 1, lambda df: df.withColumn("v", F.col("v") + 1))
    table = D.overlapped(source, handle, me, 1, lambda df: df.withColumn("v", F.col("v") + 1))
    done = [x for x in seen if x != "killed"]
    assert sorted(k for _, ks in done for k in ks) == list(range(6))
    assert [i for i, _ in done] == sorted({i for i, _ in done})
    assert max(active) >= 2
    assert sorted((r.k, r.v) for r in table.collect()) == [(i, 10 * i + 1) for i in range(6)]


def test_overlapped_without_rows(spark, tmp_path):
    put(spark, tmp_path / "e", [], "k long, v long")
    source = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "e"))
    assert D.overlapped(source, lambda batch, i: None, name("none")).collect() == []


class Kept:
    """A handle and a state outside of Spark."""

    value, timers = None, ()

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_key_costs_no_frame(monkeypatch):
    """Keys are worked on as plain rows, one call for the state and one to update it."""
    import pandas as pd
    from pyspark.sql import Row

    monkeypatch.setattr(pd, "concat", None)
    state, last = Kept(), D._LastRequest(None)
    last.init(state)
    records = [("response", 2.0, None), ("response", None, None), ("request", 2.0, "m"), ("request", 1.0, None), ("response", 1.5, "own"), ("response", 0.5, None)]
    got = list(last.handleInputRows(("f", "1"), iter([Row(file="f", id="1", kind=k, at=a, model=m) for k, a, m in records]), None))
    assert [tuple(r)[2:] for r in got] == [(0.5, None, None), (1.5, 1.0, "own"), (2.0, 2.0, "m"), (None, 2.0, "m")]
    assert state.value == (2.0, "m")


def test_files_seen_are_sparks_own_state(spark, tmp_path):
    put(spark, tmp_path / "in", [("a",)], "file string")
    assert "transformWithState" not in D.first_of_each(files(spark, tmp_path / "in"))._jdf.queryExecution().toString().replace("TransformWithState", "transformWithState")
