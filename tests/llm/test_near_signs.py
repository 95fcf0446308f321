"""Parity signatures of near_dedup: they never tell two texts further apart than they are."""

from __future__ import annotations

import random

import numpy as np
import pytest

from siltstone.llm import near_dedup as N


def test_signatures_bound_differences(spark):
    rng = random.Random(4)
    hub = [f"w{i}" for i in range(200)]
    texts = [hub] + [[w if rng.random() < keep else f"e{rng.randrange(30)}" for w in hub] for keep in (1, 0.99, 0.95, 0.9, 0.7, 0.2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(len(texts))], "a long, b long")
    rows = N._overlaps(pairs, docs, 2, "laid-test", rests=True).collect()
    signs = {r.a: np.array([r[f"g{i}"] for i in range(N.SIGNS)], np.int64).view(np.uint8) for r in rows}
    shingles = [set(zip(t, t[1:])) for t in texts]
    for x in signs:
        for y in signs:
            bits = int(np.unpackbits(signs[x] ^ signs[y]).sum())
            apart = len(shingles[x] ^ shingles[y])
            assert bits <= apart and bits % 2 == apart % 2
            assert apart > 100 or apart - bits <= 30  # near sets are told apart


def test_marks_of_sketches_lose_no_pair(spark):
    rng = random.Random(5)
    made = lambda n: np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.int64))[: N.SKETCH]
    bits = lambda x, y: int(np.unpackbits((N._parity(x, N.MARKS) ^ N._parity(y, N.MARKS)).view(np.uint8)).sum())
    far = 0
    for _ in range(300):
        x, y = made(rng.choice([3, 40, 200])), made(rng.choice([3, 40, 200]))
        y = np.unique(np.concatenate([x[: rng.randrange(len(x) + 1)], y]))[: N.SKETCH]
        union = np.union1d(x, y)[: N.SKETCH]
        both = len(np.intersect1d(union, np.intersect1d(x, y)))
        near = bits(x, y) <= len(x) + len(y) - 2 * -(-max(len(x), len(y)) * N.SHARED // N.SKETCH)
        assert near or both * N.SKETCH < len(union) * N.SHARED
        far += not near
    assert far > 50


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_values_of_sketches_are_dealt_out_once(spark, no_broadcast):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(90)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (300, texts[7] + " x"), (301, texts[9])], "doc_id long, text string")

    def rows(since):
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        stages = [stages.apply(i) for i in range(stages.size())]
        return max((x.stageId() for x in stages), default=-1), sum(x.shuffleWriteRecords() for x in stages if x.stageId() > since)

    since, _ = rows(-1)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, 2).collect()}
    assert got == {i: i for i in range(300)} | {300: 7, 301: 9}
    assert rows(since)[1] < 100 * len(texts)  # a sketch has 64 values
