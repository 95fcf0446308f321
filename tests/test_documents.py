"""Documents merged as rows of paths against the merge of two dictionaries."""

import json
import random

from siltstone.functions.text import deep_merge
from siltstone.operators import documents as D

CASES = [
    ({"a": {"b": 1, "c": [1, {"x": 2}]}, "k": "v"}, {"a": {"c": {"d": 1}, "e": None}, "z": 3}),
    ({"a": {"b": {"c": 1}}}, {"a": {"b": 5}}),
    ({"a": 5}, {"a": {"b": {}}}),
    ({"a": {"b": 1}}, {"a": {}}),
    ({"a": 1, "e": {}}, {"a": {}, "e": {"f": [ ]}}),
    ({}, {"x": {"y": "é \" \\ \n"}}),
    ({"we.ird": {"$": 1, "": 2}}, {"we.ird": {"": {"q": True}}}),
    ({}, {}),
]


def value(rnd, depth):
    kind = rnd.randrange(6 if depth else 3)
    if kind < 3:
        return [None, rnd.randrange(5), [1, {"a": 2}]][kind]
    return {rnd.choice("abc"): value(rnd, depth - 1) for _ in range(rnd.randrange(4))}


def test_merged_documents(spark):
    rnd = random.Random(6)
    cases = CASES + [({c: value(rnd, 4) for c in "ab"}, {c: value(rnd, 4) for c in "bc"}) for _ in range(80)]
    rows = [(i, json.dumps(b), json.dumps(o)) for i, (b, o) in enumerate(cases)]
    rows += [(1000, None, '{"a": 1}'), (1001, '{"a": 1}', "{bad"), (1002, None, None), (1003, '{"a": 1}', "7")]
    got = {r["k"]: json.loads(r["json"]) for r in D.deep_merged(spark.createDataFrame(rows, "k int, b string, o string"), "k", "b", "o").collect()}
    assert got == {i: deep_merge(b, o) for i, (b, o) in enumerate(cases)} | {1000: {"a": 1}, 1001: {"a": 1}, 1003: 7}


def test_members_are_in_order_and_none_is_none(spark):
    df = spark.createDataFrame([(1, '{"b": 1, "a": {"d": 1, "c": 2}}', '{"a": {"cc": 3}}')], "k int, b string, o string")
    assert D.deep_merged(df, "k", "b", "o").first()["json"] == '{"a":{"c":2,"cc":3,"d":1},"b":1}'
    assert D.deep_merged(df.filter("false"), "k", "b", "o").collect() == []
