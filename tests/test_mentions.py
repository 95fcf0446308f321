"""First mentions of names against regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import mentions as M


def mentioned(line, name):
    if not name:
        return False
    return name in line if "::" in name else bool(re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?:\s*\(|\b)", line))


def test_mentions_of_overlapping_names():
    rnd, pieces = random.Random(2), ["a", "b", "ab", "ba", "_", " ", "::", "(", "  (", "é", ".", "1"]
    for _ in range(4000):
        names = sorted({"".join(rnd.choices(pieces, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 6))})
        text = "".join(rnd.choices(pieces, k=rnd.randrange(15)))
        assert {names[i] for i in M.mentions(text, names, M.automaton(names))} == {n for n in names if mentioned(text, n)}, (text, names)


@pytest.mark.parametrize("part", [20_000, 3])
def test_first_mentions(spark, part):
    rnd = random.Random(7)
    words = ["read", "read_all", "io::read", "re", "all", "x::y", "y"]
    entries = [(k, i, rnd.choice([" ", "::", "("]).join(rnd.choices(words, k=3))) for k in "pqr" for i in range(12)] + [("p", 50, None), (None, 1, "read"), ("empty", 1, "read")]
    wanted = [(k, n, [a] if a else []) for k in "pq" for n, a in (("m::read", None), ("m::all", "re"), ("z::nothing", None), ("n::k", "x::y"))] + [("p", None, []), ("gone", "read", None)]
    names = spark.createDataFrame(wanted, "info string, name string, aliases array<string>").withColumn("names", M.match_names(F.col("name"), F.col("aliases")))
    got = M.first_mentions(spark.createDataFrame(entries, "info string, at int, line string"), names, "info", part)
    want = set()
    for k, name, aliases in wanted:
        if name is None:
            continue
        every = [name, name.split("::")[-1], *(aliases or []), *(a.split("::")[-1] for a in aliases or [])]
        hits = [(at, line) for info, at, line in entries if info == k and line and any(mentioned(line, n) for n in every)]
        if hits:
            want.add((k, name, *min(hits)))
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 4
