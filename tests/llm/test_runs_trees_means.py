"""Periodic runs, repeated windows and centroid clustering against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siltstone.llm import periodic_runs, sort_means, suffix_trees

DOCS = "doc_id long, text string, lang string, z long, x string, n long, h int, runs string, covers string, key int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", 1, 2, "r", "c", 3) for i, t in rows], DOCS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- periodic runs


def brute_runs(words, least=24, times=3):
    """Every period over the whole text, one place at a time."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least, times * q) and not any(all(words[start + k] == words[start + k - p] for k in range(p, length)) for p in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = WORD.findall(text or "")
    h, n = None if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(400):
        words = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randrange(70))]
        period = [rnd.randrange(3) for _ in range(rnd.randrange(1, 8))]
        words[len(words) // 3 : len(words) // 3] = (period * 20)[: rnd.randrange(40)]
        for least, times in ((24, 3), (6, 3), (4, 2)):
            assert periodic_runs.runs_of(words, least, times) == brute_runs(words, least, times)


def test_the_smallest_period_of_a_stretch_counts():
    words = [1, 2, 2, 2, 2, 0, 1, 0, 2, *[0] * 16, 1, 1, 0, 1, 2, 0, 2, 0, 0, 2, 0, 1, 1, 0, 1, 0, 0, 0, 2, 2]
    assert periodic_runs.runs_of(words, 4, 2) == brute_runs(words, 4, 2) == [(1, 4, 1), (9, 16, 1), (29, 4, 2), (30, 6, 3), (37, 4, 2)]


def repeating(seed=2, n=160):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randrange(rnd.choice([2, 5, 50]))}" for _ in range(rnd.randrange(120))]
        for _ in range(rnd.randrange(3)):
            k, period = rnd.randrange(len(words) + 1), [f"p{rnd.randrange(4)}" for _ in range(rnd.randrange(1, 15))]
            words[k:k] = (period * 12)[: rnd.randrange(20, 100)]
        rows.append((i, rnd.choice([" ", "  ", "\n", "\t"]).join(words)))
    return rows


def test_periodic_runs(spark):
    rows = repeating()
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (None, "a b " * 20), (None, None), (1004, "é é 日 " * 15), (5, "q " * 24), (5, "q " * 24), (6, "q " * 23)]
    got = periodic_runs.digest(periodic_runs.periodic_runs(docs(spark, rows), periodic_runs.planted))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_digest(*r) for r in rows]
    assert sum(w[1] > 0 for w in want) > 60
    assert sum(w[1] > 1 for w in want) > 20
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_periodic_runs_of_a_long_text_and_none(spark):
    sentence = " ".join(f"w{i % 97}" for i in range(97 * 700)) + " end"
    got = periodic_runs.periodic_runs(docs(spark, [(1, "start here " + sentence)])).first()
    assert [tuple(r) for r in got["runs"]] == [(2, 97 * 700, 97)]
    assert got["collapsed"].split() == ["start", "here", *(f"w{i}" for i in range(97)), "end"]
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs(spark, [(1, "")]).filter("false"))).collect() == []
    with pytest.raises(ValueError, match="times"):
        periodic_runs.periodic_runs(docs(spark, [(1, "")]), times=2)


def test_stretches_hold_every_run():
    import numpy as np

    rnd = random.Random(9)
    for _ in range(150):
        texts = [[rnd.randrange(rnd.choice([2, 9])) for _ in range(rnd.randrange(90))] for _ in range(3)]
        for t in texts:
            t[10:10] = ([rnd.randrange(9) for _ in range(rnd.randrange(1, 12))] * 40)[: rnd.randrange(70)]
        cut = np.cumsum([0, *map(len, texts)])
        words = np.array([x + 1 for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first, end = periodic_runs.stretches(words, cut)
        for k, t in enumerate(texts):
            for start, length, _ in brute_runs(t):
                assert any(a <= cut[k] + start and cut[k] + start + length <= b for a, b in zip(first, end, strict=True))


# -- repeated windows


def brute_windows(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def passages(seed=4, n=90):
    """Texts of shared passages between own words: hot ones, copies, blanks of other kinds, repeats inside a text."""
    rnd = random.Random(seed)
    pool = [[f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 70))] for _ in range(9)]
    rows = []
    for i in range(n):
        words: list = []
        for _ in range(rnd.randrange(4)):
            words += [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))] + rnd.choice(pool[: rnd.choice([2, 9])])
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(n + i, rows[i][1].replace("\n", "  ")) for i in range(0, n, 9)]


@pytest.mark.parametrize(("width", "group"), [(35, 100_000), (35, 3), (12, 5), (5, 4)])
def test_repeated_windows(spark, width, group):
    rows = passages()
    long = " ".join(f"v{i % 40}" for i in range(8000))
    rows += [(500, None), (501, ""), (502, "\t \n"), (503, "one two"), (504, long), (7, long + " x"), (7, "k " * 34), (None, rows[3][1]), (None, "k " * 34), (None, None), (505, "é 日 " * 30)]
    got = suffix_trees.remove_repeated_windows(docs(spark, rows), width, group)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    assert Counter(map(tuple, got.drop("kept").collect())) == brute_windows(rows, width)
    assert all(sha(r["kept"]) == r["kept_sha256"] for r in got.collect())


def test_repeated_windows_of_repeated_rows_and_none(spark):
    text = " ".join(f"u{i}" for i in range(40))
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_trees.remove_repeated_windows(docs(spark, [(1, text), (1, text), (2, text + " y")])).collect()}
    assert got == {(1, 40), (2, 40)}
    assert suffix_trees.remove_repeated_windows(docs(spark, [(1, "")]).filter("false")).collect() == []


def test_subtree_nodes():
    import numpy as np

    symbols = [np.array(c) for c in ([1, 1, 1, 1, 2], [5, 5, 5, 6, 5], [7, 7, 8, 7, 7])]
    depth, low, high = suffix_trees.subtree_nodes(symbols, np.array([1, 1, 1, 1, 2]), [8, 16, 35])
    nodes = {(int(d), tuple(range(a, b))) for d, a, b in zip(depth, low, high, strict=True)}
    assert nodes == {(8, (0, 1, 2, 3)), (16, (0, 1, 2)), (35, (0, 1)), (35, (4,))}
    assert [len(c) for c in suffix_trees.subtree_nodes([np.zeros(0)] * 3, np.zeros(0), [8, 16, 35])] == [0, 0, 0]


def test_prefixes_grow_with_their_groups(spark):
    rows = [(a, b, c) for a in (1, 2) for b in range(1 if a == 1 else 6) for c in range(9 if a == 1 else 2)]
    split = suffix_trees.split_by_prefix(spark.createDataFrame(rows, "s0 long, s1 long, s2 long"), 8)
    assert {(r["s0"], r["symbols"]) for r in split.collect()} == {(1, 3), (2, 2)}
    assert suffix_trees.grouped(split).count() == len(rows)


def test_hot_and_rare_places(spark, monkeypatch):
    monkeypatch.setattr(suffix_trees, "LEAST_HOT", 5)
    places = spark.createDataFrame([(z, h, z) for h in range(12) for z in range(h)], "z long, h long, p int")
    got = Counter(r["h"] for r in suffix_trees.shared_places(places).collect())
    assert got == {h: h for h in range(2, 12)}


# -- centroid clustering


def brute_means(vectors, k, rounds):
    kept = [(i, [__import__("math").floor(256 * x) for x in v]) for i, v in vectors]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    rows = [(i, *near(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, j, d in rows:
        each[j] += d
    return Counter((i, j, d, each[j], sum(each.values()), sha(",".join(map(str, centroids[j])))) for i, j, d in rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, v int, cluster int").repartition(3)


@pytest.mark.parametrize(("dims", "k", "steps"), [(3, 7, 64), (2, 12, 6), (4, 40, 3)])
def test_sort_means(spark, dims, k, steps):
    rnd = random.Random(dims)
    rows = [(i, [rnd.randrange(-steps, steps) / 64 for _ in range(dims)]) for i in range(200)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (3, rows[3][1]), (None, rows[4][1])]
    bad = [(600, None), (601, []), (602, [0.5] * (dims + 1)), (603, [None] * dims), (604, [float("nan")] * dims), (605, [0.0] * (dims - 1) + [float("inf")])]
    got = sort_means.with_inertia(*sort_means.sort_means(sort_means.scaled(vectors(spark, rows + bad), dims=dims), k))
    assert Counter(map(tuple, got.collect())) == brute_means(rows, k, 5)


def test_sort_means_of_few_and_large_vectors(spark):
    few = sort_means.with_inertia(*sort_means.sort_means(sort_means.scaled(vectors(spark, [(1, [0.0, 1.0]), (2, [5.0, 5.0])]), dims=2)))
    assert {(r["vec_id"], r["distance"], r["inertia"]) for r in few.collect()} == {(1, 0, 0), (2, 0, 0)}
    assert sort_means.with_inertia(*sort_means.sort_means(sort_means.scaled(vectors(spark, [(1, None)]), dims=2))).collect() == []
    with pytest.raises(ValueError, match="component"):
        sort_means.sort_means(sort_means.scaled(vectors(spark, [(1, [1e9, 0.0])]), dims=2))


def test_walks_stop_strictly_beyond_twice_the_distance():
    import numpy as np

    c = np.array([[0, 0], [4, 0], [0, 0], [100, 100]])
    order, reach = sort_means.walks(c)
    cluster, distance = sort_means.nearest(np.array([[2, 0], [3, 0], [0, 0], [90, 90]]), np.array([1, 0, 2, 0]), c, order, reach)
    assert cluster.tolist() == [0, 1, 0, 3]
    assert distance.tolist() == [4, 1, 0, 200]
