"""Every stage of the pipeline on its own input: brute force on small corpora, and odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from siltstone.llm import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["score", "h", "line", "node", "w", "component_id", "ids", "kept", "__x"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 5) for i, t, s in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """A folder with labels and items."""
    at, rnd = tmp_path_factory.mktemp("corpus"), random.Random(1)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    items = [(k, " ".join(f"item{k}w{rnd.randrange(50)}" for _ in range(20))) for k in range(6)] + [(None, "a b c d e f"), (50, None), (51, "short one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def speech(rnd, toxic):
    bad = ["slur", "scum", "filth"]
    return " ".join(rnd.choice(bad) if toxic and rnd.random() < 0.5 else f"w{rnd.randrange(300)}" for _ in range(60))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxic_documents_go(spark, place):
    rnd = random.Random(2)
    rows = [(i, speech(rnd, i % 4 == 0), f"s{i % 5}") for i in range(400)] + [(900, speech(rnd, True), "s"), (901, speech(rnd, False), "s"), (902, None, None), (903, "", "s"), (None, speech(rnd, True), "s")]
    table = docs(spark, rows)
    kept = {r.doc_id for r in P.drop_toxic(spark, table, place).collect()}
    model = toxicity.fit(table, spark.read.parquet(f"{place}/labels.parquet"), ~toxicity.held_out())
    scores = defaultdict(float)
    for r in toxicity.toxic_passages(table, model).collect():
        scores[r.doc_id] = max(scores[r.doc_id], r.score)
    assert kept == {i for i, _, _ in rows if i is None or scores[i] < 0.7}
    assert {901, 902, 903, None} <= kept
    assert 900 not in kept
    wrong = sum((i in kept) == (i % 4 == 0) for i in range(400))
    assert wrong < 20


def test_boilerplate_lines_go(spark, place):
    rnd = random.Random(3)
    lines = [f"line {k} of many words" for k in range(12)]
    rows = [(i, "\n".join(rnd.choice([" ", "", "\t"]) + rnd.choice([*lines[: i % 12 + 1], f"own line {i}"]) for _ in range(rnd.randrange(1, 7))), f"s{rnd.randrange(14)}") for i in range(120)]
    rows += [(500, None, None), (501, "", "s1"), (502, "\n\n", "s1"), (None, lines[0] + "\nrest", None)]
    spread = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\f\x0b"):
                spread[line.strip(" \t\r\f\x0b")].add(source or "")
    bad = {line for line, sources in spread.items() if len(sources) >= 8}
    want = Counter()
    for i, text, source in rows:
        parts = (text or "").split("\n")
        left = [line for line in parts if line.strip(" \t\r\f\x0b") not in bad]
        if not any(line.strip(" \t\r\f\x0b") for line in left):
            left = parts
        want[(i, "\n".join(left), "en", source, len("\n".join(left)))] += 1
    assert rows_of(P.drop_boilerplate(spark, docs(spark, rows), place)) == want
    assert 3 < len(bad) < len(spread)


def test_contaminated_documents_go(spark, place):
    rnd = random.Random(4)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{place}/benchmark.parquet").filter("item_id < 50").collect()}
    rows = []
    for i in range(90):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(80))]
        if i % 3 == 0:
            item = items[rnd.randrange(6)].split()
            for _ in range(rnd.randrange(3)):
                item[rnd.choice([0, 1, 9, 18, 19])] = "changed"
            words[len(words) // 2 : len(words) // 2] = [w.upper() if rnd.random() < 0.3 else w for w in item]
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(words), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "short one", "s"), (None, items[0], "s"), (7, items[1], "s")]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [[x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if x]] for k in range(len(w) - 4)}
    own = defaultdict(set)
    for i, text, _ in rows:
        own[i] |= grams(text or "")
    leaked = {i for i in own if i is not None and any(100 * len(own[i] & grams(t)) >= 80 * len(grams(t)) for t in items.values())}
    want = Counter((i, t, "en", s, 5) for i, t, s in rows if i not in leaked)
    assert rows_of(P.drop_contaminated(spark, docs(spark, rows), place)) == want
    assert 10 < len(leaked) < 40
    assert 7 in leaked


def test_one_of_near_duplicates_stays(spark, place):
    rnd, rows = random.Random(5), []
    for k in range(15):
        base = [f"w{rnd.randrange(800)}" for _ in range(rnd.randrange(3, 60))]
        for _ in range(rnd.randrange(1, 6)):
            words = list(base)
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(words), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, " ", "s"), (None, rows[0][1], "s"), (None, rows[0][1], "s")]

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[a] > least[b]:
                    least[a], changed = least[b], True
    want = Counter((i, t, "en", s, 5) for i, t, s in rows if i is None or least[i] == i)
    assert rows_of(P.keep_one_of_near_duplicates(spark, docs(spark, rows), place)) == want
    assert sum(least[i] != i for i in least) > 5


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_on_odd_tables(spark, place, stage):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", None), (5, long, "b"), (6, "é ñ 日本 😀\x00", "c"), (6, "é ñ 日本 😀\x00", "c"), (7, "same id", "c"), (7, "other text", "d"), (None, "no id", "e"), (None, None, None)]
    table = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") != 4, F.col("n_chars")))
    for c in EXTRA:
        table = table.withColumn(c, F.lit(1))
    out = stage(spark, table, place)
    got = Counter(r.doc_id for r in out.collect())
    want = Counter(i for i, _, _ in rows)
    if stage is P.keep_one_of_near_duplicates:
        want[6] = 1  # one row of a doc_id and text
    assert got == want
    assert out.columns == (P.COLUMNS if stage is not P.tokenize else out.columns)
    assert stage(spark, table.filter("false"), place).collect() == []
