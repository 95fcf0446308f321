"""The training-data operators against brute force, and on nulls, empty and repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, license_scan, line_dedup, near_dedup, quality_crf, quality_rules, sentencepiece_codec, suffix_dedup, token_store, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, w string, x string, n long"
WORDS = [f"w{i}" for i in range(60)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "w", "x", 1) for i, t, s in rows], DOCS).repartition(3)


def odd(spark):
    """Null, empty, blank, short, repeated and long texts, a null id, a repeated id, columns with names of our own."""
    long = " ".join(WORDS) * 200
    return docs(spark, [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (5, "one two", "b"), (6, long, "c"), (7, long, "c"), (7, long, "c"), (8, "é ñ — 日本 😀", "d"), (None, "lost words here", "e")])


def empty(spark):
    return docs(spark, [(0, "", "")]).filter("false")


def family(seed=3, n=130):
    """Copies of one text of 120 words with 0 to 16 edits, some of them shared by several copies."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    variants = [base, [*base[:60], *(f"v{k}" for k in range(14)), *base[70:]], base[10:]]
    out = []
    for i in range(n):
        words = list(rnd.choice(variants))
        for _ in range(rnd.randrange(17)):
            k = rnd.randrange(len(words))
            words[k : k + 1] = rnd.choice([[f"x{rnd.randrange(10**6)}"], [], [words[k], "y"]])
        out.append((i, " ".join(words), "s"))
    return out


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    bases = [[rnd.choice(WORDS) for _ in range(rnd.randrange(3, 90))] for _ in range(25)]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append((i * 2, rnd.choice([" ", "  ", "\n"]).join(words), f"s{rnd.randrange(12)}"))
    return out


@pytest.mark.parametrize(("width", "made"), [(2, corpus), (5, corpus), (2, family), (5, family)])
def test_near_duplicates(spark, width, made):
    rows = made()
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs(spark, rows), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_contained_items(spark):
    rows = corpus(2, 40)
    items = [(1, rows[0][1]), (2, rows[3][1] + " unseen words"), (3, "one two"), (4, None), (None, "x"), (1, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda t: {tuple(w[k : k + 5]) for w in [cut(t)] for k in range(len(w) - 4)}
    want = {(i, k, len(grams(b)), len(grams(b) & grams(t))) for i, t, _ in rows for k, b in items if k is not None and grams(b) and 100 * len(grams(b) & grams(t)) >= 80 * len(grams(b))}
    assert {tuple(r) for r in decontaminate.contained_items(docs(spark, rows), bench).collect()} == want and want


def test_lines(spark):
    page = [(i, f"own text number {i} that is quite long enough to stay\nBuy now\n\nfooter {i % 3}", f"s{i % 9}") for i in range(30)]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs(spark, page), sites=9).collect()}
    assert got[4].text == "own text number 4 that is quite long enough to stay\n\nfooter 1" and got[4].n_removed == 1 and got[4].n_lines == 3
    same = docs(spark, [(i, "Buy now", f"s{i}") for i in range(20)])
    assert {r.text for r in line_dedup.remove_boilerplate(same, sites=9).collect()} == {"Buy now"}


def test_lines_by_join_and_in_place_are_the_same(spark):
    page = [(i // 2, f"own {i}\n\tshared one \nshared {i % 3}\n", f"s{i % 11}") for i in range(60)] + [(None, "shared one\nmine", None), (5, None, "s1"), (5, "", "s2")]
    d = docs(spark, page).withColumn("site", F.lit(1)).withColumn("h", F.lit("x"))
    both = [sorted(map(str, line_dedup.remove_boilerplate(d, sites=9, keep=["site", "h", "source"], send=send).collect())) for send in (1 << 20, 0)]
    assert both[0] == both[1] and len(both[0]) == len(page) and any("n_removed=2" in r for r in both[0])


def test_repeated_rows_do_not_add_up_votes(spark):
    notice = next(t for label, t in license_scan.TEMPLATES if label == "bsd").split()
    part = " ".join(notice[: len(notice) // 3])
    rows = [(1, part, "s")] * 4 + [(2, " ".join(notice), "s"), (3, part + " " + part, "s")]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert got == {1: "", 2: "bsd", 3: ""}


def test_boilerplate_goes_whatever_its_share(spark):
    passage = "a long passage that every site shows " * 9
    page = [(i, f"own {i}\n{passage}", f"s{i}") for i in range(9)] + [(9, f"{passage}\n \n{passage}", "s9")]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs(spark, page), sites=9).collect()}
    assert [(got[i].text, got[i].n_lines, got[i].n_removed) for i in range(9)] == [(f"own {i}", 2, 1) for i in range(9)]
    assert (got[9].text, got[9].n_lines, got[9].n_removed) == (page[9][1], 2, 0)


def test_round_trip(spark):
    model = sentencepiece_codec.default_model()
    texts = [(i, t, "") for i, t in enumerate(["", "Hello world", "a  b\n\tc", "日本 𓀀 é", "x" * 5000, None])]
    got = {r.doc_id: r for r in sentencepiece_codec.round_trip(docs(spark, texts), model).collect()}
    assert all(r.exact for r in got.values()) and got[0].n_ids == 0 and got[5].n_ids == 0 and got[3].n_fallback > 0
    encoded = sentencepiece_codec.encode_documents(docs(spark, texts), model)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_ids(encoded, model).collect()}
    assert back == {i: t or "" for i, t, _ in texts}


def test_viterbi_is_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    codec = sentencepiece_codec.Codec(pieces, [0, -2.0, -2.5, -2.2, -3.1, -3.0, -5.0, -3.3, -4.0], [2] + [1] * 8, True)
    codec.ready()

    def best(text):
        paths = {"": (0.0, [])}
        for k in range(1, len(text) + 1):
            options = [(paths[text[:j]][0] + codec.scores[i], paths[text[:j]][1] + [i]) for j in range(k) for i, p in enumerate(pieces) if i and p == text[j:k]]
            paths[text[:k]] = max(options, key=lambda o: o[0])
        return paths[text][0]

    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 12)))
        ids = codec.viterbi("▁" + text.replace(" ", "▁"))
        assert abs(sum(codec.scores[i] for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-9
        assert codec.decode(ids) == text


def test_license_spans(spark):
    notice = license_scan.TEMPLATES[1][1]
    rows = [(1, "x " * 30 + notice + " tail", "a"), (2, "The MIT  License, and General Public License", "a"), (3, notice.replace("distributed under", "given out under"), "a"), (4, "mit", "a"), (5, "no license", "a")]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert got[1].labels == "apache" and got[3].labels == "apache"
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 1, 4, "gpl,mit")
    assert got[4].labels == "" and got[4].first_word is None and got[5].score == 0.0


def test_repeated_short_licenses(spark):
    nc, apache, mit = "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    gap = apache.replace("the Apache", "the well known Apache")
    texts = {
        1: nc, 2: f"{nc} {nc}", 3: " ".join([nc] * 40), 4: f"{nc} and {nc}", 5: f"{apache} {apache} {apache}", 6: f"{mit} {mit}",
        7: f"Licensed under CC BY 4.0. {nc}", 8: f"{gap} {gap} {gap}", 9: f"{apache} {gap} {apache}", 10: f"Licensed under the old terms {gap}",
        11: "Licensed under CC BY. " * 9,
    }
    got = {r.doc_id: (r.labels, r.score, r.n_spans) for r in license_scan.license_scan(docs(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 7)] == [("cc-by-nc", 1.0, n) for n in (1, 2, 40, 2, 1)]
    assert got[5] == ("apache", 1.0, 3) and got[6] == ("mit", 1.0, 2)
    assert got[8] == ("apache", 4 / 6, 3) and got[9] == ("apache", 1.0, 3) and got[10] == ("apache", 4 / 6, 1)
    assert got[11] == ("", 0.0, 0)
    places = license_scan.license_spans(docs(spark, [(2, texts[2], "a"), (7, texts[7], "a")])).orderBy("doc_id", "first_word").collect()
    assert [(r.doc_id, r.first_word, r.end_word) for r in places] == [(2, 0, 7), (2, 7, 14), (7, 6, 13)]


def test_statistics(spark):
    rows = [(1, "a b c a b c x", ""), (2, "héé #$\nl\nl\n\nl", ""), (3, "a a a a", "")]
    got = {r.doc_id: r for r in quality_rules.text_statistics(docs(spark, rows)).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_repeat_words) == (7, 7, 6)
    assert (got[2].n_symbols, got[2].n_dup_lines, got[2].word_chars) == (2, 2, 8)
    assert got[3].n_repeat_words == 4


def test_decision_list_learns_a_conjunction():
    import numpy as np

    x = np.random.Generator(np.random.PCG64(1)).random((900, 3))
    bad = (x[:, 0] > 0.6) & (x[:, 2] < 0.5)
    rules = quality_rules.fit_decision_list(x, bad)
    said = np.zeros(900, bool)
    for r in rules:
        said |= quality_rules._covered(x, r)
    assert (said == bad).mean() > 0.95


def test_maximal_segments():
    """All maximal segments by definition: repeatedly the best one of what is left on either side."""

    def split(scores, lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,) * 4)
        if best[0] <= 0:
            return []
        return split(scores, lo, best[2]) + [(best[2], best[3])] + split(scores, best[3], hi)

    rnd = random.Random(3)
    for _ in range(300):
        scores = [rnd.choice([-5, -3, -2, -1, 1, 2, 4]) + rnd.random() / 100 for _ in range(rnd.randrange(12))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == split(scores, 0, len(scores))


def test_forward_backward_sums_all_labelings():
    import itertools

    import numpy as np

    rng = np.random.Generator(np.random.PCG64(2))
    unary, at, t = rng.normal(size=9), np.array([0, 4, 4, 9]), rng.normal(size=(2, 2))
    p, _ = quality_crf.forward_backward(unary, at, t)
    for a, b in ((0, 4), (4, 9)):
        weights = {y: np.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(t[u, v] for u, v in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=b - a)}
        for i in range(b - a):
            assert abs(sum(w for y, w in weights.items() if y[i]) / sum(weights.values()) - p[a + i]) < 1e-9


def brute_repeats(rows, length=50):
    first, out = {}, {}
    for i, b in sorted(rows):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, b in rows:
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                m[k : k + length] = b"\1" * length
        kept = bytes(c for c, f in zip(b, m, strict=True) if not f)
        out[i] = (len(b), sum(m), sum(1 for q in range(len(m)) if m[q] and (q == 0 or not m[q - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeated_strings(spark, hot):
    rnd = random.Random(5)
    base = [bytes(rnd.choice(b"ab \n") for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(60):
        b = b"".join(rnd.choice(base)[rnd.randrange(200) :][: rnd.randrange(150)] for _ in range(rnd.randrange(5)))
        rows.append((i * 3, b"ab" * rnd.randrange(90) if rnd.random() < 0.1 else b + b"a" * rnd.choice([0, 0, 99])))
    got = suffix_dedup.remove_repeats(docs(spark, [(i, b.decode(), "") for i, b in rows]), 50, hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


def test_strips_with_equal_hashes_but_other_bytes_stay(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2 ** 64."""
    rnd = random.Random(8)
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    rows = []
    for i in range(6):
        edge, end = ("".join(rnd.choice("cdefghijkl") for _ in range(200)) for _ in range(2))
        rows += [(2 * i, edge + word + end, ""), (2 * i + 1, edge + word.translate({97: "b", 98: "a"}) + end, "")]
    for d in (docs(spark, rows), docs(spark, rows).coalesce(1)):  # merged in a block, and in a task
        assert [r.n_removed for r in suffix_dedup.remove_repeats(d, 2300).collect()] == [0] * 12


def test_difference_cover():
    cover = suffix_dedup.difference_cover(16)
    assert {(a - b) % 16 for a in cover for b in cover} == set(range(16))


def test_token_store(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = [(i, t, "") for i, t in enumerate(["", "don't  stop\n\nnow", " x—y!<|endoftext|>z", "a\tb\xa0c", "日本 é"])] + [(9, None, "")]
    with open(path) as f:
        got = token_store.read_tokens(token_store.write_tokens(docs(spark, rows), f.read(), 2, 7)).orderBy("doc_id").collect()
    start = 0
    for r, (i, t, _) in zip(got, rows, strict=True):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_wavelet_matrix():
    import numpy as np

    rnd = random.Random(1)
    for size, most in ((0, 1), (1, 1), (700, 2), (3000, 50_257), (900, 70_000)):
        a = np.array([rnd.randrange(most) for _ in range(size)], np.uint32)
        _, _, w = token_store.open_shard(token_store.shard_bytes(np.array([1]), np.array([size]), a))
        assert (w.decode() == a).all()
        for _ in range(40 if size else 0):
            i = rnd.randrange(size)
            v = int(a[i])
            where = np.flatnonzero(a == v)
            k = rnd.randrange(len(where))
            assert (w.access(i), w.rank(v, i), w.count(v), w.select(v, k)) == (v, int((a[:i] == v).sum()), len(where), where[k])


@pytest.mark.parametrize("make", [odd, empty])
def test_odd_tables(spark, make):
    d = make(spark)
    known = d.filter("doc_id is not null").count()
    every = d.count()
    labels = spark.createDataFrame([(1, None, 1), (4, 1, None), (6, 0, 0), (None, 1, 1), (8, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "one two")], "item_id long, text string")
    with open(__import__("public_tokenizers").path("byte_bpe_50k.json")) as f:
        tokenizer = f.read()
    assert near_dedup.near_duplicates(d, 2).count() == known
    assert decontaminate.contained_items(d, bench).count() == 0
    assert line_dedup.remove_boilerplate(d).count() == every
    assert sentencepiece_codec.round_trip(d, sentencepiece_codec.default_model()).filter("exact").count() == every
    assert license_scan.license_scan(d).count() == known
    assert quality_rules.quality_rules(d, labels).filter("kept is not null").count() == every
    assert toxicity.toxic_passages(d, toxicity.fit(d, labels, ~toxicity.held_out())).filter("score between 0 and 1").count() == every
    assert quality_crf.score_quality(d, quality_crf.fit(d, labels, ~quality_crf.held_out())).filter("score between 0 and 1").count() == every
    assert suffix_dedup.remove_repeats(d).count() == known
    assert token_store.read_tokens(token_store.write_tokens(d, tokenizer, 2)).count() == known


def test_held_out_accuracy(spark):
    rnd = random.Random(7)
    rows, marks = [], []
    for i in range(900):
        toxic, good = rnd.random() < 0.2, rnd.random() < 0.7
        words = [rnd.choice(WORDS) for _ in range(80)]
        if toxic:
            words[rnd.randrange(80)] = rnd.choice(["nastyone", "nastytwo", "vileword"])
        lines = [" ".join(words[k : k + 8]) + "." if good else " ".join(w + "###" for w in words[k : k + 8]) for k in range(0, 80, 8)]
        rows.append((i, "\n".join(lines), "s"))
        marks.append((i, int(good), int(toxic)))
    d, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    t = toxicity.toxic_passages(d, toxicity.fit(d, labels, ~toxicity.held_out())).join(labels, "doc_id").filter(toxicity.held_out())
    assert t.agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("double"))).first()[0] > 0.95
    q = quality_crf.score_quality(d, quality_crf.fit(d, labels, ~quality_crf.held_out())).join(labels, "doc_id").filter(quality_crf.held_out())
    assert q.agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.95


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(6, 50) + [(1001, "clean words that stand alone and stay in the corpus for good", "z")]
    leak = " ".join(f"q{i}" for i in range(30))
    rows.append((1003, "before " + leak + " after", "z"))
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "exact").collect() if r.exact}
    cleaned = corpus_pipeline.drop_boilerplate(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    kept = {r.doc_id for r in near_dedup.near_duplicates(cleaned).filter("kept").collect()}
    assert 1001 in ids and 1003 not in ids and ids == kept - {1003}


def test_near_dedup_stage_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{i}" for i in range(20)) for c in "abc")
    rows = [(1, one, "s"), (1, one, "s"), (1, one, "r"), (1, two, "s"), (2, one, "s"), (3, three, "s"), (4, "", "s"), (4, "", "s"), (None, three, "s"), (None, three, "s")]
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, docs(spark, rows), "").collect()
    want = [(1, one, "r"), (1, two, "s"), (3, three, "s"), (4, "", "s"), (None, three, "s"), (None, three, "s")]
    assert got[0].asDict().keys() == set(corpus_pipeline.COLUMNS) and sorted(map(repr, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(repr, want))


def test_license_scan_of_long_texts_of_repeated_notices(spark):
    """A text of short notices over and over: every copy is a span, and four times the text takes no more than five times as long."""
    import time

    def scan(copies):
        began = time.time()
        row = license_scan.license_scan(docs(spark, [(1, "Licensed under CC BY-NC 4.0. some words " * copies, "s")])).first()
        return row["n_spans"], row["labels"], time.time() - began

    scan(100)
    short, long = scan(12_000), scan(48_000)
    assert (short[:2], long[:2]) == ((12_000, "cc-by-nc"), (48_000, "cc-by-nc"))
    assert long[2] < 5 * short[2] + 5


def test_license_scan_of_more_templates_than_are_told(spark, monkeypatch):
    rows = [(1, "x Licensed under the Apache License, Version 2.0. y", "s"), (2, "nothing", "s")]
    told = sorted(map(tuple, license_scan.license_scan(docs(spark, rows)).collect()))
    monkeypatch.setattr(license_scan, "TOLD", 3)
    assert sorted(map(tuple, license_scan.license_scan(docs(spark, rows)).collect())) == told


def test_license_scan_equals_its_statement_on_repeated_and_partial_notices(spark):
    import duckdb

    rnd, rows = random.Random(8), []
    for i in range(250):
        parts: list = []
        for _ in range(rnd.randrange(1, 6)):
            words = rnd.choice(license_scan.TEMPLATES)[1].split()
            if rnd.random() < 0.5:
                a = rnd.randrange(len(words))
                words = words[a:] + rnd.choice([[], words[:a]])
            if rnd.random() < 0.5:
                words = words[: rnd.randrange(1, len(words) + 1)]
            for _ in range(rnd.randrange(4)):
                words.insert(rnd.randrange(len(words)), "zz")
            parts += words * rnd.choice([1, 1, 2, 3]) + ["x"] * rnd.randrange(6)
        rows.append((i, " ".join(parts), "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "MIT LICENSE É", "s")]
    found = license_scan.license_scan(docs(spark, rows))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    want = con.sql(license_scan.ORACLE).select(", ".join(found.columns)).fetchall()
    got = [tuple(r) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[-1] > 2 for r in got) > 50


def test_token_log_odds_equal_plain_counts(spark):
    import math
    from collections import Counter

    rnd, rows = random.Random(11), []
    words = ["ab", "Abc", "abcd", "abcdefgh", "naïveté", "日本語日本語", "x1", "abcdefghij"] + [f"word{i}" for i in range(30)]
    for i in range(200):
        rows.append((rnd.choice([" ", "-", ", "]).join(rnd.choices(words[: 8 + i % 30], k=rnd.randrange(12))), int(rnd.random() < 0.3)))
    rows += [(None, 1), ("", 0), ("ab ab AB", 1)]
    counts = {0: Counter(), 1: Counter()}
    for text, y in rows:
        found = {w for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())}
        counts[y].update(found | {(n, w[:n]) for w in found for n in toxicity.PREFIXES if len(w) > n})
    total, prior = {y: sum(c.values()) for y, c in counts.items()}, toxicity.PRIOR
    share, want = total[1] / (total[0] + total[1]), []
    for token in counts[0] | counts[1]:
        n = {y: counts[y][token] for y in (0, 1)}
        a = prior * (n[0] + n[1]) / (total[0] + total[1])
        odds = {y: math.log((n[y] + a) / (total[y] + prior - n[y] - a)) for y in (0, 1)}
        ratio = sum(n[y] * math.log(n[y] / ((n[0] + n[1]) * q)) for y, q in ((1, share), (0, 1 - share)) if n[y])
        delta = odds[1] - odds[0]
        want.append((n[1], n[0], delta, math.copysign(math.sqrt(max(0.0, 2 * ratio)), delta)))
    labelled = spark.createDataFrame([(t or "", y) for t, y in rows], "text string, y int").repartition(3)
    got = [(r.n1, r.n0, r.odds, r.z) for r in toxicity.token_log_odds(labelled).collect()]
    assert len(got) == len(want) > 40
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g == pytest.approx(w, abs=1e-9)


def test_line_features_equal_plain_ones():
    import math

    import numpy as np

    from siltstone.llm.bytescan import Hasher, byte_table

    rnd = random.Random(12)
    pieces = ["Word", "word", "word word", "12", "x3!", "#", "$ %", "é", "Ä!", "|", ". ", "\t", "end.", "?", "\n", "\n\n", "日本"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(14))) for _ in range(200)] + ["", "\n", " ", "same\nsame\nsame"]
    raw = [t.encode() for t in texts]
    x, at, size = quality_crf.line_features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), Hasher(byte_table()))
    within = lambda line, *ranges: sum(any(a <= b <= z for a, z in ranges) for b in line)
    for i, text in enumerate(raw):
        lines, want = [line for line in text.split(b"\n") if line.split()], []
        for k, line in enumerate(lines):
            w, n, b = line.split(), len(line.split()), len(line)
            want.append([
                math.log1p(n), math.log1p(b), sum(map(len, w)) / n, within(line, (65, 90)) / b, within(line, (48, 57)) / b, sum(c in b"#*$%&<>" for c in line) / b,
                within(line, (33, 47), (58, 64), (91, 96), (123, 126)) / b, within(line, (128, 255)) / b, line.count(b"!") / n, line.count(b"|") / n,
                float(65 <= w[0][0] <= 90 or w[0][0] >= 128), float(w[-1][-1] in b".!?"), len(set(w)) / n, sum(a == z for a, z in zip(w, w[1:], strict=False)) / n, float(line in lines[:k]),
            ])
        assert x[at[i] : at[i + 1]] == pytest.approx(np.array(want).reshape(-1, 15), abs=1e-12)
        assert size[at[i] : at[i + 1]].tolist() == [len(line) for line in lines]
