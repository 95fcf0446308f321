"""op6's counts and verdicts against a plain version."""

import random
import re
from collections import Counter

from siltstone.llm import quality_rules as Q


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed by loops."""
    text = text or ""
    word = r"[^\x20\x09-\x0D]+"
    words = re.findall(word, text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(word, line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts():
    rng = random.Random(5)
    pieces = ["a", "b", "#", "é", "日本", "😀", "\xa0", "\x0b", "\x1f", "<>|", " ", " ", " ", "\n", "\n", "\t", "\r", "a b c", "same line\n", "."]
    out = [None, "", " ", "\n\n", "a a a", "a a a a", "a b a b a b", "x\nx\r\nx\n", "w " * 49, "w " * 50, " ".join(map(str, range(60))), "q r s " * 20 + " ".join(map(str, range(60)))]
    out += ["".join(rng.choice(pieces) for _ in range(rng.choice((3, 30, 300)))) for _ in range(300)]
    return [*out, "long tail " * 40_000 + "#"]


def test_counts_equal_a_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows.append(rows[-2])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted((r["doc_id"], *(r[n] for n in names)) for r in Q.text_statistics(df).select("doc_id", *names).collect())
    assert got == sorted((i, *plain(t)[:5]) for i, t in rows)


def test_query_keeps_the_base_rules(spark):
    place = "/root/testdata/sf0.001"
    want = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{place}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.query(spark, place).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == w
        assert not (r.base_failed and r.kept)
