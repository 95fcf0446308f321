"""Periodic runs of words: maximal stretches that repeat a period three times or more.

A text's words are read in one pass without a shuffle.  Where a run is, each 8-word gram occurs again at most a third of the
stretch away (a run has 24 words and three periods at least, so a gram that has no room for the next one has room for the
one before); numpy finds these stretches by hash, and every run of the text lies within one of them.  A stretch is then
read exactly, by words and not by hash:

* its suffix automaton is built; states are taken by falling length, and the ordered set of end positions of each is merged
  into its suffix link's, the smaller set into the larger one;
* an inserted position at distance d from a neighbour, with d no more than the length of the state, means that two
  occurrences touch or overlap: a square of period d;
* a square that no found run of its period holds is extended to both sides as long as words d apart are identical.  While a
  state's set still grows, d can be a multiple of the smallest period, whose own squares extend to the same stretch: of the
  periods found for a stretch the smallest counts.

Memory is one text and the automaton of one stretch (about 500 bytes for a word of the stretch).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytescan import Hasher, byte_table, mix
from siltstone.llm.common import batches, docs_of, table
from siltstone.llm.suffix_trees import rolling, word_hashes

GRAM = 8


def suffix_automaton(symbols: list) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of the states; end: the end position that a state was made for, -1 for clones and the root."""
    follow, length, link, end = [{}], [0], [-1], [-1]
    last = 0
    for i, c in enumerate(symbols):
        now = len(length)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(length)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return length, link, end


def squares(symbols: list):
    """(position, period, length): the ``length`` words that end at ``position`` occur ``period`` <= ``length`` words earlier too.

    End positions are kept from the last one on, as negative numbers: long states come first and end late, so that what is
    put into a set mostly goes to its end."""
    length, link, end = suffix_automaton(symbols)
    by_length: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for state, n in enumerate(length):
        by_length[n].append(state)
    ends = [[-e] if e >= 0 else [] for e in end]
    for n in range(len(symbols), 0, -1):
        for state in by_length[n]:
            parent = link[state]
            if parent <= 0:
                ends[state] = []
                continue
            small, large = ends[state], ends[parent]
            ends[state] = []
            if len(small) > len(large):
                small, large = large, small
            most = length[parent]
            for e in small:
                k = bisect_left(large, e)
                if k and e - large[k - 1] <= most:
                    yield -large[k - 1], e - large[k - 1], most
                if k < len(large) and large[k] - e <= most:
                    yield -e, large[k] - e, most
                large.insert(k, e)
            ends[parent] = large


def runs_of(symbols: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs with max(least, times * period) words or more, in order; times: 2 or more."""
    found: dict[int, tuple[list[int], list[int]]] = {}  # by period: first and last place that equals the one a period before
    out: dict[tuple[int, int], int] = {}
    n = len(symbols)
    for at, d, _ in squares(symbols):
        firsts, lasts = found.setdefault(d, ([], []))
        k = bisect_right(firsts, at) - 1
        if k >= 0 and at <= lasts[k]:
            continue
        low = high = at
        while low - 1 >= d and symbols[low - 1] == symbols[low - 1 - d]:
            low -= 1
        while high + 1 < n and symbols[high + 1] == symbols[high + 1 - d]:
            high += 1
        firsts.insert(k + 1, low)
        lasts.insert(k + 1, high)
        length = high - low + 1 + d
        if length >= max(least, times * d):
            out[low - d, length] = min(d, out.get((low - d, length), d))
    return sorted(((start, length, d) for (start, length), d in out.items()), key=lambda r: (r[0], r[2]))


def stretches(words, cut, least: int = 24, times: int = 3):
    """(first, end) of the stretches of words that may hold runs; words: hashes, cut: first words of the texts."""
    import numpy as np

    none = np.zeros(0, np.int64)
    gram = min(GRAM, least // times)
    if len(words) < least:
        return none, none
    grams = rolling(words, gram)
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[: len(grams)]
    inside = np.arange(len(grams)) + gram <= cut[1:][doc]
    key = mix(grams + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key[inside])
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return none, none
    at = np.flatnonzero(inside & np.isin(key, again))
    order = np.lexsort((at, key[at]))
    gap = np.diff(at[order])
    gap[key[at][order][1:] != key[at][order][:-1]] = len(words)
    near = np.empty(len(at), np.int64)
    near[order] = np.minimum(np.append(gap, len(words)), np.insert(gap, 0, len(words)))
    while True:
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (doc[at][1:] != doc[at][:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        span = np.repeat(size + gram - 1, size)
        stay = (span >= least) & (near * times <= span)
        if stay.all():
            return at[begin], at[begin] + size + gram - 1
        at, near = at[stay], near[stay]
        if not len(at):
            return none, none


def periodic_runs(documents: DataFrame, order: Callable | None = None, least: int = 24, times: int = 3) -> DataFrame:
    """For every row doc_id, runs (array of start, length, period, by start and period) and collapsed (the words that are
    left, joined by one space): a run loses all words after its first period.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of
    max(least, times * q) or more that no neighbouring word extends.  Words lie between bytes 0x20 and 0x09-0x0D.  Null, empty
    and blank texts have no words and no runs.  Repeated rows are read each.  Other columns are dropped.

    order: (doc_id, number of words) to the places of the words to read, or None for the words as they are.
    times: 3 or more; the search for stretches rests on it.
    """
    if times < 3 or least < times:
        raise ValueError("times must be 3 or more, and least no less than times")
    kind = docs_of(documents).schema["doc_id"].dataType.simpleString()
    read, frame = order, "array<struct<start: int, length: int, period: int>>"

    def run(it):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(byte_table())
        pair = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())])
        for batch, lo, hi, data, offsets in batches(it):
            hashes, cut = word_hashes(data, offsets, hasher)
            ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
            places = {}
            if read:
                for k, doc_id in enumerate(ids):
                    p = read(doc_id, int(cut[k + 1] - cut[k]))
                    if p is not None:
                        places[k] = p
                        hashes[cut[k] : cut[k + 1]] = hashes[cut[k] + p]
            first, end = stretches(hashes, cut, least, times)
            owner = np.searchsorted(cut, first, "right") - 1
            raw, found, left = data.tobytes(), [], []
            at = np.searchsorted(owner, np.arange(hi - lo + 1)).tolist()
            for k in range(hi - lo):
                words = raw[offsets[k] : offsets[k + 1]].split()
                if k in places:
                    words = [words[i] for i in places[k]]
                runs: list = []
                for i in range(at[k], at[k + 1]):
                    a, b = int(first[i] - cut[k]), int(end[i] - cut[k])
                    number: dict = {}
                    runs += [(a + s, n, q) for s, n, q in runs_of([number.setdefault(w, len(number)) for w in words[a:b]], least, times)]
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))])
                left.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(found, pa.list_(pair)), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs_of(documents).mapInArrow(run, f"doc_id {kind}, runs {frame}, collapsed string")


def planted(doc_id, n: int):
    """The contract's repeated words: with h = crc32(doc_id), for h % 10 = 0, words from a on repeat the first p of them."""
    import zlib

    import numpy as np

    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``periodic_runs``: the run with the greatest exact length / period (ties: smallest start,
    then period), its exponent in thousandths, and SHA-256 of all runs and of the collapsed text."""
    ahead = lambda x, y: x["length"].cast("long") * y["period"] > y["length"].cast("long") * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(ahead(r, best), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")),
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op11: whole ``documents`` with the contract's repeated words."""
    return digest(periodic_runs(table(spark, sf_dir, "documents"), planted))
