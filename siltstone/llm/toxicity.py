"""Toxic passages: all maximal scoring segments of token log-odds, judged by extreme-value statistics.

Log-odds of a token between toxic and clean training documents have an informative Dirichlet prior (the token's share in
both); tokens are whole words and the first four to six bytes of longer ones, so that inflected forms count together.  Words
whose log-odds are surely above 0 (by the likelihood ratio) score that much, all others a small negative drift.  A linear
scan finds every maximal segment.  A segment of score S in a text of n tokens has the normalised score lambda * S - log(K * n), with
lambda from the scores' distribution in clean text and K from the number of clean texts with a segment: by
extreme-value theory the greatest one follows a Gumbel law there.  Segments above a significance level count; their
evidence, calibrated on a held part of the training documents, is the document's score.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytescan import Hasher, byte_table, class_of, lowered, mix, per_doc, runs
from siltstone.llm.common import batches, broadcast_if_small, docs_of, table, written

#: Parameters of the model: rows that calibrate (a bounded sample of the labelled ones), prior weight, least signed root
#: of the likelihood ratio of a scoring token, score of any other token, significance level.
SAMPLE = 20_000
PRIOR = 500.0
LEAST_Z = 4.8
DRIFT = -0.6
LEVEL = 0.05

#: Letters, digits and everything outside ASCII.
TOKEN = class_of((48, 57), (65, 90), (97, 122), (128, 255))


#: Bytes of the prefixes that count as tokens of their own.
PREFIXES = (4, 5, 6)


def _tokens():
    """Words of a batch: (hashes of whole words, [(index of a longer word, hash of a prefix)], words per document, starts, ends)."""
    import numpy as np

    hasher = Hasher(lowered(byte_table()))

    def tokens(data, offsets):
        starts, ends = runs(TOKEN[data], offsets)
        prefix = hasher.prefix(data)
        parts = []
        for size in PREFIXES:
            longer = np.flatnonzero(ends - starts > size)
            parts.append((longer, mix(hasher.ranges(prefix, starts[longer], starts[longer] + size) ^ np.uint64(size))))
        return hasher.ranges(prefix, starts, ends), parts, per_doc(starts, offsets), starts, ends

    return tokens


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) of a sequence, in linear time, by Ruzzo and Tompa's method."""
    found: list = []  # start, end, sum before, sum through, index of the nearest earlier one with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        total += s
        if s <= 0:
            continue
        now = [i, i + 1, total - s, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            now[4] = j
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], i + 1, found[j][2], total, -1]
            del found[j:]
    return [(a, b, through - before) for a, b, before, through, _ in found]


def token_log_odds(labelled: DataFrame, prior: float = PRIOR) -> DataFrame:
    """labelled: (text, y).  Return (token, n1, n0, odds, z): documents of either class with the token, the log-odds, and
    the signed root of the likelihood ratio of its classes.  Every labelled document counts; each task adds up its own
    before the shuffle."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        tokens = _tokens()
        parts: dict = {0: [], 1: []}

        def merged(y):
            keys = np.concatenate([k for k, _ in parts[y]])
            counts = np.concatenate([c for _, c in parts[y]])
            keys, inverse = np.unique(keys, return_inverse=True)
            return keys, np.bincount(inverse, counts).astype(np.int64)

        def out(y):
            keys, counts = merged(y)
            parts[y] = []
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), y, np.int32)), pa.array(counts)], names=["token", "y", "n"])

        for batch, lo, hi, data, offsets in batches(it):
            label = batch.column("y").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
            whole, parts_of, at, _, _ = tokens(data, offsets)
            doc = np.repeat(np.arange(hi - lo), np.diff(at))
            docs = np.concatenate([doc, *(doc[k] for k, _ in parts_of)])
            found = np.concatenate([whole, *(h for _, h in parts_of)])
            order = np.argsort(docs, kind="stable")
            found, cut = found[order], np.searchsorted(docs[order], np.arange(hi - lo + 1))
            for y in (0, 1):
                own = [np.unique(found[cut[i] : cut[i + 1]]) for i in range(hi - lo) if label[i] == y]
                if own:
                    parts[y].append(np.unique(np.concatenate(own), return_counts=True))
                if sum(len(k) for k, _ in parts[y]) > 2_000_000:
                    yield out(y)
        for y in (0, 1):
            if parts[y]:
                yield out(y)

    counts = labelled.mapInArrow(run, "token long, y int, n long").groupBy("token").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0")
    )
    counts = written(counts, "token-counts")
    all1, all0 = counts.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0))).first()
    a = F.lit(prior) * (F.col("n1") + F.col("n0")) / float(max(1, all1 + all0))
    odds = lambda n, total: F.log((F.col(n) + a) / (float(total) + prior - F.col(n) - a))
    delta = odds("n1", all1) - odds("n0", all0)
    share = max(1e-9, min(1 - 1e-9, all1 / max(1, all1 + all0)))
    n = F.col("n1") + F.col("n0")
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * q))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("n1", share) + part("n0", 1 - share))))
    return counts.select("token", "n1", "n0", delta.alias("odds"), (F.signum(delta) * root).alias("z"))


class Scorer:
    """Segments of a batch; ``model``: vocabulary (sorted uint64), scores, lambda, log K."""

    def __init__(self, model: dict):
        import numpy as np

        self.model = model
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(model["tokens"] & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.tokens = _tokens()

    def __call__(self, data, offsets):
        """For each document: tokens, [(first byte, end byte, score, normalised score)]."""
        import numpy as np

        m = self.model
        whole, parts, at, starts, ends = self.tokens(data, offsets)
        best = np.zeros(len(whole))
        for index, found in ((None, whole), *parts):
            hits = np.flatnonzero(self.maybe[(found & np.uint64(0xFFFF)).astype(np.int64)])
            if len(hits):
                place = np.minimum(np.searchsorted(m["tokens"], found[hits]), len(m["tokens"]) - 1)
                real = m["tokens"][place] == found[hits]
                hits, gain = hits[real], m["scores"][place[real]]
                np.maximum.at(best, hits if index is None else index[hits], gain)
        hits = np.flatnonzero(best > 0)
        gain = best[hits]
        first = np.searchsorted(hits, at)
        out = []
        for i in range(len(offsets) - 1):
            n, lo, hi = int(at[i + 1] - at[i]), first[i], first[i + 1]
            segments = []
            if hi > lo:
                where = hits[lo:hi]
                gaps = np.diff(where) - 1
                scores = [float(gain[lo])]
                owner = [0]
                for k in range(1, hi - lo):
                    if gaps[k - 1]:
                        scores.append(float(gaps[k - 1]) * DRIFT)
                        owner.append(-1)
                    scores.append(float(gain[lo + k]))
                    owner.append(k)
                for a, b, s in maximal_segments(scores):
                    x, y = where[owner[a]], where[owner[b - 1]]
                    segments.append((int(starts[x] - offsets[i]), int(ends[y] - offsets[i]), s, m["lam"] * s - m["log_k"] - math.log(n)))
            out.append((n, segments))
        return out


def evidence(segments: list) -> float:
    """Normalised scores of the significant segments, added up; 0 without any."""
    floor = -math.log(-math.log(1 - LEVEL))
    return sum(s[3] for s in segments if s[3] >= floor)


def _labelled_texts(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(text, y) of the documents among known (doc_id, y).  Texts stay where they are while the labels are small enough to
    be sent to them; else labelled texts are shuffled, once: only one pass reads them."""
    docs = docs_of(documents).filter("doc_id is not null")
    return docs.join(broadcast_if_small(known, 24), "doc_id").select("text", "y")


def fit(documents: DataFrame, labels: DataFrame, training: Column) -> dict:
    """Learn from labelled rows where ``training`` (a condition on doc_id) holds; a ninth of their hash range calibrates.

    Repeated labels of a doc_id count as their greatest; rows of documents that repeat a doc_id all get its label.  Null
    labels and ids are left out.  Without any token that passes, or without labels, every text gets the same low score."""
    import numpy as np

    known = labels.filter("toxic is not null and doc_id is not null").filter(training).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = written(known, "labels")
    holds = F.pmod(F.xxhash64("doc_id"), F.lit(9)) == 0
    # Every token that passes is kept: 16 bytes each for the driver and the executors.
    best = token_log_odds(_labelled_texts(documents, known.filter(~holds))).filter(f"z >= {LEAST_Z} and odds > 0").select("token", "odds").toPandas()
    tokens = best["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    model = {"tokens": tokens[order], "scores": best["odds"].to_numpy(np.float64)[order], "lam": 1.0, "log_k": 0.0, "a": -6.0, "b": 0.0}
    if not len(tokens):
        return model
    # The sample is drawn from the ids, so that texts move for at most SAMPLE of them.
    held = known.filter(holds).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(SAMPLE)
    held = docs_of(documents).join(F.broadcast(held), "doc_id").select("doc_id", "text", "y")

    def run(it):
        import pyarrow as pa

        score = Scorer(model)
        for batch, lo, hi, data, offsets in batches(it):
            got = score(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").slice(lo, hi - lo), pa.array([n for n, _ in got], pa.int64()), pa.array([[s[2] for s in x] for _, x in got], pa.list_(pa.float64()))],
                names=["y", "n", "s"],
            )

    rows = held.mapInArrow(run, "y int, n long, s array<double>").toPandas()
    clean = rows[(rows.y == 0) & (rows.n > 0)]
    sizes = clean.n.to_numpy(np.float64)
    # Lambda solves E[exp(lambda * score)] = 1 over the tokens of clean texts, of which those of a text without a segment
    # all have the drift; half a token more keeps it finite.
    gains = np.array([v for s in clean.s for v in s] + [float(model["scores"].min())] * 1)
    share = np.full(len(gains), 1.0) / max(sizes.sum(), 2.0 * len(gains))
    lo, hi = 1e-6, 20.0
    for _ in range(100):
        mid = (lo + hi) / 2
        value = float((share * np.exp(np.minimum(mid * gains, 700))).sum() + (1 - share.sum()) * math.exp(mid * DRIFT))
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    model["lam"] = lo
    # K: as many clean texts with a segment as P(any in n tokens) = 1 - exp(-K * n * exp(-lambda * least score)) gives.
    some = sum(len(s) > 0 for s in clean.s) + 0.5
    reach = sizes * math.exp(-min(700.0, lo * float(model["scores"].min())))
    low, high = -60.0, 60.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if float((1 - np.exp(-math.exp(mid) * reach)).sum()) < some else (low, mid)
    model["log_k"] = low if len(sizes) else 0.0
    # Logistic calibration of the evidence by Newton steps with a weak ridge.
    x = np.array([evidence([(0, 0, v, lo * v - model["log_k"] - math.log(max(n, 1))) for v in s]) for s, n in zip(rows.s, rows.n, strict=True)])
    x, y, w = np.log1p(x), rows.y.to_numpy(np.float64), np.zeros(2)
    design = np.stack([np.ones(len(x)), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-2])
        w += np.linalg.solve(hessian, design.T @ (y - p) - np.array([1e-3, 1e-2]) * w)
    model["a"], model["b"] = float(w[0]), float(max(w[1], 0.0))
    return model


def toxic_passages(documents: DataFrame, model: dict) -> DataFrame:
    """Return doc_id, score (0 to 1), n_tokens and passages (first byte, end byte, normalised score; significant ones) for
    every row.  Null and empty texts have no passage and get the score of a text without evidence.  Repeated rows get the same
    score; of segments that tie all are given; passages never span two rows."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # the tokens that passed the likelihood ratio test, 16 bytes each
    floor = -math.log(-math.log(1 - LEVEL))

    def run(it):
        import pyarrow as pa

        m = sent.value
        score = Scorer(m)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch, lo, hi, data, offsets in batches(it):
            got = score(data, offsets)
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, m["a"] + m["b"] * math.log1p(evidence(x)))))) for _, x in got]
            spans = [[{"first": a, "end": b, "score": s} for a, b, _, s in x if s >= floor] for _, x in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(p), pa.array([n for n, _ in got], pa.int64()), pa.array(spans, kind)],
                names=["doc_id", "score", "n_tokens", "passages"],
            )

    return docs_of(documents).mapInArrow(run, "doc_id long, score double, n_tokens long, passages array<struct<first:long,end:long,score:double>>")


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: whole ``documents``; labels of rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"), ~held_out())
    return toxic_passages(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages")
    )
