"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad; its potential sees its own features and those of both neighbours, and a transition
matrix ties neighbouring lines.  In training, lines take their document's label.  Forward-backward gives each line's
marginal; their average, weighted by length, is calibrated to the document's score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.bytescan import WORD, Hasher, byte_table, class_of, per_doc, runs
from siltstone.llm.common import batches, discard, docs_of, table, written

#: Labelled documents that the field is fitted on at most (those whose doc_id hashes lowest; a fifth of them calibrates),
#: gradient steps, ridge, bound of a standardised feature.
SAMPLE = 8_000
STEPS = 250
RIDGE = 1e-3
#: Lines that are learned from at most, 15 numbers each on the driver.
LINES = 1_000_000
CLIP = 4.0

FEATURES = [
    "log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "punctuation", "not_ascii", "shouts", "bars",
    "starts_upper", "ends_stop", "distinct", "stutter", "seen_before",
]


def line_features(data, offsets, hasher: Hasher):
    """(features of every line with a word, first line of each document and the end, bytes of each line)."""
    import numpy as np

    prefix = hasher.prefix(data)
    inside = WORD[data]
    starts, ends = runs(inside, offsets)
    words = hasher.ranges(prefix, starts, ends)
    begins, stops = runs(data != 10, offsets)
    first, last = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    has = last > first
    begins, stops, first, last = begins[has], stops[has], first[has], last[has]
    at = per_doc(begins, offsets)
    n, size = (last - first).astype(np.float64), (stops - begins).astype(np.float64)

    def total(mask):
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[stops] - sums[begins]).astype(np.float64)

    head, tail = data[starts[first]] if len(first) else data[:0], data[ends[last - 1] - 1] if len(last) else data[:0]
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        np.cumsum(words[1:] == words[:-1], out=same[2:])
    line = np.repeat(np.arange(len(begins)), last - first)
    owned = words[np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange(len(line))] if len(line) else words[:0]
    order = np.lexsort((owned, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owned[order][1:] != owned[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(begins)).astype(np.float64)
    whole = hasher.ranges(prefix, begins, stops)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    order = np.lexsort((np.arange(len(whole)), whole, doc))
    seen = np.zeros(len(whole))
    if len(whole) > 1:
        seen[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    x = np.stack(
        [
            np.log1p(n), np.log1p(size), total(inside) / np.maximum(n, 1), total(class_of((65, 90))[data]) / size, total(class_of((48, 57))[data]) / size,
            total(class_of(*((b, b) for b in b"#*$%&<>"))[data]) / size, total(class_of((33, 47), (58, 64), (91, 96), (123, 126))[data]) / size,
            total(data >= 128) / size, total(data == 33) / n, total(data == 124) / n, ((head >= 65) & (head <= 90)) | (head >= 128),
            (tail == 46) | (tail == 33) | (tail == 63), distinct / np.maximum(n, 1), (same[last] - same[np.minimum(first + 1, last)]) / np.maximum(n, 1), seen,
        ],
        1,
    ) if len(n) else np.zeros((0, len(FEATURES)))
    return x, at, size


def design(x, at, mean, scale):
    """Standardised own and neighbours' features, with a flag for a missing neighbour and a constant."""
    import numpy as np

    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    n, k = z.shape
    out = np.zeros((n, 3 * k + 3))
    out[:, :k] = z
    out[1:, k : 2 * k] = z[:-1]
    out[:-1, 2 * k : 3 * k] = z[1:]
    first, last = at[:-1][at[1:] > at[:-1]], at[1:][at[1:] > at[:-1]] - 1
    out[first, k : 2 * k] = 0
    out[last, 2 * k : 3 * k] = 0
    out[first, 3 * k] = 1
    out[last, 3 * k + 1] = 1
    out[:, 3 * k + 2] = 1
    return out


def forward_backward(unary, at, transition):
    """Marginals of label 1 for each line, and the sum of expected transitions; documents advance side by side.

    unary: score of label 1 against label 0; at: first line of each document and the end; transition: 2 x 2 scores.
    """
    import numpy as np

    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, length = at[:-1][order], sizes[order]
    m = np.exp(transition)
    u = np.stack([np.ones(len(unary)), np.exp(np.clip(unary, -30, 30))], 1)
    alpha, beta = np.zeros((len(unary), 2)), np.ones((len(unary), 2))
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # documents longer than t
    for t in range(steps):
        i = begin[: alive[t]] + t
        a = u[i] if t == 0 else (alpha[i - 1] @ m) * u[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        i = begin[: alive[t + 1]] + t
        right = u[i + 1] * beta[i + 1]
        b = right @ m.T
        joint = alpha[i][:, :, None] * m[None] * right[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[i] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return (p[:, 1] / p.sum(1)) if len(p) else np.zeros(0), pairs


def _quality(p, at, size):
    """Length-weighted mean of the marginals; NaN for documents without a line."""
    import numpy as np

    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    weight = np.bincount(doc, size, len(at) - 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, size * p, len(at) - 1) / weight


def _logit(q):
    import numpy as np

    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def fit(documents: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE) -> dict:
    """Fit on labelled rows where ``training`` (a condition on doc_id) holds: a bounded sample, ``sample`` labelled ids in the
    order of their hash and of these as many as have ``LINES`` lines together.

    Null labels and ids are left out, repeated labels of an id count as their least, and all rows of documents that repeat an
    id are learned from.  Texts without a line teach nothing.  Without rows of both labels every text gets the same score."""
    import numpy as np

    ids = (
        labels.filter("quality is not null and doc_id is not null").filter(training)
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def run(it):
        import pyarrow as pa

        hasher = Hasher(byte_table())
        for batch, lo, hi, data, offsets in batches(it):
            x, at, size = line_features(data, offsets, hasher)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("y").slice(lo, hi - lo),
                    pa.array([x[at[i] : at[i + 1]].ravel() for i in range(hi - lo)], pa.list_(pa.float64())),
                    pa.array([size[at[i] : at[i + 1]] for i in range(hi - lo)], pa.list_(pa.float64())),
                ],
                names=["doc_id", "y", "x", "size"],
            )

    found = docs_of(documents).join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, y int, x array<double>, size array<double>")
    found = written(found, "labelled-lines")
    lines = found.groupBy("doc_id").agg(F.sum(F.size("size")).alias("n"))  # sample rows at most
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = lines.withColumn("all", F.sum("n").over(upto)).filter(F.col("all") <= LINES).select("doc_id")
    rows = found.join(F.broadcast(few), "doc_id").toPandas()
    discard(found)
    k = len(FEATURES)
    model = {"mean": np.zeros(k), "scale": np.ones(k), "w": np.zeros(3 * k + 3), "t": np.zeros((2, 2)), "a": 0.0, "b": 1.0}
    rows = rows[rows["size"].map(len) > 0].sort_values("doc_id")
    if not len(rows) or rows.y.nunique() < 2:
        return model

    def stacked(part):
        return np.concatenate([np.asarray(v).reshape(-1, k) for v in part.x]), np.concatenate([[0], np.cumsum(part["size"].map(len))]), np.concatenate([np.asarray(v) for v in part["size"]]), part.y.to_numpy()

    x, at, _, y = stacked(rows[np.arange(len(rows)) % 5 != 4])
    model["mean"], model["scale"] = x.mean(0), np.maximum(x.std(0), 1e-3)
    d = design(x, at, model["mean"], model["scale"])
    label = np.repeat(y, np.diff(at)).astype(np.float64)
    inner = np.ones(len(label), bool)
    inner[at[1:] - 1] = False
    true_pairs = np.array([[((1 - label) * inner).sum(), 0.0], [0.0, (label * inner).sum()]])
    theta = np.zeros(d.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p, pairs = forward_backward(d @ theta[:-4], at, theta[-4:].reshape(2, 2))
        gradient = np.concatenate([d.T @ (label - p), (true_pairs - pairs).ravel()]) / len(label) - RIDGE * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        theta += 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    model["w"], model["t"] = theta[:-4], theta[-4:].reshape(2, 2)
    part = rows[np.arange(len(rows)) % 5 == 4]
    if part.y.nunique() == 2:
        x, at, size, y = stacked(part)
        p, _ = forward_backward(design(x, at, model["mean"], model["scale"]) @ model["w"], at, model["t"])
        v = np.stack([np.ones(len(y)), _logit(_quality(p, at, size))], 1)
        c = np.array([0.0, 1.0])
        for _ in range(100):
            s = 1 / (1 + np.exp(-np.clip(v @ c, -30, 30)))
            c += np.linalg.solve((v * (s * (1 - s) + 1e-6)[:, None]).T @ v + 0.1 * np.eye(2), v.T @ (y - s) - 0.1 * (c - np.array([0.0, 1.0])))
        model["a"], model["b"] = float(c[0]), float(max(c[1], 0.05))
    return model


def score_quality(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) and n_lines for every row.  A null, empty or blank text has no good line: score 0."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(it):
        import numpy as np
        import pyarrow as pa

        m, hasher = sent.value, Hasher(byte_table())
        for batch, lo, hi, data, offsets in batches(it):
            x, at, size = line_features(data, offsets, hasher)
            p, _ = forward_backward(design(x, at, m["mean"], m["scale"]) @ m["w"], at, m["t"])
            q = _quality(p, at, size)
            score = np.where(np.isnan(q), 0.0, 1 / (1 + np.exp(-np.clip(m["a"] + m["b"] * _logit(np.nan_to_num(q)), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(score), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "score", "n_lines"])

    return docs_of(documents).mapInArrow(run, "doc_id long, score double, n_lines long")


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: whole ``documents``; labels of rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"), ~held_out())
    return score_quality(documents, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_lines")
