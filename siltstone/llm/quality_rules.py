"""Quality rules: text statistics, and an ordered decision list learned from labelled ones by sequential covering.

Each rule is a conjunction of thresholds that says "bad".  It is grown on two thirds of the sample by information gain
and pruned on the rest; rows it covers leave the sample and the next rule is grown, until a rule is no longer better than
a coin.  The list is emitted as one Spark conditional expression, so that applying it costs no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytescan import WORD, Hasher, byte_table, class_of, mix, per_doc, runs
from siltstone.llm.common import batches, docs_of, table

#: Labelled rows that a decision list is fitted on at most: those whose doc_id hashes lowest.
SAMPLE = 20_000

#: The base rules' symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "n_punct"]


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and COUNTS (longs) for every row: one scan, whole texts; a null text counts as empty."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(byte_table())
        lead = ~class_of((0x80, 0xBF))
        symbol, upper, digit = class_of(*((b, b) for b in SYMBOLS)), class_of((65, 90)), class_of((48, 57))
        stop, punct = class_of(*((b, b) for b in b".!?")), class_of((33, 47), (58, 64), (91, 96), (123, 126))
        for batch, lo, hi, data, offsets in batches(it):
            n = hi - lo
            out = {c: np.zeros(n, np.int64) for c in COUNTS}
            inside = WORD[data]

            def total(mask):
                sums = np.zeros(len(mask) + 1, np.int64)
                np.cumsum(mask, out=sums[1:])
                return sums[offsets[1:]] - sums[offsets[:-1]]

            for name, mask in (("word_chars", inside & lead[data]), ("n_symbols", symbol[data]), ("n_upper", upper[data]), ("n_digits", digit[data]), ("n_stops", stop[data]), ("n_punct", punct[data])):
                out[name] = total(mask)
            prefix = hasher.prefix(data)
            starts, ends = runs(inside, offsets)
            words, at = hasher.ranges(prefix, starts, ends), per_doc(starts, offsets)
            begins, stops = runs(data != 10, offsets)
            counted = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
            begins, stops = begins[counted], stops[counted]
            lines, line_at = hasher.ranges(prefix, begins, stops), per_doc(begins, offsets)
            for i in range(n):
                own = lines[line_at[i] : line_at[i + 1]]
                out["n_lines"][i] = len(own)
                out["n_dup_lines"][i] = len(own) - len(np.unique(own))
                w = words[at[i] : at[i + 1]]
                out["n_words"][i] = len(w)
                out["n_distinct"][i] = len(np.unique(w))
                if len(w) >= 4:
                    three = mix(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(0x9E3779B97F4A7C15) + w[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
                    order = np.argsort(three)
                    same = three[order][1:] == three[order][:-1]
                    if same.any():
                        twice = np.zeros(len(w) + 3, np.int64)
                        hit = np.zeros(len(three), bool)
                        hit[order[1:][same]] = hit[order[:-1][same]] = True
                        hit = np.flatnonzero(hit)
                        np.add.at(twice, hit, 1)
                        np.add.at(twice, hit + 3, -1)
                        out["n_repeat_words"][i] = int((np.cumsum(twice)[: len(w)] > 0).sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n).cast(pa.int64()), *(pa.array(out[c]) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs_of(documents).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


#: What rules may test, as SQL over COUNTS.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "punctuation_per_word": "n_punct / greatest(n_words, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _covered(x, rule):
    import numpy as np

    out = np.ones(len(x), bool)
    for k, sign, value in rule:
        out &= x[:, k] >= value if sign > 0 else x[:, k] <= value
    return out


def fit_decision_list(x, bad, max_rules: int = 16, max_conditions: int = 4, cuts: int = 48) -> list[list[tuple[int, int, float]]]:
    """Ordered rules [(feature, +1 for >= or -1 for <=, threshold), ...] for the rows where ``bad`` holds."""
    import numpy as np

    rules: list = []
    left = np.ones(len(x), bool)
    prune_part = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules:
        grow, prune = left & ~prune_part, left & prune_part
        if (bad & grow).sum() < 5:
            break
        rule, here = [], grow.copy()
        while len(rule) < max_conditions and (~bad & here).any():
            p0, n0 = (bad & here).sum(), (~bad & here).sum()
            base, best = math.log2(p0 / (p0 + n0)), (0.0, None)
            for k in range(x.shape[1]):
                v, y = x[here, k], bad[here]
                order = np.argsort(v, kind="stable")
                v, cum = v[order], np.cumsum(y[order])
                at = np.unique(np.linspace(0, len(v) - 1, cuts).astype(int))
                for value in np.unique(v[at]):
                    for sign in (1, -1):
                        i = np.searchsorted(v, value, "left" if sign > 0 else "right")
                        below = cum[i - 1] if i else 0
                        p, m = (cum[-1] - below, len(v) - i) if sign > 0 else (below, i)
                        if p and (gain := p * (math.log2(p / m) - base)) > best[0] + 1e-9:
                            best = (gain, (k, sign, float(value)))
            if best[1] is None:
                break
            rule.append(best[1])
            here = grow & _covered(x, rule)

        def worth(r):
            c = prune & _covered(x, r)
            p, m = (bad & c).sum(), c.sum()
            return (2 * p - m) / m if m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if not rule or worth(rule) <= 0:
            break
        rules.append(rule)
        left &= ~_covered(x, rule)
    return rules


def decision_column(rules: list, names: list[str]) -> Column:
    """The list as ``CASE WHEN rule1 THEN false WHEN rule2 THEN false ... ELSE true END``."""
    text = "".join(" when " + " and ".join(f"{FEATURES[names[k]]} {'>=' if s > 0 else '<='} {v!r}D" for k, s, v in r) + " then false" for r in rules)
    return F.expr(f"case{text} else true end") if rules else F.lit(True)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list, list[str]]:
    """Fit on at most ``sample`` labelled rows.  Null labels don't count; no usable label gives an empty list."""
    import numpy as np

    known = (
        labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = (
        text_statistics(documents.join(F.broadcast(known), "doc_id", "left_semi"))
        .join(F.broadcast(known), "doc_id")
        .select("doc_id", "quality", *(F.expr(e).alias(n) for n, e in FEATURES.items()))
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    names = list(FEATURES)
    if not len(rows):
        return [], names
    return fit_decision_list(rows[names].to_numpy(np.float64), (rows["quality"] == 0).to_numpy()), names


def quality_rules(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Return doc_id, the base counts, base_failed (under 50 words, or more than half of the words in repeated windows of
    three) and kept (not base_failed, and no learned rule says bad).  Null and empty texts have no words and fail.
    Labels may be missing, null or empty: then only the base rules hold.  Repeated rows are judged one by one.
    """
    rules, names = fit(documents, labels, sample)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return text_statistics(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & decision_column(rules, names)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: whole ``documents``, labels from ``labels``."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
