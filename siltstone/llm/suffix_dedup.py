"""Removal of byte strings that an earlier document has, by blockwise suffix sorting with a difference cover.

Only suffixes that can matter are sorted.  Every window of ``length`` bytes has an anchor, its least hashed 20-gram (the
leftmost of equals); windows in a row with one anchor form a strip.  Equal windows have equal anchors at equal places, so

1. one scan finds the anchors, and a shuffle of their hashes those that several documents have;
2. the strips of these are bucketed by anchor; equal strips (by hash, then by bytes) are merged, the first document's is kept;
3. buckets are sorted one block at a time.  A block's text is its distinct strips, each laid out with its anchor at a
   multiple of V.  Ranks of the suffixes at a difference cover modulo V are computed first; then each suffix at which a
   window starts is sorted by its first V bytes, and longer ties by the rank of the cover position that follows at the
   same distance.  Neighbours that agree on ``length`` bytes are occurrences of one string: all but those of the smallest
   doc_id are marked.

A block has a bounded number of strips, and an anchor with more than HOT of them is split further, by window.
Copies of whole texts are settled by their hash first and never reach step 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytescan import Hasher, byte_table, mix
from siltstone.llm.common import batches, broadcast_if_small, discard, docs_of, release, table, written

GRAM = 20
V = 16
#: Bits of a gram's hash that hold a distance while the least gram is looked for; windows have fewer grams than this.
DISTANCE = 4095

#: Anchors held by a task before it sends them on; anchors in a bucket of step 1 on average; strips of a block (a bucket
#: is not cut); strips from which an anchor is split by window.
HELD = 1_000_000
BUCKET = 400_000
BLOCK = 25_000
HOT = 50_000
#: Ranges of anchors whose strips are shuffled and sorted one after the other.
PASSES = 3


def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo v is one of two of them; greedy, 0 first."""
    cover = [0]
    while len({(a - b) % v for a in cover for b in cover}) < v:
        have = {(a - b) % v for a in cover for b in cover}
        cover.append(max((c for c in range(v) if c not in cover), key=lambda c: (len(have | {(c - a) % v for a in cover} | {(a - c) % v for a in cover}), -c)))
    return sorted(cover)


def strips(data, offsets, hasher: Hasher, length: int):
    """(document, first window, number of windows, anchor, hash of the anchor) of every strip of a batch, in order."""
    import numpy as np

    width, n = length - GRAM + 1, len(data)
    if width > DISTANCE:
        raise ValueError(f"length is at most {DISTANCE + GRAM - 1}")
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix = hasher.prefix(data)
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * hasher.inverse[: n - GRAM + 1])
    # The least gram of each window and how far from the window's start it is, in one number: its low bits hold the distance.
    least, span = gram & np.uint64(~DISTANCE & (1 << 64) - 1), 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:] + np.uint64(step))
        span += step
    at = np.arange(len(least)) + (least & np.uint64(DISTANCE)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    good = np.flatnonzero(np.arange(len(at)) + length <= ends)
    if not len(good):
        return none, none, none, none, np.zeros(0, np.uint64)
    a = at[good]
    new = np.ones(len(good), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[good][1:] != doc[good][:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(good)]]))
    return doc[good[first]], good[first], count, a[first], gram[a[first]]


def _anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows of packed anchors.  key: bucket; kind 0: anchors to be met in their bucket (doc -1: a stand-in for those that
    this task knows to be in several documents), kind 1: the latter, on a key of their own that spreads them."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(byte_table())
        held: list = []

        def pack(key, kind, h, doc, x, at):
            parts = [h.astype("<u8"), doc.astype("<i8"), x.astype("<i8"), at.astype("<i4")]
            body = b"".join(np.ascontiguousarray(p).tobytes() for p in parts[1:])
            return key, kind, len(h), parts[0].tobytes(), pa.compress(body, codec="zstd", asbytes=True)

        def flush():
            h, doc, x, at = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, h))
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            group = np.cumsum(new) - 1
            low = np.minimum.reduceat(doc[order], np.flatnonzero(new))
            high = np.maximum.reduceat(doc[order], np.flatnonzero(new))
            many = np.empty(len(h), bool)
            many[order] = (low != high)[group]
            rows = []
            stand_in = h[order][np.flatnonzero(new)][low != high]
            h0 = np.concatenate([h[~many], stand_in])
            doc0, x0, at0 = (np.concatenate([c[~many], np.full(len(stand_in), fill)]) for c, fill in ((doc, -1), (x, 0), (at, 0)))
            bucket = ((h0 >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                i = by[cut[b] : cut[b + 1]]
                rows.append(pack(int(b), 0, h0[i], doc0[i], x0[i], at0[i]))
            known = np.flatnonzero(many)
            for k in range(0, len(known), 65_536):
                i = known[k : k + 65_536]
                rows.append(pack(int(h[i[0]] % np.uint64(buckets)), 1, h[i], doc[i], x[i], at[i]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), kinds, strict=True)], names=["key", "kind", "n", "h", "body"])

        total = 0
        for batch, lo, hi, data, offsets in batches(it, 1 << 18):
            doc, _, _, anchor, h = strips(data, offsets, hasher, length)
            ids, xs = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("doc_id", "x"))
            held.append((h, ids[doc], xs[doc], anchor - offsets[doc]))
            total += len(h)
            if total >= HELD:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return docs.mapInArrow(run, "key long, kind int, n int, h binary, body binary")


def _repeated(packed: DataFrame) -> DataFrame:
    """(doc_id, x, at, h) of the anchors that several documents have; packed: sorted by key within its partitions."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        def open_row(n, h, body):
            raw = pa.decompress(body, 20 * n, codec="zstd", asbytes=True)
            return np.frombuffer(h, "<u8"), np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<i4", n, 16 * n)

        def out(h, doc, x, at):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(x), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["doc_id", "x", "at", "h"])

        def bucket(rows):
            h, doc, x, at = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.lexsort((doc, h))
            h, doc, x, at = h[order], doc[order], x[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            several = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) | ((doc[first] == -1) & (size > 1))
            take = np.repeat(several, size) & (doc != -1)
            return out(h[take], doc[take], x[take], at[take])

        now, rows = None, []
        for batch in it:
            for key, kind, n, h, body in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "n", "h", "body")), strict=True):
                if kind == 1:
                    yield out(*open_row(n, h, body))
                    continue
                if key != now and rows:
                    yield bucket(rows)
                    rows = []
                now = key
                rows.append(open_row(n, h, body))
        if rows:
            yield bucket(rows)

    return packed.mapInArrow(run, "doc_id long, x long, at int, h long")


_FLOW = "turn int, key long, kind int, doc_id long, x long, first int, size int, strip binary"


def part_unequal(new, order, strip) -> None:
    """Set ``new`` for each strip in ``order`` that has other bytes than the one before it, though their hashes are equal."""
    for k in (~new).nonzero()[0]:
        if strip(order[k]) != strip(order[k - 1]):
            new[k] = True


def _strips(docs: DataFrame, length: int, hot) -> DataFrame:
    """docs: (doc_id, x, text, ats).  Rows of _FLOW, turn being the anchor's range: kind 0 a strip of the task's first document with it, kind 1 a strip
    that an earlier document of this task has as well (no bytes)."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        hasher, split = Hasher(byte_table()), np.array(sorted(hot.value), np.int64)
        held: list = []

        def flush():
            key, doc, x, first, size = (np.concatenate([h[i] for h in held]) for i in range(5))
            mark = np.concatenate([h[5] for h in held])
            texts = [h[6] for h in held]
            start = np.concatenate([h[7] for h in held])
            source = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            held.clear()
            order = np.lexsort((doc, mark, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (mark[order][1:] != mark[order][:-1])
            part_unequal(new, order, lambda i: texts[source[i]][start[i] : start[i] + size[i]])
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            later = doc[order] > least
            kept = order[~later]  # of the first document with it, wherever it has it
            done = order[later]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            names = ["turn", "key", "kind", "doc_id", "x", "first", "size", "strip"]
            for i, kind in ((kept, 0), (done, 1)):
                for k in range(0, len(i), 8192):
                    j = i[k : k + 8192]
                    body = [texts[source[q]][start[q] : start[q] + size[q]] for q in j] if kind == 0 else [None] * len(j)
                    keys = key[j] if kind == 0 else mix(doc[j].view(np.uint64)).view(np.int64)
                    turn = (keys.view(np.uint64) % np.uint64(PASSES)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((turn, keys, np.full(len(j), kind), doc[j], x[j], first[j], size[j], body), kinds, strict=True)], names=names)

        total = 0
        for batch, lo, hi, data, offsets in batches(it, 1 << 18):
            doc, window, count, anchor, h = strips(data, offsets, hasher, length)
            ats = batch.column("ats").slice(lo, hi - lo)
            where = np.repeat(offsets[:-1], np.asarray(ats.value_lengths())) + np.asarray(ats.flatten())
            take = np.isin(anchor, where)
            doc, window, count, h = doc[take], window[take], count[take], h[take].view(np.int64)
            if not len(doc):
                continue
            size = count + length - 1
            cut = np.isin(h, split)
            if cut.any():
                each = count[cut]
                w = np.repeat(window[cut] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
                doc = np.concatenate([doc[~cut], np.repeat(doc[cut], each)])
                window, size = np.concatenate([window[~cut], w]), np.concatenate([size[~cut], np.full(len(w), length)])
                own = hasher.ranges(hasher.prefix(data), w, w + length).view(np.int64)
                h = np.concatenate([h[~cut], own])
            mark = hasher.ranges(hasher.prefix(data), window, window + size)
            ids, xs = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("doc_id", "x"))
            held.append((h, ids[doc], xs[doc], window - offsets[doc], size, mark, data.tobytes(), window))
            total += len(h)
            if total >= 300_000:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return docs.mapInArrow(run, _FLOW)


def repeated_windows(key, doc, body: list, length: int):
    """Sort the window suffixes of a block of strips, bucket by bucket; (strip, window) of all whose string an earlier
    document of the block has.  key: bucket of each strip; strips of one bucket have their anchors at equal distances."""
    import numpy as np

    cover = difference_cover(V)
    next_cover = np.array([min((c - r) % V for c in cover) for r in range(V)])
    # Windows of a strip share one anchor, so aligning strips by where it lies gives equal windows one residue.
    hasher = Hasher(byte_table())
    sizes = np.array([len(b) for b in body], np.int64)
    raw = np.frombuffer(b"".join(body), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])
    prefix = hasher.prefix(raw)
    # The anchor: the least 20-gram of the first window.
    grid = at[:-1][:, None] + np.arange(length - GRAM + 1)[None]
    gram = mix((prefix[grid + GRAM] - prefix[grid]) * hasher.inverse[grid])
    lead = (-(gram & np.uint64(~DISTANCE & (1 << 64) - 1)).argmin(1)) % V
    room = (lead + sizes + 4 * V + V - 1) // V * V
    base = np.concatenate([[0], np.cumsum(room)])
    text = np.zeros(int(base[-1]) + 8 * V, np.uint8)
    spot = np.repeat(base[:-1] + lead - at[:-1], sizes) + np.arange(len(raw))
    text[spot] = raw
    words = np.lib.stride_tricks.sliding_window_view(text, 8)

    def word(i):
        return np.ascontiguousarray(words[i]).view(">u8").ravel().astype(np.uint64)

    def dense(*keys):
        """Ranks of rows by keys, most significant first."""
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    # Cover-sample ranks by V bytes, then twice doubled: 4 V bytes, more than a window has left after V.
    every = np.arange(len(text) - 8 * V)
    sample = every[np.isin(every % V, cover)]
    rank = np.zeros(len(text) + 4 * V, np.int64)
    rank[sample] = dense(word(sample), word(sample + 8)) + 1
    for reach in (V, 2 * V):
        rank[sample] = dense(rank[sample], rank[sample + reach]) + 1

    count = sizes - length + 1
    strip = np.repeat(np.arange(len(body)), count)
    window = np.arange(len(strip)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    suffix = base[strip] + lead[strip] + window
    residue = suffix % V
    order = np.lexsort((doc[strip], rank[suffix + next_cover[residue]], residue, word(suffix + 8), word(suffix), key[strip]))
    s = suffix[order]
    same = np.zeros(len(s), bool)
    same[1:] = key[strip[order]][1:] == key[strip[order]][:-1]
    candidates = np.flatnonzero(same)
    for k in range(0, len(candidates), 100_000):  # agreement of neighbours on all bytes
        c = candidates[k : k + 100_000]
        rows = np.lib.stride_tricks.sliding_window_view(text, length)
        same[c] = (rows[s[c]] == rows[s[c - 1]]).all(1)
    run = np.cumsum(~same) - 1
    least = np.minimum.reduceat(doc[strip[order]], np.flatnonzero(~same)) if len(s) else np.zeros(0, np.int64)
    hit = order[doc[strip[order]] > least[run]] if len(s) else order
    return strip[hit], window[hit]


def _sorted_blocks(flow: DataFrame, length: int) -> DataFrame:
    """(doc_id, x, first, size): byte ranges covered by strings of earlier documents; flow: _FLOW sorted by key."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

        def out(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "x", "first", "size"])

        def block(rows):
            key, doc, x, first, size = (np.concatenate([np.asarray(r.column(c)) for r in rows]) for c in ("key", "doc_id", "x", "first", "size"))
            body = [b for r in rows for b in r.column("strip").to_pylist()]
            # Equal strips: the first document's stays, the others are covered whole.
            hasher, at = Hasher(byte_table()), np.concatenate([[0], np.cumsum(size.astype(np.int64))])
            mark = hasher.ranges(hasher.prefix(np.frombuffer(b"".join(body), np.uint8)), at[:-1], at[1:])
            order = np.lexsort((doc, mark, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (mark[order][1:] != mark[order][:-1])
            part_unequal(new, order, body.__getitem__)
            group = np.cumsum(new) - 1
            least = doc[order][np.flatnonzero(new)][group]
            later = order[doc[order] > least]
            if len(later):
                yield out(doc[later], x[later], first[later], size[later])
            kept = order[new]
            twins, of = order[doc[order] == least], group[doc[order] == least]  # the first document may have it several times
            k, n = np.unique(key[kept], return_counts=True)
            groups = np.flatnonzero(np.isin(key[kept], k[n > 1]))
            kept = kept[groups]
            if len(kept):
                strip, window = repeated_windows(key[kept], doc[kept], [body[i] for i in kept], length)
                low, high = np.searchsorted(of, groups[strip]), np.searchsorted(of, groups[strip], "right")
                each = high - low
                i = twins[np.repeat(low - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())]
                w = np.repeat(window, each)
                order = np.lexsort((w, i))
                i, w = i[order], w[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (w[1:] != w[:-1] + 1)
                start = np.flatnonzero(new)
                if len(start):
                    last = np.concatenate([start[1:], [len(i)]]) - 1
                    j = i[start]
                    yield out(doc[j], x[j], first[j] + w[start], w[last] - w[start] + length)

        held, total, last = [], 0, None
        for batch in it:
            kind = np.asarray(batch.column("kind"))
            if (kind == 1).any():
                done = batch.filter(pa.array(kind == 1))
                yield out(*(np.asarray(done.column(c)) for c in ("doc_id", "x", "first", "size")))
                batch = batch.filter(pa.array(kind == 0))
            while batch.num_rows:
                keys = np.asarray(batch.column("key"))
                if total >= BLOCK:
                    cut = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                    if cut:
                        held.append(batch.slice(0, cut))
                        batch = batch.slice(cut)
                    if not batch.num_rows:
                        break
                    yield from block(held)
                    held, total = [], 0
                    keys = np.asarray(batch.column("key"))
                take = min(len(keys), BLOCK - total)
                held.append(batch.slice(0, take))
                total, last = total + take, keys[take - 1]
                batch = batch.slice(take)
        if held:
            yield from block(held)

    return flow.mapInArrow(run, "doc_id long, x long, first int, size int")


def repeated_spans(documents: DataFrame, length: int = 50, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(docs, spans): doc_id, x (hash of the text), text, copy (an equal text has a smaller doc_id) of every row with a
    doc_id; and (doc_id, x, spans), merged byte ranges [first, end) covered by strings that earlier documents have."""
    spark = documents.sparkSession
    docs = docs_of(documents).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("x", F.xxhash64("text"))
    seen = docs.select("doc_id", "x", F.xxhash64(F.reverse("text")).alias("y"), F.octet_length("text").alias("n"))
    classes = seen.groupBy("x", "y", "n").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    repeats = written(classes.filter("low <> high").select("x", "y", "n", "low"), "copied")
    total = seen.agg(F.sum("n")).first()[0] or 0
    # y costs a second reading of the text, so it isn't a key of the join: it is compared where x and n agree.
    same = F.expr("d.x = r.x and octet_length(d.text) = r.n and (xxhash64(reverse(d.text)) ^ r.y) = 0L")
    docs = docs.alias("d").join(broadcast_if_small(repeats, 40).alias("r"), same, "left").select("d.*", F.coalesce(F.col("d.doc_id") > F.col("r.low"), F.lit(False)).alias("copy"))
    buckets = max(16, int(total) // (16 * BUCKET))
    packed = _anchors(docs.filter("not copy").select("doc_id", "x", "text"), length, buckets)
    found = written(_repeated(packed.repartition("key").sortWithinPartitions("key")), "anchors")
    del packed
    release(spark)
    crowded = [r["h"] for r in found.groupBy("h").count().filter(F.col("count") > hot).select("h").collect()]  # at most rows / hot
    hashes = spark.sparkContext.broadcast(crowded)
    ats = found.groupBy("doc_id", "x").agg(F.collect_list("at").alias("ats"))
    rich = docs.filter("not copy").select("doc_id", "x", "text").join(ats, ["doc_id", "x"])
    flow = written(_strips(rich, length, hashes), "strips")
    del rich, ats
    discard(found)
    release(spark)
    ranges = None
    for turn in range(PASSES):
        own = flow.filter(F.col("turn") == turn).drop("turn")
        part = written(_sorted_blocks(own.repartition("key").sortWithinPartitions("key"), length), "ranges")
        ranges = part if ranges is None else ranges.unionByName(part)
        release(spark)
    discard(flow)
    spans = ranges.groupBy("doc_id", "x").agg(F.array_sort(F.collect_list(F.struct("first", (F.col("first") + F.col("size")).alias("end")))).alias("ranges"))
    return docs, spans


def remove_repeats(documents: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """Return, for every row with a doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the
    remaining bytes): each byte goes that is covered by a string of ``length`` bytes which starts in a document with a
    smaller doc_id as well.  Strings are judged on the input; null counts as empty; texts shorter than ``length`` stay.
    Rows that repeat a doc_id don't count as earlier for each other.
    """
    docs, spans = repeated_spans(documents, length, hot)

    def run(it):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in it:
            n, removed, runs, digest, kept = [], [], [], [], []
            for text, copy, ranges in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("ranges"), strict=True):
                data = text.as_buffer().to_pybytes()
                gone = [(0, len(data))] if copy and len(data) >= length else []
                if not gone and ranges.is_valid:
                    pairs = ranges.values
                    first, end = np.asarray(pairs.field(0)), np.maximum.accumulate(np.asarray(pairs.field(1)))
                    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
                    gone = list(zip(first[new].tolist(), end[np.concatenate([new[1:], [len(first)]]) - 1].tolist(), strict=True))
                at, parts = 0, []
                for a, b in gone:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                kept.append(b"".join(parts))
                n.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                runs.append(len(gone))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(spans, ["doc_id", "x"], "left").select("doc_id", "text", "copy", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: whole ``documents``, 50 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
