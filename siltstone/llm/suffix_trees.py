"""Removal of word windows that occur more than once, by prefix-partitioned suffix trees.

A suffix is a place in a text, read as far as the window's width (branches further down don't change which words are
covered).  It is read in symbols that end after ``BOUNDARIES`` words and after the whole width; a symbol is the 64-bit hash
of its words, so two suffixes that agree on all symbols agree on 192 bits of hash.

1. One scan hashes every text's words and finds its anchors: the least hashed 8-word gram of each window.  Equal windows
   have equal anchors, so a window whose anchor occurs once in the corpus starts a suffix that is a leaf by itself.
2. The suffixes of all other windows are made from the texts.  Those that a task has several times are one leaf of weight 2;
   texts of equal words enter once, with weight 2.
3. Suffixes are split by prefix: by their first symbol, and where more than ``GROUP`` suffixes share it, by two, and then
   by all symbols, so that a group fits into memory.  After all symbols the suffixes of a group are equal, and it holds a
   row from each flush of a task at most.
4. A task has the suffixes of its groups in order and builds their subtrees, block by block, from the agreement of neighbours.
   Internal nodes as deep as the width are repeats: all windows at the leaves below are covered.  Windows that follow each
   other in a text merge into the maximal repeat.

Texts are known by two hashes, of their bytes (z) and of their words (x), both of 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytescan import WORD, Hasher, byte_table, mix, runs
from siltstone.llm.common import batches, broadcast_if_small, discard, docs_of, release, table, written

GRAM = 8
BOUNDARIES = (8, 16)
#: Suffixes that a group of one prefix may hold before the prefix is made longer; suffixes of a block; windows that a task
#: holds before it sends them on.
GROUP = 100_000
BLOCK = 200_000
HELD = 400_000


def boundaries(width: int) -> list[int]:
    """Words after which symbols of a suffix end; always three."""
    return [min(b, width) for b in BOUNDARIES] + [width]


def rolling(words, width: int):
    """Hashes of all ``width`` words in a row; width 0: of none."""
    import numpy as np

    n = max(len(words) - width + 1, 0)
    out = np.full(n, width, np.uint64)
    for k in range(width if n else 0):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)


def word_hashes(data, offsets, hasher: Hasher):
    """(hashes of all words of a batch, index of each document's first word and at last their number)."""
    import numpy as np

    start, end = runs(WORD[data], offsets)
    return hasher.ranges(hasher.prefix(data), start, end) if len(start) else np.zeros(0, np.uint64), np.searchsorted(start, offsets, "left")


def window_anchors(words, cut, width: int):
    """(document, first word, anchor's first word, anchor's hash) of every window; words and cut as ``word_hashes`` gives them."""
    import numpy as np

    gram = min(GRAM, width)
    span, least = width - gram + 1, rolling(words, gram)
    if len(words) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams, at, have = least, np.arange(len(least)), 1
    while have < span:
        step = min(have, span - have)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        have += step
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))[: len(at)]
    good = np.flatnonzero(np.arange(len(at)) + width <= cut[1:][doc])
    return doc[good], good, at[good], grams[at[good]]


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, z, x, y, n, hs, ps): hashes of the text's words as a sequence (x, y), their number, its anchors' hashes and places."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        import hashlib

        import numpy as np
        import pyarrow as pa

        hasher = Hasher(byte_table())
        for batch, lo, hi, data, offsets in batches(it):
            words, cut = word_hashes(data, offsets, hasher)
            doc, _, at, h = window_anchors(words, cut, width)
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            doc, at, h = doc[new], at[new], h[new]
            ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
            raw = data.tobytes()
            digests = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            xy = np.frombuffer(b"".join(d[:16] for d in digests), "<i8").reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (h.view(np.int64), (at - cut[doc]).astype(np.int32))]
            columns = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "z")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.array(np.diff(cut).astype(np.int32)), *lists], names=["doc_id", "z", "x", "y", "n", "hs", "ps"])

    return docs.mapInArrow(run, f"doc_id {kind}, z long, x long, y long, n int, hs array<long>, ps array<int>")


_FLOW = "kind int, s0 long, s1 long, s2 long, z long, x long, first int, size int"


def _suffixes(docs: DataFrame, width: int) -> DataFrame:
    """docs: (text, z, x, weight, ps).  Rows of _FLOW: kind 0 a suffix at word ``first`` (null: a leaf of weight 2, whose places
    are known to be covered), kind 1 a run of windows, ``size`` words from ``first``, that this task knows to be covered."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        hasher, ends = Hasher(byte_table()), [0, *boundaries(width)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = ["kind", "s0", "s1", "s2", "z", "x", "first", "size"]
        held: list = []

        def out(kind, s0, s1, s2, z, x, first, size):
            columns = (np.full(len(x), kind), s0.view(np.int64), s1.view(np.int64), s2.view(np.int64), z, x, first, size)
            for k in range(0, len(first), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 65_536], t, mask=(first[k : k + 65_536] < 0) if n in ("z", "x", "first") else None) for c, t, n in zip(columns, kinds, names, strict=True)], names=names)

        def flush():
            s0, s1, s2, weight, z, x, first = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((s2, s1, s0))
            s0, s1, s2, weight, z, x, first = (c[order] for c in (s0, s1, s2, weight, z, x, first))
            new = np.ones(len(s0), bool)
            new[1:] = (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            begin = np.flatnonzero(new)
            several = np.add.reduceat(weight, begin) > 1
            here = np.repeat(several, np.diff(np.concatenate([begin, [len(s0)]])))
            own = np.where(here, -1, first)
            take = ~here | new  # leaves of one place, and one for the places of the others
            yield from out(0, s0[take], s1[take], s2[take], z[take], x[take], own[take], np.zeros(take.sum(), np.int32))
            here &= weight == 1  # copied texts are known as such
            z, x, first = z[here], x[here], first[here]
            order = np.lexsort((first, x, z))
            z, x, first = z[order], x[order], first[order]
            new = np.ones(len(z), bool)
            new[1:] = (z[1:] != z[:-1]) | (x[1:] != x[:-1]) | (first[1:] != first[:-1] + 1)
            begin = np.flatnonzero(new)
            none = np.zeros(len(begin), np.int64)
            yield from out(1, none, none, none, z[begin], x[begin], first[begin], np.diff(np.concatenate([begin, [len(z)]])) + width - 1)

        total = 0
        for batch, lo, hi, data, offsets in batches(it):
            words, cut = word_hashes(data, offsets, hasher)
            doc, start, at, _ = window_anchors(words, cut, width)
            ps = batch.column("ps").slice(lo, hi - lo)
            where = np.repeat(cut[:-1], np.asarray(ps.value_lengths())) + np.asarray(ps.flatten())
            take = np.isin(at, where)
            doc, start = doc[take], start[take]
            if not len(doc):
                continue
            symbols = [rolling(words, b - a)[start + a] if b > a else np.zeros(len(start), np.uint64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            z, x, weight = (np.asarray(batch.column(c).slice(lo, hi - lo))[doc] for c in ("z", "x", "weight"))
            held.append((*symbols, weight, z, x, (start - cut[doc]).astype(np.int32)))
            total += len(doc)
            if total >= HELD:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return docs.mapInArrow(run, _FLOW)


def split_by_prefix(suffixes: DataFrame, group: int = GROUP) -> DataFrame:
    """Add ``symbols``: the length of the shortest prefix that ``group`` suffixes at most share, or all symbols."""
    crowded: list[DataFrame] = []
    rest, prefix = suffixes, []
    for s in ("s0", "s1"):
        prefix.append(s)
        found = written(rest.groupBy(*prefix).count().filter(F.col("count") > group).select(*prefix), "crowded")  # rows / group at most
        if found.isEmpty():
            break
        found = broadcast_if_small(found, 8 * len(prefix))
        crowded.append(found.withColumn(f"c{len(prefix)}", F.lit(1)))
        rest = rest.join(found, prefix, "left_semi")
    del rest
    release(suffixes.sparkSession)
    out = suffixes
    for i, found in enumerate(crowded):
        out = out.join(found, prefix[: i + 1], "left")
    longer = [F.coalesce(F.col(f"c{i + 1}"), F.lit(0)) for i in range(len(crowded))]
    return out.select(*suffixes.columns, sum(longer, F.lit(1)).alias("symbols"))


def grouped(split: DataFrame) -> DataFrame:
    """Deal suffixes out by prefix, each partition in the trees' order."""
    prefix = F.when(F.col("symbols") == 1, F.xxhash64("s0")).when(F.col("symbols") == 2, F.xxhash64("s0", "s1")).otherwise(F.xxhash64("s0", "s1", "s2"))
    return split.repartition(prefix).sortWithinPartitions("s0", "s1", "s2")


def subtree_nodes(symbols, weight, ends):
    """Internal nodes of the suffix tree of some suffixes.  symbols: their symbols, an array for each place, in the tree's
    order; weight: suffixes that a leaf stands for; ends: words after which each symbol ends.

    Returns (depth, low, high): depth in words, and the leaves below, low <= leaf < high.  A leaf of weight 2 is a node of
    equal suffixes, so it is among them.
    """
    import numpy as np

    n = len(weight)
    agree = np.zeros(n, np.int64)  # words on which a suffix agrees with the one before it
    same = np.ones(max(n - 1, 0), bool)
    for s, end in zip(symbols, ends, strict=True):
        same &= s[1:] == s[:-1]
        agree[1:][same] = end
    nodes = []
    for end in dict.fromkeys(ends):
        low = np.flatnonzero(agree < end)
        high = np.append(low[1:], n)[: len(low)]
        branch = np.add.reduceat(agree == end, low) > 0 if n else low > 0  # neighbours part right there
        if n and end == ends[-1]:
            branch |= np.add.reduceat(weight, low) > 1
        nodes.append((np.full(branch.sum(), end), low[branch], high[branch]))
    return tuple(np.concatenate(c) for c in zip(*nodes, strict=True))


def _repeats(groups: DataFrame, width: int) -> DataFrame:
    """(z, x, first, size): words covered by windows below deep nodes; groups: as ``grouped`` makes them."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        def block(rows):
            """The words covered in these whole groups."""
            columns = {c: pa.concat_arrays([r.column(c) for r in rows]) for c in ("s0", "s1", "s2", "z", "x", "first")}
            one = np.asarray(columns["first"].is_valid())
            depth, low, high = subtree_nodes([np.asarray(columns[c]) for c in ("s0", "s1", "s2")], np.where(one, 1, 2), boundaries(width))
            low, high = low[depth >= width], high[depth >= width]
            leaf = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
            leaf = leaf[one[leaf]]
            z, x, first = (np.asarray(columns[c].fill_null(0))[leaf] for c in ("z", "x", "first"))
            by = np.lexsort((first, x, z))
            z, x, first = z[by], x[by], first[by]
            new = np.ones(len(z), bool)
            new[1:] = (z[1:] != z[:-1]) | (x[1:] != x[:-1]) | (first[1:] != first[:-1] + 1)
            begin = np.flatnonzero(new)
            size = np.diff(np.concatenate([begin, [len(z)]])) + width - 1
            return pa.RecordBatch.from_arrays([pa.array(z[begin]), pa.array(x[begin]), pa.array(first[begin], pa.int32()), pa.array(size, pa.int32())], names=["z", "x", "first", "size"])

        held, total, last = [], 0, None
        for batch in it:
            while batch.num_rows:
                take = batch.num_rows
                if total >= BLOCK:  # only what is left of the last group
                    s0, s1, s2, symbols = (np.asarray(batch.column(c)) for c in ("s0", "s1", "s2", "symbols"))
                    other = np.flatnonzero((s0 != last[0]) | (symbols > 1) & (s1 != last[1]) | (symbols > 2) & (s2 != last[2]))
                    take = int(other[0]) if len(other) else take
                    if not take:
                        yield block(held)
                        held, total = [], 0
                        continue
                held.append(batch.slice(0, take))
                total, last = total + take, [batch.column(c)[take - 1].as_py() for c in ("s0", "s1", "s2")]
                batch = batch.slice(take)
        if held:
            yield block(held)

    return groups.mapInArrow(run, "z long, x long, first int, size int")


#: Texts' anchors that have more than this share of all places are met by a filter and not by a shuffle.
HOT_SHARE = 1_000_000
LEAST_HOT = 1_000


def shared_places(places: DataFrame) -> DataFrame:
    """The rows of (z, h, p) whose h occurs more than once.  An h with over a millionth of all rows is hot: there are a million
    of them at most, they are sent to the rows, and the others join by h."""
    counts = written(places.groupBy("h").count().filter("count > 1"), "shared")
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(LEAST_HOT, total // HOT_SHARE)
    hot = broadcast_if_small(counts.filter(F.col("count") > least).select("h"), 8)
    return places.join(hot, "h", "left_semi").unionByName(places.join(hot, "h", "left_anti").join(counts.filter(F.col("count") <= least).select("h"), "h", "left_semi"))


def covered_words(documents: DataFrame, width: int = 35, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(docs, covers): doc_id, text and z (hash of the text) of every row; and (doc_id, z, covers), covers holding x, first
    and size of the words of windows that start elsewhere as well; size -1 stands for the whole text."""
    docs = docs_of(documents).withColumn("z", F.xxhash64("text"))
    scan = written(_scan(docs, width), "anchors")
    long = scan.filter(F.col("n") >= width)
    copied = written(long.groupBy("x", "y").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "z")).alias("rep")).filter("copies > 1").select("x", "y", F.col("rep.doc_id").alias("low"), F.col("rep.z").alias("low_z")), "copied")
    known = broadcast_if_small(copied, 32).withColumn("copied", F.lit(True))
    long = long.join(known, ["x", "y"], "left")
    single = long.filter("copied is null").withColumn("weight", F.lit(1))
    several = long.filter("copied").filter(F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("z") == F.col("low_z"))).dropDuplicates(["x", "y"]).withColumn("weight", F.lit(2))
    texts = single.unionByName(several)
    places = texts.select("z", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select("z", F.col("a.hs").alias("h"), F.col("a.ps").alias("p"))
    by_text = shared_places(places).groupBy("z").agg(F.collect_list("p").alias("ps"))
    rich = written(by_text.join(texts.select("z", "x", "weight", F.col("doc_id").alias("low")), "z"), "shared-anchors")
    del by_text, places
    release(documents.sparkSession)
    # Texts whose bytes have one hash get the places of all of them; x tells them apart, more places only mean more leaves.
    parts = docs.join(rich, "z").filter(F.col("doc_id").eqNullSafe(F.col("low"))).select("text", "z", "x", "weight", "ps")
    flow = written(_suffixes(parts, width), "suffixes")
    del parts
    release(documents.sparkSession)
    trees = _repeats(grouped(split_by_prefix(flow.filter("kind = 0").drop("kind", "size"), group)), width)
    ranges = trees.unionByName(flow.filter("kind = 1").select("z", "x", "first", "size"))
    by_text = ranges.groupBy("z", "x").agg(F.collect_list(F.struct("first", "size")).alias("r"))
    alone = by_text.join(single.select("doc_id", "z", "x"), ["z", "x"]).select("doc_id", "z", F.transform("r", lambda r: F.struct(F.col("x").alias("x"), r["first"].alias("first"), r["size"].alias("size"))).alias("r"))
    whole = long.filter("copied").select("doc_id", "z", "x").distinct().select("doc_id", "z", F.array(F.struct("x", F.lit(0).alias("first"), F.lit(-1).alias("size"))).alias("r"))
    covers = written(alone.unionByName(whole).groupBy("doc_id", "z").agg(F.flatten(F.collect_list("r")).alias("covers")), "covers")
    discard(flow, rich, scan, copied)
    release(documents.sparkSession)
    return docs, covers


def remove_repeated_windows(documents: DataFrame, width: int = 35, group: int = GROUP) -> DataFrame:
    """For every row doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words joined by one space): each word
    goes that is covered by ``width`` words in a row which also start anywhere else, in the same text or in another.
    Windows are judged on the input.

    Words are what lies between bytes 0x20 and 0x09-0x0D, unchanged.  Null counts as empty; texts of fewer words than
    ``width`` stay.  Rows that repeat a text, under one doc_id or several or none, are places of their own and lose all
    words.  Columns other than doc_id and text are dropped.
    """
    docs, covers = covered_words(documents, width, group)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in it:
            n, removed, digest, kept = [], [], [], []
            for text, covers in zip(batch.column("text"), batch.column("covers"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                whole = b" ".join(words)
                sha = hashlib.sha256(whole)
                n.append(len(words))
                gone = np.zeros(len(words) + 1, np.int64)
                if covers.is_valid:
                    x = int.from_bytes(sha.digest()[:8], "little", signed=True)
                    mine = np.asarray(covers.values.field("x")) == x
                    first, size = (np.asarray(covers.values.field(c))[mine] for c in ("first", "size"))
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.where(size < 0, len(words), first + size), -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    if len(stay) < len(words):
                        whole = b" ".join([words[i] for i in stay])
                        sha = hashlib.sha256(whole)
                    removed.append(len(words) - len(stay))
                else:
                    removed.append(0)
                digest.append(sha.hexdigest())
                kept.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    same = covers.select(F.col("doc_id").alias("d"), F.col("z").alias("dz"), "covers")
    joined = docs.join(same, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("z") == F.col("dz")), "left")
    return joined.select("doc_id", "text", "covers").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: whole ``documents``, 35 words."""
    return remove_repeated_windows(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
with w as materialized (
  select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), places as materialized (
  select r, unnest(range(1, len(words) - 33)) as i from w where len(words) >= 35
), grams as (
  select p.r, p.i, sha256(array_to_string(words[p.i:p.i + 34], ' ')) as g from places p join w using (r)
), hits as materialized (
  select r, i from grams qualify count(*) over (partition by g) > 1
), gone as materialized (
  select distinct r, i + k as j from hits, range(35) t(k)
), cut as (
  select r, count(*) as n_removed, list(j) as js from gone group by r
)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when n_removed is null then words else list_filter(list_transform(range(1, len(words) + 1), lambda k: case when list_contains(js, k) then null else words[k] end), lambda v: v is not null) end, ' '), '')) as kept_sha256
from w left join cut using (r)"""
