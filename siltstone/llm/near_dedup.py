"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, exact verification.

1. One scan hashes each document's distinct word shingles and keeps a fingerprint of the set and its k least hashes.
   Documents with equal sets are one class; its smallest doc_id stands for it from here on.
2. The retained values form inverted lists.  A pair above the threshold shares at least ``needed`` retained values,
   so it shares one among the rarest ``retained - needed + 1`` of each side; only these are listed, and values that
   only one class has are dropped.
3. Each list links its members to one alone, its hub: that with the fewest values that nobody shares.  These pairs pass
   a filter (the estimate from the sketch of the union) and are then compared on their full sets.  Linked classes form
   first components.
4. Lists that still hold several components are searched again.  Up to ``SHORT`` members meet member against member.
   In longer ones every member is laid over the hub, and only what tells it from the hub is listed: two members that
   aren't both linked with the hub can only be linked if they share enough of that.  So a large group of near copies, in
   which all share nearly all, is searched by its rare edits and never expanded into its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bytescan import WORD, Hasher, byte_table, lowered, mix, per_doc, runs, shingles
from siltstone.llm.common import batches, broadcast_if_small, discard, docs_of, release, table, written
from siltstone.llm.components import components

#: Retained values of a sketch, and how many of them two sketches share at least at a similarity of 0.8 (a binomial
#: with 64 draws falls below 34 with a chance of about 1e-7).
SKETCH = 64
SHARED = 34
#: Lists of at most so many members meet member against member.
SHORT = 16
#: A hub's text is sent once for so many of its pairs.
DEALT = 256
#: Longs of a member's parity signature: each hash turns one of 64 times as many bits, so two sets differ in at least as many
#: hashes as their signatures in bits.
SIGNS = 16
_SIGNS = [f"g{i}" for i in range(SIGNS)]
#: The same for a sketch.
MARKS = 4
_MARKS = [f"s{i}" for i in range(MARKS)]


def shingle_sets(width: int):
    """A function from (data, offsets) of a batch to one sorted array of distinct shingle hashes per document."""
    import numpy as np

    hasher = Hasher(lowered(byte_table()))

    def sets(data, offsets):
        starts, ends = runs(WORD[data], offsets)
        words = hasher.ranges(hasher.prefix(data), starts, ends)
        at = per_doc(starts, offsets)
        return [np.unique(shingles(words[at[i] : at[i + 1]], width).view(np.int64)) for i in range(len(offsets) - 1)]

    return sets


def _parity(values, longs: int):
    """The parity signature of an array of hashes."""
    import numpy as np

    turns = np.bincount((values.view(np.uint64) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs)
    return np.packbits((turns & 1).astype(np.uint8)).view(np.int64)


def _sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    def run(it):
        import numpy as np
        import pyarrow as pa

        sets = shingle_sets(width)
        for batch, lo, hi, data, offsets in batches(it):
            found = sets(data, offsets)
            kept = [s[:k] for s in found]
            sizes = np.array([len(s) for s in found], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            every = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
            with np.errstate(over="ignore"):
                prints = []
                for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every.view(np.uint64) ^ np.uint64(seed)))])
                    prints.append(mix(total[at[1:]] - total[at[:-1]] + sizes.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array(prints[0]),
                    pa.array(prints[1]),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)),
                        pa.array(np.concatenate(kept)),
                    ),
                    *(pa.array(c) for c in np.array([_parity(s, MARKS) for s in kept], np.int64).reshape(-1, MARKS).T),
                ],
                names=["doc_id", "n_shingles", "p", "q", "sketch", *_MARKS],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, p long, q long, sketch array<long>, " + ", ".join(f"{c} long" for c in _MARKS))


def _firsts(made: DataFrame, classes: DataFrame) -> DataFrame:
    """The sketches of the classes' nodes: (node, n, sketch).  Sketches stay where they lie if the nodes, or the other
    documents, are few enough to be sent to them."""
    key = ["p", "q", "doc_id"]
    nodes = classes.select("p", "q", F.col("node").alias("doc_id"))
    others = made.select(key).join(classes.filter("copies > 1").select("p", "q", "node"), ["p", "q"]).filter("doc_id <> node").select(key)
    others = written(others, "others")
    some = made.filter("n_shingles > 0")
    some = some.join(broadcast_if_small(others, 48), key, "left_anti") if others.count() < nodes.count() else some.join(broadcast_if_small(nodes, 48), key, "left_semi")
    return some.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")


def _shared_values(firsts: DataFrame) -> DataFrame:
    """(node, df, v) for every value of a sketch that several classes have.  Values are dealt out once, with nothing but their
    node; both ends are kept in the count so that it reads the same rows."""
    listed = firsts.select("node", F.explode("sketch").alias("v")).repartition("v")
    common = listed.groupBy("v").agg(F.count("*").alias("df"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("v", "df")
    return listed.join(common.hint("merge"), "v").select("node", "df", "v")


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with text_a and text_b.  b may be the hub of very many pairs: its text is sent once for every
    ``DEALT`` of them, under a salt."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    texts = docs.join(broadcast_if_small(ids, 16), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    salts = pairs.groupBy("b").agg(F.count("*").alias("k")).select("b", F.ceil(F.col("k") / DEALT).alias("salts"))
    hubs = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(salts, "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    dealt = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    return dealt.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(hubs, ["b", "salt"]).select("a", "b", "text_a", "text_b")


def _overlaps(pairs: DataFrame, docs: DataFrame, width: int, name: str, rests: bool = False) -> DataFrame:
    """The full sets of each pair (a, b) laid over each other: (a, b, both, n, m), and with ``rests`` what only a and
    only b have, as arrays of hashes, with the parity signature of both."""

    def run(it):
        import numpy as np
        import pyarrow as pa

        sets = shingle_sets(width)

        def one(text):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            return sets(data, np.array([0, len(data)]))[0]

        def arrays(parts):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)), pa.array(np.concatenate(parts), pa.int64()))

        for whole in it:
            for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                left, right = (batch.column(batch.schema.get_field_index(c)).cast(pa.large_binary()) for c in ("text_a", "text_b"))
                ids_b = batch.column(batch.schema.get_field_index("b")).to_pylist()
                both, n, m, only, lacks, signed, last, hub = [], [], [], [], [], [], None, None
                for i in range(batch.num_rows):
                    if ids_b[i] != last:
                        last, hub = ids_b[i], one(right[i])
                    x = one(left[i])
                    common = np.intersect1d(x, hub, assume_unique=True)
                    both.append(len(common))
                    n.append(len(x))
                    m.append(len(hub))
                    if rests:
                        only.append(np.setdiff1d(x, common, assume_unique=True))
                        lacks.append(np.setdiff1d(hub, common, assume_unique=True))
                        signed.append(_parity(np.concatenate([only[-1], lacks[-1]]), SIGNS))
                out = [batch.column(batch.schema.get_field_index("a")), batch.column(batch.schema.get_field_index("b")), *(pa.array(c, pa.int64()) for c in (both, n, m))]
                if rests:
                    out += [arrays(only), arrays(lacks), *(pa.array(c, pa.int64()) for c in np.array(signed, np.int64).reshape(-1, SIGNS).T)]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "both", "n", "m", "only", "lacks", *_SIGNS][: len(out)])

    shape = "a long, b long, both long, n long, m long" + (", only array<long>, lacks array<long>, " + ", ".join(f"{g} long" for g in _SIGNS) if rests else "")
    out = written(_with_texts(pairs, docs).mapInArrow(run, shape), name)
    release(docs.sparkSession)
    return out


def _compared(pairs: DataFrame, made: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch allows a link, with their full sets compared: (a, b, both, n, m, linked).

    made: (doc_id, n_shingles, sketch and its parity signature).  Pairs meet the signatures first, since a sketch is ten times
    as long: two sketches differ in as many values as their signatures in bits at least.  For two sets held whole the
    estimate is exact.
    """
    marks = lambda s: made.select(F.col("doc_id").alias(s), F.expr(f"least(n_shingles, {SKETCH})").alias(f"k_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in _MARKS))
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in _MARKS)
    pairs = pairs.join(marks("a"), "a").join(marks("b"), "b").filter(f"{apart} <= k_a + k_b - 2 * ceil(greatest(k_a, k_b) * {SHARED} / {SKETCH})")
    pairs = written(pairs.select("a", "b").distinct(), "may-pairs")
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "may-ids")
    made = made.join(broadcast_if_small(ids, 16), "doc_id", "left_semi")
    side = lambda s: made.select(F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    near = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("u", F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH))
        .withColumn("both", F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b"))))
        .filter(f"both * {SKETCH} >= size(u) * {SHARED}")
        .filter(f"n_a > {SKETCH} or n_b > {SKETCH} or size(u) >= {SKETCH} or 100 * both >= size(u) * {percent}")
        .select("a", "b")
        .distinct()
    )
    return _overlaps(written(near, "pairs"), docs, width, "compared").withColumn("linked", F.expr(f"100 * both >= {percent} * (n + m - both)"))


def _search_by_hub(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """All links between texts that hang on one hub and are not in one component yet: (a, b).

    members: (a, b, component), b being the hub.  Every member is laid over its hub: ``only`` is what the hub lacks,
    ``lacks`` is what the member lacks, and two members differ in exactly the difference of these two differences.  With
    w = |only| + |lacks| - g * size and g = (100 - percent) / (100 + percent), members x and y are linked if and only if
    2 * |what they share of only and of lacks| >= w(x) + w(y).  The hub's own w is the least, -g * |hub|, and a member that
    is ``far``, not linked with the hub, has more than g * |hub|.  So two members of two components share values:

    * at least t / (1 + t) * (|x| + |y|) - (what the one with less shares with the hub) of ``only``;
    * or, if they share none of ``only``, all that they need of ``lacks``.

    These lists are searched with a prefix filter: a pair meets in a value only if in both members' orders, rarest first,
    enough values come after it.  What a shared shingle of the hub would bring together, the mass of a group of near
    copies, never meets.

    Pairs that meet and whose signatures allow a link are verified, the nearest ones of every two components first; only
    where these don't link the two, by whatever way, are the others verified as well.
    """
    g, t = (100 - percent) / (100 + percent), percent / 100
    laid = _overlaps(members.select("a", "b"), docs, width, "laid", rests=True)
    facts = laid.join(members, ["a", "b"]).select(
        F.col("b").alias("hub"), F.col("a").alias("x"), "component", "both", "n", "m", "only", "lacks",
        F.expr(f"n + m - 2 * both - {g} * n").alias("w"), F.size("only").alias("na"), F.size("lacks").alias("nr"),
        F.expr(f"100 * both < {percent} * (n + m - both)").alias("far"), *_SIGNS,
    )
    facts = written(facts, "facts")
    plain = ["x", "component", "both", "n", "w", "far", "na", "nr", *_SIGNS]
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in _SIGNS)

    def lists(of: DataFrame, values: str, needed: str) -> DataFrame:
        """One row for each member and shared value of its prefix; at: the value's place in the member's order, from 1."""
        size = "na" if values == "only" else "nr"
        some = of.select("hub", "x", "component", "far", size, F.expr(needed).alias("needed"), F.explode(values).alias("v"))
        shared = some.groupBy("hub", "v").agg(F.count("*").alias("df"), F.max("far").alias("any_far"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        shared = shared.filter("df > 1 and any_far and lo <> hi").select("hub", "v", "df")
        ranked = some.join(shared, ["hub", "v"]).groupBy("hub", "x").agg(F.first(size).alias(size), F.first("needed").alias("needed"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
        # Values that bring nobody together come first in the order, so the shared ones give way at the end only.
        alone = f"{size} - size(vs)"
        placed = ranked.select("hub", "x", size, "needed", F.expr(alone).alias("alone"), F.posexplode("vs").alias("at", "e")).withColumn("at", F.expr("alone + at + 1"))
        prefix = placed.filter(f"at <= {size} - needed + 1").select("hub", "x", "at", F.col("e.v").alias("v"))
        return prefix.join(of.select("hub", *plain), ["hub", "x"]).select("hub", *plain, "at", "v")

    def meet(of: DataFrame, size: str, needed: str, condition: str) -> DataFrame:
        of = written(of, "hub-lists")
        left = of.filter("far").select("hub", "v", *(F.col(c).alias(f"{c}_a") for c in (*plain, "at")))
        right = of.select("hub", "v", *(F.col(c).alias(f"{c}_b") for c in (*plain, "at")))
        return (
            left.join(right, ["hub", "v"])
            .filter("component_a <> component_b and (x_a > x_b or not far_b)")
            .filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and w_a + w_b <= 2 * (least(na_a, na_b) + least(nr_a, nr_b)) + 1e-6")
            .filter(f"{condition} and {needed} <= least({size}_a - at_a, {size}_b - at_b) + 1 + 1e-6")
            .withColumn("apart", F.expr(apart))
            .filter(f"apart <= {g} * (n_a + n_b) + 1e-6")
            .select("hub", F.col("x_a").alias("x"), F.col("x_b").alias("y"), F.least("component_a", "component_b").alias("c"), F.greatest("component_a", "component_b").alias("d"), "apart")
        )

    by_only = meet(lists(facts, "only", f"greatest(1, cast(ceil({t} * n - both - 1e-6) as int))"), "na", f"{t / (1 + t)} * (n_a + n_b) - least(both_a, both_b)", "true")
    # Without a shared value in ``only`` the whole need has to come from ``lacks``: from members that lack more than they have.
    poor = facts.filter(f"na - nr - {g} * n <= case when far then {g} else -{g} end * m + 1e-6")
    by_lacks = meet(
        lists(poor, "lacks", f"greatest(1, cast(ceil(case when far then greatest((w - {g} * m) / 2, w - {g} * n / {t}) else (w + {g} * m) / 2 end - 1e-6) as int))"),
        "nr", "(w_a + w_b) / 2", "w_a + w_b <= 2 * least(nr_a, nr_b) + 1e-6",
    )
    met = written(by_only.unionByName(by_lacks).distinct(), "hub-pairs")
    one = lambda x: facts.select("hub", F.col(x[0]).alias(x[1]), *(F.col(c).alias(f"{c}_{x[1]}") for c in ("n", "only", "lacks")), *(["m"] if x[1] == "x" else []))
    both = "size(array_intersect(only_x, only_y)) + m - size(lacks_x) - size(lacks_y) + size(array_intersect(lacks_x, lacks_y))"

    def verified(of: DataFrame) -> DataFrame:
        found = of.select("hub", "x", "y").join(one(("x", "x")), ["hub", "x"]).join(one(("x", "y")), ["hub", "y"]).withColumn("both", F.expr(both))
        return written(found.filter(f"100 * both >= {percent} * (n_x + n_y - both)").select(F.col("x").alias("a"), F.col("y").alias("b")), "found")

    to_hub = facts.filter("not far and x <> hub").select(F.col("x").alias("a"), F.col("hub").alias("b"))
    near = written(met.groupBy("c", "d").agg(F.min(F.struct("apart", "hub", "x", "y")).alias("p")).select("c", "d", "p.*"), "nearest")
    first = verified(near)
    # What the hubs and the nearest pairs make one: components by their names, which are nodes.
    named = facts.select(F.col("x").alias("a"), F.col("component").alias("b"))
    groups = components(named.unionByName(to_hub).unionByName(first))
    group = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    apart_still = near.select("c", "d").join(group("c"), "c", "left").join(group("d"), "d", "left").filter("coalesce(of_c, c) <> coalesce(of_d, d)").select("c", "d")
    rest = met.join(apart_still, ["c", "d"], "left_semi").join(near.select("hub", "x", "y"), ["hub", "x", "y"], "left_anti")
    out = first.unionByName(verified(rest)).unionByName(to_hub)
    discard(near)
    return out


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept) for every row of ``documents``.

    A document's set holds its distinct shingles of ``width`` words (of A-Z lower-cased text, cut at ASCII white
    space); a text with fewer words has its whole sequence as one shingle.  Documents are linked if
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable, kept marks that one.
    Null, empty and blank texts have no shingles and stand alone.  Rows without a doc_id are left out; rows that repeat
    a doc_id are one node.  percent must be at least 80: below, the sketches would lose links.
    """
    if percent < 80:
        raise ValueError("sketches are made for a similarity of 0.8 or more")
    docs = docs_of(documents).filter("doc_id is not null")
    made = written(_sketches(docs, width, SKETCH), "sketches")
    classes = written(made.filter("n_shingles > 0").groupBy("p", "q").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    firsts = _firsts(made, classes)
    # The prefix of each sketch in the order (number of classes with the value, value).  Rows are dealt out by node before
    # they become arrays: an array of one is several times as long as its row.
    shared = written(_shared_values(firsts), "shared")
    release(documents.sparkSession)
    needed = f"case when 5 * n <= 4 * {SKETCH} then ceil(n * {percent} / 100) else {SHARED} end"
    lists = (
        shared.repartition("node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
        .join(firsts.select("node", "n").distinct().hint("merge"), "node")
        .withColumn("k", F.expr(f"cast(least(n, {SKETCH}) as int)"))
        .withColumn("take", F.expr(f"cast(k - ({needed}) + 1 - (k - size(vs)) as int)"))
        .filter("take > 0")
        .withColumn("rank", F.struct((F.col("k") - F.size("vs")).alias("own"), F.expr("-aggregate(vs, 0L, (s, e) -> s + e.df) / k").alias("met")))
        .select("node", "n", "rank", F.explode(F.expr("slice(vs, 1, take)")).alias("e"))
        .select("node", "n", "rank", F.col("e.v").alias("v"))
    )
    lists = written(lists, "lists")
    discard(shared)
    release(documents.sparkSession)
    # The member with the fewest values of its own, and among these the one whose values most others have: among edited
    # copies of a text, the text itself.
    hubs = lists.groupBy("v").agg(F.min(F.struct("rank", "node", "n")).alias("hub"), F.count("*").alias("df")).filter("df > 1")
    hubs = written(hubs.select("v", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), "df"), "hubs")
    sized = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    first = lists.join(hubs, "v").filter("node <> b").filter(sized).select(F.col("node").alias("a"), "b").distinct()
    seen = _compared(first, made, docs, width, percent)
    edges = seen.filter("linked").select("a", "b")
    groups = components(edges)
    # Lists whose members are not yet in one component.
    placed = lists.join(hubs, "v").join(groups, "node", "left").select("v", "node", "n", "b", "df", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("v")
    open_lists = written(placed.join(mixed, "v"), "open")
    # Short ones: member against member.
    short = open_lists.filter(F.col("df") <= SHORT)
    end = lambda x: short.select("v", F.col("node").alias(x), F.col("n").alias("n" if x == "a" else "m"), F.col("component").alias(f"c_{x}"), F.col("b" if x == "a" else "v").alias(f"hub_{x}"))
    met = end("a").join(end("b"), "v").filter("a > b and c_a <> c_b and a <> hub_a and b <> hub_a").filter(sized).select("a", "b").distinct()
    more = _compared(met, made, docs, width, percent).filter("linked").select("a", "b")
    # Long ones: by the hub that most of their members are most like; it needn't be in the list.
    long = open_lists.filter(F.col("df") > SHORT)
    best = seen.groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct(F.expr("both / (n + m - both)"), F.expr("-b"))).alias("h"))
    votes = long.join(best, "node").groupBy("v", "h").agg(F.count("*").alias("k"))
    chosen = votes.groupBy("v").agg(F.max(F.struct("k", F.expr("-h").alias("h"))).alias("c")).select("v", F.expr("-c.h").alias("h"))
    members = long.join(chosen, "v", "left").select(F.col("node").alias("a"), F.coalesce("h", "b").alias("b"), "component").distinct()
    members = written(members, "members")
    if not members.isEmpty():
        more = more.unionByName(_search_by_hub(members, docs, width, percent))
    more = written(more, "more")
    if not more.isEmpty():
        groups = components(edges.unionByName(more))
    discard(lists, hubs, placed, open_lists, members, more)
    named = (
        classes.join(groups.select("node", F.col("component").alias("c")), "node", "left")
        .filter("copies > 1 or c is not null")
        .select("p", "q", F.coalesce("c", "node").alias("c"))
    )
    return (
        made.select("doc_id", "n_shingles", "p", "q")
        .join(named, ["p", "q"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op4: whole ``documents``, shingles of two words, 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


#: Exact links by an inverted index on all shingles, components by a recursive closure over them.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
  from documents where doc_id is not null),
g as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
        else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end gs from w),
x as (select doc_id, len(gs) n, unnest(gs) s from g),
p as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c
      from x a join x b on a.s = b.s and a.doc_id <> b.doc_id and 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) group by 1, 2),
e as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) m from r group by 1)
select g.doc_id, len(gs)::bigint n_shingles, least(g.doc_id, coalesce(m, g.doc_id)) component_id,
       g.doc_id = least(g.doc_id, coalesce(m, g.doc_id)) kept
from g left join m on m.a = g.doc_id
"""
