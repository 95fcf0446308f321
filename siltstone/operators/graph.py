"""Iterative graph operators on edge tables (src, dst).  Every round is written to the shared folder, so that plans stay
short and a lost executor repeats one round at most; the driver sees only counts.

Components, longest paths, layers and chains don't cross the connected pieces of a graph.  Pieces of up to ``LOCAL`` edges are dealt
out and each is worked on in one task; larger ones go by rounds over all tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import written


#: Rounds after which the parts of a growing table are written as one.
COMPACT = 8

#: Edges of a connected piece that is worked on in one task, and about as many as a group of small pieces has together.
LOCAL = 50_000


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): the starts and all that they reach; semi-naive, only the last round's nodes are joined again.  Every
    ``COMPACT`` rounds what was seen becomes one table again."""
    edges = written(_edges(edges), "edges")
    seen = written(starts.select("node").distinct(), "reach")
    front, rounds = seen, 0
    while not front.isEmpty():
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front, rounds = written(step.join(seen, "node", "left_anti"), "front"), rounds + 1
        seen = seen.unionByName(front)
        if rounds % COMPACT == 0:
            seen = written(seen, "reach")
    return seen


def chains(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(src, dst) between nodes that are reachable from a start and reach an end; ends have no way out.  Ends that no start
    reaches take no part."""
    edges = written(_edges(edges), "edges")
    marks = starts.select("node", F.lit(1).alias("mark")).unionByName(ends.select("node", F.lit(2).alias("mark"))).distinct()
    linked, large = _linked(edges)
    marks = marks.join(linked.select(F.col("src").alias("node"), "piece").unionByName(linked.select(F.col("dst").alias("node"), "piece")).distinct(), "node")
    some = not large.isEmpty()
    small, theirs = (df.join(large, "piece", "left_anti") if some else df for df in (linked, marks))
    groups = 1 + 3 * small.count() // max(LOCAL, 1)
    rows = small.select("piece", "src", "dst", F.lit(0).alias("mark")).unionByName(theirs.select("piece", F.col("node").alias("src"), F.col("node").alias("dst"), "mark"))
    kind = edges.schema["src"].dataType.simpleString()
    out = rows.select(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("_g"), "src", "dst", "mark").groupBy("_g").applyInPandas(_chained, f"src {kind}, dst {kind}")
    if some:
        of = lambda mark: marks.filter(F.col("mark") == mark).join(large, "piece", "left_semi").select("node")
        out = out.unionByName(_chain_rounds(linked.join(large, "piece", "left_semi").select("src", "dst"), of(1), of(2)))
    return out


def _chained(frame):
    """The edges on chains of the graph in a frame (src, dst, mark): mark 0 is an edge, 1 a start, 2 an end."""
    import numpy as np
    import pandas as pd

    codes, names = pd.factorize(pd.concat([frame["src"], frame["dst"]], ignore_index=True))
    n, mark = len(names), frame["mark"].to_numpy()
    src, dst = codes[: len(frame)], codes[len(frame) :]
    begins, ends, edge = src[mark == 1], src[mark == 2], mark == 0
    src, dst = src[edge], dst[edge]

    def reached(a, b, front):
        order = np.argsort(a, kind="stable")
        to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
        seen = np.zeros(n, dtype=bool)
        seen[front] = True
        stack, marked = list(set(front.tolist())), seen.tolist()
        while stack:
            v = stack.pop()
            for w in to[first[v] : first[v + 1]]:
                if not marked[w]:
                    marked[w] = True
                    stack.append(w)
        return np.array(marked, dtype=bool)

    forward = reached(src, dst, begins)
    both = forward & reached(dst, src, ends[forward[ends]])
    closed = np.zeros(n, dtype=bool)
    closed[ends] = True
    on = ~closed[src] & both[src] & both[dst]
    return frame.loc[edge, ["src", "dst"]][on]


def _chain_rounds(edges: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``chains`` by rounds."""
    edges = written(_edges(edges), "edges")
    cut = written(edges.join(ends.select(F.col("node").alias("src")).distinct(), "src", "left_anti"), "cut")
    forward = written(reachable(edges, starts), "forward")
    back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ends.select("node").distinct().join(forward, "node", "left_semi"))
    both = written(back.join(forward, "node", "left_semi"), "both")
    return cut.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")


def pieces(edges: DataFrame) -> DataFrame:
    """(node, piece) of the nodes that have an edge: those that edges connect in any direction share a piece, a node of it.

    A round sends every node to the least of itself and its neighbours, by a hash that is another one in each round, and goes
    on with the edges between those.  A share of the nodes goes with each round, whatever the graph's diameter."""
    left, steps = edges.select("src", "dst"), []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("hash"), F.col(c).alias("node"))  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min(rank("dst")).alias("least"))
        step = written(least.select(F.col("src").alias("node"), F.least(rank("src"), "least")["node"].alias("piece")), "step")
        steps.append(step)
        ends = left.join(step.select(F.col("node").alias("src"), F.col("piece").alias("a")), "src").join(step.select(F.col("node").alias("dst"), F.col("piece").alias("b")), "dst")
        left = written(ends.filter("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "linked")
    if not steps:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("piece"))
    out = steps.pop()
    while steps:
        later = out.select(F.col("node").alias("piece"), F.col("piece").alias("_p"))
        out = written(steps.pop().join(later, "piece", "left").select("node", F.coalesce("_p", "piece").alias("piece")), "pieces")
    return out


def _placed(frame):
    """(node, component, cyclic, late, depth) of the graph in a frame (src, dst), by Tarjan's algorithm.  cyclic: the
    component has several nodes; late: a cycle reaches it; depth: components on the longest path to it, among the late or the
    other ones."""
    import numpy as np
    import pandas as pd

    codes, names = pd.factorize(pd.concat([frame["src"], frame["dst"]], ignore_index=True), sort=True)
    n, src, dst = len(names), codes[: len(frame)], codes[len(frame) :]
    order = np.argsort(src, kind="stable")
    to, begin = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, seen, low, part, stack, number, parts = begin[:n], [0] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            v = path[-1]
            if not seen[v]:
                number += 1
                seen[v] = low[v] = number
                stack.append(v)
            if at[v] < begin[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                while part[v] < 0:
                    part[stack.pop()] = parts
                parts += 1
    # Parts are numbered against the edges' direction: from the highest on, all that leads to a part was dealt with.
    part = np.array(part, dtype="int64")
    cyclic = np.bincount(part, minlength=parts) > 1
    smallest = np.full(parts, n, dtype="int64")
    np.minimum.at(smallest, part, np.arange(n))
    between = part[src] != part[dst]
    a, b = part[src][between], part[dst][between]
    down = np.argsort(-a, kind="stable")
    links, late, depth = list(zip(a[down].tolist(), b[down].tolist(), strict=True)), cyclic.tolist(), [0] * parts
    for x, y in links:
        late[y] = late[y] or late[x]
    for x, y in links:
        if late[x] == late[y]:
            depth[y] = max(depth[y], depth[x] + 1)
    return pd.DataFrame({"node": names, "component": names[smallest[part]], "cyclic": cyclic[part], "late": np.array(late, dtype=bool)[part], "depth": np.array(depth, dtype="int32")[part]})


def _linked(edges: DataFrame, member: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(src, dst, piece) of the edges and (piece) of the pieces that are too large for one task, both written."""
    member = pieces(edges) if member is None else member
    linked = written(edges.join(member.withColumnRenamed("node", "src"), "src").select("src", "dst", "piece"), "linked")
    return linked, written(linked.groupBy("piece").count().filter(F.col("count") > LOCAL).select("piece"), "large")


def _by_pieces(nodes: DataFrame, edges: DataFrame, columns: list[str], rounds: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """node and columns of ``_placed`` for every node, written; ``rounds`` gives them for the nodes and edges of large pieces.
    Edges from or to what isn't among the nodes don't count."""
    nodes = written(nodes.select("node").distinct(), "nodes")
    known = _edges(edges).join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    known = written(known.select("src", "dst"), "edges")
    member = pieces(known)
    linked, large = _linked(known, member)
    some = not large.isEmpty()
    small = linked.join(large, "piece", "left_anti") if some else linked
    groups = 1 + 3 * small.count() // max(LOCAL, 1)
    kind = nodes.schema["node"].dataType.simpleString()
    dealt = small.select(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("_g"), "src", "dst").groupBy("_g")
    out = dealt.applyInPandas(_placed, f"node {kind}, component {kind}, cyclic boolean, late boolean, depth int").select("node", *columns)
    single = {"component": F.col("node"), "cyclic": F.lit(False), "late": F.lit(False), "depth": F.lit(0)}
    out = out.unionByName(nodes.join(member, "node", "left_anti").select("node", *(single[c].alias(c) for c in columns)))
    if some:
        theirs = member.join(large, "piece", "left_semi").select("node")
        out = out.unionByName(rounds(theirs, linked.join(large, "piece", "left_semi").select("src", "dst")).select("node", *columns))
    return written(out, "placed")


def longest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): edges on the longest path from a node without callers; for graphs without cycles."""
    out = _by_pieces(nodes, edges, ["depth", "cyclic"], lambda n, e: _path_rounds(n, e).withColumn("cyclic", F.lit(False)))
    if not out.filter("cyclic").isEmpty():
        raise ValueError("the graph has a cycle")
    return out.select("node", "depth")


def _path_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``longest_path`` by rounds.

    A round takes the nodes that no edge leads to any more and drops them with their edges: what a round reads and writes, one
    table, is what the earlier ones left.  Edges from what isn't among the nodes don't count."""
    nodes = written(nodes.select("node").distinct(), "nodes")
    known = _edges(edges).join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    # A row for each node (without dst) and for each edge, under the node that it leaves.
    left = nodes.select("node", F.lit(None).cast(known.schema["dst"].dataType).alias("dst")).unionByName(known.select(F.col("src").alias("node"), "dst"))
    left, done, depth = written(left, "graph"), None, 0
    while True:
        blocked = left.filter("dst is not null").select(F.col("dst").alias("node"), F.lit(True).alias("blocked")).distinct()
        level = written(left.join(blocked, "node", "left").select("node", "dst", F.coalesce("blocked", F.lit(False)).alias("blocked")), "level")
        free, rest = level.filter("dst is null").agg(F.count_if(~F.col("blocked")), F.count_if("blocked")).first()
        if rest and not free:
            raise ValueError("the graph has a cycle")
        ready = level.filter("not blocked and dst is null").select("node", F.lit(depth).alias("depth"))
        done = ready if done is None else done.unionByName(ready)
        if not rest:
            return done
        left, depth = level.filter("blocked").drop("blocked"), depth + 1


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node of the strongly connected component."""
    return _by_pieces(nodes, edges, ["component"], _component_rounds)


def _component_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``strong_components`` by rounds.

    Nodes without a way in or out among those left are components alone.  The others take the smallest node that reaches
    them (forward colours); a colour's component are the nodes that reach its root within the colour.
    """
    left_edges = written(_edges(edges), "edges")
    left = written(nodes.select("node").distinct(), "nodes")
    out = None

    def add(found: DataFrame):
        nonlocal out
        out = found if out is None else out.unionByName(found)

    while not left.isEmpty():
        while True:  # trimming
            src, dst = left_edges.select(F.col("src").alias("node")).distinct(), left_edges.select(F.col("dst").alias("node")).distinct()
            inner = written(left.join(src, "node", "left_semi").join(dst, "node", "left_semi"), "inner")
            alone = written(left.join(inner, "node", "left_anti"), "alone")
            if alone.isEmpty():
                break
            add(alone.select("node", F.col("node").alias("component")))
            left = inner
            keep = left_edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
            left_edges = written(keep, "edges")
        if left.isEmpty():
            break
        colour = left.select("node", F.col("node").alias("colour"))
        while True:
            offered = left_edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("o"))
            new = written(colour.join(offered, "node", "left").select("node", F.least("colour", "o").alias("colour"), (F.col("o") < F.col("colour")).alias("moved")), "colour")
            colour = new.select("node", "colour")
            if new.filter("moved").isEmpty():
                break
        own = (
            left_edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d").select("src", "dst")
        )
        roots = colour.filter("node = colour").select("node")
        back = written(reachable(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots), "back")
        found = written(colour.join(back, "node", "left_semi").select("node", F.col("colour").alias("component")), "component")
        add(found)
        left = written(left.join(found, "node", "left_anti"), "left")
        keep = left_edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
        left_edges = written(keep, "edges")
    return out if out is not None else nodes.select("node", F.col("node").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer, cycle_resolution) of any graph.

    Nodes that no cycle reaches get the length of the longest path to them.  The others, cycles and what follows them, come
    after, layered by the longest path between strongly connected components; a layer with a component of several nodes is
    marked.
    """
    placed = _by_pieces(nodes, edges, ["cyclic", "late", "depth"], _layer_rounds)
    base = placed.filter("not late").agg(F.coalesce(F.max("depth") + 1, F.lit(0))).first()[0]
    layer = placed.select("node", "cyclic", "late", F.when(F.col("late"), F.col("depth") + base).otherwise(F.col("depth")).alias("layer"))
    flags = layer.filter("cyclic").select("layer").distinct().withColumn("_f", F.lit(True))
    return layer.join(flags, "layer", "left").select("node", "layer", F.coalesce("_f", F.lit(False)).alias("cycle_resolution"))


def _layer_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cyclic, late, depth) by rounds, as ``_placed`` has them."""
    edges = written(_edges(edges), "edges")
    parts = written(_component_rounds(nodes, edges), "parts")
    big = written(parts.groupBy("component").count().filter("count > 1").select("component"), "big")
    cyclic = parts.join(big, "component", "left_semi").select("node")
    late = written(reachable(edges, cyclic), "late")
    early = written(nodes.select("node").distinct().join(late, "node", "left_anti"), "early")
    inside = lambda who: edges.join(who.withColumnRenamed("node", "src"), "src", "left_semi").join(who.withColumnRenamed("node", "dst"), "dst", "left_semi")
    first = _path_rounds(early, inside(early)).select("node", F.lit(False).alias("cyclic"), F.lit(False).alias("late"), "depth")
    placed = written(parts.join(late, "node", "left_semi"), "placed")
    between = (
        inside(late).join(placed.select(F.col("node").alias("src"), F.col("component").alias("a")), "src")
        .join(placed.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    depth = written(_path_rounds(placed.select(F.col("component").alias("node")), between), "depth")
    second = placed.join(depth.withColumnRenamed("node", "component"), "component").join(big.withColumn("_c", F.lit(True)), "component", "left")
    return first.unionByName(second.select("node", F.coalesce("_c", F.lit(False)).alias("cyclic"), F.lit(True).alias("late"), "depth"))


def frontier(pending: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """The pending nodes without a pending caller; if there is none, the single first one in order."""
    e = _edges(edges)
    blocked = e.join(pending.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    free = pending.join(blocked, "node", "left_anti")
    # One row at most on the other side: kept only if nothing is free.
    first = pending.orderBy(*order).limit(1)
    none = free.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(1).alias("_k"))
    return free.unionByName(first.withColumn("_k", F.lit(1)).join(F.broadcast(none), "_k", "left_semi").drop("_k"))


def frontier_rounds(nodes: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """(node, round) when every round takes the frontier of what is left."""
    left, n, out = written(nodes, "pending"), 0, None
    while not left.isEmpty():
        now = written(frontier(left, edges, order).select("node", F.lit(n).alias("round")), "round")
        out = now if out is None else out.unionByName(now)
        left = written(left.join(now, "node", "left_anti"), "pending")
        n += 1
    return out if out is not None else nodes.select("node", F.lit(0).alias("round"))


def call_graph(sites: DataFrame, definitions: DataFrame, backend: DataFrame, extra: DataFrame, keywords: list[str]) -> DataFrame:
    """(src, dst) of resolved call sites, backend edges between known functions and supplemental edges."""
    from siltstone.operators.relations import resolve_call_sites, within

    known = definitions.select(F.col("callee").alias("node")).distinct()
    named = resolve_call_sites(sites, definitions, keywords).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return _edges(named.unionByName(within(backend.unionByName(extra), "src", "dst", known, "node")))


def trim_to_selection(lines: DataFrame, spans: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines of files that have a kept function, without the lines of functions that aren't kept.
    lines: (file, line_no, line); spans: (file, name, first, last); kept: (file, name)."""
    files = kept.select("file").distinct()
    gone = spans.join(kept, ["file", "name"], "left_anti").select("file", F.explode(F.sequence("first", "last")).alias("line_no"))
    mine = spans.join(kept, ["file", "name"], "left_semi").select("file", F.explode(F.sequence("first", "last")).alias("line_no"))
    return lines.join(files, "file", "left_semi").join(gone.join(mine, ["file", "line_no"], "left_anti").distinct(), ["file", "line_no"], "left_anti")
