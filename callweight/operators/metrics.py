"""Recursive metrics: components, recursion, peaks, depths, roots and per-root values.

Edges are (src, dst); nodes are (id, frame). On acyclic reach all values are exact. A strongly
connected component counts once, as one node of the sum of its frames and of its size: a bound
that no single pass through the cycle exceeds; such values carry bounded = true.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixpoint import Pile, connected_components, counted, free
from ..fixpoint import durable as durable
from . import rules as _rules  # noqa: F401  (conditions of conditional_per_root)

STEP_ROWS, FREE_ROWS = 20, 1_000_000  # rows a doubling step of a closure may make for each edge, and anyway
WALK_EDGES = 1_000_000  # edges that one task walks to find components
PEEL = 0.1  # share of the edges that a round of trimming must take to be followed by another

def closure_doubling(edges: DataFrame, max_iter: int = 40) -> DataFrame:
    """(a, b): b is reachable from a by one edge or more. Logarithmic rounds, quadratic size; for
    small or trimmed graphs.

    Pairs carry their distance. After k rounds those of up to 2^k edges are known; what is further
    away, up to twice that, goes over a node at exactly 2^k, so only pairs at that distance are
    joined on, and no round is made to see that nothing changes."""
    r = durable(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("d")).distinct())
    for k in range(max_iter):
        far = r.filter(F.col("d") == 2**k)
        if far.isEmpty():
            return r.select("a", "b")
        step = far.select("a", F.col("b").alias("m"), F.col("d").alias("d1")).join(r.select(F.col("a").alias("m"), "b", "d"), "m").select("a", "b", F.col("d1") + F.col("d"))
        old = r
        r = durable(r.union(step).groupBy("a", "b").agg(F.min("d").alias("d")))
        free(old)
    raise RuntimeError(f"the closure still grows after {max_iter} rounds")


def closure_seeded(edges: DataFrame, seeds: DataFrame, max_iter: int = 100_000) -> DataFrame:
    """(seed, node): nodes that each seed reaches, itself included. Only new pairs move on."""
    e = durable(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    new = durable(seeds.select("seed", F.col("seed").alias("node")).distinct())
    seen = Pile(new)
    for _ in range(max_iter):
        new, n = counted(new.join(e, "node").select("seed", F.col("next").alias("node")).distinct().join(seen.all, ["seed", "node"], "left_anti"))
        if n == 0:
            return durable(seen.all)
        seen.add(new)
    raise RuntimeError(f"the closure still grows after {max_iter} rounds")


def trim(edges: DataFrame, max_iter: int = 1000, least: float = 0) -> DataFrame:
    """Edges that may lie on a cycle: nodes without a caller or without a callee are peeled off, as
    long as a round takes more than the share `least` of the edges. Self loops stay. Fewer rounds
    leave more edges and stay correct for `components`."""
    e, n = counted(edges.select("src", "dst").distinct())
    for _ in range(max_iter):
        if n == 0:
            break
        old = e
        e, now = counted(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        free(old)
        if n - now <= least * n:
            break
        n = now
    return e


def _scc_colour(e: DataFrame, max_iter: int = 10_000) -> DataFrame:
    """Components by colouring: the largest id that reaches a node is its colour; a colour's
    component is what reaches its owner inside the colour. Linear memory."""
    found = None
    e = durable(e)
    for _ in range(max_iter):
        if e.isEmpty():
            return found
        nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        colour = durable(nodes.select("id", F.col("id").alias("c")))
        while True:
            up = e.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            nxt = durable(colour.join(up, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("ch")))
            colour = nxt.select("id", "c")
            if nxt.filter("ch").isEmpty():
                break
        ce = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("sc")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("dc")), "dst").filter("sc = dc").select("src", "dst")
        back = closure_seeded(ce.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("id = c").select(F.col("id").alias("seed")))
        comp = durable(back.select(F.col("node").alias("id"), F.col("seed").alias("scc")))
        found = comp if found is None else found.union(comp)
        gone = comp.select("id")
        e = trim(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), least=PEEL)
    raise RuntimeError(f"components are left after {max_iter} colourings")


def _reach(e: DataFrame, pivot, max_iter: int = 1_000_000) -> DataFrame:
    """(id): the component of one node, as what it reaches and is reached from. Both searches go
    in the same rounds; a round moves new nodes only."""
    both = durable(e.select(F.col("src").alias("id"), F.col("dst").alias("next"), F.lit(True).alias("down")).union(e.select(F.col("dst"), F.col("src"), F.lit(False))))
    kind = dict(e.dtypes)["src"]
    new = durable(e.sparkSession.createDataFrame([(pivot, True), (pivot, False)], f"id {kind}, down boolean").coalesce(1))
    seen = Pile(new)
    for _ in range(max_iter):
        new, n = counted(new.join(both, ["id", "down"]).select(F.col("next").alias("id"), "down").distinct().join(seen.all, ["id", "down"], "left_anti"))
        if n == 0:
            return durable(seen.all.groupBy("id").agg(F.count("*").alias("n")).filter("n = 2").select("id"))
        seen.add(new)
    raise RuntimeError(f"a search still grows after {max_iter} rounds")


def _without(e: DataFrame, gone: DataFrame) -> DataFrame:
    return e.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def _scc_closure(e: DataFrame, limit: int = FREE_ROWS) -> DataFrame | None:
    """(id, scc) from a doubled closure, or None as soon as a step would make more than STEP_ROWS
    rows for each edge and more than `limit`: short paths and small components only."""
    r, n = counted(e.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    most = max(limit, STEP_ROWS * n)
    while True:
        made = r.groupBy(F.col("b").alias("m")).count().join(r.groupBy(F.col("a").alias("m")).agg(F.count("*").alias("o")), "m").agg(F.sum(F.col("count") * F.col("o"))).first()[0] or 0
        if made > most:
            return None
        old = r
        r, now = counted(r.union(r.select("a", F.col("b").alias("m")).join(r.select(F.col("a").alias("m"), "b"), "m").select("a", "b")).distinct())
        free(old)
        if now == n:
            both = r.join(r.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
            return both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("scc"))
        n = now


def _walked(t: pa.Table) -> pa.Table:
    """(id, scc) of the edges (src, dst) in one pass (Tarjan): time and memory are linear in them."""
    ends = pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks], t.schema.field("src").type).combine_chunks().dictionary_encode()
    ids, code = ends.dictionary, ends.indices.to_numpy()
    src, dst = code[: len(t)], code[len(t) :]
    order = np.argsort(src, kind="stable")
    to = dst[order].tolist()
    begin = np.searchsorted(src[order], np.arange(len(ids) + 1)).tolist()
    at, low, seen, path, comp = begin[:-1], [0] * len(ids), [0] * len(ids), [], [-1] * len(ids)
    now = 0
    for start in range(len(ids)):
        if seen[start]:
            continue
        now += 1
        seen[start] = low[start] = now
        todo = [start]
        path.append(start)
        while todo:
            x = todo[-1]
            if at[x] < begin[x + 1]:
                y = to[at[x]]
                at[x] += 1
                if not seen[y]:
                    now += 1
                    seen[y] = low[y] = now
                    todo.append(y)
                    path.append(y)
                elif comp[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            todo.pop()
            if todo:
                low[todo[-1]] = min(low[todo[-1]], low[x])
            if low[x] == seen[x]:
                while comp[x] < 0:
                    comp[path.pop()] = x
    group = pa.table({"scc": pa.array(comp, pa.int64()), "id": ids})
    least = group.group_by("scc").aggregate([("id", "min")])
    place = dict(zip(least.column("scc").to_pylist(), range(len(least)), strict=True))
    return pa.table({"id": ids, "scc": least.column("id_min").combine_chunks().take(pa.array([place[c] for c in comp], pa.int64()))})


def _scc_walk(e: DataFrame, n: int) -> DataFrame | None:
    """(id, scc) of n edges by walks, one a task: over all edges if there are WALK_EDGES at most, else
    over parts that share no node; None if a part has more edges than that."""
    if n <= WALK_EDGES:
        dealt = e.select("src", "dst", F.lit(0).alias("p"))
    else:
        part = connected_components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        dealt = durable(e.join(part.select(F.col("v").alias("src"), "component"), "src").select("src", "dst", "component"))
        if dealt.groupBy("component").count().agg(F.max("count")).first()[0] > WALK_EDGES:
            return None
        dealt = dealt.select("src", "dst", F.pmod(F.xxhash64("component"), F.lit(4 * -(-n // WALK_EDGES))).alias("p"))
    kind = dict(e.dtypes)["src"]
    return durable(dealt.groupBy("p").applyInArrow(_walked, f"id {kind}, scc {kind}"))


def components(nodes: DataFrame, edges: DataFrame, limit: int = FREE_ROWS) -> DataFrame:
    """(id, scc, size, recursive): the smallest id of each node's strongly connected component,
    its size, and whether the node is on a cycle (component of two or more, or a self loop).

    WALK_EDGES edges or fewer are walked by one task (unless `limit` is set to another number). Of more,
    what lies on no cycle is peeled off first, while a round takes a tenth of the edges. What is left
    is walked, part by part, where no part has more edges than that, else closed by doubling
    as long as a step makes `limit` rows at most, or STEP_ROWS for each edge (a limit of 0: not at all). Beyond, the component of a node of the highest degree is found by a search from
    it and one to it, as long as such a component holds a tenth of the nodes: a large one costs a
    few passes over the edges. The many small ones that are then left come from a closure again,
    or from colouring.
    """
    e, n = counted(edges.select("src", "dst").distinct())
    if limit != FREE_ROWS or n > WALK_EDGES:
        e = trim(e, least=PEEL)  # long tails would need a round each; doubling and the searches take them in their stride
    loops = e.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    left, more = counted(e.filter("src <> dst"))
    found = []
    if more and limit == FREE_ROWS and (walked := _scc_walk(left, more)) is not None:
        found.append(walked)
        more = 0
    while more:
        raw = _scc_closure(left, limit) if limit else None
        if raw is not None:
            found.append(raw)
            break
        ends = left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")).join(left.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), "id")
        n, top = ends.agg(F.count("*"), F.max_by("id", F.struct(F.col("o") * F.col("i"), "id"))).first()
        one = _reach(left, top)
        size, least = one.agg(F.count("*"), F.min("id")).first()
        found.append(one.select("id", F.lit(least).alias("scc")))
        left, more = counted(trim(_without(left, one), least=PEEL))
        if more and size * 10 < n:
            raw = _scc_colour(left)
            found.append(raw.join(raw.groupBy("scc").agg(F.min("id").alias("l")), "scc").select("id", F.col("l").alias("scc")))
            break
    comp = nodes.select("id", F.col("id").alias("scc"))
    if found:
        known = found[0]
        for f in found[1:]:
            known = known.union(f)
        comp = nodes.select("id").join(known, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    size = comp.groupBy("scc").agg(F.count("*").alias("size"))
    return durable(comp.join(size, "scc").join(loops, "id", "left").select("id", "scc", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("recursive")))


def recursive_via_pointer(comp: DataFrame, edges: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(id): recursive nodes none of whose edges inside their component is direct. edges carry
    `indirect`; callers in verified(id) count all their edges as direct."""
    c = comp.filter("recursive").select("id", "scc")
    inside = edges.join(c.toDF("src", "s1"), "src").join(c.toDF("dst", "s2"), "dst").filter("s1 = s2")
    if verified is not None:
        inside = inside.join(verified.select(F.col("id").alias("src"), F.lit(True).alias("__v")), "src", "left").withColumn("indirect", F.col("indirect") & F.col("__v").isNull())
    direct = inside.groupBy("src").agg(F.max((~F.col("indirect")).cast("int")).alias("d"))
    return c.join(direct.filter("d = 0").select(F.col("src").alias("id")), "id", "left_semi").select("id")


def _shortcuts(nodes: DataFrame, edges: DataFrame, max_iter: int = 64) -> DataFrame | None:
    """(id, t, sw, sl, sr): for nodes with one callee, the first node down their chain that has
    not exactly one, and the sums over the chain before it. Pointer doubling: a chain of any
    length takes logarithmically many rounds. None where no such node calls another."""
    only = edges.groupBy("src").agg(F.count("*").alias("c"), F.min("dst").alias("t")).filter("c = 1").select(F.col("src").alias("id"), "t")
    j = durable(only.join(nodes, "id").select("id", "t", F.col("w").alias("sw"), F.col("len").alias("sl"), F.col("rec").alias("sr")))
    for k in range(max_iter):
        step = durable(
            j.join(j.select(F.col("id").alias("t"), F.col("t").alias("t2"), F.col("sw").alias("w2"), F.col("sl").alias("l2"), F.col("sr").alias("r2")), "t", "left")
            .select("id", F.coalesce("t2", "t").alias("t"), (F.col("sw") + F.coalesce("w2", F.lit(0))).alias("sw"), (F.col("sl") + F.coalesce("l2", F.lit(0))).alias("sl"), (F.col("sr") | F.coalesce("r2", F.lit(False))).alias("sr"), F.col("t2").isNotNull().alias("moved"))
        )
        j = step.drop("moved")
        if step.filter("moved").isEmpty():
            return None if k == 0 else j
    return j


def relax_down(nodes: DataFrame, edges: DataFrame, max_iter: int = 10_000) -> DataFrame:
    """(id, peak, down, rec): heaviest and longest chain below each node of an acyclic graph, itself
    included, and whether a marked node is on any. nodes(id, w, len, rec), w >= 0. Chains of single
    callees are cut short first; then each round only nodes whose value rose tell their callers."""
    nodes = durable(nodes.select("id", "w", "len", "rec"))
    e = durable(edges.select("src", "dst").distinct())
    cut = _shortcuts(nodes, e)
    inner, tail = nodes, None
    if cut is None:
        arcs = e.select("src", "dst", F.lit(0).cast("long").alias("ew"), F.lit(0).cast("long").alias("el"), F.lit(False).alias("er"))
    else:
        inner = durable(nodes.join(cut.select("id"), "id", "left_anti"))
        far = cut.select(F.col("id").alias("dst"), "t", "sw", "sl", "sr")
        out = e.join(cut.select(F.col("id").alias("src")), "src", "left_anti").join(far, "dst", "left")
        arcs = durable(out.select("src", F.coalesce("t", "dst").alias("dst"), F.coalesce("sw", F.lit(0)).alias("ew"), F.coalesce("sl", F.lit(0)).alias("el"), F.coalesce("sr", F.lit(False)).alias("er")))
        tail = cut
    state = inner.select("id", "w", "len", F.col("w").alias("peak"), F.col("len").alias("down"), "rec")
    new = state.select("id", "peak", "down", "rec")
    for _ in range(max_iter):
        up = arcs.join(new.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.max(F.col("peak") + F.col("ew")).alias("p"), F.max(F.col("down") + F.col("el")).alias("d"), F.max(F.col("rec") | F.col("er")).alias("r"))
        nxt = durable(
            state.join(up, "id", "left").select(
                "id", "w", "len", F.greatest("peak", F.coalesce(F.col("w") + F.col("p"), "peak")).alias("peak"), F.greatest("down", F.coalesce(F.col("len") + F.col("d"), "down")).alias("down"), F.coalesce(F.col("rec") | F.col("r"), "rec").alias("rec"),
                ((F.col("w") + F.col("p") > F.col("peak")) | (F.col("len") + F.col("d") > F.col("down")) | (F.col("r") & ~F.col("rec"))).alias("rose"),
            )
        )
        state = nxt.drop("rose")
        new = nxt.filter("rose").select("id", "peak", "down", "rec")
        if new.isEmpty():
            break
    else:
        raise RuntimeError(f"values still rise after {max_iter} rounds")
    out = state.select("id", "peak", "down", "rec")
    if tail is not None:
        ends = out.select(F.col("id").alias("t"), "peak", "down", "rec")
        out = out.union(tail.join(ends, "t").select("id", F.col("sw") + F.col("peak"), F.col("sl") + F.col("down"), F.col("sr") | F.col("rec")))
    return out


def peaks(nodes: DataFrame, edges: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(id, peak, bounded, down_depth, scc, recursive) of nodes(id, frame)."""
    known = nodes.select(F.col("id").alias("src"))
    e = durable(edges.select("src", "dst").distinct().join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi"))
    comp = components(nodes, e) if comp is None else comp
    w = nodes.join(comp, "id").groupBy("scc").agg(F.sum(F.coalesce("frame", F.lit(0))).cast("long").alias("w"), F.count("*").cast("long").alias("len"), F.max("recursive").alias("rec"))
    ce = e.join(comp.select(F.col("id").alias("src"), F.col("scc").alias("s")), "src").join(comp.select(F.col("id").alias("dst"), F.col("scc").alias("d")), "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    ce = durable(ce)
    best = relax_down(w.withColumnRenamed("scc", "id"), ce).select(F.col("id").alias("scc"), "peak", "down", F.col("rec").alias("bounded"))
    return durable(comp.join(best, "scc").select("id", "peak", "bounded", F.col("down").cast("int").alias("down_depth"), "scc", "recursive"))


def find_roots(nodes: DataFrame, edges: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(root, is_pinned, is_auto): pinned nodes and nodes without a caller; if there are neither,
    every node. A node that only calls itself has a caller."""
    called = edges.select(F.col("dst").alias("id")).distinct()
    auto = nodes.select("id").join(called, "id", "left_anti")
    if pinned is not None:
        auto = auto.join(pinned.select("id"), "id", "left_anti").select("id", F.lit(False).alias("p"))
        roots = pinned.select("id", F.lit(True).alias("p")).distinct().union(auto)
    else:
        roots = auto.select("id", F.lit(False).alias("p"))
    if roots.isEmpty():
        roots = nodes.select("id", F.lit(False).alias("p"))
    return roots.select(F.col("id").alias("root"), F.col("p").alias("is_pinned"), (~F.col("p")).alias("is_auto"))


def relax_up(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 256) -> DataFrame:
    """(root, id, depth, entry, truncated): longest chain and heaviest sum of frames from each root to
    each node it reaches, both ends included and each maximised on its own, in an acyclic graph.

    A chain counts `len` of its nodes and grows no more once it counts max_depth; truncated tells
    that a chain to this node stopped there with calls to go on, so nodes behind it may lack it."""
    e = durable(edges.select("src", "dst").distinct().join(nodes.select(F.col("id").alias("dst"), F.col("w").alias("dw"), F.col("len").alias("dlen")), "dst"))
    # Round k holds the best chains of k steps for each pair, so a round meets the edges only, never
    # the pairs of other rounds; what is best over all rounds is asked once, at the end.
    new = durable(seeds.select(F.col("root"), F.col("root").alias("id")).join(nodes, "id").select("root", "id", F.col("len").alias("depth"), F.col("w").alias("entry")))
    all_, steps = Pile(new), 0
    while steps < max_depth:
        steps += 1
        step = new.filter(F.col("depth") < max_depth).withColumnRenamed("id", "src").join(e, "src").groupBy("root", F.col("dst").alias("id"))
        new = durable(step.agg(F.max(F.col("depth") + F.col("dlen")).alias("depth"), F.max(F.col("entry") + F.col("dw")).alias("entry")))
        if new.isEmpty():
            break
        all_.add(new)
    goes_on = e.select(F.col("src").alias("id")).distinct().withColumn("more", F.lit(True))
    best = all_.all.groupBy("root", "id").agg(F.max("depth").alias("depth"), F.max("entry").alias("entry"))
    return best.join(goes_on, "id", "left").select("root", "id", "depth", "entry", ((F.col("depth") >= max_depth) & F.col("more").isNotNull()).alias("truncated"))


def per_root(nodes: DataFrame, edges: DataFrame, pk: DataFrame, roots: DataFrame, max_depth: int = 256) -> DataFrame:
    """(id, root, depth, entry, peak, bounded, is_auto, is_pinned, truncated): how each root sees each
    node; peak = entry + own peak - own frame, the heaviest full chain through the node. Chains run
    over components; inside one, entry and depth take the component's bound. Depths beyond
    max_depth nodes are not followed; truncated marks where."""
    w = nodes.join(pk, "id").groupBy("scc").agg(F.sum(F.coalesce("frame", F.lit(0))).cast("long").alias("w"), F.count("*").cast("long").alias("len"))
    scc = pk.select("id", "scc")
    ce = edges.join(scc.toDF("src", "s"), "src").join(scc.toDF("dst", "d"), "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    seeds = roots.join(scc.withColumnRenamed("id", "root"), "root").select(F.col("scc").alias("root")).distinct()
    up = relax_up(seeds, w.withColumnRenamed("scc", "id"), ce, max_depth)
    out = up.select(F.col("root").alias("rscc"), F.col("id").alias("scc"), "depth", "entry", "truncated").join(pk.drop("down_depth", "recursive"), "scc").join(w.select("scc", "w"), "scc")
    out = out.join(roots.join(scc.toDF("root", "rscc"), "root"), "rscc")
    return out.select("id", "root", F.col("depth").cast("int").alias("depth"), "entry", (F.col("entry") + F.col("peak") - F.col("w")).alias("peak"), "bounded", "is_auto", "is_pinned", "truncated")


def conditional_per_root(nodes: DataFrame, edges: DataFrame, roots: DataFrame, conditions: list, max_depth: int = 256, compat_entry: bool = False) -> DataFrame:
    """Per-root values where some edges hold only under a condition on root and path.

    edges(src, dst, cond_id), conditions[cond_id]. A traversal state is (root, node, mask); mask
    tells which of the watched functions lie on the path, the node itself included (nodes may carry
    a column `watch`, by which conditions know them instead of their id). Per node the
    deepest state gives depth, the best of entry + heaviest chain below in its state gives peak.
    compat_entry reports a node's own frame as entry for all but the root. bounded is true where
    a state can return to itself.
    """
    bits = _rules.watched(conditions)
    bit = F.lit(0)
    label = F.col("watch" if "watch" in nodes.columns else "id").cast("string")
    for f, b in bits.items():
        bit = F.when(label == f, b).otherwise(bit)
    n = durable(nodes.select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("frame"), bit.cast("int").alias("bit")))
    e = durable(edges.select("src", "dst", "cond_id").distinct().join(n.select(F.col("id").alias("dst"), F.col("bit").alias("dbit")), "dst"))
    holds = F.col("cond_id").isNull()
    for k, c in enumerate(conditions):
        holds = holds | ((F.col("cond_id") == k) & _rules.path_condition(c, bits))
    key = lambda a, m: F.concat_ws("\u0001", "root", a, F.col(m).cast("string"))
    new, steps = durable(roots.select("root", F.col("root").alias("id")).join(n, "id").select("root", "id", F.col("bit").alias("mask"))), None
    seen = Pile(new)
    for _ in range(max_depth * (len(bits) + 1) + 1):  # a path of max_depth nodes changes its mask at most len(bits) times
        go = new.withColumnRenamed("id", "src").join(e, "src").filter(holds).select("root", "src", "mask", F.col("dst").alias("id"), F.col("mask").bitwiseOR(F.col("dbit")).alias("to"))
        go = durable(go.select(key("src", "mask").alias("src"), key("id", "to").alias("dst"), "root", "id", F.col("to").alias("mask"), F.col("src").alias("from")))
        if steps is None:
            steps = Pile(go)
        else:
            steps.add(go)
        new, more = counted(go.select("root", "id", "mask").distinct().join(seen.all, ["root", "id", "mask"], "left_anti"))
        if not more:
            break
        seen.add(new)
    else:
        raise RuntimeError("conditional paths go deeper than max_depth allows")
    states = durable(seen.all.join(n.select("id", "frame"), "id").select("root", F.col("id").alias("node"), "mask", "frame", key("id", "mask").alias("id")))
    # A state that can return to itself is of a node that can, so only such steps are asked for components.
    steps = steps.all.select("src", "dst", "from", F.col("id").alias("to"))
    base = components(n, e.select("src", "dst")).filter("size > 1 or recursive").select("id", "scc")
    turns = steps.join(base.toDF("from", "s"), "from").join(base.toDF("to", "d"), "to").filter("s = d").select("src", "dst")
    steps = steps.select("src", "dst")
    pk = peaks(states.select("id", "frame"), steps, components(states, turns))
    first = states.filter(F.col("root") == F.col("node")).groupBy("root").agg(F.min_by("id", "mask").alias("id"))
    up = per_root(states.select("id", "frame"), steps, pk, first.select(F.col("id").alias("root"), F.lit(False).alias("is_pinned"), F.lit(True).alias("is_auto")), max_depth)
    s = up.select("id", F.col("root").alias("rs"), "depth", "entry", "peak", "bounded").join(states, "id").join(first.select("root", F.col("id").alias("rs")), ["root", "rs"])
    out = s.groupBy("root", F.col("node").alias("id")).agg(F.max("depth").alias("depth"), F.max("entry").alias("entry"), F.max("peak").alias("peak"), F.max("bounded").alias("bounded"), F.max("frame").alias("frame"))
    if compat_entry:
        out = out.withColumn("entry", F.when(F.col("root") == F.col("id"), F.col("entry")).otherwise(F.col("frame")))
    return out.drop("frame").join(roots, "root").select("id", "root", "depth", "entry", "peak", "bounded", "is_auto", "is_pinned")


def replay_peaks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, peak, down_depth) in the visiting order of a memoised depth-first walk in which a
    revisited node returns its own frame: an order-dependent legacy model of cycles.

    Only nodes that reach a cycle are replayed; parts of that sub-graph that share no call are
    independent of each other and go to a task each. nodes(id, frame, ord), edges(src, dst, seq).
    """
    pk = peaks(nodes, edges)
    bad = pk.filter("bounded").select("id")
    rest = pk.filter("not bounded").select("id", "peak", "down_depth")
    e = edges.join(bad.withColumnRenamed("id", "src"), "src", "left_semi").groupBy("src", "dst").agg(F.min("seq").alias("seq"))
    exact = rest.select(F.col("id").alias("dst"), F.col("peak").alias("xp"), F.col("down_depth").alias("xd"))
    rows = nodes.join(bad, "id", "left_semi").select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("frame"), F.col("ord").cast("long").alias("ord"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("long").alias("xp"), F.lit(None).cast("long").alias("xd"))
    arcs = e.join(exact, "dst", "left").select(F.col("src").alias("id"), F.lit(None).cast("long").alias("frame"), F.col("seq").cast("long").alias("ord"), F.col("dst").cast("string").alias("dst"), F.col("xp").cast("long").alias("xp"), F.col("xd").cast("long").alias("xd"))
    kind = dict(nodes.dtypes)["id"]

    def walk(pdf):
        import pandas as pd

        own = pdf[pdf.dst.isna()].sort_values("ord")
        frame = dict(zip(own.id.astype(str), own.frame.astype(int), strict=True))
        fixed, out = {}, {k: [] for k in frame}
        for r in pdf[pdf.dst.notna()].sort_values(["id", "ord"]).itertuples():
            out[str(r.id)].append(r.dst)
            if r.xp == r.xp and r.xp is not None:
                fixed[r.dst] = (int(r.xp), int(r.xd))
        done: dict[str, tuple[int, int]] = dict(fixed)
        for start in frame:
            stack, active = [[start, 0, 0, 0]], {start}
            if start in done:
                continue
            while stack:
                top = stack[-1]
                node, i = top[0], top[1]
                if i < len(out[node]):
                    top[1] += 1
                    t = out[node][i]
                    if t in active:
                        v = (frame[t], 1)
                    elif t in done:
                        v = done[t]
                    else:
                        stack.append([t, 0, 0, 0])
                        active.add(t)
                        continue
                    top[2], top[3] = max(top[2], v[0]), max(top[3], v[1])
                else:
                    stack.pop()
                    active.discard(node)
                    done[node] = (frame[node] + top[2], 1 + top[3])
                    if stack:
                        stack[-1][2], stack[-1][3] = max(stack[-1][2], done[node][0]), max(stack[-1][3], done[node][1])
        ids = list(frame)
        return pd.DataFrame({"id": pd.Series(ids).astype(own.id.dtype), "peak": [done[i][0] for i in ids], "down_depth": [done[i][1] for i in ids]})

    inner = e.join(bad.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    parts = connected_components(inner).withColumnRenamed("v", "id")
    again = rows.unionByName(arcs).join(parts, "id", "left").withColumn("__g", F.coalesce("component", "id")).drop("component").groupBy("__g").applyInPandas(lambda pdf: walk(pdf.drop(columns="__g")), f"id {kind}, peak long, down_depth int")
    return rest.union(again)


def legacy_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, peak): legacy model in which a node has no peak when neither it nor a direct callee
    has a frame, and a cycle adds nothing beyond its members."""
    pk = peaks(nodes, edges)
    seen = edges.join(nodes.filter("frame is not null").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).union(nodes.filter("frame is not null").select("id")).distinct().withColumn("k", F.lit(True))
    return pk.join(seen, "id", "left").select("id", F.when(F.col("k"), F.col("peak")).alias("peak"), "bounded")


def analyse(nodes: DataFrame, edges: DataFrame, pinned: DataFrame | None = None, conditions: list | None = None, verified: DataFrame | None = None, max_depth: int = 256) -> dict[str, DataFrame]:
    """All results of one graph: metrics, per_root and roots. edges(src, dst, indirect, cond_id)."""
    nodes, edges = durable(nodes), durable(edges)
    pk = peaks(nodes, edges)
    roots = durable(find_roots(nodes, edges, pinned))
    if conditions:
        pr = conditional_per_root(nodes, edges, roots, conditions, max_depth)
    else:
        pr = per_root(nodes, edges, pk, roots, max_depth)
    pr = durable(pr)
    deepest = pr.groupBy("id").agg(F.max("depth").alias("depth"))
    comp = pk.select("id", "scc", "recursive")
    via = recursive_via_pointer(comp, edges, verified) if "indirect" in edges.columns else nodes.limit(0).select("id")
    flag = lambda d, c: d.select("id", F.lit(True).alias(c))
    m = pk.join(deepest, "id", "left").join(flag(via, "v"), "id", "left").join(roots.withColumnRenamed("root", "id"), "id", "left")
    m = m.join(flag(verified, "fp"), "id", "left") if verified is not None else m.withColumn("fp", F.lit(False))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    m = m.select("id", "peak", "bounded", "recursive", no("v").alias("recursive_via_fp"), "down_depth", F.coalesce("depth", F.lit(0)).alias("depth"), "scc", no("fp").alias("fp_verified"), no("is_pinned").alias("is_pinned_root"), no("is_auto").alias("is_auto_root"))
    return {"metrics": m, "per_root": pr, "roots": roots}
