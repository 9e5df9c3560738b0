"""Bounded neighbourhoods, paths, longest chains, cycles and corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixpoint import Pile, counted, durable
from .metrics import closure_doubling, closure_seeded, components, peaks

BUDGET, PATHS, PATH_LENGTH = 600, 5, 32


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def bfs(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """(id, hop): nodes within `hops` edges of start(id), the start at 0."""
    e = durable(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct())
    new, k = durable(start.select("id", F.lit(0).alias("hop"))), 0
    seen = Pile(new)
    while hops is None or k < hops:
        k += 1
        new, n = counted(new.join(e, "id").select(F.col("next").alias("id")).distinct().join(seen.all, "id", "left_anti").select("id", F.lit(k).alias("hop")))
        if n == 0:
            break
        seen.add(new)
    return durable(seen.all)


def discovered(edges: DataFrame, focus, up: int, down: int, budget: int = BUDGET) -> tuple[list[tuple], bool]:
    """([(id, layer)], cut) in the order of discovery: callees hop by hop, each hop in the order of
    its callers and of their calls (`seq`, else the smaller callee), then callers in the same way,
    by the smaller id. The way up does not lead through what was found below. The search ends with
    the node that does not fit into the budget, so no more than that is ever on the driver; a hop is
    one job, in which every node takes its first place before places are ordered."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    found, cut = [(focus, 0)], False
    for sign, hops, e in ((1, down, edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), (F.col("seq") if "seq" in edges.columns else F.col("dst")).alias("seq"))), (-1, up, edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), F.col("src").alias("seq")))):
        frontier = [focus]
        for h in range(1, hops + 1):
            room = budget - len(found)
            here = spark.createDataFrame(list(zip(frontier, range(len(frontier)), strict=True)), f"at {kind}, place int")
            seen = spark.createDataFrame([(x,) for x, _ in found], f"next {kind}")
            new = e.join(F.broadcast(here), "at").groupBy("next").agg(F.min(F.struct("place", "seq")).alias("first")).join(F.broadcast(seen), "next", "left_anti")  # both hold `budget` rows at most
            frontier = [r.next for r in new.orderBy("first", "next").limit(room + 1).collect()]
            cut |= len(frontier) > room
            frontier = frontier[:room]
            found += [(x, sign * h) for x in frontier]
            if cut or not frontier:
                break
        if cut:
            break
    return found, cut


def neighbourhood(edges: DataFrame, focus, up: int, down: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, cut): nodes(id, layer, truncated_callees, truncated_callers, number) around a
    focus, positive layers below and negative above; a node on both sides is below. At most `budget`
    nodes, numbered as they are discovered. edges(src, dst, on_focus, recursive, indirect): recursive
    tells cycles inside the neighbourhood.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    pointer = F.max("indirect") if "indirect" in edges.columns else F.lit(False)
    order = [F.min("seq").alias("seq")] if "seq" in edges.columns else []
    e = durable(edges.groupBy("src", "dst").agg(pointer.alias("indirect"), *order))
    found, cut = discovered(e, focus, up, down, budget)
    n = durable(spark.createDataFrame([(x, layer, i) for i, (x, layer) in enumerate(found)], f"id {kind}, layer int, number int"))
    inside = durable(e.join(n.select(F.col("id").alias("src"), F.col("layer").alias("lf")), "src").join(n.select(F.col("id").alias("dst"), F.col("layer").alias("lt")), "dst"))
    out_miss = e.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct()
    in_miss = e.join(n.select(F.col("id").alias("dst")), "dst", "left_semi").join(n.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    mark = lambda d, c: d.withColumn(c, F.lit(True))
    nodes = n.join(mark(out_miss, "x"), "id", "left").join(mark(in_miss, "y"), "id", "left").select("id", "layer", F.coalesce("x", F.lit(False)).alias("truncated_callees"), F.coalesce("y", F.lit(False)).alias("truncated_callers"), "number")
    comp = components(n.select("id"), inside.select("src", "dst"))
    same = inside.join(comp.select(F.col("id").alias("src"), F.col("scc").alias("s")), "src").join(comp.select(F.col("id").alias("dst"), F.col("scc").alias("d")), "dst")
    on = ((F.col("lf") < F.col("lt")) & (F.col("lt") <= 0)) | ((F.col("lf") >= 0) & (F.col("lf") < F.col("lt"))) | (F.col("src") == F.col("dst"))
    return nodes, same.select("src", "dst", on.alias("on_focus"), (F.col("s") == F.col("d")).alias("recursive"), "indirect"), cut


def drill_down(depth: int | None) -> tuple[int, int]:
    """(up, down) hops of a root's graph from a depth hint."""
    return 0, min(20, max(1, (6 if depth is None else depth) - 1))


def _ranked(paths: DataFrame, by: str, limit: int) -> DataFrame:
    """The heaviest `limit` paths of each `by`, equals in the order of their nodes."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("total"), "nodes"))
    return paths.withColumn("rank", r).filter(F.col("rank") <= limit)


def paths_from(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = PATH_LENGTH, limit: int | None = None) -> DataFrame:
    """(start, nodes, total, by_cycle, by_depth): every path from starts(id) to a leaf, to the
    depth cap, or to a node it has been at, which is repeated at its end and counted again. With
    `limit` the heaviest of each start with their rank, found without listing the others; paths of
    one node stay only where a start has no other.
    """
    e = durable(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    w = nodes.select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("w"))
    if limit is not None:
        return _best_paths(w, e, starts, max_depth, limit)
    step = durable(e.join(w.withColumnRenamed("id", "next"), "next"))
    live = durable(starts.select("id").distinct().join(w, "id").select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.col("w").alias("total")))
    leaf = e.select("at").distinct()
    done = None
    for k in range(max_depth + 1):
        if k == max_depth:
            end = live.select("start", "nodes", "total", F.lit(False).alias("by_cycle"), F.lit(True).alias("by_depth"))
            done = end if done is None else done.union(end)
            break
        end = live.join(leaf, "at", "left_anti").select("start", "nodes", "total", F.lit(False).alias("by_cycle"), F.lit(False).alias("by_depth"))
        grown = durable(_walked(live, step))
        cyc = grown.filter("again").select("start", "nodes", "total", F.lit(True).alias("by_cycle"), F.lit(False).alias("by_depth"))
        done = end.union(cyc) if done is None else done.union(end).union(cyc)
        live = grown.filter("not again").drop("again")
        if live.isEmpty():
            break
    return done


def _walked(live: DataFrame, step: DataFrame) -> DataFrame:
    """Open walks one call further; `again` tells that the new node was on the walk."""
    return live.join(step, "at").select("start", F.col("next").alias("at"), F.array_append("nodes", F.col("next")).alias("nodes"), (F.col("total") + F.col("w")).alias("total"), F.array_contains("nodes", F.col("next")).alias("again"))


def _best_paths(w: DataFrame, e: DataFrame, starts: DataFrame, max_depth: int, limit: int) -> DataFrame:
    """The `limit` heaviest paths of each start.

    A node that reaches no cycle keeps a sorted list of its `limit` best ways down; a caller's list
    is the best of its callees' lists, so 2^40 paths through a ladder are never made. Where the
    depth cap can bind, a list is kept for each number of calls left, as long as it still changes.
    Walks are made one by one only through nodes that reach a cycle, where what may follow depends
    on the whole walk; on leaving these, a walk takes the lists of the node it comes to.
    """
    ids = durable(starts.select("id").distinct().join(w.select("id"), "id", "left_semi"))
    near = bfs(e.toDF("src", "dst"), ids, max_depth)
    e = durable(e.join(near.select(F.col("id").alias("at")), "at", "left_semi").join(w.select(F.col("id").alias("next"), F.col("w").alias("nw")), "next").join(w.toDF("at", "w"), "at").select("at", "next", "w", "nw"))
    here = near.select("id").union(e.select("next")).distinct().join(w, "id")
    has_calls = e.select(F.col("at").alias("id")).distinct()
    own = lambda d, deep: d.select("id", F.array("id").alias("nodes"), F.col("w").alias("total"), F.lit(deep).alias("by_depth"))

    def merged(targets: DataFrame, lists: DataFrame) -> DataFrame:
        got = e.join(targets.withColumnRenamed("id", "at"), "at", "left_semi").join(lists.withColumnRenamed("id", "next"), "next")
        ways = got.select(F.col("at").alias("id"), F.concat(F.array("at"), "nodes").alias("nodes"), (F.col("w") + F.col("total")).alias("total"), "by_depth")
        return durable(_ranked(ways, "id", limit).drop("rank"))

    # From the leaves up, a node gets its list once all its callees have theirs. A node that never does reaches a cycle.
    new = durable(own(here.join(has_calls, "id", "left_anti"), False))
    lists, open_, height, n = Pile(new), e.select("at", "next"), 1, 1
    while n:
        done = new.select(F.col("id").alias("next")).distinct()
        left, n = counted(open_.join(done, "next", "left_anti"))
        ready = open_.join(done, "next", "left_semi").select(F.col("at").alias("id")).distinct().join(left.select(F.col("at").alias("id")).distinct(), "id", "left_anti")
        new = merged(ready, lists.all) if height < max_depth else durable(ready)  # where the cap binds, only who reaches a cycle matters
        open_ = left
        if new.isEmpty():
            break
        height += 1
        if height <= max_depth:
            lists.add(new)
    bad = durable(open_.select(F.col("at").alias("id")).distinct())
    if n == 0 and height <= max_depth:
        found = lists.all.join(ids, "id", "left_semi").select(F.col("id").alias("start"), "nodes", "total", F.lit(False).alias("by_cycle"), "by_depth")
    else:
        good = durable(here.join(bad, "id", "left_anti"))
        inner = durable(e.join(good.select(F.col("id").alias("at")), "at", "left_semi"))
        # all_ holds (id, left, ...): the list of a node from that number of calls left on, until a larger `left`
        now, has_calls = durable(own(good, True)), has_calls.join(good, "id", "left_semi")
        all_, new = Pile(now.withColumn("left", F.lit(0))), None
        for left in range(1, max_depth + 1):
            if left == 1:
                new = own(good.join(has_calls, "id", "left_anti"), False).union(merged(has_calls, now))
            else:
                new = merged(inner.join(new.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select(F.col("at").alias("id")).distinct(), now)
            new = durable(new)
            if new.isEmpty():
                break
            all_.add(new.withColumn("left", F.lit(left)))
            now = durable(now.join(new.select("id").distinct(), "id", "left_anti").union(new))
        all_ = durable(all_.all)
        since = durable(all_.select("id", "left").distinct().withColumn("until", F.lead("left").over(Window.partitionBy("id").orderBy("left"))))
        all_ = all_.join(since, ["id", "left"]).select(F.col("id").alias("at"), F.col("nodes").alias("rest"), F.col("total").alias("below"), F.col("by_depth").alias("deep"), "left", "until")

        def closed(live: DataFrame, left: int) -> DataFrame:
            """Walks at nodes that reach no cycle, with each of the best ways on."""
            got = live.join(all_.filter((F.col("left") <= left) & (F.coalesce("until", F.lit(left + 1)) > left)), "at")
            ways = got.select("start", F.concat("nodes", "rest").alias("nodes"), (F.col("total") + F.col("below")).alias("total"), F.lit(False).alias("by_cycle"), F.col("deep").alias("by_depth"))
            return durable(_ranked(ways, "start", limit).drop("rank"))

        none = lambda d: d.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast(f"array<{dict(ids.dtypes)['id']}>").alias("nodes"), F.lit(0).cast("long").alias("total"))
        found = closed(none(ids.join(good.select("id"), "id", "left_semi")), max_depth)
        live = durable(ids.join(bad, "id", "left_semi").join(w, "id").select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.col("w").alias("total")))
        step = durable(e.join(bad.withColumnRenamed("id", "at"), "at", "left_semi").select("at", "next", F.col("nw").alias("w")))
        for k in range(max_depth + 1):
            if live.isEmpty():
                break
            if k == max_depth:
                found = found.union(live.select("start", "nodes", "total", F.lit(False).alias("by_cycle"), F.lit(True).alias("by_depth")))
                break
            grown = durable(_walked(live, step))
            found = found.union(grown.filter("again").select("start", "nodes", "total", F.lit(True).alias("by_cycle"), F.lit(False).alias("by_depth")))
            away = grown.filter("not again").join(good.toDF("at", "aw"), "at")
            # the list of the next node starts with that node, which the walk has already
            away = away.select("start", "at", F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("nodes"), (F.col("total") - F.col("aw")).alias("total"))
            found = found.union(closed(away, max_depth - k - 1))
            live = durable(grown.filter("not again").drop("again").join(bad.withColumnRenamed("id", "at"), "at", "left_semi"))
    several = F.max(F.size("nodes")).over(Window.partitionBy("start")) > 1
    found = _ranked(found, "start", limit + 1).drop("rank")
    return _ranked(found.withColumn("__m", several).filter(~F.col("__m") | (F.size("nodes") > 1)).drop("__m"), "start", limit)


def paths_to(nodes: DataFrame, edges: DataFrame, ends: DataFrame, max_depth: int = PATH_LENGTH, limit: int | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """The same towards ends(id), written root to end: reversed edges, at which pinned roots other
    than the end are terminal. Paths of one node and mere self loops are left out. With `limit`,
    equals come in the order of their nodes from the end up."""
    e = reversed_edges(edges.select("src", "dst"))
    if pinned is not None:
        e = e.join(pinned.join(ends, "id", "left_anti").select(F.col("id").alias("src")), "src", "left_anti")
    p = paths_from(nodes, e, ends, max_depth, None if limit is None else limit + 1)
    p = p.filter((F.size("nodes") > 1) & ~((F.size("nodes") == 2) & (F.col("nodes")[0] == F.col("nodes")[1])))
    if limit is not None:
        p = _ranked(p.drop("rank"), "start", limit)
    also = ["rank"] if limit is not None else []
    return p.select(F.col("start").alias("end"), F.reverse("nodes").alias("nodes"), "total", "by_cycle", "by_depth", *also)


def paths_capped(nodes: DataFrame, edges: DataFrame, starts: DataFrame, limit: int = PATHS, max_depth: int = PATH_LENGTH) -> DataFrame:
    """(start, rank, nodes, total, by_cycle, by_depth) in the order of a depth-first walk that
    stops after 4 * limit paths and ranks only these. edges(src, dst, seq).

    The first paths of a node are the first of what its callees' lists give in the order of its
    calls, so lists are merged by height, each once for all starts. Only starts that reach a cycle
    or a chain that max_depth cuts are walked, each over its own reachable edges in one group."""
    kind, cap = dict(nodes.dtypes)["id"], 4 * limit
    ids = durable(starts.select("id").distinct())
    w = durable(nodes.select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("w")))
    known = w.select(F.col("id").alias("src"))
    e = durable(edges.groupBy("src", "dst").agg(F.min("seq").alias("seq")).join(known, "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi"))
    high = peaks(nodes, e).select("id", F.when(~F.col("bounded") & (F.col("down_depth") <= max_depth), F.col("down_depth")).alias("h"))
    here = durable(high.join(w, "id"))
    tops = here.agg(F.max("h")).first()[0] or 0
    arcs = durable(e.join(here.filter("h > 1").withColumnRenamed("id", "src"), "src"))
    lists = Pile(durable(here.filter("h = 1").select("id", F.lit(1).alias("k"), F.array("id").alias("nodes"), F.col("w").alias("total"))))
    for h in range(2, tops + 1):
        ways = arcs.filter(F.col("h") == h).join(lists.all.select(F.col("id").alias("dst"), "k", "nodes", "total"), "dst")
        first = ways.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("seq", "dst", "k"))).filter(F.col("n") <= cap)
        lists.add(durable(first.select(F.col("src").alias("id"), F.col("n").alias("k"), F.concat(F.array("src"), "nodes").alias("nodes"), (F.col("w") + F.col("total")).alias("total"))))
    best = lists.all.join(ids, "id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("total"), "k"))).filter(F.col("rank") <= limit)
    best = best.select(F.col("id").alias("start"), "rank", "nodes", "total", F.lit(False).alias("by_cycle"), F.lit(False).alias("by_depth"))
    rest = durable(here.filter("h is null").select("id").join(ids, "id"))
    if rest.isEmpty():
        return best
    reach = closure_seeded(e, rest.select(F.col("id").alias("seed")))
    part = reach.join(w.withColumnRenamed("id", "node"), "node").select("seed", F.col("node").alias("src"), "w").join(e, "src", "left")

    def walk(pdf):
        import pandas as pd

        start = pdf.seed.iloc[0]
        frame = dict(zip(pdf.src, pdf.w, strict=True))
        out: dict = {}
        for r in pdf[pdf.dst.notna()].sort_values(["src", "seq", "dst"]).itertuples():
            out.setdefault(r.src, []).append(type(start)(r.dst))
        found = []

        def emit(path, cyc, deep):
            found.append((path, int(sum(frame[x] for x in path)), cyc, deep))

        stack = [[start, 0]]
        while stack and len(found) < cap:
            node, i = stack[-1]
            kids = out.get(node, [])
            path = [x[0] for x in stack]
            if i == 0 and (not kids or len(stack) - 1 >= max_depth):
                emit(path, False, len(stack) - 1 >= max_depth)
                stack.pop()
                continue
            if i >= len(kids):
                stack.pop()
                continue
            stack[-1][1] += 1
            if kids[i] in path:
                emit([*path, kids[i]], True, False)
            else:
                stack.append([kids[i], 0])
        found.sort(key=lambda p: -p[1])
        if any(len(p[0]) > 1 for p in found):
            found = [p for p in found if len(p[0]) > 1]
        keep, seen = [], set()
        for p in found:
            if tuple(p[0]) not in seen:
                seen.add(tuple(p[0]))
                keep.append(p)
        keep = keep[:limit]
        return pd.DataFrame({"start": [start] * len(keep), "rank": range(1, len(keep) + 1), "nodes": [p[0] for p in keep], "total": [p[1] for p in keep], "by_cycle": [p[2] for p in keep], "by_depth": [p[3] for p in keep]})

    return best.union(part.groupBy("seed").applyInPandas(walk, f"start {kind}, rank int, nodes array<{kind}>, total long, by_cycle boolean, by_depth boolean"))


def longest_chain(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, nodes, total): the longest chain by node count below each of starts(id); among equal
    callees the one called first, then the smaller id. A component on the way is entered once and
    named by its smallest node, so chains end everywhere."""
    pk = peaks(nodes, edges)
    seq = F.min("seq") if "seq" in edges.columns else F.lit(0)
    e = edges.groupBy("src", "dst").agg(seq.alias("seq"))
    scc = pk.select("id", "scc", "down_depth")
    j = e.join(scc.toDF("src", "s", "sd"), "src").join(scc.toDF("dst", "d", "dd"), "dst").filter("s <> d")
    best = durable(j.groupBy("s").agg(F.min_by("d", F.struct(-F.col("dd"), F.col("seq"), F.col("d"))).alias("next")))
    w = nodes.join(scc, "id").groupBy("scc").agg(F.sum(F.coalesce("frame", F.lit(0))).cast("long").alias("w"))
    live = durable(starts.select("id").join(scc, "id").join(w, "scc").select(F.col("id").alias("start"), F.col("scc").alias("at"), F.array("scc").alias("nodes"), F.col("w").alias("total")))
    done = None
    while True:
        nxt = durable(live.join(best, live["at"] == best["s"], "left").select("start", "at", "nodes", "total", "next"))
        end = nxt.filter("next is null").select("start", "nodes", "total")
        done = end if done is None else done.union(end)
        live = nxt.filter("next is not null").join(w.withColumnRenamed("scc", "next"), "next").select("start", F.col("next").alias("at"), F.array_append("nodes", F.col("next")).alias("nodes"), (F.col("total") + F.col("w")).alias("total"))
        live = durable(live)
        if live.isEmpty():
            return done


def inject_longest(paths: DataFrame, longest: DataFrame) -> DataFrame:
    """Ranked paths with each start's longest chain in front, listed once."""
    front = longest.select("start", "nodes", "total", F.lit(0).alias("rank"))
    both = front.unionByName(paths.select("start", "nodes", "total", "rank"))
    return both.groupBy("start", "nodes").agg(F.min("rank").alias("r"), F.first("total").alias("total")).withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy("r"))).drop("r")


def sort_paths(paths: DataFrame, by: str = "stack") -> DataFrame:
    return paths.orderBy(F.desc("total") if by == "stack" else F.desc(F.size("nodes")), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">"))


def shortest_cycles(edges: DataFrame, members: DataFrame, max_hops: int = 10_000) -> DataFrame:
    """(id, hops, nodes): a shortest cycle through each of members(id), as [id, ..., id]; among
    equals the one whose nodes come first. Nodes on no cycle are not listed."""
    e = durable(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    live = members.select("id").distinct().select("id", F.col("id").alias("at"), F.array("id").alias("nodes"))
    seen = live.select("id", "at").limit(0)
    done = None
    for _ in range(max_hops):
        grown = live.join(e, "at").groupBy("id", F.col("next").alias("at")).agg(F.min(F.array_append("nodes", F.col("next"))).alias("nodes"))
        grown = durable(grown.join(seen, ["id", "at"], "left_anti"))
        hit = durable(grown.filter("id = at").select("id", (F.size("nodes") - 1).alias("hops"), "nodes"))
        done = hit if done is None else done.union(hit)
        seen = durable(seen.union(grown.select("id", "at")))
        live = grown.join(hit.select("id"), "id", "left_anti")
        if live.isEmpty():
            break
    return done


def cycles(edges: DataFrame, members: DataFrame, max_hops: int = PATH_LENGTH, limit: int = PATHS, budget: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(listed, truncated): listed(id, rank, hops, nodes), the loops [id, ..., id] through each of
    members(id), shorter ones first; truncated(id, reason) where there may be more.

    Loops are walked to max_hops, all members at once. A member that has more than `budget` open
    walks stops there ("budget"); walks left at max_hops give "depth", more than `limit` loops give
    "count". A member without a loop among these has its shortest one, however long; one that lies
    on no loop is in neither table.
    """
    e = durable(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct())
    ids = durable(members.select("id").distinct())
    live = ids.select("id", F.col("id").alias("at"), F.array("id").alias("nodes"))
    found = why = None
    for k in range(max_hops):
        grown = durable(live.join(e, "at").select("id", F.col("next").alias("at"), F.col("nodes"), (F.col("next") == F.col("id")).alias("closed")).filter(F.col("closed") | ~F.array_contains("nodes", F.col("at"))).withColumn("nodes", F.array_append("nodes", F.col("at"))))
        hit = grown.filter("closed").select("id", "nodes")
        found = hit if found is None else found.union(hit)
        many = durable(grown.filter("not closed").groupBy("id").agg(F.count("*").alias("n")))
        stop = many.filter(F.col("n") > budget).select("id", F.lit("budget").alias("reason"))
        if k == max_hops - 1:
            stop = stop.union(many.filter(F.col("n") <= budget).select("id", F.lit("depth")))
        why = stop if why is None else why.union(stop)
        live = grown.filter("not closed").drop("closed").join(stop.select("id"), "id", "left_anti")
        if many.isEmpty():
            break
    found = durable(found)
    order = Window.partitionBy("id").orderBy(F.size("nodes"), "nodes")
    listed = found.withColumn("rank", F.row_number().over(order)).withColumn("hops", F.size("nodes") - 1)
    why = why.union(listed.filter(F.col("rank") == limit + 1).select("id", F.lit("count")))
    bare = durable(ids.join(found.select("id"), "id", "left_anti"))
    rest = shortest_cycles(edges, bare) if not bare.isEmpty() else None
    listed = listed.filter(F.col("rank") <= limit).select("id", "rank", "hops", "nodes")
    if rest is not None:
        listed = listed.union(rest.select("id", F.lit(1).alias("rank"), "hops", "nodes"))
    on = listed.select("id").distinct()
    return listed, why.groupBy("id").agg(F.min("reason").alias("reason")).join(on, "id", "left_semi")


def corridor(edges: DataFrame, focus, node) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all walks between a focus and a node below it, or above it: what one end
    reaches and the other is reached from, and the edges that lead away from the focus in steps of
    BFS distance (towards it when the node is above)."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    e = durable(edges.select("src", "dst").distinct())
    one = lambda x: spark.createDataFrame([(x,)], f"id {kind}")
    down = bfs(e, one(focus))
    below = not down.filter(F.col("id") == node).isEmpty()
    if below:
        dist, other = down, bfs(reversed_edges(e), one(node))
    else:
        dist, other = bfs(reversed_edges(e), one(focus)), bfs(e, one(node))
    both = dist.select("id").intersect(other.select("id"))
    ends = one(focus).union(one(node))
    nodes = durable(both.union(ends).distinct())
    lit = e.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    lit = lit.join(dist.toDF("src", "hs"), "src").join(dist.toDF("dst", "hd"), "dst")
    return nodes, lit.filter("hs < hd" if below else "hs > hd").select("src", "dst")


def reciprocal(edges: DataFrame) -> DataFrame:
    """(src, dst) with src < dst whose reverse is an edge too."""
    e = edges.select("src", "dst").distinct()
    return e.filter("src < dst").join(reversed_edges(e), ["src", "dst"], "left_semi")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, change): edges added and removed between two builds."""
    o, n = old.select("src", "dst"), new.select("src", "dst")
    return n.subtract(o).withColumn("change", F.lit("added")).union(o.subtract(n).withColumn("change", F.lit("removed")))


def subgraph_cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, recursive) of a small graph; recursive if dst reaches src."""
    back = closure_doubling(edges).select(F.col("a").alias("dst"), F.col("b").alias("src"), F.lit(True).alias("r"))
    return edges.select("src", "dst").join(back, ["src", "dst"], "left").select("src", "dst", (F.coalesce("r", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("recursive"))
