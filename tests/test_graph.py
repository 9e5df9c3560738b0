"""Recursive metrics and exploration on small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from callweight import fixpoint
from callweight.fixpoint import connected_components
from callweight.operators import explore, metrics, rules

NODES, EDGES = "id string, frame long, ord int", "src string, dst string, seq int, indirect boolean"


def graph(spark, frames, edges, indirect=()):
    n = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(frames.items())], NODES)
    e = spark.createDataFrame([(a, b, i, (a, b) in indirect) for i, (a, b) in enumerate(edges)], EDGES)
    return n, e


def rows(df, *cols):
    return {r[0]: r[1:] if len(cols) > 2 else r[1] for r in df.select(*cols).collect()}


def test_golden_peaks(spark):
    f = {"lin0": 304, "lin1": 560, "lin2": 816, "lin3": 1072, "lin4": 1328, "lin5": 1552, "heavy_mid": 2096, "branch": 576, "bottom": 1040, "left": 304, "right": 816, "top": 320, "light": 144}
    e = [(f"lin{i}", f"lin{i + 1}") for i in range(5)] + [("heavy_mid", "lin0"), ("branch", "light"), ("branch", "heavy_mid"), ("top", "left"), ("top", "right"), ("left", "bottom"), ("right", "bottom")]
    got = rows(metrics.peaks(*graph(spark, f, e)), "id", "peak")
    want = {"lin5": 1552, "lin0": 5632, "lin1": 5328, "heavy_mid": 7728, "branch": 8304, "bottom": 1040, "left": 1344, "right": 1856, "top": 2176}
    assert {k: got[k] for k in want} == want


def test_cycles_are_bounded_and_certain_or_possible(spark):
    f = dict.fromkeys("abcdes", 10)
    n, e = graph(spark, f, [("s", "s"), ("a", "b"), ("b", "a"), ("c", "a"), ("d", "e")], {("a", "b"), ("b", "a")})
    got = rows(metrics.peaks(n, e), "id", "peak", "bounded", "down_depth")
    assert got["s"] == (10, True, 1) and got["a"] == (20, True, 2) and got["c"] == (30, True, 3) and got["d"] == (20, False, 2)
    m = metrics.analyse(n, e)["metrics"]
    assert rows(m.filter("recursive"), "id", "recursive_via_fp") == {"a": True, "b": True, "s": False}
    # A node that only calls itself has a caller, so no root sees it.
    assert rows(m, "id", "depth")["s"] == 0
    old = rows(metrics.replay_peaks(n, e), "id", "peak", "down_depth")
    assert old["s"] == (20, 2) and old["d"] == (20, 2)


def replay(frames, edges):
    """The memoised walk as recursion: a node met on its own path counts its frame and one level."""
    out = {k: [b for a, b in edges if a == k] for k in frames}
    done = {}

    def visit(node, path):
        if node in path:
            return frames[node], 1
        if node not in done:
            got = [visit(k, path | {node}) for k in dict.fromkeys(out[node])]
            done[node] = (frames[node] + max((g[0] for g in got), default=0), 1 + max((g[1] for g in got), default=0))
        return done[node]

    for k in frames:
        visit(k, frozenset())
    return done


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_the_recursive_walk(spark, seed):
    r = random.Random(seed)
    f = {f"n{i:02d}": r.randrange(1, 50) for i in range(30)}
    ids = list(f)
    e = list(dict.fromkeys((r.choice(ids[k : k + 10]), r.choice(ids[k : k + 10])) for k in (0, 0, 0, 10, 10, 20, 20, 20) for _ in range(5)))
    n, g = graph(spark, f, e)
    want = replay(f, e)
    got = rows(metrics.replay_peaks(n, g), "id", "peak", "down_depth")
    bad = set(rows(metrics.peaks(n, g).filter("bounded"), "id", "peak"))
    assert bad and {k: tuple(got[k]) for k in bad} == {k: replay_of(f, e, bad)[k] for k in bad}
    assert all(tuple(got[k]) == want[k] for k in f if k not in bad)


def replay_of(f, e, bad):
    """The walk begins at nodes that reach a cycle only; the others' values are exact anyway."""
    rest = {k: v for k, v in replay(f, e).items() if k not in bad}
    out = {k: [b for a, b in e if a == k] for k in f}
    done = dict(rest)

    def visit(node, path):
        if node in path:
            return f[node], 1
        if node not in done:
            got = [visit(k, path | {node}) for k in dict.fromkeys(out[node])]
            done[node] = (f[node] + max((g[0] for g in got), default=0), 1 + max((g[1] for g in got), default=0))
        return done[node]

    for k in f:
        if k in bad:
            visit(k, frozenset())
    return done


def test_components_by_colouring_agree_with_doubling(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)]
    pairs = [(f"p{i}", f"p{i ^ 1}") for i in range(4)] + [("r0", "p0"), ("p1", "q"), ("q", "q")]
    n, e = graph(spark, {x: 1 for x in sorted({a for ab in ring + pairs for a in ab})}, ring + pairs)
    a, b = (rows(metrics.components(n, e, limit=k), "id", "scc", "size", "recursive") for k in (10_000, 0))
    assert a == b and a["r3"] == ("r0", 5, True) and a["q"][2]


def test_estimates_stay_small_over_many_rounds(spark):
    """A round joins what the last one gave: its estimate must not grow with every round, or planning takes all the time."""
    layers = 14
    f = {f"{x}{i:02d}": 10 + (x == "b") for i in range(layers) for x in "ab"}
    e = [(f"{x}{i:02d}", f"{y}{i + 1:02d}") for i in range(layers - 1) for x in "ab" for y in "ab"]
    n, g = graph(spark, f, e)
    best = metrics.relax_down(n.select("id", F.col("frame").alias("w"), F.lit(1).cast("long").alias("len"), F.lit(False).alias("rec")), g)
    assert rows(best, "id", "peak", "down")["a00"] == (10 + 11 * (layers - 1), layers)
    assert best._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**40


def test_peeling_stops_where_rounds_take_little(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("c15", "c14")]
    n, e = graph(spark, dict.fromkeys(sorted({x for ab in chain for x in ab}), 1), chain)
    assert metrics.trim(e, least=0.9).count() == 29 and metrics.trim(e).count() == 2
    assert rows(metrics.components(n, e).filter("recursive"), "id", "scc") == {"c14": "c14", "c15": "c14"}


def test_closure_removes_its_rounds_and_makes_none_for_nothing(spark, monkeypatch):
    r = random.Random(5)
    e = [(f"n{r.randrange(25):02d}", f"n{r.randrange(25):02d}") for _ in range(30)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(17)] + [("x", "x")]
    want, out = set(e), {}
    for a, b in e:
        out.setdefault(a, set()).add(b)
    while more := {(a, c) for a, b in want for c in out.get(b, ())} - want:
        want |= more
    made, kept = [], metrics.durable
    monkeypatch.setattr(metrics, "durable", lambda df: made.append(kept(df)) or made[-1])
    _, g = graph(spark, {}, e)
    got = [tuple(x) for x in metrics.closure_doubling(g).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(made) == 6 and sum(x in fixpoint._PATHS for x in made) == 1  # 17 edges: 1, 2, 4, 8, 16, 32


def test_capped_paths_are_the_first_of_the_walk(spark, monkeypatch):
    """Starts that reach no cycle are merged from lists, without a search and a group of their own."""
    r = random.Random(3)
    f = {f"n{i:02d}": r.randrange(1, 50) for i in range(24)}
    e = list(dict.fromkeys((f"n{a:02d}", f"n{a + r.randrange(1, 4):02d}") for a in range(20) for _ in range(3))) + [("z0", "z1"), ("z1", "z0"), ("z0", "n20")]
    f |= {"z0": 5, "z1": 6}
    n, g = graph(spark, f, e)
    walked, search = [], explore.closure_seeded
    monkeypatch.setattr(explore, "closure_seeded", lambda e, s: walked.extend(x[0] for x in s.collect()) or search(e, s))

    def first(path, found):
        kids = [b for a, b in e if a == path[-1]]
        for k in kids:
            if len(found) >= 8:
                return
            if k in path:
                found.append([*path, k])
            else:
                first([*path, k], found)
        if not kids:
            found.append(path)

    got = {}
    for x in explore.paths_capped(n, g, n, limit=2).orderBy("start", "rank").collect():
        got.setdefault(x.start, []).append((x.nodes, x.total))
    for start in f:
        found = []
        first([start], found)
        ways = sorted(((p, sum(f[x] for x in p)) for p in found), key=lambda p: -p[1])[:2]
        assert got[start] == ways
    assert sorted(walked) == ["z0", "z1"]


def test_depth_with_many_leaves(spark):
    f = {"F": 100, "H1": 9000, "H2": 9000, "H3": 9000, "A": 10, "B": 10, "C": 10, "D": 10}
    n, e = graph(spark, f, [("F", "H1"), ("F", "H2"), ("F", "H3"), ("F", "A"), ("A", "B"), ("B", "C"), ("C", "D")])
    assert rows(metrics.peaks(n, e), "id", "peak", "down_depth")["F"] == (9100, 5)
    chain = rows(explore.longest_chain(n, e, n.filter("id = 'F'")), "start", "nodes")["F"]
    assert chain == ["F", "A", "B", "C", "D"]
    best = explore.paths_from(n, e, n.filter("id = 'F'"), limit=2)
    both = explore.inject_longest(best, explore.longest_chain(n, e, n.filter("id = 'F'")))
    assert rows(both.filter("rank = 1"), "start", "nodes")["F"] == chain
    capped = explore.paths_from(n, e, n.filter("id = 'F'"), max_depth=2).collect()
    assert max(len(r.nodes) for r in capped) == 3 and any(r.by_depth for r in capped)


def test_conditional_removal(spark):
    n, e = graph(spark, dict.fromkeys("ABCDEFM", 1), [("C", "A"), ("A", "B"), ("D", "A"), ("E", "M"), ("M", "F"), ("F", "B")])
    n = n.withColumn("name", n.id).withColumn("file", n.id)
    left = lambda rs: {(r.src, r.dst) for r in rules.prune_edges(e, rs, n)[0].collect()}
    assert ("F", "B") not in left([{"callee": "B", "when": {"callerContains": "E"}}])
    assert ("A", "B") in left([{"callee": "B", "when": {"callerContains": "E"}}])
    assert ("A", "B") not in left([{"callee": "B", "when": {"callerContains": "A"}}])  # reflexive
    assert left([{"callee": "B", "when": {"not": {"fromRoot": "C"}}}]) >= {("A", "B")}
    kept, unused, _ = rules.prune_edges(e, [{"callee": "zz"}, {"caller": "A"}], n)
    assert kept.count() == 6 and [r.callee for r in unused.collect()] == ["zz"]


def test_conditional_roots(spark):
    n, e = graph(spark, {"r1": 1, "r2": 1, "d": 10, "x": 100, "y": 1000}, [("r1", "d"), ("r2", "d"), ("d", "x"), ("d", "y")])
    from pyspark.sql import functions as F

    e = e.withColumn("cond_id", F.when(e.dst == "y", 0))
    got = {(r.root, r.id): r.peak for r in metrics.conditional_per_root(n, e, metrics.find_roots(n, e), [{"callerContains": "r2"}]).collect()}
    assert got["r1", "d"] == 111 and got["r2", "d"] == 1011 and ("r1", "y") not in got


def test_cycle_listing(spark):
    ring = [(f"{i:03d}", f"{(i + 1) % 20:03d}") for i in range(20)]
    n, e = graph(spark, {a: 1 for a, _ in ring} | {"x": 1}, [*ring, ("x", "000")])
    got = rows(explore.shortest_cycles(e, n.filter("id in ('003', 'x')")), "id", "hops", "nodes")
    assert list(got) == ["003"] and got["003"][0] == 20 and len(got["003"][1]) == 21
    clique = [(a, b) for a in "abcdef" for b in "abcdef" if a != b]
    n, e = graph(spark, dict.fromkeys("abcdef", 1), clique)
    assert rows(explore.shortest_cycles(e, n), "id", "hops") == dict.fromkeys("abcdef", 2)
    listed, cut = explore.cycles(e, n.filter("id = 'a'"), limit=3, budget=50)
    assert [r.nodes for r in listed.orderBy("rank").collect()] == [["a", x, "a"] for x in "bcd"] and rows(cut, "id", "reason") == {"a": "budget"}
    n, e = graph(spark, dict.fromkeys([f"{i:03d}" for i in range(100)] + ["lone"], 1), [(f"{i:03d}", f"{(i + 1) % 100:03d}") for i in range(100)])
    listed, cut = explore.cycles(e, n.filter("id in ('000', 'lone')"))
    assert [(r.id, r.hops, len(r.nodes)) for r in listed.collect()] == [("000", 100, 101)] and rows(cut, "id", "reason") == {"000": "depth"}


def test_neighbourhood_and_corridor(spark):
    n, e = graph(spark, dict.fromkeys("abcdef", 1), [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "b"), ("c", "b")])
    nodes, edges, cut = explore.neighbourhood(e, "b", 1, 1)
    assert rows(nodes, "id", "layer") == {"b": 0, "c": 1, "a": -1, "e": -1} and not cut
    assert {(r.src, r.dst): r.recursive for r in edges.collect()}[("b", "c")]
    keep, lit = explore.corridor(e, "a", "d")
    assert {r.id for r in keep.collect()} == set("abcd") and ("c", "b") not in {(r.src, r.dst) for r in lit.collect()}
    assert explore.drill_down(None) == (0, 5) and explore.drill_down(40) == (0, 20)


def test_removing_an_edge_never_raises_a_peak(spark):
    r = random.Random(3)
    edges = sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((r.randrange(20), r.randrange(20)) for _ in range(40)) if a < b})
    n, e = graph(spark, {f"n{i:02d}": r.randrange(1, 99) for i in range(20)}, edges)
    before = rows(metrics.peaks(n, e), "id", "peak")
    after = rows(metrics.peaks(n, e.filter(f"not (src = '{edges[3][0]}' and dst = '{edges[3][1]}')")), "id", "peak")
    assert all(after[k] <= before[k] for k in before)


def test_connected_components(spark):
    pairs = [(1, 2), (2, 3), (10, 11), (7, 3), (20, 20)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got[7] == 1 and got[11] == 10 and got[139] == 100 and got[260] == 200 and 20 not in got


def test_components_of_long_rings_take_no_round_for_each_step(spark, monkeypatch):
    """Rings too long to be closed were coloured before, a table for each step along them; parts are walked now."""
    rng, made = random.Random(9), []
    edges = {(b + i, b + (i + 1) % 60) for b in range(0, 480, 60) for i in range(60)} | {(rng.randrange(480), 500 + rng.randrange(100)) for _ in range(300)} | {(7, 7), (501, 501), (70, 10)}
    edges |= {(500 + rng.randrange(100), 500 + rng.randrange(100)) for _ in range(110)}
    ends = {}
    for s, d in edges:
        ends.setdefault(s, []).append(d)

    def below(x):
        seen, todo = set(), [x]
        while todo:
            for y in ends.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {x: below(x) for x in range(600)}
    want = {x: (min([x, *(y for y in far[x] if x in far[y])]), x in far[x]) for x in range(600)}
    for name in ("durable", "counted"):
        monkeypatch.setattr(metrics, name, lambda df, f=getattr(metrics, name): made.append(1) or f(df))
    n, e = spark.range(600), spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {x.id: (x.scc, x.recursive) for x in metrics.components(n, e).collect()} == want
    assert len(made) <= 4
    monkeypatch.setattr(metrics, "WALK_EDGES", 100, raising=False)  # part by part
    made.clear()
    rings = e.filter("src < 480 and dst < 480 and src div 60 = dst div 60")
    got = {x.id: x.scc for x in metrics.components(n, rings).collect()}
    assert got == {x: x // 60 * 60 if x < 480 else x for x in range(600)} and len(made) <= 8
