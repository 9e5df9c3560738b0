"""Limited paths against enumeration."""

import random
import time

from callweight.operators import explore


def brute(frame, edges, start, max_depth):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    done = []

    def walk(path):
        if len(path) - 1 == max_depth:
            return done.append((path, False, True))
        if path[-1] not in out:
            return done.append((path, False, False))
        for b in out[path[-1]]:
            if b in path:
                done.append(([*path, b], True, False))
            else:
                walk([*path, b])

    walk([start])
    if any(len(p) > 1 for p, _, _ in done):
        done = [d for d in done if len(d[0]) > 1]
    return sorted(((-sum(frame[x] for x in p), p, c, deep) for p, c, deep in done))


def graph(spark, frame, edges):
    return spark.createDataFrame(sorted(frame.items()), "id long, frame long"), spark.createDataFrame(sorted(edges), "src long, dst long")


def found(df, key):
    got = {}
    for r in df.collect():
        got.setdefault(r[key], []).append((r["rank"], -r.total, list(r.nodes), r.by_cycle, r.by_depth))
    return {k: [x[1:] for x in sorted(v)] for k, v in got.items()}


def test_limited_paths_equal_enumeration(spark):
    r = random.Random(21)
    for n, calls, up, max_depth in ((40, 2, False, 32), (40, 3, False, 4), (18, 2, True, 7), (12, 1, True, 32)):
        frame = {i: r.randrange(1, 5) for i in range(n)}  # few sizes, so many ties
        edges = {(i, r.randrange(0 if up else i + 1, n)) for i in range(n - (not up)) for _ in range(calls) if r.random() < 0.9}
        d, e = graph(spark, frame, edges)
        got = found(explore.paths_from(d, e, d, max_depth, limit=3), "start")
        want = {i: brute(frame, edges, i, max_depth)[:3] for i in frame}
        assert got == want, (n, calls, up, max_depth)
        back = {i: [(t, p[::-1], c, x) for t, p, c, x in brute(frame, {(b, a) for a, b in edges}, i, max_depth) if len(p) > 1 and p != [i, i]][:3] for i in frame}
        assert found(explore.paths_to(d, e, d, max_depth, limit=3), "end") == {k: v for k, v in back.items() if v}


def test_a_ladder_of_diamonds(spark):
    edges, frame = set(), {0: 1}
    for k in range(40):
        a = 3 * k
        edges |= {(a, a + 1), (a, a + 2), (a + 1, a + 3), (a + 2, a + 3)}
        frame |= {a + 1: 10, a + 2: 11, a + 3: 1}
    d, e = graph(spark, frame, edges)
    t = time.time()
    got = found(explore.paths_from(d, e, d.filter("id = 0"), max_depth=100, limit=5), "start")[0]
    assert [-t for t, *_ in got] == [40 * 12 + 1] + [40 * 12] * 4 and len({tuple(p) for _, p, *_ in got}) == 5
    assert got[1][1][-3:] != got[0][1][-3:] or got[1][1] < got[0][1]
    assert time.time() - t < 200


def test_pinned_nodes_end_paths(spark):
    frame = {i: 1 for i in range(6)}
    d, e = graph(spark, frame, {(0, 1), (1, 2), (2, 3), (4, 3)})
    pins = d.filter("id = 1").select("id")
    got = found(explore.paths_to(d, e, d.filter("id = 3"), limit=5, pinned=pins), "end")
    assert [p for _, p, *_ in got[3]] == [[1, 2, 3], [4, 3]]
    got = explore.paths_to(d, e, d.filter("id = 1"), pinned=pins).collect()
    assert [list(r.nodes) for r in got] == [[0, 1]]
