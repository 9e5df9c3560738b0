"""Metrics after an edit against full runs."""

import random

from callweight.operators import delta, metrics

M = ["id", "peak", "bounded", "down_depth", "scc", "recursive"]


def frame(spark, rows, schema):
    return spark.createDataFrame(sorted(rows), schema)


def build(spark, nodes, edges):
    return frame(spark, nodes.items(), "id long, frame long"), frame(spark, edges, "src long, dst long")


def found(s):
    return sorted(map(tuple, s.metrics.select(*M).collect()))


def test_random_edits(spark):
    r = random.Random(11)
    nodes = {i: r.randrange(16, 400) for i in range(120)}
    edges = {(i, j) for i in nodes for j in (r.randrange(120), min(119, i + r.randrange(1, 9))) if r.random() < 0.45}
    s = delta.snapshot(*build(spark, nodes, edges))
    for k in range(1):
        for _ in range(100):
            what = r.randrange(6)
            if what < 2:
                edges.add((r.choice(list(nodes)), r.choice(list(nodes))))
            elif what < 4 and edges:
                edges.discard(r.choice(sorted(edges)))
            elif what == 4:
                nodes[r.choice([*nodes, 1000 + len(nodes)])] = r.randrange(16, 400)
            else:
                x = r.choice(list(nodes))
                nodes.pop(x)
                edges = {e for e in edges if x not in e}
        n, e = build(spark, nodes, edges)
        s, report = delta.edited(s, delta.edit_between(s, n, e))
        assert found(s) == found(delta.snapshot(n, e)), k
        assert sorted(map(tuple, s.edges.collect())) == sorted(edges) and report.touched >= report.changed


def test_only_what_can_change_is_looked_at(spark):
    # a hundred callers above a heavy and a light leaf; the light one's frame does not show above
    nodes = {i: 10 for i in range(200)} | {200: 5000, 201: 16}
    edges = {(i, i + 100) for i in range(100)} | {(i + 100, x) for i in range(100) for x in (200, 201)}
    s = delta.snapshot(*build(spark, nodes, edges))
    nodes[201] = 32
    s, report = delta.edited(s, delta.edit_between(s, *build(spark, nodes, edges)))
    ancestors = 200
    assert report.touched == 101 < ancestors and report.changed == 1 and report.rounds == 2 and report.regrouped == 0
    same, report = delta.edited(s, delta.edit_between(s, *build(spark, nodes, edges)))
    assert report == (0, 0, 0, 0) and found(same) == found(s)


def test_components_split_and_join(spark):
    nodes = {i: i for i in range(1, 9)}
    ring = {(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4), (6, 7), (7, 8)}
    s = delta.snapshot(*build(spark, nodes, ring))
    steps = [(ring | {(8, 1), (8, 8)}) - {(5, 6)}, ring - {(1, 2), (3, 1)} | {(8, 8)}]
    for edges in steps:
        s, _ = delta.edited(s, delta.edit_between(s, *build(spark, nodes, edges)))
        assert found(s) == found(delta.snapshot(*build(spark, nodes, edges)))


def test_versions(spark, tmp_path):
    v = delta.Versions(spark, str(tmp_path / "snapshots"))
    nodes, edges = {1: 10, 2: 20, 3: 30}, {(1, 2), (2, 3)}
    assert v.latest() is None
    first, report = v.update(*build(spark, nodes, edges))
    assert report is None and found(v.latest()) == found(first)
    (tmp_path / "snapshots" / "v999999999-dead" / "nodes").mkdir(parents=True)  # a run that died
    second, report = v.update(*build(spark, nodes, edges | {(3, 1), (1, 9)}))
    assert report.regrouped == 3 and found(v.latest()) == found(second)
    assert {r.peak for r in v.latest().metrics.collect()} == {60}


def test_components_of_all_shapes(spark):
    r = random.Random(3)
    for n, d in ((600, 10), (300, 1)):
        edges = [(i, r.randrange(n)) for i in range(n) for _ in range(d)] + [(n + i, n + (i + 1) % 7) for i in range(7)]
        e = spark.createDataFrame(edges, "src long, dst long")
        got = {x.id: (x.scc, x.size, x.recursive) for x in metrics.components(spark.range(n + 10), e).collect()}
        out = {}
        for a, b in edges:
            out.setdefault(a, set()).add(b)

        def reach(x, out=out):
            seen, todo = set(), [x]
            while todo:
                for y in out.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        far = {x: reach(x) for x in range(n + 10)}
        want = {x: {y for y in far[x] if x in far[y]} | {x} for x in far}
        assert got == {x: (min(c), len(c), x in far[x]) for x, c in want.items()}
