"""Centroid clustering against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweight.llm import centroids as C

VECS = "vec_id long, embedding array<float>"


def brute(rows, k=8, rounds=10, dim=64, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        c = [[sum(col) // mine.count(j) for col in zip(*(v for (_, v), m in zip(kept, mine, strict=True) if m == j), strict=True)] if j in mine else c[j] for j in range(len(c))]
    last = [near(v) for _, v in kept]
    total = sum(d for d, _ in last)
    return sorted([(str(i), j, d, sum(x for x, y in last if y == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)])


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_equal_to_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(i % 5 - 2, 1) * r.choice([0.1, 1, 3]) for _ in range(64)]) for i in range(250)]
    rows += [(i, rows[i][1]) for i in range(0, 60, 3)] + [(300 + i, rows[7][1]) for i in range(80)]  # repeated rows, copies under other ids
    d = spark.createDataFrame(rows, VECS)
    want = brute(rows)
    assert found(C.cluster_vectors(d)) == want and found(C.cluster_vectors(d.repartition(9))) == want


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] * 63 + [0.0]) for i in range(60)]  # three distinct vectors for eight centroids
    got = found(C.cluster_vectors(spark.createDataFrame(rows, VECS)))
    assert got == brute(rows) and len({g[1] for g in got}) == 3
    a, b = [0.0] * 64, [2 / 1024] + [0.0] * 63
    rows = [(0, a), (1, b), (2, [1 / 1024] + [0.0] * 63)] * 2
    for k in (1, 2, 3):
        assert found(C.cluster_vectors(spark.createDataFrame(rows, VECS), k=k, rounds=0)) == brute(rows, k=k, rounds=0)


def test_annulus_keeps_every_nearest_centroid():
    r = np.random.default_rng(5)
    for scale in (1, 3, 1000, 1 << 26, 1 << 40):
        c = r.integers(-scale, scale + 1, (40, 8))
        c[5], c[6] = c[4], -c[4]  # equal centroids, equal norms
        x = np.concatenate([r.integers(-scale, scale + 1, (300, 8)), c, (c[:20] + c[20:]) // 2])
        near = C.Annuli(c.tolist())
        if scale < 1 << 30:
            number, distance, pairs = near.nearest(x)
            d = ((x[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
            assert number.tolist() == [int(np.argmin(row)) for row in d] and distance.tolist() == [min(row) for row in d]
            assert pairs <= d.size
        else:
            with pytest.raises(OverflowError):
                near.nearest(x)
    spread = np.arange(1, 101)[:, None] * np.ones((1, 8), np.int64) * 50
    _, _, pairs = C.Annuli(spread.tolist()).nearest(spread + 3)
    assert pairs <= 4 * len(spread)


def test_wide_components_are_exact(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1, 1]) * 2.0**19 * r.random() if j < 3 else r.random() for j in range(64)]) for i in range(50)]
    assert found(C.cluster_vectors(spark.createDataFrame(rows, VECS))) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        C.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], VECS)).collect()
    with pytest.raises(ValueError):
        C.cluster_vectors(spark.createDataFrame(rows, VECS), k=1 << 20)


def test_odd_rows(spark):
    good = [random.Random(7).random() for _ in range(64)]
    rows = [(1, None), (2, []), (3, good[:63]), (4, [*good, 1.0]), (5, [None, *good[1:]]), (6, [float("nan"), *good[1:]]), (7, [float("inf"), *good[1:]]), (8, [0.0] * 64), (None, good), (None, good), (9, good), (9, good), (9, good[::-1])]
    d = spark.createDataFrame(rows, VECS)
    for c in ("v", "x", "cluster", "distance", "inertia", "h"):
        d = d.withColumn(c, F.lit("clash"))
    got = found(C.cluster_vectors(d))
    assert got == brute(rows) and len(got) == 6
    none = C.cluster_vectors(d.limit(0))
    assert none.count() == 0 and none.columns == C.cluster_vectors(d).columns
