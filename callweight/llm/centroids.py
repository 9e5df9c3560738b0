"""Centroid clustering of integer vectors, with annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid just below and to the one just
above its own norm bounds its nearest distance by u, and ``| |c| - |x| | <= |c - x|``, so only
centroids whose norm lies within u of the vector's can be as near. Binary search finds that
annulus; its centroids are compared in exact integers, ties at its edge included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Scratch

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
PAIRS = 1 << 16  # (vector, centroid) pairs compared at once
MAX_VALUES = 1 << 20  # clusters * components, which are on the driver and in every task
INT64_SAFE = 1 << 27  # squared distances of up to 64 such components fit into 64 bits
WIDEST = float(1 << 52)  # components beyond are refused


def exact(x: np.ndarray) -> np.ndarray:
    """The same integers, as Python's own where 64 bits might not hold a squared distance."""
    safe = INT64_SAFE * (DIM / max(DIM, x.shape[1])) ** 0.5 if x.ndim == 2 else INT64_SAFE
    return x.astype(object) if x.size and max(int(x.max()), -int(x.min())) > safe else x


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


class Annuli:
    """Centroids in order of their norm."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, dtype=np.int64)
        norm = _norms(c)
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.values = exact(c)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of each vector's annulus in the order of norms."""
        norm, last = _norms(x), len(self.order) - 1
        at = np.searchsorted(self.norm, norm)
        near = [_squares(x, self.values[self.order[np.clip(p, 0, last)]]) for p in (at - 1, at)]
        u = np.sqrt(np.minimum(*near).astype(np.float64))
        u = u + 1e-9 * (norm + u) + 1e-6  # wider than any rounding of norms and roots
        return np.searchsorted(self.norm, norm - u, "left"), np.searchsorted(self.norm, norm + u, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, ties to the smaller number,
        and how many pairs were compared."""
        x = exact(x) if self.values.dtype != object else x.astype(object)
        lo, hi = self.bounds(x)
        ahead = np.concatenate([[0], np.cumsum(hi - lo)])
        number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(ahead, ahead[a] + PAIRS, "right")) - 1)
            width = (hi - lo)[a:b]
            starts = ahead[a:b] - ahead[a]
            row = np.repeat(np.arange(a, b), width)
            c = self.order[np.arange(len(row)) - np.repeat(starts, width) + lo[row]]
            d = _squares(x[row], self.values[c])
            best = np.minimum.reduceat(d, starts)
            number[a:b] = np.minimum.reduceat(np.where(d == np.repeat(best, width), c, len(self.order)), starts)
            distance[a:b] = best  # refuses what 64 bits do not hold
            a = b
        return number, distance, int(ahead[-1])


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows whose vector has `dim` components, all finite: floor(scale * x)."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).filter((F.size("x") == dim) & ~F.coalesce(bad, F.lit(True)))
    whole = lambda x: F.when(F.abs(x * scale) < WIDEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large to cluster")))
    return kept.select("vec_id", F.transform("x", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id, in ascending order; then by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Centroids after one round: floor of the mean of their vectors, empty ones as they were."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annuli(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for b in it:
            x = _matrix(b, dim)
            number, _, _ = near.nearest(x)
            n += np.bincount(number, minlength=len(n))
            o = np.argsort(number, kind="stable")
            held, at = np.unique(number[o], return_index=True)
            if len(held):
                total[held] += np.add.reduceat(x[o], at, axis=0)
        held = np.flatnonzero(n)
        flat = pa.array(total[held].reshape(-1), pa.int64())
        s = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dim, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), s], ["cluster", "n", "s"])

    part = vectors.select("v").mapInArrow(sums, "cluster int, n long, s array<long>")
    wide = part.select("cluster", "n", F.posexplode("s").alias("p", "s")).groupBy("cluster", "p").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(19,0)")).alias("s"))
    out = [list(c) for c in centroids]
    for r in wide.collect():
        out[r.cluster][r.p] = int(r.s) // r.n
    return out


def _digest(c: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()


def cluster_vectors(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vec: str = "embedding", dim: int = DIM, scale: int = SCALE, seed: int = 3) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length or hold null or non-finite components are left out;
    components beyond 2**52 / scale, and distances that 64 bits do not hold, are refused. Rows that
    repeat an id are vectors of their own; a null id comes last among the first centroids. With
    fewer than k vectors there are as many clusters; an empty table gives no rows. Extra columns
    are ignored. Results do not depend on how rows are dealt: all sums are of whole numbers.
    Each round sends k * dim sums a task into an aggregate and k * dim numbers to the driver; that
    product is at most MAX_VALUES. Rounds that change nothing end the loop, as all later ones would.
    """
    if k * dim > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} centroid components")
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = Scratch(df.sparkSession, "vectors").keep(integer_vectors(df, id_col, vec, dim, scale))
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return df.sparkSession.createDataFrame([], out)
    for _ in range(rounds):
        new = moved(vectors, centroids, dim)
        if new == centroids:
            break
        centroids = new

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annuli(centroids)
        for b in it:
            number, distance, _ = near.nearest(_matrix(b, dim))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    placed = vectors.mapInArrow(assign, "vec_id long, cluster int, distance long")
    spread = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    rows = [(j, spread.get(j, 0), sum(spread.values()), _digest(c)) for j, c in enumerate(centroids)]
    table = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
