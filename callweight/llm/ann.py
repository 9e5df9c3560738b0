"""Nearest neighbours by a block matrix join over int8 tiles with quantisation error bounds.

Vectors are scaled to int8 one by one: v = s * q + e with |e| <= s / 2 in each component. For a
query u = t * p + f the true product lies within
``|u.v - t s (p.q)| <= t/2 * s |q|_1 + s/2 * |u|_1`` (Hoelder on both error terms), so a tile of integer products gives
lower and upper bounds. In a tile, a query's survivors are the candidates whose upper bound
reaches its k-th best lower bound; they are recomputed in double precision from the original
vectors, and the k best of each tile are merged by a bounded heap per query. Nothing is lost.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import durable, parts_for

QUERY_BLOCK = 1024
ROW_BLOCK = 8192
_OUT = "query_id long, vec_id long, score double"


def valid_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: id and vector not null, every
    component finite, not all zero. Works in the JVM."""
    v = F.col(vec).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int8 codes, scales)."""
    s = np.abs(x).max(axis=1) / 127.0
    s[s == 0] = 1.0
    return np.rint(x / s[:, None]).astype(np.int8), s


def products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products summed component by component, so equal vectors tie exactly."""
    acc = np.zeros(len(u))
    for d in range(u.shape[1]):
        acc += u[:, d] * v[:, d]
    return acc


def tile_best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, vec id, score) of the k best candidates of each query in this tile."""
    qc, qs = quantise(q)
    vc, vs = quantise(v)
    out = []
    v_l1 = np.abs(vc.astype(np.int32)).sum(axis=1) * vs
    # Integer products are exact in float32: |p.q| <= 127 * 127 * dim < 2**24 for dim <= 1040.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    vt = np.ascontiguousarray(vc.astype(kind).T)
    step = max(1, (1 << 21) // max(1, len(v)))
    for lo in range(0, len(q), step):
        hi = min(lo + step, len(q))
        mid = (qc[lo:hi].astype(kind) @ vt) * (qs[lo:hi, None] * vs[None, :])
        err = qs[lo:hi, None] * 0.5 * v_l1[None, :] + np.abs(q[lo:hi]).sum(axis=1)[:, None] * 0.5 * vs[None, :]
        err *= 1.0 + 1e-9
        err += 1e-300
        mid[qid[lo:hi, None] == vid[None, :]] = -np.inf
        low = mid - err
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(hi - lo, -np.inf)
        a, b = np.nonzero((mid + err >= floor[:, None]) & (mid > -np.inf))
        score = products(q[lo + a], v[b])
        o = np.lexsort((vid[b], -score, a))
        a, b, score = a[o], b[o], score[o]
        first = np.searchsorted(a, a)  # start of the query's run
        keep = np.arange(len(a)) - first < k
        out.append((qid[lo + a[keep]], vid[b[keep]], score[keep]))
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by inner product, itself left out.

    Rows that are null, zero or hold null or non-finite components take no part, neither as query
    nor as candidate; vectors of different lengths are compared only with their own length. Ties
    go to the smaller id. Rows that repeat an id are separate candidates of other queries. Empty
    tables give no rows; with fewer than k candidates all are returned. Extra columns are ignored.
    """
    v = durable(valid_vectors(rows, id_col, vec).withColumn("dim", F.size("v")))
    q = durable(valid_vectors(queries, id_col, vec).withColumn("dim", F.size("v")))
    n_blocks, q_blocks = parts_for(v.count(), ROW_BLOCK, 1), parts_for(q.count(), QUERY_BLOCK, 1)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    # Every candidate is in one row block, every query in one query block; a tile is a pair of blocks.
    left = q.withColumn("qb", block(q_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("is_q", F.lit(True))
    right = v.withColumn("rb", block(n_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("is_q", F.lit(False))
    both = left.select("qb", "rb", "dim", "is_q", "vec_id", "v").unionByName(right.select("qb", "rb", "dim", "is_q", "vec_id", "v"))

    def tile(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        is_q = t.column("is_q").combine_chunks().to_numpy(zero_copy_only=False)
        ids = t.column("vec_id").combine_chunks().to_numpy()
        x = _matrix(t.column("v").combine_chunks(), dim)
        got = tile_best(ids[is_q], x[is_q], ids[~is_q], x[~is_q], k) if is_q.any() and (~is_q).any() else []
        cat = [np.concatenate(c) if got else np.zeros(0) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    per_tile = both.groupBy("qb", "rb", "dim").applyInArrow(tile, _OUT)

    def merge(t: pa.Table) -> pa.Table:
        qid = t.column("query_id").combine_chunks().to_numpy()
        heaps: dict[int, list] = {}
        for a, b, s in zip(qid.tolist(), t.column("vec_id").to_pylist(), t.column("score").to_pylist(), strict=True):
            h = heaps.setdefault(a, [])
            if len(h) < k:
                heapq.heappush(h, (s, -b))
            else:
                heapq.heappushpop(h, (s, -b))
        rows_ = [(a, r + 1, -b, s) for a, h in heaps.items() for r, (s, b) in enumerate(sorted(h, reverse=True))]
        c = list(zip(*rows_, strict=True)) if rows_ else [[], [], [], []]
        return pa.table({"query_id": pa.array(c[0], pa.int64()), "rank": pa.array(c[1], pa.int32()), "vec_id": pa.array(c[2], pa.int64()), "score": pa.array(c[3], pa.float64())})

    merged = per_tile.withColumn("m", F.pmod(F.xxhash64("query_id"), F.lit(max(8, 4 * q_blocks))))
    return merged.groupBy("m").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest_sharing(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """`nearest` with the rows whose id is divisible by `every` as queries, against all rows."""
    return nearest(df.filter(F.col(id_col) % every == 0), df, k, id_col, vec)
