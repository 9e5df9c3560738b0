"""Durable cuts of lineage for driver-controlled loops over edge tables.

Every loop cuts lineage with a table in the shared folder (it survives lost executors), moves only a
delta where the semantics allow it, and stops on a count or fails.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

ROUNDS = 100
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: the table is written once to the session's shared checkpoint folder and read back.

    What is read has the size of its files. A checkpoint would keep the estimate of its plan, which
    every join multiplies: a loop doubles the digits of that number each round, until planning a
    round takes longer than running it. Types and names that files do not hold are checkpointed.
    Only where spark.checkpoint.dir is unset and all runs on one machine a temporary folder is made.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(folder)
    if not df.columns or len({c.lower() for c in df.columns}) < len(df.columns) or any(x in df.schema.simpleString() for x in ("void", "interval", "variant")):
        return df.checkpoint(eager=True)
    path = f"{sc.getCheckpointDir()}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # the exchanges behind the table are read no more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def free(*dfs: DataFrame) -> None:
    """Remove the files of durable tables that nothing reads any more; others stay as they are."""
    for df in dfs:
        path = _PATHS.pop(df, None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A durable table and its number of rows, counted in the pass that writes it."""
    seen = Observation()
    d = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return d, seen.get["n"]


class Pile:
    """Rows that a loop gathers round by round, held in few tables: as soon as WIDE parts of one size
    are there they are written as one, so a plan over all rounds stays short and a row is written
    a logarithmic number of times."""

    WIDE = 6

    def __init__(self, first: DataFrame):
        self.parts = [(0, first)]
        self.slices = max(1, first.rdd.getNumPartitions())

    def add(self, part: DataFrame) -> None:
        self.parts.append((0, part))
        while len(self.parts) >= self.WIDE and len({size for size, _ in self.parts[-self.WIDE :]}) == 1:
            size, last = self.parts[-1][0], [p for _, p in self.parts[-self.WIDE :]]
            self.parts[-self.WIDE :] = [(size + 1, durable(_union(last).coalesce(self.slices)))]

    @property
    def all(self) -> DataFrame:
        return _union([p for _, p in self.parts])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = durable, free: Callable[[DataFrame], None] = lambda _: None) -> DataFrame:
    """(v, component): the smallest vertex reachable from each vertex of edges(a, b).

    Alternating large-star and small-star steps (Kiveris et al., 2014): O(log n) rounds, each of
    them a pre-aggregated minimum per vertex and an equi-join, so no neighbourhood is ever
    gathered in one task. Loops and null ends are left out. `cut` makes a round's table durable,
    `free` removes one that is read no more. Fails rather than return components that have not
    settled.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(ROUNDS):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u > v always holds here; each u hands its smallest v to itself and its other v
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        new = cut(large.join(small_low, "u").select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u <> v").distinct())
        free(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    roots = e.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct()
    out = cut(e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("v"), "component").union(roots))
    free(e)
    return out
