"""Sizing, durable cuts of lineage and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweight.fixpoint import durable as durable

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder
    set on the context. A temporary one is made only where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = None if held.isEmpty() else held.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scopes: list[list[Scratch]] = []


@contextmanager
def passing() -> Iterator[None]:
    """Remove, at the end, all tables that operators have written inside."""
    mine: list[Scratch] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for s in mine:
            s.close()


class Scratch:
    """Tables of one run in the shared folder: written once, read column by column, removed when
    told. They survive lost executors; the shuffle files behind a written table go with its job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []
        self.made = 0
        if _scopes:
            _scopes[-1].append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.made}"
        self.made += 1
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Remove these tables; nothing may read them any more."""
        for df in dfs:
            for held, path in self.held:
                if held is df:
                    remove(self.spark, path)
        self.held = [x for x in self.held if not any(x[0] is df for df in dfs)]

    def close(self) -> None:
        remove(self.spark, self.base)
        self.held = []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


ARROW_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches of long texts to a few megabytes, unless the session asks for fewer."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def parts_for(volume: float, each: float, least: int = 1) -> int:
    """Number of partitions that keeps each near `each` units of the volume."""
    return max(least, int(-(-volume // each)))


SUB_ROWS, SUB_LEAST = 1 << 18, 64


def sub_buckets(df: DataFrame) -> int:
    """Sub-buckets of a group for `numbered`: one group may hold nearly all rows, so its sub-buckets
    hold about SUB_ROWS then."""
    return parts_for(df.count(), SUB_ROWS, SUB_LEAST)


def numbered(df: DataFrame, group: list[str], order: list, *, key, parts: int, name: str, weight=None) -> DataFrame:
    """Running number (or running sum of `weight`, exclusive) inside each group without putting a
    group into one task: rows are dealt by (group, sub-bucket of `key`), sub-bucket totals are
    summed ahead, and each sub-bucket is numbered on its own."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    d = df.withColumn("__sub", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("__w", w)
    g = [*group, "__sub"]
    tot = d.groupBy(*g).agg(F.sum("__w").alias("__t"))
    ahead = Window.partitionBy(*group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*g, F.coalesce(F.sum("__t").over(ahead), F.lit(0)).alias("__ahead"))
    inner = Window.partitionBy(*g).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in g]
    d = d.alias("d").join(tot.alias("t"), on, "left").select("d.*", "t.__ahead")
    return d.withColumn(name, F.col("__ahead") + F.coalesce(F.sum("__w").over(inner), F.lit(0))).drop("__sub", "__w", "__ahead")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
