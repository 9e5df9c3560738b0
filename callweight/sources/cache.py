"""Unit facts kept between runs: units that have not changed are read back, the others scanned."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..fixpoint import durable
from ..schema import FACTS
from ..streaming.incremental import stale_units, unit_keys
from . import readers, sinks

CACHED = FACTS + ", unit_key string, cached_at double"


def file_states(paths: DataFrame) -> DataFrame:
    """(path, mtime, size) of those paths(path) that are files, looked up by the tasks: the folders
    of sources are mounted wherever tasks run. mtime is in seconds."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b.path:
                try:
                    s = os.stat(p)
                except (OSError, ValueError):
                    continue
                rows.append((p, s.st_mtime, s.st_size))
            yield pd.DataFrame(rows, columns=["path", "mtime", "size"])

    return paths.select("path").filter("path is not null").distinct().mapInPandas(look, "path string, mtime double, size long")


def _there(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and any(s.isDirectory() for s in fs.listStatus(at))


def cached_facts(units: DataFrame, facts_path: str, folder: str | None) -> tuple[DataFrame, dict[str, int]]:
    """(facts, counts) of units(path, args, pos): a unit's facts come from the cache where its file,
    arguments and format are those of the scan and none of its includes is newer or gone, else from
    the scan at facts_path, which then replaces the unit's entry. Without a folder all are scanned.
    unit_ord is the place in the build database, so it does not matter where a unit comes from.

    counts: units, from_cache, scanned, without_facts, and unreadable lines of the scan.
    """
    spark = units.sparkSession
    place = units.select(F.col("path").alias("unit"), F.col("pos").alias("unit_ord"))
    lines, stale, fresh = Observation(), units, None
    if folder:
        keyed = durable(unit_keys(units.join(file_states(units), "path")))
        stale = keyed
        if _there(spark, folder):
            cached = spark.read.schema(CACHED).parquet(folder)
            inc = cached.select("unit_key", F.explode("includes").alias("include"))
            stale = durable(stale_units(keyed, cached.select("unit_key", "cached_at"), inc, file_states(inc.select(F.col("include").alias("path")))))
            fresh = durable(cached.join(keyed.join(stale, "unit_key", "left_anti").select("unit_key"), "unit_key", "left_semi").drop("unit_key", "cached_at"))
    scan = readers.all_facts(spark, facts_path).observe(lines, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("unreadable"))
    scanned = durable(scan.filter("_corrupt_record is null").drop("_corrupt_record", "unit_ord").dropDuplicates(["unit"]).join(stale.select(F.col("path").alias("unit")), "unit", "left_semi"))
    if folder:
        new = scanned.join(stale.select(F.col("path").alias("unit"), "unit_key"), "unit").withColumn("cached_at", F.lit(time.time()))
        sinks.write_unit_facts(new, folder)
    columns = scanned.columns
    facts = scanned if fresh is None else scanned.union(fresh.select(columns))
    n_units, n_scanned, n_fresh = units.count(), scanned.count(), 0 if fresh is None else fresh.count()
    counts = {"units": n_units, "fromCache": n_fresh, "scanned": n_scanned, "withoutFacts": n_units - n_scanned - n_fresh, "unreadableLines": lines.get["unreadable"]}
    return facts.join(place, "unit"), counts
