"""Stale units, bursts of changes, and views rebuilt after each burst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FORMAT = "1"  # of cached facts; a new scanner format makes every cached unit stale


def unit_keys(units: DataFrame, version: str = FORMAT) -> DataFrame:
    """units(path, mtime, size, args) with unit_key, a digest of all that a scan depends on."""
    parts = [F.lit(version), F.col("path"), F.col("mtime").cast("string"), F.col("size").cast("string"), F.array_join("args", "\u0001")]
    return units.withColumn("unit_key", F.sha1(F.concat_ws("\u0000", *parts)))


def stale_units(units: DataFrame, cached: DataFrame, includes: DataFrame, files: DataFrame) -> DataFrame:
    """units whose key is not in cached(unit_key, cached_at), or whose includes(unit_key, include)
    are missing from files(path, mtime) or newer than the cached scan."""
    inc = includes.join(files.select(F.col("path").alias("include"), "mtime"), "include", "left").groupBy("unit_key").agg(F.max("mtime").alias("newest"), F.max(F.col("mtime").isNull().cast("int")).alias("gone"))
    ok = cached.join(inc, "unit_key", "left").filter(F.coalesce(F.col("newest") <= F.col("cached_at"), F.lit(True)) & (F.coalesce("gone", F.lit(0)) == 0))
    return units.join(ok.select("unit_key"), "unit_key", "left_anti")


def listing_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): created, changed and deleted files between two listings(path, mtime, size);
    file streams do not see deletions."""
    j = old.toDF("path", "m0", "s0").join(new.toDF("path", "m1", "s1"), "path", "full")
    change = F.when(F.col("m0").isNull(), "created").when(F.col("m1").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "changed")
    return j.select("path", change.alias("change")).filter("change is not null")


def change_stream(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """A stream of (kind, path, modified) of new and rewritten files, from {kind: (folder, glob)};
    contents are not read. Deletions are for listing_diff."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    one = lambda kind, folder, glob: spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select(F.lit(kind).alias("kind"), "path", F.col("modificationTime").alias("modified"))
    out = None
    for kind, (folder, glob) in sources.items():
        s = one(kind, folder, glob)
        out = s if out is None else out.union(s)
    return out


def tracked(changes: DataFrame, units: DataFrame, rule_files: list[str]) -> DataFrame:
    """Changes(path) that ask for a new run: tracked units, frame files, build databases, rules."""
    known = units.select("path").distinct().withColumn("__t", F.lit(True))
    d = changes.join(known, "path", "left")
    return d.filter(F.col("__t").isNotNull() | F.col("path").endswith(".su") | F.col("path").endswith("compile_commands.json") | F.col("path").isin(rule_files)).drop("__t")


def bursts(events: DataFrame, gap_seconds: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """(key, start, end, n): changes no more than the gap apart are one burst; a batch form of the
    trailing-edge debounce."""
    o = Window.partitionBy(key).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(o) > int(gap_seconds * 1_000_000)).cast("int"), F.lit(1))
    d = events.select(key, ts, new.alias("new")).withColumn("burst", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "burst").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).drop("burst")


def stream_bursts(events: DataFrame, gap: str = "800 milliseconds", late: str = "10 seconds", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same on a stream: a burst is emitted when its session window closes."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def on_change(changes: DataFrame, rebuild: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run `rebuild` for each micro-batch that holds changes. Micro-batches are serial, so at most
    one run is active and what arrives meanwhile makes one more."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rebuild(batch)

    w = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def cancellable(spark: SparkSession, tag: str, run: Callable[[], DataFrame]):
    """Run with a tag that `cancel` can interrupt from any thread; the interrupted result is discarded."""
    spark.sparkContext.addJobTag(tag)
    try:
        return run()
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def settings_changed(old: dict, new: dict, content_keys: set[str]) -> bool:
    """Whether a change of settings asks for a new run; display-only keys do not."""
    return any(old.get(k) != new.get(k) for k in content_keys)
