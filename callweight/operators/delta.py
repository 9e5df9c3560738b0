"""Metrics after an edit: only what an edit can change is looked at again.

A snapshot holds a build's graph with its components and the values of the condensed graph. An edit
is a set of edges added and removed, functions added, removed or given another frame. Components
can change only where an edge inside one goes, or where added edges close a way back; values can
change only above what changed, and a caller is asked again only if a callee's value did change.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixpoint import Pile, counted, durable
from .metrics import components, peaks

ROUNDS = 1_000_000


class Snapshot(NamedTuple):
    """nodes(id, frame), edges(src, dst), and metrics(id, peak, bounded, down_depth, scc, recursive)."""

    nodes: DataFrame
    edges: DataFrame
    metrics: DataFrame


class Edit(NamedTuple):
    """Edges added(src, dst) and removed(src, dst); functions set(id, frame), new ones included, and
    dropped(id) with all their edges. An edge or node in neither is as it was; removal comes first."""

    added: DataFrame
    removed: DataFrame
    set_: DataFrame
    dropped: DataFrame


class Report(NamedTuple):
    """What a run of `edited` looked at: functions whose component was found anew, functions whose
    values were computed anew, those whose values came out different, and rounds of values."""

    regrouped: int
    touched: int
    changed: int
    rounds: int


def snapshot(nodes: DataFrame, edges: DataFrame) -> Snapshot:
    """A full run. Edges at unknown functions are left out."""
    n = durable(nodes.select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("frame")))
    e = durable(_known(edges.select("src", "dst").distinct(), n))
    return Snapshot(n, e, durable(peaks(n, e)))


def _known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def edit_between(old: Snapshot, nodes: DataFrame, edges: DataFrame) -> Edit:
    """The edit that leads from a snapshot to another build."""
    n = nodes.select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("frame"))
    e = edges.select("src", "dst").distinct()
    return Edit(durable(e.subtract(old.edges)), durable(old.edges.subtract(e)), durable(n.subtract(old.nodes)), durable(old.nodes.select("id").subtract(n.select("id"))))


def _between(steps: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """(id): what some of tops(id) reaches and what reaches some of ends(id), over steps(s, d).
    Both searches go in the same rounds."""
    both = durable(steps.select(F.col("s").alias("id"), F.col("d").alias("next"), F.lit(True).alias("down")).union(steps.select("d", "s", F.lit(False))))
    new = durable(tops.select("id", F.lit(True).alias("down")).union(ends.select("id", F.lit(False))).distinct())
    seen = Pile(new)
    for _ in range(ROUNDS):
        new, n = counted(new.join(both, ["id", "down"]).select(F.col("next").alias("id"), "down").distinct().join(seen.all, ["id", "down"], "left_anti"))
        if n == 0:
            return seen.all.groupBy("id").agg(F.count("*").alias("n")).filter("n = 2").select("id")
        seen.add(new)
    raise RuntimeError(f"a search still grows after {ROUNDS} rounds")


def _closing(old: Snapshot, edges: DataFrame, added: DataFrame, comp: DataFrame) -> DataFrame:
    """(scc): old components that added edges may have joined into larger ones.

    Along old edges between components the depth below falls. So a loop over added edges u -> v
    keeps, on its old edges, to depths between the least of any u and the greatest of any v; the
    components that a v reaches and that reach a u inside that band are all there can be.
    """
    rank = old.metrics.select("scc", F.col("down_depth").alias("rank")).distinct()
    side = lambda end, s: comp.select(F.col("id").alias(end), F.col("scc").alias(s))
    new = durable(added.join(side("src", "s"), "src").join(side("dst", "d"), "dst").filter("s <> d").select("s", "d").distinct())
    band = new.join(rank.toDF("s", "rs"), "s", "left").join(rank.toDF("d", "rd"), "d", "left").agg(F.min(F.coalesce("rs", F.lit(0))), F.max(F.coalesce("rd", F.lit(1 << 30)))).first()
    if band[0] is None or band[0] > band[1]:
        return comp.select("scc").limit(0)
    inside = comp.join(rank, "scc").filter(F.col("rank").between(band[0], band[1])).select("id", "scc")
    steps = edges.join(inside.toDF("src", "s"), "src").join(inside.toDF("dst", "d"), "dst").filter("s <> d").select("s", "d").union(new).distinct()
    return _between(steps, new.select(F.col("d").alias("id")), new.select(F.col("s").alias("id"))).select(F.col("id").alias("scc"))


def edited(old: Snapshot, edit: Edit) -> tuple[Snapshot, Report]:
    """The snapshot after an edit, equal to a full run, and what it took."""
    gone = durable(edit.dropped.select("id").distinct())
    put = durable(edit.set_.select("id", F.coalesce("frame", F.lit(0)).cast("long").alias("frame")).join(gone, "id", "left_anti"))
    nodes = durable(old.nodes.join(gone, "id", "left_anti").join(put, "id", "left_anti").union(put))
    fresh = put.join(old.nodes, "id", "left_anti").select("id")
    moved = put.join(old.nodes.toDF("id", "was"), "id").filter("frame <> was").select("id")
    cut = durable(old.edges.join(edit.removed.select("src", "dst").distinct(), ["src", "dst"], "left_semi").union(old.edges.join(gone.toDF("src"), "src", "left_semi")).union(old.edges.join(gone.toDF("dst"), "dst", "left_semi").select("src", "dst")).distinct())
    kept = old.edges.join(cut, ["src", "dst"], "left_anti")
    added = durable(_known(edit.added.select("src", "dst").distinct(), nodes).join(kept, ["src", "dst"], "left_anti"))
    cut = durable(cut.join(added, ["src", "dst"], "left_anti"))  # removed and added again: nothing happened
    edges = durable(kept.union(added).distinct())

    was = old.metrics.select("id", "scc")
    comp = durable(was.join(gone, "id", "left_anti").union(fresh.select("id", F.col("id").alias("scc"))))
    inner = cut.join(was.toDF("src", "s"), "src").join(was.toDF("dst", "d"), "dst").filter("s = d").select(F.col("s").alias("scc"))
    split = inner.union(gone.join(was, "id").select("scc")).distinct()
    loops = added.union(cut).filter("src = dst").select(F.col("src").alias("id")).join(comp, "id").select("scc")
    groups = durable(split.union(_closing(old, kept, added, comp)).union(loops).union(fresh.select(F.col("id").alias("scc"))).distinct())
    loose = durable(comp.join(groups, "scc", "left_semi").select("id"))
    again = components(loose, _known(edges, loose))
    flags = old.metrics.select("id", "scc", "recursive").join(gone, "id", "left_anti").join(loose, "id", "left_anti")
    comp = durable(flags.union(again.select("id", "scc", "recursive")))

    # Values of the condensed graph: asked of what changed, then of the callers of what came out different.
    base = old.metrics.select("scc", "peak", F.col("down_depth").alias("down"), F.col("bounded").alias("rec")).distinct().join(again.select("scc").distinct(), "scc", "left_anti")
    base = durable(base.join(groups, "scc", "left_anti"))
    at = comp.select("id", "scc")
    src, dst = at.toDF("src", "s"), at.toDF("dst", "d")
    ends = durable(edges.join(src, "src").join(dst, "dst").filter("s <> d").select("s", "d").distinct())
    first = loose.union(moved).union(added.select("src")).union(cut.select(F.col("src").alias("id")))
    dirty, n = counted(first.distinct().join(at, "id").select("scc").distinct())
    own = durable(comp.join(nodes, "id").groupBy("scc").agg(F.sum("frame").alias("w"), F.count("*").alias("len"), F.max("recursive").alias("own")))
    known, rounds = None, 0
    while n:
        rounds += 1
        if rounds > ROUNDS:
            raise RuntimeError(f"values still change after {ROUNDS} rounds")
        value = base if known is None else base.join(known.select("scc"), "scc", "left_anti").union(known)
        below = ends.join(dirty.toDF("s"), "s", "left_semi").join(value.toDF("d", "p", "n", "r"), "d").groupBy(F.col("s").alias("scc")).agg(F.max("p").alias("p"), F.max("n").alias("n"), F.max("r").alias("r"))
        new = own.join(dirty, "scc", "left_semi").join(below, "scc", "left").select("scc", (F.col("w") + F.coalesce("p", F.lit(0))).cast("long").alias("peak"), (F.col("len") + F.coalesce("n", F.lit(0))).cast("int").alias("down"), (F.col("own") | F.coalesce("r", F.lit(False))).alias("rec"))
        new = durable(new)
        rose = new.join(value, ["scc", "peak", "down", "rec"], "left_anti")
        dirty, n = counted(ends.join(rose.select(F.col("scc").alias("d")), "d", "left_semi").select(F.col("s").alias("scc")).distinct())
        known = durable(new if known is None else known.join(new.select("scc"), "scc", "left_anti").union(new))
    if known is None:
        return Snapshot(nodes, edges, old.metrics), Report(0, 0, 0, 0)
    hit = durable(comp.join(known, "scc"))
    metrics = old.metrics.join(gone, "id", "left_anti").join(hit.select("id"), "id", "left_anti").union(hit.select("id", "peak", F.col("rec").alias("bounded"), F.col("down").alias("down_depth"), "scc", "recursive"))
    metrics = durable(metrics)
    before = old.metrics.select("id", "peak", "bounded", "down_depth")
    changed = hit.select("id", "peak", F.col("rec").alias("bounded"), F.col("down").alias("down_depth")).join(before, ["id", "peak", "bounded", "down_depth"], "left_anti").count()
    return Snapshot(nodes, edges, metrics), Report(loose.count(), hit.count(), changed, rounds)


class Versions:
    """Snapshots in a shared folder, one sub-folder a version. A version is there once the last of
    its tables has been written, so a run that dies leaves the one before as the latest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        there = [p.getPath().getName() for p in fs.listStatus(at)]
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/metrics/_SUCCESS"))
        return sorted(n for n in there if n[:1] == "v" and done(n))

    def latest(self) -> Snapshot | None:
        names = self._names()
        return self.read(names[-1]) if names else None

    def read(self, name: str) -> Snapshot:
        return Snapshot(*(self.spark.read.parquet(f"{self.folder}/{name}/{t}") for t in ("nodes", "edges", "metrics")))

    def write(self, s: Snapshot) -> str:
        names = self._names()
        number = int(names[-1][1:].split("-")[0]) + 1 if names else 0
        name = f"v{number:09d}-{uuid.uuid4().hex[:8]}"
        for t in ("nodes", "edges", "metrics"):
            getattr(s, t).write.parquet(f"{self.folder}/{name}/{t}")
        return name

    def update(self, nodes: DataFrame, edges: DataFrame) -> tuple[Snapshot, Report | None]:
        """The snapshot of another build, from the latest one if there is one, written as the next."""
        last = self.latest()
        if last is None:
            new, report = snapshot(nodes, edges), None
        else:
            new, report = edited(last, edit_between(last, nodes, _known(edges, nodes)))
        self.write(new)
        return new, report
