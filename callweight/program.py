"""The whole run: unit facts, frames and rules to the resolved graph, its metrics and all reports."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixpoint import durable
from .functions.scalars import matches_globs
from .operators import metrics, resolve, rules, views
from .schema import FRAMES
from .sources import cache, readers, sinks

log = logging.getLogger("callweight")

# Exit codes, and rule files that a root may hold.
NO_BUILD_DB, NO_FACTS = 2, 3
OVERRIDE_FILE, REMOVAL_FILE = "fp-overrides.json", "edge-removals.json"


class Graph(NamedTuple):
    """A resolved program: functions(id, name, file, ..., ord), calls(src, dst, seq, indirect,
    cond_id), call sites with what binds them, the conditions by cond_id, callers whose pointers are
    all bound, and the rules that matched nothing."""

    functions: DataFrame
    calls: DataFrame
    sites: DataFrame
    conditions: list
    verified: DataFrame
    unused_overrides: DataFrame
    unused_removals: DataFrame


def build(tables: dict[str, DataFrame], overrides: Sequence[dict] = (), removals: Sequence[dict] = ()) -> Graph:
    """The graph of merged fact tables (readers.merge_facts).

    Calls and bound targets are resolved by name alike; targets that are defined nowhere drop out,
    and a condition all of whose targets drop out binds nothing. Where a function calls another both
    directly and under a condition, the condition holds for the call; of several the last.
    """
    spark = tables["fn_defs"].sparkSession
    defs = tables["fn_defs"].withColumn("ord", F.struct("unit_ord", "seq"))
    f = durable(resolve.display_keys(defs).drop("unit", "unit_ord", "seq").withColumnRenamed("key", "id"))
    who = f.select("usr", F.col("id").alias("src"), F.col("file").alias("src_file"), F.col("name").alias("caller"))
    direct = tables["raw_calls"].join(who, "usr").select("src", "src_file", "callee", F.struct(F.lit(0).alias("late"), F.col("unit_ord").cast("long").alias("unit_ord"), F.col("seq").cast("long").alias("seq")).alias("at"), F.lit(False).alias("indirect"), F.lit(None).cast("int").alias("cond_id"))
    sites = tables["raw_sites"].join(who.withColumnRenamed("usr", "caller_usr"), "caller_usr")
    sites = sites.select(F.struct("unit_ord", "seq").alias("site"), "src", "caller", F.col("src_file").alias("file"), F.col("line").alias("line1"), "via", F.coalesce("via_param", F.lit(-1)).alias("via_param"))
    good = rules.usable_overrides(list(overrides))
    if good:
        table = rules.override_table(spark, good)
        matched = durable(rules.match_overrides(sites, table))
        bound, sites, conditions = rules.bind(matched, good, "src", "file", "site")
        unused = rules.unused_overrides(table, matched)
        bound = bound.select("src", F.col("file").alias("src_file"), "callee", F.struct(F.lit(1).alias("late"), F.col("site.unit_ord").cast("long").alias("unit_ord"), (F.col("site.seq").cast("long") * 4096 + F.col("place")).alias("seq")).alias("at"), F.lit(True).alias("indirect"), "cond_id", "verified")
        verified = bound.filter("verified").select(F.col("src").alias("id")).distinct()
        raw = direct.unionByName(bound.drop("verified"))
    else:
        raw, conditions = direct, []
        unused, verified = spark.createDataFrame([], "rule int, caller string"), f.limit(0).select("id")
        sites = sites.withColumn("rule", F.lit(None).cast("int")).withColumn("overridden", F.lit(False)).withColumn("candidates", F.array().cast("array<string>"))
    to = resolve.resolve_names(raw, f).groupBy("src", "dst").agg(F.min("at").alias("at"), F.min("indirect").alias("indirect"), F.max("cond_id").alias("cond_id"))
    calls = durable(to.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("at")).alias("seq"), "indirect", "cond_id"))
    sites = sites.withColumnRenamed("caller", "name").withColumnRenamed("src", "caller")
    left, unused_removals, sites = rules.prune_edges(calls, list(removals), f, sites)
    return Graph(f, durable(left), sites.withColumnRenamed("caller", "id"), conditions, verified, unused, unused_removals)


def with_frames(functions: DataFrame, frames: DataFrame) -> DataFrame:
    """Functions with their frames, and ghosts: frames of names that no function has."""
    by_name, by_file = readers.frame_index(frames)
    f = resolve.attach_frames(functions, by_name, by_file).withColumn("ghost", F.lit(False))
    return f.unionByName(resolve.ghosts(functions, by_name), allowMissingColumns=True).withColumn("decl_file", F.coalesce("decl_file", "file")).withColumn("qualifier", F.coalesce("qualifier", F.lit("")))


def run(tables: dict[str, DataFrame], frames: DataFrame, overrides: Sequence[dict] = (), removals: Sequence[dict] = (), root_patterns: Sequence[str] = (), max_depth: int = 256) -> dict:
    """All result tables: functions, calls, sites, metrics, per_root, roots, unused_overrides,
    unused_removals; and the list of conditions that calls name by cond_id."""
    g = build(tables, overrides, removals)
    f = durable(with_frames(g.functions, frames))
    pinned = f.filter(matches_globs("decl_file", list(root_patterns))).select("id") if root_patterns else None
    got = metrics.analyse(f, g.calls, pinned, g.conditions, g.verified, max_depth)
    return {"functions": f, "calls": g.calls, "sites": g.sites, "conditions": g.conditions, "unused_overrides": g.unused_overrides, "unused_removals": g.unused_removals} | got


def _rules(path: str, key: str) -> list[dict]:
    if not path:
        return []
    try:
        with open(path, encoding="utf-8") as f:
            return readers.load_rules(f.read(), key)
    except OSError as e:
        log.warning("%s: %s", key, e)
        return []


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="callweight", description=__doc__)
    p.add_argument("--root", required=True, help="source root")
    p.add_argument("--facts", required=True, help="unit facts, one JSON object a line")
    p.add_argument("--su-dir", default="", help="folder of frame texts")
    p.add_argument("--root-pattern", action="append", default=[], help="glob over declaration files of pinned roots; may repeat")
    p.add_argument("--compile-commands-dir", default="", help="build database or its folder; the root, then its build folder, if not given")
    p.add_argument("--max-depth", type=int, default=256)
    p.add_argument("--fp-overrides", default="", help="JSON of call-site bindings")
    p.add_argument("--edge-removals", default="", help="JSON of calls that never happen")
    p.add_argument("--cache-dir", default="", help="folder of unit facts that later runs read")
    p.add_argument("--out", default="", help="result as JSON")
    p.add_argument("--report", default="", help="report as HTML")
    p.add_argument("--csv", default="", help="report as CSV")
    p.add_argument("--roots-only", action="store_true", help="reports of entry points only")
    p.add_argument("--json", action="store_true", help="result as JSON to standard output")
    p.add_argument("--verbose", action="store_true")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command line: 0, or NO_BUILD_DB or NO_FACTS."""
    args = arguments().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if args.verbose else logging.WARNING)
    db = readers.find_build_db(args.root, args.compile_commands_dir or None)
    if db is None:
        log.error("no build database in %s", args.compile_commands_dir or f"{args.root} or its build folder")
        return NO_BUILD_DB
    if not os.path.exists(args.facts):
        log.error("no unit facts at %s", args.facts)
        return NO_FACTS
    if spark is None:
        from .session import session

        spark = session()
    named = durable(readers.read_build_db(spark, db))
    units = durable(named.join(cache.file_states(named), "path", "left_semi"))
    if units.isEmpty():
        log.error("%s names no source file that is there", db)
        return NO_BUILD_DB
    facts, counts = cache.cached_facts(units, args.facts, args.cache_dir or None)
    counts["missingFiles"] = named.count() - counts["units"]
    tables = readers.merge_facts(readers.fact_tables(facts))
    frames = readers.read_frames(spark, args.su_dir) if args.su_dir else spark.createDataFrame([], FRAMES)
    rule = lambda path, name, key: _rules(readers.rule_file(args.root, name, path) or "", key)
    got = run(tables, frames, rule(args.fp_overrides, OVERRIDE_FILE, "overrides"), rule(args.edge_removals, REMOVAL_FILE, "removals"), args.root_pattern, args.max_depth)
    counts["unresolvedCalls"] = tables["raw_calls"].select("callee").join(got["functions"].select(F.col("name").alias("callee")).distinct(), "callee", "left_anti").count()
    log.info("counts: %s", counts)
    meta = {"root": args.root, "suDir": args.su_dir, "fileCount": counts["units"], "functionCount": got["functions"].count(), "generatedAt": time.strftime("%Y-%m-%dT%H:%M:%S"), "counts": counts}
    rows = sinks.document_rows(got["functions"], got["metrics"], got["per_root"], got["calls"], got["sites"].select("id", "line1", "via", "overridden"), got["conditions"])
    report = sinks.with_flags(views.cli_rows(got["functions"], got["metrics"], got["calls"], args.roots_only))
    if args.out:
        sinks.write_document(rows, got["roots"], meta, os.path.abspath(args.out))
    if args.report:
        sinks.write_text(sinks.html_parts(report, list(sinks.CLI_COLUMNS.values()), views.cards(got["metrics"]).first().asDict(), note=json.dumps(meta)), args.report)
    if args.csv:
        sinks.write_text(sinks.csv_parts(report, sinks.CLI_COLUMNS), args.csv)
    if args.json or not (args.out or args.report or args.csv):
        sys.stdout.writelines(sinks.document_parts(rows, got["roots"], meta))
        sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
