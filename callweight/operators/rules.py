"""Rules that add, condition or prune edges, and their small condition language.

A condition is {fromRoot: f}, {callerContains: f}, {all: [..]}, {any: [..]} or {not: c}; it is
compiled on the driver to a column, with leaves that depend on where it is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bare, basename
from . import metrics

BITS = 12  # functions that a path condition can watch
RUN_ORDER = ("fromRoot", "callerContains", "all", "any", "not")
STATIC_ORDER = ("callerContains", "fromRoot", "all", "any", "not")


def compile_condition(cond, leaf: Callable[[str, str], Column], order: tuple[str, ...] = RUN_ORDER) -> Column:
    """The first key in `order` that the condition has decides; what is no condition holds."""
    if not isinstance(cond, dict):
        return F.lit(True)
    key = next((k for k in order if k in cond), None)
    if key in ("fromRoot", "callerContains"):
        return leaf(key, str(cond[key]))
    if key in ("all", "any"):
        parts = [compile_condition(c, leaf, order) for c in (cond[key] or [])]
        out = F.lit(key == "all")
        for p in parts:
            out = (out & p) if key == "all" else (out | p)
        return out
    return ~compile_condition(cond["not"], leaf, order) if key == "not" else F.lit(True)


def watched(conditions: list) -> dict[str, int]:
    """Bit of each function that a callerContains names: the first BITS by name."""
    found: set[str] = set()

    def walk(c) -> None:
        if isinstance(c, dict):
            if "callerContains" in c:
                found.add(str(c["callerContains"]))
            for k in ("all", "any"):
                for x in c.get(k) or []:
                    walk(x)
            walk(c.get("not"))

    for c in conditions:
        walk(c)
    return {f: 1 << i for i, f in enumerate(sorted(found)[:BITS])}


def path_condition(cond, bits: dict[str, int], root: str = "root", mask: str = "mask") -> Column:
    """The condition over a traversal's root and mask; functions without a bit hold."""

    def leaf(kind: str, f: str) -> Column:
        if kind == "fromRoot":
            return F.col(root) == f
        return F.col(mask).bitwiseAND(F.lit(bits[f])) != 0 if f in bits else F.lit(True)

    return compile_condition(cond, leaf)


def names_in(cond) -> set[str]:
    if not isinstance(cond, dict):
        return set()
    own = {str(cond[k]) for k in ("fromRoot", "callerContains") if k in cond}
    return own.union(*(names_in(x) for k in ("all", "any") for x in cond.get(k) or []), names_in(cond.get("not")))


# Overrides: rules bind targets to call sites through pointers.


def usable_overrides(rules: list[dict]) -> list[dict]:
    """Rules with targets, or with a conditional entry that has targets."""
    return [r for r in rules if r.get("caller") and (r.get("targets") or any(isinstance(c, dict) and c.get("targets") for c in r.get("conditional") or []))]


def override_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    rows = [(i, r["caller"], r.get("file") or None, r.get("line"), r.get("via") or None) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, caller string, file string, line int, via string")


def match_overrides(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites(site, caller, file, line1, via) with the rule that binds each: the caller must be
    equal, and of file name, line and via those the rule states; the rule that states most wins,
    the earlier on ties. Rules are few, so their side is broadcast."""
    r = F.broadcast(rules.select(F.col("rule"), F.col("caller").alias("r_caller"), F.col("file").alias("r_file"), F.col("line").alias("r_line"), F.col("via").alias("r_via")))
    stated = sum((F.col(c).isNotNull().cast("int") for c in ("r_file", "r_line", "r_via")), F.lit(0))
    fits = (F.col("caller") == F.col("r_caller")) & (F.col("r_file").isNull() | (basename("r_file") == basename("file"))) & (F.col("r_line").isNull() | (F.col("r_line") == F.col("line1"))) & (F.col("r_via").isNull() | (F.col("r_via") == F.col("via")))
    best = sites.join(r, fits).groupBy("site").agg(F.min_by("rule", F.struct(-stated, F.col("rule"))).alias("rule"))
    return sites.join(best, "site", "left")


def unused_overrides(rules: DataFrame, matched: DataFrame) -> DataFrame:
    return rules.join(matched.filter("rule is not null").select("rule"), "rule", "left_anti")


def bind(matched: DataFrame, rules: list[dict], *also: str) -> tuple[DataFrame, DataFrame, list]:
    """(edges, sites, conditions): edges(caller, callee, verified, cond_id, place) that the rules
    create, with the site's columns `also`, sites with overridden and candidates, and the condition
    of each cond_id. Edges name their targets as the rules do; place is a target's in its rule.

    Plain targets make verified edges; conditional ones unverified edges with a condition, of
    which the last stands if a target is named twice. A matched site counts as overridden even if
    nothing was bound.
    """
    spark = matched.sparkSession
    rows, conds = [], []
    for i, r in enumerate(rules):
        rows += [(i, t, True, None, k) for k, t in enumerate(r.get("targets") or [])]
        last: dict[str, int] = {}
        for c in r.get("conditional") or []:
            if isinstance(c, dict) and c.get("when") and c.get("targets"):
                conds.append(c["when"])
                for t in c["targets"]:
                    last[t] = len(conds) - 1
        rows += [(i, t, False, k, len(r.get("targets") or []) + n) for n, (t, k) in enumerate(last.items())]
    made = F.broadcast(spark.createDataFrame(rows, "rule int, callee string, verified boolean, cond_id int, place int"))
    edges = matched.join(made, "rule").select("caller", "callee", "verified", "cond_id", *(["place", *also] if also else [])).distinct()
    names = made.groupBy("rule").agg(F.array_distinct(F.flatten(F.array(F.collect_list("callee")))).alias("__t"))
    old = F.col("candidates") if "candidates" in matched.columns else F.array().cast("array<string>")
    sites = matched.join(names, "rule", "left").withColumn("overridden", F.col("rule").isNotNull()).withColumn("candidates", F.array_union(old, F.coalesce("__t", F.array().cast("array<string>")))).drop("__t")
    return edges, sites, conds


# Removals.


def prune_edges(calls: DataFrame, rules: list[dict], functions: DataFrame, sites: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(kept calls, rules that removed nothing, sites without removed candidates).

    A rule names a callee, by bare name or full key; optionally a caller ("" or "*": any), a file
    name of the caller, and a condition, which holds for a caller if the functions it names reach
    the caller (a function reaches itself) in the graph left by the unconditional rules that stand
    before the first conditional one.
    """
    spark = calls.sparkSession
    ok = [(i, r) for i, r in enumerate(rules) if r.get("callee")]
    rows = [(i, r["callee"], None if r.get("caller") in (None, "", "*") else r["caller"], r.get("file") or None, r.get("when") is not None) for i, r in ok]
    table = F.broadcast(spark.createDataFrame(rows, "rule int, r_callee string, r_caller string, r_file string, has_cond boolean"))
    f = functions.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    fits = ((bare("dst") == F.col("r_callee")) | (F.col("dst") == F.col("r_callee"))) & (F.col("r_caller").isNull() | (bare("src") == F.col("r_caller")) | (F.col("src") == F.col("r_caller"))) & (F.col("r_file").isNull() | (basename("src_file") == basename("r_file")))
    hit = calls.join(f, "src", "left").join(table, fits).select("src", "dst", "rule", "has_cond")
    conditional = [(i, r) for i, r in ok if r.get("when") is not None]
    holds = hit.filter("not has_cond").select("src", "dst", "rule")
    if conditional:
        before = min(i for i, _ in conditional)
        left = calls.join(hit.filter((~F.col("has_cond")) & (F.col("rule") < before)), ["src", "dst"], "left_anti")
        b = left.select(bare("src").alias("src"), bare("dst").alias("dst")).distinct()
        named = sorted(set().union(*(names_in(r["when"]) for _, r in conditional)))
        seeds = spark.createDataFrame([(n,) for n in named], "seed string")
        reach = metrics.closure_seeded(b, seeds)
        to = reach.groupBy("node").agg(F.collect_set("seed").alias("__from")).withColumnRenamed("node", "__caller")
        c = hit.filter("has_cond").withColumn("__caller", bare("src")).join(to, "__caller", "left")
        has = lambda _, n: F.coalesce(F.array_contains("__from", n), F.lit(False)) | (F.col("__caller") == n)
        true = F.lit(False)
        for i, r in conditional:
            true = true | ((F.col("rule") == i) & compile_condition(r["when"], has, STATIC_ORDER))
        holds = holds.union(c.filter(true).select("src", "dst", "rule"))
    holds = metrics.durable(holds.distinct())
    kept = calls.join(holds.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    unused = spark.createDataFrame([(i, r["callee"]) for i, r in ok], "rule int, callee string").join(holds.select("rule"), "rule", "left_anti")
    if sites is not None:
        gone = holds.groupBy("src").agg(F.collect_set(bare("dst")).alias("__gone")).withColumnRenamed("src", "caller")
        sites = sites.join(gone, "caller", "left").withColumn("candidates", F.filter("candidates", lambda x: ~F.coalesce(F.array_contains("__gone", x), F.lit(False)))).drop("__gone")
    return kept, unused, sites
