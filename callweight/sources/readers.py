"""Frame texts, build databases, unit facts, rule files, results and synthetic graphs."""

from __future__ import annotations

import json
import os
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixpoint import durable
from ..functions.scalars import stem
from ..schema import BUILD_DB, FACTS

SOURCES = (".c", ".cc", ".cpp", ".cxx")


def parse_frames(lines: DataFrame, line: str = "value") -> DataFrame:
    """(func, bytes, qualifier, file, line) of frame text: columns parted by tabs, or by blanks
    where there is no tab; lines whose size is no integer are skipped. The place is split from the
    right: file:line:col:func, file:line:func, file:func, or func alone."""
    v = F.trim(F.col(line))
    cells = F.when(v.contains("\t"), F.split(v, "\t")).otherwise(F.split(v, r"\s+"))
    d = lines.select("*", cells.alias("__c")).filter(F.size("__c") >= 2)
    place, n = F.trim(F.col("__c")[0]), F.expr("try_cast(trim(__c[1]) as bigint)")
    shapes = (r"^(.*):(\d+):(\d+):([^:]*)$", r"^(.*):(\d+):([^:]*)$", r"^(.*):([^:]*)$")

    def pick(groups: tuple, alone: Column) -> Column:
        out = F
        for shape, g in zip(shapes, groups, strict=True):
            out = out.when(place.rlike(shape), g if isinstance(g, Column) else F.regexp_extract(place, shape, g))
        return out.otherwise(alone)

    keep = [c for c in lines.columns if c != line]
    return d.select(*keep, pick((4, 3, 2), place).alias("func"), n.alias("bytes"), F.trim(F.coalesce(F.try_element_at("__c", F.lit(3)), F.lit(""))).alias("qualifier"), pick((1, 1, 1), F.lit("")).alias("file"), pick((2, 2, F.lit("0")), F.lit("0")).cast("int").alias("line")).filter("bytes is not null and func <> ''")


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """All *.su files below a folder but for .git and node_modules; a missing folder gives none."""
    try:
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.su").text(folder)
    except Exception as e:  # the only tolerated failure is a folder that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], "value string")
        return parse_frames(raw).withColumn("unit", F.lit(""))
    d = raw.withColumn("path", F.col("_metadata.file_path")).filter(~F.col("path").rlike(r"/(\.git|node_modules)/"))
    return parse_frames(d).withColumn("unit", stem("path")).drop("path")


def frame_index(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Largest frame by function, and by (file stem, function); the first wins ties. Rows need an
    `ord` for that; without one the smaller file, then line, is first."""
    order = [F.col("ord")] if "ord" in frames.columns else [F.col("file"), F.col("line")]
    f = frames.withColumn("__stem", stem("file"))

    def largest(*by: str) -> DataFrame:
        # the maximum of a number needs no sort and is summed up before the exchange; only frames that reach it are ordered
        top = f.groupBy(*by).agg(F.max("bytes").alias("__top")).select(*(F.col(c).alias(f"__{c}") for c in by), "__top")
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("bytes") == F.col("__top")]
        return f.join(top, on, "left_semi").groupBy(*by).agg(F.min_by(F.struct("func", "bytes", "qualifier", "file", "line"), F.struct(*order)).alias("r"))

    return largest("func").select("r.*"), largest("__stem", "func").select(F.col("__stem").alias("stem"), "r.*")


def find_build_db(root: str, explicit: str | None = None) -> str | None:
    """An explicit file or folder, else the root, else root/build; no deeper search."""
    for p in [explicit] if explicit else [root, os.path.join(root, "build")]:
        for f in (p, os.path.join(p, "compile_commands.json")):
            if os.path.isfile(f):
                return f
    return None


def read_build_db(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """(path, args) of the first entry of each source file, relative names resolved against the
    entry's directory. `existing(path)` keeps files that are there."""
    d = spark.read.schema(BUILD_DB).option("multiLine", "true").json(path).withColumn("pos", F.monotonically_increasing_id())
    full = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    d = d.withColumn("path", normal_abspath(full)).filter(F.lower("path").rlike(r"\.(c|cc|cpp|cxx)$"))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).filter("rn = 1")
    if existing is not None:
        d = d.join(existing.select("path"), "path", "left_semi")
    return d.select("path", entry_args(F.coalesce("arguments", shell_split("command")), F.col("directory")).alias("args"), "pos")


def normal_abspath(path: Column) -> Column:
    """An absolute path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_split(command: pd.Series) -> pd.Series:
    """Shell words; quoting needs a scan, so this is an Arrow-batched function."""
    return command.map(lambda c: None if c is None else shlex.split(c))


# Flags that say nothing about what a unit calls, and flags that take a folder.
DROPPED = frozenset("-c -S -MMD -MD -MP -w".split())
DROPPED_STARTS = ("-fstack-usage", "-fdump-")
FOLDER_FLAGS = frozenset("-isystem -iquote -idirafter".split())
INPUTS = (*SOURCES, ".o")


def clean_args(args: list[str], directory: str) -> list[str]:
    """Compiler arguments without the compiler itself, inputs, outputs, dependency, dump and warning
    flags; include folders absolute, those of -I joined to the flag."""
    out: list[str] = []
    rest = iter(args[1:])
    place = lambda p: os.path.normpath(os.path.join(directory, p)) if p and not os.path.isabs(p) else p
    for a in rest:
        if a == "-o":
            next(rest, None)
        elif a in DROPPED or a.startswith(DROPPED_STARTS) or a.startswith("-W") and a != "-W" or a.endswith(INPUTS):
            continue
        elif a in FOLDER_FLAGS:
            if (p := next(rest, None)) is not None:
                out += [a, place(p)]
        elif a.startswith("-I"):
            p = a[2:] or next(rest, None)
            if a != "-I" or p is not None:
                out.append("-I" + place(p))
        else:
            out.append(a)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def entry_args(args: pd.Series, directory: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else clean_args(a, d or "/") for a, d in zip(args, directory, strict=True)])


def all_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row a line, those that do not parse with their text in _corrupt_record."""
    d = spark.read.schema(FACTS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return d.withColumn("unit_ord", F.monotonically_increasing_id())


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """One row a unit; lines that do not parse are dropped and a unit without records counts as
    empty, so one bad unit never stops the rest."""
    return all_facts(spark, path).filter("_corrupt_record is null").drop("_corrupt_record")


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """Facts as flat tables: fn_defs, raw_calls, raw_sites, arg_funcs, param_fwd, includes."""
    ex = lambda c, name: facts.select("unit", "unit_ord", F.posexplode(c).alias("seq", name))
    return {
        "fn_defs": ex("records", "r").select("unit", "unit_ord", "seq", "r.*"),
        "raw_calls": ex("edges", "e").select("unit", "unit_ord", "seq", "e.usr", "e.callee"),
        "raw_sites": ex("indirect_sites", "s").select("unit", "unit_ord", "seq", "s.*"),
        "arg_funcs": ex("arg_funcs", "a").select("a.callee", "a.idx", F.explode("a.funcs").alias("func")).groupBy("callee", "idx").agg(F.sort_array(F.collect_set("func")).alias("funcs")),
        "param_fwd": ex("param_fwd", "p").select("p.*").distinct(),
        "includes": facts.select("unit", F.explode("includes").alias("include")).distinct(),
    }


def merge_facts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts of all units as one program: the first unit to define a usr wins."""
    first = Window.partitionBy("usr").orderBy("unit_ord", "seq")
    defs = tables["fn_defs"].withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return tables | {"fn_defs": defs}


def suggest_targets(tables: dict[str, DataFrame], max_hops: int = 1000) -> DataFrame:
    """(callee, idx, func): functions that may arrive at a parameter, following forwards; a
    suggestion for overrides, never an edge."""
    have = tables["arg_funcs"].select("callee", "idx", F.explode("funcs").alias("func"))
    fwd = tables["param_fwd"].select("callee", "idx", F.col("src").alias("f"), F.col("src_idx").alias("fi"))
    new = have
    for _ in range(max_hops):
        new = durable(new.toDF("f", "fi", "func").join(fwd, ["f", "fi"]).select("callee", "idx", "func").distinct().join(have, ["callee", "idx", "func"], "left_anti"))
        if new.isEmpty():
            return have
        have = have.union(new)
    raise RuntimeError(f"functions still arrive at parameters after {max_hops} forwards")


def suggestions(sites: DataFrame, functions: DataFrame, suggested: DataFrame) -> DataFrame:
    """(caller_usr, line, via, funcs): for each call through a parameter, the functions that may
    arrive there; sites of fact_tables, functions(usr, name), suggested(callee, idx, func)."""
    s = sites.filter("via_param >= 0").join(functions.select(F.col("usr").alias("caller_usr"), F.col("name").alias("callee")), "caller_usr")
    s = s.join(suggested.withColumnRenamed("idx", "via_param"), ["callee", "via_param"])
    return s.groupBy("caller_usr", "line", "via").agg(F.sort_array(F.collect_set("func")).alias("funcs"))


def load_rules(text: str | None, key: str) -> list[dict]:
    """Rules of a JSON document {key: [...]} or bare list; anything malformed gives no rules, and
    malformed entries are skipped."""
    try:
        doc = json.loads(text.lstrip("﻿")) if text else []
    except ValueError:
        return []
    rows = doc.get(key, []) if isinstance(doc, dict) else doc
    return [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


def rule_file(root: str, name: str, explicit: str | None = None) -> str | None:
    """An explicit rule file, else root/name where it exists."""
    p = explicit or os.path.join(root, name)
    return p if explicit or os.path.isfile(p) else None


# The fields of a function in the result document, and of its rows per root.
RESULT = "name string, file string, line int, callees array<string>, indirect array<string>, stackBytes long, stackQualifier string, peak long, peakBounded boolean, recursive boolean, recursiveViaFp boolean, fpVerified boolean, isPinnedRoot boolean, isAutoRoot boolean, depth int, downDepth int, downDepthBounded boolean, fpSites array<struct<line:int,via:string,overridden:boolean>>, perRoot array<struct<root:string,depth:int,entry:long,peak:long,peakBounded:boolean,isAuto:boolean,isPinned:boolean>>, conditional array<struct<targets:array<string>,cond:string>>"
ROOT_LISTS = ("roots", "pinnedRoots", "autoRoots")


def read_result(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A result document back to tables: functions (a row each, with all fields of the document; gaps
    are 0, false or empty as a host fills them), per_root, sites, calls(src, dst, indirect, seq),
    conditional, and roots(root, is_pinned, is_auto). The document is one JSON value, so one task
    parses it; its functions are spread from there."""
    doc = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", "byName map<string,string>, " + ", ".join(f"{x} array<string>" for x in ROOT_LISTS)).alias("d")
    d = doc.select(as_map).select("d.*")
    f = d.select(F.explode("byName").alias("id", "text")).repartition("id").select("id", F.from_json("text", RESULT).alias("r")).select("id", "r.*")
    for c, kind in f.dtypes:
        if c in ("depth", "downDepth", "line"):
            f = f.withColumn(c, F.coalesce(c, F.lit(0)))
        elif kind == "boolean":
            f = f.withColumn(c, F.coalesce(c, F.lit(False)))
        elif kind.startswith("array"):
            f = f.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    f = durable(f)
    calls = f.select(F.col("id").alias("src"), F.posexplode("callees").alias("seq", "dst"), "indirect").select("src", "dst", F.array_contains("indirect", F.col("dst")).alias("indirect"), (F.col("seq") + 1).alias("seq"))
    marks = d.select(F.explode("roots").alias("root"), "pinnedRoots", "autoRoots").select("root", F.array_contains("pinnedRoots", F.col("root")).alias("is_pinned"), F.array_contains("autoRoots", F.col("root")).alias("is_auto"))
    return {
        "functions": f, "calls": calls, "roots": marks,
        "per_root": f.select("id", F.explode("perRoot").alias("r")).select("id", "r.*"),
        "sites": f.select("id", F.explode("fpSites").alias("s")).select("id", "s.*"),
        "conditional": f.select("id", F.explode("conditional").alias("c")).select("id", "c.*"),
    }


def synthetic_graph(spark: SparkSession, n: int = 3000, variant: int = 0) -> tuple[DataFrame, DataFrame]:
    """(functions, calls) of the deterministic test topology: roots, hubs, a chain, cycles,
    dispatchers, callers and leaves, all by index arithmetic."""
    half = 440 + (n - 440) // 2
    leaves, callers = n - half, half - 440
    i = F.col("id")
    between = lambda a, b: (i >= a) & (i < b)
    leaf = lambda k: F.lit(half) + F.pmod(k, F.lit(leaves))
    hub = lambda k: F.when(k < 40, 20 + k)  # noqa: E731  no hub beyond the last
    h, c, w, f, d = i - 20, i - 60, i - 440, i - half, i - 360
    arr = F.array
    none = F.array().cast("array<bigint>")
    rec = i - 260
    triple = rec - 80
    cyc = (
        F.when(rec < 40, arr(i, leaf(rec * 3)))
        .when(rec < 80, F.when(rec % 2 == 0, arr(i + 1, leaf(rec * 5))).otherwise(arr(i - 1)))
        .when(rec < 95, F.when(triple % 3 == 2, arr(i - 2)).when(triple % 3 == 1, arr(i + 1, leaf((rec - 1) * 7))).otherwise(arr(i + 1)))
        .otherwise(arr(F.when(rec == 99, i - 4).otherwise(i + 1)))
    )
    block = (f / 50).cast("bigint") * 50
    inside = lambda k: F.when((f - block + k < 50) & (f + k < leaves), i + k)
    out = (
        F.when(i < 20, arr(20 + (i * 2) % 40, 20 + (i * 2 + 1) % 40, F.lit(60), 440 + (i * 7) % callers, 260 + i, 360 + i))
        .when(between(20, 60), F.concat(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: leaf(F.pmod(h * 23, F.lit(leaves - 35)) + k)), arr(hub(h + 1), hub(h + 5))))
        .when(between(60, 259), arr(i + 1))
        .when(i == 259, arr(F.lit(half)))
        .when(between(260, 360), cyc)
        .when(between(360, 440), F.when(d % 2 == 0, arr(leaf(d * 3))).otherwise(none))
        .when(between(440, half), arr(20 + w % 40, F.when(w + 3 < callers, i + 3), F.when(w + 11 < callers, i + 11)))
        .otherwise(arr(inside(1), inside(5), inside(17)))
    )
    frame = F.when(between(60, 260), 32 + 8 * (i % 7)).otherwise(16 + (48 * i) % 1600 + F.when(between(20, 60), 512).otherwise(0))
    v = spark.range(n)
    nodes = v.select(i.cast("string").alias("id"), F.format_string("fn_%04d", i).alias("name"), F.concat(F.lit("src/f"), (i / 100).cast("int"), F.lit(".c")).alias("file"), frame.cast("bigint").alias("frame"), i.cast("int").alias("ord"))
    calls = v.select(i.alias("s"), F.posexplode(out.cast("array<bigint>")).alias("seq", "d")).filter("d is not null").groupBy("s", "d").agg(F.min("seq").alias("seq"))
    calls = calls.select(F.col("s").cast("string").alias("src"), F.col("d").cast("string").alias("dst"), "seq", F.lit(False).alias("indirect"))
    if variant:  # one edge gone, one new, one frame changed
        calls = calls.filter(f"not (src = '20' and dst = '{half}')").union(spark.createDataFrame([("0", "160", 6, False)], calls.schema))
        nodes = nodes.withColumn("frame", F.when(F.col("id") == "21", F.lit(9000)).otherwise(F.col("frame")).cast("long"))
    return nodes, calls
