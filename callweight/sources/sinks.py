"""Writers: parquet snapshots, JSON, CSV and HTML reports, templates and the fact cache."""

from __future__ import annotations

import html
import json
import logging
import time
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import csv_field
from .document import write_ordered

log = logging.getLogger("callweight")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One parquet table a result; the form other jobs read."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def result_rows(functions: DataFrame, metrics: DataFrame, per_root: DataFrame, calls: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One nested row a function, as the JSON document holds it."""
    roots = per_root.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("__k"), "root", "depth", "entry", "peak", "bounded", "is_auto", "is_pinned"))).alias("__r"))
    roots = roots.select("id", F.transform("__r", lambda x: F.struct(x.root.alias("root"), x.depth.alias("depth"), x.entry.alias("entry"), x.peak.alias("peak"), x.bounded.alias("bounded"), x.is_auto.alias("is_auto"), x.is_pinned.alias("is_pinned"))).alias("per_root"))
    callees = calls.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "dst"))), lambda x: x.dst).alias("callees")).withColumnRenamed("src", "id")
    d = functions.join(metrics, "id").join(roots, "id", "left").join(callees, "id", "left")
    if sites is not None:
        d = d.join(sites.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line1", "via", "overridden"))).alias("fp_sites")), "id", "left")
    return d


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in parallel; nulls are kept so every object has the same keys."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def document_rows(functions: DataFrame, metrics: DataFrame, per_root: DataFrame, calls: DataFrame, sites: DataFrame, conditions: list) -> DataFrame:
    """(id, text): each function as the JSON object of the result document that hosts read. Names of
    callees, roots and targets are ids; frames and places that are not known are null."""
    ids = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("seq", "dst")))), lambda x: x.dst)
    out = calls.groupBy(F.col("src").alias("id")).agg(ids(F.lit(True)).alias("callees"), ids(F.col("indirect")).alias("indirect"))
    roots = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("k"), F.col("root").cast("string").alias("root"), "depth", "entry", "peak", F.col("bounded").alias("peakBounded"), F.col("is_auto").alias("isAuto"), F.col("is_pinned").alias("isPinned"))))
    seen = per_root.groupBy("id").agg(F.transform(roots, lambda x: x.dropFields("k")).alias("perRoot"))
    marked = sites.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("line1").alias("line"), "via", "overridden"))).alias("fpSites"))
    texts = F.array(*(F.lit(json.dumps(c)) for c in conditions)) if conditions else F.array().cast("array<string>")
    cond = calls.filter("cond_id is not null").groupBy(F.col("src").alias("id"), "cond_id").agg(ids(F.lit(True)).alias("targets"))
    cond = cond.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cond_id", "targets"))), lambda x: F.concat(F.lit('{"targets":'), F.to_json(x.targets), F.lit(',"cond":'), F.get(texts, x.cond_id), F.lit("}"))).alias("c"))
    d = functions.join(metrics, "id").join(out, "id", "left").join(seen, "id", "left").join(marked, "id", "left").join(cond, "id", "left")
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like))
    kind = dict(calls.dtypes)["dst"]
    has = lambda c, other: F.col(c) if c in d.columns else other
    fields = F.struct(
        F.col("name"), F.col("file"), F.coalesce(has("line", has("line0", F.lit(0))), F.lit(0)).alias("line"), none("callees", f"array<{kind}>").alias("callees"), none("indirect", f"array<{kind}>").alias("indirect"), F.col("frame").alias("stackBytes"), has("qualifier", F.lit("")).alias("stackQualifier"),
        F.col("peak"), F.col("bounded").alias("peakBounded"), F.col("recursive"), F.col("recursive_via_fp").alias("recursiveViaFp"), F.col("fp_verified").alias("fpVerified"), F.col("is_pinned_root").alias("isPinnedRoot"), F.col("is_auto_root").alias("isAutoRoot"),
        F.col("depth"), F.col("down_depth").alias("downDepth"), F.col("bounded").alias("downDepthBounded"), none("fpSites", dict(d.dtypes)["fpSites"]).alias("fpSites"), none("perRoot", dict(d.dtypes)["perRoot"]).alias("perRoot"),
    )
    body = F.to_json(fields, {"ignoreNullFields": "false"})
    return d.select("id", F.concat(body.substr(F.lit(1), F.length(body) - 1), F.lit(',"conditional":['), F.coalesce(F.array_join("c", ","), F.lit("")), F.lit("]}")).alias("text"))


def document_sections(rows: DataFrame, roots: DataFrame, meta: dict) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(section, key, text) of the result document, and what stands around each section."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c).cast("string"))), r"^\[|\]$", "")  # noqa: E731  a JSON string
    d = rows.select(F.lit(0).alias("section"), F.col("id").cast("string").alias("key"), F.concat(quoted("id"), F.lit(":"), "text").alias("text"))
    for k, c in enumerate((F.lit(True), F.col("is_pinned"), F.col("is_auto"))):
        d = d.union(roots.filter(c).select(F.lit(k + 1), F.col("root").cast("string"), quoted("root")))
    names = ["roots", "pinnedRoots", "autoRoots"]
    around = [('{"byName":{', "}")] + [(f',"{n}":[', "]") for n in names]
    around[-1] = (around[-1][0], f'],"meta":{json.dumps(meta)}}}')
    return d, around


def write_document(rows: DataFrame, roots: DataFrame, meta: dict, path: str) -> None:
    """The whole result as one JSON file in a shared folder, written by the tasks."""
    write_ordered(*document_sections(rows, roots, meta), path)


def document_parts(rows: DataFrame, roots: DataFrame, meta: dict) -> Iterator[str]:
    """The same text part by part, for a pipe; one partition of rows is on the driver at a time."""
    d, around = document_sections(rows, roots, meta)
    d = d.repartitionByRange("section", "key").sortWithinPartitions("section", "key")
    now = -1
    for r in d.toLocalIterator():
        while now < r.section:
            yield (around[now][1] if now >= 0 else "") + around[now + 1][0]
            now, first = now + 1, True
        yield ("" if first else ",") + r.text
        first = False
    while now < len(around) - 1:
        yield (around[now][1] if now >= 0 else "") + around[now + 1][0]
        now += 1
    yield around[-1][1]


def result_document(rows: DataFrame, roots: DataFrame, meta: dict) -> str:
    """The same as one string; for small graphs."""
    return "".join(document_parts(rows, roots, meta))


def write_text(parts: Iterable[str], path: str) -> None:
    """Parts of a text to a file of the driver, one after the other."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.writelines(parts)


def csv_parts(rows: DataFrame, columns: dict[str, str]) -> Iterator[str]:
    """CSV of rows under other headings: {heading: column}."""
    yield ",".join(columns) + "\r\n"
    for r in csv_lines(rows, list(columns.values())).toLocalIterator():
        yield r.value + "\r\n"


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value): CSV lines, fields quoted only where needed, nulls empty."""
    return rows.select(F.concat_ws(",", *[csv_field(c) for c in columns]).alias("value"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A header in every part file; parts keep the order of rows."""
    rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).na.fill("").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


# Headings of the two CSV reports and the columns they show.
CLI_COLUMNS = {"function": "name", "file": "file", "line": "line", "frame_bytes": "frame", "peak_bytes": "peak", "peak_bounded": "bounded_text", "max_depth": "depth", "recursive": "recursive_text", "severity": "severity", "callees": "callees"}
HOST_COLUMNS = {"function": "name", "file": "file", "line": "line", "root": "root", "root_kind": "root_kind", "longest_calls_into": "depth", "own_frame_bytes": "own_frame", "own_qualifier": "own_qualifier", "peak_stack_bytes": "peak", "peak_bounded": "bounded_text", "recursive": "recursive_text", "ghost": "ghost_text", "severity": "severity"}


def with_flags(rows: DataFrame) -> DataFrame:
    """rows with yes or no beside each flag."""
    have = [c for c in ("bounded", "recursive", "ghost") if c in rows.columns]
    return rows.select("*", *(F.when(F.col(c), "yes").otherwise("no").alias(c + "_text") for c in have))


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif}}td,th{{padding:2px 8px;text-align:left}}.critical{{color:#b00}}.warn{{color:#a60}}.card{{display:inline-block;margin:4px;padding:8px;border:1px solid #ccc}}</style>
<h1>{title}</h1><div>{cards}</div><p>{note}</p><input id="q" placeholder="filter"><table><thead><tr>{head}</tr></thead><tbody>
"""
_SCRIPT = """</tbody></table><script>
const rows=[...document.querySelectorAll('tbody tr')],q=document.getElementById('q');
q.oninput=()=>{const v=q.value.toLowerCase();for(const r of rows)r.hidden=!r.textContent.toLowerCase().includes(v)};
document.querySelectorAll('th').forEach((h,i)=>h.onclick=()=>{h.d=!h.d;const k=r=>{const t=r.cells[i].textContent;return t===''?-1:isNaN(t)?t:+t};
rows.sort((a,b)=>(k(a)>k(b)?1:k(a)<k(b)?-1:0)*(h.d?-1:1)).forEach(r=>r.parentNode.append(r))});
</script>
"""


def html_parts(rows: DataFrame, columns: list[str], cards: dict, title: str = "Report", note: str = "") -> Iterator[str]:
    """A page with summary cards and a table that sorts and filters, part by part."""
    esc = lambda x: html.escape("" if x is None else str(x))
    yield _PAGE.format(title=esc(title), note=esc(note), head="".join(f"<th>{esc(c)}</th>" for c in columns), cards="".join(f'<span class="card">{esc(k)}: <b>{esc(v)}</b></span>' for k, v in cards.items()))
    for r in rows.select(*columns).toLocalIterator():
        css = r["severity"] if "severity" in columns else ""
        yield f'<tr class="{esc(css)}">' + "".join(f"<td>{esc(r[c])}</td>" for c in columns) + "</tr>\n"
    yield _SCRIPT


def html_report(rows: DataFrame, columns: list[str], cards: dict, title: str = "Report", note: str = "") -> str:
    """The same page as one string; for small graphs."""
    return "".join(html_parts(rows, columns, cards, title, note))


def template_json(entries: DataFrame, coverage: DataFrame) -> str:
    c = coverage.first()
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in entries.toLocalIterator()]
    return json.dumps({"_comment": f"{c.unresolved} unresolved, {c.covered} covered", "overrides": rows}, indent=2)


def write_unit_facts(facts: DataFrame, folder: str) -> None:
    """Facts by unit; a rescan replaces only its own units' partitions."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit_key").parquet(folder)


def drop_cache(spark, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def graph_payload(nodes: DataFrame, edges: DataFrame, focus, warn: int, critical: int) -> dict:
    """What a graph view needs; the frames are bounded by the neighbourhood's budget."""
    return {"focus": focus, "thresholds": [warn, critical], "nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.collect()]}


class PhaseLog:
    """Levelled log with timed phases; a message repeated beyond a cap is only counted."""

    def __init__(self, cap: int = 20):
        self.cap, self.seen, self.times = cap, Counter(), {}

    def say(self, category: str, text: str, level: int = logging.INFO) -> None:
        self.seen[category] += 1
        if self.seen[category] <= self.cap:
            log.log(level, "%s: %s", category, text)

    @contextmanager
    def phase(self, name: str):
        t = time.monotonic()
        try:
            yield
        finally:
            self.times[name] = time.monotonic() - t

    def summary(self) -> dict:
        return {"seconds": dict(self.times), "suppressed": {k: n - self.cap for k, n in self.seen.items() if n > self.cap}}


def display(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
