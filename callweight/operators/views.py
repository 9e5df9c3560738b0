"""Ranked lists, reports, templates and layouts over the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CRITICAL, WARN, basename, bytes_short, matches_text, search_rank, severity, severity_rank


def top(df: DataFrame, by: str, k: int = 10, tie: str = "id") -> DataFrame:
    """k rows with the largest `by`, nulls last, ties by `tie`; one pass, k rows a task."""
    return df.orderBy(F.desc_nulls_last(by), tie).limit(k)


def reveal(df: DataFrame, order: list, step: int = 8, page: int = 1) -> DataFrame:
    """The first `page` steps of a list."""
    return df.orderBy(*order).limit(step * page)


def recursive_list(metrics: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """(id, via_fp, peak, hops): recursive functions, certain or possible."""
    d = metrics.filter("recursive").select("id", F.col("recursive_via_fp").alias("via_fp"), "peak")
    return d.join(cycles.select("id", "hops"), "id", "left") if cycles is not None else d.withColumn("hops", F.lit(None).cast("int"))


def unbound_sites(sites: DataFrame, metrics: DataFrame) -> DataFrame:
    """(id, sites, peak): functions with call sites that no rule binds, heaviest first."""
    n = sites.groupBy("id").agg(F.count_if(~F.col("overridden")).alias("sites")).filter("sites > 0")
    return n.join(metrics.select("id", "peak"), "id", "left").orderBy(F.desc_nulls_last("peak"), "id")


def root_lists(per_root: DataFrame, by: str = "depth") -> DataFrame:
    """per_root with rank: each function's roots, deepest first ("peak": heaviest first)."""
    keys = [F.desc("depth"), "root"] if by == "depth" else [F.desc("peak"), F.desc("depth"), "root"]
    return per_root.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*keys)))


def worst_root(per_root: DataFrame) -> DataFrame:
    """(id, root, more): the first root of each list and how many follow; a map-side minimum."""
    return per_root.groupBy("id").agg(F.min_by("root", F.struct(-F.col("depth"), F.col("root"))).alias("root"), (F.count("*") - 1).alias("more"))


def first_roots(per_root: DataFrame, k: int = 6) -> DataFrame:
    """(id, roots): `a(d5), b(d3), ... +N more`; only the first k roots are gathered."""
    r = root_lists(per_root)
    n = r.groupBy("id").agg(F.count("*").alias("n"))
    head = r.filter(F.col("rank") <= k).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "root", "depth"))), lambda x: F.concat(x.root.cast("string"), F.lit("(d"), x.depth.cast("string"), F.lit(")"))), ", ").alias("h"))
    return head.join(n, "id").select("id", F.when(F.col("n") > k, F.concat("h", F.lit(" +"), (F.col("n") - k).cast("string"), F.lit(" more"))).otherwise(F.col("h")).alias("roots"))


def search(df: DataFrame, query: str, name: str = "name", cap: int = 200) -> DataFrame:
    """Names equal to, starting with, or holding the query, each in order of name; all if empty."""
    if not query:
        return df.orderBy(name).limit(cap)
    return df.withColumn("rank", search_rank(name, query)).filter("rank is not null").orderBy("rank", name, *[c for c in df.columns if c != name][:1]).limit(cap)


def filter_list(df: DataFrame, query: str, *cols: str) -> DataFrame:
    return df.filter(matches_text(query, *cols))


def cli_rows(functions: DataFrame, metrics: DataFrame, calls: DataFrame, roots_only: bool = False, order: str = "ord", warn: int = WARN, critical: int = CRITICAL) -> DataFrame:
    """One row a function, heaviest first, nulls last, then in order of definition."""
    c = calls.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "dst"))), lambda x: x.dst.cast("string")), ";").alias("callees")).withColumnRenamed("src", "id")
    d = functions.join(metrics, "id").join(c, "id", "left")
    if roots_only:
        d = d.filter("is_pinned_root or is_auto_root")
    return d.select("id", "name", "file", (F.col("line0") + 1).alias("line") if "line0" in functions.columns else F.lit(None).cast("int").alias("line"), "frame", "peak", "bounded", severity("peak", warn, critical).alias("severity"), "recursive", "depth", F.coalesce("callees", F.lit("")).alias("callees"), F.col(order).alias("ord")).orderBy(F.desc_nulls_last("peak"), "ord")


def report_rows(functions: DataFrame, metrics: DataFrame, per_root: DataFrame, roots_only: bool = True, warn: int = WARN, critical: int = CRITICAL) -> DataFrame:
    """One row a function and root, worst severity first. A function's row of its own root has the
    kind `self`; with roots_only only those rows are left. A root without rows stands for itself as
    `(auto)`; a function that no root reaches has one row, `(unreached)`."""
    f = functions.join(metrics, "id")
    line = F.col("line0") + 1 if "line0" in functions.columns else F.lit(None).cast("int")
    qualifier = F.col("qualifier") if "qualifier" in functions.columns else F.lit(None).cast("string")
    p = per_root.select("id", F.col("root").alias("__root"), F.when(F.col("root") == F.col("id"), "self").when(F.col("is_pinned"), "pinned").otherwise("auto").alias("root_kind"), F.col("peak").alias("rp"), F.col("bounded").alias("rb"))
    own = F.col("is_pinned_root") | F.col("is_auto_root")
    d = f.join(p, "id", "left").join(functions.select(F.col("id").alias("__root"), F.col("file").alias("root_file")), "__root", "left")
    if roots_only:
        d = d.filter(own).filter("__root is null or root_kind = 'self'")
    unseen = F.when(own, "auto").otherwise("unreached")
    pk = F.coalesce("rp", "peak")
    ghost = F.col("ghost") if "ghost" in functions.columns else F.lit(False)
    d = d.select(
        "id", "name", "file", line.alias("line"), qualifier.alias("own_qualifier"), F.coalesce(F.col("__root").cast("string"), F.concat(F.lit("("), unseen, F.lit(")"))).alias("root"), F.coalesce("root_kind", unseen).alias("root_kind"), "root_file",
        F.greatest(F.col("down_depth") - 1, F.lit(0)).alias("depth"), F.col("frame").alias("own_frame"), pk.alias("peak"), F.coalesce("rb", "bounded").alias("bounded"), "recursive", F.coalesce(ghost, F.lit(False)).alias("ghost"), severity(pk, warn, critical).alias("severity"),
    )
    return d.orderBy(F.desc(severity_rank("peak", warn, critical)), F.desc_nulls_last("peak"), "name", "root")


def report_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warn").alias("warn"), F.count_if("bounded").alias("bounded"),
        F.countDistinct(F.when(F.col("recursive"), F.col("id"))).alias("recursive"), F.countDistinct(F.when(F.col("ghost"), F.col("id"))).alias("ghosts"),
    )


def cards(metrics: DataFrame, warn: int = WARN, critical: int = CRITICAL) -> DataFrame:
    s = severity("peak", warn, critical)
    return metrics.agg(F.count_if(s == "critical").alias("critical"), F.count_if(s == "warn").alias("warning"), F.count_if("recursive").alias("recursive"), F.count("*").alias("functions"))


def run_summary(functions: DataFrame, roots: DataFrame) -> DataFrame:
    return functions.agg(F.count("*").alias("functions"), F.count("frame").alias("with_stack")).crossJoin(roots.agg(F.count_if("is_pinned").alias("pinned_roots")))


def template(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, coverage): an entry for each call site that no rule binds, by caller and via, and
    the counts of unresolved and covered sites."""
    per = F.count("*").over(Window.partitionBy("caller"))
    entries = sites.withColumn("of_caller", per).filter(~F.col("overridden"))
    entries = entries.select(F.concat(F.lit("bind targets of "), F.col("via")).alias("_hint"), "caller", basename("file").alias("file"), F.when(F.col("of_caller") > 1, F.col("via")).alias("via"), F.array().cast("array<string>").alias("targets")).orderBy("caller", "via")
    return entries, sites.agg(F.count_if(~F.col("overridden")).alias("unresolved"), F.count_if("overridden").alias("covered"))


def fan(calls: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) over distinct edges."""
    e = calls.select("src", "dst").distinct()
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out")).join(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in")), "id", "full").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def layout(nodes: DataFrame, by_file: bool = False, gap: int = 1) -> DataFrame:
    """Position of each node(id, layer, file, peak) in its layer: heaviest first; by_file keeps a
    file's nodes together, files by their heaviest node, with a gap where the file changes."""
    p = F.coalesce("peak", F.lit(0))
    if not by_file:
        return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc(p), "id")) - 1)
    d = nodes.withColumn("fmax", F.max(p).over(Window.partitionBy("layer", "file")))
    o = Window.partitionBy("layer").orderBy(F.desc("fmax"), "file", F.desc(p), "id")
    change = F.coalesce((F.lag("file").over(o) != F.col("file")).cast("int"), F.lit(0))
    d = d.withColumn("__c", change).withColumn("pos", F.row_number().over(o) - 1 + gap * F.sum("__c").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return d.drop("__c", "fmax")


def file_boxes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("file", "layer").agg(F.min("pos").alias("top"), F.max("pos").alias("bottom"), F.count("*").alias("n"))


def layer_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("layer").agg(F.count("*").alias("n"))


def default_focus(functions: DataFrame, metrics: DataFrame, order: str = "ord") -> DataFrame:
    """(id): the heaviest function that is no ghost, the first on ties."""
    d = functions.join(metrics.select("id", "peak"), "id")
    if "ghost" in functions.columns:
        d = d.filter(~F.coalesce("ghost", F.lit(False)))
    return d.agg(F.min_by("id", F.struct(-F.coalesce("peak", F.lit(0)), F.col(order))).alias("id"))


def drawable(edges: DataFrame) -> DataFrame:
    """Edges(src, dst, lf, lt, on_focus, recursive) a layered drawing shows."""
    return edges.filter(((F.col("src") == F.col("dst")) | (F.col("lf") != F.col("lt"))) & (F.col("on_focus") | F.col("recursive")))


def hover(functions: DataFrame, metrics: DataFrame) -> DataFrame:
    return functions.join(metrics, "id").select("id", F.concat_ws("\n", F.col("name"), F.col("file"), F.concat(F.lit("frame "), bytes_short("frame")), F.concat(F.lit("peak "), bytes_short("peak"), F.when(F.col("bounded"), F.lit("+")).otherwise(F.lit("")))).alias("text"))


def frequent_messages(log: DataFrame, cap: int = 20) -> DataFrame:
    """(category, shown, hidden): repeated messages beyond a cap are only counted."""
    return log.groupBy("category").agg(F.count("*").alias("n")).select("category", F.least("n", F.lit(cap)).alias("shown"), F.greatest(F.col("n") - cap, F.lit(0)).alias("hidden"))
