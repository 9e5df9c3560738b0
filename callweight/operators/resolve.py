"""Keys, callee resolution, frames and ghosts: from facts to the resolved graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare, stem


def display_keys(functions: DataFrame, mode: str = "ordinal", name: str = "name", file: str = "file", order: str = "ord") -> DataFrame:
    """functions with a column key: the name where it is unique, else name@stem for every homonym.

    Homonyms of equal stems collide. mode "ordinal" adds ~2, ~3 ... by order to all but the first;
    "compat" keeps one key and, of the rows that share it, the last.
    """
    d = functions.withColumn("__s", stem(file)).withColumn("__n", F.count("*").over(Window.partitionBy(name)))
    d = d.withColumn("key", F.when(F.col("__n") > 1, F.concat_ws("@", F.col(name), F.col("__s"))).otherwise(F.col(name)))
    if mode == "compat":
        last = Window.partitionBy("key").orderBy(F.desc(order))
        return d.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__s", "__n", "__r")
    r = F.row_number().over(Window.partitionBy("key").orderBy(order))
    d = d.withColumn("__r", r)
    return d.withColumn("key", F.when(F.col("__r") > 1, F.concat("key", F.lit("~"), F.col("__r"))).otherwise(F.col("key"))).drop("__s", "__n", "__r")


def resolve_names(raw: DataFrame, functions: DataFrame) -> DataFrame:
    """raw(src, src_file, callee, ...) with dst, the function each call goes to.

    Calls go by bare name; among homonyms one of the caller's file wins, then the earliest
    definition. Calls to undefined names drop out. Both joins meet one row a key, so a name with
    many definitions and many calls multiplies nothing.
    """
    near = functions.groupBy(F.col("name").alias("callee"), F.col("file").alias("src_file")).agg(F.min_by("id", "ord").alias("__near"))
    far = functions.groupBy(F.col("name").alias("callee")).agg(F.min_by("id", "ord").alias("__far"))
    d = raw.join(far, "callee").join(near, ["callee", "src_file"], "left")
    return d.withColumn("dst", F.coalesce("__near", "__far")).drop("__near", "__far")


def resolve_calls(raw: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst, seq): raw(src, src_file, callee, seq) against functions(id, name, file, ord); a
    callee named twice keeps its first place."""
    return resolve_names(raw, functions).groupBy("src", "dst").agg(F.min("seq").alias("seq"))


def callee_lists(calls: DataFrame) -> DataFrame:
    """(src, callees): distinct callees in order of first call."""
    first = calls.groupBy("src", "dst").agg(F.min("seq").alias("seq"))
    return first.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "dst"))), lambda x: x.dst).alias("callees"))


def attach_frames(functions: DataFrame, by_name: DataFrame, by_file: DataFrame) -> DataFrame:
    """functions with frame and qualifier: the entry of its own file first, else of its name."""
    f = functions.withColumn("__stem", stem("file"))
    q = by_file.select(F.col("stem").alias("__stem"), F.col("func").alias("name"), F.col("bytes").alias("__b1"), F.col("qualifier").alias("__q1"))
    n = by_name.select(F.col("func").alias("name"), F.col("bytes").alias("__b2"), F.col("qualifier").alias("__q2"))
    j = f.join(q, ["__stem", "name"], "left").join(n, "name", "left")
    return j.select(*[c for c in functions.columns if c not in ("frame", "qualifier")], F.coalesce("__b1", "__b2").alias("frame"), F.coalesce("__q1", "__q2").alias("qualifier"))


def ghosts(functions: DataFrame, by_name: DataFrame) -> DataFrame:
    """Frames of names that no function has: (id, name, file, frame, qualifier, ghost)."""
    g = by_name.join(functions.select(F.col("name").alias("func")), "func", "left_anti").join(functions.select(F.col("id").alias("func")), "func", "left_anti")
    return g.select(F.col("func").alias("id"), F.col("func").alias("name"), "file", F.col("bytes").alias("frame"), "qualifier", F.lit(True).alias("ghost"))


def files_of(functions: DataFrame) -> DataFrame:
    """(file, ids): functions of each file."""
    return functions.groupBy("file").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def at_definition(functions: DataFrame, file: str, name: str, line0: int) -> DataFrame:
    return functions.filter((F.col("file") == file) & (F.col("name") == name) & (F.col("line0") == line0))


def under_cursor(functions: DataFrame, word: str) -> DataFrame:
    """Functions that a word of a source may mean: those of that key, else of that name."""
    return functions.filter((F.col("id") == word) | (F.col("name") == word))


def last_of_name(functions: DataFrame, order: str = "ord") -> DataFrame:
    """One record a name: the last."""
    return functions.groupBy("name").agg(F.max_by(F.struct(*functions.columns), order).alias("r")).select("r.*")


def bare_names(functions: DataFrame) -> DataFrame:
    return functions.withColumn("bare", bare("id"))
