"""How five text filters interact: a histogram of failure masks and all orders of the filters.

Each document gets a five-bit mask of the filters it fails, by native expressions. What is counted
is one cell for each (part, mask); every order of the filters is then played on the at most 32
cells of a part, so no document is looked at again.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import Scratch

FILTERS = "ABCDE"
MIN_WORDS = 50
SPACES = "[ \\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3, of filters A to D, for a text that is not null."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))
    fails = [n < MIN_WORDS, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"), F.regexp_like(text, F.lit(MARKS))]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents that agree in all four, still in several rows.

    The text is identical to one of a smaller id (bit 4) where its id is not the least of its text.
    Texts are compared by SHA-256, hashed on the spot, so no text moves; the least id of a text is a
    minimum with partial sums, and it meets the documents on (text, id), so a text that
    a third of all rows share is no hot key.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("h"), text_mask(t).alias("low"))
    d = Scratch(docs.sparkSession, "masks").keep(d)  # no texts from here on
    least = d.groupBy("h").agg(F.min("id").alias("id")).select("h", "id", F.lit(True).alias("first"))
    y = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = d.groupBy("id", "h", "part", "low").agg(F.count("*").alias("n")).join(least, ["h", "id"], "left").join(y, "id", "left")
    repeat = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.select("part", (F.col("low") + F.when(repeat, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row, zeros included, for each part, order of the five filters and step. A null text is
    empty; a null part and an empty one are the same part. A row with a null id is never a repeat
    and makes no other row one. Rows that repeat an id and a text are no repeats of each other; each
    counts. A document is good or toxic if any of its labels says so; null labels say nothing. An
    empty table gives no rows. Extra columns are ignored.
    """
    counts = masks(docs, labels, id_col, text, part).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.get(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.ascii(c) - ord("A")))
    steps = steps.withColumn("own", F.get(bits, F.col("step") - 1)).withColumn("before", F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b)))

    def total(which, value="n"):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(which(c["mask"]), c[value]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # A filter comes first of the s filters that a document fails in a share 1 / s of all orders.
    shares = F.transform("cells", lambda c: c["n"] * F.when(fails(c["mask"]), (F.lit(factorial(len(FILTERS))) / F.greatest(F.bit_count(c["mask"]), F.lit(1))).cast("long")).otherwise(0))
    share = F.aggregate(shares, F.lit(0).cast("long"), lambda a, s: a + s)
    return steps.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~gone(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )
