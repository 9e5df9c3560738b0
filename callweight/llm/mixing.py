"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot i of the schedule draws the point frac((i + 1) * golden ratio) and gives the slot to the source whose
share of [0, 1) holds the point, so every prefix of the schedule is close to the target shares.
A source's r-th slot takes block r modulo its block count of its own shuffled documents; blocks
of a source hold equally many words and a document may lie in several. The slot at which a block is
due is where its documents stand in the mix, so every prefix of the mix is near the target shares
too; only the last slots of a source, at most what the schedule's rounding leaves, are settled to
its target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import Scratch, numbered, parts_for, sub_buckets

WORD = "[^ \\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
GOLDEN = 0.6180339887498949
CHUNK = 1 << 16
SLOTS = 1000  # blocks a source is cut into at least
MAX_SOURCES = 10_000  # one row each is on the driver and in every task


def n_words(text):
    """Number of words of a text column; null gives 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple]:
    """(source, size, target) from (source, size): weights repeat over the sources by code point,
    null last; what exceeds most * size is shared again by weight until none is above."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    want, open_ = [0.0] * len(rows), [i for i, r in enumerate(rows) if r[1] > 0]
    left = share * sum(r[1] for r in rows)
    while open_:
        per = left / sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * per > most * rows[i][1]]
        if not over:
            for i in open_:
                want[i] = w[i] * per
            break
        for i in over:
            want[i] = most * rows[i][1]
            left -= want[i]
        open_ = [i for i in open_ if i not in set(over)]
    return [(r[0], int(r[1]), float(t)) for r, t in zip(rows, want, strict=True)]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int | None = None, seed: int = 17) -> DataFrame:
    """Per document: id, size, source_size, target, taken, first_slot.

    first_slot is the schedule's slot at which the document is taken first, null if it is not.

    One row a source is gathered; more than MAX_SOURCES sources are refused, and what travels to
    every task is bounded by that. Nulls: a null source is a source of its own, a null text has no words.
    Empty and wordless texts are never taken. Repeated rows are separate documents. An empty
    table gives no rows. `block` is the words in a block; by default a 20,000th of all words,
    from 8 to 4096, and in every source a 1,000th of its words at most. A source's taken words are
    its target, rounded, at every size. Reruns agree: shuffling
    and points depend on ids, texts and `seed` only.
    """
    placed, _, _ = _mix(docs, id_col, text, source, weights, share, most, block, seed)
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "first_slot")


def _mix(docs: DataFrame, id_col: str, text: str, source: str, weights, share: float, most: float, block: int | None, seed: int) -> tuple[DataFrame, int, DataFrame]:
    """(documents, slots, ranked): documents(id, src, size, source_size, target, taken, first_slot,
    first_block, n_blocks), the number of slots, and ranked(src, rank, slot), the slot of each
    source's r-th block."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("src"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text)).alias("mixkey"))
    d = Scratch(spark, "mix").keep(d)  # no texts from here on
    sizes = d.groupBy("src").agg(F.sum("size")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets([tuple(r) for r in sizes], weights, share, most)
    total = sum(g[1] for g in goal)
    block = block or min(4096, max(8, total // 20_000))
    table = []
    for s, size, want in goal:
        own = min(block, max(1, size // SLOTS))
        due, n_blocks = min(int(want + 0.5), int(most * size)), max(1, -(-size // own))
        passes, rest = divmod(due, size) if size else (0, 0)
        table.append((s, size, want, own, rest, passes * n_blocks - (-rest // own), n_blocks))
    slots = sum(t[5] for t in table)
    bounds = np.cumsum([t[5] / max(1, slots) for t in table])  # where each source's share of [0, 1) ends
    table = [(*t, k) for k, t in enumerate(table)]
    sources = F.broadcast(spark.createDataFrame(table, "src string, source_size long, target double, block long, rest long, due long, n_blocks long, at_source int"))  # one row a source

    @F.pandas_udf("int")
    def drawn(u: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(bounds, u.to_numpy(), "right"), len(bounds) - 1).astype(np.int32))

    # Schedule: slot -> source, then its rank among the source's slots, chunk by chunk.
    i = F.col("i")
    point = (i + 1) * F.lit(GOLDEN)
    sched = spark.range(0, slots, numPartitions=parts_for(slots, CHUNK)).withColumnRenamed("id", "i").withColumn("at_source", drawn(point - F.floor(point)))
    sched = sched.join(sources, "at_source").withColumn("chunk", F.floor(i / CHUNK))
    ahead = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = sched.groupBy("src", "chunk").agg(F.count("*").alias("c")).withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0))).drop("c")
    ranked = sched.alias("s").join(per.alias("p"), F.col("s.src").eqNullSafe(F.col("p.src")) & (F.col("s.chunk") == F.col("p.chunk"))).select("s.*", (F.row_number().over(Window.partitionBy("s.src", "s.chunk").orderBy("i")) - 1 + F.col("p.ahead")).alias("rank"))
    # A source gives its due slots exactly: what the schedule gives beyond them is left, what it
    # lacks follows, and the last slot ends inside its block, at `rest`.
    have = sched.groupBy("src").agg(F.count("*").alias("have"))
    late = sources.alias("s").join(have.alias("h"), F.col("s.src").eqNullSafe(F.col("h.src")), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < due")
    late = late.select("s.src", "s.rest", "s.n_blocks", "have", F.explode(F.sequence("have", F.col("due") - 1)).alias("rank")).withColumn("slot", F.lit(slots) + F.col("rank") - F.col("have"))
    ranked = ranked.filter("rank < due").select("src", "rest", "n_blocks", "rank", F.col("i").alias("slot")).union(late.select("src", "rest", "n_blocks", "rank", "slot"))
    blocks = ranked.groupBy("src", "rest", (F.col("rank") % F.col("n_blocks")).alias("b")).agg(F.count("*").alias("times"), F.min("slot").alias("slot"))

    # Documents on their source's shuffled line of words, cut into blocks.
    placed = numbered(d, ["src"], ["mixkey", "id"], key=F.col("mixkey"), parts=sub_buckets(d), name="at", weight=F.col("size"))
    cut = placed.filter(F.col("size") > 0).alias("p").join(sources.alias("s"), F.col("p.src").eqNullSafe(F.col("s.src"))).select("p.src", "id", "mixkey", "at", "size", "block", F.explode(F.sequence(F.floor(F.col("at") / F.col("block")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")))).alias("b"))
    end = F.least(F.col("at") + F.col("size"), (F.col("c.b") + 1) * F.col("block"))
    over = end - F.greatest(F.col("at"), F.col("c.b") * F.col("block"))
    beyond = F.when((F.col("rest") > F.col("c.b") * F.col("block")) & (F.col("rest") < (F.col("c.b") + 1) * F.col("block")), F.greatest(F.lit(0), end - F.greatest("at", "rest"))).otherwise(0)
    got = cut.alias("c").join(blocks.alias("k"), F.col("c.src").eqNullSafe(F.col("k.src")) & (F.col("c.b") == F.col("k.b"))).groupBy(F.col("c.src").alias("src"), "id", "mixkey", "at").agg(F.sum(over * F.col("times") - beyond).alias("taken"), F.min(F.when(over * F.col("times") > beyond, F.col("slot"))).alias("slot"))
    out = placed.alias("d").join(got.alias("g"), F.col("d.src").eqNullSafe(F.col("g.src")) & F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.at") == F.col("g.at")), "left")
    out = out.join(sources.alias("s"), F.col("d.src").eqNullSafe(F.col("s.src")), "left")
    taken = F.coalesce(F.col("g.taken"), F.lit(0)).cast("long")
    first = F.floor(F.col("d.at") / F.col("s.block"))
    out = out.select(F.col("d.id").alias("id"), F.col("d.src").alias("src"), F.col("d.size").alias("size"), F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), taken.alias("taken"), F.when(taken > 0, F.col("g.slot")).alias("first_slot"), first.alias("first_block"), F.col("s.n_blocks").alias("n_blocks"))
    return out, slots, ranked.select("src", "rank", "slot")


def realise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int | None = None, seed: int = 17) -> DataFrame:
    """The mix as rows, in the order of the schedule: every document as often as its words are
    taken, with all its columns.

    A document taken for t of its s words appears floor(t / s) times and once more with the chance
    of the remainder, drawn from its id by hash, so sources stay near their targets and reruns
    agree. Its n-th row stands at the slot of its first block in the source's n-th pass; partitions
    follow each other by slot, and rows inside them do, so any prefix of the mix is near the target
    shares. Rows that share an id, null ids too, share the decision; null, empty and wordless texts
    are not taken. An empty table gives no rows; no column of docs can clash.
    """
    placed, slots, ranked = _mix(docs, id_col, text, source, weights, share, most, block, seed)
    plan = placed.groupBy("id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), F.min_by(F.struct("src", "first_block", "n_blocks"), F.struct(F.coalesce("first_slot", F.lit(1 << 62)), "first_block", "src")).alias("at")).filter("t > 0")
    part = F.col("t") / F.col("s")
    draw = F.pmod(F.xxhash64(F.lit(23), "id"), F.lit(1 << 20)) / (1 << 20)
    times = (F.floor(part) + (draw < part - F.floor(part)).cast("int")).cast("int")
    plan = plan.withColumn("times", times).filter("times > 0").select("id", "at.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    plan = plan.withColumn("rank", F.col("pass") * F.col("n_blocks") + F.col("first_block")).alias("p").join(ranked.alias("r"), F.col("p.src").eqNullSafe(F.col("r.src")) & (F.col("p.rank") == F.col("r.rank")), "left")
    # a pass that the source's target ends in has no slot for its last blocks: their rows come last
    plan = plan.select("p.id", F.coalesce("r.slot", F.lit(slots) + F.col("p.rank")).alias("slot")).groupBy("id").agg(F.array_sort(F.collect_list("slot")).alias("slots"))  # `most` slots a document and one
    plan = plan.select(F.struct("id", "slots").alias("plan"))
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc")).join(plan, F.col("doc")[id_col].eqNullSafe(F.col("plan")["id"]), "inner")
    out = out.select("doc", F.explode("plan.slots").alias("slot"))
    return out.repartitionByRange("slot", F.xxhash64(F.col("doc")[id_col])).sortWithinPartitions("slot", F.col("doc")[id_col]).select("doc.*")
