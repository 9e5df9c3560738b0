"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  # labelled rows a classifier learns from at most


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled ids, one document each, drawn by hash from
    all labels that may be learned from; the same rows on every run. Ids with a null id or label are
    left out, ids with several labels take the largest, ids with several texts the one with the
    least hash. The label side is bounded by `rows`, so it is broadcast.
    """
    y = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).filter(~F.coalesce(held_out, F.lit(False)))
    y = y.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return d.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("one")).select("doc_id", "one.*")
