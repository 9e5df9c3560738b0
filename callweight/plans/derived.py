"""Graphs derived from the star schema: parts are functions, consecutive parts of an order call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixpoint import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("decl_file"), (16 + 8 * F.col("p_size")).cast("long").alias("frame"), F.col("p_partkey").alias("ord"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, f, n): f = least return flag, n = how often."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(o).alias("dst"), "l_returnflag").filter("dst is not null")
    return e.groupBy("src", "dst").agg(F.min("l_returnflag").alias("f"), F.count("*").alias("n"))


def _numbered(e: DataFrame) -> DataFrame:
    """Calls of each function in order of the callee."""
    seq = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return e.select("src", "dst", seq.alias("seq"), (F.col("f") == "R").alias("indirect"))


def _ends(spark: SparkSession, sf_dir: str, *what: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("layer", F.substring("p_brand", 7, 9).cast("int"))
    side = lambda end, x: p.select(F.col("p_partkey").alias(end), *(F.col(c).alias(x + c) for c in what))
    return raw_edges(spark, sf_dir).join(side("src", "a_"), "src").join(side("dst", "b_"), "dst")


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls inside a family (part type) from a layer (brand number) to a later one: no cycle.
    A table of its own: whoever reads it twice does not derive it twice."""
    e = _ends(spark, sf_dir, "p_type", "layer").filter("a_p_type = b_p_type and a_layer < b_layer")
    return durable(_numbered(e))


def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls inside a file (brand): components of all shapes."""
    return durable(_numbered(_ends(spark, sf_dir, "p_brand").filter("a_p_brand = b_p_brand")))


CTE = """
V AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS decl_file, CAST(16 + 8 * p_size AS BIGINT) AS frame FROM part),
X AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_returnflag FROM lineitem),
E_raw AS (SELECT src, dst, min(l_returnflag) AS f, count(*) AS n FROM X WHERE dst IS NOT NULL GROUP BY src, dst),
E_ends AS (SELECT e.*, a.p_type = b.p_type AND CAST(substr(a.p_brand, 7) AS INTEGER) < CAST(substr(b.p_brand, 7) AS INTEGER) AS down, a.p_brand = b.p_brand AS inner_ FROM E_raw e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst),
E_dag AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS seq, f = 'R' AS indirect FROM E_ends WHERE down),
E_cyc AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS seq, f = 'R' AS indirect FROM E_ends WHERE inner_)
"""
