"""The pipeline's stages, each judged on its own input."""

import os

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as P
from callweight.llm import entries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    before = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert before > sizes[0] > sizes[1] >= sizes[2] and sizes[3] > sizes[2] and sizes[4] == sizes[3]
    assert docs.filter("shard is null or shard < 0 or shard > 15").isEmpty()
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    lost = good.join(spark.read.parquet(str(tmp_path / "quality")), "doc_id", "left_anti").count()
    assert lost <= 0.03 * good.count()


def test_run_leaves_one_table(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    left = lambda: {x for x in os.listdir(folder) if x.startswith(("near-", "kept-", "clean-", "leaks-", "mix-", "classes-", "pipeline-"))}
    before = left()
    out = P.run(spark, SF)
    assert out.count() > 0 and out.columns == [*spark.read.parquet(f"{SF}/documents.parquet").columns, "shard"]
    new = left() - before
    assert len(new) == 1 and next(iter(new)).startswith("pipeline-") and os.listdir(f"{folder}/{next(iter(new))}") == ["3"]
    again = P.run(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "b", None), (3, " \t", "en", "a", 3), (4, "one two", "en", "a", 3), (5, "one two", "en", "a", 3), (5, "one two", "en", "a", 3), (None, "x y z", "en", "a", 5), (None, None, None, None, None), (8, "w " * 50_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("times", "n", "doc", "row", "plan", "id", "t", "s", "bad", "score", "component_id", "size", "copy", "__id"):
        docs = docs.withColumn(c, F.lit("clash"))
    want = {"near_duplicates": {1, 2, 3, 4, 8, None}, "decontamination": {1, 2, 3, 4, 5, 8, None}, "sharding": {1, 2, 3, 4, 5, 8, None}}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert [c for c in out.columns if c != "shard"] == docs.columns, name
        got = out.collect()
        assert all(r["times"] == r["__id"] == "clash" for r in got), name
        if name in want:
            assert {r.doc_id for r in got} == want[name], name
        if name == "mixing":
            assert not {1, 2, 3} & {r.doc_id for r in got}
        if name == "quality":
            texts = {r.text for r in got}
            assert all((r[1] in texts) == (sum(x.text == r[1] for x in got) == sum(x[1] == r[1] for x in rows)) for r in rows)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entries.oracle_sql().items():
        rel = con.sql(sql)
        cols = sorted(rel.columns)
        want = sorted(tuple(str(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
        got = entries.queries()[name](spark, SF)
        assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == want, name
