"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ann import nearest_sharing
from .audit import filter_audit
from .centroids import cluster_vectors
from .decontam import leaks
from .html import extract
from .jaccard import near_duplicates
from .lm import score_documents
from .mixing import mix_sources
from .media import media_digests
from .passages import repeated_passages
from .quality import score_documents as score_quality
from .scale import tables
from .shards import shard_documents
from .toxicity import score_documents as score_toxicity


def op1_quality(spark, sf_dir):
    return score_quality(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"), crc_is(4, 2))


def op2_sharding(spark, sf_dir):
    return shard_documents(tables(spark, sf_dir, "documents"))


def crc_is(mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string")) % mod == rest


def op3_lm_scoring(spark, sf_dir):
    return score_documents(tables(spark, sf_dir, "documents"), crc_is(7, 2))


def op4_substring_dedup(spark, sf_dir):
    return repeated_passages(tables(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark, sf_dir):
    return near_duplicates(tables(spark, sf_dir, "documents"))


def op7_ann(spark, sf_dir):
    return nearest_sharing(tables(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark, sf_dir):
    return extract(tables(spark, sf_dir, "pages"))


def op9_mixing(spark, sf_dir):
    return mix_sources(tables(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return score_toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"), crc_is(3, 1))


def op11_flac(spark, sf_dir):
    return media_digests(tables(spark, sf_dir, "documents"))


def op12_centroids(spark, sf_dir):
    return cluster_vectors(tables(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT doc_id, md5(unnest(s)) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT n.doc_id, n.n AS n_shingles, min(r.u) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY ALL
"""


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
y AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 50 AS INT) AS A, CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) AS B,
    CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) AS C, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS D, CAST(coalesce(again, false) AS INT) AS E
  FROM d LEFT JOIN y USING (doc_id)),
o AS (SELECT c AS o FROM unnest(['A', 'B', 'C', 'D', 'E']) AS x(c) UNION ALL SELECT o || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS x(c) WHERE length(o) < 5 AND NOT contains(o, c)),
c AS (SELECT part, A, B, C, D, E, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
m AS (SELECT part, n, good, toxic, map {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} AS m, A + B + C + D + E AS fails FROM c),
s AS (
  SELECT part, o AS filter_order, step, substr(o, step, 1) AS x, n, good, toxic, fails, m[substr(o, step, 1)] AS own,
    len(list_filter(range(1, step), lambda i: m[substr(o, i, 1)] = 1)) > 0 AS gone
  FROM m, o, range(1, 6) AS r(step) WHERE length(o) = 5),
t AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN own = 0 AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own = 1 AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN own = 1 AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN own = 1 AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own = 1 AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""


def _rounds(n: int) -> str:
    """CTEs a0, c1, a1, ... cn, an: assign all vectors, move the centroids, n times, and assign."""
    out = []
    for r in range(n + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT r, vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
  SELECT v.r, v.vec_id, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS d FROM v, c{r} c) GROUP BY r, vec_id)""")
        if r < n:
            out.append(f"""s{r} AS (SELECT j, p, count(*) AS n, sum(x) AS s FROM (SELECT a.j, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS p FROM a{r} a JOIN v ON v.r = a.r) GROUP BY j, p),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM s{r} GROUP BY j) m ON m.j = c.j)""")
    return ",\n".join(out)


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT j, v FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v FROM v) WHERE j < 8),
{_rounds(10)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a10 a JOIN c10 c ON c.j = a.j
"""


def oracle_sql():
    return {"op12_centroids": OP12_SQL, "op6_ngram_join": OP6_SQL, "op7_ann": OP7_SQL, "op13_filter_audit": OP13_SQL}
