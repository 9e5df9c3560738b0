"""Registered queries: every operator applied to whole tables, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import program
from ..functions import scalars as S
from ..operators import delta, explore, metrics, resolve, rules, views
from ..sources import readers
from ..streaming import incremental
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a query by its name; graph queries get the derived graph in front of their SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if not graph:
                ORACLES[f.__name__] = body
            elif body.upper().startswith("WITH "):
                ORACLES[f.__name__] = "WITH RECURSIVE " + D.CTE.strip() + ", " + body[5:]
            else:
                ORACLES[f.__name__] = "WITH RECURSIVE " + D.CTE.strip() + " " + body
        return f

    return add


def long(c):
    return F.col(c).cast("long").alias(c)


def frames(spark, sf):
    li = D.table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").cast("string").alias("func"), (F.col("l_quantity").cast("long") * 16).alias("bytes"), F.lit("static").alias("qualifier"), F.concat(F.lit("src/u"), F.col("l_suppkey"), F.lit(".c")).alias("file"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_returnflag") != "N").alias("returned"))


# Sources.


FRAME_ROWS = "R AS (SELECT CAST(l_partkey AS VARCHAR) AS func, 'u' || CAST(l_suppkey AS VARCHAR) AS stem, 'src/u' || CAST(l_suppkey AS VARCHAR) || '.c' AS file, CAST(l_linenumber AS INTEGER) AS line, CAST(l_quantity AS BIGINT) * 16 AS bytes FROM lineitem)"


@query(f"WITH {FRAME_ROWS}, O AS (SELECT *, row_number() OVER (PARTITION BY func ORDER BY bytes DESC, file, line) AS r FROM R) SELECT func, bytes, file, line FROM O WHERE r = 1", graph=False)
def frame_max_by_func(spark, sf):
    return readers.frame_index(frames(spark, sf))[0].select("func", "bytes", "file", "line")


@query(f"WITH {FRAME_ROWS}, O AS (SELECT *, row_number() OVER (PARTITION BY stem, func ORDER BY bytes DESC, file, line) AS r FROM R) SELECT stem, func, bytes, line FROM O WHERE r = 1", graph=False)
def frame_max_by_file_func(spark, sf):
    return readers.frame_index(frames(spark, sf))[1].select("stem", "func", "bytes", "line")


@query("SELECT CAST(l_partkey AS VARCHAR) AS func, CAST(l_quantity AS BIGINT) * 16 AS bytes, 'static' AS qualifier, 'src/u' || CAST(l_suppkey AS VARCHAR) || '.c' AS file, CAST(l_linenumber AS INTEGER) AS line FROM lineitem", graph=False)
def frame_line_parse(spark, sf):
    t = frames(spark, sf).select(F.concat_ws("\t", F.concat_ws(":", "file", "line", F.lit("5"), "func"), F.col("bytes").cast("string"), "qualifier").alias("value"))
    return readers.parse_frames(t)


@query("""WITH R AS (SELECT l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, l_linenumber % 4 AS shape FROM lineitem)
SELECT 'fn' || CAST(l_partkey AS VARCHAR) AS func, q AS bytes, CASE WHEN shape = 3 THEN '' ELSE 'C:/d/u' || CAST(l_suppkey AS VARCHAR) || '.c' END AS file, CAST(CASE WHEN shape < 2 THEN l_linenumber ELSE 0 END AS INTEGER) AS line, f AS qualifier FROM R""", graph=False)
def frame_shapes(spark, sf):
    li = D.table(spark, sf, "lineitem")
    func, file, shape = F.concat(F.lit("fn"), F.col("l_partkey")), F.concat(F.lit("C:/d/u"), F.col("l_suppkey"), F.lit(".c")), F.col("l_linenumber") % 4
    place = F.when(shape == 0, F.concat_ws(":", file, "l_linenumber", F.lit("9"), func)).when(shape == 1, F.concat_ws(":", file, "l_linenumber", func)).when(shape == 2, F.concat_ws(":", file, func)).otherwise(func)
    gap = F.when(shape == 3, " ").otherwise("\t")
    return readers.parse_frames(li.select(F.concat(place, gap, F.col("l_quantity").cast("long"), gap, "l_returnflag").alias("value")))


@query("SELECT CAST(n AS BIGINT) AS id, 'fn_' || lpad(CAST(n AS VARCHAR), 4, '0') AS name, CAST(CASE WHEN n >= 60 AND n < 260 THEN 32 + 8 * (n % 7) ELSE 16 + (48 * n) % 1600 + CASE WHEN n >= 20 AND n < 60 THEN 512 ELSE 0 END END AS BIGINT) AS frame FROM range(3000) t(n)", graph=False)
def synthetic_topology(spark, sf):
    return readers.synthetic_graph(spark)[0].select(long("id"), "name", "frame")


# Names, predicates, formats.


@query("SELECT id, split_part(name || '@' || file || '@x', '@', 1) AS bare FROM V")
def bare_name(spark, sf):
    return D.nodes(spark, sf).select("id", S.bare(F.concat_ws("@", "name", "file", F.lit("x"))).alias("bare"))


KEYS_SQL = """WITH K AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '@' || file ELSE name END AS k FROM V),
R AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM K)
SELECT id, CASE WHEN r > 1 THEN k || '~' || CAST(r AS VARCHAR) ELSE k END AS key FROM R"""


@query(KEYS_SQL)
def display_key(spark, sf):
    return resolve.display_keys(D.nodes(spark, sf)).select("id", "key")


@query("WITH K AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '@' || file ELSE name END AS key FROM V) SELECT max(id) AS id, key FROM K GROUP BY key")
def display_key_compat(spark, sf):
    return resolve.display_keys(D.nodes(spark, sf), "compat").select("id", "key")


@query("SELECT name, count(*) AS n FROM V GROUP BY name HAVING count(*) > 1")
def key_collisions(spark, sf):
    return D.nodes(spark, sf).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT CASE WHEN frame * 12 IS NULL THEN 'unknown' WHEN frame * 12 <= 1024 THEN 'ok' WHEN frame * 12 <= 4096 THEN 'warn' ELSE 'critical' END AS severity, count(*) AS n FROM V GROUP BY 1")
def severity_buckets(spark, sf):
    return D.nodes(spark, sf).groupBy(S.severity(F.col("frame") * 12).alias("severity")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN frame * 9 < 1024 THEN CAST(frame * 9 AS VARCHAR) || 'B' ELSE printf('%.1fKB', frame * 9 / 1024.0) END AS short,
CASE WHEN frame * frame * 9 < 1024 THEN CAST(frame * frame * 9 AS VARCHAR) || ' B' WHEN frame * frame * 9 < 1048576 THEN printf('%.1f KB', floor(frame * frame * 9 / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(frame * frame * 9 / 1048576.0 * 100 + 0.5) / 100) END AS long FROM V""")
def fmt_bytes(spark, sf):
    n = D.nodes(spark, sf)
    return n.select("id", S.bytes_short(F.col("frame") * 9).alias("short"), S.bytes_long(F.col("frame") * F.col("frame") * 9).alias("long"))


@query("SELECT id, decl_file FROM V WHERE regexp_matches(decl_file, '^(PROMO.*|.*BRUSHED.*)$')")
def glob_pinned_roots(spark, sf):
    return D.nodes(spark, sf).filter(S.matches_globs("decl_file", ["PROMO*", "*BRUSHED*"])).select("id", "decl_file")


@query("SELECT id, name, file FROM V WHERE contains(lower(file), '#1') OR contains(lower(name), '#1')")
def path_filter(spark, sf):
    return views.filter_list(D.nodes(spark, sf), "#1", "file", "name").select("id", "name", "file")


@query("""SELECT id, name, CASE WHEN lower(name) = 'ring' THEN 0 WHEN starts_with(lower(name), 'ring') THEN 1 ELSE 2 END AS rank FROM V
WHERE contains(lower(name), 'ring') ORDER BY 3, 2, 1 LIMIT 200""")
def symbol_search(spark, sf):
    return views.search(D.nodes(spark, sf).select("id", "name"), "ring")


@query("WITH H AS (SELECT id, CAST(id AS VARCHAR) AS s FROM V) SELECT id, CASE WHEN instr(s, '1') > 0 THEN substr(s, 1, instr(s, '1') - 1) || '[1]' || substr(s, instr(s, '1') + 1) ELSE s END AS text FROM H")
def match_highlight(spark, sf):
    return D.nodes(spark, sf).select("id", S.highlight(F.col("id").cast("string"), "1").alias("text"))


@query("""SELECT p_partkey AS id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_brand, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h32 FROM part""", graph=False)
def colour_hash32(spark, sf):
    codes = F.transform(F.filter(F.split("file", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return D.nodes(spark, sf).select("id", F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))).alias("h32"))


@query("""WITH H AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(file, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM V)
SELECT id, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 16 AS INTEGER) AS slot FROM H""")
def color_hash(spark, sf):
    return D.nodes(spark, sf).select("id", S.colour_slot("file").alias("slot"))


@query("SELECT id, '/ws/' || name || '//' || '${config:none}' || '${odd}' AS value FROM V")
def expand_vars(spark, sf):
    v = F.concat(F.lit("${workspaceFolder}/"), F.col("name"), F.lit("/${env:NOT_SET}/${config:none}${odd}"))
    return D.nodes(spark, sf).select("id", S.expand_vars_column(v, {"workspaceFolder": "/ws"}).alias("value"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '\"a,' || name || '\"' ELSE name END AS csv, replace(replace('<' || file || '&', '&', '&amp;'), '<', '&lt;') AS html FROM V")
def escapes(spark, sf):
    n = D.nodes(spark, sf)
    return n.select("id", S.csv_field(F.when(F.col("id") % 3 == 0, F.concat(F.lit("a,"), "name")).otherwise(F.col("name"))).alias("csv"), S.html_text(F.concat(F.lit("<"), "file", F.lit("&"))).alias("html"))


# Joins.

FRAMES_SQL = """F AS (SELECT CAST(l_partkey AS VARCHAR) AS func, 'u' || CAST(l_suppkey AS VARCHAR) AS stem, CAST(l_quantity AS BIGINT) * 16 AS bytes FROM lineitem WHERE l_returnflag <> 'N'),
FN AS (SELECT func, max(bytes) AS b FROM F GROUP BY 1), FF AS (SELECT stem, func, max(bytes) AS b FROM F GROUP BY 1, 2),
N AS (SELECT CAST(id AS VARCHAR) AS id, CAST(id AS VARCHAR) AS name, 'src/u' || CAST(id % 20 AS VARCHAR) || '.c' AS file, 'u' || CAST(id % 20 AS VARCHAR) AS stem FROM V WHERE frame > 200)"""


def _half(spark, sf):
    f = frames(spark, sf).filter("returned")
    s = F.col("id").cast("string")
    n = D.nodes(spark, sf).filter("frame > 200").select(s.alias("id"), s.alias("name"), F.concat(F.lit("src/u"), (F.col("id") % 20).cast("string"), F.lit(".c")).alias("file"))
    return n, *readers.frame_index(f)


@query(f"WITH {FRAMES_SQL} SELECT N.id, coalesce(FF.b, FN.b) AS frame FROM N LEFT JOIN FF ON FF.stem = N.stem AND FF.func = N.name LEFT JOIN FN ON FN.func = N.name")
def frame_join_fallback(spark, sf):
    return resolve.attach_frames(*_half(spark, sf)).select("id", "frame")


@query(f"WITH {FRAMES_SQL} SELECT func AS id, b AS frame FROM FN WHERE func NOT IN (SELECT name FROM N)")
def ghosts(spark, sf):
    n, by_name, _ = _half(spark, sf)
    return resolve.ghosts(n, by_name).select("id", "frame")


@query("""WITH C AS (SELECT e.src, s.file AS src_file, d.name AS callee, e.seq FROM E_dag e JOIN V s ON s.id = e.src JOIN V d ON d.id = e.dst),
M AS (SELECT C.src, V.id AS dst, C.seq, row_number() OVER (PARTITION BY C.src, C.callee ORDER BY CASE WHEN V.file = C.src_file THEN 0 ELSE 1 END, V.id, C.seq) AS r, min(C.seq) OVER (PARTITION BY C.src, C.callee) AS s FROM C JOIN V ON V.name = C.callee)
SELECT src, dst, CAST(min(s) AS INTEGER) AS seq FROM M WHERE r = 1 GROUP BY src, dst""")
def callee_resolution(spark, sf):
    n = D.nodes(spark, sf)
    c = D.dag(spark, sf).join(n.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst")
    return resolve.resolve_calls(c.select("src", "src_file", "callee", "seq"), n).withColumn("seq", F.col("seq").cast("int"))


OVERRIDES = [{"caller": f"f{i}", **({"conditional": [{"when": {"fromRoot": "m"}, "targets": [f"c{i}"]}]} if i in (7, 9) else {}), **({"file": f"a/Brand#{11 + i}"} if i % 2 else {}), **({"line": i % 50 + 1} if i % 3 == 0 else {}), **({"via": f"v{i % 4}"} if i % 5 == 0 else {}), "targets": [f"t{i}"]} for i in range(40)] + [{"caller": f"f{i}", "targets": ["x"]} for i in range(0, 40, 2)]
_RULES_SQL = "RULES(rule, caller, file, line, via) AS (VALUES " + ", ".join(f"({i}, '{r['caller']}', {repr(r['file'].split('/')[-1]) if 'file' in r else 'NULL'}, {r.get('line', 'NULL')}, {repr(r['via']) if 'via' in r else 'NULL'})" for i, r in enumerate(OVERRIDES)) + ")"
SITES_SQL = "SITES AS (SELECT src * 1000003 + dst AS site, 'f' || CAST(src % 60 AS VARCHAR) AS caller, V.file AS file, CAST(src % 50 + 1 AS INTEGER) AS line1, 'v' || CAST(dst % 4 AS VARCHAR) AS via FROM E_dag JOIN V ON V.id = src WHERE indirect)"
MATCH_SQL = f"""{_RULES_SQL}, {SITES_SQL}, SC AS (SELECT s.site, r.rule, row_number() OVER (PARTITION BY s.site ORDER BY (CASE WHEN r.file IS NULL THEN 0 ELSE 1 END) + (CASE WHEN r.line IS NULL THEN 0 ELSE 1 END) + (CASE WHEN r.via IS NULL THEN 0 ELSE 1 END) DESC, r.rule) AS k
FROM SITES s JOIN RULES r ON r.caller = s.caller AND (r.file IS NULL OR r.file = s.file) AND (r.line IS NULL OR r.line = s.line1) AND (r.via IS NULL OR r.via = s.via)),
B AS (SELECT s.*, SC.rule AS rule FROM SITES s LEFT JOIN SC ON SC.site = s.site AND SC.k = 1)"""


def sites(spark, sf):
    e = D.dag(spark, sf).filter("indirect").join(D.nodes(spark, sf).select(F.col("id").alias("src"), "file"), "src")
    return e.select((F.col("src") * 1000003 + F.col("dst")).alias("site"), F.concat(F.lit("f"), (F.col("src") % 60).cast("string")).alias("caller"), "file", (F.col("src") % 50 + 1).cast("int").alias("line1"), F.concat(F.lit("v"), (F.col("dst") % 4).cast("string")).alias("via"))


def matched(spark, sf):
    table = rules.override_table(spark, rules.usable_overrides(OVERRIDES))
    return rules.match_overrides(sites(spark, sf), table), table


@query(f"WITH {MATCH_SQL} SELECT site, rule FROM B")
def override_match(spark, sf):
    return matched(spark, sf)[0].select("site", "rule")


@query(f"WITH {MATCH_SQL} SELECT rule, caller FROM RULES WHERE rule NOT IN (SELECT rule FROM B WHERE rule IS NOT NULL)")
def unused_overrides(spark, sf):
    m, table = matched(spark, sf)
    return rules.unused_overrides(table, m).select("rule", "caller")


@query(f"""WITH {MATCH_SQL} SELECT DISTINCT B.caller, CASE WHEN B.rule < 40 THEN 't' || CAST(B.rule AS VARCHAR) ELSE 'x' END AS callee, true AS verified, CAST(NULL AS INTEGER) AS cond_id FROM B WHERE B.rule IS NOT NULL
UNION ALL SELECT DISTINCT B.caller, 'c' || CAST(B.rule AS VARCHAR), false, CAST(CASE B.rule WHEN 7 THEN 0 ELSE 1 END AS INTEGER) FROM B WHERE B.rule IN (7, 9)""")
def override_edges(spark, sf):
    m, _ = matched(spark, sf)
    return rules.bind(m, OVERRIDES)[0].select("caller", "callee", "verified", "cond_id")


@query(f"WITH {MATCH_SQL} SELECT 'bind targets of ' || via AS _hint, caller, file, CASE WHEN c > 1 THEN via END AS via FROM (SELECT *, count(*) OVER (PARTITION BY caller) AS c FROM B) WHERE rule IS NULL")
def fp_template(spark, sf):
    _, s, _ = rules.bind(matched(spark, sf)[0], OVERRIDES)
    return views.template(s)[0].drop("targets")


@query(f"WITH {MATCH_SQL} SELECT caller AS id, count(*) AS sites, CAST(substr(caller, 2) AS BIGINT) * 100 AS peak FROM B WHERE rule IS NULL GROUP BY caller")
def fp_sites_list(spark, sf):
    _, s, _ = rules.bind(matched(spark, sf)[0], OVERRIDES)
    s = s.withColumnRenamed("caller", "id")
    return views.unbound_sites(s, s.select("id", (F.substring("id", 2, 9).cast("long") * 100).alias("peak")).distinct())


REMOVALS = [{"callee": "177"}, {"callee": "27", "caller": "*"}, {"callee": "25", "file": "x/Brand#5"}, {"callee": "62", "when": {"callerContains": "162"}}, {"callee": "42", "when": {"any": [{"fromRoot": "65"}, {"not": {"callerContains": "4"}}]}}, {"callee": "46", "when": {"all": [{"callerContains": "162"}, {"callerContains": "65"}]}}, {"callee": "nobody"}, {"callee": "50", "caller": "7"}]
REMOVE_SQL = """E AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, V.file AS file FROM E_dag JOIN V ON V.id = src),
L AS (SELECT * FROM E WHERE NOT (dst = '177' OR dst = '27' OR (dst = '25' AND file = 'Brand#5'))),
R AS (SELECT s, s AS n FROM (VALUES ('162'), ('65'), ('4')) t(s) UNION SELECT R.s, L.dst FROM R JOIN L ON L.src = R.n),
H AS (SELECT src, dst, 0 AS rule FROM E WHERE dst = '177' UNION ALL SELECT src, dst, 1 FROM E WHERE dst = '27' UNION ALL SELECT src, dst, 2 FROM E WHERE dst = '25' AND file = 'Brand#5'
UNION ALL SELECT src, dst, 3 FROM E WHERE dst = '62' AND EXISTS (SELECT 1 FROM R WHERE s = '162' AND n = src)
UNION ALL SELECT src, dst, 4 FROM E WHERE dst = '42' AND (EXISTS (SELECT 1 FROM R WHERE s = '65' AND n = src) OR NOT EXISTS (SELECT 1 FROM R WHERE s = '4' AND n = src))
UNION ALL SELECT src, dst, 5 FROM E WHERE dst = '46' AND EXISTS (SELECT 1 FROM R WHERE s = '162' AND n = src) AND EXISTS (SELECT 1 FROM R WHERE s = '65' AND n = src)
UNION ALL SELECT src, dst, 7 FROM E WHERE dst = '50' AND src = '7')"""


def _named(spark, sf):
    e = D.dag(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "seq", "indirect")
    return e, D.nodes(spark, sf).withColumn("id", F.col("id").cast("string"))


@query(f"WITH {REMOVE_SQL} SELECT src, dst FROM E WHERE NOT EXISTS (SELECT 1 FROM H WHERE H.src = E.src AND H.dst = E.dst)")
def edge_removal_conditional(spark, sf):
    e, n = _named(spark, sf)
    return rules.prune_edges(e, REMOVALS, n)[0].select("src", "dst")


@query("WITH E AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, V.file AS file FROM E_dag JOIN V ON V.id = src) SELECT src, dst FROM E WHERE NOT (dst = '177' OR dst = '27' OR (dst = '25' AND file = 'Brand#5'))")
def edge_removal(spark, sf):
    e, n = _named(spark, sf)
    return rules.prune_edges(e, REMOVALS[:3], n)[0].select("src", "dst")


@query(f"WITH {REMOVE_SQL} SELECT CAST(i AS INTEGER) AS rule FROM range(8) t(i) WHERE i NOT IN (SELECT rule FROM H)")
def removal_unmatched(spark, sf):
    e, n = _named(spark, sf)
    return rules.prune_edges(e, REMOVALS, n)[1].select("rule")


# The whole program from unit facts.

BINDINGS = [{"caller": "hot bolt", "via": "v1", "targets": ["blue ring", "no such name"]}, {"caller": "large ring", "conditional": [{"when": {"fromRoot": "hot bolt"}, "targets": ["red bolt"]}, {"when": {"fromRoot": "x"}, "targets": ["gone"]}]}, {"caller": "blue ring", "file": "x/Brand#14.c", "targets": ["hot bolt"]}]
EXCLUDED = [{"callee": "small ring", "caller": "hot bolt"}, {"callee": "red ring", "file": "a/Brand#7.c"}]
PROGRAM_SQL = """D AS (SELECT CAST(id AS VARCHAR) AS usr, id, name, 'src/' || file || '.c' AS file, CAST(substr(file, 7) AS INTEGER) AS u FROM V),
RAW AS (SELECT a.usr, a.name AS caller, a.file, b.name AS callee, false AS indirect, CAST(NULL AS INTEGER) AS cond_id FROM E_dag JOIN D a ON a.id = src JOIN D b ON b.id = dst
UNION ALL SELECT a.usr, a.name, a.file, t.callee, true, t.c FROM E_dag JOIN D a ON a.id = src JOIN (VALUES ('hot bolt', 'blue ring', NULL), ('large ring', 'red bolt', 0), ('blue ring', 'hot bolt', NULL)) t(caller, callee, c) ON t.caller = a.name
WHERE E_dag.indirect AND (a.name = 'large ring' OR (a.name = 'hot bolt' AND dst % 4 = 1) OR (a.name = 'blue ring' AND a.file = 'src/Brand#14.c'))),
M AS (SELECT r.*, d.usr AS dst, row_number() OVER (PARTITION BY r.usr, r.callee ORDER BY CASE WHEN d.file = r.file THEN 0 ELSE 1 END, d.u, d.id) AS k FROM (SELECT DISTINCT usr, file, callee FROM RAW) r JOIN D d ON d.name = r.callee),
G AS (SELECT RAW.usr AS src, M.dst, min(RAW.indirect) AS indirect, max(RAW.cond_id) AS cond_id, min(RAW.caller) AS caller, min(RAW.callee) AS callee, min(RAW.file) AS file FROM RAW JOIN M ON M.usr = RAW.usr AND M.callee = RAW.callee AND M.k = 1 GROUP BY RAW.usr, M.dst)"""


def program_facts(spark, sf):
    """Parts as functions of their brand's unit, the acyclic calls by name, pointers as call sites."""
    n = D.nodes(spark, sf).withColumn("usr", F.col("id").cast("string")).withColumn("path", F.concat(F.lit("src/"), "file", F.lit(".c")))
    unit = F.substring("file", 7, 9).cast("long")
    e = D.dag(spark, sf).join(n.select(F.col("id").alias("src"), "usr", "file"), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").withColumn("unit_ord", F.substring("file", 7, 9).cast("long"))
    site = e.filter("indirect").select(F.col("file").alias("unit"), "unit_ord", (F.col("src") * 4096 + F.col("seq")).alias("seq"), F.col("usr").alias("caller_usr"), F.lit(1).alias("line"), F.concat(F.lit("v"), (F.col("dst") % 4).cast("string")).alias("via"), F.lit(-1).alias("via_param"))
    return {
        "fn_defs": n.select(F.col("file").alias("unit"), unit.alias("unit_ord"), F.col("id").alias("seq"), "usr", "name", F.col("path").alias("file"), F.col("decl_file"), F.lit(0).alias("line0"), F.lit(False).alias("is_static")),
        "raw_calls": e.select(F.col("file").alias("unit"), "unit_ord", F.col("seq").cast("long").alias("seq"), "usr", "callee"),
        "raw_sites": site,
    }


@query(f"WITH {PROGRAM_SQL} SELECT src, dst, indirect, cond_id FROM G WHERE NOT (callee = 'small ring' AND caller = 'hot bolt') AND NOT (callee = 'red ring' AND file = 'src/Brand#7.c')")
def program_calls(spark, sf):
    g = program.build(program_facts(spark, sf), BINDINGS, EXCLUDED)
    usr = g.functions.select("id", "usr")
    return g.calls.join(usr.toDF("src", "s"), "src").join(usr.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "indirect", "cond_id")


# Aggregates over edges.


@query("WITH O AS (SELECT src AS id, count(*) AS o FROM E_raw GROUP BY 1), I AS (SELECT dst AS id, count(*) AS i FROM E_raw GROUP BY 1) SELECT coalesce(O.id, I.id) AS id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM O FULL JOIN I ON O.id = I.id")
def fan_in_out(spark, sf):
    return views.fan(D.raw_edges(spark, sf))


@query("SELECT src, string_agg(CAST(dst AS VARCHAR), ';' ORDER BY seq) AS callees FROM E_dag GROUP BY src")
def callee_list(spark, sf):
    return resolve.callee_lists(D.dag(spark, sf)).select("src", F.array_join(F.transform("callees", lambda x: x.cast("string")), ";").alias("callees"))


@query("SELECT a.src, a.dst FROM E_raw a JOIN E_raw b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def reciprocal_edges(spark, sf):
    return explore.reciprocal(D.raw_edges(spark, sf))


@query("WITH N AS (SELECT src, dst FROM E_dag WHERE NOT indirect UNION SELECT dst, src FROM E_dag WHERE seq = 1) SELECT src, dst, 'added' AS change FROM (SELECT src, dst FROM N EXCEPT SELECT src, dst FROM E_dag) UNION ALL SELECT src, dst, 'removed' FROM (SELECT src, dst FROM E_dag EXCEPT SELECT src, dst FROM N)")
def edge_diff(spark, sf):
    e = D.dag(spark, sf)
    new = e.filter("not indirect").select("src", "dst").union(e.filter("seq = 1").select("dst", "src")).distinct()
    return explore.edge_diff(e, new)


@query("SELECT file, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM V GROUP BY file")
def functions_by_file(spark, sf):
    return resolve.files_of(D.nodes(spark, sf)).select("file", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT name, max(id) AS id FROM V GROUP BY name")
def last_definition(spark, sf):
    return resolve.last_of_name(D.nodes(spark, sf)).select("name", "id")


# Recursive metrics.

CLOSURE_SQL = "C AS (SELECT src AS a, dst AS b FROM E_cyc UNION SELECT C.a, E_cyc.dst FROM C JOIN E_cyc ON E_cyc.src = C.b)"
SCC_SQL = CLOSURE_SQL + ", S AS (SELECT V.id, coalesce(min(x.b), V.id) AS scc FROM V LEFT JOIN (SELECT p.a, p.b FROM C p JOIN C q ON p.a = q.b AND p.b = q.a) x ON x.a = V.id GROUP BY V.id), REC AS (SELECT DISTINCT a AS id FROM C WHERE a = b)"


@query("SELECT V.id AS root FROM V WHERE id NOT IN (SELECT dst FROM E_cyc)")
def roots(spark, sf):
    return metrics.find_roots(D.nodes(spark, sf), D.cyclic(spark, sf)).select("root")


@query("WITH P AS (SELECT id FROM V WHERE starts_with(decl_file, 'PROMO')) SELECT id AS root, true AS is_pinned FROM P UNION ALL SELECT id, false FROM V WHERE id NOT IN (SELECT dst FROM E_cyc) AND id NOT IN (SELECT id FROM P)")
def roots_pinned(spark, sf):
    n = D.nodes(spark, sf)
    return metrics.find_roots(n, D.cyclic(spark, sf), n.filter(S.matches_globs("decl_file", ["PROMO*"]))).select("root", "is_pinned")


@query(f"WITH {CLOSURE_SQL} SELECT a, b FROM C")
def closure(spark, sf):
    return metrics.closure_doubling(D.cyclic(spark, sf))


@query(f"WITH {CLOSURE_SQL} SELECT DISTINCT a AS id FROM C WHERE a = b")
def recursive(spark, sf):
    return metrics.components(D.nodes(spark, sf), D.cyclic(spark, sf)).filter("recursive").select("id")


@query(f"WITH {SCC_SQL} SELECT scc, count(*) AS size FROM S GROUP BY scc HAVING count(*) > 1")
def scc_sizes(spark, sf):
    return metrics.components(D.nodes(spark, sf), D.cyclic(spark, sf)).select("scc", "size").filter("size > 1").distinct()


@query(f"WITH {SCC_SQL} SELECT e.src AS id FROM E_cyc e JOIN S a ON a.id = e.src JOIN S b ON b.id = e.dst JOIN REC ON REC.id = e.src WHERE a.scc = b.scc GROUP BY e.src HAVING bool_and(e.indirect)")
def recursive_via_fp(spark, sf):
    e = D.cyclic(spark, sf)
    return metrics.recursive_via_pointer(metrics.components(D.nodes(spark, sf), e), e)


PATHS_SQL = "P AS (SELECT id AS s, id AS n, frame AS v, 1 AS d FROM V UNION ALL SELECT P.s, E_dag.dst, P.v + V.frame, P.d + 1 FROM P JOIN E_dag ON E_dag.src = P.n JOIN V ON V.id = E_dag.dst), PK AS (SELECT s AS id, max(v) AS peak, CAST(max(d) AS INTEGER) AS down_depth FROM P GROUP BY s)"


@query(f"WITH {PATHS_SQL} SELECT id, peak, down_depth, false AS bounded FROM PK")
def peak_dag(spark, sf):
    return metrics.peaks(D.nodes(spark, sf), D.dag(spark, sf)).select("id", "peak", "down_depth", "bounded")


@query(f"WITH {CLOSURE_SQL} SELECT DISTINCT a AS id FROM C WHERE b IN (SELECT a FROM C WHERE a = b) UNION SELECT a FROM C WHERE a = b")
def peak_bounded(spark, sf):
    return metrics.peaks(D.nodes(spark, sf), D.cyclic(spark, sf)).filter("bounded").select("id")


CONDENSED_SQL = SCC_SQL + """, W AS (SELECT scc, sum(frame) AS w, count(*) AS len FROM S JOIN V ON V.id = S.id GROUP BY scc),
CE AS (SELECT DISTINCT a.scc AS s, b.scc AS d FROM E_cyc JOIN S a ON a.id = src JOIN S b ON b.id = dst WHERE a.scc <> b.scc),
CP AS (SELECT scc AS s, scc AS n, w AS v, len AS d FROM W UNION ALL SELECT CP.s, CE.d, CP.v + W.w, CP.d + W.len FROM CP JOIN CE ON CE.s = CP.n JOIN W ON W.scc = CE.d)"""


@query(f"WITH {CONDENSED_SQL} SELECT S.id, CAST(max(v) AS BIGINT) AS peak, CAST(max(d) AS INTEGER) AS down_depth FROM S JOIN CP ON CP.s = S.scc GROUP BY S.id")
def peak_cyclic_scc_sum(spark, sf):
    return metrics.peaks(D.nodes(spark, sf), D.cyclic(spark, sf)).select("id", "peak", "down_depth")


RAW_SQL = CONDENSED_SQL.replace("E_cyc", "E_raw")


@query(f"WITH {RAW_SQL} SELECT scc, count(*) AS size FROM S GROUP BY scc")
def scc_sizes_raw(spark, sf):
    """All calls of all orders: one component holds nearly every function."""
    e = metrics.durable(D.raw_edges(spark, sf))
    return metrics.components(D.nodes(spark, sf), e).select("scc", "size").distinct()


@query(f"WITH {RAW_SQL} SELECT S.id, CAST(max(v) AS BIGINT) AS peak, CAST(max(d) AS INTEGER) AS down_depth, bool_or(n IN (SELECT S.scc FROM REC JOIN S ON S.id = REC.id)) AS bounded, S.id IN (SELECT id FROM REC) AS recursive FROM S JOIN CP ON CP.s = S.scc GROUP BY S.id")
def peak_raw(spark, sf):
    return metrics.peaks(D.nodes(spark, sf), metrics.durable(D.raw_edges(spark, sf))).select("id", "peak", "down_depth", "bounded", "recursive")


ROOTS_SQL = PATHS_SQL + ", RT AS (SELECT id AS root FROM V WHERE id NOT IN (SELECT dst FROM E_dag)), PR AS (SELECT s AS root, n AS id, CAST(max(d) AS INTEGER) AS depth, max(v) AS entry FROM P JOIN RT ON RT.root = P.s GROUP BY s, n)"


def _dag_roots(spark, sf):
    n, e = D.nodes(spark, sf), metrics.durable(D.dag(spark, sf))
    pk = metrics.peaks(n, e)
    return n, e, pk, metrics.durable(metrics.per_root(n, e, pk, metrics.find_roots(n, e)))


@query(f"WITH {ROOTS_SQL} SELECT root, id, depth, entry FROM PR")
def per_root_depth_entry(spark, sf):
    return _dag_roots(spark, sf)[3].select("root", "id", "depth", "entry")


@query(f"WITH {ROOTS_SQL} SELECT PR.root, PR.id, PR.entry + PK.peak - V.frame AS peak FROM PR JOIN PK ON PK.id = PR.id JOIN V ON V.id = PR.id")
def per_root_peak(spark, sf):
    return _dag_roots(spark, sf)[3].select("root", "id", "peak")


@query(f"WITH {ROOTS_SQL} SELECT V.id, coalesce(max(PR.depth), 0) AS depth FROM V LEFT JOIN PR ON PR.id = V.id GROUP BY V.id")
def depth_max(spark, sf):
    return metrics.analyse(D.nodes(spark, sf), D.dag(spark, sf))["metrics"].select("id", "depth")


CONDITIONS = [{"callerContains": "c1"}, {"any": [{"callerContains": "c2"}, {"not": {"callerContains": "c1"}}]}]
COND_SQL = """CN AS (SELECT id, frame, CASE WHEN id % 5 = 1 THEN 1 WHEN id % 5 = 2 THEN 2 ELSE 0 END AS bit FROM V),
RT AS (SELECT id AS root FROM V WHERE id NOT IN (SELECT dst FROM E_dag)),
CE AS (SELECT src, dst, CASE WHEN dst % 4 = 0 THEN 0 WHEN dst % 4 = 1 THEN 1 END AS c FROM E_dag),
CP AS (SELECT root, root AS id, bit AS mask, frame AS v, 1 AS d, [root] AS p FROM RT JOIN CN ON CN.id = root
UNION ALL SELECT CP.root, CE.dst, CP.mask | CN.bit, CP.v + CN.frame, CP.d + 1, list_append(CP.p, CE.dst) FROM CP JOIN CE ON CE.src = CP.id JOIN CN ON CN.id = CE.dst
WHERE CE.c IS NULL OR (CE.c = 0 AND (CP.mask & 1) <> 0) OR (CE.c = 1 AND ((CP.mask & 2) <> 0 OR (CP.mask & 1) = 0)))"""


@query(f"WITH {COND_SQL}, PKS AS (SELECT root, id, max(v) AS peak FROM (SELECT root, unnest(p) AS id, v FROM CP) GROUP BY root, id) SELECT CP.root, CP.id, CAST(max(d) AS INTEGER) AS depth, max(v) AS entry, CAST(max(PKS.peak) AS BIGINT) AS peak, false AS bounded FROM CP JOIN PKS ON PKS.root = CP.root AND PKS.id = CP.id GROUP BY CP.root, CP.id")
def per_root_conditional(spark, sf):
    n, e = D.nodes(spark, sf), D.dag(spark, sf)
    # Watched functions are two of a graph whose ids stand for themselves: c1 and c2 are classes here.
    name = F.when(F.col("id") % 5 == 1, "c1").when(F.col("id") % 5 == 2, "c2")
    e = e.withColumn("cond_id", F.when(F.col("dst") % 4 == 0, 0).when(F.col("dst") % 4 == 1, 1))
    roots_ = metrics.find_roots(n, e)
    return metrics.conditional_per_root(n.withColumn("watch", name), e, roots_, CONDITIONS).select("root", "id", "depth", "entry", "peak", "bounded")


@query()
def cycle_replay(spark, sf):
    n = D.nodes(spark, sf)
    return metrics.replay_peaks(n, D.cyclic(spark, sf))


FEW_SQL = "F0 AS (SELECT id, CASE WHEN frame % 32 = 0 THEN frame END AS f FROM V), P AS (SELECT id AS s, id AS n, coalesce(f, 0) AS v, 1 AS d FROM F0 UNION ALL SELECT P.s, E_dag.dst, P.v + coalesce(F0.f, 0), P.d + 1 FROM P JOIN E_dag ON E_dag.src = P.n JOIN F0 ON F0.id = E_dag.dst)"


@query(f"WITH {FEW_SQL}, K AS (SELECT id FROM F0 WHERE f IS NOT NULL UNION SELECT src FROM E_dag JOIN F0 ON F0.id = dst WHERE f IS NOT NULL) SELECT s AS id, CASE WHEN s IN (SELECT id FROM K) THEN CAST(max(v) AS BIGINT) END AS peak, false AS bounded FROM P GROUP BY s")
def legacy_depths(spark, sf):
    n = D.nodes(spark, sf)
    return metrics.legacy_depths(n.withColumn("frame", F.when(F.col("frame") % 32 == 0, F.col("frame"))), D.dag(spark, sf))


@query(f"WITH {CONDENSED_SQL} SELECT S.id, CAST(max(v) AS BIGINT) AS peak, CAST(max(d) AS INTEGER) AS down_depth, bool_or(n IN (SELECT S.scc FROM REC JOIN S ON S.id = REC.id)) AS bounded, S.id IN (SELECT id FROM REC) AS recursive FROM S JOIN CP ON CP.s = S.scc GROUP BY S.id")
def delta_metrics(spark, sf):
    """A build of the direct calls and reversed first calls, then the edit to all calls."""
    n, e = D.nodes(spark, sf), D.cyclic(spark, sf)
    old = delta.snapshot(n.filter("id % 50 <> 7").withColumn("frame", F.when(F.col("id") % 9 == 0, 8).otherwise(F.col("frame"))), e.filter("not indirect").select("src", "dst").union(e.filter("seq = 1").select("dst", "src")))
    new, _ = delta.edited(old, delta.edit_between(old, n, e))
    return new.metrics.select("id", "peak", "down_depth", "bounded", "recursive")


# Exploration.

FOCUS = 13
HOOD_SQL = f"""DN AS (SELECT CAST({FOCUS} AS BIGINT) AS id, 0 AS h UNION SELECT E_dag.dst, DN.h + 1 FROM DN JOIN E_dag ON E_dag.src = DN.id WHERE DN.h < 4),
UP AS (SELECT CAST({FOCUS} AS BIGINT) AS id, 0 AS h UNION SELECT E_dag.src, UP.h + 1 FROM UP JOIN E_dag ON E_dag.dst = UP.id WHERE UP.h < 3),
LN AS (SELECT id, min(h) AS layer FROM DN GROUP BY id), LU AS (SELECT id, -min(h) AS layer FROM UP WHERE id NOT IN (SELECT id FROM LN) GROUP BY id),
L AS (SELECT id, layer FROM (SELECT * FROM LN UNION ALL SELECT * FROM LU) ORDER BY layer < 0, abs(layer), id LIMIT 600)"""


@query(f"""WITH {HOOD_SQL} SELECT id, CAST(layer AS INTEGER) AS layer, EXISTS (SELECT 1 FROM E_dag WHERE src = L.id AND dst NOT IN (SELECT id FROM L)) AS truncated_callees,
EXISTS (SELECT 1 FROM E_dag WHERE dst = L.id AND src NOT IN (SELECT id FROM L)) AS truncated_callers FROM L""")
def neighborhood_nodes(spark, sf):
    return explore.neighbourhood(D.dag(spark, sf), FOCUS, 3, 4)[0].drop("number")


ORDER_SQL = f"""D0 AS (SELECT CAST({FOCUS} AS BIGINT) AS id, CAST(0 AS BIGINT) AS p),
D1 AS (SELECT dst AS id, row_number() OVER (ORDER BY dst) AS p FROM E_raw WHERE src = {FOCUS} AND dst <> {FOCUS}),
D2 AS (SELECT id, row_number() OVER (ORDER BY f) AS p FROM (SELECT e.dst AS id, min((D1.p, e.dst)) AS f FROM D1 JOIN E_raw e ON e.src = D1.id WHERE e.dst NOT IN (SELECT id FROM D0 UNION ALL SELECT id FROM D1) GROUP BY e.dst)),
DN AS (SELECT id, 0 AS layer, p FROM D0 UNION ALL SELECT id, 1, p FROM D1 UNION ALL SELECT id, 2, p FROM D2),
U1 AS (SELECT src AS id, row_number() OVER (ORDER BY src) AS p FROM E_raw WHERE dst = {FOCUS} AND src NOT IN (SELECT id FROM DN)),
U2 AS (SELECT id, row_number() OVER (ORDER BY f) AS p FROM (SELECT e.src AS id, min((U1.p, e.src)) AS f FROM U1 JOIN E_raw e ON e.dst = U1.id WHERE e.src NOT IN (SELECT id FROM DN UNION ALL SELECT id FROM U1) GROUP BY e.src)),
L AS (SELECT *, row_number() OVER (ORDER BY layer < 0, abs(layer), p) - 1 AS n FROM (SELECT * FROM DN UNION ALL SELECT id, -1, p FROM U1 UNION ALL SELECT id, -2, p FROM U2))"""


@query(f"WITH {ORDER_SQL} SELECT id, CAST(layer AS INTEGER) AS layer, CAST(n AS INTEGER) AS number FROM L WHERE n < 600")
def neighborhood_order(spark, sf):
    """Two hops of all calls below and above the focus, numbered as discovered; the budget cuts them from sf0.01 on."""
    return explore.neighbourhood(D.raw_edges(spark, sf), FOCUS, 2, 2)[0].select("id", "layer", "number")


def _loop_focus(spark, sf):
    on = metrics.components(D.nodes(spark, sf), D.cyclic(spark, sf)).filter("size > 2")
    at = on.agg(F.min("id")).first()[0]
    return FOCUS if at is None else at


CYC_HOOD = f"""{SCC_SQL}, FO AS (SELECT coalesce(min(S.id), {FOCUS}) AS f FROM S WHERE scc IN (SELECT scc FROM S GROUP BY scc HAVING count(*) > 2)),
DN AS (SELECT f AS id, 0 AS h FROM FO UNION SELECT E_cyc.dst, DN.h + 1 FROM DN JOIN E_cyc ON E_cyc.src = DN.id WHERE DN.h < 4),
LN AS (SELECT id, min(h) AS layer FROM DN GROUP BY id),
UP AS (SELECT f AS id, 0 AS h FROM FO UNION SELECT E_cyc.src, UP.h + 1 FROM UP JOIN E_cyc ON E_cyc.dst = UP.id WHERE UP.h < 3 AND E_cyc.src NOT IN (SELECT id FROM LN)),
LU AS (SELECT id, -min(h) AS layer FROM UP WHERE id NOT IN (SELECT id FROM LN) GROUP BY id),
L AS (SELECT * FROM LN UNION ALL SELECT * FROM LU), EL AS (SELECT src, dst, indirect FROM E_cyc JOIN L a ON a.id = src JOIN L b ON b.id = dst),
CL AS (SELECT src AS a, dst AS b FROM EL UNION SELECT CL.a, EL.dst FROM CL JOIN EL ON EL.src = CL.b)"""


@query(f"WITH {CYC_HOOD} SELECT src, dst, indirect, src = dst OR EXISTS (SELECT 1 FROM CL WHERE a = EL.dst AND b = EL.src) AS recursive FROM EL")
def neighborhood_edges_cyclic(spark, sf):
    return explore.neighbourhood(D.cyclic(spark, sf), _loop_focus(spark, sf), 3, 4)[1].select("src", "dst", "indirect", "recursive")


@query(f"WITH {HOOD_SQL} SELECT src, dst, ((a.layer < b.layer AND b.layer <= 0) OR (a.layer >= 0 AND a.layer < b.layer)) AS on_focus, false AS recursive, indirect FROM E_dag JOIN L a ON a.id = src JOIN L b ON b.id = dst")
def neighborhood_edges(spark, sf):
    return explore.neighbourhood(D.dag(spark, sf), FOCUS, 3, 4)[1]


WALK_SQL = """PT AS (SELECT id AS start, id AS n, frame AS total, 1 AS d, [id] AS path FROM V
UNION ALL SELECT PT.start, E_dag.dst, PT.total + V.frame, PT.d + 1, list_append(PT.path, E_dag.dst) FROM PT JOIN E_dag ON E_dag.src = PT.n JOIN V ON V.id = E_dag.dst),
DONE AS (SELECT * FROM PT WHERE n NOT IN (SELECT src FROM E_dag))"""


def _text(c="nodes"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">")


@query(f"WITH {WALK_SQL}, M AS (SELECT *, max(d) OVER (PARTITION BY start) AS m FROM DONE), R AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY total DESC, path) AS rank FROM M WHERE m = 1 OR d > 1) SELECT start, array_to_string(path, '>') AS path, total, CAST(rank AS INTEGER) AS rank FROM R WHERE rank <= 5")
def paths_from(spark, sf):
    n = D.nodes(spark, sf)
    p = explore.paths_from(n, D.dag(spark, sf), n, limit=explore.PATHS)
    return p.select("start", _text().alias("path"), "total", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH PT AS (SELECT id AS e, id AS n, frame AS total, 1 AS d, CAST(id AS VARCHAR) AS path FROM V
UNION ALL SELECT PT.e, E_dag.src, PT.total + V.frame, PT.d + 1, CAST(E_dag.src AS VARCHAR) || '>' || PT.path FROM PT JOIN E_dag ON E_dag.dst = PT.n JOIN V ON V.id = E_dag.src)
SELECT e AS "end", path, total FROM PT WHERE d > 1 AND n NOT IN (SELECT dst FROM E_dag)""")
def paths_to(spark, sf):
    n = D.nodes(spark, sf)
    return explore.paths_to(n, D.dag(spark, sf), n).select("end", _text().alias("path"), "total")


BACK_SQL = """PT AS (SELECT id AS e, id AS n, frame AS total, 1 AS d, [id] AS path FROM V
UNION ALL SELECT PT.e, E_dag.src, PT.total + V.frame, PT.d + 1, list_append(PT.path, E_dag.src) FROM PT JOIN E_dag ON E_dag.dst = PT.n JOIN V ON V.id = E_dag.src),
R AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY total DESC, path) AS rank FROM PT WHERE d > 1 AND n NOT IN (SELECT dst FROM E_dag))"""


@query(f"""WITH {BACK_SQL} SELECT e AS "end", array_to_string(list_reverse(path), '>') AS path, total, CAST(rank AS INTEGER) AS rank FROM R WHERE rank <= 5""")
def paths_to_limited(spark, sf):
    n = D.nodes(spark, sf)
    p = explore.paths_to(n, D.dag(spark, sf), n, limit=explore.PATHS)
    return p.select("end", _text().alias("path"), "total", F.col("rank").cast("int").alias("rank"))


CYCLE_WALK_SQL = """PT AS (SELECT id AS start, id AS n, frame AS total, [id] AS path, false AS c FROM V
UNION ALL SELECT PT.start, E_cyc.dst, PT.total + V.frame, list_append(PT.path, E_cyc.dst), list_contains(PT.path, E_cyc.dst) FROM PT JOIN E_cyc ON E_cyc.src = PT.n JOIN V ON V.id = E_cyc.dst WHERE NOT PT.c AND len(PT.path) <= 6),
DONE AS (SELECT start, total, path, c AS by_cycle, NOT c AND len(path) = 7 AS by_depth FROM PT WHERE c OR len(path) = 7 OR n NOT IN (SELECT src FROM E_cyc)),
M AS (SELECT *, max(len(path)) OVER (PARTITION BY start) AS m FROM DONE),
R AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY total DESC, path) AS rank FROM M WHERE m = 1 OR len(path) > 1)"""


@query(f"WITH {CYCLE_WALK_SQL} SELECT start, array_to_string(path, '>') AS path, total, by_cycle, by_depth, CAST(rank AS INTEGER) AS rank FROM R WHERE rank <= 5")
def paths_cyclic(spark, sf):
    n = D.nodes(spark, sf)
    p = explore.paths_from(n, D.cyclic(spark, sf), n, max_depth=6, limit=5)
    return p.select("start", _text().alias("path"), "total", "by_cycle", "by_depth", F.col("rank").cast("int").alias("rank"))


@query("""WITH PT AS (SELECT id AS start, id AS n, frame AS total, 1 AS d, CAST(id AS VARCHAR) AS path, CAST('' AS VARCHAR) AS walk FROM V
UNION ALL SELECT PT.start, E_dag.dst, PT.total + V.frame, PT.d + 1, PT.path || '>' || CAST(E_dag.dst AS VARCHAR), PT.walk || lpad(CAST(E_dag.seq AS VARCHAR), 6, '0') FROM PT JOIN E_dag ON E_dag.src = PT.n JOIN V ON V.id = E_dag.dst),
FIRST20 AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY walk) AS k FROM PT WHERE n NOT IN (SELECT src FROM E_dag)),
R AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY total DESC, k) AS rank FROM FIRST20 WHERE k <= 20)
SELECT start, CAST(rank AS INTEGER) AS rank, path, total, false AS by_cycle, false AS by_depth FROM R WHERE rank <= 5""")
def paths_capped(spark, sf):
    n = D.nodes(spark, sf)
    return explore.paths_capped(n, D.dag(spark, sf), n).select("start", "rank", _text().alias("path"), "total", "by_cycle", "by_depth")


@query(f"WITH {PATHS_SQL} SELECT id AS start, down_depth AS hops FROM PK")
def longest_chain(spark, sf):
    n = D.nodes(spark, sf)
    return explore.longest_chain(n, D.dag(spark, sf), n).select("start", F.size("nodes").alias("hops"))


@query("WITH W AS (SELECT src AS id, dst AS a, 1 AS h FROM E_cyc UNION SELECT W.id, E_cyc.dst, W.h + 1 FROM W JOIN E_cyc ON E_cyc.src = W.a WHERE W.a <> W.id AND W.h < 40) SELECT id, CAST(min(h) AS INTEGER) AS hops FROM W WHERE id = a GROUP BY id")
def shortest_cycle(spark, sf):
    e = D.cyclic(spark, sf)
    on = metrics.components(D.nodes(spark, sf), e).filter("recursive")
    return explore.shortest_cycles(e, on).select("id", "hops")


@query(f"""WITH {CLOSURE_SQL}, REC AS (SELECT DISTINCT a AS id FROM C WHERE a = b),
WK AS (SELECT id, id AS n, [id] AS p, false AS closed FROM REC UNION ALL SELECT WK.id, e.dst, list_append(WK.p, e.dst), e.dst = WK.id FROM WK JOIN E_cyc e ON e.src = WK.n WHERE NOT WK.closed AND len(WK.p) <= 6 AND (e.dst = WK.id OR NOT list_contains(WK.p, e.dst))),
R AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY len(p), p) AS rank FROM WK WHERE closed)
SELECT id, CAST(rank AS INTEGER) AS rank, CAST(len(p) - 1 AS INTEGER) AS hops, array_to_string(p, '>') AS path FROM R WHERE rank <= 3""")
def cycle_listing(spark, sf):
    e = D.cyclic(spark, sf)
    on = metrics.components(D.nodes(spark, sf), e).filter("recursive")
    listed, _ = explore.cycles(e, on, max_hops=6, limit=3)
    return listed.filter("hops <= 6").select("id", F.col("rank").cast("int").alias("rank"), "hops", _text().alias("path"))


CORRIDOR_SQL = f"""DN AS (SELECT CAST({FOCUS} AS BIGINT) AS id, 0 AS h UNION SELECT E_dag.dst, DN.h + 1 FROM DN JOIN E_dag ON E_dag.src = DN.id),
T AS (SELECT max(id) AS t FROM DN), UP AS (SELECT t AS id FROM T UNION SELECT E_dag.src FROM UP JOIN E_dag ON E_dag.dst = UP.id),
B AS (SELECT id, min(h) AS h FROM DN GROUP BY id), K AS (SELECT id, h FROM B WHERE id IN (SELECT id FROM UP))"""


def _corridor(spark, sf):
    e = D.dag(spark, sf)
    seed = spark.createDataFrame([(FOCUS,)], "seed long")
    far = metrics.closure_seeded(e, seed).agg(F.max("node")).first()[0]
    return explore.corridor(e, FOCUS, far)


@query(f"WITH {CORRIDOR_SQL} SELECT id FROM K")
def corridor_nodes(spark, sf):
    return _corridor(spark, sf)[0]


@query(f"WITH {CORRIDOR_SQL} SELECT src, dst FROM E_dag JOIN K a ON a.id = src JOIN K b ON b.id = dst WHERE a.h < b.h")
def corridor_edges(spark, sf):
    return _corridor(spark, sf)[1]


# Lists, reports, layouts.


def _top(by):
    def run(spark, sf):
        n = D.nodes(spark, sf)
        m = metrics.peaks(n, D.dag(spark, sf)).join(n, "id")
        return views.top(m, by, 20).select("id", "name", long(by))

    run.__name__ = {"peak": "top_by_peak", "down_depth": "top_by_depth", "frame": "top_by_frame"}[by]
    return run


for _by, _src in (("peak", "PK.peak"), ("down_depth", "PK.down_depth"), ("frame", "V.frame")):
    query(f"WITH {PATHS_SQL} SELECT V.id, V.name, CAST({_src} AS BIGINT) AS {_by} FROM V JOIN PK ON PK.id = V.id ORDER BY {_src} DESC, V.id LIMIT 20")(_top(_by))


@query(f"WITH {CONDENSED_SQL}, VIA AS (SELECT e.src AS id FROM E_cyc e JOIN S a ON a.id = e.src JOIN S b ON b.id = e.dst WHERE a.scc = b.scc GROUP BY e.src HAVING bool_and(e.indirect)) SELECT REC.id, REC.id IN (SELECT id FROM VIA) AS via_fp, CAST(max(v) AS BIGINT) AS peak FROM REC JOIN S ON S.id = REC.id JOIN CP ON CP.s = S.scc GROUP BY REC.id")
def recursive_list(spark, sf):
    n, e = D.nodes(spark, sf), D.cyclic(spark, sf)
    pk = metrics.peaks(n, e)
    via = metrics.recursive_via_pointer(pk.select("id", "scc", "recursive"), e).withColumn("v", F.lit(True))
    m = pk.join(via, "id", "left").withColumn("recursive_via_fp", F.coalesce("v", F.lit(False)))
    return views.recursive_list(m).select("id", "via_fp", "peak")


@query(f"WITH {ROOTS_SQL}, R AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC, root) AS r, count(*) OVER (PARTITION BY id) - 1 AS more FROM PR) SELECT id, root, more FROM R WHERE r = 1")
def worst_root_badge(spark, sf):
    return views.worst_root(_dag_roots(spark, sf)[3])


@query(f"""WITH {ROOTS_SQL}, R AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC, root) AS r, count(*) OVER (PARTITION BY id) AS n FROM PR)
SELECT id, string_agg(CAST(root AS VARCHAR) || '(d' || CAST(depth AS VARCHAR) || ')', ', ' ORDER BY r) || CASE WHEN max(n) > 6 THEN ' +' || CAST(max(n) - 6 AS VARCHAR) || ' more' ELSE '' END AS roots FROM R WHERE r <= 6 GROUP BY id""")
def first_six_roots(spark, sf):
    return views.first_roots(_dag_roots(spark, sf)[3])


@query(f"WITH {ROOTS_SQL}, R AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, depth DESC, root) AS rank FROM (SELECT PR.root, PR.id, PR.depth, PR.entry + PK.peak - V.frame AS p FROM PR JOIN PK ON PK.id = PR.id JOIN V ON V.id = PR.id)) SELECT id, root, CAST(rank AS INTEGER) AS rank FROM R")
def root_list_by_peak(spark, sf):
    return views.root_lists(_dag_roots(spark, sf)[3], "peak").select("id", "root", "rank")


def _report(spark, sf):
    n, e = D.nodes(spark, sf), D.dag(spark, sf)
    a = metrics.analyse(n, e)
    return views.report_rows(n, a["metrics"], a["per_root"], roots_only=False)


REPORT_SQL = f"{ROOTS_SQL}, RR AS (SELECT V.id, V.name, CAST(PR.root AS VARCHAR) AS root, greatest(PK.down_depth - 1, 0) AS depth, V.frame AS own_frame, PR.entry + PK.peak - V.frame AS peak FROM V JOIN PK ON PK.id = V.id JOIN PR ON PR.id = V.id), RP AS (SELECT *, CASE WHEN peak <= 1024 THEN 'ok' WHEN peak <= 4096 THEN 'warn' ELSE 'critical' END AS severity FROM RR)"


@query(f"WITH {REPORT_SQL} SELECT id, name, root, depth, own_frame, peak, severity FROM RP")
def report_rows(spark, sf):
    return _report(spark, sf).select("id", "name", "root", "depth", "own_frame", "peak", "severity")


CYC_SQL = CONDENSED_SQL + """, PKC AS (SELECT s AS scc, CAST(max(v) AS BIGINT) AS peak, bool_or(n IN (SELECT S.scc FROM REC JOIN S ON S.id = REC.id)) AS bounded FROM CP GROUP BY s),
RTC AS (SELECT id AS root FROM V WHERE id NOT IN (SELECT dst FROM E_cyc)),
PRC AS (SELECT r.root, b.id, CAST(max(CP.v) AS BIGINT) AS entry FROM RTC r JOIN S a ON a.id = r.root JOIN CP ON CP.s = a.scc JOIN S b ON b.scc = CP.n GROUP BY r.root, b.id),
RR AS (SELECT V.id, coalesce(PRC.entry + PKC.peak - CAST(W.w AS BIGINT), PKC.peak) AS peak, PKC.bounded, V.id IN (SELECT id FROM REC) AS recursive, V.decl_file = 'PROMO' AS ghost,
CASE WHEN PRC.root IS NULL THEN 'unreached' WHEN PRC.root = V.id THEN 'self' ELSE 'auto' END AS root_kind
FROM V JOIN S ON S.id = V.id JOIN PKC ON PKC.scc = S.scc JOIN W ON W.scc = S.scc LEFT JOIN PRC ON PRC.id = V.id),
RS AS (SELECT *, CASE WHEN peak <= 1024 THEN 'ok' WHEN peak <= 4096 THEN 'warn' ELSE 'critical' END AS severity FROM RR)"""


def _cyclic_report(spark, sf):
    n, e = D.nodes(spark, sf).withColumn("ghost", F.col("decl_file") == "PROMO"), D.cyclic(spark, sf)
    a = metrics.analyse(n, e)
    return views.report_rows(n, a["metrics"], a["per_root"], roots_only=False)


@query(f"WITH {CYC_SQL} SELECT id, peak, bounded, recursive, ghost, root_kind, severity FROM RS")
def report_rows_cyclic(spark, sf):
    return _cyclic_report(spark, sf).select("id", "peak", "bounded", "recursive", "ghost", "root_kind", "severity")


@query(f"WITH {REPORT_SQL} SELECT count(*) AS rows, count(*) FILTER (RP.severity = 'critical') AS critical, count(*) FILTER (RP.severity = 'warn') AS warn, CAST(0 AS BIGINT) AS bounded, CAST(0 AS BIGINT) AS recursive, count(DISTINCT CASE WHEN V.decl_file = 'PROMO' THEN V.id END) AS ghosts FROM RP JOIN V ON V.id = RP.id")
def report_totals(spark, sf):
    n, e = D.nodes(spark, sf).withColumn("ghost", F.col("decl_file") == "PROMO"), D.dag(spark, sf)
    a = metrics.analyse(n, e)
    return views.report_totals(views.report_rows(n, a["metrics"], a["per_root"], roots_only=False))


@query(f"WITH {CYC_SQL} SELECT count(*) AS rows, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (bounded) AS bounded, count(DISTINCT CASE WHEN recursive THEN id END) AS recursive, count(DISTINCT CASE WHEN ghost THEN id END) AS ghosts FROM RS")
def report_totals_cyclic(spark, sf):
    return views.report_totals(_cyclic_report(spark, sf))


@query(f"WITH {CYC_SQL} SELECT count(*) FILTER (PKC.peak > 4096) AS critical, count(*) FILTER (PKC.peak > 1024 AND PKC.peak <= 4096) AS warning, count(*) FILTER (V.id IN (SELECT id FROM REC)) AS recursive, count(*) AS functions FROM V JOIN S ON S.id = V.id JOIN PKC ON PKC.scc = S.scc")
def report_cards(spark, sf):
    return views.cards(metrics.peaks(D.nodes(spark, sf), D.cyclic(spark, sf)))


@query(f"WITH {PATHS_SQL}, C AS (SELECT src, string_agg(CAST(dst AS VARCHAR), ';' ORDER BY seq) AS c FROM E_dag GROUP BY src) SELECT V.id, V.frame, PK.peak, coalesce(C.c, '') AS callees FROM V JOIN PK ON PK.id = V.id LEFT JOIN C ON C.src = V.id")
def cli_rows(spark, sf):
    n, e = D.nodes(spark, sf), D.dag(spark, sf)
    return views.cli_rows(n, metrics.analyse(n, e)["metrics"], e).select("id", "frame", "peak", "callees")


@query(f"WITH {PATHS_SQL} SELECT id FROM PK ORDER BY peak DESC, id LIMIT 1")
def default_focus(spark, sf):
    n = D.nodes(spark, sf)
    return views.default_focus(n, metrics.peaks(n, D.dag(spark, sf)))


@query("WITH L AS (SELECT id, file, frame AS peak, id % 6 AS layer FROM V) SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY peak DESC, id) - 1 AS pos FROM L")
def layer_layout(spark, sf):
    n = D.nodes(spark, sf).select("id", "file", F.col("frame").alias("peak"), (F.col("id") % 6).alias("layer"))
    return views.layout(n).select("id", "layer", long("pos"))


FILES_SQL = """L AS (SELECT id, file, frame AS peak, id % 6 AS layer FROM V), M AS (SELECT *, max(peak) OVER (PARTITION BY layer, file) AS fmax FROM L),
O AS (SELECT *, row_number() OVER w AS r, CASE WHEN lag(file) OVER w <> file THEN 1 ELSE 0 END AS ch FROM M WINDOW w AS (PARTITION BY layer ORDER BY fmax DESC, file, peak DESC, id)),
G AS (SELECT id, file, layer, CAST(r - 1 + sum(ch) OVER (PARTITION BY layer ORDER BY r) AS BIGINT) AS pos FROM O)"""


@query(f"WITH {FILES_SQL} SELECT file, layer, min(pos) AS top, max(pos) AS bottom, count(*) AS n FROM G GROUP BY file, layer")
def file_frames(spark, sf):
    n = D.nodes(spark, sf).select("id", "file", F.col("frame").alias("peak"), (F.col("id") % 6).alias("layer"))
    return views.file_boxes(views.layout(n, by_file=True).withColumn("pos", F.col("pos").cast("long")))


# Changes.

STALE_SQL = """U AS (SELECT p_partkey AS id, 'p' || CAST(p_partkey AS VARCHAR) AS path, p_size AS size FROM part),
CA AS (SELECT id FROM U WHERE id % 3 <> 0 AND id % 7 <> 1), INC AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'gone' ELSE 'inc' || CAST(id % 11 AS VARCHAR) END AS inc FROM CA),
BAD AS (SELECT id FROM INC WHERE inc = 'gone' OR inc = 'inc4')"""


@query(f"WITH {STALE_SQL} SELECT id FROM U WHERE id NOT IN (SELECT id FROM CA) OR id IN (SELECT id FROM BAD)")
def stale_units(spark, sf):
    p = D.table(spark, sf, "part")
    units = incremental.unit_keys(p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.lit(100).alias("mtime"), F.col("p_size").alias("size"), F.array(F.col("p_brand")).alias("args")))
    cached = units.filter("id % 3 <> 0 and id % 7 <> 1").select("unit_key", F.lit(500).alias("cached_at"), "id")
    inc = cached.select("unit_key", F.when(F.col("id") % 5 == 0, "gone").otherwise(F.concat(F.lit("inc"), (F.col("id") % 11).cast("string"))).alias("include"))
    files = spark.range(11).select(F.concat(F.lit("inc"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") == 4, 900).otherwise(100).alias("mtime"))
    return incremental.stale_units(units, cached.drop("id"), inc, files).select("id")


@query("""WITH G AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
B AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM G)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM B GROUP BY user_id, b""", graph=False)
def debounce_sessions(spark, sf):
    return incremental.bursts(D.table(spark, sf, "events"), 6 * 3600)


@query("SELECT event_type AS category, least(count(*), 20) AS shown, greatest(count(*) - 20, 0) AS hidden FROM events GROUP BY 1", graph=False)
def message_counts(spark, sf):
    return views.frequent_messages(D.table(spark, sf, "events").select(F.col("event_type").alias("category")))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the twenty heaviest functions of the derived graph with their severity."""
    n = D.nodes(spark, sf)
    pk = metrics.peaks(n, D.dag(spark, sf))
    return views.top(pk.join(n.select("id", "name"), "id"), "peak", 20).select("id", "name", "peak", S.severity("peak").alias("severity"))
