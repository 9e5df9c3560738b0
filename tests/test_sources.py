"""Readers, rules, scalars, sinks and change handling."""

import json

from pyspark.sql import functions as F

from callweight.functions import scalars as S
from callweight.operators import metrics, resolve, rules, views
from callweight.sources import readers, sinks
from callweight.streaming import incremental


def test_frames(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.su").write_text("src/a.c:3:5:f\t48\tstatic\nC:\\d\\b.c:7:g\t16\tdynamic,bounded\nx.c:k\t4\tstatic\na.cpp:3:5:ns::f2\t6\tstatic\nh 8 static\nbad\tnone\tstatic\n\nsrc/a.c:9:1:f\t48\tdynamic\n")
    (tmp_path / ".git" / "y.su").write_text("z\t1\tstatic\n")
    got = {(r.func, r.line): (r.bytes, r.file) for r in readers.read_frames(spark, str(tmp_path)).collect()}
    assert got == {("f", 3): (48, "src/a.c"), ("g", 7): (16, "C:\\d\\b.c"), ("k", 0): (4, "x.c"), ("f2", 0): (6, "a.cpp:3:5:ns:"), ("h", 0): (8, ""), ("f", 9): (48, "src/a.c")}
    by_name, _ = readers.frame_index(readers.read_frames(spark, str(tmp_path)))
    assert {r.func: r.line for r in by_name.collect()}["f"] == 3
    assert readers.read_frames(spark, str(tmp_path / "none")).count() == 0


def test_build_db(spark, tmp_path):
    f = tmp_path / "compile_commands.json"
    f.write_text(json.dumps([{"directory": "/w/build", "file": "../src/a.c", "command": "gcc -c -I../inc -isystem x -Wall -O2 -o a.o '../src/a.c' -DX=\"a b\""}, {"directory": "/w", "file": "src/a.c", "arguments": ["gcc"]}, {"directory": "/w", "file": "t.txt", "arguments": []}]))
    assert readers.find_build_db(str(tmp_path)) == str(f) and readers.find_build_db(str(tmp_path / "x")) is None
    assert readers.clean_args(["-gcc", "-W", "-Wall", "-w", "-I", "inc", "-I/abs", "-isystem", "s", "-ofast", "-fdump-x", "a.o", "b.obj", "-I"], "/w") == ["-W", "-I/w/inc", "-I/abs", "-isystem", "/w/s", "-ofast", "b.obj"]
    got = readers.read_build_db(spark, str(f)).collect()
    assert [(r.path, r.args) for r in got] == [("/w/src/a.c", ["-I/w/inc", "-isystem", "/w/build/x", "-O2", "-DX=a b"])]


def test_facts_merge_and_resolve(spark, tmp_path):
    a = {"unit": "a", "records": [{"usr": "u1", "name": "f", "file": "a.c", "decl_file": "a.h", "line0": 1, "is_static": False}, {"usr": "u2", "name": "s", "file": "a.c", "decl_file": "a.c", "line0": 5, "is_static": True}], "edges": [{"usr": "u1", "callee": "s"}, {"usr": "u1", "callee": "gone"}], "indirect_sites": [], "arg_funcs": [{"callee": "f", "idx": 0, "funcs": ["s"]}], "param_fwd": [{"callee": "g", "idx": 1, "src": "f", "src_idx": 0}], "includes": ["a.h"]}
    b = {"unit": "b", "records": [{"usr": "u1", "name": "f", "file": "b.c", "decl_file": "a.h", "line0": 9, "is_static": False}, {"usr": "u3", "name": "s", "file": "b.c", "decl_file": "b.c", "line0": 5, "is_static": True}], "edges": [], "indirect_sites": [], "arg_funcs": [], "param_fwd": [], "includes": []}
    (tmp_path / "f.json").write_text(json.dumps(a) + "\n" + json.dumps(b) + "\n{broken\n")
    t = readers.merge_facts(readers.fact_tables(readers.read_facts(spark, str(tmp_path / "f.json"))))
    defs = t["fn_defs"].withColumn("ord", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("unit_ord", "seq")))
    assert {r.usr: r.file for r in defs.collect()} == {"u1": "a.c", "u2": "a.c", "u3": "b.c"}
    keys = resolve.display_keys(defs)
    assert {r.usr: r.key for r in keys.collect()} == {"u1": "f", "u2": "s@a", "u3": "s@b"}
    raw = t["raw_calls"].join(defs.select("usr", F.col("file").alias("src_file")), "usr").select(F.col("usr").alias("src"), "src_file", "callee", "seq")
    assert [(r.src, r.dst) for r in resolve.resolve_calls(raw, defs.withColumn("id", F.col("usr"))).collect()] == [("u1", "u2")]
    assert {(r.callee, r.idx, r.func) for r in readers.suggest_targets(t).collect()} == {("f", 0, "s"), ("g", 1, "s")}


def test_rules_are_read_leniently(spark):
    assert readers.load_rules('{"overrides": [{"caller": "a"}, 3]}', "overrides") == [{"caller": "a"}]
    assert readers.load_rules('[{"callee": "b"}]', "removals") == [{"callee": "b"}]
    assert readers.load_rules("{nope", "removals") == [] and readers.load_rules(None, "x") == []
    assert [r["caller"] for r in rules.usable_overrides([{"caller": "a"}, {"caller": "b", "targets": ["t"]}, {"caller": "c", "conditional": [{"when": {}, "targets": ["t"]}]}])] == ["b", "c"]
    sites = spark.createDataFrame([(1, "a", "x/f.c", 3, "cb"), (2, "a", "g.c", 9, "cb")], "site int, caller string, file string, line1 int, via string")
    table = rules.override_table(spark, [{"caller": "a", "targets": ["any"]}, {"caller": "a", "file": "q/f.c", "line": 3, "targets": ["exact"], "conditional": [{"when": {"fromRoot": "m"}, "targets": ["c"]}]}])
    m = rules.match_overrides(sites, table)
    assert {r.site: r.rule for r in m.collect()} == {1: 1, 2: 0}
    edges, bound, conds = rules.bind(m, [{"targets": ["any"]}, {"targets": ["exact"], "conditional": [{"when": {"fromRoot": "m"}, "targets": ["c"]}]}])
    assert {(r.callee, r.verified, r.cond_id) for r in edges.collect()} == {("any", True, None), ("exact", True, None), ("c", False, 0)} and len(conds) == 1
    assert all(r.overridden for r in bound.collect())


def test_variables(monkeypatch):
    monkeypatch.setenv("CW_X", "1")
    e = lambda v: S.expand_vars(v, "/ws", {"n": "/n"}, "/home/u", None, {"a.b": "c"})
    assert e("${workspaceFolder}/a") == "/ws/a" and e("${workspaceFolder:n}") == "/n" and e("${workspaceFolder:q}") == "${workspaceFolder:q}"
    assert S.expand_vars("${workspaceFolder}${config:k}", config={"k": None}) == "${workspaceFolder}${config:k}"
    assert e("${userHome}${/}${env:CW_X}${env:CW_NONE}") == "/home/u/1" and e("${config:a.b}${config:z}${odd}") == "c${config:z}${odd}"


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("f", 'a"b', "x.c", 5000, 0), ("g", "g", "y<.c", None, 1)], "id string, name string, file string, frame long, ord int")
    e = spark.createDataFrame([("f", "g", 0, False)], "src string, dst string, seq int, indirect boolean")
    a = metrics.analyse(n, e)
    none = spark.createDataFrame([], "id string, line1 int, via string, overridden boolean")
    rows = sinks.document_rows(n, a["metrics"], a["per_root"], e.withColumn("cond_id", F.lit(None).cast("int")), none, [])
    text = sinks.result_document(rows, a["roots"], {"functionCount": 2})
    doc = json.loads(text)
    assert doc["byName"]["f"]["peak"] == 5000 and doc["byName"]["g"]["perRoot"][0]["root"] == "f" and doc["roots"] == ["f"] and doc["meta"]["functionCount"] == 2
    (tmp_path / "j").write_text(text)
    assert readers.read_result(spark, str(tmp_path / "j"))["functions"].count() == 2
    sinks.write_json(sinks.result_rows(n, a["metrics"], a["per_root"], e), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    rep = views.report_rows(n, a["metrics"], a["per_root"], roots_only=False)
    assert [r.severity for r in rep.collect()] == ["critical", "critical"]
    lines = [r.value for r in sinks.csv_lines(rep, ["name", "own_frame"]).collect()]
    assert sorted(lines) == ['"a""b",5000', "g,"]
    rep = sinks.with_flags(rep)
    sinks.write_csv(rep, list(sinks.HOST_COLUMNS.values()), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert "".join(sinks.csv_parts(rep, sinks.HOST_COLUMNS)).startswith("function,file,line,root,root_kind,longest_calls_into,own_frame_bytes,own_qualifier,peak_stack_bytes,peak_bounded,recursive,ghost,severity\r\n")
    page = sinks.html_report(rep, list(sinks.HOST_COLUMNS.values()), views.report_totals(rep).first().asDict())
    assert "y&lt;.c" in page and "critical" in page
    sinks.write_tables(a, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "roots")).count() == 1


def test_invariants(spark):
    from callweight.plans import derived as D

    n, e = D.nodes(spark, "/root/testdata/sf0.001"), D.dag(spark, "/root/testdata/sf0.001")
    a = metrics.analyse(n, e)
    m = a["metrics"].join(n, "id").cache()
    assert m.agg(F.sum("peak"), F.max("peak"), F.max("down_depth")).first()[:] == (118504, 1808, 8)
    for bad in ("peak < frame", "down_depth < 1", "recursive and not bounded", "is_pinned_root and is_auto_root"):
        assert m.filter(bad).isEmpty(), bad
    assert a["per_root"].filter("peak < entry or depth < 1").isEmpty()


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    rows = [("u", f"2024-01-01 00:00:0{s}") for s in (0, 0, 1)] + [("u", "2024-01-01 00:05:00"), ("v", "2024-01-01 01:00:00")]
    d = spark.createDataFrame(rows, "user_id string, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r.n for r in incremental.bursts(d, 10).collect()) == [1, 1, 3]
    d.write.mode("append").parquet(str(src))
    s = spark.readStream.schema("user_id string, ts timestamp").parquet(str(src))
    q = incremental.on_change(s, lambda b: out.append(b.count()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert out == [5]
    w = incremental.stream_bursts(s, "10 seconds", "1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert 3 in [r.n for r in spark.table("bursts").collect()]
    (src / "x.su").write_text("f 8 static")
    c = incremental.change_stream(spark, {"frames": (str(src), "*.su"), "rules": (str(src), "*.json")})
    seen = []
    incremental.on_change(c, lambda b: seen.extend((r.kind, r.path.rsplit("/", 1)[-1]) for r in b.collect()), str(tmp_path / "c3")).awaitTermination(60)
    assert seen == [("frames", "x.su")]
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, mtime int, size int")
    new = spark.createDataFrame([("a", 2, 1), ("c", 1, 1)], "path string, mtime int, size int")
    assert {r.path: r.change for r in incremental.listing_diff(old, new).collect()} == {"a": "changed", "b": "deleted", "c": "created"}
    assert incremental.settings_changed({"a": 1}, {"a": 2}, {"a"}) and not incremental.settings_changed({"z": 1}, {"z": 2}, {"a"})


def test_synthetic_graph(spark):
    n, e = readers.synthetic_graph(spark)
    assert n.count() == 3000 and e.count() == 8867 == e.select("src", "dst").distinct().count()
    f = views.fan(e)
    assert f.filter("fan_in >= 20 and fan_out >= 20").count() == 40
    assert f.agg(F.max("fan_out"), F.max("fan_in")).first()[:] == (32, 35)
    assert n.join(e, n.id == e.dst, "left_anti").count() == 89
    assert metrics.components(n, e).filter("recursive").count() == 100
