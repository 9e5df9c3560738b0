"""The whole run from facts, frames and rules to reports, and its exit codes."""

import csv
import json
import os

from callweight import program

FN = ("usr", "name", "file", "decl_file", "line0", "is_static")


def unit(path, records, edges=(), sites=()):
    return {
        "unit": path, "records": [dict(zip(FN, r, strict=True)) for r in records], "edges": [{"usr": a, "callee": b} for a, b in edges],
        "indirect_sites": [{"caller_usr": u, "line": ln, "via": via, "targets": [], "extra_candidates": [], "via_param": vp, "caller_name": ""} for u, ln, via, vp in sites],
        "arg_funcs": [{"callee": "main", "idx": 0, "funcs": ["cb"]}] if path.endswith("a.c") else [], "param_fwd": [], "includes": [],
    }


def project(tmp_path):
    w = str(tmp_path / "w")
    (tmp_path / "w").mkdir(exist_ok=True)
    for f in ("a.c", "b.c"):
        (tmp_path / "w" / f).write_text("")
    a = unit(f"{w}/a.c", [("u:main", "main", f"{w}/a.c", f"{w}/api.h", 1, False), ("u:a.s", "s", f"{w}/a.c", f"{w}/a.c", 5, True), ("u:cb", "cb", f"{w}/a.c", f"{w}/a.c", 9, False)], [("u:main", "s"), ("u:main", "lib"), ("u:a.s", "leaf")], [("u:main", 3, "cb", 0), ("u:a.s", 7, "hook", -1)])
    b = unit(f"{w}/b.c", [("u:leaf", "leaf", f"{w}/b.c", f"{w}/b.h", 1, False), ("u:b.s", "s", f"{w}/b.c", f"{w}/b.c", 4, True), ("u:dead", "dead", f"{w}/b.c", f"{w}/b.c", 8, False)], [("u:b.s", "leaf"), ("u:leaf", "dead")])
    other = unit(f"{w}/not_built.c", [("u:x", "x", f"{w}/not_built.c", f"{w}/x.h", 0, False)])
    (tmp_path / "facts.json").write_text("\n".join(json.dumps(x) for x in (a, b, other)))
    (tmp_path / "compile_commands.json").write_text(json.dumps([{"directory": w, "file": f, "arguments": ["cc", "-c", f]} for f in ("a.c", "b.c")]))
    (tmp_path / "su").mkdir()
    (tmp_path / "su" / "all.su").write_text("a.c:2:1:main\t100\tstatic\na.c:6:1:s\t20\tstatic\nb.c:5:1:s\t300\tstatic\nb.c:leaf\t7\tdynamic\nasm.c:1:1:ghost\t64\tstatic\na.c:10:1:cb\t1000\tstatic\n")
    (tmp_path / "o.json").write_text(json.dumps({"overrides": [{"caller": "main", "via": "cb", "targets": ["cb", "nowhere"]}, {"caller": "s", "file": "a.c", "conditional": [{"when": {"fromRoot": "main"}, "targets": ["cb"]}, {"when": {"fromRoot": "q"}, "targets": ["none"]}]}, {"caller": "absent", "targets": ["cb"]}]}))
    (tmp_path / "r.json").write_text(json.dumps({"removals": [{"callee": "dead"}, {"callee": "never"}]}))
    return ["--root", str(tmp_path), "--facts", str(tmp_path / "facts.json"), "--su-dir", str(tmp_path / "su"), "--fp-overrides", str(tmp_path / "o.json"), "--edge-removals", str(tmp_path / "r.json")]


def test_run(spark, tmp_path):
    args = project(tmp_path)
    out, table, page = tmp_path / "out.json", tmp_path / "out.csv", tmp_path / "out.html"
    assert program.main([*args, "--root-pattern", "*api.h", "--out", str(out), "--csv", str(table), "--report", str(page), "--cache-dir", str(tmp_path / "cache")], spark) == 0
    got = json.loads(out.read_text())
    by = got["byName"]
    assert set(by) == {"main", "s@a", "s@b", "leaf", "cb", "dead", "ghost"}  # the unit that is not built stays out
    assert by["main"]["callees"] == ["s@a", "cb"] and by["s@a"]["callees"] == ["leaf", "cb"] and by["leaf"]["callees"] == []
    assert {k: v["stackBytes"] for k, v in by.items()} == {"main": 100, "s@a": 20, "s@b": 300, "leaf": 7, "cb": 1000, "dead": None, "ghost": 64}
    assert by["main"]["peak"] == 1120 and by["s@b"]["peak"] == 307 and by["ghost"]["peak"] == 64
    assert got["pinnedRoots"] == ["main"] and got["autoRoots"] == ["dead", "ghost", "s@b"] and got["meta"]["fileCount"] == 2
    assert by["main"]["fpSites"][0]["overridden"] and by["main"]["fpVerified"] and not by["s@a"]["fpVerified"]
    rows = list(csv.reader(table.open(newline="")))
    assert rows[0] == ["function", "file", "line", "frame_bytes", "peak_bytes", "peak_bounded", "max_depth", "recursive", "severity", "callees"]
    assert [r for r in rows if r[0] == "main"] == [["main", str(tmp_path / "w" / "a.c"), "2", "100", "1120", "no", "1", "no", "warn", "s@a;cb"]]
    assert "<td>main</td>" in page.read_text() and spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_build_reports_rules_without_effect(spark, tmp_path):
    project(tmp_path)
    from callweight.sources import readers

    tables = readers.merge_facts(readers.fact_tables(readers.read_facts(spark, str(tmp_path / "facts.json"))))
    rules = json.loads((tmp_path / "o.json").read_text())["overrides"]
    g = program.build(tables, rules, [{"callee": "dead"}, {"callee": "never"}])
    assert [r.caller for r in g.unused_overrides.collect()] == ["absent"] and [r.rule for r in g.unused_removals.collect()] == [1]
    assert {(r.src, r.dst, r.indirect, r.cond_id is None) for r in g.calls.collect()} == {("main", "s@a", False, True), ("main", "cb", True, True), ("s@a", "leaf", False, True), ("s@a", "cb", True, False), ("s@b", "leaf", False, True)}
    plain = program.build(tables)
    assert plain.calls.count() == 4 and not any(r.overridden for r in plain.sites.collect())
    got = readers.suggestions(tables["raw_sites"], tables["fn_defs"], readers.suggest_targets(tables))
    assert [tuple(r) for r in got.collect()] == [("u:main", 3, "cb", ["cb"])]


def test_exit_codes(spark, tmp_path):
    args = project(tmp_path)
    (tmp_path / "empty").mkdir()
    assert program.main(["--root", str(tmp_path / "empty"), *args[2:]], spark) == program.NO_BUILD_DB
    assert program.main([*args[:2], "--facts", str(tmp_path / "gone.json")], spark) == program.NO_FACTS


def test_many_homonyms_multiply_nothing(spark):
    from callweight.operators import resolve

    f = spark.createDataFrame([(f"{i}", "hot", f"f{i}.c", i) for i in range(1000)] + [("c", "caller", "f7.c", 5000)], "id string, name string, file string, ord int")
    raw = spark.createDataFrame([("c", f"f{i}.c", "hot", i) for i in range(1000)] + [("c", "none.c", "hot", 1000)], "src string, src_file string, callee string, seq int")
    d = resolve.resolve_names(raw, f)
    assert d.count() == 1001 and {r.dst for r in d.filter("src_file in ('f7.c', 'none.c')").collect()} == {"7", "0"}


def test_the_document_reads_back(spark, tmp_path):
    from callweight.sources import readers, sinks

    args = project(tmp_path)
    out = tmp_path / "out.json"
    assert program.main([*args, "--root-pattern", "*api.h", "--out", str(out)], spark) == 0
    by = json.loads(out.read_text())["byName"]
    got = readers.read_result(spark, str(out))
    f = {r.id: r for r in got["functions"].collect()}
    assert set(f) == set(by)
    for k, want in by.items():
        r = f[k].asDict(recursive=True)
        for field, v in want.items():
            if field == "conditional":
                v = [{"targets": c["targets"], "cond": json.dumps(c["cond"], separators=(",", ":"))} for c in v]
                r[field] = [{"targets": c["targets"], "cond": c["cond"].replace(" ", "")} for c in r[field]]
            assert r[field] == v, (k, field)
    assert by["s@a"]["conditional"] == [{"targets": ["cb"], "cond": {"fromRoot": "main"}}] and by["s@a"]["indirect"] == ["cb"]
    assert {(r.root, r.is_pinned, r.is_auto) for r in got["roots"].collect()} == {("main", True, False), ("dead", False, True), ("ghost", False, True), ("s@b", False, True)}
    assert {(r.src, r.dst, r.indirect) for r in got["calls"].collect()} >= {("main", "cb", True), ("s@a", "leaf", False)}
    assert got["per_root"].filter("id = 'leaf' and root = 'main'").first().depth == 3 and got["sites"].count() == 2 and got["conditional"].count() == 1
    # the same text from one task and from twenty, and from the driver's pipe
    rows = spark.range(500).selectExpr("cast(id as string) id", "concat('{\"n\":', id, '}') text")
    roots = rows.selectExpr("id root", "id < '3' is_pinned", "id > '4' is_auto")
    texts = []
    for parts in ("1", "20"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        sinks.write_document(rows.repartition(int(parts)), roots, {"a": 1}, str(tmp_path / parts))
        texts.append((tmp_path / parts).read_text())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert texts[0] == texts[1] == "".join(sinks.document_parts(rows, roots, {"a": 1})) and len(json.loads(texts[0])["byName"]) == 500
    assert not [p for p in os.listdir(tmp_path) if ".parts-" in p]


def test_a_second_run_scans_what_changed(spark, tmp_path):
    args = project(tmp_path)
    header = tmp_path / "w" / "x.h"
    header.write_text("")
    facts = [json.loads(x) for x in (tmp_path / "facts.json").read_text().splitlines()]
    for f in facts:
        f["includes"] = [str(header)] if f["unit"].endswith("a.c") else []
    (tmp_path / "facts.json").write_text("\n".join(json.dumps(f) for f in facts) + "\nnot a unit")
    (tmp_path / "fp-overrides.json").write_text((tmp_path / "o.json").read_text())  # found without being named
    at = args.index("--fp-overrides")
    args = [*args[:at], *args[at + 2 :], "--cache-dir", str(tmp_path / "cache"), "--out", str(tmp_path / "out.json")]

    def counts():
        assert program.main(args, spark) == 0
        doc = json.loads((tmp_path / "out.json").read_text())
        return doc["byName"], doc["meta"]["counts"]

    first, c = counts()
    assert (c["units"], c["scanned"], c["fromCache"], c["unreadableLines"], c["unresolvedCalls"]) == (2, 2, 0, 1, 1) and first["main"]["fpVerified"]
    (tmp_path / "facts.json").write_text("")  # whatever is read now comes from the cache
    second, c = counts()
    assert second == first and (c["scanned"], c["fromCache"], c["withoutFacts"]) == (0, 2, 0)
    os.utime(header, (4e9, 4e9))
    (tmp_path / "facts.json").write_text("\n".join(json.dumps(f) for f in facts))
    third, c = counts()
    assert third == first and (c["scanned"], c["fromCache"]) == (1, 1)
    os.utime(header, (1e9, 1e9))
    header.unlink()
    (tmp_path / "w" / "b.c").unlink()
    left, c = counts()
    assert (c["units"], c["scanned"], c["missingFiles"]) == (1, 1, 1) and "s@b" not in left and left["s"]["peak"] == 1020
