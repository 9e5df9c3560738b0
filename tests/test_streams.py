"""Change streams that see deletions and restart, debounce and single flight."""

import os
import time

from pyspark.sql import functions as F

from callweight.streaming import debounce, watch


def drain(spark, sources, state, checkpoint, out):
    q = watch.watch(spark, sources, state).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r.kind, os.path.basename(r.path), r.change) for r in spark.read.schema(watch.SCHEMA).parquet(out).collect())


def test_changes_and_deletions_survive_a_restart(spark, tmp_path):
    src, state, ck, out = (str(tmp_path / x) for x in ("src", "state", "ck", "out"))
    os.makedirs(f"{src}/deep")
    sources = {"source": (src, "*.c"), "frames": (src, "*.su")}
    for f in ("a.c", "deep/b.c", "x.su", "other.txt"):
        open(f"{src}/{f}", "w").close()
    seen = [("frames", "x.su", "created"), ("source", "a.c", "created"), ("source", "b.c", "created")]
    assert drain(spark, sources, state, ck, out) == seen
    assert drain(spark, sources, state, ck, out) == seen  # nothing happened: nothing is repeated
    os.remove(f"{src}/a.c")
    os.utime(f"{src}/x.su", (5, 5))
    with open(f"{src}/new.c", "w") as f:
        f.write("int x;")
    seen += [("source", "a.c", "deleted"), ("frames", "x.su", "changed"), ("source", "new.c", "created")]
    assert drain(spark, sources, state, ck, out) == sorted(seen)
    # a listing that was written, but whose batch died before it was done
    os.remove(f"{src}/new.c")
    reader = watch.ChangeReader(sources, state, 4)
    end = reader.latestOffset()
    open(f"{src}/new.c", "w").close()  # it is back before the restart; the deletion has been seen all the same
    assert end["listing"] == reader._last()
    seen += [("source", "new.c", "changed")]
    assert drain(spark, sources, state, ck, out) == sorted(seen)
    assert len([f for f in os.listdir(state) if f.endswith(".json")]) <= 3


def test_reader_differences(tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "a.c").write_text("1")
    r = watch.ChangeReader({"k": (str(src), "*.c")}, str(tmp_path / "state"), 3)
    rows = lambda a, b: sorted((x[1].rsplit("/", 1)[1], x[2]) for p in r.partitions(a, b) for x in r.read(p))
    zero, one = r.initialOffset(), r.latestOffset()
    assert r.latestOffset() == one and rows(zero, one) == [("a.c", "created")]
    (src / "a.c").unlink()
    (src / "b.c").write_text("1")
    two = r.latestOffset()
    assert rows(one, two) == [("a.c", "deleted"), ("b.c", "created")] and rows(zero, two) == [("b.c", "created")]
    assert rows(one, two) == rows(one, two)  # the same again after a restart
    r.commit(two)
    assert os.listdir(tmp_path / "state") == ["000000000001.json"]


def test_a_burst_is_one_request(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    sources = {"p": (str(src), "*.c"), "q": (str(src), "*.h")}
    changes = watch.watch(spark, sources, str(tmp_path / "state")).select(F.col("kind").alias("project"), "modified")
    asked = []
    flight = type("Flight", (), {"request": lambda self, key: asked.append((key, time.time()))})()
    q = debounce.run_on_change(debounce.debounced(changes, 4000), flight, str(tmp_path / "ck"), "100 milliseconds")
    try:
        last = 0.0
        for k in range(3):
            (src / f"{k}.c").write_text("x")
            last = time.time()
            time.sleep(0.7)
        (src / "y.h").write_text("x")
        end = time.time() + 60
        while time.time() < end and len(asked) < 2:
            time.sleep(0.2)
        time.sleep(2)
        assert sorted(k for k, _ in asked) == ["p", "q"] and all(t - last >= 3 for _, t in asked)
        (src / "0.c").unlink()  # a deletion is a change too
        end = time.time() + 60
        while time.time() < end and len(asked) < 3:
            time.sleep(0.2)
        assert [k for k, _ in asked[2:]] == ["p"]
    finally:
        q.stop()


def test_news_cancels_a_run_and_makes_one_more(spark):
    slow = F.udf(lambda x: (time.sleep(0.05), x)[1], "long")
    ran = []

    def run(key, stop):
        rows = 400 if not ran else 4
        ran.append(key)
        spark.range(0, rows, numPartitions=1).select(slow("id")).write.format("noop").mode("overwrite").save()

    f = debounce.SingleFlight(spark, run)
    t = time.time()
    f.request("a")
    time.sleep(3)
    f.request("a")
    f.request("a")  # two more during the run are one
    f.wait()
    assert (f.started, f.cancelled, f.done) == (2, 1, 1) and time.time() - t < 18 and ran == ["a", "a"]
    f.request("b")
    f.wait()
    assert (f.started, f.done) == (3, 2)
    time.sleep(0.5)
    assert f.started == 3  # silence runs nothing
