"""The filter audit against brute force over all documents and orders."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from callweight.llm import audit

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" if len(w) < 50 else ""
        out += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        out += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        out += "D" if re.search(r"[#$%&*|]", t) else ""
        return out + ("E" if i is not None and i > least[t] else "")

    per = {}
    for i, t, _, s in rows:
        per.setdefault(s or "", []).append((i, fails(i, t)))
    want = {}
    for part, ds in per.items():
        first = Counter()
        for o in permutations("ABCDE"):
            for _, f in ds:
                hit = next((x for x in o if x in f), None)
                first[hit] += 1
        for o in permutations("ABCDE"):
            for k, x in enumerate(o):
                gone = [bool(set(o[:k]) & set(f)) for _, f in ds]
                lost = [i for (i, f), g in zip(ds, gone, strict=True) if x in f and not g]
                kept = sum(not g and x not in f for (_, f), g in zip(ds, gone, strict=True))
                want[part, "".join(o), k + 1] = (kept, len(lost), sum(x in f and g for (_, f), g in zip(ds, gone, strict=True)), sum(f == x for _, f in ds), sum(i in good for i in lost), sum(i in toxic for i in lost), first[x])
    return want


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def random_text(r):
    n = r.choice([3, 48, 49, 50, 51, 70])
    words = [r.choice(["alpha", "Beta", "GAMMA", "delta", "wörd", "é"]) + str(r.randrange(r.choice([5, 400]))) for _ in range(n)]
    return r.choice(" \t\n\x0b") + r.choice([" ", "  ", "\r\n"]).join(words) + r.choice(["", " ", " #", "&"])


def test_equal_to_brute_force(spark):
    r = random.Random(3)
    rows = [(i if r.random() < 0.97 else None, random_text(r), "en", r.choice(["a", "a", "b", "", None, "ß"])) for i in range(300)]
    rows += [(r.randrange(600), r.choice(rows)[1], "en", r.choice(["a", "b"])) for _ in range(150)] + rows[:9]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 600, 2)] + [(4, 1, 1), (None, 1, 1)]
    d, y = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    want = brute(rows, labels)
    assert found(audit.filter_audit(d, y)) == want and len(want) == 4 * 600
    assert found(audit.filter_audit(d.repartition(7), y.repartition(3))) == want


def test_edges_of_the_conditions(spark):
    words = [f"w{i}" for i in range(65)]
    texts = [" ".join(words[:49]), " ".join(words[:50]), " ".join(words + ["w0"] * 35), " ".join(words[:64] + ["w0"] * 36), "A" + "b" * 19, "A" + "b" * 18, "A" + "é" * 19, "a|b", "", None, "\x1c\x85"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    assert found(audit.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))) == brute(rows, [])


def test_odd_rows(spark):
    rows = [(1, None, "en", None), (2, "", None, ""), (3, " \t", "en", "a"), (5, "one", "en", "a"), (5, "one", "en", "a"), (None, "one", "en", "a"), (None, None, None, None), (8, "w " * 200_000, "en", "a"), (9, "w " * 200_000, "en", "b")]
    d = spark.createDataFrame(rows, DOCS)
    labels = [(9, 1, 1)]
    y = spark.createDataFrame(labels, LABELS)
    want = brute(rows, labels)
    for c in ("part", "id", "h", "mask", "n", "good", "toxic", "first", "low", "cells", "step", "own", "before", "quality"):
        d = d.withColumn(c, F.lit("clash"))
    for c in ("text", "source", "id", "good", "n", "part"):
        y = y.withColumn(c, F.lit("clash"))
    assert found(audit.filter_audit(d, y)) == want
    assert audit.filter_audit(d.limit(0), y).count() == 0
