"""Rows and pages of awkward shape, and what the schedule decides."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweight.llm import html, mixing, passages, text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def test_passages_of_rows_that_share_an_id(spark):
    r = random.Random(31)
    shared = " ".join(words(r, 80))
    text = lambda a, b: " ".join([*words(r, a), shared, *words(r, b)])
    rows = [(1, text(5, 30)), (2, text(60, 0)), (2, text(0, 90)), (2, "short"), (3, " ".join(words(r, 99)))]
    rows += rows[1:2] * 2  # repeated rows are one document
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((x.doc_id, x.start_word, x.end_word, x.partner_id, x.partner_start, x.partner_end) for x in passages.repeated_passages(d.repartition(p)).collect()) for p in (1, 3, 40)]
    assert got[0] == got[1] == got[2] and {(x[0], x[1], x[2]) for x in got[0]} == {(1, 5, 85), (2, 60, 140), (2, 0, 80)}


def test_pages_of_great_depth_take_linear_time():
    for page in ("<div class=ad>" * 60_000 + "x", "<a" * 400_000, "<div class=ad>t" * 50_000, "<b>x" * 100_000 + "<p>y" * 1000, "<header><b>x" * 60_000, "<!-- " * 200_000, "<p title='" * 80_000):
        t = time.time()
        html.parse(page)
        assert time.time() - t < 6


def test_blocks_go_on_around_what_is_left_out():
    got = [b[0] for b in html.parse("<p>The value is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here <button>buy</button>and <object data=a>there</object> or<script>s()</script> <svg><text>no</text></svg>then<!-- c --> on.</p><p>Two<select><option>a</select>!</p>")]
    assert got == ["The value is x=2 here and there or then on.", "Two!"]


def test_a_teaser_does_not_replace_the_text():
    body, teaser = "<div>" + "<p>The text of this page lies here.</p>" * 6 + "</div>", "<article><p>" + "Read more in another place. " * 12 + "</p></article>"
    got = " ".join(b[0] for b in html.parse(f"<body>{body}{teaser}</body>"))
    assert "The text of this page" in got
    got = " ".join(b[0] for b in html.parse(f"<body><article>{'<p>The article is long.</p>' * 30}</article><div>Some other words</div></body>"))
    assert "other" not in got


def mixed(spark):
    r = random.Random(33)
    rows = [(i, " ".join(words(r, r.randrange(1, 120))), "en", ("a", "a", "b", None)[i % 4], 0) for i in range(700)]
    return spark.createDataFrame(rows, DOCS)


def test_the_schedule_decides_the_order_of_the_mix(spark, monkeypatch):
    d = mixed(spark)
    one = {x.doc_id: x for x in mixing.mix_sources(d).collect()}
    assert all((x.first_slot is None) == (x.taken == 0) for x in one.values())
    order = [x.doc_id for x in mixing.realise(d).collect()]
    assert order == [x.doc_id for x in mixing.realise(d.repartition(5)).collect()]
    first = {}
    for k, i in enumerate(order):
        first.setdefault(i, k)
    fully = [i for i in first if one[i].taken >= one[i].size]
    assert all(one[a].first_slot <= one[b].first_slot for a, b in zip(sorted(fully, key=first.get), sorted(fully, key=first.get)[1:]))
    # every prefix is near the target shares
    target = {x.src: x.t for x in d.join(spark.createDataFrame([(x.doc_id, x.target) for x in one.values()], "doc_id long, t double"), "doc_id").groupBy(F.col("source").alias("src")).agg(F.first("t").alias("t")).collect()}
    source = {x.doc_id: x.source for x in d.collect()}
    seen, total = Counter(), 0
    for k, i in enumerate(order):
        seen[source[i]] += one[i].size
        total += one[i].size
        if total > 8000 and k < 0.9 * len(order):
            assert all(abs(seen[s] / total - t / sum(target.values())) < 0.06 for s, t in target.items()), k
    # another sequence of points gives another order, and the same totals
    monkeypatch.setattr(mixing, "GOLDEN", 0.41421356237)
    two = {x.doc_id: x for x in mixing.mix_sources(d).collect()}
    assert sum(one[i].first_slot != two[i].first_slot for i in one) > 350
    assert [x.doc_id for x in mixing.realise(d).collect()] != order
    total = lambda m, s: sum(x.taken for i, x in m.items() if source[i] == s)
    assert all(total(one, s) == total(two, s) for s in target)


@pytest.mark.parametrize("length,changed", [(45, 5), (60, 9), (60, 12), (100, 20), (200, 44)])
def test_fuzzy_passages_are_found(spark, length, changed):
    r = random.Random(length * 100 + changed)
    rows = []
    for k in range(40):
        p = words(r, length)
        q = list(p)
        for i in r.sample(range(length), changed):
            q[i] = f"x{r.randrange(10**9)}"
        rows += [(2 * k, " ".join([*words(r, 40), *p, *words(r, 40)])), (2 * k + 1, " ".join([*words(r, 60), *q, *words(r, 10)]))]
    found = {x.doc_id for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) >= 0.85 * 80, len(found) / 80


def linked(spark, docs):
    """Sets of classes by document, and pairs of documents in rows."""
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert all(x.matched >= 0.75 * max(x.end_word - x.start_word, x.partner_end - x.partner_start) and min(x.end_word - x.start_word, x.partner_end - x.partner_start) >= 40 for x in got)
    held = [set() for _ in docs]
    for x in got:
        held[x.doc_id].add(x.class_id)
    return held, {(x.doc_id, x.partner_id) for x in got}


def altered(r, p, changed):
    """p with so many places changed, left out or put in, of which no two are one and the ends are none."""
    q = list(p)
    for i in sorted(r.sample(range(1, len(p) - 1), changed), reverse=True):
        q[i : i + 1] = [(f"x{r.randrange(10**9)}",), (), (q[i], f"x{r.randrange(10**9)}")][r.choice([0, 0, 0, 1, 2])]
    return q


def test_passages_without_long_runs_are_linked(spark):
    r = random.Random(61)
    docs, pairs = [], []
    for k in range(60):
        p = words(r, 60 if k % 3 else 40 if k < 30 else 50)
        q = [f"x{r.randrange(10**9)}" if i % 4 == 1 else w for i, w in enumerate(p)] if k < 30 else altered(r, p, len(p) // 5)  # runs of three words only; or changes of all kinds
        docs += [words(r, 20) + p[i : i + 9] + words(r, 20) for i in (0, 12, 24)]  # earlier holders of its parts
        pairs.append((len(docs), len(docs) + 2))
        docs += [words(r, 50) + p + words(r, 50), words(r, 20) + p[3:12] + words(r, 20), words(r, 70) + q + words(r, 9)]
    held, _ = linked(spark, docs)
    assert [(a, b) for a, b in pairs if not held[a] & held[b]] == []
    assert not any(h for i, h in enumerate(held) if i % 6 not in (3, 5))


def test_all_holders_of_a_hot_line_are_looked_at(spark):
    r = random.Random(62)
    line = words(r, 12)
    docs = []
    for k in range(120):  # all hold the line; two by two they share what is around it, or nothing
        if k % 4 == 0:
            a, b = words(r, 16), words(r, 16)
        own = (a, b) if k % 4 < 2 else (words(r, 16), words(r, 16))
        own = [[w if j % 4 else f"y{r.randrange(10**9)}" for j, w in enumerate(o)] if k % 4 == 1 else o for o in own]
        docs.append(words(r, 5 + k % 7) + own[0] + line + own[1] + words(r, 50))
    held, rows = linked(spark, docs)
    assert rows == {x for k in range(0, 120, 4) for x in ((k, k + 1), (k + 1, k))}


def test_stretches_of_one_word_are_linked_by_few_rows(spark):
    r = random.Random(63)
    docs = [words(r, 10 + k) + ["of"] * (45 + 3 * k) + words(r, 20) + ["la"] * (10 + k) for k in range(20)]
    held, rows = linked(spark, docs)
    assert all(h & held[0] for h in held) and len(rows) < 200


def test_a_stretch_of_one_word_sends_its_ends_only():
    """All places of a stretch had a window before; windows between the ends follow from theirs."""
    rng, reach = np.random.default_rng(3), 37
    line = [f"a{rng.integers(9**9)}" for _ in range(45)] + ["of"] * 50 + [f"b{rng.integers(9**9)}" for _ in range(45)]
    w = text.words(np.frombuffer(" ".join(line).encode(), np.uint8), np.array([0, len(" ".join(line))]))
    at = np.arange(45, 93, dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([" ".join(line)]), *(pa.array([x.tobytes()]) for x in (at, np.full(48, 5), np.zeros(48, np.int64)))], ["key", "text", "places", "seeds", "labels"])
    (got,) = passages._windows(3, reach, 1)(iter([batch]))
    wins = passages._wide(got.column("wins")[0].as_py(), 2 * reach + 3)
    assert np.frombuffer(got.column("places")[0].as_py(), np.int32).tolist() == [45, 92]
    assert np.frombuffer(got.column("more")[0].as_py(), np.int32).tolist() == [47, -47]
    h = np.maximum(w.hash >> np.uint64(52), np.uint64(1))
    for rest in range(reach):
        place = 92 - rest
        assert passages._between(wins[:1], wins[1:], np.array([47]), rest, 3, reach)[0].tolist() == h[place - reach : place + reach + 3].tolist()


def test_bounds_of_the_second_look_agree_with_plain_alignments():
    rng = np.random.default_rng(4)
    u, v = (rng.integers(0, 6, (300, 37)).astype(np.uint16) for _ in range(2))
    got = passages._agreeing(u, v)
    for r in range(300):
        a, b = u[r].astype(int), v[r].astype(int)
        assert got[:, r].tolist() == passages._matches(np.where(a, a, -1), b)[:, -1].tolist()
    for words in (3, 12, 40):
        for _ in range(200):
            x, y = (rng.integers(0, words, rng.integers(1, 41)) for _ in range(2))
            best, far = passages._matches(x, y), np.maximum(np.arange(len(x) + 1)[:, None], np.arange(len(y) + 1))
            assert passages._may_agree(x, y, 0.75) or not (best >= 0.75 * far)[1:, 1:].any()


def test_alignment_builds_no_matrix_of_counts(monkeypatch):
    """Every end that was grown built one before; counts in the bits of a number give the same ends."""
    rng, plain = np.random.default_rng(5), passages._matches
    monkeypatch.setattr(passages, "_matches", None)
    for words in (2, 5, 12, 40):
        for _ in range(150):
            x, y = (rng.integers(0, words, rng.integers(1, 41)) for _ in range(2))
            best, spare = plain(x, y), float(rng.integers(0, 24)) / 2
            assert passages.matched_in_gap(x.tolist(), y.tolist()) == best[-1, -1]
            far = np.maximum(np.arange(len(x) + 1)[:, None], np.arange(len(y) + 1))
            ends = [(i, j, int(best[i, j])) for i in range(1, len(x) + 1) for j in range(1, len(y) + 1) if x[i - 1] == y[j - 1]]
            assert list(passages._ends(x.tolist(), y.tolist())) == ends
            able = [e for e in ends if e[2] - 0.75 * max(e[:2]) >= -spare]
            want = min(able, key=lambda e: (-min(e[:2]), -e[2], e[0] + e[1]), default=(0, 0, 0))
            assert passages.reach(x.tolist(), y.tolist(), 0.75, spare) == want
            assert passages._may_grow(x.tolist(), y.tolist(), 0.75, spare) or not able
            if x[0] != y[0]:  # what comes first: up to MARGIN words that are worth most
                worth = best - 0.75 * far
                i, j = min(zip(*np.nonzero(worth >= worth.max() - 1e-9), strict=True), key=lambda e: (-best[e], sum(e)))
                got = passages.extend(x.tolist(), y.tolist(), 0.75)
                assert got == (0, 0, 0) if not best[i, j] else got[0] >= i and got[1] >= j and got[2] >= best[i, j]
