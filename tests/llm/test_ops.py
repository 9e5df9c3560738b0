"""The corpus operators against brute force, on planted cases and on odd inputs."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweight.llm import ann, decontam, html, jaccard, lm, mixing, passages, quality, shards, text, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, 0), (2, "", None, "b", None), (3, " \t\n", "en", "a", 3), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "x y z", "en", "a", 5), (7, "wörd ÀB c", "de", "é", 9), (8, "w " * 60_000, "en", "a", 120_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("sid", F.lit(1)).withColumn("score", F.lit("clash")).withColumn("shard", F.lit(9))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6))) for _ in range(n))


def split(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]


def test_words_match_the_pattern():
    r = random.Random(1)
    texts = ["".join(r.choice(" \t\n\v\f\r\x1cAbZé ß-9") for _ in range(r.randrange(0, 40))) for _ in range(300)] + ["", None]
    data, off = text.column_bytes(pa.array(texts))
    w = text.words(data, off)
    got = [[] for _ in texts]
    for s, e, row in zip(w.start, w.end, w.row, strict=True):
        got[row].append(bytes(w.buf[s:e]).decode())
    assert got == [split(t) for t in texts]
    by = {}
    for h, s, e in zip(w.hash.tolist(), w.start, w.end, strict=True):
        by.setdefault(bytes(w.buf[s:e]), set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


# Sharding


def test_jump_hash_moves_only_into_the_new_shard(spark, odd, none):
    k = np.arange(50_000, dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 7, 16):
        a, b = shards.jump_hash(k, n), shards.jump_hash(k, n + 1)
        assert a.max() < n and ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.01
    got = shards.shard_documents(odd).toPandas()
    assert len(got) == len(ODD) and set(got["size"]) >= {1, 4, 6} and (got.law == "key").all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 16)).all()
    assert got[got.doc_id == 7].text_crc32.iloc[0] == zlib.crc32("wörd ÀB c".encode())
    assert shards.shard_documents(none).count() == 0 and shards.shard_rows(odd).columns == odd.columns


def test_shards_equal_a_scalar_jump_hash(spark):
    def jump(key, n):  # Lamping and Veach, figure 1
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    r = random.Random(15)
    rows = [(r.choice([i, i - 10**12, None if i % 50 == 0 else i * 7]), sentence(r, r.randrange(0, 9)), "en", "s", 0) for i in range(400)] + [(7, "same", "en", "s", 0)] * 3
    d = spark.createDataFrame(rows, DOCS)
    h = {x.doc_id: x.h for x in d.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    got = shards.shard_documents(d.repartition(5)).collect()
    assert all((x.shard, x.grown_shard) == (jump(h[x.doc_id] % 2**64, 16), jump(h[x.doc_id] % 2**64, 17)) for x in got)
    again = shards.shard_documents(d).collect()
    key = lambda x: (x.shard, x.slot, x.doc_id or 0, x.text_crc32)
    assert sorted(map(key, got)) == sorted(map(key, again))
    for s in range(16):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))


# Mixing


def test_targets_stop_and_share_again():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 0)])
    assert [g[0] for g in got] == ["a", "b", "c", None]
    t = {g[0]: g[2] for g in got}
    assert t["a"] == 20 and t["c"] == 0 and abs(sum(t.values()) - 240) < 1e-6 and all(v <= 2 * s + 1e-9 for (s, v) in ((g[1], g[2]) for g in got))


def test_mix(spark, odd, none):
    r = random.Random(2)
    rows = [(i, sentence(r, r.randrange(1, 300)), "en", None if i % 13 == 0 else f"s{i % 4 if i % 3 else 0}", 0) for i in range(600)]
    d = spark.createDataFrame(rows, DOCS)
    a, b = (mixing.mix_sources(x).toPandas().sort_values("doc_id").reset_index(drop=True) for x in (d, d.repartition(7)))
    assert a.equals(b) and len(a) == 600 and (a.taken <= 2 * a["size"]).all()
    a["source"] = [x[3] or "none" for x in rows]
    g = a.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), n=("size", "sum"), s=("source_size", "first"))
    assert (g.n == g.s).all() and (abs(g.k / g.t - 1) < 0.02).all()
    assert abs(a.taken.sum() / (1.5 * a["size"].sum()) - 1) < 0.01
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(none).count() == 0
    assert mixing.realise(d).columns == d.columns and mixing.realise(none).count() == 0 and mixing.realise(odd).count() >= 1


def test_mix_equals_a_replayed_schedule(spark):
    r = random.Random(16)
    rows = [(i, "w " * r.randrange(0, 60), "en", ("a", "b", None)[i % 3 if i % 5 else 0], 0) for i in range(300)]
    d = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x.taken for x in mixing.mix_sources(d, block=16).collect()}
    mixkey = {x.doc_id: x.k for x in d.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("k")).collect()}
    sub = {x.doc_id: x.sub for x in d.select("doc_id", F.pmod(F.xxhash64(F.xxhash64(F.lit(17), "doc_id", "text")), F.lit(64)).alias("sub")).collect()}
    size = {i: len(split(t)) for i, t, *_ in rows}
    sources = {s: [i for i, _, _, x, _ in rows if x == s] for s in ("a", "b", None)}
    goal = mixing.targets([(s, sum(size[i] for i in ids)) for s, ids in sources.items()])
    table = []
    for s, total, want in goal:
        own = min(16, max(1, total // mixing.SLOTS))
        n_blocks, due_words = -(-total // own), min(int(want + 0.5), 2 * total)
        passes, rest = divmod(due_words, total)
        table.append((s, own, n_blocks, rest, passes * n_blocks + -(-rest // own)))
    slots = sum(t[4] for t in table)
    line, times = [], {t[0]: 0 for t in table}
    for s, *_, due in table:
        line += [(s, due / slots)]
    cum = [sum(x[1] for x in line[: k + 1]) for k in range(len(line))]
    for i in range(slots):
        u = (i + 1) * mixing.GOLDEN % 1.0
        s = line[next(k for k, c in enumerate(cum) if u < c or k == len(cum) - 1)][0]
        times[s] += 1
    want = dict.fromkeys(size, 0)
    for s, own, n_blocks, rest, due in table:
        assert abs(times[s] - due) <= 3  # the schedule keeps near its shares; what it gives beyond is left, what it lacks follows
        ids = sorted(sources[s], key=lambda i: (sub[i], mixkey[i], i))
        words_ = [i for i in ids for _ in range(size[i])]
        for rank in range(due):
            b = rank % n_blocks
            for k in range(b * own, min((b + 1) * own, len(words_))):
                # The last pass ends inside its block, at `rest`.
                if rest and rank == due - 1 and k >= rest and b == (rest - 1) // own:
                    continue
                want[words_[k]] += 1
    assert got == want


def test_small_sources_meet_their_targets(spark):
    rows = [(i, "w " * (100 if i % 50 else 7), "en", None if i % 50 == 0 else "big" if i % 50 > 1 else "mid", 0) for i in range(1000)]
    d = spark.createDataFrame(rows, DOCS)
    for block in (None, 4096):
        got = mixing.mix_sources(d, block=block).toPandas()
        got["source"] = got.target
        g = got.groupby("source").agg(k=("taken", "sum"), t=("target", "first"))
        assert len(g) == 3 and (abs(g.k - g.t) <= 0.5 + 1e-6).all() and (got.taken <= 2 * got["size"]).all()


# Near duplicates


def near_brute(rows, pct=75):
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= pct * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, odd, none):
    r = random.Random(5)
    rows, shared = [], sentence(r, 60)
    for i in range(30):
        rows.append(sentence(r, r.randrange(1, 120)) + (" " + shared if i % 3 == 0 else ""))
    base = sentence(r, 80).split()
    for _ in range(40):  # chains of edits: some link to each other and not to the first
        w = list(r.choice(rows[-10:]).split()) if r.random() < 0.4 else list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "q" + str(r.randrange(99))
        rows.append(" ".join(w))
    rows += ["a b c", "A b  C", "a b c d", "", "x", "x"]
    rows = list(enumerate(rows))
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(d).collect()}
    assert got == near_brute(rows)
    kept = {x.doc_id for x in jaccard.one_of_each(d).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}
    o = jaccard.near_duplicates(odd).toPandas()
    assert len(o) == len(ODD) and set(o[o.doc_id.isin([4, 5])].component_id) == {4} and jaccard.near_duplicates(none).count() == 0
    assert jaccard.one_of_each(odd).columns == odd.columns


# Nearest neighbours


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50:90] = v[7]  # one common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [None] * 16), (480, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_sharing(d, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    x = v.astype(np.float64)
    for q, g in got.items():
        s = ann.products(np.repeat(x[q : q + 1], 300, axis=0), x)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert [i for i, _ in g] == want and [p for _, p in g] == [s[i] for i in want]
    assert ann.nearest_sharing(d.limit(0)).count() == 0


def test_nearest_on_odd_rows(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(60, 4)), 1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[9].tolist()), (7, v[9].tolist()), (100, [1.0, 2.0]), (101, [3.0, 1.0]), (102, [3.0, 1.0]), (120, []), (None, v[0].tolist()), (140, [math.inf, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("v", "dim", "is_q", "qb", "rb", "m", "score", "query_id"):
        d = d.withColumn(c, F.lit("clash"))
    got = {}
    for r in ann.nearest_sharing(d, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 100}
    assert got[100] == [(101, 5.0), (102, 5.0)]  # only its own length; ties to the smaller id
    for q in (0, 20, 40):
        s = ann.products(np.repeat(v[q : q + 1], 60, axis=0), v)
        every = [(i, s[i]) for i in range(60) if i != q] + [(7, s[9])] * 2
        assert [x for _, x in got[q]] == [x for _, x in sorted(every, key=lambda p: -p[1])[:20]]


# Language model


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b"ab", b"b", b" ab", b"a", b" ", b"c"]
    lattice = lm.Lattice(pieces)
    p = dict(zip(pieces, np.exp(lattice.logp[0]), strict=True))

    def brute(s):
        return 1.0 if not s else sum(p[s[:k]] * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    w = text.words_of([b"ab abab c ac aaab "])
    got = np.exp(lattice.word_logp(w, np.zeros(5, np.int64)))
    want = [brute(b" " + x) for x in (b"ab", b"abab", b"c", b"ac", b"aaab")]
    assert np.allclose(got, want)
    use = lattice.expected(w, np.zeros(5, np.int64), np.ones(5))
    total = sum(len(x) + 1 for x in (b"ab", b"abab", b"c", b"ac", b"aaab"))
    assert abs(sum(u * len(x) for u, x in zip(use[0], pieces, strict=True)) - total) < 1e-9
    assert np.allclose(lm.log_gamma(np.array([0.001, 0.5, 3.0, 1e4])), [math.lgamma(x) for x in (0.001, 0.5, 3.0, 1e4)])


def test_lm_scores(spark, odd, none):
    r = random.Random(4)
    vocab = [sentence(r, 1) for _ in range(80)]
    rows = [(i, " ".join(r.choice(vocab[: 20 + 3 * (i % 20)]) for _ in range(r.randrange(5, 60))), "en", "s", 0) for i in range(300)] + [(900, "One a", "en", "s", 0), (901, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = lm.score_documents(d, held, rounds=2).toPandas().set_index("doc_id")
    train = [split(t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = {}
    for t in train:
        for w in [*t, None]:
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows:
        w = [*split(t), None]
        g = got.loc[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(g.base_score - sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6
    assert (got.score < 0).all() and got[got.held_out].score.sum() > got[got.held_out].base_score.sum()
    o = lm.score_documents(odd, F.lit(False), rounds=1).toPandas()
    assert len(o) == len(ODD) and o.score.notna().all() and (o[o.doc_id == 5].score.nunique() == 1)
    assert lm.score_documents(none, F.lit(False), rounds=1).count() == 0


def test_lm_scores_equal_brute_force(spark):
    r = random.Random(14)
    vocab = [sentence(r, 1) for _ in range(60)] + ["éa", "q" * 9]
    rows = [(i, " ".join(r.choice(vocab[: 12 + 3 * (i % 16)]) for _ in range(r.randrange(0, 25))), "en", "s", 0) for i in range(120)]
    d = spark.createDataFrame(rows, DOCS)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {x.doc_id: x.score for x in lm.score_documents(d, held, rounds=1).collect()}
    train = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    classes, lattice, totals, hot = lm.learn(spark.createDataFrame([(t,) for t in train], "text string"), 12, rounds=1)
    assert 0 < len(hot.table) < len(vocab)  # words of one text only meet their counts by exchange

    def words_of(t):
        data, off = text.column_bytes(pa.array([t]))
        return text.words(data, off)

    of = {t: int(classes(words_of(t))[0]) for t in {t for _, t, *_ in rows}}
    count, ends = {}, [0] * lm.CLASSES
    for t in train:
        ends[of[t]] += 1
        for w in split(t):
            count[w, of[t]] = count.get((w, of[t]), 0) + 1
    total = {w: sum(count.get((w, c), 0) for c in range(lm.CLASSES)) for w, _ in count}
    n, v = sum(total.values()) + len(train), len(total) + 1
    pieces = dict(zip(lm.load_pieces(), lattice.logp.T, strict=True))

    def marginal(s, c):
        a = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            a[j] = sum(a[i] * math.exp(pieces[s[i:j]][c]) for i in range(j) if s[i:j] in pieces)
        return a[-1]

    for i, t, *_ in rows:
        c = of[t]
        class_n = max(1, sum(k for (_, x), k in count.items() if x == c) + ends[c])
        class_v = max(1, sum(x == c for _, x in count) + (ends[c] > 0))
        lp, seen, drawn = math.log((ends[c] + 0.5) / (sum(ends) + 0.5 * lm.CLASSES)), {}, 0
        for w in [*split(t), None]:
            if w is None:
                p = max(ends[c], 0.5) / class_n
            else:
                whole = max(total.get(w, 0) - lm.DISCOUNT, 0) / n + min(1, lm.DISCOUNT * v / n) * marginal(b" " + w.encode(), c)
                p = max(count.get((w, c), 0) - lm.DISCOUNT, 0) / class_n + min(1, lm.DISCOUNT * class_v / class_n) * whole
            lp += math.log((lm.URN * p + seen.get(w, 0)) / (lm.URN + drawn))
            seen[w] = seen.get(w, 0) + 1
            drawn += 1
        assert abs(got[i] - lp / math.log(10)) < 1e-6 * max(1, abs(lp)), i


def test_classes_learn_from_all_texts(spark):
    r = random.Random(12)
    kinds = [[sentence(r, 1) + str(k) for _ in range(30)] for k in range(4)]
    rows = [(i, " ".join(r.choice(kinds[i % 4 if i % 10 else 3]) for _ in range(30)), "en", "s", 0) for i in range(1200)]
    d = spark.createDataFrame(rows, DOCS)
    a, b = (lm.fit_classes(x, k=4, start=40) for x in (d, d.repartition(7)))
    vocab = {w for _, t, *_ in rows for w in split(t)}
    assert len(a.table) == len(vocab)  # words of all texts
    assert (a.table == b.table).all() and np.allclose(a.logp, b.logp, atol=1e-4) and np.allclose(a.prior, b.prior, atol=1e-4)
    # One more round over all texts changes nothing.
    data, off = text.column_bytes(pa.array([x[1] for x in rows]))
    x = a.counts(text.words(data, off))
    ll = x @ a.logp.T + a.prior
    share = np.exp(ll - ll.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    p = share.T @ x + 0.1
    assert np.abs(np.exp(a.prior) - (share.sum(axis=0) + 1) / (len(x) + 4)).max() < 1e-3
    assert np.abs(np.exp(a.logp) - p / p.sum(axis=1, keepdims=True)).max() < 1e-3


# Repeated passages


def test_chain_is_the_best_chain():
    r = random.Random(6)
    for _ in range(60):
        segs = []
        for _ in range(r.randrange(2, 7)):
            x, y, n = r.randrange(60), r.randrange(60), r.randrange(2, 12)
            segs.append((x, x + n, y, y + n))

        def worth(path, segs=segs):
            w = sum(segs[i][1] - segs[i][0] for i in path)
            for a, b in zip(path[:-1], path[1:], strict=True):
                w -= passages.GAP_COST * (segs[b][0] - segs[a][1] + segs[b][2] - segs[a][3])
            return w

        def ok(a, b, segs=segs):
            return segs[a][1] <= segs[b][0] and segs[a][3] <= segs[b][2]

        best = 0.0
        todo = [[i] for i in range(len(segs))]
        while todo:
            p = todo.pop()
            best = max(best, worth(p))
            todo += [[*p, j] for j in range(len(segs)) if ok(p[-1], j)]
        assert abs(worth(passages.chain(segs)[0]) - best) < 1e-9
        assert sorted(i for p in passages.chain(segs) for i in p) == list(range(len(segs)))


def test_repeated_passages(spark, odd, none):
    r = random.Random(7)
    p = sentence(r, 70).split()
    fuzzy = list(p)
    for k in (10, 25, 41, 60):
        fuzzy[k] = "zz"
    del fuzzy[33]
    texts = [sentence(r, 90) + " " + " ".join(p) + " " + sentence(r, 20), " ".join(p).upper() + " " + sentence(r, 50), sentence(r, 30) + " " + " ".join(fuzzy), sentence(r, 200), " ".join(p[:30]) + " " + sentence(r, 60), sentence(r, 200)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = passages.repeated_passages(d).collect()
    assert {x.doc_id for x in got} == {0, 1, 2}
    one = next(x for x in got if (x.doc_id, x.partner_id) == (1, 0))
    assert (one.start_word, one.end_word, one.partner_start, one.partner_end, one.identity) == (0, 70, 90, 160, 1.0)
    two = next(x for x in got if x.doc_id == 2)
    assert two.start_word >= 30 and two.matched >= 55 and two.identity > 0.85
    assert passages.repeated_passages(odd).count() == 0 and passages.repeated_passages(none).count() == 0


@pytest.mark.parametrize("gap", [60, 100, 200, 290])
def test_passages_round_unrelated_text(spark, gap):
    r = random.Random(gap)
    head, foot = sentence(r, 60), sentence(r, 60)
    d = spark.createDataFrame([(i, f"{head} {sentence(r, gap)} {foot}", "en", "s", 0) for i in range(2)], DOCS)
    got = sorted((x.doc_id, x.start_word, x.end_word) for x in passages.repeated_passages(d).collect())
    assert got == [(i, *x) for i in range(2) for x in ((0, 60), (60 + gap, 120 + gap))]


def test_passages_whose_parts_have_earlier_holders(spark):
    r = random.Random(11)
    lost = []
    for n in range(12):
        p = sentence(r, 60).split()
        q = sentence(r, 45)
        texts = [" ".join(p[:30]), " ".join(p[30:]), " ".join(p[:30]), " ".join(p), " ".join(p[30:]), " ".join(p)]
        texts = [f"{sentence(r, 40)} {x} {sentence(r, 40)}" for x in texts]
        texts += [f"{' '.join(q.split()[:9])} {sentence(r, 70)} {q}", f"{sentence(r, 50)} {q}"]  # its second place has the whole
        d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
        got = {(x.doc_id, x.start_word, x.end_word) for x in passages.repeated_passages(d).collect()}
        lost.append({(3, 40, 100), (5, 40, 100), (6, 79, 124), (7, 50, 95)} - got)
    assert not any(lost)


@pytest.mark.parametrize("seed", range(3))
def test_recall_of_exact_repeats_against_brute_force(spark, seed):
    r = random.Random(100 + seed)
    pool = [sentence(r, r.randrange(60, 110)).split() for _ in range(8)]
    docs = []
    for _ in range(60):
        w = sentence(r, r.randrange(5, 40)).split()
        for _ in range(r.randrange(1, 4)):
            p = r.choice(pool)
            n = r.randrange(20, len(p) + 1)  # halves and overlapping parts too
            k = r.randrange(len(p) - n + 1)
            w += p[k : k + n] + sentence(r, r.randrange(3, 40)).split()
        docs.append(w)
    d = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(docs)], DOCS)
    found = [set() for _ in docs]
    for x in passages.repeated_passages(d).collect():
        assert x.matched >= 0.75 * (x.end_word - x.start_word) and x.end_word - x.start_word >= 40
        found[x.doc_id] |= set(range(x.start_word, x.end_word))
    holders = {}
    for i, w in enumerate(docs):
        for k in range(len(w) - 39):
            holders.setdefault(tuple(w[k : k + 40]), set()).add(i)
    true = [set().union(*(range(k, k + 40) for k in range(len(w) - 39) if len(holders[tuple(w[k : k + 40])]) > 1), set()) for w in docs]
    assert sum(map(len, true)) > 500
    assert sum(len(t & f) for t, f in zip(true, found, strict=True)) >= 0.98 * sum(map(len, true))
    assert all(f or not t for t, f in zip(true, found, strict=True))


@pytest.mark.parametrize("every", [7, 8])
def test_passages_changed_all_along(spark, every):
    r = random.Random(every)
    rows = []
    for _ in range(40):
        p = sentence(r, 50).split()
        rows += [" ".join(p), " ".join(f"q{i}" if i % every == every - 1 else w for i, w in enumerate(p))]
    d = spark.createDataFrame([(i, f"{sentence(r, 60)} {t} {sentence(r, 60)}", "en", "s", 0) for i, t in enumerate(rows)], DOCS)
    got = {(x.doc_id, x.partner_id) for x in passages.repeated_passages(d).collect() if x.end_word - x.start_word >= 47}  # of 50; an end of two words behind a changed one may go
    assert got == {(i, i ^ 1) for i in range(80)}


def test_one_seed_and_unlike_ends():
    p = np.arange(100, 150, dtype=np.uint32)
    q = p.copy()
    q[[3, 7, 11, 15, 19, 28, 32, 36, 40, 44]] += 500  # one run of six words is left
    far = np.arange(1000, 1040, dtype=np.uint32)
    u, v = np.concatenate((far, p, far + 200)), np.concatenate((far + 400, q, far + 600))
    got = passages.align(u, v, 0, 0, [60, 66, 60, 66], 40, 0.75)
    assert len(got) == 1 and got[0][0] <= 41 and got[0][1] >= 88 and got[0][4] == 40
    assert passages.align(u, v[::-1].copy(), 0, 0, [60, 66, 60, 66], 40, 0.75) == []


# Decontamination


def edits(a, b):
    """Fewest word edits of a into any passage of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, odd, none):
    r = random.Random(8)
    items = [(i, sentence(r, r.randrange(1, 50))) for i in range(30)] + [(90, None), (91, ""), (92, "of")]
    docs = []
    for i in range(60):
        w = sentence(r, r.randrange(0, 120)).split()
        if i % 2:
            it = split(items[r.randrange(30)][1])
            for _ in range(r.randrange(0, 1 + len(it) // 5)):
                k = r.randrange(len(it))
                it[k : k + 1] = r.choice([[], ["new"], [it[k], "more"]])
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in it]
        docs.append((i, " ".join(w), "en", "s", 0))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontam.leaks(d, b).collect()}
    want = {}
    for i, t, *_ in docs:
        for k, it in items:
            a = split(it)
            if a and edits(a, split(t)) <= int(decontam.tau(len(a))):
                want[i, k] = edits(a, split(t))
    assert got == want and len(want) > 20
    assert {x.doc_id for x in decontam.clean(d, b).collect()} == {i for i, *_ in docs} - {i for i, _ in want}
    assert decontam.leaks(none, b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0
    assert {x.doc_id for x in decontam.leaks(odd, b).collect()} == set() and decontam.clean(odd, b).count() == len(ODD)


@pytest.mark.parametrize("m", [6, 8, 12, 24, 48, 80, 150])
def test_recall_at_every_length(m):
    assert decontam.measured_recall(m, trials=400) >= decontam.RECALL


@pytest.mark.parametrize("m", [6, 24, 48, 80])
def test_leaks_of_each_length_are_found(spark, m):
    r = random.Random(m)
    items, docs = [], []
    for i in range(60):
        it = [f"{r.randrange(4000)}" for _ in range(m)]
        items.append((i, " ".join(it)))
        for _ in range(int(decontam.tau(m))):
            k = r.randrange(len(it))
            it[k : k + 1] = r.choice([[], ["new"], [it[k], "more"]])
        docs.append((i, " ".join([*sentence(r, 30).split(), *it, *sentence(r, 30).split()]), "en", "s", 0))
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & {(i, i) for i in range(60)}) >= 59  # 0.99 of 60


def test_long_and_repeated_items(spark):
    r = random.Random(31)
    long = " ".join(str(r.randrange(9999)) for _ in range(200_000))
    items = [(i, sentence(r, 20)) for i in range(50)] + [(90, long), (7, "again"), (7, "again")]
    docs = [(1, "x again y", "en", "s", 0), (1, "x again y", "en", "s", 0), (None, items[3][1], "en", "s", 0), (5, long[:4000], "en", "s", 0)]
    d, b = spark.createDataFrame(docs, DOCS).withColumn("bad", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    it = decontam.Items([i for i, _ in items], [t for _, t in items], decontam.MAX_EDIT, decontam.SAMPLES)
    held = it.hash.nbytes + it.marks.nbytes + sum(x.nbytes for t in it.tables for x in t)
    assert held < 2000 * len(it.hash)  # in proportion to the words, not items x longest item
    got = sorted((x.doc_id or 0, x.item_id) for x in decontam.leaks(d, b).collect())
    assert got == [(0, 3), (1, 7), (1, 7), (1, 7), (1, 7)]
    assert [x.doc_id for x in decontam.clean(d, b).collect()] == [5]


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><header>site</header>
<article><h1>Head &amp; line</h1><p><b>First\n one<br>two <p>Second&nbsp;x &lt;b&gt;</p><aside>side</aside><form><label>l</label><input></form><ul><li>a<li>b</ul></article>
<section id="comments"><p>reader</p></section><footer>&copy; x</footer></body></html>"""


def test_main_text(spark, none):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, "plain text"), (4, "http://h/4", ""), (1, "http://h/1", PAGE)]
    site = lambda i: f'<html><body><div class="top">Same words on all pages</div><div class="body">Own story {i} of this page</div><div class="end">Same again</div></body></html>'
    rows += [(100 + i, "http://Site.example/p", site(i)) for i in range(8)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {}
    for x in html.extract(d).collect():
        got.setdefault(x.page_id, []).append(x.text)
        assert x.n_chars == len(x.text)
    assert got[1] == ["Head & line\n\nFirst one two\n\nSecond x <b>\n\na\n\nb"] * 2
    assert got[2] == [""] and got[3] == ["plain text"] and got[4] == [""]
    assert [got[100 + i] for i in range(8)] == [[f"Own story {i} of this page"] for i in range(8)]
    assert html.extract(d.limit(0)).count() == 0


def test_wrappers_named_like_clutter_stay():
    page = lambda x: html.parse(f"<html><body><nav>menu</nav>{x}</body></html>")
    text = lambda x: [b[0] for b in page(x)]
    assert text('<article><h1>T</h1><div class="entry-content sharing-enabled"><p>a long story</p></div></article>') == ["T", "a long story"]
    assert text('<article><h1>T</h1><div class="post related-work"><p>a long story</p><div class="related">more</div></div></article>') == ["T", "a long story"]
    assert text('<article><header><h1>T</h1><p>lead</p><ul><li>share</ul></header><p>story</p></article>') == ["T", "lead", "story"]
    assert text('<div id="content"><h1>T</h1><p>the page is a long story of its own</p></div><article>card</article>') == ["T", "the page is a long story of its own", "card"]
    assert text('<div class="ad">an advert, longer than it</div><article>x</article>') == ["x"]
    assert text("<div>outside</div><main><p>one</p><p>two two two</p></main>") == ["one", "two two two"]
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert text(deep) == ["deep"] and len({b[1] for b in page("<div><p>a</p></div><p>b</p>")}) == 2
    assert text("<p>" + "long &amp; " * 200_000) == [" ".join(["long &"] * 200_000)]


def test_style_tree_equals_brute_force(spark):
    r = random.Random(21)
    rows, pages = [], []
    for i in range(60):
        host = f"h{i % 3}.example" if i % 4 else "H1.example"
        parts = [r.choice(("<p>same</p>", "<p>same<br></p>", f"<p>own {i}</p>")), r.choice(("<div>a <b>b</b></div>", f"<div>{i}</div>", "<div>a b</div>")), "<section>all</section>"]
        pages.append((i, f"http://{host}/x", f"<html><body>{''.join(parts[: r.randrange(1, 4)])}</body></html>"))
    pages += [(90, *pages[5][1:]), (91, None, "<p>no host</p>")]
    table = []
    for row, url, doc in pages:
        blocks = html.parse(doc)
        mark = hash("|".join(b[0] for b in blocks))
        rows += [(html.host_of(url), mark, b[1], b[2], html._hash(b[0])) for b in blocks]
        table.append((row, html.host_of(url), mark, [(b[1], b[2], html._hash(b[0])) for b in blocks]))
    want = set()
    for host, path in {(x[0], x[2]) for x in rows}:
        here = [x for x in rows if (x[0], x[2]) == (host, path)]
        m = len({x[1] for x in here})
        if m < html.LEAST_PAGES:
            continue
        c = {}
        for _, style in {(x[1], x[3]) for x in here}:
            c[style] = c.get(style, 0) + 1
        n = sum(c.values())
        node = -sum(k / n * math.log(k / n) for k in c.values()) / math.log(m)
        for body in {x[4] for x in here}:
            k = len({x[1] for x in here if x[4] == body})
            if (1 - html.GAMMA) * min(1, node) + html.GAMMA * (1 - math.log(k) / math.log(m)) < html.LOW:
                want.add((host, path, body))
    d = spark.createDataFrame(table, "row long, host string, print long, keys array<struct<path:long,style:long,body:long>>")
    assert {tuple(x) for x in html.low_importance(d).collect()} == want and want


def test_the_tree_judges_articles_too(spark):
    page = lambda i: f"<article><h1>Story {i}</h1><p>words of {i}</p><p>Follow us for more stories</p></article>"
    d = spark.createDataFrame([(i, "http://x.example/", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {x.text for x in html.extract(d).collect()} == {f"Story {i}\n\nwords of {i}" for i in range(12)}


# Classifiers


def auc(y, s):
    o = np.argsort(np.argsort(s, kind="stable"), kind="stable")
    n = y.sum()
    return (o[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("op", "label", "least"), [(quality, "quality", 0.98), (toxicity, "toxic", 0.85)])
def test_classifiers_hold_out(spark, op, label, least):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = op.score_documents(d.repartition(8), y, held).toPandas()
    assert len(got) == d.count() and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    m = got.merge(y.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m[label].to_numpy(), m.score.to_numpy()) > least
    # Labels of held-out rows change nothing.
    flip = y.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    again = op.score_documents(d.repartition(8), flip, held).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(200, quality.TERMS))) * (rng.random((200, quality.TERMS)) < 0.1)
    x[50:60] = x[40]  # ties
    space = quality.Space(x, (rng.random(200) < 0.5).astype(float))
    q = np.concatenate((x[35:65], np.abs(rng.normal(size=(20, quality.TERMS)))))
    got = space.vote(q)
    u = np.rint((lambda v: v / np.linalg.norm(v, axis=1, keepdims=True) * quality.GRAIN)(space._weigh(q) @ space.axes))
    for i, v in enumerate(u):
        s = [int(v @ r) for r in space.vectors.astype(float)]
        near = sorted(range(200), key=lambda j: (-s[j], j))[: space.k]
        w = [max(s[j] / quality.GRAIN**2, 0) ** 8 + 1e-6 for j in near]
        want = (sum(a * space.label[j] for a, j in zip(w, near, strict=True)) + 0.2 * space.prior) / (sum(w) + 0.2)
        assert abs(got[i] - want) < 1e-9
    assert (np.concatenate([space.vote(q[k : k + 1]) for k in range(len(q))]) == got).all()  # however rows are dealt


def test_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for op in (quality, toxicity):
        a, b = ({(r.doc_id, r.score) for r in op.score_documents(d.repartition(n), y, F.lit(False)).collect()} for n in (1, 40))
        assert a == b


def test_boosting_and_calibration_equal_brute_force():
    from callweight.llm.boost import Boosted, Isotonic

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = Boosted(trees=1, depth=1, rate=1.0).fit(x, y)
    p = y.mean()
    best = None  # the best single split over all features and bin edges
    for f in range(3):
        for e in m.edges[f]:
            left = x[:, f] <= e
            if min(left.sum(), (~left).sum()) * p * (1 - p) < m.least:
                continue
            gain = sum((y[s] - p).sum() ** 2 / (s.sum() * p * (1 - p) + m.l2) for s in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = gain, left
    g = [(y[s] - p).sum() / (s.sum() * p * (1 - p) + m.l2) for s in (best[1], ~best[1])]
    assert np.allclose(m.raw(x), np.log(p / (1 - p)) + np.where(best[1], *g))
    deep = Boosted().fit(x, y)
    assert ((deep.raw(x) > 0) == y).mean() > 0.97
    z = np.round(rng.normal(size=60), 1)
    t = (z + rng.normal(size=60) > 0).astype(float)
    cal = Isotonic().fit(z, t)
    # Each pool's mean is max over starts of min over ends of the mean between (Barlow et al., 1972).
    u = np.unique(z)
    mean = [max(min(t[(z >= a) & (z <= b)].mean() for b in u[u >= v]) for a in u[u <= v]) for v in u]
    n = [sum((z == w).sum() for w, x in zip(u, mean, strict=True) if abs(x - y_) < 1e-9) for y_ in mean]
    want = np.maximum.accumulate([(x * k + 0.5) / (k + 1) for x, k in zip(mean, n, strict=True)])
    assert np.allclose(cal(u), want)


def test_learned_words_equal_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["bad", "worse"] if i % 3 == 0 and r.random() < 0.6 else ["fine", "good", "the", "sun"]) for _ in range(20)), int(i % 3 == 0)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(40)
    df = {}
    for _, t, y in rows:
        for w in set(t.split()):
            df.setdefault(w, [0, 0])[y] += 1
    odds = {w: math.log((p + 0.5) / 101) - math.log((n + 0.5) / 201) for w, (n, p) in df.items() if p >= toxicity.LEARN_DOCS}
    want = sorted((w for w, o in odds.items() if o >= toxicity.LEARN_ODDS), key=lambda w: (-odds[w] * math.sqrt(df[w][1]), w))
    assert toxicity.learn_words(d) == want and want


@pytest.mark.parametrize("op", [quality, toxicity])
def test_samples_are_bounded_in_rows(spark, op):
    from callweight.llm.labelled import labelled_sample

    d = spark.createDataFrame([(i % 60, f"text {i}") for i in range(3000)], "doc_id long, text string")
    y = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, y int")
    assert labelled_sample(d, y, "y", F.lit(False), rows=50).count() == 50


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, none, op):
    y = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (2, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = op.score_documents(odd, y, F.lit(False)).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all() and got[got.doc_id == 5].score.nunique() == 1
    assert op.score_documents(odd, y.limit(0), F.lit(False)).count() == len(ODD)
    assert op.score_documents(none, y, F.lit(False)).count() == 0


def test_toxic_forms():
    texts = ["you are an idiot", "YOU 1D10T!!", "an i.d.i.o.t", "a lovely day for you", "idiooot", ""]
    data, off = text.column_bytes(pa.array(texts))
    x = toxicity.features(data, off, np.zeros(0, np.uint64))
    f = dict(zip(toxicity.FEATURES, x.T, strict=True))
    assert f["lexicon"][0] > 0 and f["near_you"][0] > 0 and (f["disguised"][[1, 2, 4]] > 0).all()
    assert f["lexicon"][3] == 0 and f["disguised"][3] == 0 and not x[5].any()
