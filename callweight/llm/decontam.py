"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of lower-cased words. An item of m words leaks where some passage is
within tau(m) word edits. The random walks of Chakraborty, Goldenberg and Koucky (2016) embed a
window: at step s the walk writes down the word it stands on and moves on or stays, by a bit of
that word and step alone. Two windows a few edits apart soon walk in step again, so edit distance
becomes Hamming distance, and equal coordinates of the embeddings mark close windows.

1. Windows slide word by word over every text, and over every item to the item's end. Their walks
   need no item's length: a coordinate is the same for all windows that begin at a word and reach it.
2. A sample is a walk and a few of its coordinates; windows whose walk stands on different words
   there have the coordinates' words as bucket key. The items' windows make a bucket table a
   sample; every window of a text is looked up in all of them. The number of samples is measured:
   what `recall` needs over items of all lengths with tau(m) random edits (see `measured_recall`).
3. A colliding window says where the whole item would lie. That zone has to hold m - tau of the
   item's words (a lossless bound), and then an exact alignment decides.

Items of tau 0 are looked up as whole windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Scratch, small_batches
from .text import chunks, column_bytes, mix, shingles, words

MAX_EDIT = 0.25
PIECE = 3  # words that edits leave together on average at least
WALKS = 4
STEPS = 8
COORDINATES = 3  # of a sample
SAMPLES = 16  # measured: every length's recall is 0.99 or more
RECALL = 0.99
ITEM_BYTES = 1 << 20  # items held at once; more items make more passes
CELLS = 1 << 18  # words of zones aligned at once
_U = np.uint64


def tau(m, max_edit: float = MAX_EDIT):
    """Word edits allowed to an item of m words: a share of m, with pieces of PIECE words left."""
    return np.maximum(0, np.minimum(np.floor(np.asarray(m) * max_edit), np.asarray(m) // PIECE - 1)).astype(np.int64)


@lru_cache
def plan(samples: int) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """(walk, coordinates) of each sample; all begin with the first coordinate."""
    r = Random(3)
    return tuple((i % WALKS, (0, *sorted(r.sample(range(1, STEPS), COORDINATES - 1)))) for i in range(samples))


def walk(h: np.ndarray, which: int) -> Iterator[np.ndarray]:
    """Where the walk stands at each step, from every word of a sequence of word hashes."""
    bits = np.append(mix(h + _U((which + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> _U(56), _U(0)).astype(np.uint8)
    at = np.arange(len(h), dtype=np.int32)
    for s in range(STEPS):
        yield at
        at = np.minimum(at + ((bits[at] >> s) & 1), len(h)).astype(np.int32)


def buckets(h: np.ndarray, end: np.ndarray, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each sample the windows that have a key and their keys; a window begins at each word and
    ends at `end` at the latest."""
    todo = plan(samples)
    salt = [_U(c * 2 + 1) for c in (0x51ED270B9B3, 0xB492B66FBE9, 0x9AE16A3B2F9, 0xC2B2AE3D27D)]
    for which in range(min(WALKS, samples)):
        stand = list(walk(h, which))
        for i, (w, at) in enumerate(todo):
            if w != which:
                continue
            ok = stand[at[-1]] < end
            for a, b in zip(at[:-1], at[1:], strict=True):
                ok &= stand[a] < stand[b]
            win = np.flatnonzero(ok)
            key = np.full(len(win), i, np.uint64)
            for c, s in zip(at, salt, strict=False):
                key += h[stand[c][win]] * s
            yield win, mix(key)


def measured_recall(m: int, samples: int = SAMPLES, trials: int = 500, max_edit: float = MAX_EDIT, seed: int = 1) -> float:
    """Share of random items of m words that collide with a copy of themselves after tau(m) random
    edits (words replaced, left out or put in)."""
    r, hit = Random(seed * 1000 + m), 0
    for _ in range(trials):
        a = [r.getrandbits(62) for _ in range(m)]
        b = list(a)
        for _ in range(int(tau(m, max_edit))):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice(([r.getrandbits(62)], [], [b[k], r.getrandbits(62)]))
        x, y = (buckets(np.array(s, np.uint64), np.full(len(s), len(s)), samples) for s in (a, b))
        hit += any(np.isin(p[1], q[1]).any() for p, q in zip(x, y, strict=True))
    return hit / trials


@lru_cache
def samples_needed(recall: float = RECALL, max_edit: float = MAX_EDIT) -> int:
    """Samples with which items of every length reach the recall; short ones are the hardest."""
    if recall <= RECALL and max_edit <= MAX_EDIT:
        return SAMPLES
    n = SAMPLES
    while n < 16 * SAMPLES and min(measured_recall(m, n, max_edit=max_edit) for m in (6, 9, 12, 24, 48)) < recall:
        n += WALKS
    return n


def best_alignment(item: np.ndarray, zone: np.ndarray, zlen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of the best passage of each zone (n, z) for its item (n, m): fewest
    word edits, then the earliest end. Sellers' recurrence, a row at a time for all."""
    n, z = zone.shape
    big = np.int32(1 << 30)
    cols = np.arange(z + 1, dtype=np.int32)
    d = np.zeros((n, z + 1), np.int32)
    s = np.tile(cols, (n, 1))  # where the alignment that ends here began
    for i in range(item.shape[1]):
        sub = d[:, :-1] + (zone != item[:, i : i + 1])
        up = d[:, 1:] + 1
        nd, ns = np.empty_like(d), np.empty_like(s)
        nd[:, 0], ns[:, 0] = i + 1, 0
        take = sub <= up
        nd[:, 1:] = np.where(take, sub, up)
        ns[:, 1:] = np.where(take, s[:, :-1], s[:, 1:])
        run = nd - cols
        low = np.minimum.accumulate(run, axis=1)
        src = np.maximum.accumulate(np.where(run == low, cols, 0), axis=1)
        d = low + cols
        s = np.take_along_axis(ns, src, axis=1)
    d = np.where(cols[None, :] <= zlen[:, None], d, big)
    e = d.argmin(axis=1)
    r = np.arange(n)
    return d[r, e].astype(np.int64), s[r, e].astype(np.int64), e.astype(np.int64)


class Items:
    """Items of a benchmark end to end as word hashes, with a bucket table a sample and a mark for
    each item's words. Memory is in proportion to the items' words, however they are long."""

    def __init__(self, ids: list, texts: list, max_edit: float, samples: int):
        data, off = column_bytes(pa.array(texts, pa.string()))
        w = words(data, off)
        n = np.bincount(w.row, minlength=len(ids)) if len(w.row) else np.zeros(len(ids), np.int64)
        keep = np.flatnonzero(n > 0)  # wordless items mark nothing
        self.ids, self.m, self.hash = np.array(ids, np.int64)[keep], n[keep].astype(np.int64), w.hash
        self.begin = np.cumsum(self.m) - self.m
        self.tau = tau(self.m, max_edit)
        item = np.repeat(np.arange(len(keep)), self.m)
        offset = np.arange(len(item)) - self.begin[item]
        self.samples = samples
        self.tables = []
        fuzzy = self.tau[item] > 0
        for win, key in buckets(w.hash, (self.begin + self.m)[item], samples):
            yes = fuzzy[win]
            self.tables.append(self._table(key[yes], item[win[yes]], offset[win[yes]]))
        self.whole = {}  # items that leak only as they are, by number of words
        for m in np.unique(self.m[self.tau == 0]).tolist():
            row, at, g = shingles(w, m, short=False)
            own = np.flatnonzero((self.m[item[at]] == m) & (self.tau[item[at]] == 0))
            self.whole[m] = self._table(g[own], item[at[own]], np.zeros(len(own), np.int64))
        size = 1 << max(16, int(len(item) * 16).bit_length())
        self.marks = np.zeros(size, bool)
        self.marks[self.mark(item, w.hash)] = True

    @staticmethod
    def _table(key: np.ndarray, item: np.ndarray, offset: np.ndarray):
        o = np.argsort(key, kind="stable")
        seen = np.zeros(1 << max(14, int(len(key) * 8).bit_length()), bool)
        seen[key & _U(len(seen) - 1)] = True
        return key[o], item[o].astype(np.int32), offset[o].astype(np.int32), seen

    def mark(self, item: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (mix(h + item.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) & _U(len(self.marks) - 1)).astype(np.int64)

    @staticmethod
    def find(table, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which key, item, offset) of all entries of the table with these keys."""
        keys, item, offset, seen = table
        ok = np.flatnonzero(seen[key & _U(len(seen) - 1)])
        a, b = np.searchsorted(keys, key[ok], "left"), np.searchsorted(keys, key[ok], "right")
        c = b - a
        x = np.repeat(a - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        return np.repeat(ok, c), item[x].astype(np.int64), offset[x].astype(np.int64)


def candidates(it: Items, h: np.ndarray, row: np.ndarray, begin: np.ndarray, cnt: np.ndarray, w) -> np.ndarray:
    """(row, item, first word) of where items may lie, by bucket collisions."""
    found = [np.zeros((0, 3), np.int64)]
    for table, (win, key) in zip(it.tables, buckets(h, (begin + cnt)[row], it.samples), strict=True):
        which, item, offset = it.find(table, key)
        at = win[which]
        found.append(np.stack((row[at], item, at - offset), axis=1))
    for m, table in it.whole.items():
        r, at, g = shingles(w, m, short=False)
        which, item, _ = it.find(table, g)
        found.append(np.stack((r[which], item, at[which]), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _leaks(it: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            ids = batch.column(0)
            for lo, hi in chunks(off):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cnt = np.bincount(w.row, minlength=hi - lo)
                begin = np.cumsum(cnt) - cnt
                hits = candidates(it, w.hash, w.row, begin, cnt, w)
                hits = hits[np.argsort(it.m[hits[:, 1]], kind="stable")]
                zone = it.m[hits[:, 1]] + 2 * it.tau[hits[:, 1]]
                good, i = [], 0
                while i < len(hits):  # items of one length at a time, as many as the cells allow
                    j = min(int(np.searchsorted(zone, zone[i], "right")), i + max(1, CELLS // int(zone[i])))
                    good.append(_aligned(it, w.hash, begin, cnt, hits[i:j]))
                    i = j
                if good and len(g := np.unique(np.concatenate(good), axis=0)):  # by row, item, distance, start
                    g = g[np.concatenate(([True], (g[1:, :2] != g[:-1, :2]).any(axis=1)))]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(g[:, 0] + lo)), pa.array(it.ids[g[:, 1]]), pa.array(g[:, 2].astype(np.int32)), pa.array(g[:, 3]), pa.array(g[:, 4]), pa.array(it.m[g[:, 1]].astype(np.int32))],
                        ["doc_id", "item_id", "distance", "start_word", "end_word", "item_words"],
                    )

    return run


def _aligned(it: Items, h: np.ndarray, begin: np.ndarray, cnt: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """(row, item, distance, start, end) of those of the candidates, all of one length, that leak."""
    row, i, st = hits.T
    m, t = int(it.m[i[0]]), int(it.tau[i[0]])
    first, last = np.maximum(st - t, begin[row]), np.minimum(st + m + t, begin[row] + cnt[row])
    at = first[:, None] + np.arange(m + 2 * t)
    inside = at < last[:, None]
    z = np.where(inside, h[np.minimum(at, len(h) - 1)], _U(0))
    likely = (it.marks[it.mark(i[:, None], z)] & inside).sum(axis=1) >= m - t
    row, i, first, last, z = row[likely], i[likely], first[likely], last[likely], z[likely]
    if not len(row):
        return np.zeros((0, 5), np.int64)
    dist, b, e = best_alignment(it.hash[it.begin[i][:, None] + np.arange(m)], z, last - first)
    return np.stack((row, i, dist, first + b - begin[row], first + e - begin[row]), axis=1)[dist <= t]


SCHEMA = "doc_id long, item_id long, distance int, start_word long, end_word long, item_words int"


def leaks(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that leaks in it: its best passage [start_word, end_word) and
    that passage's distance in word edits.

    Nulls and empty texts, in documents or items, leak nothing; items of fewer than 6 words must
    occur exactly; whole texts and items are read however long. Ties of distance go to the earliest
    passage. Repeated documents and items have rows of their own. Items are read in blocks of about
    ITEM_BYTES, each a pass over the documents whose rows are written before the next block is
    read, so memory has a bound for any benchmark; one longer item is a block of its own. An empty
    table on either side gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    d = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    samples = samples_needed(recall, max_edit)
    scratch = Scratch(spark, "leaks")
    done: list[DataFrame] = []
    ids, texts, held = [], [], 0

    def scan() -> DataFrame:
        return d.mapInArrow(_leaks(Items(ids, texts, max_edit, samples)), SCHEMA)

    for r in items.toLocalIterator():
        size = len(r.t.encode()) + 64
        if ids and held + size > ITEM_BYTES:
            done.append(scratch.keep(scan()))
            ids, texts, held = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        held += size
    if ids:
        done.append(scan())
    out = done[0] if done else spark.createDataFrame([], SCHEMA)
    for x in done[1:]:
        out = out.union(x)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The documents in which no item leaks, with all their columns.

    Null and empty texts stay; rows with a null id stay unless a row with a null id leaks; rows
    that share an id go or stay together. Repeated rows all stay or all go. An empty table on
    either side changes nothing; no column of docs can clash.
    """
    # Written first, so that Spark knows its size: few rows are broadcast, many meet the documents in
    # an exchange.
    scratch = Scratch(docs.sparkSession, "clean")
    bad = scratch.keep(leaks(docs, benchmark, id_col=id_col, **kw).select(F.struct(F.col("doc_id")).alias("bad")).distinct())
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["bad"]["doc_id"]), "left_anti")
