"""Language-model scoring by subword lattices, beside a smoothed word unigram as base.

The vocabulary is an existing tokenizer's; its order gives first unigram scores, which a few
rounds of expectation-maximisation over the training documents' word counts refine (the tokenizer
itself is not trained: no piece is added or dropped). A word's probability is the sum over all
its segmentations into pieces, by the forward recursion in log space; every byte is a piece, so
there always is one. A text's score is the sum over its words, each led by a space mark, and one
end. Three things sharpen it: piece scores are kept by class of texts (classes are found without
labels, by a mixture over frequent words); a word seen in training has an arc of its own over its
whole span, with its discounted count in the class, then in the corpus, and only the discounted
mass is left to pieces; and a text draws its words from an urn that gives back what was drawn
(a Dirichlet prior around the lattice), so a word is likelier once it has occurred.

Words meet their counts by an exchange of packed word ranges: every document sends each range the
words it has there, and receives three partial sums. The most frequent words (those of the class
model, a fixed number) are scored once and travel to every task instead, so no range is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import Scratch, parts_for, small_batches, text_volume
from .text import _BYTE, Words, _powers, chunks, column_bytes, mix, release, runs, word_texts, words, words_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BUCKET_BYTES = 16 << 20  # text behind one range of words
CHUNK = 3 << 19
ROUNDS = 3
CLASSES = 6
CLASS_WORDS, CLASS_DOCS = 1000, 4000  # the class model's words, and the texts its EM begins with
CLASS_ROUNDS, CLASS_GAIN = 40, 1e-5  # rounds over all texts at most, and the least gain to go on
DISCOUNT = 0.75
URN = 5000.0
LONGEST = 256  # bytes of a word in one lattice; longer words are scored in stretches of as many
MARK = 0x20
_U = np.uint64


def load_pieces(path: str = MODEL) -> list[bytes]:
    """Pieces of a sentencepiece model in rank order, as lowered bytes with the space mark as a
    space; pieces that lower-cased words cannot use are left out, single bytes all added."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, None] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i).replace("▁", " ").encode()
        if p.strip(b" ") == p.lstrip(b" ") and b" " not in p[1:] and p == p.lower():
            out[p] = None
    for b in range(256):
        out.setdefault(bytes([b]))
    return list(out)


class Lattice:
    """Unigram scores of pieces over bytes, a row for each class of texts."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray | None = None, classes: int = 1):
        self.longest = max(map(len, pieces))
        self.size = len(pieces)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ln = np.array([len(p) for p in pieces])
        at = np.cumsum(ln) - ln
        place = np.arange(len(data)) - np.repeat(at, ln)
        self.hash = np.add.reduceat(_BYTE[data] * _powers(self.longest + 1)[0][place], at)
        if logp is None:
            p = 1.0 / (np.arange(self.size) + 10.0)
            logp = np.tile(np.log(p / p.sum()), (classes, 1))
        self.logp = logp
        self.table = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, -1 where there is none: two direct tables, the second for
        pieces whose place in the first was taken."""
        if self.table is None:
            one = np.full(1 << 20, -1, np.int32)
            slot = (self.hash >> _U(44)).astype(np.int64)
            one[slot[::-1]] = np.arange(self.size, dtype=np.int32)[::-1]
            lost = np.flatnonzero(one[slot] != np.arange(self.size))
            order = lost[np.argsort(self.hash[lost])]
            full = np.zeros(1 << 20, bool)
            full[slot[lost]] = True
            self.table = one, full, order, self.hash[order]
        one, full, order, rest = self.table
        slot = (h >> _U(44)).astype(np.int64)
        pid = one[slot]
        hit = self.hash[pid] == h
        pid = np.where(hit & (pid >= 0), pid, -1)
        more = np.flatnonzero(full[slot] & (pid < 0))
        if len(more):
            k = np.minimum(np.searchsorted(rest, h[more]), len(rest) - 1)
            pid[more] = np.where(rest[k] == h[more], order[k], -1)
        return pid

    def groups(self, w: Words, step: int = 20_000) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
        """(word numbers, arcs, leads) by length; arcs[j] lists (i, words, their pieces) for
        stretches [i, j). A long word comes in several stretches, of which the first has a mark."""
        ln = w.end - w.start
        n_parts = np.maximum(1, -(-ln // LONGEST))
        word = np.repeat(np.arange(len(ln)), n_parts)
        part = np.arange(len(word)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        start = w.start[word] + part * LONGEST
        size = np.minimum(w.end[word] - start, LONGEST)
        fwd, inv = _powers(LONGEST + 3)
        o = np.argsort(size, kind="stable")
        for s, c in zip(*runs(size[o]), strict=True):
            width = int(size[o[s]])
            for lo in range(s, s + c, step):
                at = o[lo : min(lo + step, s + c)]
                x = np.full((width + 1, len(at)), MARK, np.uint8)
                x[1:] = w.buf[start[at] + np.arange(width)[:, None]]
                acc = np.zeros((width + 2, len(at)), np.uint64)
                np.cumsum(_BYTE[x] * fwd[: width + 1, None], axis=0, out=acc[1:])
                lead = part[at] == 0
                arcs = []
                for j in range(1, width + 2):
                    row = []
                    for i in range(max(0, j - self.longest), j):
                        pid = self.find((acc[j] - acc[i]) * inv[i])
                        if i == 0:
                            pid[~lead] = -1
                        ok = np.flatnonzero(pid >= 0)
                        if len(ok):
                            row.append((i, ok, pid[ok]))
                    arcs.append(row)
                yield word[at], arcs, lead

    @staticmethod
    def _sum(best: np.ndarray, terms: list) -> np.ndarray:
        """Log of the sum of the exponentials of terms [(columns, values)] by column."""
        for ok, v in terms:
            best[ok] = np.maximum(best[ok], v)
        top = np.where(np.isfinite(best), best, 0.0)
        total = np.zeros(len(best))
        for ok, v in terms:
            total[ok] += np.exp(v - top[ok])
        with np.errstate(divide="ignore"):
            return np.log(total) + top

    def forward(self, arcs: list, lead: np.ndarray, cls: np.ndarray) -> np.ndarray:
        a = np.full((len(arcs) + 1, len(lead)), -np.inf)
        a[0, lead] = 0.0
        a[1, ~lead] = 0.0
        for j, row in enumerate(arcs, 1):
            if row:
                new = self._sum(np.full(len(lead), -np.inf), [(ok, a[i, ok] + self.logp[cls[ok], pid]) for i, ok, pid in row])
                a[j] = np.where(~lead & (j == 1), 0.0, new)
        return a

    def word_logp(self, w: Words, cls: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability in its class."""
        out = np.zeros(len(w.start))
        for word, arcs, lead in self.groups(w):
            np.add.at(out, word, self.forward(arcs, lead, cls[word])[-1])
        return out

    def expected(self, w: Words, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(class, piece) expected uses over words with these classes and counts."""
        use = np.zeros(self.logp.size)
        for word, arcs, lead in self.groups(w):
            c, m = cls[word], count[word]
            a = self.forward(arcs, lead, c)
            b = np.full_like(a, -np.inf)
            b[-1] = 0.0
            after: list[list] = [[] for _ in a]
            for j, row in enumerate(arcs, 1):
                for i, ok, pid in row:
                    after[i].append((j, ok, pid))
            for i in range(len(arcs) - 1, -1, -1):
                terms = [(ok, self.logp[c[ok], pid] + b[j, ok]) for j, ok, pid in after[i]]
                if terms:
                    b[i] = self._sum(np.full(len(c), -np.inf), terms)
                for (_, ok, pid), (_, v) in zip(after[i], terms, strict=True):
                    g = np.exp(a[i, ok] + v - a[-1, ok]) * m[ok]
                    use += np.bincount(c[ok] * self.size + pid, weights=g, minlength=len(use))
        return use.reshape(self.logp.shape)




def _uniq_class(w: Words, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (word, class) pairs in order of the word's hash: first places, numbers, classes."""
    h, inv = np.unique(w.hash, return_inverse=True)
    _, at, inv = np.unique(inv.astype(np.int64) * 256 + cls, return_index=True, return_inverse=True)
    return at, inv, np.asarray(cls, np.int64)[at]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int32)


def _blob(w: Words, at: np.ndarray) -> bytes:
    """The words `at`, each followed by a space."""
    raw, ln = word_texts(w, at)
    out = np.full(len(raw) + len(ln), MARK, np.uint8)
    body = np.ones(len(out), bool)
    body[np.cumsum(ln + 1) - 1] = False
    out[body] = np.frombuffer(raw, np.uint8)
    return out.tobytes()


class Classes:
    """Mixture of unigrams over frequent words; gives every text its likeliest class."""

    def __init__(self, table: np.ndarray, logp: np.ndarray, prior: np.ndarray):
        self.table, self.logp, self.prior = table, logp, prior

    def counts(self, w: Words) -> np.ndarray:
        return _class_counts(w, self.table)

    def __call__(self, w: Words) -> np.ndarray:
        return (self.counts(w) @ self.logp.T + self.prior).argmax(axis=1) if len(self.table) else np.zeros(w.n_rows, np.int64)


def _class_counts(w: Words, table: np.ndarray) -> np.ndarray:
    """(text, word of the table) counts, cut at 3."""
    k = np.minimum(np.searchsorted(table, w.hash), max(0, len(table) - 1))
    hit = table[k] == w.hash if len(table) else np.zeros(len(w.hash), bool)
    c = np.bincount(w.row[hit] * len(table) + k[hit], minlength=w.n_rows * len(table))
    return np.minimum(c, 3).reshape(w.n_rows, len(table)).astype(np.float32)


def _mixture(x: np.ndarray, k: int, seed: int, rounds: int = 40) -> tuple[float, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed).dirichlet(np.full(k, 0.3), len(x))
    for _ in range(rounds):
        p = r.T @ x + 0.1
        logp, prior = np.log(p / p.sum(axis=1, keepdims=True)), np.log((r.sum(axis=0) + 1) / (len(x) + k))
        ll = x @ logp.T + prior
        m = ll.max(axis=1, keepdims=True)
        r = np.exp(ll - m)
        z = r.sum(axis=1, keepdims=True)
        r /= z
    return float((m + np.log(z)).sum()), logp, prior


def _packed(c: np.ndarray) -> list[bytes]:
    """The words with a count of 1 to 3 of each text, two bytes each."""
    row, word = np.nonzero(c)
    x = (word * 4 + c[row, word]).astype("<u2")
    cut = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(c)))))
    return [x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _unpacked(rows: list[bytes], n_words: int) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<u2").astype(np.int64)
    out = np.zeros((len(rows), n_words), np.float32)
    out[np.repeat(np.arange(len(rows)), [len(r) // 2 for r in rows]), x >> 2] = x & 3
    return out


def _shares(logp: np.ndarray, prior: np.ndarray):
    """One round over texts of a partition: (class * (words + 1) + word, sum); the last word of a
    class is its number of texts, one more number is the log likelihood."""
    k, n = logp.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, like = np.zeros((k, n + 1)), 0.0
        for b in batches:
            x = _unpacked(b.column(0).to_pylist(), n)
            ll = x @ logp.T + prior
            m = ll.max(axis=1, keepdims=True)
            r = np.exp(ll - m)
            z = r.sum(axis=1, keepdims=True)
            r /= z
            out[:, :n] += r.T @ x
            out[:, n] += r.sum(axis=0)
            like += float((m + np.log(z)).sum())
        got = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(got, k * (n + 1))), pa.array(np.append(out.ravel()[got], like))], ["i", "s"])

    return run


def fit_classes(train: DataFrame, k: int = CLASSES, n_words: int = CLASS_WORDS, start: int = CLASS_DOCS, rounds: int = CLASS_ROUNDS) -> Classes:
    """Classes by EM over all training texts. EM begins at the best fit of `start` of them, chosen
    by hash of their counts, so that classes begin apart however many texts there are; from there
    every round reads all texts and one number a class and word comes to the driver."""
    texts = train.select("text")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(0))
            for lo, hi in chunks(off):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                h, inv = np.unique(w.hash, return_inverse=True)
                df = np.bincount(np.unique(inv * (hi - lo) + w.row) // (hi - lo), minlength=len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df.astype(np.int64))], ["h", "df"])

    top = texts.mapInArrow(frequent, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).filter("df > 1").orderBy(F.desc("df"), "h").limit(n_words)
    table = np.sort(np.array([r.h for r in top.collect()], np.int64).view(np.uint64))
    if not len(table):
        return Classes(table, np.zeros((k, 0)), np.zeros(k))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(0))
            for lo, hi in chunks(off):
                c = _class_counts(words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), table)
                yield pa.RecordBatch.from_arrays([pa.array(_packed(c.astype(np.int64)), pa.binary())], ["x"])

    scratch = Scratch(train.sparkSession, "classes")
    rows = scratch.keep(texts.mapInArrow(count, "x binary"))
    # The hash thins the texts to about twice `start` before they are ordered, whatever their number;
    # equal ones count once.
    share = min(1.0, 2 * start / max(1, rows.count()))
    thin = rows.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    some = sorted(bytes(r.x) for r in thin.orderBy(F.xxhash64("x"), "x").limit(start).collect())
    _, logp, prior = max((_mixture(_unpacked(some, len(table)), k, seed) for seed in range(3)), key=lambda f: f[0])
    last, n = -np.inf, len(table)
    for _ in range(rounds):
        s = np.zeros(k * (n + 1) + 1)
        for r in rows.mapInArrow(_shares(logp, prior), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            s[r.i] = r.s
        sums = s[:-1].reshape(k, n + 1)
        p = sums[:, :n] + 0.1
        logp, prior = np.log(p / p.sum(axis=1, keepdims=True)), np.log((sums[:, n] + 1) / (sums[:, n].sum() + k))
        if s[-1] - last <= CLASS_GAIN * abs(s[-1]):
            break
        last = s[-1]
    scratch.drop(rows)
    return Classes(table, logp.astype(np.float32), prior.astype(np.float32))


def _train_words(buckets: int, classes: Classes):
    """Word counts of the training texts of a run of documents, by range and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(0))
            for lo, hi in chunks(off, CHUNK):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at, inv, cls = _uniq_class(w, classes(w)[w.row])
                cnt = np.bincount(inv, minlength=len(at))
                b = _bucket(w.hash[at], buckets)
                rows = [(int(b[s]), _blob(w, at[s : s + c]), cls[s : s + c].astype(np.uint8).tobytes(), cnt[s : s + c].astype(np.int64).tobytes()) for s, c in zip(*runs(b), strict=True)]  # hashes are sorted, so ranges are
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["b", "words", "cls", "counts"])

    return run


def _trimmed(run):
    """A group's function that leaves none of the memory it took to its idle worker."""

    def one(t: pa.Table) -> pa.Table:
        release()
        out = run(t)
        release()
        return out

    return one


def _merge_words(t: pa.Table) -> pa.Table:
    w = words_of(t.column("words").to_pylist())
    cnt = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int64)
    at, inv, cls = _uniq_class(w, np.frombuffer(b"".join(t.column("cls").to_pylist()), np.uint8))
    total = np.bincount(inv, weights=cnt, minlength=len(at)).astype(np.int64)
    kinds = np.bincount(cls, minlength=256), np.bincount(cls, weights=total, minlength=256).astype(np.int64)
    step = 100_000
    cuts = list(range(0, len(at), step))
    first = [s == 0 for s in cuts]
    whole = len(np.unique(w.hash[at]))
    return pa.table({
        "v": pa.array([whole if f else 0 for f in first], pa.int64()), "by_class": pa.array([np.stack(kinds).tolist() if f else None for f in first], pa.list_(pa.list_(pa.int64()))),
        "words": pa.array([_blob(w, at[s : s + step]) for s in cuts], pa.binary()), "cls": pa.array([cls[s : s + step].astype(np.uint8).tobytes() for s in cuts], pa.binary()), "counts": pa.array([total[s : s + step].tobytes() for s in cuts], pa.binary()),
    })


def _expect(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(lattice.logp.shape)
        for batch in batches:
            for words_, cls, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                use += lattice.expected(words_of([words_]), np.frombuffer(cls, np.uint8).astype(np.int64), np.frombuffer(counts, np.int64))
        got = np.flatnonzero(use)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(use.ravel()[got])], ["piece", "uses"])

    return run


def fit(counted: DataFrame, pieces: list[bytes], classes: int, rounds: int = ROUNDS) -> Lattice:
    """EM over (words, cls, counts) rows. One number a class and piece comes to the driver each
    round, whatever the corpus."""
    lattice = Lattice(pieces, classes=classes)
    for _ in range(rounds):
        use = np.full(lattice.logp.size, 1e-2)
        for r in counted.select("words", "cls", "counts").mapInArrow(_expect(lattice), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
            use[r.piece] += r.uses
        use = use.reshape(lattice.logp.shape)
        lattice.logp = np.log(use / use.sum(axis=1, keepdims=True))
    return lattice


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function, by Stirling's series after a shift."""
    s, y = np.zeros(len(x)), np.array(x, float)
    for _ in range(8):
        m = y < 8
        s[m] -= np.log(y[m])
        y[m] += 1
    return s + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)


class Totals:
    """Corpus totals the scores need: tokens and distinct words of training texts, by class too."""

    def __init__(self, n_words: int, v_words: int, by_class: np.ndarray, ends: np.ndarray):
        some = ends > 0
        self.ends, self.n, self.v = int(ends.sum()), n_words + int(ends.sum()), v_words + int(ends.sum() > 0)
        self.class_n = np.maximum(by_class[1] + ends, 1).astype(float)
        self.class_v = np.maximum(by_class[0] + some, 1).astype(float)
        self.p_end = np.maximum(ends, 0.5) / self.class_n
        self.prior = np.log((ends + 0.5) / (ends + 0.5).sum())

    def word_p(self, lattice_p: np.ndarray, cls: np.ndarray, in_class: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A word's probability: discounted arc of its class, of the corpus, then its pieces."""
        n = max(1, self.n)
        left = min(1.0, DISCOUNT * max(1, self.v) / n)
        whole = np.maximum(count - DISCOUNT, 0) / n + left * lattice_p
        back = np.minimum(1.0, DISCOUNT * self.class_v / self.class_n)[cls]
        return np.maximum(in_class - DISCOUNT, 0) / self.class_n[cls] + back * whole


class Hot:
    """Scores of the class model's words in every class."""

    def __init__(self, table: np.ndarray, base: np.ndarray, urn: np.ndarray):
        self.table, self.base, self.urn = table, base, urn

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for all others."""
        if not len(self.table):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.table, h), len(self.table) - 1)
        return np.where(self.table[k] == h, k, -1)

    def sums(self, w: Words, which: np.ndarray, of: np.ndarray) -> np.ndarray:
        """(text, 3): sums of log10(c + 1), of known tokens, of word scores of a run of texts."""
        out = np.zeros((w.n_rows, 3))
        at = np.flatnonzero(which >= 0)
        n = len(self.table)
        pair, m = np.unique(w.row[at] * max(1, n) + which[at], return_counts=True)
        row, word = pair // max(1, n), pair % max(1, n)
        urn = self.urn[word, of[row]] if len(row) else np.zeros(0)
        for j, v in enumerate((m * self.base[word], m, log_gamma(urn + m) - log_gamma(urn))):
            out[:, j] = np.bincount(row, weights=v, minlength=w.n_rows)
        return out


def _hot(counted: DataFrame, classes: Classes, lattice: Lattice, totals: Totals) -> Hot:
    """Scores of the class model's words, from their training counts; one row a word and class."""
    table = classes.table

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words_, cls, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = words_of([words_])
                at = np.flatnonzero(np.isin(w.hash, table))
                raw, ln = word_texts(w, at)
                cut = np.concatenate(([0], np.cumsum(ln)))
                yield pa.RecordBatch.from_arrays([pa.array([raw[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(np.frombuffer(cls, np.uint8)[at].astype(np.int32)), pa.array(np.frombuffer(counts, np.int64)[at])], ["word", "cls", "n"])

    got = counted.select("words", "cls", "counts").mapInArrow(pick, "word binary, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n")).collect() if len(table) else []
    text = sorted({bytes(r.word) for r in got})
    w = words_of([b" ".join(text)])
    o = np.argsort(w.hash)
    w = Words(w.buf, w.start[o], w.end[o], w.row[o], w.hash[o], 1)
    place = {text[k]: i for i, k in enumerate(o)}
    by_class = np.zeros((len(o), CLASSES))
    for r in got:
        by_class[place[bytes(r.word)], r.cls] += r.n
    every = Words(w.buf, np.repeat(w.start, CLASSES), np.repeat(w.end, CLASSES), np.repeat(w.row, CLASSES), np.repeat(w.hash, CLASSES), 1)
    cls = np.tile(np.arange(CLASSES), len(o))
    count = np.repeat(by_class.sum(axis=1), CLASSES)
    p = totals.word_p(np.exp(lattice.word_logp(every, cls)), cls, by_class.ravel(), count)
    return Hot(w.hash, np.log10(by_class.sum(axis=1) + 1), URN * p.reshape(-1, CLASSES))


def _narrow(x: np.ndarray) -> tuple[bytes, int]:
    kind = 1 if x.max(initial=0) < 256 else 2 if x.max(initial=0) < 65536 else 4
    return x.astype(f"<u{kind}").tobytes(), kind


def _doc_words(buckets: int, classes: Classes, hot: Hot):
    """Per run of documents and range: its words with their training counts, and which document
    holds which how often. One range also carries the documents' heads, with their sums over hot words."""
    names = ["b", "words", "cls", "train", "docs", "sizes", "at", "at_kind", "times", "times_kind", "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            null = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy()
            for lo, hi in chunks(off, CHUNK):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = np.bincount(w.row, minlength=hi - lo)
                begin = np.concatenate(([0], np.cumsum(n)[:-1]))
                key = mix(ids[lo:hi].astype(np.int64).view(np.uint64) + null[lo:hi].astype(np.uint64) * _U(0xD6E8FEB86659FD93))
                if len(w.row):
                    x = mix(w.hash + (np.arange(len(w.row)) - begin[w.row]).astype(np.uint64) * _U(0xA0761D6478BD642F))
                    some = np.flatnonzero(n)
                    key[some] ^= mix(np.add.reduceat(x, begin[some]))
                of = classes(w)
                which = hot.find(w.hash)
                own = np.ascontiguousarray(hot.sums(w, which, of).T).view(np.int64)
                heads = np.stack((key.view(np.int64), ids[lo:hi], null[lo:hi].astype(np.int64), held[lo:hi].astype(np.int64), n, of, *own)).T.astype(np.int64).tobytes()
                cold = np.flatnonzero(which < 0)
                w = Words(w.buf, w.start[cold], w.end[cold], w.row[cold], w.hash[cold], w.n_rows)
                at, inv, cls = _uniq_class(w, of[w.row])
                pair, times = np.unique((w.row.astype(np.uint64) << _U(32)) | inv.astype(np.uint64), return_counts=True)
                row, word = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)
                train = np.bincount(inv, weights=~held[lo:hi][w.row], minlength=len(at)).astype(np.int64)
                wb = _bucket(w.hash[at], buckets)
                o = np.argsort(wb[word], kind="stable")
                row, word, times = row[o], word[o], times[o]
                rs, rc = runs(wb[word])
                spans = {int(wb[word[s]]): (s, c) for s, c in zip(rs, rc, strict=True)}
                home = int(key[0] % _U(buckets))
                cols: list[list] = [[] for _ in names]
                ws, wc = runs(wb)
                span_w = {int(wb[s]): (s, c) for s, c in zip(ws, wc, strict=True)}
                for b in sorted({*spans, home}):
                    s, c = spans.get(b, (0, 0))
                    s0, c0 = span_w.get(b, (0, 0))
                    r, k = runs(row[s : s + c])
                    a, ak = _narrow(word[s : s + c] - s0)
                    m, mk = _narrow(times[s : s + c])
                    for to, v in zip(cols, (b, _blob(w, at[s0 : s0 + c0]), cls[s0 : s0 + c0].astype(np.uint8).tobytes(), train[s0 : s0 + c0].astype("<u4").tobytes(), key[row[s + r]].tobytes() if c else b"", k.astype("<u4").tobytes(), a, ak, m, mk, heads if b == home else b""), strict=True):
                        to.append(v)
                kinds = [pa.int32(), *[pa.binary()] * 6, pa.int32(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


HEAD = 9  # numbers in a document's head
_DOC_WORDS = "b int, words binary, cls binary, train binary, docs binary, sizes binary, at binary, at_kind int, times binary, times_kind int, heads binary"


def _partial(lattice: Lattice, totals: Totals, parts: int):
    """What a range knows of each document: sums of log10(c + 1), of known tokens, of word scores."""

    def run(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_pylist() for n in t.schema.names}
        w = words_of(c["words"])
        at, inv, cls = _uniq_class(w, np.frombuffer(b"".join(c["cls"]), np.uint8))
        train = np.frombuffer(b"".join(c["train"]), "<u4").astype(np.float64)
        in_class = np.bincount(inv, weights=train, minlength=len(at))
        _, same = np.unique(w.hash[at], return_inverse=True)
        count = np.bincount(same, weights=in_class)[same] if len(at) else in_class
        distinct = Words(w.buf, w.start[at], w.end[at], w.row[at], w.hash[at], 1)
        urn = URN * totals.word_p(np.exp(lattice.word_logp(distinct, cls)), cls, in_class, count)
        base, known = np.log10(count + 1), (count > 0).astype(float)
        got, first = [], 0
        for i in range(t.num_rows):
            n_words = len(c["train"][i]) // 4
            idx = inv[first + np.frombuffer(c["at"][i], f"<u{c['at_kind'][i]}").astype(np.int64)]
            first += n_words
            if not len(idx):
                continue
            m = np.frombuffer(c["times"][i], f"<u{c['times_kind'][i]}").astype(np.float64)
            sizes = np.frombuffer(c["sizes"][i], "<u4").astype(np.int64)
            s = np.cumsum(sizes) - sizes
            drawn = log_gamma(urn[idx] + m) - log_gamma(urn[idx])
            got.append((np.frombuffer(c["docs"][i], np.uint64), np.add.reduceat(m * base[idx], s), np.add.reduceat(m * known[idx], s), np.add.reduceat(drawn, s)))
        key = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint64)
        key, inv = np.unique(key, return_inverse=True)
        sums = [np.bincount(inv, weights=np.concatenate([g[k] for g in got]), minlength=len(key)) if got else np.zeros(0) for k in (1, 2, 3)]
        heads = np.frombuffer(b"".join(c["heads"]), np.int64).reshape(-1, HEAD)
        p, hp = key % _U(parts), heads[:, 0].view(np.uint64) % _U(parts) if len(heads) else np.zeros(0, np.uint64)
        rows = []
        for x in np.unique(np.concatenate((p, hp))):
            a, b = p == x, hp == x
            rows.append((int(x), key[a].tobytes(), *(s[a].tobytes() for s in sums), heads[b].tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["p", "key", "base", "known", "lm", "heads"])

    return run


def _finish(totals: Totals):
    down, end_base = np.log10(totals.n + totals.v + 1), np.log10(totals.ends + 1)

    def run(t: pa.Table) -> pa.Table:
        cat = lambda n, k: np.frombuffer(b"".join(t.column(n).to_pylist()), k)
        heads = cat("heads", np.int64).reshape(-1, HEAD)
        own = np.ascontiguousarray(heads[:, 6:]).view(np.float64)
        keys, inv = np.unique(np.concatenate((heads[:, 0].view(np.uint64), cat("key", np.uint64))), return_inverse=True)
        h, k = inv[: len(heads)], inv[len(heads) :]
        alike = np.bincount(h, minlength=len(keys))  # equal rows have sent their sums together
        base, known, lm = (np.bincount(k, weights=cat(n, np.float64), minlength=len(keys))[h] / alike[h] + own[:, j] for j, n in enumerate(("base", "known", "lm")))
        n, cls = heads[:, 4] + 1, heads[:, 5]
        urn = np.full(len(n), URN)
        lm = lm + totals.prior[cls] + np.log(URN * totals.p_end[cls]) - log_gamma(urn + n) + log_gamma(urn)
        return pa.table({
            "doc_id": pa.array(heads[:, 1], mask=heads[:, 2] == 1), "held_out": pa.array(heads[:, 3] == 1), "n_tokens": pa.array(n), "n_known": pa.array(np.rint(known).astype(np.int64) + (totals.ends > 0)),
            "train_tokens": pa.array(np.full(len(n), totals.n, np.int64)), "base_score": pa.array(base + end_base - n * down), "score": pa.array(lm / np.log(10)),
        })

    return run


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", model: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    `held_out` is a column expression; its rows are scored but not learned from (null: learned
    from). Null and empty texts have one token, the end. Words of more than LONGEST bytes are
    scored in stretches of that length. Equal rows get equal scores. With no training rows the
    base is uniform and the piece scores follow the vocabulary's order. An empty table gives no
    rows; extra columns are ignored.
    """
    d = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    buckets = parts_for(text_volume(d), BUCKET_BYTES, 12)
    classes, lattice, totals, hot = learn(d.filter("not held_out").select("text"), buckets, model, rounds)
    partial = d.mapInArrow(_doc_words(buckets, classes, hot), _DOC_WORDS).groupBy("b").applyInArrow(_trimmed(_partial(lattice, totals, buckets)), "p int, key binary, base binary, known binary, lm binary, heads binary")
    return partial.groupBy("p").applyInArrow(_finish(totals), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learn(train: DataFrame, buckets: int, model: str = MODEL, rounds: int = ROUNDS) -> tuple[Classes, Lattice, Totals, Hot]:
    """All that scores need of the training texts (text); their words' counts stay distributed."""
    scratch = Scratch(train.sparkSession, "lm")
    classes = fit_classes(train)
    counted = scratch.keep(train.mapInArrow(_train_words(buckets, classes), "b int, words binary, cls binary, counts binary").groupBy("b").applyInArrow(_trimmed(_merge_words), "v long, by_class array<array<long>>, words binary, cls binary, counts binary"))
    by_class = np.zeros((2, CLASSES), np.int64)
    v = 0
    for r in counted.filter("by_class is not null").select("v", "by_class").toLocalIterator():
        by_class += np.array(r.by_class)[:, :CLASSES]
        v += r.v

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES, np.int64)
        for b in batches:
            data, off = column_bytes(b.column(0))
            for lo, hi in chunks(off, CHUNK):
                n += np.bincount(classes(words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n)], ["c", "n"])

    ends = np.zeros(CLASSES, np.int64)
    for r in train.mapInArrow(ends_of, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        ends[r.c] = r.n
    lattice = fit(counted, load_pieces(model), CLASSES, rounds)
    totals = Totals(int(by_class[1].sum()), v, by_class, ends)
    hot = _hot(counted, classes, lattice, totals)
    scratch.drop(counted)
    return classes, lattice, totals, hot
