"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features of a whole text: densities of a fixed lexicon and of words learned from the labelled
sample, how many of the hits stand close to a second person, capitals, punctuation, digits, and
how many hits are disguised (digits or signs for letters, letters set apart or repeated).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted, Isotonic
from .labelled import SAMPLE_ROWS, labelled_sample
from .scale import small_batches
from .text import SPACE, Words, chunks, column_bytes, word_texts, words

# Insults and abuse in English, French, German and Spanish; second persons.
LEXICON = """
idiot idiots moron morons loser losers trash pathetic worthless disgusting stupid clown clowns scum
fool dumb imbecile cretin scumbag garbage filth vermin pig jerk bastard bitch whore slut asshole
bullshit shit fuck fucking fucked crap damn retard freak creep coward liar ugly hate kill die
hateful vile despicable degenerate parasite subhuman
connard connasse salope merde putain abruti crétin imbécile ordure débile
arschloch scheisse scheiße hurensohn idioten dummkopf abschaum widerlich
puta mierda cabrón gilipollas imbécil estúpido estúpida basura asqueroso
""".split()
SECOND = "you your yours yourself youre u ya thou tu toi te vous votre vos du dich dir dein deine ihr euch euer sie usted ustedes tú vosotros vuestro".split()
NEAR = 5  # words between a hit and a second person
LEARNED = 200  # words learned from labels at most
LEARN_DOCS, LEARN_ODDS = 12, 3.0  # a learned word's least documents and log odds

_KEEP = np.arange(256, dtype=np.uint8)  # letters and digits; the rest parts words
_KEEP[65:91] += 32
for _c in range(128):
    if not (chr(_c).isalnum()):
        _KEEP[_c] = 0x20
_LEET = np.arange(256, dtype=np.uint8)  # disguises undone; 0 is dropped
_LEET[65:91] += 32
for _a, _b in zip("0134578@$!|+", "oieastbasilt", strict=True):
    _LEET[ord(_a)] = ord(_b)
for _c in ".,;:-_'\"`~^#%&()[]{}<>?=/\\":
    _LEET[ord(_c)] = 0
FEATURES = ("log_words", "lexicon", "log_lexicon", "learned", "log_learned", "near_you", "you", "capitals", "shouted", "marks", "exclaims", "digits", "disguised", "log_disguised", "mean_length", "symbols")


def word_hashes(texts: list[str]) -> np.ndarray:
    """Sorted hashes of single words."""
    data, off = column_bytes(pa.array(texts, pa.string()))
    return np.unique(words(data, off).hash)


def _in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    k = np.searchsorted(table, h)
    k[k == len(table)] = 0
    return table[k] == h


def _per_row(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    acc = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return acc[off[1:]] - acc[off[:-1]]


def _undisguised(data: np.ndarray, off: np.ndarray) -> Words:
    """Words with disguises undone: signs read as letters, separators dropped, runs of one letter
    shortened to one."""
    m = _LEET[data]
    head = np.zeros(len(data) + 1, bool)
    head[off] = True
    solid = ~SPACE[data]
    tail = np.zeros(len(data), bool)  # trailing marks of a word are punctuation, not letters
    nxt_space = np.ones(len(data), bool)
    nxt_space[:-1] = ~solid[1:] | head[1 : len(data)]
    mark = (data == 33) | (data == 42) | (data == 36)
    for _ in range(3):
        tail |= mark & nxt_space
        nxt_space[:-1] |= tail[1:]
    drop = (m == 0) | tail
    same = np.zeros(len(data), bool)
    same[1:] = (m[1:] == m[:-1]) & solid[1:] & ~head[1 : len(data)]
    keep = ~(drop | same)
    acc = np.concatenate(([0], np.cumsum(keep)))
    return words(m[keep], acc[off])


def squeeze(s: str) -> str:
    return "".join(c for i, c in enumerate(s) if i == 0 or c != s[i - 1])


def features(data: np.ndarray, off: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of the texts data[off[i]:off[i+1]]."""
    n = len(off) - 1
    w = words(_KEEP[data], off)
    cnt = np.bincount(w.row, minlength=n).astype(float)
    per = lambda flag: np.bincount(w.row[flag], minlength=n).astype(float)
    lex, you, own = _in(w.hash, _LEX), _in(w.hash, _YOU), _in(w.hash, learned)
    at = np.flatnonzero(you)
    hit = np.flatnonzero(lex)
    close = np.zeros(len(hit), bool)
    if len(at):
        for side in (np.searchsorted(at, hit), np.searchsorted(at, hit) - 1):
            k = np.clip(side, 0, len(at) - 1)
            close |= (np.abs(at[k] - hit) <= NEAR) & (w.row[at[k]] == w.row[hit])
    near = np.bincount(w.row[hit[close]], minlength=n).astype(float)
    u = _undisguised(data, off)
    hidden = np.maximum(0.0, np.bincount(u.row[_in(u.hash, _SQUEEZED)], minlength=n) - per(lex))
    size = np.maximum(np.diff(off), 1).astype(float)
    up = (data >= 65) & (data <= 90)
    low = (data >= 97) & (data <= 122)
    shouted = np.zeros(len(data), bool)
    shouted[1:] = up[1:] & up[:-1]
    punct = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))
    words_ = np.maximum(cnt, 1)
    letters = np.maximum(_per_row(up, off) + _per_row(low, off), 1)
    return np.stack((
        np.log1p(cnt), per(lex) / words_, np.log1p(per(lex)), per(own) / words_, np.log1p(per(own)), near / words_, per(you) / words_,
        _per_row(up, off) / letters, _per_row(shouted, off) / letters, _per_row(punct, off) / size, _per_row(data == 33, off) / size, _per_row((data >= 48) & (data < 58), off) / size,
        hidden / words_, np.log1p(hidden), np.bincount(w.row, weights=w.end - w.start, minlength=n) / words_, _per_row((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42), off) / size,
    ), axis=1)


_LEX, _YOU, _SQUEEZED = word_hashes(LEXICON), word_hashes(SECOND), word_hashes([squeeze(x) for x in LEXICON if len(x) > 3])


def _word_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, positive documents, negative documents) of a run of labelled texts, for all its words."""
    for b in batches:
        data, off = column_bytes(b.column(0))
        y = b.column(1).to_numpy()
        for lo, hi in chunks(off):
            w = words(_KEEP[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo])
            _, at, inv = np.unique(w.hash, return_index=True, return_inverse=True)
            pair = np.unique(inv.astype(np.int64) * (hi - lo) + w.row)
            word, row = pair // (hi - lo), pair % (hi - lo)
            pos = np.bincount(word, weights=y[lo:hi][row], minlength=len(at)).astype(np.int64)
            neg = np.bincount(word, minlength=len(at)) - pos
            raw, ln = word_texts(w, at)
            cut = np.concatenate(([0], np.cumsum(ln)))
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(pos), pa.array(neg)], ["word", "pos", "neg"])


def learn_words(sample: DataFrame, limit: int = LEARNED) -> list[str]:
    """Words far likelier in toxic texts of the sample, at most `limit`; most telling first."""
    y = Counter({r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()})
    odds = F.log((F.col("pos") + 0.5) / (y[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (y[0] + 1.0))
    got = sample.select("text", "label").mapInArrow(_word_labels, "word binary, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = got.filter((F.col("pos") >= max(LEARN_DOCS, 0.01 * y[1])) & (odds >= LEARN_ODDS)).orderBy(F.desc(odds * F.sqrt("pos")), "word").limit(limit)
    return [bytes(r.word).decode("utf-8", "replace") for r in got.collect()]


class Model:
    """Trees, calibration and learned words; small enough to travel in a task."""

    def __init__(self, trees: Boosted, calibrate: Isotonic, learned: list[str]):
        self.trees, self.calibrate, self.learned = trees, calibrate, word_hashes(learned)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.clip(self.calibrate(self.trees.raw(features(data, off, self.learned))), 0.0, 1.0)


def _calibrates():
    return F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)) == 0


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `rows` labelled documents. A quarter of them, by hash of the id, only
    calibrates; words and trees are learned from the rest. If one part has a single label, the
    calibration is that of the prior: all scores are shrunk to the share of label 1."""
    sample = labelled_sample(docs, labels, label, held_out, rows)
    learned = learn_words(sample.filter(~_calibrates()))
    table = word_hashes(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(1))
            for lo, hi in chunks(off):
                x = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], table)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in (0, 2, 3)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "cal", "x"])

    got = sample.select("doc_id", "text", "label", _calibrates().alias("cal")).mapInArrow(run, "doc_id long, label int, cal boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got.x.tolist(), np.float64).reshape(len(got), len(FEATURES))
    y = got.label.to_numpy(float)
    part = got.cal.to_numpy(bool)
    mean = float(y.mean()) if len(y) else 0.0
    if len(np.unique(y[part])) < 2 or len(np.unique(y[~part])) < 2:
        return Model(Boosted(trees=0).fit(x, y), Isotonic().fit(np.zeros(max(1, len(y))), np.full(max(1, len(y)), mean)), learned)
    trees = Boosted().fit(x[~part], y[~part])
    return Model(trees, Isotonic().fit(trees.raw(x[part]), y[part]), learned)


def score_documents(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", cut: float = 0.7, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored as empty; whole texts are read however long. Null ids are
    scored, not learned from, and not held out. Without usable labels every score is the share of
    label 1 among them (0 if none). Equal texts get equal scores. An empty table gives no rows;
    extra columns are ignored.
    """
    d = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = fit(d, labels, held_out, label, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(1))
            for lo, hi in chunks(off):
                s = model.score(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = d.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
