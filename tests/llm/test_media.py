"""FLAC columns: exact round trips, streams of every kind against a scalar writer, damage, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweight.llm import flac, media

DOCS = "doc_id long, text string"


class Writer:
    """Bits of one frame, one field after the other."""

    def __init__(self):
        self.bits = ""

    def put(self, v, n):
        self.bits += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def bytes(self):
        b = self.bits + "0" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8))


def crc(data, poly, width):
    c = 0
    for x in data:
        c ^= x << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) & 1 else c << 1) & ((1 << width) - 1)
    return c


def utf8(n):
    if n < 0x80:
        return bytes([n])
    k = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    return bytes([(0xFF00 >> k) & 255 | n >> 6 * (k - 1)]) + bytes(0x80 | n >> 6 * j & 63 for j in range(k - 2, -1, -1))


def subframe(w, x, bits, r):
    """One channel in a form drawn at random."""
    waste = 0
    while waste < bits - 2 and all(v % (2 << waste) == 0 for v in x) and any(x):
        waste += 1
    waste = r.randrange(waste + 1)
    x, bits = [v >> waste for v in x], bits - waste
    kinds = ["verbatim", "fixed", "lpc"] + ["constant"] * (len(set(x)) == 1) * 3
    kind = r.choice(kinds)
    if kind == "constant" or kind == "verbatim":
        w.put((kind == "verbatim") << 1 | (waste > 0), 8)
        w.put(1, waste)
        for v in x[: 1 if kind == "constant" else None]:
            w.put(v, bits)
        return
    parts = r.choice([p for p in range(5) if len(x) % (1 << p) == 0])
    run = len(x) >> parts
    o = r.randrange(min(5 if kind == "fixed" else 9, run + 1))
    if kind == "lpc":
        o = max(1, o) if run >= 1 else 0
        precision, shift = r.randrange(4, 13), r.randrange(0, 6)
        c = [r.randrange(-(1 << precision - 1), 1 << precision - 1) // (1 << 2 * j) for j in range(o)]
    else:
        c, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][o], 0
    w.put((8 + o if kind == "fixed" else 31 + o) << 1 | (waste > 0), 8)
    w.put(1, waste)
    for v in x[:o]:
        w.put(v, bits)
    if kind == "lpc":
        w.put(precision - 1, 4)
        w.put(shift, 5)
        for v in c:
            w.put(v, precision)
    res = [x[i] - (sum(a * x[i - 1 - j] for j, a in enumerate(c)) >> shift) for i in range(o, len(x))]
    method = r.randrange(2)
    w.put(method, 2)
    w.put(parts, 4)
    wide = 5 if method else 4
    for p in range(1 << parts):
        mine = res[max(0, p * run - o) : (p + 1) * run - o]
        width = max((abs(v) for v in mine), default=0).bit_length() + 1
        if r.random() < 0.25 and width < 32:
            w.put((1 << wide) - 1, wide)
            w.put(width if any(mine) else 0, 5)
            for v in mine:
                w.put(v, width if any(mine) else 0)
        else:
            top = max(0, width - r.choice([1, 3, 7]))
            k = min(top, (1 << wide) - 2)
            w.put(k, wide)
            for v in mine:
                u = v * 2 if v >= 0 else -v * 2 - 1
                w.put(1, (u >> k) + 1)
                w.put(u, k)


def stream(r, channels, bits, sizes, variable, layouts):
    x = [[0] * channels]
    for _ in range(sum(sizes) - 1):
        x.append([max(-(1 << bits - 1), min((1 << bits - 1) - 1, v + r.randrange(-40, 41) * (1 << max(0, bits - 10)))) for v in x[-1]])
    if r.random() < 0.3:
        x = [[v // 8 * 8 for v in s] for s in x]
    if r.random() < 0.2:
        x[: sizes[0]] = [[5] * channels] * sizes[0]
    out, at = b"", 0
    for k, n in enumerate(sizes):
        part = [[s[c] for s in x[at : at + n]] for c in range(channels)]
        layout = r.choice(layouts)
        head = bytes([0xFF, 0xF8 | variable, (1 if n == 192 else 6 if n <= 256 else 7) << 4, layout << 4 | {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits] * r.randrange(2) << 1])
        head += utf8(at if variable else k) + (b"" if n == 192 else (n - 1).to_bytes(1 if n <= 256 else 2, "big"))
        head += bytes([crc(head, 0x07, 8)])
        w = Writer()
        if layout >= 8:
            a, b = part
            part = {8: [a, [i - j for i, j in zip(a, b)]], 9: [[i - j for i, j in zip(a, b)], b], 10: [[(i + j) >> 1 for i, j in zip(a, b)], [i - j for i, j in zip(a, b)]]}[layout]
        for c, y in enumerate(part):
            subframe(w, y, bits + (layout in (8, 10) and c == 1 or layout == 9 and c == 0), r)
        body = head + w.bytes()
        out, at = out + body + crc(body, 0x8005, 16).to_bytes(2, "big"), at + n
    raw = b"".join(v.to_bytes(-(-bits // 8), "little", signed=True) for s in x for v in s)
    info = max(16, max(sizes)).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | channels - 1 << 41 | bits - 1 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    tag = bytes([4]) + (9).to_bytes(3, "big") + b"\xff\xf8comment"
    return b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x80 | 1]) + (5).to_bytes(3, "big") + bytes(5) if not out else b"fLaC" + b"\0" + (34).to_bytes(3, "big") + info + bytes([0x80 | tag[0]]) + tag[1:] + out, raw


def joined(streams, **kw):
    got, errors = [b""] * len(streams), [None] * len(streams)
    for i, first, frames in flac.decode(streams, **kw):
        if first is None:
            errors[i] = frames
        else:
            got[i] += flac.pcm(frames, flac.read_info(streams[i]).bits)
    return got, errors


def test_streams_of_every_kind():
    r = random.Random(5)
    made = []
    for bits in (8, 12, 16, 20, 24):
        for channels in (1, 2, 3):
            for variable in (0, 1):
                for _ in range(4):
                    sizes = [r.choice([192, 64, 320]) for _ in range(r.randrange(1, 5))] if variable else [r.choice([192, 64])] * r.randrange(1, 5)
                    made.append(stream(r, channels, bits, sizes, variable, [1, 8, 9, 10] if channels == 2 else [channels - 1]))
    got, errors = joined([m[0] for m in made])
    assert errors == [None] * len(made) and got == [m[1] for m in made]
    made = made[::6]
    got, errors = joined([m[0] for m in made], size=500)  # many stretches, frames across their ends
    assert errors == [None] * len(made) and got == [m[1] for m in made]


@pytest.mark.parametrize("bits", [8, 16])
def test_round_trip(bits):
    r = np.random.default_rng(6)
    top = 1 << bits - 1
    signals = [np.zeros(0, int), np.full(500, 3), r.integers(-top, top, 1000), np.clip(np.cumsum(r.integers(-3, 4, 2000)), -top, top - 1), (top / 2 * np.sin(np.arange(5000) / 9)).astype(int), np.array([-top, top - 1] * 96), np.array([7])]
    made = flac.encode([s.astype(f"int{bits}") for s in signals], bits=bits)
    got, errors = joined(made)
    assert errors == [None] * len(made) and got == [s.astype(f"<i{bits // 8}").tobytes() for s in signals]
    assert len(made[1]) < 150 and len(made[4]) < 0.8 * bits / 8 * 5000
    kinds = {b[flac.read_info(b).first + 6 + (n % 192 > 0 and n < 192) * 2] >> 1 for b, n in zip(made[1:], map(len, signals[1:]))}
    assert any(k >= 32 for k in kinds) or any(8 <= k <= 12 for k in kinds)


def test_a_header_inside_a_frame_is_no_frame():
    head = bytes([0xFF, 0xF8, 0x14, 0x02, 0x01])
    x = np.frombuffer(b"".join(head + bytes([crc(head, 0x07, 8)]) + random.Random(k).randbytes(90) for k in range(20)), np.int8)
    made = flac.encode([x, x[::-1].copy()])
    assert len(flac.find_heads(np.frombuffer(made[0], np.uint8)).at) > 10
    got, errors = joined(made)
    assert got == [x.tobytes(), x[::-1].tobytes()] and errors == [None, None]


def test_damage_is_seen(spark):
    r = random.Random(8)
    x = np.array([r.randrange(-128, 128) if i % 2 else 5 for i in range(1920)], np.int8)
    whole = flac.encode([x])[0]
    first = flac.read_info(whole).first
    rows = [(-1, whole), (-2, None), (-3, b""), (-4, b"fLaC"), (-5, whole[:-3]), (-6, whole[: flac.read_info(whole).first])]
    rows += [(at, whole[:at] + bytes([whole[at] ^ 1 << r.randrange(8)]) + whole[at + 1 :]) for at in range(first, len(whole), 7)]
    rows += [(0, whole[:26] + bytes([whole[26] ^ 1]) + whole[27:])]  # the MD5 of the samples
    d = spark.createDataFrame(rows, "id long, media binary").withColumn("pcm", F.lit("clash"))
    got = {}
    for b in media.pcm_blocks(d.repartition(3)).collect():
        got.setdefault(b.id, []).append(b)
    assert all(b.error is None for b in got[-1]) and b"".join(b.pcm for b in sorted(got[-1], key=lambda b: b.first_sample)) == x.tobytes()
    assert [b.first_sample for b in sorted(got[-1], key=lambda b: b.first_sample)] == list(range(0, 1920, 192))
    for i, _ in rows[1:]:
        bad = [b for b in got[i] if b.error is not None]
        assert len(bad) == 1 and bad[0].pcm is None and all(x.tobytes()[b.first_sample :].startswith(bytes(b.pcm)) for b in got[i] if b.error is None)


def test_seeking(spark):
    x = np.arange(2000) % 251 - 125
    y = (x * 50).astype(np.int16)
    d = spark.createDataFrame([(1, flac.encode([x.astype(np.int8)])[0]), (2, flac.encode([y], bits=16)[0])], "id long, media binary")
    blocks = media.pcm_blocks(d)
    got = {}
    for b in sorted(media.samples_between(blocks, 190, 700).collect(), key=lambda b: b.first_sample):
        got[b.id] = got.get(b.id, b"") + b.pcm
    assert got == {1: x[190:700].astype(np.int8).tobytes(), 2: y[190:700].tobytes()}
    assert media.samples_between(blocks, 5000, 6000).isEmpty()
    seek = flac.read_info(flac.encode([np.resize(x, 192 * 200).astype(np.int8)])[0]).seek
    assert [s for s, _ in seek] == [0, 64 * 192, 128 * 192, 192 * 192]


def test_digests(spark):
    r = random.Random(7)
    texts = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 100, "wörd \x00\x7f " * 300, "".join(chr(r.randrange(32, 0x3000)) for _ in range(40_000)), "w " * 1_200_000]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts + texts[:6])] + [(4, "same")] * 2
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    for c in ("media", "n_bytes", "id", "feature"):
        d = d.withColumn(c, F.lit("clash"))
    got = media.media_digests(d).collect()
    assert len(got) == len(rows) and media.media_digests(d.limit(0)).count() == 0

    def want(t):
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        x = np.frombuffer(p, np.uint8).astype(int) - 128
        m = flac.encode([x.astype(np.int8)])[0]
        f = f"blocks={len(p) // 192} sum={x.sum()} energy={(x * x).sum()} crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()} low={x.min()} high={x.max()}"
        return (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), f)

    key = lambda t: (t[0] is None, t)
    assert sorted(((g[0], *g[1:]) for g in got), key=key) == sorted(((i, *want(t)) for i, t in rows), key=key)
