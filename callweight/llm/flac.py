"""FLAC streams as arrays: all frames of a batch are written, or read, side by side.

Rice codes have no length of their own, so the codes of one frame can only be read one after the
other; frames can be read at once. Every step below takes the n-th sample of all frames.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
BLOCK_SIZES = {1: 192, **{2 + i: 576 << i for i in range(4)}, **{8 + i: 256 << i for i in range(8)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
MAGIC, STREAMINFO, SEEKTABLE = b"fLaC", 0, 3

BLOCK = 192
ORDER, PRECISION = 4, 10  # of the linear predictors that the encoder tries besides the fixed ones
SEEK_EVERY = 64  # frames from one seek point to the next
WINDOW = 8192  # frames written at once, blocks of samples read at once


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = []
    for v in range(256):
        c = v << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (width - 1) else c << 1) & ((1 << width) - 1)
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(buf: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Checksum of buf[start : start + length] for many spans, longest spans first inside."""
    o = np.argsort(-length, kind="stable")
    at, left, c = start[o], length[o], np.zeros(len(o), np.int64)
    more = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")  # spans longer than t
    for t, n in enumerate(more):
        c[:n] = ((c[:n] << 8) & ((1 << width) - 1)) ^ table[(c[:n] >> (width - 8)) ^ buf[at[:n] + t]]
    out = np.empty_like(c)
    out[o] = c
    return out


# Writing


def pack(fields: list[tuple], size: int) -> np.ndarray:
    """Bytes with each field (bit position, value, up to 25 bits) in its place; fields do not overlap,
    so adding up their bytes puts them together."""
    pos, val, n = (np.concatenate([np.broadcast_to(f[i], np.shape(f[0])).reshape(-1) for f in fields]) for i in range(3))
    word = (val & ((1 << n) - 1)) << (32 - n - (pos & 7))
    out = np.zeros(size + 4)
    for j in range(4):
        out += np.bincount((pos >> 3) + j, weights=(word >> (24 - 8 * j)) & 255, minlength=size + 4)
    return out[:size].astype(np.uint8)


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shift) of each row's linear predictor, by Levinson and Durbin's recursion on
    whole-number autocorrelations; element by element, so a row gives the same bits anywhere."""
    r = np.stack([(x[:, j:] * x[:, : x.shape[1] - j]).sum(axis=1) for j in range(ORDER + 1)]).astype(np.float64)
    a, err = np.zeros((ORDER, x.shape[0])), np.where(r[0] > 0, r[0], 1.0)
    for i in range(ORDER):
        acc = r[i + 1].copy()
        for j in range(i):
            acc -= a[j] * r[i - j]
        k = np.clip(acc / err, -1.0, 1.0)
        old = a.copy()
        a[i] = k
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        err = np.where(err * (1 - k * k) > 1e-9 * r[0], err * (1 - k * k), np.maximum(r[0], 1.0))
    top = np.frexp(np.abs(a).max(axis=0))[1]
    shift = np.clip(PRECISION - 1 - top, 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * 2.0**shift), -most, most).astype(np.int64), shift.astype(np.int64)


def _rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of a Rice code for each row of folded residuals."""
    mean = res.sum(axis=1) * 7 // (10 * max(1, res.shape[1]))
    k = np.clip(np.frexp(mean.astype(np.float64))[1] - 1, 0, 13)
    bits = [(res >> (k + d)[:, None]).sum(axis=1) + res.shape[1] * (k + d + 1) for d in (0, 1)]
    return np.where(bits[1] < bits[0], k + 1, k), np.minimum(*bits)


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> (8 * r.dtype.itemsize - 1))


def _utf8(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, count) of numbers of up to 36 bits in the extended UTF-8 code."""
    size = 1 + sum((n >= b).astype(np.int64) for b in (0x80, 0x800, 0x10000, 0x200000, 0x4000000, 0x80000000))
    out = np.zeros((len(n), 7), np.int64)
    for j in range(7):
        tail = (n >> np.maximum(0, 6 * (size - 1 - j))) & 63
        lead = np.where(size == 1, n, ((0xFF00 >> size) & 255) | (n >> np.minimum(63, 6 * (size - 1))))
        out[:, j] = lead if j == 0 else np.where(j < size, 0x80 | tail, 0)
    return out, size


def write_frames(x: np.ndarray, number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): one frame for each row of samples, each in its cheapest form."""
    w, n = x.shape
    code = next((c for c, s in BLOCK_SIZES.items() if s == n), 7)
    head = np.zeros((w, 16), np.int64)
    utf, n_utf = _utf8(number)
    head[:, :4] = [0xFF, 0xF8, code << 4, next(c for c, b in BITS.items() if b == bits) << 1]
    head[:, 4:11] = utf
    n_head = 4 + n_utf
    if code == 7:
        for j in (8, 0):
            head[np.arange(w), n_head] = (n - 1) >> j & 255
            n_head = n_head + 1
    check = crc(head.reshape(-1), np.arange(w) * 16, n_head, CRC8, 8)
    head[np.arange(w), n_head] = check
    n_head = n_head + 1

    # What each form costs; ties go to the first.
    forms, r = [], x
    for o in range(min(len(FIXED), n)):
        forms.append((8 + o, o, None, _fold(r)))
        r = np.diff(r, axis=1)
    if n > ORDER:
        coef, shift = _predictors(x)
        p = sum(coef[j][:, None] * x[:, ORDER - 1 - j : n - 1 - j] for j in range(ORDER)) >> shift[:, None]
        forms.append((32 + ORDER - 1, ORDER, (coef, shift), _fold(x[:, ORDER:] - p)))
    cost = [np.full(w, n * bits), np.where((x == x[:, :1]).all(axis=1), bits, 1 << 40)]
    param = []
    for _, o, lpc, res in forms:
        k, c = _rice(res)
        param.append(k)
        cost.append(c + 10 + o * bits + (9 + ORDER * PRECISION if lpc else 0))
    best = np.argmin(np.stack(cost), axis=0)
    size = n_head + 1 + -(-np.stack(cost)[best, np.arange(w)] // 8) + 2
    off = np.concatenate([[0], np.cumsum(size)])
    fields = [((off[:-1, None] * 8 + np.arange(16) * 8)[np.arange(16) < n_head[:, None]], head[np.arange(16) < n_head[:, None]], 8)]
    for f in np.unique(best).tolist():
        rows = np.flatnonzero(best == f)
        at = (off[rows] + n_head[rows]) * 8
        if f < 2:
            fields += [(at, 1 - f << 1, 8)]  # verbatim samples, or one constant
            fields += [((at + 8)[:, None] + np.arange(n if f == 0 else 1) * bits, x[rows, : n if f == 0 else 1], bits)]
            continue
        kind, o, lpc, res = forms[f - 2]
        k, res = param[f - 2][rows], res[rows]
        fields += [(at, kind << 1, 8), ((at + 8)[:, None] + np.arange(o) * bits, x[rows, :o], bits)]
        at = at + 8 + o * bits
        if lpc:
            fields += [(at, (PRECISION - 1) << 5 | lpc[1][rows], 9), ((at + 9)[:, None] + np.arange(ORDER) * PRECISION, lpc[0][:, rows].T, PRECISION)]
            at = at + 9 + ORDER * PRECISION
        fields += [(at, k, 10)]  # four-bit parameters, one partition, its parameter
        q = res >> k[:, None]
        length = q + 1 + k[:, None]
        start = (at + 10)[:, None] + np.cumsum(length, axis=1) - length
        low = (1 << k)[:, None]
        fields += [(start + q, low | res & (low - 1), np.broadcast_to(k[:, None] + 1, res.shape))]
    out = pack(fields, int(off[-1]))
    c16 = crc(out, off[:-1], size - 2, CRC16, 16)
    out[off[1:] - 2], out[off[1:] - 1] = c16 >> 8, c16 & 255
    return out, off


def encode(signals: list[np.ndarray], bits: int = 8, rate: int = 8000, block: int = BLOCK) -> list[bytes]:
    """A FLAC stream of one channel for each array of signed whole samples."""
    frame = [(f, k, lo, min(block, len(s) - lo)) for f, s in enumerate(signals) for k, lo in enumerate(range(0, len(s), block))]
    of, number, start, length = (np.array(c, np.int64) for c in zip(*frame, strict=True)) if frame else (np.zeros(0, np.int64),) * 4
    base = np.cumsum([0, *map(len, signals)])
    flat = np.concatenate([np.zeros(0, np.int8), *signals])
    done: list[bytes] = [b""] * len(frame)
    for n in np.unique(length):
        same = np.flatnonzero(length == n)
        for lo in range(0, len(same), WINDOW):
            rows = same[lo : lo + WINDOW]
            at = base[of[rows]] + start[rows]
            data, off = write_frames(flat[at[:, None] + np.arange(n)].astype(np.int32 if bits <= 8 else np.int64), number[rows], bits)
            view = data.tobytes()
            for i, a, b in zip(rows.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                done[i] = view[a:b]
    first = np.searchsorted(of, np.arange(len(signals) + 1))
    out = []
    for f, s in enumerate(signals):
        mine = done[first[f] : first[f + 1]]
        sizes = list(map(len, mine)) or [0]
        at = np.concatenate([[0], np.cumsum(sizes)])
        md5 = hashlib.md5(s.astype(f"<i{bits // 8}").tobytes()).digest()
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | bits - 1 << 36 | len(s)).to_bytes(8, "big") + md5
        seek = b"".join((k * block).to_bytes(8, "big") + int(at[k]).to_bytes(8, "big") + int(min(block, len(s) - k * block)).to_bytes(2, "big") for k in range(0, len(mine), SEEK_EVERY))
        meta = [bytes([STREAMINFO]) + len(info).to_bytes(3, "big") + info, bytes([0x80 | SEEKTABLE]) + len(seek).to_bytes(3, "big") + seek]
        out.append(MAGIC + b"".join(meta) + b"".join(mine))
    return out


# Reading


class Bits:
    """Big-endian bit fields of a byte array at many places at once."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        buf = data.tobytes() + bytes(32)
        self.word = np.empty(n + 17, np.uint64)
        for j in range(8):
            mine = self.word[j::8]
            mine[:] = np.frombuffer(buf, ">u8", len(mine), j)
        self.end, self.data, self.solid = 8 * n, data, None

    def window(self, p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, self.end)
        return self.word[p >> 3] << (p & 7).astype(np.uint64)

    def read(self, p: np.ndarray, n) -> np.ndarray:
        """Unsigned value of the n <= 33 bits at each place."""
        return ((self.window(p) >> np.uint64(1)) >> (63 - np.asarray(n)).astype(np.uint64)).astype(np.int64)

    def signed(self, p: np.ndarray, n) -> np.ndarray:
        v, n = self.read(p, n), np.asarray(n)
        return np.where(n > 0, v - ((v >> np.maximum(n - 1, 0)) << n), 0)

    def zeros(self, p: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """Number of 0 bits up to the next 1; beyond the data what is left."""
        w = self.window(p) if w is None else w
        top = (w >> np.uint64(11)).astype(np.int64)
        out = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        far = np.flatnonzero(top == 0)
        if len(far):
            if self.solid is None:
                self.solid = np.flatnonzero(self.data)
            at = np.append(self.solid, len(self.data))[np.searchsorted(self.solid, (p[far] + 53) >> 3)]
            lead = 8 - np.frexp(np.append(self.data, 255)[at].astype(np.float64))[1]
            out[far] = np.maximum(8 * at + lead - p[far], 0)
        return out


@dataclass
class Info:
    """What a stream says of itself."""

    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    first: int  # byte of the first frame
    seek: list[tuple[int, int]]  # (sample, byte after the first frame's)


def read_info(data: bytes) -> Info:
    if data[:4] != MAGIC:
        raise ValueError("not a FLAC stream")
    at, info, seek, last = 4, None, [], False
    while not last:
        if at + 4 > len(data):
            raise ValueError("metadata ends early")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body, at = data[at + 4 : at + 4 + n], at + 4 + n
        if kind == STREAMINFO and n >= 34:
            v = int.from_bytes(body[10:18], "big")
            info = (v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & ((1 << 36) - 1), bytes(body[18:34]))
        elif kind == SEEKTABLE:
            seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, n - 17, 18)]
    if info is None:
        raise ValueError("no stream info")
    return Info(*info, at, [s for s in seek if s[0] != (1 << 64) - 1])


@dataclass
class Heads:
    """Frame headers, one array element a frame."""

    at: np.ndarray  # byte of the frame
    body: np.ndarray  # byte after the header
    size: np.ndarray  # samples
    layout: np.ndarray  # channel assignment
    bits: np.ndarray  # 0: as the stream says
    number: np.ndarray  # of the frame, or of its first sample
    by_sample: np.ndarray

    def take(self, i: np.ndarray) -> Heads:
        return Heads(*(v[i] for v in vars(self).values()))


def find_heads(buf: np.ndarray) -> Heads:
    """All places that hold a valid frame header with its checksum; a few may lie inside frames."""
    pad = np.concatenate([buf, np.zeros(20, np.uint8)])
    at = np.flatnonzero((buf[:-1] == 0xFF) & ((buf[1:] & 0xFE) == 0xF8)) if len(buf) > 1 else np.zeros(0, np.int64)
    h = pad[at[:, None] + np.arange(18)].astype(np.int64)
    size_code, rate_code, layout, bit_code = h[:, 2] >> 4, h[:, 2] & 15, h[:, 3] >> 4, h[:, 3] >> 1 & 7
    ones = 8 - np.frexp((h[:, 4] ^ 0xFF).astype(np.float64))[1]  # leading 1 bits: how many bytes the number takes
    ok = (size_code != 0) & (rate_code != 15) & (layout < 11) & (bit_code != 3) & (h[:, 3] & 1 == 0) & (ones != 1) & (ones < 8)
    more = np.where(ones == 0, 0, np.clip(ones - 1, 0, 6))
    ok &= ((h[:, 5:11] >> 6 == 2) | (np.arange(1, 7) > more[:, None])).all(axis=1)
    number = np.where(ones == 0, h[:, 4], h[:, 4] & (0x7F >> np.clip(ones, 0, 7)))
    for j in range(6):
        number = np.where(j < more, number << 6 | h[:, 5 + j] & 63, number)
    p, row = 5 + more, np.arange(len(at))
    size = np.array([BLOCK_SIZES.get(c, 0) for c in range(16)])[size_code]
    size = np.where(size_code == 6, h[row, p] + 1, np.where(size_code == 7, (h[row, p] << 8 | h[row, p + 1]) + 1, size))
    p = p + np.where(size_code == 6, 1, np.where(size_code == 7, 2, 0)) + np.where(rate_code == 12, 1, np.where(rate_code > 12, 2, 0))
    if len(at):
        ok &= crc(pad, at, p, CRC8, 8) == h[row, p]
    bits = np.array([BITS.get(c, 0) for c in range(8)])[bit_code]
    return Heads(at, at + p + 1, size, layout, bits, number, h[:, 1] & 1 == 1).take(np.flatnonzero(ok))


def _subframes(b: Bits, p: np.ndarray, n: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples [n, frames], bit after each, whether it is sound) of one channel of frames of n samples."""
    w = len(p)
    x, end, good = np.zeros((n, w), np.int64), p.copy(), b.read(p, 1) == 0
    kind = b.read(p + 1, 6)
    waste = np.where(b.read(p + 7, 1) == 1, b.zeros(p + 8) + 1, 0)
    p = p + 8 + waste
    good &= waste < depth
    depth = np.where(good, depth - waste, 1)
    constant, plain = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    x[:, constant] = b.signed(p[constant], depth[constant])
    end[constant] = p[constant] + depth[constant]
    x[:, plain] = b.signed(p[plain] + np.arange(n)[:, None] * depth[plain], depth[plain])
    end[plain] = p[plain] + n * depth[plain]
    order = np.where(kind >= 32, kind - 31, kind - 8)
    pred = (kind >= 32) | (kind >= 8) & (kind <= 12)
    good &= (kind < 2) | pred & (order <= n)
    rows = np.flatnonzero(pred & good)
    if len(rows):
        x[:, rows], end[rows], fine = _predicted(b, p[rows], n, depth[rows], kind[rows], order[rows])
        good[rows] &= fine
    return x << waste, end, good


def _predicted(b: Bits, p: np.ndarray, n: int, depth: np.ndarray, kind: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for fixed and linear predictors."""
    w, most = len(p), int(order.max())
    good = np.ones(w, bool)
    x = np.zeros((most + n, w), np.int64)  # `most` rows of nothing ahead of the samples
    for j in range(most):
        r = np.flatnonzero(order > j)
        x[most + j, r] = b.signed(p[r], depth[r])
        p[r] += depth[r]
    coef, shift = np.zeros((most, w), np.int64), np.zeros(w, np.int64)  # coef[most - 1 - j] goes with the sample j + 1 back
    for o, c in enumerate(FIXED):
        for j, v in enumerate(c):
            coef[most - 1 - j : most - j, kind == 8 + o] = v
    lin = np.flatnonzero(kind >= 32)
    if len(lin):
        precision = b.read(p[lin], 4) + 1
        shift[lin] = b.signed(p[lin] + 4, 5)
        good[lin] &= (precision < 16) & (shift[lin] >= 0)
        shift = np.maximum(shift, 0)
        p[lin] += 9
        for j in range(int(order[lin].max())):
            r = order[lin] > j
            coef[most - 1 - j, lin[r]] = b.signed(p[lin[r]], precision[r])
            p[lin[r]] += precision[r]
    method, parts = b.read(p, 2), b.read(p + 2, 4)
    p += 6
    run = n >> parts
    good &= (method < 2) & (run << parts == n) & (run >= order)
    run = np.maximum(run, 1)
    wide = np.where(method == 1, 5, 4)
    k, raw = np.zeros(w, np.int64), np.zeros(w, bool)

    def parameter(r: np.ndarray) -> None:
        v = b.read(p[r], wide[r])
        raw[r] = v == (1 << wide[r]) - 1
        k[r] = np.where(raw[r], b.read(p[r] + wide[r], 5), v)
        p[r] += wide[r] + np.where(raw[r], 5, 0)

    turns = {int(t) for s in np.unique(run) for t in range(0, n, int(s))}
    some_raw = False
    for s in range(n):
        if s <= most or s in turns:
            if s <= most:
                parameter(np.flatnonzero(order == s))
            if s in turns and s:
                parameter(np.flatnonzero((s % run == 0) & (s >= order)))
            some_raw = bool(raw.any())
        if s < most:
            r = np.flatnonzero(order <= s)
            if not len(r):
                continue
        else:
            r = slice(None)
        at, kk = p[r], k[r]
        win = b.window(at)
        q = b.zeros(at, win)
        low = ((win << np.minimum(q + 1, 63).astype(np.uint64)) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)
        far = np.flatnonzero(q + 1 + kk > 56)
        low = low.astype(np.int64)
        if len(far):
            low[far] = b.read(at[far] + q[far] + 1, kk[far])
        u = q << kk | low
        res, step = (u >> 1) ^ -(u & 1), q + 1 + kk
        if some_raw:
            f = raw[r]
            res, step = np.where(f, b.signed(at, kk), res), np.where(f, kk, step)
        p[r] = at + step
        if most:
            res = res + (np.einsum("ij,ij->j", coef[:, r], x[s : s + most, r]) >> shift[r])
        x[most + s, r] = res
    return x[most:], p, good & (p <= b.end)


def read_frames(buf: np.ndarray, h: Heads, info_bits: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(samples [channels, size] of each frame, byte after it, whether it is whole and its checksum holds)."""
    b, w = Bits(buf), len(h.at)
    depth = np.where(h.bits > 0, h.bits, info_bits)
    n_channels = np.where(h.layout < 8, h.layout + 1, 2)
    out: list = [None] * w
    end, good = np.zeros(w, np.int64), np.ones(w, bool)
    for n, c in sorted({*zip(h.size.tolist(), n_channels.tolist(), strict=True)}):
        rows = np.flatnonzero((h.size == n) & (n_channels == c))
        p, lay, sound, x = h.body[rows] * 8, h.layout[rows], np.ones(len(rows), bool), []
        for ch in range(c):
            side = ((lay == 8) | (lay == 10)) & (ch == 1) | (lay == 9) & (ch == 0)
            y, p, fine = _subframes(b, p, n, depth[rows] + side)
            x.append(y)
            sound &= fine
        if c == 2:
            l, r = x
            mid = l << 1 | r & 1
            x = [np.where(lay == 9, l + r, np.where(lay == 10, (mid + r) >> 1, l)), np.where(lay == 8, l - r, np.where(lay == 10, (mid - r) >> 1, r))]
        end[rows], good[rows] = (p + 7) // 8 + 2, sound
        both = np.stack(x, axis=1).transpose(2, 1, 0)  # frames, channels, samples
        for i, f in enumerate(rows.tolist()):
            out[f] = both[i]
    good &= end <= len(buf)
    i = np.flatnonzero(good)
    good[i] &= crc(buf, h.at[i], end[i] - h.at[i], CRC16, 16) == 0
    return out, end, good


def pcm(frames: list[np.ndarray], bits: int) -> bytes:
    """Interleaved little-endian signed samples of whole bytes."""
    x = np.concatenate(frames, axis=1).T
    wide = -(-bits // 8)
    return x.astype(f"<i{wide}").tobytes() if wide != 3 else x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()


class Reading:
    """How far a stream is read."""

    def __init__(self, data: bytes):
        self.data, self.error = data, None
        try:
            self.info = read_info(data)
        except ValueError as e:
            self.info, self.error = None, str(e)
        self.at = self.info.first if self.info else len(data)
        self.samples = self.frames = 0
        self.md5 = hashlib.md5()
        self.room = WINDOW * BLOCK

    @property
    def open(self) -> bool:
        return self.error is None and self.at < len(self.data) and not (self.info.total and self.samples >= self.info.total)

    def take(self, frames: list[np.ndarray], end: int) -> None:
        self.md5.update(pcm(frames, self.info.bits))
        self.at, self.frames, self.samples = end, self.frames + len(frames), self.samples + sum(f.shape[1] for f in frames)

    def close(self) -> str | None:
        if self.error is None and self.info.total and self.samples != self.info.total:
            self.error = f"{self.samples} samples of {self.info.total}"
        if self.error is None and any(self.info.md5) and self.md5.digest() != self.info.md5:
            self.error = "the samples have another MD5"
        return self.error


def decode(streams: list[bytes], size: int = WINDOW * BLOCK):
    """Events of many streams: (i, first sample, frames) for stretches of its frames, in order, and
    (i, None, error) once a stream is through, error None if all checksums held. Streams are
    read `size` bytes at a time, many small ones together; a frame begins where the last one ended,
    so what looks like a header inside a frame is no frame."""
    left = [(i, Reading(d)) for i, d in enumerate(streams)]
    while left:
        now, room = [], 0
        for i, r in left:
            if now and room + min(r.room, len(r.data) - r.at) > size:
                break
            now.append((i, r))
            room += min(r.room, len(r.data) - r.at)
        spans = [r.data[r.at : r.at + r.room] if r.open else b"" for _, r in now]
        base = np.cumsum([0, *map(len, spans)])
        buf = np.frombuffer(b"".join(spans), np.uint8)
        h = find_heads(buf)
        file = np.searchsorted(base, h.at, "right") - 1
        bits = np.array([r.info.bits if r.info else 8 for _, r in now], np.int64)
        frames, end, good = read_frames(buf, h, bits[file]) if len(h.at) else ([], np.zeros(0, np.int64), np.zeros(0, bool))
        place = {a: k for k, a in enumerate(h.at.tolist())}
        stop, sound, number, by_sample = end.tolist(), good.tolist(), h.number.tolist(), h.by_sample.tolist()
        again = []
        for f, (i, r) in enumerate(now):
            got, at, n = [], int(base[f]), 0
            while r.open and at < base[f + 1] and not (r.info.total and r.samples + n >= r.info.total):
                k = place.get(at)
                if k is None or not sound[k] or stop[k] > base[f + 1] or number[k] != (r.samples + n if by_sample[k] else r.frames + len(got)) or len(frames[k]) != r.info.channels:
                    break
                got.append(frames[k])
                n, at = n + frames[k].shape[1], stop[k]
            first, whole = r.samples, r.at + len(spans[f]) == len(r.data)
            if got:
                r.take(got, r.at + at - int(base[f]))
                yield i, first, got
            if r.open and not got and whole:
                r.error = f"the frame at byte {r.at} is damaged"
            elif r.open and not got:
                r.room *= 2  # a frame longer than the stretch
            if r.open:
                again.append((i, r))
            else:
                yield i, None, r.close()
        left = again + left[len(now) :]
