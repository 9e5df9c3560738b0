"""Media columns: FLAC streams in a binary column, written from texts, read back, cut into PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .scale import small_batches
from .text import chunks, column_bytes

UNIT = 192  # payloads are whole multiples of it
GROUP = 3 << 19  # bytes of payload that are written, or of media that are read, side by side
PAD = b" "


def media_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, spaces appended up to a positive multiple of
    `unit`, as the 8-bit samples (byte - 128) of a FLAC stream. A null text is empty. One row a row."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, off = column_bytes(b.column(1))
            for lo, hi in chunks(off, GROUP):
                size = np.diff(off[lo : hi + 1])
                full = np.maximum(1, -(-size // unit)) * unit
                at = np.concatenate([[0], np.cumsum(full)])
                flat = np.full(int(at[-1]), PAD[0], np.uint8)
                # texts lie one after the other; each moves on by the padding of those before it
                flat[np.arange(int(size.sum())) + np.repeat(at[:-1] - (off[lo:hi] - off[lo]), size)] = data[off[lo] : off[hi]]
                signal = (flat ^ 0x80).view(np.int8)
                media = flac.encode([signal[a:z] for a, z in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], ["id", "n_bytes", "media"])

    d = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(write, "id long, n_bytes long, media binary")


def _groups(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, list]]:
    """(first row, media) of stretches of the batch; null media are empty."""
    col = b.column(b.schema.names.index(column))
    size = np.array([0, *np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in col])])
    for lo, hi in chunks(size, GROUP):
        yield lo, [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in col.slice(lo, hi - lo)]


class _Features:
    """What is asked of a payload, block by block."""

    def __init__(self) -> None:
        self.sha, self.tail, self.blocks, self.n = hashlib.sha256(), b"", 0, 0
        self.total = self.energy = self.crossings = 0
        self.low, self.high, self.last = 127, -128, 0

    def take(self, frames: list[np.ndarray]) -> None:
        x = np.concatenate(frames, axis=1)[0]
        raw = (x + 128).astype(np.uint8).tobytes()
        self.sha.update(raw)
        self.tail = (self.tail + raw[-16:])[-16:]
        self.blocks, self.n = self.blocks + len(frames), self.n + len(x)
        self.total, self.energy = self.total + int(x.sum()), self.energy + int((x * x).sum())
        below = x < 0
        self.crossings += int((below[1:] != below[:-1]).sum()) + int(self.n > len(x) and below[0] != (self.last < 0))
        self.low, self.high, self.last = min(self.low, int(x.min())), max(self.high, int(x.max())), int(x[-1])

    def text(self) -> str:
        return f"blocks={self.blocks} sum={self.total} energy={self.energy} crossings={self.crossings} low={self.low} high={self.high}"


def read_back(media: DataFrame) -> DataFrame:
    """Per row of `media_columns`: what decoding its stored stream gives. All frame checksums and the
    stream's MD5 must hold; a stream that does not decode stops the job."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, streams in _groups(b, "media"):
                got = [_Features() for _ in streams]
                for i, first, frames in flac.decode(streams):
                    if first is not None:
                        got[i].take(frames)
                    elif frames is not None:
                        raise ValueError(f"stored media: {frames}")
                cols = [
                    pa.array([g.n for g in got], pa.int64()), pa.array([g.sha.hexdigest() for g in got]), pa.array([zlib.crc32(g.tail) for g in got], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams]), pa.array([g.text() for g in got]),
                ]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, len(streams)) for i in (0, 1)), *cols], ["id", "n_bytes", *names])

    return media.mapInArrow(read, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The media column is written by one step and read by the next, which sees only its bytes. Null
    texts are empty and give one unit of spaces; null ids stay; repeated rows give repeated rows,
    equal texts equal values; an empty table gives no rows; extra columns are ignored. Texts of any
    length are written and read a stretch at a time. Nothing is shuffled.
    """
    return read_back(media_columns(docs, id_col, text)).withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "id", column: str = "media") -> DataFrame:
    """id, first_sample, n_samples, channels, bits, rate, pcm, error: the blocks of each FLAC stream.

    pcm holds interleaved little-endian signed samples of whole bytes. A stream whose header, frame
    checksums, sample count or MD5 do not hold gives the blocks before the damage and one row with
    `error`, at the sample where reading stopped; null media do too. A sound stream without samples
    gives no rows. Repeated rows give repeated blocks; null ids stay.
    """
    out = "id long, first_sample long, n_samples int, channels int, bits int, rate int, pcm binary, error string"

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).to_pylist()
            for lo, streams in _groups(b, "media"):
                info, at = {}, dict.fromkeys(range(len(streams)), 0)
                for i, first, frames in flac.decode(streams):
                    rows = []
                    if first is None and frames is not None:
                        rows.append((ids[lo + i], at[i], None, None, None, None, None, frames))
                    elif first is not None:
                        f = info.setdefault(i, flac.read_info(streams[i]))
                        for x in frames:
                            rows.append((ids[lo + i], at[i], x.shape[1], f.channels, f.bits, f.rate, flac.pcm([x], f.bits), None))
                            at[i] += x.shape[1]
                    if rows:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in out.split(", ")])

    d = small_batches(media).select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("media"))
    return d.mapInArrow(read, out)


def samples_between(blocks: DataFrame, first: int, end: int) -> DataFrame:
    """(id, first_sample, pcm): samples first to end - 1 of each stream, block by block. Only blocks
    that hold some of them are read, as a filter on their sample offsets; blocks with an error hold none."""
    start, stop = F.greatest(F.col("first_sample"), F.lit(first)), F.least(F.col("first_sample") + F.col("n_samples"), F.lit(end))
    wide = F.col("channels") * F.ceil(F.col("bits") / 8)
    hit = blocks.filter(F.col("error").isNull() & (F.col("first_sample") < end) & (F.col("first_sample") + F.col("n_samples") > first))
    cut = F.substring(F.col("pcm"), ((start - F.col("first_sample")) * wide + 1).cast("int"), ((stop - start) * wide).cast("int"))
    return hit.select("id", start.alias("first_sample"), cut.alias("pcm"))
