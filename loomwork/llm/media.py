"""Operator 8, media columns: motion-JPEG in AVI, with shots as timed clip rows.

Every frame is a lossless JPEG (process 14, SOF3: 8-bit samples, predictor 1) and so an intra frame.
The file is RIFF: header list, ``movi`` list of ``00dc`` chunks, ``idx1`` index; the length of what it
holds stands in the stream's ``strd`` chunk. The Huffman table gives difference category s a code of
16 - s bits, so that code and extra bits always fill 16 bits and whole frames are coded and decoded
as arrays. Files from elsewhere are read too, for their shots: with or without an index, with these frames or
ordinary baseline ones. A file is limited by RIFF's 4 GB, nearly 2 GB of samples, which is above what a string column can hold.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shipping import ship

from .common import read
from .jpeg import luma

WIDTH, HEIGHT, FRAME_MS, BINS = 64, 64, 40, 32
#: A shot begins where the histogram difference is above mean + SPREAD deviations of the last SPAN differences, and FLOOR at least. The first difference has none before it and must be above FIRST.
SPAN, SPREAD, FLOOR, FIRST = 8, 3.0, 0.05, 0.5

CATEGORIES = bytes(range(8, -1, -1))
COUNTS = bytes([0] * 7 + [1] * 9)


@lru_cache(maxsize=64)
def code_table(counts: bytes, values: bytes) -> np.ndarray:
    """Difference by 16-bit word, from a Huffman table whose codes and extra bits fill 16 bits; 32767 marks no code."""
    table = np.full(65536, 32767, dtype=np.int16)
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for s in values[k : k + n]:
            if length + s != 16:
                raise ValueError("only tables whose codes and extra bits fill 16 bits are read")
            extra = np.arange(1 << s)
            table[(code << s) + extra] = np.where(extra >= (1 << s) >> 1, extra, extra - (1 << s) + 1)
            code += 1
        k += n
        code <<= 1
    return table


_decode = code_table(COUNTS, CATEGORIES)
_encode = np.zeros(511, dtype=">u2")
_encode[_decode[_decode != 32767] + 255] = np.flatnonzero(_decode != 32767)


@lru_cache(maxsize=128)
def jpeg_head(width: int, height: int) -> bytes:
    table = bytes([0]) + COUNTS + CATEGORIES
    return (
        b"\xff\xd8\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
        + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes([1, 0x11, 0])
        + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
    )


def jpeg_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG of each (height, width) plane of samples (n, height, width), unsigned 8-bit."""
    x = samples.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    words = _encode[d + 255]
    head = jpeg_head(samples.shape[2], samples.shape[1])
    return [head + frame.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for frame in words]


@lru_cache(maxsize=256)
def parsed_head(head: bytes) -> tuple[int, int, bytes, bytes]:
    """Width, height and Huffman table of what comes before the entropy-coded data."""
    at, size, table = 2, None, None
    while at < len(head):
        mark, length = struct.unpack_from(">HH", head, at)
        part = head[at + 4 : at + 2 + length]
        if mark == 0xFFC4:
            table = part[1:17], part[17:]
        elif mark == 0xFFC3:
            bits, high, wide, planes = struct.unpack_from(">BHHB", part)
            if (bits, planes) != (8, 1):
                raise ValueError("one plane of 8-bit samples is read")
            size = wide, high
        elif mark == 0xFFDA and (part[0], part[3]) != (1, 1):
            raise ValueError("predictor 1 is read")
        at += 2 + length
    if size is None or table is None or head[:2] != b"\xff\xd8":
        raise ValueError("not a lossless JPEG frame")
    return *size, *table


def jpeg_samples(frames: list[bytes]) -> np.ndarray:
    """The planes of frames of one size."""
    raw, form = [], None
    for frame in frames:
        begin = frame.index(b"\xff\xda") + 10
        own = parsed_head(frame[:begin])
        if form not in (None, own):
            raise ValueError("frames of several forms")
        form = own
        raw.append(frame[begin:-2].replace(b"\xff\x00", b"\xff"))
    wide, high, counts, values = form
    d = code_table(counts, values)[np.frombuffer(b"".join(raw), dtype=">u2")].reshape(len(frames), high, wide).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi_bytes(payload: bytes) -> bytes:
    """An AVI file of the payload, whose length is a multiple of WIDTH."""
    rows = len(payload) // WIDTH
    high = min(HEIGHT, rows)
    n = -(-rows // high)
    frames = jpeg_frames(np.frombuffer(payload.ljust(n * high * WIDTH, b"\0"), dtype=np.uint8).reshape(n, high, WIDTH))
    most = max(map(len, frames))
    main = struct.pack("<14I", FRAME_MS * 1000, most * 1000 // FRAME_MS, 0, 0x10, n, 0, 1, most, WIDTH, high, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIiI4H", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, -1, 0, 0, 0, WIDTH, high)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, high, 1, 8, b"MJPG", WIDTH * high, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", stream) + chunk(b"strf", form) + chunk(b"strd", struct.pack("<Q", len(payload)))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", strl))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        parts.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of each chunk's data."""
    while at + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, at)
        yield kind, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def avi_parsed(data: bytes) -> tuple[bytes, np.ndarray, int]:
    """The payload, the planes of the frames and the milliseconds a frame stands; frames are found by the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    frames, ms, length = avi_frames(data)
    planes = jpeg_samples(frames)
    return planes.tobytes()[:length], planes, ms


def avi_frames(data: bytes) -> tuple[list[bytes], int, int]:
    """The frames of an AVI file, the milliseconds a frame stands and the stated length of the payload. Frames are found by the index, whose
    places count from the list of frames or from the file's begin, or, where there is none, one after another."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, ms = None, b"", 0, FRAME_MS
    for kind, a, b in chunks(data, 12, len(data)):
        if kind == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, d in chunks(data, a + 4, b):
                if inner == b"avih":
                    ms = max(1, struct.unpack_from("<I", data, c)[0] // 1000)
                elif inner == b"LIST":
                    for own, e, _ in chunks(data, c + 4, d):
                        if own == b"strd" and len(data) >= e + 8:
                            length = struct.unpack_from("<Q", data, e)[0]
        elif kind == b"LIST" and data[a : a + 4] == b"movi":
            movi = a, b
        elif kind == b"idx1":
            index = data[a : b - (b - a) % 16]
    if movi is None:
        raise ValueError("no list of frames")
    frames = []
    for kind, _, at, size in struct.iter_unpack("<4sIII", index):
        if kind[2:] in (b"dc", b"db"):
            begin = movi[0] + at if data[movi[0] + at : movi[0] + at + 4] == kind else at
            frames.append(data[begin + 8 : begin + 8 + size])
    return frames or list(_walked(data, movi[0] + 4, movi[1])), ms, length


def _walked(data: bytes, at: int, end: int) -> Iterator[bytes]:
    for kind, a, b in chunks(data, at, end):
        if kind == b"LIST":
            yield from _walked(data, a + 4, b)
        elif kind[2:] in (b"dc", b"db"):
            yield data[a:b]


def avi_shots(data: bytes) -> list[tuple[int, int, int, float]]:
    """Shots of any motion-JPEG file: lossless frames as written here, else the luma of baseline frames, all of one size."""
    frames, ms, _ = avi_frames(data)
    frames = [f for f in frames if f]  # an empty chunk repeats the frame before
    if not frames:
        return []
    planes = jpeg_samples(frames) if _lossless(frames[0]) else np.stack([luma(f) for f in frames])
    return shots(planes, ms)


def _lossless(frame: bytes) -> bool:
    at = 2
    while at + 4 <= len(frame):
        mark, size = struct.unpack_from(">HH", frame, at)
        if mark in (0xFFC3, 0xFFDA):
            return mark == 0xFFC3
        at += 2 + size
    return False


def shots(planes: np.ndarray, ms: int) -> list[tuple[int, int, int, float]]:
    """Begin and end in milliseconds, frames and mean sample of each shot."""
    n, each = len(planes), planes[0].size
    bins = (planes.reshape(n, -1) >> 3).astype(np.int64) + BINS * np.arange(n)[:, None]
    counts = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    differ = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * each)
    cuts = [0]
    for t in range(n - 1):
        last = differ[max(0, t - SPAN) : t]
        if differ[t] > max(FLOOR, last.mean() + SPREAD * last.std() if len(last) else FIRST):
            cuts.append(t + 1)
    means = planes.reshape(n, -1).mean(axis=1)
    return [(a * ms, b * ms, b - a, float(means[a:b].mean())) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


CLIP = "array<struct<begin_ms:long,end_ms:long,frames:long,mean:double>>"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each whole text in an AVI file, read the file back, and describe it.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32 (all of the bytes read back),
    media_bytes, media_sha256, clips (begin, end, frames and mean sample of each shot) and, with
    keep_media, the file itself. The payload is the text in UTF-8 (null: empty) with zero bytes up to
    a positive multiple of 64. Equal texts give equal values; repeated rows stay; an empty table gives
    no rows; other columns are not read.
    """
    ship(df.sparkSession)
    source = df.select(df[id_col], df[text_col].alias("__text"))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIP}" + ", media binary" * keep_media
    clip = pa.list_(pa.struct([("begin_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int64()), ("mean", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("__text").to_pylist():
                raw = (text or "").encode()
                media = avi_bytes(raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"))
                payload, planes, ms = avi_parsed(media)
                clips = [dict(zip(("begin_ms", "end_ms", "frames", "mean"), c, strict=True)) for c in shots(planes, ms)]
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), clips, *[media] * keep_media))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip, pa.binary()]
            columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(7 + keep_media)]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "media"][: 7 + keep_media]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *columns], [id_col, *names])

    return source.mapInArrow(run, schema)


def clip_rows(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each clip: id, its place, begin and end in milliseconds, frames, mean sample."""
    return media.select(id_col, F.posexplode("clips").alias("clip", "c")).select(id_col, "clip", "c.*")


def media_clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id_col, clips and error of a column of motion-JPEG AVI files, written here or elsewhere.

    A file that cannot be read has no clips and says why in error; a null or a file without frames has no clips and no error. Repeated rows
    stay; an empty table gives no rows; other columns are not read. What is read: RIFF with or without an index, frames of
    the lossless form above or baseline frames that bring their Huffman tables."""
    ship(df.sparkSession)
    clip = pa.list_(pa.struct([("begin_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int64()), ("mean", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips, errors = [], []
            for media in batch.column("media"):  # one file in memory at a time
                try:
                    found, error = avi_shots(media.as_py()) if media.is_valid else [], None
                except (ValueError, struct.error) as broken:
                    found, error = [], str(broken)
                clips.append([dict(zip(("begin_ms", "end_ms", "frames", "mean"), c, strict=True)) for c in found])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(clips, clip), pa.array(errors, pa.string())], [id_col, "clips", "error"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, clips {CLIP}, error string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("shots="), F.size("clips").cast("string")),
        F.concat_ws(",", F.transform("clips", lambda c: F.concat_ws(":", c.begin_ms.cast("string"), c.end_ms.cast("string"), F.format_string("%.3f", c.mean)))),
    )
    return media_columns(read(spark, sf_dir, "documents"), keep_media=False).withColumn("feature", feature).drop("clips")
