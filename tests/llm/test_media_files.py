"""Motion-JPEG from elsewhere: baseline frames by a small encoder of our own."""

import struct

import numpy as np
import pytest

from loomwork.llm import media
from loomwork.llm.jpeg import BASIS, ZIGZAG, luma

DC, AC = bytes(range(12)), bytes([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))])


def segment(mark, body):
    return struct.pack(">HH", mark, len(body) + 2) + body


def encode(planes, factors=((1, 1),), restart=0, step=1):
    """A baseline frame of component planes; DC codes have 4 bits each, AC codes 8."""
    high, wide = planes[0].shape[0] // factors[0][1] * max(v for _, v in factors), planes[0].shape[1] // factors[0][0] * max(h for h, _ in factors)
    bits, out, last = [], [], [0] * len(planes)

    def put(value, n):
        bits.extend((value >> (n - 1 - i)) & 1 for i in range(n))

    def number(x):
        n = int(abs(x)).bit_length()
        return n, x if x > 0 else x + (1 << n) - 1

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        out.append(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
        bits.clear()

    single = len(planes) == 1
    most_h, most_v = (1, 1) if single else (max(h for h, _ in factors), max(v for _, v in factors))
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            last = [0] * len(planes)
        row, column = divmod(unit, across)
        for i, plane in enumerate(planes):
            h, v = (1, 1) if single else factors[i]
            padded = np.pad(plane, ((0, 8 * down * v - plane.shape[0]), (0, 8 * across * h - plane.shape[1])), mode="edge")
            for k in range(h * v):
                y, x = 8 * (row * v + k // h), 8 * (column * h + k % h)
                c = np.rint(BASIS @ (padded[y : y + 8, x : x + 8].astype(float) - 128) @ BASIS.T / step).astype(int)
                n, raw = number(c[0, 0] - last[i])
                last[i] = c[0, 0]
                put(DC.index(n), 4)
                put(int(raw), n)
                run = 0
                for p in ZIGZAG[1:]:
                    if not c[p]:
                        run += 1
                        continue
                    while run > 15:
                        put(AC.index(0xF0), 8)
                        run -= 16
                    n, raw = number(int(c[p]))
                    put(AC.index(run << 4 | n), 8)
                    put(int(raw), n)
                    run = 0
                if run:
                    put(AC.index(0), 8)
    flush()
    tables = b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + DC, b"\x10" + bytes([0] * 7 + [len(AC)] + [0] * 8) + AC
    parts = b"".join(bytes([i + 1, factors[i][0] << 4 | factors[i][1], 0]) for i in range(len(planes)))
    head = b"\xff\xd8" + segment(0xFFE0, b"AVI1") + segment(0xFFDB, b"\x00" + bytes([step] * 64)) + b"".join(segment(0xFFC4, t) for t in tables)
    head += segment(0xFFC0, struct.pack(">BHHB", 8, high, wide, len(planes)) + parts) + (segment(0xFFDD, struct.pack(">H", restart)) if restart else b"")
    head += segment(0xFFDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    scan = b"".join(part + (bytes([0xFF, 0xD0 + i % 8]) if i < len(out) - 1 else b"") for i, part in enumerate(out))
    return head + scan + b"\xff\xd9"


def avi(frames, index="list"):
    parts, entries, at = [b"movi"], [], 4
    for f in frames:
        parts.append(media.chunk(b"00dc", f))
        entries.append((at, len(f)))
        at += len(parts[-1])
    head = media.chunk(b"LIST", b"hdrl" + media.chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13)))
    base = 0 if index == "list" else 12 + len(head) + 8
    idx = media.chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 16, base + a, n) for a, n in entries)) if index else b""
    return media.chunk(b"RIFF", b"AVI " + head + media.chunk(b"LIST", b"".join(parts)) + idx)


def picture(seed, high, wide):
    y, x = np.mgrid[:high, :wide]
    return np.clip(120 + 60 * np.sin(x / 9 + seed) + 40 * np.cos(y / 7 * (1 + seed)) + np.random.default_rng(seed).normal(0, 2, (high, wide)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("size", "restart"), [((16, 24), 0), ((13, 21), 2), ((8, 8), 0)])
def test_gray(size, restart):
    p = picture(1, *size)
    assert np.abs(luma(encode([p], restart=restart)).astype(int) - p).max() <= 2
    assert np.abs(luma(encode([p], step=8)).astype(int) - p).mean() < 4


def test_colour_with_coarse_chroma():
    y, c = picture(2, 32, 48), picture(3, 16, 24)
    assert np.abs(luma(encode([y, c, c], ((2, 2), (1, 1), (1, 1)), restart=1)).astype(int) - y).max() <= 2


def test_what_is_not_read():
    good = encode([picture(1, 8, 8)])
    for bad in (b"", b"\xff\xd8", good[:60], good.replace(b"\xff\xc0", b"\xff\xc2"), good[: len(good) // 2]):
        try:
            luma(bad)
        except ValueError:
            continue
        assert bad[:20] == good[:20]  # a frame cut in its scan may be read to its end as ones


@pytest.mark.parametrize("index", ["list", "file", None])
def test_shots_of_files_from_elsewhere(spark, index):
    dark, light = picture(1, 24, 32) // 3, 255 - picture(5, 24, 32) // 4
    frames = [encode([dark])] * 5 + [encode([light])] * 4
    own = media.avi_bytes(b"some text".ljust(64, b"\0"))
    rows = [(1, avi(frames, index)), (2, own), (3, None), (4, b"junk"), (5, avi([frames[0][:40]], index)), (6, avi([], index)), (1, avi(frames, index))]
    got = media.media_clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [(c.begin_ms, c.end_ms, c.frames) for c in by[1].clips] == [(0, 200, 5), (200, 360, 4)] and by[1].error is None
    assert abs(by[1].clips[0]["mean"] - dark.mean()) < 2 and abs(by[1].clips[1]["mean"] - light.mean()) < 2
    assert len(by[2].clips) == 1 and by[2].error is None and by[3].clips == [] and by[3].error is None
    assert by[4].error == "not an AVI file" and by[5].error and by[5].clips == [] and by[6].clips == [] and by[6].error is None
