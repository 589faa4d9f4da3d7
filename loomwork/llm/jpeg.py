"""Luma planes of baseline JPEG frames, as ordinary motion-JPEG has them: sequential DCT, 8-bit samples, Huffman coded, one scan."""

from __future__ import annotations

import re
import struct

import numpy as np

#: Row and column of the k-th coefficient: along the diagonals, which turn at each end.
ZIGZAG = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class Bits:
    """The bits of an entropy-coded segment, the first of a byte highest; ones behind its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6].ljust(6, b"\xff")
        self.at += 6
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(part)
        self.n += 48

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self.fill()
        found = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if found < 0:
            raise ValueError("a code that no table has")
        self.n -= found >> 8
        return found & 0xFF

    def value(self, size: int) -> int:
        """A signed value of so many bits; those that begin with 0 are negative."""
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        raw = (self.held >> self.n) & ((1 << size) - 1)
        return raw if raw >> (size - 1) else raw - (1 << size) + 1


def lookup(counts: bytes, values: bytes) -> list[int]:
    """By the next 16 bits: length << 8 | symbol, or -1."""
    table, code, k = [-1] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in values[k : k + n]:
            a = code << (16 - length)
            if a >= 65536:
                raise ValueError("too many codes")
            table[a : a + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
            code += 1
        k += n
        code <<= 1
    return table


def luma(frame: bytes) -> np.ndarray:
    """The first component (height, width) of a frame, as unsigned bytes. Raises ValueError for what is not baseline or is broken."""
    try:
        return _luma(frame)
    except (IndexError, KeyError, struct.error, TypeError) as broken:
        raise ValueError("a broken frame") from broken


def _luma(frame: bytes) -> np.ndarray:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, tables, parts, restart = 2, {}, {}, None, 0
    while True:
        mark, length = struct.unpack_from(">HH", frame, at)
        if mark >> 8 != 0xFF:
            raise ValueError("a segment without a marker")
        body, at = frame[at + 4 : at + 2 + length], at + 2 + length
        if mark == 0xFFDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, k + 1)
                k += 129 if wide else 65
        elif mark == 0xFFC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif mark in (0xFFC0, 0xFFC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not high or not wide:
                raise ValueError("samples of 8 bits and a known size are read")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xFFC2 <= mark <= 0xFFCF and mark != 0xFFC8 and mark != 0xFFCC:
            raise ValueError("only baseline frames are read")
        elif mark == 0xFFDD:
            restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xFFDA:
            break
    coders = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])}
    if parts is None or set(coders) != {p[0] for p in parts}:
        raise ValueError("a frame is read whose components stand in one scan")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    end = frame.rfind(b"\xff\xd9")
    segments = re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end > at else len(frame)])
    _, h, v, q = parts[0]
    blocks = np.zeros((down * v, across * h, 64))
    unit, total = 0, across * down
    for segment in segments:
        bits, last = Bits(segment.replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for _ in range(restart or total):
            if unit == total:
                break
            row, column = divmod(unit, across)
            for i, (name, ph, pv, _) in enumerate(parts):
                dc, ac = (tables[t] for t in coders[name])
                for k in range(ph * pv):
                    last[i] += bits.value(bits.symbol(dc))
                    own = blocks[row * v + k // h, column * h + k % h] if i == 0 else None
                    if own is not None:
                        own[0] = last[0]
                    at = 1
                    while at < 64:
                        symbol = bits.symbol(ac)
                        run, size = symbol >> 4, symbol & 15
                        if not size and run < 15:
                            break
                        at += run
                        x = bits.value(size)
                        if own is not None and size:
                            own[at] = x
                        at += 1
            unit += 1
    if unit < total:
        raise ValueError("a frame that ends early")
    grid = np.zeros((down * v, across * h, 8, 8))
    scaled = blocks * np.array(quant[q], dtype=float)
    for k, (i, j) in enumerate(ZIGZAG):
        grid[:, :, i, j] = scaled[:, :, k]
    samples = BASIS.T @ grid @ BASIS + 128
    plane = samples.transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
    # the first component is the finest of ordinary frames; where it is not, samples are repeated
    plane = np.repeat(np.repeat(plane, most_v // v, axis=0), most_h // h, axis=1)
    return np.clip(np.rint(plane[:high, :wide]), 0, 255).astype(np.uint8)
