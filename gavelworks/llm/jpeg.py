"""Brightness of baseline JPEG pictures (sequential Huffman coding, 8 bits, any sampling, restart markers)."""

from __future__ import annotations

import numpy as np


def _zigzag() -> np.ndarray:
    """Place of the k-th coefficient in its 8 x 8 block: diagonals, up and down in turn."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: rows of the cosine transform
COSINE = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)


def lengths_to_codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a Huffman table given by its code lengths."""
    out, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[size, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.hold = (self.hold << 8 | byte) & 0xFFFFFFFF
            self.n += 8

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        return self.hold >> self.n & (1 << n) - 1

    def symbol(self, lookup: list) -> int:
        self.need(16)
        size, sym = lookup[self.hold >> (self.n - 16) & 0xFFFF]
        if not size:
            raise ValueError("code")
        self.n -= size
        return sym


def _lookup(codes: dict[tuple[int, int], int]) -> list:
    """Every 16-bit prefix -> (length, symbol)."""
    out = [(0, 0)] * 65536
    for (size, code), sym in codes.items():
        start = code << (16 - size)
        out[start : start + (1 << (16 - size))] = [(size, sym)] * (1 << (16 - size))
    return out


def _signed(v: int, size: int) -> int:
    return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode(data: bytes) -> np.ndarray | None:
    """Grey image, or None for other kinds of JPEG; damaged files raise ValueError or IndexError."""
    at, quant, dc, ac, every, frame = 2, {}, {}, {}, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while part:
                wide = part[0] >> 4
                quant[part[0] & 15] = np.frombuffer(part[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                part = part[65 + 64 * wide :]
        elif kind == 0xC4:
            while part:
                n = sum(part[1:17])
                (ac if part[0] >> 4 else dc)[part[0] & 15] = _lookup(lengths_to_codes(part[1:17], part[17 : 17 + n]))
                part = part[17 + n :]
        elif kind in (0xC0, 0xC1):
            if part[0] != 8:
                return None
            h, w = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
            frame = [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(part[5])]
        elif kind in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)) and kind != 0xCC:
            return None  # progressive, lossless, arithmetic
        elif kind == 0xDD:
            every = int.from_bytes(part[:2], "big")
        elif kind == 0xDA:
            break
    else:
        raise ValueError("no scan")
    if frame is None or part[0] != len(frame) or not h or not w:
        return None
    tables = {part[1 + 2 * i]: (part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15) for i in range(part[0])}
    wide, tall = (max(f[1] for f in frame), max(f[2] for f in frame)) if len(frame) > 1 else (frame[0][1], frame[0][2])
    if len(frame) == 1:  # a scan of one component has one block a unit
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        wide = tall = 1
    across, down = -(-w // (8 * wide)), -(-h // (8 * tall))
    _, lx, ly, lq = frame[0]
    blocks = np.zeros((down * ly, across * lx, 64))
    bits, last, left = _scan_bits(data, at), [0] * len(frame), every
    run = next(bits)
    for unit in range(across * down):
        if every and unit and unit % every == 0:
            run, last = next(bits), [0] * len(frame)
        for c, (name, sx, sy, _) in enumerate(frame):
            dct, act = dc[tables[name][0]], ac[tables[name][1]]
            for v in range(sy):
                for u in range(sx):
                    n = run.symbol(dct)
                    last[c] += _signed(run.read(n), n)
                    block = blocks[unit // across * ly + v, unit % across * lx + u] if c == 0 else None
                    if block is not None:
                        block[0] = last[c]
                    k = 1
                    while k < 64:
                        sym = run.symbol(act)
                        n = sym & 15
                        if not n and sym != 0xF0:
                            break
                        k += sym >> 4
                        value = _signed(run.read(n), n)
                        if block is not None and n:
                            block[k] = value
                        k += 1
    coef = np.zeros_like(blocks)
    coef[..., ZIGZAG] = blocks * quant[lq]
    px = COSINE.T @ coef.reshape(*coef.shape[:2], 8, 8) @ COSINE + 128
    px = px.transpose(0, 2, 1, 3).reshape(8 * px.shape[0], 8 * px.shape[1])
    if (lx, ly) != (wide, tall):  # brightness sampled more coarsely than colour
        px = px.repeat(tall // ly, 0).repeat(wide // lx, 1)
    return np.clip(px[:h, :w], 0, 255).astype(np.float32)


def _scan_bits(data: bytes, at: int):
    """Bit readers of the stretches between restart markers, stuffed zeros taken out."""
    start = at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            yield _Bits(data[start:].replace(b"\xff\x00", b"\xff"))
            return
        if data[at + 1] == 0 or data[at + 1] == 0xFF:
            at += 2 if data[at + 1] == 0 else 1
            continue
        yield _Bits(data[start:at].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= data[at + 1] <= 0xD7:
            return
        at += 2
        start = at
