"""Baseline JPEG images, decoded with numpy where no image library is at hand.

Sequential Huffman coding of 8 bits, grey or YCbCr, with any sampling factors
and restart intervals. Entropy decoding walks the bits, as each code's start
depends on the one before; transforms, upsampling and colours are whole arrays.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

#: Place of the k-th coefficient of a block, row by row, in zigzag order: along anti-diagonals, turning at each.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
#: Start-of-frame markers that are not read (fixed values of the format): extended, progressive, lossless, arithmetic.
_OTHER_FRAMES = {0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


class BrokenImage(ValueError):
    """Bytes that end early or contradict themselves."""


def is_jpeg(data: bytes) -> bool:
    return data[:3] == b"\xff\xd8\xff"


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that begins each 16-bit prefix; length 0 where none does."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = k = 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            a = code << (16 - bits)
            if a >= 1 << 16:
                raise BrokenImage("a Huffman table has too many codes")
            length[a : a + (1 << (16 - bits))], symbol[a : a + (1 << (16 - bits))] = bits, s
            code += 1
        k += n
        code <<= 1
    return length, symbol


@cache
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    c = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def _segments(data: bytes):
    """(marker, body, where the body ends) up to the scan; the scan's entropy data follow its header."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise BrokenImage("a JPEG marker is missing")
        if data[at + 1] == 0xFF:  # fill byte
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        if at + 2 + n > len(data):
            break
        yield data[at + 1], data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n
    raise BrokenImage("a JPEG file ends before its image")


def _scan(stretch: bytes, blocks: list[tuple[int, int]], tables: list, units: int, out: list[list[np.ndarray]]) -> None:
    """Coefficients of `units` groups of blocks from one stretch between restarts. blocks: component and its number of blocks in a group."""
    raw = stretch.replace(b"\xff\x00", b"\xff")
    total, at = 8 * len(raw), 0
    data = raw + b"\xff" * 512  # a block that runs past the end is noticed when it is whole
    before = {c: 0 for c, _ in blocks}

    def peek(at: int) -> int:
        """16 bits from a position."""
        b = at >> 3
        return ((data[b] << 16 | data[b + 1] << 8 | data[b + 2]) >> (8 - (at & 7))) & 0xFFFF

    for _ in range(units):
        for c, n in blocks:
            (dc_len, dc_sym), (ac_len, ac_sym) = tables[c]
            for _ in range(n):
                block = np.zeros(64, np.int32)
                word = peek(at)
                size, s = int(dc_len[word]), int(dc_sym[word])
                if not size or s > 15:
                    raise BrokenImage("a JPEG code is not in its table")
                at += size
                if s:
                    v = peek(at) >> (16 - s)
                    at += s
                    before[c] += v if v >> (s - 1) else v - (1 << s) + 1
                block[0] = before[c]
                k = 1
                while k < 64:
                    word = peek(at)
                    size, rs = int(ac_len[word]), int(ac_sym[word])
                    if not size:
                        raise BrokenImage("a JPEG code is not in its table")
                    at += size
                    run, s = rs >> 4, rs & 15
                    if not s:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        raise BrokenImage("a JPEG block has more than 64 values")
                    v = peek(at) >> (16 - s)
                    at += s
                    block[k] = v if v >> (s - 1) else v - (1 << s) + 1
                    k += 1
                if at > total:
                    raise BrokenImage("a JPEG file ends before its image")
                out[c].append(block)


def _stretches(data: bytes, at: int) -> list[bytes]:
    """Entropy data from a position to the end-of-image marker, cut at restart markers."""
    out, first = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise BrokenImage("a JPEG file ends before its image")
        kind = data[at + 1]
        if kind == 0:
            at += 2
        elif kind == 0xFF:
            at += 1
        else:
            out.append(data[first:at])
            if not 0xD0 <= kind <= 0xD7:
                return out
            first = at = at + 2


def _plane(blocks: list[np.ndarray], quant: np.ndarray, wide: int, h: int, v: int) -> np.ndarray:
    """Samples of a component: groups of h x v blocks, `wide` groups a row."""
    x = np.zeros((len(blocks), 64))
    x[:, ZIGZAG] = np.stack(blocks) * quant
    c = _cosines()
    x = np.rint(c.T @ x.reshape(-1, 8, 8) @ c + 128).clip(0, 255)
    tall = len(blocks) // (wide * h * v)
    return x.reshape(tall, wide, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(tall * v * 8, wide * h * 8)


def read_jpeg(data: bytes) -> np.ndarray:
    """Height x width, or height x width x 3 of red, green and blue."""
    if not is_jpeg(data):
        raise ValueError("no JPEG")
    quants: dict[int, np.ndarray] = {}
    codes: dict[int, tuple] = {}
    parts: list[tuple[int, int, int, int]] = []
    every, adobe, height, width = 0, None, 0, 0
    for marker, body, end in _segments(data):
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    size = 64 << wide
                    quants[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[1 + size :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                if bits != 8 or n not in (1, 3) or not height or not width or any(not 0 < x < 5 for _, h, v, _ in parts for x in (h, v)):
                    raise ValueError("a JPEG of this kind is not read")
            elif marker in _OTHER_FRAMES:
                raise ValueError(f"a JPEG of this kind is not read: frame {marker:X}, only baseline is")
            elif marker == 0xDD:
                (every,) = struct.unpack_from(">H", body)
            elif marker == 0xEE and body[:5] == b"Adobe":
                adobe = body[11]
            elif marker == 0xDA:
                if not parts or body[0] != len(parts):
                    raise ValueError("a JPEG of this kind is not read: several scans")
                of = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                tables = [(codes[of[i] >> 4], codes[0x10 | of[i] & 15]) for i, *_ in parts]
                return _image(data, end, parts, quants, tables, every, adobe, height, width)
        except (IndexError, KeyError, struct.error) as e:
            raise BrokenImage(f"a JPEG segment {marker:X} is cut or names a missing table") from e
    raise BrokenImage("a JPEG file ends before its image")


def _image(data: bytes, at: int, parts: list, quants: dict, tables: list, every: int, adobe: int | None, height: int, width: int) -> np.ndarray:
    if len(parts) == 1:  # blocks of a single component stand alone, whatever its factors say
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    wide, tall = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    out: list[list[np.ndarray]] = [[] for _ in parts]
    groups, left = [(k, p[1] * p[2]) for k, p in enumerate(parts)], wide * tall
    for stretch in _stretches(data, at):
        n = min(left, every or left)
        _scan(stretch, groups, tables, n, out)
        left -= n
        if not left:
            break
    if left:
        raise BrokenImage("a JPEG file ends before its image")
    planes = []
    for (_, h, v, q), blocks in zip(parts, out, strict=True):
        plane = _plane(blocks, quants[q], wide, h, v)[: -(-height * v // top_v), : -(-width * h // top_h)]
        planes.append(_stretched(_stretched(plane, top_v // v, height, top_v % v, v / top_v).T, top_h // h, width, top_h % h, h / top_h).T)
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    y, cb, cr = planes
    if adobe == 0:
        rgb = planes
    else:  # fixed values: the colour transform of JFIF
        rgb = (y + 1.402 * (cr - 128), y - 0.344136286 * (cb - 128) - 0.714136286 * (cr - 128), y + 1.772 * (cb - 128))
    return np.rint(np.stack(rgb, -1)).clip(0, 255).astype(np.uint8)


def _stretched(plane: np.ndarray, times: int, size: int, rest: int, ratio: float) -> np.ndarray:
    """Rows brought to full size: doubled ones as three quarters of the nearer and one of the farther, others repeated."""
    if times == 1 and not rest:
        return plane[:size]
    if times == 2 and not rest:
        above, below = np.concatenate([plane[:1], plane[:-1]]), np.concatenate([plane[1:], plane[-1:]])
        return np.stack([(3 * plane + above) / 4, (3 * plane + below) / 4], 1).reshape(-1, plane.shape[1])[:size]
    return plane[np.minimum((np.arange(size) * ratio).astype(int), len(plane) - 1)]
