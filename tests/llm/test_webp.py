from __future__ import annotations

import struct

import numpy as np
import pytest

from gnomon.llm import webp
from gnomon.llm.webp import Writer, decode, encode


def finish(w: Writer) -> bytes:
    body = w.value.to_bytes(w.n // 8 + 1, "little")
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def start(width: int, height: int, alpha: int = 1) -> Writer:
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.put(v, n)
    return w


class Full:
    """A code of the given symbols, all of one length (a power of two of them), or of given lengths."""

    def __init__(self, size: int, symbols: list[int], lengths: dict[int, int] | None = None):
        n = max(1, (len(symbols) - 1).bit_length())
        self.lengths = lengths or {s: n for s in symbols}
        self.size, self.codes, code, last = size, {}, 0, 0
        for n, s in sorted((n, s) for s, n in self.lengths.items()):
            code <<= n - last
            last = n
            self.codes[s] = (code, n)
            code += 1

    def write(self, w: Writer) -> None:
        if len(self.lengths) == 1 and next(iter(self.lengths)) < 256:
            w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(next(iter(self.lengths)), 8)
            self.codes = {s: (0, 0) for s in self.lengths}
            return
        w.put(0, 1)
        w.put(15, 4)  # all 19 lengths of code lengths: 16 literal ones of 4 bits
        for s in webp.CODE_ORDER:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for s in range(self.size):
            w.code(self.lengths.get(s, 0), 4)

    def put(self, w: Writer, s: int) -> None:
        w.code(*self.codes[s])


BYTE = [*range(256)]


def image(w: Writer, argb: list[int], main: bool) -> None:
    """An entropy image of literals, with codes that are not all complete bytes."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    codes = [Full(280, BYTE + [256, 257]) if False else Full(280, BYTE), Full(256, BYTE), Full(256, BYTE), Full(256, BYTE), Full(40, [0])]
    for c in codes:
        c.write(w)
    for p in argb:
        for c, s in zip(codes[:4], (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24), strict=True):
            c.put(w, s)


def pack(px: np.ndarray) -> list[int]:
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in px.reshape(-1, 4)]


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (11, 144), (64, 2)])
def test_round_trip(shape):
    px = np.random.default_rng(1).integers(0, 256, (*shape, 4), dtype=np.uint8)
    assert (decode(encode(px)) == px).all()


def test_prefix_codes_back_references_and_cache():
    # 4 x 2: a, b, then a copy of both (distance 2 is code 120 + 2), then two from the cache, then a run over itself
    a, b = 0xFF102030, 0x80AABBCC
    w = start(4, 2)
    w.put(0, 1)
    w.put(1, 1), w.put(4, 4)  # a cache of 16
    w.put(0, 1)
    key = [(0x1E35A7BD * x & 0xFFFFFFFF) >> 28 for x in (a, b)]
    assert key[0] != key[1]
    g = Full(296, [], {0x20: 3, 0xBB: 3, 257: 2, 280 + key[0]: 2, 280 + key[1]: 2})
    r, bl, al = Full(256, [0x10, 0xAA]), Full(256, [0x30, 0xCC]), Full(256, [0xFF, 0x80])
    d = Full(40, [0, 13])
    for c in (g, r, bl, al, d):
        c.write(w)
    for x in (a, b):
        for c, s in ((g, x >> 8 & 255), (r, x >> 16 & 255), (bl, x & 255), (al, x >> 24)):
            c.put(w, s)
    g.put(w, 257)  # length 2
    d.put(w, 13)  # 2 + 1 << 5 = 96, and 5 more bits: 97..128
    w.put(122 - 97, 5)
    g.put(w, 280 + key[1])
    g.put(w, 280 + key[0])
    g.put(w, 257)
    d.put(w, 0)  # (0, 1): the pixel above
    assert pack(decode(finish(w))) == [a, b, a, b, b, a, a, b]


def test_transforms():
    rng = np.random.default_rng(2)
    px = rng.integers(0, 256, (6, 9, 4), dtype=np.uint8)
    # subtract green
    w = start(9, 6)
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    less = px.copy()
    less[..., 0] -= px[..., 1]
    less[..., 2] -= px[..., 1]
    image(w, pack(less), True)
    assert (decode(finish(w)) == px).all()
    # cross colour, one tile of 4 x 4 multipliers each
    w = start(9, 6)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    tiles = [int(x) for x in rng.integers(0, 1 << 24, 3 * 2)]
    image(w, tiles, False)
    w.put(0, 1)
    signed = lambda v: (int(v) + 128) % 256 - 128
    sent = px.copy()
    for y in range(6):
        for x in range(9):
            t = tiles[(y >> 2) * 3 + (x >> 2)]
            red, green, blue, _ = (int(v) for v in px[y, x])
            sent[y, x, 0] = (red - (signed(t) * signed(green) >> 5)) & 255
            sent[y, x, 2] = (blue - (signed(t >> 8 & 255) * signed(green) >> 5) - (signed(t >> 16) * signed(red) >> 5)) & 255
    image(w, pack(sent), True)
    assert (decode(finish(w)) == px).all()


@pytest.mark.parametrize("n", [2, 4, 16, 40])
def test_palette(n):
    rng = np.random.default_rng(n)
    palette = rng.integers(0, 256, (n, 4), dtype=np.uint8)
    index = rng.integers(0, n, (5, 11))
    b = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    w = start(11, 5)
    w.put(1, 1), w.put(3, 2), w.put(n - 1, 8)
    image(w, pack(np.diff(palette, axis=0, prepend=np.zeros((1, 4), np.uint8))), False)
    w.put(0, 1)
    per, across = 8 >> b, (11 + (1 << b) - 1) >> b
    sent = [sum(int(index[y, x]) << per * (x & (1 << b) - 1) for x in range(k << b, min(11, (k + 1) << b))) << 8 for y in range(5) for k in range(across)]
    image(w, sent, True)
    assert (decode(finish(w)) == palette[index]).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    """The inverse of a forward predictor written from the format's definitions."""
    rng = np.random.default_rng(mode)
    h, wd = 5, 6
    px = rng.integers(0, 256, (h, wd, 4)).astype(int)
    avg = lambda a, b: (a + b) // 2

    def predict(y, x):
        black = np.array([0, 0, 0, 255])
        if not y:
            return px[0, x - 1] if x else black
        if not x:
            return px[y - 1, 0]
        left, top, tl = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
        tr = px[y - 1, x + 1] if x + 1 < wd else px[y, 0]
        gap = avg(left, top) - tl
        closer = left if np.abs(top - tl).sum() < np.abs(left - tl).sum() else top
        return [black, left, top, tr, tl, avg(avg(left, tr), top), avg(left, tl), avg(left, top), avg(tl, top), avg(top, tr), avg(avg(left, tl), avg(top, tr)), closer, np.clip(left + top - tl, 0, 255), np.clip(avg(left, top) + np.trunc(gap / 2).astype(int), 0, 255)][mode]

    sent = np.array([[(px[y, x] - predict(y, x)) % 256 for x in range(wd)] for y in range(h)])
    w = start(wd, h)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    image(w, [mode << 8] * 4, False)
    w.put(0, 1)
    image(w, pack(sent), True)
    assert (decode(finish(w)) == px).all()


def test_groups_of_codes():
    """Two groups of prefix codes, chosen by tile."""
    w = start(8, 4)
    w.put(0, 1), w.put(0, 1), w.put(1, 1), w.put(0, 3)  # tiles of 4
    image(w, [0, 1 << 8], False)
    groups = [[Full(280, [k]), Full(256, [k + 1]), Full(256, [9]), Full(256, [255]), Full(40, [0])] for k in (10, 20)]
    for c in [c for g in groups for c in g]:
        c.write(w)
    assert decode(finish(w))[:, :, 1].tolist() == [[10] * 4 + [20] * 4] * 4


def test_query_values(spark):
    rows = [(1, "é" * 400), (2, None), (3, ""), (4, "é" * 400), (None, "x")]
    got = {r.doc_id: r for r in webp.media(spark.createDataFrame(rows, "doc_id long, text string"), with_media=True).collect()}
    assert got[1].n_bytes == 800 and got[1].payload_bytes == 1152 and got[1][1:] == got[4][1:]
    assert bytes(webp.load([bytes(got[1].media)])[0].tobytes()) == ("é" * 400).encode() + b"\xff" * 352
    assert got[2][1:] == got[3][1:] and got[2].n_bytes == 0 and got[2].payload_bytes == 576 and len(got) == 5
    assert webp.media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tall_payload():
    data = bytes(range(256)) * (9 * 16400 // 4)
    data += b"\xff" * (-len(data) % 576)
    (media,) = webp.store([np.frombuffer(data, np.uint8)])
    assert webp.load([media])[0].tobytes() == data and len(media) < len(data)
