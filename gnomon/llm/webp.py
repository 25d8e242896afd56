"""Lossless WebP media columns.

decode() reads any lossless (VP8L) still image: prefix codes in groups, back-
references, colour cache, and the predictor, cross-colour, subtract-green and
palette transforms, and returns the pixels. store() and load() are for whole tables:
``webp_batch`` writes and reads many images in step, with a transform, back-references
and prefix codes of each image's own. encode() writes one image of any size plainly, as
literals of four complete 8-bit codes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gnomon.llm import webp_batch
from gnomon.llm.common import documents, release, slices, table, utf8

ROW = 576  # bytes of payload in a row of pixels: 144 pixels of red, green, blue, alpha
LIMIT = 16384  # largest side of an image
HEIGHT = 16  # rows of pixels in an image of a payload: long texts are many images, which are read in step
AT_ONCE = 500  # images that are written or read in step
GROUP = 2_000_000  # bytes of texts that are stored together
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)

# Fixed values of the format: the order in which lengths of code lengths are stored,
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# and the (x, y) of the first 120 distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """A stream of bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.have = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            chunk = self.data[self.at : self.at + 64]
            self.value |= int.from_bytes(chunk, "little") << self.have
            self.at += 64
            self.have += 512  # past the end: zeros

    def read(self, n: int) -> int:
        self._fill(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.have -= n
        return out

    def place(self) -> int:
        return self.at * 8 - self.have


class Code:
    """A canonical prefix code; one symbol alone takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.single = used[0][1] if len(used) == 1 else (0 if not used else None)
        self.table: dict[tuple[int, int], int] = {}
        code, last = 0, 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            self.table[n, code] = s
            code += 1
        if len(used) > 1 and sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("a prefix code that is not complete")
        self.plain = len(lengths) >= 256 and lengths[:256] == [8] * 256 and not any(lengths[256:])

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            s = self.table.get((n, code))
            if s is not None:
                return s
        raise ValueError("a bit pattern that is no code")


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):  # one or two symbols, given outright
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[CODE_ORDER[k]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    k, before = 0, 8
    while k < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[k] = s
            before = s or before
            k += 1
            continue
        n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if k + n > size:
            raise ValueError("code lengths past the alphabet")
        lengths[k : k + n] = [before if s == 16 else 0] * n
        k += n
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    """The value of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _parts(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An image of ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    tile, groups_of, n_groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = _entropy_image(bits, _parts(width, tile), _parts(height, tile), False)
        groups_of = ((meta >> 8) & 0xFFFF).tolist()
        n_groups = max(groups_of) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, s) for s in sizes] for _ in range(n_groups)]
    total = width * height
    if n_groups == 1 and not cache_bits and all(c.plain for c in groups[0][:4]):
        return _literals(bits, total)
    out, cache, done = [0] * total, [0] * (1 << cache_bits), 0
    across, i = _parts(width, tile) if tile else 0, 0

    def remember() -> None:
        nonlocal done
        while done < i:
            cache[(0x1E35A7BD * out[done] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[done]
            done += 1

    while i < total:
        codes = groups[groups_of[(i // width >> tile) * across + (i % width >> tile)]] if groups_of is not None else groups[0]
        s = codes[0].read(bits)
        if s < 256:
            red = codes[1].read(bits)
            blue = codes[2].read(bits)
            out[i] = codes[3].read(bits) << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 280:
            n = _extended(bits, s - 256)
            d = _extended(bits, codes[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > i:
                raise ValueError("a back-reference before the image")
            for _ in range(min(n, total - i)):
                out[i] = out[i - d]
                i += 1
        else:
            remember()
            out[i] = cache[s - 280]
            i += 1
    return np.array(out, np.uint32)


def _literals(bits: Bits, total: int) -> np.ndarray:
    """Pixels of four complete 8-bit codes: each code is its symbol with the bits reversed."""
    at, shift = divmod(bits.place(), 8)
    raw = np.zeros(4 * total + 1, np.uint8)
    got = np.frombuffer(bits.data, np.uint8)[at : at + 4 * total + 1]
    raw[: len(got)] = got
    if shift:
        raw = (raw[:-1] >> shift) | (raw[1:] << (8 - shift))
    g, r, b, a = _REVERSED[raw[: 4 * total]].reshape(-1, 4).astype(np.uint32).T
    end = bits.place() + 32 * total
    bits.at, bits.value, bits.have = end // 8, 0, 0
    bits.read(end % 8)
    return a << 24 | r << 16 | g << 8 | b


def _split(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _undo_predictor(argb: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    px = _split(argb).reshape(height, width, 4).tolist()
    mode, across = ((modes >> 8) & 15).tolist(), _parts(width, bits)

    def average(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    for y in range(height):
        row, up = px[y], px[y - 1]
        for x in range(width):
            if not y:
                p = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                p = up[0]
            else:
                m = mode[(y >> bits) * across + (x >> bits)]
                left, top, tl = row[x - 1], up[x], up[x - 1]
                tr = up[x + 1] if x + 1 < width else row[0]
                if m == 0 or m > 13:
                    p = [255, 0, 0, 0]
                elif m < 5:
                    p = (left, top, tr, tl)[m - 1]
                elif m == 5:
                    p = average(average(left, tr), top)
                elif m == 6:
                    p = average(left, tl)
                elif m == 7:
                    p = average(left, top)
                elif m == 8:
                    p = average(tl, top)
                elif m == 9:
                    p = average(top, tr)
                elif m == 10:
                    p = average(average(left, tl), average(top, tr))
                elif m == 11:
                    to_left = sum(abs(t - c) for t, c in zip(top, tl, strict=True))
                    to_top = sum(abs(a - c) for a, c in zip(left, tl, strict=True))
                    p = left if to_left < to_top else top
                elif m == 12:
                    p = [min(255, max(0, a + t - c)) for a, t, c in zip(left, top, tl, strict=True)]
                else:
                    p = []
                    for a, c in zip(average(left, top), tl, strict=True):
                        half = abs(a - c) // 2
                        p.append(min(255, max(0, a + (half if a >= c else -half))))
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
    return _join(np.array(px, np.uint32).reshape(-1, 4))


def _join(px: np.ndarray) -> np.ndarray:
    px = px.astype(np.uint32)
    return px[..., 0] << 24 | px[..., 1] << 16 | px[..., 2] << 8 | px[..., 3]


def _undo_colour(argb: np.ndarray, width: int, height: int, bits: int, tiles: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    t = tiles[(y >> bits) * _parts(width, bits) + (x >> bits)]
    signed = lambda v: (v & 0xFF).astype(np.uint8).view(np.int8).astype(np.int64)
    red_blue, green_blue, green_red = signed(t >> 16), signed(t >> 8), signed(t)
    px = _split(argb)
    green = signed(px[:, 2])
    px[:, 1] = (px[:, 1] + (green_red * green >> 5)) & 255
    px[:, 3] = (px[:, 3] + (green_blue * green >> 5) + (red_blue * signed(px[:, 1]) >> 5)) & 255
    return _join(px)


def _undo_palette(argb: np.ndarray, width: int, height: int, bits: int, palette: np.ndarray) -> np.ndarray:
    green = (argb >> 8 & 0xFF).reshape(height, -1)
    per = 8 >> bits
    index = np.stack([green >> (per * k) & ((1 << per) - 1) for k in range(1 << bits)], -1).reshape(height, -1)[:, :width].ravel() if bits else green.ravel()
    return np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], 0).astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file -> (height, width, 4) bytes: red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + -(-struct.unpack_from("<I", data, at + 4)[0] // 2) * 2
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height, has_alpha = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            b = bits.read(3) + 2
            undo.append((kind, across, b, _entropy_image(bits, _parts(across, b), _parts(height, b), False)))
        elif kind == 2:
            undo.append((kind, across, 0, None))
        else:
            n = bits.read(8) + 1
            palette = _join(np.cumsum(_split(_entropy_image(bits, n, 1, False)), 0) & 255)
            b = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, across, b, palette))
            across = _parts(across, b)
    argb = _entropy_image(bits, across, height, True)
    for kind, w, b, extra in reversed(undo):
        if kind == 0:
            argb = _undo_predictor(argb, w, height, b, extra)
        elif kind == 1:
            argb = _undo_colour(argb, w, height, b, extra)
        elif kind == 2:
            px = _split(argb)
            px[:, [1, 3]] = (px[:, [1, 3]] + px[:, 2:3]) & 255
            argb = _join(px)
        else:
            argb = _undo_palette(argb, w, height, b, extra)
    out = np.stack([argb >> s & 0xFF for s in (16, 8, 0, 24)], -1).astype(np.uint8).reshape(height, width, 4)
    if not has_alpha:
        out[..., 3] = 255
    return out


class Writer:
    """Bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, code: int, n: int) -> None:
        """A prefix code: its highest bit first."""
        self.put(int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)


def _head() -> Writer:
    """What follows the sizes of every image that encode() writes."""
    w = Writer()
    w.put(0, 3)  # no transform, no colour cache, one group of codes
    for size in (280, 256, 256, 256):
        w.put(0, 1)
        lengths = {8: 1, 16: 2, 18: 2} if size == 280 else {8: 1, 16: 1}
        n = max(k for k, s in enumerate(CODE_ORDER) if s in lengths) + 1
        w.put(n - 4, 4)
        for s in CODE_ORDER[:n]:
            w.put(lengths.get(s, 0), 3)
        w.put(0, 1)
        codes = {8: (0, 1), 16: (2, 2), 18: (3, 2)} if size == 280 else {8: (0, 1), 16: (1, 1)}
        w.code(*codes[8])  # 1 length of 8, then 255 more: 42 times 6 and 3
        for n in [6] * 42 + [3]:
            w.code(*codes[16])
            w.put(n - 3, 2)
        if size == 280:
            w.code(*codes[18])
            w.put(24 - 11, 7)
    w.put(0b0001, 4)  # distances: a single symbol, 0
    return w


_HEAD = _head()


def encode(pixels: np.ndarray) -> bytes:
    """(height, width, 4) bytes red, green, blue, alpha -> a lossless WebP file of literals."""
    height, width, _ = pixels.shape
    if not (1 <= height <= LIMIT and 1 <= width <= LIMIT):
        raise ValueError("an image's sides are 1 to 16384")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    w.put(_HEAD.value, _HEAD.n)
    whole, shift = divmod(w.n, 8)
    body = _REVERSED[pixels.reshape(-1, 4)[:, [1, 0, 2, 3]].ravel()]
    tail = np.zeros(len(body) + 1, np.uint8)
    tail[:-1] = body << shift
    if shift:
        tail[1:] |= body >> (8 - shift)
    head = w.value.to_bytes(whole + 1, "little")
    tail[0] |= head[-1]
    chunk = head[:-1] + tail.tobytes()
    pad = b"\x00" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """Payloads of whole rows of pixels -> WebP files of HEIGHT rows at most, those of a payload one after the other."""
    images, owner = [], []
    for k, payload in enumerate(payloads):
        px = payload.reshape(-1, ROW // 4, 4)
        images += [px[s : s + HEIGHT] for s in range(0, len(px), HEIGHT)]
        owner += [k] * -(-len(px) // HEIGHT)
    files: list[list[bytes]] = [[] for _ in payloads]
    for s in range(0, len(images), AT_ONCE):
        for k, f in zip(owner[s:], webp_batch.encode_many(images[s : s + AT_ONCE]), strict=False):
            files[k].append(f)
    return [b"".join(f) for f in files]


def load(media: list[bytes]) -> list[np.ndarray]:
    """The pixels of media as ``store`` writes them; files of another writer are read one by one."""
    files, owner = [], []
    for k, m in enumerate(media):
        at = 0
        while at < len(m):
            n = 8 + struct.unpack_from("<I", m, at + 4)[0]
            files.append(m[at : at + n])
            owner.append(k)
            at += n
    parts: list[list[np.ndarray]] = [[] for _ in media]
    for s in range(0, len(files), AT_ONCE):
        some = files[s : s + AT_ONCE]
        try:
            images = webp_batch.decode_many(some)
        except webp_batch.NotOurs:
            images = [decode(f) for f in some]
        for k, px in zip(owner[s:], images, strict=False):
            parts[k].append(px)
    return [np.concatenate(p) for p in parts]


def features(px: np.ndarray) -> str:
    """Size, mean of each channel, and the entropy of all bytes, as text."""
    count = np.bincount(px.ravel(), minlength=256)
    p = count[count > 0] / px.size
    mean = px.reshape(-1, 4).mean(0)
    return f"{px.shape[1]}x{px.shape[0]};mean={','.join(f'{m:.3f}' for m in mean)};entropy={-(p * np.log2(p)).sum():.4f}"


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each whole text, as UTF-8 filled up with bytes 255 to rows of pixels, as lossless WebP, and read it back.

    Output: digests of the payload as read back and of the stored form, a feature of the pixels and,
    with ``with_media``, the stored form itself. Null and empty texts are one row of bytes 255. Equal
    texts give equal values; repeated and null doc_ids keep a row each; an empty table gives no rows.
    """
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["media"] * with_media
    types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()] * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for a, b in slices(offsets, GROUP):
                sizes = np.diff(offsets[a : b + 1]).tolist()
                payloads = []
                for k, n in enumerate(sizes, a):
                    payload = np.full(max(1, -(-n // ROW)) * ROW, 255, np.uint8)
                    payload[:n] = data[offsets[k] : offsets[k + 1]]
                    payloads.append(payload)
                stored, rows = store(payloads), []
                for doc, n, m, px in zip(ids[a:b], sizes, stored, load(stored), strict=True):
                    back = px.tobytes()
                    rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), features(px), *([m] if with_media else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    source = documents(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, _SCHEMA + ", media binary" * with_media)


def query(spark, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
