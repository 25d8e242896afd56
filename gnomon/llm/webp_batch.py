"""Many lossless WebP images at once, in whole arrays.

The writer picks a transform for each image (none, green subtracted, or each pixel predicted by
its left or its upper neighbour), replaces repeats by back-references and writes what is left with
prefix codes of its own for each channel. The reader takes a pixel of every image at each step, so
that its work is array operations over all images, and undoes the transforms. Codes have at most
MOST bits here; other files are for ``webp.decode``, which reads any.
"""

from __future__ import annotations

import struct

import numpy as np

from gnomon.llm.common import U64, mix

ACROSS = 144  # pixels in a row
MOST = 11  # bits of a prefix code: four of them and what is read beside them fit in one machine word
SIZES = (280, 256, 256, 256, 40)  # symbols of green and lengths, red, blue, alpha, distances
WIDE = 280
SHORTEST = 4  # pixels of a back-reference
LONGEST = 4096
_CHANNEL = (1, 0, 2, 3)  # of a pixel's bytes: green, red, blue, alpha
# The code of code lengths, the same in all files: 0 to 15, and runs of zeros (17, 18).
_CL_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_CL_BITS = {s: 5 if s in (1, 2, 14, 15) else 4 for s in (*range(16), 17, 18)}
_REV = np.array([int(f"{i:0{MOST}b}"[::-1], 2) for i in range(1 << MOST)], np.int64)


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, bits)"""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


_CL = _canonical(_CL_BITS)
_CL_VALUE = np.array([_CL.get(s, (0, 0))[0] for s in range(19)], np.int64)
_CL_N = np.array([_CL.get(s, (0, 0))[1] for s in range(19)], np.int64)
_CL_TABLE = np.zeros(32, np.int64)  # by the next five bits: symbol and bits
for _s, (_v, _n) in _CL.items():
    _CL_TABLE[_v :: 1 << _n] = _s << 4 | _n
# What stands before the lengths of each code: not simple, 19 lengths of 3 bits, no number of symbols.
_CL_HEAD = 0 | 15 << 1 | sum(_CL_BITS.get(s, 0) << (5 + 3 * k) for k, s in enumerate(_CL_ORDER))
_CL_HEAD_N = 5 + 57 + 1


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their number) of lengths or distance codes, from 1 on."""
    v = value - 1
    high = np.where(v >= 2, np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 0)
    second = (v >> np.maximum(high - 1, 0)) & 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + second), v & ((1 << extra) - 1), extra


def code_lengths(count: np.ndarray) -> np.ndarray:
    """Lengths of optimal prefix codes of at most MOST bits, a code a row; all rows are built in step.

    Rows with fewer than two symbols get a length of 1 for theirs.
    """
    rows, width = count.shape
    out = np.zeros((rows, width), np.int64)
    todo, c = np.arange(rows), count.astype(np.int64)
    while len(todo):
        used = (c > 0).sum(1)
        order = np.argsort(np.where(c > 0, c, np.iinfo(np.int64).max), axis=1, kind="stable")
        n = int(used.max(initial=0))
        big = np.iinfo(np.int64).max // 4
        leaf = np.take_along_axis(np.where(c > 0, c, big), order, 1)[:, :n]
        leaf = np.concatenate([leaf, np.full((len(todo), 2), big)], 1)
        node = np.full((len(todo), n + 2), big)  # sums, in order of making
        up = np.zeros((len(todo), 2 * n + 2), np.int64)  # parent of each leaf (first n) and each sum
        at, lo, hi = np.arange(len(todo)), np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        for k in range(n - 1):
            live = used > k + 1
            total = np.zeros(len(todo), np.int64)
            for _ in range(2):
                x, y = leaf[at, lo], node[at, hi]
                first = x <= y
                total += np.where(first, x, y)
                who = np.where(first, lo, n + hi)
                up[at[live], who[live]] = n + k
                lo += live & first
                hi += live & ~first
            node[live, k] = total[live]
        depth = np.zeros((len(todo), 2 * n + 2), np.int64)
        for k in range(n - 3, -1, -1):
            live = used > k + 2  # not its row's last sum
            depth[live, n + k] = depth[at[live], up[live, n + k]] + 1
        mine = np.arange(n)[None, :] < used[:, None]
        got = np.where(mine, np.take_along_axis(depth, up[:, :n], 1) + 1, 0) if n else np.zeros((len(todo), 0), np.int64)
        length = np.zeros(c.shape, np.int64)
        np.put_along_axis(length, order[:, :n], got, 1)
        fits = length.max(1, initial=0) <= MOST
        out[todo[fits]] = length[fits]
        todo, c = todo[~fits], (c[~fits] + 1) >> 1  # flatter counts give flatter codes
    return out


def codes(length: np.ndarray) -> np.ndarray:
    """The codes of rows of lengths, first bit lowest."""
    order = np.argsort(np.where(length > 0, length, 99), axis=1, kind="stable")
    n = np.take_along_axis(length, order, 1)
    share = np.where(n > 0, 1 << (MOST - np.minimum(n, MOST)), 0)
    first = np.cumsum(share, 1) - share  # with MOST bits
    out = np.zeros_like(length)
    np.put_along_axis(out, order, np.where(n > 0, _REV[np.minimum(first, (1 << MOST) - 1)], 0), 1)
    return out


def _residual(px: np.ndarray, start: np.ndarray, kind: int) -> np.ndarray:
    """Pixels after a transform: 0 none, 1 green subtracted, 2 predicted by the left one, 3 by the upper one."""
    if kind == 0:
        return px
    if kind == 1:
        out = px.copy()
        out[:, 0] -= px[:, 1]
        out[:, 2] -= px[:, 1]
        return out
    out = px.copy()
    i = np.arange(len(px)) - np.repeat(start, np.diff(np.append(start, len(px))))
    left = np.flatnonzero((i % ACROSS > 0) if kind == 2 else (i > 0) & (i < ACROSS))
    above = np.flatnonzero((i >= ACROSS) & (i % ACROSS == 0) if kind == 2 else i >= ACROSS)
    out[left] -= px[left - 1]
    out[above] -= px[above - ACROSS]
    out[start, 3] -= 255  # the first pixel is predicted as black
    return out


def _undo(px: np.ndarray, kind: int) -> np.ndarray:
    """One image's pixels before the transform."""
    if kind == 1:
        px[:, 0] += px[:, 1]
        px[:, 2] += px[:, 1]
    elif kind > 1:
        px[0, 3] = (int(px[0, 3]) + 255) & 255
        rows = px.reshape(-1, ACROSS, 4)
        if kind == 2:
            rows[:, 0] = np.cumsum(rows[:, 0], 0, dtype=np.uint8)
            px = np.cumsum(rows, 1, dtype=np.uint8)
        else:
            rows[0] = np.cumsum(rows[0], 0, dtype=np.uint8)
            px = np.cumsum(rows, 0, dtype=np.uint8)
    return px.reshape(-1, 4)


def _choose(px: np.ndarray, start: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transform of each image, all pixels after theirs): the one whose channels have the least entropy."""
    n = len(start)
    best, cost = np.zeros(n, np.int64), np.full(n, np.inf)
    size = np.diff(np.append(start, len(px)))
    out = px
    for kind in range(4):
        got = _residual(px, start, kind)
        bits = np.zeros(n)
        for c in range(4):
            h = np.bincount(image * 256 + got[:, c], minlength=256 * n).reshape(n, 256).astype(float)
            bits -= (h * np.log2(np.maximum(h, 1) / size[:, None])).sum(1)
        better = bits < cost - (0 if kind == 0 else 64)  # a transform has to pay for itself
        cost = np.where(better, bits, cost)
        best = np.where(better, kind, best)
        if kind and better.any():
            out = np.where(better[image][:, None], got, out)
    return best, out


def _repeats(value: np.ndarray, image: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, pixels, distance) of back-references that do not overlap, in order: runs that also stand earlier in their image."""
    n = len(value)
    if n <= SHORTEST:
        return (np.empty(0, np.int64),) * 3
    v = value.astype(U64)
    h = image[: n - SHORTEST + 1].astype(U64)
    for k in range(SHORTEST):
        h = mix(h ^ (v[k : n - SHORTEST + 1 + k] + U64(k + 1)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    before = np.full(len(h), -1)
    before[order[1:][same]] = order[:-1][same]
    at = np.flatnonzero((before >= 0) & (np.arange(len(h)) + SHORTEST <= end[image[: len(h)]]))
    at = at[image[at] == image[before[at]]]
    for k in range(SHORTEST):
        at = at[value[at + k] == value[before[at] + k]]
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    gap = at - before[at]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1]) | (image[at[1:]] != image[at[:-1]])]))
    stop = at[np.append(first[1:], len(at)) - 1] + SHORTEST
    out, done = [], 0
    for s, e, d in zip(at[first].tolist(), stop.tolist(), gap[first].tolist(), strict=True):
        s = max(s, done)
        while e - s >= SHORTEST:
            take = min(e - s, LONGEST)
            out.append((s, take, d))
            s += take
            done = s
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _packed(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits of fields of at most 60 bits each, one after the other, as words."""
    off = np.cumsum(n) - n
    total = int(off[-1] + n[-1]) if len(n) else 0
    words = np.zeros(total // 64 + 2, U64)
    word, shift = off >> 6, (off & 63).astype(U64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
    if len(first):
        words[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    over = np.flatnonzero((off & 63) + n > 64)
    words[word[over] + 1] |= value[over] >> (U64(64) - shift[over])
    return words


def _length_fields(length: np.ndarray, lane: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lane, order within it, value, bits) of the fields that tell the lengths of codes: lengths and runs of zeros."""
    rows, width = length.shape
    inside = np.arange(width)[None, :] < size[:, None]
    r, c = np.nonzero((length > 0) & inside)
    parts = [(r, c * 8, _CL_VALUE[length[r, c]], _CL_N[length[r, c]])]
    zero = (length == 0) & inside
    edge = np.diff(np.concatenate([np.zeros((rows, 1), np.int8), zero.astype(np.int8), np.zeros((rows, 1), np.int8)], 1), axis=1)
    r, s = np.nonzero(edge == 1)
    run = np.nonzero(edge == -1)[1] - s
    for k in range(3):  # runs of up to 138 zeros; no alphabet has more than three of these
        take = np.minimum(run, 138)
        long, mid, few = run >= 11, (run >= 3) & (run < 11), (run > 0) & (run < 3)
        parts.append((r[long], s[long] * 8 + k, _CL_VALUE[18] | (take[long] - 11) << _CL_N[18], np.full(int(long.sum()), _CL_N[18] + 7)))
        parts.append((r[mid], s[mid] * 8 + k, _CL_VALUE[17] | (run[mid] - 3) << _CL_N[17], np.full(int(mid.sum()), _CL_N[17] + 3)))
        for j in range(2):
            more = few & (run > j)
            parts.append((r[more], s[more] * 8 + 4 + j, np.full(int(more.sum()), _CL_VALUE[0]), np.full(int(more.sum()), _CL_N[0])))
        run = np.where(long, run - take, 0)
    got = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return lane[got[0]], *got[1:]


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Images of (rows, ACROSS, 4) bytes -> WebP files. What is written for an image depends on it alone."""
    flat = [x.reshape(-1, 4) for x in images]
    size = np.array([len(x) for x in flat])
    start, n = np.cumsum(size) - size, len(images)
    px, image = np.concatenate(flat), np.repeat(np.arange(n), size)
    kind, px = _choose(px, start, image)
    s, take, far = _repeats(np.ascontiguousarray(px).view(np.uint32).ravel(), image, start + size)
    edge = np.zeros(len(px) + 1, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + take, -1)
    plain = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    length_of, length_more, length_n = _prefixed(take)
    far_of, far_more, far_n = _prefixed(np.where(far == 1, 2, np.where(far == ACROSS, 1, far + 120)))
    # how often each symbol stands in each image: five codes an image
    who, whose = image[plain], image[s]
    count = np.zeros((5 * n, WIDE), np.int64)
    for k, c in enumerate(_CHANNEL):
        count[k::5, :256] = np.bincount(who * 256 + px[plain, c], minlength=256 * n).reshape(n, 256)
    count[0::5] += np.bincount(whose * WIDE + 256 + length_of, minlength=WIDE * n).reshape(n, WIDE)
    count[4::5, :40] = np.bincount(whose * 40 + far_of, minlength=40 * n).reshape(n, 40)
    length = code_lengths(count)
    code = codes(length)
    used = (count > 0).sum(1)
    bits = np.where((used < 2)[:, None], 0, length)  # a symbol alone takes no bits
    # fields: (image, order, value, bits)
    simple = np.flatnonzero(used < 2)
    normal = np.flatnonzero(used >= 2)
    fields = _opening(size, kind)
    only = count[simple].argmax(1)
    fields.append((simple // 5, 10 + simple % 5 * 10_000, 1 | 1 << 2 | only << 3, np.full(len(simple), 11)))
    head = np.full(len(normal), _CL_HEAD & (1 << 32) - 1)
    fields.append((normal // 5, 10 + normal % 5 * 10_000, head, np.full(len(normal), 32)))
    fields.append((normal // 5, 11 + normal % 5 * 10_000, np.full(len(normal), _CL_HEAD >> 32), np.full(len(normal), _CL_HEAD_N - 32)))
    lane, order, value, nb = _length_fields(length[normal], normal, np.array(SIZES)[normal % 5])
    fields.append((lane // 5, 12 + lane % 5 * 10_000 + order, value, nb))
    base = 100_000
    value, nb = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64)
    for k, c in enumerate(_CHANNEL):
        symbol, lane = px[plain, c], who * 5 + k
        value |= code[lane, symbol] << nb
        nb += bits[lane, symbol]
    fields.append((who, base + 2 * (plain - start[who]), value, nb))
    lane = whose * 5
    first = bits[lane, 256 + length_of]
    place = base + 2 * (s - start[whose])
    fields.append((whose, place, code[lane, 256 + length_of] | length_more << first, first + length_n))
    first = bits[lane + 4, far_of]
    fields.append((whose, place + 1, code[lane + 4, far_of] | far_more << first, first + far_n))
    of, order, value, nb = (np.concatenate(x) for x in zip(*fields, strict=True))
    by = np.argsort(of * (base + 2 * int(size.max()) + 4) + order)
    of, value, nb = of[by], value[by].astype(U64), nb[by]
    total = np.bincount(of, nb, minlength=n).astype(np.int64)
    # every image begins with a word of its own
    last = np.searchsorted(of, np.arange(n), "right")
    value, nb = np.insert(value, last, U64(0)), np.insert(nb, last, -total % 64)
    # a filler may have more bits than a field: they are zeros, so only its place counts
    raw = _packed(value, nb).tobytes()
    out, at = [], 0
    for t in total.tolist():
        chunk = raw[at : at + (t + 7) // 8]
        at += (t + 63) // 64 * 8
        pad = b"\x00" * (len(chunk) & 1)
        out.append(b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad)
    return out


# A predictor: one tile over the image, whose mode (1 left, 2 above) is an image of one pixel.
_PREDICTOR = {2: 1 | 0 << 1 | 7 << 3 | 0 << 6 | (1 | 1 << 2 | 1 << 3) << 7 | 0b0001_0001_0001_0001 << 18, 3: 1 | 0 << 1 | 7 << 3 | 0 << 6 | (1 | 1 << 2 | 2 << 3) << 7 | 0b0001_0001_0001_0001 << 18}
_PREDICTOR_N = 34


def _opening(size: np.ndarray, kind: np.ndarray) -> list[tuple]:
    """Fields of what stands before an image's codes: signature, sides, transform, neither cache nor tiles of codes."""
    n = len(size)
    first = 0x2F | (ACROSS - 1) << 8 | (size // ACROSS - 1) << 22 | 1 << 36 | np.where(kind == 1, (1 | 2 << 1) << 40, 0)
    guessed = np.flatnonzero(kind > 1)
    return [
        (np.arange(n), np.zeros(n, np.int64), first, np.where(kind == 1, 43, 40)),
        (guessed, np.full(len(guessed), 1), np.where(kind[guessed] == 2, _PREDICTOR[2], _PREDICTOR[3]), np.full(len(guessed), _PREDICTOR_N)),
        (np.arange(n), np.full(n, 2), np.zeros(n, np.int64), np.full(n, 3)),
    ]


class NotOurs(ValueError):
    """A file that is not of the form that ``encode_many`` writes."""


class _Reader:
    """A place in each of several streams, all moved in step."""

    def __init__(self, chunks: list[bytes]):
        size = np.array([len(c) + 16 for c in chunks])
        raw = b"".join(c + bytes(16) for c in chunks)
        self.words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # eight bytes from each byte on
        self.at = (np.cumsum(size) - size) * 8
        self.end = self.at + (size - 16) * 8

    def see(self, who: np.ndarray) -> np.ndarray:
        """At least 57 bits from where these streams are."""
        return self.words[self.at[who] >> 3] >> (self.at[who] & 7).astype(U64)


def _read_lengths(r: _Reader, n: int) -> np.ndarray:
    """Lengths of the five codes of each image; a symbol alone has -1."""
    out = np.zeros((n, 5, WIDE), np.int8)
    everyone = np.arange(n)
    for k, size in enumerate(SIZES):
        v = r.see(everyone).astype(np.int64)
        simple = v & 1 == 1
        if (v[simple] & 7 != 5).any():
            raise NotOurs("two symbols given outright")
        out[everyone[simple], k, (v[simple] >> 3) & 255] = -1
        if ((v[~simple] & (1 << 32) - 1) != _CL_HEAD & (1 << 32) - 1).any():
            raise NotOurs("another code of code lengths")
        r.at += np.where(simple, 11, 32)
        who = everyone[~simple]
        if (r.see(who).astype(np.int64) & (1 << 31) - 1 != _CL_HEAD >> 32).any():
            raise NotOurs("another code of code lengths")
        r.at[who] += 31
        place = np.zeros(n, np.int64)
        while len(who):
            v = r.see(who).astype(np.int64)
            e = _CL_TABLE[v & 31]
            symbol, bits = e >> 4, e & 15
            v >>= bits
            out[who, k, np.minimum(place[who], WIDE - 1)] = np.where(symbol < 16, symbol, 0)
            long = symbol == 18
            place[who] += np.where(symbol < 16, 1, np.where(long, 11 + (v & 127), 3 + (v & 7)))
            r.at[who] += bits + np.where(symbol < 16, 0, np.where(long, 7, 3))
            who = who[place[who] < size]
        if (place > size).any():
            raise ValueError("code lengths past the alphabet")
    return out


def _tables(lengths: np.ndarray) -> np.ndarray:
    """Of each code, for each MOST bits in order of the code: symbol and bits, as one number."""
    flat = lengths.reshape(-1, WIDE).astype(np.int64)
    alone = (flat < 0).any(1)
    order = np.argsort(np.where(flat > 0, flat, 99), axis=1, kind="stable")
    n = np.take_along_axis(flat, order, 1)
    share = np.where(n > 0, 1 << (MOST - np.maximum(n, 0)), 0)
    if n.max(initial=0) > MOST:
        raise NotOurs("longer codes")
    if (share.sum(1)[~alone] != 1 << MOST).any():
        raise ValueError("a prefix code that is not complete")
    share[alone] = 0
    share[alone, 0] = 1 << MOST
    entry = order << 4 | np.maximum(n, 0)
    entry[alone, 0] = flat[alone].argmin(1) << 4
    return np.repeat(entry.astype(np.uint16).ravel(), share.ravel())


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The images of files that ``encode_many`` wrote, as (rows, ACROSS, 4) bytes."""
    chunks = []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L":
            raise NotOurs("another container")
        chunks.append(f[20 : 20 + struct.unpack_from("<I", f, 16)[0]])
    r, n = _Reader(chunks), len(files)
    everyone = np.arange(n)
    v = r.see(everyone).astype(np.int64)
    if ((v & (1 << 22) - 1 != (0x2F | (ACROSS - 1) << 8)) | (v >> 36 & 15 != 1)).any():
        raise NotOurs("another signature, width or version")
    rows = (v >> 22 & (1 << 14) - 1) + 1
    r.at += 40
    v = r.see(everyone).astype(np.int64)
    mask = (1 << _PREDICTOR_N) - 1
    kind = np.where(v & 7 == 5, 1, np.where(v & mask == _PREDICTOR[2], 2, np.where(v & mask == _PREDICTOR[3], 3, 0)))
    r.at += np.array([0, 3, _PREDICTOR_N, _PREDICTOR_N])[kind]
    if (r.see(everyone).astype(np.int64) & 7 != 0).any():
        raise NotOurs("another transform, a cache or tiles")
    r.at += 3
    table = _tables(_read_lengths(r, n))
    size = rows * ACROSS
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint32)
    word, rev, step = r.words, _REV, 1 << MOST
    p, q, o, left = r.at.copy(), start.copy(), everyone * 5 * step, size.copy()
    low = U64(step - 1)
    while len(p):
        first = word[p >> 3] >> (p & 7).astype(U64)
        e = table[o + rev[(first & low).astype(np.int64)]].astype(np.int64)
        green, bits = e >> 4, e & 15
        copies = np.flatnonzero(green >= 256)
        v = first >> bits.astype(U64)
        pixel = green << 8
        used = bits.copy()
        for k, place in ((1, 0), (2, 16), (3, 24)):
            e = table[o + k * step + rev[(v & low).astype(np.int64)]].astype(np.int64)
            n_bits = e & 15
            v >>= n_bits.astype(U64)
            used += n_bits
            pixel |= (e >> 4) << place
        out[q] = pixel & 0xFFFFFFFF
        took = np.ones(len(p), np.int64)
        if len(copies):
            v = (first[copies] >> bits[copies].astype(U64)).astype(np.int64)
            length, extra = _value(green[copies] - 256, v)
            v >>= extra
            e = table[o[copies] + 4 * step + rev[v & step - 1]].astype(np.int64)
            v >>= e & 15
            far, more = _value(e >> 4, v)
            used[copies] = bits[copies] + extra + (e & 15) + more
            if ((far > 2) & (far < 121)).any():
                raise NotOurs("a distance by place")
            far = np.where(far == 1, ACROSS, np.where(far == 2, 1, far - 120))
            took[copies] = length
            if (length > left[copies]).any() or (far > q[copies] - (start[o[copies] // (5 * step)])).any():
                raise ValueError("a back-reference beyond the image")
            for a, m, d in zip(q[copies].tolist(), length.tolist(), far.tolist(), strict=True):
                out[a : a + m] = out[a - d : a - d + m] if d >= m else np.resize(out[a - d : a], m)
        p, q, left = p + used, q + took, left - took
        if (left <= 0).any():
            keep = left > 0
            p, q, o, left = p[keep], q[keep], o[keep], left[keep]
    px = out.view(np.uint8).reshape(-1, 4)
    return [_undo(px[a : a + m].copy() if k else px[a : a + m], k).reshape(-1, ACROSS, 4) for a, m, k in zip(start.tolist(), size.tolist(), kind.tolist(), strict=True)]


def _value(prefix: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value of a length or distance prefix, its extra bits) with the bits that follow it."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + (v & ((1 << extra) - 1)) + 1), extra
