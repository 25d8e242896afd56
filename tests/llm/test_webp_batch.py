from __future__ import annotations

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gnomon.llm import webp
from gnomon.llm import webp_batch as many

R = np.random.default_rng(5)
ROWS = 3 * webp.ROW


def rows(raw: bytes) -> np.ndarray:
    raw += b"\xff" * (max(1, -(-len(raw) // webp.ROW)) * webp.ROW - len(raw))
    return np.frombuffer(raw, np.uint8).reshape(-1, webp.ROW // 4, 4)


def shaded(across: int, down: int) -> np.ndarray:
    noise = R.integers(0, 4, (16, webp.ROW // 4, 4))
    return ((np.arange(16)[:, None, None] * down + np.arange(webp.ROW // 4)[None, :, None] * across + noise) & 255).astype(np.uint8)


def grey() -> np.ndarray:
    px = R.integers(0, 256, (16, webp.ROW // 4, 4), dtype=np.uint8)
    px[..., [0, 2]] = px[..., [1]]
    return px


IMAGES = {
    "empty": rows(b""), "one": rows(b"a"), "text": rows("Wörter, words and more of them. ".encode() * 40), "noise": R.integers(0, 256, (4, webp.ROW // 4, 4), dtype=np.uint8),
    "runs": rows(b"x" * 9000), "far": rows(R.bytes(1200) * 7), "lines": np.repeat(R.integers(0, 256, (1, webp.ROW // 4, 4), dtype=np.uint8), 16, 0), "left": shaded(7, 41), "grey": grey(), "skewed": rows(b"".join(bytes([k]) * (1 << min(k, 12)) for k in range(16))[:9216]),
    "above": np.cumsum(R.integers(0, 3, (16, webp.ROW // 4, 4)) + np.arange(0, webp.ROW // 4 * 4).reshape(1, -1, 4) * 61 * (np.arange(16) == 0)[:, None, None], 0).astype(np.uint8),
}


def test_both_decoders_read_what_is_written():
    """The reader of many images and the general decoder agree; an image's file does not depend on those beside it."""
    files = many.encode_many(list(IMAGES.values()))
    for (name, px), f, back in zip(IMAGES.items(), files, many.decode_many(files), strict=True):
        assert (back == px).all() and (webp.decode(f) == px).all(), name
        assert many.encode_many([px]) == [f], name
    assert all(len(f) < px.size for (name, px), f in zip(IMAGES.items(), files, strict=True) if name not in ("noise", "grey"))


def test_every_transform_is_chosen():
    flat = [x.reshape(-1, 4) for x in IMAGES.values()]
    size = np.array([len(x) for x in flat])
    kind, _ = many._choose(np.concatenate(flat), np.cumsum(size) - size, np.repeat(np.arange(len(flat)), size))
    got = dict(zip(IMAGES, kind.tolist(), strict=True))
    assert (got["text"], got["grey"], got["left"], got["above"]) == (0, 1, 2, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=ROWS), st.text(max_size=400).map(str.encode), st.tuples(st.binary(min_size=1, max_size=9), st.integers(1, 900)).map(lambda x: x[0] * x[1])), min_size=1, max_size=6))
def test_round_trip(payloads):
    px = [rows(p) for p in payloads]
    media = webp.store(px)
    assert all((a == b).all() for a, b in zip(px, webp.load(media), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=2, max_size=40), min_size=1, max_size=5))
def test_code_lengths_are_optimal(counts):
    table = np.zeros((len(counts), 40), np.int64)
    for k, c in enumerate(counts):
        table[k, : len(c)] = c
    for c, length in zip(table, many.code_lengths(table), strict=True):
        used = c[c > 0].tolist()
        assert ((length > 0) == (c > 0)).all()
        if len(used) < 2:
            continue
        assert sum(2.0 ** -int(n) for n in length if n) == 1 and length.max() <= many.MOST
        heap, cost = list(used), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        if length.max() < many.MOST:
            assert int((c * length).sum()) == cost


def test_files_of_another_writer():
    px = IMAGES["text"]
    with pytest.raises(many.NotOurs):
        many.decode_many([webp.encode(px)])
    assert (webp.load([webp.encode(px)])[0] == px).all()


def test_a_torn_file_is_refused():
    (f,) = many.encode_many([IMAGES["far"]])
    with pytest.raises((ValueError, IndexError)):
        many.decode_many([f[:16] + (24).to_bytes(4, "little") + f[20:44]])
