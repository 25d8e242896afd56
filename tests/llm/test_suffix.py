from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gnomon.llm.gsaca import suffix_array
from gnomon.llm.suffix import suffix_dedup


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, size):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen: dict = {}
    for _, b in docs:
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] = seen.get(b[k : k + size], 0) + 1
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, size):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(size)
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, "ab" * size), (6, "x" * (size + 3)), (7, base[: size + 1]), (8, text(9) + base[7 : size + 30] + text(5)), (9, base[: size - 1]), (None, text(4) + base[-size - 2 :])]
    for k in range(10, 30):  # copies with edits
        b = list(base)
        for _ in range(r.randint(1, 5)):
            b[r.randrange(len(b))] = "Z"
        rows.append((k, text(r.randint(0, 6)) + "".join(b)))
    rows.append((30, rows[-1][1] + " " + rows[-1][1]))
    return rows


@pytest.mark.parametrize(("seed", "size", "chunk"), [(1, 200, 1_000_000), (2, 100, 3000), (3, 60, 1)])
def test_brute_force(spark, seed, size, chunk):
    rows = rows_of(seed, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in suffix_dedup(df, size, chunk=chunk).collect()), key=str)
    assert got == brute(rows, size)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string, h int")).count() == 0
