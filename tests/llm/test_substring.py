from __future__ import annotations

import hashlib
import re

import pytest

from gnomon.llm.substring import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


PASSAGE = " ".join(f"p{k}" for k in range(40))
ROWS = [
    (5, f"alpha beta {PASSAGE} gamma"),
    (2, f"{PASSAGE}\nend of two"),
    (9, f"x y z {PASSAGE[:60]} q"),
    (7, None), (8, ""), (1, "short"), (3, "same same " * 30), (4, "same same " * 30), (11, "é ü " * 9 + PASSAGE), (12, "same " * 13),
    (13, "a b c " * 14), (14, "a b c " * 15),
]


@pytest.mark.parametrize(("n", "chunk"), [(13, 2_000_000), (13, 200), (6, 100), (2, 300)])
def test_brute_force(spark, n, chunk):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = substring_dedup(df, min_words=n, chunk=chunk).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(ROWS, n)


def longest(rows, n):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    best = dict.fromkeys((i for i, _ in docs), 0)
    while True:
        seen = {}
        for i, w in docs:
            for k in range(len(w) - n + 1):
                seen.setdefault(tuple(w[k : k + n]), set()).add(i)
        several = [x for x in seen.values() if len(x) > 1]
        if not several:
            return best
        best.update(dict.fromkeys(set().union(*several), n))
        n *= 2


@pytest.mark.parametrize(("n", "chunk"), [(13, 2_000_000), (5, 150), (2, 400)])
def test_doubling_until_none_survives(spark, n, chunk):
    rows = [*ROWS, (20, "w " * 500), (21, "w " * 450 + "v " * 50), (22, "v " * 49 + "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.longest for r in substring_dedup(df, min_words=n, grow=True, chunk=chunk).collect()}
    assert got == longest(rows, n) and max(got.values()) >= 16 * n


def test_growth_and_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(df, grow=True, with_text=True).collect()}
    assert got[5].longest == 26 and got[5].kept == "alpha beta gamma" and got[2].longest == 26
    assert got[7].kept is None and got[8].kept == "" and got[1].longest == 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, PASSAGE, 1, 2), (4, PASSAGE, 1, 2), (4, PASSAGE, 1, 2)], "doc_id int, text string, chunk_id int, replies int")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup(odd).collect()), key=str)
    assert got == [(4, 40), (4, 40), (None, 0)]
