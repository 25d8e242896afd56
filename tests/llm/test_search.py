"""Personal data, ranked search and hard negatives against plain versions of their rules."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "word"), (904, "é" * 3000), (905, "x " * 4000), (906, "!?"), (None, "a null id alpha"), (7, "alpha beta"), (7, "alpha beta"), (7, "alpha beta gamma")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# Personal data.

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in p.finditer(text) if ok(m[0])]
    return [(a, PLAIN[k][0], b) for a, k, b in sorted(found)]


def personal_texts():
    r = random.Random(3)
    bits = ["a", "b.c", "@", ".", "-", "+", "1", "25", "255", "256", "007", " ", "(", ")", "é", "_", "%", "4111111111111111", "4111 1111 1111 1111", "+1 (212) 555-0000", "10.0.0.1", "x@y.co", "@@", "..", "\n", "٣"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(4000)]


def test_base_spans():
    from gnomon.llm.pii import base_spans

    for t in [*personal_texts(), "a@b.co_x@d.com", "1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3.0255"]:
        assert base_spans(t) == plain_spans(t), t


def test_long_texts_take_linear_time():
    from gnomon.llm.pii import Field, base_spans

    for t in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1(" * 300_000, "a@" * 500_000, "@" * 1_000_000, "1 -" * 300_000):
        base_spans(t)
    assert Field().decode("12 x " * 40_000) == []


@pytest.fixture(scope="module")
def field():
    from gnomon.llm.pii import Field, examples

    return Field().fit(examples([]), 60)


def test_field_finds_what_patterns_miss(field):
    for text, kind, span in [
        ("call (017) 555-7713 now", "phone", "(017) 555-7713"),
        ("bob.23 [at] mail [dot] com please", "email", "bob.23 [at] mail [dot] com"),
        ("at 97[.]51[.]17[.]173 there", "ip", "97[.]51[.]17[.]173"),
        ("no 4111.1111.1111.1111 is", "card", "4111.1111.1111.1111"),
    ]:
        assert [(k, text[a:b]) for a, k, b in field.decode(text)] == [(kind, span)]
    for text in ("version 3.0.1 of 2024-05-17 at 12:30", "4111 1111 1111 1112", "it is 5 at 7 (at) home", "token = d6c7987c5f8c48d1caa1fa8c19a4b9123f", ""):
        assert field.decode(text) == []


def test_field_keeps_off_covered(field):
    text = "call (017) 555-7713 now"
    assert field.decode(text, [(5, 9)]) == [] or all(a >= 9 for a, _, _ in field.decode(text, [(5, 9)]))


def segmentations(n, spans):
    """All sets of spans of [0, n) that do not overlap, in order."""
    if n <= 0:
        yield []
        return
    yield from segmentations(n - 1, spans)
    for i, j in spans:
        if j == n:
            for rest in segmentations(i, spans):
                for kind in range(4):
                    yield [*rest, (i, j, kind)]


def test_decode_and_learning_against_all_segmentations():
    """The best segmentation and the expected counts are those of enumerating every one."""
    from gnomon.llm.pii import _FEATURES, KINDS, Field, Tokens, _grouped

    r = np.random.default_rng(5)
    for text in ("1-2 @b", "(3).4 5", "a@b.c1", "+1 2 3"):
        t = Tokens(text)
        i, j = t.candidates(0, t.n)
        x = t.features(i, j)
        f = Field(r.normal(0, 1, (len(_FEATURES), 4)) / 2, r.normal(0, 1, (4, 4)))
        at = {(a, b): k for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True))}
        score = x @ f.weights

        def value(seg, score=score, at=at, f=f):
            return sum(score[at[a, b], k] for a, b, k in seg) + sum(f.follow[p[2], q[2]] for p, q in itertools.pairwise(seg) if p[1] == q[0])

        every = list(segmentations(t.n, list(at)))
        top = max(every, key=value)
        got = f.decode(text)
        assert value([(t.start.tolist().index(a), t.end.tolist().index(b) + 1, KINDS.index(k)) for a, k, b in got]) == pytest.approx(value(top))
        weight = np.exp([value(s) for s in every])
        weight /= weight.sum()
        features, pairs = np.zeros_like(f.weights), np.zeros((4, 4))
        for s, w in zip(every, weight, strict=True):
            for a, b, k in s:
                features[:, k] += w * x[at[a, b]]
            for p, q in itertools.pairwise(s):
                pairs[p[2], q[2]] += w * (p[1] == q[0])
        places = np.stack([np.zeros(len(i), np.int64), i, j], 1)
        expected, met = f._expected(places, x, 1, *(_grouped(places, side, int(j.max()) + 1) for side in (1, 2)))
        np.testing.assert_allclose(expected, features, atol=1e-6)
        np.testing.assert_allclose(met, pairs, atol=1e-6)


def test_find(spark, field):
    from gnomon.llm.pii import find, train

    texts = personal_texts()[:300] + ["1 " * 200_000 + "mail a@b.de"]
    rows = [*enumerate(texts), *ODD]
    docs = frame(spark, [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, spans int, n_email string")
    got = find(docs, field).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        spans = plain_spans(t or "")
        want.setdefault(i, []).append((hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest(), *(sum(k == x for _, k, _ in spans) for x in ("email", "ip", "card", "phone"))))
    for r in got:
        assert (r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) in want[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [s for s in spans if s] == sorted(spans, key=lambda s: (int(s[1]), ["email", "ip", "card", "phone"].index(s[0]), int(s[2])))
        assert len(spans) == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone
    empty = frame(spark, [])
    assert find(empty, train(empty, turns=2)).count() == 0


# Ranked search.

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_ranking(docs, items, keep=10):
    bags = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df: dict = {}
    for _, b in bags:
        for x in set(b):
            df[x] = df.get(x, 0) + 1
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, want in asked.items():
        scored = []
        for d, b in bags:
            if b:
                m = 10 + 90 * len(b) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * b.count(x) // (1000 * b.count(x) + 8 * m)) for x in want & set(b))
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:keep])]
    return sorted(out, key=str)


def corpus(seed, n, most=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Alpha", "béta", "gAMMA"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(k, r.choice([" ", "-", "\n"]).join(r.choices(words, weights, k=r.randrange(most)))) for k in range(n)]


@pytest.mark.parametrize("shard", [400, 16_000_000])
def test_ranked(spark, monkeypatch, shard):
    from gnomon.llm import ranked

    docs = corpus(1, 300) + ODD + [(400, "w1 " * 5000 + "w39"), *((500 + k, "w38 alpha") for k in range(40))]
    items = [(k, t) for k, t in corpus(2, 25, 12)] + [(3, "w39 w38"), (None, "alpha"), (None, "w7"), (60, None), (61, ""), (62, "absent"), (63, "W38")]
    build = ranked.build_index
    monkeypatch.setattr(ranked, "build_index", lambda d: build(d, shard))
    monkeypatch.setattr(ranked, "FIRST", 16)
    monkeypatch.setattr(ranked, "STEP", 32)
    found = ranked.ranked(frame(spark, [(i, t, 5) for i, t in docs], "doc_id long, text string, score int"), frame(spark, [(i, t, "x") for i, t in items], "item_id long, text string, rank string"), limit=200)
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect()), key=str) == plain_ranking(docs, items)
    assert ranked.ranked(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0
    assert ranked.ranked(frame(spark, docs), frame(spark, [], "item_id string, text string")).count() == 0


def test_bounds_spare_postings():
    """With bounds fewer postings are looked at, and the result is that of looking at all."""
    from gnomon.llm import ranked
    from gnomon.llm.decontam import term_hashes, text_terms

    docs = corpus(9, 6000)
    raw = [t.encode() for _, t in docs]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, first = term_hashes(data, offsets)
    n = np.diff(first)
    row = dict(zip((f"{x}_{k}" for k in range(ranked.BUCKETS) for x in ranked._PARTS), ranked._postings(h, n), strict=True)) | {"doc_ids": np.arange(len(docs)).tobytes(), "sizes": n.astype(np.uint32).tobytes()}
    vocabulary = np.unique(h)
    df = np.array([len({d for d in np.searchsorted(first, np.flatnonzero(h == t), "right") - 1}) for t in vocabulary])
    weights = np.floor(1000 * np.log((2 * (n > 0).sum() + 2) / (2 * df + 1))).astype(np.int64)
    shard = ranked.Shard(row, list(range(ranked.BUCKETS)), vocabulary, weights, int((n > 0).sum()), int(n.sum()))
    item = np.searchsorted(vocabulary, np.unique(text_terms("w0 w1 w2 w35 w36")))
    fast, slow = ranked.Best(10), ranked.Best(10)
    few, all_ = shard.search(item, fast), shard.search(item, slow, prune=False)
    assert few < all_ / 2 and fast.ids.tolist() == slow.ids.tolist() and fast.scores.tolist() == slow.scores.tolist()


def test_long_text_in_pieces(monkeypatch):
    from gnomon.llm import ranked
    from gnomon.llm.decontam import text_terms

    monkeypatch.setattr(ranked, "PIECE", 50)
    text = " ".join(f"Wörd{k}" for k in range(300)) + "x" * 300 + " end"
    assert np.concatenate(list(ranked._hashes(np.frombuffer(text.encode(), np.uint8)))).tolist() == text_terms(text).tolist()


# Hard negatives.


def plain_negatives(rows, keep=5, low=80):
    rows = [(k, *r) for k, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, i, label, v in rows:
        if i is None or i % 10:
            continue
        scored = [(int(sum(int(a) * int(b) for a, b in zip(v, w, strict=False))), j, y) for q, j, y, w in rows if q != k]
        for s, p, _ in sorted((x for x in scored if x[2] == label), key=order)[:keep]:
            near = sorted((x for x in scored if x[2] != label and low * s <= 100 * x[0] <= 100 * s), key=order)[:keep]
            out += [(i, p, r + 1, n, s, t) for r, (t, n, _) in enumerate(near)]
    return sorted(out, key=str)


def vectors(seed, n, dim, size=60, clusters=0):
    r = np.random.default_rng(seed)
    centre = r.integers(-size, size, (max(1, clusters), dim)) * bool(clusters)
    return [(k, int(r.integers(4)), [float(x) for x in centre[k % max(1, clusters)] + r.integers(-size // 4, size // 4 + 1, dim)]) for k in range(n)]


@pytest.mark.parametrize("kind", ["round", "clusters", "odd", "huge", "zero"])
def test_hard_negatives(spark, monkeypatch, kind):
    from gnomon.llm import hardneg

    monkeypatch.setattr(hardneg, "BLOCK", 16)
    monkeypatch.setattr(hardneg, "TILE", 4)
    rows = {"round": vectors(1, 200, 5), "clusters": vectors(2, 200, 6, 200, 8), "huge": vectors(3, 60, 3, 2_000_000_000 // 3), "zero": [(k, k % 2, [0.0, 0.0]) for k in range(30)], "odd": vectors(4, 80, 4)}[kind]
    if kind == "odd":
        rows += [(k, 1, [9.0, 9.0, 9.0, 9.0]) for k in range(200, 260)] + [(10, 2, [5.0, 5.0, 5.0, 5.0]), (10, 2, [5.0, 5.0, 5.0, 5.0]), (None, 1, [8.0, 8.0]), (None, 3, [9.0, 9.0, 9.0, 8.0]), (20, None, [1.0]), (30, 1, None), (40, 1, [float("nan")]), (40, 1, [float("inf")]), (40, 1, [None, 1.0]), (50, 2, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "id long, label long, vector array<double>, score int").repartition(3)
    want = plain_negatives(rows)
    for limit in (200, 1 << 30):
        got = hardneg.hard_negatives(table, F.col("id") % 10 == 0, limit=limit)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert want or kind == "huge"
    assert hardneg.hard_negatives(table.limit(0), F.col("id") % 10 == 0).count() == 0


def test_pivots_spare_scores():
    """In a table with near rows most pairs fall to the brackets, and none that counts."""
    from gnomon.llm import hardneg

    rows = vectors(6, 4000, 16, 400, 40)
    v = np.array([r[2] for r in rows])
    norms = (v * v).sum(1)
    space = hardneg.Space(float(norms.max()), 16, float(np.abs(v).max()))
    space.choose(v[:512])
    order = np.lexsort((space.of_rows(v).min(1), space.of_rows(v).argmin(1)))
    picked = list(range(0, len(v), 100))
    table = []
    for a in range(0, len(v), 250):
        w = v[order[a : a + 250]]
        d = space.of_rows(w).astype(np.float32)
        flags = np.arange(a, a + len(w)) % 100 == 0
        table.append({"block": a, "ids": np.arange(a, a + len(w)).tobytes(), "labels": np.zeros(len(w), np.int64).tobytes(), "anchors": flags.tobytes(), "vectors": w.astype(space.kind).tobytes(), "distances": d.T.copy().tobytes(), "nearest": d.min(0).tobytes(), "farthest": d.max(0).tobytes()})
    anchors = hardneg.Anchors([r for row in table for r in hardneg._in_block(space, row, 5)], space).ready(space)
    best = hardneg.Best(len(picked), 5, anchors.floors)
    scored = sum(hardneg._positives(space, anchors, hardneg.Block(row, space), best) for row in table)
    assert anchors.keys.tolist() == picked and scored < 0.5 * len(v) * len(picked)
    exact = v[order[picked]] @ v[order].T
    exact[np.arange(len(picked)), picked] = -np.inf
    for g in range(len(picked)):
        assert sorted(best.score[best.group == g].tolist()) == sorted(np.sort(exact[g])[-5:].astype(int).tolist())
