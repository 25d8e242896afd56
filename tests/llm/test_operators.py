"""Small brute-force tests of the operators that have none of their own file."""

from __future__ import annotations

import gc
import hashlib
import os
import random
import re
import time
import tracemalloc
import weakref
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(seed, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omikron pi rho sigma tau".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "word"), (904, "é" * 3000), (905, "x " * 4000), (906, "!?"), (None, "a null id")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_simhash_groups(spark):
    from gnomon.llm.simhash import simhash_groups

    base = [(k, sentences(k, 60)) for k in range(12)]
    near = [(100 + k, t + " omega") for k, t in base] + [(200, base[0][1]), (201, base[0][1])]
    rows = base + near + ODD
    got = {r.doc_id: r for r in simhash_groups(frame(spark, rows)).collect()}
    fp = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = [i for i in fp if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for i in ids:
        assert got[i].fingerprint == f"{fp[i]:016x}" and got[i].component_id == find(i)
    assert len(got) == len(rows)
    assert simhash_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_close_lanes(radius):
    from gnomon.llm.simhash import close_lanes

    r = np.random.default_rng(radius)
    fp = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    for k in range(1, 150, 2):
        fp[k] = fp[k - 1] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)))
    end = np.where(np.arange(150) < 90, 90, 150)
    found = set()
    for shift in (0, 64, 128):
        found |= set(zip(*(x.tolist() for x in close_lanes(fp, end, shift, radius)), strict=True))
    assert found == {(i, j) for i in range(150) for j in range(i + 1, end[i]) if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius}


def test_near_duplicates(spark):
    from gnomon.llm.simhash import near_duplicates

    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(6):
        t = sentences(k, 300, vocabulary).split()
        rows.append((10 * k, " ".join(t)))
        rows.append((10 * k + 1, " ".join(t)))
        t[5] = "changed"
        rows.append((10 * k + 2, " ".join(t)))
        rows.append((10 * k + 3, " ".join(x if n % 9 else "other" for n, x in enumerate(t))))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows + ODD)).collect()}
    for k in range(6):
        assert got[10 * k + 1] == got[10 * k + 2] == 10 * k and got[10 * k + 3] == 10 * k + 3
    assert got[900] == 900 and got[901] == 901


def test_language(spark):
    from gnomon.llm.langid import identify, train

    words = {"aa": "der die das und nicht auch wird".split(), "bb": "the and this that with have been".split()}
    rows = [(k, sentences(k, 40, words[l]), l, "s", 1) for k in range(80) for l in [("aa", "bb")[k % 2]]]
    df = frame(spark, rows, SCHEMA)
    filters = train(df)
    got = {r.doc_id: r for r in identify(frame(spark, [(1, sentences(1, 30, words["aa"])), (2, sentences(2, 30, words["bb"])), (3, "\U0001F600" * 60), *ODD]), filters).collect()}
    assert got[1].lang_pred == "aa" and got[2].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert got[900].lang_pred == got[901].lang_pred == got[906].lang_pred == got[3].lang_pred == "und" and len(got) == len(ODD) + 3
    assert train(frame(spark, [], SCHEMA)).languages == ["und"]


def test_packing(spark):
    from tokenizers import Tokenizer

    from gnomon.llm.packing import default_path, pack

    rows = [(k, sentences(k, 7 * k % 400)) for k in range(40)] + ODD
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], np.uint32) for i, x in rows}
    got = [r for r in pack(frame(spark, rows), size=64, windows=3, fan=2).collect()]
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes()) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0
    assert pack(frame(spark, [])).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    from gnomon.llm.bitpack import default_path, read_ids, write_ids

    rows = [(3 * k, sentences(k, 5 * k)) for k in range(30)] + ODD
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    got = read_ids(write_ids(frame(spark, rows), file_ids=500)).collect()
    at = 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], np.uint32)
        (r,) = [r for r in got if r.doc_id == i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert read_ids(write_ids(frame(spark, []))).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 25])
def test_bit_file(width):
    from gnomon.llm.bitpack import File, encode_file

    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    f = File(encode_file(ids, np.array([10, 10, 700, 1000]), width, block=64))
    assert (f.ids() == ids).all() and (f.document(2) == ids[10:700]).all() and not len(f.document(1))
    assert all((f.ids(a, a + 70) == ids[a : a + 70]).all() for a in range(0, 1000, 33))


def test_pieces_are_whole_encodings():
    from tokenizers import Tokenizer

    from gnomon.llm import bitpack, packing
    from gnomon.llm.tokens import Encoder

    r = random.Random(4)
    texts = ["".join(r.choice("abcéÉ 's,.\n !²œ́1A日\t<|>ŀ") for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a<|endoftext|> b", "it's  we'll\n\nx", None]
    for path in (bitpack.default_path(), packing.default_path()):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        flat, n = Encoder(path, remembered=50).ids(texts)
        edge = np.concatenate([[0], np.cumsum(n)])
        assert all(flat[edge[k] : edge[k + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(texts))


def test_workers_let_pieces_go():
    from gnomon.llm import packing
    from gnomon.llm.common import release
    from gnomon.llm.tokens import encoder

    path = packing.default_path()
    held = weakref.ref(encoder(path))
    held().ids(["some pieces of a text"])
    release()  # as tasks of other operators begin
    gc.collect()
    assert held() is None
    one = encoder(path)
    release(path)  # as its own do
    assert encoder(path) is one


def test_word_hashes_in_bounded_memory(monkeypatch):
    from gnomon.llm import common

    def hashed(text):
        data = np.frombuffer(text, np.uint8)
        start, end, _ = common.words(data, np.array([0, len(data)]))
        tracemalloc.start()
        got = common.word_hashes(data, start, end)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    text = (sentences(3, 5000) + " " + "long" * 3000 + "\n").encode() * 60
    common._powers.clear()
    whole, most = hashed(text)
    assert len(text) > 2_000_000 and most < 12 * len(text), most
    same: dict = {}
    for w, h in zip(text.split(), whole.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    for piece in (1, 7, 100, 1 << 30):
        monkeypatch.setattr(common, "PIECE", piece)
        part = text[: 1 + text.index(b"\n")]
        assert (hashed(part)[0] == whole[: len(part.split())]).all()
    assert not len(hashed(b"")[0]) and not len(hashed(b" ")[0])


@pytest.mark.parametrize("limit", [10_000_000, 2000])
def test_contamination(spark, limit):
    from gnomon.llm.decontam import contamination

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(k, sentences(k, 25)) for k in range(12)] + [(50, "Unique-short item"), (51, None), (52, "...")]
    docs = [(k, sentences(100 + k, 50) + " " + items[k % 12][1].upper() + ". " + sentences(200 + k, k * 30)) for k in range(15)] + [(70, "a unique short ITEM here"), (71, sentences(7, 20))] + ODD
    want = {}
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for n, x in items:
            q = split(x)
            for win in [q[k : k + 13] for k in range(max(1, len(q) - 12))] if q else []:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        names.add(str(n))
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), limit=limit).collect()}
    assert got == want and sum(w[4] for w in want.values()) > 5


def test_contamination_of_odd_tables(spark):
    """A null item id counts and is not named; ids that repeat are one item; columns with clashing names are left alone."""
    from gnomon.llm.decontam import contamination

    q = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = frame(spark, [(None, q, 1), (7, "short item", 2), (7, "short item", 3), (8, None, 4)], "item_id long, text string, row int")
    rows = [(1, q + " more"), (1, "a short item"), (None, q), (2, None), (3, "x " * 30_000 + q), (4, "")]
    docs = frame(spark, rows).select("*", F.lit("z").alias("shard"), F.lit(1).alias("row"), F.lit(2).alias("hits"), F.lit(3).alias("terms_0"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256 == hashlib.sha256(b"7").hexdigest(), r.contaminated) for r in contamination(docs, items).collect())
    assert got == [(0, 13, 13, 1, False, True), (1, 3, 2, 1, True, True), (1, 14, 13, 1, False, True), (2, 0, 0, 0, False, False), (3, 30_013, 13, 1, False, False), (4, 0, 0, 0, False, False)]
    none = frame(spark, [], "item_id long, text string")
    assert contamination(frame(spark, []), items).count() == 0 and {r.n_hit for r in contamination(docs, none).collect()} == {0}


def test_more_languages_than_a_word_has_bits(spark):
    from gnomon.llm.langid import identify, train

    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    speech = [["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(40)] for _ in range(70)]
    rows = [(k, " ".join(r.choices(speech[k % 70], k=25)), f"l{k % 70:02d}") for k in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    filters = train(docs)
    assert len(filters.languages) == 70 and len(filters.tables) == 2
    got = {x.doc_id: x.lang_pred for x in identify(docs.drop("lang"), filters).collect()}
    assert np.mean([got[k] == lang for k, _, lang in rows]) > 0.98


def test_conflicting_labels(spark):
    """Of several labels of a document the lowest counts, whatever their order."""
    from gnomon.llm.quality import train

    rows = [(k, sentences(k, 60)) for k in range(80)]
    labels = [(k, k % 2, 0) for k in range(80)]
    more = [(k, 1, 0) for k in range(0, 80, 2)]
    docs = frame(spark, rows)
    a, b = (train(docs, frame(spark, x, "doc_id long, quality int, toxic int")) for x in (labels + more, more[::-1] + labels[::-1]))
    assert a.pairs == b.pairs == train(docs, frame(spark, labels, "doc_id long, quality int, toxic int")).pairs


def test_proximity(spark):
    from gnomon.llm.decontam import proximity

    got = {r.doc_id for r in proximity(frame(spark, [(1, "red x x blue"), (2, "blue x red"), (3, "red x x x x blue"), (4, None)]), "Red blue", 4).collect()}
    assert got == {1, 2}


def test_quality(spark):
    from gnomon.llm.quality import score, train

    good = [(k, sentences(k, 80)) for k in range(0, 200, 2)]
    bad = [(k, "!!! ".join(sentences(k, 60).upper().split())) for k in range(1, 200, 2)]
    labels = [(i, int(i % 2 == 0), 0) for i, _ in good + bad]
    docs = frame(spark, good + bad + ODD)
    got = {r.doc_id: r.score for r in score(docs, train(docs, frame(spark, labels, "doc_id long, quality int, toxic int"))).collect()}
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 0) for i in held]) > 0.95 and all(0 <= s <= 1 for s in got.values()) and len(got) == 208


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, accept them.</div>
<article><h1>A title</h1><p>First, a <b>bo</b>ld&nbsp;para &amp; more, long enough to count.<br>Line two.<p>Second, para; unclosed.<ul><li>one, item<li>two</ul><form>Sign up, now</form></article>
<section id=comments><p>Nice post, thanks, really.</p></section><footer>F, f.</footer><script>var t="</p>";</script></body></html>"""


def test_main_text(spark):
    from gnomon.llm.html import main_text

    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "<nav>x</nav>"), (5, "u", "just text, no tags"), (6, "u", "<p>a < b<p" * 50)]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A title First, a bold para & more, long enough to count. Line two. Second, para; unclosed. one, item two"
    assert got[2].text == got[3].text == got[4].text == "" and got[5].text == "just text, no tags" and all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_attribute_names():
    """Only whole attribute names count, not their endings and not text inside other values."""
    from gnomon.llm.html import extract

    body = "<p>A first sentence, with commas, of the article.</p><p>A second one, no shorter.</p>"
    assert extract(f"<body><div data-id='menu'><section title='see id=search'>{body}</section></div><div id='menu'>Home, about.</div></body>") == "A first sentence, with commas, of the article. A second one, no shorter."


def test_main_text_beside_the_text_element():
    """Headline and lead beside the element with the text, a short second article, and lists of links in an article stay."""
    from gnomon.llm.html import extract

    texts = [f"Paragraph {k} of the text, which goes on for a while, with commas, and ends here." for k in range(10)]
    body = "".join(f"<p>{t}</p>" for t in texts)
    links = [f"Source {k} &amp; more" for k in range(4)]
    refs = "<ul>" + "".join(f"<li><a href=/{k}>  {x}  </a></li>" for k, x in enumerate(links)) + "</ul>"
    plain = " ".join(x.replace("&amp;", "&") for x in links)
    menu = "<nav><a href=/>Home</a></nav>"
    whole = " ".join(texts)
    head = "<h1>A headline</h1><p class=lead>The lead.</p>"
    assert extract(f"<body>{menu}<div id=content>{head}<div class=text>{body}</div></div></body>") == "A headline The lead. " + whole
    assert extract(f"<body>{menu}<div id=content>{head}<div><div class=text>{body}</div></div></div></body>") == "A headline The lead. " + whole
    assert extract(f"<body>{menu}<article>{body}</article><article><p>A second, short article.</p></article></body>") == whole + " A second, short article."
    assert extract(f"<body>{menu}<article>{body}{refs}</article></body>") == whole + " " + plain
    assert extract(f"<body><div>{refs}</div><div class=text>{body}{refs}</div></body>") == whole + " " + plain
    assert extract(f"<body><main><h1>A headline</h1><article>{body}</article></main></body>") == "A headline " + whole


def test_linked_length():
    """Of links the decoded text counts, as of the block."""
    from gnomon.llm.html import Page

    (n,) = Page("<p>Some words <a href=/>&amp;&amp;&amp;&nbsp; \n\n &amp;</a></p>").nodes
    assert (n.text, n.linked) == ("Some words &&& &", 5)


def labelled_pages():
    """(page, its main text): articles of several shapes among menus, adverts and footers, most of them without a telling name."""
    r = random.Random(8)
    say = lambda k: " ".join(f"{w}{',' if r.random() < 0.1 else ''}" for w in sentences(r.randrange(10**6), k).replace(".", "").split()) + "."
    for k in range(60):
        paragraphs = [say(r.randint(20, 90)) for _ in range(r.randint(3, 9))]
        title, item, menu = say(6)[:-1], [say(3) for _ in range(3)], [say(1)[:-1] for _ in range(8)]
        inner = [f"<h1>{title}</h1>", *(f"<p>{p}</p>" for p in paragraphs)]
        inner.insert(2, "<ul>" + "".join(f"<li>{x}" for x in item) + "</ul>")
        text = " ".join([title, paragraphs[0], *item, *paragraphs[1:]])
        bar = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in menu)
        top = [f"<ul>{bar}</ul>", f"<nav><ul>{bar}</ul></nav>", f"<div><div>{'</div><div>'.join(menu)}</div></div>"][k % 3]
        hold = [("<article>", "</article>"), ("<div class=c7>", "</div>"), ("<main><div><div>", "</div></div></main>"), ("<table><tr><td>", "</table>")][k % 4]
        foot = ["<footer>F 2024</footer>", "<div class=b2><span>F 2024</span></div>", "<div><ul>" + bar + "</ul></div>"][k // 2 % 3]
        ad = f"<div class=x{k}>Buy {menu[0]}</div>"
        said = f"<section id=comments><p>{say(40)}</p><p>{say(30)}</p></section>" if k % 5 == 0 else ""
        yield f"<html><body>{top}{ad}{hold[0]}{''.join(inner)}{hold[1]}{said}{foot}</body></html>", text


def test_main_text_of_labelled_pages():
    from collections import Counter

    from gnomon.llm.html import extract

    kept = wanted = both = 0
    for page, text in labelled_pages():
        got, want = Counter(extract(page).split()), Counter(text.split())
        kept, wanted, both = kept + got.total(), wanted + want.total(), both + (got & want).total()
    assert both / kept > 0.97 and both / wanted > 0.99


def test_ratios_decide_what_is_content(monkeypatch):
    """With ratios that say nothing, the text of many pages is another one."""
    from gnomon.llm import html

    pages = [p for p, _ in labelled_pages()]
    right = [html.extract(p) for p in pages]
    monkeypatch.setattr(html, "fused_ratios", lambda paths, *_: np.ones(len(paths)))
    assert sum(a != b for a, b in zip(right, map(html.extract, pages), strict=True)) >= len(pages) // 3


@pytest.mark.parametrize("page", ["<div>a, b." * 20_000, "<div>" * 20_000 + "<p>one, two.</p>" + "</b></p></div>" * 20_000, "<ul><li>a, b" * 8_000, "<p>a<div>" * 10_000, "<div><p>" * 5_000 + "</table></td>x" * 5_000])
def test_main_text_takes_linear_time(page):
    import time

    from gnomon.llm.html import extract

    start = time.process_time()
    extract(page)
    assert time.process_time() - start < 1.5


def test_main_text_odd_tables(spark):
    from gnomon.llm.html import main_text

    schema = "page_id long, url string, html string, text string, n_chars string"
    assert main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, "<p>One, two.</p>", "x", "y"), (3, "u", "<p>One, two.</p>", "x", "y"), (3, "u", "<p>One, two.</p>", "x", "y"), (4, "u", "<p>" + "long, text. " * 100_000 + "</p>", None, None)]
    got = sorted(((r.page_id or 0), len(r.text), r.n_chars) for r in main_text(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 9, 9), (3, 9, 9), (3, 9, 9), (4, 1_199_999, 1_199_999)]


def test_quality_learns_whole_texts(spark):
    """Texts of either class open alike for 9,000 bytes and differ only after that."""
    from gnomon.llm.quality import score, train

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    opening, kinds = " ".join(word() for _ in range(1125)), [[word() for _ in range(150)] for _ in range(2)]
    rows = [(k, opening + " " + sentences(k, 400, kinds[k % 2])) for k in range(240)]
    docs, labels = frame(spark, rows), frame(spark, [(k, k % 2, 0) for k, _ in rows], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in score(docs, train(docs, labels)).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 2 == 1) for k in held]) > 0.95
    # the sample is of whole rows: with room for none of them there is nothing to tell texts by
    blind = train(docs, labels, sample_bytes=100)
    assert all(not d for pair in blind.pairs for d in pair) and train(docs, labels).pairs == train(docs, labels).pairs


def test_language_filters_hold_every_ngram(spark):
    """No n-gram of the sample is missing in its filter, tables have room for the language with most, and predictions are those of exact sets."""
    from gnomon.llm import langid

    r = random.Random(6)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "абвгдежз", "dd": "一二三四五六七八九十"}
    word = lambda k: "".join(r.choice(letters[k]) for _ in range(r.randrange(2, 8)))
    vocabulary = {k: [word(k) for _ in range(400)] for k in letters}
    rows = [(n, " ".join(r.choice(vocabulary[k]) for _ in range(r.randrange(3, 60))), k) for n, k in enumerate(r.choice(list(letters)) for _ in range(600))]
    rows += [(900, "shared words", "aa"), (901, None, "bb"), (902, "", "cc"), (903, "x" * 1_000_000, "aa"), (904, "abc", None), (1, "abcd", "aa"), (None, "hgfe", "aa")]
    docs = spark.createDataFrame([(*x, "s", 0.5) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    filters = langid.train(docs)
    learn = [x for x in rows if x[2] and x[1] is not None and (x[0] is None or zlib.crc32(str(x[0]).encode()) % 5)]
    sets = {k: set(langid.grams([t for _, t, lang in learn if lang == k])[0].tolist()) for k in letters}
    for bit, k in enumerate(filters.languages):
        h = np.array(sorted(sets[k]), np.uint64)
        assert (filters._bit(filters.hits(h, filters.tables[0]), bit) == 1).all()
    assert filters.size == langid.room(max(map(len, sets.values()))) and langid.room(1 << 20) == 1 << 24 and filters.chance.max() < 0.02
    got = langid.identify(docs, filters).collect()
    assert len(got) == len(rows)
    wrong = 0
    for i, t, _ in rows:
        hits = {k: sum(h in s for h in langid.grams([t or ""])[0].tolist()) for k, s in sets.items()} if len(t or "") < 9999 else {"aa": 1}
        best = max(sorted(hits), key=hits.get) if any(map(str.isalpha, t or "")) else "und"
        wrong += not any(x.doc_id == i and x.lang_pred == best for x in got)
    assert wrong <= 6  # false positives of the filters, in texts of a few n-grams


def test_quality_is_the_difference_of_sizes(spark):
    """Scores are the calibrated differences of sizes that plain compression with the model's dictionaries gives."""
    import zstandard

    from gnomon.llm.quality import LEVEL, score, train

    rows = [(k, sentences(k, 60) if k % 2 else "!!! ".join(sentences(k, 60).upper().split())) for k in range(120)]
    docs = frame(spark, rows + ODD)
    model = train(docs, frame(spark, [(k, k % 2, 0) for k, _ in rows] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    sizes = []
    for _, t in rows + ODD:
        raw = (t or "").encode()
        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for pair in model.pairs for d in pair]
        sizes.append([len(raw), *(len(c.compress(raw)) for c in made)])
    got = sorted((r.doc_id, r.score) for r in score(docs, model).collect() if r.doc_id is not None)
    want = sorted((i, float(x)) for (i, _), x in zip(rows + ODD, model.score(np.array(sizes)), strict=True) if i is not None)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
    assert score(frame(spark, []), model).count() == 0 and all(x == x for _, x in got)
    same = np.array([[1000, *([400] * 2 * len(model.pairs))], [1000, *([300] * 2 * len(model.pairs))]])
    assert np.allclose(*model.score(same))  # without a difference, how well a text compresses says nothing


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    body = lambda k: sentences(k, 120, words)
    passage = sentences(77, 60, words)
    rows = [(k, body(k), "en", "s", 1) for k in range(1, 40)] + [(50, body(1), "en", "s", 1), (51, body(60) + " " + passage, "en", "s", 1), (52, body(61) + " " + passage, "en", "s", 1), (53, "12 34", "en", "s", 1), (54, None, None, "s", 1)]
    docs = frame(spark, rows, SCHEMA)
    a = p.language(spark, docs, "")
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == {r[0] for r in rows} - {53, 54}
    b = p.near_duplicate(spark, a, "")
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == {r[0] for r in rows} - {50, 53, 54}
    c = {r.doc_id: r for r in p.substring(spark, b, "").collect()}
    assert c[51].text.endswith(passage) and not c[52].text.endswith(passage) and c[52].n_chars == len(c[52].text) and c[1].text == body(1)


def test_stages_with_repeated_ids_and_clashing_names(spark):
    """Each row keeps its own columns; of rows alike in doc_id and text one stays; names of the stages' own do not clash."""
    import corpus_pipeline as p

    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    a, b, c = (sentences(k, 120, words) for k in (301, 302, 303))
    rows = [(1, a, "x1"), (1, b, "x2"), (2, b + " more", "x3"), (1, a, "x1"), (3, a + " end", "x4"), (3, c, "x5"), (None, a, "x6"), (4, None, "x7")]
    docs = frame(spark, rows, "doc_id long, text string, kept string").select("*", F.lit(1).alias("text_key"), F.lit(2).alias("found_id"), F.lit(3).alias("node"), F.lit(4).alias("_kept"), F.lit(5).alias("_id"), F.lit("en").alias("LANG"))
    near = p.near_duplicate(spark, docs, "")
    assert near.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept) for r in near.collect()) == [(0, "x6"), (1, "x1"), (1, "x2"), (3, "x5"), (4, "x7")]
    cut = p.substring(spark, docs, "")
    assert cut.columns == docs.columns
    got = sorted((r.doc_id or 0, r.kept, r.text or "") for r in cut.collect())
    assert got == [(0, "x6", a), (1, "x2", b), (2, "x3", "more"), (3, "x4", "end"), (3, "x5", c), (4, "x7", "")]


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    """``run`` over a small table: what each stage has to drop is gone, the rest is packed whole."""
    import corpus_pipeline as p
    import tokenizers

    from gnomon.llm.packing import default_path

    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    body = lambda k: sentences(k, 100, words)
    passage, item = sentences(900, 60, words), sentences(901, 40, words)
    rows = [(k, body(k), "en", "s", 1) for k in range(40)] + [(50, body(3) + " tail", "en", "s", 1), (51, body(60) + " " + passage, "en", "s", 1), (52, body(61) + " " + passage, "en", "s", 1), (53, "12 34", "en", "s", 1), (54, None, None, "s", 1), (55, body(62) + " " + item, "en", "s", 1)]
    frame(spark, rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {k: body(k) for k in range(40)} | {51: body(60) + " " + passage, 52: body(61)}
    encoder = tokenizers.Tokenizer.from_file(default_path())
    pieces: dict[int, list] = {}
    for r in p.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert pieces.keys() == want.keys()
    for k, text in want.items():
        n = len(encoder.encode(text, add_special_tokens=False).ids) + 1
        at = 0
        for start, length, whole in sorted(pieces[k]):
            assert start == at and whole == n
            at += length
        assert at == n


def test_language_stage_keeps_short_texts(spark):
    """A letter, or a word that the sample did not hold, is too little to reject a text; pages of unknown n-grams go."""
    import corpus_pipeline as p

    rows = [(k, sentences(k, 40), "en", "s", 1) for k in range(40)]
    short = [(100, "A.", "en", "s", 1), (101, "Qwyx", None, "s", 1), (102, "Zzyzx, vuvuzela!", None, "s", 1)]
    gone = [(110, "zqxj wvkq " * 40, None, "s", 1), (111, "1 2.", None, "s", 1), (112, "", None, "s", 1), (113, None, None, "s", 1)]
    got = p.language(spark, frame(spark, rows + short + gone, SCHEMA), "")
    assert {x.doc_id for x in got.collect()} == {x[0] for x in rows + short} and got.columns == [x.split()[0] for x in SCHEMA.split(", ")]


def test_near_duplicates_of_one_key(spark):
    """A large group of near copies beside other texts that share its key: parts of a few rows give the same groups."""
    from gnomon.llm.simhash import near_duplicates

    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [r.choice(vocabulary) for _ in range(200)]
    rows = []
    for k in range(60):  # near copies, and at each tenth a chain that leads away from them
        t = list(base)
        t[r.randrange(200)] = f"n{k}"
        rows.append((k, " ".join(t)))
    for k in range(100, 124):  # other texts with most of the passage, in pairs
        t = base[:60] + [random.Random(k // 2).choice(vocabulary) + str(k // 2) for _ in range(150)]
        rows.append((k, " ".join([*t, str(k)])))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in root):
            break
    for tile in (4, 4096):
        got = {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows + ODD), tile=tile).collect()}
        assert {i: got[i] for i in root} == root and got[904] == 904 and len(got) == len(rows + ODD)


def test_near_duplicates_leave_no_shuffle_files(spark, monkeypatch):
    """The copies of the sets that a step sends are gone before the next: else disk holds those of two steps at once."""
    from gnomon.llm import simhash
    from gnomon.sources.io import CLEAR

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    write, left = simhash.materialise, []

    def watched(df, *args, **options):
        before = files()
        out = write(df, *args, **options)
        end = time.time() + 5  # files go in the background
        while files() - before and time.time() < end:
            time.sleep(0.1)
        left.append(len(files() - before))
        return out

    monkeypatch.setattr(simhash, "materialise", watched)
    words = [f"w{k}" for k in range(4000)]
    rows = [(2 * k + n, sentences(k, 60, words) + " end" * n) for k in range(50) for n in (0, 1)]
    was = spark.conf.get(CLEAR)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in rows}
    assert len(left) >= 9 and not any(left) and spark.conf.get(CLEAR) == was


def test_near_duplicates_of_few_words(spark):
    """Short texts, most of them with one word added (similarity just 0.8): every link that brute force finds, no other."""
    from gnomon.llm.simhash import near_duplicates

    r, rows, want = random.Random(8), [], {}
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for k in range(6000):
        n = 8 if k % 4 else r.randrange(5, 40)
        t = [f"{k}w{x}" for x in range(n)]
        u = [*t, "more"] if k % 5 else [*t[:-1], "end"]
        rows += [(2 * k, " ".join(t)), (2 * k + 1, " ".join(u))]
        a, b = shingles(t), shingles(u)
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if 5 * len(a & b) >= 4 * len(a | b) else 2 * k + 1}
    assert {x.doc_id: x.component_id for x in near_duplicates(frame(spark, rows)).collect()} == want


def test_overlaps():
    from gnomon.llm import simhash

    r = np.random.default_rng(3)
    group = np.sort(r.integers(0, 5, 60))
    lab = np.concatenate([np.sort(r.integers(0, 6, n)) for n in np.bincount(group)])
    sets = [np.unique(r.integers(0, 90, r.integers(1, 40))).astype(np.uint32) for _ in group]
    want = {(i, j): n for i in range(60) for j in range(i + 1, 60) if group[i] == group[j] and lab[i] != lab[j] and (n := len(np.intersect1d(sets[i], sets[j])))}
    before = simhash.PAIRS
    try:
        for simhash.PAIRS in (7, 1 << 20):
            got = [x for part in simhash.overlaps(np.concatenate(sets), np.array([len(x) for x in sets]), group, lab) for x in zip(*(y.tolist() for y in part), strict=True)]
            assert len(got) == len(want) and {(i, j): n for i, j, n in got} == want
    finally:
        simhash.PAIRS = before


@pytest.mark.parametrize("look", [1, 3, 64])
def test_hopeful_rows(monkeypatch, look):
    """No similar pair of another group is ruled out in its first key in common."""
    from gnomon.llm import simhash

    monkeypatch.setattr(simhash, "LOOK", look)
    r = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        base = r.choice(400, r.integers(2, 60), replace=False)
        sets += [np.unique(np.where(r.random(len(base)) < p, r.integers(0, 400, len(base)), base)) for p in (0, 0.05, 0.1, 0.5)]
    rows = sorted((int(h), len(x), i, k) for i, x in enumerate(sets) for k, h in enumerate(x[: simhash.prefix_length(len(x), 0.8)]))
    key, n, node, place = (np.array(c) for c in zip(*rows, strict=True))
    kept = {(h, i) for h, i, k in zip(key.tolist(), node.tolist(), simhash.hopeful(key, node, n, place, 0.8).tolist(), strict=True) if k}
    found = 0
    for i, x in enumerate(sets):
        for j in range(i):
            both = np.intersect1d(x, sets[j])
            if 5 * len(both) >= 4 * len(np.union1d(x, sets[j])):
                found += 1
                assert {(int(both[0]), i), (int(both[0]), j)} <= kept
    assert found > 50 and (look < 64 or len(kept) < len(rows))


def test_alike_rows():
    from gnomon.llm.common import U64
    from gnomon.llm.simhash import alike, parity

    r = np.random.default_rng(7)
    sets = []
    for _ in range(80):
        base = r.integers(0, 1 << 63, r.integers(2, 600)).astype(U64)
        sets += [np.unique(base[r.random(len(base)) < p]) for p in (1, 0.9, 0.82, 0.4)]
    sets = sorted((x for x in sets if len(x)), key=len)
    n, odd = np.array([len(x) for x in sets]), [parity(x) for x in sets]
    keep = alike(np.full(len(n), len(n)), np.arange(len(n)), n, np.frombuffer(b"".join(odd), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in odd])]), 0.8)
    want = [any(i != j and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    assert sum(want) > 100 and keep[want].all() and not keep.all()


def test_rows_of_different_groups_meet(spark):
    """Rows of one key in different groups share a part; those of a large group go where the others are, not to each other."""
    from gnomon.llm.simhash import across

    labs = {n: 0 if n < 40 else 40 if n < 52 else n for n in range(70)}
    rows = [(1, n, n, 8, lab) for n, lab in labs.items()] + [(2, n, n, 8, 0) for n in range(9)] + [(3, n, n, 8, n) for n in range(3)] + [(4, n, n, 8, n % 2) for n in range(20)]
    got = across(spark.createDataFrame(rows, "key long, node long, fp long, bytes long, lab long"), 4, 1000).collect()
    met: dict = {}
    for x in got:
        met.setdefault((x.key, x.part), []).append((x.node, x.lab))
    together = {(key, a, b) for (key, _), nodes in met.items() for a, _ in nodes for b, _ in nodes}
    for key in (1, 3, 4):
        mine = [(n, lab) for k, n, _, _, lab in rows if k == key]
        assert all((key, a, b) in together for a, x in mine for b, y in mine if x != y)
    assert all(key != 2 for key, _ in met)
    copies = sum(x.key == 1 and x.lab == 0 for x in got)
    assert copies <= 40 * (5 + 3)  # five bins of single rows at most and three parts of the other large group
