"""What is read from the web: addresses, redirects, domains, markup; and what users type."""

from __future__ import annotations

import datetime as dt

import pytest

from gnomon.api import Directory
from gnomon.plans import pages
from gnomon.plans.dialect import spark_sql
from gnomon.sources import io

# The examples of RFC 3986, section 5.4, for http://a/b/c/d;p?q, and the forms that browsers give.
RESOLVED = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/",
    "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x",
    "http:g": "http://a/b/c/g", "HTTP://X.org:80": "http://x.org/", "https://X.org:443/A": "https://x.org/A", "http://x.org:8080": "http://x.org:8080/", "mailto:a@b.c": "mailto:a@b.c",
}


def test_relative_addresses(spark):
    rows = spark.createDataFrame([(h,) for h in RESOLVED], "h string")
    rows.createOrReplaceTempView("href")
    got = {r.h: r.x for r in spark.sql(spark_sql(f"SELECT h, {pages.absolute('h', 'b')} AS x FROM (SELECT h, 'http://a/b/c/d;p?q' AS b FROM href)")).collect()}
    assert got == RESOLVED


def test_fetch_chain(spark):
    responses, requests = [], []

    def answer(url, agent, status, location=None, body=None, rendered=None):
        responses.append((url, agent, status, location, body, rendered))

    for n in range(8):  # chains of 0 to 7 redirects
        requests.append((f"https://c{n}.org/p0",))
        for k in range(n):
            answer(f"https://c{n}.org/p{k}", "own", 301, ("/p", "p", "./p", f"HTTPS://C{n}.org:443/p")[k % 4] + str(k + 1))
        answer(f"https://c{n}.org/p{n}", "own", 200, None, f"body {n}")
    for url in ("https://ring.org/a", "https://refused.org/", "https://both.org/", "https://proxied.org/", "https://badproxy.org/", "https://gone.org/", "https://inward.org/", "http://127.0.0.1/", "https://silent.org/", "https://nowhere.org/", "https://kept.org/"):
        requests.append((url,))
    answer("https://ring.org/a", "own", 302, "/b")
    answer("https://ring.org/b", "own", 302, "/a")
    answer("https://refused.org/", "own", 403)
    answer("https://refused.org/", "browser", 302, "/in")
    answer("https://refused.org/in", "browser", 200, None, "for browsers")
    for agent in ("own", "browser"):
        answer("https://both.org/", agent, 406)
        answer("https://proxied.org/", agent, 403)
        answer("https://badproxy.org/", agent, 403)
    answer("https://proxied.org/", "proxy", 200, "https://proxied.org/home", "by proxy")
    answer("https://badproxy.org/", "proxy", 502, None, "error")
    answer("https://gone.org/", "own", 404, None, "gone", "drawn")
    answer("https://inward.org/", "own", 301, "http://192.168.0.1/admin")
    answer("http://192.168.0.1/admin", "own", 200, None, "secret")
    answer("http://127.0.0.1/", "own", 200, None, "secret")
    answer("https://silent.org/", "own", 301, "https://nowhere.org/x")
    answer("https://kept.org/", "own", 304, None, "not moved")
    answer("https://kept.org/", "browser", 200, None, "never asked")
    found = io.fetched(spark.createDataFrame(requests * 2, "url string"), spark.createDataFrame(responses, "url string, agent string, status int, location string, body string, rendered string"))
    got = {r.url: (r.final_url, r.status, r.agent, r.hops, r.why, r.ok, r.is_rendered, r.body) for r in found.collect()}
    assert len(got) == len(requests)
    for n in range(8):
        url = f"https://c{n}.org/p"
        assert got[url + "0"] == ((url + str(n), 200, "own", n, None, True, False, f"body {n}") if n <= 5 else (url + "5", 310, "own", 5, "too many redirects", False, False, ""))
    assert got["https://ring.org/a"][1:5] == (310, "own", 5, "too many redirects")
    assert got["https://refused.org/"] == ("https://refused.org/in", 200, "browser", 1, None, True, False, "for browsers")
    assert got["https://both.org/"] == ("https://both.org/", 406, "browser", 0, "status 406", False, False, "")
    assert got["https://proxied.org/"] == ("https://proxied.org/home", 200, "proxy", 0, None, True, False, "by proxy")
    assert got["https://badproxy.org/"] == ("https://badproxy.org/", 502, "proxy", 0, "status 502", False, False, "")
    assert got["https://gone.org/"] == ("https://gone.org/", 404, "own", 0, "status 404", False, True, "drawn")
    assert got["https://inward.org/"] == ("http://192.168.0.1/admin", None, "own", 1, "blocked host", False, False, "")
    assert got["http://127.0.0.1/"][1] is None and got["http://127.0.0.1/"][7] == ""
    assert got["https://silent.org/"][:5] == ("https://nowhere.org/x", None, "own", 1, "no answer")
    assert got["https://nowhere.org/"][4] == "no answer"
    assert got["https://kept.org/"][1:5] == (304, "own", 0, "status 304")


NASTY = ["@now(", "@now()", "a@first()b", "a @len(x) b", "jo@site(x)", "it's", "50%", "a\\", ":q", "x" * 500, "", "  "]


@pytest.fixture(scope="module")
def directory(spark):
    now = dt.datetime(2024, 5, 1, 12)
    names = ["Beth El", "O'Neil @now() Hall", "Back\\slash 50% :q", "Ahavas Torah"]
    places = [(k, f"place-{k}", n, "active", 40.0, -74.0, "UTC", None, f"{k} Main St", None, now) for k, n in enumerate(names)]
    sources = [(k, k, "manual", "x", "approved", "ok", "html", 1, now, None, None, now, 0.9, None, "{}", now) for k in range(len(names))]
    return Directory(spark, {
        "place": spark.createDataFrame(places, "id int, slug string, name string, status string, lat double, lng double, timezone string, submitted_url string, address string, match_domain string, submitted_at timestamp"),
        "source": spark.createDataFrame(sources, "id int, place_id int, kind string, identifier string, review_status string, run_status string, strategy string, priority int, last_run_at timestamp, last_received_at timestamp, first_broken_at timestamp, built_at timestamp, confidence double, reviewer_notes string, config_json string, created_at timestamp"),
        "rule": spark.createDataFrame([], "id string, place_id int, source_id int, tefillah string, time_kind string, clock string, anchor string, offset_min int, days string, valid_from date, valid_to date, special_kind string, priority int, is_manual_edit boolean, is_deleted boolean"),
    }, now=now)


def test_what_users_type_is_no_statement(directory):
    for q in NASTY:
        like = q.strip().lower().replace("%", "")
        assert all(like in r.name.lower() or like in r.slug for r in directory.search(q).collect())
        directory.lookup(q).collect()
        directory.listing(q).collect()
        directory.day(q, dt.date(2024, 5, 1)).collect()
    assert [r.name for r in directory.search("@now()").collect()] == ["O'Neil @now() Hall"]
    assert [r.name for r in directory.search("k\\s").collect()] == ["Back\\slash 50% :q"]
    assert [r.name for r in directory.search(":q").collect()] == ["Back\\slash 50% :q"]
    assert directory.search(" ").count() == 0 and directory.lookup("").count() == 0


def plain_score(needle, name, address):
    hay, low = f"{name} {address or ''}".lower(), name.lower()
    at, run, total, first = -1, 0, 0, 0
    for k, c in enumerate(needle):
        found = hay.find(c, at + 1)
        if found < 0:
            return 0
        near = k > 0 and found == at + 1
        run = run + 1 if near else 0
        total += 10 + (10 + 2 * run if near else 0) + (15 if found == 0 or hay[found - 1].isspace() else 0)
        first, at = (found if k == 0 else first), found
    boost = 200 + 100 * (low.find(needle) == 0) if needle in low else 50 if needle in hay else 0
    return total - min(first, 30) + boost


def test_lookup_scores(directory):
    places = [("Beth El", "0 Main St"), ("O'Neil @now() Hall", "1 Main St"), ("Back\\slash 50% :q", "2 Main St"), ("Ahavas Torah", "3 Main St")]
    for q in ("beth", "b e", "main", "2 m", "a", "o'neil @now() hall 1 main st", "ah tor", "ahavas torah 3 main st" + "x" * 100):
        want = sorted(((plain_score(q, *p), p[0]) for p in places if plain_score(q, *p) > 0), key=lambda x: (-x[0], x[1]))
        assert [(r.score, r.name) for r in directory.lookup(q).collect()] == want


# Rules of the public-suffix list, and its published cases for them.
SUFFIXES = """// comments and blank lines are no rules

com
biz
uk.com
jp  // all that follows white space is left out
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
ak.us
k12.ak.us
cn
com.cn
公司.cn
中国
"""
SUFFIX_CASES = {
    "COM": None, "example.COM": "example.com", "WwW.example.COM": "example.com", ".com": None, ".example": None, ".example.com": None, "example": None, "example.example": "example.example", "b.example.example": "example.example",
    "a.b.example.example": "example.example", "biz": None, "domain.biz": "domain.biz", "b.domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "com": None, "example.com": "example.com", "b.example.com": "example.com", "a.b.example.com": "example.com",
    "uk.com": None, "example.uk.com": "example.uk.com", "b.example.uk.com": "example.uk.com", "a.b.example.uk.com": "example.uk.com", "test.ac": "test.ac", "jp": None, "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": None,
    "test.ac.jp": "test.ac.jp", "www.test.ac.jp": "test.ac.jp", "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp", "ide.kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None,
    "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck", "www.ck": "www.ck",
    "www.www.ck": "www.ck", "us": None, "test.us": "test.us", "www.test.us": "test.us", "ak.us": None, "test.ak.us": "test.ak.us", "www.test.ak.us": "test.ak.us", "k12.ak.us": None, "test.k12.ak.us": "test.k12.ak.us",
    "www.test.k12.ak.us": "test.k12.ak.us", "食狮.com.cn": "食狮.com.cn", "食狮.公司.cn": "食狮.公司.cn", "www.食狮.公司.cn": "食狮.公司.cn", "shishi.公司.cn": "shishi.公司.cn", "公司.cn": None, "食狮.中国": "食狮.中国", "中国": None,
    "10.0.0.1": None, "a..com": None, "::1": None, "": None,
}


def test_public_suffixes(spark, tmp_path):
    (tmp_path / "list.dat").write_text(SUFFIXES, encoding="utf-8")
    assert io.suffixes(spark, str(tmp_path / "list.dat")).count() == 18
    spark.createDataFrame([(h,) for h in [*SUFFIX_CASES, *SUFFIX_CASES, None]], "host string").createOrReplaceTempView("hosts")
    got = spark.sql(spark_sql(f"WITH {pages.domains('hosts', 'h.host')} SELECT host, domain FROM named")).collect()
    assert len(got) == 2 * len(SUFFIX_CASES) + 1 and {r.host: r.domain for r in got} == {**SUFFIX_CASES, None: None}
    spark.catalog.dropTempView("suffix")


PAGE = """<!doctype html><html><head><title>A &amp; B
 | Home</title><style>a > b { content: "<a href='x'>no</a>" }</style><body>
<!-- <a href="/hidden">no</a> --><H1 class=x>Times <i>of</i> day</H1>
<a href="/one?a=1&amp;b=2" title="a > b">First <b>bold</b><span><span>in</span>ner</span></a><a href='two'>Un<i>closed
<a href=three>Third</a><A HREF="/four"></A><a name="x">no href</a><a href="mailto:a@b.c">mail</a><a href="#top">top</a>
<div><div><a href="https://other.org/">else</a></div><a href="/five">Five &#65;&eacute;</a></div>
<svg><svg><a href="/six">six</a></svg><title>not the title</title></svg><template><p>no <template>t</template> no</p></template>
<script>document.write("<a href='/js'>no</a>")</script><noscript>enable <a href="/seven">Seven</a></noscript>
<img src="/a.png" alt="x > y" id=i class="c d"><img alt="none"><p>one<p>two<br>three</p><a href="/one?a=1&b=2">again</a><textarea><a href="/t">typed</a></textarea>
<p title="never closed>tail <a href="/eight">Eight"""


def test_pages_by_a_parser(spark):
    from gnomon.functions import markup

    rows = [(1, "https://S.org:443/dir/page", PAGE), (2, "https://s.org", "plain &lt;text&gt; only"), (3, "https://s.org", ""), (4, "https://s.org", None), (5, "https://s.org", "<a href=/x>" * 3 + "<svg>" * 1000 + "x" * 1_000_000 + "</svg>" * 1000 + "<b>end")]
    pages_ = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {}
    for r in markup.parts(pages_).collect():
        got.setdefault((r.page_id, r.kind), []).append((r.ref, r.text))
    assert got[1, "title"] == [(None, "A & B | Home")]
    assert got[1, "heading"] == [("1", "Times of day")]
    assert got[1, "image"] == [("/a.png", "x > y i c d"), ("", "none")]
    assert got[1, "link"][:4] == [("/one?a=1&b=2", "First boldinner"), ("two", "Unclosed"), ("three", "Third"), ("/four", "")]
    assert ("/hidden", "no") not in got[1, "link"] and not [x for x in got[1, "link"] if x[0] in ("x", "/js", "/t")]
    text = got[1, "text"][0][1]
    assert "one two three" in text and "Five Aé" in text and "enable" not in text and "document" not in text and "not the title" not in text
    assert got[2, "text"] == [(None, "plain <text> only")] and (3, "text") not in got and (4, "text") not in got
    assert got[5, "text"] == [(None, "end")] and len(got[5, "link"]) == 3
    links = [(r.href, r.text) for r in markup.links(pages_).filter("page_id = 1").orderBy("nth").collect()]
    assert links[:4] == [("https://s.org/one?a=1&b=2", "First boldinner"), ("https://s.org/dir/two", "Unclosed"), ("https://s.org/dir/three", "Third"), ("https://s.org/five", "Five Aé")]
    assert markup.links(pages_, 2).filter("page_id = 1").count() == 2


def test_fetch_chain_reads_responses_once(spark):
    """No recursion: responses are made once and read back, whatever it takes to make them; locations that lead to another host, private ones in the middle."""
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [("https://a.org/1", "own", 302, "//B.org:443/x/../y", None, None), ("https://b.org/y", "own", 301, "http://10.1.2.3/", None, None), ("http://10.1.2.3/", "own", 302, "https://a.org/2", None, None), ("https://a.org/2", "own", 200, None, "two", None), ("https://c.org/", "own", 302, "", None, "drawn")]
    answers = spark.createDataFrame(rows, "url string, agent string, status int, location string, body string, rendered string")
    found = io.fetched(spark.createDataFrame([("https://a.org/1",), ("https://c.org/",), (None,)], "url string"), answers.mapInPandas(made, answers.schema))
    got = {r.url: (r.final_url, r.status, r.hops, r.why, r.is_rendered, r.body) for r in found.collect()}
    assert got == {"https://a.org/1": ("http://10.1.2.3/", None, 2, "blocked host", False, ""), "https://c.org/": ("https://c.org/", 310, 5, "too many redirects", True, "drawn")}
    assert seen.value == len(rows)
