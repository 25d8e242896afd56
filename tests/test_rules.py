"""Rules held against cases worked out by hand, over tables made for them."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gnomon.plans import catalog, ingest, pages, schedule
from gnomon.plans.dialect import spark_sql


def ask(spark, text, **tables):
    """Rows of a statement over hand-made tables, without the test tables' mapping."""
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    return spark.sql(spark_sql(catalog.with_extras(text))).collect()


def one(spark, expression, **columns):
    values = ", ".join(f"{'NULL' if v is None else repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)} AS {k}" for k, v in columns.items())
    return ask(spark, f"SELECT {expression} AS x FROM (SELECT {values})")[0].x


@pytest.mark.parametrize(("url", "want"), [
    ("https://x.org/14062026.png?v=1718&t=20260614", "https://x.org/14062026.png?t=20260614"),
    ("https://x.org/a.png?CacheBust=1&ref=2&id=0123456789abcdefAB", "https://x.org/a.png?ref=2"),
    ("https://x.org/a.png?ts=5&_=9#top", "https://x.org/a.png?ts=5"),
    ("https://x.org?rand=1", "https://x.org/"),
    ("https://x.org/a.png?k=abcdef012345678", "https://x.org/a.png?k=abcdef012345678"),
])
def test_resource_key(spark, url, want):
    assert one(spark, pages.resource_key("u"), u=url) == want


@pytest.mark.parametrize(("host", "want"), [("www.a.co.uk", "a.co.uk"), ("co.uk", None), ("a.b.site.org", "site.org"), ("site.k12.nj.us", "site.k12.nj.us"), ("localhost", None), ("10.0.0.1", None)])
def test_registrable_domain(spark, host, want):
    rows = ask(spark, f"WITH {pages.domains('h0', 'h.host')} SELECT domain FROM named", h0=("id int, host string", [(1, host)]), suffix=("name string", [("co.uk",), ("k12.nj.us",)]))
    assert [r.domain for r in rows] == [want]


@pytest.mark.parametrize(("text", "want"), [("Info@Mail.Site.org", "mail.site.org"), ("https://u:p@Www.site.org:80/x?y", "www.site.org"), ("theshul.org/times", "theshul.org"), ("a@b@c.org", "c.org")])
def test_host_of(spark, text, want):
    assert one(spark, pages.HOST_OF.format(t="t"), t=text) == want


@pytest.mark.parametrize(("ip", "want"), [("10.1.2.3", True), ("172.15.0.1", False), ("172.16.0.1", True), ("100.64.0.1", True), ("100.128.0.1", False), ("169.254.169.254", True), ("300.1.1.1", True), ("8.8.8.8", False), ("::ffff:192.168.0.1", True), ("::1", True), ("FD00::2", True), ("fe80::1", True), ("2001:db8::1", False)])
def test_private_addresses(spark, ip, want):
    assert one(spark, pages.private_address("ip"), ip=ip) is want


@pytest.mark.parametrize(("host", "want"), [("fda.gov", False), ("[fd00::1]", True), ("a.internal", True), ("localhost", True), ("notlocalhost", False), ("127.0.0.1", True), ("999.1.1.1", False)])
def test_blocked_hosts(spark, host, want):
    assert one(spark, pages.blocked_host("h"), h=host) is want


@pytest.mark.parametrize(("prev", "now", "confidence", "want"), [
    (12, 2, 0.9, "rule count dropped from 12 → 2 (>50% drop)"),
    (4, 2, 0.9, None),
    (2, 0, 0.55, "confidence 0.55 < 0.6; new extraction produced 0 rules (previous: 2)"),
    (0, 0, 0.9, "broken (unknown reason)"),
    (5, 0, 0.7, "rule count dropped from 5 → 0 (>50% drop); new extraction produced 0 rules (previous: 5)"),
])
def test_guardrail_reasons(spark, prev, now, confidence, want):
    got = ask(spark, catalog.TEXT["guardrail"], run_result=("source_id int, prev long, now long, confidence double", [(1, prev, now, confidence)]))[0]
    assert got.reason == want and got.is_broken is (want is not None)


def test_daily_spend_at_any_depth(spark):
    at, old = dt.datetime(2024, 5, 2), dt.datetime(2024, 4, 1)
    rows = [
        (1, at, old, '{"model":"Claude-HAIKU-4","usage":{"a":{"inputTokens":1000000,"outputTokens":10},"b":[{"inputTokens": 500000}]}}'),
        (2, old, at, '{"usage":{"x":{"inputTokens":1000000,"outputTokens":100000}}}'),
        (3, old, old, '{"model":"haiku","usage":{"inputTokens":9}}'),
        (4, at, at, '{"model":"haiku"}'),
    ]
    got = {r.model: r for r in ask(spark, f"WITH {ingest.spent(chr(84) + 'IMESTAMP ' + repr('2024-05-02 00:00:00'))} SELECT * FROM spend", source=("id int, created_at timestamp, built_at timestamp, config_json string", rows))}
    assert got["small"].tin == 1_500_000 and got["small"].tout == 10 and got["small"].dollars == pytest.approx(1.50005)
    assert got["large"].dollars == pytest.approx(3 + 1.5) and len(got) == 2


@pytest.mark.parametrize(("days", "page", "review"), [
    ("5,1,2,3,4", "Mon-Fri", "Mon-Fri"), ("1,2,3,4", "Mon-Thu", "Mon, Tue, Wed, Thu"), ("4,0,1,2,3", "Sun-Thu", "Thu, Sun, Mon, Tue, Wed"), ("6", "Shabbos", "Shabbos"),
    ("0,1,2,3,4,5,6", "Daily", "Every day"), ("4,2", "Thu, Tue", "Thu, Tue"), (None, "—", "(no recurring day — check valid_from/to)"),
])
def test_day_labels(spark, days, page, review):
    row = ask(spark, f"SELECT {schedule.DAYS_LABEL} AS a, {schedule.DAYS_LABEL_REVIEW} AS b FROM (SELECT CAST({'NULL' if days is None else repr(days)} AS STRING) AS days)")[0]
    assert (row.a, row.b) == (page, review)


@pytest.mark.parametrize(("kind", "clock", "anchor", "offset", "page", "review"), [
    ("fixed", "0:05", None, None, "12:05 AM", "12:05 AM"), ("fixed", "19:15", None, None, "7:15 PM", "7:15 PM"), ("fixed", "late", None, None, "late", "late"),
    ("zmanim", None, "shkia", -18, "18 min before sunset", "18 min before shkia"), ("zmanim", None, "plag_mincha", 0, "at plag", "at plag mincha"), ("zmanim", None, "tzeis_72", 5, "5 min after tzeis (72)", "5 min after tzeis 72"),
])
def test_time_labels(spark, kind, clock, anchor, offset, page, review):
    text = lambda v: "CAST(NULL AS STRING)" if v is None else f"'{v}'"
    row = ask(spark, f"SELECT {schedule.TIME_LABEL} AS a, {schedule.TIME_LABEL_REVIEW} AS b FROM (SELECT '{kind}' AS time_kind, {text(clock)} AS clock, {text(anchor)} AS anchor, CAST({'NULL' if offset is None else offset} AS INT) AS offset_min)")[0]
    assert (row.a, row.b) == (page, review)


@pytest.mark.parametrize(("secs", "want"), [(30, "starting now"), (-59, "starting now"), (90, "in 2m"), (3600, "in 1h"), (5400, "in 1h 30m"), (-600, "started 10m ago"), (-7300, "started 2h ago")])
def test_relative_start(spark, secs, want):
    assert one(spark, schedule.RELATIVE, secs=secs, mins=int(abs(secs) / 60 + 0.5)) == want


@pytest.mark.parametrize(("text", "want"), [("2024-02-31", dt.date(2024, 3, 2)), ("2024-13-01", dt.date(2025, 1, 1)), ("2024-2-3", None), ("2024-00-10", dt.date(2023, 12, 10))])
def test_date_only(spark, text, want):
    assert one(spark, schedule.DATE_ONLY.format(t="t"), t=text) == want


def test_metres_on_the_spheroid(spark):
    rows = [(0.0, 0.0, 0.0, 1.0, 111319.491), (0.0, 0.0, 1.0, 0.0, 110574.389), (40.0, -74.0, 40.0, -74.0, 0.0), (40.7128, -74.006, 40.7306, -73.9352, 6301.6)]
    text = "SELECT want, metres FROM " + schedule.metres("p", "a", "b", "c", "d")
    for r in ask(spark, text, p=("a double, b double, c double, d double, want double", rows)):
        assert r.metres == pytest.approx(r.want, abs=8)


def test_line_extraction(spark):
    lines = ["Weekday davening schedule", "Shacharis 7:30 AM", "Mincha   18 minutes before sunset on Friday", "12:15 p.m.", "Office hours 9:00 am", "", "x" * 250 + " 8:00 am mincha"]
    rows = [(1, k, t) for k, t in enumerate(lines)] + [(2, 0, "Maariv 12:10 am"), (2, 1, "Maariv 12:10 am (Sunday)")]
    got = ask(spark, "WITH " + pages.extract_lines("page_line") + " SELECT * FROM extracted ORDER BY page_id, nth", page_line=("page_id int, line_no int, line string", rows))
    first = [(r.service, r.day_rule, r.time_kind, r.clock, r.offset_min) for r in got if r.page_id == 1]
    # service and day are looked for in the lines beside it too, in their order; office hours stand next to a line with neither
    assert first == [("shacharis", "friday", "fixed", "07:30", None), ("shacharis", "friday", "relative_sunset", None, -18), ("mincha", "friday", "fixed", "12:15", None)]
    by = {(r.page_id, r.clock, r.offset_min): r.confidence for r in got}
    assert by[1, "07:30", None] == pytest.approx(0.4 + 0.2 + 0.1 + 0.05) and by[1, None, -18] == pytest.approx(0.4 + 0.15 + 0.1 + 0.05)
    assert [(r.clock, r.day_rule) for r in got if r.page_id == 2] == [("00:10", "sunday")]


def fuzzy_score(needle, name, address):
    hay = (name + " " + (address or "")).lower()
    if not all(c in hay for c in needle):
        return 0
    boost = (200 + 100 * name.lower().startswith(needle)) if needle in name.lower() else 50 if needle in hay else 0
    score = run = k = 0
    before = False
    for i, c in enumerate(hay):
        if k == len(needle):
            break
        if c == needle[k]:
            score += 10
            if before:
                run += 1
                score += 10 + 2 * run
            else:
                run = 0
            if i == 0 or hay[i - 1].isspace():
                score += 15
            k, before = k + 1, True
        else:
            before = False
    return 0 if k < len(needle) else score - min(hay.index(needle[0]), 30) + boost


@pytest.mark.parametrize("needle", ["agdh sth", "beth", "main", "o'b", "zz", "h", "south  1"])
def test_fuzzy_scores(spark, needle):
    rows = [(1, "Agudath South", None), (2, "Beth Israel", "1 Main St"), (3, "O'Brien Beth", "South 1 Main"), (4, "Hashkamah at the Beth Medrash", ""), (5, "Mainly South", "  1")]
    got = ask(spark, f"WITH {pages.fuzzy('some_place', chr(39) + needle.replace(chr(39), chr(39) * 2) + chr(39))} SELECT id, score FROM fuzzy", some_place=("id int, name string, address string", rows))
    assert {r.id: r.score for r in got} == {i: fuzzy_score(needle, n, a) for i, n, a in rows}


def test_senders_and_sites(spark):
    bodies = [
        (1, 'From: me@gmail.com\n---------- Forwarded message ---------\nFrom: "Jo B" <Jo@Site.org>\nsee https://url12.myshul.com/x, https://www.site.co.uk/now).'),
        (2, "from: gabbai@site.org\nhttps://x.org/a.png https://click.site.org/b https://site.org/unsubscribe http://Shul.org:80/c"),
        (3, "Begin forwarded message:\nFrom: nobody here\nhttps://mailchimp.com/a"),
    ]
    tables = {"mail": ("id int, body string", bodies), "suffix": ("name string", [("co.uk",)]), "shared_domain": ("domain string", [("myshul.com",), ("mailchimp.com",)])}
    assert {r.id: (r.email, r.name) for r in ask(spark, catalog.TEXT["original_sender"], **tables)} == {1: ("jo@site.org", "Jo B"), 2: ("gabbai@site.org", None)}
    assert {r.id: r.website for r in ask(spark, catalog.TEXT["website_in_email"], **tables)} == {1: "https://www.site.co.uk", 2: "https://shul.org"}


def test_slugs(spark):
    assert one(spark, pages.slug("n"), n="  Bét-Ël of Ñorth!! (Main) ") == "bet-el-of-north-main"


def test_pictures_and_documents(spark):
    html = '<img src="/logo.png" alt="schedule"><img src="b.jpg"><img SRC="/hero-times.webp" class="hero"><img src="c.png" alt="Minyan"><img src="d.gif"><a href="x.pdf?week=1">a</a><a href="/weekly-times.pdf">b</a>'
    site = ("page_id int, url string, html string", [(1, "https://s.org/a/b", html)])
    got = ask(spark, catalog.TEXT["image_candidates"], site=site)
    assert sorted((r.nth, r.link, r.rank) for r in got) == [(1, "https://s.org/a/c.png", 22), (2, "https://s.org/hero-times.webp", 17), (3, "https://s.org/a/b.jpg", 2)]
    assert [(r.link, r.rank) for r in ask(spark, catalog.TEXT["pdf_candidates"], site=site)] == [("https://s.org/weekly-times.pdf", 10)]


def test_platforms(spark):
    rows = [(1, "https://a.org", '<img src="https://images.shulcloud.com/x.png">Powered by ShulCloud'), (2, "https://a.org", '<link href="//wix.com/a"><meta name="generator" content="WIX.com">'), (3, "https://x.shulcloud.com/", ""), (4, "https://a.org", "Powered by ShulHub, powered by shulspace"), (5, "https://a.org", "plain")]
    got = {r.page_id: (r.platform, r.confidence) for r in ask(spark, catalog.TEXT["platform"], site=("page_id int, url string, html string", rows))}
    assert got == {1: ("shulcloud", 1.0), 2: ("wix", 0.8), 3: ("shulcloud", 0.6), 4: ("shulspace", 0.6), 5: ("unknown", 0.0)}


def test_failure_summary(spark):
    rows = [(1, 1, "html", "extracted", 0, 0.12, None, "vision_image"), (1, 2, "js_rendered", "fetch_failed", 0, None, "status\n 503", "vision_image"), (1, 3, "vision_image", "skipped", 0, None, "no schedule image on page", "vision_image")]
    schema = "source_id int, pos int, strategy string, status string, rules int, confidence double, message string, preferred string"
    assert [r.summary for r in ask(spark, catalog.TEXT["failure_summary"], attempt=(schema, rows))] == ["vision_image skipped: no schedule image on page | html 0r@0.12 | js_rendered fetch_failed: status 503"]


def test_change_notes(spark, tmp_path):
    from gnomon.sources import io

    (tmp_path / "NOTES.md").write_text("# Notes\nintro\n## v2 — 2024-05-01\nwords\n### Features\n- one\n  goes on\n- two\n### Fixes\n* three\n## v1 - 2024-01-01\n### Features\n- four\n")
    got = sorted((r.version, r.day, r.heading, r.bullet, r.text) for r in io.changelog(spark, str(tmp_path / "NOTES.md")).collect())
    assert got == [("v1", "2024-01-01", "Features", 1, "four"), ("v2", "2024-05-01", "Features", 1, "one|goes on"), ("v2", "2024-05-01", "Features", 2, "two"), ("v2", "2024-05-01", "Fixes", 1, "three")]
    assert io.notes(spark, str(tmp_path / "none.md")).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    from gnomon.sources import io

    (tmp_path / "t.json").write_text('{"targets": [\n {"name": "A", "region": "NY", "tier": 1},\n {"name": "B", "region": "NJ", "tier": 2}]}')
    assert [r.name for r in io.targets(spark, str(tmp_path / "t.json"), region="NJ", name="all").collect()] == ["B"] and io.targets(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "c.txt").write_text("site.org/\n# no\n\nhttps://site.org?x=1\n HTTP://b.org/a#t \n")
    assert sorted(r.url for r in io.candidate_urls(spark, str(tmp_path / "c.txt")).collect()) == ["HTTP://b.org/a", "https://site.org"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"From": " Me@X.org ", "Subject": null, "TextBody": " hi "}\n{"From": "", "TextBody": "x"}\n{"From": "a@b.c"}\n')
    q = io.message_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("messages_in").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert [(r.forwarder, r.subject, r.body) for r in spark.table("messages_in").collect()] == [("me@x.org", "", "hi")]
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    new = io.update_by_key(table, spark.createDataFrame([(2, None), (9, "z")], "id int, name string"), "id")
    assert sorted(map(tuple, new.collect())) == [(1, "a", 5), (2, None, 6)]
    io.publish({"t": table}, str(tmp_path / "db"), 1)
    io.publish({"t": new}, str(tmp_path / "db"), 2)
    io.publish({"t": table}, str(tmp_path / "db"), 2)  # again: nothing
    assert sorted(map(tuple, io.current(spark, str(tmp_path / "db"), "t").collect())) == [(1, "a", 5), (2, None, 6)]
    io.append(table, str(tmp_path / "log"))
    io.append(table, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_model_output(spark):
    from gnomon.functions.model_output import extractions, object_in

    assert object_in('```json\n{"a": "}"}\n```') == '{"a": "}"}' and object_in('Sure: {"a": {"b": "\\"}"}} and {"c": 1}') == '{"a": {"b": "\\"}"}}' and object_in("no object") == "no object"
    rule = '{"tefillah": "mincha", "time": {"kind": "fixed", "clock": "18:15"}, "daysOfWeek": [0, 6]}'
    good = f'Here: {{"confidence": 0.9, "reasoning": "r", "rules": [{rule}]}} bye'
    cases = [
        (1, good, True), (2, good.replace("18:15", "6 pm"), False), (3, good.replace("0.9", "1.2"), False), (4, good.replace("[0, 6]", "[0, 7]"), False), (5, good.replace("mincha", "musaf"), False), (6, "nothing", False), (7, None, False),
        (8, good.replace('"kind": "fixed", "clock": "18:15"', '"kind": "zmanim", "anchor": "shkia", "offsetMin": -18'), True), (9, good.replace('"r"', '"' + "r" * 801 + '"'), False), (10, good.replace(f"[{rule}]", "[]"), True),
    ]
    got = {r.id: r for r in extractions(spark.createDataFrame([(i, t) for i, t, _ in cases], "id int, text string")).collect()}
    assert {i: got[i].valid for i, _, _ in cases} == {i: v for i, _, v in cases}
    assert got[1].extraction.rules[0].specialScheduleKind == "regular"


NOW = dt.datetime(2024, 7, 8, 14, 0)  # a Monday, 10 in the morning in New York
PLACE = "id int, slug string, name string, address string, status string, lat double, lng double, timezone string, submitted_url string, submitted_at timestamp, match_domain string"
SOURCE = "id int, place_id int, kind string, identifier string, review_status string, run_status string, strategy string, priority int, last_run_at timestamp, last_received_at timestamp, first_broken_at timestamp, confidence double, reviewer_notes string"
RULE = "id string, place_id int, source_id int, tefillah string, time_kind string, clock string, anchor string, offset_min int, days string, valid_from date, valid_to date, special_kind string, priority int, is_manual_edit boolean, is_deleted boolean"


def places():
    spot = lambda i, lat, status="active": (i, f"p{i}", f"Place {i}", f"{i} Main", status, lat, -74.0, "America/New_York", None, NOW, None)
    return [spot(1, 40.7), spot(2, 40.71), spot(3, 40.7, "archived"), spot(4, 41.7), spot(5, 40.7)]


def sources():
    day = dt.timedelta(days=1)
    row = lambda i, place, review="approved", run="ok", age=1, priority=40: (i, place, "website_llm", f"s{i}", review, run, "html", priority, NOW - age * day, None, None, 0.9, None)
    return [row(1, 1), row(2, 2), row(3, 3), row(4, 4), row(5, 5, age=15), row(6, 1, priority=60), row(7, 1, review="rejected")]


def rule(i, place, source, clock=None, anchor=None, offset=None, days="1,2,3,4,5", special="regular", tefillah="mincha", start=None, end=None, edited=False, deleted=False):
    return (i, place, source, tefillah, "fixed" if clock else "zmanim", clock, anchor, offset, days, start, end, special, 0, edited, deleted)


@pytest.fixture
def directory(spark):
    from gnomon.api import Directory

    rules = [
        rule("a", 1, 1, "10:20"), rule("b", 1, 6, "10:20"),  # the same minyan: the source of higher priority wins
        rule("c", 2, 2, "09:45"), rule("d", 2, 2, anchor="shkia", offset=-18), rule("e", 2, 2, "09:20"),  # e began over half an hour ago
        rule("f", 1, 1, "11:00", days="6"), rule("g", 1, 1, "11:30", days=None), rule("h", 1, 7, "12:00"), rule("i", 1, 1, "13:00", deleted=True),
        rule("j", 1, 1, "15:00", days="6", special="ad_hoc", start=dt.date(2024, 7, 1), end=dt.date(2024, 7, 8)), rule("k", 3, 3, "12:00"), rule("l", 4, 4, "12:00"), rule("m", 5, 5, "12:00"),
    ]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Directory(spark, {"place": frame(places(), PLACE), "source": frame(sources(), SOURCE), "rule": frame(rules, RULE)}, now=NOW)


def test_feed_near_a_point(directory):
    rows = directory.nearby(40.7, -74.0, 2).collect()
    assert [r.id for r in rows] == ["b", "g", "j", "d", "c"]  # upcoming by time, then what began last
    by = {r.id: r for r in rows}
    assert by["b"].starts_at == dt.datetime(2024, 7, 8, 14, 20) and by["c"].started and not by["b"].started
    sunset = by["d"].starts_at + dt.timedelta(minutes=18)
    assert abs((sunset - dt.datetime(2024, 7, 9, 0, 29)).total_seconds()) < 150 and not by["d"].fixed_evening and by["b"].fixed_evening
    assert by["b"].metres == 0 and by["c"].metres == pytest.approx(1110.5, abs=1)
    assert [r.id for r in directory.nearby(40.7, -74.0, 0.1).collect()] == ["b", "g", "j"]
    assert [r.id for r in directory.nearby(40.7, -74.0, 2, limit=1, tefillah="mincha").collect()] == ["b"]
    assert [(r.place_id, r.id) for r in directory.nearby_places(40.7, -74.0, 2).collect()] == [(1, "b"), (1, "g"), (2, "d"), (2, "c")]


def test_feed_of_a_travel_day(directory):
    rows = directory.nearby(40.7, -74.0, 2, day=dt.date(2024, 7, 13), travel=True).collect()  # a Saturday
    assert [r.id for r in rows] == ["f", "g"] and rows[0].starts_at == dt.datetime(2024, 7, 13, 15, 0)


def test_day_search_and_lookup(directory):
    day = directory.day("p1", dt.date(2024, 7, 8)).collect()
    assert [(r.id, r.label) for r in day] == [("b", "10:20 AM"), ("j", "3:00 PM")]  # without days a rule is not on the page
    assert [r.id for r in directory.search(" place ").collect()] == [1, 2, 4] and directory.search("  ").count() == 0 and [r.id for r in directory.search("place_4").collect()] == [4]
    assert directory.lookup("2 main").first().id == 2 and directory.lookup(" ").count() == 0
    assert [(r.id, r.state) for r in directory.listing(state="stale").collect()] == []
    assert {r.id: r.state for r in directory.listing().collect()} == {1: "active", 2: "active", 3: "archived", 4: "active", 5: "broken"}


def test_runs_count_what_they_remove(spark):
    from gnomon.operators.transitions import apply_runs

    rules = spark.createDataFrame([("a", 1, False, False), ("b", 1, False, True), ("c", 1, True, False)], "id string, source_id int, is_deleted boolean, is_manual_edit boolean")
    schema = "id int, review_status string, run_status string, confidence double, last_run_at timestamp, first_broken_at timestamp, identifier string"
    results = spark.createDataFrame([(1, 0.7, "https://x/poster.png", [("z",)]), (1, 0.8, "https://x/", [("n",), ("m",)])], "source_id int, confidence double, identifier string, rules array<struct<id:string>>")
    s, r, runs = apply_runs(spark.createDataFrame([(1, "pending", "broken", 0.1, None, NOW, "old")], schema), rules, results, F.lit(NOW))
    assert [(x.rules_added, x.rules_removed, x.status) for x in runs.collect()] == [(2, 1, "ok")]
    assert {(x.id, x.is_deleted) for x in r.collect()} == {("a", True), ("b", False), ("c", True), ("n", False), ("m", False)}
    assert [(x.identifier, x.review_status, x.first_broken_at) for x in s.collect()] == [("https://x/", "approved", None)]


def test_created_sources_supersede(spark):
    from gnomon.operators.transitions import create_sources

    old = [(1, 7, "website_llm", "u", "approved", "ok", "html", 40, NOW, None, None, 0.9, None), (2, 7, "website_llm", "v", "approved", "ok", "html", 40, NOW, None, None, 0.9, None), (3, 7, "website_llm", "u", "rejected", "ok", "html", 40, NOW, None, None, 0.9, "no")]
    rules = [rule("a", 7, 1, "10:00"), rule("b", 7, 1, "11:00", edited=True), rule("c", 7, 2, "12:00")]
    new = [(9, 7, "website_llm", "u", None, "broken", "failed", 40, NOW, None, None, None, None, [])]
    s, r = create_sources(spark.createDataFrame(old, SOURCE), spark.createDataFrame(rules, RULE), spark.createDataFrame(new, SOURCE + ", rules array<struct<id:string>>"), F.lit(NOW))
    got = {x.id: (x.review_status, x.reviewer_notes, x.first_broken_at) for x in s.collect()}
    assert got == {1: ("rejected", "superseded by new extraction on 2024-07-08", None), 2: ("approved", None, None), 3: ("rejected", "no", None), 9: ("rejected", "auto-rejected: cascade returned no useful rules", NOW)}
    assert {x.id: x.is_deleted for x in r.collect()} == {"a": True, "b": True, "c": False}


def test_mail(spark):
    from gnomon.operators.transitions import apply_mail

    mail = lambda i, identifier: (i, i, "email_newsletter", identifier, "approved", "ok", None, 60, NOW, None, None, 0.9, None)
    rules = [rule("a", 1, 1, "10:00"), rule("b", 1, 1, "11:00", edited=True), rule("s", 1, 1, "12:00", special="ad_hoc")] + [rule(f"x{k}", 2, 2, f"{k}:00") for k in range(4)]
    letters = [
        (1, "a@x.org", None, 0.9, [("n1", "regular", "mincha"), ("n2", "yom_tov", "maariv")]), (2, "b@x.org", None, 0.9, [("m1", None, "mincha")]), (3, "c@x.org", "site.org", 0.9, [("q", "regular", "other")]),
        (4, "d@x.org", "none.org", 0.9, [("q", "regular", "other")]), (5, "a@x.org", None, 0.4, [("q", "regular", "other")]), (6, "e@x.org", "site.org", 0.9, []),
    ]
    p = spark.createDataFrame([(8, "site.org")], "id int, match_domain string")
    out, s, r = apply_mail(spark.createDataFrame([mail(1, "a@x.org"), mail(2, "b@x.org")], SOURCE), spark.createDataFrame(rules, RULE), p, spark.createDataFrame(letters, "id int, identifier string, match_domain string, confidence double, rules array<struct<id:string,special_kind:string,tefillah:string>>"), F.lit(NOW))
    assert {x.id: (x.outcome, x.source_id, x.place_id) for x in out.collect()} == {1: ("refresh", 1, None), 2: ("broken", 2, None), 3: ("attach", None, 8), 4: ("create", None, None), 5: ("skipped", None, None), 6: ("skipped", None, None)}
    assert {x.id: (x.run_status, x.review_status, x.first_broken_at) for x in s.collect()} == {1: ("ok", "approved", None), 2: ("broken", "approved", NOW)}
    got = {x.id: (x.is_deleted, x.priority, x.place_id) for x in r.collect()}
    assert got["a"][0] and got["b"][0] and not got["s"][0] and got["n1"] == (False, 0, 1) and got["n2"] == (False, 10, 1) and not got["x0"][0] and "m1" not in got


def test_manual_edits(spark):
    from gnomon.operators.transitions import edit_rules

    rules = spark.createDataFrame([rule("a", 1, 1, "10:00"), rule("b", 1, 1, "11:00"), rule("c", 1, 1, "12:00")], RULE)
    edits = spark.createDataFrame([("a", 1, "edit", "09:00", None), ("a", 2, "edit", "08:00", None), ("b", 1, "delete", None, None)], "id string, at int, verb string, clock string, days string")
    got = {r.id: (r.clock, r.days, r.is_deleted, r.is_manual_edit) for r in edit_rules(rules, edits).collect()}
    assert got == {"a": ("08:00", None, False, True), "b": ("11:00", "1,2,3,4,5", True, True), "c": ("12:00", "1,2,3,4,5", False, False)}


def test_triggers_and_failures(spark, tmp_path):
    from gnomon.streaming.state import FailureLog, due

    assert due(dt.datetime(2024, 7, 6, 5), dt.datetime(2024, 7, 7, 4)) == [(dt.datetime(2024, 7, 7, 3), "weekly_runs"), (dt.datetime(2024, 7, 7, 4), "weekly_digest")]
    told: list = []
    log = FailureLog(lambda name, message: told.append((name, message)))
    spark.streams.addListener(log)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.json").write_text('{"x": 1}')

        def fail(batch, batch_id):
            raise ValueError("no such shelf")

        q = spark.readStream.schema("x int").json(str(tmp_path / "in")).writeStream.queryName("shelves").foreachBatch(fail).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no such shelf"):
            q.awaitTermination(60)
        for _ in range(100):
            if told:
                break
            spark.sparkContext._jvm.Thread.sleep(100)
    finally:
        spark.streams.removeListener(log)
    assert told and told[0][0] == "shelves" and "no such shelf" in told[0][1]


def test_stream_folded_into_versions(spark, tmp_path):
    from gnomon.sources import io

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "n": 2}\n{"id": 1, "n": 3}\n{"id": 2, "n": 5}')
    io.publish({"t": spark.createDataFrame([], "id int, n long")}, str(tmp_path / "db"), 0)

    def step(batch, batch_id):
        return {"t": batch.groupBy("id").agg(F.sum("n").alias("n"))}

    events = spark.readStream.schema("id int, n int").json(str(tmp_path / "in"))
    for _ in range(2):  # a second run has nothing to do
        io.apply_stream(events, "id", lambda b, k: step(b, k), str(tmp_path / "db2"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(map(tuple, io.current(spark, str(tmp_path / "db2"), "t").collect())) == [(1, 5), (2, 5)]
