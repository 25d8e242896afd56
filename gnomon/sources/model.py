"""Relations of the engine: fixed domains, and a mapping of the benchmark tables to them.

The mapping is plain SQL that both Spark and other engines can run, so a query over it
has the same inputs wherever it runs. ``AS_OF`` stands for "now" in the order-based
relations and ``EVENT_NOW`` in the event-based ones; no query reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01 00:00:00"
EVENT_NOW = "2024-01-31 00:00:00"

# Domains in the order in which they sort.
PLACE_STATUS = ("pending_review", "active", "broken", "archived", "unsupported")
SOURCE_KIND = ("shulcloud_website", "website_llm", "email_newsletter", "manual")
REVIEW_STATUS = ("pending", "approved", "rejected")
RUN_STATUS = ("ok", "no_change", "broken", "error")
STRATEGY = ("html", "js_rendered", "pdf_document", "vision_image", "failed")
ANCHOR = ("shkia", "tzeis_72", "tzeis_42", "alos", "netz", "misheyakir", "sof_zman_shma_gra", "sof_zman_shma_mga", "sof_zman_tefillah_gra", "sof_zman_tefillah_mga", "chatzos", "mincha_gedolah", "plag_mincha", "candle_lighting")
TEFILLAH = ("shacharis", "mincha", "maariv", "selichos", "neilah", "other")
SPECIAL_KIND = ("regular", "yom_tov", "three_weeks", "aseres_yemei_teshuvah", "fast_day", "rosh_chodesh", "ad_hoc")
REPORT_STATUS = ("open", "resolved", "dismissed")
FRESH_DAYS = 14

# Domains that many places share: list mailers, mail providers, social and short links.
SHARED_DOMAINS = (
    "myshul.com", "mailchimp.com", "list-manage.com", "campaign-archive.com", "createsend.com", "mailerlite.com", "constantcontact.com", "rs6.net", "sendgrid.net", "sendgrid.com", "mailgun.org", "mailgun.com", "mailgun.net",
    "mandrillapp.com", "convertkit-mail.com", "beehiiv.net", "substack.com", "klaviyo.com", "cmail19.com", "cmail20.com", "gmail.com", "googlemail.com", "googlegroups.com", "yahoo.com", "ymail.com", "outlook.com", "hotmail.com",
    "live.com", "icloud.com", "me.com", "aol.com", "protonmail.com", "proton.me", "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "linkedin.com", "tiktok.com", "pinterest.com",
    "whatsapp.com", "wa.me", "t.me", "bit.ly", "tinyurl.com", "t.co", "goo.gl", "cloudfront.net", "akamaized.net",
)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents")

# @ago(days) is AS_OF minus that many days, @event_ago(days) likewise for events; see plans.dialect.
RELATIONS = {
    "place": """
SELECT CAST(c_custkey AS INT) AS id, lower(replace(c_name, '#', '-')) AS slug, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'pending_review' WHEN 'FURNITURE' THEN 'archived' WHEN 'HOUSEHOLD' THEN 'unsupported' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 40.0e0 + (c_custkey % 100) / 100.0e0 END AS lat,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE -74.5e0 + ((c_custkey * 37) % 100) / 100.0e0 END AS lng,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'America/Chicago' WHEN c_nationkey % 3 = 1 THEN 'America/New_York' ELSE 'Europe/London' END AS timezone,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('https://www.site', CAST(c_custkey % 300 AS VARCHAR(20)), '.org/times') END AS submitted_url,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(CAST(c_custkey AS VARCHAR(20)), ' Main St') END AS address,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'gmail.com' ELSE concat('site', CAST(c_custkey % 300 AS VARCHAR(20)), '.org') END AS match_domain,
  @ago(c_custkey % 90) AS submitted_at
FROM customer""",
    "source": """
SELECT CAST(o_orderkey AS INT) AS id, CAST(o_custkey AS INT) AS place_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'email_newsletter' ELSE 'website_llm' END AS kind,
  concat('src-', CAST(o_orderkey % 5 AS VARCHAR(20))) AS identifier,
  CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'pending' ELSE 'rejected' END AS review_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ok' WHEN '2-HIGH' THEN 'no_change' WHEN '3-MEDIUM' THEN 'broken' WHEN '5-LOW' THEN 'error' ELSE NULL END AS run_status,
  CASE o_orderkey % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'html' WHEN 2 THEN 'js_rendered' WHEN 3 THEN 'pdf_document' WHEN 4 THEN 'vision_image' ELSE NULL END AS strategy,
  CASE o_orderkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 40 ELSE 60 END AS priority,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE @ago(o_orderkey % 40) END AS last_run_at,
  CASE WHEN o_orderkey % 8 = 0 THEN @ago(o_orderkey % 10) ELSE NULL END AS last_received_at,
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN @ago(o_orderkey % 20 + 1) ELSE NULL END AS first_broken_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS built_at,
  (CAST(floor(o_totalprice * 100e0 + 0.5e0) AS BIGINT) % 100) / 100.0e0 AS confidence,
  CASE WHEN o_orderstatus <> 'P' THEN NULL ELSE CASE o_orderkey % 4 WHEN 0 THEN 'auto-rejected: no rules' WHEN 1 THEN 'Superseded by a newer build' WHEN 2 THEN 'rejected by admin' ELSE NULL END END AS reviewer_notes,
  concat('{"usage":{"', CASE WHEN o_orderkey % 2 = 0 THEN 'haiku' ELSE 'sonnet' END, '":{"inputTokens":', CAST(o_orderkey % 900 AS VARCHAR(20)), ',"outputTokens":', CAST(o_orderkey % 70 AS VARCHAR(20)), '}},"model":"', CASE WHEN o_orderkey % 2 = 0 THEN 'small-haiku' ELSE 'large' END, '","page_content_hash":"h', CAST(o_orderkey % 50 AS VARCHAR(20)), '"}') AS config_json,
  o_orderdate AS created_at
FROM orders""",
    "rule": """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(CAST(floor(l_extendedprice * 100e0 + 0.5e0) AS BIGINT) AS VARCHAR(20))) AS id,
  CAST(o_custkey AS INT) AS place_id, CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_orderkey AS INT) END AS source_id,
  CASE WHEN l_linenumber <= 2 THEN 'shacharis' WHEN l_linenumber <= 4 THEN 'mincha' WHEN l_linenumber <= 6 THEN 'maariv' ELSE 'other' END AS tefillah,
  CASE WHEN l_returnflag = 'R' THEN 'zmanim' ELSE 'fixed' END AS time_kind,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat(lpad(CAST(CAST(l_quantity AS INT) % 24 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(CAST(l_partkey % 12 * 5 AS INT) AS VARCHAR(20)), 2, '0')) END AS clock,
  CASE WHEN l_returnflag <> 'R' THEN NULL WHEN l_partkey % 3 = 0 THEN 'shkia' WHEN l_partkey % 3 = 1 THEN 'netz' ELSE 'plag_mincha' END AS anchor,
  CASE WHEN l_returnflag <> 'R' THEN NULL ELSE CAST(l_partkey % 7 * 5 - 15 AS INT) END AS offset_min,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 9 = 1 THEN '' WHEN l_partkey % 9 = 2 THEN '0,1,2,3,4,5,6' WHEN l_partkey % 9 = 3 THEN '1,2,3,4,5' WHEN l_partkey % 9 = 4 THEN '5,3,1,2,4' WHEN l_partkey % 9 = 5 THEN '1,2,3,4' WHEN l_partkey % 9 = 6 THEN '6' WHEN l_partkey % 9 = 7 THEN '4,0,1,2,3' ELSE '2,4' END AS days,
  CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) ELSE NULL END AS valid_from,
  CASE WHEN l_returnflag = 'A' AND l_partkey % 4 > 0 THEN CAST(l_shipdate AS DATE) + CAST(l_partkey % 60 AS INT) ELSE NULL END AS valid_to,
  CASE WHEN l_returnflag <> 'A' THEN 'regular' WHEN l_partkey % 2 = 0 THEN 'yom_tov' ELSE 'ad_hoc' END AS special_kind,
  CAST(l_partkey % 3 AS INT) AS priority, l_partkey % 11 = 0 AS is_manual_edit, l_linestatus = 'F' AND l_returnflag = 'N' AS is_deleted
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "run": """
SELECT CAST(event_id AS INT) AS id, CAST(user_id AS INT) AS place_id, CAST(event_id % 700 AS INT) AS source_id, ts AS started_at,
  CASE event_type WHEN 'view' THEN 'no_change' WHEN 'signup' THEN 'broken' WHEN 'error' THEN 'error' ELSE 'ok' END AS status, CAST(event_id % 9 AS INT) AS rules_added
FROM events""",
    "report": """
SELECT CAST(event_id AS INT) AS id, CAST(event_id % 20 AS INT) AS place_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 5000 AS INT) END AS rule_id,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(user_id AS INT) END AS reporter, CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'open' END AS status, ts AS created_at
FROM events""",
    "candidate": """
SELECT CAST(page_id AS INT) AS id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN page_id % 6 = 0 THEN NULL ELSE url END AS website,
  CASE page_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'deferred' ELSE 'pending' END AS review_status,
  CASE WHEN page_id % 8 = 0 THEN NULL ELSE concat('target-', CAST(page_id % 7 AS VARCHAR(20))) END AS target,
  CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 150 AS INT) ELSE NULL END AS linked_place_id, @event_ago(page_id % 4) AS reviewed_at, @event_ago(page_id % 50) AS created_at
FROM pages""",
    # What the tables above do not hold: pages, mail, results and the like that have the cases of their rules.
    "root": """
SELECT CAST(c_custkey AS INT) AS id, CASE c_custkey % 8 WHEN 0 THEN concat('https://www.site', CAST(c_custkey % 300 AS VARCHAR(9)), '.org/') WHEN 1 THEN concat('https://www.site', CAST(c_custkey % 300 AS VARCHAR(9)), '.org') WHEN 2 THEN 'not an address'
  WHEN 3 THEN concat('http://a.site', CAST(c_custkey % 300 AS VARCHAR(9)), '.co.uk/times?x=1') WHEN 4 THEN concat('gabbai@mail.site', CAST(c_custkey % 300 AS VARCHAR(9)), '.k12.nj.us') WHEN 5 THEN 'www.Facebook.com' WHEN 6 THEN NULL ELSE CASE c_custkey % 5 WHEN 0 THEN 'co.uk' WHEN 1 THEN concat('a.b.site', CAST(c_custkey % 300 AS VARCHAR(9)), '.c.kobe.jp') WHEN 2 THEN 'www.city.kobe.jp' WHEN 3 THEN concat('x.site', CAST(c_custkey % 300 AS VARCHAR(9)), '.ck') ELSE 'www.www.ck' END END AS submitted_url FROM customer""",
    "site": """
SELECT CAST(page_id AS INT) AS page_id, CASE page_id % 6 WHEN 0 THEN concat('https://www.site', CAST(page_id % 300 AS VARCHAR(9)), '.org/') WHEN 1 THEN concat('https://www.site', CAST((page_id - 1) % 300 AS VARCHAR(9)), '.org/davening-times')
    WHEN 2 THEN concat('https://cdn.site.org/poster', CAST(page_id % 9 AS VARCHAR(9)), '.png?v=', CAST(page_id AS VARCHAR(9)), '&t=20240', CAST(page_id % 3 AS VARCHAR(9)), '&cachebust=1&h=0123456789abcdefABCD') ELSE url END AS url,
  concat(html, CASE page_id % 7 WHEN 0 THEN '<a href="schedule">Davening  <b>Times</b></a><a href="#x">top</a><a href=''mailto:a@b.c''>mail</a><img id="poster" src="/files/week.jpg" alt="Minyan times"><img class="hero" src="/big.webp"><img src="/logo.png"><img src="data:x">'
    WHEN 1 THEN '<p>Shacharis 7:30 AM</p><p>Mincha 18:15</p><script>var a = "1:11";</script><a href="/files/Weekly-Times.pdf?x=1">week</a><a href="/donation.pdf">give</a>' WHEN 2 THEN '<script src="https://images.shulcloud.com/a.js"></script><footer>Powered by ShulCloud</footer><img src="//x.org/a/hero.png" alt="schedule">'
    WHEN 3 THEN '<meta name="generator" content="Wix.com Website Builder"><link href="https://static.parastorage.com/a.css"><svg><path/></svg><noscript>x</noscript>' WHEN 4 THEN '<p>Powered by ShulSpace</p><a href="?page=2">next</a><a href="//other.org/a">other</a><a href="times.html"> </a>' ELSE '' END) AS html
FROM pages""",
    "mail": """
SELECT CAST(page_id AS INT) AS id, concat(CASE page_id % 4 WHEN 0 THEN concat('From: Me <me@gmail.com>', chr(10), '---------- Forwarded message ---------', chr(10)) WHEN 1 THEN '' WHEN 2 THEN concat('Begin forwarded message:', chr(10), 'From: not an address', chr(10)) ELSE 'hello ' END,
  CASE page_id % 3 WHEN 0 THEN concat('From: "Jo B" <Jo@Site', CAST(page_id % 300 AS VARCHAR(9)), '.org>') WHEN 1 THEN concat('from: gabbai@site', CAST(page_id % 300 AS VARCHAR(9)), '.org') ELSE 'no sender' END, chr(10), 'see https://url77.myshul.com/ls/click?a=1, https://click.site.org/x and https://www.mailchimp.com/a ',
  CASE page_id % 5 WHEN 0 THEN 'https://site.org/banner.png' WHEN 1 THEN 'nothing' ELSE concat('(https://Www.Site', CAST(page_id % 300 AS VARCHAR(9)), '.co.uk/now).') END, ' and ', url, ' now') AS body FROM pages""",
    "listing": """
SELECT CAST(o_orderkey % 400 AS INT) AS page_id, CAST(o_orderkey AS INT) AS line_no, CASE o_orderkey % 11 WHEN 0 THEN 'Weekday davening' WHEN 1 THEN concat('Shacharis ', CAST(6 + o_orderkey % 3 AS VARCHAR(2)), ':', lpad(CAST(o_orderkey % 4 * 15 AS VARCHAR(2)), 2, '0'), ' AM Sunday') WHEN 2 THEN '12:15 p.m. Mincha'
  WHEN 3 THEN concat('Maariv ', CAST(o_orderkey % 40 AS VARCHAR(2)), ' minutes after sunset') WHEN 4 THEN 'Candle lighting 18 min before shkia  Friday' WHEN 5 THEN o_orderpriority WHEN 6 THEN 'Plag Mincha: 5 min prior to plag' WHEN 7 THEN 'Shabbos' WHEN 8 THEN '8:05 PM' WHEN 9 THEN 'Selichos 12:30 am Rosh Chodesh' ELSE '' END AS line FROM orders""",
    "attempt": """
SELECT CAST(l_orderkey AS INT) AS source_id, CAST(l_linenumber AS INT) AS pos, CASE l_linenumber WHEN 1 THEN 'html' WHEN 2 THEN 'js_rendered' WHEN 3 THEN 'vision_image' ELSE 'pdf_document' END AS strategy, CASE WHEN l_partkey % 3 = 0 THEN 'extracted' WHEN l_partkey % 3 = 1 THEN 'fetch_failed' ELSE 'skipped' END AS status,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 5 AS INT) ELSE 0 END AS rules, CASE WHEN l_partkey % 3 = 0 AND l_partkey % 12 > 0 THEN (l_suppkey % 100) / 100e0 END AS confidence, CASE l_partkey % 6 WHEN 1 THEN concat('status 503', chr(10), 'from host') WHEN 2 THEN '' WHEN 4 THEN lpad('x', 120, 'long ') END AS message,
  CASE WHEN l_orderkey % 4 = 0 THEN 'vision_image' END AS preferred FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "legacy": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CASE l_partkey % 8 WHEN 0 THEN 'shacharis' WHEN 1 THEN 'mincha' WHEN 2 THEN 'maariv' WHEN 3 THEN 'selichos' WHEN 4 THEN 'other' WHEN 5 THEN 'candles' WHEN 6 THEN 'havdalah' ELSE 'kiddush' END AS service,
  CASE l_suppkey % 11 WHEN 0 THEN 'sunday' WHEN 1 THEN 'monday' WHEN 2 THEN 'tuesday' WHEN 3 THEN 'wednesday' WHEN 4 THEN 'thursday' WHEN 5 THEN 'friday' WHEN 6 THEN 'shabbos' WHEN 7 THEN 'weekday' WHEN 8 THEN 'rosh_chodesh' WHEN 9 THEN 'yom_tov' ELSE 'specific_date' END AS day_rule,
  l_partkey % 5 > 0 AS enabled, CASE WHEN l_suppkey % 3 = 0 THEN 'shulcloud' END AS platform, CASE l_partkey % 7 WHEN 0 THEN 'relative_sunrise' WHEN 1 THEN 'relative_sunset' WHEN 2 THEN 'relative_plag' WHEN 3 THEN 'relative_chatzos' WHEN 4 THEN 'unknown' ELSE 'fixed' END AS old_kind,
  CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey % 40 - 20 AS INT) END AS offset_min, CASE WHEN l_partkey % 9 > 0 THEN '07:30' END AS old_clock FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "run_result": """
SELECT CAST(o_orderkey AS INT) AS source_id, CAST(o_orderkey % 7 AS BIGINT) AS prev, CAST(o_custkey % 6 AS BIGINT) AS now, (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100e0 AS confidence FROM orders""",
    "page_state": "SELECT CAST(o_orderkey AS INT) AS source_id, concat('h', CAST(o_custkey % 50 AS VARCHAR(9))) AS hash FROM orders",
    "model_result": "SELECT CAST(o_orderkey AS INT) AS source_id, (CAST(floor(o_totalprice * 100e0 + 0.5e0) AS BIGINT) % 100) / 100e0 AS cheap, CAST(o_orderkey % 4 AS INT) AS cheap_rules, (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100e0 AS strong FROM orders",
    # A model's answers: in fences, within words, bare; without an object, with NaN, out of range, as a list. A second rule has a clock that is none.
    "model_text": """
SELECT id, concat(CASE id % 8 WHEN 0 THEN concat('```json', chr(10)) WHEN 1 THEN 'Here it is: ' WHEN 7 THEN '[' ELSE '' END, CASE WHEN id % 8 = 3 THEN 'no {object' ELSE concat('{"confidence": ', CASE id % 8 WHEN 4 THEN 'NaN' WHEN 5 THEN '1.5' ELSE concat('0.', lpad(CAST(id % 100 AS VARCHAR(2)), 2, '0')) END, ', "reasoning": "a \\"}\\" b", "rules": [', rules, ']}') END,
  CASE id % 8 WHEN 0 THEN concat(chr(10), '```') WHEN 1 THEN ' and {"more": 1}' WHEN 7 THEN ']' ELSE '' END) AS text
FROM (SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{"tefillah": "mincha", "time": {"kind": "zmanim", "anchor": "shkia", "offsetMin": -15}, "daysOfWeek": [0, 6]}'
  ELSE '{"tefillah": "mincha", "time": {"kind": "fixed", "clock": "7:30"}}, {"tefillah": "maariv", "time": {"kind": "fixed", "clock": "late"}}' END AS rules FROM orders)""",
    "rule_report": "SELECT id AS id, CASE WHEN priority = 1 THEN place_id + 1 ELSE place_id END AS place_id, CASE WHEN tefillah = 'other' THEN NULL WHEN offset_min = 0 THEN 'no such rule' ELSE id END AS rule_id FROM rule",
    "target": "SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, CAST(s_nationkey % 5 AS INT) AS region, CAST(s_suppkey % 3 AS INT) AS tier FROM supplier",
    "target_filter": "SELECT CAST(n_nationkey AS INT) AS id, CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_regionkey AS INT) END AS region, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey % 4 AS INT) END AS tier, CASE WHEN n_nationkey % 7 = 6 THEN 'no such name' ELSE 'all' END AS name FROM nation",
    "geo_part": """
SELECT CAST(l_orderkey % 900 AS INT) AS place_id, CAST(l_orderkey AS INT) AS result_no, CAST(l_linenumber AS INT) AS part_no, @list(CASE l_partkey % 5 WHEN 0 THEN 'locality' WHEN 1 THEN 'administrative_area_level_1' WHEN 2 THEN 'route' WHEN 3 THEN 'postal_town' ELSE 'country' END, 'political') AS types,
  concat('Town ', CAST(l_partkey AS VARCHAR(9))) AS long_name, concat('T', CAST(l_partkey % 50 AS VARCHAR(9))) AS short_name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "place_hit": """
SELECT CAST(l_orderkey % 1200 AS INT) AS place_id, concat('Beth Israel of Town-', CAST(l_orderkey % 20 AS VARCHAR(9))) AS wanted, concat('bethisrael', CAST(l_orderkey % 20 AS VARCHAR(9)), '.org') AS host, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos,
  CASE l_partkey % 4 WHEN 0 THEN 'Beth Israel' WHEN 1 THEN concat('Israel Center Town-', CAST(l_partkey % 20 AS VARCHAR(9))) WHEN 2 THEN 'Pizza' END AS name, concat(CAST(l_partkey AS VARCHAR(9)), ' Bethisrael', CAST(l_partkey % 20 AS VARCHAR(9)), ' Road') AS address,
  @list(CASE l_partkey % 7 WHEN 0 THEN 'synagogue' WHEN 1 THEN 'place_of_worship' WHEN 2 THEN 'religious_organization' ELSE 'store' END, 'point_of_interest') AS types FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    "ip_address": """
SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN concat('::FFFF:', CAST(event_id % 256 AS VARCHAR(3)), '.', CAST(event_id % 199 AS VARCHAR(3)), '.0.1') WHEN 1 THEN CASE event_id % 5 WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::1' WHEN 2 THEN 'FD00::2' WHEN 3 THEN '2001:db8::1' ELSE '::' END
  WHEN 2 THEN concat(CASE event_id % 4 WHEN 0 THEN '172.' WHEN 1 THEN '100.' WHEN 2 THEN '169.' ELSE '192.' END, CAST(event_id % 260 AS VARCHAR(3)), '.9.9') ELSE concat(CAST(event_id % 300 AS VARCHAR(3)), '.', CAST(event_id % 199 AS VARCHAR(3)), '.0.', CAST(user_id % 200 AS VARCHAR(3))) END AS ip FROM events""",
    "change": """
SELECT CAST(o_orderkey AS INT) AS id, concat(CASE o_orderkey % 5 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'Fix(feed): ' WHEN 2 THEN 'chore(x): ' WHEN 3 THEN 'feature: ' ELSE '' END, lower(o_orderpriority), ' work') AS subject FROM orders""",
    "notes": """
SELECT concat('notes-', CAST(o_custkey AS VARCHAR(20))) AS file, CAST(o_orderkey AS INT) AS line_no, CASE WHEN o_orderkey % 10 = 3 THEN concat('## v', CAST(o_orderkey % 400 AS INT), ' — 2024-01-01') WHEN o_orderkey % 10 = 4 THEN '### Fixes & more ' WHEN o_orderkey % 10 = 6 THEN '### Features' WHEN o_orderkey % 11 = 3 THEN '' WHEN o_orderkey % 3 = 0 THEN concat('- ', o_orderpriority) WHEN o_orderkey % 3 = 1 THEN '   goes on' ELSE 'plain words' END AS line
FROM orders""",
    "address_page": """
SELECT CAST(l_orderkey AS INT) AS place_id, CAST(l_linenumber AS INT) AS pos, concat('https://site.org/', CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'contact' WHEN 2 THEN 'contact-us' WHEN 3 THEN 'about' ELSE 'directions' END) AS url, CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 100) / 100e0 END AS confidence, CAST(l_partkey AS BIGINT) AS tokens_in, CAST(l_suppkey AS BIGINT) AS tokens_out
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    # Outlines of zones, a row a ring: eight-cornered stars, some with a hole and a part of their own.
    "outline": """
SELECT rank, zone, ring, @list(x + r * 1.0e0, x + r * 0.4e0, x, x - r * 0.3e0, x - r, x - r * 0.45e0, x + r * 0.1e0, x + r * 0.5e0) AS xs, @list(y, y + r * 0.3e0, y + r, y + r * 0.35e0, y - r * 0.1e0, y - r * 0.4e0, y - r * 0.95e0, y - r * 0.3e0) AS ys
FROM (SELECT CAST(n_nationkey AS INT) + 1 AS rank, concat('Zone/', n_name) AS zone, ring, -74.5e0 + (n_nationkey * 37 % 100) / 100e0 + shift * 0.3e0 AS x, 40e0 + (n_nationkey * 61 % 100) / 100e0 AS y, (0.0803e0 + n_nationkey % 5 * 0.0611e0) * scale AS r
  FROM nation CROSS JOIN (VALUES (1, 1e0, 0e0), (2, 0.37e0, 0e0), (3, 0.53e0, 1e0)) AS v(ring, scale, shift) WHERE ring = 1 OR n_nationkey % 3 = 0 AND ring = 2 OR n_nationkey % 4 = 1 AND ring = 3)""",
    # Chains of redirects: an order's lines one after the other, some in a ring, some to a private host.
    "response": """
SELECT concat('https://s', CAST(o AS VARCHAR(20)), '.example.org/p', CAST(k AS VARCHAR(9))) AS url, agent,
  CASE WHEN agent = 'proxy' THEN CASE WHEN o % 64 < 32 THEN 200 ELSE 502 END WHEN k < n OR o % 13 = 0 THEN 302 WHEN agent = 'own' AND o % 8 IN (1, 2) THEN 403 WHEN agent = 'own' AND o % 8 = 3 THEN 406 WHEN agent = 'browser' AND o % 8 IN (1, 3) THEN 403 WHEN o % 19 = 5 THEN 500 ELSE 200 END AS status,
  CASE WHEN agent = 'proxy' THEN NULL WHEN k < n AND o % 17 = 0 AND k = 2 THEN 'http://10.0.0.9/x' WHEN k < n THEN concat(CASE k % 4 WHEN 0 THEN '../x/../p' WHEN 1 THEN './p' WHEN 2 THEN concat('HTTPS://S', CAST(o AS VARCHAR(20)), '.example.org:443/p') ELSE '/p' END, CAST(k + 1 AS VARCHAR(9))) WHEN o % 13 = 0 THEN '/p1' END AS location,
  concat('<p>page ', CAST(o AS VARCHAR(20)), ' by ', agent, '</p>') AS body, CASE WHEN agent = 'own' AND k = 1 AND o % 5 = 0 THEN concat('<p>rendered ', CAST(o AS VARCHAR(20)), '</p>') END AS rendered
FROM (SELECT o, k, n, agent FROM (SELECT o, CAST(row_number() OVER (PARTITION BY o ORDER BY line) AS INT) AS k, CAST(count(*) OVER (PARTITION BY o) AS INT) AS n FROM (SELECT l_orderkey AS o, l_linenumber AS line FROM lineitem GROUP BY l_orderkey, l_linenumber)) CROSS JOIN (VALUES ('own'), ('browser'), ('proxy')) AS a(agent))
WHERE CASE WHEN agent = 'proxy' THEN k = 1 AND o % 3 > 0 ELSE k < n OR o % 23 <> 4 END""",
    "request": "SELECT DISTINCT concat('https://s', CAST(l_orderkey AS VARCHAR(20)), '.example.org/p1') AS url FROM lineitem",
    # Rules of public suffixes, with their wildcards and exceptions; users put a whole list in their place (``sources.io.suffixes``).
    "suffix": "SELECT name FROM (VALUES ('com'), ('org'), ('uk.com'), ('*.ck'), ('!www.ck'), ('jp'), ('ac.jp'), ('kyoto.jp'), ('ide.kyoto.jp'), ('*.kobe.jp'), ('!city.kobe.jp'), ('us'), ('ak.us'), ('k12.ak.us'), ('co.uk'), ('org.uk'), ('ac.uk'), ('co.il'), ('org.il'), ('ac.il'), ('com.au'), ('org.au'), ('co.za'), ('org.za'), ('com.br'), ('com.mx'), ('co.nz'), ('org.nz'), ('k12.nj.us'), ('k12.ny.us')) AS v(name)",
    "shared_domain": f"SELECT domain FROM (VALUES {', '.join(f"('{x}')" for x in SHARED_DOMAINS)}) AS v(domain)",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Base tables as temporary views; relations are common table expressions over them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def relation(spark: SparkSession, name: str) -> DataFrame:
    """One relation over the registered base tables."""
    from gnomon.plans.dialect import spark_sql

    return spark.sql(spark_sql(RELATIONS[name]))
