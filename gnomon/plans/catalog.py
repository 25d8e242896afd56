"""The engine's queries over places, sources, rules, runs, reports and candidates, by name.

Each is one declarative statement; Catalyst plans the joins, windows and pushdowns. The
same text, spelled for another engine, is the query's meaning in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gnomon.functions import markup, model_output
from gnomon.plans import fetch, ingest, pages, schedule
from gnomon.plans.dialect import duck_sql, spark_sql, with_relations
from gnomon.plans.schedule import DAYS_KEY, FRESH, PUBLIC, VISIBLE
from gnomon.sources.model import REVIEW_STATUS, TEFILLAH, register
from gnomon.streaming import limits

LIVE = "coalesce(s.review_status = 'approved' AND s.run_status IN ('ok', 'no_change') AND coalesce(s.last_received_at, s.last_run_at) >= @ago(14), false)"
TEF = ", ".join(f"'{x}'" for x in TEFILLAH)
REV = ", ".join(f"'{x}'" for x in REVIEW_STATUS)
HERE_LAT, HERE_LNG = "40.3e0", "-74.1e0"
# Great-circle miles on a sphere of 3958.8 miles.
MILES = "round(2e0 * 3958.8e0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2e0), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2e0), 2))), 3)"
DISTANCE = MILES.format(a=HERE_LAT, b="p.lat", c=HERE_LNG, d="p.lng")
STATE = f"""source_state AS (SELECT s.place_id, count(*) AS n_sources,
  max(CASE WHEN s.review_status = 'approved' AND s.run_status IN ('ok', 'no_change') THEN coalesce(s.last_received_at, s.last_run_at) END) AS last_fresh_at,
  coalesce(bool_or(s.review_status = 'pending' AND NOT coalesce(s.strategy = 'failed', false)), false) AS has_pending,
  coalesce(bool_or(s.review_status = 'approved'), false) AS has_approved, coalesce(bool_or(s.review_status = 'rejected'), false) AS has_rejected,
  coalesce(NOT bool_or(s.review_status = 'approved' AND s.run_status IN ('ok', 'no_change') AND coalesce(s.last_received_at, s.last_run_at) >= @ago(14)), false) AS has_broken_run,
  min(CASE WHEN s.review_status <> 'rejected' THEN s.first_broken_at END) AS first_broken_at,
  count(*) FILTER (WHERE s.review_status = 'pending' AND NOT coalesce(s.strategy = 'failed', false)) AS pending_count
  FROM source s GROUP BY s.place_id)"""
ADMIN = f"""{STATE}, admin AS (SELECT p.id, p.slug, p.status, p.submitted_at, x.pending_count, x.last_fresh_at, x.first_broken_at, coalesce(x.n_sources, 0) AS n_sources, coalesce(x.has_approved, false) AS has_approved,
  CASE WHEN p.status = 'archived' THEN 'archived' WHEN p.status = 'unsupported' THEN 'unsupported' WHEN coalesce(x.has_pending, false) THEN 'pending_review'
    WHEN coalesce(x.has_broken_run, false) THEN 'broken' WHEN x.n_sources IS NULL THEN 'awaiting_extraction' WHEN NOT x.has_approved AND x.has_rejected THEN 'no_good_source'
    WHEN x.has_approved AND (x.last_fresh_at IS NULL OR x.last_fresh_at < @ago(14)) THEN 'stale' WHEN x.has_approved THEN 'active' ELSE 'no_good_source' END AS state
  FROM place p LEFT JOIN source_state x ON x.place_id = p.id)"""
INBOX = "('pending_review', 'broken', 'awaiting_extraction', 'no_good_source', 'stale', 'unsupported')"

TEXT: dict[str, str] = {}
Q = TEXT.__setitem__

# ---- projections, filters, predicates ----
Q("count_places_by_status", "SELECT status, count(*) AS n FROM place GROUP BY status")
Q("fresh_sources", f"SELECT s.id, s.place_id, coalesce(s.last_received_at, s.last_run_at) AS fresh_at FROM source s WHERE {FRESH}")
Q("visible_places", f"WITH {VISIBLE} SELECT id, slug, name FROM visible")
Q("lookup_places", f"WITH {VISIBLE} SELECT slug, name, address FROM visible")
Q("search_places", f"WITH {VISIBLE} SELECT id, slug, name FROM visible WHERE name ILIKE '%00012%' OR slug ILIKE '%00012%' ORDER BY name, id LIMIT 30")
Q("search_gate", "SELECT q, @len(q) >= 2 AS searched FROM (SELECT DISTINCT trim(lower(l_returnflag || l_linestatus)) AS q FROM lineitem)")
Q("place_by_slug", "SELECT id, slug, name, lat, lng FROM place WHERE slug = 'customer-000000042'")
Q("source_by_id", "SELECT id, place_id, kind, identifier FROM source WHERE id = 77")
Q("live_rules_of_place", f"SELECT r.id, r.tefillah, r.priority, r.valid_from, CAST(row_number() OVER (ORDER BY r.priority DESC, @ordinal(r.tefillah, {TEF}), r.valid_from ASC NULLS LAST, r.id) AS BIGINT) AS place FROM rule r WHERE r.place_id = 7 AND NOT r.is_deleted")
Q("has_fresh_source", f"SELECT p.id, count(s.id) > 0 AS is_fresh FROM place p LEFT JOIN source s ON s.place_id = p.id AND {FRESH} GROUP BY p.id")
Q("last_successful_run", "SELECT place_id, max(last_run_at) AS last_ok FROM source WHERE run_status IN ('ok', 'no_change') AND last_run_at IS NOT NULL GROUP BY place_id")
Q("source_halves", f"""SELECT s.id, CASE WHEN NOT coalesce(s.strategy = 'failed', false) AND (s.review_status = 'pending' OR {LIVE}) THEN 'active'
  WHEN coalesce(s.strategy = 'failed', false) OR s.review_status = 'rejected' OR (s.review_status = 'approved' AND NOT {LIVE}) THEN 'demoted' END AS half FROM source s""")
Q("reviewed_candidates", "SELECT id, host, review_status FROM candidate WHERE review_status IN ('approved', 'rejected', 'duplicate') AND target = 'target-3' AND website IS NOT NULL")
Q("rejected_by_note", "SELECT id, reviewer_notes FROM source WHERE review_status = 'rejected' AND (reviewer_notes ILIKE 'auto-rejected%' OR reviewer_notes ILIKE 'superseded%' OR reviewer_notes ILIKE 'rejected by%')")
Q("weekly_worklist", "SELECT p.id AS place_id, s.id AS source_id FROM place p JOIN source s ON s.place_id = p.id WHERE p.status <> 'archived' AND s.review_status = 'approved'")
Q("daily_worklist", """SELECT p.id AS place_id, s.id AS source_id FROM place p JOIN source s ON s.place_id = p.id WHERE p.status <> 'archived' AND s.review_status = 'approved'
  AND s.strategy IN ('vision_image', 'pdf_document') AND (s.run_status IN ('ok', 'no_change') OR coalesce(s.first_broken_at, s.last_run_at) >= @ago(14))""")
Q("stranded_sources", """SELECT p.id AS place_id, s.id AS source_id FROM place p JOIN source s ON s.place_id = p.id WHERE s.run_status = 'broken' AND s.review_status = 'pending'
  AND p.status = 'pending_review' AND coalesce(s.strategy, 'html') <> 'failed' ORDER BY p.id, s.id LIMIT 50""")
Q("inspect_sources", "SELECT s.id, p.slug, s.identifier, s.built_at FROM source s JOIN place p ON p.id = s.place_id WHERE p.slug ILIKE '%99%' OR p.name ILIKE '%99%' OR s.identifier ILIKE '%99%' ORDER BY s.built_at DESC NULLS LAST, s.id LIMIT 5")
Q("resource_backfill_list", "SELECT id FROM source WHERE @json(config_json, '$.last_extracted_resource') IS NULL AND strategy IN ('pdf_document', 'vision_image') OR identifier <> coalesce(@json(config_json, '$.submitted_url'), identifier)")
Q("missing_attributes", "SELECT id, lat IS NOT NULL AND timezone IS NULL AS needs_timezone, address IS NOT NULL AND lat IS NULL AND status IN ('active', 'pending_review') AS needs_location, submitted_url IS NOT NULL AND lat IS NULL AS needs_address, match_domain IS NULL AS needs_domain FROM place")
Q("refire_cooldown", "SELECT p.id, EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND s.last_run_at > @now() - @minutes(4320)) AS suppressed FROM place p")
Q("admin_listing", "SELECT id, name, status FROM place WHERE name ILIKE '%1%' AND status = 'active' ORDER BY name, id LIMIT 200")
Q("tefillah_chips", f"WITH {PUBLIC} SELECT place_id, tefillah, n, n_all >= 3 AS shown FROM (SELECT place_id, tefillah, count(*) AS n, sum(count(*)) OVER (PARTITION BY place_id) AS n_all FROM public_rule GROUP BY place_id, tefillah)")

# ---- joins ----
Q("stale_places", f"SELECT p.id FROM place p WHERE p.status = 'active' AND NOT EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND {FRESH})")
Q("broken_lane", f"""SELECT p.id FROM place p WHERE p.status <> 'archived' AND p.submitted_url IS NOT NULL AND EXISTS (SELECT 1 FROM source a WHERE a.place_id = p.id AND a.review_status = 'approved')
  AND NOT EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND {FRESH}) ORDER BY p.id LIMIT 100""")
Q("sibling_sources", "SELECT id, place_id, identifier FROM (SELECT *, count(*) OVER (PARTITION BY place_id, identifier) AS n FROM source WHERE review_status <> 'rejected') WHERE n > 1")
Q("rejected_sources", "SELECT s.id, p.slug, s.built_at FROM source s JOIN place p ON p.id = s.place_id WHERE s.review_status = 'rejected'")
Q("rules_with_source", "SELECT r.id, r.place_id, s.id AS source_id, coalesce(s.priority, 0) AS priority FROM rule r LEFT JOIN source s ON s.id = r.source_id WHERE NOT r.is_deleted AND (s.id IS NULL OR s.review_status <> 'rejected')")
Q("candidates_with_place", "SELECT c.id, c.host, p.slug FROM candidate c LEFT JOIN place p ON p.id = c.linked_place_id")
Q("recent_reviews", "SELECT c.id, p.slug, c.reviewed_at FROM candidate c JOIN place p ON p.id = c.linked_place_id WHERE c.reviewed_at > @event_ago(1) ORDER BY c.reviewed_at DESC, c.id LIMIT 20")
Q("top_source", "SELECT place_id, id AS source_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY priority DESC, built_at DESC NULLS LAST, id DESC) AS rn FROM source) WHERE rn = 1")
Q("last_verified", "WITH v AS (SELECT place_id, max(coalesce(last_received_at, last_run_at)) AS verified_at FROM source WHERE review_status = 'approved' AND run_status IN ('ok', 'no_change') GROUP BY place_id) SELECT p.id, v.verified_at FROM place p LEFT JOIN v ON v.place_id = p.id")
Q("failed_approvals", """SELECT c.id, CASE WHEN c.linked_place_id IS NULL THEN 'not_linked' WHEN p.id IS NULL THEN 'place_missing' WHEN p.submitted_url IS NULL THEN 'no_url'
  WHEN NOT EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id) THEN 'no_source' WHEN NOT EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND NOT coalesce(s.strategy = 'failed', false)) THEN 'extraction_failed' ELSE 'ok' END AS failure_reason
  FROM candidate c LEFT JOIN place p ON p.id = c.linked_place_id WHERE c.review_status = 'approved'""")
Q("exact_url_duplicates", "SELECT p.id FROM place p WHERE EXISTS (SELECT 1 FROM place o WHERE o.submitted_url = p.submitted_url AND o.id < p.id)")
Q("review_payload", "SELECT s.id, p.slug, r.id AS rule_id, r.tefillah FROM source s JOIN place p ON p.id = s.place_id LEFT JOIN rule r ON r.source_id = s.id AND NOT r.is_deleted")
Q("open_reports", "SELECT t.id, p.slug, t.created_at FROM report t JOIN place p ON p.id = t.place_id WHERE t.status = 'open' ORDER BY t.created_at DESC, t.id LIMIT 100")
Q("evening_worklist", """SELECT DISTINCT p.id AS place_id, s.id AS source_id, count(CASE WHEN r.tefillah IN ('mincha', 'maariv') AND r.time_kind = 'fixed' THEN 1 END) OVER (PARTITION BY s.id) AS fixed_evening
  FROM place p JOIN source s ON s.place_id = p.id JOIN rule r ON r.source_id = s.id WHERE p.status = 'active' AND s.review_status = 'approved' AND NOT r.is_deleted""")

# ---- aggregations ----
Q("sources_and_rules", "WITH n AS (SELECT place_id, count(*) AS n_sources FROM source GROUP BY place_id), m AS (SELECT place_id, count(*) AS n_rules FROM rule WHERE NOT is_deleted GROUP BY place_id) SELECT p.id, coalesce(n.n_sources, 0) AS n_sources, coalesce(m.n_rules, 0) AS n_rules FROM place p LEFT JOIN n ON n.place_id = p.id LEFT JOIN m ON m.place_id = p.id")
Q("source_state", f"WITH {STATE} SELECT * FROM source_state")
Q("source_state_of_place", f"WITH {STATE} SELECT * FROM source_state WHERE place_id = 31")
Q("pending_source", "SELECT place_id, id AS pending_id FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY built_at DESC NULLS LAST, id DESC) AS rn FROM source WHERE review_status = 'pending' AND NOT coalesce(strategy = 'failed', false)) WHERE rn = 1")
Q("run_status_counts", "SELECT status, count(*) AS n FROM run WHERE started_at >= @event_now() - @minutes(2880) AND started_at < @event_now() GROUP BY status")
Q("global_counts", f"""SELECT (SELECT count(*) FROM place WHERE status = 'active') AS active_places, (SELECT count(*) FROM place p WHERE p.status = 'active' AND NOT EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND {FRESH})) AS stale_active,
  (SELECT count(*) FROM report WHERE status = 'open') AS open_reports""")
Q("candidate_counts", "SELECT 'status' AS what, review_status AS value, count(*) AS n FROM candidate GROUP BY review_status UNION ALL SELECT 'target', target, count(*) FROM candidate WHERE target IS NOT NULL GROUP BY target")
Q("rejection_buckets", "SELECT CASE WHEN reviewer_notes ILIKE 'auto-rejected%' THEN 'auto-rejected' WHEN reviewer_notes ILIKE 'superseded%' THEN 'superseded' WHEN reviewer_notes ILIKE 'rejected by%' THEN 'admin' ELSE 'other' END AS bucket, count(*) AS n FROM source WHERE review_status = 'rejected' GROUP BY 1")
Q("dup_approved", "SELECT place_id, count(*) AS n FROM source WHERE review_status = 'approved' AND run_status = 'ok' GROUP BY place_id HAVING count(*) > 1")
Q("dup_identifiers", "SELECT place_id, identifier, count(*) AS n FROM source WHERE review_status <> 'rejected' GROUP BY place_id, identifier HAVING count(*) > 1")
Q("dup_sanity", "SELECT count(*) AS n_groups FROM (SELECT place_id FROM source WHERE review_status = 'approved' AND run_status = 'ok' GROUP BY place_id HAVING count(*) > 1)")
Q("strategy_audit", "SELECT count(*) AS total, count(*) FILTER (WHERE strategy = 'html') AS html, count(*) FILTER (WHERE strategy IS NULL) AS missing FROM source WHERE kind = 'website_llm'")
Q("load_summary", "SELECT count(DISTINCT place_id) AS places, count(*) AS sources, (SELECT count(*) FROM rule) AS rules, (SELECT count(*) FROM rule WHERE is_deleted) AS dropped FROM source")
Q("live_rules_per_source", "SELECT source_id, count(*) AS n FROM rule WHERE NOT is_deleted AND source_id IS NOT NULL GROUP BY source_id")
Q("lane_counts", f"WITH {ADMIN} SELECT CASE WHEN has_approved THEN 'broken' ELSE 'new' END AS lane, count(*) AS n FROM admin WHERE state IN {INBOX} GROUP BY 1")
Q("mean_confidence", "SELECT place_id, round(coalesce(avg(confidence), 0e0), 6) AS mean_confidence FROM source GROUP BY place_id")
Q("broken_age", "SELECT id, days_broken, CASE WHEN days_broken < 7 THEN 'NEW' ELSE 'CHRONIC' END AS age FROM (SELECT id, CAST(floor((@epoch(@now()) - @epoch(first_broken_at)) / 86400e0) AS BIGINT) AS days_broken FROM source WHERE first_broken_at IS NOT NULL)")
Q("discovery_counts", "WITH f AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY id) AS rn FROM candidate) SELECT coalesce(target, 'total') AS target, count(*) AS results, count(*) FILTER (WHERE rn = 1) AS added, count(*) FILTER (WHERE rn > 1) AS duplicates FROM f WHERE target IS NOT NULL GROUP BY GROUPING SETS ((target), ())")

# ---- windows, order ----
Q("public_rules_dedup", f"WITH {PUBLIC} SELECT id, place_id, source_id, tefillah, time_kind, clock, {DAYS_KEY} AS days_key FROM public_rule r")
Q("source_winner", "SELECT id, place_id, first_value(id) OVER w AS winner_id, CAST(row_number() OVER w AS BIGINT) AS rn FROM source WHERE review_status = 'approved' AND run_status = 'ok' WINDOW w AS (PARTITION BY place_id ORDER BY priority DESC, coalesce(last_run_at, TIMESTAMP '1970-01-01 00:00:00') DESC, id DESC)")
Q("cross_status_winner", "SELECT id, place_id, identifier, CAST(row_number() OVER (PARTITION BY place_id, identifier ORDER BY CASE WHEN review_status = 'approved' THEN 0 ELSE 1 END, priority DESC, coalesce(last_run_at, TIMESTAMP '1970-01-01 00:00:00') DESC, id DESC) AS BIGINT) AS rn FROM source WHERE review_status <> 'rejected'")
Q("fixed_evening_counts", "SELECT id, source_id, count(CASE WHEN tefillah IN ('mincha', 'maariv') AND time_kind = 'fixed' THEN 1 END) OVER (PARTITION BY source_id) AS n FROM rule WHERE source_id IS NOT NULL AND NOT is_deleted")
Q("runs_of_place", "SELECT id, status, started_at FROM run WHERE place_id = 12 ORDER BY started_at DESC, id DESC LIMIT 20")
Q("pending_candidates", "SELECT id, host, created_at FROM candidate WHERE review_status = 'pending' ORDER BY created_at DESC, id LIMIT 200")
Q("context_lines", r"SELECT page_id, line_no, line, concat_ws(' | ', lag(line) OVER w, line, lead(line) OVER w) AS context FROM (SELECT o_orderkey % 500 AS page_id, o_orderkey AS line_no, o_orderpriority || ' ' || o_orderstatus AS line FROM orders) WINDOW w AS (PARTITION BY page_id ORDER BY line_no)")
Q("best_of_key", "SELECT id, place_id, strategy, confidence FROM (SELECT *, row_number() OVER (PARTITION BY place_id, strategy ORDER BY confidence DESC, id) AS rn FROM source) WHERE rn = 1")

# ---- state, lanes ----
Q("admin_state", f"WITH {ADMIN} SELECT id, state, state IN {INBOX} AS inbox FROM admin")
Q("admin_feed", f"""WITH {ADMIN} SELECT id, slug, state, lane FROM (SELECT *, CASE WHEN has_approved THEN 'broken' ELSE 'new' END AS lane FROM admin WHERE state IN {INBOX})
  ORDER BY lane DESC, CASE WHEN lane = 'new' THEN @epoch(submitted_at) ELSE -coalesce(@epoch(coalesce(first_broken_at, last_fresh_at)), 0) END, id LIMIT 5000""")
Q("state_labels", f"""WITH {ADMIN} SELECT id, state, CASE state WHEN 'archived' THEN 'Archived' WHEN 'unsupported' THEN 'Try a different source URL' WHEN 'broken' THEN 'Investigate broken extraction' WHEN 'pending_review' THEN CASE WHEN pending_count = 1 THEN 'Review 1 new extraction' ELSE concat('Review ', CAST(pending_count AS VARCHAR(9)), ' new extractions') END
    WHEN 'no_good_source' THEN 'No good source — triage' WHEN 'awaiting_extraction' THEN 'Awaiting extraction' WHEN 'stale' THEN 'Stale — re-extract (14d+)' ELSE 'Active' END AS label,
  CASE WHEN state IN ('archived', 'unsupported') THEN 'blocked' WHEN state IN ('broken', 'no_good_source', 'stale') THEN 'broken' WHEN state IN ('pending_review', 'awaiting_extraction') THEN 'pending' ELSE 'ok' END AS tier, state NOT IN ('active', 'archived') AS inbox FROM admin""")
Q("state_urgency", f"WITH {ADMIN} SELECT state, CASE state WHEN 'pending_review' THEN 0 WHEN 'broken' THEN 1 WHEN 'no_good_source' THEN 2 WHEN 'stale' THEN 3 WHEN 'awaiting_extraction' THEN 4 WHEN 'active' THEN 5 WHEN 'unsupported' THEN 6 ELSE 7 END AS urgency, count(*) AS n FROM admin GROUP BY state")
# The digest's lines: runs by status, sources broken within a week, those broken for longer.
Q("digest_lines", """WITH broken AS (SELECT s.id, coalesce(s.strategy, '—') AS strategy, p.name, p.slug, CAST(floor((@epoch(@now()) - @epoch(s.first_broken_at)) / 86400e0) AS BIGINT) AS days FROM source s JOIN place p ON p.id = s.place_id WHERE s.run_status = 'broken' AND s.first_broken_at IS NOT NULL)
  SELECT 1 AS section, status AS about, concat(status, ': ', CAST(count(*) AS VARCHAR(20))) AS line FROM run GROUP BY status
  UNION ALL SELECT CASE WHEN days < 7 THEN 2 ELSE 3 END, CAST(id AS VARCHAR(20)), concat('[', strategy, '] ', name, CASE WHEN days < 7 THEN ' (broken ' ELSE ' (' END, CAST(days AS VARCHAR(9)), 'd) /admin/', slug) FROM broken""")
Q("digest", f"""WITH {ADMIN}, c AS (SELECT status, count(*) AS n FROM run GROUP BY status), t AS (SELECT coalesce(sum(n), 0) AS total FROM c)
  SELECT CASE WHEN t.total = 0 THEN 'ALERT: no runs' ELSE concat('runs ', CAST(CAST(t.total AS BIGINT) AS VARCHAR(20)), ', broken ', CAST((SELECT count(*) FROM admin WHERE state = 'broken') AS VARCHAR(20))) END AS line, (SELECT count(*) FROM source WHERE first_broken_at >= @ago(7)) >= 5 AS mass_breakage FROM t""")

# ---- time and schedule ----
Q("local_dow", "SELECT p.id, s.id AS source_id, CAST(@local(s.created_at, coalesce(p.timezone, 'America/New_York')) AS DATE) AS local_date, @dow(CAST(@local(s.created_at, coalesce(p.timezone, 'America/New_York')) AS DATE)) AS dow FROM source s JOIN place p ON p.id = s.place_id")
Q("clock_label", "SELECT DISTINCT o_orderdate AS at, @time12(@local(o_orderdate, 'America/New_York')) AS label FROM orders")
Q("distance_label", f"""SELECT id, CASE WHEN miles < 0.1e0 THEN concat(CAST(CAST(floor(miles * 1609.344e0 + 0.5e0) AS BIGINT) AS VARCHAR(9)), ' m') WHEN miles < 10e0 THEN concat(CAST(CAST(floor(miles * 10e0 + 0.5e0) AS BIGINT) / 10 AS VARCHAR(1)), ' mi') ELSE concat(CAST(CAST(floor(miles + 0.5e0) AS BIGINT) AS VARCHAR(9)), ' mi') END AS label
  FROM (SELECT p.id, {DISTANCE} AS miles FROM place p WHERE p.lat IS NOT NULL)""".replace("CAST(CAST(floor(miles * 10e0 + 0.5e0) AS BIGINT) / 10 AS VARCHAR(1))", "CAST(CAST(floor(floor(miles * 10e0 + 0.5e0) / 10e0) AS BIGINT) AS VARCHAR(9)), '.', CAST(CAST(floor(miles * 10e0 + 0.5e0) AS BIGINT) % 10 AS VARCHAR(1))"))
Q("relative_days", "SELECT id, CASE WHEN hours < 1 THEN 'just now' WHEN hours < 24 THEN concat(CAST(hours AS VARCHAR(9)), 'h ago') WHEN hours < 336 THEN concat(CAST(CAST(floor(hours / 24e0) AS BIGINT) AS VARCHAR(9)), 'd ago') ELSE concat(CAST(CAST(floor(hours / 168e0) AS BIGINT) AS VARCHAR(9)), ' weeks ago') END AS label FROM (SELECT id, CAST(floor((@epoch(@now()) - @epoch(created_at)) / 3600e0) AS BIGINT) AS hours FROM source)")
Q("freshness_tier", "SELECT id, CASE WHEN days IS NULL THEN 'never' WHEN days < 10 THEN 'fresh' WHEN days < 14 THEN 'warning' ELSE 'stale' END AS tier FROM (SELECT id, CAST(floor((@epoch(@now()) - @epoch(coalesce(last_received_at, last_run_at))) / 86400e0) AS BIGINT) AS days FROM source)")

# ---- text, urls, pages ----
Q("page_host", r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, concat('https://', @replace_all(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '')) AS website FROM pages")
Q("page_title", r"SELECT page_id, substring(trim(@replace_all(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ')), 1, 200) AS title FROM pages")
Q("name_from_title", r"SELECT page_id, trim(@replace_all(@replace_all(@split(regexp_extract(html, '<title>([^<]*)', 1), '|')[0], '(?i)^welcome to ', ''), '(?i)\s+-\s+home.*$', '')) AS name FROM pages".replace("@split(regexp_extract(html, '<title>([^<]*)', 1), '|')[0]", "regexp_extract(html, '<title>([^<|•·–—]*)', 1)"))
_BODY = "concat('Hello ', CAST(page_id AS VARCHAR(9)), ' From: Jo <jo@site', CAST(page_id % 300 AS VARCHAR(9)), '.org> see https://track.example.com/c and ', url, ' now')"
Q("email_identifier", "SELECT id, CASE WHEN match_domain = 'gmail.com' THEN concat('gabbai@gmail.com::', coalesce(nullif(regexp_extract(coalesce(submitted_url, ''), '//(?:www\\.)?([^/]+)', 1), ''), concat('unknown-', substring(@sha256(slug), 1, 12)))) ELSE concat('gabbai@', coalesce(match_domain, 'nowhere.org')) END AS identifier FROM place")
Q("ip_hash", "SELECT id, CASE WHEN reporter IS NULL THEN NULL ELSE @sha256(concat('pepper:10.0.0.', CAST(reporter AS VARCHAR(9)))) END AS hash FROM report")
Q("url_fallback", "SELECT place_id, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE WHEN pos = 1 AND confidence >= 0.4e0 THEN 0 WHEN confidence >= 0.6e0 THEN 1 ELSE 2 END, CASE WHEN (pos = 1 AND confidence >= 0.4e0) OR confidence >= 0.6e0 THEN pos ELSE 0 END, confidence DESC, pos) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY id) AS pos FROM source)) WHERE rn = 1")
Q("edit_validation", f"SELECT r.id, r.tefillah IN ({TEF}) AND (r.time_kind <> 'fixed' OR @matches(r.clock, '^[0-9]{{1,2}}:[0-9]{{2}}$')) AND (coalesce(r.days, '') = '' OR @matches(r.days, '^[0-6](,[0-6])*$')) AS valid, nullif(r.days, '') AS days FROM rule r")
Q("email_body_hash", f"SELECT page_id, @sha256(substring({_BODY}, 1, 30000)) AS hash FROM pages")
Q("hostname_tokens", r"""SELECT page_id, token FROM (SELECT page_id, @explode(@split(@replace_all(@replace_all(host, '\.[^.]*$', ''), '[._]', '-'), '-')) AS token
  FROM (SELECT page_id, @replace_all(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)) WHERE @len(token) > 3""")
Q("identifier_label", r"""SELECT id, identifier, CASE WHEN @matches(identifier, '^.+@') THEN @replace_all(identifier, '@[^@]*$', '') WHEN @matches(identifier, '^[a-z]+://') THEN regexp_extract(identifier, '^[a-z]+://(www\.)?([^/?#:]+)', 2) ELSE identifier END AS label
  FROM (SELECT id, CASE WHEN id % 3 = 0 THEN concat('gabbai', CAST(id AS VARCHAR(9)), '@', coalesce(match_domain, 'example.org')) ELSE coalesce(submitted_url, name) END AS identifier FROM place)""")
# Messages of failures that are worth another try.
_TRANSIENT = r"(?i)(\b429\b|\b5\d\d\b|rate[_\s-]?limit|overloaded|too many requests|ETIMEDOUT|ECONNRESET|ECONNREFUSED|ENOTFOUND|EAI_AGAIN|socket hang up|timed?\s?out|fetch failed)"
Q("transient_failure", rf"""SELECT place_id, bool_or(NOT (status = 'skipped' AND @matches(message, 'budget|kill switch|disabled')) AND (coalesce(http, 0) = 429 OR coalesce(http, 0) >= 500 OR @matches(message, '{_TRANSIENT}'))) AS transient
  FROM (SELECT place_id, CASE WHEN id % 7 = 0 THEN 'skipped' ELSE 'fetch_failed' END AS status, CASE id % 6 WHEN 0 THEN 'budget reached, fetch failed' WHEN 1 THEN 'socket hang up' WHEN 2 THEN 'status 503 from host' WHEN 3 THEN 'no rules on page 5031' ELSE '' END AS message,
    CASE WHEN id % 50 = 4 THEN 429 WHEN id % 5 = 0 THEN 404 END AS http FROM source WHERE run_status IN ('broken', 'error')) GROUP BY place_id""")
Q("mass_breakage", "SELECT count(*) AS n_new, count(*) >= 5 AS mass FROM source WHERE run_status = 'broken' AND first_broken_at >= @ago(7)")

# ---- ingestion: change detection and transitions, as new versions of rows ----
Q("skipped_runs", "SELECT s.id FROM source s JOIN place p ON p.id = s.place_id WHERE s.strategy = 'failed' OR p.status = 'unsupported'")
Q("no_change_version", "SELECT id, @now() AS last_run_at, first_broken_at FROM source WHERE run_status = 'no_change'")
Q("reactivation", f"SELECT p.id, 'active' AS status FROM place p WHERE p.status IN ('pending_review', 'unsupported', 'broken') AND EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND {FRESH})")
Q("backfilled", "SELECT id, coalesce(address, 'unknown') AS address, CASE WHEN name LIKE '%.%' OR name = '' THEN slug ELSE name END AS name FROM place")
Q("config_without_hash", r"""SELECT id, @replace_all(config_json, ',"page_content_hash":"[^"]*"', '') AS config_json FROM source""")
Q("fan_out", "SELECT p.id AS place_id, s.id AS source_id, 'weekly' AS reason FROM place p JOIN source s ON s.place_id = p.id WHERE p.status <> 'archived' AND s.review_status = 'approved'")
Q("insert_or_ignore", "SELECT host, min(id) AS id, count(*) - 1 AS duplicates FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM place p WHERE p.match_domain = c.host) GROUP BY host")
Q("enum_narrowing", "SELECT id, CASE WHEN status = 'unsupported' THEN 'archived' ELSE status END AS status FROM place")
Q("strategy_backfill", "SELECT id, coalesce(strategy, CASE WHEN kind IN ('website_llm', 'shulcloud_website') THEN 'html' END) AS strategy FROM source")

TEXT |= schedule.TEXT | pages.TEXT | ingest.TEXT | fetch.TEXT

# Calls with a different spelling that only these texts use.
_EXTRA = {"group1": ("'$1'", "'\\1'"), "collect": ("collect_list", "list")}


def with_extras(text: str, k: int = 0) -> str:
    """The text with these calls spelled for Spark (0) or DuckDB (1)."""
    for name, spelled in _EXTRA.items():
        text = text.replace(f"@{name}()", spelled[k]).replace(f"@{name}(", f"{spelled[k]}(")
    return text


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        text = with_extras(TEXT[name])
        if text.startswith("WITH RECURSIVE"):
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rounds are bounded by the statement, rows by the tables
        return spark.sql(spark_sql(with_relations(text)))

    return build


QUERIES = {name: run(name) for name in TEXT} | markup.QUERIES | model_output.QUERIES | limits.QUERIES | fetch.QUERIES | schedule.QUERIES


def oracle(name: str) -> str:
    text = with_extras(TEXT[name], 1)
    return duck_sql(with_relations(text))


ORACLE = {name: oracle(name) for name in TEXT} | model_output.ORACLE | limits.ORACLE
ORACLE["parsed_links"] = ORACLE["page_links"]  # on these pages patterns find what the parser finds
