"""Ingestion as statements: what a result, a submission, a message or a command makes of the rows it is for.

Each text gives the next version of the rows (or the outcome that decides it); ``gnomon.operators.transitions``
applies results to whole tables.
"""

from __future__ import annotations

from gnomon.plans.pages import GUARD, GUARD_REASON, HOST_OF, domains
from gnomon.plans.schedule import VISIBLE

_PRIOR_OK = "coalesce(s.run_status IN ('ok', 'no_change'), false)"
_RULES = "regular AS (SELECT source_id, count(*) AS n FROM rule WHERE special_kind = 'regular' AND NOT is_deleted AND source_id IS NOT NULL GROUP BY source_id)"
# Prices in dollars for a million tokens, of models whose name has "haiku" and of others.
PRICES = ((1, 5), (3, 15))
_DOLLARS = "(CAST(tin AS DOUBLE) * {0} + CAST(tout AS DOUBLE) * {1}) / 1e6"
_TOKENS = "coalesce(@sum_of(@extract_group(usage, '\"{name}\"\\s*:\\s*(-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?)')), 0e0)"
# Limits: requests in a time, by kind. A request without a key is never limited.
LIMITS = {"submit": (5, 3600), "link_address": (10, 3600), "link_mail": (3, 3600), "inbound": (100, 86400), "report": (20, 3600)}


def spent(day: str) -> str:
    """CTE ``spend``: of each source created or built from ``day`` on, its tokens at any depth and their price."""
    tin, tout = (_TOKENS.format(name=n) for n in ("inputTokens", "outputTokens"))
    return f"""used AS (SELECT id, lower(coalesce(@json(config_json, '$.model'), '')) LIKE '%haiku%' AS small, @json(config_json, '$.usage') AS usage FROM source WHERE created_at >= {day} OR built_at >= {day}),
  told AS (SELECT id, small, t.tin AS tin, t.tout AS tout FROM (SELECT id, small, @explode(@list(@struct(tin, {tin}, tout, {tout}))) AS t FROM used)),
  spend AS (SELECT id, CASE WHEN small THEN 'small' ELSE 'large' END AS model, tin, tout, CASE WHEN small THEN {_DOLLARS.format(*PRICES[0])} ELSE {_DOLLARS.format(*PRICES[1])} END AS dollars FROM told WHERE tin > 0 OR tout > 0)"""


# The test tables end long before their "now"; this day has rows on either side.
_DAY = "TIMESTAMP '1998-06-01 00:00:00'"
_GATE = "CASE WHEN disabled THEN 'kill_switch' WHEN budget IS NOT NULL AND NOT isnan(budget) AND budget > 0 AND today >= budget THEN 'daily_budget_exceeded' END"

TEXT = {
    "daily_spend": f"WITH {spent(_DAY)} SELECT model, count(*) AS n, round(sum(tin), 3) AS input_tokens, round(sum(tout), 3) AS output_tokens, round(sum(dollars), 6) AS dollars FROM spend GROUP BY model",
    "cost_gate": f"""WITH {spent(_DAY)}, day AS (SELECT coalesce(sum(dollars), 0e0) AS today FROM spend), setting AS (SELECT CAST(l_linenumber AS INT) AS k, l_linenumber = 7 AS disabled, CASE l_linenumber WHEN 1 THEN 25e0 WHEN 2 THEN 0e0 WHEN 3 THEN 1e-3 WHEN 4 THEN -5e0 WHEN 5 THEN CAST('NaN' AS DOUBLE) WHEN 6 THEN 1e6 ELSE 25e0 END AS budget FROM (SELECT DISTINCT l_linenumber FROM lineitem))
  SELECT k, {_GATE} AS reason, {_GATE} IS NULL AS allowed FROM setting CROSS JOIN day""",
    "gated_run": f"""SELECT s.id, CASE WHEN {_PRIOR_OK} THEN 'skipped' ELSE 'error' END AS outcome, CASE WHEN {_PRIOR_OK} THEN s.run_status ELSE 'error' END AS run_status FROM source s""",
    "change_detection": f"""SELECT s.id, coalesce(@json(s.config_json, '$.page_content_hash') = n.hash, false) AND {_PRIOR_OK} AS unchanged FROM source s JOIN page_state n ON n.source_id = s.id""",
    "broken_run_version": f"SELECT s.id, 'broken' AS run_status, coalesce(s.first_broken_at, @now()) AS first_broken_at, s.review_status, g.confidence, {GUARD_REASON.replace('confidence', 'g.confidence')} AS reason FROM source s JOIN run_result g ON g.source_id = s.id WHERE {GUARD.replace('confidence', 'g.confidence')}",
    "ok_run_version": f"""WITH live AS (SELECT source_id, count(*) FILTER (WHERE NOT is_manual_edit) AS removed, count(*) FILTER (WHERE is_manual_edit) AS kept FROM rule WHERE NOT is_deleted GROUP BY source_id)
  SELECT s.id, 'ok' AS run_status, 'approved' AS review_status, CAST(NULL AS TIMESTAMP) AS first_broken_at, g.confidence, g.now AS rules_added, coalesce(l.removed, 0) AS rules_removed, coalesce(l.kept, 0) AS rules_kept
  FROM source s JOIN run_result g ON g.source_id = s.id LEFT JOIN live l ON l.source_id = s.id WHERE NOT ({GUARD.replace('confidence', 'g.confidence')})""",
    "resource_run_version": f"""SELECT s.id, coalesce(p.submitted_url, s.identifier) AS identifier, @json(s.config_json, '$.last_extracted_resource') AS was, concat('https://cdn.site.org/poster', CAST(s.id % 9 AS VARCHAR(9)), '.png') AS last_extracted_resource, 'ok' AS run_status, 'approved' AS review_status
  FROM source s JOIN place p ON p.id = s.place_id JOIN run_result g ON g.source_id = s.id WHERE s.strategy IN ('vision_image', 'pdf_document') AND NOT ({GUARD.replace('confidence', 'g.confidence')})""",
    "superseded": """WITH newest AS (SELECT place_id, identifier, max(id) AS id FROM source GROUP BY place_id, identifier)
  SELECT o.id AS old_id, n.id AS new_id, 'rejected' AS review_status, concat('superseded by new extraction on ', coalesce(substring(CAST(n.last_run_at AS VARCHAR(30)), 1, 10), '')) AS reviewer_notes
  FROM source o JOIN newest w ON w.place_id = o.place_id AND w.identifier = o.identifier AND w.id > o.id JOIN source n ON n.id = w.id WHERE o.review_status <> 'rejected'""",
    "superseded_rules": """WITH fresh AS (SELECT place_id, identifier, max(id) AS id FROM source GROUP BY place_id, identifier), old AS (SELECT o.id FROM source o JOIN fresh n ON n.place_id = o.place_id AND n.identifier = o.identifier AND n.id > o.id WHERE o.review_status <> 'rejected')
  SELECT r.id, true AS is_deleted FROM rule r WHERE NOT r.is_deleted AND EXISTS (SELECT 1 FROM old WHERE old.id = r.source_id)""",
    "created_source": """SELECT s.id, CASE WHEN s.strategy = 'failed' THEN 'rejected' ELSE 'pending' END AS review_status, CASE WHEN s.strategy = 'failed' THEN 'auto-rejected: cascade returned no useful rules' END AS reviewer_notes, CASE WHEN s.run_status IN ('broken', 'error') THEN s.last_run_at END AS first_broken_at FROM source s""",
    "first_build": """SELECT p.id AS place_id, CASE WHEN s.strategy = 'failed' OR s.strategy IS NULL THEN 'unsupported' WHEN p.status = 'unsupported' THEN 'pending_review' ELSE p.status END AS status, CASE s.kind WHEN 'shulcloud_website' THEN 30 ELSE 40 END AS priority,
    CASE WHEN s.strategy IN ('vision_image', 'pdf_document', 'failed') OR s.strategy IS NULL THEN p.submitted_url ELSE p.submitted_url || '/times' END AS identifier, CASE WHEN s.strategy = 'failed' OR s.strategy IS NULL THEN p.address ELSE coalesce(p.address, concat('read ', CAST(s.id AS VARCHAR(9)))) END AS address,
    CASE WHEN s.strategy <> 'failed' AND (p.name LIKE '%.%' OR p.name = '') THEN concat('Read ', CAST(s.id AS VARCHAR(9))) ELSE p.name END AS name
  FROM place p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY id) AS rn FROM source) WHERE rn = 1) s ON s.place_id = p.id""",
    "email_routing": f"""WITH letter AS (SELECT CAST(o_orderkey AS INT) AS id, concat('src-', CAST(o_orderkey % 5 AS VARCHAR(9))) AS identifier, CAST(o_custkey AS INT) AS near, concat('https://www.site', CAST(o_custkey % 300 AS VARCHAR(9)), '.org/') AS website, (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100e0 AS confidence, CAST(o_orderkey % 4 AS INT) AS rules FROM orders),
  h AS (SELECT l.*, {HOST_OF.format(t='website')} AS host FROM letter l), {domains('h', 'h.host')},
  known AS (SELECT identifier, min(id) AS source_id FROM source WHERE kind = 'email_newsletter' AND place_id % 5 = 0 GROUP BY identifier), same AS (SELECT match_domain, min(id) AS place_id FROM place WHERE match_domain IS NOT NULL GROUP BY match_domain)
  SELECT n.id, CASE WHEN n.rules = 0 OR n.confidence < 0.5e0 THEN 'skipped' WHEN k.source_id IS NOT NULL AND n.near % 2 = 0 THEN 'refresh' WHEN s.place_id IS NOT NULL THEN 'attach' ELSE 'create' END AS outcome, CASE WHEN n.rules = 0 OR n.confidence < 0.5e0 OR (k.source_id IS NOT NULL AND n.near % 2 = 0) THEN NULL ELSE s.place_id END AS place_id
  FROM named n LEFT JOIN known k ON k.identifier = n.identifier LEFT JOIN same s ON s.match_domain = n.domain""",
    "email_guardrail": f"WITH {_RULES}, judged AS (SELECT g.source_id, coalesce(r.n, 0) AS prev, g.now, g.confidence FROM run_result g JOIN source s ON s.id = g.source_id LEFT JOIN regular r ON r.source_id = g.source_id WHERE s.kind = 'email_newsletter') SELECT source_id, prev, now, {GUARD} AS is_broken, {GUARD_REASON} AS reason FROM judged",
    "email_rules": f"""WITH {_RULES}, good AS (SELECT g.source_id, g.now FROM run_result g JOIN source s ON s.id = g.source_id LEFT JOIN regular r ON r.source_id = g.source_id WHERE s.kind = 'email_newsletter' AND NOT ({GUARD.replace('prev', 'coalesce(r.n, 0)').replace('confidence', 'g.confidence')}))
  SELECT r.id, r.is_deleted OR (r.special_kind = 'regular' AND g.source_id IS NOT NULL AND g.now > 0) AS is_deleted, CASE WHEN r.special_kind = 'regular' THEN 0 ELSE 10 END AS new_priority FROM rule r JOIN source s ON s.id = r.source_id LEFT JOIN good g ON g.source_id = r.source_id WHERE s.kind = 'email_newsletter'""",
    "submit_routing": f"""WITH asked AS (SELECT o_orderkey AS id, CAST(floor(o_custkey / 4e0) AS INT) AS address, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS asked_at, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'https://10.0.0.1/times' WHEN 2 THEN 'not an address' ELSE concat('https://www.site', CAST(o_custkey % 350 AS VARCHAR(9)), CASE o_orderkey % 3 WHEN 0 THEN '.org/times' ELSE '.org/new' END) END AS url FROM orders),
  paced AS (SELECT *, count(*) OVER (PARTITION BY address ORDER BY @epoch(asked_at) RANGE BETWEEN {LIMITS['submit'][1]} PRECEDING AND CURRENT ROW) > {LIMITS['submit'][0]} AS limited, {HOST_OF.format(t="coalesce(url, '')")} AS host FROM asked), {domains('paced', 'h.host')},
  exact AS (SELECT submitted_url, min(id) AS place_id FROM place GROUP BY submitted_url), same AS (SELECT match_domain, min(id) AS place_id FROM place WHERE match_domain IS NOT NULL GROUP BY match_domain), had AS (SELECT place_id, identifier, max(last_run_at) AS last_run_at FROM source GROUP BY place_id, identifier), ran AS (SELECT place_id, max(last_run_at) AS last_run_at FROM source GROUP BY place_id)
  SELECT n.id, CASE WHEN n.limited THEN 'rate_limited' WHEN n.url IS NULL OR NOT @matches(n.url, '^https?://') THEN 'invalid' WHEN @matches(n.host, '^(10|127|192[.]168)[.]') THEN 'unsafe_host' WHEN e.place_id IS NOT NULL THEN 'duplicate' WHEN d.place_id IS NOT NULL THEN 'duplicate' WHEN s.place_id IS NOT NULL THEN 'attach' ELSE 'create' END AS outcome,
    CASE WHEN e.place_id IS NULL AND d.place_id IS NULL THEN s.place_id END AS attached_to, s.place_id IS NOT NULL AND coalesce(r.last_run_at > @now() - @minutes(4320), false) AS suppressed
  FROM named n LEFT JOIN exact e ON e.submitted_url = n.url LEFT JOIN same s ON s.match_domain = n.domain LEFT JOIN had d ON d.place_id = s.place_id AND d.identifier = n.url LEFT JOIN ran r ON r.place_id = s.place_id""",
    "candidate_approval": f"""WITH c AS (SELECT c.id, c.review_status, c.website, {HOST_OF.format(t="coalesce(c.website, '')")} AS host FROM candidate c), {domains('c', 'h.host')}, same AS (SELECT match_domain, min(id) AS place_id FROM place WHERE match_domain IS NOT NULL GROUP BY match_domain)
  SELECT n.id, CASE WHEN n.review_status <> 'pending' THEN concat('already ', n.review_status) WHEN n.website IS NULL THEN 'no_url' WHEN s.place_id IS NOT NULL THEN 'duplicate' ELSE 'create' END AS outcome, CASE WHEN n.review_status = 'pending' AND n.website IS NOT NULL THEN CASE WHEN s.place_id IS NOT NULL THEN 'duplicate' ELSE 'approved' END ELSE n.review_status END AS review_status,
    CASE WHEN n.review_status = 'pending' AND n.website IS NOT NULL THEN s.place_id END AS linked_place_id FROM named n LEFT JOIN same s ON s.match_domain = n.domain""",
    # Commands on sources and places, the newest of each row: what becomes of it, or why not.
    "review_transitions": """WITH command AS (SELECT id, CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'unreject' ELSE 'none' END AS verb FROM source),
  live AS (SELECT place_id, identifier, min(id) AS low, max(id) AS high FROM source WHERE review_status <> 'rejected' GROUP BY place_id, identifier)
  SELECT s.id, c.verb, CASE WHEN c.verb = 'approve' AND coalesce(s.strategy = 'failed', false) THEN 'failed' WHEN c.verb = 'unreject' AND coalesce(l.low <> s.id OR l.high <> s.id, false) THEN 'live sibling' END AS refused,
    CASE WHEN c.verb = 'approve' AND NOT coalesce(s.strategy = 'failed', false) THEN 'approved' WHEN c.verb = 'reject' THEN 'rejected' WHEN c.verb = 'unreject' AND NOT coalesce(l.low <> s.id OR l.high <> s.id, false) THEN 'pending' ELSE s.review_status END AS review_status,
    CASE WHEN c.verb = 'approve' AND NOT coalesce(s.strategy = 'failed', false) AND p.status IN ('pending_review', 'unsupported') THEN 'active' ELSE p.status END AS place_status
  FROM command c JOIN source s ON s.id = c.id JOIN place p ON p.id = s.place_id LEFT JOIN live l ON l.place_id = s.place_id AND l.identifier = s.identifier""",
    "place_commands": """SELECT id, verb, CASE WHEN verb = 'archive' THEN CASE WHEN status = 'archived' THEN 'active' ELSE 'archived' END WHEN verb = 'reset' AND status = 'unsupported' THEN 'pending_review' ELSE status END AS status FROM (SELECT id, status, CASE id % 2 WHEN 0 THEN 'archive' ELSE 'reset' END AS verb FROM place)""",
    "report_commands": "SELECT id, CASE WHEN status = 'open' THEN CASE verb WHEN 'resolve' THEN 'resolved' WHEN 'dismiss' THEN 'dismissed' ELSE status END ELSE status END AS status, status = 'open' AND verb <> 'none' AS changed FROM (SELECT id, status, CASE id % 3 WHEN 0 THEN 'resolve' WHEN 1 THEN 'dismiss' ELSE 'none' END AS verb FROM report)",
    "split_source": """WITH moved AS (SELECT id, place_id, kind, identifier, 100000 + id AS new_place_id FROM source)
  SELECT m.id, m.new_place_id, CASE WHEN m.kind = 'email_newsletter' THEN NULL ELSE m.identifier END AS submitted_url, CASE WHEN m.kind = 'email_newsletter' THEN m.identifier END AS contact_email, 'pending_review' AS status, count(r.id) AS rules_moved FROM moved m LEFT JOIN rule r ON r.source_id = m.id GROUP BY m.id, m.new_place_id, m.kind, m.identifier""",
    # A rule's edit sets all its fields, its deletion is soft; both mark it so that runs leave it alone.
    "rule_edits": """WITH edit AS (SELECT *, CASE WHEN source_id % 20 = 4 THEN 'delete' WHEN source_id % 20 = 1 THEN 'edit' ELSE 'none' END AS verb, CASE WHEN source_id % 3 = 0 THEN '' ELSE '1,2' END AS new_days FROM rule)
  SELECT id, CASE WHEN verb = 'edit' THEN 'other' ELSE tefillah END AS tefillah, CASE WHEN verb = 'edit' THEN nullif(new_days, '') ELSE days END AS days, is_deleted OR verb = 'delete' AS is_deleted, is_manual_edit OR verb <> 'none' AS is_manual_edit FROM edit""",
    "place_edits": """SELECT id, name, nullif(new_address, '') AS address, CASE WHEN trim(new_url) = '' THEN submitted_url ELSE trim(new_url) END AS submitted_url, nullif(trim(note), '') AS notes, CASE WHEN trim(note) = '' THEN NULL ELSE @now() END AS noted_at
  FROM (SELECT *, CASE id % 3 WHEN 0 THEN '' ELSE concat('new ', CAST(id AS VARCHAR(9))) END AS new_address, CASE id % 4 WHEN 0 THEN ' ' ELSE concat('https://new', CAST(id AS VARCHAR(9)), '.org') END AS new_url, CASE id % 5 WHEN 0 THEN '  ' ELSE ' seen ' END AS note FROM place)""",
    "rebuild_events": """SELECT s.id, CASE WHEN s.kind IN ('website_llm', 'shulcloud_website') THEN 'data-source.requested' END AS event, CASE WHEN s.kind IN ('website_llm', 'shulcloud_website') THEN s.identifier END AS url, CASE WHEN s.kind NOT IN ('website_llm', 'shulcloud_website') THEN concat('cannot rebuild kind=', s.kind) END AS refused FROM source s""",
    "extract_events": "SELECT id AS place_id, CASE WHEN submitted_url IS NOT NULL THEN 'data-source.requested' END AS event, submitted_url AS url, CASE WHEN submitted_url IS NULL THEN 'no-url' END AS refused FROM place",
    "resource_rewrite": """SELECT id, coalesce(@json(config_json, '$.submitted_url'), @json(config_json, '$.page_url')) AS identifier, coalesce(@json(config_json, '$.last_extracted_resource'), identifier) AS last_extracted_resource FROM source WHERE strategy IN ('pdf_document', 'vision_image') AND coalesce(@json(config_json, '$.submitted_url'), @json(config_json, '$.page_url')) IS NOT NULL""",
    "bulk_replacement": """WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY id) AS rn FROM source) WHERE rn = 1), got AS (SELECT f.id, f.place_id, g.now, g.confidence FROM first f JOIN run_result g ON g.source_id = f.id), live AS (SELECT source_id, count(*) AS n FROM rule WHERE NOT is_deleted GROUP BY source_id)
  SELECT g.id, g.now = 0 OR g.confidence < 0.6e0 AS skipped, CASE WHEN g.now = 0 OR g.confidence < 0.6e0 THEN 0 ELSE coalesce(l.n, 0) END AS rules_removed, CASE WHEN g.now = 0 OR g.confidence < 0.6e0 THEN 0 ELSE g.now END AS rules_added, CASE WHEN g.now = 0 OR g.confidence < 0.6e0 THEN NULL ELSE 50 END AS priority FROM got g LEFT JOIN live l ON l.source_id = g.id""",
    "legacy_transform": """SELECT id, tefillah, days, special_kind, status, kind, time_kind, anchor, offset_min, clock, tefillah IS NULL AS dropped FROM (SELECT id, CASE service WHEN 'shacharis' THEN 'shacharis' WHEN 'mincha' THEN 'mincha' WHEN 'maariv' THEN 'maariv' WHEN 'selichos' THEN 'selichos' WHEN 'other' THEN 'other' END AS tefillah,
    CASE day_rule WHEN 'sunday' THEN '0' WHEN 'monday' THEN '1' WHEN 'tuesday' THEN '2' WHEN 'wednesday' THEN '3' WHEN 'thursday' THEN '4' WHEN 'friday' THEN '5' WHEN 'shabbos' THEN '6' WHEN 'weekday' THEN '1,2,3,4,5' END AS days, CASE WHEN day_rule IN ('rosh_chodesh', 'yom_tov') THEN day_rule WHEN day_rule = 'specific_date' THEN 'ad_hoc' ELSE 'regular' END AS special_kind,
    CASE WHEN enabled THEN 'active' ELSE 'archived' END AS status, CASE WHEN platform = 'shulcloud' THEN 'shulcloud_website' ELSE 'manual' END AS kind, CASE WHEN old_kind LIKE 'relative%' THEN 'zmanim' ELSE 'fixed' END AS time_kind, CASE old_kind WHEN 'relative_sunrise' THEN 'netz' WHEN 'relative_sunset' THEN 'shkia' WHEN 'relative_plag' THEN 'plag_mincha' WHEN 'relative_chatzos' THEN 'chatzos' END AS anchor,
    CASE WHEN old_kind LIKE 'relative%' THEN coalesce(offset_min, 0) END AS offset_min, CASE WHEN old_kind NOT LIKE 'relative%' THEN coalesce(old_clock, '00:00') END AS clock FROM legacy)""",
    "rate_limit_hits": "SELECT event_id, kind, CASE WHEN who IS NULL THEN false WHEN kind = 'inbound' THEN n_day > 100 WHEN kind = 'submit' THEN n_hour > 5 WHEN kind = 'link_address' THEN n_hour > 10 WHEN kind = 'link_mail' THEN n_hour > 3 ELSE n_hour > 20 END AS limited FROM (SELECT *, count(*) OVER (PARTITION BY kind, who ORDER BY @epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_hour, count(*) OVER (PARTITION BY kind, who ORDER BY @epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_day FROM (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'report' WHEN 'click' THEN 'submit' WHEN 'signup' THEN 'link_mail' WHEN 'error' THEN 'inbound' ELSE 'link_address' END AS kind, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN 'global' ELSE CAST(user_id AS VARCHAR(20)) END AS who FROM events))",
    # Sources without a run for two days: since when, when that is told, and the run that ends it; the stream of it is ``streaming.limits.silence``.
    "silent_sources": """WITH gap AS (SELECT source_id, started_at, lead(started_at) OVER (PARTITION BY source_id ORDER BY started_at, id) AS next_at FROM run)
  SELECT source_id, started_at AS since, started_at + @days(2) AS raised_at, next_at AS cleared_at FROM gap WHERE coalesce(next_at, @event_now()) >= started_at + @days(2)""",
    "report_rules": "SELECT t.id, t.place_id, r.id AS rule_id FROM rule_report t LEFT JOIN (SELECT DISTINCT id, place_id FROM rule) r ON r.id = t.rule_id AND r.place_id = t.place_id",
    "pending_sources": "SELECT s.id, p.slug, s.confidence, s.built_at FROM source s JOIN place p ON p.id = s.place_id WHERE s.review_status = 'pending' ORDER BY s.confidence ASC NULLS LAST, s.built_at ASC NULLS LAST, s.id",
    "place_with_sources": "SELECT p.id, p.slug, count(s.id) AS n, CASE WHEN count(s.id) = 0 THEN NULL ELSE @join(@sorted_pairs(@collect_pairs(s.id, concat(CAST(s.id AS VARCHAR(12)), ' ', s.identifier, ' ', s.review_status))), '; ') END AS sources FROM place p LEFT JOIN source s ON s.place_id = p.id GROUP BY p.id, p.slug",
    "discovery_targets": "SELECT t.id, f.id AS ask, t.name, t.region, t.tier FROM target t JOIN target_filter f ON (f.region IS NULL OR f.region = t.region) AND (f.tier IS NULL OR f.tier = t.tier) AND (f.name = 'all' OR f.name = t.name)",
    "sitemap": f"WITH {VISIBLE} SELECT '/' AS path, 'daily' AS frequency, 1e0 AS priority UNION ALL SELECT '/find', 'monthly', 0.7e0 UNION ALL SELECT '/submit', 'monthly', 0.5e0 UNION ALL SELECT '/bot', 'yearly', 0.3e0 UNION ALL SELECT concat('/place/', slug), 'weekly', 0.8e0 FROM visible",
}
