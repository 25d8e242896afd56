"""The fetch chain over recorded responses: redirects, agents in turn, a proxy, rendered pages.

``request`` has the addresses asked for (url), ``response`` what each agent got at each address (url, agent,
status, location, body, rendered); an address without a row did not answer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.plans.dialect import spark_sql
from gnomon.plans.pages import HOST, SEGMENTS, absolute, blocked_host, formed, joined
from gnomon.sources.io import materialise
from gnomon.sources.model import register, relation

HOPS = 5  # redirects that are followed; one more gives status 310
REFUSED = "status IN (403, 406)"  # what the next agent is tried for


def follow(name: str, agent: str, seeds: str) -> str:
    """CTE ``name``: where ``agent`` ends up from each url of ``seeds`` (asked, spot, hops, status, body, why).

    Only chains that are still open are joined with responses again. Status is null where the chain meets
    a private host or an address that does not answer.
    """
    blocked = lambda c: blocked_host(HOST.format(u=f"{c}.spot"))
    moved = "s.status BETWEEN 300 AND 399 AND s.location IS NOT NULL"
    return f"""{name}_hop AS (SELECT url AS asked, url AS spot, 0 AS hops FROM {seeds}
    UNION ALL SELECT c.asked, {absolute('s.location', 'c.spot')}, c.hops + 1 FROM {name}_hop c JOIN response s ON s.url = c.spot AND s.agent = '{agent}' WHERE c.hops < {HOPS} AND {moved} AND NOT {blocked('c')}),
  {name}_last AS (SELECT asked, @max_by(spot, hops) AS spot, max(hops) AS hops FROM {name}_hop GROUP BY asked),
  {name} AS (SELECT c.asked, c.spot, c.hops, CASE WHEN {blocked('c')} THEN NULL WHEN {moved} THEN 310 ELSE s.status END AS status, CASE WHEN s.status BETWEEN 200 AND 299 AND NOT {blocked('c')} THEN s.body ELSE '' END AS body,
    CASE WHEN {blocked('c')} THEN 'blocked host' WHEN s.status IS NULL THEN 'no answer' WHEN {moved} THEN 'too many redirects' WHEN s.status NOT BETWEEN 200 AND 299 THEN concat('status ', CAST(s.status AS VARCHAR(9))) END AS why
    FROM {name}_last c LEFT JOIN response s ON s.url = c.spot AND s.agent = '{agent}')"""


# The second agent and the proxy are asked for what the one before was refused; a rendered page stands in for one that failed.
REACHED = f"""direct AS (SELECT o.asked, coalesce(b.asked IS NOT NULL, false) AS second, CASE WHEN b.asked IS NULL THEN o.spot ELSE b.spot END AS spot, CASE WHEN b.asked IS NULL THEN o.hops ELSE b.hops END AS hops,
    CASE WHEN b.asked IS NULL THEN o.status ELSE b.status END AS status, CASE WHEN b.asked IS NULL THEN o.body ELSE b.body END AS body, CASE WHEN b.asked IS NULL THEN o.why ELSE b.why END AS why FROM own o LEFT JOIN browser b ON b.asked = o.asked),
  tried AS (SELECT d.*, p.url IS NOT NULL AS third, p.status AS p_status, p.location AS p_at, p.body AS p_body FROM direct d LEFT JOIN response p ON p.url = d.asked AND p.agent = 'proxy' AND d.second AND d.{REFUSED}),
  reached AS (SELECT asked AS url, CASE WHEN third THEN coalesce(p_at, asked) ELSE spot END AS final_url, CASE WHEN third THEN p_status ELSE status END AS status, CASE WHEN third THEN CASE WHEN p_status BETWEEN 200 AND 299 THEN p_body ELSE '' END ELSE body END AS html,
    CASE WHEN third THEN 'proxy' WHEN second THEN 'browser' ELSE 'own' END AS agent, CASE WHEN third THEN 0 ELSE hops END AS hops, CASE WHEN third THEN CASE WHEN p_status BETWEEN 200 AND 299 THEN NULL ELSE concat('status ', CAST(p_status AS VARCHAR(9))) END ELSE why END AS why FROM tried),
  fetched AS (SELECT f.url, f.final_url, f.status, f.agent, f.hops, f.why, coalesce(f.status BETWEEN 200 AND 299, false) AS ok, coalesce(f.status NOT BETWEEN 200 AND 299, true) AND coalesce(r.rendered, '') <> '' AS is_rendered,
    CASE WHEN f.status BETWEEN 200 AND 299 THEN f.html ELSE coalesce(r.rendered, '') END AS body FROM reached f LEFT JOIN (SELECT url, max(rendered) AS rendered FROM response WHERE rendered IS NOT NULL GROUP BY url) r ON r.url = f.url)"""
FETCHED = f"""{follow('own', 'own', 'request')}, again AS (SELECT asked AS url FROM own WHERE {REFUSED}), {follow('browser', 'browser', 'again')},
  {REACHED}"""
COLUMNS = "url, final_url, status, agent, hops, why, ok, is_rendered, body"

TEXT = {
    "fetch_chain": f"WITH RECURSIVE {FETCHED} SELECT {COLUMNS} FROM fetched",
}


def _sql(text: str) -> Column:
    return F.expr(spark_sql(text))


def _led(rows: DataFrame) -> DataFrame:
    """Adds ``next``: ``location`` from ``spot``, as ``absolute`` has it, each step a column so that none is done twice."""
    told = rows.withColumn("u", _sql(joined("location", "spot"))).withColumn("segments", _sql(SEGMENTS))
    dots = "@has(segments, '.') OR @has(segments, '..')"
    return told.withColumn("folded", _sql(f"CASE WHEN {dots} THEN @folded(segments) ELSE segments END")).withColumn("next", _sql(formed("segments", "folded"))).drop("u", "segments", "folded")


def _inward(rows: DataFrame) -> DataFrame:
    """Adds ``blocked``: whether ``spot`` is on a host that is not asked."""
    return rows.withColumn("host", _sql(HOST.format(u="spot"))).withColumn("blocked", _sql(blocked_host("host"))).drop("host")


def _followed(agent: str, seeds: DataFrame, answers: DataFrame) -> DataFrame:
    """What ``follow`` says of each url of ``seeds``, by a join a hop; only where chains come to are addresses resolved. Joins go by addresses' hashes first."""
    mine = answers.filter(f"agent = '{agent}'").withColumnRenamed("url", "spot")
    moved = "status BETWEEN 300 AND 399 AND location IS NOT NULL"
    moves = mine.filter(moved).select("key", "spot", "location")
    at = seeds.selectExpr("url AS asked", "url AS spot", "0 AS hops")
    for _ in range(HOPS):
        step = _inward(_led(at.selectExpr("*", "xxhash64(spot) AS key").join(moves, ["key", "spot"], "left")))
        at = step.withColumn("on", F.expr("location IS NOT NULL AND NOT blocked")).selectExpr("asked", "CASE WHEN on THEN next ELSE spot END AS spot", "hops + CAST(coalesce(on, false) AS INT) AS hops")
    ends = mine.selectExpr("key", "spot", "status", "body", f"{moved} AS moved")
    last = _inward(at.selectExpr("*", "xxhash64(spot) AS key").join(ends, ["key", "spot"], "left"))
    return last.selectExpr(
        "asked", "spot", "hops", "CASE WHEN blocked THEN NULL WHEN moved THEN 310 ELSE status END AS status", "CASE WHEN status BETWEEN 200 AND 299 AND NOT blocked THEN body ELSE '' END AS body",
        "CASE WHEN blocked THEN 'blocked host' WHEN status IS NULL THEN 'no answer' WHEN moved THEN 'too many redirects' WHEN status NOT BETWEEN 200 AND 299 THEN concat('status ', CAST(status AS STRING)) END AS why",
    )


def chain(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The fetch chain of ``FETCHED`` for distinct requests (url) and responses of one row a (url, agent).

    Responses, and what the first agent got, are written once, as all later steps read them.
    """
    answers = materialise(responses.selectExpr("url", "agent", "status", "location", "body", "rendered", "xxhash64(url) AS key"))
    own = materialise(_followed("own", requests, answers))
    browser = _followed("browser", own.filter(REFUSED).selectExpr("asked AS url"), answers)
    given = {"own": own, "browser": browser, "response": answers}
    text = REACHED
    for name in given:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return requests.sparkSession.sql(f"WITH {text} SELECT {COLUMNS} FROM fetched", **given)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return chain(relation(spark, "request"), relation(spark, "response"))


QUERIES = {"fetch_chain": query}
