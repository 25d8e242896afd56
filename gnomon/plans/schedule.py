"""Schedules: which rules apply on a day, when they start at a place, how they read, what starts soon near a point.

Texts are templates: a query of the catalogue fills them with literals, ``gnomon.api`` with what a user asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.functions import solar
from gnomon.plans import zones
from gnomon.plans.dialect import spark_sql
from gnomon.sources.io import materialise
from gnomon.sources.model import FRESH_DAYS, register, relation

FRESH = f"s.review_status = 'approved' AND s.run_status IN ('ok', 'no_change') AND coalesce(s.last_received_at, s.last_run_at) >= @ago({FRESH_DAYS})"
DAYS_KEY = "coalesce(@join(@sorted(@split(nullif(r.days, ''), ',')), ','), '')"
# The winner of rules that say the same: manual edits, then the source's priority, its last run, and ids.
WINNER = f"""row_number() OVER (PARTITION BY r.place_id, r.tefillah, r.time_kind, r.clock, r.anchor, r.offset_min, {DAYS_KEY}, r.special_kind, r.valid_from, r.valid_to
  ORDER BY r.is_manual_edit DESC, coalesce(s.priority, 0) DESC, s.last_run_at DESC NULLS LAST, r.source_id DESC NULLS LAST, r.id DESC)"""
SHOWN = "NOT r.is_deleted AND (s.id IS NULL OR s.review_status <> 'rejected')"
PUBLIC = f"""public_rule AS (SELECT * FROM (SELECT r.*, coalesce(s.priority, 0) AS source_priority, {WINNER} AS rn
  FROM rule r LEFT JOIN source s ON s.id = r.source_id WHERE {SHOWN}) WHERE rn = 1)"""
VISIBLE = f"visible AS (SELECT p.* FROM place p WHERE p.status <> 'archived' AND EXISTS (SELECT 1 FROM source s WHERE s.place_id = p.id AND {FRESH}))"
DEFAULT_ZONE = "America/New_York"
ZONE = f"coalesce(p.timezone, '{DEFAULT_ZONE}')"
METRES_PER_MILE = 1609.344
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257223563  # of the WGS 84 spheroid
NOW_PAST, NOW_AHEAD = 30, 24 * 60  # minutes around now that a feed shows
TRAVEL_BEFORE, TRAVEL_AFTER = 12 * 60, 36 * 60  # and around a travel day's midnight UTC


def metres(rows: str, a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    """A subquery: ``rows`` with the metres between two points of the spheroid, to the millimetre.

    The sphere's angle at reduced latitudes, with the first-order correction for the flattening: off by
    some centimetres at the distances of a feed, by tens of metres between continents.
    """
    reduced = f"atan({1 - _FLATTENING!r}e0 * tan(radians({{x}})))"
    # a list of one, so that a filter on the distance is not written out in each join and scan below
    return f"""(SELECT *, @explode(@list(round(CASE WHEN _h = 0e0 THEN 0e0 WHEN _h < 1e0 THEN {_AXIS}e0 * (_s - {_FLATTENING / 2!r}e0 * ((_s - sin(_s)) * pow(sin((_b1 + _b2) / 2e0) * cos((_b2 - _b1) / 2e0), 2) / (1e0 - _h)
    + (_s + sin(_s)) * pow(cos((_b1 + _b2) / 2e0) * sin((_b2 - _b1) / 2e0), 2) / _h)) ELSE {_AXIS * math.pi}e0 END, 3))) AS metres
  FROM (SELECT *, 2e0 * asin(sqrt(_h)) AS _s FROM (SELECT *, least(1e0, pow(sin((_b2 - _b1) / 2e0), 2) + cos(_b1) * cos(_b2) * pow(sin(radians({b_lng} - {a_lng}) / 2e0), 2)) AS _h
  FROM (SELECT *, {reduced.format(x=a_lat)} AS _b1, {reduced.format(x=b_lat)} AS _b2 FROM {rows}))))"""


def radius(miles: float) -> float:
    """Miles as metres, held between 50 and 50,000."""
    return min(max(miles * METRES_PER_MILE, 50.0), 50000.0)


def within(lat: float, lng: float, reach: float, rows: str = "visible") -> str:
    """CTE ``near``: places of ``rows`` within ``reach`` metres, with their distance; a box is tested first, on columns alone."""
    dy = reach / 110574.0 * 1.01
    dx = min(180.0, dy / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + dy)))) * 1.01)
    box = f"p.lat BETWEEN {lat - dy!r}e0 AND {lat + dy!r}e0 AND p.lng BETWEEN {lng - dx!r}e0 AND {lng + dx!r}e0"
    boxed = f"(SELECT p.* FROM {rows} p WHERE {box})"
    return f"near AS (SELECT * FROM {metres(boxed, f'{lat!r}e0', f'{lng!r}e0', 'lat', 'lng')} WHERE metres <= {float(reach)!r}e0)"


def pairs_within(rows: str, reach: float, order: str = "<") -> str:
    """CTE ``pair``: (a_id, b_id, metres) of ``rows`` (id, lat, lng) within ``reach`` metres, a_id < b_id (or what ``order`` says); not across the date line.

    Bands of latitude are as high as the reach, cells as wide as it is at the end of the band that is farther from the equator; a row
    meets the cells that its box touches, and only pairs whose boxes meet have their distance computed.
    """
    dy = reach / 110574.0 * 1.01
    wide = lambda band: f"({dy!r}e0 / greatest(0.01e0, cos(radians(least(89.9e0, greatest(abs({band}), abs({band} + 1)) * {dy!r}e0)))))"
    floor = lambda x: f"CAST(floor({x}) AS INT)"
    return f"""boxed AS (SELECT id, lat, lng, {floor(f'lat / {dy!r}e0')} AS band, {dy!r}e0 / greatest(0.01e0, cos(radians(least(89.9e0, abs(lat) + {dy!r}e0)))) AS dx FROM {rows} WHERE lat IS NOT NULL AND lng IS NOT NULL),
  cell AS (SELECT id, lat, lng, dx, band, {floor(f'lng / {wide("band")}')} AS col FROM boxed),
  beside AS (SELECT id, lat, lng, dx, @explode(@range(band - 1, band + 1)) AS band FROM boxed),
  spread AS (SELECT id, lat, lng, band, @explode(@range({floor(f'(lng - dx) / {wide("band")}')}, {floor(f'(lng + dx) / {wide("band")}')})) AS col FROM beside),
  met AS (SELECT a.id AS a_id, b.id AS b_id, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2 FROM cell a JOIN spread b ON a.band = b.band AND a.col = b.col AND a.id {order} b.id AND abs(a.lat - b.lat) <= {dy!r}e0 AND abs(a.lng - b.lng) <= a.dx),
  pair AS (SELECT a_id, b_id, metres FROM {metres("met", "lat1", "lng1", "lat2", "lng2")} WHERE metres <= {reach!r}e0)"""


CHUNK = 1024  # about so many places of one spot are a row; two such rows make a million pairs


def place_pairs(places: DataFrame, reach: float) -> DataFrame:
    """The pairs of ``pairs_within``: each distance is found once for two spots, and their places meet in chunks.

    A chunk is a list of ids of one spot, so a spot of many places is many rows, dealt out by pairs of chunks; what is held at once is bounded.
    """
    spark = places.sparkSession
    rows = places.select("id", "lat", "lng").filter("id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")
    spots = materialise(rows.groupBy("lat", "lng").count().withColumn("id", F.monotonically_increasing_id()))
    text = f"WITH {pairs_within('{spot}', reach, '<>')} SELECT a_id, b_id, metres FROM pair UNION ALL SELECT id, id, 0e0 FROM {{spot}}"
    near = spark.sql(spark_sql(text), spot=spots)
    own = spots.select("lat", "lng", F.col("id").alias("spot"), F.ceil(F.col("count") / CHUNK).alias("parts"))
    chunk = rows.join(own, ["lat", "lng"]).groupBy("spot", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list("id").alias("ids"))
    a, b = (chunk.select(F.col("spot").alias(f"{x}_id"), F.col("part").alias(f"{x}_part"), F.col("ids").alias(f"{x}_ids")) for x in "ab")
    met = near.join(a, "a_id").join(b, "b_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a_id", "a_part", "b_id", "b_part")
    return met.select(F.explode("a_ids").alias("a_id"), "b_ids", "metres").select("a_id", F.explode("b_ids").alias("b_id"), "metres").filter("a_id < b_id")


def special(day: str) -> str:
    return f"(r.valid_from IS NULL OR {day} >= r.valid_from) AND (r.valid_to IS NULL OR {day} <= r.valid_to)"


def applies(day: str, empty_means_daily: bool) -> str:
    """Special rules by their dates alone, regular ones by weekday alone. The feed reads no days as every day, a place's page as never."""
    weekly = f"@has(@split(r.days, ','), CAST(@dow({day}) AS VARCHAR(2)))"
    return f"CASE WHEN r.special_kind <> 'regular' THEN {special(day)} WHEN coalesce(r.days, '') = '' THEN {str(empty_means_daily).lower()} ELSE {weekly} END"


def timed(rows: str, places: str, day: str) -> str:
    """CTEs from ``rows`` (rules with zone) to ``timed``: with starts_at on that day, null where it cannot be told.

    A wall clock is corrected by the zone's offset at a guess, twice; an anchored time lies its offset after
    the sun's, which is found once for each of ``places`` (id, lat, lng).
    """
    wall = f"CASE WHEN time_kind = 'fixed' AND @matches(clock, '^[0-9]+:[0-9]+') THEN @at({day}, 0, 0) + @minutes(CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT)) END"
    return f"""walled AS (SELECT *, {wall} AS wall FROM {rows}), guess AS (SELECT *, wall + (wall - @local(wall, zone)) AS g1 FROM walled),
  {solar.sun_ctes(f"(SELECT id AS sun_id, lat, lng FROM {places})", day)},
  timed AS (SELECT w.*, CASE WHEN time_kind = 'fixed' THEN g1 + (wall - @local(g1, zone)) ELSE {solar.of_anchor("anchor", "offset_min")} END AS starts_at FROM guess w JOIN sun ON sun.sun_id = w.place_id)"""


def feed(lat: float, lng: float, reach: float, now: str, day: str, travel: bool = False) -> str:
    """CTEs to ``feed``: what starts near a point around ``now`` (or all around a travel day), with its place in the feed's order.

    Places near the point are found first; only their rules are read for winners.
    """
    if travel:
        low, high = f"@at({day}, 0, 0) - @minutes({TRAVEL_BEFORE})", f"@at({day}, 0, 0) + @minutes({TRAVEL_AFTER})"
        order = "starts_at"
    else:
        low, high = f"{now} - @minutes({NOW_PAST})", f"{now} + @minutes({NOW_AHEAD})"
        order = "started, CASE WHEN started THEN -@epoch(starts_at) ELSE @epoch(starts_at) END"
    return f"""{VISIBLE}, {within(lat, lng, reach)},
  public_rule AS (SELECT * FROM (SELECT r.*, p.slug, p.name, p.address, p.metres, {ZONE} AS zone, {WINNER} AS rn FROM rule r JOIN near p ON p.id = r.place_id LEFT JOIN source s ON s.id = r.source_id WHERE {SHOWN}) WHERE rn = 1),
  applicable AS (SELECT r.* FROM public_rule r WHERE {applies(day, True)}),
  {timed("applicable", "near", day)},
  open AS (SELECT *, starts_at < {now} AS started, tefillah IN ('mincha', 'maariv') AND time_kind = 'fixed' AS fixed_evening FROM timed WHERE starts_at BETWEEN {low} AND {high}),
  feed AS (SELECT *, CAST(row_number() OVER (PARTITION BY place_id ORDER BY {order}, priority DESC, id) AS BIGINT) AS at_place FROM open)"""


def feed_order(travel: bool = False) -> str:
    return ("starts_at" if travel else "started, CASE WHEN started THEN -@epoch(starts_at) ELSE @epoch(starts_at) END") + ", metres, priority DESC, id"


def groups(per_place: int = 2, limit: int = 25) -> str:
    """The feed by place: nearest places first, the first rules of each."""
    return f"""SELECT f.place_id, f.slug, f.metres, f.id, f.tefillah, f.starts_at, f.at_place FROM feed f
  JOIN (SELECT DISTINCT place_id, metres FROM feed ORDER BY metres, place_id LIMIT {limit}) g ON g.place_id = f.place_id WHERE f.at_place <= {per_place}"""


NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Shabbos")


def _named_days(empty: str, daily: str, ranges: dict[str, str]) -> str:
    listed = "days"
    for k, name in enumerate(NAMES):
        listed = f"replace({listed}, '{k}', '{name}')"
    key = "@join(@sorted(@split(days, ',')), ',')"
    cases = " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in ranges.items())
    return f"CASE WHEN coalesce(days, '') = '' THEN '{empty}' WHEN @size(@split(days, ',')) = 7 THEN '{daily}' {cases} ELSE replace({listed}, ',', ', ') END"


# How days read on a place's page, and to those who review rules.
DAYS_LABEL = _named_days("—", "Daily", {"1,2,3,4,5": "Mon-Fri", "1,2,3,4": "Mon-Thu", "0,1,2,3,4": "Sun-Thu"})
DAYS_LABEL_REVIEW = _named_days("(no recurring day — check valid_from/to)", "Every day", {"1,2,3,4,5": "Mon-Fri"})
# How anchors read on a place's page; other names have spaces for underscores.
ANCHOR_LABELS = {
    "shkia": "sunset", "tzeis_72": "tzeis (72)", "tzeis_42": "tzeis (42)", "alos": "alos", "netz": "sunrise", "misheyakir": "misheyakir", "sof_zman_tefillah_mga": "sof zman tefillah (MGA)",
    "sof_zman_tefillah_gra": "sof zman tefillah (GRA)", "sof_zman_shma_mga": "sof zman shma (MGA)", "sof_zman_shma_gra": "sof zman shma (GRA)", "chatzos": "chatzos", "mincha_gedolah": "mincha gedolah",
    "plag_mincha": "plag", "candle_lighting": "candle-lighting",
}


def time_label(anchor: str) -> str:
    """12-hour clock, or "N min before", "N min after" or "at" an anchor."""
    hour = "CAST(split_part(clock, ':', 1) AS INT)"
    fixed = f"CASE WHEN @matches(clock, '^[0-9]+:[0-9]+') THEN concat(CAST(({hour} + 11) % 12 + 1 AS VARCHAR(3)), ':', lpad(CAST(CAST(split_part(clock, ':', 2) AS INT) AS VARCHAR(3)), 2, '0'), CASE WHEN {hour} >= 12 THEN ' PM' ELSE ' AM' END) ELSE clock END"
    return f"""CASE WHEN time_kind = 'fixed' THEN {fixed} WHEN offset_min = 0 THEN concat('at ', {anchor})
  ELSE concat(CAST(abs(offset_min) AS VARCHAR(5)), ' min ', CASE WHEN offset_min < 0 THEN 'before ' ELSE 'after ' END, {anchor}) END"""


TIME_LABEL = time_label("CASE anchor " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ANCHOR_LABELS.items()) + " ELSE replace(anchor, '_', ' ') END")
TIME_LABEL_REVIEW = time_label("replace(anchor, '_', ' ')")
# Seconds to a start as text; halves of a minute go up.
RELATIVE = """CASE WHEN abs(secs) < 60 THEN 'starting now' WHEN secs > 0 AND mins < 60 THEN concat('in ', CAST(mins AS VARCHAR(9)), 'm')
  WHEN secs > 0 THEN concat('in ', CAST(CAST(floor(mins / 60e0) AS BIGINT) AS VARCHAR(9)), 'h', CASE WHEN mins % 60 = 0 THEN '' ELSE concat(' ', CAST(mins % 60 AS VARCHAR(9)), 'm') END)
  WHEN mins < 60 THEN concat('started ', CAST(mins AS VARCHAR(9)), 'm ago') ELSE concat('started ', CAST(CAST(floor(mins / 60e0) AS BIGINT) AS VARCHAR(9)), 'h ago') END"""
# A date as text: null unless of the form; months and days beyond their range run on.
DATE_ONLY = "CASE WHEN @matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(CAST(concat(substring({t}, 1, 4), '-01-01') AS DATE) + @months(CAST(substring({t}, 6, 2) AS INT) - 1) AS DATE) + (CAST(substring({t}, 9, 2) AS INT) - 1) END"

POINT = (40.3, -74.1)
DAY, NOW = "DATE '1998-07-08'", "TIMESTAMP '1998-07-08 14:00:00'"
_FEED = feed(*POINT, radius(25.0), NOW, DAY)
_COLUMNS = "id, place_id, slug, tefillah, time_kind, metres, starts_at, started, fixed_evening"
_SPOT = f"sites AS (SELECT p.id, coalesce(p.lat, 0e0) AS lat, coalesce(p.lng, 0e0) AS lng, {ZONE} AS zone FROM place p)"
_LOCATED = f"{_SPOT}, located AS (SELECT r.*, p.zone FROM public_rule r JOIN sites p ON p.id = r.place_id WHERE {{where}})"
TEXT = {
    "nearby_feed": f"WITH {_FEED} SELECT {_COLUMNS} FROM feed ORDER BY {feed_order()} LIMIT 25",
    "travel_feed": f"WITH {feed(*POINT, radius(25.0), NOW, DAY, travel=True)} SELECT {_COLUMNS} FROM feed ORDER BY {feed_order(True)} LIMIT 25",
    "feed_by_place": f"WITH {_FEED} {groups()}",
    "day_schedule": f"WITH {PUBLIC}, {_LOCATED.format(where=applies(DAY, False))}, {timed('located', 'sites', DAY)} SELECT place_id, id, tefillah, starts_at, CAST(row_number() OVER (PARTITION BY place_id ORDER BY starts_at NULLS LAST, id) AS BIGINT) AS at_place FROM timed",
    "rule_instants": f"WITH {PUBLIC}, {_LOCATED.format(where='true')}, {timed('located', 'sites', DAY)} SELECT id, time_kind, anchor, starts_at FROM timed",
    "recurring_table": f"WITH {PUBLIC} SELECT r.place_id, r.tefillah, count(*) AS n FROM public_rule r WHERE r.special_kind = 'regular' GROUP BY r.place_id, r.tefillah",
    "sun_times": f"WITH {_SPOT}, {solar.sun_ctes('sites', DAY)} SELECT id, {', '.join(f'{solar.instant(n)} AS {n}' for n in solar.NAMES)} FROM sun",
    "fixed_clock_utc": f"WITH {PUBLIC}, {_LOCATED.format(where=chr(39).join(('r.time_kind = ', 'fixed', '')))}, {timed('located', 'sites', DAY)} SELECT id, starts_at AS utc FROM timed",
    "applies_feed_and_page": f"SELECT r.id, {applies(DAY, True)} AS in_feed, {applies(DAY, False)} AS on_page FROM rule r",
    "days_label": f"SELECT DISTINCT days, {DAYS_LABEL} AS label, {DAYS_LABEL_REVIEW} AS review_label FROM rule",
    "time_label": f"SELECT DISTINCT time_kind, clock, anchor, offset_min, {TIME_LABEL} AS label, {TIME_LABEL_REVIEW} AS review_label FROM rule",
    "relative_start": f"SELECT secs, {RELATIVE} AS label, secs < 0 AND secs > -1800 AS live FROM (SELECT secs, CAST(floor(abs(secs) / 60e0 + 0.5e0) AS BIGINT) AS mins FROM (SELECT DISTINCT CAST(floor(l_extendedprice) AS BIGINT) % 20000 - 9000 AS secs FROM lineitem))",
    "date_only": f"SELECT t, {DATE_ONLY.format(t='t')} AS day FROM (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN 'next week' ELSE concat('2024-', lpad(CAST(l_suppkey % 15 AS VARCHAR(2)), 2, '0'), '-', lpad(CAST(l_partkey % 40 AS VARCHAR(2)), 2, '0')) END AS t FROM lineitem)",
    "nearby_places": f"WITH {VISIBLE}, {within(*POINT, radius(25.0))} SELECT id, slug, metres FROM near",
    "radius_clamp": f"SELECT DISTINCT l_quantity AS miles, least(greatest(round(l_quantity * {METRES_PER_MILE}e0, 6), 50e0), 50000e0) AS metres FROM lineitem",
    "place_pairs_within": f"WITH {pairs_within('place', 2400.0)} SELECT a_id, b_id, metres FROM pair",
    # Many places at one spot are one row of a pair, with their number: no pair of places is written out.
    "spot_pairs": f"WITH spot AS (SELECT min(id) AS id, lat, lng, count(*) AS n FROM place WHERE lat IS NOT NULL GROUP BY lat, lng), {pairs_within('spot', 2400.0)} SELECT p.a_id, p.b_id, p.metres, a.n * b.n AS pairs FROM pair p JOIN spot a ON a.id = p.a_id JOIN spot b ON b.id = p.b_id UNION ALL SELECT id, id, 0e0, CAST(floor(n * (n - 1) / 2e0) AS BIGINT) FROM spot WHERE n > 1",
    "resolved_places": f"WITH {PUBLIC}, {_LOCATED.format(where='true')}, {timed('located', 'sites', DAY)} SELECT count(DISTINCT place_id) AS n_places, count(*) AS n_rules FROM timed WHERE starts_at IS NOT NULL",
}
TEXT |= zones.text(DEFAULT_ZONE)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return place_pairs(relation(spark, "place"), 2400.0)


QUERIES = {"place_pairs_within": _pairs}
