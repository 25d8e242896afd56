from __future__ import annotations

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
HAS_DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def same(value):
    if value is None or value != value:
        return None
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return round(value, 6)
    return value


@HAS_DATA
@pytest.mark.parametrize("name", ["count_places_by_status", "visible_places", "public_rules_dedup", "nearby_feed", "source_state", "admin_feed", "daily_spend", "guardrail", "page_links", "place_pairs_within", "superseded", "review_payload", "fan_out", "email_body_hash", "hostname_tokens", "identifier_label", "image_candidates", "transient_failure", "mass_breakage"])
def test_equals_sql(spark, name):
    from gnomon.plans import catalog

    got = catalog.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from read_parquet('{SF}/{t}')")
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted((tuple(same(x) for x in r) for r in rows), key=str)
    assert key(cur.fetchall()) == key(tuple(r[c] for c in names) for r in got.collect())


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


@HAS_DATA
def test_feed_plan_is_native(spark):
    from gnomon.plans import catalog

    plan = catalog.QUERIES["nearby_feed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "WindowGroupLimit" in plan


def test_spring_gap(spark):
    """A wall clock in the hour that a spring change skips: the second correction moves it an hour earlier."""
    from gnomon.plans import schedule
    from gnomon.plans.dialect import spark_sql

    spark.createDataFrame([(1, 1, "fixed", "02:30", None, 0, "America/New_York"), (2, 1, "fixed", "19:00", None, 0, "America/New_York")], "id int, place_id int, time_kind string, clock string, anchor string, offset_min int, zone string").createOrReplaceTempView("gap_rule")
    spark.createDataFrame([(1, 40.7, -74.0)], "id int, lat double, lng double").createOrReplaceTempView("gap_place")
    text = f"WITH {schedule.timed('gap_rule', 'gap_place', chr(68) + 'ATE ' + repr('2024-03-10'))} SELECT id, CAST(starts_at AS STRING) AS at FROM timed"
    assert {r.id: r["at"] for r in spark.sql(spark_sql(text)).collect()} == {1: "2024-03-10 06:30:00", 2: "2024-03-10 23:00:00"}


@pytest.mark.parametrize(("received", "run", "want"), [(None, 14, True), (None, 15, False), (1, 30, True), (30, 1, False), (None, None, False)])
def test_freshness(spark, received, run, want):
    from gnomon.plans.dialect import spark_sql
    from gnomon.plans.schedule import FRESH
    from gnomon.sources.model import AS_OF

    ago = lambda d: None if d is None else dt.datetime.fromisoformat(AS_OF) - dt.timedelta(days=d)
    spark.createDataFrame([("approved", "ok", ago(received), ago(run))], "review_status string, run_status string, last_received_at timestamp, last_run_at timestamp").createOrReplaceTempView("fresh_source")
    assert spark.sql(spark_sql(f"SELECT * FROM fresh_source s WHERE {FRESH}")).count() == int(want)


def test_sun(spark):
    from gnomon.functions import solar
    from gnomon.plans.dialect import spark_sql

    text = f"WITH at AS (SELECT CAST(lat AS DOUBLE) AS lat, CAST(-74.01 AS DOUBLE) AS lng FROM VALUES (40.71), (80) AS v(lat)), {solar.sun_ctes('at', chr(68) + 'ATE ' + repr('2024-06-20'))} SELECT {solar.instant('netz')} AS up, {solar.instant('shkia')} AS down FROM sun ORDER BY lat"
    sun, none = spark.sql(spark_sql(text)).collect()
    minutes = lambda t: t.hour * 60 + t.minute
    assert abs(minutes(sun.up) - (9 * 60 + 25)) <= 2 and abs(minutes(sun.down) - 31) <= 2 and none.down is None


def test_report_dedupe_on_a_stream(spark, tmp_path):
    from gnomon.streaming.state import dedupe_reports

    at = dt.datetime(2024, 1, 1)
    rows = [(1, 5, 7, at), (2, 5, 7, at + dt.timedelta(hours=23)), (3, 5, 7, at + dt.timedelta(hours=25)), (4, 5, None, at), (5, 5, None, at)]
    df = spark.createDataFrame(rows, "id int, place_id int, reporter int, created_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = dedupe_reports(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("kept_reports").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.id: r.kept for r in spark.table("kept_reports").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_transitions(spark):
    from gnomon.operators.transitions import apply_runs

    now = dt.datetime(2024, 5, 1)
    sources = spark.createDataFrame([(1, "pending", "error", 0.1, None, now), (2, "approved", "ok", 0.9, None, None), (3, "approved", "ok", 0.9, None, None)], "id int, review_status string, run_status string, confidence double, last_run_at timestamp, first_broken_at timestamp")
    rules = spark.createDataFrame([("a", 1, False, False), ("b", 1, False, True), ("c", 2, False, False)], "id string, source_id int, is_deleted boolean, is_manual_edit boolean")
    results = spark.createDataFrame([(1, 0.8, [("n",), ("m",)]), (2, 0.2, [("z",)])], "source_id int, confidence double, rules array<struct<id:string>>")
    s, r, runs = apply_runs(sources, rules, results, F.lit(now).cast("timestamp"))
    by = {x.id: x for x in s.collect()}
    assert (by[1].run_status, by[1].review_status, by[1].first_broken_at) == ("ok", "approved", None)
    assert (by[2].run_status, by[2].review_status, by[2].first_broken_at) == ("broken", "approved", now) and by[3].run_status == "ok"
    assert {(x.id, x.is_deleted) for x in r.collect()} == {("a", True), ("b", False), ("c", False), ("n", False), ("m", False)}
    assert {(x.source_id, x.status) for x in runs.collect()} == {(1, "ok"), (2, "broken")}


@HAS_DATA
def test_sun_times(spark):
    from gnomon.plans import catalog

    row = catalog.QUERIES["sun_times"](spark, SF).first()
    assert row.alos < row.misheyakir < row.netz < row.sof_zman_shma_mga < row.sof_zman_shma_gra < row.sof_zman_tefillah_gra < row.chatzos < row.mincha_gedolah < row.plag_mincha < row.candle_lighting < row.shkia < row.tzeis_42 < row.havdalah < row.tzeis_72
