"""Streams against batches of the same rows, restarts and replays included."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from gnomon.streaming import limits

T0 = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
REQUEST = "id int, kind string, who string, ts timestamp"


def requests(seed, n):
    r = random.Random(seed)
    rows, at = [], T0
    for k in range(n):
        at += dt.timedelta(seconds=r.choice([0, 1, 30, 30, 200, 200, 900]))
        rows.append((k, r.choice(["submit", "link_mail", "inbound", "report", "other"]), r.choice(["a", "b", "c", None, ""]), at))
    return rows


def plain(rows, kinds):
    out, seen = {}, {}
    for i, kind, who, ts in sorted(rows, key=lambda x: (x[3], x[0])):
        if not who or kind not in kinds:
            out[i] = False
            continue
        limit, window = kinds[kind]
        before = seen.setdefault((kind, who), [])
        before.append(ts)
        out[i] = sum((ts - t).total_seconds() <= window for t in before) > limit
    return out


KINDS = {"submit": (5, 3600), "link_mail": (3, 3600), "inbound": (8, 86400), "report": (20, 3600)}


def drain(query):
    assert query.awaitTermination(240), "the stream has not ended"


def test_rate_limits_of_a_batch(spark):
    rows = requests(1, 600)
    got = {r.id: r.limited for r in limits.rate_limits(spark.createDataFrame(rows, REQUEST), KINDS).collect()}
    assert got == plain(rows, KINDS) and 20 < sum(got.values()) < 500, sum(got.values())
    assert limits.rate_limits(spark.createDataFrame([], REQUEST), KINDS).count() == 0


def test_rate_limits_of_a_stream(spark, tmp_path):
    """The same verdicts, a batch a file, with the query stopped and started again between."""
    rows = requests(2, 240)
    for part in range(2):
        spark.createDataFrame(rows[part * 120 : part * 120 + 120], REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limits.rate_limits(spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in")), KINDS)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()  # state with a time to live keeps a stream going
        end = time.monotonic() + 120
        while time.monotonic() < end and query.isActive and sum(p["numInputRows"] for p in query.recentProgress) < 120:
            time.sleep(0.5)
        query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(rows) and {r.id: r.limited for r in got} == plain(rows, KINDS)


def test_silence_raises_once_and_a_run_clears_it(spark, tmp_path):
    day = dt.timedelta(days=1)
    files = [
        [("a", T0), ("b", T0 + day), (None, T0 + 2 * day)],
        [("b", T0 + 5 * day), ("clock", T0 + 8 * day)],  # a is silent since T0
        [("clock", T0 + 10 * day), ("b", T0 + 9 * day)],
        [("clock", T0 + 20 * day)],  # b is silent, a still is: no second alarm
        [("a", T0 + 21 * day), ("clock", T0 + 22 * day)],  # a runs again
        [("clock", T0 + 23 * day)],
    ]
    for rows in files:
        spark.createDataFrame(rows, "lane string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limits.silence(spark.readStream.schema("lane string, ts timestamp").parquet(str(tmp_path / "in")))
        drain(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    got = sorted((r.lane, r["at"], r.raised, r.since) for r in spark.read.parquet(str(tmp_path / "out")).filter("lane <> 'clock'").collect())
    bare = T0.replace(tzinfo=None)
    assert got == [("a", bare + 7 * day, True, bare), ("a", bare + 21 * day, False, bare), ("b", bare + 16 * day, True, bare + 9 * day)]


def test_messages_count_once(spark, tmp_path):
    rows = [("m1", "x", T0), ("m2", "y", T0), (None, "z", T0)]
    out, seen = str(tmp_path / "out"), str(tmp_path / "in")
    for _ in range(2):  # the same file twice
        spark.createDataFrame(rows, "id string, body string, ts timestamp").coalesce(1).write.mode("append").parquet(seen)
        stream = limits.once(spark.readStream.schema("id string, body string, ts timestamp").parquet(seen), "id", "ts")
        drain(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start())
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["m1", "m2"]


def test_tokens_are_used_once(spark, tmp_path):
    folders = [str(tmp_path / x) for x in ("used", "accepted", "check")]
    for rows in ([("t1", 1), ("t1", 2), ("t2", 3)], [("t2", 4), ("t3", 5), (None, 6)], [("t1", 7)]):
        spark.createDataFrame(rows, "token string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(limits.consume(spark.readStream.schema("token string, n int").parquet(str(tmp_path / "in")), "token", *folders))
    assert sorted((r.token, r.n) for r in spark.read.parquet(folders[1]).collect()) == [("t1", 1), ("t2", 3), ("t3", 5)]
    # a batch tried again finds what other batches have used, not its own tokens
    assert sorted(r.token for r in limits._used(spark, folders[0], "token", 0).collect()) == ["t3"]


def test_rate_limits_look_back_no_further_than_the_limit(spark, monkeypatch):
    """Busy callers' time is dealt into stretches: no group grows with a caller, and no row reads its whole span again."""
    rows = [*requests(3, 900), *((1000 + k, "inbound", "a", None) for k in range(20)), (2000, "submit", "a", T0 - dt.timedelta(days=20000)), (2001, "submit", "a", T0 - dt.timedelta(days=20000, seconds=3600))]
    frame = spark.createDataFrame(rows, REQUEST)
    whole = {r.id: r.limited for r in limits.rate_limits(frame, KINDS).collect()}
    monkeypatch.setattr(limits, "BUSY", 5)
    dealt = limits.rate_limits(frame, KINDS)
    assert {r.id: r.limited for r in dealt.collect()} == whole and len(whole) == len(rows)
    assert {i: x for i, x in whole.items() if i < 1000 or i >= 2000} == plain([r for r in rows if r[3]], KINDS)
    assert [whole[1000 + k] for k in range(20)] == [k >= 8 for k in range(20)]  # without an instant: equals, in order of id
    assert "RangeFrame" not in dealt._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("busy", [2, 1 << 16])
def test_equal_requests_count_together(spark, monkeypatch, busy):
    monkeypatch.setattr(limits, "BUSY", busy)
    r = random.Random(4)
    rows = [(k, kind, r.choice("ab"), r.choice([None, *range(-30, 60)])) for k, kind in enumerate(["x", "y"] * 150)]
    sizes = {"x": (4, 10), "y": (7, 3)}
    got = {x.id: x.limited for x in limits.beyond(spark.createDataFrame(rows, "id int, kind string, who string, at long"), F.col("at"), sizes).collect()}
    near = lambda a, b, s: a is b is None or None not in (a, b) and 0 <= b - a <= s
    assert got == {i: sum(k == kind and w == who and near(t, at, sizes[kind][1]) for _, k, w, t in rows) > sizes[kind][0] for i, kind, who, at in rows} and 20 < sum(got.values()) < 280
