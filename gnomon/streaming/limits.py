"""Keyed state with lists, timers and times to live: rate limits, silence alarms, messages and tokens that count once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from gnomon.plans.ingest import LIMITS

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STRETCH = 4  # spans of a limit that are judged together; one more is read before each
BUSY = 1 << 16  # requests of a caller from which its time is dealt into stretches


def _verdicts(times: list[float], before: list[float], limit: int, window: int) -> tuple[list[bool], list[float]]:
    """Of requests in order: whether each is beyond ``limit`` in ``window`` seconds, itself counted; and the last ones, as many as that needs."""
    out, held = [], list(before)
    for t in times:
        held.append(t)
        held = held[-(limit + 1) :]
        out.append(len(held) > limit and held[0] >= t - window)
    return out, held


def beyond(requests: DataFrame, at: Column, limits: dict[str, tuple[int, int]], order: str | None = None) -> DataFrame:
    """Adds ``limited`` to requests (kind, who, ...): whether more than their kind's limit of the caller's lie in the span before ``at``, itself and later equals counted.

    ``order`` tells equals apart: of these, only those up to a request count. ``at`` and spans are whole numbers of one unit; requests
    without an instant are equals of each other. The time of a caller of many requests is dealt into stretches of some spans, each with the
    span before it, so it is many groups; in a group it is enough to look back as many requests as the limit.
    """
    size, span = (F.element_at(F.create_map(*(F.lit(x) for k, v in limits.items() for x in (k, v[i]))), F.col("kind")).cast("long") for i in (0, 1))
    timed = requests.withColumns({"_at": F.coalesce(at, F.lit(0).cast("long")), "_none": at.isNull(), "_size": size, "_span": span})
    busy = requests.groupBy("kind", "who").agg(F.count("*").alias("_n")).filter(F.col("_n") > BUSY).drop("_n").withColumn("_busy", F.lit(True))
    cut = F.when(~F.col("_none") & F.col("_busy"), F.expr(f"(_at - pmod(_at, _span * {STRETCH})) div (_span * {STRETCH})"))
    home = timed.join(busy, ["kind", "who"], "left").withColumn("_home", cut)
    near = F.col("_at") >= (F.col("_home") + 1) * F.col("_span") * STRETCH - F.col("_span")  # the next stretch looks back at it
    dealt = home.withColumn("_stretch", F.explode(F.when(near, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))
    group = ["kind", "who", "_none", "_stretch"]
    line = Window.partitionBy(*group).orderBy(*(x for x in ("_at", order) if x))
    before = F.lit(None).cast("long")
    for n in sorted({n for n, _ in limits.values()}):
        before = F.when(F.col("_size") == n, F.lag("_at", n).over(line)).otherwise(before)
    judged = dealt.withColumn("limited", F.coalesce(before >= F.col("_at") - F.col("_span"), F.lit(False)))
    if order is None:  # the last of the equals has them all before it
        judged = judged.withColumn("limited", F.max("limited").over(Window.partitionBy(*group, "_at")))
    return judged.filter(F.col("_stretch").eqNullSafe(F.col("_home"))).select(*requests.columns, "limited")


def rate_limits(requests: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """id, kind, who, ts, limited: requests (id, kind, who, ts) beyond their kind's (limit, seconds), refused ones counted as well.

    Requests of one caller count in order of ts, then id; several at one instant in that order. A null or empty caller, and a
    kind without a limit, is never limited. Works on a batch by windows, and on a stream with the last
    requests of each (kind, who) as a list that is given up the longest window after the last of them was seen (by the clock, so such a stream
    goes on until it is stopped); a stream takes requests as they come, so verdicts are the batch's where they come in order.
    """
    size = F.create_map(*(F.lit(x) for k, (n, _) in limits.items() for x in (k, n)))
    free = F.col("who").isNull() | (F.col("who") == "") | F.element_at(size, F.col("kind")).isNull()
    asked = requests.select("id", "kind", "who", "ts")
    if not requests.isStreaming:
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        counted = beyond(asked.filter(~free), at, {k: (n, s * 1_000_000) for k, (n, s) in limits.items()}, "id")
        return counted.select("id", "kind", "who", "ts", "limited").unionByName(asked.filter(free).withColumn("limited", F.lit(False)))
    requests.sparkSession.conf.set(*_STORE)
    key = F.when(free, F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise(F.concat_ws("/", "kind", "who"))  # no caller: each request alone
    keyed = asked.withColumn("key", key)
    longest = max(s for _, s in limits.values()) * 1000

    class Requests(StatefulProcessor):
        def init(self, handle) -> None:
            self.times = handle.getListState("times", "at double", longest)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            df = pd.concat(list(rows)).sort_values(["ts", "id"])
            if key[0].startswith("-"):
                df["limited"] = False
            else:
                limit, window = limits[df["kind"].iloc[0]]
                before = [x[0] for x in self.times.get()] if self.times.exists() else []
                df["limited"], held = _verdicts([t.timestamp() for t in df["ts"]], before, limit, window)
                self.times.put([(x,) for x in held])
            yield df[["id", "kind", "who", "ts", "limited"]]

        def close(self) -> None:
            pass

    types = dict(asked.dtypes)
    return keyed.groupBy("key").transformWithStateInPandas(Requests(), f"id {types['id']}, kind string, who string, ts timestamp, limited boolean", "Append", "ProcessingTime")


def silence(runs: DataFrame, within: int = 7 * 86400, late: str = "1 hour") -> DataFrame:
    """lane, raised, since, at: alarms of a stream of runs (lane, ts), each with an event-time timer.

    A lane without a run for ``within`` seconds raises one alarm, at the instant the time is up; its next run clears it (raised
    false). Time moves by the events of all lanes (and later ones than ``late`` are dropped), so a lane that marks time, such as
    a row an hour with lane 'clock', lets the others be found silent. Rows without a lane only move time.
    """
    runs.sparkSession.conf.set(*_STORE)

    class Watch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at timestamp, alarmed boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            times = sorted(t for df in rows for t in df["ts"])
            out = []
            if key[0] is not None:
                last, alarmed = self.last.get() if self.last.exists() else (None, False)
                for t in times:
                    if last is not None and not alarmed and (t - last).total_seconds() >= within:
                        out.append((key[0], True, last, last + pd.Timedelta(seconds=within)))  # a gap within what came at once
                        alarmed = True
                    if alarmed and t > last:
                        out.append((key[0], False, last, t))
                        alarmed = False
                    last = t if last is None else max(last, t)
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.last.update((last, alarmed))
                self.handle.registerTimer(max(int(last.timestamp() * 1000) + within * 1000, timerValues.getCurrentWatermarkInMs() + 1))
            yield _alarms(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, alarmed = self.last.get()
            self.last.update((last, True))
            yield _alarms([] if alarmed else [(key[0], True, last, pd.Timestamp(last) + pd.Timedelta(seconds=within))])

        def close(self) -> None:
            pass

    return runs.select("lane", "ts").withWatermark("ts", late).groupBy("lane").transformWithStateInPandas(Watch(), "lane string, raised boolean, since timestamp, at timestamp", "Append", "EventTime")


def _alarms(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["lane", "raised", "since", "at"])
    return df.astype({"lane": "object", "raised": "bool", "since": "datetime64[ns]", "at": "datetime64[ns]"})


def once(messages: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """A stream's messages, each ``key`` once: what comes again within the time after the first is left out. Messages without a key are refused."""
    return messages.filter(F.col(key).isNotNull()).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def consume(tokens: DataFrame, key: str, used: str, accepted: str, checkpoint: str) -> StreamingQuery:
    """Accept each token the first time it comes: rows of a stream whose ``key`` is not in the table ``used`` go to ``accepted``, and their keys to ``used``.

    Both tables are written a folder a batch, so a batch that is tried again after a failure writes the same
    folders again and finds the tokens that others have used, not its own. Of a key's rows in a batch the least by all columns counts.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("row")).select("row.*")
        before = _used(spark, used, key, batch_id)
        fresh = first if before is None else first.join(before, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        spark.read.schema(fresh.schema).parquet(f"{accepted}/batch={batch_id}").select(key).write.mode("overwrite").parquet(f"{used}/batch={batch_id}")

    return tokens.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _used(spark: SparkSession, used: str, key: str, batch_id: int) -> DataFrame | None:
    """Keys that other batches have used; None before the first."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{used}/batch=*/_SUCCESS")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top)
    return spark.read.option("basePath", used).parquet(*(x.getPath().getParent().toString() for x in found)).filter(F.col("batch") != batch_id).select(key) if found else None


_ASKED = """SELECT CAST(event_id AS INT) AS id, CASE event_type WHEN 'view' THEN 'report' WHEN 'click' THEN 'submit' WHEN 'signup' THEN 'link_mail' WHEN 'error' THEN 'inbound' ELSE 'link_address' END AS kind,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN 'global' ELSE CAST(user_id AS VARCHAR(20)) END AS who, ts FROM events"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.sources.model import register

    register(spark, sf_dir)
    return rate_limits(spark.sql(_ASKED))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In whole seconds, and equals all count: what the SQL of the same name says by windows."""
    from gnomon.plans.dialect import spark_sql
    from gnomon.sources.model import register

    register(spark, sf_dir)
    asked = spark.sql(spark_sql(_HITS))
    counted = beyond(asked.filter("who IS NOT NULL"), F.col("at"), LIMITS)
    return counted.select("event_id", "kind", "limited").unionByName(asked.filter("who IS NULL").select("event_id", "kind", F.lit(False).alias("limited")))


_HITS = f"SELECT id AS event_id, kind, who, @epoch(ts) AS at FROM ({_ASKED.replace('CAST(event_id AS INT)', 'event_id')})"
QUERIES = {"rate_limit_verdicts": _asked, "rate_limit_hits": _hits}
_SPAN = "count(*) OVER (PARTITION BY kind, who ORDER BY epoch_us(ts) RANGE BETWEEN {0}000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY kind, who, ts) + row_number() OVER (PARTITION BY kind, who, ts ORDER BY id)"
ORACLE = {"rate_limit_verdicts": f"SELECT id, kind, who, ts, coalesce(who, '') <> '' AND CASE kind {' '.join(f"WHEN '{k}' THEN {_SPAN.format(s)} > {n}" for k, (n, s) in LIMITS.items())} END AS limited FROM ({_ASKED})"}
