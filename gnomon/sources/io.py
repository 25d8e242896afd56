"""Sources and sinks beside the tables: target lists, candidate files, change notes, messages; appended and replaced tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gnomon.plans.dialect import spark_sql

CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # from Spark 4.1 on; earlier ones know no such setting and keep the files
MESSAGE = "From string, Subject string, TextBody string, Headers array<struct<Name:string,Value:string>>"


def targets(spark: SparkSession, path: str, region: str | None = None, tier: int | None = None, name: str | None = None) -> DataFrame:
    """Discovery targets of a JSON file {"targets": [{name, region, tier}, ...]}; 'all' and None do not filter."""
    rows = spark.read.schema("targets array<struct<name:string,region:string,tier:int>>").json(path, multiLine=True).select(F.inline("targets"))
    for column, wanted in (("region", region), ("tier", tier), ("name", name)):
        if wanted not in (None, "all"):
            rows = rows.filter(F.col(column) == wanted)
    return rows


def candidate_urls(spark: SparkSession, path: str) -> DataFrame:
    """url: the lines of a file without blanks and comments, normalised, each once."""
    lines = spark.read.text(path).select(F.trim("value").alias("u")).filter("u <> '' and not startswith(u, '#')")
    whole = F.when(F.col("u").rlike("(?i)^https?://"), F.col("u")).otherwise(F.concat(F.lit("https://"), "u"))
    return lines.select(F.regexp_replace(F.regexp_replace(whole, "[?#].*$", ""), "/$", "").alias("url")).distinct()


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of files of change notes, each read whole; no rows where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "file string, line_no int, line string")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n"))).select("file", F.col("pos").alias("line_no"), F.col("col").alias("line"))


def changelog(spark: SparkSession, path: str) -> DataFrame:
    """Versions, sections and bullets of a file of change notes."""
    from gnomon.plans import pages
    from gnomon.plans.catalog import with_extras

    notes(spark, path).createOrReplaceTempView("notes")
    return spark.sql(spark_sql(with_extras(pages.TEXT["changelog"])))


def received(raw: DataFrame) -> DataFrame:
    """Messages with a sender and a text, as events; others are refused. Headers are an array of (Name, Value) still."""
    sender, body = F.lower(F.trim("From")), F.trim("TextBody")
    return raw.select(sender.alias("forwarder"), F.trim(F.coalesce("Subject", F.lit(""))).alias("subject"), body.alias("body"), "Headers").filter("forwarder <> '' and body <> ''")


def header_rows(messages: DataFrame, key: str) -> DataFrame:
    """key, name, value: the headers (an array of Name and Value) of messages as rows, names in lower case; of one that repeats the first."""
    each = messages.select(key, F.posexplode("Headers").alias("pos", "h")).select(key, F.lower(F.trim("h.Name")).alias("name"), "h.Value", "pos").filter("name <> ''")
    return each.groupBy(key, "name").agg(F.min(F.struct("pos", "Value"))["Value"].alias("value"))


def message_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that arrive as JSON files in a folder."""
    return received(spark.readStream.schema(MESSAGE).json(folder))


def image_files(spark: SparkSession, folder: str, most: int = 25_000_000) -> DataFrame:
    """path, length, content and why not: files of at most ``most`` bytes; larger ones are not read and have no content but a reason."""
    files = spark.read.format("binaryFile").load(folder)
    read = files.filter(F.col("length") <= most).select("path", "length", "content", F.lit(None).cast("string").alias("reason"))
    return read.unionByName(files.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit(f"larger than {most} bytes").alias("reason")))


def outlines(spark: SparkSession, path: str, name: str = "tzid") -> DataFrame:
    """rank, zone, ring, xs, ys: a row a ring of the polygons of a GeoJSON file, in the file's order; ``name`` is the property that names a zone.

    The file is one collection of features, or has a feature a line. Other geometries are left out.
    """
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    lines = spark.read.schema(f"type string, features array<{feature}>, properties map<string,string>, geometry struct<type:string,coordinates:string>").json(path, multiLine=not path.endswith(("l", "seq")))
    each = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.coalesce("features", F.array(F.struct("properties", "geometry").cast(feature)))).alias("pos", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = F.when(kind == "Polygon", F.from_json(raw, one)).when(kind == "MultiPolygon", F.flatten(F.from_json(raw, many)))
    zone = F.col("f.properties")[name]
    ranked = each.filter(kind.isin("Polygon", "MultiPolygon")).select("line", "pos", zone.alias("zone"), parts.alias("parts")).withColumn("rank", F.dense_rank().over(Window.orderBy("line", "pos")))  # one row a zone: few
    return ranked.select("rank", "zone", F.posexplode("parts").alias("ring", "ps")).select("rank", "zone", "ring", F.transform("ps", lambda p: p[0]).alias("xs"), F.transform("ps", lambda p: p[1]).alias("ys"))


def suffixes(spark: SparkSession, path: str) -> DataFrame:
    """name: the rules of a public-suffix list, a file with a rule a line and // before comments; made the table ``suffix`` that domains are read by."""
    rules = spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1)).alias("name")).filter("name <> '' and not startswith(name, '//')").distinct()
    rules.createOrReplaceTempView("suffix")
    return rules


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: a local one if all runs on this machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file:///tmp/gnomon-checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialise(df: DataFrame, codec: str = "zstd", clear: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cut lineage that survives executors.

    The table is removed by ``discard``, or else when the driver's JVM ends. With ``clear`` the shuffle files
    of the job go as soon as it is over; else when the driver's garbage is collected and another job has run since.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/gnomon-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAR, None)
    if clear:
        spark.conf.set(CLEAR, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if clear and before is None:
            spark.conf.unset(CLEAR)
        elif clear:
            spark.conf.set(CLEAR, before)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = where
    return back


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote, once nothing will read them again."""
    for t in tables:
        t.written_to.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(t.written_to, True)


def fetched(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """What the fetch chain makes of recorded responses: see ``gnomon.plans.fetch`` for both tables' columns.

    Repeated addresses count once; one request has one row. Rounds of the recursion are bounded by the redirects that are followed.
    """
    from gnomon.plans.fetch import chain

    return chain(requests.select("url").filter("url IS NOT NULL").distinct(), responses.dropDuplicates(["url", "agent"]))


def append(rows: DataFrame, path: str) -> None:
    """Insert: rows are added to a table."""
    rows.write.mode("append").parquet(path)


def newest(changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: the one with the largest ``order`` and, where that ties or is not named, the largest by all columns. Null keys are left out."""
    rest = [c for c in changes.columns if c != key]
    by = [F.col(order)] if order else []
    row = F.max(F.struct(*(x.alias(f"o{k}") for k, x in enumerate(by)), F.struct(*rest).alias("r")))["r"] if rest else F.lit(None)
    return changes.filter(F.col(key).isNotNull()).groupBy(key).agg(row.alias("r")).select(key, *(F.col("r")[c].alias(c) for c in rest))


def update_by_key(table: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Update: a table's next version, with the columns that ``changes`` has set for its keys; other keys are left out of it.

    Of a key's changes the one with the largest ``order`` counts (see ``newest``), so no row is doubled.
    """
    names = [c for c in changes.columns if c != key and c in table.columns]
    fresh = next(f"change{k}" for k in range(len(table.columns) + 1) if f"change{k}" not in table.columns)
    marked = newest(changes.select(key, *names, *([order] if order and order not in (key, *names) else [])), key, order).select(key, F.struct(F.lit(True).alias("hit"), *names).alias(fresh))
    joined = table.join(marked, key, "left")
    return joined.select(*(F.when(F.col(fresh)["hit"], F.col(fresh)[c]).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


BUCKETS = 256  # folders of a keyed table, by hash of the key


def keyed(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table that ``upsert`` changes: a folder for each of ``buckets`` hashes of its key."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert(changes: DataFrame, path: str, key: str, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Change rows of a keyed table in place and add those of new keys: only buckets that hold changed keys are read and written.

    New keys have null in columns that ``changes`` lacks. Of a key's changes the one with the largest ``order`` counts
    (see ``newest``). A job that fails leaves the buckets as they were, and one that is run again gives the same table.
    """
    spark = changes.sparkSession
    latest = newest(changes, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    hit = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not hit:
        return
    old = spark.read.parquet(path).filter(F.col("bucket").isin(hit))
    new = latest.join(old.select(key), key, "left_anti")
    added = new.select(*(F.col(c).cast(old.schema[c].dataType).alias(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    out = update_by_key(old, latest.drop("bucket"), key).unionByName(added)
    out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def publish(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write the next version of several tables at once: readers see it by its marker, which is written last.

    A version that is there already is left as it is, so a repeated batch does nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={version:010d}/{name}")
    fs = path("x").getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path("_COMMITTED")):
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{root}/v={version:010d}/{name}")
        fs.create(path("_COMMITTED")).close()
    return f"{root}/v={version:010d}"


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest version that is complete."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v=*/_COMMITTED")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(top)
    if not found:
        raise FileNotFoundError(f"no complete version in {root}")
    return spark.read.parquet(f"{max(x.getPath().getParent().toString() for x in found)}/{name}")


def apply_stream(events: DataFrame, key: str, step, root: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream into published versions: ``step(batch, batch_id)`` returns the tables of the next one.

    A batch is dealt by ``key``, so one key's events are worked on by one task at a time; its id is the
    version, so a batch that is tried again after a failure publishes nothing twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        publish(step(batch.repartition(key), batch_id), root, batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
