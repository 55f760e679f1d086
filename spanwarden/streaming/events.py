"""Change events as a stream: parse, authorise, filter, dedupe with a watermark, scan each batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PULL_REQUEST_EVENT

MAX_BODY = 10 * 1024 * 1024


def deliveries(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """value, ts: deliveries that a receiver drops as files (one JSON body each) in a folder, as a stream; ``ts`` is the file's time."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return raw.select("value", F.col("_metadata.file_modification_time").alias("ts"))


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    return raw.withColumn("event", F.from_json(F.col(column).cast("string"), PULL_REQUEST_EVENT))


def should_scan(event: str = "event") -> Column:
    """Opened, updated or reopened, still open and no draft."""
    e = F.col(event)
    return F.coalesce(e["action"].isin("opened", "synchronize", "reopened") & (e["pull_request"]["state"] == "open") & ~F.coalesce(e["pull_request"]["draft"], F.lit(False)) & e["installation"]["id"].isNotNull(), F.lit(False))


def route(kind: Column, action: Column) -> Column:
    """What an event leads to: scan, pong, store (installations) or ignored."""
    return F.when(kind == "ping", "pong").when(kind == "pull_request", "scan").when((kind == "installation") & action.isin("created", "new_permissions_accepted"), "store").otherwise("ignored")


def signature_status(body: Column, signature: Column, secret: str | None) -> Column:
    """HTTP status of a delivery: 200, 401 (missing or wrong), 413 (too large) or 500 (no secret is set)."""

    if not secret:
        return F.lit(500)
    data = F.coalesce(body.cast("binary"), F.lit(b""))
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")  # a code of two hashes, of the body and of that hash
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), data), 256))
    want = F.concat(F.lit("sha256="), F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256))
    # compared as hashes, so that the time does not tell how much of it is right
    same = F.sha2(want, 256) == F.sha2(F.coalesce(signature, F.lit("")), 256)
    return F.when(F.octet_length(data) > MAX_BODY, 413).when(same, 200).otherwise(401)


#: What an installation's event makes of it.
INSTALLATION = {"created": "active", "new_permissions_accepted": "active", "unsuspend": "active", "suspend": "suspended", "deleted": "deleted"}


def installation_log(raw: DataFrame, kind: str = "kind", column: str = "value", ts: str = "ts") -> DataFrame:
    """installation_id, status, ts: what the deliveries of kind installation say."""
    said = raw.filter(F.col(kind) == "installation").select(F.from_json(F.col(column).cast("string"), "action string, installation struct<id:long>").alias("e"), F.col(ts).alias("ts"))
    status = F.create_map(*[F.lit(x) for pair in INSTALLATION.items() for x in pair])
    rows = said.select(F.col("e.installation.id").alias("installation_id"), F.try_element_at(status, F.col("e.action")).alias("status"), "ts")
    return rows.filter(F.col("installation_id").isNotNull() & F.col("status").isNotNull())


def authorised(requests: DataFrame, log: DataFrame, key: str = "installation_id", ts: str = "ts") -> DataFrame:
    """The requests whose installation was active when they came: the last entry of the log up to then says so.

    Entries become intervals, as many as the log has rows, and the join is one on the installation with a range of times; of entries of one time the
    strictest holds. A busy installation has many requests but few intervals.
    """
    rank = F.when(F.col("status") == "deleted", 2).when(F.col("status") == "suspended", 1).otherwise(0)
    once = log.groupBy(F.col(key).alias("__key"), F.col("ts").alias("__from")).agg(F.max_by("status", rank).alias("__status"))
    order = Window.partitionBy("__key").orderBy("__from")
    spans = once.withColumn("__to", F.lead("__from").over(order)).filter("__status = 'active'")
    on = (F.col(key) == F.col("__key")) & (F.col(ts) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(ts) < F.col("__to")))
    return requests.join(spans, on, "left_semi")


def run_authorised(raw: DataFrame, state: str, scan_batch: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Scan the pull requests of installations that are active at their time; ``raw``: kind, value, ts.

    What is known of installations is a table of versions by batch: batch n reads that of n - 1, adds its own entries and writes its own version in
    full, so a batch that is repeated after a failure finds what it found before. The last entry of each installation is kept, and
    two versions. ``state`` belongs to one checkpoint.
    """
    spark = raw.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs

    def place(n: int):
        where = fs.Path(f"{state.rstrip('/')}/batch={n}")
        return where, where.getFileSystem(spark._jsc.hadoopConfiguration())

    def step(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        before, store = place(n - 1)
        log = installation_log(batch)
        if store.exists(before):
            log = spark.read.schema("installation_id long, status string, ts timestamp").parquet(before.toString()).unionByName(log)
        log = log.persist()
        rank = F.when(F.col("status") == "deleted", 2).when(F.col("status") == "suspended", 1).otherwise(0)
        log.groupBy("installation_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", rank)).alias("l")).select("installation_id", "l.*").write.mode("overwrite").parquet(place(n)[0].toString())
        asked = parse(batch.filter("kind = 'pull_request'")).withColumn("installation_id", F.col("event.installation.id"))
        scan_batch(authorised(asked.filter(should_scan()), log), n)
        old, store = place(n - 2)
        if store.exists(old):
            store.delete(old, True)
        log.unpersist()
        batch.unpersist()

    return run(raw, step, checkpoint, **trigger)


def to_scan(raw: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One row per (repository, number, head) to scan; repeated deliveries within the watermark go."""
    e = parse(raw).filter(should_scan()).select(F.col(ts).alias("ts"), F.col("event.repository.full_name").alias("repo"), F.col("event.pull_request.number").alias("number"), F.col("event.pull_request.head.sha").alias("sha"))
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["repo", "number", "sha"]) if e.isStreaming else e.groupBy("repo", "number", "sha").agg(F.min("ts").alias("ts"))


def run(events: DataFrame, scan_batch: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start the stream; the batch number makes a replayed batch's writes the same."""
    return events.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rates(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
