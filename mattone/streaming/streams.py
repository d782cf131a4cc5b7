"""Structured Streaming forms of the incremental work.

What must be known of a key lives in the state store (source health, listings) or in an append-only log that is
partitioned by a hash of the key (notifications, messages), so a trigger costs what it brings and not what the archive holds.
Every output is appended; readers take the newest row of a key.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import StructField, StructType

from .. import rules
from ..functions.expr import newest_per
from ..operators import merge
from ..sources.mail import parse_mail

#: Keyed state needs this store.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Partitions of a log of keys.
LOG_BUCKETS = 256


def daily_counts(stream: DataFrame, at: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Rows per calendar day; a day is final once the watermark has passed it."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", watermark)
    return (timed.groupBy(F.window("_at", "1 day")).agg(F.count(F.lit(1)).alias("total"))
            .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "total"))


def stream_daily_counts(stream: DataFrame, path: str, checkpoint: str, at: str = "ts") -> DataStreamWriter:
    """Rows per calendar day, open days included. State and each written version hold one row per day."""
    counts = stream.groupBy(F.date_format(F.col(at).cast("timestamp_ntz"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("total"))

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return counts.writeStream.outputMode("complete").foreachBatch(run).option("checkpointLocation", checkpoint)


def last_version(versions: DataFrame) -> DataFrame:
    """Rows of the newest version of a table written as ``v=0``, ``v=1`` …"""
    return versions.join(versions.agg(F.max("v").alias("v")), "v").drop("v")


# --- Source health: keyed state with a timer ----------------------------------------------------------------------------

#: Times are microseconds inside the state.
HEALTH = "source_id string, kind string, version bigint, at bigint, event_id bigint, failures bigint, last_success bigint, next_retry bigint"


class SourceHealth(StatefulProcessor):
    """Failures since a source's last success, in event order whatever the order of arrival.

    State: the last success, the failures behind it that an earlier success may still cut (those younger than the watermark, by time
    and id), and the number of older ones, which nothing can cut any more. A timer at the time of the next retry tells when the source
    is due.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", "success bigint, success_id bigint, settled bigint, last bigint, last_id bigint, retry_after bigint, version bigint, timer bigint")
        self.open = handle.getListState("open", "at bigint, event_id bigint, retry_after bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.state.get()
        success, success_id, settled, last, last_id, wait, version, timer = old if old is not None else (None, None, 0, None, None, 0, 0, None)
        failed = [tuple(r) for r in self.open.get()]
        before = settled + len(failed)
        failing, begins = before > 0, []
        for at, ident, ok, retry_after in sorted((r["at_us"], r["event_id"], r["ok"], r["retry_after"] or 0) for r in rows):
            if ok:
                if success is None or (at, ident) > (success, success_id):
                    success, success_id = at, ident
            else:
                failed.append((at, ident, retry_after))
                if not failing:
                    begins.append((at, ident))
            failing = not ok
        if success is not None:
            failed = [f for f in failed if f[:2] > (success, success_id)]
            if last is not None and (success, success_id) > (last, last_id):
                settled, last = 0, None
        failed.sort()
        newest = failed[-1] if failed else None
        if newest and (last is None or newest[:2] > (last, last_id)):
            last, last_id, wait = newest
        horizon = timerValues.getCurrentWatermarkInMs() * 1000
        closed = [f for f in failed if f[0] < horizon]
        total = settled + len(failed)
        settled, failed = settled + len(closed), failed[len(closed):]
        retry = last + 1_000_000 * _delay(total, wait) if total else None
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = retry // 1000 if total else None
        if timer is not None:
            self.handle.registerTimer(timer)
        version += 1
        self.state.update((success, success_id, settled, last if total else None, last_id, wait, version, timer))
        self.open.put(failed) if failed else self.open.clear()
        yield Row(source_id=key[0], kind="state", version=version, at=last if total else success, event_id=last_id if total else success_id, failures=total, last_success=success, next_retry=retry)
        for at, ident in begins:
            yield Row(source_id=key[0], kind="blocked", version=version, at=at, event_id=ident, failures=total, last_success=success, next_retry=retry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        success, success_id, settled, last, last_id, wait, version, timer = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self.state.update((success, success_id, settled, last, last_id, wait, version, None))
        yield Row(source_id=key[0], kind="due", version=version, at=due, event_id=last_id, failures=settled + sum(1 for _ in self.open.get()), last_success=success, next_retry=due)

    def close(self) -> None:
        pass


def _delay(failures: int, retry_after: int) -> int:
    return min(86400, max(retry_after, 60 * 2 ** min(failures, 10)))


def source_health(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """One ``state`` row per source that a trigger touches, a ``blocked`` row for each failure that follows a success or nothing (in the order of arrival
    between triggers), a ``due`` row when a retry falls due.

    ``stream``: source_id, at, event_id, ok, retry_after. ``lateness``: how late an event may arrive; later ones are dropped.
    """
    timed = stream.select("source_id", F.col("at").cast("timestamp").alias("at"), "event_id", "ok", F.col("retry_after").cast("bigint").alias("retry_after")).withWatermark("at", lateness)
    rows = timed.withColumn("at_us", F.unix_micros("at")).groupBy("source_id").transformWithState(SourceHealth(), HEALTH, "append", "eventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return rows.select("source_id", "kind", "version", time("at"), "event_id", "failures", time("last_success"), time("next_retry"))


def stream_source_health(stream: DataFrame, path: str, checkpoint: str, lateness: str = "2 days") -> DataStreamWriter:
    """The rows of ``source_health`` appended to ``path``."""
    stream.sparkSession.conf.set(STATE_STORE, ROCKS)
    return source_health(stream, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def current_health(written: DataFrame) -> DataFrame:
    """source_id, failures, last_success, next_retry as last written."""
    last = written.where("kind = 'state'").groupBy("source_id").agg(F.max_by(F.struct("failures", "last_success", "next_retry"), "version").alias("s"))
    return last.select("source_id", "s.failures", "s.last_success", "s.next_retry")


# --- Keys that count once for ever --------------------------------------------------------------------------------------

def append_once(batch: DataFrame, batch_id: int, key: str, log: str) -> None:
    """Append the rows whose key the log doesn't hold, one per key.

    The log is partitioned by a hash of the key and by batch. Only partitions that the batch touches are read, and of them the
    key column. A batch repeated after a failure ignores and replaces its own partitions, so it writes the same rows again.
    """
    spark = batch.sparkSession
    rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(LOG_BUCKETS)).cast("int"))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most LOG_BUCKETS numbers
    if not touched:
        return
    schema = StructType([*rows.drop("bucket").schema.fields]).add("bucket", "integer").add("batch", "long")
    rows.limit(0).withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("append").partitionBy("bucket", "batch").parquet(log)  # a first batch finds a folder
    known = spark.read.schema(schema).parquet(log).where(F.col("bucket").isin(touched) & (F.col("batch") != batch_id)).select("bucket", key)
    fresh = rows.join(known, ["bucket", key], "left_anti").withColumn("batch", F.lit(batch_id).cast("bigint"))
    (fresh.select(*batch.columns, "bucket", "batch").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(log))


def stream_notifications(changes: DataFrame, log: str, checkpoint: str) -> DataStreamWriter:
    """Notifications (kind, title, dedupe_key, at …) appended to ``log``, each dedupe key once for ever."""
    return changes.writeStream.foreachBatch(lambda batch, n: append_once(batch, n, "dedupe_key", log)).option("checkpointLocation", checkpoint)


def source_blocked(health: DataFrame, names: DataFrame | None = None, run_of=None) -> DataFrame:
    """Notifications of sources that begin to fail, from the rows of ``source_health``; ``run_of`` gives the run's id by time."""
    run = run_of(F.col("at")) if run_of else F.date_format("at", "yyyyMMddHHmmss")
    rows = health.where("kind = 'blocked'").withColumn("run_id", run)
    name = F.col("source_id")
    if names is not None:
        rows = rows.join(names.select("source_id", "source_name"), "source_id", "left")
        name = F.coalesce("source_name", "source_id")
    return rows.select(F.lit("source_blocked").alias("kind"), F.concat(F.lit("Fonte da controllare: "), name).alias("title"),
                       F.concat_ws(":", F.lit("source"), "source_id", "run_id").alias("dedupe_key"), "at")


def stream_alert_mail(spark: SparkSession, path: str, domains: list[str], log: str, checkpoint: str, files_per_trigger: int = 1000) -> DataStreamWriter:
    """New mail files as messages, each Message-ID once for ever; the checkpoint keeps the position."""
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", files_per_trigger).load(path))
    return parse_mail(files, domains).writeStream.foreachBatch(lambda batch, n: append_once(batch, n, "message_id", log)).option("checkpointLocation", checkpoint)


# --- Listings: the last statement of a key in the state store -----------------------------------------------------------

KEY = ("source_id", "listing_key")


class ListingState(StatefulProcessor):
    """What a listing last stated; each row that changes it is passed on with what it replaces.

    A closed listing isn't reopened by a weaker statement; a page that is gone (404, 410) only asks to review a listing that is known.
    A trigger's rows of one listing are applied in the order of ``read_at`` and their content.
    """

    def __init__(self, state: str):
        self.schema = state

    def init(self, handle) -> None:
        self.state = handle.getValueState("listing", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = len(merge.CONTENT)
        place, price = merge.CONTENT.index("availability"), merge.CONTENT.index("price")
        old = self.state.get()
        content, first, last, version = (tuple(old[:n]), *old[n:]) if old is not None else (None, None, None, 0)
        every = [(r["read_at"], tuple(r[c] for c in merge.CONTENT), r["http_status"]) for r in rows]
        for at, stated, status in sorted(every, key=lambda x: (x[0], x[2], [(v is not None, v) for v in x[1]])):
            gone = status in (404, 410)
            if gone and content is None:
                continue
            new = list(content if gone else stated)
            if gone:
                new[place] = "review"
            elif content is not None and content[place] in rules.CLOSED and new[place] not in rules.CLOSED:
                new[place] = content[place]
            changed, created, new = content is None or tuple(new) != content, content is None, tuple(new)
            first, last = first or at, last if gone else at
            version += 1
            if changed:
                yield Row(**dict(zip(KEY, key)), **dict(zip(merge.CONTENT, new)), first_seen=first, last_seen=last, read_at=at, version=version, created=created,
                          previous_price=None if created else content[price], previous_availability=None if created else content[place])
            content = new
        if content is not None:
            self.state.update((*content, first, last, version))

    def close(self) -> None:
        pass


def listing_changes(stream: DataFrame) -> DataFrame:
    """One row per changed version of a listing: key, content, first and last seen, version, created, previous price and availability, hash."""
    types = {f.name: f.dataType for f in stream.schema.fields}
    content = [StructField(c, types[c]) for c in merge.CONTENT]
    times = ("first_seen", "last_seen", "read_at")
    state = StructType([*content]).add("first_seen", "long").add("last_seen", "long").add("version", "long")
    out = StructType([StructField(c, types[c]) for c in KEY] + content)
    for c in (*times, "version"):
        out = out.add(c, "long")
    out = out.add("created", "boolean").add("previous_price", types["price"]).add("previous_availability", types["availability"])
    if "http_status" not in stream.columns:
        stream = stream.withColumn("http_status", F.lit(200))
    rows = stream.select(*KEY, *merge.CONTENT, F.unix_micros(F.col("read_at").cast("timestamp")).alias("read_at"), "http_status")
    changed = rows.groupBy(*KEY).transformWithState(ListingState(state), out, "append", "none")
    changed = changed.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in times})
    return changed.withColumn("content_hash", merge.content_hash()).withColumn("in_batch", F.lit(True)).withColumn("changed", F.lit(True))


def stream_listing_changes(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The changed versions appended to ``path``; ``current_listings`` and the operators of ``merge`` read them."""
    stream.sparkSession.conf.set(STATE_STORE, ROCKS)
    return listing_changes(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def current_listings(changes: DataFrame) -> DataFrame:
    """The newest version of each listing. ``last_seen`` is when it last changed or was first read."""
    return newest_per(changes, list(KEY), [F.desc("version")])
