"""Streams over growing folders against the batch operators: several triggers, late rows, repeated keys, repeated batches."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import NOW, frame, listing
from mattone.operators import merge, quality
from mattone.streaming import streams

EVENTS = "source_id string, at timestamp_ntz, event_id bigint, ok boolean, retry_after int"


def once(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def health_after(spark, tmp_path, parts, lateness="10000 days"):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        once(streams.stream_source_health(spark.readStream.schema(EVENTS).parquet(source), out, str(tmp_path / "state"), lateness))
    return spark.read.parquet(out)


def plain(df):
    return sorted((r["source_id"], r["failures"], str(r["last_success"]), str(r["next_retry"])) for r in df.collect())


def test_health_in_event_order_whatever_the_order_of_arrival(spark, tmp_path):
    outcome = [False, True, False, False, False, True, True, False]
    rows = [("s", NOW + timedelta(minutes=i), i, ok, 0) for i, ok in enumerate(outcome)] + [("t", NOW, 9, False, 7200), ("u", NOW, 1, True, None), ("v", NOW, 1, False, None), ("v", NOW, 2, True, 5)]
    parts = [rows[4:6] + rows[8:9], rows[0:2] + rows[11:], rows[2:4] + rows[10:11], rows[6:8] + rows[9:10]]
    written = health_after(spark, tmp_path, parts)
    assert plain(streams.current_health(written)) == plain(quality.source_health(spark.createDataFrame(rows, EVENTS)))


def test_settled_failures_are_counted_and_no_longer_kept(spark, tmp_path):
    days = [[("s", NOW + timedelta(days=d, hours=h), 10 * d + h, False, 0) for h in range(3)] for d in range(5)]
    days.append([("z", NOW + timedelta(days=20), 99, True, 0)])
    written = health_after(spark, tmp_path, days, "1 hour")
    (last,) = streams.current_health(written).where("source_id = 's'").collect()
    assert (last["failures"], last["last_success"], last["next_retry"]) == (15, None, NOW + timedelta(days=4, hours=2, seconds=60 * 2 ** 10))
    # The other source's event moved the watermark past the retry: the timer said so, once.
    assert [(r["source_id"], r["at"]) for r in written.where("kind = 'due'").collect()] == [("s", last["next_retry"])]


def test_blocked_once_where_failures_begin(spark, tmp_path):
    rows = [("s", NOW + timedelta(hours=i), i, ok, 0) for i, ok in enumerate([False, False, True, False, True, True, False])]
    written = health_after(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]])
    names = spark.createDataFrame([("s", "Fonte S")], "source_id string, source_name string")
    said = streams.source_blocked(written, names, lambda at: F.date_format(at, "yyyyMMddHH")).orderBy("at").collect()
    assert [r["dedupe_key"] for r in said] == [f"source:s:{(NOW + timedelta(hours=i)).strftime('%Y%m%d%H')}" for i in (0, 3, 6)]
    assert {r["title"] for r in said} == {"Fonte da controllare: Fonte S"}


def changed(spark, tmp_path, parts):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        once(streams.stream_listing_changes(spark.readStream.schema(part.schema).parquet(source), out, str(tmp_path / "state")))
    return spark.read.parquet(out)


def stated(spark, rows, day, status=200):
    return frame(spark, rows).withColumn("read_at", F.lit(str(NOW + timedelta(days=day))).cast("timestamp_ntz")).withColumn("http_status", F.lit(status))


def test_every_changed_version_is_written_once(spark, tmp_path):
    first = stated(spark, [listing("a"), listing("b"), listing("c", availability="sold")], 0)
    # Three statements of one key in a trigger, one of them a repetition: two changes. A closed listing stays closed.
    second = (stated(spark, [listing("a", 190000.0)], 1).union(stated(spark, [listing("a", 190000.0)], 2)).union(stated(spark, [listing("a", 180000.0), listing("c")], 3))
              .union(stated(spark, [listing("b"), listing("nobody")], 4, 404)))
    third = stated(spark, [listing("b"), listing("a", 180000.0)], 5)
    rows = changed(spark, tmp_path, [first, second, third])
    versions = sorted((r["listing_key"], r["read_at"], r["price"], r["availability"], r["created"], r["previous_price"], r["previous_availability"]) for r in rows.collect())
    day = lambda n: NOW + timedelta(days=n)
    assert versions == [("a", day(0), 200000.0, "listed", True, None, None), ("a", day(1), 190000.0, "listed", False, 200000.0, "listed"), ("a", day(3), 180000.0, "listed", False, 190000.0, "listed"),
                        ("b", day(0), 200000.0, "listed", True, None, None), ("b", day(4), 200000.0, "review", False, 200000.0, "listed"), ("b", day(5), 200000.0, "listed", False, 200000.0, "review"),
                        ("c", day(0), 200000.0, "sold", True, None, None)]
    now = {r["listing_key"]: r for r in streams.current_listings(rows).collect()}
    assert (now["a"]["price"], now["a"]["first_seen"], now["b"]["availability"], now["c"]["availability"]) == (180000.0, NOW, "listed", "sold")
    kinds = sorted(r["kind"] for r in merge.notifications(rows, F.date_format("read_at", "yyyyMMdd")).collect())
    assert kinds == ["availability_change"] + ["new_property"] * 3 + ["price_change"] * 2


def test_stream_equals_batches(spark, tmp_path):
    """The content hash and the current table of the batch merge, one batch a trigger."""
    days = [stated(spark, [listing("a"), listing("b", None), listing("d", surface=None)], 0), stated(spark, [listing("a", 180000.0), listing("b", None), listing("e", title="Ünï")], 1)]
    rows = streams.current_listings(changed(spark, tmp_path, days))
    current = days[0].limit(0).select("source_id", "listing_key", *merge.CONTENT, "first_seen", "last_seen", F.lit("").alias("content_hash"))
    for n, batch in enumerate(days):
        merged = merge.merge_listings(current, batch, NOW + timedelta(days=n))
        current = spark.createDataFrame(merged.collect(), merged.schema)
    key = lambda df: sorted((r["listing_key"], r["content_hash"], r["first_seen"]) for r in df.collect())
    assert key(rows) == key(current)


def notified(spark, tmp_path, rows, day):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    data = spark.createDataFrame([(k, f"title {k}", NOW + timedelta(days=day)) for k in rows], "dedupe_key string, title string, at timestamp_ntz")
    data.coalesce(1).write.mode("append").parquet(source)
    once(streams.stream_notifications(spark.readStream.schema(data.schema).parquet(source), log, str(tmp_path / "state")))
    return sorted(r["dedupe_key"] for r in spark.read.parquet(log).collect())


def test_a_key_is_sent_once_for_ever(spark, tmp_path):
    assert notified(spark, tmp_path, ["a", "b", "b", None], 0) == ["a", "b"]
    assert notified(spark, tmp_path, ["a", "c"], 400) == ["a", "b", "c"]
    assert notified(spark, tmp_path, ["b", "c"], 4000) == ["a", "b", "c"]


def test_a_repeated_batch_writes_the_same_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    batch = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "k string, n int")
    streams.append_once(batch("a", "b"), 0, "k", log)
    streams.append_once(batch("b", "c"), 1, "k", log)
    streams.append_once(batch("b", "c"), 1, "k", log)
    streams.append_once(batch(), 2, "k", log)
    assert sorted((r["k"], r["batch"]) for r in spark.read.parquet(log).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_mail_stream_reads_each_message_once(spark, tmp_path):
    from test_ingest import MAIL
    inbox, log = tmp_path / "mail", str(tmp_path / "log")
    inbox.mkdir()
    for names in (("a.eml", "b.eml"), ("c.eml",)):
        for name in names:
            (inbox / name).write_bytes(MAIL.encode())
        once(streams.stream_alert_mail(spark, str(inbox), ["casa.it"], log, str(tmp_path / "state")))
    assert [(r["message_id"], r["status"]) for r in spark.read.parquet(log).collect()] == [("<m1@casa.it>", "read")]


def test_stream_queries_read_a_table_of_part_files(spark, tmp_path):
    from mattone.plans import load
    start = datetime(2024, 1, 1)
    rows = [(n, n % 40, "purchase" if n % 5 == 0 else "view", start + timedelta(hours=n)) for n in range(200)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz").repartition(5, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    days = {r["day"]: r["total"] for r in load().QUERIES["stream_daily_counts"](spark, str(tmp_path)).collect()}
    want = {}
    for r in rows:
        want[str(r[3].date())] = want.get(str(r[3].date()), 0) + 1
    assert days == want
    health = {r["source_id"]: r["failures"] for r in load().QUERIES["stream_source_health"](spark, str(tmp_path)).collect()}
    last = {s: max([r[0] for r in rows if r[1] % 37 == s and r[2] == "purchase"], default=-1) for s in range(37)}
    assert health == {f"S{s}": sum(r[1] % 37 == s and r[2] == "view" and r[0] > last[s] for r in rows) for s in range(37)}
