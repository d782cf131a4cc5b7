"""Batches that state a key several times: merged rows and observations against statements applied one by one."""
import random
from datetime import timedelta

from conftest import NOW, frame, listing
from pyspark.sql import functions as F

from mattone.operators import merge

CLOSED = ("sold", "rented", "withdrawn")


def one_by_one(old, statements):
    """What stands after each (price, availability, status), and the statements that changed it."""
    stands, content, seen = old, old, []
    for price, availability, status in statements:
        if status == 404:
            if stands and stands[1] != "review":
                stands = stands[0], "review"
                seen.append(stands)
            continue
        if stands and stands[1] in CLOSED and availability not in CLOSED:
            availability = stands[1]
        stands = price, availability
        if content != stands:
            seen.append(stands)
        content = stands
    return stands, seen


def test_every_changed_version_is_one_observation(spark):
    rng = random.Random(7)
    old, batch, want, after = [], [], {}, {}
    for k in range(60):
        before = (float(rng.randrange(3)), rng.choice(["listed", "sold", "unknown"])) if k % 3 else None
        if before:
            old.append(listing(f"k{k}", before[0], availability=before[1]))
        statements = [(float(rng.randrange(3)), rng.choice(["listed", "listed", "sold"]), rng.choice([200, 200, 200, 404])) for _ in range(rng.randrange(5))]
        for n, (price, availability, status) in enumerate(statements):
            batch.append((listing(f"k{k}", price, availability=availability), n, status))
        stands, seen = one_by_one(before, statements)
        if stands:
            after[f"k{k}"] = stands
        if seen:
            want[f"k{k}"] = seen
    current = frame(spark, old).withColumn("content_hash", merge.content_hash())
    # Each statement twice: a repeated row says nothing new.
    rows = frame(spark, [{**r, "latitude": float(i)} for i, (r, _, _) in enumerate(batch)])
    extra = spark.createDataFrame([(float(i), n, s, NOW - timedelta(minutes=60 - n)) for i, (_, n, s) in enumerate(batch)], "latitude double, batch_order int, http_status int, read_at timestamp_ntz")
    rows = rows.join(extra, "latitude").withColumn("latitude", F.lit(None).cast("double"))
    rows = rows.union(rows)
    got = {}
    for r in sorted(merge.version_observations(current, rows, NOW).collect(), key=lambda r: r.version):
        got.setdefault(r.listing_key, []).append((r.price, r.availability))
    assert got == want
    merged = merge.merge_listings(current, rows, NOW).collect()
    assert {r.listing_key: (r.price, r.availability) for r in merged} == after
    assert merge.version_observations(current, rows.limit(0), NOW).count() == 0


def test_repeated_statements_go_without_an_aggregate_of_whole_rows(spark):
    old = frame(spark, [listing("a", 1.0)]).withColumn("content_hash", merge.content_hash())
    rows = frame(spark, [listing("a", 0.0), listing("a", -0.0), listing("a", 0.0), listing("b", 2.0), listing("b", 2.0)])
    found = merge.version_observations(old, rows, NOW)
    assert sorted((r.listing_key, r.version, r.price) for r in found.collect()) == [("a", 1, 0.0), ("b", 1, 2.0)]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
