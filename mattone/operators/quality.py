"""Archive indicators: coverage, counts per day, per source and per run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.expr import completeness, days, half_up, inactive, labels, missing, newest_per, stamp


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def archive_overview(scored: DataFrame, reduced: DataFrame, as_of) -> DataFrame:
    """One row of archive counters. ``reduced`` lists the ids that once asked more."""
    now = stamp(as_of)
    rows = scored.join(reduced.select("id", F.lit(1).alias("_reduced")), "id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("first_seen") >= now - days(7)).alias("new_7d"),
        count_if(F.col("last_seen") < now - days(7)).alias("stale_7d"), count_if(F.col("last_seen") < now - days(30)).alias("stale_30d"),
        count_if(F.col("review_status").isin("reviewing", "shortlisted", "due_diligence", "negotiation")).alias("in_work"),
        count_if(F.col("priority_score") >= 75).alias("priority"), half_up(F.avg("completeness"), 4).alias("completeness"),
        count_if(F.col("benchmark_id").isNotNull()).alias("benchmarked"),
        count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("geolocated"),
        count_if((F.col("discount") >= 10) & ~inactive()).alias("below_benchmark"), F.count("_reduced").alias("reduced"))


def action_hints(overview: DataFrame, sources: DataFrame, overdue: DataFrame) -> DataFrame:
    """What the workspace should do next, from its own counters."""
    enabled = sources.where("enabled").agg(F.count(F.lit(1))).scalar()
    blocked = sources.where(F.col("enabled") & F.col("status").isin("blocked", "degraded")).agg(F.count(F.lit(1))).scalar()
    late = overdue.agg(F.count(F.lit(1))).scalar()
    one = overview.select("*", enabled.alias("enabled"), blocked.alias("blocked"), late.alias("overdue"))
    hints = labels([("setup", F.col("enabled") == 0), ("source", F.col("blocked") > 0), ("freshness", F.col("stale_7d") > 0),
                    ("benchmark", F.col("total") > F.col("benchmarked")), ("review", F.col("overdue") > 0)])
    return one.select(F.posexplode(hints).alias("position", "kind"))


def data_quality(scored: DataFrame) -> DataFrame:
    """Coverage of each quality field over the whole archive, one row per field."""
    fields = rules.QUALITY_FIELDS
    counts = scored.agg(F.count(F.lit(1)).alias("total"), count_if(F.col("benchmark_id").isNull()).alias("unbenchmarked"),
                        *[count_if(missing(f)).alias("missing_" + f) for f in fields])
    filled = F.lit(0)
    for f in fields:
        filled = filled + F.col("total") - F.col("missing_" + f)
    overall = F.when(F.col("total") > 0, half_up(filled / (F.col("total") * len(fields)) * 100, 1))
    rows = counts.select("total", "unbenchmarked", overall.alias("completeness"),
                         F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("missing_" + f).alias("missing")) for f in fields])).alias("f"))
    present = F.col("total") - F.col("f.missing")
    return rows.select("f.field", present.alias("present"), "f.missing", "total",
                       F.when(F.col("total") > 0, half_up(present / F.col("total") * 100, 1)).alias("percent"),
                       "unbenchmarked", "completeness")


def source_quality(scored: DataFrame, sources: DataFrame, health: DataFrame) -> DataFrame:
    """Listings and average completeness of every source, with its health."""
    per = scored.groupBy("source_id").agg(F.count(F.lit(1)).alias("listings"), half_up(F.avg("completeness"), 4).alias("completeness"))
    return (sources.join(per, "source_id", "left").join(health, "source_id", "left")
            .select("source_id", "source_name", "status", "enabled", F.coalesce("listings", F.lit(0).cast("bigint")).alias("listings"),
                    "completeness", F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures")))


def value_counts(df: DataFrame, column: str, empty: str | None = None) -> DataFrame:
    value = F.col(column) if empty is None else F.when(F.coalesce(F.col(column), F.lit("")) == "", empty).otherwise(F.col(column))
    return df.groupBy(value.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def workspace_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("properties"), count_if(F.col("benchmark_id").isNotNull()).alias("benchmarked"),
        count_if(F.col("score") >= 75).alias("high_priority"), count_if(F.col("review_status") == "shortlisted").alias("shortlisted"),
        half_up(F.avg("completeness"), 1).alias("quality"),
        F.coalesce(F.sum(F.col("price").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total_asking"))


def new_by_day(listings: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    return (listings.where(F.col("first_seen") >= stamp(as_of) - days(window_days))
            .groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("total")))


def run_summary(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Counters, status and duration of every run from its events.

    A run fails when no source answered, or links were found and nothing was read; it is
    partial when a source failed.
    """
    e = F.col("step")
    acquired = e == "acquire"
    stats = events.groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(e == "discovery", F.col("items"))), F.lit(0)).cast("bigint").alias("found"),
        count_if(acquired).alias("processed"), count_if(acquired & F.col("is_new")).alias("new"),
        count_if(acquired & F.col("is_changed") & ~F.col("is_new")).alias("changed"),
        count_if((e == "source") & (F.col("level") == "error")).alias("errors"),
        # Sources are few and known: the set of those that answered stays small.
        F.size(F.collect_set(F.when(e == "discovery", F.col("source_id")))).cast("bigint").alias("sources_ok"))
    names = ["found", "processed", "new", "changed", "errors", "sources_ok"]
    joined = runs.join(stats, "run_id", "left")
    for n in names:
        joined = joined.withColumn(n, F.coalesce(n, F.lit(0).cast("bigint")))
    status = (F.when((F.col("sources_ok") == 0) | ((F.col("found") > 0) & (F.col("processed") == 0)), "failed")
              .when(F.col("errors") > 0, "partial").otherwise("completed"))
    seconds = F.when(F.col("finished_at") >= F.col("created_at"),
                     F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp")))
    return joined.withColumn("status", status).withColumn("duration_s", seconds.cast("bigint"))


def run_qualified(runs: DataFrame, events: DataFrame, memberships: DataFrame) -> DataFrame:
    """run_id, qualified: listings that a run acquired and that fit its search."""
    read = events.where("step = 'acquire'").select("run_id", F.col("property_id").alias("id")).distinct()
    fit = memberships.where("fit").select("agent_id", "id").distinct()
    return read.join(runs.select("run_id", "agent_id"), "run_id").join(fit, ["agent_id", "id"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("qualified"))


def daily_runs(summary: DataFrame, n: int | None = None) -> DataFrame:
    out = summary.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("status") == "completed").alias("completed"),
        count_if(F.col("status").isin("failed", "partial", "interrupted")).alias("failed"))
    return out if n is None else out.orderBy(F.desc("day")).limit(n)


def agent_totals(searches: DataFrame, memberships: DataFrame, runs: DataFrame) -> DataFrame:
    """Per saved search: linked and qualified listings and the last run."""
    linked = memberships.groupBy("agent_id").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("fit")).alias("qualified"))
    last = runs.groupBy("agent_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("last_run"))
    zero = F.lit(0).cast("bigint")
    return (searches.select("agent_id", "agent_name").join(linked, "agent_id", "left").join(last, "agent_id", "left")
            .select("agent_id", "agent_name", F.coalesce("total", zero).alias("total"), F.coalesce("qualified", zero).alias("qualified"), "last_run"))


def analysis_progress(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), count_if(F.col("submitted")).alias("accepted"),
                                       count_if(~F.col("submitted")).alias("pending"))


def usage_cost(input_price: float, output_price: float) -> Column:
    """Cost of one model answer; unknown when either count is."""
    return half_up((F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000, 8)


def ai_usage_totals(usage: DataFrame) -> DataFrame:
    reported = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return usage.agg(F.count(F.lit(1)).alias("accepted_analyses"), count_if(reported).alias("reported_analyses"),
                     F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
                     F.sum(F.col("estimated_eur").cast("decimal(28,8)")).cast("double").alias("estimated_eur"))


def alert_totals(messages: DataFrame) -> DataFrame:
    done = messages.where(F.col("status") != "processing")
    s = F.col("status")
    return done.agg(F.count(F.lit(1)).alias("messages"), count_if(s.isin("processed", "empty")).alias("read"),
                    count_if(s == "ignored").alias("ignored"), count_if(s == "rejected").alias("rejected"),
                    *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("cards", "created", "updated", "skipped")])


def unread_anti(notifications: DataFrame, reads: DataFrame, user_id: str) -> DataFrame:
    """Notifications the user has not opened."""
    mine = reads.where(F.col("user_id") == user_id).select("notification_id")
    return notifications.join(mine, "notification_id", "left_anti")


def unread_totals(notifications: DataFrame, reads: DataFrame, team: DataFrame) -> DataFrame:
    """Total and unread notifications per team member."""
    total = notifications.agg(F.count(F.lit(1))).scalar()
    # Receipts of notifications that exist, counted once per user.
    seen = (reads.select("notification_id", "user_id").distinct().join(notifications.select("notification_id"), "notification_id", "left_semi")
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("seen")))
    return (team.select("user_id").join(seen, "user_id", "left").withColumn("total", total)
            .select("user_id", "total", (F.col("total") - F.coalesce("seen", F.lit(0).cast("bigint"))).alias("unread")))


def import_summary(merged: DataFrame) -> DataFrame:
    """Imported, new, changed and unchanged rows of a merge."""
    seen = merged.where("in_batch")
    return seen.agg(F.count(F.lit(1)).alias("imported"), count_if(F.col("created")).alias("new"),
                    count_if(F.col("changed") & ~F.col("created")).alias("changed"), count_if(~F.col("changed")).alias("unchanged"))


def retry_delay(failures: Column, retry_after: Column) -> Column:
    """Seconds to wait after a failure: doubling from two minutes, at most a day."""
    return F.least(F.lit(86400), F.greatest(retry_after, 60 * F.pow(F.lit(2), F.least(failures, F.lit(10))))).cast("bigint")


def source_message_class(message: Column) -> Column:
    out = None
    for pattern, name in rules.SOURCE_MESSAGES:
        out = F.when(message.rlike(pattern), name) if out is None else out.when(message.rlike(pattern), name)
    return out.otherwise("other")


def source_health(events: DataFrame) -> DataFrame:
    """State after the last event of each source: failures since its last success, next retry.

    ``events``: source_id, at, event_id, ok, retry_after. Only two partial aggregates per source.
    """
    last_ok = events.where("ok").groupBy("source_id").agg(F.max(F.struct("at", "event_id")).alias("_ok"))
    joined = events.join(last_ok, "source_id", "left")
    after = ~F.col("ok") & (F.col("_ok").isNull() | (F.struct("at", "event_id") > F.col("_ok")))
    state = joined.groupBy("source_id").agg(
        count_if(after).alias("failures"), F.max(F.when(after, F.struct("at", "event_id", "retry_after"))).alias("_last"),
        F.max("_ok.at").alias("last_success"))
    delay = retry_delay(F.col("failures"), F.coalesce("_last.retry_after", F.lit(0)))
    return state.select("source_id", "failures", "last_success",
                        F.when(F.col("failures") > 0, F.col("_last.at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay)).alias("next_retry"))
