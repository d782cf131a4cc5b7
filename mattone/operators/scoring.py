"""Benchmarks, opportunity score and triage priority of every listing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions.expr import (closed, completeness, future_period, half_up, inactive, known, labels, missing_fields,
                              months_since, newest_per, present, price_sqm)


def replace_benchmark_series(old: DataFrame, new: DataFrame) -> DataFrame:
    """Re-import: rows of ``new`` replace those of the same seven keys and period."""
    keys = [*rules.SEGMENT_KEYS, "period"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def period_latest(benchmarks: DataFrame) -> DataFrame:
    """Newest period of each series, keys compared without case."""
    keyed = benchmarks.select(*[F.lower(k).alias("_" + k) for k in rules.SEGMENT_KEYS], "period", "min_sqm", "max_sqm",
                              F.col("id").alias("benchmark_id"))
    return newest_per(keyed, ["_" + k for k in rules.SEGMENT_KEYS], [F.desc("period"), F.asc("benchmark_id")])


def match_benchmark(listings: DataFrame, benchmarks: DataFrame, as_of) -> DataFrame:
    """Attach the newest benchmark of the same seven keys, or the reason why there is none.

    Validity is tested on the newest period only: an older valid row is no substitute.
    """
    latest = period_latest(benchmarks)
    keyed = listings
    for k in rules.SEGMENT_KEYS:
        keyed = keyed.withColumn("_" + k, F.lower(k))
    joined = keyed.join(latest, ["_" + k for k in rules.SEGMENT_KEYS], "left").drop(*["_" + k for k in rules.SEGMENT_KEYS])
    unknown = F.lit(False)
    for k in rules.SEGMENT_KEYS:
        unknown = unknown | F.coalesce(F.col(k).isin("", "unknown"), F.lit(True))
    reason = (F.when(unknown, "insufficient").when(F.col("period").isNull(), "no_match")
              .when(future_period("period", as_of), "future_period")
              .when(months_since("period", as_of) > rules.BENCHMARK_MONTHS, "too_old").otherwise(""))
    out = joined.withColumn("benchmark_note", reason)
    usable = F.col("benchmark_note") == ""
    for name in ("benchmark_id", "min_sqm", "max_sqm", "period"):
        target = {"min_sqm": "benchmark_min", "max_sqm": "benchmark_max", "period": "benchmark_period"}.get(name, name)
        out = out.withColumn(target, F.when(usable, F.col(name)))
    return out.drop("min_sqm", "max_sqm", "period")


def discount_raw() -> Column:
    """Percent below the middle of the benchmark range."""
    middle = (F.col("benchmark_min") + F.col("benchmark_max")) / 2
    return (1 - F.col("price") / F.col("surface") / middle) * 100


def opportunity(df: DataFrame) -> DataFrame:
    """Score 0–100 from discount (70 points) and documented strategies (30 points)."""
    usable = ~closed() & F.col("benchmark_id").isNotNull() & present("price") & present("surface")
    discount = F.when(usable, discount_raw())
    price_points = F.greatest(F.lit(0.0), F.least(F.lit(70.0), 35 + discount * 1.4))
    points = F.least(F.lit(30), 15 * F.col("n_strategies"))
    return (df.withColumn("discount", half_up(discount, 2))
            .withColumn("price_points", F.when(usable, half_up(price_points, 1)))
            .withColumn("strategy_points", F.when(usable, points.cast("bigint")))
            .withColumn("score", F.when(usable, half_up(price_points + points, 0)).cast("bigint")))


def priority(df: DataFrame, zone_scenarios: Column | None = None) -> DataFrame:
    """Triage index from documented data, availability, economics and strategies."""
    with_benchmark = F.col("benchmark_id").isNotNull() & present("price") & present("surface")
    by_zone = zone_scenarios if zone_scenarios is not None else F.lit(False)
    quality = half_up(F.col("completeness") * 0.3, 1)
    availability = F.when(F.col("availability") == "listed", 10).otherwise(0)
    economics = (F.when(with_benchmark, half_up(F.greatest(F.lit(0.0), F.least(F.lit(40.0), 20 + discount_raw() * 0.8)), 1))
                 .when(F.col("benchmark_id").isNull() & by_zone, 10.0).otherwise(0.0))
    strategies = F.least(F.lit(10), 5 * F.col("n_strategies"))
    live = ~inactive()
    return (df.withColumn("quality_points", F.when(live, quality))
            .withColumn("availability_points", F.when(live, availability).cast("bigint"))
            .withColumn("economic_points", F.when(live, economics))
            .withColumn("strategy_priority_points", F.when(live, strategies).cast("bigint"))
            .withColumn("priority_score", F.when(live, half_up(quality + availability + economics + strategies, 0))
                        .otherwise(0).cast("bigint")))


def describe(listings: DataFrame) -> DataFrame:
    """Per-row facts that later steps share: price per m², completeness, strategies."""
    return (listings.withColumn("price_sqm", price_sqm()).withColumn("completeness", completeness())
            .withColumn("strategies", T.strategies(T.listing_text()))
            .withColumn("n_strategies", F.size("strategies")))


def score_listings(listings: DataFrame, benchmarks: DataFrame, as_of) -> DataFrame:
    return priority(opportunity(match_benchmark(describe(listings), benchmarks, as_of)))


def project_listing(listings: DataFrame) -> DataFrame:
    """The public row: derived price per m² and the list of missing fields."""
    return listings.withColumn("price_sqm", price_sqm()).withColumn("missing_fields", missing_fields())


def backfill_strategies(scored: DataFrame) -> DataFrame:
    """One row per listing and documented strategy."""
    return scored.select(F.col("id").alias("property_id"), F.explode("strategies.strategy").alias("strategy")).distinct()


def refresh_analysis(listings: DataFrame, benchmarks: DataFrame, assessments: DataFrame, as_of) -> DataFrame:
    """Rescore after a change; criteria checks survive only for the current content."""
    current = (assessments.join(listings.select(F.col("id").alias("property_id"), "content_hash"), ["property_id", "content_hash"], "left_semi")
               .groupBy("property_id").agg(F.count(F.lit(1)).alias("kept_checks")))
    scored = score_listings(listings, benchmarks, as_of)
    return (scored.join(current, scored["id"] == current["property_id"], "left").drop("property_id")
            .withColumn("kept_checks", F.coalesce("kept_checks", F.lit(0).cast("bigint"))))


def zone_scenarios(listings: DataFrame, quotes: DataFrame, as_of) -> DataFrame:
    """Official zone quotes applied to each listing that may be compared with them.

    ``quotes`` holds zone_code, usage, type, condition, min_sqm, max_sqm, area_basis, period;
    listings carry the ``zone_code`` found by the polygon join.
    """
    usage = (F.when(F.col("property_type") == "residential", "R").when(F.col("property_type") == "commercial", "C")
             .when(F.col("property_type") == "office", "T").when(F.col("property_type") == "logistics", "P"))
    q = quotes.select("zone_code", "usage", F.col("type").alias("quote_type"), F.col("condition").alias("quote_condition"),
                      "min_sqm", "max_sqm", F.col("area_basis").alias("quote_basis"), F.col("period").alias("quote_period"))
    joined = listings.withColumn("usage", usage).join(q, ["zone_code", "usage"])
    age = months_since("quote_period", as_of)
    dwelling = F.lower("quote_type").rlike("^(abitazioni|ville)")
    usable = (age.between(0, rules.BENCHMARK_MONTHS) & (F.col("currency") == "EUR") & (F.col("transaction_type") == "sale")
              & present("price") & present("surface") & ((F.col("property_type") != "residential") | dwelling))
    middle = (F.col("min_sqm") + F.col("max_sqm")) / 2
    return (joined.where(usable)
            .select("id", "zone_code", "quote_type", "quote_condition", "quote_basis", "quote_period",
                    half_up(F.col("min_sqm") * F.col("surface"), 0).alias("range_min"),
                    half_up(F.col("max_sqm") * F.col("surface"), 0).alias("range_max"),
                    half_up((F.col("price") / F.col("surface") / middle - 1) * 100, 1).alias("delta_midpoint_pct")))


def zone_signal(listings: DataFrame, quotes: DataFrame, as_of) -> DataFrame:
    """The one zone quote shown with a listing: the row of its condition, else the first row.

    ``quotes`` also carries ``position``, the row's place in the official table.
    """
    usage = (F.when(F.col("property_type") == "residential", "R").when(F.col("property_type") == "commercial", "C")
             .when(F.col("property_type") == "office", "T").when(F.col("property_type") == "logistics", "P"))
    words = F.lower("quote_condition")
    fits = (F.when(F.col("condition") == "to_renovate", words.contains("scadent") | words.contains("da ristrutturare"))
            .when(F.col("condition") == "renovated", words.contains("ottim")
                  | (words.contains("ristrutturat") & ~words.contains("da ristrutturare")))
            .when(F.col("condition") == "new", words.contains("nuov")).otherwise(F.lit(False)))
    q = quotes.select("zone_code", "usage", F.col("condition").alias("quote_condition"), "min_sqm", "max_sqm",
                      F.col("area_basis").alias("quote_basis"), F.col("period").alias("quote_period"), "position")
    joined = listings.withColumn("usage", usage).join(q, ["zone_code", "usage"])
    best = newest_per(joined.withColumn("_fits", fits), ["id"], [F.desc("_fits"), F.asc("position")])
    middle = half_up((F.col("min_sqm") + F.col("max_sqm")) / 2, 2)
    age = months_since("quote_period", as_of)
    stale = ~age.between(0, rules.BENCHMARK_MONTHS)
    return best.select("id", "zone_code", "min_sqm", "max_sqm", middle.alias("mid_sqm"), stale.alias("stale"),
                       F.col("quote_period").alias("period"), F.col("quote_basis").alias("area_basis"),
                       F.when(~stale & (middle != 0), half_up((price_sqm() / middle - 1) * 100, 1)).alias("delta_pct"))


def eligible_for_analysis(rows: DataFrame, searches: DataFrame, assessments: DataFrame, runtime: str) -> DataFrame:
    """Run rows that need (re)classification: changed, other engine or new prompt, and inside the hard filters.

    ``rows``: listings with run_id, agent_id, changed, engine, content_hash. ``assessments``:
    property_id, content_hash, prompt_key.
    """
    s = searches.withColumn("prompt_key", F.when(F.col("custom_prompt") != "", T.prompt_key(F.col("custom_prompt"))))
    joined = rows.join(s, "agent_id").where(
        ~inactive() & (F.lower("city") == F.lower("agent_city")) & (F.col("transaction_type") == "sale")
        & (F.col("currency") == "EUR") & F.col("price").between(F.col("min_price"), F.col("max_price"))
        & (F.col("surface") >= F.col("min_surface"))
        & (F.col("max_surface").isNull() | (F.col("surface") <= F.col("max_surface")))
        & F.coalesce((F.size("property_types") == 0) | F.array_contains("property_types", F.col("property_type")), F.lit(True))
        & (F.col("include_auctions") | ~F.col("is_auction")))
    done = assessments.select(F.col("property_id").alias("id"), "content_hash", "prompt_key", F.lit(True).alias("_done"))
    checked = joined.join(done.distinct(), ["id", "content_hash", "prompt_key"], "left")
    needs_custom = F.col("prompt_key").isNotNull() & F.col("_done").isNull()
    return checked.where(needs_custom | F.col("changed") | (F.coalesce("engine", F.lit("")) != runtime)).select(
        "run_id", "agent_id", "id", "content_hash", needs_custom.alias("needs_custom"))


def semantic_result_accept(results: DataFrame, tasks: DataFrame, current: DataFrame) -> DataFrame:
    """A classification counts only for an existing task whose listing has not changed since."""
    t = tasks.select("run_id", "property_id", F.col("content_hash").alias("task_hash"))
    c = current.select(F.col("id").alias("property_id"), F.col("content_hash").alias("current_hash"))
    out = results.join(t, ["run_id", "property_id"], "left").join(c, ["property_id"], "left")
    status = (F.when(F.col("task_hash").isNull(), "no_task")
              .when(~F.col("task_hash").eqNullSafe(F.col("current_hash")), "content_changed").otherwise("accepted"))
    return out.withColumn("status", status)


def merge_checks(checks: DataFrame) -> DataFrame:
    """One status per listing from its line-by-line checks: the worst one wins."""
    s = F.col("status")
    worst = F.min(F.when(s == "not_matched", 0).when(s == "uncertain", 1).otherwise(2))
    return (checks.groupBy("property_id").agg(worst.alias("_w"), F.count(F.lit(1)).alias("checks"))
            .select("property_id", "checks", F.when(F.col("_w") == 0, "not_matched").when(F.col("_w") == 1, "uncertain")
                    .otherwise("matched").alias("status")))
