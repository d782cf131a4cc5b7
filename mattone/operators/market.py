"""Market segments and like-for-like references from asking prices in the archive."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.expr import all_of, days, half_up, inactive, known, labels, newest_per, present, price_sqm, size_band, stamp, text_key
from ..functions.quantiles import group_quantiles
from ..session import cut_lineage
from .clusters import latest_per_cluster, with_root
from .density import band_newest, band_stats


def market_segments(listings: DataFrame, clusters: DataFrame, as_of, window_days: int | None = None,
                    first: int | None = None) -> DataFrame:
    """Asking price per m² by homogeneous segment, confirmed duplicates counted once.

    Statistics need five assets. ``window_days`` keeps listings seen lately, ``first`` the
    largest segments in report order.
    """
    rows = listings
    if window_days is not None:
        rows = rows.where(F.col("last_seen") >= stamp(as_of) - days(window_days))
    assets = latest_per_cluster(rows, clusters)
    live = (assets.where(all_of([known(k) for k in rules.SEGMENT_KEYS]) & present("price") & present("surface")
                         & ~F.col("is_auction") & ~inactive())
            .withColumn("_value", F.col("price") / F.col("surface")).withColumn("size_band", size_band())
            .withColumn("_key", F.concat_ws("\u0001", text_key(*rules.SEGMENT_KEYS), "size_band")))
    newest = F.struct("last_seen", "id")
    segments = live.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.max("last_seen").alias("latest_observed"),
        F.max_by(F.struct(*rules.SEGMENT_KEYS, "size_band"), newest).alias("_s"))
    enough = segments.where(F.col("n") >= rules.MIN_SEGMENT).select("_key")
    # Values are opened only for segments large enough to report one.
    stats = group_quantiles(live.select("_key", "_value").join(enough, "_key", "left_semi"), ["_key"], "_value",
                            {"p25_sqm": 0.25, "median_sqm": 0.5, "p75_sqm": 0.75}, places=2)
    out = segments.join(stats, "_key", "left").select("_s.*", "n", "median_sqm", "p25_sqm", "p75_sqm",
                                                      (F.col("n") >= rules.MIN_SEGMENT).alias("sufficient"), "latest_observed")
    if first is not None:
        out = out.orderBy(F.desc("n"), "city", "zone", "property_type", "condition", "area_basis", "currency",
                          "transaction_type", "size_band").limit(first)
    return out


# --- Like-for-like references -----------------------------------------------------------------

def reference_subjects(listings: DataFrame, same_condition: bool = False) -> DataFrame:
    """Listings with their segment key and, where there is one, the reason against a comparison."""
    labels_it = {"city": "comune", "zone": "zona", "property_type": "tipologia", "area_basis": "tipo di superficie",
                 "currency": "valuta", "transaction_type": "vendita o affitto"}
    absent = [(label, ~F.coalesce(known(k), F.lit(False)) if k != "area_basis"
               else F.coalesce(F.col(k) == "", F.lit(True))) for k, label in labels_it.items()]
    absent.append(("superficie", ~F.coalesce(present("surface"), F.lit(False))))
    if same_condition:
        absent.append(("stato manutentivo", ~F.coalesce(known("condition"), F.lit(False))))
    gaps = labels(absent)
    reason = F.when(F.size(gaps) > 0, F.concat(F.lit("Dati mancanti: "), F.array_join(gaps, ", ")))
    if same_condition:
        reason = reason.when(F.col("is_auction"), "Per le aste serve un confronto dedicato")
    else:
        reason = reason.when(F.col("transaction_type") != "sale", "Solo compravendite")
    return listings.withColumn("seg", text_key(*rules.REFERENCE_KEYS)).withColumn("refusal", reason)


def reference_pool(listings: DataFrame, clusters: DataFrame, conflicts: DataFrame, as_of, conditions=None) -> DataFrame:
    """Comparables: live listings of the last 90 days, one per asset and segment.

    With ``conditions`` an asset stands with its newest listing in any of them; without, with its newest one in each
    condition. Assets whose sources contradict each other are left out.
    """
    now = stamp(as_of)
    rows = with_root(listings, clusters).where(
        ~F.col("is_auction") & (F.col("availability") == "listed") & (F.col("price") > 0) & (F.col("surface") > 0)
        & (F.col("last_seen") >= now - days(90)) & (F.col("last_seen") <= now))
    if conditions is not None:
        rows = rows.where(F.col("condition").isin(*conditions))
    doubtful = conflicts.where(F.size("conflicts") > 0).select("root")
    rows = (rows.join(doubtful, "root", "left_anti").withColumn("seg", text_key(*rules.REFERENCE_KEYS))
            .withColumn("comp_sqm", price_sqm()))
    multi = newest_per(rows.where("clustered"), ["root", "seg", *(["condition"] if conditions is None else [])], [F.desc("last_seen"), F.asc("id")])
    return rows.where("not clustered").unionByName(multi).select(
        "seg", F.col("condition").alias("comp_condition"), F.col("root").alias("comp_root"), F.col("id").alias("comp_id"),
        F.col("title").alias("comp_title"), F.col("url").alias("comp_url"), F.col("surface").alias("comp_surface"),
        F.col("price").alias("comp_price"), "comp_sqm", F.col("last_seen").alias("comp_seen"), F.col("source_id").alias("comp_source"))


def _with_domain(pool: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(F.col("source_id").alias("comp_source"), "domain")
    return (pool.join(s, "comp_source", "left")
            .withColumn("comp_origin", F.coalesce(F.when(F.col("domain") != "", F.col("domain")), "comp_source")).drop("domain"))


def market_references(listings: DataFrame, clusters: DataFrame, conflicts: DataFrame, sources: DataFrame, as_of,
                      same_condition: bool = False) -> DataFrame:
    """Per listing and condition: what comparable assets ask, at least three needed.

    Without ``same_condition`` each listing is set against assets to renovate, renovated and
    new; with it, against assets in its own condition.
    """
    conditions = None if same_condition else rules.REFERENCE_CONDITIONS
    subjects = reference_subjects(listings, same_condition)
    pool = cut_lineage(_with_domain(reference_pool(listings, clusters, conflicts, as_of, conditions), sources))
    asking = cut_lineage(with_root(subjects.where("refusal is null"), clusters).select("id", "seg", "root", "surface", "condition"))
    stats = band_stats(asking, pool, same_condition)
    keep = subjects.select("id", "condition", "price", "surface", "refusal")
    if same_condition:
        groups = keep.withColumn("key", F.col("condition"))
    else:
        groups = keep.withColumn("key", F.explode(F.array(*[F.lit(c) for c in conditions])))
    out = groups.join(stats.withColumnRenamed("comp_condition", "key"), ["id", "key"], "left")
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    enough = n >= rules.MIN_REFERENCE
    spread = F.when(enough, half_up((F.col("max_raw") - F.col("min_raw")) / F.col("median_raw") * 100, 1))
    own = enough & present("price") & (F.col("condition") == F.col("key"))
    out = out.withColumn("spread_pct", spread)
    warnings = labels([("Una sola fonte nel campione", (n > 0) & (F.col("source_count") == 1)),
                       ("Prezzi molto dispersi: confronta i singoli annunci", enough & (F.col("spread_pct") > 50)),
                       ("Mostrati i primi 12 asset del campione", n > rules.SHOWN_COMPARABLES)])
    return out.select(
        "id", "key", n.alias("n"), F.when(enough, half_up("median_raw", 2)).alias("median_sqm"),
        F.when(enough, F.col("min_raw")).alias("min_sqm"), F.when(enough, F.col("max_raw")).alias("max_sqm"),
        F.when(enough, half_up("q1_raw", 2)).alias("q1_sqm"), F.when(enough, half_up("q3_raw", 2)).alias("q3_sqm"),
        "spread_pct", F.coalesce("source_count", F.lit(0).cast("bigint")).alias("source_count"),
        F.col("oldest").alias("oldest_observed"), F.col("newest").alias("newest_observed"),
        F.when(own, half_up((F.col("price") / F.col("surface") / F.col("median_raw") - 1) * 100, 1)).alias("asking_delta_pct"),
        F.array_join(warnings, "; ").alias("warnings"),
        F.coalesce("refusal", F.when(~enough, "Servono almeno 3 asset confrontabili").otherwise("Prezzi richiesti osservati")).alias("reason"))


def market_comparables(listings: DataFrame, clusters: DataFrame, conflicts: DataFrame, sources: DataFrame, as_of,
                       shown: int = rules.SHOWN_COMPARABLES) -> DataFrame:
    """The comparables shown with each listing: the most recent ones of each condition."""
    subjects = with_root(reference_subjects(listings).where("refusal is null"), clusters).select(
        "id", "seg", "root", "surface", "condition")
    pool = cut_lineage(_with_domain(reference_pool(listings, clusters, conflicts, as_of, rules.REFERENCE_CONDITIONS), sources))
    columns = ["id", "comp_condition", "comp_id", "comp_sqm", "comp_surface", "comp_price", "comp_source", "comp_seen", "position"]
    return band_newest(subjects, pool, shown).select(*columns)


def headroom(references: DataFrame, listings: DataFrame) -> DataFrame:
    """Distance from the own ask to the renovated and new medians, per m² and for the surface."""
    own = listings.select("id", F.col("surface").alias("own_surface"), price_sqm().alias("own_sqm"))
    gap = F.col("median_sqm") - F.col("own_sqm")
    return (references.where(F.col("key").isin("renovated", "new") & F.col("median_sqm").isNotNull()).join(own, "id")
            .where(F.col("own_sqm").isNotNull() & present("own_surface"))
            .select("id", "key", half_up(gap, 0).alias("gap_sqm"),
                    (half_up(gap * F.col("own_surface") / 1000, 0) * 1000).alias("gap_total")))
