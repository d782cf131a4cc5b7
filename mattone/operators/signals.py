"""Compact decision signals of every listing, and the dossier that joins them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions.expr import half_up, labels, price_sqm, stamp
from ..functions.values import valid_email, valid_phone


def facts_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))


def text_facts(listings: DataFrame) -> DataFrame:
    """Cadastral, change-of-use and mandate declarations quoted from the text."""
    text = facts_text()
    return listings.select("id", T.cadastral(text).alias("cadastral"), T.change_of_use(text).alias("change_of_use"),
                           T.mandate(text).alias("mandate"))


def days_listed(listings: DataFrame, as_of) -> DataFrame:
    """Whole days on the market: from a declared date that is not in the future, else first seen."""
    now = stamp(as_of)
    declared = F.try_to_timestamp("published_at").cast("timestamp_ntz")
    usable = declared.isNotNull() & (declared <= now)
    since = F.when(usable, declared).when(F.col("first_seen") <= now, F.col("first_seen"))
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))
    return listings.select("id", F.floor(seconds / 86400).cast("bigint").alias("days_listed"),
                           F.date_format(since, "yyyy-MM-dd").alias("listed_since"),
                           F.when(since.isNotNull(), F.when(usable, "published").otherwise("first_seen")).alias("listed_basis"))


def contact_flags(listings: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("contact_name", F.lit("")) != "", F.col("contact_name"))
    return listings.select("id", name.alias("contact"), valid_phone("telephone").alias("has_phone"), valid_email("email").alias("has_email"))


def freshness(listings: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """Whether the detail page was read within the hours its source asks for (1–720, else 24)."""
    now = stamp(as_of)
    hours = F.when(F.col("refresh_hours").between(1, 720), F.col("refresh_hours")).otherwise(24)
    joined = listings.select("id", "source_id", "last_detail_at").join(sources.select("source_id", "refresh_hours", "kind"), "source_id", "left")
    valid = F.coalesce(F.col("last_detail_at") <= now, F.lit(False))
    stale = ~valid | (F.col("last_detail_at") <= now - F.make_dt_interval(F.lit(0), hours))
    return joined.select("id", F.when(stale, "stale").otherwise("recent").alias("status"),
                         F.when(valid, F.col("last_detail_at")).alias("checked_at"),
                         F.when(valid, F.col("last_detail_at") + F.make_dt_interval(F.lit(0), hours)).alias("due_at"),
                         hours.cast("bigint").alias("hours"),
                         F.when(F.col("kind") == "import", "Importazione").otherwise("Pagina acquisita").alias("method"))


def contact_routes(listings: DataFrame) -> DataFrame:
    route = T.contact_route(facts_text())
    return listings.select("id", route.alias("r")).select("id", "r.kind", "r.label", "r.quote")


def reference_pivot(references: DataFrame) -> DataFrame:
    """One row per listing with the three medians, quartiles and sample sizes."""
    aggs = []
    for key in rules.REFERENCE_CONDITIONS:
        for name in ("median_sqm", "q1_sqm", "q3_sqm", "n", "source_count"):
            aggs.append(F.max(F.when(F.col("key") == key, F.col(name))).alias(f"{key}_{name}"))
    return references.groupBy("id").agg(*aggs)


def signals(listings: DataFrame, observations_reductions: DataFrame, references: DataFrame, as_of) -> DataFrame:
    """One row per listing: age, reductions, declarations, contact and position against references."""
    refs = reference_pivot(references)
    out = (listings.select("id", price_sqm().alias("price_sqm"), "currency", "condition")
           .join(days_listed(listings, as_of), "id").join(contact_flags(listings), "id").join(contact_routes(listings), "id")
           .join(text_facts(listings), "id")
           .join(observations_reductions.withColumnRenamed("property_id", "id"), "id", "left").join(refs, "id", "left"))
    for key in rules.REFERENCE_CONDITIONS:
        out = out.withColumn(f"{key}_delta_pct", half_up((F.col("price_sqm") / F.col(f"{key}_median_sqm") - 1) * 100, 1))
    return out


def listing_dossier(listings: DataFrame, reductions: DataFrame, contacts: DataFrame) -> DataFrame:
    """Facts, reductions, contact, route and last call of every listing in one row."""
    text = facts_text()
    base = listings.select("id", "url", "last_seen", "first_seen", "contact_name", "telephone", "email", T.cadastral(text).alias("cadastral"),
                           T.change_of_use(text).alias("change_of_use"), T.mandate(text).alias("mandate"), T.contact_route(text).alias("route"))
    red = reductions.select(F.col("property_id").alias("id"), "reductions", "total_pct")
    call = contacts.select(F.col("property_id").alias("id"), "outcome", "mandate_status", "next_contact")
    return (base.join(red, "id", "left").join(call, "id", "left")
            .select("id", "url", "first_seen", "last_seen", "contact_name", "telephone", "email", "cadastral", "change_of_use", "mandate",
                    F.col("route.kind").alias("route_kind"), F.col("route.quote").alias("route_quote"),
                    "reductions", "total_pct", "outcome", "mandate_status", "next_contact"))


def open_questions() -> Column:
    """What to ask the advertiser, from the gaps of one assembled row."""
    missing_refs = F.array_join(F.col("missing_references"), ", ")
    return labels([
        ("L’immobile è ancora disponibile? Confermare prima di procedere.", (F.col("freshness") == "stale") | F.coalesce(F.col("availability_conflict"), F.lit(False))),
        ("Qual è il rapporto con la proprietà e chi ha il mandato?", ~F.col("mandate_status").eqNullSafe(F.lit("confirmed_by_team"))),
        ("Richiedere categoria catastale e documentazione aggiornata.", F.col("cadastral").isNull()),
        ("Quali documenti supportano il cambio d’uso dichiarato?", F.array_contains("strategy_names", "conversion")),
        ("Qual è il prezzo aggiornato e perché differisce tra le fonti?", F.array_contains("conflicts", "Prezzi richiesti diversi")),
        ("Da quando è in vendita? Ci sono ribassi precedenti al nostro storico?", F.col("published_at").isNull()),
        (F.concat(F.lit("Integrare comparabili: "), missing_refs, F.lit(".")), F.size("missing_references") > 0),
        ("Manca un benchmark compatibile: verificare il vantaggio di prezzo.", F.col("benchmark_id").isNull()),
    ])


def questions(scored: DataFrame, fresh: DataFrame, conflicts: DataFrame, clusters: DataFrame, contacts: DataFrame,
              references: DataFrame) -> DataFrame:
    """Ordered open questions of every listing."""
    names = {"to_renovate": "da ristrutturare", "renovated": "ristrutturato", "new": "nuovo"}
    refs = references.groupBy("id").agg(*[F.max(F.when(F.col("key") == k, F.col("median_sqm"))).alias("_" + k) for k in names])
    missing_refs = labels([(label, F.col("_" + k).isNull()) for k, label in names.items()])
    rows = (scored.select("id", "published_at", "benchmark_id", F.col("strategies.strategy").alias("strategy_names"),
                          T.cadastral(facts_text()).alias("cadastral"))
            .join(fresh.select("id", F.col("status").alias("freshness")), "id")
            .join(clusters, "id", "left").join(conflicts.select("root", "availability_conflict", "conflicts"), "root", "left")
            .join(contacts.select(F.col("property_id").alias("id"), "mandate_status"), "id", "left")
            .join(refs, "id", "left").withColumn("missing_references", missing_refs))
    return rows.select("id", open_questions().alias("questions"))
