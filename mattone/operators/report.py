"""The analyst's nine tables, each a frame with one row per fact."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import missing_fields
from .history import history_price_delta
from .scenario import scenario_profit

_STATE = {"listed": "Pubblicato", "sold": "Venduto", "rented": "Affittato", "withdrawn": "Ritirato"}
_STAGE = {"new": "Da valutare", "reviewing": "In valutazione", "shortlisted": "In shortlist", "due_diligence": "Due diligence",
          "negotiation": "Negoziazione", "acquired": "Acquisito", "discarded": "Scartato"}


def _label(c: str, names: dict[str, str], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(c)), default)


def selection(scored: DataFrame, signals: DataFrame, dossier: DataFrame, zone_signals: DataFrame, fresh: DataFrame, questions: DataFrame,
              memberships: DataFrame, searches: DataFrame, conflicts: DataFrame, clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """Decision columns of every listing in the order the analyst reads them."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    links = memberships.join(searches.select("agent_id", "agent_name"), "agent_id").groupBy("id").agg(
        F.sort_array(F.collect_set(F.when(F.col("fit"), F.col("agent_name")))).alias("searches"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("broken"))
    s = signals.drop("price_sqm", "currency", "condition", "cadastral", "change_of_use", "mandate", "contact", "has_phone", "has_email", "kind", "label", "quote")
    d = dossier.drop("url", "first_seen", "last_seen", "contact_name", "telephone", "email", "reductions", "total_pct")
    z = zone_signals.select("id", F.col("min_sqm").alias("zone_min"), F.col("max_sqm").alias("zone_max"), F.col("delta_pct").alias("zone_delta"))
    f = fresh.select("id", F.col("status").alias("freshness"), "checked_at")
    c = clusters.join(conflicts.select("root", "conflicts"), "root").select("id", "conflicts")
    rows = (scored.join(s, "id", "left").join(d, "id", "left").join(z, "id", "left").join(f, "id", "left").join(questions, "id", "left")
            .join(links, "id", "left").join(c, "id", "left").join(sources.select("source_id", "source_name"), "source_id", "left"))
    reasons = F.array_distinct(F.concat(F.coalesce("broken", F.array().cast("array<string>")), F.coalesce("conflicts", F.array().cast("array<string>")),
                                        F.when(F.col("benchmark_id").isNull(), F.array(F.lit("Benchmark compatibile assente"))).otherwise(F.array().cast("array<string>"))))
    samples = F.concat_ws("/", *[F.coalesce(f"{k}_n", F.lit(0)).cast("string") for k in ("to_renovate", "renovated", "new")])
    return rows.select(
        "id", "title", "city", "zone", "price", "currency", "surface", "price_sqm", "to_renovate_median_sqm", "to_renovate_delta_pct", "renovated_median_sqm",
        "renovated_delta_pct", "new_median_sqm", "new_delta_pct", samples.alias("samples"), "zone_min", "zone_max", "zone_delta", "discount", "days_listed", "listed_basis",
        "reductions", "total_pct", "cadastral", "change_of_use", "contact_name", "telephone", "email", "route_kind", "route_quote", "mandate_status", "next_contact",
        _label("availability", _STATE, F.lit("Da verificare")).alias("availability"), _label("review_status", _STAGE, F.col("review_status")).alias("stage"),
        F.array_join("searches", "; ").alias("searches"), F.array_join(reasons, "; ").alias("reasons"), F.array_join("questions", "\n").alias("to_clarify"),
        F.array_join(missing_fields(), ", ").alias("missing_fields"), "source_name", "url", "published_at", day("first_seen").alias("first_seen"),
        day("last_seen").alias("last_seen"), "freshness", day("checked_at").alias("checked_at"))


def report_tables(*, opportunities: DataFrame, selected: DataFrame, references: DataFrame, comparables: DataFrame, memberships: DataFrame, searches: DataFrame,
                  checks: DataFrame, contacts: DataFrame, cross_source: DataFrame, scenarios: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """Name and frame of each table: opportunities, selection, references, comparables, criteria,
    contacts, sources of the same asset, scenarios and history."""
    wanted = searches.where("custom_prompt <> ''").select("agent_id", "agent_name", "custom_prompt")
    criteria = (memberships.select("id", "agent_id").join(wanted, "agent_id").join(checks, ["id", "agent_id"], "left")
                .withColumn("status", F.coalesce("status", F.lit("to_analyse"))))
    return {"opportunities": opportunities, "selection": selected, "references": references, "comparables": comparables, "criteria": criteria,
            "contacts": contacts, "same_asset_sources": cross_source.where("members > 1"), "scenarios": scenario_profit(scenarios),
            "history": history_price_delta(observations)}
