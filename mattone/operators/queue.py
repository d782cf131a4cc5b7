"""Calls and the daily work queue."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expr import half_up, inactive, labels, newest_per, stamp
from ..functions.ranks import with_position, with_position_in
from ..functions.values import valid_email, valid_phone
from .catalog import pending_card
from .clusters import with_root
from .signals import facts_text


def latest_contact(actions: DataFrame) -> DataFrame:
    return newest_per(actions, ["property_id"], [F.desc("created_at"), F.desc("action_id")])


def contact_history(actions: DataFrame, team: DataFrame) -> DataFrame:
    """All calls with their author and ``position``: newest first within each listing."""
    called = actions.join(team.select("user_id", F.col("user_name").alias("author")), "user_id")
    return with_position_in(called, "property_id", [F.desc("created_at"), F.desc("action_id")])


def related_contact(actions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Latest call to any listing of the same confirmed asset, for each of its listings."""
    members = clusters.select("id", "root")
    called = actions.join(members.withColumnRenamed("id", "property_id"), "property_id")
    last = newest_per(called, ["root"], [F.desc("created_at"), F.desc("action_id")])
    return members.join(last.select("root", F.col("property_id").alias("called_id"), "action_id", "outcome", "mandate_status", "next_contact",
                                    "created_at"), "root")


def _call_allowed(today):
    """No call yet, or a call whose outcome leaves something to do by today."""
    return (F.col("outcome").isNull()
            | ((F.col("outcome") != "not_relevant")
               & (~F.col("outcome").isin("reached", "documents_requested") | F.col("next_contact").isNotNull())
               & (F.col("next_contact").isNull() | (F.col("next_contact") <= today))))


def today_queue(scored: DataFrame, memberships: DataFrame, actions: DataFrame, clusters: DataFrame, conflicts: DataFrame,
                fresh: DataFrame, as_of) -> DataFrame:
    """Listings to call or to verify today, one per asset; ``position`` is their working order, calls first."""
    today = F.date_format(stamp(as_of), "yyyy-MM-dd")
    fits = memberships.where("fit").groupBy("id").agg(F.count(F.lit(1)).alias("matching_searches"))
    own = latest_contact(actions).select(F.col("property_id").alias("id"), "outcome", "next_contact")
    rows = (with_root(scored, clusters).join(fits, "id", "left").join(own, "id", "left")
            .where((F.col("availability") == "listed") & ~F.col("review_status").isin("acquired", "discarded")
                   & (F.col("review_status").isin("shortlisted", "due_diligence", "negotiation") | F.col("matching_searches").isNotNull())
                   & _call_allowed(today)).drop("outcome", "next_contact"))
    # The asset's last call decides, whichever of its listings was called.
    called = actions.join(clusters.withColumnRenamed("id", "property_id"), "property_id", "left")
    asset_last = newest_per(called.withColumn("root", F.coalesce("root", "property_id")), ["root"], [F.desc("created_at"), F.desc("action_id")])
    rows = rows.join(asset_last.select("root", "outcome", "next_contact"), "root", "left").where(_call_allowed(today))
    rows = (rows.join(conflicts.select("root", "members", "identity_conflict", "availability_conflict", "conflicts"), "root", "left")
            .join(fresh.select("id", F.col("status").alias("freshness")), "id")
            .withColumn("route", T.contact_route(facts_text())["kind"]))
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    stale = F.col("freshness") == "stale"
    reachable = valid_phone("telephone") | valid_email("email")
    callable_ = reachable & ~(stale | truth("identity_conflict") | truth("availability_conflict"))
    checks = F.concat(F.coalesce("conflicts", F.array().cast("array<string>")),
                      labels([("Disponibilità da ricontrollare", stale), ("Recapito da trovare", ~reachable)]))
    rows = (rows.withColumn("callable", callable_).withColumn("direct", F.col("route") != "unknown").withColumn("checks", checks)
            .where(F.col("callable") | ~pending_card()))
    arrival = [F.asc_nulls_last("next_contact"), F.desc("priority_score"), F.desc("last_seen"), F.asc("id")]
    one = newest_per(rows, ["root"], [F.desc("callable"), F.desc("direct"), *arrival])
    rows = (one.select("id", "root", F.when(F.col("callable"), "call").otherwise("verify").alias("list"), "priority_score", "last_seen",
                       F.coalesce("matching_searches", F.lit(0).cast("bigint")).alias("matching_searches"), "outcome", "next_contact",
                       F.col("route").alias("route"), "freshness", F.coalesce("members", F.lit(1).cast("bigint")).alias("linked_count"), "checks"))
    return with_position(rows, [F.asc("list"), F.asc_nulls_last("next_contact"), F.asc(F.col("route") == "unknown"), F.desc("priority_score"), F.asc("id")])


def portal_pending(listings: DataFrame, n: int | None = 5) -> DataFrame:
    """Listings known only from a portal card, newest first, with the cut the card itself declares."""
    card = F.col("portal_card")
    old, price = card["old_price"], F.col("price")
    drop = F.when(card["price_drop"] & (old > 0) & (price > 0) & (price < old), half_up((price - old) / old * 100, 1))
    out = (listings.where(~F.col("review_status").isin("acquired", "discarded") & ~inactive() & pending_card())
           .select("id", "title", "price", "currency", "city", "zone", card["portal"].alias("portal"), card["source_url"].alias("card_url"),
                   drop.alias("drop_pct"), card["seen_at"].alias("seen_at"), "first_seen")
           .orderBy(F.desc("first_seen"), F.asc("id")))
    return out if n is None else out.limit(n)
