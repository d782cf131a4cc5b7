"""Advertisers across the archive, from the contacts that listings declare."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expr import closed, half_up, let
from ..functions.values import norm_email, norm_phone
from ..session import cut_lineage
from .clusters import connected_components
from .signals import facts_text


def contact_keys(listings: DataFrame) -> DataFrame:
    """Listings with the keys that tie them to an advertiser: phone and e-mail, else the organization, else the name."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    if "organization" not in listings.columns:
        listings = listings.withColumn("organization", F.lit(None).cast("string"))
    rows = (listings.withColumn("phone", norm_phone("telephone")).withColumn("mail", norm_email("email"))
            .withColumn("name", squeeze("contact_name")).withColumn("organization", squeeze("organization")))

    def keys(c):
        direct = F.filter(F.array(F.when(c["phone"] != "", F.concat(F.lit("tel:"), c["phone"])),
                                  F.when(c["mail"] != "", F.concat(F.lit("mail:"), c["mail"]))), lambda x: x.isNotNull())
        said = F.when(c["organization"] != "", c["organization"]).otherwise(c["name"])
        named = F.when(said != "", F.array(F.concat(F.lit("name:"), F.lower(said)))).otherwise(F.array().cast("array<string>"))
        return let(direct, lambda d: F.when(F.size(d) > 0, d).otherwise(named))

    # One element exploded: what is asked of the keys later cannot be pushed below, where it would compute them again.
    return rows.withColumn("keys", F.explode(F.array(let(F.struct("phone", "mail", "organization", "name"), keys))))


def advertiser_components(listings: DataFrame) -> DataFrame:
    """(key, advertiser): keys seen together on any listing name one advertiser.

    Only distinct pairs of keys enter the graph, so it grows with the contacts and not with
    the listings.
    """
    keyed = cut_lineage(contact_keys(listings.where(~closed())).select("keys").where(F.size("keys") > 0).distinct())
    pairs = keyed.where(F.size("keys") > 1).select(F.col("keys")[0].alias("a"), F.col("keys")[1].alias("b")).distinct()
    linked = connected_components(pairs).select(F.col("node").alias("key"), F.col("root").alias("advertiser"))
    singles = keyed.select(F.explode("keys").alias("key")).distinct().join(linked.select("key"), "key", "left_anti")
    return cut_lineage(linked.unionByName(singles.select("key", F.col("key").alias("advertiser"))))


def broker_top_values(rows: DataFrame, group: str, value: str, n: int | None = None) -> DataFrame:
    """Values of a column by frequency within each group, ties in text order."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def _advertised(listings: DataFrame, components: DataFrame) -> DataFrame:
    rows = contact_keys(listings.where(~closed())).where(F.size("keys") > 0).withColumn("key", F.col("keys")[0])
    return rows.join(components, "key").withColumn("direct", T.contact_route(facts_text())["kind"] != "unknown")


#: Text columns of a directory row and how many of their values it shows, most frequent first (None: all).
_SHOWN = {"name": 4, "organization": 1, "telephone": 1, "mail": 1, "city": None, "zone": 6, "source_name": None}


def broker_directory(listings: DataFrame, components: DataFrame, sources: DataFrame | None = None, city: str = "", min_price: float | None = None,
                     max_price: float | None = None, direct_only: bool = False, q: str = "") -> DataFrame:
    """One row per advertiser: most frequent name, organization, phone and e-mail, further names, places, sources, counts, amounts in euro.

    ``city`` and the bounds (euro only) choose listings; ``direct_only`` and ``q`` (text found in any shown field, case ignored) choose rows.
    One pass counts (advertiser, kind of text, value), the totals being one more kind; values are ranked within their kind.
    """
    rows = _advertised(listings, components)
    if city.strip():
        rows = rows.where(F.lower("city") == city.strip().lower())
    if min_price is not None:
        rows = rows.where((F.col("currency") == "EUR") & (F.col("price") >= min_price))
    if max_price is not None:
        rows = rows.where((F.col("currency") == "EUR") & (F.col("price") <= max_price))
    if sources is not None:
        rows = rows.join(sources.select("source_id", "source_name"), "source_id", "left")
    elif "source_name" not in rows.columns:
        rows = rows.withColumn("source_name", F.col("source_id"))
    # The phone as printed, where it is one.
    rows = rows.withColumn("telephone", F.when(F.col("phone") != "", F.col("telephone")))
    euro = F.when((F.col("currency") == "EUR") & (F.col("price") != 0), F.col("price"))
    kinds = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in _SHOWN])
    counted = (rows.select("advertiser", "direct", "last_seen", euro.alias("euro"), F.explode(kinds).alias("k")).where("k.kind = '' OR k.value <> ''")
               .groupBy("advertiser", "k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("direct"), 1)).alias("direct"), F.sum(F.col("euro").cast("decimal(18,2)")).alias("sum"),
                                                               F.max("euro").alias("max"), F.max("last_seen").alias("last_seen")))
    w = Window.partitionBy("advertiser", "kind").orderBy(F.desc("n"), F.asc("value"))
    ranked = counted.withColumn("rank", F.row_number().over(w)).where(
        " OR ".join(["kind = ''", *[f"kind = '{c}'" + ("" if shown is None else f" AND rank <= {shown}") for c, shown in _SHOWN.items()]]))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("rank", "value")))), lambda x: x["value"])
    whole = lambda c: F.max(F.when(F.col("kind") == "", F.col(c)))
    out = ranked.groupBy("advertiser").agg(*[texts(c).alias(c + "_list") for c in _SHOWN], whole("n").alias("count"), whole("direct").alias("direct"), half_up(whole("sum"), 0).alias("value_eur"),
                                           whole("max").alias("max_price_eur"), whole("last_seen").alias("last_seen"))
    first = lambda c, name: F.get(F.col(c + "_list"), F.lit(0)).alias(name)
    out = out.select("advertiser", first("name", "name"), first("organization", "organization"), first("telephone", "phone"), first("mail", "email"), F.slice("name_list", 2, 3).alias("other_names"),
                     F.col("city_list").alias("cities"), F.col("zone_list").alias("zones"), F.col("source_name_list").alias("sources"), "count", "direct", "value_eur", "max_price_eur", "last_seen")
    if direct_only:
        out = out.where("direct > 0")
    if q.strip():
        said = F.concat_ws(" ", "name", "organization", "phone", "email", "other_names", "cities", "zones")
        out = out.where(F.contains(F.lower(said), F.lit(q.strip().lower())))
    return out


def broker_page(directory: DataFrame, limit: int = 200) -> DataFrame:
    """The first advertisers by direct contacts, listings and value, with the number there are and whether some are not shown."""
    total = directory.agg(F.count(F.lit(1))).scalar()
    shown = directory.orderBy(F.desc("direct"), F.desc("count"), F.desc(F.coalesce("value_eur", F.lit(0))), "advertiser").limit(limit)
    return shown.withColumn("total", total).withColumn("limited", F.col("total") > limit)


def broker_listings(listings: DataFrame, components: DataFrame, n: int = 20) -> DataFrame:
    """The dearest listings of each advertiser, as rows."""
    w = Window.partitionBy("advertiser").orderBy(F.desc(F.coalesce("price", F.lit(0.0))), F.asc("id"))
    return (_advertised(listings, components).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
            .select("advertiser", "position", "id", "city", "zone", "price", "currency", "surface", "review_status", "direct"))


def unattributed(listings: DataFrame) -> DataFrame:
    """How many open listings name no advertiser."""
    return (contact_keys(listings.where(~closed()))
            .agg(F.count(F.when(F.size("keys") == 0, 1)).alias("unattributed"), F.count(F.lit(1)).alias("examined")))
