"""Confirmed links between listings of one asset, and what they disclose."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expr import known, labels
from ..session import cut_lineage

# A step is a little more than -ln 0.97 = 0.03046: listings within 3 % sit in the same or the next bucket.
_STEP = 0.0306


def _address_key():
    return [F.regexp_replace(F.lower(c), r"(?U)[^\w]", "") for c in ("city", "address")]


def duplicate_offers(listings: DataFrame) -> DataFrame:
    """Each comparable listing with the offer it belongs to.

    An offer is one source's statement of an address, type and surface; copies of a listing
    share it. ``offer_id`` is the smallest listing id.
    """
    city, address = _address_key()
    rows = listings.where((F.coalesce("address", F.lit("")) != "") & (F.col("surface") > 0)).select(
        "id", "source_id", "property_type", "surface", city.alias("city_key"), address.alias("address_key"))
    keys = ["city_key", "address_key", "property_type", "source_id", "surface"]
    offers = rows.groupBy(*keys).agg(F.min("id").alias("offer_id"), F.count(F.lit(1)).alias("offer_listings"))
    return rows.join(offers, keys)


def duplicate_candidates(listings: DataFrame) -> DataFrame:
    """Pairs of offers from different sources at one address, surfaces within 3 % of the larger.

    Pairs link offers, not single listings, so a large group of copies gives one row and not
    its square; ``listing_pairs`` says how many listing pairs a row stands for, and
    ``duplicate_offers`` lists the members. Surfaces meet in narrow buckets, which splits a
    crowded address over many tasks.
    """
    city, address = _address_key()
    offers = (listings.where((F.coalesce("address", F.lit("")) != "") & (F.col("surface") > 0))
              .groupBy(city.alias("city_key"), address.alias("address_key"), "property_type", "source_id", "surface")
              .agg(F.min("id").alias("offer_id"), F.count(F.lit(1)).alias("listings"))
              .withColumn("bucket", F.floor(F.log("surface") / _STEP)))
    offers = cut_lineage(offers)  # both sides of the join read it
    b = F.col("bucket")
    left = offers.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1))).alias("x")
    right = offers.alias("y")
    on = ["city_key", "address_key", "property_type", "bucket"]
    pairs = left.join(right, on).where(
        (F.col("x.source_id") != F.col("y.source_id")) & (F.col("x.offer_id") < F.col("y.offer_id"))
        & (F.abs(F.col("x.surface") - F.col("y.surface")) / F.greatest("x.surface", "y.surface") <= 0.03))
    return pairs.select(F.col("x.offer_id").alias("a"), F.col("y.offer_id").alias("b"),
                        F.col("x.listings").alias("a_listings"), F.col("y.listings").alias("b_listings"),
                        (F.col("x.listings") * F.col("y.listings")).alias("listing_pairs"))


#: Width of a bucket of the sweep in log surface; rows within 3 % of an edge also stand in the bucket beyond it.
_SWEEP = 0.25


def duplicate_links(listings: DataFrame) -> DataFrame:
    """Two links at most per offer: to the next smaller and the next larger offer of another source, if within 3 %.

    The pairs of ``duplicate_candidates`` grow with the square of a crowded address; these links grow with its offers and
    connect the same groups. For, of two offers within 3 % everything between them is within 3 % too, and walking from either
    to its nearest offer of another source shortens the gap until they meet. Each address is swept in order of
    surface, in buckets wide enough that most rows stand in one.
    """
    city, address = _address_key()
    offers = (listings.where((F.coalesce("address", F.lit("")) != "") & (F.col("surface") > 0))
              .groupBy(city.alias("city_key"), address.alias("address_key"), "property_type", "source_id", "surface")
              .agg(F.min("id").alias("offer_id"), F.count(F.lit(1)).alias("listings")))
    log = F.log("surface")
    own = F.floor(log / _SWEEP)
    edges = F.array_distinct(F.array(own, F.floor((log - _STEP) / _SWEEP), F.floor((log + _STEP) / _SWEEP)))
    rows = offers.withColumn("own", own).withColumn("bucket", F.explode(edges))
    keys = ["city_key", "address_key", "property_type", "bucket"]
    links = []
    for ascending in (True, False):
        order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("surface", "source_id")]
        along = Window.partitionBy(*keys).orderBy(*order)
        other = F.struct(F.col("offer_id").alias("id"), "surface", "listings")
        # Where the source changes, the row before is the nearest of another source; the rows that follow with this source share it.
        turn = F.when(~F.lag("source_id").over(along).eqNullSafe(F.col("source_id")), F.lag(other).over(along))
        near = F.last(F.col("turn"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
        found = rows.withColumn("turn", turn).withColumn("near", near).where("own = bucket AND near IS NOT NULL")
        links.append(found.where(F.abs(F.col("surface") - F.col("near.surface")) / F.greatest("surface", "near.surface") <= 0.03))
    both = links[0].unionByName(links[1])
    first = F.col("offer_id") < F.col("near.id")
    return both.select(F.least("offer_id", "near.id").alias("a"), F.greatest("offer_id", "near.id").alias("b"),
                       F.when(first, F.col("listings")).otherwise(F.col("near.listings")).alias("a_listings"),
                       F.when(first, F.col("near.listings")).otherwise(F.col("listings")).alias("b_listings")).distinct()


def duplicate_groups(listings: DataFrame) -> DataFrame:
    """Each listing that may stand for an asset of other sources: its offer and its group (the smallest offer connected with it)."""
    groups = connected_components(duplicate_links(listings)).select(F.col("node").alias("offer_id"), F.col("root").alias("group_id"))
    return duplicate_offers(listings).join(groups, "offer_id").select("id", "offer_id", "group_id")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of each component.

    Alternating star contraction: each round links neighbours to the smallest of them, first
    the larger ones, then the smaller ones, until the edge set stops changing. Minima are
    pre-aggregated, so a node with very many edges costs no more than its rows. Each round
    ends in a written table; the driver sees two numbers per round.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()

    def fingerprint(df):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    previous = fingerprint(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lower.select("u", F.col("m").alias("v")))).distinct()
        links = cut_lineage(small)
        current = fingerprint(links)
        if current == previous:
            break
        previous = current
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def asset_clusters(reviews: DataFrame) -> DataFrame:
    """Listing and smallest listing of its asset, from pairs confirmed as the same asset."""
    same = reviews.where(F.col("decision") == "same_asset")
    return cut_lineage(connected_components(same).select(F.col("node").alias("id"), "root"))


def cluster_contradictions(reviews: DataFrame, clusters: DataFrame) -> DataFrame:
    """Assets that hold a pair judged to be different."""
    distinct = reviews.where(F.col("decision") == "distinct").select("a", "b")
    ca = clusters.select(F.col("id").alias("a"), F.col("root").alias("root_a"))
    cb = clusters.select(F.col("id").alias("b"), F.col("root").alias("root_b"))
    return (distinct.join(ca, "a").join(cb, "b").where("root_a = root_b")
            .groupBy(F.col("root_a").alias("root")).agg(F.count(F.lit(1)).alias("contradictions")))


def with_root(listings: DataFrame, clusters: DataFrame) -> DataFrame:
    return (listings.join(clusters, "id", "left")
            .withColumn("clustered", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "id")))


def latest_per_cluster(listings: DataFrame, clusters: DataFrame) -> DataFrame:
    """The most recently seen listing of each asset."""
    from ..functions.expr import newest_per
    rooted = with_root(listings, clusters)
    # Only confirmed assets are ranked: a listing without links is its own asset.
    ranked = newest_per(rooted.where("clustered"), ["root"], [F.desc("last_seen"), F.desc("id")])
    return rooted.where("not clustered").unionByName(ranked)


def cross_source_conflicts(listings: DataFrame, clusters: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Per confirmed asset: which facts its sources state differently in the same context."""
    members = listings.join(clusters, "id")
    stated = []
    for field, context in (("price", ["currency", "transaction_type"]), ("surface", ["area_basis"]), ("availability", []), ("condition", [])):
        number = field in ("price", "surface")
        value = F.struct((F.col(field) if number else F.lit(None).cast("double")).alias("n"), (F.lit(None).cast("string") if number else F.col(field)).alias("t"))
        usable = F.col(field).isNotNull()
        if not number:
            usable = usable & ~F.col(field).isin("unknown", "XXX", "review")
        for c in context:
            usable = usable & F.col(c).isNotNull() & ~F.col(c).isin("unknown", "XXX")
        stated.append(F.when(usable, F.struct(F.lit(field).alias("field"), F.array(*[F.col(c) for c in context]).cast("array<string>").alias("context"), value.alias("v"))))
    # Every statement with its context in one pass; more than one distinct value means the smallest differs from the largest.
    each = members.select("root", F.explode(F.array_compact(F.array(F.struct(F.lit("member").alias("field"), F.array().cast("array<string>").alias("context"),
                                                                              F.struct(F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("t")).alias("v")), *stated))).alias("s"))
    scoped = each.groupBy("root", "s.field", "s.context").agg(F.count(F.lit(1)).alias("n"), (F.min("s.v") != F.max("s.v")).alias("differs"))
    size = scoped.groupBy("root").agg(F.max(F.when(F.col("field") == "member", F.col("n"))).alias("members"),
                                      *[F.max((F.col("differs") & (F.col("field") == f)).cast("int")).alias("_" + f) for f in ("price", "surface", "availability", "condition")])
    out = size.join(contradictions.select("root", F.lit(1).alias("_identity")), "root", "left")
    on = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return out.select(
        "root", "members", on("_identity").alias("identity_conflict"), on("_availability").alias("availability_conflict"),
        labels([("Collegamenti tra annunci da rivedere", on("_identity")), ("Prezzi richiesti diversi", on("_price")),
                ("Superfici diverse", on("_surface")), ("Disponibilità discordante", on("_availability")),
                ("Stati manutentivi diversi", on("_condition"))]).alias("conflicts"))


def cluster_cross_source(listings: DataFrame, clusters: DataFrame, conflicts: DataFrame, sources: DataFrame) -> DataFrame:
    """Member rows of each confirmed asset with source, contact and declared mandate."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    rows = (listings.join(clusters, "id").join(sources, "source_id", "left")
            .join(conflicts.select("root", "members", "conflicts"), "root"))
    return rows.select("root", "id", "source_name", "url", "price", "currency", "surface", "area_basis", "transaction_type",
                       "availability", "condition", "last_seen", "contact_name", "telephone", "email",
                       F.coalesce(T.mandate(text), F.lit("")).alias("mandate"), F.col("members"),
                       F.array_join("conflicts", "; ").alias("conflicts"))
