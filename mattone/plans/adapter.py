"""The driver's tables seen as a listing archive.

Every dataset is a deterministic projection of the given Parquet tables, so that the same
mapping can be written in SQL for the checks (``plans.oracle``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import stamp
from ..session import cut_lineage

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"

PHRASES = [
    "Ufficio da ristrutturare con ingresso indipendente.",
    "Immobile locato, ottimo a reddito.",
    "Possibile cambio d'uso in residenziale, da verificare in comune.",
    "Non da ristrutturare, pronto da abitare.",
    "Terreno edificabile con demolizione e ricostruzione approvata.",
    "Vendita diretta da proprietario, senza agenzie.",
    "Mandato esclusivo dello studio, visite su appuntamento.",
    "Cerchiamo incarico in esclusiva per clienti referenziati.",
    "Categoria catastale A/3, classe energetica D.",
    "Ristrutturato nel 1999, ambienti luminosi.",
    "Piano alto con terrazzo, venduto arredato.",
]


WIDE = {"orders", "documents", "events", "pages", "conversations"}


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the files give fewer splits than there are; large inputs pass untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in WIDE else df


def phrase(k: Column) -> Column:
    out = F.when(k % 11 == 0, PHRASES[0])
    for i, text in enumerate(PHRASES[1:], 1):
        out = out.when(k % 11 == i, text)
    return out


_LISTING = [
    "o_orderkey AS k", "o_custkey AS cust", "concat('L', o_orderkey) AS id", "CAST(o_orderkey AS STRING) AS listing_key",
    "concat('S', o_custkey % 7) AS source_id", "concat('https://s', o_custkey % 7, '.example/annunci/', o_orderkey) AS url",
    "concat('Annuncio ', o_orderkey) AS title",
    "CASE WHEN o_orderkey % 13 <> 0 THEN element_at(array({phrases}), CAST(o_orderkey % 11 AS INT) + 1) END AS description",
    "r_name AS city", "concat('Z', o_custkey % 3) AS zone",
    "CASE WHEN o_orderkey % 9 <> 0 THEN concat('Via ', o_orderkey % 40) END AS address",
    "CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'residential' WHEN c_mktsegment = 'MACHINERY' THEN 'logistics' "
    "WHEN c_mktsegment = 'AUTOMOBILE' THEN 'commercial' ELSE 'office' END AS property_type",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'to_renovate' WHEN '2-HIGH' THEN 'renovated' WHEN '3-MEDIUM' THEN 'new' "
    "WHEN '4-NOT SPECIFIED' THEN 'good' ELSE 'unknown' END AS condition",
    "CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price",
    "CASE WHEN o_orderkey % 23 <> 0 THEN CAST(40 + (o_orderkey * 37) % 400 AS DOUBLE) END AS surface",
    "CASE WHEN o_orderkey % 5 <= 2 THEN 'commercial' WHEN o_orderkey % 5 = 3 THEN 'net' ELSE 'unknown' END AS area_basis",
    "CASE WHEN o_orderkey % 19 = 0 THEN 'USD' WHEN o_orderkey % 29 = 0 THEN 'XXX' ELSE 'EUR' END AS currency",
    "CASE WHEN o_orderkey % 8 = 0 THEN 'rent' WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE 'sale' END AS transaction_type",
    "CASE WHEN o_orderstatus IN ('O', 'P') THEN 'listed' WHEN o_orderkey % 4 = 0 THEN 'sold' WHEN o_orderkey % 4 = 1 THEN 'withdrawn' "
    "ELSE 'unknown' END AS availability",
    "o_orderkey % 37 = 0 AS is_auction", "o_orderkey % 10 = 0 AS starred",
    "element_at(array('new', 'reviewing', 'shortlisted', 'due_diligence', 'negotiation', 'acquired', 'discarded'), "
    "CAST(o_orderkey % 7 AS INT) + 1) AS review_status",
    "CAST(o_orderkey % 6 + 1 AS DOUBLE) AS rooms", "CAST(o_orderkey % 3 + 1 AS DOUBLE) AS bathrooms",
    "CASE WHEN o_orderkey % 21 <> 0 THEN 36 + (o_orderkey * 7919 % 1200) / 100.0D END AS latitude",
    "CASE WHEN o_orderkey % 21 <> 0 THEN 6 + (o_orderkey * 104729 % 1330) / 100.0D END AS longitude",
    "TIMESTAMP_NTZ '{as_of}' - make_dt_interval(CAST(o_orderkey % 200 AS INT)) AS last_seen",
    "TIMESTAMP_NTZ '{as_of}' - make_dt_interval(CAST(o_orderkey % 200 + o_orderkey % 300 AS INT)) AS first_seen",
    "CASE WHEN o_orderkey % 14 <> 0 THEN TIMESTAMP_NTZ '{as_of}' - make_dt_interval(0, CAST(o_orderkey % 72 AS INT)) END AS last_detail_at",
    "CASE WHEN o_orderkey % 5 < 2 THEN date_format(TIMESTAMP_NTZ '{as_of}' - make_dt_interval(CAST(o_orderkey % 200 + o_orderkey % 300 "
    "+ o_orderkey % 30 AS INT)), 'yyyy-MM-dd') WHEN o_orderkey % 5 = 2 THEN '2099-01-01' END AS published_at",
    "CASE WHEN o_orderkey % 6 <> 0 THEN concat('+3902', lpad(CAST(o_custkey % 50 AS STRING), 6, '0')) END AS telephone",
    "CASE WHEN o_orderkey % 4 <> 0 THEN concat('agente', o_custkey % 80, '@casa.example') END AS email",
    "CASE WHEN o_orderkey % 12 <> 0 THEN concat('Agente ', o_custkey % 80) END AS contact_name",
    "CASE WHEN o_orderkey % 12 = 5 THEN named_struct('incomplete', o_orderkey % 24 = 5, 'price_drop', o_orderkey % 36 = 5, "
    "'old_price', o_totalprice * 1.25D, 'portal', 'casa.it', 'source_url', concat('https://www.casa.it/immobili/', o_orderkey, '/'), "
    "'seen_at', TIMESTAMP_NTZ '{as_of}' - make_dt_interval(CAST(o_orderkey % 200 + o_orderkey % 10 AS INT))) END AS portal_card",
]


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer and region, as listings."""
    phrases = ", ".join("'" + p.replace("'", "\\'") + "'" for p in PHRASES)
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return (orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
            .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
            .join(region, nation["n_regionkey"] == region["r_regionkey"])
            .selectExpr(*[e.format(phrases=phrases, as_of=AS_OF) if "{" in e else e for e in _LISTING]))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Events as price observations of the listing named by the user."""
    e, kind = table(spark, folder, "events"), F.col("event_type")
    n = F.get_json_object("props", "$.k").cast("bigint")
    fields = F.struct(
        F.concat(F.lit("Annuncio "), F.col("user_id")).alias("title"), (F.col("value") * 1000).alias("price"),
        (50 + 10 * (n % 2)).cast("double").alias("surface"), F.when(kind == "error", "XXX").otherwise("EUR").alias("currency"),
        F.when(kind == "signup", "rent").otherwise("sale").alias("transaction_type"),
        F.when(n % 7 == 0, "unknown").otherwise("commercial").alias("area_basis"),
        F.lit("office").alias("property_type"), F.when(n % 3 == 0, "good").otherwise("new").alias("condition"),
        F.lit("Milano").alias("city"), F.concat(F.lit("Z"), F.col("user_id") % 3).alias("zone"),
        F.when(n % 5 != 0, F.concat(F.lit("Via "), F.col("user_id") % 40)).alias("address"),
        (n % 4).cast("double").alias("rooms"), (n % 2).cast("double").alias("bathrooms"),
        F.lit(45.0).alias("latitude"), F.lit(9.0).alias("longitude"), (n % 11 == 0).alias("is_auction"),
        kind.alias("description"), F.when(n % 9 == 0, "review").otherwise("listed").alias("availability"))
    return e.select(
        F.col("event_id").alias("observation_id"), F.concat(F.lit("L"), F.col("user_id")).alias("property_id"),
        F.col("ts").alias("observed_at"), fields["price"].alias("price"), fields["currency"].alias("currency"),
        fields["transaction_type"].alias("transaction_type"), fields["area_basis"].alias("area_basis"),
        fields["surface"].alias("surface"), F.sha2(F.to_json(fields), 256).alias("content_hash"),
        F.concat(F.lit("v"), F.col("event_id") % 3).alias("parser_version"),
        F.when(F.col("event_id") % 10 != 0, fields).alias("fields"))


def benchmarks(spark: SparkSession, folder: str) -> DataFrame:
    """Published price ranges for the known combinations of keys, in several periods."""
    keys = ["city", "zone", "property_type", "condition", "area_basis", "currency", "transaction_type"]
    series = listings(spark, folder).select(*keys)
    for key in keys:
        series = series.where(~F.col(key).isin("unknown", "XXX"))
    weight = (F.ascii("city") + 5 * F.ascii("condition") + 11 * F.length("property_type")
              + 3 * F.ascii(F.substring("zone", 2, 1)) + 7 * F.length("area_basis"))
    latest = F.when(F.col("zone") == "Z2", "1999-S2").otherwise("2001-S1")
    periods = F.when(F.col("city") == "ASIA", F.array(latest, F.lit("1999-S1"), F.lit("2003-S1"))).otherwise(
        F.array(latest, F.lit("1999-S1")))
    return (series.distinct().withColumn("period", F.explode(periods))
            .withColumn("min_sqm", (800 + 10 * (weight % 97) + F.when(F.col("period") == "1999-S1", -100).otherwise(0)).cast("double"))
            .withColumn("max_sqm", F.col("min_sqm") * 1.25)
            .withColumn("source_label", F.concat(F.lit("Listino "), F.col("zone")))
            .withColumn("id", F.concat_ws("-", *keys, "period")))


def contact_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks, views and purchases as calls the team made."""
    kind, e = F.col("event_type"), F.col("event_id")
    outcome = (F.when(kind == "click", "reached").when(kind == "view", "no_answer")
               .when(e % 5 == 0, "not_relevant").otherwise("documents_requested"))
    return (table(spark, folder, "events").where(kind.isin("click", "view", "purchase"))
            .select(e.alias("action_id"), F.concat(F.lit("L"), F.col("user_id") * 7 + e % 7).alias("property_id"),
                    outcome.alias("outcome"),
                    F.when(e % 3 == 0, "confirmed_by_team").when(e % 3 == 1, "declared").otherwise("not_checked").alias("mandate_status"),
                    F.when(F.col("event_type").isin("click", "view") & (e % 4 != 0),
                           F.date_format(F.lit("2001-07-20").cast("date") + (e % 28).cast("int"), "yyyy-MM-dd")).alias("next_contact"),
                    F.concat(F.lit("U"), e % 4).alias("user_id"), F.col("ts").alias("created_at")))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per customer group, with a refresh interval and a state."""
    n = F.col("o_custkey") % 7
    return (table(spark, folder, "orders").select(n.alias("n")).distinct()
            .select(F.concat(F.lit("S"), F.col("n")).alias("source_id"), F.concat(F.lit("Fonte "), F.col("n")).alias("source_name"),
                    F.when(F.col("n") == 6, "s5.example").otherwise(F.concat(F.lit("s"), F.col("n"), F.lit(".example"))).alias("domain"),
                    (F.col("n") != 3).alias("enabled"),
                    F.when(F.col("n") == 2, "blocked").otherwise("healthy").alias("status"),
                    F.when(F.col("n") == 4, 900).otherwise(24 + 12 * F.col("n")).cast("int").alias("refresh_hours"),
                    F.when(F.col("n") == 0, "import").otherwise("html").alias("kind")))


def deal_work(spark: SparkSession, folder: str) -> DataFrame:
    """Work rows for the orders that are not yet filled."""
    k = F.col("o_orderkey")
    return (table(spark, folder, "orders").where("o_orderstatus <> 'F'")
            .select(F.concat(F.lit("L"), k).alias("property_id"),
                    F.when(k % 5 != 0, F.concat(F.lit("U"), k % 4)).alias("owner_id"),
                    F.when(k % 4 != 0, F.date_format(F.lit("2001-07-20").cast("date") + (k % 40).cast("int"), "yyyy-MM-dd")).alias("due_date"),
                    (k % 3).alias("version")))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Team members named by the work rows."""
    return (deal_work(spark, folder).where("owner_id is not null").select("owner_id").distinct()
            .select(F.col("owner_id").alias("user_id"), F.concat(F.lit("Persona "), F.col("owner_id")).alias("user_name")))


def saved_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Two searches per region: one wide, one narrow with every kind of rule."""
    r = table(spark, folder, "region").select("r_name", "r_regionkey")
    wide = F.explode(F.array(F.lit(True), F.lit(False))).alias("wide")
    base = r.select("r_name", "r_regionkey", wide)
    w = F.col("wide")
    return base.select(
        F.concat(F.lit("A"), F.col("r_regionkey") * 2 + F.when(w, 0).otherwise(1)).alias("agent_id"),
        F.concat(F.when(w, "Ampia ").otherwise("Mirata "), F.col("r_name")).alias("agent_name"),
        F.col("r_name").alias("agent_city"), (F.col("r_regionkey") != 4).alias("active"),
        F.when(w, 0.0).otherwise(100000.0).alias("min_price"), F.when(w, 400000.0).otherwise(300000.0).alias("max_price"),
        F.when(w, 0.0).otherwise(60.0).alias("min_surface"), F.when(~w, 300.0).alias("max_surface"),
        F.when(~w, F.array(F.lit("residential"), F.lit("office"))).alias("property_types"),
        F.when(~w & (F.col("r_regionkey") % 2 == 0), F.array(F.lit("value_add"), F.lit("core_plus"))).alias("strategies"),
        (~w & (F.col("r_regionkey") == 1)).alias("opportunity_only"),
        F.when(~w & (F.col("r_regionkey") == 3), "require_direct").otherwise("any").alias("contact_policy"),
        F.when(~w & (F.col("r_regionkey") == 2), 5.0).alias("min_discount"), w.alias("include_auctions"),
        F.when(~w, F.concat(F.lit("via "), F.col("r_regionkey") + 1)).otherwise("").alias("location_query"),
        F.lit("").alias("custom_prompt"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per event hour bucket and agent."""
    e = table(spark, folder, "events")
    return (e.groupBy(F.date_trunc("hour", "ts").alias("started_at"))
            .agg(F.min("ts").alias("created_at"), F.max("ts").alias("finished_at"), F.min("event_id").alias("n"))
            .select(F.concat(F.lit("R"), F.date_format("started_at", "yyyyMMddHH")).alias("run_id"), "created_at", "finished_at",
                    F.concat(F.lit("A"), F.col("n") % 10).alias("agent_id")))


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as steps of the run of their hour."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.concat(F.lit("R"), F.date_format("ts", "yyyyMMddHH")).alias("run_id"), F.col("event_id"), F.col("ts"),
        F.concat(F.lit("S"), F.col("user_id") % 7).alias("source_id"), F.concat(F.lit("L"), F.col("user_id")).alias("property_id"),
        F.when(kind == "error", "source").when(kind == "view", "discovery").otherwise("acquire").alias("step"),
        F.when((kind == "error") & (F.col("event_id") % 4 == 0), "error").otherwise("info").alias("level"),
        (kind == "signup").alias("is_new"), (kind == "purchase").alias("is_changed"),
        F.get_json_object("props", "$.k").cast("bigint").alias("items"))


def listing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents with a closing phrase, as listing descriptions."""
    d = F.col("doc_id")
    return table(spark, folder, "documents").select(
        d.alias("doc_id"), F.concat(F.lit("L"), d).alias("id"), F.concat(F.lit("Annuncio "), d).alias("title"),
        F.concat(F.col("text"), F.lit(". "), phrase(d)).alias("description"))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Team decisions on duplicate candidates: a third confirmed, a third rejected, the rest open."""
    from ..operators.clusters import duplicate_candidates
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    turn = (number(F.col("a")) + number(F.col("b"))) % 3
    decided = (duplicate_candidates(listings(spark, folder)).select("a", "b", F.when(turn == 0, "same_asset").when(turn == 1, "distinct").alias("decision"))
               .where("decision is not null"))
    return cut_lineage(decided)  # assets and their contradictions both read it


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """One square zone per nation with a hole, on a grid over the area of the listings."""
    n = F.col("n_nationkey")
    west, south = 6 + (n % 5) * 2.66, 36 + F.floor(n / 5) * 2.4

    def box(w, s, width, height):
        point = lambda x, y: F.array(x, y)
        return F.array(point(w, s), point(w + width, s), point(w + width, s + height), point(w, s + height))

    return table(spark, folder, "nation").select(
        F.concat(F.lit("B"), n).alias("zone_code"), F.col("n_name").alias("name"),
        F.array(F.array(box(west, south, F.lit(2.0), F.lit(1.9)), box(west + 0.5, south + 0.5, F.lit(0.4), F.lit(0.4)))).alias("polygons"))


def zone_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Official rows per zone and use, in two conditions and an old or a current period."""
    n = F.col("n_nationkey")
    usage = F.explode(F.array(*[F.lit(u) for u in "RCTP"])).alias("usage")
    rows = table(spark, folder, "nation").select("n_nationkey", usage).select(
        "n_nationkey", "usage", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    p = F.col("position")
    kinds = F.create_map(*[F.lit(x) for x in ("R", "Abitazioni civili", "C", "Negozi", "T", "Uffici", "P", "Capannoni")])
    low = (900 + 40 * n + 100 * p).cast("double")
    return rows.select(F.concat(F.lit("B"), n).alias("zone_code"), "usage",
                       F.when((F.col("usage") == "R") & (p == 1), "Box").otherwise(kinds[F.col("usage")]).alias("type"),
                       F.when(p == 0, "Normale").otherwise("Ottimo").alias("condition"), low.alias("min_sqm"), (low * 1.5).alias("max_sqm"),
                       F.when(p == 0, "gross").otherwise("net").alias("area_basis"),
                       F.when(n % 6 == 5, "1999-S1").otherwise("2001-S1").alias("period"), p.alias("position"))
