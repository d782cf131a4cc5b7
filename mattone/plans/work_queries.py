"""Queries on text evidence, contacts, searches, daily work, places, ingest and runs."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import rules, sinks
from ..functions import text as T
from ..functions import values as V
from ..operators import brokers, catalog, evidence, geo, history, market, merge, quality, queue, scenario, scoring, screening, signals
from ..session import cut_lineage, over_tasks, shared_folder
from ..sources import cards, files, mail, pages, places
from ..streaming import streams
from .adapter import AS_OF, EVENTS_AS_OF
from .context import Archive
from .oracle_parts import CLOSED, MANDATE_SENTENCE, FACTS, INACTIVE, NOW, TEXT, USABLE, cut, hit, known, quote, rnd, route_kind, strategy_quote, ts
from .registry import query

_TODAY = "'2001-08-02'"

# --- Text evidence, over whole documents ------------------------------------------------------------


@query("classify_strategies", ["texts"], " UNION ALL ".join(
    f"SELECT id, '{s}' AS strategy, {strategy_quote(TEXT, s)} AS evidence FROM texts WHERE {strategy_quote(TEXT, s)} IS NOT NULL" for s in rules.STRATEGIES))
def _(a: Archive):
    return evidence.classify_texts(a.listing_texts)


def _whole(pattern: str, text: str = FACTS) -> str:
    return f"nullif(trim(regexp_extract({text}, {quote('(?i)' + pattern)})), '')"


_CADASTRAL = f"nullif(regexp_replace(trim(regexp_extract({FACTS}, {quote('(?i)' + rules.CADASTRAL)})), '^.*\\b([A-F])\\s*/?\\s*([0-9]{{1,2}})$', 'Categoria catastale \\1/\\2', 's'), '')"


@query("text_facts", ["texts"], f"""SELECT id, {_CADASTRAL} AS cadastral, {_whole('[^.!?' + chr(10) + ']{0,90}(?:' + rules.CHANGE_OF_USE + ')[^.!?' + chr(10) + ']{0,170}')} AS change_of_use,
  {_whole(MANDATE_SENTENCE)} AS mandate FROM texts""")
def _(a: Archive):
    return signals.text_facts(a.listing_texts)


@query("contact_route", ["texts"], f"SELECT id, {route_kind(FACTS)} AS kind FROM texts")
def _(a: Archive):
    return signals.contact_routes(a.listing_texts).select("id", "kind")


_STATUS = "trim(regexp_replace(lower(concat(text, '. ', phrase)), '\\s+', ' ', 'g'))"


@query("explicit_status", ["texts"], f"""SELECT id, CASE WHEN p > 0 AND NOT regexp_matches({cut('t', 'p - 30', 'p')}, {quote(rules.STATUS_NEGATION)}) THEN
  CASE WHEN w LIKE 'vendut%' OR w = 'sold' THEN 'sold' WHEN w LIKE 'affitt%' THEN 'rented' ELSE 'withdrawn' END END AS status
FROM (SELECT id, t, regexp_extract(t, {quote(rules.STATUS_PATTERN)}) AS w, {hit('t', rules.STATUS_PATTERN)} AS p
      FROM (SELECT id, trim(regexp_replace(lower(description), '\\s+', ' ', 'g')) AS t FROM texts))""")
def _(a: Archive):
    return a.listing_texts.select("id", T.explicit_status(F.col("description")).alias("status"))


@query("quote_check", [], """SELECT d.doc_id * 3 + n AS claim_id, d.doc_id, CASE n WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS supported
FROM (SELECT *, unnest([0, 1, 2]) AS n FROM documents) d""")
def _(a: Archive):
    docs = a.table("documents").select("doc_id", "text")
    quotes = F.array(F.col("text"), F.regexp_replace("text", " ", "  "), F.concat(F.lit("« senza riscontro »"), "text"))
    claims = docs.select("doc_id", F.posexplode(quotes).alias("n", "quote")).withColumn("claim_id", F.col("doc_id") * 3 + F.col("n"))
    return evidence.quote_check(claims, docs).select("claim_id", "doc_id", "supported")


_CLAIM_TEXT = "concat(text, '. Superficie commerciale: ', 60 + doc_id % 900, ' mq. Prezzo € ', 1000 + doc_id % 7, '.500')"


def _claim_texts(a: Archive):
    d = F.col("doc_id")
    return a.table("documents").select("doc_id", F.concat("text", F.lit(". Superficie commerciale: "), 60 + d % 900, F.lit(" mq. Prezzo € "), 1000 + d % 7, F.lit(".500")).alias("text"))


@query("number_supported", [], f"""SELECT doc_id * 2 AS claim_id, doc_id, CAST(60 + doc_id % 900 AS DOUBLE) AS value, true AS printed, 'commercial' AS bases FROM documents
UNION ALL SELECT doc_id * 2 + 1, doc_id, CAST(1000500 + (doc_id % 7) * 1000 AS DOUBLE), true, '' FROM documents""")
def _(a: Archive):
    d = F.col("doc_id")
    values = F.array((60 + d % 900).cast("double"), (1000500 + (d % 7) * 1000).cast("double"))
    claims = a.table("documents").select("doc_id", F.posexplode(values).alias("n", "value")).withColumn("claim_id", d * 2 + F.col("n")).drop("n")
    return evidence.supported_numbers(claims, _claim_texts(a))


@query("condition_supported", [], """SELECT doc_id * 5 + n AS claim_id, condition, supported FROM documents, (VALUES (0, 'renovated', true), (1, 'renovated', false), (2, 'good', true), (3, 'new', false), (4, 'to_renovate', true)) v(n, condition, supported)""")
def _(a: Archive):
    cases = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(q).alias("quote")) for c, q in (
        ("renovated", "appartamento completamente ristrutturato"), ("renovated", "cucina ristrutturata"), ("good", "Condizioni dell’immobile: buono"),
        ("new", "palazzo di nuova costruzione"), ("to_renovate", "immobile da ristrutturare"))])
    docs = a.table("documents").select("doc_id", "text")
    claims = docs.select("doc_id", F.posexplode(cases).alias("n", "c")).select("doc_id", (F.col("doc_id") * 5 + F.col("n")).alias("claim_id"), "c.*")
    # The palace case states the building and the unit word "costruzione"; the quote names the building only.
    claims = claims.withColumn("quote", F.when(F.col("quote").startswith("palazzo"), "facciata mai abitata").otherwise(F.col("quote")))
    return evidence.supported_conditions(claims, docs).select("claim_id", "condition", "supported")


@query("date_and_price_labels", [], """SELECT doc_id, true AS dated, false AS updated_only, 'Prezzo ribassato' AS label FROM documents""")
def _(a: Archive):
    d = a.table("documents")
    day = F.format_string("2024-%02d-%02d", (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 28 + 1).cast("int"))
    shown = F.concat(F.split(day, "-")[2], F.lit("/"), F.split(day, "-")[1], F.lit("/2024"))
    price = (987654000 + F.col("doc_id")).cast("double")
    text = F.concat(F.lit("Annuncio pubblicato il "), shown, F.lit(". Prezzo ribassato € "), price.cast("bigint").cast("string"), F.lit(". "), F.col("text"))
    update = F.concat(F.lit("Aggiornato il "), shown, F.lit(". "), F.col("text"))
    return d.select("doc_id", T.date_written(day, text).alias("dated"), T.date_written(day, update).alias("updated_only"), T.price_update_label(price, text).alias("label"))


@query("contact_claims", [], """SELECT doc_id, true AS printed, false AS part_of_longer, concat('info', doc_id, '@agenzia.example') AS email FROM documents""")
def _(a: Archive):
    d = F.col("doc_id")
    number = F.format_string("%07d", d)
    text = F.concat(F.col("text"), F.lit(". Tel. 02 1"), number, F.lit(". Scrivi a info"), d, F.lit("@agenzia.example"))
    slip = F.concat(F.lit("inf"), d, F.lit("@agenzia.example"))
    return a.table("documents").select("doc_id", T.phone_printed(F.concat(F.lit("021"), number), text).alias("printed"),
                                       T.phone_printed(F.concat(F.lit("1"), number), text).alias("part_of_longer"), T.email_one_edit(slip, text).alias("email"))


@query("city_and_zone", ["listings"], """SELECT id, CASE WHEN k % 3 = 0 THEN 'Milano' WHEN k % 3 = 1 THEN NULL ELSE 'Bollate' END AS city,
  CASE WHEN k % 3 = 0 THEN 'Monza' WHEN k % 3 = 1 THEN NULL ELSE NULL END AS zone FROM listings""")
def _(a: Archive):
    k = F.col("k")
    city = F.when(k % 3 == 0, "Monza").otherwise("Bollate")
    text = F.when(k % 3 == 0, F.concat(F.lit("Viale Monza, "), k, F.lit(" Monza, Milano, MI"))).when(k % 3 == 1, "Via Roma 1, Bollate, Milano, MI").otherwise("Bollate, via Roma")
    return a.listings.select("id", T.city_and_zone(city, text).alias("r")).select("id", "r.city", "r.zone")


@query("open_points", ["listings"], f"""SELECT id, concat_ws('; ', CASE WHEN price IS NULL THEN 'prezzo' END, CASE WHEN surface IS NULL THEN 'superficie' END,
  CASE WHEN surface IS NOT NULL AND area_basis = 'unknown' THEN 'base della superficie' END, CASE WHEN condition = 'unknown' THEN 'stato' END,
  CASE WHEN telephone IS NULL AND email IS NULL THEN 'recapito' END, CASE WHEN NOT coalesce(contains(description, 'catastale'), false) THEN 'catasto' END) AS points FROM listings""")
def _(a: Archive):
    facts = a.listings.join(signals.text_facts(a.listings), "id")
    return facts.select("id", T.open_points(F.lit("Verificare la categoria catastale")).alias("points"))


# --- Contacts and advertisers ------------------------------------------------------------------------

@query("contact_flags", ["listings"], "SELECT id, contact_name AS contact, telephone IS NOT NULL AS has_phone, email IS NOT NULL AS has_email FROM listings")
def _(a: Archive):
    return signals.contact_flags(a.listings)


@query("norm_contacts", ["listings"], "SELECT id, coalesce(substring(telephone, 4), '') AS phone, coalesce(email, '') AS mail FROM listings")
def _(a: Archive):
    return a.listings.select("id", V.norm_phone("telephone").alias("phone"), V.norm_email("email").alias("mail"))


_KEYED = f"""keyed AS (SELECT *, list_filter([CASE WHEN telephone IS NOT NULL THEN concat('tel:', substring(telephone, 4)) END, CASE WHEN email IS NOT NULL THEN concat('mail:', email) END], lambda x: x IS NOT NULL) AS direct
  FROM listings WHERE availability NOT IN ({CLOSED}))"""
_KEYS_CASE = "CASE WHEN len(direct) > 0 THEN direct WHEN contact_name IS NOT NULL THEN [concat('name:', lower(contact_name))] ELSE [] END"
_ADVERTISERS = f"""
  SELECT node AS key, min(other) AS advertiser FROM (
    WITH RECURSIVE k AS (SELECT DISTINCT {_KEYS_CASE} AS keys FROM (SELECT *, list_filter([CASE WHEN telephone IS NOT NULL THEN concat('tel:', substring(telephone, 4)) END, CASE WHEN email IS NOT NULL THEN concat('mail:', email) END], lambda x: x IS NOT NULL) AS direct
        FROM listings WHERE availability NOT IN ({CLOSED}))),
      e AS (SELECT keys[1] AS u, keys[len(keys)] AS v FROM k WHERE len(keys) > 0 UNION SELECT keys[len(keys)], keys[1] FROM k WHERE len(keys) > 0),
      r(node, other) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.other = e.u)
    SELECT * FROM r) GROUP BY node"""


@query("advertiser_components", ["listings"], _ADVERTISERS)
def _(a: Archive):
    return brokers.advertiser_components(a.listings)


_AD_ROWS = f"""(SELECT l.*, c.advertiser, substring(telephone, 4) AS phone FROM (SELECT *, ({_KEYS_CASE})[1] AS key FROM (SELECT *, list_filter([CASE WHEN telephone IS NOT NULL THEN concat('tel:', substring(telephone, 4)) END,
  CASE WHEN email IS NOT NULL THEN concat('mail:', email) END], lambda x: x IS NOT NULL) AS direct FROM listings WHERE availability NOT IN ({CLOSED}))) l JOIN ({_ADVERTISERS}) c ON l.key = c.key)"""


def _top(column: str) -> str:
    return f"(SELECT advertiser, {column} AS v FROM {_AD_ROWS} WHERE {column} IS NOT NULL GROUP BY advertiser, {column} QUALIFY row_number() OVER (PARTITION BY advertiser ORDER BY count(*) DESC, {column}) = 1)"


# Some listings name an organization; where neither phone nor e-mail is given, it alone says who advertises.
_ORG = "CASE WHEN k % 24 = 0 OR k % 15 = 4 THEN concat('Studio ', k % 30) END"


def _with_organization(a: Archive):
    return a.listings.withColumn("organization", F.expr(_ORG))


_ORG_KEYED = f"""(SELECT *, CASE WHEN len(direct_keys) > 0 THEN direct_keys WHEN coalesce(organization, contact_name) IS NOT NULL THEN [concat('name:', lower(coalesce(organization, contact_name)))] ELSE [] END AS keys FROM (
  SELECT *, {_ORG} AS organization, list_filter([CASE WHEN telephone IS NOT NULL THEN concat('tel:', substring(telephone, 4)) END, CASE WHEN email IS NOT NULL THEN concat('mail:', email) END], lambda x: x IS NOT NULL) AS direct_keys
  FROM listings WHERE availability NOT IN ({CLOSED})))"""
_ORG_ROWS = f"""SELECT l.*, c.advertiser, s.source_name, {route_kind(FACTS)} <> 'unknown' AS is_direct, CASE WHEN currency = 'EUR' AND price <> 0 THEN price END AS euro FROM {_ORG_KEYED} l JOIN (
  SELECT node AS key, min(other) AS advertiser FROM (WITH RECURSIVE e AS (SELECT DISTINCT keys[1] AS u, keys[len(keys)] AS v FROM {_ORG_KEYED} WHERE len(keys) > 0 UNION SELECT keys[len(keys)], keys[1] FROM {_ORG_KEYED} WHERE len(keys) > 0),
    r(node, other) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.other = e.u) SELECT * FROM r) GROUP BY node) c ON l.keys[1] = c.key LEFT JOIN sources s ON l.source_id = s.source_id"""


def _directory_sql(where: str = "true", shown: str = "true") -> str:
    listed = lambda c: f"(SELECT advertiser, list({c} ORDER BY n DESC, {c}) AS v FROM (SELECT advertiser, {c}, count(*) AS n FROM rows WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY advertiser)"
    return f"""SELECT advertiser, name, organization, phone, email, other_names, cities, zones, sources, count, direct, value_eur, max_price_eur, last_seen FROM (
  WITH rows AS (SELECT * FROM ({_ORG_ROWS}) WHERE {where})
  SELECT t.*, n.v[1] AS name, o.v[1] AS organization, p.v[1] AS phone, m.v[1] AS email, coalesce(array_to_string(n.v[2:4], '; '), '') AS other_names, array_to_string(c.v, '; ') AS cities, array_to_string(z.v[1:6], '; ') AS zones,
    array_to_string(s.v, '; ') AS sources FROM (SELECT advertiser, count(*) AS count, count(*) FILTER (is_direct) AS direct, {rnd('sum(CAST(euro AS DECIMAL(18,2)))', 0)} AS value_eur, max(euro) AS max_price_eur, {ts('max(last_seen)')} AS last_seen
    FROM rows GROUP BY advertiser) t LEFT JOIN {listed('contact_name')} n USING (advertiser) LEFT JOIN {listed('organization')} o USING (advertiser) LEFT JOIN {listed('telephone')} p USING (advertiser)
    LEFT JOIN {listed('email')} m USING (advertiser) LEFT JOIN {listed('city')} c USING (advertiser) LEFT JOIN {listed('zone')} z USING (advertiser) LEFT JOIN {listed('source_name')} s USING (advertiser)) WHERE {shown}"""


@query("broker_directory", ["listings", "sources"], _directory_sql())
def _(a: Archive):
    rows = _with_organization(a)
    return brokers.broker_directory(rows, brokers.advertiser_components(rows), a.sources)


@query("broker_search", ["listings", "sources"], _directory_sql("lower(city) = 'asia' AND currency = 'EUR' AND price >= 50000 AND price <= 300000",
       "direct > 0 AND contains(lower(concat_ws(' ', name, organization, phone, email, other_names, cities, zones)), 'studio 1')"))
def _(a: Archive):
    rows = _with_organization(a)
    return brokers.broker_directory(rows, brokers.advertiser_components(rows), a.sources, city=" Asia", min_price=50_000, max_price=300_000, direct_only=True, q="Studio 1")


@query("broker_page", ["listings", "sources"], f"""SELECT advertiser, direct, count, value_eur, total, total > 10 AS limited FROM (SELECT *, count(*) OVER () AS total FROM ({_directory_sql()})) ORDER BY direct DESC, count DESC, coalesce(value_eur, 0) DESC, advertiser LIMIT 10""")
def _(a: Archive):
    rows = _with_organization(a)
    return brokers.broker_page(brokers.broker_directory(rows, brokers.advertiser_components(rows), a.sources), 10).select("advertiser", "direct", "count", "value_eur", "total", "limited")


@query("broker_listings", ["listings"], f"""SELECT advertiser, position, id, price FROM (SELECT *, row_number() OVER (PARTITION BY advertiser ORDER BY coalesce(price, 0) DESC, id) AS position FROM {_AD_ROWS}) WHERE position <= 20""")
def _(a: Archive):
    return brokers.broker_listings(a.listings, brokers.advertiser_components(a.listings)).select("advertiser", "position", "id", "price")


@query("broker_top_values", ["listings"], f"""SELECT advertiser, zone AS value, n, row_number() OVER (PARTITION BY advertiser ORDER BY n DESC, zone) AS rank FROM (SELECT advertiser, zone, count(*) AS n FROM {_AD_ROWS} GROUP BY ALL)""")
def _(a: Archive):
    rows = brokers._advertised(a.listings, brokers.advertiser_components(a.listings))
    return brokers.broker_top_values(rows, "advertiser", "zone")


@query("unattributed", ["listings"], f"SELECT count(*) FILTER (telephone IS NULL AND email IS NULL AND contact_name IS NULL) AS unattributed, count(*) AS examined FROM listings WHERE availability NOT IN ({CLOSED})")
def _(a: Archive):
    return brokers.unattributed(a.listings)


# --- Saved searches -------------------------------------------------------------------------------------

@query("agent_city_link", ["listings", "searches"], "SELECT id, agent_id FROM listings JOIN searches ON lower(city) = lower(agent_city) WHERE active")
def _(a: Archive):
    return a.links


@query("screen", ["screened"], "SELECT agent_id, id, fit, reasons, score FROM screened")
def _(a: Archive):
    return a.memberships


def _hashed(a: Archive):
    return a.scored.withColumn("content_hash", F.md5("id"))


def _checks(a: Archive):
    """Results of three criteria for most listings, a fourth of them for an older version of the listing."""
    k, j = F.substring("id", 2, 20).cast("bigint"), F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j")
    way = (k + F.col("j")) % 4
    return a.listings.select("id", j).select("id", T.prompt_key(F.concat(F.lit("Criterio  "), F.col("j"), F.lit("\n\n"))).alias("prompt_key"), F.when(way == 3, "old").otherwise(F.md5("id")).alias("content_hash"),
                                             F.when(way == 1, "not_matched").when(way == 2, "to_verify").otherwise("matched").alias("status"), F.concat(F.lit("motivo "), F.col("j")).alias("reason"))


@query("screen_criteria", ["screened"], """SELECT agent_id, id, said = '' AND fit AS fit, concat_ws('; ', nullif(said, ''), nullif(reasons, '')) AS reasons FROM (SELECT *, CASE WHEN n % 2 = 0 THEN '' WHEN w = 3 THEN 'Criteri personalizzati: verifica AI da eseguire'
  WHEN w = 1 THEN concat('Criteri personalizzati non soddisfatti: motivo ', n % 3) WHEN w = 2 THEN concat('Criteri personalizzati da verificare: motivo ', n % 3) ELSE '' END AS said
  FROM (SELECT *, CAST(substring(agent_id, 2) AS BIGINT) AS n, (CAST(substring(id, 2) AS BIGINT) + CAST(substring(agent_id, 2) AS BIGINT) % 3) % 4 AS w FROM screened))""")
def _(a: Archive):
    """Every second search with criteria of its own, checked for some listings."""
    n = F.substring("agent_id", 2, 9).cast("bigint")
    searches = a.saved_searches.withColumn("custom_prompt", F.when(n % 2 == 1, F.concat(F.lit("Criterio "), n % 3)).otherwise(""))
    return screening.screen(_hashed(a), searches, a.links, _checks(a)).select("agent_id", "id", "fit", "reasons")


def _many_searches(a: Archive):
    """A saved search of every customer in the region."""
    c, n, r = a.table("customer"), a.table("nation"), a.table("region")
    k = F.col("c_custkey")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    low, small = (20_000 + (k * 977 % 200) * 1000).cast("double"), (40 + k % 100).cast("double")
    return rows.select(F.concat(F.lit("C"), k).alias("agent_id"), F.lit("").alias("agent_name"), F.initcap("r_name").alias("agent_city"), (k % 10 != 9).alias("active"), low.alias("min_price"), (low * (1 + k % 5)).alias("max_price"),
                       small.alias("min_surface"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, small + k % 150).alias("max_surface"), F.when(k % 2 == 0, F.array(F.lit("residential"), F.lit("office"))).alias("property_types"),
                       F.lit(None).cast("array<string>").alias("strategies"), F.lit(False).alias("opportunity_only"), F.lit("any").alias("contact_policy"), F.when(k % 11 == 0, 5.0).alias("min_discount"), (k % 4 == 0).alias("include_auctions"),
                       F.when(k % 13 == 0, "via 3").otherwise("").alias("location_query"), F.when(k % 7 == 0, F.concat(F.lit("Criterio "), k % 3)).otherwise("").alias("custom_prompt"))


@query("matching_searches", ["scored"], f"""SELECT concat('C', c_custkey) AS agent_id, id, score FROM scored s JOIN (SELECT *, 20000.0 + (c_custkey * 977 % 200) * 1000 AS low, 40.0 + c_custkey % 100 AS small FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 10 <> 9) c ON lower(s.city) = lower(c.r_name)
  WHERE availability NOT IN ({INACTIVE}) AND transaction_type = 'sale' AND currency = 'EUR' AND price >= low AND price <= low * (1 + c_custkey % 5) AND surface >= small AND (c_custkey % 3 <> 1 OR surface <= small + c_custkey % 150)
    AND (c_custkey % 2 = 1 OR property_type IN ('residential', 'office')) AND (c_custkey % 4 = 0 OR NOT is_auction) AND (c_custkey % 11 <> 0 OR coalesce(discount, -1e9) >= 5) AND (c_custkey % 13 <> 0 OR coalesce(lower(address), '') = 'via 3')
    AND (c_custkey % 7 <> 0 OR (CAST(substring(id, 2) AS BIGINT) + c_custkey % 3) % 4 = 0)""")
def _(a: Archive):
    """A search of every customer against all listings, through the predicate index."""
    return screening.matching(_hashed(a), _many_searches(a), _checks(a))


@query("rescreen_agent", ["screened"], "SELECT agent_id, id, fit, reasons, score FROM screened WHERE agent_id = 'A5'")
def _(a: Archive):
    return screening.rescreen_agent(a.scored, a.saved_searches, a.links, "A5")


@query("attach_memberships", ["listings", "screened"], """SELECT l.id, s.matches FROM listings l LEFT JOIN (SELECT id, string_agg(concat(agent_id, ':', agent_name, ':', fit), '; ' ORDER BY agent_id) AS matches FROM screened GROUP BY id) s ON l.id = s.id""")
def _(a: Archive):
    out = catalog.attach_memberships(a.listings, a.memberships, a.saved_searches)
    return out.select("id", F.transform("search_matches", lambda m: F.concat_ws(":", m["agent_id"], m["agent_name"], m["fit"].cast("string"))).alias("matches"))


@query("agent_totals", ["screened", "searches", "runs"], """SELECT s.agent_id, s.agent_name, coalesce(total, 0) AS total, coalesce(qualified, 0) AS qualified, last_run FROM searches s
LEFT JOIN (SELECT agent_id, count(*) AS total, count(*) FILTER (fit) AS qualified FROM screened GROUP BY 1) m ON s.agent_id = m.agent_id
LEFT JOIN (SELECT agent_id, run_id AS last_run FROM runs QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, run_id DESC) = 1) r ON s.agent_id = r.agent_id""")
def _(a: Archive):
    return quality.agent_totals(a.saved_searches, a.memberships, a.runs)


@query("eligible_for_analysis", ["listings", "searches"], f"""SELECT concat('R', k % 50) AS run_id, agent_id, id, k % 4 <> 1 AS needs_custom FROM listings JOIN searches ON agent_id = concat('A', k % 10)
WHERE availability NOT IN ({INACTIVE}) AND lower(city) = lower(agent_city) AND transaction_type = 'sale' AND currency = 'EUR' AND price BETWEEN min_price AND max_price AND surface >= min_surface
  AND (max_surface IS NULL OR surface <= max_surface) AND (NOT typed OR property_type IN ('residential', 'office')) AND (include_auctions OR NOT is_auction) AND (k % 4 <> 1 OR k % 3 = 0 OR k % 5 <> 0)""")
def _(a: Archive):
    k = F.col("k")
    rows = a.listings.select("*", F.concat(F.lit("R"), k % 50).alias("run_id"), F.concat(F.lit("A"), k % 10).alias("agent_id"), (k % 3 == 0).alias("changed"),
                             F.when(k % 5 == 0, "llm").otherwise("rules").alias("engine"), F.sha2("title", 256).alias("content_hash"))
    prompt = F.lit("Solo piani alti\n  con   terrazzo ")
    done = rows.where(k % 4 == 1).select(F.col("id").alias("property_id"), "content_hash", T.prompt_key(F.lit("Solo piani alti\ncon terrazzo")).alias("prompt_key"))
    return scoring.eligible_for_analysis(rows, a.saved_searches.withColumn("custom_prompt", prompt), done, "llm").drop("content_hash")


@query("semantic_result_accept", ["listings"], """SELECT id AS property_id, CASE WHEN condition = 'unknown' THEN 'no_task' WHEN k % 7 = 0 THEN 'content_changed' ELSE 'accepted' END AS status FROM listings""")
def _(a: Archive):
    k = F.col("k")
    results = a.listings.select(F.lit("R1").alias("run_id"), F.col("id").alias("property_id"))
    tasks = a.listings.where("condition <> 'unknown'").select(F.lit("R1").alias("run_id"), F.col("id").alias("property_id"), F.concat(F.lit("h"), k).alias("content_hash"))
    current = a.listings.select("id", F.when(k % 7 == 0, "changed").otherwise(F.concat(F.lit("h"), k)).alias("content_hash"))
    return scoring.semantic_result_accept(results, tasks, current).select("property_id", "status")


@query("merge_checks", ["listings"], """SELECT concat('P', k % 997) AS property_id, count(*) AS checks, CASE WHEN bool_or(k % 11 = 0) THEN 'not_matched' WHEN bool_or(k % 5 = 0) THEN 'uncertain' ELSE 'matched' END AS status FROM listings GROUP BY 1""")
def _(a: Archive):
    k = F.col("k")
    checks = a.listings.select(F.concat(F.lit("P"), k % 997).alias("property_id"), F.when(k % 11 == 0, "not_matched").when(k % 5 == 0, "uncertain").otherwise("matched").alias("status"))
    return scoring.merge_checks(checks)


# --- Daily work -------------------------------------------------------------------------------------------

@query("latest_contact", ["last_action"], f"SELECT property_id, action_id, outcome, mandate_status, next_contact, user_id, {ts('created_at')} AS created_at FROM last_action")
def _(a: Archive):
    return a.last_calls


@query("contact_history", ["actions", "team"], """SELECT property_id, action_id, outcome, user_name AS author,
  row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC, action_id DESC) AS position FROM actions a JOIN team t ON a.user_id = t.user_id""")
def _(a: Archive):
    return queue.contact_history(a.contact_actions, a.users).select("property_id", "action_id", "outcome", "author", "position")


@query("related_contact", ["clusters", "actions"], """SELECT c.id, c.root, l.called_id, l.action_id, l.outcome FROM clusters c JOIN (
  SELECT root, a.property_id AS called_id, action_id, outcome FROM actions a JOIN clusters k ON a.property_id = k.id QUALIFY row_number() OVER (PARTITION BY root ORDER BY created_at DESC, action_id DESC) = 1) l ON c.root = l.root""")
def _(a: Archive):
    return queue.related_contact(a.contact_actions, a.clusters).select("id", "root", "called_id", "action_id", "outcome")


_FRESH = f"""SELECT id, CASE WHEN last_detail_at IS NOT NULL AND last_detail_at > {NOW} - to_hours(h) THEN 'recent' ELSE 'stale' END AS status, last_detail_at, h, kind
  FROM (SELECT l.id, l.last_detail_at, s.kind, CASE WHEN refresh_hours BETWEEN 1 AND 720 THEN refresh_hours ELSE 24 END AS h FROM listings l LEFT JOIN sources s ON l.source_id = s.source_id)"""


@query("freshness", ["listings", "sources"], f"""SELECT id, status, {ts('last_detail_at')} AS checked_at, {ts('last_detail_at + to_hours(h)')} AS due_at, h AS hours,
  CASE WHEN kind = 'import' THEN 'Importazione' ELSE 'Pagina acquisita' END AS method FROM ({_FRESH})""")
def _(a: Archive):
    return a.freshness


@query("days_listed", ["listings"], f"""SELECT id, CAST(floor(epoch({NOW} - since) / 86400) AS BIGINT) AS days_listed, strftime(since, '%Y-%m-%d') AS listed_since, basis AS listed_basis
FROM (SELECT id, CASE WHEN published_at <= '2001-08-02' THEN CAST(published_at AS TIMESTAMP) ELSE first_seen END AS since, CASE WHEN published_at <= '2001-08-02' THEN 'published' ELSE 'first_seen' END AS basis FROM listings)""")
def _(a: Archive):
    return signals.days_listed(a.listings, AS_OF)


_ALLOWED = f"(outcome IS NULL OR (outcome <> 'not_relevant' AND (outcome NOT IN ('reached', 'documents_requested') OR next_contact IS NOT NULL) AND (next_contact IS NULL OR next_contact <= {_TODAY})))"


@query("today_queue", ["scored", "screened", "clusters", "conflicts", "last_action", "actions", "sources"], f"""
SELECT *, row_number() OVER (ORDER BY list, next_contact NULLS LAST, route = 'unknown', priority_score DESC, id) AS position FROM (SELECT id, root, CASE WHEN callable THEN 'call' ELSE 'verify' END AS list, priority_score, {ts('last_seen')} AS last_seen, matching AS matching_searches, outcome, next_contact, route, freshness,
  coalesce(members, 1) AS linked_count, concat_ws('; ', nullif(conflicts, ''), CASE WHEN freshness = 'stale' THEN 'Disponibilità da ricontrollare' END, CASE WHEN NOT reachable THEN 'Recapito da trovare' END) AS checks
FROM (SELECT *, reachable AND freshness <> 'stale' AND NOT coalesce(identity_conflict, false) AND NOT coalesce(availability_conflict, false) AS callable
  FROM (SELECT s.*, coalesce(c.root, s.id) AS root, coalesce(f.n, 0) AS matching, al.outcome, al.next_contact, k.members, k.identity_conflict, k.availability_conflict, k.conflicts, fr.status AS freshness,
          {route_kind(FACTS)} AS route, telephone IS NOT NULL OR email IS NOT NULL AS reachable
    FROM scored s LEFT JOIN clusters c ON s.id = c.id LEFT JOIN (SELECT id, count(*) AS n FROM screened WHERE fit GROUP BY id) f ON s.id = f.id
      LEFT JOIN (SELECT property_id, outcome AS o1, next_contact AS n1 FROM last_action) la ON s.id = la.property_id
      LEFT JOIN (SELECT coalesce(q.root, a.property_id) AS root, outcome, next_contact FROM actions a LEFT JOIN clusters q ON a.property_id = q.id
                 QUALIFY row_number() OVER (PARTITION BY coalesce(q.root, a.property_id) ORDER BY created_at DESC, action_id DESC) = 1) al ON coalesce(c.root, s.id) = al.root
      LEFT JOIN conflicts k ON coalesce(c.root, s.id) = k.root JOIN ({_FRESH}) fr ON s.id = fr.id
    WHERE availability = 'listed' AND review_status NOT IN ('acquired', 'discarded') AND (review_status IN ('shortlisted', 'due_diligence', 'negotiation') OR f.n IS NOT NULL)
      AND {_ALLOWED.replace('outcome', 'o1').replace('next_contact', 'n1')})
  WHERE {_ALLOWED})
WHERE callable OR NOT card_incomplete
QUALIFY row_number() OVER (PARTITION BY root ORDER BY callable DESC, route <> 'unknown' DESC, next_contact NULLS LAST, priority_score DESC, last_seen DESC, id) = 1)""")
def _(a: Archive):
    return queue.today_queue(a.scored, a.memberships, a.contact_actions, a.clusters, a.conflicts, a.freshness, AS_OF)


@query("portal_pending", ["listings"], f"""SELECT id, title, price, currency, city, zone, 'casa.it' AS portal, concat('https://www.casa.it/immobili/', k, '/') AS card_url,
  CASE WHEN card_drop AND price > 0 AND price < card_old_price THEN {rnd('(price - card_old_price) / card_old_price * 100', 1)} END AS drop_pct,
  {ts('last_seen - to_days(CAST(k % 10 AS INTEGER))')} AS seen_at, {ts('first_seen')} AS first_seen FROM listings WHERE review_status NOT IN ('acquired', 'discarded') AND availability NOT IN ({INACTIVE}) AND card_incomplete""")
def _(a: Archive):
    return queue.portal_pending(a.listings, None)


@query("next_best", ["scored", "screened"], f"""SELECT id, priority_score FROM scored WHERE availability NOT IN ({INACTIVE}) AND review_status NOT IN ('acquired', 'discarded')
  AND id NOT IN (SELECT id FROM screened WHERE fit) ORDER BY priority_score DESC, id LIMIT 5""")
def _(a: Archive):
    return catalog.next_best(a.scored, a.memberships.where("fit")).select("id", "priority_score")


@query("open_questions", ["scored", "clusters", "conflicts", "last_action", "references_", "listings", "sources"], f"""
SELECT s.id, concat_ws('; ', CASE WHEN f.status = 'stale' OR coalesce(k.availability_conflict, false) THEN 'L’immobile è ancora disponibile? Confermare prima di procedere.' END,
  CASE WHEN la.mandate_status IS DISTINCT FROM 'confirmed_by_team' THEN 'Qual è il rapporto con la proprietà e chi ha il mandato?' END,
  CASE WHEN NOT coalesce(contains(description, 'Categoria catastale'), false) THEN 'Richiedere categoria catastale e documentazione aggiornata.' END,
  CASE WHEN coalesce({strategy_quote(TEXT, 'conversion')} IS NOT NULL, false) THEN 'Quali documenti supportano il cambio d’uso dichiarato?' END,
  CASE WHEN contains(k.conflicts, 'Prezzi richiesti diversi') THEN 'Qual è il prezzo aggiornato e perché differisce tra le fonti?' END,
  CASE WHEN published_at IS NULL THEN 'Da quando è in vendita? Ci sono ribassi precedenti al nostro storico?' END,
  CASE WHEN gaps <> '' THEN concat('Integrare comparabili: ', gaps, '.') END, CASE WHEN benchmark_id IS NULL THEN 'Manca un benchmark compatibile: verificare il vantaggio di prezzo.' END) AS questions
FROM scored s JOIN ({_FRESH}) f ON s.id = f.id LEFT JOIN clusters c ON s.id = c.id LEFT JOIN conflicts k ON c.root = k.root LEFT JOIN last_action la ON s.id = la.property_id
LEFT JOIN (SELECT id, concat_ws(', ', CASE WHEN max(median_sqm) FILTER (key = 'to_renovate') IS NULL THEN 'da ristrutturare' END, CASE WHEN max(median_sqm) FILTER (key = 'renovated') IS NULL THEN 'ristrutturato' END,
    CASE WHEN max(median_sqm) FILTER (key = 'new') IS NULL THEN 'nuovo' END) AS gaps FROM references_ GROUP BY id) g ON s.id = g.id""")
def _(a: Archive):
    return signals.questions(a.scored, a.freshness, a.conflicts, a.clusters, a.last_calls, a.references)


@query("listing_dossier", ["listings", "observations", "last_action"], f"""SELECT l.id, url, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, contact_name, telephone, email,
  {route_kind(FACTS)} AS route_kind, {_whole(MANDATE_SENTENCE)} AS mandate, outcome, mandate_status, next_contact FROM listings l LEFT JOIN last_action a ON l.id = a.property_id""")
def _(a: Archive):
    return signals.listing_dossier(a.listings, a.reductions, a.last_calls).drop("route_quote", "cadastral", "change_of_use", "reductions", "total_pct")


# --- Notifications, runs, usage ---------------------------------------------------------------------------

def _reads(a: Archive):
    return a.table("events").where("event_type = 'view'").select(F.col("event_id").alias("notification_id"), F.concat(F.lit("U"), F.col("user_id") % 4).alias("user_id"))


@query("unread_anti", [], "SELECT event_id AS notification_id FROM events WHERE NOT (event_type = 'view' AND user_id % 4 = 1)")
def _(a: Archive):
    return quality.unread_anti(a.table("events").select(F.col("event_id").alias("notification_id")), _reads(a), "U1")


@query("unread_totals", ["team"], """SELECT t.user_id, (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM events) - coalesce(n, 0) AS unread FROM team t
LEFT JOIN (SELECT concat('U', user_id % 4) AS user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) r ON t.user_id = r.user_id""")
def _(a: Archive):
    return quality.unread_totals(a.table("events").select(F.col("event_id").alias("notification_id")), _reads(a), a.users)


_RUNS = """SELECT r.run_id, created_at, finished_at, coalesce(found, 0) AS found, coalesce(processed, 0) AS processed, coalesce(new, 0) AS new, coalesce(changed, 0) AS changed, coalesce(errors, 0) AS errors,
  coalesce(sources_ok, 0) AS sources_ok, CASE WHEN coalesce(sources_ok, 0) = 0 OR (coalesce(found, 0) > 0 AND coalesce(processed, 0) = 0) THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'completed' END AS status
FROM runs r LEFT JOIN (SELECT run_id, CAST(coalesce(sum(items) FILTER (step = 'discovery'), 0) AS BIGINT) AS found, count(*) FILTER (step = 'acquire') AS processed, count(*) FILTER (step = 'acquire' AND is_new) AS new,
  count(*) FILTER (step = 'acquire' AND is_changed AND NOT is_new) AS changed, count(*) FILTER (step = 'source' AND level = 'error') AS errors, count(DISTINCT source_id) FILTER (step = 'discovery') AS sources_ok
  FROM run_events GROUP BY 1) e ON r.run_id = e.run_id"""


@query("run_summary", ["runs", "run_events", "screened"], f"""SELECT run_id, found, processed, new, changed, errors, sources_ok, status, CAST(floor(epoch(finished_at)) - floor(epoch(created_at)) AS BIGINT) AS duration_s, coalesce(qualified, 0) AS qualified FROM ({_RUNS})
  LEFT JOIN (SELECT r.run_id, count(*) AS qualified FROM (SELECT DISTINCT run_id, property_id FROM run_events WHERE step = 'acquire') e JOIN runs r ON e.run_id = r.run_id JOIN screened s ON s.agent_id = r.agent_id AND s.id = e.property_id WHERE s.fit GROUP BY 1) q USING (run_id)""")
def _(a: Archive):
    fit = quality.run_qualified(a.runs, a.run_events, a.memberships)
    return (a.run_summary.select("run_id", "found", "processed", "new", "changed", "errors", "sources_ok", "status", "duration_s").join(fit, "run_id", "left")
            .withColumn("qualified", F.coalesce("qualified", F.lit(0).cast("bigint"))))


@query("daily_runs", ["runs", "run_events"], f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('failed', 'partial')) AS failed
FROM ({_RUNS}) GROUP BY 1 ORDER BY day DESC LIMIT 14""")
def _(a: Archive):
    return quality.daily_runs(a.run_summary, 14)


@query("analysis_progress", ["run_events"], "SELECT run_id, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS accepted, count(*) FILTER (event_id % 3 <> 0) AS pending FROM run_events GROUP BY 1")
def _(a: Archive):
    return quality.analysis_progress(a.run_events.withColumn("submitted", F.col("event_id") % 3 == 0))


_TOKENS = "CASE WHEN event_id % 7 <> 0 THEN items * 100 END"


@query("ai_usage_totals", ["run_events"], f"""SELECT count(*) AS accepted_analyses, count({_TOKENS}) AS reported_analyses, CAST(sum({_TOKENS}) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN items * 10 END) AS BIGINT) AS output_tokens,
  CAST(sum(CAST(({_TOKENS}) * 0.4 / 1000000 + (items * 10) * 1.6 / 1000000 AS DECIMAL(28,8))) AS DOUBLE) AS estimated_eur FROM run_events""")
def _(a: Archive):
    reported = F.col("event_id") % 7 != 0
    usage = a.run_events.select(F.when(reported, F.col("items") * 100).alias("input_tokens"), F.when(reported, F.col("items") * 10).alias("output_tokens"))
    return quality.ai_usage_totals(usage.withColumn("estimated_eur", quality.usage_cost(0.4, 1.6)))


@query("alert_totals", [], """SELECT count(*) AS messages, count(*) FILTER (s IN ('processed', 'empty')) AS read, count(*) FILTER (s = 'ignored') AS ignored, count(*) FILTER (s = 'rejected') AS rejected,
  CAST(sum(n) AS BIGINT) AS cards, CAST(sum(n % 3) AS BIGINT) AS created, CAST(sum(n % 5) AS BIGINT) AS updated, CAST(sum(n % 2) AS BIGINT) AS skipped
FROM (SELECT CASE event_type WHEN 'view' THEN 'processed' WHEN 'click' THEN 'empty' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'ignored' ELSE 'processing' END AS s, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n FROM events) WHERE s <> 'processing'""")
def _(a: Archive):
    kind, n = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    status = F.when(kind == "view", "processed").when(kind == "click", "empty").when(kind == "error", "rejected").when(kind == "signup", "ignored").otherwise("processing")
    return quality.alert_totals(a.table("events").select(status.alias("status"), n.alias("cards"), (n % 3).alias("created"), (n % 5).alias("updated"), (n % 2).alias("skipped")))


@query("source_health", [], f"""SELECT source_id, failures, last_success, CASE WHEN failures > 0 THEN {ts('last_at + to_seconds(CAST(least(86400, greatest(last_retry, 60 * power(2, least(failures, 10)))) AS BIGINT))')} END AS next_retry
FROM (SELECT concat('S', e.user_id % 37) AS source_id, count(*) FILTER (fail) AS failures, {ts("max(ts) FILTER (event_type = 'purchase')")} AS last_success, max(ts) FILTER (fail) AS last_at,
  arg_max(event_id % 500, event_id) FILTER (fail) AS last_retry FROM (SELECT *, event_type <> 'purchase' AND event_id > coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id % 37), -1) AS fail FROM events) e GROUP BY 1)""")
def _(a: Archive):
    events = a.table("events").select(F.concat(F.lit("S"), F.col("user_id") % 37).alias("source_id"), F.col("ts").alias("at"), "event_id",
                                      (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 500).alias("retry_after"))
    return quality.source_health(events).select("source_id", "failures", "last_success", "next_retry")


@query("source_message_class", [], """SELECT event_id, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'bad_response' WHEN 'click' THEN 'excluded_by_rules' WHEN 'signup' THEN 'unreachable' ELSE 'other' END AS class FROM events""")
def _(a: Archive):
    kind = F.col("event_type")
    message = (F.when(kind == "error", "Il sito blocca l’accesso automatico (HTTP 403)").when(kind == "view", "La fonte risponde HTTP 500")
               .when(kind == "click", "Escluso da robots.txt").when(kind == "signup", "Il nome non risolve").otherwise("altro"))
    return a.table("events").select("event_id", quality.source_message_class(message).alias("class"))


# --- Scenarios and places --------------------------------------------------------------------------------------

def _inputs(a: Archive):
    k = F.col("k")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return a.listings.where("price is not null").select(
        "id", F.col("price").alias("purchase"), (F.col("price") + 50000).alias("sale"), number(k % 50 * 1000).alias("works"), number(k % 20 * 500).alias("acquisition_costs"),
        number(k % 15).alias("contingency_pct"), number(k % 6).alias("selling_pct"), number(k % 10 * 100).alias("holding_monthly"), (k % 24 + 1).cast("int").alias("months"),
        number(k % 25).alias("target_roi_pct"), number(k % 20).alias("stress_sale_pct"), number(k % 40).alias("stress_works_pct"), (k % 12).cast("int").alias("stress_delay_months"))


_INPUTS = """(SELECT id, CAST(price AS DECIMAL(20,4)) AS purchase, CAST(price + 50000 AS DECIMAL(20,4)) AS sale, k % 50 * 1000 AS works, k % 20 * 500 AS costs, k % 15 AS contingency, k % 6 AS selling,
  k % 10 * 100 AS holding, k % 24 + 1 AS months, k % 25 AS target, k % 20 AS s_sale, k % 40 AS s_works, k % 12 AS s_delay FROM listings WHERE price IS NOT NULL)"""
_I = "(purchase + costs + CAST(works * (1 + contingency * 0.01) AS DECIMAL(20,4)) + holding * months)"
_P = f"(CAST(sale * (1 - selling * 0.01) AS DECIMAL(24,8)) - {_I})"
_SI = "(purchase + costs + CAST(works * CAST(1 + s_works * 0.01 AS DECIMAL(10,2)) * (1 + contingency * 0.01) AS DECIMAL(24,8)) + holding * (months + s_delay))"
_SP = f"(CAST(sale * CAST(1 - s_sale * 0.01 AS DECIMAL(10,2)) * CAST(1 - selling * 0.01 AS DECIMAL(10,2)) AS DECIMAL(28,8)) - {_SI})"
_CENT = lambda x: f"CAST(round({x}, 2) AS DOUBLE)"


@query("scenario_profit", ["listings"], f"""SELECT id, {_CENT(_I)} AS invested, {_CENT(_P)} AS profit, {rnd(f'{_P} / {_I} * 100', 2)} AS roi_pct, {rnd(f'{_I} / (1 - selling * 0.01)', 2)} AS breakeven_sale,
  {_CENT(_SI)} AS stress_invested, {_CENT(_SP)} AS stress_profit, {_P} * 100 >= target * {_I} AS target_met, {_SP} * 100 >= target * {_SI} AS stress_target_met FROM {_INPUTS}""")
def _(a: Archive):
    return scenario.scenario_profit(_inputs(a)).select("id", "invested", "profit", "roi_pct", "breakeven_sale", "stress_invested", "stress_profit", "target_met", "stress_target_met")


@query("sensitivity_grid", ["listings"], f"""SELECT id, s AS sale_change_pct, w AS works_change_pct, {_CENT("""CAST(sale * CAST(1 + s * 0.01 AS DECIMAL(10,2)) * CAST(1 - selling * 0.01 AS DECIMAL(10,2)) AS DECIMAL(28,8))
  - (purchase + costs + CAST(works * CAST(1 + w * 0.01 AS DECIMAL(10,2)) * (1 + contingency * 0.01) AS DECIMAL(24,8)) + holding * months)""")} AS profit
FROM {_INPUTS}, (SELECT unnest([-10, 0, 10]) AS s), (SELECT unnest([0, 20]) AS w)""")
def _(a: Archive):
    return scenario.sensitivity_grid(_inputs(a)).select("id", "sale_change_pct", "works_change_pct", "profit")


_COS = "cos(42.0 * pi() / 180)"
_SCALE = f"least(580 / (13.3 * {_COS}), 350 / 12.0)"


@query("map_grid", ["listings"], f"""SELECT CAST(floor(x / 32 + 0.5) AS BIGINT) AS cell_x, CAST(floor(y / 32 + 0.5) AS BIGINT) AS cell_y, count(*) AS n, {rnd('sum(CAST(x AS DECIMAL(20,6))) / count(*)', 3)} AS x,
  {rnd('sum(CAST(y AS DECIMAL(20,6))) / count(*)', 3)} AS y
FROM (SELECT {rnd(f'320 + (longitude - 12.65) * {_SCALE} * {_COS}', 6)} AS x, {rnd(f'195 - (latitude - 42.0) * {_SCALE}', 6)} AS y FROM listings WHERE latitude IS NOT NULL) WHERE x BETWEEN 16 AND 624 AND y BETWEEN 16 AND 374 GROUP BY 1, 2""")
def _(a: Archive):
    return geo.map_grid(a.listings)


_ZONED = """(SELECT l.id, z.zone_code, l.property_type, l.price, l.surface, l.currency, l.transaction_type, l.condition, least(
    least(longitude - w, w + 2.0 - longitude) * 111320 * cos(radians(latitude)), least(latitude - s, s + 1.9 - latitude) * 111320,
    sqrt(power(greatest(w + 0.5 - longitude, longitude - w - 0.9, 0) * 111320 * cos(radians(latitude)), 2) + power(greatest(s + 0.5 - latitude, latitude - s - 0.9, 0) * 111320, 2))) AS border
  FROM listings l JOIN (SELECT concat('B', n_nationkey) AS zone_code, 6 + (n_nationkey % 5) * 2.66 AS w, 36 + floor(n_nationkey / 5) * 2.4 AS s FROM nation) z
    ON longitude > w AND longitude < w + 2.0 AND latitude > s AND latitude < s + 1.9 AND NOT (longitude BETWEEN w + 0.5 AND w + 0.9 AND latitude BETWEEN s + 0.5 AND s + 0.9))"""


@query("zone_join", ["listings"], f"SELECT id, zone_code FROM {_ZONED} WHERE round(border, 1) >= 20")
def _(a: Archive):
    return geo.zone_join(a.listings, a.zones).select("id", "zone_code")


_QUOTES = """(SELECT concat('B', n_nationkey) AS zone_code, usage, CASE WHEN usage = 'R' AND p = 1 THEN 'Box' WHEN usage = 'R' THEN 'Abitazioni civili' WHEN usage = 'C' THEN 'Negozi' WHEN usage = 'T' THEN 'Uffici' ELSE 'Capannoni' END AS type,
  CASE WHEN p = 0 THEN 'Normale' ELSE 'Ottimo' END AS quote_condition, CAST(900 + 40 * n_nationkey + 100 * p AS DOUBLE) AS min_sqm, CAST((900 + 40 * n_nationkey + 100 * p) * 1.5 AS DOUBLE) AS max_sqm,
  CASE WHEN n_nationkey % 6 = 5 THEN '1999-S1' ELSE '2001-S1' END AS period, p AS position FROM (SELECT *, unnest(['R', 'C', 'T', 'P']) AS usage FROM nation) n, (SELECT unnest([0, 1]) AS p))"""
_USAGE = "CASE property_type WHEN 'residential' THEN 'R' WHEN 'commercial' THEN 'C' WHEN 'office' THEN 'T' ELSE 'P' END"


def _zoned(a: Archive):
    return a.listings.join(geo.zone_join(a.listings, a.zones).select("id", "zone_code"), "id")


@query("zone_quote_join", ["listings"], f"SELECT z.id, z.zone_code, q.usage, q.type, q.position FROM {_ZONED} z JOIN {_QUOTES} q ON z.zone_code = q.zone_code AND q.usage = {_USAGE} WHERE round(border, 1) >= 20")
def _(a: Archive):
    return geo.zone_quote_join(_zoned(a).select("id", "zone_code", "property_type"), a.zone_quotes).select("id", "zone_code", "usage", "type", "position")


@query("zone_scenarios", ["listings"], f"""SELECT z.id, z.zone_code, q.type AS quote_type, q.quote_condition, q.period AS quote_period, {rnd('min_sqm * surface', 0)} AS range_min, {rnd('max_sqm * surface', 0)} AS range_max,
  {rnd('(price / surface / ((min_sqm + max_sqm) / 2) - 1) * 100', 1)} AS delta_midpoint_pct FROM {_ZONED} z JOIN {_QUOTES} q ON z.zone_code = q.zone_code AND q.usage = {_USAGE}
WHERE round(border, 1) >= 20 AND period = '2001-S1' AND currency = 'EUR' AND transaction_type = 'sale' AND {USABLE} AND (property_type <> 'residential' OR q.type = 'Abitazioni civili')""")
def _(a: Archive):
    return scoring.zone_scenarios(_zoned(a), a.zone_quotes, AS_OF).drop("quote_basis")


@query("zone_signal", ["listings"], f"""SELECT id, zone_code, min_sqm, max_sqm, mid_sqm, period <> '2001-S1' AS stale, period, CASE WHEN period = '2001-S1' AND {USABLE} THEN {rnd(f"{rnd('price / surface', 2)} / mid_sqm * 100 - 100", 1)} END AS delta_pct
FROM (SELECT z.*, q.min_sqm, q.max_sqm, {rnd('(min_sqm + max_sqm) / 2', 2)} AS mid_sqm, q.period, q.position, q.quote_condition FROM {_ZONED} z JOIN {_QUOTES} q ON z.zone_code = q.zone_code AND q.usage = {_USAGE} WHERE round(border, 1) >= 20)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY (condition = 'renovated' AND quote_condition = 'Ottimo') DESC, position) = 1""")
def _(a: Archive):
    return scoring.zone_signal(_zoned(a), a.zone_quotes, AS_OF).drop("area_basis")


# --- Ingest over the given pages ----------------------------------------------------------------------------------

@query("scan_pages")
def _(a: Archive):
    return pages.scan_pages(a.table("pages"), {"locality": "h1"}).select("page_id", "url", "listing_key", "title", "description", "price", "surface", "address", "currency", "availability", "reject_reason")


def _html_of(a: Archive):
    """A detail page per listing, written from its row: structured data plus a heading."""
    node = F.to_json(F.struct(
        F.lit("Apartment").alias("@type"), F.col("title").alias("name"), F.col("description"),
        F.struct("price", F.when(F.col("currency") != "XXX", F.col("currency")).alias("priceCurrency"),
                 F.concat(F.lit("http://purl.org/goodrelations/v1#"), F.when(F.col("transaction_type") == "rent", "LeaseOut").otherwise("Sell")).alias("businessFunction"),
                 F.struct(F.col("contact_name").alias("name"), "telephone", "email").alias("seller")).alias("offers"),
        F.struct(F.col("surface").alias("value"), F.lit("MTK").alias("unitCode")).alias("floorSize"),
        F.struct(F.col("address").alias("streetAddress"), F.col("city").alias("addressLocality")).alias("address"),
        F.array(F.struct(F.lit("zone").alias("name"), F.col("zone").alias("value")), F.struct(F.lit("condition").alias("name"), F.col("condition").alias("value"))).alias("additionalProperty"),
        F.col("published_at").alias("datePosted")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), node, F.lit("</script></head><body><h1>"), "title", F.lit("</h1></body></html>"))
    return over_tasks(a.listings).select(F.col("k").alias("page_id"), F.concat("url", F.lit("?utm_source=x#foto")).alias("url"), html.alias("html"))


@query("scan_listing_pages", ["listings"], f"""SELECT k AS page_id, url, title, coalesce(description, '') AS description, price, surface, address, city, zone, condition, CASE WHEN transaction_type = 'rent' THEN 'rent' ELSE 'sale' END AS transaction_type,
  currency, contact_name, telephone, email, published_at, CASE WHEN price IS NULL AND surface IS NULL AND address IS NULL THEN 'not a listing: no price, surface or address' END AS reject_reason FROM listings""")
def _(a: Archive):
    return pages.scan_pages(_html_of(a)).select("page_id", "url", "title", "description", "price", "surface", "address", "city", "zone", "condition", "transaction_type",
                                                 "currency", "contact_name", "telephone", "email", "published_at", "reject_reason")


@query("discover_links", [], """
SELECT page_id, link FROM (SELECT DISTINCT page_id, concat(scheme, '://', host, h) AS link FROM (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
  unnest(regexp_extract_all(html, '<a href="(/[A-Za-z0-9_/.-]*)"', 1)) AS h FROM pages))""")
def _(a: Archive):
    links = pages.discover_links(pages.parse_pages(a.table("pages")))
    return links.where(V.url_part("link", "query") == "").where(V.url_part("link", "path").rlike("^/[A-Za-z0-9_/.-]*$")).select("page_id", "link")


@query("page_link_context")
def _(a: Archive):
    return pages.page_link_context(pages.parse_pages(a.table("pages")))


@query("page_candidates")
def _(a: Archive):
    parsed = pages.parse_pages(a.table("pages"))
    seen = pages.discover_links(parsed).where(F.col("link").rlike("[0-4]/?$")).select(F.col("link").alias("url"), F.when(F.col("page_id") % 2 == 0, "sold").otherwise("listed").alias("availability"))
    return pages.page_candidates(parsed, seen)


@query("canonical_url", [], """SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, NOT contains(canonical, '#') AS clean FROM (SELECT *, regexp_replace(url, '#.*$', '') AS canonical FROM pages)""")
def _(a: Archive):
    c = V.canonical_url("url")
    return a.table("pages").select("page_id", V.url_part(c, "host").alias("host"), (~c.contains("#") & ~c.contains("utm_")).alias("clean"))


def _three_layouts(a: Archive, rows, columns: list[str]) -> str:
    """The rows as CSV files of three layouts in one folder: comma, semicolon with a byte-order mark, tab with the columns turned round and one more."""
    base = f"{shared_folder(a.spark)}/csv-{uuid.uuid4().hex}"
    write = lambda df, sep, name: df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{base}/{name}")
    write(rows.where("part = 0").select(*columns), ",", "a")
    sinks.sink_csv(rows.where("part = 1").select(*columns), f"{base}/b")
    write(rows.where("part = 2").select(F.lit("altro").alias("note"), *reversed(columns)), "\t", "c")
    return f"{base}/*"


_CSV_SQL = f"""SELECT listing_key, url, title, city, zone, address, CASE WHEN k % 41 = 0 THEN 'castle' ELSE property_type END AS property_type, condition, price, surface, rooms, bathrooms, CASE WHEN k % 43 = 1 THEN 95.0 ELSE latitude END AS latitude, longitude, area_basis, currency,
  transaction_type, CASE WHEN k % 10 = 3 THEN concat('Riga "uno";', chr(10), 'due, ', coalesce(description, 'niente')) ELSE coalesce(description, '') END AS description, availability, is_auction,
  nullif(concat_ws('; ', CASE WHEN k % 41 = 0 THEN 'unknown property_type' END, CASE WHEN k % 43 = 1 THEN 'latitude out of range' END), '') AS error FROM listings"""


@query("scan_listings_csv", ["listings"], _CSV_SQL)
def _(a: Archive):
    """The listings written as CSV files of three layouts and read back."""
    k, comma = F.col("k"), lambda c, kind: F.translate(F.col(c).cast(kind).cast("string"), ".", ",").alias(c)
    rows = (a.listings.withColumn("property_type", F.when(k % 41 == 0, "castle").otherwise(F.col("property_type"))).withColumn("latitude", F.when(k % 43 == 1, 95.0).otherwise(F.col("latitude")))
            .withColumn("description", F.when(k % 10 == 3, F.concat(F.lit('Riga "uno";\ndue, '), F.coalesce("description", F.lit("niente")))).otherwise(F.col("description"))))
    texts = [comma(c, "decimal(18,2)") if c in ("price", "surface", "rooms", "bathrooms") else F.col(c).cast("string").alias(c) for c in files.LISTING_COLUMNS]
    return files.scan_listings_csv(a.spark, _three_layouts(a, rows.select((k % 3).alias("part"), *texts), files.LISTING_COLUMNS))


@query("scan_benchmarks_csv", ["benchmarks"], """SELECT city, zone, property_type, condition, area_basis, currency, transaction_type, min_sqm, CASE WHEN length(condition) = 3 THEN 1.0 ELSE max_sqm END AS max_sqm, period, concat('Listino ', zone) AS source_label, 'https://listino.example/1' AS source_url,
  CASE WHEN length(condition) = 3 THEN 'inverted range' END AS error FROM benchmarks""")
def _(a: Archive):
    comma = lambda c: F.translate(F.col(c).cast("decimal(18,4)").cast("string"), ".", ",").alias(c)
    rows = a.benchmarks.withColumn("source_url", F.lit("https://listino.example/1")).withColumn("max_sqm", F.when(F.length("condition") == 3, 1.0).otherwise(F.col("max_sqm")))
    texts = [comma(c) if c.endswith("_sqm") else F.col(c) for c in files.BENCHMARK_COLUMNS]
    return files.scan_benchmarks_csv(a.spark, _three_layouts(a, rows.select(F.pmod(F.xxhash64("id"), F.lit(3)).alias("part"), *texts), files.BENCHMARK_COLUMNS))


@query("scan_sitemap", [], """SELECT page_id, concat(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)), '://', regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '/annunci/', page_id) AS link FROM pages""")
def _(a: Archive):
    base = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*", 0)
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.lit("/annunci/"), F.col("page_id"), F.lit(" </loc></url><url><loc>/altro/1</loc></url></urlset>"))
    maps = a.table("pages").select("page_id", base.alias("base_url"), xml.alias("xml"))
    found = files.scan_sitemap(maps.select(F.concat(F.lower(F.regexp_extract("base_url", r"^([a-zA-Z]+)", 1)), F.regexp_replace("base_url", r"^[a-zA-Z]+", "")).alias("base_url"), "xml"), "/annunci/")
    return found.select(F.regexp_extract("link", r"(\d+)$", 1).cast("bigint").alias("page_id"), "link")


@query("scan_zone_quotes", [], """SELECT concat('B', n_nationkey) AS zone_code, 'Uffici' AS type, 'Normale' AS condition, CAST(900.5 + 40 * n_nationkey AS DOUBLE) AS min_sqm, CAST(1500 + 40 * n_nationkey AS DOUBLE) AS max_sqm, CASE WHEN n_nationkey % 2 = 0 THEN 'gross' ELSE 'net' END AS area_basis FROM nation""")
def _(a: Archive):
    n = F.col("n_nationkey")
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    row = lambda low, high, basis: F.concat(F.lit("<tr>"), cell(F.lit("<b>Uffici</b>")), cell(F.lit("Normale")), cell(low), cell(high), cell(basis), *[cell(F.lit("x"))] * 3, F.lit("</tr>"))
    low, high = F.concat((900 + 40 * n).cast("string"), F.lit(",5")), (1500 + 40 * n).cast("string")
    html = F.concat(F.lit("<table>"), row(low, high, F.when(n % 2 == 0, "L").otherwise("N")), row(high, low, F.lit("L")), F.lit("<tr><td>intestazione</td></tr></table>"))
    docs = a.table("nation").select(F.concat(F.lit("B"), n).alias("zone_code"), html.alias("html"))
    return files.scan_zone_quotes(docs).drop("position")


@query("scan_semantic_results", [], """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'not a JSON object' ELSE nullif(concat_ws('; ', CASE WHEN 2 * n + CASE turn % 3 WHEN 0 THEN 112 ELSE 102 END > 30000 THEN 'too long' END,
  CASE WHEN n > 1500 THEN 'summary missing or too long' END, CASE WHEN turn % 3 = 1 THEN 'unknown strategy' END, CASE WHEN n + 10 > 700 THEN 'evidence length' END), '') END AS error
FROM (SELECT *, length(coalesce(text, '')) AS n FROM conversations)""")
def _(a: Archive):
    quoted = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L} ]", " ")
    body = lambda s: F.to_json(F.struct(quoted.alias("summary"), F.array(F.struct(F.lit(s).alias("strategy"), F.concat(F.lit("citazione "), quoted).alias("evidence"))).alias("strategies"), F.array(F.lit("ipotesi")).alias("caveats")))
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body("value_add"), F.lit("\n```"))).when(F.col("turn") % 3 == 1, body("speculation")).otherwise(F.concat(F.lit("testo "), quoted))
    return files.scan_semantic_results(a.table("conversations").select("conv_id", "turn", content.alias("content"))).select("conv_id", "turn", "error")


# --- Cards: alert mails and results pages written from the listing rows --------------------------------------------

def _mails(a: Archive):
    """One mail per city, zone and day group with a text block per listing, and some from other senders."""
    k = F.col("k")
    block = F.concat(F.lit("Appartamento in vendita a Milano\r\nVia Savona "), k % 99, F.lit(", Tortona\r\n€ "), F.format_string("%d.%03d", ((100 + k % 800)).cast("int"), (k % 1000).cast("int")),
                     F.lit(" · "), 40 + k % 200, F.lit(" m² · "), k % 6 + 1, F.lit(" locali\r\nhttps://track.example/c?u=https%3A%2F%2Fwww.casa.it%2Fimmobili%2F"), 10000 + k, F.lit("%2F&x=1"))
    mails = a.listings.groupBy(F.floor(k / 5).alias("m")).agg(F.array_join(F.sort_array(F.collect_list(block)), "\r\n\r\n").alias("body"))
    sender = F.when(F.col("m") % 10 == 9, "news@altro.example").otherwise("alert@mail.casa.it")
    raw = F.concat(F.lit("From: Avvisi <"), sender, F.lit(">\r\nSubject: Nuovi immobili Milano\r\nDate: Sat, 26 Sep 2026 08:00:00 +0200\r\nMessage-ID: <m"), F.col("m"),
                   F.lit("@casa.it>\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=\"utf-8\"\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "body")
    out = mails.select(F.concat(F.lit("mail-"), F.col("m")).alias("path"), F.encode(raw, "UTF-8").alias("content"))
    return over_tasks(out, "path")


@query("scan_alert_mail", [], """SELECT concat('<m', m, '@casa.it>') AS message_id, CASE WHEN m % 10 = 9 THEN 'altro.example' ELSE 'mail.casa.it' END AS sender_domain, CASE WHEN m % 10 = 9 THEN 'ignored' ELSE 'processed' END AS status,
  CASE WHEN m % 10 = 9 THEN 0 ELSE n END AS cards FROM (SELECT CAST(floor(o_orderkey / 5) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1)""")
def _(a: Archive):
    messages = cut_lineage(mail.parse_mail(_mails(a), ["casa.it"]))
    return mail.message_log(messages, mail.mail_cards(messages)).select("message_id", "sender_domain", "status", "cards")


@query("extract_cards", [], """SELECT concat('https://www.casa.it/immobili/', 10000 + k, '/') AS url, CAST((100 + k % 800) * 1000 + k % 1000 AS DOUBLE) AS price, CAST(40 + k % 200 AS DOUBLE) AS surface, CAST(k % 6 + 1 AS DOUBLE) AS rooms, 'Milano' AS city,
  concat('Via Savona ', k % 99, ', Tortona') AS address, 'residential' AS property_type, 'sale' AS transaction_type, 'EUR' AS currency FROM (SELECT o_orderkey AS k FROM orders) WHERE CAST(floor(k / 5) AS BIGINT) % 10 <> 9""")
def _(a: Archive):
    found = mail.mail_cards(cut_lineage(mail.parse_mail(_mails(a), ["casa.it"])))
    return found.select("url", "price", "surface", "rooms", "city", "address", "property_type", "transaction_type", "currency")


@query("unwrap_link", ["listings"], """SELECT id, CASE WHEN k % 4 <> 3 THEN concat('https://www.casa.it/immobili/', 10000 + k, '/') END AS url, CASE WHEN k % 4 <> 3 THEN 'casa.it' END AS portal FROM listings""")
def _(a: Archive):
    k = F.col("k")
    plain = F.concat(F.lit("https://www.casa.it/immobili/"), 10000 + k, F.lit("/"))
    packed = F.regexp_replace(F.base64(plain.cast("binary")), "=+$", "")
    href = (F.when(k % 4 == 0, F.concat(plain, F.lit("?utm_source=x"))).when(k % 4 == 1, F.concat(F.lit("https://t.example/c?u="), F.url_encode(plain)))
            .when(k % 4 == 2, F.concat(F.lit("https://t.example/r/"), packed)).otherwise(F.lit("https://t.example/altro")))
    return a.listings.select("id", cards.unwrap_link(href).alias("l")).select("id", "l.url", "l.portal")


def _results(a: Archive):
    k = F.col("k")
    item = F.concat(F.lit('<article><a href="/immobili/'), 10000 + k, F.lit('/">Bilocale via Crema '), k % 70, F.lit("</a><p>"), F.when(k % 5 == 0, F.concat(F.lit("<s>€ "), F.format_string("%d.000", (400 + k % 300).cast("int")), F.lit("</s> "))).otherwise(""),
                    F.lit("€ "), F.format_string("%d.000", (100 + k % 300).cast("int")), F.lit("</p><p>"), 40 + k % 100, F.lit(" mq</p><p>rata € 900/mese</p></article>"))
    contract = F.when(F.floor(k / 20) % 2 == 0, "vendita").otherwise("affitto")
    grouped = a.listings.groupBy(F.floor(k / 20).alias("page_id"), contract.alias("contract")).agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"))
    return grouped.select("page_id", F.concat(F.lit("https://www.casa.it/"), "contract", F.lit("/residenziale/milano/")).alias("url"), F.concat(F.lit("<html><body><h1>Case a Milano</h1>"), "items", F.lit("</body></html>")).alias("html")).repartition(a.spark.sparkContext.defaultParallelism, "page_id")


@query("results_page", [], """SELECT concat('https://www.casa.it/immobili/', 10000 + k, '/') AS url, CAST((100 + k % 300) * 1000 AS DOUBLE) AS price, CASE WHEN k % 5 = 0 THEN CAST((400 + k % 300) * 1000 AS DOUBLE) END AS old_price, k % 5 = 0 AS price_drop,
  CAST(40 + k % 100 AS DOUBLE) AS surface, CASE WHEN CAST(floor(k / 20) AS BIGINT) % 2 = 0 THEN 'sale' ELSE 'rent' END AS transaction_type FROM (SELECT o_orderkey AS k FROM orders)""")
def _(a: Archive):
    return cards.results_page(_results(a)).select("url", "price", "old_price", "price_drop", "surface", "transaction_type")


@query("card_location", [], """SELECT concat('https://www.casa.it/immobili/', 10000 + k, '/') AS url, 'Milano' AS city FROM (SELECT o_orderkey AS k FROM orders)""")
def _(a: Archive):
    found = cards.results_page(_results(a)).withColumn("context", F.lit("Case in vendita a Milano"))
    names = a.listings.select("city").distinct().union(a.listings.select(F.lit("Milano")).distinct())
    return cards.card_location(found, names).select("url", "city")


_CITIES = "[" + ", ".join(quote(c) for c in rules.CAPITALS) + "]"


@query("card_places", [], f"""SELECT doc_id, CASE WHEN k % 6 IN (0, 2, 3) THEN city WHEN k % 6 = 1 THEN CASE WHEN k % 12 = 1 THEN city END END AS city,
  CASE WHEN k % 6 = 0 THEN 'Tortona' ELSE '' END AS zone, CASE k % 6 WHEN 0 THEN concat('Via Savona ', k) WHEN 5 THEN 'Via Padova 3, Sconosciuta' END AS address
  FROM (SELECT o_orderkey::VARCHAR AS doc_id, o_orderkey AS k, ({_CITIES})[o_orderkey % {len(rules.CAPITALS)} + 1] AS city FROM orders)""")
def _(a: Archive):
    """Cards of every listing with a place written in one of six ways, many cities, accents left out on some."""
    k, n = F.col("k"), len(rules.CAPITALS)
    names = F.array(*[F.lit(c) for c in rules.CAPITALS])
    city, other = F.get(names, (k % n).cast("int")), F.get(names, ((k + 1) % n).cast("int"))
    bare = F.when(k % 5 == 0, F.translate(city, "ì", "i")).otherwise(city)
    way = lambda *texts: F.element_at(F.array(*texts), (k % 6 + 1).cast("int"))
    none = F.lit(None).cast("string")
    address = way(F.concat(F.lit("Via Savona "), k, F.lit(", Tortona, "), F.upper(bare)), none, none, none, none, F.lit("Via Padova 3, Sconosciuta"))
    context = way(F.lit("Avviso"), F.when(k % 12 == 1, F.concat(F.lit("Case in vendita a "), bare)).otherwise(F.concat(F.lit("Case in corso "), bare)), F.concat(F.lit("Nuovi annunci: "), bare, F.lit(", via "), other),
                  F.concat(F.lit("A "), bare, F.lit(" e "), F.lower(other)), F.concat(F.lit("A "), bare), F.lit("Case in vendita"))
    text = way(F.lit("Trilocale"), F.concat(F.lit("Vicino a corso "), other), F.concat(F.lit("In piazza "), other, F.lit(" a "), bare), F.lit("Bilocale"), F.concat(F.lit("Comodo per "), other), F.lit("Trilocale a Nessundove"))
    rows = a.listings.select(F.col("listing_key").alias("doc_id"), F.col("url"), none.alias("city"), address.alias("address"), context.alias("context"), text.alias("text"))
    return cards.card_location(rows, places.known_places(a.spark, a.listings)).select("doc_id", "city", "zone", "address")


# --- Versioned merges -----------------------------------------------------------------------------------------------

def _current(a: Archive):
    return a.listings.withColumn("content_hash", merge.content_hash())


def _batch(a: Archive):
    """Every listing again: some under a new key, some with another price or state, some gone."""
    k = F.col("k")
    return (a.listings.withColumn("listing_key", F.when(k % 10 == 0, F.concat(F.lit("N"), k)).otherwise(F.col("listing_key")))
            .withColumn("price", F.when(k % 6 == 0, F.col("price") - 1000).otherwise(F.col("price")))
            .withColumn("availability", F.when(k % 9 == 0, "sold").otherwise(F.col("availability"))).withColumn("http_status", F.when(k % 33 == 0, 404).otherwise(200)))


_MERGED = f"""SELECT source_id, listing_key, true AS was, k % 10 <> 0 AS sent, k % 33 = 0 AS gone, price, availability, CASE WHEN k % 6 = 0 THEN price - 1000 ELSE price END AS b_price,
  CASE WHEN k % 9 = 0 THEN 'sold' ELSE availability END AS b_avail FROM listings
  UNION ALL SELECT source_id, concat('N', k), false, true, k % 33 = 0, NULL, NULL, CASE WHEN k % 6 = 0 THEN price - 1000 ELSE price END, CASE WHEN k % 9 = 0 THEN 'sold' ELSE availability END FROM listings WHERE k % 10 = 0"""
_NEW_AVAIL = f"CASE WHEN NOT sent THEN availability WHEN gone THEN 'review' WHEN was AND availability IN ({CLOSED}) AND b_avail NOT IN ({CLOSED}) THEN availability ELSE b_avail END"
_MERGE_SQL = f"""SELECT source_id, listing_key, CASE WHEN sent AND NOT gone THEN b_price ELSE price END AS price, {_NEW_AVAIL} AS availability, sent AS in_batch, NOT was AS created,
  NOT was OR (sent AND ((NOT gone AND b_price IS DISTINCT FROM price) OR {_NEW_AVAIL} IS DISTINCT FROM availability)) AS changed FROM ({_MERGED}) WHERE NOT (gone AND NOT was)"""


@query("merge_listings", ["listings"], _MERGE_SQL)
def _(a: Archive):
    return merge.merge_listings(_current(a), _batch(a), AS_OF).select("source_id", "listing_key", "price", "availability", "in_batch", "created", "changed")


@query("import_summary", ["listings"], f"SELECT count(*) AS imported, count(*) FILTER (created) AS new, count(*) FILTER (changed AND NOT created) AS changed, count(*) FILTER (NOT changed) AS unchanged FROM ({_MERGE_SQL}) WHERE in_batch")
def _(a: Archive):
    return quality.import_summary(merge.merge_listings(_current(a), _batch(a), AS_OF))


@query("new_observations", ["listings"], f"SELECT source_id, listing_key, price FROM ({_MERGE_SQL}) WHERE in_batch AND changed")
def _(a: Archive):
    return merge.new_observations(merge.merge_listings(_current(a), _batch(a), AS_OF), AS_OF).select("source_id", "listing_key", "price")


_STATED_THRICE = f"""SELECT *, CASE WHEN coalesce(prior, a0) IN ({CLOSED}) AND a NOT IN ({CLOSED}) THEN coalesce(prior, a0) ELSE a END AS ra FROM (
  SELECT *, last_value(CASE WHEN gone THEN 'review' WHEN a IN ({CLOSED}) THEN a END IGNORE NULLS) OVER (PARTITION BY source_id, listing_key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM (
    SELECT source_id, listing_key, price AS p0, availability AS a0, n, CASE WHEN n < 2 AND k % 4 = 0 THEN price - 500 ELSE price END AS p, CASE WHEN n = 1 AND k % 7 = 0 THEN 'sold' ELSE availability END AS a,
      n = 1 AND k % 33 = 0 AS gone FROM listings, (SELECT unnest([0, 1, 2]) AS n)))"""


@query("version_observations", ["listings"], f"""SELECT source_id, listing_key, row_number() OVER (PARTITION BY source_id, listing_key ORDER BY n) AS version, held.p AS price, av AS availability FROM (
  SELECT *, coalesce(lag(held) OVER w, {{'p': p0, 'ra': a0}}) AS held_before, coalesce(lag(av) OVER w, a0) AS av_before FROM (
    SELECT *, coalesce(last_value(CASE WHEN NOT gone THEN {{'p': p, 'ra': ra}} END IGNORE NULLS) OVER (PARTITION BY source_id, listing_key ORDER BY n), {{'p': p0, 'ra': a0}}) AS held, CASE WHEN gone THEN 'review' ELSE ra END AS av
    FROM ({_STATED_THRICE})) WINDOW w AS (PARTITION BY source_id, listing_key ORDER BY n))
  WHERE CASE WHEN gone THEN av IS DISTINCT FROM av_before ELSE held IS DISTINCT FROM held_before END""")
def _(a: Archive):
    """Every listing stated three times: at a lower price, then sold or missing, then as it was."""
    k, n = F.col("k"), F.col("batch_order")
    batch = (a.listings.withColumn("batch_order", F.explode(F.array(*[F.lit(i) for i in range(3)])))
             .withColumn("price", F.when((n < 2) & (k % 4 == 0), F.col("price") - 500).otherwise(F.col("price")))
             .withColumn("availability", F.when((n == 1) & (k % 7 == 0), "sold").otherwise(F.col("availability"))).withColumn("http_status", F.when((n == 1) & (k % 33 == 0), 404).otherwise(200)))
    current = a.listings.withColumn("content_hash", merge.content_hash())
    return merge.version_observations(current, batch, AS_OF).select("source_id", "listing_key", "version", "price", "availability")


@query("notifications", ["listings"], f"""SELECT kind, count(*) AS n FROM (SELECT m.*, unnest(list_filter([CASE WHEN m.created THEN 'new_property' END, CASE WHEN NOT m.created AND m.changed AND m.price IS DISTINCT FROM l.price THEN 'price_change' END,
  CASE WHEN NOT m.created AND m.availability <> l.availability AND m.availability IN ({CLOSED}, 'review') THEN 'availability_change' END], lambda x: x IS NOT NULL)) AS kind FROM ({_MERGE_SQL}) m LEFT JOIN listings l ON m.listing_key = l.listing_key WHERE in_batch) GROUP BY 1""")
def _(a: Archive):
    return merge.notifications(merge.merge_listings(_current(a), _batch(a), AS_OF), "R1").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("page_snapshots", ["listings"], f"SELECT source_id, listing_key FROM ({_MERGE_SQL}) WHERE in_batch AND changed")
def _(a: Archive):
    raw = _batch(a).select("source_id", "listing_key", F.concat(F.lit("<html>"), "title", F.lit("</html>")).alias("html"))
    return merge.page_snapshots(merge.merge_listings(_current(a), _batch(a), AS_OF), raw).select("source_id", "listing_key")


@query("complete_from_detail", ["listings"], """SELECT listing_key, CASE WHEN k % 4 = 0 AND availability = 'listed' AND price IS NULL THEN 1000.0 + k ELSE price END AS price, CASE WHEN k % 4 = 0 AND availability = 'listed' AND address IS NULL THEN concat('Via Scheda ', k) ELSE address END AS address, availability = 'listed' AS from_card, false AS incomplete FROM listings""")
def _(a: Archive):
    k = F.col("k")
    seen = a.listings.where("availability = 'listed'").withColumn("price", 1000.0 + k).withColumn("address", F.concat(F.lit("Via Scheda "), k)).withColumn("incomplete", k % 4 == 0)
    return merge.complete_from_detail(seen, a.listings).select("listing_key", "price", "address", "from_card", "incomplete")


def _card_batch(a: Archive):
    k, n = F.col("k"), F.col("n")
    rows = a.listings.where("availability = 'listed'").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select("source_id", "listing_key", F.concat(F.lit("c"), k * 2 + n).alias("card_id"), (F.to_timestamp(F.lit(AS_OF)).cast("timestamp_ntz") + F.make_dt_interval(n)).alias("seen_at"),
                       F.concat(F.lit("Titolo "), n).alias("title"), F.when(n == 1, rules.TITLE_RANK[3]).otherwise(rules.TITLE_RANK[2]).alias("title_how"),
                       F.when((n == 1) & (k % 101 == 0), 2e9).when(~((n == 2) & (k % 6 == 0)), 5000.0 + k + n).alias("price"), F.lit("EUR").alias("currency"), F.when(n == 1, 77.0).alias("surface"), F.lit(None).cast("double").alias("rooms"),
                       F.lit(None).cast("double").alias("bathrooms"), F.concat(F.lit("Via Carta "), k).alias("address"), F.lit("").alias("zone"), F.lit("Milano").alias("city"),
                       F.lit("residential").alias("property_type"), F.lit("unknown").alias("transaction_type"), (k % 8 == 0).alias("price_drop"))


def _card_base(a: Archive):
    k = F.col("k")
    return a.listings.where("NOT is_auction").withColumn("incomplete", k % 3 == 0).withColumn("title_rank", F.lit(4))


# Of the two cards of an open listing the first is implausible for some; auctions are known from cards only.
_CARD_SQL = """SELECT listing_key, CASE WHEN NOT sent OR NOT part OR (bad AND NOT is_auction) THEN title WHEN bad THEN 'Titolo 2' ELSE 'Titolo 1' END AS title,
  CASE WHEN NOT sent THEN price WHEN k % 6 <> 0 THEN 5002.0 + k WHEN NOT bad THEN 5001.0 + k WHEN NOT is_auction THEN price END AS price,
  CASE WHEN NOT sent THEN surface WHEN bad THEN CASE WHEN NOT is_auction THEN surface END WHEN part OR surface IS NULL THEN 77.0 ELSE surface END AS surface, CASE WHEN NOT sent THEN address WHEN part OR address IS NULL THEN concat('Via Carta ', k) ELSE address END AS address,
  CASE WHEN NOT sent OR NOT part THEN city ELSE 'Milano' END AS city, CASE WHEN NOT sent THEN k % 3 = 0 ELSE part END AS incomplete, is_auction AS created
FROM (SELECT *, is_auction OR k % 3 = 0 AS part, availability = 'listed' AS sent, k % 101 = 0 AS bad FROM listings) WHERE NOT is_auction OR sent"""


@query("merge_card", ["listings"], _CARD_SQL)
def _(a: Archive):
    return merge.merge_card(_card_base(a), _card_batch(a)).select("listing_key", "title", "price", "surface", "address", "city", "incomplete", "created")


@query("card_summary", ["listings"], """SELECT count(*) * 2 AS cards, count(*) FILTER (k % 101 = 0) AS rejected, count(*) FILTER (k % 6 = 0) AS no_price, count(*) FILTER (k % 8 = 0) * 2 - count(*) FILTER (k % 24 = 0) - count(*) FILTER (k % 8 = 0 AND k % 101 = 0) AS price_drops,
  count(*) FILTER (is_auction) AS created, count(*) FILTER (NOT is_auction) AS updated, 0 AS unchanged FROM listings WHERE availability = 'listed'""")
def _(a: Archive):
    batch = _card_batch(a)
    return merge.card_summary(batch, merge.merge_card(_card_base(a), batch))


# --- Report tables ------------------------------------------------------------------------------------------------------

@query("sink_csv", ["scored", "sources"], f"""SELECT id AS "ID", title AS "Titolo", price AS "Prezzo", price_sqm AS "Prezzo/mq", discount AS "Sconto %", source_name AS "Fonte", completeness AS "Completezza %", priority_score AS "Priorità verifica" FROM scored s LEFT JOIN sources o ON s.source_id = o.source_id""")
def _(a: Archive):
    return sinks.csv_frame(a.scored, a.sources).select("ID", "Titolo", "Prezzo", "`Prezzo/mq`", "`Sconto %`", "Fonte", "`Completezza %`", "`Priorità verifica`")


@query("report_selection", ["scored"], "SELECT id, title, price, discount, review_status FROM scored")
def _(a: Archive):
    from ..operators import report
    references = a.references
    signal = signals.signals(a.listings, a.reductions, references, AS_OF)
    questions = signals.questions(a.scored, a.freshness, a.conflicts, a.clusters, a.last_calls, references)
    out = report.selection(a.scored, signal, signals.listing_dossier(a.listings, a.reductions, a.last_calls), scoring.zone_signal(_zoned(a), a.zone_quotes, AS_OF), a.freshness,
                           questions, a.memberships, a.saved_searches, a.conflicts, a.clusters, a.sources)
    stages = {v: k for k, v in report._STAGE.items()}
    back = F.create_map(*[F.lit(x) for pair in stages.items() for x in pair])
    return out.select("id", "title", "price", "discount", back[F.col("stage")].alias("review_status"))


# --- Streams over the given tables --------------------------------------------------------------------------------------

def _event_stream(a: Archive):
    # A pattern, because a stream takes a single file only as the match of one; it fits a folder of part files just as well.
    return a.spark.readStream.schema(a.table("events").schema).option("maxFilesPerTrigger", 2).parquet(f"{a.folder}/events.parque[t]")


@query("stream_daily_counts", [], "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total FROM events GROUP BY 1")
def _(a: Archive):
    """The event table as a stream, several files per batch; the counts after the last one."""
    source = _event_stream(a)
    base = f"{shared_folder(a.spark)}/daily-{uuid.uuid4().hex}"
    streams.stream_daily_counts(source, base + "/out", base + "/state").trigger(availableNow=True).start().awaitTermination()
    return streams.last_version(a.spark.read.parquet(base + "/out")).select("day", "total")


_BACK_OFF = "least(86400, greatest(wait, 60 * pow(2, least(failures, 10))))"


@query("stream_source_health", [], f"""SELECT source_id, failures, {ts('last_success')} AS last_success, {ts(f"CASE WHEN failures > 0 THEN last + to_seconds(({_BACK_OFF})::BIGINT) END")} AS next_retry FROM (
  SELECT concat('S', user_id % 37) AS source_id, count(*) FILTER (fail) AS failures, max(ts) FILTER (event_type = 'purchase') AS last_success, max(ts) FILTER (fail) AS last,
         arg_max(event_id % 500, (ts, event_id)) FILTER (fail) AS wait FROM (
    SELECT *, event_type <> 'purchase' AND ((ts, event_id) > max(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id % 37)
           OR count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id % 37) = 0) AS fail FROM events) GROUP BY 1)""")
def _(a: Archive):
    """Failure counters, last success and next retry, kept per source while the event table streams in, two files a trigger."""
    source = _event_stream(a).select(
        F.concat(F.lit("S"), F.col("user_id") % 37).alias("source_id"), F.col("ts").alias("at"), "event_id", (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 500).alias("retry_after"))
    base = f"{shared_folder(a.spark)}/health-{uuid.uuid4().hex}"
    # The order in which files are read says nothing about the time of their events, so none counts as late.
    streams.stream_source_health(source, base + "/out", base + "/state", "10000 days").trigger(availableNow=True).start().awaitTermination()
    return streams.current_health(a.spark.read.schema(streams.source_health(source).schema).parquet(base + "/out"))


def _statements(a: Archive):
    """The event table as statements of listings: a price, and whether the listing is open, sold or to be reviewed."""
    kind, e = F.col("event_type"), a.spark.readStream.schema(a.table("events").schema).parquet(f"{a.folder}/events.parque[t]")
    stated = {"url": F.concat(F.lit("https://s.example/"), F.col("user_id")), "title": F.concat(F.lit("Annuncio "), F.col("user_id")), "city": F.lit("Milano"),
              "price": F.col("value") * 1000, "currency": F.lit("EUR"), "availability": F.when(kind == "purchase", "sold").when(kind == "error", "review").otherwise("listed"), "is_auction": F.lit(False)}
    empty = {c: F.lit(None).cast("double" if c in ("price", "surface", "rooms", "bathrooms", "latitude", "longitude") else "string") for c in merge.CONTENT}
    return e.select(F.concat(F.lit("S"), F.col("user_id") % 7).alias("source_id"), F.col("user_id").cast("string").alias("listing_key"), F.col("ts").alias("read_at"),
                    *[stated.get(c, empty[c]).alias(c) for c in merge.CONTENT])


def _run_changes(a: Archive):
    base = f"{shared_folder(a.spark)}/changes-{uuid.uuid4().hex}"
    source = _statements(a)
    streams.stream_listing_changes(source, base + "/out", base + "/state").trigger(availableNow=True).start().awaitTermination()
    return base + "/out", streams.listing_changes(source).schema


_STATED_SQL = """SELECT *, lag(price) OVER w AS previous_price, lag(availability) OVER w AS previous_availability, row_number() OVER w = 1 AS created, strftime(read_at, '%Y%m%d%H') AS run FROM (
  SELECT concat('S', user_id % 7) AS source_id, user_id::VARCHAR AS listing_key, ts AS read_at, price, stated, CASE WHEN bool_or(stated = 'sold') OVER w THEN 'sold' ELSE stated END AS availability
  FROM (SELECT *, value * 1000 AS price, CASE event_type WHEN 'purchase' THEN 'sold' WHEN 'error' THEN 'review' ELSE 'listed' END AS stated FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, price, stated ROWS UNBOUNDED PRECEDING))
  WINDOW w AS (PARTITION BY listing_key ORDER BY read_at, price, stated)"""


@query("stream_listing_changes", [], f"""SELECT source_id, listing_key, {ts('read_at')} AS read_at, price, availability, created, previous_price, previous_availability FROM ({_STATED_SQL})
  WHERE created OR price IS DISTINCT FROM previous_price OR availability IS DISTINCT FROM previous_availability""")
def _(a: Archive):
    """Every changed version of a listing while the event table streams in, with what it replaces."""
    path, schema = _run_changes(a)
    return a.spark.read.schema(schema).parquet(path).select("source_id", "listing_key", "read_at", "price", "availability", "created", "previous_price", "previous_availability")


@query("stream_notifications", [], f"""WITH s AS ({_STATED_SQL}), moved AS (SELECT *, NOT created AND availability <> previous_availability AS moved FROM s),
  said AS (SELECT 'new_property' AS kind, listing_key AS about, NULL AS key FROM moved WHERE created
    UNION ALL SELECT DISTINCT 'price_change', listing_key, concat(price, availability, run) FROM moved WHERE NOT created AND price IS DISTINCT FROM previous_price
    UNION ALL SELECT DISTINCT 'availability_change', listing_key, concat(price, availability) FROM moved WHERE moved AND availability IN ('sold', 'review')
    UNION ALL SELECT DISTINCT 'source_blocked', source_id, strftime(ts, '%Y%m%d%H') FROM (SELECT *, concat('S', user_id % 7) AS source_id, lag(event_type) OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS before FROM events)
      WHERE event_type = 'error' AND before IS DISTINCT FROM 'error')
  SELECT kind, about, count(*) AS n FROM said GROUP BY 1, 2""")
def _(a: Archive):
    """What the changes of listings and sources give rise to, each key once: two streams of state feed a stream of messages."""
    path, schema = _run_changes(a)
    source = _event_stream(a).select(F.concat(F.lit("S"), F.col("user_id") % 7).alias("source_id"), F.col("ts").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"), F.lit(0).alias("retry_after"))
    base = f"{shared_folder(a.spark)}/messages-{uuid.uuid4().hex}"
    streams.stream_source_health(source, base + "/health", base + "/health-state", "10000 days").trigger(availableNow=True).start().awaitTermination()
    hour = lambda at: F.date_format(at, "yyyyMMddHH")
    listed = merge.notifications(a.spark.readStream.schema(schema).parquet(path), hour(F.col("read_at")))
    blocked = streams.source_blocked(a.spark.readStream.schema(streams.source_health(source).schema).parquet(base + "/health"), run_of=hour)
    both = listed.select("kind", F.col("listing_key").alias("about"), "title", "dedupe_key").unionByName(blocked.select("kind", F.split("dedupe_key", ":")[1].alias("about"), "title", "dedupe_key"))
    streams.stream_notifications(both, base + "/log", base + "/state").trigger(availableNow=True).start().awaitTermination()
    return a.spark.read.parquet(base + "/log").groupBy("kind", "about").agg(F.count(F.lit(1)).alias("n"))
