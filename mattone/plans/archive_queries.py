"""Queries over the archive: indicators, scores, search, work."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules, sinks
from ..functions.expr import price_sqm, size_band
from ..operators import brokers, catalog, clusters, evidence, geo, history, market, quality, queue, refresh, scenario, scoring, screening, signals
from .adapter import AS_OF, EVENTS_AS_OF
from .context import Archive
from .oracle_parts import (BAND, CLOSED, COMPLETENESS, DISCOUNT, EVENTS_NOW, FACTS, INACTIVE, KEYS, MANDATE_SENTENCE, MISSING, NOW, SQM, TEXT, USABLE, cut, hit, known,
                           quote, reference_sql, rnd, route_kind, strategy_quote, ts)
from .registry import query

_SEGMENT_SQL = f"""
SELECT min(city) AS city, min(zone) AS zone, min(property_type) AS property_type, min(condition) AS condition, min(area_basis) AS area_basis,
  min(currency) AS currency, min(transaction_type) AS transaction_type, {BAND} AS size_band, count(*) AS n,
  CASE WHEN count(*) >= 5 THEN {rnd('quantile_cont(price / surface, 0.5)', 2)} END AS median_sqm,
  CASE WHEN count(*) >= 5 THEN {rnd('quantile_cont(price / surface, 0.25)', 2)} END AS p25_sqm,
  CASE WHEN count(*) >= 5 THEN {rnd('quantile_cont(price / surface, 0.75)', 2)} END AS p75_sqm,
  count(*) >= 5 AS sufficient, {ts('max(last_seen)')} AS latest_observed
FROM (SELECT * FROM rooted QUALIFY row_number() OVER (PARTITION BY root ORDER BY last_seen DESC, id DESC) = 1)
WHERE {' AND '.join(known(k) for k in KEYS)} AND {USABLE} AND NOT is_auction AND availability NOT IN ({INACTIVE})
GROUP BY {', '.join(f'lower({k})' for k in KEYS)}, {BAND}"""


@query("market_segments", ["rooted"], _SEGMENT_SQL)
def _(a: Archive):
    return market.market_segments(a.listings, a.clusters, AS_OF)


@query("market_segments_plain", ["listings"], _SEGMENT_SQL.replace("FROM (SELECT * FROM rooted QUALIFY row_number() OVER (PARTITION BY root ORDER BY last_seen DESC, id DESC) = 1)", "FROM listings"))
def _(a: Archive):
    return market.market_segments(a.listings, a.no_clusters, AS_OF)


# --- Indicators ---------------------------------------------------------------------------------

_REDUCED = f"""SELECT DISTINCT l.id FROM listings l JOIN observations o ON o.property_id = l.id AND o.currency = l.currency
  AND o.transaction_type = l.transaction_type WHERE o.price > l.price AND l.availability NOT IN ({INACTIVE})"""

_OVERVIEW = f"""SELECT count(*) AS total, count(*) FILTER (first_seen >= {NOW} - to_days(7)) AS new_7d, count(*) FILTER (last_seen < {NOW} - to_days(7)) AS stale_7d,
  count(*) FILTER (last_seen < {NOW} - to_days(30)) AS stale_30d,
  count(*) FILTER (review_status IN ('reviewing', 'shortlisted', 'due_diligence', 'negotiation')) AS in_work, count(*) FILTER (priority_score >= 75) AS priority,
  {rnd('avg(completeness)', 4)} AS completeness, count(benchmark_id) AS benchmarked, count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS geolocated,
  count(*) FILTER (discount >= 10 AND availability NOT IN ({INACTIVE})) AS below_benchmark, count(*) FILTER (id IN ({_REDUCED})) AS reduced FROM scored"""


@query("archive_overview", ["scored", "observations"], _OVERVIEW)
def _(a: Archive):
    return quality.archive_overview(a.scored, history.reduced_semi(a.listings, a.observations), AS_OF)


@query("action_hints", ["scored", "observations", "sources", "work"], f"""
SELECT row_number() OVER (ORDER BY ord) - 1 AS position, kind FROM (
  SELECT 1 AS ord, 'setup' AS kind WHERE (SELECT count(*) FROM sources WHERE enabled) = 0
  UNION ALL SELECT 2, 'source' WHERE (SELECT count(*) FROM sources WHERE enabled AND status IN ('blocked', 'degraded')) > 0
  UNION ALL SELECT 3, 'freshness' WHERE (SELECT count(*) FROM scored WHERE last_seen < {NOW} - to_days(7)) > 0
  UNION ALL SELECT 4, 'benchmark' WHERE (SELECT count(*) FROM scored WHERE benchmark_id IS NULL) > 0
  UNION ALL SELECT 5, 'review' WHERE (SELECT count(*) FROM scored JOIN work ON id = property_id WHERE due_date < '2001-08-02' AND review_status NOT IN ('acquired', 'discarded')) > 0)""")
def _(a: Archive):
    overview = quality.archive_overview(a.scored, history.reduced_semi(a.listings, a.observations), AS_OF)
    return quality.action_hints(overview, a.sources, catalog.overdue_list(a.listings, a.deal_work, a.users, AS_OF))


_FILLED = " + ".join(f"sum(CASE WHEN {m} THEN 0 ELSE 1 END)" for m in MISSING.values())


@query("data_quality", ["scored"], " UNION ALL ".join(f"""
SELECT '{f}' AS field, count(*) FILTER (NOT {m}) AS present, count(*) FILTER ({m}) AS missing, count(*) AS total,
  {rnd(f'count(*) FILTER (NOT {m}) / count(*) * 100', 1)} AS percent, count(*) FILTER (benchmark_id IS NULL) AS unbenchmarked,
  {rnd(f'({_FILLED}) / (count(*) * 10) * 100', 1)} AS completeness FROM scored""" for f, m in MISSING.items()))
def _(a: Archive):
    return quality.data_quality(a.scored)


_HEALTH = """health AS (SELECT concat('S', user_id % 7) AS source_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1)"""


@query("source_quality", ["described", "sources"], f"""
SELECT s.source_id, source_name, status, enabled, coalesce(listings, 0) AS listings, completeness, coalesce(failures, 0) AS failures FROM sources s
LEFT JOIN (SELECT source_id, count(*) AS listings, {rnd('avg(completeness)', 4)} AS completeness FROM described GROUP BY 1) p ON s.source_id = p.source_id
LEFT JOIN (SELECT concat('S', user_id % 7) AS source_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1) h ON s.source_id = h.source_id""")
def _(a: Archive):
    health = (a.table("events").groupBy(F.concat(F.lit("S"), F.col("user_id") % 7).alias("source_id"))
              .agg(quality.count_if(F.col("event_type") == "error").alias("failures")))
    return quality.source_quality(scoring.describe(a.listings), a.sources, health)


@query("type_counts", ["listings"], "SELECT property_type, count(*) AS n FROM listings GROUP BY 1")
def _(a: Archive):
    return quality.value_counts(a.listings, "property_type")


@query("city_counts", ["listings"], "SELECT CASE WHEN coalesce(city, '') = '' THEN 'Non disponibile' ELSE city END AS city, count(*) AS n FROM listings GROUP BY 1")
def _(a: Archive):
    return quality.value_counts(a.listings, "city", "Non disponibile")


@query("workspace_totals", ["scored"], f"""
SELECT count(*) AS properties, count(benchmark_id) AS benchmarked, count(*) FILTER (score >= 75) AS high_priority, count(*) FILTER (review_status = 'shortlisted') AS shortlisted,
  {rnd('avg(completeness)', 1)} AS quality, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total_asking FROM scored""")
def _(a: Archive):
    return quality.workspace_totals(a.scored)


@query("new_by_day", ["listings"], f"SELECT strftime(first_seen, '%Y-%m-%d') AS day, count(*) AS total FROM listings WHERE first_seen >= {NOW} - to_days(30) GROUP BY 1")
def _(a: Archive):
    return quality.new_by_day(a.listings, AS_OF)


@query("facets", ["listings"], """
SELECT 'city' AS facet, min(city) AS value, count(*) AS n FROM listings WHERE city <> '' GROUP BY lower(city)
UNION ALL SELECT 'currency', currency, count(*) FROM listings WHERE currency <> 'XXX' GROUP BY currency UNION ALL SELECT 'total', '', count(*) FROM listings""")
def _(a: Archive):
    return catalog.facets(a.listings)


# --- Benchmarks and scores ------------------------------------------------------------------------

@query("period_latest", ["latest_benchmarks"], f"""
SELECT {', '.join(f'lower({k}) AS {k}' for k in KEYS)}, period, min_sqm, max_sqm, id AS benchmark_id FROM latest_benchmarks""")
def _(a: Archive):
    out = scoring.period_latest(a.benchmarks)
    for k in KEYS:
        out = out.withColumnRenamed("_" + k, k)
    return out


@query("match_benchmark", ["matched"], "SELECT id, benchmark_note, benchmark_id, benchmark_min, benchmark_max, benchmark_period FROM matched")
def _(a: Archive):
    return scoring.match_benchmark(a.listings, a.benchmarks, AS_OF).select(
        "id", "benchmark_note", "benchmark_id", "benchmark_min", "benchmark_max", "benchmark_period")


@query("benchmark_validity", ["matched"], "SELECT benchmark_note, count(*) AS n FROM matched GROUP BY 1")
def _(a: Archive):
    return scoring.match_benchmark(a.listings, a.benchmarks, AS_OF).groupBy("benchmark_note").agg(F.count(F.lit(1)).alias("n"))


@query("replace_benchmark_series", ["benchmarks"], f"""
SELECT {', '.join(KEYS)}, period, CASE WHEN zone = 'Z1' AND period = '2001-S1' THEN min_sqm + 50 ELSE min_sqm END AS min_sqm,
  CASE WHEN zone = 'Z1' AND period = '2001-S1' THEN max_sqm + 50 ELSE max_sqm END AS max_sqm FROM benchmarks""")
def _(a: Archive):
    old = a.benchmarks
    new = old.where("zone = 'Z1' and period = '2001-S1'").withColumn("min_sqm", F.col("min_sqm") + 50).withColumn("max_sqm", F.col("max_sqm") + 50)
    return scoring.replace_benchmark_series(old, new).select(*KEYS, "period", "min_sqm", "max_sqm")


@query("opportunity", ["scored"], "SELECT id, discount, score, CAST(CASE WHEN score IS NOT NULL THEN least(30, 15 * n_strategies) END AS BIGINT) AS strategy_points FROM scored")
def _(a: Archive):
    return a.scored.select("id", "discount", "score", "strategy_points")


@query("priority", ["scored"], "SELECT id, completeness, priority_score FROM scored")
def _(a: Archive):
    return a.scored.select("id", "completeness", "priority_score")


@query("backfill_priority", ["scored"], "SELECT priority_score, count(*) AS n FROM scored GROUP BY 1")
def _(a: Archive):
    return a.scored.groupBy("priority_score").agg(F.count(F.lit(1)).alias("n"))


@query("project_listing", ["listings"], f"""
SELECT id, CASE WHEN {USABLE} THEN {SQM} END AS price_sqm, concat_ws('; ', {', '.join(f"CASE WHEN {m} THEN '{f}' END" for f, m in MISSING.items())}) AS missing_fields,
  {COMPLETENESS} AS completeness, {BAND.replace("ELSE", "WHEN surface >= 1500 THEN")} AS size_band FROM listings""")
def _(a: Archive):
    from ..functions.expr import completeness
    return (scoring.project_listing(a.listings).withColumn("completeness", completeness()).withColumn("size_band", size_band())
            .select("id", "price_sqm", "missing_fields", "completeness", "size_band"))


@query("backfill_strategies", ["listings"], " UNION ALL ".join(
    f"SELECT id AS property_id, '{s}' AS strategy FROM listings WHERE {strategy_quote(TEXT, s)} IS NOT NULL" for s in rules.STRATEGIES))
def _(a: Archive):
    return scoring.backfill_strategies(scoring.describe(a.listings))


@query("refresh_analysis", ["scored"], """
SELECT id, score, priority_score, CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 1 ELSE 0 END AS kept_checks FROM scored""")
def _(a: Archive):
    hashed = a.listings.withColumn("content_hash", F.sha2("title", 256))
    checks = hashed.where("k % 4 = 0").select(F.col("id").alias("property_id"), F.when(F.col("k") % 3 != 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return scoring.refresh_analysis(hashed, a.benchmarks, checks, AS_OF).select("id", "score", "priority_score", "kept_checks")


def _refreshed(a: Archive):
    """The archive after some listings changed their price and the benchmarks of one zone were published anew."""
    hashed = lambda df: df.withColumn("content_hash", F.sha2(F.concat_ws("|", "title", F.col("price").cast("string")), 256))
    before = a.listings.withColumn("price", F.when(F.col("transaction_type") == "rent", F.col("price") + 1000).otherwise(F.col("price")))
    old = a.benchmarks.withColumn("min_sqm", F.when(F.col("zone") == "Z1", F.col("min_sqm") / 2).otherwise(F.col("min_sqm")))
    previous = scoring.score_listings(hashed(before), old, AS_OF)
    return previous, *refresh.refresh_changed(previous, hashed(a.listings), old, a.benchmarks, AS_OF)


@query("refresh_changed", ["scored"], "SELECT id, score, priority_score, discount, benchmark_id FROM scored")
def _(a: Archive):
    return _refreshed(a)[1].select("id", "score", "priority_score", "discount", "benchmark_id")


@query("refresh_memberships", ["screened"], "SELECT agent_id, id, fit, reasons, score FROM screened")
def _(a: Archive):
    previous, scored, ids = _refreshed(a)
    return refresh.refresh_memberships(screening.screen(previous, a.saved_searches, a.links), scored, ids, a.saved_searches, a.links)


# --- Search -----------------------------------------------------------------------------------------

_CARD = "id, title, city, price, priority_score"


@query("catalog_filter", ["scored"], f"""SELECT {_CARD} FROM scored WHERE availability NOT IN ({INACTIVE}) AND lower(city) = 'europe' AND property_type = 'residential'
  AND currency = 'EUR' AND price >= 100000 AND price <= 300000 AND surface >= 60 AND surface <= 250""")
def _(a: Archive):
    return catalog.catalog_filter(a.scored, city="Europe", type="residential", currency="EUR", min_price=100000, max_price=300000,
                                  min_surface=60, max_surface=250).select(*_CARD.split(", "))


@query("catalog_text_search", ["listings"], """SELECT id, title, address FROM listings WHERE contains(lower(coalesce(title, '')), 'via 1') OR contains(lower(coalesce(city, '')), 'via 1')
  OR contains(lower(coalesce(zone, '')), 'via 1') OR contains(lower(coalesce(address, '')), 'via 1') OR contains(lower(coalesce(listing_key, '')), 'via 1')""")
def _(a: Archive):
    return catalog.catalog_filter(a.listings, availability="all", q="Via 1").select("id", "title", "address")


@query("catalog_missing_field", ["listings"], f"SELECT id, review_status FROM listings WHERE availability NOT IN ({INACTIVE}) AND (condition IS NULL OR condition IN ('', 'unknown'))")
def _(a: Archive):
    return catalog.catalog_filter(a.listings, missing_field="condition").select("id", "review_status")


@query("catalog_starred", ["listings"], f"SELECT id, availability FROM listings WHERE availability = 'listed' AND starred AND lower(review_status) = 'new' AND source_id = 'S1'")
def _(a: Archive):
    return catalog.catalog_filter(a.listings, availability="listed", starred=True, status="new", source_id="S1").select("id", "availability")


_OPEN_STAGE = "review_status NOT IN ('acquired', 'discarded')"
for _name, _test in {"new": f"first_seen >= {NOW} - to_days(7)", "stale": f"last_seen < {NOW} - to_days(7)", "below": "discount >= 10", "unbenchmarked": "benchmark_id IS NULL",
                     "overdue": f"due_date < '2001-08-02' AND {_OPEN_STAGE}", "unassigned": f"owner_id IS NULL AND {_OPEN_STAGE}",
                     "portal": f"card_incomplete AND {_OPEN_STAGE}"}.items():
    @query("focus_" + _name, ["scored", "work"], f"SELECT id, city, priority_score FROM scored LEFT JOIN work ON id = property_id WHERE availability NOT IN ({INACTIVE}) AND {_test}")
    def _(a: Archive, name=_name):
        base = a.scored
        if name in ("overdue", "unassigned"):
            base = base.join(a.deal_work.select(F.col("property_id").alias("id"), "owner_id", "due_date"), "id", "left")
        return catalog.catalog_filter(base, as_of=AS_OF, focus=name).select("id", "city", "priority_score")


@query("reduced_semi", ["listings", "observations"], _REDUCED)
def _(a: Archive):
    return history.reduced_semi(a.listings, a.observations).select("id")


@query("strategy_semi", ["listings"], f"SELECT id FROM listings WHERE availability NOT IN ({INACTIVE}) AND {strategy_quote(TEXT, 'value_add')} IS NOT NULL")
def _(a: Archive):
    pairs = scoring.backfill_strategies(scoring.describe(a.listings))
    return catalog.catalog_filter(a.listings, strategy="value_add", strategies=pairs).select("id")


@query("agent_semi", ["screened"], "SELECT DISTINCT id FROM screened WHERE agent_id = 'A0' AND fit")
def _(a: Archive):
    return catalog.agent_semi(a.listings, a.memberships, "A0", qualified=True).select("id")


_SORT_SQL = {"score": "priority_score DESC, last_seen DESC, id", "price": "currency, price NULLS LAST, id", "latest": "last_seen DESC, id",
             "newest": "first_seen DESC, id", "listed": "first_seen, id", "quality": "completeness DESC, id", "due": "due_date NULLS LAST, id"}
for _key, _order in _SORT_SQL.items():
    @query("catalog_sort_" + _key, ["scored", "work"], f"SELECT id, city FROM scored LEFT JOIN work ON id = property_id ORDER BY {_order}")
    def _(a: Archive, key=_key):
        """All listings in this order."""
        base = a.scored
        if key == "due":
            base = base.join(a.deal_work.select(F.col("property_id").alias("id"), "due_date"), "id", "left")
        return catalog.catalog_sort(base, key).select("id", "city")


@query("catalog_page", ["scored"], f"""SELECT id, priority_score, (SELECT count(*) FROM scored WHERE availability NOT IN ({INACTIVE})) AS total, 3 AS page,
  CAST(ceil((SELECT count(*) FROM scored WHERE availability NOT IN ({INACTIVE})) / 20) AS BIGINT) AS pages
  FROM scored WHERE availability NOT IN ({INACTIVE}) ORDER BY priority_score DESC, last_seen DESC, id LIMIT 20 OFFSET 40""")
def _(a: Archive):
    return catalog.catalog_page(catalog.catalog_filter(a.scored), 3, 20).select("id", "priority_score", "total", "page", "pages")


@query("keyset_page", [], """SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' OR (ts = TIMESTAMP '2024-01-20 00:00:00' AND event_id < 0)
  ORDER BY ts DESC, event_id DESC LIMIT 41""")
def _(a: Archive):
    return catalog.keyset_page(a.table("events"), "ts", "event_id", 40, ("2024-01-20 00:00:00", 0)).select("event_id", "event_type")


@query("export_guard", ["listings"], f"SELECT id FROM listings WHERE availability = 'listed' AND lower(city) = 'asia' AND starred AND review_status = 'new'")
def _(a: Archive):
    rows = catalog.catalog_filter(a.listings, availability="listed", city="Asia", starred=True, status="new")
    return catalog.export_guard(rows, 1_000_000).select("id")


@query("select_by_ids", ["listings"], "SELECT id, title, CASE id WHEN 'L7' THEN 0 WHEN 'L3' THEN 1 ELSE 3 END AS pos FROM listings WHERE id IN ('L7', 'L3', 'L11')")
def _(a: Archive):
    return catalog.select_by_ids(a.listings, ["L7", "L3", "missing", "L11"]).select("id", "title", "pos")


@query("short_list", ["scored"], "SELECT id, score FROM scored WHERE lower(city) = 'africa' AND contains(lower(coalesce(address, '')) || '|' || lower(title), 'via 3') ORDER BY score DESC NULLS LAST, last_seen DESC, id")
def _(a: Archive):
    return catalog.short_list(a.scored, city="africa", q="via 3").select("id", "score")


@query("benchmark_catalog", ["benchmarks"], "SELECT id, city, zone, period, min_sqm, max_sqm FROM benchmarks WHERE condition = 'new' AND currency = 'EUR' AND (contains(lower(city), 'listino z1') OR contains(lower(zone), 'listino z1') OR contains(lower(source_label), 'listino z1'))")
def _(a: Archive):
    return catalog.benchmark_catalog(a.benchmarks, q="listino Z1", condition="new", currency="EUR").select("id", "city", "zone", "period", "min_sqm", "max_sqm")


@query("benchmark_series_count", ["benchmarks"], "SELECT currency, condition, count(*) AS n FROM benchmarks GROUP BY ALL")
def _(a: Archive):
    return a.benchmarks.groupBy("currency", "condition").agg(F.count(F.lit(1)).alias("n"))


# --- Joins with sources and work -----------------------------------------------------------------

@query("listing_source_work", ["listings", "sources", "work"], """
SELECT l.id, s.source_name, w.owner_id, w.due_date, coalesce(w.version, 0) AS work_version FROM listings l JOIN sources s ON l.source_id = s.source_id LEFT JOIN work w ON l.id = w.property_id""")
def _(a: Archive):
    return catalog.listing_source_work(a.listings, a.sources, a.deal_work).select("id", "source_name", "owner_id", "due_date", "work_version")


_BOARD = f"""SELECT l.id, review_status, priority_score, w.due_date, CASE WHEN w.owner_id IS NULL THEN '' ELSE coalesce(t.user_name, 'Responsabile non disponibile') END AS owner,
  {_OPEN_STAGE} AND coalesce(w.due_date < '2001-08-02', false) AS late FROM scored l LEFT JOIN work w ON l.id = w.property_id LEFT JOIN team t ON w.owner_id = t.user_id"""


@query("work_listing", ["scored", "work", "team"], f"SELECT id, owner, late, due_date FROM ({_BOARD})")
def _(a: Archive):
    return catalog.work_listing(a.listings, a.deal_work, a.users, AS_OF).select("id", "owner", "late", "due_date")


@query("pipeline_order", ["scored", "work", "team"], f"""SELECT id, review_status, late,
  row_number() OVER (ORDER BY {_OPEN_STAGE} DESC, late DESC, coalesce(due_date, '9999'), coalesce(priority_score, -1) DESC, id) AS position FROM ({_BOARD})""")
def _(a: Archive):
    return catalog.pipeline_order(catalog.work_listing(a.scored, a.deal_work, a.users, AS_OF)).select("id", "review_status", "late", "position")


@query("overdue_list", ["listings", "work", "team"], f"""SELECT id, title, city, due_date, user_name AS owner FROM listings JOIN work ON id = property_id LEFT JOIN team ON owner_id = user_id
  WHERE due_date < '2001-08-02' AND {_OPEN_STAGE} ORDER BY due_date, id LIMIT 20""")
def _(a: Archive):
    return catalog.overdue_list(a.listings, a.deal_work, a.users, AS_OF)


@query("due_for_refresh", ["listings", "sources"], f"""SELECT id FROM listings l JOIN sources s ON l.source_id = s.source_id WHERE availability NOT IN ({CLOSED})
  AND (availability = 'unknown' OR coalesce(city, '') = '' OR coalesce(price, 0) = 0 OR coalesce(surface, 0) = 0 OR last_detail_at IS NULL OR last_detail_at <= {NOW} - to_hours(refresh_hours))""")
def _(a: Archive):
    return catalog.due_for_refresh(a.listings, a.sources, AS_OF).select("id")


# --- History --------------------------------------------------------------------------------------

_LAG = "OVER (PARTITION BY property_id ORDER BY observed_at, observation_id)"
_CHAIN = f"""chain AS (SELECT *, lag(price) {_LAG} AS p_price, lag(currency) {_LAG} AS p_currency, lag(transaction_type) {_LAG} AS p_transaction,
  lag(area_basis) {_LAG} AS p_basis, lag(surface) {_LAG} AS p_surface FROM observations)"""
_CHANGES = f"""SELECT property_id, p_price AS previous_price, price, currency, {rnd('(p_price - price) / p_price * 100', 1)} AS reduction_pct, {ts('observed_at')} AS observed_at
  FROM (SELECT *, lag(price) {_LAG} AS p_price, lag(currency) {_LAG} AS p_currency, lag(transaction_type) {_LAG} AS p_transaction, lag(area_basis) {_LAG} AS p_basis,
          lag(surface) {_LAG} AS p_surface FROM observations WHERE observed_at >= {EVENTS_NOW} - to_days(90))
  WHERE currency = p_currency AND transaction_type = p_transaction AND area_basis = p_basis AND surface = p_surface AND {known('currency')} AND {known('area_basis')} AND {known('transaction_type')}
    AND observed_at >= {EVENTS_NOW} - to_days(30) AND price <> 0 AND p_price <> 0 AND price < p_price
  QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY observed_at DESC, observation_id DESC) = 1"""


@query("price_changes", ["observations"], _CHANGES)
def _(a: Archive):
    return history.price_changes(a.observations, EVENTS_AS_OF)


@query("top_reductions", ["observations"], f"SELECT property_id, reduction_pct FROM ({_CHANGES}) ORDER BY reduction_pct DESC, property_id LIMIT 20")
def _(a: Archive):
    return history.top_reductions(history.price_changes(a.observations, EVENTS_AS_OF)).select("property_id", "reduction_pct")


_COMPARABLE = "currency <> 'XXX' AND transaction_type IN ('sale', 'rent')"
_REDUCTIONS = f"""SELECT property_id, coalesce(reductions, 0) AS reductions, CASE WHEN current_price < highest THEN {rnd('(current_price / highest - 1) * 100', 1)} END AS total_pct,
  CASE WHEN current_price < highest THEN highest END AS from_price, last_drop_at
FROM (SELECT l.id AS property_id, l.price AS current_price, h.highest, s.reductions, s.last_drop_at FROM listings l
  LEFT JOIN (SELECT property_id, currency, transaction_type, max(price) AS highest FROM observations WHERE {_COMPARABLE} GROUP BY ALL) h
    ON l.id = h.property_id AND l.currency = h.currency AND l.transaction_type = h.transaction_type
  LEFT JOIN (SELECT property_id, count(*) FILTER (d) AS reductions, {ts('max(observed_at) FILTER (d)')} AS last_drop_at
    FROM (SELECT *, coalesce({_COMPARABLE} AND currency = lag(currency) {_LAG} AND transaction_type = lag(transaction_type) {_LAG} AND price < lag(price) {_LAG}, false) AS d FROM observations)
    GROUP BY 1) s ON l.id = s.property_id)"""


@query("price_reductions", ["listings", "observations"], _REDUCTIONS)
def _(a: Archive):
    return a.reductions


_FIELDS = {"title": "concat('Annuncio ', user_id)", "price": "price", "surface": "surface", "currency": "currency", "transaction_type": "transaction_type", "area_basis": "area_basis",
           "condition": "CASE WHEN n % 3 = 0 THEN 'good' ELSE 'new' END", "address": "CASE WHEN n % 5 <> 0 THEN concat('Via ', user_id % 40) END", "rooms": "n % 4",
           "bathrooms": "n % 2", "is_auction": "n % 11 = 0", "description": "event_type", "availability": "CASE WHEN n % 9 = 0 THEN 'review' ELSE 'listed' END"}
_OBS_PCT = f"""CASE WHEN has_fields AND p_has AND currency <> 'XXX' AND area_basis = 'commercial' AND price > 0 AND p_price > 0 AND currency = p_currency AND transaction_type = p_transaction
  AND surface = p_surface AND area_basis = p_basis THEN nullif({rnd('(price / p_price - 1) * 100', 1)}, 0) END"""


@query("observation_history", ["observations"], f"""
SELECT property_id, observation_id, {ts('observed_at')} AS observed_at, parser_version, p_id IS NULL AS baseline, has_fields AS has_evidence, has_fields AND coalesce(p_has, false) AS comparable,
  CASE WHEN has_fields AND coalesce(p_has, false) THEN {' + '.join(f'CAST(f_{f} IS DISTINCT FROM p_{f}_ AS INTEGER)' for f in _FIELDS)} ELSE 0 END AS n_changes,
  {_OBS_PCT} AS price_change_pct
FROM (SELECT *, lag(observation_id) {_LAG} AS p_id, lag(has_fields) {_LAG} AS p_has, lag(price) {_LAG} AS p_price, lag(currency) {_LAG} AS p_currency, lag(transaction_type) {_LAG} AS p_transaction,
        lag(area_basis) {_LAG} AS p_basis, lag(surface) {_LAG} AS p_surface, {', '.join(f'{e} AS f_{f}, lag({e}) {_LAG} AS p_{f}_' for f, e in _FIELDS.items())} FROM observations)""")
def _(a: Archive):
    return history.observation_history(a.observations).withColumn("n_changes", F.size("changes")).drop("changes")


@query("observed_price_change", ["observations"], f"""SELECT observation_id, {_OBS_PCT} AS price_change_pct
FROM (SELECT *, lag(has_fields) {_LAG} AS p_has, lag(price) {_LAG} AS p_price, lag(currency) {_LAG} AS p_currency, lag(transaction_type) {_LAG} AS p_transaction, lag(area_basis) {_LAG} AS p_basis,
        lag(surface) {_LAG} AS p_surface FROM observations)""")
def _(a: Archive):
    return history.with_previous(a.observations, ["fields"]).select("observation_id", history.observed_price_change().alias("price_change_pct"))


@query("history_price_delta", ["observations"], f"""SELECT observation_id, price, CASE WHEN {_COMPARABLE} AND currency = lag(currency) {_LAG} AND transaction_type = lag(transaction_type) {_LAG}
  THEN {rnd(f'price - lag(price) {_LAG}', 2)} END AS price_delta FROM observations""")
def _(a: Archive):
    return history.history_price_delta(a.observations).select("observation_id", "price", "price_delta")


@query("history_coverage", ["observations"], "SELECT property_id, count(*) AS total, count(*) FILTER (has_fields) AS with_fields FROM observations GROUP BY 1")
def _(a: Archive):
    return history.history_coverage(a.observations)


@query("history_page", ["observations"], f"""SELECT observation_id, {ts('observed_at')} AS observed_at FROM observations WHERE property_id = 'L7' AND (observed_at < TIMESTAMP '2024-01-25 00:00:00')
  ORDER BY observed_at DESC, observation_id DESC LIMIT 31""")
def _(a: Archive):
    return history.history_page(a.observations, "L7", ("2024-01-25 00:00:00", 0)).select("observation_id", "observed_at")


@query("observation_context_join", ["observations"], "SELECT observation_id, price, CASE WHEN has_fields THEN currency END AS currency, CASE WHEN has_fields THEN surface END AS surface FROM observations")
def _(a: Archive):
    context = a.observations.where("fields is not null").select("observation_id", "currency", "surface")
    return history.observation_context_join(a.observations.select("observation_id", "price"), context)


# --- Assets ---------------------------------------------------------------------------------------

@query("duplicate_candidates", ["pairs"], "SELECT * FROM pairs")
def _(a: Archive):
    return clusters.duplicate_candidates(a.listings)


@query("duplicate_links", ["offers"], """SELECT * FROM (WITH met AS (SELECT x.offer_id AS x, x.listings AS x_listings, x.surface AS x_surface,
    max((y.surface, y.source_id, y.offer_id, y.listings)) FILTER ((y.surface, y.source_id) < (x.surface, x.source_id)) AS low, min((y.surface, y.source_id, y.offer_id, y.listings)) FILTER ((y.surface, y.source_id) > (x.surface, x.source_id)) AS high
  FROM offers x JOIN offers y ON x.city_key = y.city_key AND x.address_key = y.address_key AND x.property_type = y.property_type AND x.source_id <> y.source_id GROUP BY ALL),
near AS (SELECT x, x_listings, x_surface, low AS n FROM met UNION ALL SELECT x, x_listings, x_surface, high FROM met)
SELECT DISTINCT least(x, n[3]) AS a, greatest(x, n[3]) AS b, CASE WHEN x < n[3] THEN x_listings ELSE n[4] END AS a_listings, CASE WHEN x < n[3] THEN n[4] ELSE x_listings END AS b_listings
FROM near WHERE n IS NOT NULL AND abs(x_surface - n[1]) / greatest(x_surface, n[1]) <= 0.03)""")
def _(a: Archive):
    return clusters.duplicate_links(a.listings)


@query("duplicate_groups", ["offers", "listings"], """SELECT * FROM (WITH RECURSIVE link AS (SELECT x.offer_id AS a, y.offer_id AS b FROM offers x JOIN offers y ON x.city_key = y.city_key AND x.address_key = y.address_key AND x.property_type = y.property_type
  AND x.source_id <> y.source_id AND abs(x.surface - y.surface) / greatest(x.surface, y.surface) <= 0.03),
reach AS (SELECT DISTINCT a AS node, a AS other FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a),
root AS (SELECT node, min(other) AS group_id FROM reach GROUP BY node)
SELECT l.id, o.offer_id, root.group_id FROM listings l JOIN offers o ON lower(replace(l.city, ' ', '')) = o.city_key AND lower(replace(l.address, ' ', '')) = o.address_key
  AND l.property_type = o.property_type AND l.source_id = o.source_id AND l.surface = o.surface JOIN root ON o.offer_id = root.node)""")
def _(a: Archive):
    return clusters.duplicate_groups(a.listings)


@query("duplicate_offers", ["listings", "offers"], """SELECT l.id, o.offer_id, o.listings AS offer_listings FROM listings l JOIN offers o
  ON lower(replace(l.city, ' ', '')) = o.city_key AND lower(replace(l.address, ' ', '')) = o.address_key AND l.property_type = o.property_type AND l.source_id = o.source_id AND l.surface = o.surface""")
def _(a: Archive):
    return clusters.duplicate_offers(a.listings).select("id", "offer_id", "offer_listings")


@query("asset_clusters", ["clusters"], "SELECT id, root FROM clusters")
def _(a: Archive):
    return a.clusters


@query("cluster_contradictions", ["contradictions"], "SELECT root, contradictions FROM contradictions")
def _(a: Archive):
    return a.contradictions


@query("cross_source_conflicts", ["conflicts"], "SELECT root, members, identity_conflict, availability_conflict, conflicts FROM conflicts")
def _(a: Archive):
    return a.conflicts


@query("cluster_cross_source", ["rooted", "conflicts", "sources"], f"""
SELECT r.root, r.id, s.source_name, r.url, r.price, r.currency, r.surface, r.area_basis, r.transaction_type, r.availability, r.condition, {ts('r.last_seen')} AS last_seen,
  r.contact_name, r.telephone, r.email, trim(regexp_extract({FACTS}, {quote('(?i)' + MANDATE_SENTENCE)})) AS mandate, c.members, c.conflicts
FROM rooted r JOIN conflicts c ON r.root = c.root LEFT JOIN sources s ON r.source_id = s.source_id WHERE r.clustered""")
def _(a: Archive):
    return clusters.cluster_cross_source(a.listings, a.clusters, a.conflicts, a.sources)


@query("latest_per_cluster", ["rooted"], "SELECT id, root FROM rooted QUALIFY row_number() OVER (PARTITION BY root ORDER BY last_seen DESC, id DESC) = 1")
def _(a: Archive):
    return clusters.latest_per_cluster(a.listings, a.clusters).select("id", "root")


# --- References -----------------------------------------------------------------------------------

@query("market_references", ["references_"], "SELECT * FROM references_")
def _(a: Archive):
    return a.references


@query("same_condition_comparables", ["asking", "met_same"], reference_sql("met_same", True))
def _(a: Archive):
    return market.market_references(a.listings, a.clusters, a.conflicts, a.sources, AS_OF, same_condition=True)


@query("market_comparables", ["met"], f"""SELECT id, comp_condition, comp_id, comp_sqm, comp_surface, comp_price, comp_source, {ts('comp_seen')} AS comp_seen, position FROM (
  SELECT *, row_number() OVER (PARTITION BY id, comp_condition ORDER BY comp_seen DESC, comp_id) AS position FROM met) WHERE position <= 12""")
def _(a: Archive):
    return market.market_comparables(a.listings, a.clusters, a.conflicts, a.sources, AS_OF)


@query("headroom", ["references_", "listings"], f"""SELECT r.id, key, {rnd(f'median_sqm - {rnd("price / surface", 2)}', 0)} AS gap_sqm, {rnd(f'(median_sqm - {rnd("price / surface", 2)}) * surface / 1000', 0)} * 1000 AS gap_total
  FROM references_ r JOIN listings l ON r.id = l.id WHERE key IN ('renovated', 'new') AND median_sqm IS NOT NULL AND {USABLE.replace('price', 'l.price').replace('surface', 'l.surface')}""")
def _(a: Archive):
    return market.headroom(a.references, a.listings)


_PIVOT = ", ".join(f"max({c}) FILTER (key = '{k}') AS {k}_{c}" for k in rules.REFERENCE_CONDITIONS for c in ("median_sqm", "n", "source_count"))


@query("signals", ["references_", "listings", "observations"], f"""
SELECT l.id, price_sqm, {', '.join(f"{k}_median_sqm, {k}_n, {rnd(f'(price_sqm / {k}_median_sqm - 1) * 100', 1)} AS {k}_delta_pct" for k in rules.REFERENCE_CONDITIONS)}, reductions, total_pct,
  kind, listed_basis, days_listed, has_phone, has_email
FROM (SELECT id, CASE WHEN {USABLE} THEN {SQM} END AS price_sqm, {route_kind(FACTS)} AS kind, CASE WHEN published_at < '2001-08-03' THEN 'published' ELSE 'first_seen' END AS listed_basis,
        CAST(floor(epoch({NOW} - CASE WHEN published_at < '2001-08-03' THEN CAST(published_at AS TIMESTAMP) ELSE first_seen END) / 86400) AS BIGINT) AS days_listed,
        telephone IS NOT NULL AS has_phone, email IS NOT NULL AS has_email FROM listings) l
JOIN (SELECT id, {_PIVOT} FROM references_ GROUP BY id) r ON l.id = r.id JOIN ({_REDUCTIONS}) p ON l.id = p.property_id""")
def _(a: Archive):
    out = signals.signals(a.listings, a.reductions, a.references, AS_OF)
    keep = [f"{k}_{c}" for k in rules.REFERENCE_CONDITIONS for c in ("median_sqm", "n", "delta_pct")]
    return out.select("id", "price_sqm", *keep, "reductions", "total_pct", "kind", "listed_basis", "days_listed", "has_phone", "has_email")
