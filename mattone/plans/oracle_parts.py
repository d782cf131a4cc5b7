"""Shared parts of the check queries: the listing archive and its derivations in plain SQL."""
from __future__ import annotations

from .. import rules
from .adapter import AS_OF, EVENTS_AS_OF, PHRASES

NOW = f"TIMESTAMP '{AS_OF}'"
EVENTS_NOW = f"TIMESTAMP '{EVENTS_AS_OF}'"


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)), {n}) AS DOUBLE)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(quote(v) for v in values)


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def hit(text: str, pattern: str) -> str:
    """Position of the first match, 0 if none."""
    m = f"regexp_extract({text}, {quote('(?i)' + pattern)})"
    return f"(CASE WHEN {m} = '' THEN 0 ELSE strpos({text}, {m}) END)"


def cut(text: str, start: str, stop: str) -> str:
    return f"substring({text}, greatest({start}, 1), greatest({stop} - greatest({start}, 1), 0))"


def strategy_quote(text: str, strategy: str) -> str:
    options = []
    for p in rules.STRATEGY_PATTERNS[strategy]:
        at, m = hit(text, p), f"length(regexp_extract({text}, {quote('(?i)' + p)}))"
        denied = f"regexp_matches(lower({cut(text, f'{at} - 45', at)}), {quote(rules.STRATEGY_NEGATION)})"
        options.append(f"CASE WHEN {at} > 0 AND NOT {denied} THEN trim({cut(text, f'{at} - 25', f'{at} + {m} + 85')}) END")
    return "coalesce(" + ", ".join(options) + ")"


def _phrase(k: str) -> str:
    return "[" + ", ".join(quote(p) for p in PHRASES) + f"][CAST({k} % 11 AS INTEGER) + 1]"


def months(period: str) -> str:
    y, h = f"CAST(substring({period}, 1, 4) AS INTEGER)", f"CAST(right({period}, 1) AS INTEGER)"
    return f"((year({NOW}) - {y}) * 12 + month({NOW}) - CASE WHEN {h} = 1 THEN 6 ELSE 12 END)"


def known(c: str) -> str:
    return f"({c} IS NOT NULL AND {c} NOT IN ('', 'unknown', 'XXX'))"


KEYS = rules.SEGMENT_KEYS
INACTIVE = words(rules.INACTIVE)
CLOSED = words(rules.CLOSED)
MISSING = {f: (f"{f} IS NULL" if f in ("price", "surface") else f"({f} IS NULL OR {f} IN ('', 'unknown'))") for f in rules.QUALITY_FIELDS}
COMPLETENESS = "CAST((10 - (" + " + ".join(f"CAST({m} AS INTEGER)" for m in MISSING.values()) + ")) * 10 AS BIGINT)"
SQM = rnd("price / surface", 2)
USABLE = "(price IS NOT NULL AND price <> 0 AND surface IS NOT NULL AND surface <> 0)"
DISCOUNT = "((1 - price / surface / ((benchmark_min + benchmark_max) / 2)) * 100)"
TEXT = "trim(concat(coalesce(title, ''), '. ', coalesce(description, '')))"
FACTS = "concat(coalesce(title, ''), chr(10), coalesce(description, ''))"
BAND = "CASE WHEN surface < 150 THEN '<150' WHEN surface < 500 THEN '150–499' WHEN surface < 1500 THEN '500–1499' ELSE '≥1500' END"

CTES: dict[str, tuple[list[str], str]] = {}

CTES["listings"] = ([], f"""
SELECT o_orderkey AS k, o_custkey AS cust, concat('L', o_orderkey) AS id, CAST(o_orderkey AS VARCHAR) AS listing_key,
  concat('S', o_custkey % 7) AS source_id, concat('https://s', o_custkey % 7, '.example/annunci/', o_orderkey) AS url,
  concat('Annuncio ', o_orderkey) AS title, CASE WHEN o_orderkey % 13 <> 0 THEN {_phrase('o_orderkey')} END AS description,
  r_name AS city, concat('Z', o_custkey % 3) AS zone, CASE WHEN o_orderkey % 9 <> 0 THEN concat('Via ', o_orderkey % 40) END AS address,
  CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'residential' WHEN c_mktsegment = 'MACHINERY' THEN 'logistics'
       WHEN c_mktsegment = 'AUTOMOBILE' THEN 'commercial' ELSE 'office' END AS property_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'to_renovate' WHEN '2-HIGH' THEN 'renovated' WHEN '3-MEDIUM' THEN 'new'
       WHEN '4-NOT SPECIFIED' THEN 'good' ELSE 'unknown' END AS condition,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 23 <> 0 THEN CAST(40 + (o_orderkey * 37) % 400 AS DOUBLE) END AS surface,
  CASE WHEN o_orderkey % 5 <= 2 THEN 'commercial' WHEN o_orderkey % 5 = 3 THEN 'net' ELSE 'unknown' END AS area_basis,
  CASE WHEN o_orderkey % 19 = 0 THEN 'USD' WHEN o_orderkey % 29 = 0 THEN 'XXX' ELSE 'EUR' END AS currency,
  CASE WHEN o_orderkey % 8 = 0 THEN 'rent' WHEN o_orderkey % 31 = 0 THEN 'unknown' ELSE 'sale' END AS transaction_type,
  CASE WHEN o_orderstatus IN ('O', 'P') THEN 'listed' WHEN o_orderkey % 4 = 0 THEN 'sold' WHEN o_orderkey % 4 = 1 THEN 'withdrawn' ELSE 'unknown' END AS availability,
  o_orderkey % 37 = 0 AS is_auction, o_orderkey % 10 = 0 AS starred,
  ['new', 'reviewing', 'shortlisted', 'due_diligence', 'negotiation', 'acquired', 'discarded'][CAST(o_orderkey % 7 AS INTEGER) + 1] AS review_status,
  CAST(o_orderkey % 6 + 1 AS DOUBLE) AS rooms, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS bathrooms,
  CASE WHEN o_orderkey % 21 <> 0 THEN 36 + CAST(o_orderkey * 7919 % 1200 AS DOUBLE) / 100 END AS latitude,
  CASE WHEN o_orderkey % 21 <> 0 THEN 6 + CAST(o_orderkey * 104729 % 1330 AS DOUBLE) / 100 END AS longitude,
  {NOW} - to_days(CAST(o_orderkey % 200 AS INTEGER)) AS last_seen,
  {NOW} - to_days(CAST(o_orderkey % 200 + o_orderkey % 300 AS INTEGER)) AS first_seen,
  CASE WHEN o_orderkey % 14 <> 0 THEN {NOW} - to_hours(o_orderkey % 72) END AS last_detail_at,
  CASE WHEN o_orderkey % 5 < 2 THEN strftime({NOW} - to_days(CAST(o_orderkey % 200 + o_orderkey % 300 + o_orderkey % 30 AS INTEGER)), '%Y-%m-%d')
       WHEN o_orderkey % 5 = 2 THEN '2099-01-01' END AS published_at,
  CASE WHEN o_orderkey % 6 <> 0 THEN concat('+3902', lpad(CAST(o_custkey % 50 AS VARCHAR), 6, '0')) END AS telephone,
  CASE WHEN o_orderkey % 4 <> 0 THEN concat('agente', o_custkey % 80, '@casa.example') END AS email,
  CASE WHEN o_orderkey % 12 <> 0 THEN concat('Agente ', o_custkey % 80) END AS contact_name,
  o_orderkey % 24 = 5 AS card_incomplete, o_orderkey % 12 = 5 AND o_orderkey % 36 = 5 AS card_drop, o_totalprice * 1.25 AS card_old_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

_W = "(ascii(city) + 5 * ascii(condition) + 11 * length(property_type) + 3 * ascii(substring(zone, 2, 1)) + 7 * length(area_basis))"
CTES["benchmarks"] = (["listings"], f"""
SELECT s.*, CAST(800 + 10 * ({_W} % 97) + CASE WHEN period = '1999-S1' THEN -100 ELSE 0 END AS DOUBLE) AS min_sqm,
  CAST(800 + 10 * ({_W} % 97) + CASE WHEN period = '1999-S1' THEN -100 ELSE 0 END AS DOUBLE) * 1.25 AS max_sqm,
  concat('Listino ', zone) AS source_label, concat_ws('-', {', '.join(KEYS)}, period) AS id
FROM (SELECT *, unnest(CASE WHEN city = 'ASIA' THEN [CASE WHEN zone = 'Z2' THEN '1999-S2' ELSE '2001-S1' END, '1999-S1', '2003-S1']
                            ELSE [CASE WHEN zone = 'Z2' THEN '1999-S2' ELSE '2001-S1' END, '1999-S1'] END) AS period
      FROM (SELECT DISTINCT {', '.join(KEYS)} FROM listings WHERE {' AND '.join(f"{k} NOT IN ('unknown', 'XXX')" for k in KEYS)})) s""")

CTES["latest_benchmarks"] = (["benchmarks"], f"""
SELECT * FROM benchmarks QUALIFY row_number() OVER (PARTITION BY {', '.join(f'lower({k})' for k in KEYS)} ORDER BY period DESC, id) = 1""")

_UNKNOWN = " OR ".join(f"coalesce(l.{k} IN ('', 'unknown'), true)" for k in KEYS)
_ON = " AND ".join(f"lower(l.{k}) = lower(b.{k})" for k in KEYS)
CTES["matched"] = (["listings", "latest_benchmarks"], f"""
SELECT *, CASE WHEN benchmark_note = '' THEN _bid END AS benchmark_id, CASE WHEN benchmark_note = '' THEN _bmin END AS benchmark_min,
  CASE WHEN benchmark_note = '' THEN _bmax END AS benchmark_max, CASE WHEN benchmark_note = '' THEN _bper END AS benchmark_period
FROM (SELECT l.*, b.id AS _bid, b.min_sqm AS _bmin, b.max_sqm AS _bmax, b.period AS _bper,
  CASE WHEN {_UNKNOWN} THEN 'insufficient' WHEN b.period IS NULL THEN 'no_match'
       WHEN CAST(substring(b.period, 1, 4) AS INTEGER) * 2 + CAST(right(b.period, 1) AS INTEGER) > year({NOW}) * 2 + CASE WHEN month({NOW}) <= 6 THEN 1 ELSE 2 END THEN 'future_period'
       WHEN {months('b.period')} > {rules.BENCHMARK_MONTHS} THEN 'too_old' ELSE '' END AS benchmark_note
  FROM listings l LEFT JOIN latest_benchmarks b ON {_ON})""")

_STRATS = " + ".join(f"CAST({strategy_quote(TEXT, s)} IS NOT NULL AS INTEGER)" for s in rules.STRATEGIES)
_ECON_USABLE = f"(benchmark_id IS NOT NULL AND {USABLE})"
CTES["described"] = (["matched"], f"""
SELECT *, CASE WHEN {USABLE} THEN {SQM} END AS price_sqm, {COMPLETENESS} AS completeness, {_STRATS} AS n_strategies FROM matched""")
CTES["scored"] = (["described"], f"""
SELECT *, CASE WHEN u AND live_score THEN {rnd(DISCOUNT, 2)} END AS discount,
  CASE WHEN u AND live_score THEN CAST({rnd('greatest(0.0, least(70.0, 35 + ' + DISCOUNT + ' * 1.4)) + least(30, 15 * n_strategies)', 0)} AS BIGINT) END AS score,
  CASE WHEN availability IN ({INACTIVE}) THEN 0 ELSE CAST({rnd(f"{rnd('completeness * 0.3', 1)} + CASE WHEN availability = 'listed' THEN 10 ELSE 0 END + CASE WHEN u THEN {rnd('greatest(0.0, least(40.0, 20 + ' + DISCOUNT + ' * 0.8))', 1)} ELSE 0 END + least(10, 5 * n_strategies)", 0)} AS BIGINT) END AS priority_score
FROM (SELECT *, {_ECON_USABLE} AS u, availability NOT IN ({CLOSED}) AS live_score FROM described)""")

CTES["observations"] = ([], """
SELECT event_id AS observation_id, concat('L', user_id) AS property_id, ts AS observed_at, value * 1000 AS price,
  CASE WHEN event_type = 'error' THEN 'XXX' ELSE 'EUR' END AS currency, CASE WHEN event_type = 'signup' THEN 'rent' ELSE 'sale' END AS transaction_type,
  CASE WHEN n % 7 = 0 THEN 'unknown' ELSE 'commercial' END AS area_basis, CAST(50 + 10 * (n % 2) AS DOUBLE) AS surface,
  concat('v', event_id % 3) AS parser_version, event_id % 10 <> 0 AS has_fields, n, event_type, user_id
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS n FROM events)""")

CTES["offers"] = (["listings"], """
SELECT lower(regexp_replace(city, '[^\\w]', '', 'g')) AS city_key, lower(regexp_replace(address, '[^\\w]', '', 'g')) AS address_key, property_type, source_id,
  surface, min(id) AS offer_id, count(*) AS listings FROM listings WHERE coalesce(address, '') <> '' AND surface > 0 GROUP BY ALL""")
CTES["pairs"] = (["offers"], """
SELECT x.offer_id AS a, y.offer_id AS b, x.listings AS a_listings, y.listings AS b_listings, x.listings * y.listings AS listing_pairs
FROM offers x JOIN offers y ON x.city_key = y.city_key AND x.address_key = y.address_key AND x.property_type = y.property_type
WHERE x.source_id <> y.source_id AND x.offer_id < y.offer_id AND abs(x.surface - y.surface) / greatest(x.surface, y.surface) <= 0.03""")
CTES["reviews"] = (["pairs"], """
SELECT a, b, CASE (CAST(substring(a, 2) AS BIGINT) + CAST(substring(b, 2) AS BIGINT)) % 3 WHEN 0 THEN 'same_asset' ELSE 'distinct' END AS decision
FROM pairs WHERE (CAST(substring(a, 2) AS BIGINT) + CAST(substring(b, 2) AS BIGINT)) % 3 < 2""")
CTES["edges"] = (["reviews"], """
SELECT a AS u, b AS v FROM reviews WHERE decision = 'same_asset' UNION SELECT b, a FROM reviews WHERE decision = 'same_asset'""")
CTES["reach"] = (["edges"], """
SELECT DISTINCT u AS node, u AS other FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u""")
CTES["clusters"] = (["reach"], "SELECT node AS id, min(other) AS root FROM reach GROUP BY node")
CTES["rooted"] = (["listings", "clusters"], """
SELECT l.*, coalesce(c.root, l.id) AS root, c.root IS NOT NULL AS clustered FROM listings l LEFT JOIN clusters c ON l.id = c.id""")
CTES["contradictions"] = (["reviews", "clusters"], """
SELECT x.root, count(*) AS contradictions FROM reviews r JOIN clusters x ON r.a = x.id JOIN clusters y ON r.b = y.id
WHERE r.decision = 'distinct' AND x.root = y.root GROUP BY x.root""")


def _differs(field: str, context: list[str], words_too: bool) -> str:
    usable = f"{field} IS NOT NULL" + (f" AND {field} NOT IN ('unknown', 'XXX', 'review')" if words_too else "")
    usable += "".join(f" AND {c} IS NOT NULL AND {c} NOT IN ('unknown', 'XXX')" for c in context)
    group = ", ".join(["root", *context])
    return f"SELECT root, '{field}' AS field FROM members WHERE {usable} GROUP BY {group} HAVING count(DISTINCT {field}) > 1"


CTES["members"] = (["rooted"], "SELECT * FROM rooted WHERE clustered")
CTES["conflicts"] = (["members", "contradictions"], f"""
SELECT m.root, m.members, c.root IS NOT NULL AS identity_conflict, coalesce(a, false) AS availability_conflict,
  concat_ws('; ', CASE WHEN c.root IS NOT NULL THEN 'Collegamenti tra annunci da rivedere' END, CASE WHEN p THEN 'Prezzi richiesti diversi' END,
    CASE WHEN s THEN 'Superfici diverse' END, CASE WHEN a THEN 'Disponibilità discordante' END, CASE WHEN k THEN 'Stati manutentivi diversi' END) AS conflicts
FROM (SELECT root, count(*) AS members FROM members GROUP BY root) m LEFT JOIN contradictions c ON m.root = c.root
LEFT JOIN (SELECT root, bool_or(field = 'price') AS p, bool_or(field = 'surface') AS s, bool_or(field = 'availability') AS a, bool_or(field = 'condition') AS k
  FROM ({_differs('price', ['currency', 'transaction_type'], False)} UNION ALL {_differs('surface', ['area_basis'], False)}
        UNION ALL {_differs('availability', [], True)} UNION ALL {_differs('condition', [], True)}) GROUP BY root) f ON m.root = f.root""")

CTES["sources"] = ([], """
SELECT concat('S', n) AS source_id, concat('Fonte ', n) AS source_name, CASE WHEN n = 6 THEN 's5.example' ELSE concat('s', n, '.example') END AS domain,
  n <> 3 AS enabled, CASE WHEN n = 2 THEN 'blocked' ELSE 'healthy' END AS status, CASE WHEN n = 4 THEN 900 ELSE 24 + 12 * n END AS refresh_hours,
  CASE WHEN n = 0 THEN 'import' ELSE 'html' END AS kind FROM (SELECT DISTINCT o_custkey % 7 AS n FROM orders)""")
CTES["work"] = ([], """
SELECT concat('L', o_orderkey) AS property_id, CASE WHEN o_orderkey % 5 <> 0 THEN concat('U', o_orderkey % 4) END AS owner_id,
  CASE WHEN o_orderkey % 4 <> 0 THEN strftime(DATE '2001-07-20' + CAST(o_orderkey % 40 AS INTEGER), '%Y-%m-%d') END AS due_date, o_orderkey % 3 AS version
FROM orders WHERE o_orderstatus <> 'F'""")
CTES["team"] = (["work"], "SELECT DISTINCT owner_id AS user_id, concat('Persona ', owner_id) AS user_name FROM work WHERE owner_id IS NOT NULL")
CTES["actions"] = ([], """
SELECT event_id AS action_id, concat('L', user_id * 7 + event_id % 7) AS property_id,
  CASE WHEN event_type = 'click' THEN 'reached' WHEN event_type = 'view' THEN 'no_answer' WHEN event_id % 5 = 0 THEN 'not_relevant' ELSE 'documents_requested' END AS outcome,
  CASE WHEN event_id % 3 = 0 THEN 'confirmed_by_team' WHEN event_id % 3 = 1 THEN 'declared' ELSE 'not_checked' END AS mandate_status,
  CASE WHEN event_type IN ('click', 'view') AND event_id % 4 <> 0 THEN strftime(DATE '2001-07-20' + CAST(event_id % 28 AS INTEGER), '%Y-%m-%d') END AS next_contact,
  concat('U', event_id % 4) AS user_id, ts AS created_at FROM events WHERE event_type IN ('click', 'view', 'purchase')""")
CTES["last_action"] = (["actions"], "SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC, action_id DESC) = 1")
CTES["searches"] = ([], """
SELECT concat('A', r_regionkey * 2 + CASE WHEN wide THEN 0 ELSE 1 END) AS agent_id, concat(CASE WHEN wide THEN 'Ampia ' ELSE 'Mirata ' END, r_name) AS agent_name,
  r_name AS agent_city, r_regionkey <> 4 AS active, CASE WHEN wide THEN 0.0 ELSE 100000.0 END AS min_price, CASE WHEN wide THEN 400000.0 ELSE 300000.0 END AS max_price,
  CASE WHEN wide THEN 0.0 ELSE 60.0 END AS min_surface, CASE WHEN NOT wide THEN 300.0 END AS max_surface, NOT wide AS typed,
  NOT wide AND r_regionkey % 2 = 0 AS wants_strategy, NOT wide AND r_regionkey = 1 AS opportunity_only, NOT wide AND r_regionkey = 3 AS direct_only,
  CASE WHEN NOT wide AND r_regionkey = 2 THEN 5.0 END AS min_discount, wide AS include_auctions,
  CASE WHEN NOT wide THEN concat('via ', r_regionkey + 1) ELSE '' END AS location_query
FROM (SELECT *, unnest([true, false]) AS wide FROM region)""")
CTES["runs"] = ([], """
SELECT concat('R', strftime(date_trunc('hour', ts), '%Y%m%d%H')) AS run_id, min(ts) AS created_at, max(ts) AS finished_at, concat('A', min(event_id) % 10) AS agent_id
FROM events GROUP BY date_trunc('hour', ts)""")
CTES["run_events"] = ([], """
SELECT concat('R', strftime(ts, '%Y%m%d%H')) AS run_id, event_id, ts, concat('S', user_id % 7) AS source_id, concat('L', user_id) AS property_id,
  CASE event_type WHEN 'error' THEN 'source' WHEN 'view' THEN 'discovery' ELSE 'acquire' END AS step,
  CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'error' ELSE 'info' END AS level, event_type = 'signup' AS is_new, event_type = 'purchase' AS is_changed,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS items FROM events""")
CTES["texts"] = ([], f"""
SELECT doc_id, concat('L', doc_id) AS id, concat('Annuncio ', doc_id) AS title, concat(text, '. ', {_phrase('doc_id')}) AS description FROM documents""")

MANDATE_SENTENCE = r"[^.!?\n]{0,70}(?:" + rules.MANDATE_CORE + r")[^.!?\n]{0,100}"
OWNER, MANDATE = rules.OWNER_ROUTE, rules.MANDATE_ROUTE


def route_kind(text: str) -> str:
    """Route of texts that hold at most one declaration of each kind."""
    def found(pattern):
        at, m = hit(text, pattern), f"length(regexp_extract({text}, {quote('(?i)' + pattern)}))"
        before = f"regexp_matches({cut(text, f'{at} - 80', at)}, {quote('(?i)' + rules.ROUTE_NEGATION_BEFORE)})"
        after = f"regexp_matches(substring({text}, {at} + {m}, 80), {quote('(?i)' + rules.ROUTE_NEGATION_AFTER)})"
        return f"({at} > 0 AND NOT {before} AND NOT {after})"
    o, m = found(OWNER), found(MANDATE)
    return f"CASE WHEN {o} AND {m} THEN 'unknown' WHEN {o} THEN 'owner_declared' WHEN {m} THEN 'mandate_declared' ELSE 'unknown' END"


def located(field: str) -> str:
    return f"coalesce(regexp_matches(lower({field}), concat('(^|[^a-z0-9_])', replace(s.location_query, ' ', '[^a-z0-9]+'), '($|[^a-z0-9_])')), false)"


_REASONS = [
    ("Annuncio non più attivo", f"availability IN ({INACTIVE})"),
    ("Comune diverso dalla ricerca", "lower(city) <> lower(agent_city)"),
    ("Zona o indirizzo richiesto non documentato nell’annuncio", f"s.location_query <> '' AND NOT ({located('zone')} OR {located('address')} OR {located('title')})"),
    ("Non risulta una compravendita", "transaction_type <> 'sale'"), ("Valuta non EUR", "currency <> 'EUR'"), ("Prezzo assente", "price IS NULL"),
    ("Prezzo sotto il budget minimo", "price < min_price"), ("Prezzo sopra il budget", "price >= min_price AND price > max_price"),
    ("Superficie assente", "surface IS NULL"), ("Superficie sotto la soglia", "surface < min_surface"), ("Superficie sopra la soglia", "surface > max_surface"),
    ("Tipologia fuori ricerca", "typed AND property_type NOT IN ('residential', 'office')"), ("Aste escluse", "NOT include_auctions AND is_auction"),
    ("Vantaggio di prezzo non documentato sul benchmark", "opportunity_only AND (discount IS NULL OR discount <= 0)"),
    ("Contatto diretto con recapito non documentato", "direct_only AND (route = 'unknown' OR (telephone IS NULL AND email IS NULL))"),
    ("Confronto di prezzo non disponibile", "min_discount IS NOT NULL AND discount IS NULL"), ("Sconto inferiore alla soglia", "discount < min_discount"),
    ("Nessuna strategia richiesta supportata dal testo", "wants_strategy AND NOT wanted_found"),
]
_WANTED = f"({strategy_quote(TEXT, 'value_add')} IS NOT NULL OR {strategy_quote(TEXT, 'core_plus')} IS NOT NULL)"
CTES["screened"] = (["scored", "searches"], f"""
SELECT agent_id, id, agent_name, reasons = '' AS fit, reasons, score FROM (
  SELECT agent_id, agent_name, id, score, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN {quote(r)} END" for r, c in _REASONS)}) AS reasons
  FROM (SELECT *, {route_kind(FACTS)} AS route, {_WANTED} AS wanted_found FROM scored) JOIN searches s ON lower(city) = lower(agent_city) WHERE active)""")

_REF = rules.REFERENCE_KEYS
CTES["asking"] = (["rooted"], f"""
SELECT id, root, concat_ws('|', {', '.join(f'lower({k})' for k in _REF)}) AS seg, surface, price, condition, transaction_type, is_auction,
  concat_ws(', ', {', '.join(f"CASE WHEN NOT {known(k) if k != 'area_basis' else "(area_basis <> '')"} THEN {quote(n)} END" for k, n in zip(_REF, ['comune', 'zona', 'tipologia', 'tipo di superficie', 'valuta', 'vendita o affitto']))},
    CASE WHEN coalesce(surface, 0) = 0 THEN 'superficie' END) AS gaps FROM rooted""")
CTES["pool_all"] = (["rooted", "conflicts", "sources"], f"""
SELECT r.id AS comp_id, r.root AS comp_root, concat_ws('|', {', '.join(f'lower(r.{k})' for k in _REF)}) AS comp_seg, r.condition AS comp_condition, r.surface AS comp_surface,
  r.price AS comp_price, {rnd('r.price / r.surface', 2)} AS comp_sqm, r.last_seen AS comp_seen, r.source_id AS comp_source, coalesce(nullif(s.domain, ''), r.source_id) AS comp_origin
FROM rooted r LEFT JOIN sources s ON r.source_id = s.source_id
WHERE NOT r.is_auction AND r.availability = 'listed' AND r.price > 0 AND r.surface > 0 AND r.last_seen >= {NOW} - to_days(90) AND r.last_seen <= {NOW}
  AND r.root NOT IN (SELECT root FROM conflicts WHERE conflicts <> '')""")
CTES["pool"] = (["pool_all"], """
SELECT * FROM pool_all WHERE comp_condition IN ('to_renovate', 'renovated', 'new')
QUALIFY row_number() OVER (PARTITION BY comp_root, comp_seg ORDER BY comp_seen DESC, comp_id) = 1""")
CTES["pool_same"] = (["pool_all"], """
SELECT p.* FROM pool_all p WHERE NOT EXISTS (SELECT 1 FROM pool_all q WHERE q.comp_root = p.comp_root AND q.comp_seg = p.comp_seg AND q.comp_condition = p.comp_condition
  AND (q.comp_seen > p.comp_seen OR (q.comp_seen = p.comp_seen AND q.comp_id < p.comp_id)))""")
_NEAR = "a.seg = p.comp_seg AND p.comp_surface >= a.surface * 0.7 AND p.comp_surface <= a.surface * 1.3 AND p.comp_root <> a.root"
CTES["met"] = (["asking", "pool"], f"SELECT a.id, p.* FROM asking a JOIN pool p ON {_NEAR} WHERE a.gaps = '' AND a.transaction_type = 'sale'")
CTES["met_same"] = (["asking", "pool_same"], f"""
SELECT a.id, p.* FROM asking a JOIN pool_same p ON {_NEAR} AND p.comp_condition = a.condition
WHERE a.gaps = '' AND a.condition NOT IN ('', 'unknown') AND NOT a.is_auction""")


def reference_sql(met: str, same: bool) -> str:
    key = "a.condition" if same else "unnest(['to_renovate', 'renovated', 'new'])"
    refusal = ("CASE WHEN gaps <> '' OR condition IN ('', 'unknown') THEN concat('Dati mancanti: ', concat_ws(', ', nullif(gaps, ''), CASE WHEN condition IN ('', 'unknown') THEN 'stato manutentivo' END)) "
               "WHEN is_auction THEN 'Per le aste serve un confronto dedicato' END") if same else \
        "CASE WHEN gaps <> '' THEN concat('Dati mancanti: ', gaps) WHEN transaction_type <> 'sale' THEN 'Solo compravendite' END"
    return f"""
SELECT id, key, n, {', '.join(f"CASE WHEN n >= 3 THEN {rnd(c, 2)} END AS {c}_sqm" for c in ('median', 'min', 'max', 'q1', 'q3'))}, spread_pct, source_count,
  {ts('oldest')} AS oldest_observed, {ts('newest')} AS newest_observed,
  CASE WHEN n >= 3 AND coalesce(price, 0) <> 0 AND condition = key THEN {rnd('(price / surface / median - 1) * 100', 1)} END AS asking_delta_pct,
  concat_ws('; ', CASE WHEN n > 0 AND source_count = 1 THEN 'Una sola fonte nel campione' END,
    CASE WHEN spread_pct > 50 THEN 'Prezzi molto dispersi: confronta i singoli annunci' END, CASE WHEN n > 12 THEN 'Mostrati i primi 12 asset del campione' END) AS warnings,
  coalesce({refusal}, CASE WHEN n < 3 THEN 'Servono almeno 3 asset confrontabili' ELSE 'Prezzi richiesti osservati' END) AS reason
FROM (SELECT g.*, coalesce(m.n, 0) AS n, coalesce(m.source_count, 0) AS source_count, m.median, m.min, m.max, m.q1, m.q3, m.oldest, m.newest,
        CASE WHEN m.n >= 3 THEN {rnd('(m.max - m.min) / m.median * 100', 1)} END AS spread_pct
      FROM (SELECT a.*, {key} AS key FROM asking a) g
      LEFT JOIN (SELECT id, comp_condition, count(*) AS n, count(DISTINCT comp_origin) AS source_count, quantile_cont(comp_sqm, 0.5) AS median, min(comp_sqm) AS min,
          max(comp_sqm) AS max, quantile_cont(comp_sqm, 0.25) AS q1, quantile_cont(comp_sqm, 0.75) AS q3, min(comp_seen) AS oldest, max(comp_seen) AS newest
        FROM {met} GROUP BY id, comp_condition) m ON g.id = m.id AND g.key = m.comp_condition)"""


CTES["references_"] = (["asking", "met"], reference_sql("met", False))


def with_parts(parts: list[str], body: str) -> str:
    """A statement with the parts it needs, in dependency order."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for p in parts:
        visit(p)
    if not order:
        return body
    recursive = "RECURSIVE " if "reach" in order else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body
