"""Listings against saved searches: rule results with every reason, on linked pairs only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expr import all_of, any_of, inactive, labels
from ..session import cut_lineage, over_tasks


def agent_city_link(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Listing and active search of the same city: the pairs that are screened."""
    active = searches.where("active").select("agent_id", F.lower("agent_city").alias("_city"))
    return listings.select("id", F.lower("city").alias("_city")).join(active, "_city").select("id", "agent_id")


def _unreached() -> Column:
    """No direct contact is documented: the text names none, or there is no telephone and no address."""
    text = F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("\n"), F.coalesce(F.col("description"), F.lit("")))
    reachable = (F.coalesce(F.col("telephone"), F.lit("")) != "") | (F.coalesce(F.col("email"), F.lit("")) != "")
    return (T.contact_route(text)["kind"] == "unknown") | ~reachable


def _rules(city: Column, wanted_city: Column, pattern: Column, unreached: Column) -> list[tuple[str, Column]]:
    """Every rule but the criteria of the search's own: its label, and where the listing breaks it."""
    c = F.col
    located = F.lit(False)
    for field in ("zone", "address", "title"):
        located = located | F.coalesce(F.regexp_like(F.lower(c(field)), pattern), F.lit(False))
    return [
        ("Annuncio non più attivo", inactive()),
        ("Comune diverso dalla ricerca", F.coalesce(city, F.lit("")) != wanted_city),
        ("Zona o indirizzo richiesto non documentato nell’annuncio", (c("location_query") != "") & ~located),
        ("Non risulta una compravendita", ~c("transaction_type").eqNullSafe(F.lit("sale"))),
        ("Valuta non EUR", ~c("currency").eqNullSafe(F.lit("EUR"))),
        ("Prezzo assente", c("price").isNull()),
        ("Prezzo sotto il budget minimo", c("price") < c("min_price")),
        ("Prezzo sopra il budget", (c("price") >= c("min_price")) & (c("price") > c("max_price"))),
        ("Superficie assente", c("surface").isNull()),
        ("Superficie sotto la soglia", c("surface") < c("min_surface")),
        ("Superficie sopra la soglia", (c("max_surface") != 0) & (c("surface") > c("max_surface"))),  # 0 is no bound
        ("Tipologia fuori ricerca", (F.size("property_types") > 0) & ~F.array_contains("property_types", c("property_type"))),
        ("Aste escluse", ~c("include_auctions") & c("is_auction")),
        ("Vantaggio di prezzo non documentato sul benchmark", c("opportunity_only") & (c("discount").isNull() | (c("discount") <= 0))),
        ("Contatto diretto con recapito non documentato", (c("contact_policy") == "require_direct") & unreached),
        ("Confronto di prezzo non disponibile", c("min_discount").isNotNull() & c("discount").isNull()),
        ("Sconto inferiore alla soglia", c("discount") < c("min_discount")),
        ("Nessuna strategia richiesta supportata dal testo",
         (F.size("wanted_strategies") > 0) & ~F.arrays_overlap("wanted_strategies", c("strategies.strategy"))),
    ]


def rule_reasons() -> Column:
    """Every rule of the search that the listing breaks, in report order."""
    c = F.col
    check = c("check_status")
    return labels([
        ("Criteri personalizzati: verifica AI da eseguire", (c("custom_prompt") != "") & check.isNull()),
        (F.concat(F.when(check == "not_matched", "Criteri personalizzati non soddisfatti: ").otherwise("Criteri personalizzati da verificare: "),
                  F.coalesce(c("check_reason"), F.lit(""))), (c("custom_prompt") != "") & (check != "matched")),
        *_rules(F.lower("city"), F.lower("agent_city"), T.location_pattern(c("location_query")), _unreached()),
    ])


def _asked() -> list:
    """What a search asks, beside its city."""
    return ["min_price", "max_price", "min_surface", "max_surface", "property_types", F.col("strategies").alias("wanted_strategies"), "opportunity_only", "contact_policy",
            "min_discount", "include_auctions", "location_query", "custom_prompt"]


def screen(scored: DataFrame, searches: DataFrame, links: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Fit and reasons of every linked listing and search.

    ``links`` names the pairs, so the work follows the links and not the product of both
    sides. ``checks`` holds criteria results: id, prompt_key, content_hash, status, reason.
    """
    s = searches.select("agent_id", "agent_name", "agent_city", *_asked())
    rows = scored.join(links, "id").join(s, "agent_id")
    if checks is not None:
        key = F.when(F.col("custom_prompt") != "", T.prompt_key(F.col("custom_prompt")))
        c = checks.select("id", "prompt_key", "content_hash", F.col("status").alias("check_status"), F.col("reason").alias("check_reason"))
        rows = rows.withColumn("prompt_key", key).join(c, ["id", "prompt_key", "content_hash"], "left")
    else:
        rows = rows.withColumn("check_status", F.lit(None).cast("string")).withColumn("check_reason", F.lit(None).cast("string"))
    out = rows.withColumn("reasons", rule_reasons())
    return out.select("agent_id", "id", (F.size("reasons") == 0).alias("fit"), "reasons", "score")


#: Amounts and surfaces are filed in half-octave cells 0 to 63, and these in blocks of 1, 2, 4 … 64 cells.
_LEVELS = 7
_LAST = 63


def _cell(value: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest(value, F.lit(1.0))) * 2), F.lit(0)), F.lit(_LAST)).cast("int")


def _blocks_of(value: Column) -> Column:
    """The block of each level that a value lies in, as one number per level."""
    return F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), lambda level: level * 64 + F.call_function("shiftright", _cell(value), level))


def _cover(low: Column, high: Column) -> Column:
    """The few disjoint blocks that make up the cells of an interval."""
    first, last = _cell(low), F.when(high.isNull(), _LAST).otherwise(_cell(high))

    def sides(level):
        size = F.call_function("shiftleft", F.lit(1), level)
        a, b = F.call_function("shiftright", first + size - 1, level), F.call_function("shiftright", last + 1, level) - 1
        # A block at either end that the block above it would exceed.
        left, right = F.when((a <= b) & (a % 2 == 1), level * 64 + a), F.when((a <= b) & (b % 2 == 0), level * 64 + b)
        return F.array_distinct(F.array(left, right))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), sides)))


def interval_links(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """(id, agent_id): open sales in euro and the active searches whose city, price and surface intervals hold them.

    A predicate index: each search is filed under its city and the blocks that cover its intervals (at most a dozen each); a listing
    fetches from the blocks it lies in, seven by seven. A pair meets at most once, and only if both intervals hold the listing's cells,
    so the work follows the listings and the pairs that fit, not the product with all searches of a city.
    """
    top = F.when(F.coalesce("max_surface", F.lit(0.0)) != 0, F.col("max_surface"))
    filed = searches.where("active").select(
        "agent_id", F.lower("agent_city").alias("city"), "min_price", "max_price", "min_surface", top.alias("max_surface"),
        F.explode(_cover(F.col("min_price"), F.col("max_price"))).alias("price_block"), F.col("min_surface").alias("_low"), top.alias("_high"))
    filed = filed.withColumn("surface_block", F.explode(_cover(F.col("_low"), F.col("_high")))).drop("_low", "_high")
    open_ = listings.where(~inactive() & (F.col("transaction_type") == "sale") & (F.col("currency") == "EUR") & F.col("price").isNotNull() & F.col("surface").isNotNull())
    asked = (open_.select("id", F.lower("city").alias("city"), "price", "surface", F.explode(_blocks_of(F.col("price"))).alias("price_block"))
             .withColumn("surface_block", F.explode(_blocks_of(F.col("surface")))))
    met = asked.join(filed, ["city", "price_block", "surface_block"])
    return met.where((F.col("price") >= F.col("min_price")) & (F.col("max_price").isNull() | (F.col("price") <= F.col("max_price"))) & (F.col("surface") >= F.col("min_surface"))
                     & (F.col("max_surface").isNull() | (F.col("surface") <= F.col("max_surface")))).select("id", "agent_id")


def _bits(conditions: list[Column]) -> Column:
    """The conditions that hold as the bits of one number."""
    return sum((F.when(F.coalesce(holds, F.lit(False)), 1 << i).otherwise(0) for i, holds in enumerate(conditions)), F.lit(0))


#: Listings of one cell that meet the searches filed under it in one piece.
PIECE = 4096


def matching(scored: DataFrame, searches: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """The listings that fit each active search: what ``screen`` finds to fit on ``interval_links``, without a row per link.

    Every rule is decided where a listing and a search meet, so only pairs that fit leave the join and none is shuffled. Listings lie
    in one cell each, by city, price and surface, in pieces of about ``PIECE``; a search is filed under the cells that its intervals
    touch and that hold listings. A listing also lies under each criterion it was found to match, a search under the criterion it has,
    so criteria are part of the key. Rows that repeat an id meet by id, as links do.
    """
    key = F.when(F.col("custom_prompt") != "", T.prompt_key(F.col("custom_prompt")))
    none = F.array(F.lit(""))  # no criterion
    rows = scored.withColumn("_keys", none)
    if checks is not None:
        passed = checks.where("status = 'matched'").groupBy("id", "content_hash").agg(F.collect_list("prompt_key").alias("_passed"))
        rows = scored.join(passed, ["id", "content_hash"], "left").withColumn("_keys", F.concat(none, F.coalesce("_passed", F.array().cast("array<string>"))))
    open_ = rows.where(~inactive() & (F.col("transaction_type") == "sale") & (F.col("currency") == "EUR") & F.col("price").isNotNull() & F.col("surface").isNotNull())
    # What one side alone decides is decided here, once per listing or search and not once per pair.
    texts = {f"_{field}": F.lower(F.coalesce(field, F.lit(""))) for field in ("zone", "address", "title")}
    discount = F.col("discount")
    listed = cut_lineage(open_.select(
        "id", "score", F.lower("city").alias("_city"), *[text.alias(name) for name, text in texts.items()], T.words_apart(*texts.values()).alias("_said"), "price", "surface", "property_type",
        "discount", F.col("strategies.strategy").alias("_strategies"), _bits([F.col("is_auction"), discount.isNull() | (discount <= 0), _unreached(), discount.isNull()]).alias("_has"), "_keys"))
    spot = listed.select("id", F.col("_city").alias("_at"), F.col("price").alias("_price"), F.col("surface").alias("_surface"), _cell(F.col("price")).alias("_p"), _cell(F.col("surface")).alias("_s"))
    top = F.when(F.coalesce("max_surface", F.lit(0.0)) != 0, F.col("max_surface"))
    bounds = searches.where("active AND min_price IS NOT NULL AND min_surface IS NOT NULL").select(
        "agent_id", F.lower("agent_city").alias("_at"), F.col("min_price").alias("_from"), F.col("max_price").alias("_to"), F.col("min_surface").alias("_least"), top.alias("_most"))

    def cells(low: str, high: str) -> Column:
        first, last = _cell(F.col(low)), F.when(F.col(high).isNull(), _LAST).otherwise(_cell(F.col(high)))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    place = ["_at", "_p", "_s"]
    pieces = cut_lineage(spot.groupBy(*place).agg(F.expr(f"count(1) div {PIECE} + 1").alias("_pieces")))
    lying = spot.join(pieces, place).withColumn("_piece", F.pmod(F.xxhash64("id"), F.col("_pieces"))).drop("_pieces")
    lying = lying.join(listed, "id").withColumn("_key", F.explode("_keys")).drop("_keys")
    asked = searches.select(
        "agent_id", F.lower("agent_city").alias("_wanted_city"), "min_price", "max_price", "min_surface", top.alias("max_surface"), "min_discount", F.coalesce(key, F.lit("")).alias("_key"),
        F.when(F.size("property_types") > 0, F.col("property_types")).alias("_types"), F.when(F.size("strategies") > 0, F.col("strategies")).alias("_wanted"),
        F.coalesce(F.col("location_query") != "", F.lit(False)).alias("_located"), T.location_pattern(F.col("location_query")).alias("_pattern"), F.when(T.location_pattern(F.col("location_query")).isNotNull(), T.words_in_row(F.lower("location_query"))).alias("_phrase"),
        _bits([~F.col("include_auctions"), F.col("opportunity_only"), F.col("contact_policy") == "require_direct", F.col("min_discount").isNotNull()]).alias("_refuses"))
    filed = (bounds.withColumn("_p", cells("_from", "_to")).withColumn("_s", cells("_least", "_most")).join(pieces, place)
             .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1))).drop("_pieces")).join(asked, "agent_id")
    # A row that met itself by its id, as each does unless ids repeat, need not be held against the same bounds again.
    alike = lambda pairs: all_of([F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])
    lying = lying.withColumn("_itself", alike([("_city", "_at"), ("price", "_price"), ("surface", "_surface")]))
    filed = filed.withColumn("_same", alike([("_wanted_city", "_at"), ("min_price", "_from"), ("max_price", "_to"), ("min_surface", "_least"), ("max_surface", "_most")]))
    filed = filed.withColumns({name: F.coalesce(name, F.lit(float("nan"))) for name in ("_to", "_most")})  # no number exceeds NaN
    c, may = F.col, lambda rule: F.coalesce(rule, F.lit(False))
    outside = any_of([may(rule) for rule in (F.coalesce(c("_city"), F.lit("")) != c("_wanted_city"), c("price") < c("min_price"), (c("price") >= c("min_price")) & (c("price") > c("max_price")),
                                             c("surface") < c("min_surface"), c("surface") > c("max_surface"))])
    # Where "_" may stand within a word and between words, the pattern decides.
    named = F.when(c("_said").contains("_") | c("_phrase").contains("_"), any_of([may(F.regexp_like(c(name), c("_pattern"))) for name in texts])).otherwise(may(c("_said").contains(c("_phrase"))))
    fits = [(c("_price") >= c("_from")) & (c("_price") <= c("_to")) & (c("_surface") >= c("_least")) & (c("_surface") <= c("_most")), c("_has").bitwiseAND(c("_refuses")) == 0,
            (c("_itself") & c("_same")) | ~outside, c("min_discount").isNull() | ~may(c("discount") < c("min_discount")), c("_types").isNull() | F.coalesce(F.array_contains("_types", c("property_type")), F.lit(True)),
            c("_wanted").isNull() | F.coalesce(F.arrays_overlap(c("_wanted"), c("_strategies")), F.lit(True)), ~c("_located") | named]
    by = [*place, "_piece", "_key"]
    return over_tasks(filed, *by).join(over_tasks(lying, *by), by).where(all_of(fits)).select("agent_id", "id", "score")


def rescreen_agent(scored: DataFrame, searches: DataFrame, memberships: DataFrame, agent_id: str, checks: DataFrame | None = None) -> DataFrame:
    """Recompute the links of one search after its criteria changed."""
    links = memberships.where(F.col("agent_id") == agent_id).select("id", "agent_id")
    return screen(scored, searches.where(F.col("agent_id") == agent_id), links, checks)
