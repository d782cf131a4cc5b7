"""Stored web pages as listing rows, links and candidates."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..functions.expr import let
from ..functions.values import (canonical_url, clean_text, currency_of, join_url, listing_key, lookup, normalize_condition,
                                parse_number, portal_listing, property_type_of, split_locality, url_part, valid_email)

_LINK = "struct<href:string,text:string,context:string,hint:string,card:string>"
#: Pages that a task holds taken apart at once.
HELD = 256
PARSED = (f"page_id bigint, url string, page_title string, h1 string, description string, nodes array<string>, "
          f"fields map<string,string>, links array<{_LINK}>, labels array<struct<label:string,value:string>>, next_href string")

# Where the three page layouts print their fields.
PORTAL_FIELDS = {
    "www.immobiliare.it": {"transaction_type": 'dt:-soup-contains-own("Contratto") + dd',
                           "property_type": 'dt:-soup-contains-own("Tipologia") + dd',
                           "description": '[class*="ReadAll_readAll__"]'},
    "www.idealista.it": {"price": ".info-data-price", "description": ".adCommentsLanguage p", "address": "#headerMap li"},
    "www.casa.it": {"price": ".csapdp-infos__price", "surface": 'main [aria-label^="Superficie:"]',
                    "rooms": 'main [aria-label^="Numero di locali:"]', "bathrooms": 'main [aria-label^="Numero di bagni:"]',
                    "description": "[aria-label=\"Descrizione dell'immobile\"]",
                    "condition": '.chars__lbl:-soup-contains-own("Condizioni immobile") + p',
                    "location": ".map__head--addrs", "zone": "h1 + p"},
}
PORTAL_LABELS = {"Prezzo": "price", "Superficie": "surface", "Locali": "rooms", "Bagni": "bathrooms"}


def parse_pages(pages: DataFrame, fields: dict[str, str] | None = None, next_selector: str = "") -> DataFrame:
    """One tree pass per page: structured data, mapped fields, labels and links.

    ``fields`` maps listing fields to selectors; pages of the known portals add their own.
    """
    fields = fields or {}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urlsplit
        from . import html_blocks as H
        for batch in (whole.iloc[at:at + HELD] for whole in batches for at in range(0, len(whole), HELD)):
            rows = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                root = H.parse(html)
                first = lambda s: next(iter(H.select(root, s)), None)
                host = (urlsplit(url).hostname or "") if any(known in (url or "").lower() for known in PORTAL_FIELDS) else ""
                values = {}
                for name, selector in {**PORTAL_FIELDS.get(host, {}), **fields}.items():
                    node = first(selector)
                    if node is not None:
                        values[name] = node.attrs.get("content") or node.text()
                title, h1, meta = first("title"), first("h1"), first('meta[name="description"]')
                pairs = [(H.previous(dd), dd) for dd in H.select(root, "dd")]
                labels = [{"label": dt.text(), "value": dd.text()} for dt, dd in pairs if dt is not None and dt.tag == "dt"]
                labels += [{"label": "feature", "value": li.text()} for li in H.select(root, ".details-property_features li")]
                labels += [{"label": "location", "value": n.text()} for n in H.select(root, 'button [class*="LocationInfo_location__"]')]
                nxt = first(next_selector) if next_selector else None
                rows.append((page_id, url, title.text() if title else None, h1.text() if h1 else None, meta.attrs.get("content") if meta else None, H.json_nodes(root), values,
                             H.page_links(root, url), labels, nxt.attrs.get("href") if nxt else None))
            yield pd.DataFrame(rows, columns=["page_id", "url", "page_title", "h1", "description", "nodes", "fields", "links", "labels", "next_href"])

    return pages.select("page_id", "url", "html").mapInPandas(read, PARSED)


def _json(node: Column, path: str) -> Column:
    return F.get_json_object(node, path)


def _some(*options: Column) -> Column:
    return F.coalesce(*[F.when(o != "", o) for o in options])


_NODE = ("name string, description string, floorSize string, address string, geo string, price string, numberOfRooms string, "
         "numberOfBathroomsTotal string, additionalProperty string, datePosted string, datePublished string, `@type` string, "
         "seller string, offeredBy string, broker string, offers string, url string, `@id` string, mainEntityOfPage string")


def _type_names(node: Column) -> Column:
    """Types of an opened node, a single one or a list, in lower case."""
    raw = node["@type"]
    listed = F.from_json(raw, "array<string>")
    return F.transform(F.when(raw.startswith("["), listed).otherwise(F.array(raw)), lambda t: F.lower(t))


def _first_offer(node: Column) -> Column:
    """The offer of an opened node, or the first of a list of them."""
    raw = node["offers"]
    return F.when(raw.startswith("["), _json(raw, "$[0]")).otherwise(raw)


def page_identity(url: Column) -> Column:
    """Host and path of a page: enough to tell whether structured data speaks of it."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^?#]*[^?#/])", 1))


def same_page(ref: Column) -> Column:
    """Whether an address is this page, absolute or from the root."""
    return F.when(ref.startswith("/"), F.col("page").endswith(F.lower(F.regexp_extract(ref, r"^([^?#]*[^?#/])", 1)))).otherwise(page_identity(ref) == F.col("page"))


def choose_node(parsed: DataFrame) -> DataFrame:
    """The structured-data object that describes the listing: the one with most of six fields.

    Every object is read once, into ``opened``. Objects that name another page are skipped; ``offer`` may sit on a wrapper.
    """
    out = parsed.withColumn("page", page_identity(F.col("url"))).withColumn("opened", F.transform("nodes", lambda n: F.from_json(n, _NODE)))
    out = out.withColumn("own", F.filter("opened", lambda n: n["url"].isNull() | same_page(n["url"])))
    accepted = [*rules.TYPE_MAP, "realestatelisting", "product", "accommodation", "place"]
    weighed = F.transform(F.filter("own", lambda n: F.arrays_overlap(_type_names(n), F.array(*[F.lit(t) for t in accepted]))),
                          lambda n, i: F.struct(sum((n[k].isNotNull().cast("int") for k in
                                                     ("offers", "floorSize", "address", "description", "price", "numberOfRooms")), F.lit(0)).alias("w"),
                                                (-i).alias("i"), n.alias("n")))
    wrapper = F.try_element_at(F.filter("own", lambda n: n["@type"] == "RealEstateListing"), F.lit(1))
    out = out.withColumn("n", F.array_max(weighed)["n"]).withColumn("w", wrapper)
    return out.withColumn("offer", F.coalesce(_first_offer(F.col("n")), _first_offer(F.col("w")))).drop("own")


_OFFER = "price string, priceCurrency string, businessFunction string, availability string, seller string, offeredBy string, broker string"
_PERSON = "name string, telephone string, email string, worksFor struct<name:string>"


def open_nodes(chosen: DataFrame) -> DataFrame:
    """Beside the chosen objects n and w (wrapper) the offer o and their nested parts, each read once."""
    out = chosen.withColumn("o", F.from_json("offer", _OFFER))
    raw = F.col("n.additionalProperty")
    extras = F.from_json(F.when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw), "array<struct<name:string,value:string>>")
    return (out.withColumn("floor", F.from_json("n.floorSize", "value string, unitCode string")).withColumn("place", F.from_json("n.address", "streetAddress string, addressLocality string"))
            .withColumn("geo", F.from_json("n.geo", "latitude string, longitude string")).withColumn("extras", extras)
            .withColumn("types", F.when(F.col("n").isNotNull(), _type_names(F.col("n")))))


def _additional(name: str) -> Column:
    """Value of a named additional property, last one wins."""
    hits = F.filter("extras", lambda p: (F.lower(F.trim(p["name"])) == name) & (F.coalesce(p["value"], F.lit("")) != ""))
    return F.trim(F.try_element_at(hits, F.lit(-1))["value"])


def declared_dates_contacts(chosen: DataFrame) -> DataFrame:
    """Publication date a page states for itself and the advertiser its structured data names."""
    articles = F.filter("opened", lambda x: F.arrays_overlap(_type_names(x), F.array(*[F.lit(t) for t in ("webpage", "itempage", "article", "blogposting")]))
                        & (same_page(x["url"]) | same_page(x["@id"]) | same_page(x["mainEntityOfPage"])))
    dates = F.array("n.datePosted", "n.datePublished", "w.datePosted", "w.datePublished", F.try_element_at(articles, F.lit(1))["datePublished"])

    def person(x):
        p = F.from_json(x["json"], _PERSON)
        return let(p, lambda v: F.struct(v["name"].alias("name"), v["worksFor"]["name"].alias("organization"), F.regexp_replace(v["telephone"], r"[\s().-]", "").alias("telephone"),
                                         F.trim(v["email"]).alias("email"), F.concat(F.lit("JSON-LD "), x["key"]).alias("method")))

    holders = F.array(*[F.struct(F.lit(key).alias("key"), F.col(f"{h}.{key}").alias("json")) for h in ("o", "n", "w") for key in ("seller", "offeredBy", "broker")])
    people = F.transform(F.filter(holders, lambda x: x["json"].startswith("{")), person)
    given = F.filter(people, lambda c: F.concat_ws("", c["name"], c["telephone"], c["email"], c["organization"]) != "")
    return (chosen.withColumn("published_at", F.try_element_at(F.filter(dates, lambda d: F.try_to_timestamp(d).isNotNull()), F.lit(1)))
            .withColumn("_c", F.try_element_at(given, F.lit(1)))
            .withColumn("contact_name", clean_text("_c.name")).withColumn("organization", clean_text("_c.organization"))
            .withColumn("telephone", F.when(F.col("_c.telephone").rlike(rules.PHONE_SHAPE), F.col("_c.telephone")))
            .withColumn("email", F.when(valid_email("_c.email"), F.col("_c.email"))).withColumn("contact_method", F.col("_c.method")).drop("_c"))


def portal_fields(parsed: DataFrame) -> DataFrame:
    """Label and value pairs of the known page layouts as one map per page; ranges refuse the page."""
    parsed = parsed.withColumns({"_host": url_part("url", "host"), "_path": url_part("url", "path")})
    parsed = parsed.withColumn("_known", portal_listing(F.col("_host"), F.col("_path")))
    host, known_page = F.col("_host"), F.col("_known")
    label = lambda name: F.try_element_at(F.filter("labels", lambda x: x["label"] == name), F.lit(1))["value"]
    feature = lambda pattern: F.try_element_at(F.filter("labels", lambda x: (x["label"] == "feature") & x["value"].rlike(pattern)), F.lit(1))["value"]
    places = F.transform(F.filter("labels", lambda x: x["label"] == "location"), lambda x: x["value"])
    css = lambda name: F.col("fields")[name]
    located = F.regexp_extract(css("location"), r"^(.+),\s*([^,]+)\s+\([A-Z]{2}\)$", 1)
    city = F.regexp_extract(css("location"), r"^(.+),\s*([^,]+)\s+\([A-Z]{2}\)$", 2)
    h1 = F.coalesce("h1", F.lit(""))
    imm, casa, idea = (host == h for h in ("www.immobiliare.it", "www.casa.it", "www.idealista.it"))
    three = F.size(places) == 3
    city_links = F.array_distinct(F.filter(F.transform("links", lambda x: F.when(
        x["href"].rlike("^/(vendita|affitto)-case/"), F.regexp_extract(x["text"], r"^[\s]*Case a (.+)$", 1))), lambda x: x != ""))
    values = {
        "title": h1,
        "transaction_type": F.when(h1.rlike(r"(?i)\bin vendita\b"), "sale").when(h1.rlike(r"(?i)\bin affitto\b"), "rent"),
        "property_type": F.when(h1.rlike("(?i)" + rules.RESIDENTIAL_TITLE), "residential"),
        "price": F.when(imm, label("Prezzo")).otherwise(css("price")),
        "surface": F.when(imm, label("Superficie")).when(idea, feature(r"^[\d.,]+\s*m²\s+commerciali$")).otherwise(css("surface")),
        "rooms": F.when(imm, label("Locali")).when(idea, feature(r"^\d+\s+local[ei]$")).otherwise(css("rooms")),
        "bathrooms": F.when(imm, label("Bagni")).when(idea, feature(r"^\d+\s+bagn[oi]$")).otherwise(css("bathrooms")),
        "area_basis": F.when(idea & feature(r"^[\d.,]+\s*m²\s+commerciali$").isNotNull(), "commercial"),
        "city": F.when(imm & three, places[0]).when(casa, city).when(idea & (F.size(city_links) == 1), city_links[0]),
        "zone": F.when(imm & three, places[1]).when(casa, css("zone")),
        "address": F.when(imm & three, places[2]).when(casa, located).otherwise(css("address")),
        "currency": F.when(F.when(imm, label("Prezzo")).otherwise(css("price")).contains("€"), "EUR"),
        "condition": css("condition"),
    }
    entries = F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in values.items()])
    several = lambda v: F.coalesce(v.rlike(r"(?i)^(?:da|a partire da)\b") | v.rlike(r"\d\s*[-–]\s*\d"), F.lit(False))
    ranged = several(values["price"])
    for name in ("surface", "rooms", "bathrooms"):
        ranged = ranged | (imm & several(values[name]))
    found = F.when(known_page, F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())))
    return (parsed.withColumn("portal", found).withColumn("refused", F.when(known_page & ranged, "several units or a range of values"))
            .drop("_host", "_path", "_known"))


def scan_pages(pages: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Listing rows of stored pages, one per page, with the origin of each value.

    Pages without title, or without price, surface and address, keep a ``reject_reason``.
    """
    rows = declared_dates_contacts(open_nodes(choose_node(portal_fields(parse_pages(pages, fields)))))
    css = lambda k: F.when(F.coalesce(F.col("fields")[k], F.lit("")) != "", F.col("fields")[k])
    portal = lambda k: F.col("portal")[k]
    unit = F.coalesce("floor.unitCode", F.lit("MTK"))
    street = F.coalesce("place.streetAddress", F.when(~F.col("n.address").startswith("{"), F.col("n.address")))
    business = F.lower(F.regexp_extract(F.col("o.businessFunction"), r"([^#/]*)$", 1))
    options = {  # field: portal layout, mapped selector, structured data
        "title": [portal("title"), css("title"), F.col("n.name")],
        "description": [css("description"), F.col("n.description")],
        "price": [portal("price"), css("price"), F.coalesce("o.price", "n.price")],
        "surface": [portal("surface"), css("surface"), F.when(unit.isin("MTK", "M2", "m2", "m²"), F.coalesce("floor.value", F.when(
            ~F.col("n.floorSize").startswith("{"), F.col("n.floorSize"))))],
        "rooms": [portal("rooms"), css("rooms"), F.col("n.numberOfRooms")],
        "bathrooms": [portal("bathrooms"), css("bathrooms"), F.col("n.numberOfBathroomsTotal")],
        "address": [portal("address"), css("address"), street],
        "city": [portal("city"), css("city"), F.col("place.addressLocality"), split_locality(css("locality"))["city"]],
        "zone": [portal("zone"), css("zone"), _additional("zone"), split_locality(css("locality"))["zone"]],
        "property_type": [portal("property_type"), property_type_of(css("property_type")), property_type_of(_additional("property_type")),
                          lookup(rules.TYPE_MAP, F.try_element_at("types", F.lit(1)))],
        "condition": [normalize_condition(portal("condition")), normalize_condition(css("condition")), normalize_condition(_additional("condition"))],
        "area_basis": [portal("area_basis"), lookup(rules.BASIS_MAP, css("area_basis")), lookup(rules.BASIS_MAP, _additional("area_basis"))],
        "transaction_type": [portal("transaction_type"), lookup(rules.TRANSACTION_MAP, css("transaction_type")),
                             lookup(rules.TRANSACTION_MAP, _additional("transaction_type")),
                             F.when(business == "sell", F.lit("sale")).when(business == "leaseout", "rent")],
        "currency": [portal("currency"), currency_of(css("currency")), F.when(css("price").rlike("(?i)€|EUR"), "EUR"),
                     F.when(F.col("o.priceCurrency").rlike("^[A-Z]{3}$"), F.col("o.priceCurrency"))],
        "latitude": [F.col("geo.latitude")], "longitude": [F.col("geo.longitude")],
    }
    fallback = {"title": F.col("h1"), "description": F.col("description")}
    numbers = ("price", "surface", "rooms", "bathrooms")
    picked, given = {}, {}
    for field, values in options.items():
        values = [*values, fallback[field]] if field in fallback else values
        given |= {f"v_{field}_{i}": parse_number(v) if field in numbers else v for i, v in enumerate(values)}
    # Each value is one column before anything reads it.
    out = rows.withColumns(given)
    for field in options:
        values = [F.col(name) for name in given if name.rpartition("_")[0] == "v_" + field]
        if field in ("property_type", "condition", "area_basis", "transaction_type"):
            values = [F.when(v != "unknown", v) for v in values]
        picked[field] = F.coalesce(*values) if field in numbers else _some(*values)
    out = out.withColumns({"p_" + field: value for field, value in picked.items()})
    for field in picked:
        picked[field] = F.col("p_" + field)
        if field in ("title", "description", "address", "city", "zone"):
            picked[field] = clean_text(picked[field])
    origins = F.filter(F.array(*[F.when(v.isNotNull(), F.lit(f)) for f, v in picked.items()]), lambda x: x.isNotNull())
    text = lambda f: F.coalesce(picked[f], F.lit(""))
    word = lambda f: F.coalesce(picked[f], F.lit("unknown"))
    url = canonical_url("url")
    out = out.select(
        "page_id", url.alias("url"), listing_key(url).alias("listing_key"), F.substring(text("title"), 1, 500).alias("title"),
        F.substring(text("description"), 1, 30000).alias("description"), *[picked[f].cast("double").alias(f) for f in numbers],
        picked["address"].alias("address"), text("city").alias("city"), text("zone").alias("zone"),
        *[word(f).alias(f) for f in ("property_type", "condition", "area_basis", "transaction_type")],
        F.coalesce(picked["currency"], F.lit("XXX")).alias("currency"), picked["latitude"].try_cast("double").alias("latitude"),
        picked["longitude"].try_cast("double").alias("longitude"), F.col("o.availability").alias("_stock"), F.col("fields")["availability"].alias("_state"),
        "published_at", "contact_name", "organization", "telephone", "email", origins.alias("stated"), "refused")
    stock = F.lower(F.regexp_extract("_stock", r"([^/]*)$", 1))
    availability = (F.when(stock == "soldout", "sold").when(stock.isin("outofstock", "discontinued"), "withdrawn")
                    .otherwise(F.coalesce(T.explicit_status(F.col("title")), T.explicit_status(clean_text("_state")), F.lit("unknown"))))
    reject = (F.coalesce("refused", F.when(F.col("title") == "", "no title").when(
        F.col("price").isNull() & F.col("surface").isNull() & F.col("address").isNull(), "not a listing: no price, surface or address")))
    return out.withColumn("availability", availability).withColumn("reject_reason", reject).drop("_stock", "_state", "refused")


def absolute_links(rows: DataFrame, href: str) -> DataFrame:
    """Add ``link``: the identity of the page a link leads to."""
    return rows.withColumn("_joined", join_url(F.col("url"), F.col(href))).withColumn("link", canonical_url("_joined")).drop("_joined")


def discover_links(parsed: DataFrame, pattern: str = "") -> DataFrame:
    """Listing links of each page on its own host, in page order, each once."""
    host = url_part("url", "host")
    anchors = F.transform("links", lambda x: x["href"])
    items = F.filter("nodes", lambda n: _json(n, "$['@type']") == "ListItem")
    listed = F.transform(items, lambda n: F.coalesce(_json(n, "$.url"), _json(n, "$.item.url")))
    rows = parsed.select("page_id", "url", host.alias("host"), F.posexplode(F.concat(anchors, listed)).alias("pos", "href")).where("href <> ''")
    rows = absolute_links(rows, "href").where(
        (url_part("link", "host") == F.col("host")) & url_part("link", "scheme").isin("http", "https"))
    if pattern:
        rows = rows.where(url_part("link", "path").contains(pattern))
    portal_host = F.col("host").isin(*[p["host"] for p in rules.PORTALS.values()])
    rows = rows.where(~portal_host | portal_listing(url_part("link", "host"), url_part("link", "path")))
    return rows.groupBy("page_id", "url", "link").agg(F.min("pos").cast("bigint").alias("pos"))


def next_pages(parsed: DataFrame) -> DataFrame:
    target = join_url(F.col("url"), F.col("next_href"))
    return (parsed.where("next_href is not null").select("page_id", "url", target.alias("next_url"))
            .where(url_part("next_url", "host") == url_part("url", "host")))


def page_link_context(parsed: DataFrame) -> DataFrame:
    """Same-host links with their text and the text of the card around; repeated menu text dropped."""
    rows = parsed.select("page_id", "url", url_part("url", "host").alias("host"), F.posexplode("links").alias("pos", "l"))
    rows = rows.where(~F.col("l.href").rlike(r"(?i)^(#|mailto:|tel:|javascript:)") & (F.col("l.href") != ""))
    rows = absolute_links(rows.withColumn("_page", canonical_url("url")), "l.href").where(
        (url_part("link", "host") == F.col("host")) & (F.col("link") != F.col("_page")))
    first = rows.groupBy("page_id", "link").agg(F.min(F.struct("pos", F.col("l.text").alias("text"), F.col("l.context").alias("context"))).alias("f"))
    out = first.select("page_id", "link", F.col("f.pos").cast("bigint").alias("pos"), F.substring("f.text", 1, 110).alias("text"),
                       F.substring("f.context", 1, 300).alias("context"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("page_id", "context"))
    return out.withColumn("_n", shared).withColumn("context", F.when((F.col("_n") >= 3) | (F.col("context") == F.col("text")), "")
                                                   .otherwise(F.col("context"))).drop("_n")


def page_candidates(parsed: DataFrame, known_listings: DataFrame, pattern: str = "") -> DataFrame:
    """Discovered links with card text, unseen ones first; closed listings are left out."""
    links = discover_links(parsed, pattern)
    cards = absolute_links(parsed.select("page_id", "url", F.explode("links").alias("l")), "l.href").select(
        "page_id", "link", F.col("l.hint").alias("price_hint"), F.substring("l.card", 1, 1200).alias("card_text"))
    first = cards.groupBy("page_id", "link").agg(F.max("price_hint").alias("price_hint"), F.max("card_text").alias("card_text"))
    old = known_listings.groupBy(F.col("url").alias("link")).agg(F.max(F.col("availability").isin(*rules.CLOSED).cast("int")).alias("_closed"))
    out = links.join(first, ["page_id", "link"], "left").join(old, "link", "left").where(F.coalesce("_closed", F.lit(0)) == 0)
    return (out.withColumn("previously_seen", F.col("_closed").isNotNull()).drop("_closed")
            .select("page_id", "link", "pos", "price_hint", "card_text", "previously_seen").orderBy("page_id", "previously_seen", "pos"))
