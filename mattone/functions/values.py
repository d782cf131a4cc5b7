"""Numbers, labels, contacts and URLs written by people, turned into one form."""
from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .expr import col, let


def lookup(mapping: dict[str, str], c: Column, default: str = "unknown") -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.lit(default))


def parse_number(c) -> Column:
    """Italian or English amount as a double; null when absent, negative or out of range."""
    first = r"\d[\d.,\s]*"

    def plain(n):
        dot, comma = F.instr(n, ".") > 0, F.instr(n, ",") > 0
        last_dot = F.length(n) - F.instr(F.reverse(n), ".")
        last_comma = F.length(n) - F.instr(F.reverse(n), ",")
        return (F.when(dot & comma & (last_comma > last_dot), F.translate(F.translate(n, ".", ""), ",", "."))
                .when(dot & comma, F.translate(n, ",", ""))
                .when(comma, F.translate(n, ",", "."))
                .when(n.rlike(r"^\d{1,3}(\.\d{3})+$"), F.translate(n, ".", ""))
                .otherwise(n))

    def read(text):
        lead = F.rtrim(F.substring(text, F.lit(1), F.greatest(F.regexp_instr(text, F.lit(first)) - 1, F.lit(0))))
        digits = F.regexp_replace(F.regexp_substr(text, F.lit(first)), r"\s+", "")
        # Structured data may print a large number with an exponent.
        scientific = text.rlike(r"^\d+(\.\d+)?E\d+$")
        value = F.when(scientific, text.try_cast("double")).otherwise(let(digits, plain).try_cast("double"))
        return F.when(~lead.rlike(r"[-−(]$"), value)

    number = let(F.trim(F.translate(col(c), "\u00a0\u202f", "  ")), read)
    return F.when(col(c).isNotNull(), let(number, lambda v: F.when((v > 0) & (v < 1e12), v)))


def clean_text(c) -> Column:
    """Tags stripped, entities decoded, blanks collapsed; a printable ASCII text without any is only trimmed."""
    text = col(c)
    cleaned = F.regexp_replace(decode_entities(F.regexp_replace(text, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " ")
    return F.trim(F.when(text.contains("<") | text.contains("&") | text.contains("  ") | text.rlike("[^ -~]"), cleaned).otherwise(text))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def decode_entities(c) -> Column:
    """Numeric and named character references as characters, each once; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))])

    def character(code):
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def piece(p):
        body = F.substring(p, F.lit(2), F.length(p) - 2)
        number = (F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10))
                  .when(body.startswith("#"), F.substring(body, F.lit(2), F.length(body))).try_cast("bigint"))
        return F.when(p.rlike("^" + _ENTITY + "$"), F.coalesce(character(number), F.try_element_at(names, body), p)).otherwise(p)

    def decoded(text):
        pieces = F.regexp_extract_all(text, F.lit(_ENTITY + "|[^&]+|&"), F.lit(0))
        return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)

    return let(col(c), decoded)


def normalize_condition(c) -> Column:
    text = F.lower(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")))
    return (F.when(text.isin(*rules.CONDITION_MAP), lookup(rules.CONDITION_MAP, text))
            .when(text.rlike(rules.CONDITION_RENOVATED), "renovated").otherwise("unknown"))


def property_type_of(c) -> Column:
    text = F.lower(F.trim(col(c)))
    mapped = lookup(rules.TYPE_MAP, text)
    local = text.rlike(r"^(?:mono|bi|tri|quadri)local[ei]\b|^appartament[oi]\b")
    return F.when((mapped == "unknown") & local, "residential").otherwise(mapped)


def currency_of(c) -> Column:
    """Three-letter currency from a code, a sign or its name; null otherwise."""
    text = F.trim(col(c))
    code = F.when(F.lower(text).isin("€", "euro"), "EUR").otherwise(F.upper(text))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def split_locality(c) -> Column:
    """(city, zone) from "<city> zona <zone>" or "<city> A/B"; nulls otherwise."""
    text = col(c)
    worded, slashed = r"(?i)^(.{2,100}?)\s+zona\s+(.{1,100})$", r"^(.{2,100}?)\s+([^/\s]{1,49}/[^/\s]{1,49})$"
    return (F.when(text.rlike(worded), F.struct(F.trim(F.regexp_extract(text, worded, 1)).alias("city"),
                                                F.trim(F.regexp_extract(text, worded, 2)).alias("zone")))
            .when(text.rlike(slashed), F.struct(F.trim(F.regexp_extract(text, slashed, 1)).alias("city"),
                                                F.trim(F.regexp_extract(text, slashed, 2)).alias("zone"))))


def norm_phone(c) -> Column:
    """National form of a phone number; empty when it is not one."""
    def national(bare):
        return (F.when(bare.startswith("0039") & (F.length(bare) >= 10), F.substring(bare, 5, 20))
                .when(bare.startswith("39") & (F.length(bare) >= 8), F.substring(bare, 3, 20))
                .otherwise(bare))

    def read(digits):
        return F.when(digits.rlike(rules.PHONE_SHAPE), let(F.regexp_replace(digits, r"^\++", ""), national)).otherwise("")

    return let(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\s().-]", ""), read)


def norm_email(c) -> Column:
    text = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return let(text, lambda t: F.when(t.rlike(rules.EMAIL_SHAPE), t).otherwise(""))


def valid_phone(c) -> Column:
    return F.coalesce(F.regexp_replace(col(c), r"[\s().-]", "").rlike(rules.PHONE_SHAPE), F.lit(False))


def valid_email(c) -> Column:
    return F.coalesce(col(c).rlike(rules.EMAIL_SHAPE), F.lit(False))


# --- URLs ---------------------------------------------------------------------------------

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(c, part: str) -> Column:
    index = {"scheme": 1, "host": 2, "path": 3, "query": 4}[part]
    value = F.regexp_extract(col(c), _URL, index)
    return F.lower(value) if part in ("scheme", "host") else value


def _encode(c: Column) -> Column:
    """Form encoding of one parameter, unreserved characters kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def portal_listing(host: Column, path: Column) -> Column:
    """Whether host and path are the numbered detail page of a known portal."""
    tests = [(host == p["host"]) & path.rlike("^/" + p["segment"] + r"/\d+/?$") for p in rules.PORTALS.values()]
    return tests[0] | tests[1] | tests[2]


def canonical_url(c) -> Column:
    """Identity of a page: lower host, no fragment or campaign parameters, parameters sorted."""
    def parts(u):
        return F.struct(*[url_part(u, p).alias(p) for p in ("scheme", "host", "path", "query")], u.alias("whole"))

    def parameter(p):
        return F.struct(F.coalesce(F.try_url_decode(F.regexp_extract(p, r"^([^=]*)", 1)), F.lit("")).alias("k"),
                        F.coalesce(F.try_url_decode(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)), F.lit("")).alias("v"))

    def identity(u):
        pairs = F.transform(F.filter(F.split(u["query"], "&"), lambda p: p != ""), parameter)
        kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin("fbclid", "gclid")))
        text = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
        base = F.concat(u["scheme"], F.lit("://"), u["host"])
        return (F.when(u["scheme"] == "", u["whole"])
                .when(portal_listing(u["host"], u["path"]), F.concat(base, F.rtrim(u["path"], F.lit("/")), F.lit("/")))
                .otherwise(F.concat(base, F.when(u["path"] == "", "/").otherwise(u["path"]),
                                    let(text, lambda t: F.when(t != "", F.concat(F.lit("?"), t)).otherwise("")))))

    return let(let(col(c), parts), identity)


def join_url(base, href) -> Column:
    """Absolute form of a link found on a page."""
    def parts(x):
        u, h = x["base"], x["href"]
        return F.struct(url_part(u, "scheme").alias("scheme"), url_part(u, "host").alias("host"), url_part(u, "path").alias("path"),
                        u.alias("base"), h.alias("href"), F.regexp_extract(h, r"^([^?#]*)", 1).alias("relative"))

    def folded(segments):
        # ".." drops the segment before it, "." itself.
        return F.aggregate(segments, F.array().cast("array<string>"),
                           lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
                           .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))

    def resolve(x):
        h, root = x["href"], F.concat(x["scheme"], F.lit("://"), x["host"])
        folder = F.regexp_replace(x["path"], r"[^/]*$", "")
        joined = F.concat(F.when(folder == "", "/").otherwise(folder), x["relative"])
        tail = F.when(x["relative"].rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        solved = let(folded(F.slice(F.split(joined, "/"), 2, 1_000)), lambda s: F.concat(F.array_join(s, "/"), F.when(F.size(s) > 0, tail).otherwise("")))
        return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
                .when(h.startswith("//"), F.concat(x["scheme"], F.lit(":"), h))
                .when(h.startswith("/"), F.concat(root, h))
                .when(h.startswith("?"), F.concat(root, x["path"], h))
                .when(h.startswith("#") | (h == ""), F.concat(F.regexp_replace(x["base"], "#.*$", ""), h))
                .otherwise(F.concat(root, F.lit("/"), solved, F.regexp_extract(h, r"^[^?#]*(.*)$", 1))))

    return let(let(F.struct(col(base).alias("base"), F.trim(col(href)).alias("href")), parts), resolve)


def listing_key(url) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 24)
