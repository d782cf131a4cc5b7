"""Evidence found in listing text. A declaration counts only where it is written and not denied."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .expr import col, labels, let


def uni(pattern: str, ignore_case: bool = True, first: str = "") -> str:
    """The pattern with Unicode words and, usually, case-insensitive letters.

    ``first`` are the characters that a match can begin with: places where none of them stands are passed over at once.
    """
    return ("(?iU)" if ignore_case else "(?U)") + (f"(?=[{first}])(?:{pattern})" if first else pattern)


def first_match(text: Column, pattern: str, longest: int = 200) -> tuple[Column, Column]:
    """Position (1-based, 0 if none) and text of the first match.

    The whole text is searched once; the hit is then read from where it starts.
    """
    at = F.regexp_instr(text, F.lit(pattern))
    return at, F.when(at > 0, F.regexp_substr(F.substring(text, at, F.lit(longest)), F.lit(pattern)))


def first_sentence(text: Column, core: str, before: int, after: int) -> Column:
    """The first match of ``core`` with the rest of its sentence, up to so many characters around.

    The sentence pattern is costly on long texts, so it only runs around the first core.
    """
    sentence = uni(r"[^.!?\n]{0,%d}(?:%s)[^.!?\n]{0,%d}" % (before, core, after))

    def near(m):
        return F.when(m["at"] > 0, F.trim(F.regexp_substr(window(m["text"], m["at"] - before, m["at"] + before + after + 1000), F.lit(sentence))))

    return let(F.struct(F.regexp_instr(text, F.lit(uni(core))).alias("at"), text.alias("text")), near)


def window(text: Column, start: Column, stop: Column) -> Column:
    """Characters from ``start`` up to and not including ``stop``, clipped to the text."""
    begin = F.greatest(start, F.lit(1))
    return F.substring(text, begin, F.greatest(stop - begin, F.lit(0)))


def spans(text: Column, pattern) -> Column:
    """Every match of a pattern as (start, stop, hit), positions counted from one."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    pieces = F.split(text, pattern)
    empty = F.array().cast("array<struct<start:int,stop:int,hit:string>>")

    def add(acc, z):
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(1)) + F.length(z["piece"])
        return F.concat(acc, F.array(F.struct(start.cast("int").alias("start"), (start + F.length(z["hit"])).cast("int").alias("stop"),
                                              z["hit"].alias("hit"))))

    def placed(hits):
        zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"))
        return F.when(F.size(hits) > 0, F.aggregate(zipped, empty, add)).otherwise(empty)

    return let(found, placed)


def listing_text(title="title", description="description") -> Column:
    return F.trim(F.concat(F.coalesce(col(title), F.lit("")), F.lit(". "), F.coalesce(col(description), F.lit(""))))


def strategy_quote(text: Column, strategy: str) -> Column:
    """Quote for one strategy: the first pattern whose first hit is not denied just before it."""
    def quote(pattern):
        def read(m):
            hit = F.regexp_substr(F.substring(m["text"], m["at"], F.lit(200)), F.lit(uni(pattern)))
            denied = F.lower(window(m["text"], m["at"] - 45, m["at"])).rlike(uni(rules.STRATEGY_NEGATION))
            return F.when((m["at"] > 0) & ~denied, F.trim(window(m["text"], m["at"] - 25, m["at"] + F.length(hit) + 85)))
        return let(F.struct(F.regexp_instr(text, F.lit(uni(pattern))).alias("at"), text.alias("text")), read)

    return F.coalesce(*[quote(p) for p in rules.STRATEGY_PATTERNS[strategy]])


def strategies(text: Column) -> Column:
    """Array of (strategy, evidence) found in the text."""
    items = F.array(*[F.struct(F.lit(s).alias("strategy"), strategy_quote(text, s).alias("evidence"))
                      for s in rules.STRATEGIES])
    return F.filter(items, lambda x: x["evidence"].isNotNull())


def explicit_status(text: Column) -> Column:
    """Closed state that the text declares: first status word not denied within 30 characters."""
    mapping = F.create_map(*[F.lit(x) for pair in rules.STATUS_WORDS.items() for x in pair])

    def status(squashed):
        kept = F.filter(spans(squashed, uni(rules.STATUS_PATTERN)),
                        lambda m: ~window(squashed, m["start"] - 30, m["start"]).rlike(uni(rules.STATUS_NEGATION)))
        return F.try_element_at(mapping, F.try_element_at(kept, F.lit(1))["hit"])

    return let(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")), status)


def cadastral(text: Column) -> Column:
    """Declared cadastral category or use, codes in one form."""
    return let(text, _cadastral)


def _cadastral(text: Column) -> Column:
    return let(F.trim(F.regexp_substr(text, F.lit(uni(rules.CADASTRAL)))), _cadastral_label)


def _cadastral_label(quote: Column) -> Column:
    letter = F.regexp_extract(quote, r"\b([A-F])\s*/?\s*(\d{1,2})\b\s*$", 1)
    digits = F.regexp_extract(quote, r"\b([A-F])\s*/?\s*(\d{1,2})\b\s*$", 2)
    sentence = F.concat(F.upper(F.substring(quote, 1, 1)), F.substring(quote, 2, 1_000_000))
    return (F.when(quote.isNull(), F.lit(None).cast("string"))
            .when(letter != "", F.concat(F.lit("Categoria catastale "), letter, F.lit("/"), digits))
            .otherwise(sentence))


def change_of_use(text: Column) -> Column:
    return let(text, lambda t: first_sentence(t, rules.CHANGE_OF_USE, 90, 170))


def mandate(text: Column) -> Column:
    return let(text, lambda t: first_sentence(t, rules.MANDATE_CORE, 70, 100))


def _route_hits(text: Column, kind: str, label: str, pattern: str) -> Column:
    """Declarations of one kind that nothing denies shortly before or after."""
    def keep(m):
        denied = (window(text, m["start"] - 80, m["start"]).rlike(uni(rules.ROUTE_NEGATION_BEFORE))
                  | F.substring(text, m["stop"], F.lit(80)).rlike(uni(rules.ROUTE_NEGATION_AFTER)))
        return ~denied

    def quote(m):
        lead = F.element_at(F.split(window(text, m["start"] - 35, m["start"]), "\n"), -1)
        return F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"),
                        F.trim(F.concat(lead, m["hit"], F.substring(text, m["stop"], F.lit(65)))).alias("quote"))

    return F.transform(F.filter(spans(text, uni(pattern)), keep), quote)


def contact_route(text: Column) -> Column:
    """Who the page says sells: owner, exclusive mandate, or unknown when silent or both."""
    owner = _route_hits(text, "owner_declared", "Proprietario dichiarato", rules.OWNER_ROUTE)
    mandated = _route_hits(text, "mandate_declared", "Mandato esclusivo dichiarato", rules.MANDATE_ROUTE)

    def unknown(label):
        return F.struct(F.lit("unknown").alias("kind"), F.lit(label).alias("label"), F.lit("").alias("quote"))

    def decide(r):
        return (F.when((F.size(r["owner"]) > 0) & (F.size(r["mandated"]) > 0), unknown("Ruolo da verificare"))
                .when(F.size(r["owner"]) > 0, F.try_element_at(r["owner"], F.lit(1)))
                .when(F.size(r["mandated"]) > 0, F.try_element_at(r["mandated"], F.lit(1)))
                .otherwise(unknown("Filiera da verificare")))

    return let(F.struct(owner.alias("owner"), mandated.alias("mandated")), decide)


def fold(text: Column) -> Column:
    """Typography folded, blanks collapsed, lower case: the form in which quotes are compared."""
    plain = F.translate(F.coalesce(text, F.lit("")), rules.TYPOGRAPHY_FROM, rules.TYPOGRAPHY_TO)
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def quote_in_text(quote: Column, text: Column) -> Column:
    return F.coalesce((F.length(F.trim(quote)) >= 2) & fold(text).contains(fold(quote)), F.lit(False))


def number_pattern(value: Column) -> Column:
    """Regular expression for a figure printed standalone, with or without thousand separators."""
    whole = value == F.floor(value)
    two = F.regexp_replace(F.format_string("%.2f", value), r"0+$", "")
    integer = F.when(whole, value.cast("decimal(20,0)").cast("string")).otherwise(F.split(two, r"\.").getItem(0))
    tail = F.when(whole, F.lit("")).otherwise(F.concat(F.lit(r"[.,]"), F.split(two, r"\.").getItem(1)))
    grouped = F.reverse(F.regexp_replace(F.reverse(integer), r"(\d{3})(?=\d)", "$1~"))
    body = F.regexp_replace(grouped, "~", r"[.\\s\\x{a0}\\x{202f}]?")
    return F.when(value > 0, F.concat(F.lit(r"(?<![\d.,])"), body, tail, F.lit(r"(?![\d]|[.,]\d{3})")))


def number_supported(value: Column, text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, number_pattern(value)), F.lit(False))


def bases_named(text: Column) -> Column:
    """Area bases whose words stand anywhere in the text: only these can be tied to a figure."""
    return labels([(basis, text.rlike("(?iU)(?:" + word + ")")) for basis, word in rules.BASIS_WORDS.items()])


def basis_supported(surface: Column, text: Column, named: Column | None = None) -> Column:
    """Area bases the text ties to this very figure; ``named`` is what ``bases_named`` says of the text."""
    named = bases_named(text) if named is None else named
    body = number_pattern(surface)
    unit = r"\s*(?:mq|m²|m2|metri\s+quadr[ia]ti|metri)?\.?\s*(?:circa\s+)?"
    tests = []
    for basis, word in rules.BASIS_WORDS.items():
        after = F.concat(F.lit("(?iU)"), body, F.lit(unit + r"(?:di\s+superficie\s+)?(?:" + word + ")"))
        before = F.concat(F.lit(r"(?iU)(?:superficie|metratura|mq|m²)\s+(?:" + word
                                + r")[\s:]*(?:di\s+|pari\s+a\s+)?(?:circa\s+|ca\.?\s+)?(?:mq\.?\s*|m²\s*)?"), body)
        tests.append((basis, F.array_contains(named, basis) & (F.regexp_like(text, after) | F.regexp_like(text, before))))
    return labels(tests)


def condition_supported(condition: str, q: Column, page: Column) -> Column:
    """Whether a quote states this condition of the unit, not of the building or one component.

    Quote and page text come folded.
    """
    no = F.lit(False)
    veto = no
    if condition == "renovated":
        veto = veto | q.rlike(r"parzialmente|da ristrutturare|in parte")
    if condition in ("renovated", "new", "good"):
        veto = veto | (q.rlike(uni(rules.BUILDING_WORDS)) & ~q.rlike(uni(rules.UNIT_WORDS)))
    if condition == "good":
        veto = veto | q.rlike(uni(r"discret|da ristrutturare|\bnon\b"))
    at, hit = first_match(q, uni(rules.CONDITION_PHRASES[condition]))
    phrase = at > 0
    if condition in ("renovated", "new"):
        lead, rest = window(q, at - 25, at), F.substring(q, at + F.length(hit), F.lit(30))
        component = (lead.rlike(uni(rules.COMPONENT_WORDS + r"\s+(?:\w+\s+)?$"))
                     | rest.rlike(uni(r"^\w*\s+(?:\w+\s+)?(?:del|della|dei|degli)\s+" + rules.COMPONENT_WORDS)))
        stated = ~component
    else:
        stated = F.lit(True)
    labelled = no
    if condition in rules.CONDITION_ADJECTIVES:
        word_at, _ = first_match(q, uni(rules.CONDITION_ADJECTIVES[condition]))
        lead = window(q, word_at - 45, word_at)
        own = lead.rlike(uni(rules.CONDITION_LABEL)) | window(q, word_at - 30, word_at).rlike(uni(rules.UNIT_SUBJECT))
        # The quote opens with the adjective: the label must stand right before it in the page.
        parts = F.split(page, F.concat(F.lit(r"\Q"), q, F.lit(r"\E")))
        before_quote = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
                        lambda p: F.substring(p, F.greatest(F.length(p) - 44, F.lit(1)), F.lit(45)).rlike(uni(rules.CONDITION_LABEL)))
        labelled = (word_at > 0) & (own | ((word_at == 1) & before_quote))
    return F.coalesce(~veto & F.when(phrase, stated).otherwise(labelled), no)


def date_written(published: Column, text: Column) -> Column:
    """The date stands next to a publication label; an update date does not count."""
    y, m, d = (F.split(published, "-").getItem(i) for i in range(3))
    month = F.element_at(F.array(*[F.lit(x) for x in rules.MONTHS]), m.cast("int"))
    forms = F.concat(F.lit(r"(?:\b0?"), d.cast("int").cast("string"), F.lit(r"[/.-]0?"), m.cast("int").cast("string"),
                     F.lit(r"[/.-](?:"), y, F.lit("|"), F.substring(y, 3, 2), F.lit(r")\b|\b0?"), d.cast("int").cast("string"),
                     F.lit(r"\s+"), month, F.lit(r"\s+"), y, F.lit(r"\b|"), published, F.lit(")"))
    near = F.concat(F.lit("(?iU)" + rules.DATE_LABEL + r"(?:(?!aggiornat|modificat)[^.\n]){0,25}"), forms)
    return F.coalesce(F.regexp_like(text, near), F.lit(False))


def price_update_label(price: Column, text: Column) -> Column:
    """Price-update label beside the first print of the price, within 45 characters."""
    def near(x):
        at = F.regexp_instr(x["text"], x["body"])
        return F.struct(x["body"].alias("body"), F.when(at > 0, window(x["text"], at - 45, at + F.length(F.regexp_substr(x["text"], x["body"])) + 45)).alias("near"))

    def label(x):
        after = F.concat(F.lit("(?i)"), x["body"], F.lit(r"\s*(?:€|euro)?[^\d€]{0,30}?(?:" + rules.PRICE_UPDATE + ")"))
        before = F.concat(F.lit("(?i)(?:" + rules.PRICE_UPDATE + r")[^\d€]{0,30}?(?:€\s*)?"), x["body"])
        return F.regexp_substr(F.coalesce(F.regexp_substr(x["near"], after), F.regexp_substr(x["near"], before)), F.lit("(?i)" + rules.PRICE_UPDATE))

    return let(let(F.struct(number_pattern(price).alias("body"), text.alias("text")), near), label)


def location_pattern(query: Column) -> Column:
    """Pattern of the query words in sequence as whole words; null when there is none."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?U)(?<!\w)"), F.array_join(words, r"[\W_]+"), F.lit(r"(?!\w)")))


def words_in_row(text: Column) -> Column:
    """The words of a text with a blank around each."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)), " "), F.lit(" "))


def words_apart(*texts: Column) -> Column:
    """``words_in_row`` of each text on a line of its own.

    ``location_pattern(query)`` is found in one of the texts when this holds ``words_in_row`` of the query's words, unless either
    contains "_", which the pattern takes both for a letter and for a gap.
    """
    return F.concat_ws("\n", *[words_in_row(text) for text in texts])


def prompt_key(prompt: Column) -> Column:
    """Hash of the criteria text with blank lines dropped and blanks collapsed."""
    lines = F.transform(F.split(F.coalesce(prompt, F.lit("")), r"\r\n|\r|\n"),
                        lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.sha2(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), 256)


def city_and_zone(city: Column, text: Column) -> Column:
    """(city, zone) where an address is printed as "<zone>, <comune>, <province code>"."""
    pattern = F.concat(F.lit(r"(?U)(?<![\w])\Q"), city, F.lit(r"\E,\s*" + rules.MUNICIPALITY))
    names = F.regexp_extract_all(text, pattern, F.lit(1))
    codes = F.regexp_extract_all(text, pattern, F.lit(2))
    provinces = F.create_map(*[F.lit(x) for pair in rules.PROVINCES.items() for x in pair])
    capital_of = F.create_map(*[F.lit(x) for code, name in rules.PROVINCES.items() for x in (name.lower(), code)])
    hits = F.filter(F.arrays_zip(names.alias("name"), codes.alias("code")),
                    lambda h: F.map_contains_key(provinces, h["code"]) & (F.lower(h["name"]) != F.lower(city)))
    hit = F.try_element_at(hits, F.lit(1))
    own = F.try_element_at(capital_of, F.lower(city))
    elsewhere = (F.lower(hit["name"]) != F.lower(F.try_element_at(provinces, hit["code"]))) | (own != hit["code"])
    none = F.lit(None).cast("string")

    def pair(a, b):
        return F.struct(a.alias("city"), b.alias("zone"))

    return (F.when(hit.isNull(), pair(city, none)).when(F.coalesce(elsewhere, F.lit(False)), pair(hit["name"], city))
            .otherwise(pair(none, none)))


def open_points(instructions: Column) -> Column:
    """What the page does not state, in the order the analyst reads it."""
    asked = F.lower(F.coalesce(instructions, F.lit("")))
    return labels([
        ("prezzo", F.col("price").isNull()),
        ("superficie", F.col("surface").isNull()),
        ("base della superficie", F.col("surface").isNotNull() & (F.col("area_basis") == "unknown")),
        ("stato", F.col("condition") == "unknown"),
        ("recapito", ~(F.coalesce(F.col("telephone"), F.lit("")) != "") & ~(F.coalesce(F.col("email"), F.lit("")) != "")),
        ("catasto", asked.rlike("catast") & F.col("cadastral").isNull()),
        ("cambio d’uso", asked.rlike(r"convert|cambio|trasform|destinazion|d['’]uso") & F.col("change_of_use").isNull()),
    ])


def phone_pattern(digits: Column) -> Column:
    """The whole number as printed, not part of a longer one; a country code before it is fine."""
    body = F.regexp_replace(digits, r"(\d)(?=\d)", r"$1[\\s().\\-/]*")
    before = r"(?:(?<=(?:\+|\b00)39[\s.]?)|(?<!\d)(?<!\d[().\-/])(?<!(?:^|\D)\d{1,4}[\s().\-/]))"
    after = r"(?![().\-/]?\d)(?![\s().\-/]\d{1,4}(?!\d))"
    # What stands before is only looked at where the number itself is printed.
    return F.concat(F.lit("(?="), body, F.lit(")" + before), body, F.lit(after))


def phone_printed(phone: Column, text: Column) -> Column:
    """Whether the text prints this number, and not only beside a head-office notice."""
    digits = F.regexp_replace(phone, r"\D", "")
    national = F.when(phone.startswith("+39"), F.substring(digits, 3, 20)).otherwise(digits)
    shaped = F.regexp_replace(phone, r"[\s().\-/]", "").rlike(rules.PHONE_SHAPE)
    pattern, office = phone_pattern(national), "(?i)" + rules.NETWORK_OFFICE
    # The spots are only looked at one by one where there is such a notice at all.
    own = F.exists(spans(text, pattern), lambda m: ~window(text, m["start"] - 160, m["start"] + 200).rlike(office))
    return F.coalesce(shaped & F.regexp_like(text, pattern) & (~text.rlike(office) | own), F.lit(False))


def email_one_edit(email: Column, text: Column) -> Column:
    """The address as printed: the same one, or the only one of its domain a single edit away."""
    mail = F.lower(F.regexp_replace(F.trim(email), "^[<>.]+|[<>.]+$", ""))
    # Addresses hold no blanks, so the words with an @ are all that is lowered and searched.
    words = F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"((?<!\S)[^\s@]*+@\S*)"), F.lit(1)), " "))

    def printed(x):
        domain = F.regexp_extract(x["mail"], "@(.*)$", 1)
        # A run of letters is read from its start, or from the end of the address before it, and once only.
        page = F.array_distinct(F.regexp_extract_all(x["words"], F.lit(r"(?U)((?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]+(?:\.[\w-]+)+)"), F.lit(1)))
        near = F.filter(page, lambda m: m.endswith(F.concat(F.lit("@"), domain)) & (F.levenshtein(m, x["mail"]) == 1))
        return F.when(x["words"].contains(x["mail"]), x["mail"]).when(F.size(near) == 1, F.try_element_at(near, F.lit(1)))

    return let(F.struct(mail.alias("mail"), words.alias("words")), lambda x: F.when(x["mail"].rlike(rules.EMAIL_SHAPE), printed(x)))
