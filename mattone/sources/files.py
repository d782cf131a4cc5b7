"""CSV imports, sitemaps, official zone documents and classification results."""
from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.expr import labels
from ..functions.values import canonical_url, clean_text, join_url, listing_key, parse_number, url_part
from ..session import cut_lineage

LISTING_COLUMNS = ["listing_key", "url", "title", "city", "zone", "address", "property_type", "condition", "price", "surface", "rooms",
                   "bathrooms", "latitude", "longitude", "area_basis", "currency", "transaction_type", "description", "availability", "is_auction"]
BENCHMARK_COLUMNS = ["city", "zone", "property_type", "condition", "area_basis", "currency", "transaction_type", "min_sqm", "max_sqm",
                     "period", "source_label", "source_url"]


_SEPARATORS = ",;\t"


def _layout(line: str) -> tuple[str, list[str], str | None]:
    """Separator, column names and, where the line is no header, the reason."""
    line = line.lstrip("\ufeff")
    plain = re.sub(r'"[^"]*"', "", line)
    sep = max(_SEPARATORS, key=plain.count)
    names = [n.strip() for n in next(csv.reader([line], delimiter=sep), [])]
    if not line.strip() or any(not n for n in names):
        return sep, names, "the CSV needs a first line with the field names"
    if len(set(names)) != len(names):
        return sep, names, "the CSV has columns of the same name"
    return sep, names, None


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """file, sep, names and refusal of each file that is not empty, from its first line."""
    place = F.monotonically_increasing_id()  # grows along the rows of a task, and a file's first block is read by one
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), place.alias("_n"))
    first = cut_lineage(lines.where("_start = 0").groupBy("file").agg(F.min_by("value", "_n").alias("line")))
    # Layouts are few, whatever the number of files.
    layouts = [(r["line"], *_layout(r["line"])) for r in first.select("line").distinct().collect()]
    known = spark.createDataFrame(layouts, "line string, sep string, names array<string>, refusal string")
    return first.join(known, "line").drop("line")


def _read(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Declared columns as text (others ignored), with a reason on rows that have too many values and one row per refused file.

    Every file has a header of its own: columns may come in any order and the separator may differ from file to file.
    """
    place = lambda n: F.array_position("names", F.lit(n)).cast("int") - 1
    headers = _headers(spark, path).withColumn("places", F.array(*[place(n) for n in wanted]))
    found = headers.where("refusal IS NULL").groupBy("sep").agg(F.max(F.size("names")).alias("n"), F.collect_list("file").alias("files")).collect()
    refused = headers.where("refusal IS NOT NULL").select(*[F.lit(None).cast("string").alias(n) for n in wanted], F.col("refusal").alias("_broken"))
    out = refused
    for part in found:  # at most one read per separator
        # One column more than any header, so that a value too many is seen.
        columns = [f"_c{i}" for i in range(part["n"] + 1)]
        # Quoted line breaks need whole-file records; many files, not one big one, give parallelism.
        df = (spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", False).option("sep", part["sep"]).option("multiLine", True).option("escape", '"')
              .option("mode", "PERMISSIVE").csv(part["files"]).where(F.coalesce(*columns).isNotNull())
              .select(F.array(*columns).alias("v"), F.col("_metadata.file_path").alias("file")))
        # One short row per file of those listed above: dealt by file, the records of many files would meet in a few tasks.
        rows = df.join(F.broadcast(headers.select("file", "names", "places")), "file")
        clean = lambda x: F.trim(F.regexp_replace(x, "^\ufeff", ""))
        # The header itself; most other rows differ from it in their first value.
        begins = clean(F.get("v", F.lit(0))).eqNullSafe(F.get("names", F.lit(0)))
        rows = rows.where(~(begins & F.slice(F.transform("v", clean), F.lit(1), F.size("names")).eqNullSafe(F.col("names"))))
        extra = F.exists(F.slice("v", F.size("names") + 1, F.size("v")), lambda x: x.isNotNull())
        # A name that the file lacks has place -1, which get() reads as null.
        value = lambda n: F.get("v", F.get("places", F.lit(wanted.index(n))))
        text = lambda n: F.when(value(n) != "", value(n))
        out = out.unionByName(rows.select(*[text(n).alias(n) for n in wanted], F.when(extra, F.lit("more values than columns")).alias("_broken")))
    return out


def _one_of(c: str, values: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def scan_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Listing rows of a CSV import; ``error`` says why a row cannot be taken."""
    df = _read(spark, path, LISTING_COLUMNS)
    raw = df
    for n in ("price", "surface", "rooms", "bathrooms"):
        df = df.withColumn(n, parse_number(n))
    for n in ("latitude", "longitude"):
        df = df.withColumn("_" + n, F.col(n)).withColumn(n, F.col(n).try_cast("double"))
    defaults = {"property_type": "unknown", "condition": "unknown", "area_basis": "unknown", "currency": "XXX", "transaction_type": "unknown",
                "availability": "unknown", "city": "", "zone": "", "description": ""}
    declared = F.sha2(F.to_json(F.struct(*[c for c in LISTING_COLUMNS if c not in ("url", "latitude", "longitude")])), 256)
    df = df.withColumn("url", F.coalesce("url", F.concat(F.lit("import://csv/"), F.substring(declared, 1, 24))))
    df = df.withColumn("listing_key", F.coalesce("listing_key", listing_key(canonical_url("url"))))
    df = df.withColumn("is_auction", F.coalesce(F.lower("is_auction").isin("true", "1", "si", "sì"), F.lit(False)))
    for n, value in defaults.items():
        df = df.withColumn(n, F.coalesce(n, F.lit(value)))
    problems = labels([
        (F.col("_broken"), F.col("_broken").isNotNull()), ("title missing", F.col("title").isNull() | (F.length("title") > 500)),
        ("unknown property_type", ~_one_of("property_type", rules.PROPERTY_TYPES)), ("unknown condition", ~_one_of("condition", rules.CONDITIONS)),
        ("unknown area_basis", ~_one_of("area_basis", rules.AREA_BASES)), ("unknown transaction_type", ~_one_of("transaction_type", rules.TRANSACTIONS)),
        ("unknown availability", ~_one_of("availability", rules.AVAILABILITY)), ("currency not a three-letter code", ~F.col("currency").rlike("^[A-Z]{3}$")),
        ("price out of range", F.col("price") > 1e9), ("surface out of range", (F.col("surface") < 0.1) | (F.col("surface") > 1e7)),
        ("latitude out of range", (F.col("_latitude").isNotNull() & F.col("latitude").isNull()) | ~F.coalesce(F.col("latitude").between(-90, 90), F.lit(True))),
        ("longitude out of range", (F.col("_longitude").isNotNull() & F.col("longitude").isNull()) | ~F.coalesce(F.col("longitude").between(-180, 180), F.lit(True))),
        ("unsupported protocol", ~url_part("url", "scheme").isin("http", "https", "import"))])
    return df.select(*LISTING_COLUMNS, F.when(F.size(problems) > 0, F.array_join(problems, "; ")).alias("error"))


def scan_benchmarks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark rows of a CSV import; ``error`` says why a row cannot be taken."""
    df = _read(spark, path, BENCHMARK_COLUMNS)
    for n in ("min_sqm", "max_sqm"):
        df = df.withColumn(n, parse_number(n))
    df = df.withColumn("currency", F.coalesce("currency", F.lit("EUR"))).withColumn("transaction_type", F.coalesce("transaction_type", F.lit("sale")))
    given = lambda c, low: F.coalesce(F.length(c) >= low, F.lit(False))
    in_range = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) <= 1_000_000), F.lit(False))
    problems = labels([
        (F.col("_broken"), F.col("_broken").isNotNull()), ("city missing", ~given("city", 1)), ("zone missing", ~given("zone", 1)),
        ("property_type must be known", ~_one_of("property_type", [p for p in rules.PROPERTY_TYPES if p != "unknown"])),
        ("condition must be known", ~_one_of("condition", [c for c in rules.CONDITIONS if c != "unknown"])),
        ("area_basis must be known", ~_one_of("area_basis", [a for a in rules.AREA_BASES if a != "unknown"])),
        ("currency not a three-letter code", ~F.col("currency").rlike("^[A-Z]{3}$")), ("unknown transaction_type", ~_one_of("transaction_type", ["sale", "rent"])),
        ("min_sqm out of range", ~in_range("min_sqm")), ("max_sqm out of range", ~in_range("max_sqm")), ("inverted range", F.col("max_sqm") < F.col("min_sqm")),
        ("period is not YYYY-S1 or YYYY-S2", ~F.coalesce(F.col("period").rlike(r"^\d{4}-S[12]$"), F.lit(False))),
        ("source_label missing", ~given("source_label", 3)), ("source_url missing", ~given("source_url", 3))])
    return df.select(*BENCHMARK_COLUMNS, F.when(F.size(problems) > 0, F.array_join(problems, "; ")).alias("error"))


def scan_sitemap(sitemaps: DataFrame, pattern: str = "") -> DataFrame:
    """Page links of ``sitemaps`` (base_url, xml) in order; documents with a DTD or an index are refused."""
    upper = F.upper("xml")
    root = F.regexp_extract("xml", r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    error = (F.when(upper.contains("<!DOCTYPE") | upper.contains("<!ENTITY"), "DTD or entities").when(root == "sitemapindex", "index of sitemaps")
             .when(root == "", "not XML"))
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?loc>"), F.lit(1)),
                       lambda x: join_url(F.col("base_url"), clean_text(x)))
    kept = F.array_distinct(F.filter(locs, lambda u: u.contains(pattern)))
    rows = sitemaps.withColumn("error", error).withColumn("_urls", F.when(F.col("error").isNull(), kept).otherwise(F.array().cast("array<string>")))
    return rows.select("base_url", "error", F.posexplode_outer("_urls").alias("position", "link"))


def scan_zone_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Zones of a GeoJSON feature collection: code, name and polygons, each a list of rings; ``error`` where one is refused."""
    feature = "struct<properties:struct<zona:string,descZona:string>,geometry:struct<type:string,coordinates:string>>"
    doc = spark.read.schema(f"features array<{feature}>, dat struct<features:array<{feature}>>").option("multiLine", True).json(path)
    rows = doc.select(F.explode(F.coalesce("features", "dat.features")).alias("f")).select("f.*")
    polygon = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    several = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(polygon)).when(F.col("geometry.type") == "MultiPolygon", several)
    points = F.flatten(F.flatten(polygons))
    error = (F.when(~F.coalesce(F.col("properties.zona").rlike(r"^[BCDER][0-9]{1,3}$"), F.lit(False)), "unknown zone code")
             .when(F.coalesce(F.size(points), F.lit(0)) < 1, "no polygon").when(F.exists(points, lambda p: F.size(F.filter(p, lambda x: x.isNotNull())) < 2), "broken point"))
    return (rows.select(F.col("properties.zona").alias("zone_code"), F.coalesce("properties.descZona", "properties.zona").alias("name"), polygons.alias("polygons"), error.alias("error"))
            .withColumn("polygons", F.when(F.col("error").isNull(), F.col("polygons"))))


def scan_zone_quotes(documents: DataFrame) -> DataFrame:
    """Quote rows of official tables: eight cells with type, condition, range and gross or net."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("row"), F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), clean_text)
    keep = [c for c in documents.columns if c != "html"]
    out = documents.select(*keep, F.posexplode(rows).alias("position", "row")).withColumn("c", cells).where(F.size("c") == 8)
    cell = lambda i: F.get("c", i)
    number = lambda i: F.replace(cell(i), F.lit(","), F.lit(".")).try_cast("double")
    out = out.select(*keep, "position", cell(0).alias("type"), cell(1).alias("condition"), number(2).alias("min_sqm"),
                     number(3).alias("max_sqm"), cell(4).alias("_basis"))
    ok = (F.col("min_sqm") > 0) & (F.col("min_sqm") <= F.col("max_sqm")) & (F.col("max_sqm") < 1_000_000) & F.col("_basis").isin("L", "N")
    return out.where(ok).withColumn("area_basis", F.when(F.col("_basis") == "L", "gross").otherwise("net")).drop("_basis")


RESULT = ("summary string, strategies array<struct<strategy:string,evidence:string>>, caveats array<string>, "
          "custom_assessment struct<status:string,reason:string,evidence:array<string>,checks:array<struct<criterion:string,status:string,reason:string,evidence:array<string>>>>")


def scan_semantic_results(results: DataFrame) -> DataFrame:
    """Classification answers (``content``) against the strict contract; ``error`` on a breach."""
    text = F.trim("content")
    fenced = text.startswith("```") & text.endswith("```")
    body = F.when(fenced, F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(text)
    parsed = F.from_json(body, RESULT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = results.withColumn("r", parsed).withColumn("_keys", F.json_object_keys(body))
    s = F.col("r.strategies")
    allowed = F.array(*[F.lit(k) for k in ("summary", "strategies", "caveats", "custom_assessment")])
    statuses = ["matched", "not_matched", "uncertain"]
    c = F.col("r.custom_assessment")
    broken = F.col("_keys").isNull() | F.col("r._bad").isNotNull()
    problems = labels([
        ("too long", F.length("content") > 30000),
        ("extra fields", F.size(F.array_except("_keys", allowed)) > 0),
        ("summary missing or too long", F.col("r.summary").isNull() | (F.length("r.summary") > 1500)),
        ("too many strategies", F.size(s) > 4), ("too many caveats", F.size("r.caveats") > 8),
        ("unknown strategy", F.exists(s, lambda x: ~F.coalesce(x["strategy"].isin(*rules.STRATEGIES), F.lit(False)))),
        ("evidence length", F.exists(s, lambda x: ~F.coalesce(F.length(x["evidence"]).between(5, 700), F.lit(False)))),
        ("assessment status", c.isNotNull() & ~F.coalesce(c["status"].isin(*statuses), F.lit(False))),
        ("assessment reason", c.isNotNull() & ~F.coalesce(F.length(c["reason"]).between(5, 800), F.lit(False)))])
    return rows.withColumn("error", F.when(broken, "not a JSON object").when(F.size(problems) > 0, F.array_join(problems, "; "))).drop("_keys")
