"""The predicate index against all pairs."""
import random

from pyspark.sql import functions as F

from conftest import frame, listing
from mattone.operators import screening

SEARCH = "agent_id string, agent_city string, active boolean, min_price double, max_price double, min_surface double, max_surface double"


def test_cover_holds_each_cell_once(spark):
    rows = spark.createDataFrame([(float(2 ** (a / 2)) + 0.01, float(2 ** (b / 2)) + 0.01, a, b) for a in range(0, 64, 3) for b in range(a, 64, 5)], "low double, high double, a int, b int")
    for r in rows.select("a", "b", screening._cover(F.col("low"), F.col("high")).alias("c")).collect():
        cells = [cell for block in r["c"] for cell in range((block % 64) << (block // 64), ((block % 64) + 1) << (block // 64))]
        assert sorted(cells) == list(range(r["a"], r["b"] + 1)) and len(r["c"]) <= 12


def test_links_equal_all_pairs(spark):
    rng = random.Random(3)
    amounts = [0.0, 1.0, 99_999.99, 100_000.0, 1e12]
    rows = [listing(f"l{i}", rng.choice([None, *amounts, rng.uniform(1e4, 1e6)]), surface=rng.choice([None, 0.5, 50.0, rng.uniform(10, 900)]), city=rng.choice(["Milano", "ROMA"]),
                    availability=rng.choice(["listed", "listed", "sold"]), currency=rng.choice(["EUR", "EUR", "USD"])) for i in range(150)]
    searches = []
    for i in range(120):
        low = rng.choice([*amounts, rng.uniform(1e4, 1e6)])
        searches.append((f"a{i}", rng.choice(["milano", "Roma"]), rng.random() < 0.9, low, rng.choice([None, low, low * rng.uniform(1, 4)]), rng.choice([0.0, 50.0, rng.uniform(10, 400)]), rng.choice([None, 0.0, 50.0, rng.uniform(50, 900)])))
    got = [tuple(r) for r in screening.interval_links(frame(spark, rows), spark.createDataFrame(searches, SEARCH)).collect()]
    want = [(r["id"], s[0]) for r in rows for s in searches if r["availability"] == "listed" and r["currency"] == "EUR" and r["price"] is not None and r["surface"] is not None and s[2]
            and r["city"].lower() == s[1].lower() and r["price"] >= s[3] and (s[4] is None or r["price"] <= s[4]) and r["surface"] >= s[5] and (not s[6] or r["surface"] <= s[6])]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_many_narrow_searches_make_no_pairs_that_break_an_interval(spark):
    n = 100_000
    searches = spark.range(n).selectExpr("concat('a', id) AS agent_id", "'Milano' AS agent_city", "true AS active", "1000D * (id + 1) AS min_price", "1000D * (id + 1) + 500 AS max_price", "50D AS min_surface", "60D AS max_surface")
    rows = spark.range(200).selectExpr("concat('l', id) AS id", "'milano' AS city", "1000D * (500 * id + 1) + 100 AS price", "40D + id % 40 AS surface", "'listed' AS availability", "'sale' AS transaction_type", "'EUR' AS currency")
    found = screening.interval_links(rows, searches)
    assert found.count() == sum(50 <= 40 + i % 40 <= 60 for i in range(200))


def test_matching_equals_screened_links_and_decides_where_pairs_meet(spark, monkeypatch):
    monkeypatch.setattr(screening, "PIECE", 4)
    rng = random.Random(5)
    rows = [listing(f"l{rng.randrange(70)}", rng.choice([None, 1e5, rng.uniform(8e4, 3e5)]), surface=rng.choice([None, 50.0, rng.uniform(40, 200)]), city=rng.choice(["Milano", "ROMA", None]), address=rng.choice(["Via 3", None]),
                    availability=rng.choice(["listed", "listed", "sold"]), is_auction=rng.random() < 0.3, description=rng.choice(["", "Vendita diretta da proprietario, senza agenzie."])) for _ in range(90)]
    scored = frame(spark, rows).selectExpr("*", "CASE WHEN hash(id) % 3 <> 0 THEN CAST(hash(id) % 9 AS double) END AS discount", "CAST(length(id) AS double) AS score", "IF(hash(id) % 2 = 0, '02123456', NULL) AS telephone",
                                           "CAST(NULL AS string) AS email", "md5(id) AS content_hash", "IF(hash(id) % 4 = 0, NULL, array(struct(IF(hash(id) % 2 = 0, 'core', 'value_add') AS strategy, 'x' AS evidence))) AS strategies")
    searches = spark.range(80).selectExpr("concat('a', id % 60) AS agent_id", "'' AS agent_name", "IF(id % 3 = 0, 'milano', 'Roma') AS agent_city", "id % 9 <> 0 AS active", "60000D + 1000 * (id % 50) AS min_price", "IF(id % 4 = 0, NULL, 250000D) AS max_price",
                                          "30D + id % 40 AS min_surface", "CASE WHEN id % 3 = 0 THEN 0D WHEN id % 3 = 1 THEN 180D END AS max_surface", "IF(id % 2 = 0, array('office'), NULL) AS property_types", "IF(id % 5 = 0, array('core'), NULL) AS strategies",
                                          "id % 7 = 0 AS opportunity_only", "IF(id % 6 = 0, 'require_direct', 'any') AS contact_policy", "IF(id % 8 = 0, 2D, NULL) AS min_discount", "id % 4 <> 1 AS include_auctions", "IF(id % 10 = 0, 'via 3', '') AS location_query",
                                          "CASE WHEN id % 7 = 1 THEN 'Criterio A' WHEN id % 7 = 2 THEN NULL ELSE '' END AS custom_prompt")
    checks = scored.where("hash(id) % 3 = 0").select("id", "content_hash", screening.T.prompt_key(F.lit("Criterio A")).alias("prompt_key"), F.when(F.col("id") > "l4", "matched").otherwise("to_verify").alias("status"), F.lit("").alias("reason"))
    for given in (checks, None):
        want = screening.screen(scored, searches, screening.interval_links(scored, searches), given).where("fit").select("agent_id", "id", "score")
        got = screening.matching(scored, searches, given)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
        # The last join is the one of listings and searches: no pair is shuffled for a rule.
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "_piece" in plan[plan.index("Join"):].split("\n")[0]


def test_a_place_is_found_without_a_pattern_per_pair(spark):
    texts = ["Via 3", "via  3, interno", "Via 33", "Corso Via-3", "via_3", "la_via 3", "Via  Dante Alighieri 3", "via dante_alighieri", "Città Alta", "citta alta", "", None, "È via", "via"]
    queries = ["via 3", "VIA", "", None, "...", "- via 3 -", "dante alighieri", "via_3", "città", "3", "via dante"]
    rows = [listing(f"l{i}", zone=a, address=b, title="Casa") for i, (a, b) in enumerate([(t, None) for t in texts] + [(None, t) for t in texts] + [("via", "3"), ("x_y", "Via 3")])]
    scored = frame(spark, rows).selectExpr("*", "5D AS discount", "1D AS score", "'02123456' AS telephone", "CAST(NULL AS string) AS email", "md5(id) AS content_hash", "CAST(NULL AS array<struct<strategy: string, evidence: string>>) AS strategies")
    searches = spark.createDataFrame([(f"a{i}", q) for i, q in enumerate(queries)], "agent_id string, location_query string").selectExpr(
        "*", "'' AS agent_name", "'Milano' AS agent_city", "true AS active", "0D AS min_price", "CAST(NULL AS double) AS max_price", "0D AS min_surface", "CAST(NULL AS double) AS max_surface", "CAST(NULL AS array<string>) AS property_types",
        "CAST(NULL AS array<string>) AS strategies", "false AS opportunity_only", "'any' AS contact_policy", "CAST(NULL AS double) AS min_discount", "true AS include_auctions", "'' AS custom_prompt")
    want = screening.screen(scored, searches, screening.interval_links(scored, searches)).where("fit").select("agent_id", "id", "score")
    got = screening.matching(scored, searches)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.where("agent_id IN ('a0', 'a1', 'a7')").count() > 8
    # Texts are put in lower case and taken apart once per listing or search, never per pair.
    plan = got._jdf.queryExecution().sparkPlan().toString()
    pair = plan[plan.index("Join"):].split("\n")[0]
    assert "_piece" in pair and "lower(" not in pair and "regexp_extract" not in pair
