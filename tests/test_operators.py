import random
import statistics
from datetime import timedelta

from pyspark.sql import functions as F

from mattone import rules
from mattone.operators import clusters, density, geo, history, market, merge, refresh, scenario, scoring
from mattone.functions.quantiles import group_quantiles
from conftest import NOW, frame, listing


def links(spark, pairs=()):
    return spark.createDataFrame(list(pairs), "id string, root string")


def test_segments_need_five_and_count_assets_once(spark):
    rows = frame(spark, [listing(str(n), 200000.0 + n * 1000) for n in range(5)])
    got = market.market_segments(rows, links(spark), NOW).first()
    assert (got["n"], got["median_sqm"], got["sufficient"]) == (5, 2020.0, True)
    merged = market.market_segments(rows, links(spark, [("0", "0"), ("1", "0")]), NOW).first()
    assert (merged["n"], merged["median_sqm"]) == (4, None)


def test_quantiles_match_percentile(spark):
    random.seed(3)
    values = [(g, round(random.lognormvariate(7, 1), 2)) for g in "aab" for _ in range(150)] + [("c", 5.0)] * 7 + [("d", 1.0), ("d", 2.0), ("d", 3.0), ("d", 5.0)]
    df = spark.createDataFrame(values, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()}
    want = {r["g"]: tuple(r["q"]) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    for g in want:
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[g], want[g])), g


def test_opportunity_values(spark):
    bench = spark.createDataFrame([("b", "Milano", "Z1", "office", "good", "commercial", "EUR", "sale", 2000.0, 3000.0, "2026-S1")],
                                  "id string, city string, zone string, property_type string, condition string, area_basis string, currency string, transaction_type string, min_sqm double, max_sqm double, period string")
    rows = frame(spark, [listing("a", description="frazionabile, a reddito"), listing("b", 10000.0, description="frazionabile, a reddito"), listing("c", 900000.0, description="da frazionamento, a reddito")])
    got = {r["id"]: (r["score"], r["discount"]) for r in scoring.score_listings(rows, bench, NOW).collect()}
    assert got["a"] == (93, 20.0) and got["b"][0] == 100 and got["c"][0] == 30


def test_price_changes_need_equal_context(spark):
    schema = "property_id string, observation_id bigint, observed_at timestamp_ntz, price double, currency string, transaction_type string, area_basis string, surface double"
    day = lambda n: NOW - timedelta(days=n)
    rows = [("a", 1, day(3), 200000.0, "EUR", "sale", "net", 100.0), ("a", 2, day(2), 180000.0, "EUR", "sale", "net", 100.0),
            ("b", 3, day(3), 200000.0, "EUR", "sale", "net", 100.0), ("b", 4, day(2), 180000.0, "USD", "sale", "net", 100.0), ("b", 5, day(1), 150000.0, "EUR", "sale", "net", 100.0)]
    got = history.price_changes(spark.createDataFrame(rows, schema), NOW).collect()
    assert [(r["property_id"], r["reduction_pct"]) for r in got] == [("a", 10.0)]


def test_duplicates_link_offers_of_different_sources(spark):
    rows = frame(spark, [listing("a"), listing("b", surface=102.0, source_id="s2", address="via test, 1"), listing("c", surface=110.0, source_id="s3"), listing("d", source_id="s1")])
    got = clusters.duplicate_candidates(rows).collect()
    assert [(r["a"], r["b"], r["listing_pairs"]) for r in got] == [("a", "b", 2)]
    members = {r["id"]: r["offer_id"] for r in clusters.duplicate_offers(rows).collect()}
    assert members["d"] == members["a"] == "a"


def test_duplicates_of_any_surface(spark):
    rng = random.Random(4)
    surfaces = [50.48, 52.04] + [round(rng.uniform(40, 60), 3) for _ in range(60)]
    rows = frame(spark, [listing(f"i{n:02}", surface=x, source_id=f"s{n}") for n, x in enumerate(surfaces)])
    got = {(r["a"], r["b"]) for r in clusters.duplicate_candidates(rows).collect()}
    want = {(f"i{a:02}", f"i{b:02}") for b in range(62) for a in range(b) if abs(surfaces[a] - surfaces[b]) / max(surfaces[a], surfaces[b]) <= 0.03}
    assert ("i00", "i01") in got and got == want


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(8)
    for sources in (2, 3, 12):
        rows = frame(spark, [listing(f"i{n:03}", surface=round(rng.uniform(30, 120), rng.randrange(3)), source_id=f"s{rng.randrange(sources)}", address=f"Via {rng.randrange(3)}") for n in range(150)])
        links, pairs = clusters.duplicate_links(rows), clusters.duplicate_candidates(rows)
        assert links.count() <= 2 * 150 and links.select("a", "b").exceptAll(pairs.select("a", "b")).count() == 0
        roots = lambda edges: sorted(map(tuple, clusters.connected_components(edges).collect()))
        assert roots(links) == roots(pairs)


def test_a_crowded_address_stays_linear(spark):
    rows = spark.range(10_000).selectExpr("concat('i', lpad(id, 5, '0')) AS id", "concat('s', id % 50) AS source_id", "'office' AS property_type", "100 + id / 1000 AS surface", "'Milano' AS city", "'Via Test 1' AS address")
    assert clusters.duplicate_links(rows).count() <= 20_000
    groups = clusters.duplicate_groups(rows)
    assert groups.count() == 10_000 and groups.select("group_id").distinct().count() == 1


def test_components_of_chain_star_and_ring(spark):
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("z0", f"z{i}") for i in range(1, 40)] + [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    got = {r["node"]: r["root"] for r in clusters.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"n{i:02}"] == "n00" for i in range(31)) and all(got[f"z{i}"] == "z0" for i in range(40)) and got["r3"] == "r1"


def test_references_match_brute_force(spark):
    rng = random.Random(5)
    stored = [70.006, 70.007, 130.013, 130.014, 100.01, 99.999, 0.4, 0.3] + [round(rng.uniform(55, 145), 3) for _ in range(150)]
    rows = [listing(f"L{i:03}", price=float(rng.randint(100, 400) * 1000), surface=x, source_id=f"s{i % 3}", condition=rng.choice(["to_renovate", "renovated", "new", "good", "unknown"]),
                    last_seen=NOW - timedelta(days=rng.randint(0, 120), hours=i % 7)) for i, x in enumerate(stored)]
    root = {f"L{i:03}": f"L{i // 3 * 3:03}" for i in range(30, 60)}
    df, pairs = frame(spark, rows), links(spark, root.items())
    none = spark.createDataFrame([], "root string, conflicts array<string>")
    sources = spark.createDataFrame([("s0", "d0"), ("s1", "d1"), ("s2", "d1")], "source_id string, domain string")
    live = sorted((r for r in rows if r["last_seen"] >= NOW - timedelta(days=90)), key=lambda r: (-r["last_seen"].timestamp(), r["id"]))

    def met(subject, key, per_condition):
        seen, out = set(), []
        for r in live:
            asset = (root.get(r["id"], r["id"]), r["condition"] if per_condition else None)
            if asset in seen or not (per_condition or r["condition"] in rules.REFERENCE_CONDITIONS):
                continue
            seen.add(asset)
            if r["condition"] == key and subject["surface"] * 0.7 <= r["surface"] <= subject["surface"] * 1.3 and asset[0] != root.get(subject["id"], subject["id"]):
                out.append(r)
        return out

    for same in (False, True):
        got = {(r["id"], r["key"]): r for r in market.market_references(df, pairs, none, sources, NOW, same_condition=same).collect()}
        for s in rows:
            for key in ([s["condition"]] if same else rules.REFERENCE_CONDITIONS):
                want = [] if same and key == "unknown" else met(s, key, same)
                r, values = got[s["id"], key], [x["price"] / x["surface"] for x in want]
                assert r["n"] == len(want)
                if len(want) >= 3:
                    assert abs(r["median_sqm"] - statistics.median(values)) < 0.02 and abs(r["min_sqm"] - min(values)) < 0.02 and abs(r["max_sqm"] - max(values)) < 0.02
                    assert r["newest_observed"] == want[0]["last_seen"] and r["oldest_observed"] == want[-1]["last_seen"]
                    assert r["source_count"] == len({"d0" if x["source_id"] == "s0" else "d1" for x in want})
    shown = {}
    for r in market.market_comparables(df, pairs, none, sources, NOW).collect():
        shown.setdefault((r["id"], r["comp_condition"]), {})[r["position"]] = r["comp_id"]
    for s in rows:
        for key in rules.REFERENCE_CONDITIONS:
            assert [x for _, x in sorted(shown.get((s["id"], key), {}).items())] == [x["id"] for x in met(s, key, False)[:12]]


def test_newest_row_in_another_condition_hides_no_asset(spark):
    rows = [listing("me", condition="new")] + [listing(f"{n}{c}", condition=c, last_seen=NOW - timedelta(days=d)) for n in "abc" for c, d in (("new", 5), ("unknown", 1))]
    pairs = links(spark, [(f"{n}{c}", f"{n}new") for n in "abc" for c in ("new", "unknown")])
    none = spark.createDataFrame([], "root string, conflicts array<string>")
    sources = spark.createDataFrame([("s1", "d1")], "source_id string, domain string")
    got = {r["id"]: r["n"] for r in market.market_references(frame(spark, rows), pairs, none, sources, NOW, same_condition=True).collect()}
    assert got["me"] == 3


def test_refresh_scores_only_what_a_change_reaches(spark):
    columns = "id string, city string, zone string, property_type string, condition string, area_basis string, currency string, transaction_type string, min_sqm double, max_sqm double, period string"
    series = lambda zone, low, period="2026-S1": (f"{zone}{period}", "Milano", zone, "office", "good", "commercial", "EUR", "sale", low, low + 500, period)
    old = spark.createDataFrame([series("Z1", 2000.0), series("Z2", 2000.0), series("Z3", 1000.0, "2025-S2")], columns)
    # Z2 gets new amounts, Z3 a newer period, Z4 its first benchmark; Z1 an older row that changes nothing.
    new = spark.createDataFrame([series("Z1", 2000.0), series("Z1", 500.0, "2025-S1"), series("Z2", 2100.0), series("Z3", 1000.0, "2025-S2"), series("Z3", 1500.0), series("Z4", 900.0)], columns)
    hashed = lambda rows: frame(spark, rows).withColumn("content_hash", F.md5(F.concat_ws("|", "title", F.col("price").cast("string"))))
    before = hashed([listing("a", zone="Z1"), listing("b", zone="Z1"), listing("c", zone="Z2"), listing("d", zone="Z3"), listing("e", zone="Z4"), listing("gone", zone="Z1")])
    now = hashed([listing("a", zone="Z1"), listing("b", 150000.0, zone="Z1"), listing("c", zone="Z2"), listing("d", zone="Z3"), listing("e", zone="Z4"), listing("f", zone="Z9")])
    scored, ids = refresh.refresh_changed(scoring.score_listings(before, old, NOW), now, old, new, NOW)
    assert sorted(r["id"] for r in ids.collect()) == ["b", "c", "d", "e", "f"]
    key = lambda df: sorted((r["id"], r["score"], r["priority_score"], r["benchmark_id"], r["benchmark_note"]) for r in df.collect())
    assert key(scored) == key(scoring.score_listings(now, new, NOW))


def test_implausible_cards_are_counted_and_left_out(spark):
    fields = "source_id string, listing_key string, card_id string, seen_at timestamp_ntz, title string, title_how string, price double, currency string, surface double, rooms double, bathrooms double, address string, zone string, city string, property_type string, transaction_type string, price_drop boolean"
    card = lambda key, **o: tuple({**dict(source_id="s", listing_key=key, card_id=key, seen_at=NOW, title="Casa", title_how=rules.TITLE_RANK[0], price=1.0, currency="EUR", surface=None, rooms=None, bathrooms=None, address=None, zone="", city="", property_type="unknown", transaction_type="unknown", price_drop=True), **o}.values())
    cards = spark.createDataFrame([card("a"), card("b", price=0.0), card("c", surface=0.01), card("d", title="x" * 501), card("e", price=None), card("f", title=None), card("g", rooms=1e5)], fields)
    empty = cards.limit(0).withColumn("incomplete", F.lit(False)).withColumn("title_rank", F.lit(1))
    merged = merge.merge_card(empty, cards)
    assert sorted(r["listing_key"] for r in merged.collect()) == ["a", "e"]
    (r,) = merge.card_summary(cards, merged).collect()
    assert (r["cards"], r["rejected"], r["no_price"], r["price_drops"], r["created"]) == (7, 5, 1, 1, 2)


def test_polygons(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    hole = [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6]]
    other = [[0.8, 0.0], [2.0, 0.0], [2.0, 1.0], [0.8, 1.0]]
    zones = spark.createDataFrame([("B1", [[square, hole]]), ("B2", [[other]]), ("B3", [[[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0], [5.0, 6.0]]], [[[5.5, 5.0], [7.0, 5.0], [7.0, 6.0], [5.5, 6.0]]]])],
                                  "zone_code string, polygons array<array<array<array<double>>>>")
    rows = frame(spark, [listing("in", latitude=0.2, longitude=0.2), listing("out", latitude=3.0, longitude=3.0), listing("edge", latitude=0.5, longitude=0.00001),
                         listing("both", latitude=0.5, longitude=0.9), listing("hole", latitude=0.5, longitude=0.5), listing("parts", latitude=5.5, longitude=5.7)])
    assert sorted((r["id"], r["zone_code"]) for r in geo.zone_join(rows, zones).collect()) == [("in", "B1"), ("parts", "B3")]


def test_scenario(spark):
    row = dict(purchase=100000.0, sale=150000.0, works=20000.0, acquisition_costs=5000.0, contingency_pct=10.0, selling_pct=3.0, holding_monthly=100.0, months=12,
               target_roi_pct=0.0, stress_sale_pct=10.0, stress_works_pct=20.0, stress_delay_months=6)
    df = spark.createDataFrame([tuple(row.values()), tuple({**row, "months": 0}.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in row.items()))
    got = scenario.scenario_profit(df).collect()
    r, refused = sorted(got, key=lambda x: -x["months"])
    assert (refused["error"], refused["profit"], refused["target_met"], r["error"]) == ("out of bounds: months", None, None, None)
    assert (r["invested"], r["profit"], r["roi_pct"], r["max_purchase"], r["target_met"]) == (128200.0, 17300.0, 13.49, 117300.0, True)
    assert [scenario.sensitivity_grid(df).where(x).count() for x in ("profit is not null and error is null", "profit is null and error is not null")] == [6, 6]


def test_a_key_stated_three_times_is_one_row(spark):
    old = frame(spark, [listing("a")]).withColumn("content_hash", merge.content_hash())
    batch = frame(spark, [listing("a", p) for p in (190000.0, 170000.0, 180000.0)])
    assert merge.merge_listings(old, batch, NOW).count() == 1
    read = batch.withColumn("read_at", F.when(F.col("price") == 180000.0, F.lit(NOW)).otherwise(F.lit(NOW - timedelta(days=1))))
    assert [r["price"] for r in merge.merge_listings(old, read, NOW).collect()] == [180000.0]


def test_merge_keeps_first_seen_and_closed_state(spark):
    old = frame(spark, [listing("a", first_seen=NOW - timedelta(days=9)), listing("b", availability="sold")]).withColumn("content_hash", merge.content_hash())
    batch = frame(spark, [listing("a", 190000.0), listing("b"), listing("c")])
    got = {r["listing_key"]: r for r in merge.merge_listings(old, batch, NOW).collect()}
    assert got["a"]["changed"] and got["a"]["first_seen"] == NOW - timedelta(days=9) and not got["a"]["created"]
    assert got["b"]["availability"] == "sold" and not got["b"]["changed"] and got["c"]["created"]
    again = merge.merge_listings(merge.merge_listings(old, batch, NOW), batch, NOW)
    assert again.where("changed").count() == 0
    assert {r["kind"] for r in merge.notifications(merge.merge_listings(old, batch, NOW), "r").collect()} == {"new_property", "price_change"}


def test_offers_are_put_together_once_for_both_sides_of_their_pairs(spark):
    rows = frame(spark, [listing("a", surface=100.0), listing("b", surface=101.0, source_id="s2"), listing("c", surface=100.0)])
    pairs = clusters.duplicate_candidates(rows)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 2, 1, 2)]
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()
