"""Surface bands against brute force, with groups that are cut into many pieces."""
import random
import statistics
from datetime import timedelta

import numpy as np
import pytest

from mattone.operators import density

from conftest import NOW

POOL = "seg string, comp_condition string, comp_root string, comp_id string, comp_title string, comp_url string, comp_surface double, comp_price double, comp_sqm double, comp_seen timestamp_ntz, comp_source string, comp_origin string"
SUBJECTS = "id string, seg string, root string, surface double, condition string"


def test_rank_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 100):
        ranks = rng.permutation(n)
        tree = density.RankTree(ranks)
        for _ in range(40):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a + 1, n + 1))
            inside = np.sort(ranks[a:b])
            k, bound = int(rng.integers(0, b - a)), int(rng.integers(0, n + 1))
            one = np.array([a]), np.array([b])
            assert tree.pick(*one, np.array([k]))[0] == inside[k] and tree.below(*one, np.array([bound]))[0] == (inside < bound).sum()


def archive(seed, n=160):
    """One crowded group, one small one; equal surfaces, prices and times; surfaces of three decimals; some assets among the subjects."""
    rng = random.Random(seed)
    pool, subjects = [], []
    for i in range(n):
        seg = "big" if i % 10 else "small"
        surface = rng.choice([50.0, 65.005, 71.429, 100.0, round(rng.uniform(30, 200), 3)])
        price = rng.choice([1000.0, 1500.0, round(rng.uniform(500, 4000), 2)])
        condition = rng.choice(["good", "new"])
        pool.append((seg, condition, f"r{i}", f"c{i:03}", "t", "u", surface, price * surface, price, NOW - timedelta(days=rng.randrange(40)), "s", f"o{rng.randrange(5)}"))
        subjects.append((f"c{i:03}", seg, f"r{i}", surface if rng.random() < 0.8 else round(rng.uniform(30, 200), 3), condition))
    subjects += [(f"x{i}", "big", f"x{i}", round(rng.uniform(20, 300), 3), "good") for i in range(20)] + [("y", "none", "y", 50.0, "new")]
    return pool, subjects


def inside(pool, subject, condition):
    return [p for p in pool if p[0] == subject[1] and p[1] == condition and p[2] != subject[2] and subject[3] * 0.7 <= p[6] <= subject[3] * 1.3]


@pytest.mark.parametrize("piece", [8, 32, 1 << 15])
@pytest.mark.parametrize("same", [False, True])
def test_band_stats_equal_brute_force(spark, monkeypatch, piece, same):
    monkeypatch.setattr(density, "PIECE", piece)
    pool, subjects = archive(piece + same)
    got = {(r.id, r.comp_condition): r for r in density.band_stats(spark.createDataFrame(subjects, SUBJECTS), spark.createDataFrame(pool, POOL), same).collect()}
    want = {}
    for s in subjects:
        for condition in ([s[4]] if same else ["good", "new"]):
            found = inside(pool, s, condition)
            if found:
                want[s[0], condition] = found
    assert got.keys() == want.keys()
    for key, found in want.items():
        r, prices = got[key], sorted(p[8] for p in found)
        assert (r.n, r.min_raw, r.max_raw, r.source_count) == (len(found), prices[0], prices[-1], len({p[11] for p in found})), key
        assert (r.oldest, r.newest) == (min(p[9] for p in found), max(p[9] for p in found))
        quartiles = np.quantile(prices, [0.25, 0.5, 0.75])
        assert np.allclose([r.q1_raw, r.median_raw, r.q3_raw], quartiles, atol=1e-9) and abs(r.median_raw - statistics.median(prices)) < 1e-9


@pytest.mark.parametrize("piece", [8, 1 << 15])
def test_newest_of_a_band_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(density, "PIECE", piece)
    pool, subjects = archive(7)
    got = {}
    for r in density.band_newest(spark.createDataFrame(subjects, SUBJECTS), spark.createDataFrame(pool, POOL), 5).collect():
        got.setdefault((r.id, r.comp_condition), []).append((r.position, r.comp_id))
    want = {}
    for s in subjects:
        for condition in ("good", "new"):
            found = sorted(inside(pool, s, condition), key=lambda p: (-p[9].timestamp(), p[3]))[:5]
            if found:
                want[s[0], condition] = [(i + 1, p[3]) for i, p in enumerate(found)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rows_written_follow_the_listings(spark, monkeypatch):
    """Five times the listings of one group, each with a surface of its own: five times the rows, not twenty-five."""
    written = []
    kept = density.cut_lineage
    monkeypatch.setattr(density, "cut_lineage", lambda df: written.append(kept(df)) or written[-1])
    sizes = []
    for n in (400, 2000):
        written.clear()
        rows = [("g", "new", f"r{i}", f"c{i}", "t", "u", 50 + i / n, 1e5, 1000.0 + i, NOW, "s", "o") for i in range(n)]
        asked = [(f"c{i}", "g", f"r{i}", 50 + i / n, "new") for i in range(n)]
        assert density.band_stats(spark.createDataFrame(asked, SUBJECTS), spark.createDataFrame(rows, POOL), False).count() == n
        sizes.append(sum(df.count() for df in written))
    assert sizes[1] <= 5.5 * sizes[0]
