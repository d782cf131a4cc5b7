"""Positions by ranges of the order, against a sort on the driver."""
import random

from pyspark.sql import functions as F

from mattone.functions.ranks import with_position, with_position_in


def test_position_is_the_place_in_the_whole_order(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1, 2, 2, 3]), "x") for i in range(500)]
    df = spark.createDataFrame(data, "id int, v int, _n string").repartition(7)
    got = with_position(df, [F.desc_nulls_last("v"), F.asc("id")]).collect()
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v, r._n) for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(1, 501))
    assert with_position(df.limit(0), [F.asc("id")]).count() == 0


def test_position_within_a_hot_key_and_a_null_key(spark):
    data = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 12}") for i in range(600)]
    df = spark.createDataFrame(data, "id int, k string").repartition(5)
    want = {}
    for i, k in sorted(data, reverse=True):
        want.setdefault(k, []).append(i)
    got = {r.id: r.position for r in with_position_in(df, "k", [F.desc("id")]).collect()}
    assert got == {i: n for ids in want.values() for n, i in enumerate(ids, 1)}
