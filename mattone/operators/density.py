"""Order statistics of surface bands for market groups of any size, without pairing subjects and comparables.

Comparables get one total order by (group, value) through a range shuffle and are cut into pieces of at most ``PIECE``
consecutive elements; a group of any size is a run of pieces, most groups lie in one. Each distinct surface of a group asks once,
in chunks of at most ``PIECE`` questions. A task that holds a piece and a chunk sorts the piece by surface, so a band is an interval
of places, and keeps a tree over it that halves the values' ranks level by level: at each level a place is mapped to
its place among the lower or upper half by running counts. The k-th value of any interval, or how many of its values are below a
bound, takes one step a level, for all questions at once.

Groups of one piece are answered there. For the others each piece first says how many of its elements each band holds; running sums
over the pieces tell which piece holds a wanted rank and at which place, and only those are asked again. A subject's own asset
is one element of the answer at most; it is taken out afterwards by shifting ranks.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, over_tasks

#: Elements of a piece and questions of a chunk at most; a power of two.
PIECE = 1 << 15
QUARTILES = {"q1_raw": 0.25, "median_raw": 0.5, "q3_raw": 0.75}
#: A quartile of n elements, and of n less one, reads five ranks; then the two lowest and the two highest.
SLOTS = 5 * len(QUARTILES) + 4
KEYS = ["seg", "comp_condition"]


class RankTree:
    """Ranks 0 to n - 1 in some order of places, halved level by level."""

    def __init__(self, ranks: np.ndarray):
        self.n = len(ranks)
        self.levels = []
        for bit in range(max(self.n - 1, 1).bit_length() - 1, -1, -1):
            upper = (ranks >> bit) & 1
            lower = np.concatenate([[0], np.cumsum(1 - upper)])
            self.levels.append((bit, lower))
            ranks = np.concatenate([ranks[upper == 0], ranks[upper == 1]])

    def pick(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest rank (from 0) among the places start to stop."""
        found = np.zeros(len(k), np.int64)
        for bit, lower in self.levels:
            a, b = lower[start], lower[stop]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            found += np.where(up, 1 << bit, 0)
            start, stop = np.where(up, lower[-1] + start - a, a), np.where(up, lower[-1] + stop - b, b)
        return found

    def below(self, start: np.ndarray, stop: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many ranks among the places lie below the bound."""
        whole = bound >= self.n
        count = np.where(whole, stop - start, 0)
        for bit, lower in self.levels:
            a, b = lower[start], lower[stop]
            up = (bound >> bit) & 1 == 1
            count += np.where(up & ~whole, b - a, 0)
            start, stop = np.where(up, lower[-1] + start - a, a), np.where(up, lower[-1] + stop - b, b)
        return count


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value (ties in any order) and the values by rank."""
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    return ranks, values[order]


def wanted(n: np.ndarray) -> np.ndarray:
    """Ranks that quartiles and extremes of n elements, and of n less one, read; one row of ``SLOTS`` a question."""
    columns = []
    for q in QUARTILES.values():
        full, less = np.floor((n - 1) * q).astype(np.int64), np.floor((n - 2) * q).astype(np.int64)
        columns += [full, full + 1, less, less + 1, less + 2]
    columns += [np.zeros_like(n), np.ones_like(n), n - 2, n - 1]
    return np.clip(np.stack(columns, 1), 0, (n - 1)[:, None])


def wanted_column(n: Column) -> Column:
    ranks = []
    for q in QUARTILES.values():
        full, less = F.floor((n - 1) * q), F.floor((n - 2) * q)
        ranks += [full, full + 1, less, less + 1, less + 2]
    ranks += [F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), n - 2, n - 1]
    return F.array(*[F.greatest(F.lit(0).cast("bigint"), F.least(r.cast("bigint"), n - 1)) for r in ranks])


def pieces_of(pool: DataFrame, value: Column, fields: list[Column]) -> DataFrame:
    """KEYS, piece, alone (its group has no other), elements (structs with ``pos``, ``at`` = surface and the fields, by value)."""
    by = [*[F.col(k) for k in KEYS], value, F.col("comp_id")]
    placed = (pool.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id())
              .select(*KEYS, "pos", F.col("comp_surface").alias("at"), *fields))
    names = [c for c in placed.columns if c not in KEYS]
    packed = placed.groupBy(*KEYS, F.shiftright("pos", PIECE.bit_length() - 1).alias("piece")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("elements"))
    return packed.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(*KEYS)) == 1)


def questions_of(subjects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk, asked (distinct surfaces, at most about ``PIECE``)."""
    each = subjects.select(*keys, "surface").distinct()
    sizes = each.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) * 2 / PIECE).alias("_chunks"))
    chunk = F.pmod(F.xxhash64("surface"), F.col("_chunks"))
    return each.join(sizes, keys).groupBy(*keys, chunk.alias("chunk")).agg(F.collect_list("surface").alias("asked"))


def lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def list_of(rows: np.ndarray, type_: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), type_))


def intervals(surface: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements, sorted by surface, within 30 % of each asked surface."""
    return np.searchsorted(surface, asked * 0.7, "left"), np.searchsorted(surface, asked * 1.3, "right")


def per_piece(df: DataFrame, schema: str, answer: Callable[[dict, np.ndarray, dict], dict | None], keep: list[str]) -> DataFrame:
    """``answer`` of (element arrays sorted by surface, asked surfaces, kept columns of the row); ``keep`` columns are repeated."""
    fields = [f.name for f in df.schema["elements"].dataType.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            inner, first = lists(column("elements"))
            values = {name: numbers(inner.field(i)) for i, name in enumerate(fields)}
            asked, begin = lists(column("asked"))
            asked, flags = numbers(asked), numbers(column("alone"))
            more = {name: lists(column(name)) for name in ("slot", "rank") if name in batch.schema.names}
            rows, parts = [], []
            for r in range(batch.num_rows):
                own = {name: v[first[r]:first[r + 1]] for name, v in values.items()}
                order = np.argsort(own["at"], kind="stable")
                extra = {name: numbers(v)[o[r]:o[r + 1]] for name, (v, o) in more.items()} | {"alone": flags[r]}
                part = answer({name: v[order] for name, v in own.items()}, asked[begin[r]:begin[r + 1]], extra)
                if part is not None:
                    size = len(next(iter(part.values())))
                    rows.append(np.full(size, r))
                    parts.append(part)
            if not parts:
                continue
            back = pa.array(np.concatenate(rows))
            out = {name: column(name).take(back) for name in keep}
            for name in parts[0]:
                both = [p[name] for p in parts]
                out[name] = list_of(np.concatenate(both), pa.int64() if both[0].dtype == np.int64 else pa.float64()) if both[0].ndim == 2 else pa.array(np.concatenate(both))
            yield pa.RecordBatch.from_pydict(out)

    # A group's rows are few bytes and much work, so their number and not their size decides on the tasks.
    return over_tasks(df).mapInArrow(run, schema)


def band_answers(subjects: DataFrame, pool: DataFrame, same_condition: bool) -> DataFrame:
    """KEYS, surface, n, prices (``SLOTS`` values), early and late (two times each), origins: one row per asked surface with a comparable.

    pool: comp_id, comp_surface, comp_sqm, comp_seen and ``before``, the next smaller surface of the same origin (of equal ones the first holds it).
    """
    moment = F.unix_micros(F.col("comp_seen").cast("timestamp")).alias("t")
    pieces = cut_lineage(pieces_of(pool, F.col("comp_sqm"), [F.col("comp_sqm").alias("price"), moment, F.coalesce("before", F.lit(-1.0)).alias("before")]))
    asked = subjects.withColumnRenamed("condition", "comp_condition") if same_condition else subjects
    keys = KEYS if same_condition else ["seg"]
    met = pieces.join(questions_of(asked, keys), keys)

    def first_pass(e: dict, surfaces: np.ndarray, row: dict) -> dict | None:
        start, stop = intervals(e["at"], surfaces)
        some = stop > start
        if not some.any():
            return None
        start, stop, surfaces = start[some], stop[some], surfaces[some]
        n = stop - start
        times, by_time = ranked(e["t"])
        tree = RankTree(times)
        two = [by_time[tree.pick(start, stop, np.clip(k, 0, n - 1))] for k in (0 * n, 0 * n + 1, n - 1, n - 2)]
        earlier, by_before = ranked(e["before"])
        origins = RankTree(earlier).below(start, stop, np.searchsorted(by_before, surfaces * 0.7, "left"))
        prices = np.zeros((len(n), SLOTS if row["alone"] else 0))
        if row["alone"]:
            ranks, by_price = ranked(e["price"])
            k = wanted(n)
            prices = by_price[RankTree(ranks).pick(np.repeat(start, SLOTS), np.repeat(stop, SLOTS), k.ravel())].reshape(-1, SLOTS)
        # A lone element is its own second one; it must not stand in twice when pieces are put together.
        early, late = np.stack(two[:2], 1), np.stack(two[2:], 1)
        return {"surface": surfaces, "n": n.astype(np.int64), "early": early.astype(np.int64), "late": late.astype(np.int64), "origins": origins.astype(np.int64),
                "prices": prices if row["alone"] else np.full((len(n), 1), np.nan)}

    kept = [*KEYS, "piece", "chunk", "alone"]
    schema = "seg string, comp_condition string, piece bigint, chunk bigint, alone boolean, surface double, n bigint, early array<bigint>, late array<bigint>, origins bigint, prices array<double>"
    told = cut_lineage(per_piece(met.select(*kept, "elements", "asked"), schema, _ragged(first_pass), kept))
    at = [*KEYS, "surface"]
    columns = [*at, "n", "prices", "early", "late", "origins"]
    whole = told.where("alone").select(*columns)
    parts = told.where("NOT alone")
    if not parts.limit(1).count():
        return whole
    return whole.unionByName(_put_together(parts, pieces).select(*columns))


def _ragged(answer: Callable) -> Callable:
    """Rows of one batch must agree on the width of ``prices``: pieces of larger groups fill it with NaN."""
    def run(e, asked, row):
        part = answer(e, asked, row)
        if part is not None and part["prices"].shape[1] != SLOTS:
            part["prices"] = np.full((len(part["n"]), SLOTS), np.nan)
        return part
    return run


def _put_together(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """The answers of groups of several pieces."""
    at = [*KEYS, "surface"]
    along = Window.partitionBy(*at).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
    counted = parts.withColumn("base", F.sum("n").over(along) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*at)))
    slots = counted.select(*KEYS, "piece", "chunk", "surface", "base", "n", "all", F.posexplode(wanted_column(F.col("all"))).alias("slot", "rank"))
    slots = slots.where((F.col("rank") >= F.col("base")) & (F.col("rank") < F.col("base") + F.col("n")))
    each = F.sort_array(F.collect_list(F.struct("surface", "slot", (F.col("rank") - F.col("base")).alias("rank"))))
    asked = slots.groupBy(*KEYS, "piece", "chunk").agg(each.alias("q")).select(*KEYS, "piece", "chunk", F.col("q.surface").alias("asked"), F.col("q.slot").alias("slot"), F.col("q.rank").alias("rank"))

    def second_pass(e: dict, surfaces: np.ndarray, row: dict) -> dict:
        start, stop = intervals(e["at"], surfaces)
        ranks, by_price = ranked(e["price"])
        return {"surface": surfaces, "slot": row["slot"].astype(np.int32), "price": by_price[RankTree(ranks).pick(start, stop, row["rank"].astype(np.int64))]}

    found = per_piece(pieces.join(asked, [*KEYS, "piece"]).select(*KEYS, "alone", "elements", "asked", "slot", "rank"), "seg string, comp_condition string, surface double, slot int, price double", second_pass, KEYS)
    prices = found.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "price"))), lambda x: x["price"]).alias("prices"))
    # Two of each piece, once where a piece holds one element.
    few = lambda c: F.flatten(F.collect_list(F.when(F.col("n") == 1, F.slice(c, 1, 1)).otherwise(F.col(c))))
    rest = counted.groupBy(*at).agg(F.sum("n").alias("n"), F.slice(F.sort_array(few("early")), 1, 2).alias("early"),
                                    F.slice(F.sort_array(few("late"), False), 1, 2).alias("late"), F.sum("origins").alias("origins"))
    return rest.join(prices, at)


def with_neighbours(pool: DataFrame) -> DataFrame:
    """pool with ``before`` (next smaller surface of the same origin; only the first of equal ones has it, the others their own surface),
    and of its origin's cell: elements, next smaller and next larger surface."""
    by = [*KEYS, "comp_origin"]
    cells = pool.groupBy(*by, "comp_surface").agg(F.count(F.lit(1)).alias("cell_n"), F.min("comp_id").alias("_first"))
    along = Window.partitionBy(*by).orderBy("comp_surface")  # one row per distinct surface
    cells = cells.withColumn("cell_before", F.lag("comp_surface").over(along)).withColumn("cell_after", F.lead("comp_surface").over(along))
    out = pool.join(cells, [*by, "comp_surface"])
    return out.withColumn("before", F.when(F.col("comp_id") == F.col("_first"), F.col("cell_before")).otherwise(F.col("comp_surface"))).drop("_first")


def _own_elements(subjects: DataFrame, pool: DataFrame) -> DataFrame:
    """The element of the pool that stands for the subject's own asset, where it lies in the band, and whether it is its origin's only one there."""
    own = pool.select("seg", F.col("comp_root").alias("root"), "comp_condition", F.col("comp_surface").alias("own_surface"), F.col("comp_sqm").alias("own_sqm"),
                      F.unix_micros(F.col("comp_seen").cast("timestamp")).alias("own_t"), "cell_n", "cell_before", "cell_after")
    low, high = F.col("surface") * 0.7, F.col("surface") * 1.3
    lone = (F.col("cell_n") == 1) & (F.coalesce("cell_before", F.lit(-1.0)) < low) & F.coalesce(F.col("cell_after") > high, F.lit(True))
    return (subjects.select("id", "seg", "root", "surface").join(own, ["seg", "root"]).where((F.col("own_surface") >= low) & (F.col("own_surface") <= high))
            .select("id", "comp_condition", "own_sqm", "own_t", lone.alias("lone")))


def band_stats(subjects: DataFrame, pool: DataFrame, same_condition: bool) -> DataFrame:
    """Count, quartiles, extremes, dates and sources of the comparables within 30 % of each subject's surface."""
    pool = cut_lineage(with_neighbours(pool))
    answers = band_answers(subjects, pool, same_condition)
    if same_condition:
        asked = subjects.withColumn("comp_condition", F.col("condition")).join(answers, [*KEYS, "surface"])
    else:
        asked = subjects.join(answers, ["seg", "surface"])
    rows = asked.join(_own_elements(subjects, pool), ["id", "comp_condition"], "left")
    own, prices = F.col("own_sqm"), F.col("prices")
    rows = rows.withColumn("m", F.col("n") - F.when(own.isNotNull(), 1).otherwise(0)).where("m > 0")

    def less_own(here: Column, then: Column) -> Column:
        return F.when(own.isNull() | (own > here), here).otherwise(then)

    def quantile(place: int, q: float) -> Column:
        position = (F.col("m") - 1) * q
        v = [prices[5 * place + i] for i in range(5)]
        low = F.when(own.isNull(), v[0]).otherwise(less_own(v[2], v[3]))
        high = F.when(own.isNull(), v[1]).otherwise(less_own(v[3], v[4]))
        share = position - F.floor(position)
        return F.when(share == 0, low).otherwise(low + (high - low) * share)

    low, second, less, high = (prices[SLOTS - 4 + i] for i in range(4))
    t = F.col("own_t")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return rows.select(
        "id", "comp_condition", F.col("m").alias("n"), *[quantile(i, q).alias(name) for i, (name, q) in enumerate(QUARTILES.items())],
        less_own(low, second).alias("min_raw"), F.when(own.isNull() | (own < high), high).otherwise(less).alias("max_raw"),
        time(F.when(t.isNull() | (t > F.col("early")[0]), F.col("early")[0]).otherwise(F.col("early")[1])).alias("oldest"),
        time(F.when(t.isNull() | (t < F.col("late")[0]), F.col("late")[0]).otherwise(F.col("late")[1])).alias("newest"),
        (F.col("origins") - F.when(F.coalesce("lone", F.lit(False)), 1).otherwise(0)).cast("bigint").alias("source_count"))


def band_newest(subjects: DataFrame, pool: DataFrame, shown: int) -> DataFrame:
    """The ``shown`` newest comparables in the band of each subject and condition, its own asset left out, with their position.

    Pieces are ordered by recency, so an element's place is its rank; each piece names the first of a band, one more than shown.
    """
    wanted_n = shown + 1
    fields = [F.col(c) for c in pool.columns if c not in (*KEYS, "comp_surface")]
    by = [*[F.col(k) for k in KEYS], F.desc("comp_seen"), F.col("comp_id")]
    placed = cut_lineage(pool.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()))
    packed = placed.groupBy(*KEYS, F.shiftright("pos", PIECE.bit_length() - 1).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("comp_surface").alias("at")))).alias("elements"))
    met = packed.withColumn("alone", F.lit(True)).join(questions_of(subjects, ["seg"]), "seg")

    def newest(e: dict, surfaces: np.ndarray, row: dict) -> dict | None:
        start, stop = intervals(e["at"], surfaces)
        ranks, by_pos = ranked(e["pos"])
        n = np.minimum(stop - start, wanted_n)
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return None
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return {"surface": surfaces[which], "pos": by_pos[RankTree(ranks).pick(start[which], stop[which], k)].astype(np.int64)}

    named = per_piece(met.select(*KEYS, "alone", "elements", "asked"), "seg string, comp_condition string, surface double, pos bigint", newest, KEYS)
    shown_fields = placed.select("pos", F.struct("pos", F.col("comp_surface").alias("comp_surface"), *fields).alias("x"))
    # At most ``wanted_n`` a piece and question.
    lists_ = (named.join(shown_fields, "pos").groupBy("seg", "comp_condition", "surface").agg(F.slice(F.array_sort(F.collect_list("x")), 1, wanted_n).alias("found")))
    others = lambda found: F.slice(F.filter(found, lambda x: x["comp_root"] != F.col("root")), 1, shown)
    out = subjects.join(lists_, ["seg", "surface"]).select("id", "comp_condition", F.posexplode(others(F.col("found"))).alias("position", "x"))
    return out.select("id", "comp_condition", (F.col("position") + 1).alias("position"), "x.*").drop("pos")
