"""Fuzzy passages that documents share: seeds, collinear chains, alignment.

1. Seeds are minimizers of word k-mers: of every ``WINDOW`` neighbouring k-mers the one with the smallest hash, so any run of
   ``WINDOW + K - 1`` equal words shares a seed whatever surrounds it.
2. Seeds are joined on their hash. Every occurrence is matched with the seed's first one (smallest document, smallest place),
   not with all others: a passage in n documents costs n matches and not n squared. The first one comes from a grouping
   with map-side combine, the join back is one that Spark can split where a seed is very frequent.
   The seeds of one passage may have their first ones in several documents, one in each. So what no chain held in the first
   round is asked again by pairs: any two seeds that a document shares with others and holds at most ``MOST_GAP`` words
   apart, at least one of them left over somewhere, are matched with the first document that holds both so. Whatever two
   documents could chain is made of such pairs, so each of its seeds gets a chain, if perhaps with a third document.
3. Per document and partner, matches are chained in order in both texts: score = K + max over earlier matches of
   (score - GAP * words skipped in both), the maximum taken from a Fenwick tree over the partner's places.
4. Chains are aligned on the words themselves: equal stretches by comparison, differing ones by their longest common
   subsequence, both ends are extended while words go on to agree. All parts of a chain with ``IDENTITY`` or more are pieces.
5. Pieces of a document (as either side) that touch are one passage; passages of ``LEAST`` words or more are returned. The
   pieces of one passage may have different partners, so it does not matter which document came first for which seed.

Rules: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``. Texts shorter than a k-mer, empty or null have no passage. Rows
without an id take no part; rows that repeat an id are one document, passages only count between different ids. An empty
table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut_lineage
from .words import grams, mix, slices

K = 8
WINDOW = 12
GAP = 0.05
MOST_GAP = 60
#: Words around a chain that are read for the extension, at least.
AROUND = 32
IDENTITY = 0.8
TOUCH = 8
LEAST = 50


def minimizers(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place (first word) and hash of the seeds."""
    hashes, begin = grams(words, K)
    long = words.counts() >= K
    if not len(hashes) or not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(long)), np.diff(begin))
    at = np.zeros(0, np.int64)
    if len(hashes) >= WINDOW:
        first = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).argmin(axis=1) + np.arange(len(hashes) - WINDOW + 1)
        at = first[row[:len(first)] == row[WINDOW - 1:]]
    short = [begin[r] + hashes[begin[r]:begin[r + 1]].argmin() for r in np.flatnonzero(long & (np.diff(begin) < WINDOW) & (np.diff(begin) > 0))]
    at = np.unique(np.concatenate([at, np.array(short, np.int64)]))
    at = at[long[row[at]]]
    # The n-th time a document holds a seed is a seed of its own, so that repeated lines chain line by line.
    order = np.lexsort((at, hashes[at], row[at]))
    r, h = row[at][order], hashes[at][order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])
    time = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return r, at[order] - begin[r], mix(h + time.astype(np.uint64))


def seeds(docs: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1)):
                row, place, seed = minimizers(words)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).take(pa.array(words.rows[row])), pa.array(place.astype(np.int32))], names=["seed", "doc_id", "place"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, "seed bigint, doc_id bigint, place int")


def matches(found: DataFrame) -> DataFrame:
    """(seed, doc_id, place, partner, at): each occurrence of a seed with the seed's first one in another document."""
    first = (found.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("_first"), F.max("doc_id").alias("_last"))
             .where("_first.doc_id <> _last").select("seed", F.col("_first.doc_id").alias("partner"), F.col("_first.place").alias("at")))
    return found.join(first, "seed").where("doc_id <> partner").select("seed", "doc_id", "place", "partner", "at")


def pair_matches(matched: DataFrame, chain: DataFrame) -> DataFrame:
    """(doc_id, place, partner, at) of the seeds of near pairs with the first other document that holds the pair.

    Only pairs with a seed that some document holds outside of all its chains.
    """
    held = chain.select("doc_id", F.explode("xs").alias("place")).distinct()
    left = matched.join(held, ["doc_id", "place"], "left_anti").select("seed", F.lit(True).alias("open")).distinct()
    shared = matched.select("seed", "doc_id", "place").union(matched.select("seed", "partner", "at").distinct())
    marked = shared.join(left, "seed", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    # A document's shared seeds are no more than its own seeds.
    rows = marked.groupBy("doc_id").agg(F.collect_list(F.struct("place", "seed", "open")).alias("s"), F.max("open").alias("any")).where("any").select("doc_id", "s")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                s = batch.column(1)[r].values
                place, seed, is_open = (s.field(c).to_numpy(zero_copy_only=False) for c in ("place", "seed", "open"))
                order = np.argsort(place, kind="stable")
                place, seed, is_open = place[order], seed[order].view(np.uint64), is_open[order]
                step, at = 1, np.arange(len(place))
                while len(at := at[at + step < len(place)]) and len(at := at[place[at + step] - place[at] <= MOST_GAP]):
                    one = at[is_open[at] | is_open[at + step]]
                    if len(one):
                        key = mix(mix(seed[one]) + seed[one + step])
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(one), batch.column(0)[r].as_py(), np.int64)), pa.array(place[one]), pa.array(place[one + step])],
                                                         names=["seed", "doc_id", "place", "next"])
                    step += 1

    pairs = cut_lineage(rows.mapInArrow(pair, "seed bigint, doc_id bigint, place int, next int"))
    first = (pairs.groupBy("seed").agg(F.min(F.struct("doc_id", "place", "next")).alias("_first"), F.max("doc_id").alias("_last"))
             .where("_first.doc_id <> _last").select("seed", F.col("_first.doc_id").alias("partner"), F.col("_first.place").alias("at"), F.col("_first.next").alias("next_at")))
    both = F.explode(F.array(F.struct("place", "at"), F.struct(F.col("next").alias("place"), F.col("next_at").alias("at")))).alias("m")
    return pairs.join(first, "seed").where("doc_id <> partner").select("doc_id", "partner", both).select("doc_id", "m.place", "partner", "m.at").distinct()


class Fenwick:
    """Maxima of (value, index) over prefixes."""

    def __init__(self, n: int):
        self.value, self.index = [0.0] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, index: int) -> None:
        while i < len(self.value):
            if self.index[i] < 0 or value > self.value[i]:
                self.value[i], self.index[i] = value, index
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        value, index = 0.0, -1
        while i > 0:
            if self.index[i] >= 0 and (index < 0 or self.value[i] > value):
                value, index = self.value[i], self.index[i]
            i -= i & -i
        return value, index


def chained(place: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Best collinear chains of matches, best first; every match is in one chain at most. ``place`` rises."""
    n = len(place)
    rank = np.unique(at, return_inverse=True)[1] + 1
    tree, score, before = Fenwick(int(rank.max())), [0.0] * n, [-1] * n
    here, there = place.tolist(), at.tolist()
    for j in range(n):
        way = GAP * (here[j] + there[j])
        value, i = tree.best(int(rank[j]) - 1)
        gain = value - way if i >= 0 else 0.0
        score[j] = K + max(0.0, gain)
        before[j] = i if gain > 0 else -1
        tree.put(int(rank[j]), score[j] + way, j)
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        chain = []
        while j >= 0 and not used[j]:
            if chain and (here[chain[-1]] - here[j] > MOST_GAP or there[chain[-1]] - there[j] > MOST_GAP):
                break
            used[j] = True
            chain.append(j)
            j = before[j]
        if len(chain) >= 2:
            out.append(chain[::-1])
    return out


def chains(matched: DataFrame) -> DataFrame:
    """(doc_id, partner, xs, ys): the places of the seeds of each chain in document and partner."""
    # A document's matches are no more than its own seeds.
    rows = matched.groupBy("doc_id").agg(F.collect_list(F.struct("partner", "place", "at")).alias("m"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                m = batch.column(1)[r].values
                partner, place, at = (m.field(c).to_numpy(zero_copy_only=False) for c in ("partner", "place", "at"))
                order = np.lexsort((place, partner))
                partner, place, at = partner[order], place[order], at[order]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(partner)) + 1, [len(partner)]])
                for a, b in zip(edges[:-1], edges[1:]):
                    if b - a >= 2:
                        for c in chained(place[a:b], at[a:b]):
                            out.append((batch.column(0)[r].as_py(), int(partner[a]), place[a:b][c], at[a:b][c]))
            for i in range(0, len(out), 5000):
                c = list(zip(*out[i:i + 5000]))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.list_(pa.int32()))], names=["doc_id", "partner", "xs", "ys"])

    return rows.mapInArrow(chain, "doc_id bigint, partner bigint, xs array<int>, ys array<int>")


def segments(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, lo, hi) -> also words: 32-bit hashes of the words lo to hi of the document."""
    # Ranges begin and end at multiples of AROUND, so even a document that very many chains point to has few distinct ones.
    wanted = asked.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    joined = docs.select(F.col("doc_id").cast("bigint"), "text").join(wanted, "doc_id").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for words in slices(batch.column(1)):
                small = (words.hashes & np.uint64(0x7FFFFFFF)).astype(np.int32)
                for r, row in enumerate(words.rows):
                    mine = small[words.first[r]:words.first[r + 1]]
                    for x in batch.column(2)[int(row)].as_py():
                        out.append((batch.column(0)[int(row)].as_py(), x["lo"], x["hi"], mine[x["lo"]:x["hi"]]))
                        held += x["hi"] - x["lo"]
                if held > 1_000_000:
                    yield packed(out)
                    out, held = [], 0
            if out:
                yield packed(out)

    def packed(out):
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.int32()))], names=["doc_id", "lo", "hi", "words"])

    return joined.mapInArrow(cut, "doc_id bigint, lo int, hi int, words array<int>").dropDuplicates(["doc_id", "lo", "hi"])


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of a longest common subsequence of two short runs."""
    rows = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, x in enumerate(a):
        step = np.where(b == x, rows[i, :-1] + 1, rows[i, 1:])
        rows[i + 1, 1:] = np.maximum.accumulate(step)
    i, j, pairs = len(a), len(b), []
    while i and j and rows[i, j]:
        if rows[i - 1, j] == rows[i, j]:
            i -= 1
        elif rows[i, j - 1] == rows[i, j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    found = np.array(pairs[::-1], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def extended(a: np.ndarray, b: np.ndarray) -> int:
    """Words by which an alignment goes on, on one diagonal: up to where agreement last outweighed difference."""
    n = min(len(a), len(b))
    if not n:
        return 0
    score = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    lost = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > 8)
    score = score[:lost[0]] if len(lost) else score
    return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0


def aligned(xs: list[int], ys: list[int], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y of the equal words of the alignment; places are relative to the segments."""
    less = extended(x[:xs[0]][::-1], y[:ys[0]][::-1])
    a, b = xs[0] - less, ys[0] - less
    here, there = [], []

    def straight(u: int) -> np.ndarray:
        return np.flatnonzero(x[a:u] == y[b:b + u - a])

    for u, v in zip(xs + [xs[-1] + K], ys + [ys[-1] + K]):
        same = straight(u) if u - a == v - b else np.zeros(0, np.int64)
        # Before the first seed lies the extension, which is on one diagonal.
        i, j = (same, same) if not here or (u - a == v - b and len(same) >= IDENTITY * (u - a)) else common(x[a:u], y[b:v])
        here.append(a + i)
        there.append(b + j)
        a, b = u, v
    more = straight(a + extended(x[a:], y[b:]))
    return np.concatenate([*here, a + more]), np.concatenate([*there, b + more])


def parts(px: np.ndarray, py: np.ndarray) -> list[tuple[int, int]]:
    """First and last pair of every stretch of equal words with ``IDENTITY`` that no longer such stretch holds.

    From the first word of each run of equal words a stretch goes to the last end of a run up to which it is alike enough,
    so an unlike stretch inside a chain parts it and a chain alike as a whole stays whole.
    """
    edge = np.flatnonzero((np.diff(px) != 1) | (np.diff(py) != 1)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(px)]]) - 1
    out, reach = [], -1
    for k, i in enumerate(first):
        if reach == len(px) - 1:
            break
        alike = last[k:] - i + 1 >= IDENTITY * (np.maximum(px[last[k:]] - px[i], py[last[k:]] - py[i]) + 1)
        j = int(last[k:][alike][-1])
        if j > reach:
            out.append((int(i), j))
            reach = j
    return out


def pieces(docs: DataFrame, chain: DataFrame) -> DataFrame:
    """(doc_id, start, stop, partner, start_there, stop_there, equal, late) of the parts of chains that align well enough."""
    def bounds(c, lo, hi):
        first, last = F.get(c, F.lit(0)), F.element_at(c, -1)
        return {lo: F.greatest(F.lit(0), (F.floor(first / AROUND) - 1) * AROUND).cast("int"), hi: ((F.ceil((last + K) / AROUND) + 1) * AROUND).cast("int")}

    ranged = cut_lineage(chain.withColumns(bounds(F.col("xs"), "xlo", "xhi") | bounds(F.col("ys"), "ylo", "yhi")))
    asked = (ranged.select("doc_id", F.col("xlo").alias("lo"), F.col("xhi").alias("hi"))
             .union(ranged.select("partner", "ylo", "yhi")).distinct())
    words = cut_lineage(segments(docs, asked))
    here = words.select("doc_id", F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), F.col("words").alias("x"))
    there = words.select(F.col("doc_id").alias("partner"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), F.col("words").alias("y"))
    both = ranged.join(here, ["doc_id", "xlo", "xhi"]).join(there, ["partner", "ylo", "yhi"]).select("doc_id", "partner", "xs", "ys", "xlo", "ylo", "x", "y", F.col("late").cast("bigint"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                doc, partner, xs, ys, xlo, ylo = (batch.column(i)[r].as_py() for i in range(6))
                x, y = (batch.column(i)[r].values.to_numpy() for i in (6, 7))
                px, py = aligned([p - xlo for p in xs], [p - ylo for p in ys], x, y)
                out += [(doc, int(px[i]) + xlo, int(px[j]) + xlo + 1, partner, int(py[i]) + ylo, int(py[j]) + ylo + 1, j - i + 1, batch.column(8)[r].as_py()) for i, j in parts(px, py)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "stop", "partner", "start_there", "stop_there", "equal", "late"])

    return both.mapInArrow(align, "doc_id bigint, start bigint, stop bigint, partner bigint, start_there bigint, stop_there bigint, equal bigint, late bigint")


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_pieces, partner (smallest other document), duplicate (the partner comes first)."""
    matched = cut_lineage(matches(seeds(docs)))
    chain = cut_lineage(chains(matched))
    found = cut_lineage(pieces(docs, chain.withColumn("late", F.lit(False)).union(chains(pair_matches(matched, chain)).withColumn("late", F.lit(True)))))
    sides = found.select("doc_id", "start", "stop", "partner", "late").union(found.select("partner", "start_there", "stop_there", "doc_id", "late"))
    # One row per distinct span: what a document of a very frequent passage holds is bounded by its own length.
    spans = sides.groupBy("doc_id", "start", "stop").agg(F.min("partner").alias("partner"), F.min("late").alias("late"))
    so_far = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce(F.max("stop").over(so_far), F.lit(-1_000_000))
    # A piece of a pair within one of the first round is no piece more.
    first_round = F.max(F.when(F.col("late") == 0, F.col("stop"))).over(Window.partitionBy("doc_id").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = (F.col("late") == 0) | (F.col("stop") > F.coalesce(first_round, F.lit(-1)))
    marked = spans.withColumn("_counted", counted.cast("bigint")).withColumn("_until", until).withColumn("_new", (F.col("start") > F.col("_until") + TOUCH).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "_until")))
    return (numbered.groupBy("doc_id", "_island")
            .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), covered.alias("n_words"), F.sum("_counted").alias("n_pieces"), F.min("partner").alias("partner"))
            .where(F.col("n_words") >= LEAST)
            .select("doc_id", "start_word", "end_word", "n_words", "n_pieces", "partner", (F.col("partner") < F.col("doc_id")).alias("duplicate")))
