"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

1. Every benchmark item is a weighted set of word shingles (the weight is how often it holds one) with a 64-bit SimHash.
2. Every document is read through windows of the length of each item length, word by word. A window can only be similar
   enough if that share of its shingles is in items of its length; a bitmap of fixed size (``BITS``) answers that for all
   windows by running counts and never turns away a true one. The windows left get their SimHash.
3. Multi-index Hamming join: the 64 bits are cut into ``BLOCKS`` blocks; of two fingerprints at most ``RADIUS`` bits apart
   one block at least differs in ``NEAR`` bits or fewer. The items list all values that near for each block, the windows
   their own, and an equi-join on (length, block, value) finds every pair within the radius.
4. Pairs within the radius are verified by the exact weighted Jaccard similarity, sum of minima over sum of maxima.

Rules: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``. An item of fewer words than a shingle is one shingle, its
windows too. Items and documents without words match nothing; null texts count as empty. Items with equal texts are
reported each. Rows that repeat an id and text are told as one. Empty tables give an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _ROLL, _STEP, Words, grams, mix, slices

SIZE = 5
PERCENT = 80
#: Bits of the bitmap of item shingles: half a MB whatever the size of the benchmark.
BITS = 1 << 22
WIDTHS = (13, 13, 13, 13, 12)
BLOCKS = len(WIDTHS)
NEAR = 2
RADIUS = BLOCKS * (NEAR + 1) - 1


def windowed(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of windows of ``length`` words and where each row's begin: as ``grams``, or one per run of a short length."""
    if length >= SIZE:
        return grams(words, SIZE)
    counts = words.counts()
    runs = np.maximum(counts - length + 1, 0)
    begin = np.concatenate([[0], np.cumsum(runs)])
    rolled = np.full(max(0, len(words.hashes) - length + 1), length, np.uint64)
    for t in range(length):
        rolled = rolled * _ROLL + words.hashes[t:t + len(rolled)]
    at = np.repeat(words.first[:-1], runs) + np.arange(int(begin[-1])) - np.repeat(begin[:-1], runs)
    return mix(rolled[at] ^ _STEP), begin


def bits_of(shingles: np.ndarray, length: int) -> np.ndarray:
    """Place of a shingle in the bitmap of items of that length; length 0: of any length."""
    return (mix(shingles + np.full(1, length, np.uint64) * _STEP) % np.uint64(BITS)).astype(np.int64)


def need_of(length: int) -> int:
    """Shingles that a window of the length must have in common with an item of its length."""
    return -(-PERCENT * max(1, length - SIZE + 1) // 100)


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash: the majority of each bit, every shingle counted as often as it occurs."""
    ones = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(len(shingles), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(np.int64)[0])


def weighted(shingles: np.ndarray) -> np.ndarray:
    """The weighted set as a plain one: the k-th occurrence of a shingle is an element of its own."""
    s = np.sort(shingles)
    new = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return mix(s + (np.arange(len(s)) - first).astype(np.uint64) * _ROLL).view(np.int64)


def block_values(fp: int) -> list[int]:
    fp, out = fp & 0xFFFFFFFFFFFFFFFF, []
    for width in WIDTHS:
        out.append(fp & ((1 << width) - 1))
        fp >>= width
    return out


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, fp, elements, bits, keys): keys are all (block, value) within NEAR bits of the item's own.

    ``bits`` are places in the bitmap of the item's length and, as -1 - place, in that of all lengths.
    """
    flips = [[0] + [sum(1 << b for b in c) for n in range(1, NEAR + 1) for c in combinations(range(w), n)] for w in WIDTHS]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(1)):
                rows = []
                for r, row in enumerate(words.rows):
                    n = int(words.first[r + 1] - words.first[r])
                    if not n:
                        continue
                    shingles, begin = windowed(words, n)
                    s = shingles[begin[r]:begin[r + 1]]
                    fp = fingerprint(s)
                    keys = [(b << 16) | (v ^ f) for b, v in enumerate(block_values(fp)) for f in flips[b]]
                    bits = np.concatenate([bits_of(s, n), -1 - bits_of(s, 0)])
                    rows.append((batch.column(0)[int(row)].as_py(), n, fp, weighted(s), bits, keys))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.list_(pa.int64())),
                                                      pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.list_(pa.int32()))], names=["item_id", "length", "fp", "elements", "bits", "keys"])

    return (benchmark.select(F.col("item_id").cast("bigint"), "text")
            .mapInArrow(read, "item_id bigint, length int, fp bigint, elements array<bigint>, bits array<bigint>, keys array<int>"))


def windows(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, start_word, length, fp, elements) of the windows that may match an item of their length."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    full = [n for n in lengths if n >= SIZE]
    least = min((need_of(n) for n in full), default=0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_length = np.zeros(BITS, bool), np.zeros(BITS, bool)
        held[bits[bits >= 0]] = True
        any_length[-1 - bits[bits < 0]] = True

        def matching(shingles, length):
            """Where a window of the length begins of which enough shingles may be in items of the length."""
            m = max(1, length - SIZE + 1)
            if len(shingles) < m:
                return np.zeros(0, np.int64)
            running = np.concatenate([[0], np.cumsum(held[bits_of(shingles, length)])])
            return np.flatnonzero(running[m:] - running[:-m] >= need_of(length))

        for batch in batches:
            ids, rows = batch.column(0), []

            def add(row, shingles, length):
                for at in matching(shingles, length):
                    s = shingles[at:at + max(1, length - SIZE + 1)]
                    rows.append((row, int(at), length, fingerprint(s), weighted(s)))

            for words in slices(batch.column(2)):
                if full:
                    shingles, begin = grams(words, SIZE)
                    running = np.concatenate([[0], np.cumsum(any_length[bits_of(shingles, 0)])])
                    for r in np.flatnonzero((running[begin[1:]] - running[begin[:-1]] >= least) & (words.counts() >= SIZE)):
                        for length in full:
                            add(int(words.rows[r]), shingles[begin[r]:begin[r + 1]], length)
                for length in (n for n in lengths if n < SIZE):
                    shingles, begin = windowed(words, length)
                    hit = np.unique(np.searchsorted(begin, np.flatnonzero(held[bits_of(shingles, length)]), "right") - 1)
                    for r in hit:
                        add(int(words.rows[r]), shingles[begin[r]:begin[r + 1]], length)
            for i in range(0, len(rows), 20_000):
                c = list(zip(*rows[i:i + 20_000]))
                picked = pa.array(c[0], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(picked), batch.column(1).take(picked), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()),
                                                  pa.array(c[4], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "start_word", "length", "fp", "elements"])

    return (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(read, f"doc_id {kind}, text_hash bigint, start_word bigint, length int, fp bigint, elements array<bigint>"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, n_words, similarity, hamming: the best window of each document and item."""
    items = benchmark_items(benchmark)
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())
    bits = items.select(F.explode("bits").alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)  # at most BITS
    found = windows(docs, lengths, bits)
    own, low = [], 0
    for b, width in enumerate(WIDTHS):
        own.append(F.lit(b << 16).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("int")))
        low += width
    keyed = found.withColumn("key", F.explode(F.array(*own)))
    listed = items.select(F.explode("keys").alias("key"), "length", "item_id", F.col("fp").alias("item_fp"), F.col("elements").alias("item_elements"))
    near = (keyed.join(listed, ["length", "key"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= RADIUS))
    common = F.size(F.array_intersect("elements", "item_elements"))
    exact = near.withColumn("common", common).withColumn("either", F.size("elements") + F.size("item_elements") - F.col("common")).where(f"100 * common >= {PERCENT} * either")
    best = F.min_by(F.struct("start_word", "length", "common", "either", "hamming"), F.struct(-F.col("common") / F.col("either"), F.col("start_word"), F.col("length")))
    return (exact.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("w"))
            .select("doc_id", "text_hash", "item_id", F.col("w.start_word").alias("start_word"), F.col("w.length").cast("bigint").alias("n_words"),
                    (F.col("w.common") / F.col("w.either")).alias("similarity"), F.col("w.hamming").alias("hamming")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_h"]), "left_anti")
