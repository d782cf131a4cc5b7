"""Toxicity by maximum-scoring segments: token log-odds, a linear scan for passages, extreme-value calibration.

A token is a run of letters, lower-cased. It is known by its whole form and its beginnings of 4, 5 and 6 letters, so a stem tells on
forms never seen. Each feature's weight is its log-odds between toxic and other labelled documents under a Dirichlet
prior of ``PRIOR`` documents split as the classes are, less ``DOUBT`` of its standard deviations. A token scores the weight of its heaviest telling feature; all others
score ``NEUTRAL``, so clean text drifts down and a passage ends where toxic words stop. One scan in linear time (a stack of
candidates, each looked at once) finds all maximal-scoring segments of a document: every toxic passage, not only the best.

Chance passages follow an extreme-value law, P(best >= s) = 1 - exp(-K n exp(-lambda s)) for n tokens. K and lambda are fitted by maximum
likelihood to labelled clean documents, each scored as if its own words had not been counted (its share is taken out of
every weight), so overfitted words show up as what they are. The passages of a document are joined by the sum statistic of the r
best ones; the least tail probability over r, in nats of evidence, goes through a logistic curve in log(1 + evidence), fitted on the same
left-out scores. The score is a probability of the label.

Learning reads only labelled rows that are not held out: at most ``SAMPLE`` distinct texts of each class, those with the lowest hash.
Features are counted and judged in Spark; the driver gets the telling ones only, whose number the sample bounds, and one
(length, passage scores) line per sampled document. Labels, language, source and id are no input of a score.

Rules: null and empty texts hold no token and score the curve at no evidence. A null label counts as 0; a row with several labels is
toxic if one says so. Null ids are scored, not held out and never learnt from. Equal texts get equal scores. Without labelled rows of both classes
every score is the share of toxic ones (0 without any). Repeated rows stay; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut_lineage
from .words import mix

#: Distinct labelled texts that are learnt from, per class.
SAMPLE = 20_000
#: Documents that the prior stands for, and standard deviations taken off a weight.
PRIOR, DOUBT = 4.0, 3.0
#: Score of a token that tells nothing.
NEUTRAL = -0.25
#: Toxic documents with a feature, and its weight, at least.
FEWEST, LEAST = 2, 1.0
#: Passages that the sum statistic joins at most; those behind the best ones only add to certainty.
JOINED = 8
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
SLICE_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Tokens:
    """Features of the tokens of some rows: ``hashes[t]`` is the whole form and the beginnings (0 where the token is shorter);
    row r holds tokens ``first[r]:first[r + 1]``."""
    hashes: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Iterator[Tokens]:
    """The rows in order, about half a MB at a time (one row at least)."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1))
        yield split(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def split(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    n = len(data)
    inside = _LETTER[data]
    if n > 1:
        # U+0080 to U+00BF and U+2000 to U+206F are marks, not letters.
        mark = data == 0xC2
        inside[mark] = False
        inside[1:][mark[:-1]] = False
        wide = np.flatnonzero((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81)))
        for k in range(3):
            inside[np.minimum(wide + k, n - 1)] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    starts, ends = np.flatnonzero(inside & (before | edge[:-1])), np.flatnonzero(inside & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Tokens(np.zeros((0, 1 + len(BEGINNINGS)), np.uint64), first)
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begin, lengths)
    letters = data[inside]
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[letters] * powers(int(lengths.max()))[place], dtype=np.uint64)])
    # Where characters begin, to cut beginnings between characters and not between bytes.
    char = np.flatnonzero((letters & 0xC0) != 0x80)
    of = np.searchsorted(char, begin)
    char = np.append(char, len(letters))
    out = np.empty((len(starts), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = mix(running[begin + lengths] - running[begin] + lengths.astype(np.uint64) * _STEP)
    for c, size in enumerate(BEGINNINGS, 1):
        stop = char[np.minimum(of + size, len(char) - 1)]
        part = mix((running[np.minimum(stop, len(letters))] - running[begin]) * _STEP + np.uint64(size))
        out[:, c] = np.where((stop <= begin + lengths) & (of + size <= len(char) - 1), part, np.uint64(0))
    return Tokens(out, first)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum) of a list of scores, in one pass.

    A stack holds candidates with the running totals at their two ends. A candidate is joined to the last one that starts lower if that
    one's end lies lower than its own; each joining removes a candidate, so the work is linear.
    """
    stack: list[list] = []  # start, end, total before, total at the end, index of the last candidate that starts lower
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [at, at + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            new[4] = j
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def passages(places: np.ndarray, weights: np.ndarray) -> list[tuple[int, int, float]]:
    """Segments over the tokens of a text, given where tokens tell something and their weights; the stretches between score ``NEUTRAL``
    a token and are one step each. Start and end are token places."""
    if not len(places):
        return []
    between = np.diff(places) - 1
    line = np.zeros(2 * len(places) - 1)
    line[::2], line[1::2] = weights, NEUTRAL * between
    return [(int(places[s // 2]), int(places[(e - 1) // 2]) + 1, total) for s, e, total in segments(line.tolist())]


@dataclass(frozen=True)
class Model:
    """Telling features (sorted hashes) with their documents by class, the class sizes, the extreme-value law and the curve."""
    hashes: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    sizes: tuple[int, int]
    decay: float = 1.0
    rate: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)

    def weights(self, out: int | None = None) -> np.ndarray:
        """Log-odds of the features; ``out`` leaves one document of that class out of the counts."""
        share = self.sizes[1] / sum(self.sizes)
        toxic = np.maximum(self.toxic - (out == 1), 0) + PRIOR * share
        clean = np.maximum(self.clean - (out == 0), 0) + PRIOR * (1 - share)
        return np.log(toxic / clean) - np.log(share / (1 - share)) - DOUBT * np.sqrt(1 / toxic + 1 / clean)

    def told(self, row: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that tell something and their weights."""
        if not len(self.hashes) or not len(row):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, row), len(self.hashes) - 1)
        best = np.where(self.hashes[at] == row, weights[at], -np.inf).max(axis=1)
        places = np.flatnonzero(best > 0)
        return places, best[places]

    def evidence(self, length: float, sums: list[float]) -> float:
        """Nats against chance: -log of the least tail probability over the r best passages."""
        most, found, factorial, total = 0.0, np.sort(sums)[::-1][:JOINED], 0.0, 0.0
        for r, s in enumerate(found, 1):
            total += self.decay * s - np.log(self.rate * max(length, 1))
            if r > 1:
                factorial += np.log(r) + np.log(r - 1)  # r! (r - 1)!
            if total > 0:
                most = max(most, total - (r - 1) * np.log(total) + factorial if r > 1 and total > 1 else total)
            elif r == 1:
                break
        return float(most)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(evidence), -40, 40)))


def held_out(id_column: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic, text of the labelled rows to learn from."""
    known = labels.where("doc_id IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).join(known, "doc_id")
    texts = cut_lineage(texts.groupBy("toxic", "_h").agg(F.min("doc_id").alias("doc_id")))  # equal texts count once
    chosen = texts.where("toxic = 1").orderBy("_h").limit(sample).union(texts.where("toxic <> 1").orderBy("_h").limit(sample))
    # At most twice ``sample`` lines of three numbers; a repeated id may bring more than one text.
    return cut_lineage(docs.select("doc_id", "text").withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
                       .join(F.broadcast(chosen), ["doc_id", "_h"]).groupBy("toxic", "_h").agg(F.first("text").alias("text")).select(F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"), "text"))


def count(learnt: DataFrame) -> Model | None:
    """The telling features of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, row = batch.column(0).to_numpy(zero_copy_only=False), 0
            for t in tokens(batch.column(1)):
                found = []
                for r in range(len(t.first) - 1):
                    own = np.unique(t.hashes[t.first[r]:t.first[r + 1]])
                    found.append((own[own != 0], labels[row + r]))
                row += len(t.first) - 1
                for toxic in (0, 1):
                    every = [own for own, label in found if label == toxic]
                    if every:
                        h, n = np.unique(np.concatenate(every), return_counts=True)
                        # Hash 0 can't be a feature; its line counts the documents.
                        yield pa.RecordBatch.from_arrays([pa.array(np.append(h, np.uint64(0)).view(np.int64)), pa.array(np.append(n, len(every)) * toxic),
                                                          pa.array(np.append(n, len(every)) * (1 - toxic))], names=["h", "t", "c"])

    counted = learnt.mapInArrow(run, "h bigint, t bigint, c bigint").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = cut_lineage(counted)
    size = counted.where("h = 0").first()
    if size is None or not size["t"] or not size["c"]:
        return None
    share = size["t"] / (size["t"] + size["c"])
    toxic, clean = F.col("t") + PRIOR * share, F.col("c") + PRIOR * (1 - share)
    weight = F.log(toxic / clean) - float(np.log(share / (1 - share))) - DOUBT * F.sqrt(1 / toxic + 1 / clean)
    got = counted.where(f"h <> 0 AND t >= {FEWEST}").where(weight >= LEAST).select("h", "t", "c").toArrow()
    h = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Model(h[order], got["t"].to_numpy()[order].astype(float), got["c"].to_numpy()[order].astype(float), (size["c"], size["t"]))


def law(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K of clean documents by maximum likelihood; documents without a passage count as below any score."""
    lengths, some = np.maximum(lengths, 1.0), best > 0
    if some.sum() < 5:
        return 1.0, max(float(some.sum()), 0.5) / float(lengths.sum())
    low, high = 0.05, 20.0

    def rate(decay: float) -> float:
        # Censored at the least positive score: those documents only say that nothing above it was met.
        seen = np.where(some, best, best[some].min())
        return float(some.sum() / (lengths * np.exp(-decay * seen)).sum())

    def slope(decay: float) -> float:
        seen = np.where(some, best, best[some].min())
        k = rate(decay)
        return float(some.sum() / decay - best[some].sum() + (k * lengths * seen * np.exp(-decay * seen)).sum())

    for _ in range(60):
        middle = (low + high) / 2
        if slope(middle) > 0:
            low = middle
        else:
            high = middle
    return low, rate(low)


def curve(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton's method, held near 0 by a weak prior and never falling."""
    x = np.stack([np.ones_like(evidence), evidence], 1)
    beta, keep = np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (label - p) - keep @ beta)
        beta = beta + step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    learnt = sampled(docs, labels, sample)
    model = count(learnt)
    if model is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = [m.weights(0), m.weights(1)]
        for batch in batches:
            labels_, row = batch.column(0).to_numpy(zero_copy_only=False), 0
            lengths, sums = [], []
            for t in tokens(batch.column(1)):
                for r in range(len(t.first) - 1):
                    own = t.hashes[t.first[r]:t.first[r + 1]]
                    sums.append([s for _, _, s in passages(*m.told(own, weights[labels_[row + r]]))])
                    lengths.append(len(own))
                row += len(t.first) - 1
            best = [sorted(s, reverse=True)[:JOINED] for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(lengths, pa.int64()), pa.array(best, pa.list_(pa.float64()))], names=["y", "n", "s"])

    got = learnt.mapInArrow(left_out, "y int, n bigint, s array<double>").toArrow()  # one line per sampled document
    y, n, sums = got["y"].to_numpy(), got["n"].to_numpy().astype(float), got["s"].to_pylist()
    clean = y == 0
    decay, rate = law(n[clean], np.array([s[0] if s else 0.0 for s in sums])[clean])
    model = Model(model.hashes, model.toxic, model.clean, model.sizes, decay, rate)
    evidence = np.array([model.evidence(length, s) for length, s in zip(n, sums)])
    return Model(model.hashes, model.toxic, model.clean, model.sizes, decay, rate, curve(np.log1p(evidence), y.astype(float)))


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (token places and score of each significant passage)."""
    model = fit(docs, labels, sample)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = "array<struct<start:int,end:int,score:double>>"
    if model is None:
        share = labels.where("doc_id IS NOT NULL").where(~held_out("doc_id")).agg(F.avg(F.coalesce("toxic", F.lit(0)))).first()[0] or 0.0
        return rows.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted"), F.array().cast(found).alias("passages"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = m.weights()
        for batch in batches:
            evidence, spans = [], []
            for t in tokens(batch.column(2)):
                for r in range(len(t.first) - 1):
                    own = t.hashes[t.first[r]:t.first[r + 1]]
                    mine = passages(*m.told(own, weights))
                    evidence.append(m.evidence(len(own), [s for _, _, s in mine]))
                    # A passage counts where chance would bring it in fewer than one of twenty such texts.
                    spans.append([{"start": s, "end": e, "score": x} for s, e, x in mine if m.rate * max(len(own), 1) * np.exp(-m.decay * x) < 0.05])
            score = m.score(np.array(evidence, float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                                              pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                                             names=["doc_id", "held_out", "score", "predicted", "passages"])

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, passages {found}")
