"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A model holds for each bucket of hashed n-grams (one word, two words, word endings) how likely a document is to hold it. Target text is
what is labelled good and not toxic. Raw text is modelled as what it is made of, a mixture of documents from three strata
(target, low quality, toxic), each with a model of its own and its share among the labels. A document's importance weight
is w = p_target / p_raw = P(target | text) / share of target, so a long text does not drown a few telling words. Buckets
count only where the low or toxic stratum holds them clearly more often than target documents of the same languages, and
beyond chance; all others have one rate in all models, since the many frequent words of good prose come together and
would outvote the few telling ones. The sample is Gumbel
top-k: key = log w / temperature + Gumbel noise seeded by the text, the k highest keys stay, with k = the number of
documents whose P(target | text) is above ``DOUBT``. The low temperature makes the draw follow the weight wherever it is clear and
leaves chance only to documents of almost equal weight.

The models are fitted on a bounded sample of labelled rows: the ``sample`` labelled documents of each stratum with the
lowest hash. Shares are counted over all labels, k and the k-th key over all documents.

Rules: null and empty texts hold no n-gram, weigh as a text that says nothing and stay. A null label counts as not
toxic and not good; a document with several labels counts for each. Rows with equal texts get equal noise; all rows that
tie with the k-th key stay. Without labelled target rows, or without any other labelled rows, there is nothing to weigh
and every document stays with log weight 0. A null id stays or goes by its text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut_lineage
from .words import Words, mix, slices

BUCKETS = 1 << 20
SAMPLE = 10_000
#: Documents of a stratum that must hold an n-gram for it to count, at least.
FEWEST = 3
#: For low quality, the share of some stratum's documents that must hold it besides: rarer n-grams of low quality texts are clear
#: by count, but on check_s they cost clean documents (97 % stay with this share, 90 % without) and found no more low quality.
COMMON = 0.03
#: Languages are told apart in so many bins.
DOMAINS = 8
SMOOTHING = 0.5
#: Standard deviations of a count beyond which two rates of a bucket count as different.
CLEAR = 5.0
#: Smallest excess of a log rate over target's that counts.
LEAST = float(np.log(4))
TEMPERATURE = 0.02
#: P(target | text) above which a document counts as target text.
DOUBT = 0.01
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text (one word, two words, the last two bytes of a word), and the row of each."""
    h, counts = words.hashes, words.counts()
    row = np.repeat(np.arange(len(counts)), counts)
    modulo = np.uint64(BUCKETS)
    if not len(h):
        return np.zeros(0, np.int64), row
    last = words.data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    ending = mix((before << np.uint64(8) | last) + _SALT) % modulo
    same = row[1:] == row[:-1]
    two = (np.where(h[:-1] == h[1:], _SALT, mix(h[:-1] * _SALT + h[1:])) % modulo)[same]  # any word twice is one n-gram
    return np.concatenate([h % modulo, ending, two]).astype(np.int64), np.concatenate([row, row, row[1:][same]])


def once(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every bucket of a row once."""
    key = np.unique(row * BUCKETS + bucket)
    return key % BUCKETS, key // BUCKETS


def stratum():
    """0 target, 1 low quality, 2 toxic."""
    return (F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.coalesce("quality", F.lit(0)) == 1, 0).otherwise(1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Telling buckets and their log p_stratum / p_target for low quality and toxic; None if a side has no labelled text."""
    known = labels.where("doc_id IS NOT NULL").select("doc_id", stratum().alias("stratum")).distinct()
    # Equal texts count once, or the words of one much copied text would pass for words of its stratum.
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).join(known, "doc_id").groupBy("stratum", "_h").agg(F.min("doc_id").alias("doc_id"))
    texts = cut_lineage(texts)
    picked = [texts.where(F.col("stratum") == s).orderBy("_h").limit(sample).select("doc_id", "stratum") for s in range(3)]
    chosen = picked[0].union(picked[1]).union(picked[2])  # at most three times ``sample`` pairs of numbers
    domain = F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(DOMAINS)).cast("int") if "lang" in docs.columns else F.lit(0)
    texts = (docs.select("doc_id", "text", domain.alias("_d")).join(F.broadcast(chosen), "doc_id")
             .select((F.col("stratum") * DOMAINS + F.col("_d")).alias("_s"), "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for words in slices(batch.column(1)):
                bucket, row = once(*features(words))
                of = label[words.rows]
                for s in np.unique(of):
                    # Bucket BUCKETS counts the documents.
                    mine = total.setdefault(int(s), np.zeros(BUCKETS + 1, np.int32))
                    mine[:BUCKETS] += np.bincount(bucket[of[row] == s], minlength=BUCKETS).astype(np.int32)
                    mine[BUCKETS] += int((of == s).sum())
        for s, mine in total.items():
            b = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), s, np.int32)), pa.array(b.astype(np.int32)), pa.array(mine[b].astype(np.int64))], names=["s", "b", "n"])

    counted = texts.mapInArrow(count, "s int, b int, n bigint")
    by_bucket = counted.groupBy("b").agg(*[F.sum(F.when(F.col("s") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(3 * DOMAINS)])
    by_bucket = cut_lineage(by_bucket)
    whole = by_bucket.where(F.col("b") == BUCKETS).first()
    if whole is None:
        return None
    size = np.array([whole[f"n{s}"] for s in range(3 * DOMAINS)], float).reshape(3, DOMAINS)
    if size[0].sum() == 0 or size[1:].sum() == 0:
        return None
    # Target text in the stratum's mixture of languages, so that the ratio speaks of quality and not of language.
    per = {}
    for s in (1, 2):
        if size[s].sum():
            share = np.where(size[0] > 0, size[s], 0)
            share = share / share.sum() if share.sum() else size[0] / size[0].sum()
            per[s] = share / np.maximum(size[0], 1)
    often = F.lit(False)
    for s in range(3):
        if size[s].sum():
            often = often | (sum(F.col(f"n{s * DOMAINS + d}") for d in range(DOMAINS)) >= max(float(FEWEST), COMMON * size[s].sum()))
    # Spark tells which buckets are clear; only those reach the driver. There are at most BUCKETS of them.
    clear = F.lit(False)
    for s, p in per.items():
        docs_in, held = float(size[s].sum()), sum(F.col(f"n{s * DOMAINS + d}") for d in range(DOMAINS))
        a = sum(F.col(f"n{d}") * float(p[d]) for d in range(DOMAINS)) + float(SMOOTHING / size[0].sum())
        b = held / docs_in + SMOOTHING / docs_in
        spread = F.sqrt(sum(F.col(f"n{d}") * float(p[d] ** 2) for d in range(DOMAINS)) + a / float(size[0].sum()) + (a + b) / docs_in)
        clear = clear | ((often if s == 1 else held >= FEWEST) & (b - a >= CLEAR * spread) & (F.log(b / a) >= LEAST))
    found = by_bucket.where(F.col("b") < BUCKETS).where(clear).withColumn("often", often).toPandas()
    buckets = found["b"].to_numpy(np.int64)
    n = found[[f"n{s}" for s in range(3 * DOMAINS)]].to_numpy(float).reshape(len(found), 3, DOMAINS)
    ratio = np.full((len(found), 2), -np.inf)
    for s, p in per.items():
        docs_in = size[s].sum()
        a, b = n[:, 0] @ p + SMOOTHING / size[0].sum(), n[:, s].sum(axis=1) / docs_in + SMOOTHING / docs_in
        spread = np.sqrt(n[:, 0] @ p ** 2 + a / size[0].sum() + (a + b) / docs_in)
        enough = found["often"].to_numpy(bool) if s == 1 else n[:, s].sum(axis=1) >= FEWEST
        strength = np.log(b / a)
        ratio[:, s - 1] = np.where(~enough | (b - a < CLEAR * spread) | (strength < LEAST), 0.0, strength)
    told = np.any((ratio != 0) & np.isfinite(ratio), axis=1)
    absent = [np.isneginf(ratio[:, s]).all() for s in (0, 1)]
    ratio[:, absent] = 0.0
    return buckets[told], ratio[told]


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, hash of the text, log likelihood ratios of low quality and toxic against target)."""
    buckets, ratio = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.zeros(BUCKETS, np.int32)
        place[buckets] = np.arange(1, len(buckets) + 1)
        for batch in batches:
            sums = np.zeros((batch.num_rows, 2))
            for words in slices(batch.column(1)):
                bucket, row = features(words)
                hit = place[bucket] > 0
                bucket, row = once(bucket[hit], row[hit])
                for s in (0, 1):
                    sums[words.rows, s] = np.bincount(row, ratio[place[bucket] - 1, s], minlength=len(words.rows))
            out = [pa.array(sums[:, s]) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *out], names=["doc_id", "_noise", "_low", "_toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    noise = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text", noise.alias("_noise")).mapInArrow(score, f"doc_id {kind}, _noise bigint, _low double, _toxic double")


def log_weight(shares: tuple[float, float, float]):
    """log of p_target / sum of share * p_stratum, from the two log ratios against target."""
    parts = [F.lit(float(np.log(shares[0]))), F.col("_low") + float(np.log(max(shares[1], 1e-300))), F.col("_toxic") + float(np.log(max(shares[2], 1e-300)))]
    top = F.greatest(*parts)
    return -(top + F.log(sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top))))


def strata_shares(labels: DataFrame) -> tuple[float, float, float]:
    """Shares of target, low quality and toxic among all labelled rows."""
    found = dict(labels.groupBy(stratum().alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    counts = [max(found.get(s, 0), 1) for s in range(3)]
    return tuple(c / sum(counts) for c in counts)


def kth_largest(rows: DataFrame, column: str, k: int, enough: int = 1000) -> float:
    """The k-th largest value of a double column: histograms of at most 4,096 lines, each inside one bar of the last."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    left = k
    while True:
        inside = rows.where(F.col(column).between(low, high))
        n = inside.count()
        if n <= enough or low == high:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True) if low < high else [low] * n
            return values[left - 1]
        width = (high - low) / 4096
        if not width > 0:
            return low
        bar = F.least(F.lit(4095), F.floor((F.col(column) - low) / width)).cast("int")
        bars = sorted(inside.groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True)
        for b in bars:
            if left <= b["n"]:
                low, high = b["lo"], b["hi"]
                break
            left -= b["n"]


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, temperature: float = TEMPERATURE, k: int | None = None,
             seed: int = 11) -> DataFrame:
    """doc_id, log_weight and key of the rows that stay (``k`` of them; by default as many as are likely target)."""
    model = fit(docs, labels, sample)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_noise"))
    scored = cut_lineage(scores(docs, model))
    shares = strata_shares(labels)
    weighed = scored.withColumn("log_weight", log_weight(shares))
    uniform = (F.shiftrightunsigned(F.xxhash64("_noise", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(uniform)))
    if k is None:
        k = keyed.where(F.col("log_weight") > float(np.log(DOUBT / shares[0]))).count()
    if k <= 0:
        return keyed.where("false").select("doc_id", "log_weight", "key", "_noise")
    total = keyed.count()
    bound = kth_largest(keyed, "key", min(k, total))
    return keyed.where(F.col("key") >= bound).select("doc_id", "log_weight", "key", "_noise")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows of one id and one text stay or go together."""
    stays = resample(docs, labels, **options).select(F.col("doc_id").alias("_id"), F.col("_noise").alias("_h")).distinct()
    noise = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_id"]) & (noise == stays["_h"]), "left_semi")
