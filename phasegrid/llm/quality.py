"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed unigrams and bigrams: one of the target (documents labelled good), one of the raw
corpus (all documents). A document's log-weight is the sum over its n-grams of log p_target - log p_raw; adding Gumbel
noise to the log-weights and taking the k largest samples k documents without replacement in proportion to their weights.

*Tokens* are runs of word characters or of other marks, lower-cased; a token equal to the one before is read as a mark of
repetition, so that repeated words are n-grams of their own.

*k* is not given but estimated: the number of documents that the target model explains better than the raw model of
rejected text does, that is, whose log-weight is positive. Noise is drawn from a hash of the document's id and text and a
key, so reruns agree. The k-th largest value is found by counting in ever narrower bins, not by sorting.

*Bounds.* The target model may use at most ``FIT_ROWS`` labelled rows (those with the smallest hashed ids), which bounds
the broadcast of labels; every document counts in the raw model. Counts have ``BUCKETS`` rows.

Defined cases: null or empty text has log-weight 0 and is rejected; a document without a label counts in the raw model
only; one that is labelled both ways isn't taken for good; without any good label every document with words is kept;
rows that repeat id and text have equal keys, so they stay or go together, and equal keys at the k-th place all stay; rows
that repeat an id with other texts are sampled separately; very long texts are read whole; an empty table gives an empty
result; further columns are ignored by the scoring and kept by the filter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import cut

BUCKETS = 1 << 15
FIT_ROWS = 100_000
KEY = 20240607
SMOOTH = 1.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHE_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def ngrams(text: str | None, known: dict, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams."""
    t = _TOKEN.findall((text or "").lower())
    if not t:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, t), np.uint64, len(t))
    same = np.empty(len(h), bool)
    same[0] = False
    np.equal(h[1:], h[:-1], out=same[1:])
    h = np.where(same, np.uint64(0x5851F42D4C957F2D), h)
    two = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    both = np.concatenate([h, two])
    both = (both ^ (both >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((both >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1)):
                n = np.bincount(ngrams(text.as_py(), known, buckets), minlength=buckets)
                raw += n
                if is_good.as_py():
                    good += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    return run


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """log p_target - log p_raw of every bucket."""
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = good.where("least = 1 AND most = 1").select("doc_id")
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left")  # at most fit_rows ids
    counts = rows.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(
        _counter(buckets), "bucket long, raw long, good long"
    )
    total = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in total:
        raw[r.bucket], target[r.bucket] = r.raw, r.good
    if not target.sum():
        return np.full(buckets, 1e-9)
    # The raw model is the target's prior, worth as many n-grams as there are buckets: without evidence the ratio is 1.
    p_raw = np.maximum(raw, SMOOTH) / np.maximum(raw, SMOOTH).sum()
    return np.log((target + buckets * p_raw) / (target.sum() + buckets)) - np.log(p_raw)


def scored(docs: DataFrame, model: np.ndarray, key: int = KEY) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, text_hash`` of every document; without words log-weight 0 and no key.

    ``text_hash`` is the engine's 64-bit hash of the text, which tells rows of one id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = len(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = _Hashes(), shared.value
        for batch in batches:
            weights, keys, hashes = [], [], []
            for i, text in zip(batch.column(0), batch.column(1)):
                t = text.as_py()
                at = ngrams(t, known, buckets)
                x = float(w[at].sum())
                u = (xxhash.xxh3_64_intdigest(f"{key}:{i.as_py()}:{t}") + 0.5) / 2.0**64
                weights.append(x)
                keys.append(x - math.log(-math.log(u)) if len(at) else None)
                h = xxhash.xxh64_intdigest((t or "").encode(), 42)
                hashes.append(h - (h >> 63 << 64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(weights, pa.float64()), pa.array(keys, pa.float64()), pa.array(hashes, pa.int64())],
                names=["doc_id", "log_weight", "gumbel_key", "text_hash"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, log_weight double, gumbel_key double, text_hash long")


def threshold(keys: DataFrame, k: int, width: int = 4096) -> float:
    """The k-th largest ``gumbel_key``, by counting in ever narrower bins (at most ``width`` rows a step).

    Bins are narrowed until one holds no two different values; then its largest value is the threshold.
    """
    low, high = keys.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    left = k
    while low is not None and low != high and left > 0:
        size = (high - low) / width
        if size <= 0 or low + size == low:
            break
        inside = keys.where((F.col("gumbel_key") >= low) & (F.col("gumbel_key") <= high))
        at = F.least(F.floor((F.col("gumbel_key") - low) / size), F.lit(width - 1))
        bins = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if left <= row.n:
                low, high = row.lo, row.hi
                break
            left -= row.n
        else:
            break
    return low if low is not None else math.inf


def _sampled(docs: DataFrame, labels: DataFrame, key: int) -> DataFrame:
    table = cut(scored(docs, fit(docs, labels), key))
    k = table.where("gumbel_key IS NOT NULL AND log_weight > 0").count()
    rows = table.where("gumbel_key IS NOT NULL")
    if not k:
        return rows.where("false")
    return rows.where(F.col("gumbel_key") >= threshold(rows, k))


def sample(docs: DataFrame, labels: DataFrame, key: int = KEY) -> DataFrame:
    """The sampled documents: ``doc_id, log_weight, gumbel_key, kept`` (true)."""
    return _sampled(docs, labels, key).select("doc_id", "log_weight", "gumbel_key", F.lit(True).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: int = KEY) -> DataFrame:
    """The rows of ``docs`` that the sample holds."""
    kept = _sampled(docs, labels, key).select(F.col("doc_id").alias("__pg_id"), F.col("text_hash").alias("__pg_hash")).distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__pg_id")) & (own == F.col("__pg_hash")), "left_semi")
