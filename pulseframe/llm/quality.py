"""Quality by importance resampling.

Two bag models over hashed word n-grams are counted: the target from the texts labelled as good, the raw model
from all texts. The sum of the log-ratios of a text's n-grams is the log of its importance weight, target over raw
likelihood; with Gumbel noise hashed from its id it ranks the documents, and the k highest are a sample without
replacement in proportion to the weights. The k-th highest key is found exactly by counting in ever finer bins, so
that no ordering of all rows and no bound on k is needed.

Since the likelihood of a text is a product over its n-grams, a weight moves further from 1 the longer the text: a
long text like the target is nearly always taken and a long one unlike it nearly never, while short texts are left
to the noise. ``temper`` divides the log-weights where that is not wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import is_held_out, is_learnable, materialize, unit_hash
from .mixing import hashed_unit
from .textkernel import Chunk, chunks, hash_runs, lowered
from .toxicity import is_word

BITS = 16
#: Labelled rows that the target model is learned from.
LEARN_ROWS = 1_000_000

RESULT = "doc_id long, held_out boolean, log_weight double, n_grams long"


def gram_buckets(chunk: Chunk, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token and each pair of neighbours, the n + 1 offsets of the texts, and the last token.

    Tokens are runs of letters and digits and runs of other characters that are not white space; of the latter
    only kind and length (up to 3) count, of letters the lower case. ``before`` is the token before the first, if the
    chunk goes on with a text.
    """
    points = lowered()[chunk.points]
    word = is_word()[points]
    starts, ends, row = chunk.runs(word)
    white = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0xA0)
    s2, e2, r2 = chunk.runs(~word & ~white)
    hashes = np.concatenate([hash_runs(points, starts, ends), hash_runs(points, s2, np.minimum(e2, s2 + 3))])
    begin, rows = np.concatenate([starts, s2]), np.concatenate([row, r2])
    order = np.argsort(begin, kind="stable")
    hashes, rows = hashes[order], rows[order]
    led, led_rows = (hashes, rows) if before is None else (np.concatenate([before, hashes]), np.concatenate([np.zeros(len(before), rows.dtype), rows]))
    with np.errstate(over="ignore"):
        pairs = (led[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (led[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    same = led_rows[1:] == led_rows[:-1]
    all_rows = np.concatenate([rows, led_rows[1:][same]])
    bucket = (np.concatenate([hashes, pairs[same]]) >> np.uint64(64 - BITS)).astype(np.int64)
    order = np.argsort(all_rows, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=chunk.n))]), led[-1:]


def gram_parts(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and offsets of a chunk, or of each part of a long text."""
    last = None
    for part in chunk.parts():
        bucket, bounds, last = gram_buckets(part, last)
        yield bucket, bounds


def bag_counts(docs: DataFrame) -> np.ndarray:
    """How often each n-gram bucket occurs in all texts of ``docs(text)``; 2^BITS numbers, however many rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for chunk in chunks(batches):
            for bucket, _ in gram_parts(chunk):
                total += np.bincount(bucket, minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = 8.0) -> np.ndarray:
    """Log of target over raw probability of each bucket.

    The count that the raw model would give a target of this size is compared with the target's count, both with
    ``prior`` added, so that a bucket seen too seldom to tell counts little either way.
    """
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + prior) / (expected + prior)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, max_good: int = LEARN_ROWS, seed: int = 13) -> np.ndarray:
    """The log-ratio of each bucket: raw model from every row of ``docs``, target from learnable rows labelled quality 1.

    At most about ``max_good`` labelled rows, taken by a hash of doc_id, are learned from; that bounds the ids that
    are sent to all executors.
    """
    good = labels.where(is_learnable(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id").distinct()
    good = good.where(unit_hash(F.col("doc_id"), seed) < max_good / max(good.count(), 1))
    target = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left_semi")
    return log_ratio(bag_counts(target), bag_counts(docs))


def target_share(labels: DataFrame) -> float:
    """The share of quality 1 among the learnable labelled rows; 1 without any."""
    n, good = labels.where(is_learnable(F.col("doc_id")) & F.col("quality").isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    return good / n if n else 1.0


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, held_out, log_weight (sum of the n-grams' log-ratios), n_grams of every row; 0 for a text without n-grams."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            weight, n = np.zeros(chunk.n), np.zeros(chunk.n, np.int64)
            for bucket, bounds in gram_parts(chunk):
                sums = np.concatenate([[0], np.cumsum(held.value[bucket], dtype=np.float64)])
                weight += sums[bounds[1:]] - sums[bounds[:-1]]
                n += np.diff(bounds)
            # rounded, so that a weight doesn't depend on which texts its chunk holds
            yield pa.RecordBatch.from_arrays([chunk.rows.column(0), chunk.rows.column(2), pa.array(np.round(weight, 6) + 0.0), pa.array(n)], names=["doc_id", "held_out", "log_weight", "n_grams"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    return plain.mapInArrow(score, RESULT)


def kth_highest(keys: DataFrame, k: int) -> int | None:
    """The k-th highest value of the LONG column ``key``, found by four rounds of counting in at most 2^16 bins."""
    low, left = -(1 << 63), k
    for shift in (48, 32, 16, 0):
        part = F.shiftright("key", shift)
        bins = keys.where((F.col("key") >= low) & (F.col("key") <= F.lit(low + (1 << (shift + 16)) - 1 if shift < 48 else (1 << 63) - 1)))
        found = bins.groupBy(part.alias("bin")).count().toArrow()
        order = np.argsort(-found.column("bin").to_numpy())
        at, n = found.column("bin").to_numpy()[order], found.column("count").to_numpy()[order]
        above = np.cumsum(n)
        i = int(np.searchsorted(above, left))
        if i == len(at):
            return None
        left -= int(above[i] - n[i])
        low = int(at[i]) << shift
    return low


def _descending(name: str) -> Column:
    """A LONG that is higher the smaller the number is; null counts as 0."""
    return F.bitwise_not(F.coalesce(name, F.lit(0).cast("long")))


def sortable_bits(x: np.ndarray) -> np.ndarray:
    """64-bit integers that order as the doubles do, every two different ones apart: the bits, those of negative numbers turned round."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def _sortable(x: Column) -> Column:
    def bits(values: pd.Series) -> pd.Series:
        return pd.Series(sortable_bits(values.to_numpy(np.float64)))

    return F.pandas_udf(bits, LongType())(x)


def resample(docs: DataFrame, ratio: np.ndarray, keep: float, seed: int = 3, temper: float = 1.0) -> DataFrame:
    """doc_id, held_out, log_weight, sample_key, kept for every row of ``docs(doc_id, text, ...)``.

    Exactly round(keep * rows) rows are kept: those of the highest log-weight (over ``temper``) plus Gumbel noise, ties by the
    smaller doc_id. Noise depends on seed and doc_id alone, so rows that repeat a doc_id and text stay or go
    together unless the limit falls between them. Null and empty texts have log-weight 0. Texts of
    more than a million characters are read in parts. Other columns are not looked at. An empty table gives an empty result.
    """
    gumbel = -F.log(-F.log(F.greatest(hashed_unit(F.lit(seed), F.col("doc_id")), F.lit(1e-12))))
    scored = weigh(docs, ratio).withColumn("sample_key", F.col("log_weight") / temper + gumbel)
    scored = materialize(scored.withColumn("key", _sortable(F.col("sample_key"))), "quality-keys")
    rows = scored.count()
    k = round(keep * rows)
    limit = kth_highest(scored, k) if k else None
    if limit is None:
        kept: Column = F.lit(k >= rows and k > 0)
        return scored.select("doc_id", "held_out", "log_weight", "sample_key", kept.alias("kept"))
    above, at = scored.agg(F.count_if(F.col("key") > limit), F.count_if(F.col("key") == limit)).first()
    ties = scored.where(F.col("key") == limit)
    last = kth_highest(ties.select(_descending("doc_id").alias("key")), k - above) if above + at > k else None
    kept = F.col("key") > limit
    tie = F.lit(True) if last is None else _descending("doc_id") >= last
    return scored.select("doc_id", "held_out", "log_weight", "sample_key", (kept | ((F.col("key") == limit) & tie)).alias("kept"))
