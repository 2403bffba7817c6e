"""Language identification by nearest centroid.

A text is the TF-IDF weighted, normalised vector of its hashed letter n-grams. Each language has several
centroids, found by spherical k-means among its learning vectors; a text takes the language of the centroid of
highest cosine, and is rejected if it is farther from that centroid than nearly all learning texts of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, is_learnable, unit_hash
from .textkernel import Chunk, chunks, is_letter, lowered

BUCKETS = 8192
ORDERS = (1, 2, 3)
#: Rows of the dense vectors that are held at once.
DENSE_ROWS = 256

#: Learning texts in all and of each language, taken by a hash of doc_id; of very many languages still LEAST_PER_LANGUAGE each.
LEARN_ROWS = 4000
LEARN_PER_LANGUAGE = 800
LEAST_PER_LANGUAGE = 5
#: Values of lang that are learned; of more the most frequent ones.
LEARN_LANGUAGES = 1_000

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def ngram_buckets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of the words (runs of letters), each word padded by one space on either side."""
    points = lowered()[chunk.points]
    starts, ends, row = chunk.runs(is_letter()[chunk.points])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = int(begin[-1] + size[-1])
    symbols = points[np.clip(np.arange(total) + np.repeat(starts - begin - 1, size), 0, len(points) - 1)].astype(np.uint32)
    symbols[begin] = symbols[begin + size - 1] = 32
    left = np.repeat(begin + size, size) - np.arange(total)
    rows = np.repeat(row, size)
    out_row, out_bucket = [], []
    code = np.zeros(total, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = code[: total - n + 1] * np.uint32(0x01000193) + symbols[n - 1 :] + np.uint32(n)
        if n not in ORDERS:
            continue
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        whole = left[: total - n + 1] >= n
        out_row.append(rows[: total - n + 1][whole])
        out_bucket.append((mixed >> np.uint32(32 - 13))[whole].astype(np.int64))
    return np.concatenate(out_row), np.concatenate(out_bucket)


def count_vectors(chunk: Chunk) -> Iterator[tuple[slice, np.ndarray]]:
    """Dense n-gram counts of some rows at a time; those of a long text are summed over its parts."""
    if chunk.long is not None:
        total = sum(np.bincount(ngram_buckets(part)[1], minlength=BUCKETS) for part in chunk.parts())
        yield slice(0, 1), total[None].astype(np.float32)
        return
    row, bucket = ngram_buckets(chunk)
    order = np.argsort(row, kind="stable")
    row, bucket = row[order], bucket[order]
    for a in range(0, chunk.n, DENSE_ROWS):
        b = min(a + DENSE_ROWS, chunk.n)
        lo, hi = np.searchsorted(row, [a, b])
        flat = np.bincount((row[lo:hi] - a) * BUCKETS + bucket[lo:hi], minlength=(b - a) * BUCKETS)
        yield slice(a, b), flat.reshape(b - a, BUCKETS).astype(np.float32)


def length_class(total: np.ndarray) -> np.ndarray:
    """Texts of similar n-gram numbers: 0 to 15 by doubling."""
    return np.minimum(np.log2(np.maximum(total, 1)).astype(int), 15)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        out = np.log1p(counts) * self.weights
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine of the nearest centroid."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        return self.owner[best], cosine[np.arange(len(best)), best]


def spherical_kmeans(vectors: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), size=min(k, len(vectors)), replace=False)]
    for _ in range(rounds):
        at = (vectors @ centres.T).argmax(1)
        sums = np.stack([vectors[at == j].sum(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def learn(docs: DataFrame, per_language: int = LEARN_PER_LANGUAGE, centroids: int = 4, reject: float = 0.0005, seed: int = 11) -> LanguageModel:
    """Fit on at most about ``per_language`` texts of each lang among the learnable rows, taken by a hash of doc_id, and
    ``LEARN_ROWS`` in all (``LEAST_PER_LANGUAGE`` each, if that is more), of the ``LEARN_LANGUAGES`` values of lang that most rows have. Only n-gram counts of these texts reach the driver. A text is rejected later if its cosine is below half
    the ``reject`` quantile of the learning texts of its length or a longer class, or of the longest learned class if it is longer.
    """
    rows = docs.where(is_learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LEARN_LANGUAGES).toArrow()
    per_language = min(per_language, max(LEARN_ROWS // max(len(sizes), 1), LEAST_PER_LANGUAGE))
    shares = docs.sparkSession.createDataFrame(sizes.to_pylist(), "lang string, n long").withColumn("share", F.lit(float(per_language)) / F.col("n"))
    taken = rows.join(F.broadcast(shares), "lang").where(unit_hash(F.col("doc_id"), seed) < F.col("share")).select("lang", "text", "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            langs, ids = chunk.rows.column(0).to_pylist(), chunk.rows.column(2).to_pylist()
            for part, counts in count_vectors(chunk):
                held = [np.flatnonzero(x) for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part], pa.int64()),
                        pa.array(langs[part], pa.string()),
                        pa.array([x.astype(np.int16).tobytes() for x in held], pa.binary()),
                        pa.array([counts[i, x].astype(np.float32).tobytes() for i, x in enumerate(held)], pa.binary()),
                    ],
                    names=["doc_id", "lang", "at", "n"],
                )

    found = taken.mapInArrow(count, "doc_id long, lang string, at binary, n binary").where("length(at) > 0").toArrow()
    # rows of one id and lang are told apart by their n-grams, so that the model follows neither order nor partitions
    found = found.sort_by([(c, "ascending") for c in ("doc_id", "lang", "at", "n")])
    labels = np.array(found.column("lang").to_pylist(), object)
    counts = np.zeros((len(labels), BUCKETS), np.float32)
    for i, (at, n) in enumerate(zip(found.column("at").to_pylist(), found.column("n").to_pylist(), strict=True)):
        counts[i, np.frombuffer(at, np.int16)] = np.frombuffer(n, np.float32)
    total = counts.sum(1)
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    languages = sorted(set(labels))
    model = LanguageModel(languages, weights, np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), np.zeros(16, np.float32))
    if not languages:
        return model
    np.log1p(counts, out=counts)
    counts *= weights
    counts /= np.linalg.norm(counts, axis=1, keepdims=True)
    found_at = [spherical_kmeans(counts[labels == x], centroids, seed) for x in languages]
    model.centroids = np.concatenate(found_at)
    model.owner = np.repeat(np.arange(len(languages)), [len(x) for x in found_at])
    best = (counts @ model.centroids.T).max(1)
    kind = length_class(total)
    low = np.float32(np.inf)
    for k in range(15, -1, -1):
        if (kind == k).any():
            low = min(low, np.float32(0.5 * np.quantile(best[kind == k], reject)))
        model.floor[k] = low
    model.floor[kind.max() + 1 :] = model.floor[kind.max()]
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs(doc_id, text, ...)``.

    ``score`` is the cosine to the nearest centroid. A null text or one without a letter is ``und``, score 0,
    and rejected; so is every text if nothing could be learned. Of languages of equal cosine the first in the order of
    their names is taken. ``rejected`` is also true beyond the model's
    distance limit, whose ``lang_pred`` is still the nearest language. Rows that repeat are each judged; other
    columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, "und"], object)
        for chunk in chunks(batches):
            lang = np.full(chunk.n, len(model.languages))
            score, far = np.zeros(chunk.n), np.ones(chunk.n, bool)
            if model.languages:
                for part, counts in count_vectors(chunk):
                    total = counts.sum(1)
                    own, cosine = model.nearest(counts)
                    some = total > 0
                    lang[part] = np.where(some, own, len(model.languages))
                    score[part] = np.where(some, np.clip(cosine, 0, 1), 0)
                    far[part] = ~some | (cosine < model.floor[length_class(total)])
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column(0), chunk.rows.column(2), pa.array(names[lang], pa.string()), pa.array(score), pa.array(far)],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    return plain.mapInArrow(judge, RESULT)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that :func:`identify` does not reject, with all their columns.

    The texts are judged where they lie: the verdict is a column computed beside the row, no join is made.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            far = np.ones(chunk.n, bool)
            for part, counts in count_vectors(chunk):
                total = counts.sum(1)
                if held.value.languages:
                    far[part] = (total == 0) | (held.value.nearest(counts)[1] < held.value.floor[length_class(total)])
            yield chunk.rows.filter(pa.array(~far))

    return docs.select(*names).mapInArrow(keep, docs.schema)
