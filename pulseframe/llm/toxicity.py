"""Toxicity by a convolutional text classifier, trained in numpy inside Spark tasks.

A word is the sum of two hashed embeddings, of the whole word and of its first five characters. Filters of
several widths slide over the words of a document, their largest activations are pooled, and a logistic layer
scores them. Embeddings start from the words' smoothed log-odds in the learning texts and are then trained with
the rest. Decision thresholds are calibrated for each language that the model itself reads from the words; the
score is shifted so that every language's threshold lies at 0.7.

Every labelled text that is not held out is learned from. The texts are dealt over shards by a hash of their ids;
in each epoch every shard trains a copy of the network, and the changes are averaged. Counts, changes and the
histograms behind the thresholds are summed by Spark as whole numbers, so that they follow no order, and only these
sums, whose size doesn't depend on the number of texts, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, is_learnable
from .textkernel import Chunk, chunks, hash_runs, lowered

BITS = 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
DECISION = 0.7
PREFIX = 5

#: Values of lang that get thresholds of their own.
LANGUAGES = 32
#: Characters of the learning texts of a shard, about; a task holds one shard's words at a time.
SHARD_CHARS = 10_000_000
EPOCHS = 8
#: Learning texts that a word must occur in to get an embedding of its own; rarer ones count as neutral.
MIN_TEXTS = 3
#: Words of a text that are convolved at once.
SPAN_WORDS = 100_000
#: Changes are summed in units of 1 / UNIT, thresholds are placed at multiples of half of 1 / BINS.
UNIT = float(1 << 20)
BINS = 256
#: Bits of the filter of labelled ids, at most; 16 for each id if these are fewer.
ID_BITS = 1 << 27

RESULT = "doc_id long, held_out boolean, score double, predicted int"


@cache
def is_word() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def word_buckets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """[words, 2] embedding rows of whole word and prefix, and n + 1 word offsets of the texts."""
    found, counts = [], np.zeros(chunk.n, np.int64)
    shift = np.uint64(64 - BITS)
    for part in chunk.parts():
        points = lowered()[part.points]
        starts, ends, row = part.runs(is_word()[points])
        whole = hash_runs(points, starts, ends) >> shift
        front = hash_runs(points, starts, np.minimum(ends, starts + PREFIX)) * np.uint64(3) >> shift
        found.append(np.stack([whole, front], 1).astype(np.int32))
        counts += np.bincount(row, minlength=part.n)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    languages: list[str] = field(default_factory=list)
    tongue: np.ndarray | None = None
    limits: np.ndarray | None = None

    @property
    def dense(self) -> np.ndarray:
        """All parameters but the embeddings, as one vector."""
        return np.concatenate([*(x.ravel() for x in (*self.filters, *self.bias, self.out)), [self.out_bias]]).astype(np.float32)

    @dense.setter
    def dense(self, values: np.ndarray) -> None:
        at = 0
        for x in (*self.filters, *self.bias, self.out):
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        self.out_bias = float(values[at])

    def embed(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors with a gap of zeros behind each text, so that every text has a window of every width."""
        gap = max(WIDTHS)
        n = len(bounds) - 1
        at = np.arange(len(words)) + gap * np.repeat(np.arange(n), np.diff(bounds))
        out = np.zeros((len(words) + gap * n, DIM), np.float32)
        out[at] = self.table[words[:, 0]] + self.table[words[:, 1]]
        return out, bounds + gap * np.arange(n + 1)

    def activations(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        for width, weight, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            padded = np.concatenate([vectors, np.zeros((width - 1, DIM), np.float32)])
            held = sum(padded[k : k + len(vectors)] @ weight[k * DIM : (k + 1) * DIM] for k in range(width))
            yield np.maximum(held + bias, 0)

    def pooled(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The largest activation of each filter in each text."""
        vectors, edges = self.embed(words, bounds)
        # of the windows in the gap only the first holds no word of the next text
        reach = np.stack([edges[:-1], edges[:-1] + np.diff(bounds) + 1], 1).ravel()
        return np.concatenate([np.maximum.reduceat(h, reach)[::2] for h in self.activations(vectors)], 1)

    def pooled_long(self, words: np.ndarray) -> np.ndarray:
        """The same for one text, in spans that overlap by what a window reaches beyond them."""
        out = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32)
        for a in range(0, len(words), SPAN_WORDS):
            own = words[a : a + SPAN_WORDS + max(WIDTHS) - 1]
            inside = SPAN_WORDS if a + SPAN_WORDS < len(words) else None
            vectors, _ = self.embed(own, np.array([0, len(own)]))
            out = np.maximum(out, np.concatenate([h[:inside].max(0) for h in self.activations(vectors)]))
        return out

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) == 1:
            return np.zeros(0)
        size = np.diff(bounds)
        long = size > SPAN_WORDS
        short = words if not long.any() else words[np.repeat(~long, size)]
        found = np.empty((len(size), FILTERS * len(WIDTHS)), np.float32)
        if not long.all():
            found[~long] = self.pooled(short, np.concatenate([[0], np.cumsum(size[~long])]))
        for i in np.flatnonzero(long):
            found[i] = self.pooled_long(words[bounds[i] : bounds[i + 1]])
        return found @ self.out + self.out_bias

    def language(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its words alone; the last index if it has none."""
        n = len(bounds) - 1
        full = np.flatnonzero(np.diff(bounds))
        out = np.full(n, len(self.languages))
        if len(full) and self.languages:
            out[full] = np.add.reduceat(self.tongue[words[:, 0]], bounds[:-1][full]).argmax(1)
        return out

    def scores(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        shifted = self.logits(words, bounds) - self.limits[self.language(words, bounds)] + np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(shifted, -40, 40)))


def spans(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most SPAN_WORDS words in all; a longer text is alone."""
    begin = 0
    while begin < len(bounds) - 1:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + SPAN_WORDS, "right")) - 1)
        yield begin, end
        begin = end


def top_windows(net: Network, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest activation of each filter in each text, and the place in the text of the window that has it."""
    n, each = len(bounds) - 1, np.arange(FILTERS)
    best = np.full((n, FILTERS * len(WIDTHS)), -np.inf, np.float32)
    place = np.zeros(best.shape, np.int64)
    for i, j in spans(bounds):
        own = words[bounds[i] : bounds[j]]
        if len(own) <= SPAN_WORDS:
            vectors, edges = net.embed(own, bounds[i : j + 1] - bounds[i])
            for k, h in enumerate(net.activations(vectors)):
                top = np.stack([h[a : a + n + 1].argmax(0) for a, n in zip(edges[:-1], np.diff(bounds[i : j + 1]), strict=True)])
                best[i:j, k * FILTERS : (k + 1) * FILTERS] = h[edges[:-1, None] + top, each]
                place[i:j, k * FILTERS : (k + 1) * FILTERS] = top
            continue
        for a in range(0, len(own), SPAN_WORDS):
            piece = own[a : a + SPAN_WORDS + max(WIDTHS) - 1]
            vectors, _ = net.embed(piece, np.array([0, len(piece)]))
            for k, h in enumerate(net.activations(vectors)):
                h = h[: SPAN_WORDS if a + SPAN_WORDS < len(own) else None]
                top = h.argmax(0)
                better = np.flatnonzero(h[top, each] > best[i, k * FILTERS : (k + 1) * FILTERS])
                best[i, k * FILTERS + better] = h[top, each][better]
                place[i, k * FILTERS + better] = a + top[better]
    return best, place


@dataclass
class Training:
    """A network on its way: the sums of squared gradients (Adagrad), the rows that are learned, the labels' weights."""

    net: Network
    row_slack: np.ndarray
    dense_slack: np.ndarray
    known: np.ndarray
    weight: np.ndarray

    @classmethod
    def begin(cls, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, seed: int) -> Training:
        """Before the first epoch, by the numbers of texts of either label, in all and for each embedding row."""
        rng = np.random.default_rng(seed)
        share = max(n_pos / max(n_pos + n_neg, 1), 1e-3)
        known = pos + neg >= MIN_TEXTS
        table = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
        table[:, 0] = log_odds(pos, neg, share) / 4
        table[~known] = 0
        filters = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w, f in zip(WIDTHS, filters, strict=True):
            f[::DIM] = rng.uniform(0.3, 1.0, (w, FILTERS))
        net = Network(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.2, np.float32), -1.0)
        weight = np.array([0.5 / (1 - min(share, 0.999)), 0.5 / share])
        return cls(net, np.full(1 << BITS, 1e-3, np.float32), np.full(len(net.dense), 1e-3, np.float32), known, weight)

    def copy(self) -> Training:
        net = Network(self.net.table.copy(), [x.copy() for x in self.net.filters], [x.copy() for x in self.net.bias], self.net.out.copy(), self.net.out_bias)
        return Training(net, self.row_slack.copy(), self.dense_slack.copy(), self.known, self.weight)

    def pass_over(self, words: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.05) -> np.ndarray:
        """One epoch of Adagrad on the balanced logistic loss; gradients run only through the pooled windows.

        Returns which embedding rows were trained.
        """
        net, touched = self.net, np.zeros(1 << BITS, bool)
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            own = np.concatenate([*(words[bounds[i] : bounds[i + 1]] for i in part), np.zeros((1, 2), np.int32)])
            size = np.diff(bounds)[part]
            edge = np.concatenate([[0], np.cumsum(size)])
            pooled, place = top_windows(net, own[:-1], edge)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
            delta = ((p - labels[part]) * self.weight[labels[part]] / len(part)).astype(np.float32)
            back = delta[:, None] * net.out[None, :] * (pooled > 0)
            grads, hit, push = [], [], []
            for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                g, top = back[:, k * FILTERS : (k + 1) * FILTERS], place[:, k * FILTERS : (k + 1) * FILTERS]
                d_filter = np.zeros_like(f)
                for j in range(width):
                    # windows may reach into the zeros behind a text
                    inside = top + j < size[:, None]
                    pair = own[np.minimum(edge[:-1, None] + top + j, len(own) - 1)]
                    vectors = (net.table[pair[..., 0]] + net.table[pair[..., 1]]) * inside[..., None]
                    d_filter[j * DIM : (j + 1) * DIM] = np.einsum("nfd,nf->df", vectors, g)
                    use = inside & (g != 0)
                    hit.append(pair[use])
                    push.append((g[:, :, None] * f[j * DIM : (j + 1) * DIM].T[None])[use])
                grads.append(d_filter.ravel())
            grads += [back.sum(0), pooled.T @ delta, delta.sum(keepdims=True)]
            flat = np.concatenate(grads)
            self.dense_slack += flat * flat
            net.dense = net.dense - rate * flat / np.sqrt(self.dense_slack)
            pairs, moves = np.concatenate(hit), np.concatenate(push)
            for column in (0, 1):
                rows, where = np.unique(pairs[:, column], return_inverse=True)
                g = np.zeros((len(rows), DIM), np.float32)
                np.add.at(g, where, moves)
                rows, g = rows[self.known[rows]], g[self.known[rows]]
                self.row_slack[rows] += (g * g).mean(1)
                net.table[rows] -= rate * g / np.sqrt(self.row_slack[rows])[:, None]
                touched[rows] = True
        return touched

    def changes(self, before: Training) -> np.ndarray:
        """What a pass has changed, in units: embeddings and their sums of squares, then a row for each other parameter."""
        out = np.zeros(((1 << BITS) + len(self.dense_slack), DIM + 1))
        out[: 1 << BITS, :DIM] = self.net.table.astype(np.float64) - before.net.table
        out[: 1 << BITS, DIM] = self.row_slack.astype(np.float64) - before.row_slack
        out[1 << BITS :, 0] = self.net.dense.astype(np.float64) - before.net.dense
        out[1 << BITS :, DIM] = self.dense_slack.astype(np.float64) - before.dense_slack
        return np.rint(out * UNIT).astype(np.int64)

    def apply(self, at: np.ndarray, mean: np.ndarray) -> None:
        """Add the mean changes ``mean`` of the rows ``at`` of :meth:`changes`."""
        out = np.zeros(((1 << BITS) + len(self.dense_slack), DIM + 1))
        out[at] = mean
        self.net.table += out[: 1 << BITS, :DIM].astype(np.float32)
        self.row_slack += out[: 1 << BITS, DIM].astype(np.float32)
        self.net.dense = self.net.dense + out[1 << BITS :, 0].astype(np.float32)
        self.dense_slack += out[1 << BITS :, DIM].astype(np.float32)


def log_odds(pos: np.ndarray, neg: np.ndarray, prior: float, strength: float = 5.0) -> np.ndarray:
    """Of each embedding row, how much likelier texts that contain it are to be labelled 1, shrunk to 0."""
    share = (pos + strength * prior) / (pos + neg + strength)
    return np.log(share / (1 - share)) - np.log(prior / (1 - prior))


def best_limit(bins: np.ndarray, hits: np.ndarray, texts: np.ndarray, fallback: float, strength: float = 5.0) -> float:
    """The logit that best divides the labels (F1, middle of the gap), drawn to ``fallback`` if labels are few.

    ``hits`` of the ``texts`` of each bin of logits (of width 1 / BINS) are labelled 1.
    """
    n = hits.sum()
    if not n or n == texts.sum():
        return fallback
    order = np.argsort(-bins)
    bins = bins[order]
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(texts[order]) + n)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)[0]
    limit = (bins[best] + (bins[best + 1] + 1 if best + 1 < len(bins) else bins[best])) / 2 / BINS
    return float((n * limit + strength * fallback) / (n + strength))


def unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """[words, 2] embedding rows and n + 1 word offsets of rows of :func:`learning_texts`."""
    size = rows.column("size").to_numpy()
    each = [pa.decompress(x, 8 * n, "zstd", asbytes=True) for x, n in zip(rows.column("words").to_pylist(), size.tolist(), strict=True) if n]
    return np.frombuffer(b"".join(each), np.int32).reshape(-1, 2), np.concatenate([[0], np.cumsum(size)])


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in spans(np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())])):
            yield batch.slice(begin, end - begin)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap in which the slots of all ``ids(doc_id)`` are set; few others' are."""
    bits = min(1 << max(16 * ids.count() - 1, 1 << 15).bit_length(), ID_BITS)
    slot = id_slot(bits).alias("slot")
    found = ids.select(slot).groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("held")).toArrow()
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for part, held in zip(found.column("part").to_pylist(), found.column("held").to_pylist(), strict=True):
        out[part - 1] = np.frombuffer(held, np.uint8)
    return out.ravel()


def id_slot(bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))


def learning_texts(docs: DataFrame, labels: DataFrame, shard_chars: int, seed: int) -> DataFrame:
    """(shard, for_test, doc_id, toxic, lang, size, words) of all labelled rows that are not held out, a shard's rows in one
    partition and in order; ``words`` are ``size`` pairs of embedding rows, compressed.

    Of texts of equal words and label the row of the smallest doc_id is taken. A fifth is for the thresholds. Which rows are
    taken is found on digests; the words travel once, to their shard. Texts whose ids have no label are mostly left out before by
    a bitmap, whose few false ones the join leaves out.
    """
    spark = docs.sparkSession
    known = labels.where(is_learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic").cast("int") == 1).cast("int").alias("toxic"))
    rows = docs.where(F.col("text").isNotNull() & is_learnable(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    chars = rows.select("doc_id", F.length("text").alias("n")).join(known, "doc_id").agg(F.sum("n")).first()[0] or 0
    shards = chars // shard_chars + 1
    bitmap = spark.sparkContext.broadcast(id_filter(known))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(3).to_numpy()
            yield batch.filter(pa.array((bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(labelled(batches)):
            words, bounds = word_buckets(chunk)
            each = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            digests = pa.array([blake2b(x, digest_size=16).digest() for x in each], pa.binary())
            held = pa.array([pa.compress(x, "zstd", asbytes=True) for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([chunk.rows.column(0), chunk.rows.column(2), digests, pa.array(np.diff(bounds)), held], names=["doc_id", "lang", "digest", "size", "words"])

    slot = id_slot(8 * len(bitmap.value)).alias("slot")
    found = rows.select("doc_id", "text", "lang", slot).mapInArrow(encode, "doc_id long, lang string, digest binary, size long, words binary")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    partitions = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    taken = found.select("doc_id", "lang", "digest").join(known, "doc_id").groupBy("digest", "toxic").agg(F.min(F.struct("doc_id", "lang")).alias("x"))
    taken = taken.select("digest", "toxic", "x.doc_id", "x.lang").select(shard, "*")
    words = found.select(shard, "doc_id", "digest", "size", "words")
    # not a join, which would deal the rows out anew by all of its keys; rows that repeat an id and its words become one
    both = taken.unionByName(words, allowMissingColumns=True).repartitionById(partitions, "shard").groupBy("shard", "doc_id", "digest")
    whole = both.agg(*(F.first(x, ignorenulls=True).alias(x) for x in ("toxic", "lang", "size", "words"))).where("toxic is not null")
    for_test = (F.pmod(F.xxhash64("digest", F.lit(seed)), F.lit(5)) == 4).alias("for_test")
    return whole.sortWithinPartitions("shard", "doc_id", "digest").select("shard", for_test, "doc_id", "toxic", "lang", "size", "words")


def bucket_counts(texts: DataFrame, names: list[str]) -> np.ndarray:
    """Rows 0 and 1: learning texts of that label that hold each bucket; then how often each is a whole word in texts of each language."""
    number = {x: i + 2 for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number) + 2, 1 << BITS), np.int64)
        for rows in pieces(batches):
            words, bounds = unpacked(rows)
            row = np.repeat(np.arange(rows.num_rows), np.diff(bounds))
            held = np.unique((row[:, None] << BITS) | words)
            kind = np.where(rows.column("for_test").to_numpy(zero_copy_only=False), -1, rows.column("toxic").to_numpy())[held >> BITS]
            lang = np.array([number.get(x, -1) for x in rows.column("lang").to_pylist()], np.int64)[row]
            for at, bucket in ((kind, held & ((1 << BITS) - 1)), (lang, words[:, 0])):
                for k in np.unique(at[at >= 0]):
                    total[k] += np.bincount(bucket[at == k], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    found = texts.select("for_test", "toxic", "lang", "size", "words").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(names) + 2) << BITS, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(-1, 1 << BITS)


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    held: list[pa.RecordBatch] = []
    last = -1
    for batch in batches:
        shard = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                if held and shard[a] != last:
                    yield last, pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = int(shard[a])
    if held:
        yield last, pa.Table.from_batches(held)


def train(texts: DataFrame, state: Training, epoch: int, seed: int) -> None:
    """One epoch: each shard trains its copy of ``state``, which then takes the mean change of each parameter.

    The mean of an embedding row is over the shards whose texts train it.
    """
    held = texts.sparkSession.sparkContext.broadcast(state)
    fields = [f"d{k}" for k in range(DIM + 1)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, parts = 0, 0
        for shard, rows in whole_shards(batches):
            own = held.value.copy()
            words, bounds = unpacked(rows)
            touched = own.pass_over(words, bounds, rows.column("toxic").to_numpy(), np.random.default_rng([seed, epoch, shard]))
            total = total + own.changes(held.value)
            parts = parts + np.concatenate([touched, np.ones(len(own.dense_slack), bool)]).astype(np.int64)
        at = np.flatnonzero(parts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(parts[at]), *(pa.array(total[at, k]) for k in range(DIM + 1))], names=["at", "parts", *fields])

    schema = f"at long, parts long, {', '.join(f'{x} long' for x in fields)}"
    sums = texts.where("not for_test").select("shard", "toxic", "size", "words").mapInArrow(step, schema).groupBy("at").agg(*(F.sum(x).alias(x) for x in ("parts", *fields)))
    found = sums.toArrow()
    held.destroy()
    total = np.stack([found.column(x).to_numpy() for x in fields], 1)
    state.apply(found.column("at").to_numpy(), total / UNIT / found.column("parts").to_numpy()[:, None])


def limits(texts: DataFrame, net: Network) -> np.ndarray:
    """The best limit of each language that the network reads from the words, and the one of all texts."""
    held = texts.sparkSession.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            words, bounds = unpacked(rows)
            at = np.floor(np.clip(held.value.logits(words, bounds), -40, 40) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held.value.language(words, bounds).astype(np.int64)), pa.array(at), rows.column("toxic")], names=["tongue", "bin", "toxic"])

    rows = texts.where("for_test").select("toxic", "size", "words").mapInArrow(judge, "tongue long, bin long, toxic int")
    found = rows.groupBy("tongue", "bin").agg(F.count(F.lit(1)).alias("texts"), F.sum("toxic").alias("hits")).toArrow()
    tongue, bins, texts_of, hits = (found.column(x).to_numpy() for x in ("tongue", "bin", "texts", "hits"))
    each, at = np.unique(bins, return_inverse=True)
    overall = best_limit(each, np.bincount(at, hits, len(each)), np.bincount(at, texts_of, len(each)), fallback=0.0, strength=1.0)
    own = [best_limit(bins[tongue == k], hits[tongue == k], texts_of[tongue == k], overall) for k in range(len(net.languages))]
    return np.array([*own, overall])


def learn(docs: DataFrame, labels: DataFrame, seed: int = 5, epochs: int = EPOCHS, shard_chars: int = SHARD_CHARS) -> Network:
    """Fit on all labelled rows that are not held out.

    About four fifths of them train the network, one fifth calibrates the thresholds, by a hash of their words. ``lang`` is
    used only to learn which words belong to which language. The model depends on the rows and ``shard_chars``, not on
    the order or the partitions of the tables.
    """
    texts = learning_texts(docs, labels, shard_chars, seed).persist(StorageLevel.DISK_ONLY)
    try:
        n_pos, n_neg = texts.where("not for_test").agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
        sizes = texts.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
        names = sorted(r["lang"] for r in sizes.collect())
        counts = bucket_counts(texts, names)
        state = Training.begin(counts[1], counts[0], n_pos, n_neg, seed)
        for epoch in range(epochs if n_pos + n_neg else 0):
            train(texts, state, epoch, seed)
        net = state.net
        spoken = counts[2:].T + 0.05
        net.languages, net.tongue = names, np.log(spoken / spoken.sum(0)).astype(np.float32)
        net.limits = limits(texts, net)
        return net
    finally:
        texts.unpersist()


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text, ...)``.

    ``predicted`` is 1 if the score is at least 0.7. Null and empty texts and texts without a word get the score
    of no activation. Texts of more than a million characters are read in parts. Rows that repeat are each scored; other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = held.value.scores(*word_buckets(chunk)).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column(0), chunk.rows.column(2), pa.array(found), pa.array((found >= DECISION).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    return plain.mapInArrow(score, RESULT)
