"""Classifiers: held-out accuracy on the given tables and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import language_id, quality, toxicity
from pulseframe.llm import textkernel
from pulseframe.llm.common import table

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 !!!"), (4, "x" * 200_000), (4, "x" * 200_000), (None, "the and of")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def odd(spark):
    return spark.createDataFrame([(*r, "fr", 1) for r in ODD], "doc_id long, text string, lang string, score int")


def test_language(spark, docs):
    model = language_id.learn(docs)
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, rejected = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right > 0.98 and rejected == 0
    rows = {r["doc_id"]: r for r in language_id.identify(odd(spark), model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0 and rows[3]["rejected"]
    assert 0 <= rows[4]["score"] <= 1 and rows[None]["lang_pred"] == "en"
    assert sorted(r["doc_id"] or 0 for r in language_id.keep_identified(odd(spark).where("doc_id is null or doc_id < 4"), model).collect()) == [0]
    foreign = spark.createDataFrame([(1, "Привет, как дела сегодня утром"), (2, "你好世界今天天气很好")], "doc_id long, text string")
    assert all(r["rejected"] for r in language_id.identify(foreign, model).collect())


def test_foreign_texts_are_rejected(spark, docs):
    polish = "Pewnego razu młody rybak wypłynął łodzią daleko poza zatokę, ponieważ chciał zobaczyć wyspę, którą opisywał jego dziadek. "
    rows = spark.createDataFrame([(1, polish), (2, polish * 30), (3, "Однажды утром молодой рыбак вышел в море один. " * 5000)], "doc_id long, text string")
    short = docs.where("length(text) < 1000")
    for known in (docs, short):
        assert all(r["rejected"] for r in language_id.identify(rows, language_id.learn(known)).collect())


def test_nothing_to_learn_from(spark):
    empty = odd(spark).where("false")
    model = language_id.learn(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), model).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0
    net = toxicity.learn(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(odd(spark), net).where("predicted = 0").count() == len(ODD)
    ratio = quality.learn(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.resample(empty, ratio, 0.5).count() == 0


def test_toxicity(spark, docs, labels):
    net = toxicity.learn(docs, labels)
    found = toxicity.score_documents(docs, net).join(labels, "doc_id").toPandas()
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()
    fit = found[~found.held_out]
    assert ((fit.predicted == 1) & (fit.toxic == 1)).sum() / (fit.toxic == 1).sum() > 0.8
    assert (found[(found.held_out) & (found.toxic == 0)].predicted == 0).mean() > 0.95
    order = found[found.held_out].score.rank()
    toxic = found[found.held_out].toxic == 1
    auc = (order[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.85
    assert toxicity.score_documents(odd(spark), net).count() == len(ODD)


def test_quality(spark, docs, labels):
    share = quality.target_share(labels)
    found = quality.resample(docs, quality.learn(docs, labels), share).join(labels, "doc_id").where("held_out").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.95 and found[found.quality == 0].kept.mean() < 0.1
    rows = quality.resample(docs, quality.learn(docs, labels), 0.3).toPandas()
    assert rows.kept.sum() == round(0.3 * len(rows))
    assert rows[rows.kept].sample_key.min() >= rows[~rows.kept].sample_key.max() - 1e-6


def test_exact_top_k_with_ties(spark):
    same = spark.createDataFrame([(i, "a b", "fr", 1) for i in range(10)] + [(10, None, "fr", 1)], "doc_id long, text string, lang string, score int")
    ratio = np.zeros(1 << quality.BITS, np.float32)
    assert quality.resample(same, ratio, 0.5).where("kept").count() == 6
    assert quality.resample(same, ratio, 0.0).where("kept").count() == 0
    assert quality.resample(same, ratio, 1.0).where("kept").count() == 11
    keys = spark.createDataFrame([(k,) for k in (5, 5, 9, 1 << 61, -7, -(1 << 62))], "key long")
    assert [quality.kth_highest(keys, k) for k in (1, 2, 3, 4, 5, 6, 7)] == [1 << 61, 9, 5, 5, -7, -(1 << 62), None]


def test_keys_order_as_doubles_do(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 1.0, np.nextafter(1.0, 2), -1.0, np.nextafter(-1.0, 0), np.inf, -np.inf]])
    bits = quality.sortable_bits(x)
    assert (bits[x == 0] == 0).all() and ((x[:, None] < x[None]) == (bits[:, None] < bits[None])).all()
    held = spark.createDataFrame([(1.0,), (1.0000001,), (-2.5,)], "x double").select(quality._sortable(F.col("x")).alias("k"), "x").orderBy("k").collect()
    assert [r["x"] for r in held] == [-2.5, 1.0, 1.0000001]


def test_language_model_with_repeated_ids(spark):
    """Rows that share an id are learned alike in any order and partitions; of too many languages the most frequent ones are."""
    rng = random.Random(6)
    texts = texts_of_words(6, 120)
    rows = [(rng.choice([3, 6, None]), t, rng.choice(["en", "de"])) for t in texts]
    one, two = (language_id.learn(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n)) for x, n in ((rows, 1), (rows[::-1], 7)))
    assert one.languages == two.languages and np.array_equal(one.centroids, two.centroids) and np.array_equal(one.floor, two.floor)


def test_languages_learned_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LEARN_LANGUAGES", 2)
    rows = [(3 * i, f"some words of text {i}", lang) for i, lang in enumerate(["en"] * 9 + ["de"] * 8 + ["fr"] * 3)]
    assert language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]


def texts_of_words(seed, n):
    rng = random.Random(seed)
    words = ["the", "Of", "größe", "x1", "don't", "--", "!!!!", "a_b", "ÉTÉ", "plan", "b", "c", "d"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 7, 40]))) for _ in range(n)] + ["", " \t", "...", "a\u00a0b"]


def hash_of(token):
    points = np.array([ord(c) for c in token], np.uint32)
    return int(textkernel.hash_runs(points, np.array([0]), np.array([len(points)]))[0])


def plain_tokens(text):
    out = []
    for kind, run in groupby(text, lambda c: 0 if c in " \t\n\x0b\x0c\r\u00a0" else 1 if c.isalnum() else 2):
        token = "".join(c.lower() if len(c.lower()) == 1 else c for c in run)
        if kind:
            out.append(token if kind == 1 else token[:3])
    return out


def plain_buckets(text):
    hashes = [hash_of(x) for x in plain_tokens(text)]
    pairs = [(a * 0x9E3779B97F4A7C15 % 2**64) ^ (b * 0xC2B2AE3D27D4EB4F % 2**64) for a, b in zip(hashes, hashes[1:])]
    return [x >> (64 - quality.BITS) for x in hashes + pairs]


@pytest.mark.parametrize("temper", [1.0, 5.0])
def test_quality_equals_brute_force(spark, temper):
    texts = list(enumerate(texts_of_words(1, 60)))
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(len(t) > 20), 0) for i, t in texts], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.resample(docs, quality.learn(docs, labels), 0.4, temper=temper).collect()}
    learnable = {i for i, t in texts if zlib.crc32(str(i).encode()) % 3 != 1 and len(t) > 20}
    raw = Counter(b for _, t in texts for b in plain_buckets(t))
    target = Counter(b for i, t in texts if i in learnable for b in plain_buckets(t))
    scale = target.total() / raw.total()
    ratio = lambda b: math.log((target[b] + 8) / (raw[b] * scale + 8))
    keys = {}
    for i, t in texts:
        u = int(hashlib.md5(f"3|{i}".encode()).hexdigest()[:13], 16) / 2**52
        keys[i] = sum(map(ratio, plain_buckets(t))) / temper - math.log(-math.log(max(u, 1e-12)))
        assert abs(found[i]["sample_key"] - keys[i]) < 1e-4
    kept = sorted(keys, key=lambda i: -keys[i])[: round(0.4 * len(keys))]
    assert {i for i in found if found[i]["kept"]} == set(kept)


def test_a_longer_text_weighs_more(spark):
    ratio = np.zeros(1 << quality.BITS, np.float32)
    for b in set(plain_buckets("good good good")):
        ratio[b] = 0.5
    docs = spark.createDataFrame([(1, "good"), (2, "good good good"), (3, "good " * 100)], "doc_id long, text string")
    weight = {r["doc_id"]: r["log_weight"] for r in quality.weigh(docs, ratio).collect()}
    assert weight == {1: 0.5, 2: 2.5, 3: 99.5}


def test_network_equals_plain_loops(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts_of_words(2, 80))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0, i % 3 == 0) for i in range(80)], "doc_id long, quality int, toxic boolean")
    net = toxicity.learn(docs, labels.withColumn("toxic", F.col("toxic").cast("int")))
    for _, text, _ in docs.collect():
        tokens = ["".join(r) for k, r in groupby("".join(c.lower() if len(c.lower()) == 1 else c for c in text), str.isalnum) if k]
        shift = 64 - toxicity.BITS
        rows = [(hash_of(x) >> shift, (hash_of(x[: toxicity.PREFIX]) * 3 % 2**64) >> shift) for x in tokens]
        vectors = [net.table[a] + net.table[b] for a, b in rows] + [np.zeros(toxicity.DIM, np.float32)] * 5
        tops = []
        for width, weight, bias in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True):
            for f in range(toxicity.FILTERS):
                windows = [bias[f] + sum(float(vectors[i + k] @ weight[k * toxicity.DIM : (k + 1) * toxicity.DIM, f]) for k in range(width)) for i in range(len(rows) + 3)]
                tops.append(max(0.0, *windows))
        words, bounds = toxicity.word_buckets(textkernel.Chunk([text], None))
        assert words.tolist() == [list(r) for r in rows]
        assert abs(net.logits(words, bounds)[0] - (np.array(tops) @ net.out + net.out_bias)) < 1e-3


def test_learning_does_not_depend_on_partitions(spark, docs, labels):
    one, other = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(13, "lang"), labels.repartition(5))
    assert (one.table == other.table).all() and (one.limits == other.limits).all() and (one.out == other.out).all()


def rare_insults(n=36_000, words=1_500):
    """Every text has one of many words that few texts hold and that differ by their first five characters; half of these words are toxic."""
    rng = random.Random(4)
    plain = [f"plain{k}" for k in range(40)]
    return [(i, " ".join([*rng.choices(plain, k=4), f"{i % 2 * 50_000 + i // 2 % words:05d}"]), "en", i % 2) for i in range(n)]


def test_every_labelled_text_is_learned_from(spark):
    """A word of eight learning texts is known however many others there are; each word is in about two of any 8,000 rows."""
    rows = rare_insults()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    found = toxicity.score_documents(docs, toxicity.learn(docs, labels, shard_chars=300_000)).join(labels, "doc_id").where("held_out").toPandas()
    assert (found[found.toxic == 1].predicted == 1).mean() > 0.9 and (found[found.toxic == 0].predicted == 0).mean() > 0.9


def test_counts_are_of_all_learning_texts(spark):
    rows = rare_insults(9_000, 300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    # other values are no label 1; an id without a text, a null id and a null label count for nothing
    labels = spark.createDataFrame([(r[0], r[3] or i % 4) for i, r in enumerate(rows)] + [(10**6, 1), (None, 1), (0, None)], "doc_id long, toxic int")
    docs = docs.union(docs.limit(50)).union(spark.createDataFrame([(None, "plain1", "en"), (10**7, "plain2", "en")], docs.schema))
    texts = toxicity.learning_texts(docs, labels, 20_000, 5)
    held = texts.toArrow()
    words, bounds = toxicity.unpacked(held)
    held = held.to_pylist()
    assert {r["doc_id"] for r in held} <= {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert len(held) == len({(r[1], r[3]) for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}) and len({r["shard"] for r in held}) > 10
    counts = toxicity.bucket_counts(texts, ["en"])
    want = np.zeros_like(counts)
    for r, a, b in zip(held, bounds[:-1], bounds[1:], strict=True):
        own = words[a:b]
        np.add.at(want[2], own[:, 0], 1)
        if not r["for_test"]:
            want[r["toxic"]][np.unique(own)] += 1
    assert (counts == want).all()


def test_shards_learn_alike_in_any_order(spark, docs, labels):
    one, other = (toxicity.learn(d, x, shard_chars=50_000) for d, x in ((docs, labels), (docs.repartition(7, "lang"), labels.repartition(5))))
    assert (one.table == other.table).all() and (one.limits == other.limits).all() and (one.dense == other.dense).all()


def test_training_on_long_texts_in_spans(monkeypatch):
    """Windows, and so gradients, are those of whole texts."""
    rng = np.random.default_rng(3)
    words, bounds = rng.integers(0, 1 << toxicity.BITS, (900, 2)).astype(np.int32), np.array([0, 0, 3, 700, 702, 900])
    state = toxicity.Training.begin(np.full(1 << toxicity.BITS, 5), np.full(1 << toxicity.BITS, 5), 2, 3, 1)
    best, place = toxicity.top_windows(state.net, words, bounds)
    monkeypatch.setattr(toxicity, "SPAN_WORDS", 50)
    spans = toxicity.top_windows(state.net, words, bounds)
    assert abs(best - spans[0]).max() < 1e-5 and (place == spans[1])[best > 1e-3].all()


def test_a_text_scores_the_same_beside_others():
    rng = np.random.default_rng(5)
    size = np.array([3, 0, 1, 0, 40, 2])
    words, bounds = rng.integers(0, 1 << toxicity.BITS, (size.sum(), 2)).astype(np.int32), np.concatenate([[0], np.cumsum(size)])
    net = toxicity.Training.begin(np.full(1 << toxicity.BITS, 5), np.full(1 << toxicity.BITS, 5), 2, 3, 1).net
    net.table *= 50
    alone = [net.logits(words[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert abs(net.logits(words, bounds) - alone).max() < 1e-3
    pooled, _ = toxicity.top_windows(net, words, bounds)
    assert abs(pooled @ net.out + net.out_bias - alone).max() < 1e-3


def test_limit_divides_best():
    bins, hits, texts = np.array([-3, 0, 512, 700]), np.array([0, 0, 4, 6]), np.array([50, 5, 4, 6])
    assert toxicity.best_limit(bins, hits, texts, 0.0, strength=0.0) == (512 + 1) / 2 / toxicity.BINS
    assert toxicity.best_limit(bins, texts * 0, texts, 0.25) == toxicity.best_limit(bins, texts, texts, 0.25) == 0.25
    assert toxicity.best_limit(np.zeros(0, int), np.zeros(0), np.zeros(0), 0.5) == 0.5


def test_centroids_equal_plain_cosines(spark, docs):
    model = language_id.learn(docs)

    def buckets(text):
        for is_word, run in groupby(text, str.isalpha):
            if is_word:
                word = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in run) + " "
                for n in language_id.ORDERS:
                    for i in range(len(word) - n + 1):
                        code = 0
                        for k, c in enumerate(word[i : i + n], 1):
                            code = (code * 0x01000193 + ord(c) + k) % 2**32
                        yield ((code ^ (code >> 15)) * 0x2C1B3C6D % 2**32) >> 19

    rows = docs.where("text is not null").orderBy("doc_id").limit(30).collect()
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for row in rows:
        counts = Counter(buckets(row["text"]))
        vector = {b: math.log1p(n) * float(model.weights[b]) for b, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        cosine = [sum(x * float(c[b]) for b, x in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert found[row["doc_id"]]["lang_pred"] == model.languages[model.owner[best]]
        assert abs(found[row["doc_id"]]["score"] - cosine[best]) < 1e-3


def test_many_languages_all_learn(spark):
    rows = [(i, f"text{i % 900} of words {'abcdefgh'[i % 8]}", f"l{i % 900}") for i in range(9000)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 890


def test_parts_of_long_texts(spark, docs, labels, monkeypatch):
    """Parts give what the whole gives; workers see the module as it is, so functions are compared."""
    text = " ".join(r["text"] for r in docs.limit(60).collect() if r["text"])
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": [text]})
    whole = textkernel.Chunk([text], rows)
    monkeypatch.setattr(textkernel, "LONG_TEXT", 1000)
    parts = textkernel.Chunk([text], rows)
    assert whole.long is None and parts.long and "".join(textkernel.long_parts(text)) == text and len(list(parts.parts())) > 20
    assert all((a == b).all() for a, b in zip(textkernel.word_shingles(whole, 3), textkernel.word_shingles(parts, 3), strict=True))
    (a, x), (b, y) = (next(language_id.count_vectors(c)) for c in (whole, parts))
    assert a == b and (x == y).all()
    whole_counts, part_counts = (sum(np.bincount(b, minlength=1 << quality.BITS) for b, _ in quality.gram_parts(c)) for c in (whole, parts))
    assert (whole_counts == part_counts).all()
    net = toxicity.learn(docs, labels)
    one = net.logits(*toxicity.word_buckets(whole))
    monkeypatch.setattr(toxicity, "SPAN_WORDS", 50)
    assert abs(one - net.logits(*toxicity.word_buckets(parts))).max() < 1e-4


def test_a_text_of_fifty_million_characters(spark, docs, labels):
    text = "the word of it and more, " * 2_000_000
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert language_id.identify(rows, language_id.learn(docs)).first()["lang_pred"] == "en"
    assert 0 <= toxicity.score_documents(rows, toxicity.learn(docs, labels)).first()["score"] <= 1
    assert quality.weigh(rows, np.ones(1 << quality.BITS, np.float32)).first()["n_grams"] == 2 * 7 * 2_000_000 - 1
