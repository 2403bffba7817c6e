"""Exact, near and vector deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from pulseframe.llm import exact_dedup, minhash, pivot_index
from pulseframe.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, band int, node string, body string"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", "y") for i, t in rows], DOC)


def sample_rows(seed=1):
    random.seed(seed)
    rows = []
    for _ in range(40):
        words = random.choices(WORDS, k=random.choice([1, 2, 5, 60, 200]))
        rows.append(" ".join(words))
        for _ in range(random.choice([0, 0, 1, 4])):
            own = list(words)
            for _ in range(random.choice([0, 1, 3, 12])):
                own[random.randrange(len(own))] = random.choice(WORDS)
            rows.append(random.choice(["  ", "\n", ""]).join(["", " ".join(own)]))
    return list(enumerate([None, "", " \t\n", "One Two three", "one two THREE", *rows]))


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = set()
    for body, members in groups.items():
        keep = min(members)[1]
        out |= {(i, keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest()) for _, i in members}
    return out


def test_exact_equals_brute_force(spark):
    rows = sample_rows()
    assert set(map(tuple, exact_dedup.exact_duplicates(docs_of(spark, rows)).collect())) == brute_exact(rows)


def test_exact_edges(spark):
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).count() == 0
    found = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs_of(spark, [(None, "a"), (3, "a"), (4, "b"), (4, "b"), (5, "é x")])).collect()}
    assert found[3]["group_size"] == 2 and found[3]["kept"] and not found[None]["kept"]
    assert found[4]["group_size"] == 2 and found[4]["kept"] and found[5]["group_size"] == 1
    kept = exact_dedup.keep_first(docs_of(spark, [(3, "a"), (2, "a "), (4, "b"), (4, "b"), (None, "q")]))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "q"), (2, "a "), (4, "b")]
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_repeated_ids_with_different_texts(spark):
    rows = [(1, "a"), (4, "a"), (4, "only here"), (5, "x"), (5, "y"), (5, "y  "), (5, "y  "), (None, "q"), (None, "q "), (None, "a"), (None, "a")]
    kept = exact_dedup.keep_first(docs_of(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "q "), (1, "a"), (4, "only here"), (5, "x"), (5, "y  ")]
    clash = spark.createDataFrame([(5, "a", 1, 2, 3, 4), (5, "a ", 1, 2, 3, 4)], "doc_id long, text string, _sha int, _row int, _doc int, _special int")
    assert [tuple(r) for r in exact_dedup.keep_first(clash).collect()] == [(5, "a ", 1, 2, 3, 4)]
    twice = [(7, "a b c d"), (7, "a b c d"), (7, "A b c d"), (None, "x"), (None, "x"), (8, ""), (8, ""), (9, None)]
    kept = minhash.keep_representatives(spark.createDataFrame([(*r, 1, 2) for r in twice], "doc_id long, text string, _id int, _sha int"))
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect()) == [(0, "x"), (7, "a b c d"), (8, ""), (9, "")] and len(kept.columns) == 4
    found = minhash.near_components(docs_of(spark, [(5, "x y z"), (5, "u v w"), (6, "U v w"), (7, "x y z"), (7, "q")]))
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(5, 5), (5, 5), (6, 5), (7, 5), (7, 7)]
    near = [(1, "a b c"), (4, "A b c"), (4, "only here it is"), (5, "x y z"), (5, "u v w"), (6, "U v w"), (None, "a b c")]
    kept = minhash.keep_representatives(docs_of(spark, near))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(1, "a b c"), (4, "only here it is"), (5, "u v w"), (5, "x y z")]


def test_directory_doubles_and_splits():
    counts = np.zeros(16, np.int64)
    counts[[0, 1, 2, 3, 9]] = [5, 5, 5, 5, 1]
    directory = exact_dedup.split_directory(counts, 10, owners=2)
    held = directory.bucket
    assert len(held) == 8 and held[0] != held[1] and len(set(held[4:])) == 1 and (np.diff(held) >= 0).all() and held.max() == len(directory.owner) - 1
    for bucket in set(held):
        assert sum(counts[i] for i in range(16) if held[i // 2] == bucket) <= 10
    keys = np.array([0, 1 << 61, -1], np.int64)
    assert (directory.place(keys) == held[[0, 1, 7]]).all()
    assert directory.owner[0] == 0 and directory.owner[-1] == 1 and (np.diff(directory.owner) >= 0).all()


def test_index_holds_every_key_in_its_bucket(spark):
    texts = [(i, f"text {i % 700}") for i in range(2000)]
    keys = exact_dedup.text_keys(docs_of(spark, texts))
    index, directory = exact_dedup.build_index(keys)
    found = {r["key"]: (r["bucket"], r["n"]) for r in index.collect()}
    assert index.count() == len(found) == 700 and all(n == 2000 // 700 + (i < 2000 % 700) for i, n in enumerate(sorted((n for _, n in found.values()), reverse=True)))
    own = np.array(list(found), np.int64)
    assert (directory.place(own) == [b for b, _ in found.values()]).all()


def test_owners_chain_texts_of_one_key(spark):
    directory = exact_dedup.split_directory(np.array([1]), 10)
    texts = docs_of(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb "), (5, "c")])
    for hash_of in (lambda x: 7, len, lambda x: x[0] << 56):
        found = exact_dedup.equal_classes(texts, directory, hash_of)
        assert sorted((r["keep_id"], r["group_size"]) for r in found.collect()) == [(1, 2), (4, 2), (5, 1)]


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute_near(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_equals_brute_force(spark, words, percent):
    rows = sample_rows(4)
    found = minhash.near_components(docs_of(spark, rows), words, percent)
    assert set(map(tuple, found.collect())) == brute_near(rows, words, percent)


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_group_around_a_hub(spark, monkeypatch, rounds):
    """Copies that resemble their original but not each other, in blocks of few rows."""
    random.seed(2)
    base = random.choices(WORDS, k=120)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base)
        for j in random.sample(range(len(own)), random.choice([2, 3, 8])):
            own[j] = f"x{i}_{j}"
        rows.append((i, " ".join(own)))
    for i in range(60, 120):
        rows.append((i, " ".join(base[: 100 + i % 20] + [f"y{i}_{j}" for j in range(i % 23)])))
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    assert set(map(tuple, minhash.near_components(docs_of(spark, rows), 3, 85).collect())) == brute_near(rows, 3, 85)


def test_near_edges(spark):
    assert minhash.near_components(docs_of(spark, [])).count() == 0
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_components(docs_of(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (9, None), (8, " ")])).collect()}
    assert found == {(None, 1, 7, True), (7, 1, 7, True), (9, 0, 9, True), (8, 0, 8, True)}
    kept = minhash.keep_representatives(docs_of(spark, [(1, "a b c"), (2, "A b c"), (3, ""), (4, "")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_common_counts_equal_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    found = minhash.common_counts(np.concatenate(sets), np.repeat(np.arange(30), [len(x) for x in sets]), 30, dense_from=5)
    for i in range(30):
        for j in range(30):
            if i != j:
                assert found[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70)]
    random.shuffle(edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(31), 0), 50: 50, 70: 50, 100: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [list(map(float, v)) for v in base]
    for v in base[:15]:
        rows += [list(map(float, v + rng.normal(size=16) * s)) for s in (0.05, 0.3, 0.45)] + [list(map(float, v * 3))]
    rows += [rows[0]] * 5 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1e300] * 16, [1e300] * 15 + [1e299]]
    table = spark.createDataFrame([(i, v, 0, "z") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int, body string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivot_index.near_vectors(table).collect()}
    good = {i: np.array(v) / max(map(abs, v)) for i, v in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: i for i in range(len(rows))}
    links = dict.fromkeys(label, 0)
    for i, x in good.items():
        for j, y in good.items():
            if i != j and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert found == {i: (links[i], label[i]) for i in label}


def test_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (3, [1.0, 0.0])]
    found = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()) == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (3, 2, 1)]


def test_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 9)
    monkeypatch.setattr(pivot_index, "STRIPE_ROWS", 4)
    test_vectors_equal_brute_force(spark)


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert pivot_index.near_vectors(spark.createDataFrame([], schema)).count() == 0
    found = pivot_index.near_vectors(spark.createDataFrame([(1, None, 0), (None, [1.0], 0)], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["kept"]) for r in found) == [(0, True), (1, True)]
