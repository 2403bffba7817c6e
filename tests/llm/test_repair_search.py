"""Conversation repair, SentencePiece coding and lexical search against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseframe.llm import conversation_repair as cr
from pulseframe.llm import lexical_search as ls
from pulseframe.llm import piece_codec, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


# --- conversations


def plain_audit(codes):
    """Cost and audit by a DP over whole strings."""
    held = {0: (0, "")}

    def inserted(held):
        out = dict(held)
        for _ in range(2):
            for s, (cost, text) in list(out.items()):
                for c in "ua":
                    if c in cr.NEXT[s]:
                        t = cr.NEXT[s][c]
                        out[t] = min(out.get(t, (math.inf, "")), (cost + 5, text + "I"))
        return out

    for code in codes:
        initial, fault, now = code[:-1], code[-1], {}
        for s, (cost, text) in inserted(held).items():
            ways = [(s, cost + 2, "D")]
            if fault != "b":
                stay = 5 if fault == "t" else 0
                ways += [(cr.NEXT[s][initial], cost + stay, "K")] if initial in cr.NEXT[s] else []
                ways += [(cr.NEXT[s][c], cost + 1 + stay, "R") for c in "ua" if c in cr.NEXT[s]]
            for t, c, edit in ways:
                now[t] = min(now.get(t, (math.inf, "")), (c, text + edit))
        held = now
    return min(v for s, v in inserted(held).items() if s in (0, 3))


def plain_repair(rows):
    """The contract of op11, row by row."""
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(case, 1)
    out = []
    for conv, own in found.items():
        own.sort()
        seen, codes, counts, turns = set(), [], Counter(), [r[1] for r in own if r[0]]
        for i, (_, _, role, text) in enumerate(own):
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            counts["illegal"] += i > 0 and own[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
            codes.append(role[:1] + {"blank": "b", "duplicate": "b", "truncated": "t", None: "-"}[fault])
        cost, audit = plain_audit(codes)
        lines, left, state = [], iter(own), 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[2:]
            if edit != "D":
                if edit != "K":
                    role = "assistant" if state == 2 else "user"
                state = cr.NEXT[state][role[0]]
                lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_initials_of_inserts():
    assert [dict(x) for x in cr.INSERTS] == [{0: 0, 2: 1, 3: 2}, {1: 0, 2: 1, 3: 2}, {2: 0, 3: 1}, {3: 0, 2: 1}]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([i + f for i in ("s", "u", "a", "x", "") for f in "-bt"]), max_size=30), st.integers(1, 9))
def test_audits_equal_plain_ones_for_any_blocks(codes, size):
    codes = tuple(codes)
    want = plain_audit(codes)
    assert cr.short_audits(codes) == want
    assert cr.composed([cr.block_audits(codes[i : i + size]) for i in range(0, len(codes), size)]) == want


def test_order_of_audits_by_longest_common_prefix():
    rng, trie = random.Random(1), cr.Trie()
    texts = ["".join(rng.choices("DK", [1, 9], k=rng.randrange(1, 70))) for _ in range(120)]
    nodes = [trie.add(0, t) for t in texts]
    assert all(trie.less(a, b) == (x < y) for a, x in zip(nodes, texts, strict=True) for b, y in zip(nodes, texts, strict=True))
    assert [trie.text(n) for n in nodes] == texts


def random_rows(seed, conversations=60, rows=25):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", None, "é.  ", "x." * 40 + "a.", "x." * 40 + "b."]
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    out = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(1, rows)):
            plain = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if plain else rng.choice(roles)
            at = turn if rng.random() < 0.9 else rng.choice([None, rng.randrange(rows)])
            out.append((conv, at, role, f"Row {turn}." if plain and rng.random() < 0.8 else rng.choice(texts)))
    return out + rng.choices(out, k=20)


def as_tuples(df):
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain(spark, seed):
    rows = random_rows(seed)
    table = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"copies": F.lit("x"), "digest": F.lit(1), "side": F.lit(2)}).repartition(5)
    found = cr.repair(cr.damage(table))
    assert as_tuples(found) == plain_repair(rows)


def test_long_conversation_is_shared_by_partitions(spark, monkeypatch):
    """One conversation holds most rows; it comes from many partitions and blocks."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"Row {t}.", "Again.", "cut off"])) for t in range(3000)]
    rows += [(c, t, "user", "Hi.") for c in (1, 9) for t in range(3)] + [(7, 5, "user", "Same.")] * 50
    table = spark.createDataFrame(rows, CONVERSATIONS)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_tuples(cr.repair(cr.damage(table))) == plain_repair(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_repaired_rows(spark):
    rows = random_rows(3, 10)
    damaged = cr.damage(spark.createDataFrame(rows, CONVERSATIONS))
    audited = cr.audits(damaged)
    lines = {}
    for r in sorted(cr.repaired_rows(damaged, audited).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, *_, sha in plain_repair(rows):
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == sha


def test_conversations_empty_and_dropped(spark):
    assert cr.repair(cr.damage(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = as_tuples(cr.repair(cr.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], CONVERSATIONS))))
    assert found == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "the", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "\x00", "1", "<s>", "<0x41>", "​", " x", "ab "]), max_size=25).map("".join), max_size=8))
def test_pieces_equal_the_library(library, texts):
    table = piece_codec.chunk_table(PIECES)
    ids, bounds = piece_codec.code(texts, table)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library.encode(x) for x in texts]
    for x in texts:
        if x:
            assert piece_codec.code_long(x, table, 4).tolist() == library.encode(x)


def test_table_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "TABLE_CHUNKS", 10)
    table, rng = piece_codec.ChunkTable(PIECES), random.Random(2)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abc", k=3)) for _ in range(20))
        assert piece_codec.code([text], table)[0].tolist() == library.encode(text)
        assert len(table.recent) < 40 and len(table.older) < 40


def test_pieces_of_documents(spark, library):
    long = "word " * 300_000 + "▁ end"
    texts = [None, "", " ", "Plain text.", "Plain text.", "a" * 50_000, long, "日本 \n語"]
    docs = spark.createDataFrame([(i % 4 if i < 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    coded = piece_codec.encode(docs, PIECES)
    rows = coded.collect()
    want = sorted((library.encode(t or ""), library.decode(library.encode(t or ""))) for t in texts)
    assert sorted((r["ids"], r["decoded"]) for r in rows) == want
    assert [r["text"] for r in piece_codec.decode(coded, PIECES).collect()] == [r["decoded"] for r in rows]
    assert piece_codec.encode(docs.limit(0), PIECES).count() == 0


def test_digests_of_pieces(spark, library):
    from pulseframe.llm.common import table

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    rows = queries.op12_piece_codec(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- search


def plain_search(docs, items, k):
    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    n, length = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    counts = [(i, len(w), Counter(w)) for i, w in words]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for doc, size, c in counts:
            m = 50 + (50 * size * n) // length if length else 50
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c), doc is None, doc))
        scores = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "block"), [(1, 256), (16, 3), (1024, 256)])
def test_search_equals_plain(spark, width, block):
    rng = random.Random(width)
    words = ["alpha", "Beta", "é", "x1", "日本", "of", "the", "THE", "gamma", "q"]
    docs = [(rng.choice([None, *range(300)]), None if i % 17 == 0 else rng.choice(" -\n_").join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(400)]
    items = [(rng.choice([None, 1, 2, 3]), " ".join(rng.choices([*words, "missing", "."], k=rng.randrange(0, 6)))) for _ in range(12)] + [(5, None), (6, "..."), (7, "missing")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"terms": F.lit(1), "n": F.lit("x"), "score": F.lit(2), "rank": F.lit(0)})
    found = ls.search(table.repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1)), k=5, width=width, block=block)
    assert sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in found.collect()), key=str) == plain_search(docs, items, 5)


def test_search_long_and_empty(spark):
    docs = [(1, "needle " + "hay " * 400_000 + "needle"), (2, "needle"), (3, "")]
    table, items = spark.createDataFrame(docs, "doc_id long, text string"), [(1, "needle hay")]
    found = ls.search(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(docs, items, 50)
    assert ls.search(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert ls.search(table, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_terms_of_one_hash_are_told_apart():
    vocabulary = ls.Vocabulary(["ab", "abc", "b"])
    vocabulary.hashes[:] = vocabulary.hashes[0]
    from unittest import mock

    import numpy as np

    points = np.frombuffer("ab abc c b".encode("utf-32-le"), np.uint32)
    starts, ends = np.array([0, 3, 7, 9]), np.array([2, 6, 8, 10])
    with mock.patch.object(ls, "hash_runs", lambda p, s, e: np.full(len(s), vocabulary.hashes[0])):
        assert vocabulary.look_up(points, starts, ends).tolist() == [0, 1, -1, 2]
