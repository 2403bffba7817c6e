"""Page text, url rules, mixing, packing, and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseframe.llm import html_text, mixing, packing, queries, url_filter
from pulseframe.llm.common import table
from pulseframe.llm.textkernel import cuts, long_parts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_page_text():
    page = """<html><head><title>T</title><script>var a="</p><p>x"</script></head><body><header><nav><a href=/>Home</a> <a href=/b>More</a></nav></header>
    <div class="cookie-notice">We use cookies for the good of the site and of all that is in it, accept them to go on with it.</div>
    <article><h1>A &amp; B</h1><p>First   line &lt;p&gt; of the text<br>goes on with some of the words that it was made of.<p><b>Short</b> one.
    <aside>Also read this long note which is of no use to the text and the story that is in it for you.</aside><p>Last &eacute;.</p>
    <div id=comments><p>I think that this is the best of the texts that I have read in the last of the years.</p></div></article>
    <form><label>Name</label></form><footer>&copy; 2020</footer>"""
    assert html_text.main_text(page) == "A & B\nFirst line <p> of the text goes on with some of the words that it was made of.\nShort one.\nLast é."


def test_page_without_article():
    story = "The story of the man is a tale that it was in the house for all of the days with him."
    page = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h2>Head</h2><p>{story}<p>Short.<p>{story}</div><div>© 2020 by us</div>"
    assert html_text.main_text(page) == f"Head\n{story}\nShort.\n{story}"
    assert [html_text.main_text(x) for x in (None, "", "<!-- a", "<p", "<div class='", "&amp;")] == [""] * 6


STORY = "The story of the man is a tale that it was in the house for all of the days with him."
NOTE = "I think that this is the best of the texts that I have read in the last of the years."


@pytest.mark.parametrize("start", ["<div class='layout has-sidebar'>", "<div class=no-sidebar>", "<div id=social>", "<section class=ad-free><div class=no-comments>", "<form action=/x>", "<main><p>A lead of a few words.</p><div class=has-sidebar>"])
def test_marked_wrapper_of_an_article(start):
    page = f"<body>{start}<article><p>{STORY}</p><div class=ad>{NOTE}</div></article><div class=comments><article>{NOTE}</article><article>{NOTE}</article></div></body>"
    assert html_text.main_text(page).split("\n")[-1] == STORY and NOTE not in html_text.main_text(page)


def test_marks_around_other_articles_stay():
    for story in (f"<article>{STORY}</article>", f"<main>{STORY}</main>", f"<div><p>{STORY}<p>{STORY}</div>"):
        for aside in (f"<div class=comments><article>{NOTE}</article></div>" * 4, f"<div class=sidebar><article>{NOTE}</article></div>", f"<aside><article>{NOTE}</article></aside>"):
            assert NOTE not in html_text.main_text(f"<body>{story}{aside}") and STORY in html_text.main_text(f"<body>{story}{aside}")
    assert html_text.main_text(f"<div class=cookie-notice>{NOTE}</div>") == ""
    assert html_text.main_text(f"<form><header><a href=/>Home</a></header><div><p>{STORY}</div></form>") == STORY
    assert html_text.main_text(f"<div class=has-sidebar><h1>Head</h1><p>{STORY}</div>") == f"Head\n{STORY}"


@pytest.mark.parametrize(
    "story",
    [
        "Pewnego razu młody rybak wypłynął łodzią daleko poza zatokę, ponieważ chciał zobaczyć wyspę, którą opisywał jego dziadek każdej zimy.",
        "Certa manhã um jovem pescador saiu sozinho pelo mar porque queria ver a ilha que seu avô descrevia todas as noites de inverno.",
        "Однажды утром молодой рыбак вышел в море один, потому что хотел увидеть остров, о котором зимой рассказывал его дед у огня.",
        "有一天早晨年轻的渔夫独自驾船出海因为他想看看祖父每年冬天都会讲起的那座小岛到底是什么样子的。",
        "ある朝若い漁師は祖父が毎年冬に話してくれた小さな島を見るために一人で船を出して海へ向かいました。",
    ],
)
def test_page_in_another_language(story):
    menu = "<ul><li><a href=1>Um</a><li><a href=2>家</a></ul>"
    linked = f"<p><a href=3>{story}</a>"
    assert html_text.main_text(f"<body>{menu}<div><p>{story}<p>{story}</div><div>{linked}</div><footer>© x</footer>") == f"{story}\n{story}"


def test_list_of_words_on_a_known_page():
    words = "red green blue lamp table chair window door floor roof garden tree stone river cloud"
    assert html_text.main_text(f"<body><div><p>{STORY}<p>{STORY}</div><div>{words}</div>") == f"{STORY}\n{STORY}"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/p divb\"'=&;!-a1 \n", max_size=80))
def test_any_markup_is_taken(page):
    assert html_text.main_text(page) == "\n".join(html_text.main_text(page).split("\n"))


def test_pages_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 1), (1, "u", "<article><p>a b c d e</p></article>", 1)], "page_id long, url string, html string, text int")
    assert sorted((r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()) == [("", 0), ("a b c d e", 9)]


def brute_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:n])
    tail = rest[n:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    random.seed(1)
    hosts = ["example.com", "WWW.example.com", "a.b.example.com", "x.net", "net", "com", "notexample.com", "a..com", "é.NET", "", "example.com:80"]
    tails = ["", "/", "/en/", "/en/x?y#z", "/es/", "/fr/1", "?q=/en/", "#/en/", "/EN/", "/en"]
    urls = [f"{s}://{h}{t}" for s in ("http", "") for h in hosts for t in tails] + [None, "", "example.com/en/", "://", "http://x.com://en/"]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(rows, queries.URL_RULES).collect()}
    assert found == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(rows.where("false"), queries.URL_RULES).count() == 0


def test_colliding_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: len(x))
    digests, strings = url_filter.digest_file([("block", "aa", "/"), ("allow", "bb", "/")])
    (tmp_path / "d").write_bytes(digests)
    (tmp_path / "s").write_bytes(strings)
    array = url_filter.DigestArray(str(tmp_path / "d"), str(tmp_path / "s"))
    at = array.find(["bb/", "aa/", "cc/", "long one"])
    assert [array.rules[int(k)].as_py() if k >= 0 else None for k in at] == ["bb/", "aa/", None, None]


def test_mixing(spark):
    rows = [(i, "x" * 9, "big" if i % 10 else "small") for i in range(20_000)] + [(20_000, None, None)]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, copy int, cdf string")
    found = mixing.mix(docs, alpha=0.0, total=1.0)
    n = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    whole = sum(len(t or "") + 1 for _, t, _ in rows)
    for source in ("big", "small"):
        assert abs(n[source] * 10 - whole / 3) < 5 * math.sqrt(whole / 3 * 10)
    assert abs(n[None] - whole / 3) < 5 * math.sqrt(whole / 3)
    assert found.where("copy > copies or copy < 1").count() == 0 and found.columns == ["doc_id", "text", "source", "copy", "copies", "shuffle_key"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), alpha=0.0).collect()), key=str)
    small = [r["copies"] for r in found.where("source = 'small' and copy = 1").collect()]
    rate = whole / 3 / 10 / 2000
    counts = Counter(small)
    for k in (1, 2, 3):
        want = 2000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(counts[k] - want) < 6 * math.sqrt(want) + 3
    weights = spark.createDataFrame([("big", 1.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix(docs, weights).select("source").distinct().collect()} == {"big"}
    assert mixing.mix(docs.where("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9 \n\t'éñ中.,!?-<|² 　😀sdm", max_size=40), max_size=8))
def test_ids_equal_the_tokenizer(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    flat, bounds = packing.token_ids(texts, PATH)
    want = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    for text, ids in zip(texts, want, strict=True):
        assert sum((packing.token_ids([x], PATH)[0].tolist() for x in long_parts(text, 5)), []) == ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 50)), max_size=20))
def test_patterns_take_every_piece_once(pairs):
    counts = np.zeros(65, np.int64)
    for n, k in pairs:
        counts[n] += k
    plan = packing.plan_patterns(counts)
    used = np.zeros(65, np.int64)
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for n in pattern:
            used[n] += times
    assert (used == counts).all()
    sequences = sum(k for _, k in plan)
    assert sequences <= 2 * max(1, -(-int((counts * np.arange(65)).sum()) // 64))


def test_packing(spark):
    from tokenizers import Tokenizer

    random.seed(3)
    texts = [" ".join(random.choices(["alpha", "beta", "it's", "größe"], k=random.choice([1, 30, 700, 4000]))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, texts[0], 5), (None, "a", 5)], "doc_id long, text string, offset int").repartition(5)
    found = packing.pack(docs, PATH).toPandas()
    model = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts[1:], 1):
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = found[found.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    placed = found.sort_values(["sequence_id", "offset"])
    before = (placed.offset + placed.length).groupby(placed.sequence_id).shift(fill_value=0)
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 2048 + 1 and (found.doc_id == 0).sum() >= 2
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_cuts():
    import pyarrow as pa

    texts = pa.array(["aa", None, "b" * 10, "", "c"])
    assert list(cuts(texts, 5, 10)) == [(0, 2), (2, 3), (3, 5)] and list(cuts(texts, 100, 2)) == [(0, 2), (2, 4), (4, 5)]
    assert list(cuts(texts.slice(0, 0), 5, 10)) == []


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "123", "en", "src0", 3)], docs.schema)
    docs = docs.union(odd)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = pipeline.STAGES[0][1](spark, docs, sf)
    assert ids - {r["doc_id"] for r in kept.select("doc_id").collect()} == {9001, 9002, 9003}
    near = pipeline.STAGES[2][1](spark, kept, sf)
    assert near.columns == docs.columns and near.count() < kept.count()
    result = pipeline.run(spark, sf).toPandas()
    assert list(result.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and len(result)
    assert result.groupby("sequence_id").length.sum().max() <= 2048
    empty = docs.where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><h1>Hi</h1><p>Hello world.</p></body>", "Hi\nHello world."),
        ("<nav><a href=/>Home</a></nav><div><h1>Storm hits coast</h1><p>Rain fell today.</p><p>Nobody was hurt.</p></div>", "Storm hits coast\nRain fell today.\nNobody was hurt."),
        ("<div><p>Five people were hurt yesterday.</p></div>", "Five people were hurt yesterday."),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><footer>© 2020</footer>", ""),
    ],
)
def test_pages_of_short_blocks_keep_their_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "promo",
    [
        "<p>Subscribe to our newsletter for more of the news that you like.</p>", "<p>Share this on Facebook</p>", "<div>Buy now the best shoes in town today only here</div>",
        f"<p style='color:red; display: none'>{NOTE}</p>", f"<div hidden><p>{NOTE}</p></div>", f'<div aria-hidden="true">{NOTE}</div>', f"<p><a href=1>{NOTE}</a></p>",
        "<p>Lamps chairs tables <a href=1>garden tools</a> windows doors roofs trees stones rivers clouds bricks tiles paint shop</p>",
    ],
)
def test_promos_and_hidden_blocks_in_an_article(promo):
    for name in ("article", "main"):
        assert html_text.main_text(f"<{name}><p>{STORY}</p>{promo}<p>{STORY}</p></{name}>") == f"{STORY}\n{STORY}"


def test_text_like_a_promo_stays():
    for text in ("Share prices of the firm fell for a third day in a row.", "Subscribers to the paper read that the day was long.", "The hidden door of the house was open.", "Nes nes nes nes nes nes nes nes nes nes nes nes nes nes nes"):
        assert html_text.main_text(f"<article><p>{STORY}</p><p>{text}</p></article>") == f"{STORY}\n{text}"


def test_built_pages_without_article_elements():
    """Pages of plain div elements with unmarked promos, menus and footers: nearly all of the story and little else; density rejects blocks."""
    rng = random.Random(8)
    stop = "the of and to in is that it was for".split()
    plain = ["".join(rng.choices("bcdfglmnprst", k=1)) + "".join(rng.choices("aeioulnrst", k=rng.randrange(2, 7))) for _ in range(400)]
    sentence = lambda n, share: " ".join(rng.choice(stop) if rng.random() < share else rng.choice(plain) for _ in range(n)).capitalize() + "."
    kept = wanted = right = rejected = 0
    for _ in range(150):
        story = [sentence(rng.randrange(3, 40), 0.3) for _ in range(rng.randrange(3, 9))]
        menu = "".join(f"<div><a href={i}>{rng.choice(plain)}</a></div>" for i in range(6))
        promo = f"<p>{sentence(rng.randrange(16, 30), 0.0)}</p><p>Buy now {' '.join(rng.choices(plain, k=6))}</p>"
        page = f"<body><div>{menu}</div><div>{''.join(f'<p>{x}</p>' for x in story)}</div><div>{promo}</div><div>© 2020 {rng.choice(plain)}</div>"
        found, marked = html_text.read_blocks(page)
        rejected += sum(html_text.classify(x, True) is False and not x.linked and "©" not in x.text and not html_text.CALLS.match(x.text) for x in found)
        got, want = Counter(html_text.main_text(page).split("\n")), Counter(story)
        kept, wanted, right = kept + sum(len(x.split()) * n for x, n in got.items()), wanted + sum(len(x.split()) * n for x, n in want.items()), right + sum(len(x.split()) * n for x, n in (got & want).items())
    assert right > 0.97 * kept and right > 0.97 * wanted and rejected > 100
    print(f"precision {right / kept:.4f} recall {right / wanted:.4f} rejected {rejected}")


def test_url_of_many_labels_needs_little_memory():
    import tracemalloc

    host, path = "a." * 50_000 + "x.example.com", "/en/" + "b" * 1_000_000
    tracemalloc.start()
    found = list(url_filter.candidates(host, path, [1, 4], 3, 15))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == {h + p for h in ("com", "example.com", "x.example.com") for p in ("/", "/en/")} and peak < 1_000_000


@given(st.lists(st.sampled_from(["a", "bb", "com", "example", ""]), min_size=1, max_size=6).map(".".join), st.sampled_from(["", "/", "/en/", "/es/x"]))
def test_candidates_are_all_that_rules_can_name(host, path):
    hosts = ["com", "example.com", "a.example.com", "bb"]
    every = {".".join(host.split(".")[i:]) for i in range(host.count(".") + 1)}
    want = {h + path[:n] for h in hosts if h in every for n in (1, 4) if n <= len(path)}
    assert want <= set(url_filter.candidates(host, path, [1, 4], 3, 13)) <= {h + path[:n] for h in every for n in (1, 4) if n <= len(path)}


def test_long_urls_are_judged(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/")]
    urls = ["http://" + "a." * 50_000 + "example.com/en/" + "x" * 200_000, "http://" + "a." * 50_000 + "org/en/"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"], len(r["host"])) for r in rows] == [("example.com/en/", "block", 100_011), (None, "allow", 100_003)]


CLASHING = ["parts", "cdf", "rate_source", "copy", "copies", "shuffle_key", "keep_id", "kept", "set_key", "component_id", "held_out", "_sha", "_row", "_doc", "sequence_id", "bands", "node", "key", "bucket", "n"]


def test_stages_keep_clashing_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in CLASHING})
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING)
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_pipeline_equals_brute_force(spark):
    """Every stage on what its predecessor kept, each done again in plain Python; only the learned model itself is taken as it is."""
    from pulseframe.llm import language_id

    pipeline = pytest.importorskip("corpus_pipeline")
    import tokenizers

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rejected = {r["doc_id"] for r in language_id.identify(docs, language_id.learn(docs)).collect() if r["rejected"]}
    rows = [r for r in docs.collect() if r["doc_id"] not in rejected]
    body = lambda r: "".join(c for c in r["text"] if c not in " \t\n\x0b\x0c\r")
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"]), r["doc_id"])):
        best.setdefault(body(r), r)
    rows = sorted(best.values(), key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} if words else set())
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                own[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    units = Counter()
    for r in rows:
        units[r["source"]] += len(r["text"]) + 1
    weight = {s: u**0.5 for s, u in units.items()}
    want = []
    model = tokenizers.Tokenizer.from_file(PATH)
    import hashlib

    for r in rows:
        rate = weight[r["source"]] / sum(weight.values()) * (sum(units.values()) / units[r["source"]])
        assert rate <= 64
        u = int(hashlib.md5(f"7|{r['doc_id']}|1".encode()).hexdigest()[:13], 16) / (1 << 52)
        term = below = math.exp(-rate)
        copies = 0
        while below < u:
            copies += 1
            term *= rate / copies
            below += term
        ids = [*model.encode(r["text"], add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts_at = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts_at[:-1], cuts_at[1:], strict=True)):
            want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] * copies
    found = pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and all(a == sum(n for _, n in sorted(x)[:i]) for i, (a, _) in enumerate(sorted(x))) for x in places.values())
    assert len(places) <= 1.1 * sum(r["length"] for r in found) / 2048 + 1
