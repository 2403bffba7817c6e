"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, html_text, language_id, lexical_search, minhash, mixing, packing, piece_codec, pivot_index, quality, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at cosine 0.9."""
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), c AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, vec_id) AS component_id, vec_id = coalesce(c.component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of whole ``documents`` towards the texts labelled quality 1.

    As many rows are kept as the labels say are good.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.resample(docs, quality.learn(docs, labels), quality.target_share(labels))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over whole ``documents``."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH k AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM k
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""


#: (verdict, host, path) of the url rules.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the url of every row of ``pages``."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = """
WITH p AS (
  SELECT page_id, strpos(url, '://') AS colon, substr(url, strpos(url, '://') + 3) AS rest FROM pages
), q AS (
  SELECT page_id,
         CASE WHEN colon > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN colon > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM p
), rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fits AS (
  SELECT q.*, rules.rule, rules.verdict,
         row_number() OVER (PARTITION BY q.page_id, q.host, q.path ORDER BY length(rules.rule) DESC NULLS LAST) AS k
  FROM q LEFT JOIN rules ON (q.host = rule_host OR ends_with(q.host, '.' || rule_host)) AND starts_with(q.path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` mixed so that a source's share is proportional to the square root of its size."""
    return mixing.mix(table(spark, sf_dir, "documents"), alpha=0.5, seed=7)


OP7_SQL = """
WITH RECURSIVE s AS (
  SELECT source, sum(coalesce(length(text), 0) + 1) AS units FROM documents GROUP BY source
), r AS (
  SELECT source, 1.0::DOUBLE * (pow(units::DOUBLE, 0.5::DOUBLE) / (SELECT sum(pow(units::DOUBLE, 0.5::DOUBLE)) FROM s))
                 * ((SELECT sum(units)::DOUBLE FROM s) / units::DOUBLE) AS rate
  FROM s
), m AS (
  SELECT source, greatest(ceil(rate / 64.0::DOUBLE), 1)::INT AS parts, rate / greatest(ceil(rate / 64.0::DOUBLE), 1)::INT AS mean FROM r
), cdf(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM m
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 24)
), tables AS (
  SELECT source, list(c ORDER BY k) AS c FROM cdf GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.c, j.j,
         ('0x' || substr(md5('7|' || coalesce(d.doc_id::VARCHAR, '') || '|' || j.j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
  CROSS JOIN LATERAL (SELECT unnest(range(1, m.parts + 1)) AS j) j
), counted AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(c, lambda x: x < u)))::INT AS copies
  FROM drawn GROUP BY doc_id, text, lang, source, n_chars
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, copies,
       md5('order|7|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from its rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at 3-word shingles and Jaccard similarity 0.85 over whole ``documents``."""
    return minhash.near_components(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged ``conversations``: faults, cheapest audit and digest of the repaired rows of every one."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         (coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key
  FROM conversations
), h AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 20 AS d
  FROM c
), r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h
), n AS (
  SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
         lag(left(role, 1)) OVER w AS before, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, left(role, 1) AS i, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM n
), s AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), pass(a, b, i) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), put(a, b, cost, edits) AS (
  SELECT x, x, 0, '' FROM range(4) t(x) UNION ALL SELECT a, b, 5, 'I' FROM pass WHERE i <> 's'
  UNION ALL SELECT p.a, q.b, 10, 'II' FROM pass p JOIN pass q ON p.b = q.a WHERE p.i <> 's' AND q.i <> 's'
), way AS (
  SELECT conv_id, 0 AS k, 0 AS state, 0 AS cost, '' AS audit, '' AS lines FROM s
  UNION ALL
  SELECT conv_id, k, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
      SELECT w.conv_id, f.k, e.b AS state, w.cost + p.cost + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
             w.audit || p.edits || e.edit AS audit,
             w.lines || CASE WHEN p.edits = '' THEN '' ELSE array_to_string(list_transform(range(length(p.edits)), lambda x: CASE WHEN (p.a = 2) = (x % 2 = 0) THEN 'assistant:' ELSE 'user:' END || chr(10)), '') END
                     || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10) ELSE CASE WHEN p.b = 2 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) END AS lines
      FROM way w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1
      JOIN put p ON p.a = w.state
      JOIN (SELECT a, b, i, 0 AS cost, 'K' AS edit FROM pass UNION ALL SELECT a, b, NULL, 1, 'R' FROM pass WHERE i <> 's' UNION ALL SELECT x, x, NULL, 2, 'D' FROM range(4) t(x)) e
        ON e.a = p.b AND (e.edit = 'D' OR f.fault IS NULL OR f.fault = 'truncated') AND (e.edit <> 'K' OR e.i = f.i)
    )
  ) WHERE place = 1
), done AS (
  SELECT w.conv_id, w.cost + p.cost AS cost, w.audit || p.edits AS audit,
         w.lines || CASE p.edits WHEN '' THEN '' WHEN 'I' THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS lines,
         row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + p.cost, w.audit || p.edits) AS place
  FROM way w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.rows = w.k JOIN put p ON p.a = w.state AND p.b IN (0, 3)
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(rtrim_one) AS repaired_sha256
FROM ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN (SELECT * FROM done WHERE place = 1) d ON d.conv_id IS NOT DISTINCT FROM ids.conv_id
CROSS JOIN LATERAL (SELECT CASE WHEN coalesce(lines, '') = '' THEN '' ELSE left(lines, length(lines) - 1) END AS rtrim_one)
"""


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text of ``documents`` and what they decode to."""
    coded = piece_codec.encode(table(spark, sf_dir, "documents"), piece_path())
    ids, text = F.array_join("ids", ","), F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP13_SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'q', item_id, row_number() OVER (), text FROM benchmark
), words AS (
  SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM t
), size AS (
  SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM words WHERE side = 'd'
), q AS (
  SELECT DISTINCT r AS item, id AS item_id, unnest(w) AS term FROM words WHERE side = 'q'
), p AS (
  SELECT r, id AS doc_id, n, term, count(*) AS tf FROM (SELECT r, id, len(w) AS n, unnest(w) AS term FROM words WHERE side = 'd') WHERE term IN (SELECT term FROM q) GROUP BY ALL
), v AS (
  SELECT term, floor(1000 * ln((2 * size.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS v FROM p, size GROUP BY term, size.n
), scored AS (
  SELECT item, item_id, r, doc_id, sum(v * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * size.n) // size.l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN v USING (term), size GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_embedding_near_dedup, op3_html_extraction, op4_quality_resampling, op5_exact_dedup, op6_url_filters, op7_source_mixing, op8_language_id, op9_best_fit_packing, op10_minhash_near_dedup, op11_conversation_repair, op12_piece_codec, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op6_url_filters": OP6_SQL, "op7_source_mixing": OP7_SQL, "op11_conversation_repair": OP11_SQL, "op13_lexical_search": OP13_SQL}
