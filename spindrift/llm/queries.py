"""The ``opN_*`` queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontaminate, exact_dedup, filter_audit, html_extract, mixing, near_dedup, repeats, secrets, toxicity, url_filter, warc, whitening
from spindrift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary of the byte-level BPE queries, part of the environment."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "edges")


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).drop("edges")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op11_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
  SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
         CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM k
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bn AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)
), sizes AS (
  SELECT DISTINCT n FROM windows
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), found AS (
  SELECT doc_id, spots.n, i, item_id FROM spots JOIN windows USING (n, s)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op8_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    hit = lambda of: " + ".join(f"{w} * regexp_matches(t, '(^|[^a-z0-9]){x}([^a-z0-9]|$)')::INT" for x, w in of)
    strict = [(x, 1) for x, w in url_filter.VOCABULARY.items() if w >= url_filter.REJECT]
    soft = [(x, 1) for x, w in url_filter.VOCABULARY.items() if w < url_filter.REJECT]
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {az}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), n AS (
  SELECT *, {hit(strict)} AS n_strict, {hit(soft)} AS n_soft, {hit(url_filter.VOCABULARY.items())} AS weight
  FROM (SELECT *, translate(host || path, {az}) AS t FROM p)
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN weight >= {url_filter.REJECT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, weight
FROM n
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id, 9223372036854775807)::VARCHAR), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight, 2 * source_size AS cap FROM s
), b AS (
  SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weights FROM w
), l AS (
  SELECT w.*, budget, weights, cap / weight AS level, sum(cap) OVER o AS caps, sum(weight) OVER o AS upto_weight FROM w, b
  WINDOW o AS (ORDER BY cap / weight, rank)
), f AS (
  SELECT coalesce(max(level), -1) AS used_up, coalesce(sum(cap), 0) AS given, coalesce(sum(weight), 0) AS gone FROM l
  WHERE caps + level * (weights - upto_weight) <= budget
), t AS (
  SELECT source, rank, weight, source_size, budget,
         CASE WHEN level <= used_up THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * (budget - given) / (weights - gone)) END AS target
  FROM l, f
), c AS (
  SELECT d.*, t.rank, t.weight, t.source_size, t.target, t.budget, row_number() OVER () AS uid,
         sum(size) OVER (PARTITION BY t.rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT uid, rank, weight, budget, least(64, size - start) AS words, pass * source_size + before + start + least(64, size - start) AS served
  FROM (SELECT *, unnest(range(0, size, 64)) AS start FROM (SELECT *, unnest([0, 1]) AS pass FROM c))
), q AS (
  SELECT uid, words, floor(budget) - (sum(words) OVER (ORDER BY served / weight, rank, served ROWS UNBOUNDED PRECEDING) - words) AS room FROM p
), k AS (
  SELECT uid, sum(least(words, room))::BIGINT AS taken FROM q WHERE room > 0 GROUP BY uid
)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (uid)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), m AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
          'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM w LEFT JOIN m USING (doc_id)
), failed AS (
  SELECT part, good, toxic,
         CASE WHEN fails.A THEN 'A' ELSE '' END || CASE WHEN fails.B THEN 'B' ELSE '' END || CASE WHEN fails.C THEN 'C' ELSE '' END ||
         CASE WHEN fails.D THEN 'D' ELSE '' END || CASE WHEN fails.E THEN 'E' ELSE '' END AS letters
  FROM f
), patterns AS (
  SELECT part, letters, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, letters
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1 : step - 1] AS before FROM orders, range(1, 6) r(step)
), run AS (
  SELECT part, filter_order, step, f, n, p.good, p.toxic, letters, contains(letters, f) AS fails,
         len(before) > 0 AND regexp_matches(letters, '[' || before || '.]') AS gone
  FROM steps, patterns p
), counted AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (letters = f), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM run GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_weighted_mix": OP11_SQL, "op12_filter_audit": OP12_SQL} | {"op1_warc": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op8_url_filter": _op8_sql()}
