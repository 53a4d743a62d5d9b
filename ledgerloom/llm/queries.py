"""Queries of the numbered operators over their whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontam, dialogue, langid, lm, neardup, quality, repeats, secrets, topk, toxicity, urlrules
from .arrays import tuned


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[list[bytes], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rules_frame(spark, urlrules.RULES))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *tokenizer())


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op9_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # its steps shuffle all bigrams; what a later step needs is written down, so shuffle files may go with their query
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return lm.report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_secret_scans": op2_secret_scans,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_topk": op4_exact_topk,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_id": op8_language_id,
    "op9_pitman_yor_scores": op9_pitman_yor_scores,
    "op10_decontamination": op10_decontamination,
    "op11_quality": op11_quality,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

def vector_code_sql(rounds: int = codes.ROUNDS) -> str:
    """Plain nearest entries and means, one pair of steps for each round."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
gaps{k} AS MATERIALIZED (
  SELECT n, vec_id, label, p, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts JOIN book{k} USING (p)),
near{k} AS MATERIALIZED (SELECT n, vec_id, label, p, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM gaps{k} GROUP BY ALL),"""
        if k < rounds:
            steps += f"""
mean{k} AS (
  SELECT p, entry, list(m ORDER BY i) AS c
  FROM (SELECT p, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
        FROM (SELECT p, entry, x, unnest(range(1, len(x) + 1)) AS i FROM near{k} JOIN parts USING (n, p)) GROUP BY p, entry, i)
  GROUP BY p, entry),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, entry)),"""
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS n, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT n, vec_id, label, p, v[p * len(v) // {codes.PARTS} + 1:(p + 1) * len(v) // {codes.PARTS}] AS x
  FROM (SELECT *, unnest(range({codes.PARTS})) AS p FROM e)),
book0 AS (SELECT p, n AS entry, x AS c FROM parts WHERE n < {codes.ENTRIES}),{steps}
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{rounds}),
coded AS (
  SELECT n, vec_id, label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY n, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
hits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM numbered p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM numbered p LEFT JOIN hits h ON p.n = h.n AND h.place = 1
""",
    "op4_exact_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
""",
    "op5_minhash_neardup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS s FROM d WHERE len(ws) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN least_of ON d.doc_id = a
""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark),
starts AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(ws[s:s + 9], ' ') AS win, least(len(ws), 10) AS size FROM starts),
places AS (SELECT n, ws, unnest(range(1, len(ws) + 1)) AS s FROM d),
sizes AS (SELECT DISTINCT size FROM wins),
grams AS (
  SELECT n, s, size, array_to_string(ws[s:s + size - 1], ' ') AS win
  FROM places, sizes WHERE s + size - 1 <= len(ws)),
hits AS (SELECT g.n, g.s, g.size, w.item_id FROM grams g JOIN wins w USING (win, size)),
covered AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(s, s + size)) AS p FROM hits) GROUP BY n),
items AS (
  SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT n, item_id FROM hits) GROUP BY n)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (n) LEFT JOIN items i USING (n)
""",
    "op12_vector_codes": vector_code_sql(),
    "op13_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
kinds AS (
  SELECT * EXCLUDE (k),
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) % 20 AS kind
  FROM keyed),
copies AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
         regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM copies),
judged AS MATERIALIZED (
  SELECT conv_id, turn, n, role, text, left(role, 1) AS initial,
         CASE WHEN final = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM judged GROUP BY conv_id),
-- states: e nothing yet, s system, u user, a assistant; inserted runs and where they lead
runs(before, run, mid, said) AS (
  VALUES ('e', '', 'e', ''), ('e', 'I', 'u', E'user:\n'), ('e', 'II', 'a', E'user:\nassistant:\n'),
         ('s', '', 's', ''), ('s', 'I', 'u', E'user:\n'), ('s', 'II', 'a', E'user:\nassistant:\n'),
         ('u', '', 'u', ''), ('u', 'I', 'a', E'assistant:\n'), ('u', 'II', 'u', E'assistant:\nuser:\n'),
         ('a', '', 'a', ''), ('a', 'I', 'u', E'user:\n'), ('a', 'II', 'a', E'user:\nassistant:\n')),
steps(mid, initial, after) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
edits AS (
  SELECT mid, NULL AS initial, mid AS after, 'D' AS edit, 4 AS price FROM (SELECT DISTINCT mid FROM runs)
  UNION ALL SELECT mid, initial, after, 'K', 0 FROM steps
  UNION ALL SELECT DISTINCT mid, NULL, after, 'R', 3 FROM steps WHERE initial <> 's'),
paths AS (
  SELECT conv_id, 0::BIGINT AS n, 'e' AS state, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, j.n, e.after,
         min({'cost': p.best.cost + 3 * len(r.run) + e.price + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END,
              'audit': p.best.audit || r.run || e.edit,
              'said': p.best.said || r.said || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10)
                      ELSE CASE e.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || j.text || chr(10) END})
  FROM paths p
  JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND j.n = p.n + 1
  JOIN runs r ON r.before = p.state
  JOIN edits e ON e.mid = r.mid AND (e.initial IS NULL OR e.initial = j.initial) AND (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, j.n, e.after),
ends AS (
  SELECT c.conv_id, min({'cost': p.best.cost + 3 * len(r.run), 'audit': p.best.audit || r.run, 'said': p.best.said || r.said}) AS best
  FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.n = c.size
  JOIN runs r ON r.before = p.state AND r.mid IN ('e', 'a')
  GROUP BY c.conv_id),
everybody AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.said, len(best.said) - 1), '')) AS repaired_sha256
FROM everybody a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
""",
}
