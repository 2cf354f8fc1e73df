"""The registered queries of this package, opN_<name>, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, langid, minhash, mixing, pieces, pii, simhash, substring, tokens, urls
from .common import read, stage


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.learn(docs, ~F.coalesce(held, F.lit(False)))
    out = langid.predict(docs, model, extra={"held_out": F.coalesce(held, F.lit(False))})
    return out.withColumnRenamed("id", "doc_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stage(simhash.edits(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id"), "fingerprints")
    return simhash.with_hits(out, F.col("doc_id") % 20 == 0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.judge(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.judge(read(spark, sf_dir, "documents"), evenness=0.5, max_repeats=4.0)
    return out.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), F.col("goal").alias("source_budget"), "repeats")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85).withColumnRenamed("id", "doc_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), check=True)
    digest = F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_pieces", digest.alias("pieces_sha256"), "round_trip")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_language_id": op1,
    "op2_substring_dedup": op2,
    "op3_fingerprints": op3,
    "op4_exact_dedup": op4,
    "op5_token_counts": op5,
    "op6_source_mixing": op6,
    "op7_url_filter": op7,
    "op8_minhash_near_dedup": op8,
    "op9_sentencepiece": op9,
    "op10_pii": op10,
}

ORACLE = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
key AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS k FROM pos),
bad AS (SELECT doc_id, i, word, CASE WHEN k IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS b FROM key),
hit AS (SELECT doc_id, i, word, max(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM bad),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
                sha256(coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '')) AS kept_sha256
         FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op4_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS kept,
       sha256(norm) AS text_sha256
FROM d
""",
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT a, b FROM pair UNION SELECT r.x, p.b FROM reach r JOIN pair p ON r.y = p.a),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN low ON x = doc_id
""",
    "op6_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n,
         md5('mix|' || coalesce('=' || doc_id, '') || '|' || coalesce('=' || source, '') || '|' || md5(coalesce('=' || text, ''))) AS place
  FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY source),
k AS (SELECT list(t::DOUBLE) AS ts, sum(t)::DOUBLE AS total, min(t)::DOUBLE AS least, count(*) AS m FROM t WHERE t > 0),
p AS (SELECT list_transform(ts, lambda x: ln(x / total)) AS l, total, least, m,
             -list_sum(list_transform(ts, lambda x: x / total * ln(x / total))) AS nat0 FROM k),
goal AS (SELECT l, total, least, m, nat0 + 0.5::DOUBLE * (ln(m::DOUBLE) - nat0) AS target FROM p),
step(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END
  FROM (
    SELECT i, lo, hi, mid, ln(z) - mid * s / z >= target OR exp((mid - 1) * ln(least / total)) / z > 4 AS up
    FROM (
      SELECT i, lo, hi, mid, target, least, total,
             list_sum(list_transform(l, lambda x: exp(mid * x))) AS z, list_sum(list_transform(l, lambda x: exp(mid * x) * x)) AS s
      FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, goal.* FROM step, goal WHERE i < 30)))),
found AS (
  SELECT CASE WHEN m <= 1 THEN 1 WHEN ln(z) - lo * s / z >= target AND NOT exp((lo - 1) * ln(least / total)) / z > 4 THEN lo ELSE hi END AS alpha
  FROM (SELECT lo, hi, m, target, least, total, list_sum(list_transform(l, lambda x: exp(lo * x))) AS z,
               list_sum(list_transform(l, lambda x: exp(lo * x) * x)) AS s FROM step, goal WHERE i = 30)),
b AS (
  SELECT source, t, CASE WHEN t > 0 THEN round(exp(alpha * ln(t / total)) / list_sum(list_transform(l, lambda x: exp(alpha * x))) * total)::BIGINT ELSE 1 END AS budget
  FROM t, found, goal),
c AS (SELECT source, budget, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS passes, CASE WHEN t > 0 THEN budget % t ELSE -1 END AS rest FROM b),
run AS (
  SELECT doc_id, d.source, n, budget, passes, rest,
         sum(n) OVER (PARTITION BY d.source ORDER BY md5(passes || ':' || place[1:2]), md5(passes || ':' || place[1:4]), md5(passes || ':' || place)) AS upto
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, n AS n_tokens, budget AS source_budget, passes + (rest >= 0 AND upto <= rest)::BIGINT AS repeats
FROM run
""",
    "op7_url_filter": r"""
WITH RECURSIVE raw AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
tag AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM raw WHERE url LIKE '%://%' AND regexp_matches(html, '(?i)canonical|refresh')),
attr AS (
  SELECT url, t,
    regexp_replace(regexp_extract(t, '(?is)[\s"''/]rel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS rel,
    regexp_replace(regexp_extract(t, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS href,
    regexp_replace(regexp_extract(t, '(?is)[\s"''/]http-equiv\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS kind,
    regexp_replace(regexp_extract(t, '(?is)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g') AS content
  FROM tag),
found AS (
  SELECT url, trim(replace(CASE WHEN regexp_matches(t, '(?i)^<link') AND regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)') THEN href
    WHEN regexp_matches(t, '(?i)^<meta') AND regexp_matches(kind, '(?i)^\s*refresh\s*$') THEN regexp_extract(content, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&'), ' ') AS goal,
    regexp_extract(url, '(?s)^.*?://[^/?#]*(?:/[^?#]*/|/)?') AS folder
  FROM attr),
whole AS (
  SELECT url, CASE WHEN regexp_matches(goal, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN goal
    WHEN goal LIKE '//%' THEN regexp_extract(url, '(?s)^.*?:') || goal
    WHEN goal LIKE '/%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || goal
    WHEN goal LIKE '?%' THEN regexp_extract(url, '(?s)^[^?#]*') || goal
    ELSE folder || CASE WHEN folder LIKE '%/' THEN '' ELSE '/' END || goal END AS target
  FROM found WHERE goal <> '' AND goal NOT LIKE '#%'),
bare AS (SELECT split_part(url, '#', 1) AS a, split_part(target, '#', 1) AS b FROM whole),
head AS (SELECT a, b, regexp_extract(a, '(?s)^.*?://[^/?]*') AS ha, regexp_extract(b, '(?s)^.*?://[^/?]*') AS hb FROM bare),
link AS (
  SELECT translate(ha, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || a[length(ha) + 1:] AS a,
         translate(hb, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || b[length(hb) + 1:] AS b FROM head),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, other) AS (SELECT a, b FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
every AS (
  SELECT page_id, host, path, CASE WHEN url LIKE '%://%' THEN translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || u[length(h) + 1:] END AS node
  FROM (SELECT *, split_part(url, '#', 1) AS u, regexp_extract(split_part(url, '#', 1), '(?s)^.*?://[^/?]*') AS h FROM raw)
  UNION ALL
  SELECT NULL, regexp_extract(other, '(?s)^.*?://([^/?#]*)', 1), regexp_extract(other, '(?s)^.*?://[^/?#]*([^?#]*)', 1), other FROM (SELECT DISTINCT other FROM reach)),
hit AS (
  SELECT page_id, node, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM every),
own AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS v FROM hit),
carried AS (
  SELECT r.node FROM reach r JOIN own o ON o.node = r.other
  GROUP BY r.node HAVING bool_or(o.v = 'block') AND NOT coalesce(bool_or(o.v = 'allow'), false))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN c.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       v IS NULL AND c.node IS NOT NULL AS propagated
FROM own LEFT JOIN carried c ON own.node = c.node
WHERE page_id IS NOT NULL
""",
}
