"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velofield.llm import counts, decontamination, lines, near, packing, quality, suffixes, toxicity, urls, vectors


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return counts.count_edited(docs.select("doc_id", "text", counts.sample_edits(F.col("text")).alias("edits")), tokenizer_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontamination.digest_of_items("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_suffixes, op3_lines, op4_minhash, op5_decontamination, op6_counts, op7_embeddings, op8_toxicity, op9_urls, op10_quality)}


OP5_SQL = r"""
WITH di AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bi AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, k, k + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM bi WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT row_no, size, k, list_slice(w, k, k + size - 1) AS win
  FROM (SELECT row_no, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM di, sizes WHERE len(w) >= size)),
found AS (SELECT row_no, k, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hits AS (SELECT row_no, count(DISTINCT p) AS n FROM (SELECT row_no, unnest(range(k, k + size)) AS p FROM found) GROUP BY row_no),
items AS (SELECT row_no, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
          FROM (SELECT DISTINCT row_no, item_id FROM found) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated
FROM di LEFT JOIN hits USING (row_no) LEFT JOIN items USING (row_no)
"""


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id,
       vec_id <= coalesce(low.m, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN cnt ON cnt.a = vec_id
"""

OP9_SQL = r"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
split AS (
  SELECT page_id, html, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
place AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_replace(rest, '^[^/?#]*', '') AS after FROM split),
page AS (
  SELECT page_id, html, host, regexp_replace(after, '[?#].*$', '', 's') AS path, regexp_replace(after, '#.*$', '', 's') AS tail FROM place),
tag AS (
  SELECT host, path, tail, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS t FROM page WHERE host <> ''),
attr AS (  -- names and values of each tag's attributes
  SELECT host, path, tail, lower(left(t, 5)) AS kind,
         list_transform(regexp_extract_all(substr(t, 6), '(?is)\s([a-z-]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: lower(x)) AS names,
         list_transform(regexp_extract_all(substr(t, 6), '(?is)\s([a-z-]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 2),
                        lambda x: CASE WHEN left(x, 1) IN ('"', chr(39)) THEN x[2:-2] ELSE x END) AS vals
  FROM tag),
given AS (
  SELECT host, path, tail, kind, vals[list_position(names, 'rel')] AS rel, vals[list_position(names, 'http-equiv')] AS equiv,
         vals[list_position(names, 'href')] AS href, vals[list_position(names, 'content')] AS content FROM attr),
chosen AS (
  SELECT host, path, tail, kind, CASE WHEN kind = '<link' AND list_contains(regexp_split_to_array(lower(trim(rel)), '\s+'), 'canonical') THEN href
                                WHEN kind = '<meta' AND lower(trim(equiv)) = 'refresh' THEN content END AS raw FROM given),
plain AS (
  SELECT host, path, tail, kind, trim(translate(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
           '&#0*34;', '"', 'g'), '&#0*39;', chr(39), 'g'), '&#0*47;|&#[xX]0*2[fF];', '/', 'g'), '&#0*58;|&#[xX]0*3[aA];', ':', 'g'), '&#0*38;|&#[xX]0*26;', '&amp;', 'g'),
           '&quot;', '"'), '&apos;', chr(39)), '&lt;', '<'), '&gt;', '>'), chr(9) || chr(10) || chr(13), '')) AS v FROM chosen WHERE raw IS NOT NULL),
link AS (
  SELECT host, path, tail, trim(CASE WHEN kind = '<link' THEN l ELSE regexp_extract(l, '(?is)(?:^|[;,\s])url\s*=\s*["'']?([^"'']+)', 1) END) AS l
  FROM (SELECT *, replace(v, '&amp;', '&') AS l FROM plain)),
aim AS (
  SELECT host, tail, l, CASE WHEN l LIKE '/%' THEN regexp_extract(l, '^[^?#]*') ELSE coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || regexp_extract(l, '^[^?#]*') END AS p, path
  FROM link WHERE l <> '' AND l NOT LIKE '#%'),
flat AS (
  SELECT host, tail, l, path, p, list_reduce(list_transform(string_split(p, '/'), lambda x: [x]),
           lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN (CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END) ELSE list_concat(a, x) END) AS kept FROM aim),
dst AS (
  SELECT host || tail AS a,
         CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN substr(l, strpos(l, '://') + 3)
              WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL
              WHEN l LIKE '//%' THEN substr(l, 3)
              WHEN l LIKE '?%' THEN host || path || l
              ELSE host || array_to_string(kept, '/') || CASE WHEN regexp_matches(p, '/\.{1,2}$') THEN '/' ELSE '' END || regexp_extract(l, '(?s)^[^?#]*(.*)', 1) END AS rest
  FROM flat),
e AS (
  SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '#.*$', '', 's') AS b
  FROM dst WHERE rest IS NOT NULL),
g AS (SELECT a, b FROM e WHERE b <> '' UNION SELECT b, a FROM e WHERE b <> ''),
reach AS (SELECT a, b FROM g UNION SELECT reach.a, g.b FROM reach JOIN g ON reach.b = g.a),
nodes AS (SELECT DISTINCT b, regexp_extract(b, '^[^/?#]*') AS host, regexp_replace(regexp_replace(b, '^[^/?#]*', ''), '[?#].*$', '', 's') AS path FROM g),
places AS (SELECT host, path FROM page UNION SELECT host, path FROM nodes),
best AS (SELECT host, path, rh || rp AS rule, rv,
                row_number() OVER (PARTITION BY host, path ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, rv) AS k
         FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
alias AS (SELECT reach.a, max(CAST(rv = 'allow' AS INT)) AS ok, max(CAST(rv = 'block' AS INT)) AS no
          FROM reach JOIN nodes USING (b) LEFT JOIN best ON best.k = 1 AND best.host = nodes.host AND best.path = nodes.path
          GROUP BY reach.a)
SELECT page.page_id, page.host, page.path, best.rule,
       coalesce(best.rv, CASE WHEN alias.ok = 1 THEN 'allow' WHEN alias.no = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN best ON best.k = 1 AND best.host = page.host AND best.path = page.path LEFT JOIN alias ON alias.a = page.host || page.tail
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op7_embeddings": OP7_SQL, "op9_urls": OP9_SQL}
