"""The registered queries of the operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import centroids, exact_dups, langid, mixing, near_dups, packing, pii, quality, sharding, source_terms, suffix_tree, toxicity, url_lists
from .common import table

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    RUN[f.__name__] = f
    return f


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_groups(table(spark, sf_dir, "documents"))


@query
def op2_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("key", "text_hash")


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("found")


@query
def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), short_first=True)


@query
def op7_subword_bag_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dups.exact_groups(table(spark, sf_dir, "documents"))


SQL["op8_block_naming"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


@query
def op9_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures of one year, at a minute that follows from the id."""
    minute = F.coalesce(F.pmod(F.col("page_id") * 7919, F.lit(360 * 1440)), F.lit(0))
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_micros((minute * 60 + 1704067200) * 1000000).alias("fetched_at"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Six dated entries on three lists for every second host, domain and path of the pages, from the digits of a hash."""
    keys = pages.select(F.explode(url_lists.url_keys(F.col("url"))).alias("key")).distinct()
    keys = keys.filter((F.conv(F.substring(F.md5("key"), 1, 1), 16, 10).cast("int") < 8) | F.col("key").rlike("spam|pills"))
    rows = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("h", F.md5(F.concat_ws(":", "key", F.col("k").cast("string"))))
    digits = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    return rows.select(F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (digits(1, 4) % 3 + 1).cast("int")).alias("list"), "key",
                       F.when(digits(5, 4) % 4 == 0, "allow").otherwise("block").alias("verdict"), F.when(F.col("k") % 3 == 2, "remove").otherwise("add").alias("action"),
                       F.timestamp_micros((digits(9, 6) % 360 * 86400 + 1704067200) * 1000000).alias("effective_at"))


@query
def op10_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_lists.decide(dated_captures(pages), dated_lists(pages))
    seconds = lambda c: F.unix_seconds(c).alias(c)
    return found.select(F.col("capture_id").alias("page_id"), seconds("fetched_at"), "n_active", "verdict", "key", "list", seconds("valid_from"))


SQL["op10_temporal_list_join"] = r"""
WITH u AS (
  SELECT page_id, coalesce((page_id * 7919) % 518400, 0) * 60 + 1704067200 AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS part
  FROM pages),
asked AS (
  SELECT page_id, fetched_at, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
  FROM u, generate_series(1, 130) s(i) WHERE host <> '' AND i <= greatest(len(string_split(host, '.')) - 1, 1)
  UNION ALL SELECT page_id, fetched_at, host || '/' || part FROM u WHERE host <> '' AND part <> ''),
listed AS (SELECT DISTINCT key FROM asked WHERE substr(md5(key), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') OR key LIKE '%spam%' OR key LIKE '%pills%'),
drawn AS (SELECT key, k, md5(key || ':' || k) AS h FROM listed, generate_series(0, 5) s(k)),
entries AS (
  SELECT ['adult', 'malware', 'spam'][(('0x' || substr(h, 1, 4))::BIGINT % 3) + 1] AS list, key,
         CASE WHEN ('0x' || substr(h, 5, 4))::BIGINT % 4 = 0 THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN k % 3 = 2 THEN 'remove' ELSE 'add' END AS action,
         ('0x' || substr(h, 9, 6))::BIGINT % 360 * 86400 + 1704067200 AS effective_at
  FROM drawn),
one AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY list, key, effective_at ORDER BY action DESC, verdict DESC) = 1),
held AS (SELECT *, lead(effective_at) OVER (PARTITION BY list, key ORDER BY effective_at) AS valid_to FROM one),
met AS (
  SELECT a.page_id, h.verdict, h.key, h.list, h.effective_at AS valid_from, count(*) OVER (PARTITION BY a.page_id) AS n_active,
         row_number() OVER (PARTITION BY a.page_id ORDER BY length(h.key) DESC, (h.verdict = 'block') DESC, h.effective_at DESC, h.list DESC, h.key DESC) AS place
  FROM asked a JOIN held h ON a.key = h.key AND h.action = 'add' AND a.fetched_at >= h.effective_at AND (h.valid_to IS NULL OR a.fetched_at < h.valid_to))
SELECT u.page_id, u.fetched_at, coalesce(m.n_active, 0) AS n_active, m.verdict, m.key, m.list, m.valid_from
FROM u LEFT JOIN met m ON u.page_id = m.page_id AND m.place = 1
"""


@query
def op11_length_bucketed_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_terms.divergence(table(spark, sf_dir, "documents"))


SQL["op11_length_bucketed_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op12_orchard_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int, clusters: int) -> str:
    """SQL of the rounds, one after the other; a centroid is held as its list of components."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT v.id, v.vec_id, v.x, c.cluster, c.d FROM (
    SELECT v.id, k.cluster, list_sum([(v.x[i] - k.x[i]) * (v.x[i] - k.x[i]) FOR i IN range(1, 65)])::BIGINT AS d,
           row_number() OVER (PARTITION BY v.id ORDER BY d, k.cluster) AS place FROM v, k{r} k) c JOIN v USING (id) WHERE c.place = 1)""")
        if r < rounds:
            steps.append(f"""k{r + 1} AS MATERIALIZED (
  SELECT k.cluster, coalesce(m.x, k.x) AS x FROM k{r} k LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS x FROM (
      SELECT cluster, i, sum(part) // count(*) - CASE WHEN sum(part) < 0 AND sum(part) % count(*) <> 0 THEN 1 ELSE 0 END AS x
      FROM (SELECT cluster, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))""")
    return ",\n".join(steps)


SQL["op12_orchard_centroids"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [floor(e::DOUBLE * 1024)::BIGINT FOR e IN embedding] AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64),
k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS cluster, x FROM v QUALIFY cluster < 8),
{_rounds(10, 8)}
SELECT vec_id, a.cluster::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a10 a JOIN k10 k USING (cluster)
"""


@query
def op13_probabilistic_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
