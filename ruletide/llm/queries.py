"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruletide.llm import dsir, langid, linefreq, mixing, packing, repetition, sharding, simhash, spotsigs, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsir.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of the pages whose id is divisible by 20."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    out = urlfilter.judge_urls(pages, pages.where("page_id % 20 = 0"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "listed")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("slots").withColumnRenamed("id", "doc_id")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = linefreq.drop_boilerplate(docs, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_sharding, op2_quality, op3_urlfilter, op4_mixing, op5_repetition, op6_spotsigs, op7_simhash, op8_packing, op9_linededup, op10_langid)}

_OP3 = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     r AS (SELECT page_id, coalesce(rest, '') AS rest FROM u),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':\d*$', ''), '^(www\.|m\.)+', '') AS bare FROM p),
     d AS (SELECT *, CASE WHEN length(bare) > 0 THEN bare || regexp_replace(path, '(\.html?)?/*$', '') END AS canon FROM c),
     l AS (SELECT DISTINCT canon FROM d WHERE page_id % 20 = 0 AND canon IS NOT NULL),
     j AS (SELECT d.*, l.canon IS NOT NULL AS listed FROM d LEFT JOIN l ON d.canon = l.canon),
     rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     fit AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
             FROM j JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT j.page_id, host, path, rule, coalesce(rv, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM j LEFT JOIN fit ON j.page_id = fit.page_id
"""

#: The schedule slot by slot, as a recursion: earliest deadline first among the released, shares anew where a source runs out.
_OP4 = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
b AS (SELECT greatest(65536, (sum(size) + 262143) // 262144)::BIGINT AS block FROM d),
t AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT source, (total + block - 1) // block AS nb, greatest(1, round(total ** 0.7::DOUBLE / sum(total ** 0.7::DOUBLE) OVER () * 1099511627776))::BIGINT AS n,
             row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t, b),
edf(t, t0, d, done, since, pick, k) AS (
  SELECT -1::BIGINT, 0::BIGINT, (SELECT sum(n)::BIGINT FROM w), (SELECT list(0::BIGINT) FROM w), (SELECT list(0::BIGINT) FROM w), -1::BIGINT, -1::BIGINT
  UNION ALL
  SELECT t + 1, CASE WHEN ends THEN t + 2 ELSE t0 END, CASE WHEN ends THEN d - own ELSE d END, now, CASE WHEN ends THEN now ELSE since END, p, done[p + 1] FROM (
    SELECT *, done[:p] || [done[p + 1] + 1] || done[p + 2:] AS now, done[p + 1] + 1 = own_nb AS ends FROM (
      SELECT r.t, r.t0, r.d, r.done, r.since, min_by(w.i, (due, w.i)) AS p, min_by(w.n, (due, w.i)) AS own, min_by(w.nb, (due, w.i)) AS own_nb
      FROM (SELECT r.*, w.*, r.t0 + ((done[w.i + 1] - since[w.i + 1]) * r.d) // w.n AS rel, r.t0 + ((done[w.i + 1] - since[w.i + 1] + 1) * r.d + w.n - 1) // w.n AS due
            FROM edf r, w WHERE done[w.i + 1] < w.nb) r JOIN w ON w.i = r.i
      WHERE rel <= r.t + 1 GROUP BY r.t, r.t0, r.d, r.done, r.since)))
SELECT doc_id, s.source, size, start // block AS block, e.t AS slot, start
FROM s JOIN b ON true JOIN w ON s.source IS NOT DISTINCT FROM w.source JOIN edf e ON e.pick = w.i AND e.k = start // block
"""

_OP9 = r"""
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
     x AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
     solid AS (SELECT * FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     total AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
     often AS (SELECT s.source, s.line FROM (SELECT source, line, count(DISTINCT doc_id) AS pages FROM solid GROUP BY source, line) s
               JOIN total t ON s.source = t.source WHERE pages >= 2 AND pages > total * 0.065::DOUBLE),
     marked AS (SELECT x.*, regexp_matches(x.line, '[^\x20\x09-\x0D]') AS full_line, o.line IS NOT NULL AND regexp_matches(x.line, '[^\x20\x09-\x0D]') AS gone
                FROM x LEFT JOIN often o ON x.source = o.source AND x.line = o.line),
     g AS (SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_gone,
                  string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT l.doc_id, l.source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_gone, 0)::BIGINT AS n_dropped,
       md5(CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END) AS kept_md5
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""

ORACLE: dict[str, str] = {"op3_urlfilter": _OP3, "op4_mixing": _OP4, "op9_linededup": _OP9}
