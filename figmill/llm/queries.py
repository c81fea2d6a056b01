"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.llm import license_scan, line_dedup, mixing, mtree, setsketch, toxicity
from figmill.llm.packing import pack
from figmill.llm.quality_forest import BASE, quality
from figmill.llm.sharding import shard
from figmill.llm.url_filter import judge

#: The url rules (host, path, verdict) and the listed hosts, under each of three top-level domains.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LISTED_HOSTS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"{h}.{d}", "") for h in LISTED_HOSTS for d in LISTED_DOMAINS], "host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules, listed)


OP2_SQL = f"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS k,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
f AS (SELECT k, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM p JOIN r
      ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
l AS (SELECT DISTINCT k FROM p JOIN (SELECT h || '.' || d AS lh FROM (VALUES {", ".join(f"('{h}')" for h in LISTED_HOSTS)}) a(h), (VALUES {", ".join(f"('{d}')" for d in LISTED_DOMAINS)}) b(d))
      ON host = lh OR ends_with(host, '.' || lh))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN l.k IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.k IS NOT NULL AS listed
FROM p LEFT JOIN f ON p.k = f.k LEFT JOIN l ON p.k = l.k
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_GRAMS = "CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, text FROM documents),
t AS (SELECT name, list_distinct({_GRAMS}) AS tg FROM (SELECT name, {_WORDS.format("body")} AS w FROM (VALUES {", ".join("('" + n + "', '" + b + "')" for n, b in sorted(license_scan.TEMPLATES.items()))}) v(name, body))),
l AS (SELECT k, row_number() OVER () AS line, {_GRAMS} AS g FROM (SELECT k, {_WORDS.format("x")} AS w FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d)) WHERE len(w) BETWEEN 1 AND 40),
s AS (SELECT k, line, name, round(2.0 * len(list_intersect(tg, g)) / (len(g) + len(tg)), 6) AS dice FROM l JOIN t ON list_has_any(tg, g)),
h AS (SELECT k, count(DISTINCT line) AS n, max(dice) AS dice, min(name) FILTER (WHERE r = 1) AS name FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY dice DESC) AS r FROM s WHERE dice >= {license_scan.THRESHOLD}) GROUP BY k)
SELECT doc_id, coalesce(n, 0) AS n_hits, name AS license, dice FROM d LEFT JOIN h USING (k)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "anomaly")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), short=True)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_url_filter, op3_license_scan, op4_quality_rules, op5_packing, op6_near_dedup, op7_toxicity, op8_mixing, op9_topk, op10_line_dedup)}
ORACLES = {"op2_url_filter": OP2_SQL, "op3_license_scan": OP3_SQL, "op9_topk": OP9_SQL}
