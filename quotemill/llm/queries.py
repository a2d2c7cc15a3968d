"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import find_leaks
from .exact_dedup import grace_dedup
from .langid import predict_language
from .licenses import oracle as license_sql
from .licenses import scan_licenses
from .lm_bloom import lm_scores
from .mixing import mix_sources
from .ngram_join import ngram_join
from .shards import extendible_shards
from .token_records import token_records
from .unit_dedup import repeated_spans

#: A shard of the query is what one read of a training loop takes.
SHARD_BYTES = 128 << 10
#: Shorter runs of repeated sentences are left: by chance alone most documents share some.
RUN_WORDS = 30
TOKENIZER = "word_bpe_49k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(documents(spark, sf_dir))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir), min_words=RUN_WORDS).drop("text_key", "row")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(documents(spark, sf_dir), limit_bytes=SHARD_BYTES).select("doc_id", "shard", "shard_depth", "shard_bytes")


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op8_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup(documents(spark, sf_dir))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), columns=["doc_id", "source"])
    names = ["doc_id", "source", "n_tokens", "source_weight", "source_tokens", "source_budget", "copies", "mix_block", "mix_block_key", "mix_row_key", "target_met"]
    return mixed.withColumn("source_weight", F.round("source_weight", 9)).select(*names)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_string_kernel_language": op1_string_kernel_language,
    "op2_bloom_lm": op2_bloom_lm,
    "op3_extendible_shards": op3_extendible_shards,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_token_records": op7_token_records,
    "op8_grace_dedup": op8_grace_dedup,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_license_scan": op10_license_scan,
}

SHARD_SQL = """
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 32 AS bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM {docs}),
tree AS (
  SELECT d.depth, h >> (60 - d.depth) AS prefix, CAST(sum(bytes) AS BIGINT) AS total
  FROM sized, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY 1, 2),
own AS (
  SELECT s.doc_id, min(t.depth) AS depth, arg_min(t.prefix, t.depth) AS prefix, arg_min(t.total, t.depth) AS total
  FROM sized s, tree t WHERE t.prefix = s.h >> (60 - t.depth) AND t.total <= {limit} GROUP BY s.doc_id)
"""

MIX_KEY = "('0x' || substr(md5({}), 1, 15))::BIGINT"
ENTROPY = "ln(list_sum(list_transform(rs, lambda r: pow(r, {a})))) - {a} * list_sum(list_transform(rs, lambda r: pow(r, {a}) * ln(r))) / list_sum(list_transform(rs, lambda r: pow(r, {a})))"
REPEATS = "pow(least / most, {a}) / list_sum(list_transform(rs, lambda r: pow(r, {a}))) * total / least"
MIX_SQL = rf"""
WITH RECURSIVE
c AS (SELECT doc_id, source, coalesce(source, '') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n, {MIX_KEY.format("'17:' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS k FROM documents),
s AS (SELECT src, CAST(sum(n) AS BIGINT) AS t FROM c GROUP BY src),
l0 AS (SELECT CAST(sum(t) AS DOUBLE) AS total, CAST(min(t) FILTER (t > 0) AS DOUBLE) AS least, CAST(max(t) AS DOUBLE) AS most, count(*) FILTER (t > 0) AS n_src FROM s),
l AS (SELECT *, (SELECT list(t / most) FILTER (t > 0) FROM s) AS rs FROM l0),
goal AS (SELECT *, h + 0.5::DOUBLE * (ln(n_src) - h) AS target FROM (SELECT *, {ENTROPY.format(a='1.0::DOUBLE')} AS h FROM l)),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END FROM (SELECT i, lo, hi, mid, {ENTROPY.format(a='mid')} <= target AS good FROM (SELECT *, (lo + hi) / 2 AS mid FROM b, goal WHERE i < 60))),
e AS (SELECT CASE WHEN abs(target - h) > 1e-12 THEN hi ELSE 1.0 END AS a, goal.* FROM b, goal WHERE i = 60),
b2 AS (SELECT 0 AS i, a AS lo, 1.0::DOUBLE AS hi FROM e UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END FROM (SELECT i, lo, hi, mid, {REPEATS.format(a='mid')} <= 4 AS good FROM (SELECT *, (lo + hi) / 2 AS mid FROM b2, l WHERE i < 60))),
f AS (SELECT CASE WHEN {REPEATS.format(a='a')} <= 4 THEN a ELSE (SELECT hi FROM b2 WHERE i = 60) END AS x, {REPEATS.format(a='a')} <= 4 AS met, e.* FROM e),
w AS (SELECT src, t, met, total, CASE WHEN t > 0 THEN pow(t / most, x) / list_sum(list_transform(rs, lambda r: pow(r, x))) ELSE 0.0 END AS weight FROM s, f),
v AS (SELECT *, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS whole, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest, least(65536, greatest(1, CAST(ceil(t / 262144.0) AS BIGINT))) AS blocks
  FROM (SELECT *, CAST(floor(weight * (total * (1 + 1e-9::DOUBLE))) AS BIGINT) AS budget FROM w)),
p AS (SELECT *, {MIX_KEY.format("'17:' || src || ':' || block || ':' || whole")} AS bk, {MIX_KEY.format("'17:' || k || ':' || whole")} AS rk FROM (SELECT c.*, v.* EXCLUDE (src), k % blocks AS block FROM c JOIN v ON v.src = c.src)),
g AS (SELECT src, bk, rest, sum(n) AS t, sum(sum(n)) OVER (PARTITION BY src ORDER BY bk) AS upto FROM p GROUP BY src, bk, rest),
edge AS (SELECT src, min(bk) AS bk, min_by(rest - upto + t, bk) AS room FROM g WHERE upto > rest GROUP BY src),
o AS (SELECT p.src, rk, room, sum(sum(n)) OVER (PARTITION BY p.src ORDER BY rk) AS upto FROM p JOIN edge ON edge.src = p.src AND edge.bk = p.bk GROUP BY p.src, rk, room),
cut AS (SELECT src, max(rk) AS rk FROM o WHERE upto <= room GROUP BY src)
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS source_weight, p.t AS source_tokens, budget AS source_budget,
  whole + CASE WHEN rest > 0 AND (p.bk < edge.bk OR p.bk = edge.bk AND p.rk <= cut.rk) THEN 1 ELSE 0 END AS copies, block AS mix_block, p.bk AS mix_block_key, p.rk AS mix_row_key, met AS target_met
FROM p LEFT JOIN edge ON edge.src = p.src LEFT JOIN cut ON cut.src = p.src"""

ORACLES: dict[str, str] = {
    "op9_temperature_mix": MIX_SQL,
    "op3_extendible_shards": SHARD_SQL.format(docs="documents", limit=SHARD_BYTES)
    + "SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(prefix::BIT::VARCHAR, 64, '0'), CAST(depth AS INT)) END AS shard, CAST(depth AS INT) AS shard_depth, total AS shard_bytes FROM own",
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT e.u, p.r FROM reach p JOIN edges e ON e.v = p.u)
SELECT s.doc_id, len(s.g) AS n_shingles, min(r.r) AS component_id FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, len(s.g)""",
    "op8_grace_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_license_scan": license_sql(),
}
