"""The queries of this subpackage: thin wrappers that derive the contract's columns from the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, mixing, quality, sentencepiece, sharding, simhash, suffix_dedup, topk, urls
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SHARD_BYTES = 1 << 20


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select("doc_id", "n_bytes", "depth", "prefix", "shard_bytes", "shard_rows")


#: Buckets at every depth up to 20 bits; a row's shard is the shallowest that fits (deeper ones aren't needed at this size).
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
paths AS (SELECT doc_id, n_bytes, depth::INTEGER AS depth, h >> (60 - depth)::INTEGER AS prefix FROM d, generate_series(0, 20) g(depth)),
sums AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM paths GROUP BY ALL)
SELECT doc_id, n_bytes, depth, prefix::VARCHAR AS prefix, shard_bytes, shard_rows
FROM paths JOIN sums USING (depth, prefix) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP6_SQL = """
WITH sizes AS (SELECT source, sum(strlen(text))::DOUBLE AS bytes FROM documents GROUP BY source),
rates AS (SELECT source, sum(bytes) OVER () * pow(bytes, 0.5) / sum(pow(bytes, 0.5)) OVER () / bytes AS rate FROM sizes),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM rates, generate_series(0, 60) g(k)),
drawn AS (SELECT doc_id, source, text, ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT doc_id, drawn.source, any_value(text) AS text, count(*) FILTER (u >= p) AS n FROM drawn JOIN cdf ON drawn.source = cdf.source GROUP BY ALL)
SELECT doc_id, source, copy::INTEGER AS copy, md5('mix:' || doc_id || ':' || copy) AS shuffle_key, md5(text) AS text_md5
FROM (SELECT doc_id, source, text, unnest(generate_series(1, n)) AS copy FROM counted)
"""


#: The public vocabulary's model file; only the driver reads it.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentencepiece.encode_column(docs, model_path, keep=["doc_id"], check_col="round_trip")
    return found.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; then, from the same index at 200 bytes, how many passages of over 50 words stand elsewhere too, and the text without them."""
    return suffix_dedup.digest(suffix_dedup.nested_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held & F.col("doc_id").isNotNull()), "doc_id", "text", "lang")
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: The contract's rules, and weak labels, since `pages` has none: host words by which URLs are labelled for training.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BAD_HOST_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    bad = F.lower(host).rlike(r"(^|[.-])(" + "|".join(BAD_HOST_WORDS) + r")([.-]|$)")
    model = urls.fit(pages.select("url", bad.cast("int").alias("blocked")), "url", "blocked")
    return urls.judge(pages, model, URL_RULES)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS t FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch()
    described = scratch.keep(quality.describe(docs), "quality")  # each text is read once
    return scratch.result(quality.rate(described, quality.learn(described)), "quality-rated")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_shards, op3_sentencepiece, op4_suffix, op5_langid, op6_mix, op7_urls, op8_topk, op9_quality, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op2_shards": OP2_SQL, "op6_mix": OP6_SQL, "op8_topk": OP8_SQL}
