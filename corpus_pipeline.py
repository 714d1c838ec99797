"""The corpus pipeline: five stages over documents, each an operator of palimpsest.llm.

Each stage takes all rows that the one before kept. ORACLE_SQL is None: trained models, byte-level matches and token ids
can't be expressed in SQL; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, quality, sentencepiece, simhash, suffix_dedup
from palimpsest.llm.common import materialise
from palimpsest.llm.entry import PIECE_MODEL


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (and 200 bytes at least) that stand elsewhere too are cut out of the texts; n_chars follows. Every row stays."""
    return suffix_dedup.remove_repeats(docs, length=200, gram=100, over=50).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources weigh as the square root of their bytes, in one global shuffle."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and whether they decode to it."""
    found = sentencepiece.encode_column(docs, PIECE_MODEL, keep=["doc_id", "lang", "source"], check_col="round_trip")
    return found.withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
