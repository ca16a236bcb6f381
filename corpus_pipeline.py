"""From documents to training tokens in five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, common, line_dedup, mixing, queries, simhash, toxicity

#: Near copies share this much of their five-word shingles. Fingerprints within so many bits and texts with a common
#: band of smallest hashes are compared; only the exact overlap decides.
SIMILAR, NEAR = 0.8, 6
#: Share of the tokens that mixing keeps at most; weights are those of the query.
MIX_SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    done = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    return simhash.keep_one(docs, least=SIMILAR, shingle=5, distance=NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """At most once each."""
    return mixing.mix(docs, queries.WEIGHTS, MIX_SHARE, 1, queries.SEED, queries.domain()).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    encoded = bpe.encode_documents(docs, public_tokenizers.path(queries.TOKENIZER))
    return queries.digests(encoded, "ids")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", keep_one), ("mixing", mix), ("BPE", encode)]
#: Three stages cannot be expressed in SQL; tests/llm holds each stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, tokens included. Each stage is written below spark.checkpoint.dir, so a lost executor costs
    one stage; a stage's folder goes once the next one is written, the last stays for the reader."""
    docs = common.table(spark, sf_dir, "documents")
    shared = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{i}")
        docs = spark.read.parquet(f"{shared}/{i}")
        if i:
            common.remove(spark, f"{shared}/{i - 1}")
    return docs
