"""The corpus pipeline: five stages over ``documents``, each written and read again.

1. toxicity: documents that score 0.5 and more go;
2. near duplicates: one document of each class stays, the one with the least id;
3. benchmark: documents with a hit word of a benchmark window go;
4. mixing: each document is emitted as often as the mix of sources takes it;
5. tokens: the rest is encoded and written as token files, which are read back.

Every stage takes all rows that the one before kept, and each but the last returns the columns
of ``documents``.  Null texts count as empty throughout; an empty table passes through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tenderloom.llm import decontaminate, mixing, prob_minhash, token_files, toxicity
from tenderloom.llm.tables import bounded_batches, written
from tenderloom.session import checkpoint_root

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = bounded_batches(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, toxicity.learnable(labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return prob_minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = bounded_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = f"{checkpoint_root(spark)}/llm/pipeline-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Trained scores, signatures and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
