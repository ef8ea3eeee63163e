"""A training-corpus pipeline: each stage works on what the stage before it kept.

1. quality: documents the co-trained classifiers find poor or toxic go.
2. near_duplicates: of each component of near-duplicate documents the one with the smallest id stays.
3. repeats: byte strings of 50 bytes or more that an earlier document holds are cut out of the texts; a
   document of which nothing is left goes.
4. decontamination: documents that hold a benchmark item, up to the edit budget, go.
5. tokens: the texts as token ids, with the digest of the bytes these decode to.

Every stage keeps all columns of its input, whatever these are called, and works on empty tables. A null text is an
empty one. Rows without an id are scored and encoded like others; the stages that find documents by their ids leave them as
they are. Rows that repeat an id are one document to those stages and go or stay together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.llm import byte_bpe, cotrain, decontaminate, jaccard_join, suffix_dedup
from sentispark.llm.common import written
from sentispark.session import use_utc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _prepared(spark: SparkSession) -> None:
    use_utc(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    model = cotrain.train(docs, _table(spark, sf_dir, "labels"))
    return cotrain.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    found = jaccard_join.near_duplicates(docs, words=5, percent=75)
    gone = found.where(F.col("component") != F.col("id")).select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    found = suffix_dedup.remove_repeats(docs, span=50, as_text=True)
    # Texts that lost nothing stay as they are, null ones and their counts included.
    shorter = F.col("n_removed") > 0
    own = {c: F.col("carried")[c] for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    own["n_chars"] = F.when(shorter, F.length("kept")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    left = found.where(~shorter | (F.trim("kept") != ""))
    return left.select(*[own[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    leaks = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepared(spark)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = byte_bpe.read_ranks(file.read())
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        F.col("id").alias("doc_id"),
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
