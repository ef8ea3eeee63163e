"""Token counts with a digest cache.

Each text is known by the digest of its normalised content (null = empty; the tokenizer's own
normaliser works inside the library) and the digest of the tokenizer file. Counts already stored
under both digests are joined; of the others each distinct text is encoded once and appended.

The text travels at most once, by its digest, after every task has dropped its own repeats, so a
text that makes up a third of the table costs one row per task. Counts are joined by digest
without the texts; a hot digest is split by adaptive execution.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.byte_bpe import PieceEncoder
from sentispark.llm.common import give_back, id_and_text, slices

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def tokenizer_version(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _counter(kind: str, data: bytes):
    """A function from an array of texts to counts for a ``.json`` or ``.model`` file's bytes."""
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in pieces.encode(texts.to_pylist(), num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    spec = json.loads(data)
    whole = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    splitter = spec.get("pre_tokenizer") or {}
    if (
        spec.get("normalizer")
        or splitter.get("type") != "ByteLevel"
        or splitter.get("add_prefix_space")
        or not splitter.get("use_regex", True)
    ):
        return whole
    # Texts cut at spaces have the same tokens, unless they hold a string that the library
    # takes out before anything else.
    special = [t["content"] for t in spec.get("added_tokens") or []]
    encoder = PieceEncoder(tokenizer)

    def count(texts: pa.Array) -> list[int]:
        odd = np.zeros(len(texts), bool)
        for string in special:
            odd |= pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        if not odd.all():
            counts[~odd] = np.diff(encoder.encode(texts.filter(pa.array(~odd)))[1], prepend=0)
        if odd.any():
            counts[odd] = whole(texts.filter(pa.array(odd)))
        return counts

    return count


def _missing_counts(texts: DataFrame, kind: str, data: bytes) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for part in slices(batches, "text", 4 << 20):
            count = count or _counter(kind, shared.value)
            n = pa.array(count(part.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n], ["content", "n_tokens"])
        del count
        give_back()

    return texts.mapInArrow(run, "content binary, n_tokens long")


def count_tokens(
    docs: DataFrame, kind: str, data: bytes, cache: str, limit: int = 1024, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, and new counts appended to ``cache``.

    ``kind`` is ``json`` or ``model``, ``data`` the tokenizer file, ``cache`` a folder (made if
    absent) of Parquet files that grows by each call's misses. Repeated rows give repeated results;
    a null id keeps its row. An append that fails midway leaves no rows in the cache.
    """
    spark = docs.sparkSession
    version = tokenizer_version(data)
    rows = id_and_text(docs, key, text).withColumn("content", F.unhex(F.sha2(F.col("text"), 256)))
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    empty.write.mode("append").parquet(cache)
    read = lambda: (
        spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).drop("tokenizer").dropDuplicates(["content"])
    )
    distinct = rows.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read(), "content", "left_anti").select("content", "text")
    found = _missing_counts(misses, kind, data)
    found.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    known = read()
    sized = rows.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sized.join(known, "content", "left").select(
        "id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
