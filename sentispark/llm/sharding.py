"""Proportional stratified interleaving: every shard gets each source in the proportion it has in the whole.

1. Within its source every row gets a rank in a seeded random order (the digest of seed and id).
2. The fractional rank (2 * rank - 1) / (2 * rows of the source) spreads each source evenly over
   0..1, so any stretch of the order by fractional rank holds every source in proportion.
3. That order is cut into stretches whose numbers of rows differ by one at most: the shards.

Both rankings go over range partitions of (key, order), so a source that holds a third of all rows is
ranked by many tasks, and only ids, sizes and checksums are shuffled, never texts. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import written
from sentispark.scale import join_per_key, number_rows

SEED = "shards"


def interleave(
    docs: DataFrame,
    shards: int = 16,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    seed: str = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, checksum, shard, slot, carried) of every row of ``docs``.

    ``size``: the UTF-8 bytes of the text plus one; ``checksum``: CRC-32 of these bytes, unsigned. Shards are 0 to
    ``shards`` - 1, their numbers of rows differ by one at most, and slots count from 0 without gaps.
    Of every source a shard gets its share, up to the rounding of a row per source. ``carried`` holds the columns
    named in ``carry``, which then travel through both rankings.

    A null text is empty. Rows without a source are one more source. Rows without an id draw like any other; rows that
    repeat an id draw alike and lie next to one another in the order of checksum and size; whole copies are
    interchangeable. With fewer rows than shards some shards are empty; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(key).cast("long").alias("id"),
            F.struct(F.col(source).cast("string").alias("source")).alias("stratum"),
            (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
            F.crc32(content).alias("checksum"),
            F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("draw"),
            F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carry]).alias("carried"),
        ),
        "to-shard",
    )
    ranked = number_rows(rows, ["stratum"], ["draw", "checksum", "size"], "rank")
    totals = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("total"))
    share = (2 * F.col("rank") - 1) / (2 * F.col("total"))
    shared = join_per_key(ranked, totals, "stratum").withColumns({"share": share, "whole": F.lit(0)})
    placed = number_rows(shared, ["whole"], ["share", "stratum", "rank"], "position")
    count = rows.count()
    cut = placed.withColumn("shard", F.expr(f"CAST((position - 1) * {shards} DIV {max(count, 1)} AS INT)"))
    # A shard begins at ceil(shard * rows / shards).
    slot = F.expr(f"position - 1 - (shard * {count}L + {shards - 1}) DIV {shards}")
    return cut.select("id", F.col("stratum.source").alias("source"), "size", "checksum", "shard", slot.alias("slot"), "carried")


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> DataFrame:
    """Write all columns of ``docs`` as Parquet, a folder per shard with its rows in the order of their slots.

    A shard is written in stretches of slots by several tasks, so none is one task's work. Returns
    what ``interleave`` does, without the carried columns. The folders name ``shard``; a column of
    ``docs`` with that name, or named ``slot``, is stored as ``docs_shard`` or ``docs_slot``.
    """
    names = {c: f"docs_{c}" if c in ("shard", "slot") else c for c in docs.columns}
    dealt = interleave(docs, shards, carry=docs.columns, **options)
    stored = dealt.select("shard", "slot", *[F.col("carried")[c].alias(n) for c, n in names.items()])
    stored = stored.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    stored.write.partitionBy("shard").parquet(path)
    return dealt.drop("carried")
