"""Helpers that keep joins and orderings spread over the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentispark.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table that is one input split over all cores; any other passes unchanged.

    A split holds ``spark.sql.files.maxPartitionBytes`` of the file, so what is dealt out is
    bounded by that setting on a cluster of any size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() == 1 else df


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df``, measured by one distributed aggregate."""
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + F.lit(64)).alias("bytes")).first()
    return int(row["bytes"] or 0)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def join_per_key(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to a ``table`` of one row per key, whatever the skew of the rows.

    A table that measures small is broadcast and the rows stay where they are. Otherwise both
    sides are shuffled on (key, salt) with the table repeated per salt, so a key holding a third
    of the rows is spread over many tasks. ``how`` may be inner, left, left_semi or left_anti.
    ``table`` is read twice (measured, joined); pass stored or cheap data.
    """
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), key, how)
    # From content and input split: a task that runs again salts its rows the same way, and even
    # identical rows are spread as far as their splits.
    row_hash = F.xxhash64(*rows.columns, F.spark_partition_id())
    salted = rows.withColumn("_salt", F.pmod(row_hash, F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str
) -> DataFrame:
    """1-based position of every row within its key, in ``order``.

    Equal to ``row_number()`` over (keys, order), without putting a whole key in one task: the
    rows are range-partitioned on key and order together, so a key that holds a third of the
    table is cut into many slices; each slice is numbered alone and shifted by the sizes of the
    slices before it. The slices are written once, since the boundaries come from a sample and
    must be the same for the numbering and for the sizes. ``order`` has to be total per key.
    """
    return number_and_count(df, keys, order, out)[0]


def number_and_count(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str
) -> tuple[DataFrame, DataFrame]:
    """``number_rows``, and a row per key with the number of its rows as ``out``.

    Rows are shuffled and sorted once: a row's place in its slice is its running id there less the
    first one of its key, so the sizes and first ids, a row per key and slice, are all that is joined.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    # As one struct the key is never null, so rows without a key are numbered and joined too.
    keyed = df.withColumn("_key", F.struct(*keys))
    ranged = keyed.repartitionByRange(F.col("_key"), *order_cols).sortWithinPartitions(F.col("_key"), *order_cols)
    sliced = materialize(ranged.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = materialize(
        sliced.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_least"))
    )
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_least") + F.lit(1)
    shifts = parts.select("_key", "_slice", shift.alias("_shift"))
    if fits_broadcast(shifts):
        shifts = F.broadcast(shifts)
    numbered = sliced.join(shifts, ["_key", "_slice"]).select(
        *df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(out)
    )
    return numbered, parts.groupBy("_key").agg(F.sum("_size").alias(out)).select("_key.*", out)


def running_totals(
    df: DataFrame, key: str, position: str, span: int, values: dict[str, str]
) -> DataFrame:
    """Running sums of ``values`` (input -> output name) over an integer ``position`` per key.

    Positions are cut into spans of ``span``; a task orders one span of one key at a time and
    adds the total of all earlier spans, so no task ever holds a whole key.
    """
    spanned = df.withColumn("_span", F.floor(F.col(position) / F.lit(span)))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        spanned.groupBy(key, "_span")
        .agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
        .select(
            key,
            "_span",
            *[
                F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}")
                for v in values
            ],
        )
    )
    inside = (
        Window.partitionBy(key, "_span")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = spanned.select("*", *[F.sum(v).over(inside).alias(f"_run_{v}") for v in values])
    joined = local.join(bases, [key, "_span"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_run_{v}") + F.col(f"_base_{v}")).alias(out) for v, out in values.items()],
    )


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order`` (total per key).

    An aggregate rather than a window: every task reduces its copies to one row before the
    shuffle, so a group of copies holding a third of the table costs one row per task.
    """
    keyed = df.select(
        *[k.alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct("*").alias("row")).alias(
            "_ranked"
        ),
    )
    return (
        keyed.groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.min("_ranked").alias("_first"))
        .select("_first.row.*")
    )
