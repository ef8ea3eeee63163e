"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import discard, giving_back, written

#: Edges that one task may finish (16 bytes each), and edges a task holds before it reduces them.
ONE_TASK, _HELD = 1 << 20, 1 << 20
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with the least edges: every node but the smallest of its component, and that smallest one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a task's edges; groups that the task sees whole cost an edge per node from here on."""
    held, size = [], 0
    for batch in batches:
        u, v = (batch.column(i).to_numpy() for i in (0, 1))
        held.append((u, v))
        size += len(u)
        if size > _HELD:
            held = [forest(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0])
            if size > _HELD // 2:  # little to gain: pass on what there is
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], schema=_EDGES)
                held, size = [], 0
    if held:
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_EDGES)


def _forests(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(giving_back(_reduced), "u long, v long")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang every neighbour (larger: only those above the node) on the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if larger else both.where(F.col("v") < F.col("u"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = seen.join(least, "u")
    if larger:
        new = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = new.union(least.select("u", F.col("m").alias("v")))
    return new.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (u long, v long): the smallest node it is linked to.

    Every task first reduces its edges to a forest. While that leaves more than ``ONE_TASK`` edges, rounds of hanging
    nodes on smaller neighbours, each written to the shared folder, go on until nothing changes; fewer are finished by
    one task. Loops and repeated edges do no harm; null ends are left out.
    """
    known = written(_forests(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")), "edges")
    sign = lambda e: tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    before = sign(known)
    while before[0] > ONE_TASK:
        last, known = known, written(_star(_star(known, True), False), "edges")
        discard(last)
        after = sign(known)
        if after == before:
            break
        before = after
    if before[0] <= ONE_TASK:
        last, known = known, written(_forests(known.coalesce(1)), "edges")
        discard(last)
    top = known.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return known.select(F.col("u").alias("id"), F.col("v").alias("component")).union(top)
