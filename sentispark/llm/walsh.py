"""Centroid clustering by a progressive search in the Walsh-Hadamard domain, in integers.

The transform of a vector has its components' sums with signs, coarse patterns (few changes of sign)
first. It is orthogonal up to a factor: the squared distance of two vectors is that of their
transforms divided by the number of components. Any leading coefficients give a lower bound, so a vector's search
takes a few coefficients of all centroids, finishes the most promising one for an upper
bound, and goes on from coarse to fine with the centroids that are not strictly worse. What
is left at the end has all coefficients: the distances are exact and ties are seen as ties.

Vectors are transformed once and stored. A round is one pass over them; tasks reduce their vectors
to a count and sums per cluster, so only centroids come to the driver: clusters * components integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import written

_FIRST = 8


def largest(size: int) -> int:
    """Magnitude of a scaled component below which all coefficients and distances fit 64 bits."""
    return (1 << 29) // size


def pattern_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes, which is what ``transform`` follows."""
    rows = np.array([[bin(i & j).count("1") & 1 for j in range(size)] for i in range(size)])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, exact, coarse patterns first."""
    out = vectors.astype(np.int64)
    size, reach = out.shape[1], 1
    while reach < size:
        pairs = out.reshape(len(out), -1, 2, reach)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
        reach *= 2
    return out[:, pattern_order(size)]


def restored(sums: np.ndarray) -> np.ndarray:
    """The vectors whose transforms are the rows of ``sums``."""
    size = sums.shape[1]
    natural = np.empty_like(sums)
    order = pattern_order(size)
    natural[:, order] = sums
    back = np.empty_like(sums)
    back[:, order] = transform(natural)
    return back // size


class Search:
    """Nearest of a few centroids, given as transforms; counts the coefficients it looked at."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.looked = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each transformed vector, ties to the smaller number."""
        rows, count = np.arange(len(vectors)), len(self.centroids)
        size = vectors.shape[1]

        def added(vector: np.ndarray, centroid: np.ndarray, begin: int, end: int) -> np.ndarray:
            self.looked += len(vector) * (end - begin)
            gap = vectors[vector, begin:end] - self.centroids[centroid, begin:end]
            return (gap * gap).sum(axis=1)

        end = min(_FIRST, size)
        vector, centroid = np.repeat(rows, count), np.tile(np.arange(count), len(rows))
        total = added(vector, centroid, 0, end)
        guess = total.reshape(-1, count).argmin(axis=1)
        most = total.reshape(-1, count)[rows, guess] + added(rows, guess, end, size)
        while end < size:
            # Only the strictly worse go, so every centroid at the least distance reaches the end.
            able = total <= most[vector]
            vector, centroid, total = vector[able], centroid[able], total[able]
            begin, end = end, min(2 * end, size)
            total = total + added(vector, centroid, begin, end)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(best, vector, total)
        tied = total == best[vector]
        number = np.full(len(rows), count)
        np.minimum.at(number, vector[tied], centroid[tied])
        return number, best // size


def _kept(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """(id, vector) with integer components of the rows that take part."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(largest(size))))
    whole = F.coalesce(F.forall(F.col(vector), usable), F.lit(False)) & (F.size(vector) == size)
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(whole).select(F.col(key).cast("long").alias("id"), scaled.alias("vector"))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            yield batch.slice(begin, most)


def _sums(centroids: np.ndarray):
    """Per cluster of a task: its vectors and the sums of their coefficients."""
    count, size = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        totals = np.zeros((count, size + 1), np.int64)
        for batch in _pieces(batches):
            vectors = _matrix(batch, size)
            number, _ = search.nearest(vectors)
            order = np.argsort(number, kind="stable")
            found, begins = np.unique(number[order], return_index=True)
            totals[found, :size] += np.add.reduceat(vectors[order], begins, axis=0)
            totals[found, size] += np.diff(np.append(begins, len(order)))
        cluster, place = np.divmod(np.arange(count * (size + 1)), size + 1)
        there = totals[cluster, size] > 0
        columns = (cluster[there], place[there], totals.ravel()[there])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _assigned(centroids: np.ndarray):
    count, size = centroids.shape
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in _pieces(batches):
            number, distance = search.nearest(_matrix(batch, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return run


def _transformed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            flat = transform(_matrix(batch, size)).ravel()
            offsets = pa.array(np.arange(0, size * (batch.num_rows + 1), size), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["id", "vector"])

    return run


def cluster(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every row that takes part, the centroids the distances refer to).

    Rows take part whose vector has exactly ``size`` components (a power of two), none null, not finite
    or, times ``scale``, of a magnitude of ``largest(size)`` or more; a component x counts as floor(scale * x). The first
    centroids are the vectors with the least SHA-256 of ``seed:id``, rows with one id in the order of their vectors,
    rows without an id last. Every round moves a centroid to the floor of its vectors' mean; one without
    vectors stays. Ties go to the smaller number; equal centroids thus leave the later one empty. Repeated rows
    count as often as they occur. With fewer rows than ``clusters`` there are as many centroids as rows, with none no result rows.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the transform needs a power of two")
    kept = _kept(vectors, key, vector, size, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(drawn.asc_nulls_last(), "vector").limit(clusters).collect()
    if not first:
        return kept.sparkSession.createDataFrame([], "id long, cluster int, distance long"), []
    centers = np.array([r["vector"] for r in first], np.int64)
    stored = written(kept.mapInArrow(_transformed(size), "id long, vector array<long>"), "walsh")
    for _ in range(rounds):
        sums = stored.mapInArrow(_sums(transform(centers)), "cluster int, place int, total long")
        totals = np.zeros((len(centers), size + 1), np.int64)
        for r in sums.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
            totals[r["cluster"], r["place"]] = r["total"]
        full = totals[:, size] > 0
        centers[full] = restored(totals[full, :size]) // totals[full, size:]
    found = stored.mapInArrow(_assigned(transform(centers)), "id long, cluster int, distance long")
    return written(found, "clusters"), centers.tolist()


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` (sums of distances, null if beyond 64 bits) and ``centroid_sha256`` to what ``cluster`` returns."""
    per_cluster = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = found.agg(F.try_sum("distance")).first()[0]
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    # A row per cluster: as many as there are centroids on the driver.
    per_cluster = per_cluster.join(named, "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return found.join(F.broadcast(per_cluster), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
