"""Exact top-k inner-product search with an M-tree, best first.

Vectors are dealt by the nearest of a bounded sample of pivots, so a shard is a region of space; a region of too many vectors
is several shards. Each shard is one M-tree stored as pages: a page has
a routing vector, a covering radius, its distance to the routing vector of the page above, and
either child pages or vectors with their stored distances to the page's routing vector.

A query visits pages in the order of the best score they can hold. With d(q, x) >= d(q, c) - r the score
(|q|^2 + |x|^2 - d^2) / 2 is bounded from above; the stored distances bound d(q, c) and d(q, x)
through the page above before anything is computed. A page or vector is passed over only when its
bound is below the k-th score found so far, so ties are complete.

A query is first searched in the shard whose routing vector is nearest. Its k-th score there passes over all shards whose root
cannot hold a better one; the others are searched in blocks of queries per shard, and the best are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentispark.llm.common import discard, giving_back, partitions, written

SHARD = 16384  # vectors of a shard, about
PIVOTS = 1024  # at most so many sampled vectors divide space
QUERY_BLOCK = 1024  # queries that meet a shard in one task, about
ROOT_BYTES = 64 << 20  # roots of shards sent to the tasks at once; more are taken in turns
_PAGE = 256  # entries of a page
_PAGES = pa.schema(
    [("shard", pa.int32()), ("size", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("radius", pa.float64()), ("norm", pa.float64())]
    + [(c, pa.binary()) for c in ("center", "entries", "distances", "vectors")]
)
_PAGES_DDL = "shard int, size int, page int, leaf boolean, radius double, norm double, center binary, entries binary, distances binary, vectors binary"


def quantized(vector: Column) -> Column:
    """floor(256 * x) of every component, as doubles (exact below 2^53)."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def build_pages(ids: np.ndarray, vectors: np.ndarray) -> list[dict]:
    """Bulk load: split by nearest of a few spread vectors until a page holds what is left."""
    norms = (vectors * vectors).sum(axis=1)
    pages: list[dict] = []

    def page(at: np.ndarray, center: np.ndarray) -> int:
        gap = np.sqrt(np.maximum(((vectors[at] - center) ** 2).sum(axis=1), 0))
        mine = len(pages)
        node = {"page": mine, "center": center, "radius": float(gap.max()), "norm": float(norms[at].max())}
        pages.append(node)
        if len(at) <= _PAGE or node["radius"] == 0:
            node |= {"leaf": True, "entries": ids[at], "distances": gap, "vectors": vectors[at]}
            return mine
        count = min(_PAGE, -(-len(at) // (_PAGE // 2)))
        pivots = at[np.linspace(0, len(at) - 1, count).astype(np.int64)]
        if (vectors[pivots] == vectors[pivots[0]]).all():
            pivots = np.array([at[0], at[np.argmax(((vectors[at] - vectors[at[0]]) ** 2).sum(axis=1))]])
        square = norms[at][:, None] - 2 * vectors[at] @ vectors[pivots].T + norms[pivots][None, :]
        nearest = np.argmin(square, axis=1)
        children, tops = [], []
        for p in range(len(pivots)):
            if (nearest == p).any():
                children.append(page(at[nearest == p], vectors[pivots[p]]))
                tops.append(float(np.sqrt(((vectors[pivots[p]] - center) ** 2).sum())))
        node |= {"leaf": False, "entries": np.array(children, np.int64), "distances": np.array(tops), "vectors": np.empty((0, 0))}
        return mine

    if len(ids):
        page(np.arange(len(ids)), vectors.mean(axis=0))
    return pages


class Tree:
    """Pages of one shard, ready for search."""

    def __init__(self, pages: dict[int, dict]):
        self.pages = pages
        self.computed = 0
        for node in pages.values():
            if not node["leaf"]:
                below = [pages[c] for c in node["entries"].tolist()]
                node["radii"] = np.array([c["radius"] for c in below])
                node["norms"] = np.array([c["norm"] for c in below])
                node["centers"] = np.stack([c["center"] for c in below])
            else:
                node["norms"] = (node["vectors"] * node["vectors"]).sum(axis=1)

    def search(self, name: int, query: np.ndarray, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``floor``, ties to the smaller id; ``name`` itself is no candidate."""
        own = float(query @ query)
        best: list[tuple[float, int]] = []  # a heap, worst first: (score, -id)
        root = self.pages[0]
        slack = 1e-9 * (own + root["norm"]) + 1e-6
        bound = lambda norm, gap: (own + norm - np.maximum(gap, 0) ** 2) / 2 + slack
        distance = lambda c: np.sqrt(np.maximum(((c - query) ** 2).sum(axis=-1), 0))
        near = float(distance(root["center"]))
        waiting = [(-float(bound(root["norm"], near - root["radius"])), 0, near)]
        while waiting:
            top, number, near = heapq.heappop(waiting)
            worst = max(best[0][0], floor) if len(best) == k else floor
            if -top < worst:
                break
            node = self.pages[number]
            if node["leaf"]:
                able = np.flatnonzero(bound(node["norms"], np.abs(near - node["distances"])) >= worst)
                # Copying most of a page would cost more than the few products it saves.
                part = able if 2 * len(able) < len(node["entries"]) else slice(None)
                scores, ids = node["vectors"][part] @ query, node["entries"][part]
                self.computed += len(able)
                # The page's own best k at most, none below the worst so far.
                fine = np.flatnonzero((scores >= worst) & (ids != name))
                if len(fine) > k:
                    fine = fine[np.lexsort((ids[fine], -scores[fine]))[:k]]
                for score, i in zip(scores[fine].tolist(), ids[fine].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                continue
            able = np.flatnonzero(bound(node["norms"], np.abs(near - node["distances"]) - node["radii"]) >= worst)
            gaps = distance(node["centers"][able])
            self.computed += len(able)
            bounds = bound(node["norms"][able], gaps - node["radii"][able])
            for j, b, g in zip(node["entries"][able].tolist(), bounds.tolist(), gaps.tolist()):
                if b >= worst:
                    heapq.heappush(waiting, (-b, j, g))
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def _vectors_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def _same_size(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal ``keys``; the rows come sorted by them."""
    held, now = [], None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        begin = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[begin]:
                if values[begin] != now and held:
                    yield now, held
                    held = []
                now = values[begin]
                held.append(batch.slice(begin, i - begin))
                begin = i
    if held:
        yield now, held


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (shard, size), parts in _same_size(batches, "shard", "size"):
        ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        vectors = np.concatenate([_vectors_of(p, "vector") for p in parts]).reshape(len(ids), size)
        order = np.argsort(ids, kind="stable")
        rows = [
            {"shard": shard, "size": size, **{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in p.items()}}
            for p in build_pages(ids[order], vectors[order])
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)


def _nearest_pivot(pivots: dict[int, np.ndarray]):
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("vector", pa.list_(pa.float64())), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size in pivots:
                    vectors = _vectors_of(batch.take(pa.array(at)), "vector").reshape(len(at), size)
                    square = (pivots[size] ** 2).sum(axis=1)[None, :] - 2 * vectors @ pivots[size].T
                    cells[at] = np.argmin(square, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], schema=schema)

    return run


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """Pages of the M-trees over all usable rows of ``vectors``, written to the shared folder.

    Rows without an id and vectors that are null or hold null or non-finite components take no part; rows that repeat an id are
    candidates of their own. Vectors of different lengths are in different trees. At most ``PIVOTS`` vectors, the first by
    hash of their ids, are taken to the driver as pivots.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.size(vector).alias("size"), quantized(F.col(vector)).alias("vector")
    )
    count = max(1, -(-vectors.count() // shard))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "vector").limit(min(count, PIVOTS)).collect():
        if r["vector"] not in pivots.setdefault(r["size"], []):
            pivots[r["size"]].append(r["vector"])
    found = {size: np.array(some) for size, some in pivots.items()}
    dealt = written(rows.mapInArrow(_nearest_pivot(found), "id long, size int, vector array<double>, cell int"), "m-tree-cells")
    # A row per pivot; a crowded cell becomes several shards, which the hash of the id tells apart.
    cells = dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("parts")).orderBy("cell").collect()
    first = np.cumsum([0, *(r["parts"] for r in cells)]).tolist()
    place = dealt.sparkSession.createDataFrame([(r["cell"], r["parts"], f) for r, f in zip(cells, first)], "cell int, parts int, first int")
    numbered = dealt.join(F.broadcast(place), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"), "size", "id", "vector"
    )
    sorted_rows = numbered.repartitionById(max(first[-1], 1), "shard").sortWithinPartitions("shard", "size")
    pages = written(sorted_rows.mapInArrow(giving_back(_build), _PAGES_DDL), "m-tree")
    discard(dealt)
    return pages


def _bounds(query: np.ndarray, roots: list[dict], centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the root of each shard, and the best score that the shard can hold."""
    own = float(query @ query)
    near = np.sqrt(np.maximum(((centers - query) ** 2).sum(axis=1), 0))
    norm = np.array([r["norm"] for r in roots])
    slack = 1e-9 * (own + norm) + 1e-6
    return near, (own + norm - np.maximum(near - [r["radius"] for r in roots], 0) ** 2) / 2 + slack


def _chosen(asked: DataFrame, roots: list[dict], first: bool) -> DataFrame:
    """(query_id, size, query, floor, shard): the nearest shard of each query, or all others that can reach its ``floor``."""
    by_size: dict[int, tuple[list[dict], np.ndarray]] = {}
    for size in {r["size"] for r in roots}:
        some = [r for r in roots if r["size"] == size]
        by_size[size] = some, np.array([np.frombuffer(r["center"]) for r in some])
    schema = pa.schema([("query_id", pa.int64()), ("size", pa.int32()), ("query", pa.list_(pa.float64())), ("floor", pa.float64()), ("shard", pa.int32())])
    shared = asked.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards = [], []
            columns = (batch.column(c).to_pylist() for c in ("size", "query", "floor", "home"))
            for i, (size, query, floor, home) in enumerate(zip(*columns)):
                if size not in shared.value:
                    continue
                some, centers = shared.value[size]
                near, most = _bounds(np.array(query), some, centers)
                if first:
                    picked = [int(np.argmin(near))]
                else:
                    able = most >= (-np.inf if floor is None else floor)
                    picked = [j for j in np.flatnonzero(able).tolist() if some[j]["shard"] != home]
                rows += [i] * len(picked)
                shards += [some[j]["shard"] for j in picked]
            taken = batch.select(["query_id", "size", "query", "floor"]).take(pa.array(rows, pa.int64()))
            for begin in range(0, taken.num_rows, 4096):
                part = taken.slice(begin, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shards[begin : begin + 4096], pa.int32())], schema=schema)

    return asked.select("query_id", "size", "query", "floor", "home").mapInArrow(run, "query_id long, size int, query array<double>, floor double, shard int")


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def tree_of(parts: list[pa.RecordBatch], size: int) -> Tree:
        pages = {}
        for part in parts:
            for row in part.select(["page", "leaf", "radius", "norm", "center", "entries", "distances", "vectors"]).to_pylist():
                row |= {"center": np.frombuffer(row["center"]), "entries": np.frombuffer(row["entries"], np.int64), "distances": np.frombuffer(row["distances"])}
                row["vectors"] = np.frombuffer(row["vectors"]).reshape(len(row["entries"]) if row["leaf"] else 0, size)
                pages[row["page"]] = row
        return Tree(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, tree = [], None, None
        for batch in batches:
            for (shard, block, size, asked), parts in _same_size([batch], "shard", "block", "size", "asked"):
                if (shard, block, size) != now:
                    held, now, tree = [], (shard, block, size), None
                if not asked:
                    held += parts
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree, held = tree_of(held, size), []
                found = []
                for part in parts:
                    queries = _vectors_of(part, "query").reshape(part.num_rows, size)
                    for name, q, floor in zip(part.column("query_id").to_pylist(), queries, part.column("floor").to_pylist()):
                        found += [(name, i, s) for s, i in tree.search(name, q, k, -np.inf if floor is None else floor)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return run


def _searched(pages: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of (query, shard) rows: the best k of the shard from the query's floor up.

    A shard that many queries chose is searched by several tasks, each with a block of them.
    """
    blocks = chosen.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("blocks"))
    copies = pages.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asked", F.lit(False))
    dealt = chosen.join(blocks, "shard").withColumns({"block": F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"), "asked": F.lit(True)})
    both = copies.drop("blocks").unionByName(dealt.drop("blocks"), allowMissingColumns=True)
    met = both.repartition(partitions(pages.sparkSession), "shard", "block").sortWithinPartitions("shard", "block", "size", "asked")
    return met.mapInArrow(giving_back(_search(k)), "query_id long, id long, score long")


def top_k(pages: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each usable query, ties to the smaller id.

    Rows that repeat a query id are one query, with the smallest of their vectors. A candidate with the query's id is
    passed over; with fewer than k candidates all are returned. Candidates that repeat an id are ranked each. Scores must
    stay below 2^53.
    """
    spark = pages.sparkSession
    asked = queries.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("query_id"), quantized(F.col(vector)).alias("query")
    )
    asked = asked.groupBy("query_id").agg(F.min("query").alias("query")).withColumn("size", F.size("query"))
    asked = written(asked.withColumns({"floor": F.lit(None).cast("double"), "home": F.lit(-1)}), "queries")
    root = pages.where("page = 0").select("shard", "size", "radius", "norm", "center")
    total = root.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("center") + 64), F.lit(0))).first()
    turns = max(1, -(-int(total[1]) // ROOT_BYTES))
    # At most about ROOT_BYTES of roots are on the driver at a time.
    some_roots = lambda t: root.where(F.pmod("shard", F.lit(turns)) == t).collect()
    homes = reduce(DataFrame.unionAll, [_chosen(asked, some_roots(t), True) for t in range(turns)])
    homes = written(homes, "home-shards")
    near = written(_searched(pages, homes, k), "near")
    worst = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    known = asked.drop("floor", "home").join(worst, "query_id", "left")
    # With several turns of roots a query has been in several shards; it is passed over again for the first only.
    known = known.join(homes.groupBy("query_id").agg(F.min("shard").alias("home")), "query_id", "left")
    known = written(known.select("query_id", "size", "query", "floor", "home"), "floors")
    others = reduce(DataFrame.unionAll, [_chosen(known, some_roots(t), False) for t in range(turns)])
    if turns > 1:
        others = others.join(homes.select("query_id", "shard"), ["query_id", "shard"], "left_anti").select(*others.columns)
    others = written(others, "other-shards")
    found = near.unionAll(_searched(pages, others, k))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
