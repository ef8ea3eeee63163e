"""The trie of conversation prefixes: a node for every distinct sequence of leading turns.

1. A turn is a token of 20 bytes: a digest of role and text and the number of code points of the text. A
   conversation is its tokens one after the other, so byte order is the order of token sequences and a prefix
   comes before what it begins.
2. Conversations are range-partitioned by (tokens, id); a group of copies is cut by id. A task takes them in
   sorted blocks of bounded size. A block is a padded matrix of turn ids, made a band of columns at a time for the rows
   that reach it: lexsort orders the rows, the changes from row to row, OR-accumulated over the
   columns, mark where nodes start, and reduceat sums the rows of all nodes of a depth. Sums over subtrees
   go back from the deepest column.
3. A node that is not on the path of the block's first or last row is complete. The others recombine: their
   parts are added by the digest of their prefix. For sums over subtrees every such node belongs to one path that has
   it; a path adds up its own nodes from its end, and the sums of all paths are added by node.
4. Ids that end at a node come as sorted stretches; a node's digest reads them one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentispark.llm.common import giving_back, partitions, written
from sentispark.scale import join_per_key

TOKEN = 20
BAND = 32
#: A block is closed at so many conversations or bytes of tokens.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 4 << 20
_NODE, _PATH, _ENDS = 0, 1, 2
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_OUT = pa.schema(
    [("kind", pa.int8()), ("node", pa.binary()), ("parent", pa.binary()), ("path", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("chars", *_COUNTS)]
    + [("ends", pa.string())]
)
_OUT_DDL = (
    "kind byte, node binary, parent binary, path string, conv_id long, depth long, parent_conv_id long, chars long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
_NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, tokens) of every conversation: its turns in order, a token of 20 bytes each.

    Turns go by number (null first), then role, then text; a null role or text is empty. Rows without a conversation are left
    out. A text is shuffled only where another turn of its conversation has the same number and role.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), said.alias("text")
    )
    # One place for two turns by chance does no harm: it only brings a text along.
    place = F.xxhash64("id", "turn", "role")
    ties = rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place", F.lit(True).alias("tied"))
    marked = join_per_key(rows.withColumn("place", place), ties, "place", "left")
    token = F.concat(F.md5(F.concat(F.md5("role"), "text")), F.lpad(F.hex(F.length("text")), 8, "0"))
    said = F.struct("turn", "role", F.when(F.col("tied"), F.col("text")).alias("text"), token.alias("token"))
    ordered = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["token"])
    return marked.select("id", said.alias("row")).groupBy("id").agg(F.unhex(F.array_join(ordered, "")).alias("tokens"))


def grafted(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose beginning is that of the first of their group of ids.

    With h = crc32(decimal id) % ``most``: the first h turns of conversation id - id % ``group`` (all if fewer, none if there
    is no such conversation), then the own turns after the first h.
    """
    rows = conversations.select(
        "id", "tokens", (F.col("id") - F.col("id") % group).alias("base"), (F.crc32(F.col("id").cast("string")) % most * TOKEN).cast("int").alias("cut")
    )
    heads = conversations.where(F.col("id") % group == 0).select(
        F.col("id").alias("base"), F.substring("tokens", 1, most * TOKEN).alias("head")
    )
    head = F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), F.col("cut"))
    own = F.substring("tokens", F.col("cut") + 1, F.length("tokens"))
    return rows.join(heads, "base", "left").select("id", F.concat(head, own).alias("tokens"))


def block_nodes(ids: np.ndarray, tokens: list[bytes]) -> list[dict]:
    """Nodes of a block by depth, from 1; the block's rows are numbered as they lie after sorting.

    Per depth: ``row``, the first row of each node; ``convs``, rows; ``least``, smallest id; ``chars`` of the last turn; ``parent``, its
    place in the depth before; ``children``; ``leaves`` and ``saved`` of the subtree. ``order`` of the first entry has the
    sorted rows.
    """
    lengths = np.array([len(t) // TOKEN for t in tokens], np.int64)
    flat = np.frombuffer(b"".join(tokens), f"S{TOKEN}")
    kinds, turn = np.unique(flat, return_inverse=True)
    chars = np.frombuffer(np.ascontiguousarray(kinds.view(np.uint8).reshape(-1, TOKEN)[:, TOKEN - 4 :]).tobytes(), ">u4").astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    # Rows alive at the band's first column, as they lie, and the node each is in: all at the root.
    rows, within = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    place = np.arange(len(ids))  # a row's place in the order as far as it is known
    levels: list[dict] = []
    depth = 0
    while len(rows):
        width = min(BAND, max(int(lengths[rows].max()) - depth, 1))
        matrix = np.zeros((len(rows), width), np.int64)
        for k in range(width):
            there = lengths[rows] > depth + k
            matrix[there, k] = turn[begins[rows[there]] + depth + k] + 1
        # Rows that end in the band come before those that go on, which the next band orders among themselves.
        goes_on = lengths[rows] > depth + width
        order = np.lexsort((ids[rows], goes_on, *matrix.T[::-1], within))
        places = np.sort(place[rows])
        rows, within, matrix, goes_on = rows[order], within[order], matrix[order], goes_on[order]
        place[rows] = places
        change = np.ones((len(rows), width), bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= within[1:] != within[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for k in range(width):
            alive = matrix[:, k] > 0
            if not alive.any():
                break
            starts = np.flatnonzero(change[:, k])
            sizes = np.diff(np.append(starts, len(rows)))
            least = np.minimum.reduceat(ids[rows], starts)
            node = alive[starts]
            first = starts[node]
            levels.append(
                {
                    "row": place[rows[first]],
                    "convs": sizes[node],
                    "least": least[node],
                    "chars": chars[matrix[first, k] - 1],
                    "parent": within[first],
                }
            )
            within = np.where(alive, np.cumsum(change[:, k] & alive) - 1, -1)
        rows, within = rows[goes_on], within[goes_on]
        depth += width
    below = None
    for level in reversed(levels):
        count = len(level["row"])
        children, leaves, saved = np.zeros(count, np.int64), np.zeros(count, np.int64), (level["convs"] - 1) * level["chars"]
        if below is not None:
            np.add.at(children, below["parent"], 1)
            np.add.at(leaves, below["parent"], below["leaves"])
            np.add.at(saved, below["parent"], below["saved"])
        level |= {"children": children, "leaves": np.where(children == 0, 1, leaves), "saved": saved}
        below = level
    return [{"order": np.argsort(place, kind="stable"), "row": np.zeros(0, np.int64)}, *levels]


def _prefixes(tokens: bytes) -> list[bytes]:
    """Digest of every prefix, the empty one first."""
    running = hashlib.blake2b(digest_size=16)
    out = [running.digest()]
    for at in range(0, len(tokens), TOKEN):
        running.update(tokens[at : at + TOKEN])
        out.append(running.copy().digest())
    return out


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading turns two conversations share."""
    most = min(len(a), len(b)) // TOKEN
    x, y = np.frombuffer(a, f"S{TOKEN}", most), np.frombuffer(b, f"S{TOKEN}", most)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else most


def _block(ids: np.ndarray, tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Complete nodes of a block, the parts of the others with the paths they lie on, and stretches of ids that end at those."""
    head, *levels = block_nodes(ids, tokens)
    order = head["order"]
    ids, tokens = ids[order], [tokens[i] for i in order]
    lengths = np.array([len(t) // TOKEN for t in tokens], np.int64)
    names = np.char.mod("%d", ids)
    last = len(ids) - 1
    paths = [_prefixes(tokens[0]), _prefixes(tokens[last])]
    common = _shared(tokens[0], tokens[last])

    # Rows ending at one node follow one another: copies, ordered by id.
    copies = np.concatenate([[True], np.array([x != y for x, y in zip(tokens[1:], tokens[:-1])], bool)])
    runs = np.flatnonzero(copies)
    run_ends = np.append(runs[1:], len(ids))
    ending = {}  # (depth, first row) -> joined ids
    for b, e in zip(runs.tolist(), run_ends.tolist()):
        ending[int(lengths[b]), b] = ",".join(names[b:e].tolist())

    def rows_of(depth: int, level: dict) -> Iterator[pa.RecordBatch]:
        first_end = level["row"] + level["convs"]
        edge = np.zeros(len(level["row"]), bool)
        if depth < len(paths[0]):
            edge |= level["row"] == 0
        if depth < len(paths[1]):
            edge |= first_end == last + 1
        done = np.flatnonzero(~edge)
        if len(done):
            above = levels[depth - 2] if depth > 1 else None
            parent = level["parent"][done]
            if above is None:
                at_edge, parent_id = np.ones(len(done), bool), np.zeros(len(done), np.int64)
            else:
                at_edge, parent_id = above["edge"][parent], above["least"][parent]
            parents = None
            if at_edge.any():
                # The parent is on the first path if it has row 0, else on the last.
                on_first = np.ones(len(done), bool) if above is None else above["row"][parent] == 0
                parents = [(paths[0] if f else paths[1])[depth - 1] if e else None for e, f in zip(at_edge.tolist(), on_first.tolist())]
            digests = []
            for r in level["row"][done].tolist():
                joined = ending.get((depth, r))
                digests.append(_NOTHING if joined is None else hashlib.sha256(joined.encode()).hexdigest())
            n = len(done)
            columns = {
                "kind": np.full(n, _NODE, np.int8),
                "parent": parents or [None] * n,
                "conv_id": level["least"][done],
                "depth": np.full(n, depth),
                "parent_conv_id": pa.array(parent_id, pa.int64(), mask=at_edge),
                "chars": level["chars"][done],
                "n_convs": level["convs"][done],
                "n_children": level["children"][done],
                "n_leaves": level["leaves"][done],
                "saved_tokens": level["saved"][done],
                "ends": digests,
            }
            yield _batch(columns, n)
        level["edge"] = edge

    def path_rows(side: int) -> list[dict]:
        """The nodes of a path; what the block holds of a node is counted on the first path that has it."""
        name = f"{ids[0 if side == 0 else last]}:{side}"
        out = []
        for depth, node in enumerate(paths[side]):
            row = {"kind": _PATH, "node": node, "parent": paths[side][depth - 1] if depth else None, "path": name, "depth": depth}
            row |= {"conv_id": None, "chars": 0, **dict.fromkeys(_COUNTS, 0)}
            counted = side == 1 and depth <= common
            if depth:
                level = levels[depth - 1]
                place = 0 if side == 0 else len(level["row"]) - 1
                row |= {"conv_id": int(level["least"][place]), "chars": int(level["chars"][place])}
            else:
                row["conv_id"] = int(ids.min())
            if not counted:
                row["n_convs"] = int(levels[depth - 1]["convs"][place]) if depth else len(ids)
                below = levels[depth] if depth < len(levels) else None
                if below is not None:
                    mine = (below["parent"] == (place if depth else 0)) & ~below["edge"]
                    row["n_children"] = int(mine.sum())
                    row["n_leaves"], row["saved_tokens"] = int(below["leaves"][mine].sum()), int(below["saved"][mine].sum())
            out.append(row)
        return out

    for depth, level in enumerate(levels, 1):
        yield from rows_of(depth, level)
    rows = path_rows(0) + path_rows(1)
    # Ids that end at a node of either path.
    for (depth, row), joined in ending.items():
        for side, at in ((0, 0), (1, last)):
            if tokens[at].startswith(tokens[row]):
                rows.append({"kind": _ENDS, "node": paths[side][depth], "conv_id": int(ids[row]), "ends": joined})
                break
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in _OUT.names} for r in rows[at : at + 4096]], schema=_OUT)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    filled = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT]
    return pa.RecordBatch.from_arrays(filled, schema=_OUT)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, tokens, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            tokens.append(t)
            size += len(t)
            if len(ids) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield from _block(np.array(ids, np.int64), tokens)
                ids, tokens, size = [], [], 0
    if ids:
        yield from _block(np.array(ids, np.int64), tokens)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the joined ids of every node; its stretches come one after the other, in the order of ids."""
    node, running = None, None
    schema = pa.schema([("node", pa.binary()), ("ends", pa.string())])

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"node": node, "ends": running.hexdigest()}], schema=schema)

    for batch in batches:
        for n, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node:
                if running is not None:
                    yield done()
                node, running = n, hashlib.sha256(joined.encode())
            else:
                running.update(b"," + joined.encode())
    if running is not None:
        yield done()


def build_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie over (id, tokens): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0 and all conversations as members, also those without turns. ``n_leaves`` counts the childless nodes of a
    subtree, its top included; ``saved_tokens`` adds, over a subtree, (members - 1) times the code points of a node's last
    turn; ``ends_sha256`` is the digest of the ids of the members that end at the node, ascending, joined by commas.
    Ids are distinct and not null. Without conversations there are no nodes. A conversation fits a task: 20 bytes a turn.
    """
    parts = partitions(conversations.sparkSession)
    sorted_rows = conversations.repartitionByRange(parts, "tokens", "id").sortWithinPartitions("tokens", "id")
    found = written(sorted_rows.select("id", "tokens").mapInArrow(giving_back(_blocks), _OUT_DDL), "trie")
    paths = found.where(F.col("kind") == _PATH)
    summed = written(
        paths.groupBy("node").agg(
            F.first("parent").alias("parent"),
            F.min("path").alias("owner"),
            F.min("conv_id").alias("conv_id"),
            F.first("depth").alias("depth"),
            F.first("chars").alias("chars"),
            *[F.sum(c).alias(c) for c in _COUNTS],
        ),
        "trie-paths",
    )
    inner = summed.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    counted = summed.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    # What a node itself adds to the subtrees it is in: complete subtrees right below it, and its own.
    own = counted.select(
        *["node", "owner", "parent", "depth", "conv_id", "n_convs", "n_children"],
        (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    own = written(own, "trie-own")
    steps = join_per_key(paths.select("path", "node", "depth"), own.select("node", "owner", "leaves", "saved"), "node")
    upward = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = lambda c: F.sum(F.when(F.col("path") == F.col("owner"), F.col(c)).otherwise(0)).over(upward)
    subtrees = (
        steps.select("node", mine("leaves").alias("leaves"), mine("saved").alias("saved"))
        .groupBy("node")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    stretches = found.where(F.col("kind") == _ENDS).select("node", "conv_id", "ends")
    ordered = stretches.repartition(parts, "node").sortWithinPartitions("node", "conv_id").select("node", "ends")
    ends = ordered.mapInArrow(_end_digests, "node binary, ends string")
    least = own.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_id"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    edge = (
        own.select("node", "parent", "depth", "conv_id", "n_convs", "n_children")
        .join(subtrees, "node")
        .join(ends.withColumnRenamed("ends", "ends_sha256"), "node", "left")
        .join(least.withColumnRenamed("parent_id", "parent_conv_id"), "parent", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
        .select(*final)
    )
    whole = found.where(F.col("kind") == _NODE).withColumnRenamed("ends", "ends_sha256")
    inside = whole.where(F.col("parent").isNull()).select(*final)
    # The root's children are many rows of one key.
    below = join_per_key(whole.where(F.col("parent").isNotNull()), least, "parent").withColumn("parent_conv_id", F.col("parent_id")).select(*final)
    return inside.unionByName(below).unionByName(edge)
