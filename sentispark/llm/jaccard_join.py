"""Near-duplicate join: documents whose word-shingle sets have a Jaccard index of at least a threshold.

1. Every document becomes a set of 56-bit shingle hashes; ``repeated_keys`` tells which of them
   other documents have too. Only those can be shared, and a document with too few of them can
   have no partner.
2. Equal sets are one class with one representative.
3. A representative's rarest shared shingles (enough that two partners must have one in common)
   put it into tiles: one per shingle and band of set sizes; a set near the upper border of its band is in
   the band above too, as partners differ in size by the threshold at most.
4. Each representative is first checked with one member of the tiles it shares most: the one with the fewest
   shingles of its own, then, a few times, one of another component. The links so found contract groups
   of near copies without looking at all their pairs.
5. Pairs of a tile that are not linked yet must pass the bound by sizes and by hashed bitmaps
   (the bits in which two bitmaps differ bound the overlap from above), then the exact
   intersection of the sorted sets. Tiles of many rows are cut into blocks that meet pairwise.

Links are joined to components; no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import discard, giving_back, id_and_text, written
from sentispark.llm.components import components
from sentispark.llm.repeated import mix, repeated_keys

_WORDS = 16  # 64-bit words of a bitmap
_TILE = 256  # rows of a tile that meet in one group
_WIDTH = 4  # a band spans this power of the largest ratio between the sizes of partners
_ROUNDS = 6  # contractions before the pairs that are left are enumerated


def shingles_of(size: int):
    """Shingle hashes of texts: ``size`` words each; a text of fewer words is one shingle."""
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        offsets = np.asarray(lists.offsets, np.int64)
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        index = np.asarray(coded.indices, np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        filled = np.fromiter((len(w) > 0 for w in names), bool, len(names))[index]
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[index][filled]
        owner = owner[filled]
        counts = np.bincount(owner, minlength=len(texts))
        many = np.full(max(len(hashed) - size + 1, 0), size, np.uint64)
        for k in range(size):
            many += hashed[k : k + len(many)] * weights[k]
        whole = owner[: len(many)] == owner[size - 1 :][: len(many)]
        docs, keys = [owner[: len(many)][whole]], [many[whole]]
        begins = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < size))
        for i in short.tolist():
            n = int(counts[i])
            docs.append(np.array([i]))
            keys.append(np.array([(hashed[begins[i] : begins[i] + n] * weights[:n]).sum() + np.uint64(n)], np.uint64))
        # The last byte is left out: sorted and byte by byte, it would cost the exchange as much as all others but one.
        docs, keys = np.concatenate(docs), mix(np.concatenate(keys)) & ~np.uint64(255)
        if len(short):
            order = np.argsort(docs, kind="stable")
            docs, keys = docs[order], keys[order]
        return docs, keys

    return keys_of


def _set_meta(docs: np.ndarray, keys: np.ndarray, count: int) -> list[bytes]:
    """Set size and a 128-bit digest that does not depend on the order."""
    sums = np.zeros((3, count), np.uint64)
    sums[0] = np.bincount(docs, minlength=count)
    np.add.at(sums[1], docs, mix(keys ^ np.uint64(0x5851F42D4C957F2D)))
    np.add.at(sums[2], docs, mix(keys + np.uint64(0x9E3779B97F4A7C15)))
    return [row.tobytes() for row in np.ascontiguousarray(sums.T.astype(">u8"))]


def profiles(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """(id, n, digest, keys, classes): the set of every document; keys only where partners may exist."""
    found = repeated_keys(id_and_text(docs, key, text), shingles_of(words), _set_meta)
    sized = found.select(
        "id", F.conv(F.hex(F.substring("meta", 1, 8)), 16, 10).cast("long").alias("n"), F.substring("meta", 9, 16).alias("digest"), "keys", "classes"
    )
    able = (F.col("n") > 0) & (F.octet_length("keys") / 8 * 100 >= percent * F.col("n"))
    return sized.select("id", "n", "digest", *[F.when(able, F.col(c)).alias(c) for c in ("keys", "classes")])


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """(h, band, id, n, m): the tiles of each set; m counts its shared shingles."""
    step = _WIDTH * np.log(100 / percent)
    schema = pa.schema([("h", pa.int64()), ("band", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, n, packed, ranks in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "keys", "classes"))):
                keys, ranks = np.frombuffer(packed, np.uint64), np.frombuffer(ranks, np.uint16)
                lead = n - (percent * n + 99) // 100 + 1 - (n - len(keys))
                if lead <= 0:
                    continue
                chosen = keys[np.lexsort((keys, ranks))[:lead]].view(np.int64)
                # The set's own band, and the next if partners may be there. The slack is for rounding.
                bands = {int(np.log(n) / step), int(np.log(n) / step + 1 / _WIDTH + 1e-9)}
                for b in bands:
                    row = np.empty((5, len(chosen)), np.int64)
                    row[:] = [[0], [b], [i], [n], [len(keys)]]
                    row[0] = chosen
                    out.append(row)
            if out:
                table = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(table, schema)], schema=schema)

    return sets.mapInArrow(giving_back(run), "h long, band int, id long, n long, m long")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(id, b0 .. b15): hashed bitmap of the shared shingles."""
    schema = pa.schema([("id", pa.int64())] + [(f"b{k}", pa.int64()) for k in range(_WORDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, _WORDS), np.uint64)
            for row, packed in enumerate(batch.column("keys").to_pylist()):
                at = (np.frombuffer(packed, np.uint64) >> np.uint64(8)) % np.uint64(64 * _WORDS)
                np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            columns = [batch.column("id"), *(pa.array(c.view(np.int64).copy()) for c in bits.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return sets.mapInArrow(giving_back(run), ", ".join(["id long", *(f"b{k} long" for k in range(_WORDS))]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are partners, with their overlap."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("overlap", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, v, nu, nv, ku, kv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "nu", "nv", "ku", "kv"))):
                both = len(np.intersect1d(np.frombuffer(ku, np.uint64), np.frombuffer(kv, np.uint64), assume_unique=True))
                if 100 * both >= percent * (nu + nv - both):
                    out.append((u, v, both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    return joined.select("u", "v", "nu", "nv", "ku", "kv").mapInArrow(giving_back(run), "u long, v long, overlap long")


def _may_link(percent: int, a: str, b: str, bits: bool):
    """Bound of the overlap from above against what the sizes ask for."""
    shared = F.col(f"{a}m") + F.col(f"{b}m")
    least = F.least(f"{a}m", f"{b}m") * 2
    if bits:
        differ = sum((F.bit_count(F.col(f"{a}b{k}").bitwiseXOR(F.col(f"{b}b{k}"))) for k in range(_WORDS)), F.lit(0))
        least = F.least(least, shared - differ)
    return (100 + percent) * least >= 2 * percent * (F.col(f"{a}n") + F.col(f"{b}n"))


def _best_partner(pairs: DataFrame) -> DataFrame:
    """Of the tile mates (u, v) of each set, the one met in most tiles, ties to the smaller id."""
    met = pairs.groupBy("u", "v").agg(F.count("*").alias("times"))
    return met.groupBy("u").agg(F.max_by("v", F.struct("times", F.negative("v"))).alias("v"))


def _contracted(label: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after the links ``found`` (u, v) between sets: only links between different labels are looked at."""
    name = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"{x}_label"))
    between = found.join(name("u"), "u", "left").join(name("v"), "v", "left")
    ends = between.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    merged = components(ends)
    # Sets that had no link before are their own label.
    rest = merged.join(label.select("id"), "id", "left_anti").select("id", "component")
    moved = label.join(merged.select(F.col("id").alias("old"), F.col("component").alias("new")), F.col("component") == F.col("old"), "left")
    # A component without new links keeps its label; one with links has the smallest of them.
    return moved.select("id", F.coalesce("new", "component").alias("component")).union(rest)


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the distinct ``sets`` that have partners."""
    tiles_of = written(_entries(sets, percent), "tiles")
    # The member with the fewest shingles of its own is most like what the others were copied from.
    heads = tiles_of.groupBy("h", "band").agg(F.min(F.struct(F.col("n") - F.col("m"), "id")).alias("head"), F.count("*").alias("size"))
    heads = heads.where("size > 1").select("h", "band", F.col("head.id").alias("v"))
    mates = tiles_of.join(heads, ["h", "band"]).where(F.col("id") != F.col("v")).select(F.col("id").alias("u"), "v")
    label = written(components(_verified(_best_partner(mates), sets, percent).select("u", "v")), "labels")
    used = [tiles_of, label]
    for turn in range(_ROUNDS + 1):
        named = tiles_of.join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        # A member of the first and of the last component of a tile, others in each round.
        member = F.struct("label", F.xxhash64("id", F.lit(turn)).alias("rank"), "id")
        mixed = named.groupBy("h", "band").agg(F.min(member).alias("a"), F.max(member).alias("z"), F.count("*").alias("size"))
        mixed = mixed.where("a.label <> z.label").select(
            "h", "band", F.col("a.label").alias("a_label"), F.col("a.id").alias("a"), F.col("z.id").alias("z"),
            F.ceil(F.col("size") / _TILE).cast("int").alias("blocks"),
        )
        mixed = written(mixed, "mixed-tiles")
        used.append(mixed)
        if turn == _ROUNDS:
            break
        other = F.when(F.col("label") != F.col("a_label"), F.col("a")).otherwise(F.col("z"))
        mates = named.join(mixed, ["h", "band"]).select(F.col("id").alias("u"), other.alias("v"))
        found = written(_verified(_best_partner(mates), sets, percent).select("u", "v"), "links")
        used.append(found)
        if found.isEmpty():
            break
        label = written(_contracted(label, found), "labels")
        used.append(label)
    left = named.join(mixed.select("h", "band", "blocks"), ["h", "band"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    left = left.select("h", "band", "i", "j", "id", "n", "m", "label").join(_bitmaps(sets), "id")
    grid = written(left, "tile-rows")
    side = lambda x: grid.select("h", "band", "i", "j", *[F.col(c).alias(f"{x}{c}") for c in grid.columns if c not in ("h", "band", "i", "j")])
    pairs = (
        side("u_")
        .join(side("v_"), ["h", "band", "i", "j"])
        .where((F.col("u_id") < F.col("v_id")) & (F.col("u_label") != F.col("v_label")))
        .where(_may_link(percent, "u_", "v_", False))
        .where(_may_link(percent, "u_", "v_", True))
        .select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
        .distinct()
    )
    # Written before what it is made from goes.
    linked = written(_contracted(label, _verified(pairs, sets, percent).select("u", "v")), "components")
    discard(*used, grid)
    return linked


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component): set size and smallest id reachable by links, of every id of ``docs``.

    Words are separated by ASCII white space, A-Z count as a-z. A text of fewer than ``words`` words is
    one shingle; a text without words (or null) has none and is linked with nothing. Rows without
    an id are left out; rows that repeat an id count as one document. Two sets are partners when
    100 * overlap >= ``percent`` * union. Hashes of 56 bits stand for shingles.
    """
    found = written(profiles(docs, words, percent, key, text), "profiles")
    sized = written(found.select("id", "n", "digest", F.col("keys").isNotNull().alias("able")), "set-sizes")
    first = sized.where("able").groupBy("digest").agg(F.min("id").alias("id"))
    sets = written(found.where("keys IS NOT NULL").join(first, ["digest", "id"], "left_semi"), "sets")
    discard(found)  # the keys are needed once per distinct set only
    linked = links(sets, percent)
    discard(sets)
    classes = first.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    rows = sized.select("id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    return rows.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
