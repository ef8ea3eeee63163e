"""Keys (64-bit hashes) that occur in more than one document, found by one exchange of packed keys.

A task hashes its documents, removes repeats within a document, sorts the keys and sends each
part of the key space as one packed row. The task of a part sees every holder of its keys, drops
those with a single holder and sends the others back, packed by bucket of documents. A key never
is a row of its own, so the cost is that of sorting the hashes.

Hot keys: a key held by more than ``HOT`` documents of one block is certainly repeated. Its holders
are then spread by block instead of meeting in the key's part, which only gets one mark per
block. Such keys form the last class, whatever their number of holders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sentispark.llm.common import giving_back, partitions, slices

HOT = 16
HOT_CLASS = np.uint16(65535)
_BLOCK_KEYS = 1_000_000
_BLOCK_DOCS = 60_000
_ENTRY = "part int, kind byte, ids binary, docs binary, keys binary"
_MARK = np.uint16(65535)
_META, _LISTED, _SPREAD = 0, 1, 2

#: From keys to numbers from 0 to 1, never descending, that lie evenly however the keys do.
Spread = Callable[[np.ndarray], np.ndarray]
#: From texts to a (text index, key) pair per occurrence, in the order of the texts.
KeysOf = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: From the distinct pairs of a block and its number of texts to a value for each text.
MetaOf = Callable[[np.ndarray, np.ndarray, int], list[bytes]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def part_by(spread: Spread | None, keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key: by its leading bits, or by ``spread`` where keys crowd. Parts are ranges, so sorted keys stay sorted in them."""
    return part_of(keys, parts) if spread is None else np.minimum((spread(keys) * parts).astype(np.int64), parts - 1)


def bucket_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mix(ids.astype(np.uint64)), parts)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each run of equal values."""
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return begins, np.diff(np.append(begins, len(ordered)))


def _block(ids: np.ndarray, docs: np.ndarray, keys: np.ndarray, meta_of: MetaOf, parts: int, salt: int, spread: Spread | None = None) -> Iterator[tuple]:
    """Packed rows of one block. ``docs`` are indices into ``ids``; a (document, key) pair may repeat."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    if len(keys):
        # The sort is stable and documents come in order, so repeats within one are neighbours.
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        keys, docs = keys[new], docs[new]
    meta = meta_of(docs, keys, len(ids))
    for b, at in _split(bucket_of(ids, parts), parts):
        yield b, _META, ids[at].tobytes(), np.array([len(meta[i]) for i in at], np.int64).tobytes(), b"".join(meta[i] for i in at)
    begins, sizes = _runs(keys)
    hot = np.repeat(sizes > HOT, sizes)
    marks = keys[begins[sizes > HOT]]
    listed, owners = np.concatenate([keys[~hot], marks]), np.concatenate([docs[~hot], np.full(len(marks), _MARK)]).astype(np.uint16)
    yield from _packed(part_by(spread, listed, parts), parts, _LISTED, ids, owners, listed)
    yield from _packed(part_of(mix(keys[hot] + np.uint64(salt)), parts), parts, _SPREAD, ids, docs[hot].astype(np.uint16), keys[hot])


def _split(where: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(where, kind="stable")
    ends = np.searchsorted(where[order], np.arange(parts), "right")
    begin = 0
    for p, end in enumerate(ends.tolist()):
        if end > begin:
            yield p, order[begin:end]
        begin = end


def _packed(where, parts: int, kind: int, ids, docs, keys) -> Iterator[tuple]:
    for p, at in _split(where, parts):
        some = docs[at]
        used = np.unique(some[some != _MARK])
        local = np.where(some == _MARK, _MARK, np.searchsorted(used, some)).astype(np.uint16)
        yield p, kind, ids[used].tobytes(), local.tobytes(), _by_place(keys[at])


def _by_place(keys: np.ndarray) -> bytes:
    """Ascending keys with their first bytes together, then their second ...: the leading ones compress."""
    return keys.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_places(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_WIRE = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary())])
_BACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("ids", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])


def _grouped_rows(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size > limit:
            yield _record(held, schema)
            held, size = [], 0
    if held:
        yield _record(held, schema)


def _sender(keys_of: KeysOf, meta_of: MetaOf, parts: int, wanted, spread: Spread | None):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, docs, keys, count = [], [], [], 0

        def flushed() -> Iterator[tuple]:
            salt = int(mix(ids[0][:1].astype(np.uint64))[0]) >> 1
            yield from _block(np.concatenate(ids), np.concatenate(docs), np.concatenate(keys), meta_of, parts, salt, spread)

        for piece in slices((b.filter(wanted(b)).select(["id", "text"]) for b in batches), "text", 4 << 20):
            for begin in range(0, piece.num_rows, _BLOCK_DOCS):
                some = piece.slice(begin, _BLOCK_DOCS)
                if ids and (count + some.num_rows > _BLOCK_DOCS or sum(map(len, keys)) > _BLOCK_KEYS):
                    yield from flushed()
                    ids, docs, keys, count = [], [], [], 0
                new_docs, new_keys = keys_of(some.column(1))
                ids.append(some.column(0).to_numpy(zero_copy_only=False))
                docs.append(new_docs + count)
                keys.append(new_keys)
                count += some.num_rows
        if ids:
            yield from flushed()

    return lambda batches: _grouped_rows(blocks(batches), _WIRE)


def _meet(rows: list[tuple], parts: int) -> Iterator[tuple]:
    """Holders of repeated keys of one part, packed by bucket of documents."""
    ids, keys, spread = [], [], []
    for kind, table, docs, packed in rows:
        table = np.append(np.frombuffer(table, np.int64), 0)
        local = np.frombuffer(docs, np.uint16)
        ids.append(np.where(local == _MARK, 0, table[np.minimum(local, len(table) - 1)]))
        keys.append(_from_places(packed))
        spread.append(np.where(local == _MARK, 2, int(kind == _SPREAD)).astype(np.int8))
    ids, keys, spread = np.concatenate(ids), np.concatenate(keys), np.concatenate(spread)
    listed = np.flatnonzero(spread != 1)
    order = listed[np.argsort(keys[listed], kind="stable")]
    begins, sizes = _runs(keys[order])
    marked = np.maximum.reduceat(spread[order], begins) == 2 if len(order) else np.empty(0, bool)
    classes = np.where(marked, HOT_CLASS, np.minimum(sizes, 65534)).astype(np.uint16)
    keep = (np.repeat(classes, sizes) > 1) & (spread[order] == 0)
    chosen = np.concatenate([order[keep], np.flatnonzero(spread == 1)])
    classes = np.concatenate([np.repeat(classes, sizes)[keep], np.full(int((spread == 1).sum()), HOT_CLASS)])
    ids, keys = ids[chosen], keys[chosen]
    order = np.argsort(ids, kind="stable")
    ids, keys, classes = ids[order], keys[order], classes[order]
    for b, at in _split(bucket_of(ids, parts), parts):
        begins, sizes = _runs(ids[at])
        yield b, _LISTED, ids[at][begins].tobytes(), sizes.astype(np.int64).tobytes(), keys[at].tobytes() + classes[at].tobytes()


def _receiver(parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, part = [], None
        for batch in batches:
            for p, kind, ids, docs, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == _META:
                    yield p, kind, ids, docs, keys
                    continue
                if p != part and held:
                    yield from _meet(held, parts)
                    held = []
                part = p
                held.append((kind, ids, docs, keys))
        if held:
            yield from _meet(held, parts)

    return lambda batches: _grouped_rows(rows(batches), _BACK)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    metas, ids, keys, classes, owners = [], [], [], [], []
    schema = pa.schema([("id", pa.int64()), ("meta", pa.binary()), ("keys", pa.binary()), ("classes", pa.binary())])
    for batch in batches:
        for _, kind, table, sizes, packed in zip(*(c.to_pylist() for c in batch.columns)):
            table, sizes = np.frombuffer(table, np.int64), np.frombuffer(sizes, np.int64)
            if kind == _META:
                ends = np.cumsum(sizes).tolist()
                metas += [(i, packed[e - n : e]) for i, e, n in zip(table.tolist(), ends, sizes.tolist())]
            else:
                n = len(packed) // 10
                owners.append(np.repeat(table, sizes))
                keys.append(np.frombuffer(packed, np.uint64, n))
                classes.append(np.frombuffer(packed, np.uint16, n, 8 * n))
    if not metas:
        return
    owners = np.concatenate([np.empty(0, np.int64), *owners])
    keys = np.concatenate([np.empty(0, np.uint64), *keys])
    classes = np.concatenate([np.empty(0, np.uint16), *classes])
    order = np.lexsort((keys, owners))
    owners, keys, classes = owners[order], keys[order], classes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    owners, keys, classes = owners[new], keys[new], classes[new]
    metas = sorted(dict(reversed(metas)).items())
    ids = np.array([i for i, _ in metas], np.int64)
    begins, ends = np.searchsorted(owners, ids).tolist(), np.searchsorted(owners, ids, "right").tolist()

    def rows():
        for (i, meta), b, e in zip(metas, begins, ends):
            yield i, meta, keys[b:e].tobytes(), classes[b:e].tobytes()

    yield from _grouped_rows(rows(), schema)


def repeated_keys(rows: DataFrame, keys_of: KeysOf, meta_of: MetaOf, skip: str | None = None, spread: Spread | None = None) -> DataFrame:
    """(id, meta, keys, classes) of every id of ``rows`` (id long, text string).

    ``keys``: the keys of the row that another row has too, packed and ascending; ``classes``: for
    each, its number of rows up to 65534, or 65535 for a hot key, the same wherever the key occurs.
    Rows without an id, and rows that have a value in the column ``skip``, are left out; rows that repeat an id make one row.
    ``spread`` is needed where keys are not uniform 64-bit hashes: it keeps the parts of the exchange even.
    """
    parts = 2 * partitions(rows.sparkSession)

    def wanted(batch: pa.RecordBatch) -> pa.Array:
        # Here and not as a filter of the plan, which would change a shuffle below that others use too.
        valid = pc.is_valid(batch.column("id"))
        return pc.and_(valid, pc.is_null(batch.column(skip))) if skip else valid

    sent = rows.mapInArrow(giving_back(_sender(keys_of, meta_of, parts, wanted, spread)), _ENTRY).repartitionById(parts, "part")
    met = sent.sortWithinPartitions("part").mapInArrow(giving_back(_receiver(parts)), "bucket int, kind byte, ids binary, sizes binary, keys binary")
    return met.repartitionById(parts, "bucket").mapInArrow(giving_back(_assemble), "id long, meta binary, keys binary, classes binary")
