"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

Every byte covered by a ``span``-byte string that also starts in a document with a smaller id goes.

1. Candidates. The least hash among a string's 24-byte substrings depends on the string alone, so equal
   strings share it. ``repeated_keys`` tells which of these values more than one document has;
   strings with another value occur in one document only. Documents that are whole copies of an
   earlier one are known by their digest and take no further part.
2. Neighbouring strings with the same value form one segment of text. Segments go to the part of
   their value, so that equal strings meet; equal segments of one task are sent once, for their
   first document, hence a passage that a third of all documents share costs one row per task.
   At the ends of such a passage segments reach into each document's own text, all different with one
   value. A new segment whose value very many documents have is therefore sent as its single strings, by their
   128-bit digests, each to the part of its own: no part gets all segments of such a value.
3. In a part, segments equal as a whole are settled by their first document. The rest, different
   segments with one value, are dealt into shards. Each shard sorts its own suffixes once and
   keeps its Burrows-Wheeler transform; the transforms are merged by refining their interleave a
   character at a time, which gives the common prefixes. After ``span`` rounds every block of the
   interleave is one repeated string: the later documents of a block lose it.
4. The spans of a document are united and cut out of its text.

All comparisons are between the input texts, not what is left of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentispark.llm.common import giving_back, id_and_text, partitions, slices, written
from sentispark.llm.repeated import _grouped_rows, _split, bucket_of, mix, part_of, repeated_keys

_GRAM = 24
_CHUNK = 1 << 19
_SEEN = 300_000
_SHARDS = 8
#: Letters from which on the values gathered so far are merged.
_MERGED = 1 << 17
#: Bytes of the digest by which single strings of crowded values are compared (shorter than any segment).
_DIGEST = 16
#: Documents with one value from which its segments are sent as single strings; hot keys are above it.
_CROWD = 1000


def _window_minima(data: np.ndarray, span: int) -> np.ndarray:
    """For each start of a ``span``-byte window, the least hash of its 24-byte substrings."""
    rolled = mix(np.arange(1, 257, dtype=np.uint64))[data]
    odd = mix(np.arange(301, 306, dtype=np.uint64)) | np.uint64(1)
    for k, size in enumerate((1, 2, 4)):
        rolled = rolled[:-size] * odd[k] + rolled[size:]
    eight, sixteen = rolled, rolled[:-8] * odd[3] + rolled[8:]
    least = mix(sixteen[:-8] * odd[4] + eight[16:])
    width, reach = span - _GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    # The last byte is left out: it would cost the exchange of sorted values as much as most others.
    return np.minimum(least[: len(least) - (width - reach)], least[width - reach :]) & ~np.uint64(255)


def minima_spread(span: int):
    """The distribution of segment values, which makes them uniform.

    A hash x (as a part of the range) is the least of some window of w if the hashes beside it leave it w - 1 larger ones in a row:
    with q = 1 - x that has the probability q^(w-1) * (1 + (w-1) * x), whose integral, normalised, is this.
    """
    w = span - _GRAM + 1

    def spread(values: np.ndarray) -> np.ndarray:
        q = 1.0 - values / 2.0**64
        return np.clip(1.0 - (w + 1) / 2 * q**w + (w - 1) / 2 * q ** (w + 1), 0.0, 1.0)

    return spread


def _segments(texts: pa.Array, span: int) -> tuple[np.ndarray, ...]:
    """Bytes of all texts; per segment its text, first and last start of a string, value; offsets of the texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begins, ends = offsets[:-1], offsets[1:] - span + 1
    long = ends > begins
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begins[long]] = 1
    edge[ends[long]] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    firsts, lasts, values = [], [], []
    for at in range(0, len(data) - span + 1, _CHUNK):
        least = _window_minima(data[at : at + _CHUNK + span - 1], span)
        ok = valid[at : at + len(least)]
        differs = least[1:] != least[:-1]
        starts = ok.copy()
        starts[1:] &= ~ok[:-1] | differs
        stops = ok.copy()
        stops[:-1] &= ~ok[1:] | differs
        first = np.flatnonzero(starts)
        firsts.append(first + at)
        lasts.append(np.flatnonzero(stops) + at)
        values.append(least[first])
    join = lambda x, t: np.concatenate([np.empty(0, t), *x])
    firsts, lasts = join(firsts, np.int64), join(lasts, np.int64)
    return data, np.searchsorted(offsets, firsts, "right") - 1, firsts, lasts, join(values, np.uint64), offsets


def _united(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (begin, end) rows made one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], axis=1)


_SENT = pa.schema(
    [("part", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("begins", pa.binary()), ("sizes", pa.binary()), ("letters", pa.binary())]
)
_PACKED = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("spans", pa.binary())])
_SPANS = pa.schema([("id", pa.int64()), ("found", pa.binary())])


def _candidates(batch: pa.RecordBatch) -> pa.RecordBatch:
    # Rows set apart have keys if their id has them; here and not as a filter of the plan, for the sake of the shuffle below.
    taken = pc.is_valid(batch.column("keys"))
    return batch.filter(pc.and_(taken, pc.is_null(batch.column("copy"))) if "copy" in batch.schema.names else taken)


def _sender(span: int, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: dict[bytes, int] = {}
        for piece in slices(map(_candidates, batches), "text", 2 << 20):
            ids = piece.column(0).to_numpy()
            repeated, index = np.unique(np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint64), return_index=True)
            crowded = np.frombuffer(b"".join(piece.column("classes").to_pylist()), np.uint16)[index] > _CROWD
            data, owner, first, last, value, offsets = _segments(piece.column(1), span)
            at = np.minimum(np.searchsorted(repeated, value), max(len(repeated) - 1, 0))
            held = np.flatnonzero(repeated[at] == value) if len(repeated) else np.empty(0, np.int64)
            letters = data.tobytes()
            gone: dict[int, list] = {}
            kept = []  # (text, begin, end, value, digest if it stands for the string) of what is sent
            hot = crowded[at[held]] if len(repeated) else np.empty(0, bool)
            for o, b, e, v, single in zip(*(x.tolist() for x in (owner[held], first[held], last[held], value[held], hot))):
                if len(seen) > _SEEN:
                    seen = {}
                text = letters[b : e + span]
                known = seen.setdefault(text, ids[o])
                if known < ids[o]:
                    gone.setdefault(o, []).append((b - offsets[o], e + span - offsets[o]))
                elif not single:
                    kept.append((o, b, e + span, v, None))
                else:
                    for w in range(b, e + 1):
                        text = letters[w : w + span]
                        known = seen.setdefault(text, ids[o])
                        if known < ids[o]:
                            gone.setdefault(o, []).append((w - offsets[o], w + span - offsets[o]))
                        else:
                            digest = xxhash.xxh3_128_digest(text)
                            kept.append((o, w, w + span, int.from_bytes(digest[:8], "little"), digest))
            for bucket, *packed in _packed_spans(((ids[o], _united(np.array(found, np.int64))) for o, found in gone.items()), parts):
                yield bucket, packed[0], b"", packed[2], packed[1], b""
            if not kept:
                continue
            owners, froms, ends = np.array([x[:3] for x in kept], np.int64).T
            values = np.array([x[3] for x in kept], np.uint64)
            digests = [x[4] for x in kept]
            sizes = np.where([d is None for d in digests], ends - froms, -span)
            del kept
            for p, some in _split(part_of(mix(values), parts), parts):
                yield (
                    p,
                    ids[owners[some]].tobytes(),
                    # Half a value tells the values of a part apart as far as needed: more in common only means more to merge.
                    (values[some] >> np.uint64(32)).astype(np.uint32).tobytes(),
                    (froms - offsets[owners])[some].astype(np.int32).tobytes(),
                    sizes[some].astype(np.int32).tobytes(),
                    b"".join(digests[i] or letters[froms[i] : ends[i]] for i in some.tolist()),
                )

    return lambda batches: _grouped_rows(rows(batches), _SENT)


def shard_transform(segments: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard, and segment and offset of each sorted suffix.

    Letters are bytes plus one (UTF-8 has no 255), 0 ends a segment.
    """
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8) + np.uint8(1)
    padded = np.concatenate([text, text[: depth + 8], np.zeros(max(0, depth + 8 - len(text)), np.uint8)])
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth + 8)[: len(text)])
    order = np.argsort(windows.view(f"S{depth + 8}").ravel(), kind="stable")
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins, order, "right") - 1
    return text[order - 1], owner, order - begins[owner]


def merged_blocks(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: for each merged row its row in the joined transforms, and the common prefix with the row before, up to ``depth``.

    The interleave starts as the shards one after the other. A round reads each shard's letters in
    the order of the interleave and sorts the rows stably by them; after h rounds the rows are in
    the order of their first h letters. Borders between different prefixes never move.
    """
    letters = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block = np.zeros(len(letters), np.int32)
    common = np.full(len(letters), depth, np.int32)
    read = np.empty_like(letters)
    for h in range(depth):
        read[np.argsort(shard, kind="stable")] = letters
        order = np.argsort(read, kind="stable")
        read_now, block_now = read[order], block[order]
        border = np.empty(len(order), bool)
        border[:1] = True
        border[1:] = (read_now[1:] != read_now[:-1]) | (block_now[1:] != block_now[:-1])
        common[border & (common == depth)] = h
        shard, block = shard[order], np.cumsum(border, dtype=np.int32)
    # The stable sort lists a shard's merged places in order; its k-th place holds its k-th row.
    place = np.argsort(shard, kind="stable")
    rows = np.empty(len(letters), np.int64)
    rows[place] = np.arange(len(letters))
    return rows, common


def later_starts(segments: list[bytes], docs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every ``span``-byte string that occurs in a segment of a smaller document."""
    count = min(_SHARDS, len(segments))
    dealt = [np.arange(k, len(segments), count) for k in range(count)]
    parts = [shard_transform([segments[i] for i in at], span) for at in dealt]
    owner = np.concatenate([at[p[1]] for at, p in zip(dealt, parts)])
    offset = np.concatenate([p[2] for p in parts])
    rows, common = merged_blocks([p[0] for p in parts], span)
    owner, offset = owner[rows], offset[rows]
    whole = np.array([len(s) for s in segments], np.int64)[owner] - offset >= span
    begins = np.flatnonzero(common < span)
    first = np.minimum.reduceat(docs[owner], begins)
    least = np.repeat(first, np.diff(np.append(begins, len(rows))))
    later = whole & (least < docs[owner])
    return owner[later], offset[later]


def _sharing(segments: list[bytes], docs: np.ndarray, span: int) -> np.ndarray:
    """Segments that have the hash of a ``span``-byte string in common with one of another document.

    Most segments with one value share no more than the 24 bytes that made it; they need no transform.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    odd = mix(np.arange(401, 433, dtype=np.uint64)) | np.uint64(1)
    power, reach = mix(np.arange(1, 257, dtype=np.uint64))[data], 1
    whole, done = None, 0
    rest = span
    while rest:
        if rest & 1:
            whole = power.copy() if whole is None else whole[: len(power) - done] * odd[reach.bit_length()] + power[done:][: len(whole)]
            done += reach
        rest >>= 1
        if rest:
            power, reach = power[:-reach] * odd[16 + reach.bit_length()] + power[reach:], 2 * reach
    hashes = mix(whole)
    counts = sizes - span + 1
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), counts)
    at = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    order = np.argsort(hashes[at], kind="stable")
    ordered, holder = hashes[at][order], docs[owner][order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    shared = np.minimum.reduceat(holder, first) < np.maximum.reduceat(holder, first)
    return np.unique(owner[order][np.repeat(shared, np.diff(np.append(first, len(order))))])


def _resolve(rows: list[tuple], span: int) -> Iterator[tuple]:
    """Spans that documents lose, from all segments of a part."""
    ids = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
    values = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
    begins = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]).astype(np.int64)
    sizes = [np.frombuffer(r[3], np.int32).astype(np.int64) for r in rows]
    numbers: dict[bytes, int] = {}
    number = np.empty(len(ids), np.int64)
    k = 0
    for r, size in zip(rows, sizes):
        end = 0
        for n in np.where(size > 0, size, _DIGEST).tolist():
            number[k] = numbers.setdefault(r[4][end : end + n], len(numbers))
            end += n
            k += 1
    sizes = np.abs(np.concatenate(sizes))
    segments = list(numbers)
    first = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(first, number, ids)
    whole = ids > first[number]
    lost = [np.stack([ids[whole], begins[whole], begins[whole] + sizes[whole]], axis=1)]
    value = np.empty(len(segments), np.uint32)
    value[number] = values
    _, group, members = np.unique(value, return_inverse=True, return_counts=True)
    # A digest stands for a whole string; there is nothing to merge.
    strings = np.array([len(x) != _DIGEST for x in segments], bool)
    mixed = np.flatnonzero((members[group] > 1) & strings)
    if len(mixed):
        mixed = mixed[_sharing([segments[i] for i in mixed], first[mixed], span)]
    found = []
    # Equal strings have one value, so values are merged a few at a time.
    mixed = mixed[np.argsort(group[mixed], kind="stable")]
    letters = np.cumsum([len(segments[i]) for i in mixed], dtype=np.int64)
    new_value = np.flatnonzero(np.diff(group[mixed])) + 1
    begin = 0
    for end in [*new_value.tolist(), len(mixed)]:
        if end == len(mixed) or letters[end - 1] - (letters[begin - 1] if begin else 0) >= _MERGED:
            some = mixed[begin:end]
            if len(some):
                which, offset = later_starts([segments[i] for i in some], first[some], span)
                found.append((some[which], offset))
            begin = end
    if found:
        which, offset = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(which, kind="stable")
        which, offset = which[order], offset[order]
        owners = np.flatnonzero(~whole)
        low, high = np.searchsorted(which, number[owners]), np.searchsorted(which, number[owners], "right")
        counts = high - low
        at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        begin = np.repeat(begins[owners], counts) + offset[at]
        lost.append(np.stack([np.repeat(ids[owners], counts), begin, begin + span], axis=1))
    lost = np.concatenate(lost)
    lost = lost[np.argsort(lost[:, 0], kind="stable")]
    cut = np.flatnonzero(np.diff(lost[:, 0])) + 1
    for some in np.split(lost, cut):
        if len(some):
            yield int(some[0, 0]), _united(some[:, 1:])


def _packed_spans(found: Iterable[tuple[int, np.ndarray]], parts: int) -> Iterator[tuple]:
    """(bucket, ids, numbers of spans, spans): a row per bucket of documents instead of one per document."""
    found = list(found)
    ids = np.array([i for i, _ in found], np.int64)
    for bucket, at in _split(bucket_of(ids, parts), parts):
        spans = [found[i][1] for i in at.tolist()]
        yield bucket, ids[at].tobytes(), np.array([len(s) for s in spans], np.int64).tobytes(), b"".join(s.tobytes() for s in spans)


def _receiver(span: int, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = []
        for batch in batches:
            for part, ids, values, begins, sizes, letters in zip(*(c.to_pylist() for c in batch.columns)):
                if values:
                    held.append((ids, values, begins, sizes, letters))
                else:
                    yield part, ids, sizes, begins
        if held:
            yield from _packed_spans(_resolve(held, span), parts)

    return lambda batches: _grouped_rows(rows(batches), _PACKED)


def _unite_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a bucket with all its spans."""
    owners, spans = [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)]
    for batch in batches:
        for _, ids, sizes, packed in zip(*(c.to_pylist() for c in batch.columns)):
            owners.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)))
            spans.append(np.frombuffer(packed, np.int64).reshape(-1, 2))
    owners, spans = np.concatenate(owners), np.concatenate(spans)
    order = np.argsort(owners, kind="stable")
    owners, spans = owners[order], spans[order]
    cuts = np.flatnonzero(np.diff(owners)) + 1
    rows = ((int(o[0]), _united(s).tobytes()) for o, s in zip(np.split(owners, cuts), np.split(spans, cuts)) if len(o))
    yield from _grouped_rows(rows, _SPANS)


def _cut(as_text: bool):
    def cut(text: str, copy: bool | None, found: bytes | None) -> tuple[int, int, bytes, bytes]:
        data = text.encode()
        if copy:
            spans = np.array([[0, len(data)]], np.int64)
        elif found and copy is None:
            spans = np.frombuffer(found, np.int64).reshape(-1, 2)
        else:
            return len(data), 0, b"", data
        edges = [0, *spans.ravel().tolist(), len(data)]
        kept = b"".join(data[b:e] for b, e in zip(edges[::2], edges[1::2]))
        return len(data), len(data) - len(kept), spans.tobytes(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 4 << 20):
            sizes, removed, spans, kept = zip(*map(cut, *(piece.column(c).to_pylist() for c in ("text", "copy", "found"))))
            kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.binary()), kept, piece.column("carried")],
                ["id", "n_bytes", "n_removed", "spans", "kept", "carried"],
            )

    return run


def _no_meta(docs: np.ndarray, keys: np.ndarray, count: int) -> list[bytes]:
    return [b""] * count


def remove_repeats(docs: DataFrame, span: int = 50, key: str = "doc_id", text: str = "text", as_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept, carried) of every row of ``docs``.

    ``spans``: packed pairs (begin, end) of the maximal removed runs; ``kept``: the remaining bytes, or as text
    without the parts of cut characters; ``carried``: the other columns of ``docs``, as a struct. A null
    text is empty; texts under ``span`` bytes lose nothing. Rows without an id lose nothing and
    are never a source. Rows that repeat an id are one document, whose text is the one with the smallest digest: rows with
    that text lose the same and nothing to one another; rows of the id with another text stay whole and are no source.
    ``span`` is at least 40.
    """
    if span < 40:
        raise ValueError("span must be at least 40 bytes")
    rows = id_and_text(docs, key, text)
    parts = 2 * partitions(docs.sparkSession)

    def keys_of(texts: pa.Array):
        _, owner, _, _, value, _ = _segments(texts, span)
        return owner, value

    digest = F.unhex(F.sha2("text", 256))
    every = rows.where("id IS NOT NULL").select("id", F.octet_length("text").alias("size"), digest.alias("digest"))
    every = written(every, "digests")
    several = every.groupBy("id").agg(F.min("digest").alias("main"), F.max("digest").alias("other")).where("main <> other").select("id", "main")
    several = written(several, "ids-of-several-texts")
    digests = every.where(F.col("size") >= span).join(several, "id", "left").where("main IS NULL OR digest = main").select("id", "digest")
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # From a table, so that adaptive execution can split the rows of a digest that very many share.
    firsts = written(firsts, "first-copies")
    copies = written(digests.join(firsts, "digest").where("id > first").select("id").distinct(), "copies")
    other = [F.col(c) for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("none")]
    whole = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*other).alias("carried")
    )
    # The texts are shuffled by id once; all three uses below read that exchange.
    base = whole.join(copies.withColumn("copy", F.lit(True)), "id", "left")
    if not several.isEmpty():
        # False: neither a copy nor compared.
        aside = F.col("main").isNotNull() & (digest != F.col("main"))
        base = base.join(several, "id", "left").withColumn("copy", F.when(aside, F.lit(False)).otherwise(F.col("copy"))).drop("main")
    found = repeated_keys(base, keys_of, _no_meta, skip="copy", spread=minima_spread(span)).where(F.octet_length("keys") > 0).select("id", "keys", "classes")
    sent = base.join(found, "id", "left").select("id", "text", "keys", "copy", "carried", "classes").mapInArrow(
        giving_back(_sender(span, parts)), "part int, ids binary, values binary, begins binary, sizes binary, letters binary"
    )
    lost = sent.repartitionById(parts, "part").mapInArrow(giving_back(_receiver(span, parts)), "bucket int, ids binary, sizes binary, spans binary")
    lost = lost.repartitionById(parts, "bucket").mapInArrow(giving_back(_unite_bucket), "id long, found binary")
    marked = base.join(lost, "id", "left")
    rows = marked.select("id", "text", "carried", "copy", "found")
    schema = rows.select("id").schema.add("n_bytes", "long").add("n_removed", "long").add("spans", "binary").add("kept", "string" if as_text else "binary")
    return rows.mapInArrow(giving_back(_cut(as_text)), schema.add(rows.schema["carried"]))
