"""Chunked Parquet tables whose content is named by one small file.

Every write puts its rows into folders of its own, ``write=<random number>/<chunk column>=<value>``, sorted, and then publishes
the next manifest: a JSON file that lists the (write, chunk) folders that count. Readers follow the newest manifest, so a
change of many chunks is seen whole or not at all, and what a crash leaves behind is read by nobody.
Folders that neither the newest manifest nor the one before names are deleted by the next change.
One writer at a time: of two that change the same manifest the second fails and leaves the table as the first made it.

Beside the rows lies a filter of their keys per folder: 64-bit words, a few bits of one word per key, made by a grouped
aggregate. It tells a batch which folders may hold its keys; those folders decide.

``compact`` packs the small files of a chunk into sorted ones of about ``target`` bytes. The manifest grows with the number
of folders, so with chunks once tables are compacted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StringType, StructType

from sentispark.scale import fits_broadcast
from sentispark.session import materialize

TARGET_BYTES = 128 << 20
DICTIONARY_BYTES = 64 << 20
#: How a folder names the chunk of rows whose chunk column is null.
NULL_CHUNK = "__HIVE_DEFAULT_PARTITION__"
#: Bits of the key filter per key, and values up to which a scan gets the keys themselves as a filter.
BITS, LISTED = 16, 500


@dataclass(frozen=True)
class Layout:
    """How a table lies: the chunk column of its rows, their order in files, the columns that make a key.

    With ``repeats`` long values that come again in a file, far from each other, are kept once in its dictionary.
    ``probe`` names the columns of the key that its filters are made of, where many keys agree in these; all of them without it.
    """

    chunk: str
    sort: tuple[str, ...]
    keys: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    repeats: bool = False
    probe: tuple[str, ...] = ()

    @property
    def probed(self) -> tuple[str, ...]:
        return self.probe or self.keys


@dataclass(frozen=True)
class Entry:
    """A folder: rows of one chunk from one write. ``batch`` is the micro-batch that wrote it, if any.

    ``rows`` counts what its filter holds, ``probe`` names the columns it is made of if these are not the whole key.
    """

    write: int
    chunk: str
    files: int
    size: int
    rows: int
    words: int
    batch: int | None = None
    probe: str = ""


@dataclass(frozen=True)
class Manifest:
    version: int = -1
    #: The chunk column and, as JSON, all columns.
    chunk: str | None = None
    schema: str | None = None
    entries: tuple[Entry, ...] = field(default=())
    #: Micro-batches up to this one have been merged and cannot be written again.
    merged: int = -1

    def folder(self, entry: Entry) -> str:
        return f"write={entry.write}/{self.chunk}={entry.chunk}"


class Files:
    """The table's folder in its file system, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def size(self, folder: str) -> tuple[int, int]:
        """Number and bytes of the data files of a folder."""
        found = [s for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().endswith(".parquet")]
        return len(found), sum(s.getLen() for s in found)

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file appears whole, and only if there is none of the name."""
        draft = self._at(f"{name.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has published {name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


_MANIFESTS = "_manifest"


def _load(files: Files, version: int) -> Manifest:
    raw = json.loads(files.text(f"{_MANIFESTS}/{version:012d}.json"))
    return Manifest(**{**raw, "entries": tuple(Entry(**e) for e in raw["entries"])})


def _versions(files: Files) -> list[int]:
    return [int(n[:-5]) for n in files.names(_MANIFESTS) if n.endswith(".json") and not n.startswith(".")]


def manifest_of(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest, or None where there is no table."""
    files = Files(spark, path)
    versions = _versions(files)
    return _load(files, versions[-1]) if versions else None


def _publish(spark: SparkSession, path: str, now: Manifest) -> None:
    files = Files(spark, path)
    now = replace(now, version=now.version + 1)
    raw = {**vars(now), "entries": [vars(e) for e in now.entries]}
    files.publish(f"{_MANIFESTS}/{now.version:012d}.json", json.dumps(raw))
    older = [v for v in _versions(files) if v < now.version]
    before = _load(files, older[-1]).entries if older else ()
    kept = {now.folder(e) for e in (*now.entries, *before)}
    writes = {folder.partition("/")[0] for folder in kept}
    for v in older[:-1]:
        for gone in {now.folder(e) for e in _load(files, v).entries} - kept:
            files.delete(gone)
        files.delete(f"{_MANIFESTS}/{v:012d}.json")
    # Whole writes that no manifest names any more, or that no manifest ever named.
    for folder in ("", "_filter"):
        for name in files.names(folder):
            if name.startswith("write=") and name not in writes:
                files.delete(f"{folder}/{name}" if folder else name)


def read_entries(spark: SparkSession, path: str, now: Manifest, entries: Iterable[Entry] | None = None) -> DataFrame:
    """Rows of the given folders (of all), without the ``write`` they came with; only these folders are listed."""
    return with_write(spark, path, now, entries).drop("write")


def with_write(spark: SparkSession, path: str, now: Manifest, entries: Iterable[Entry] | None = None) -> DataFrame:
    """``read_entries`` with the number of the write each row came with, as ``write``."""
    schema = StructType.fromJson(json.loads(now.schema)).add("write", LongType())
    chosen = now.entries if entries is None else tuple(entries)
    if not chosen:
        return spark.createDataFrame([], schema)
    folders = [f"{path.rstrip('/')}/{now.folder(e)}" for e in chosen]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the newest manifest, or None where there is no table."""
    now = manifest_of(spark, path)
    return None if now is None else read_entries(spark, path, now)


def _key_hash(layout: Layout) -> Column:
    return F.xxhash64(*layout.probed)


def _probe_name(layout: Layout) -> str:
    return ",".join(layout.probe)


def _whole(keys: Iterable[str]) -> Column:
    """A null is equal to nothing, so rows with one are in no filter."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).isNotNull()
    return found


def _word_and_mask(words: str) -> list[Column]:
    """The word of a key (from the upper half of its hash) and five bits in it (from the lower half)."""
    bits = [F.expr(f"shiftleft(1L, CAST(shiftright(_hash, {6 * k}) & 63 AS INT))") for k in range(5)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return [F.pmod(F.shiftrightunsigned("_hash", 32), F.col(words)).alias("_word"), mask.alias("_mask")]


def _stage(rows: DataFrame, path: str, layout: Layout, now: Manifest, batch: int | None) -> tuple[Manifest, list[Entry]]:
    """Write rows and their filter as the next write; nobody reads them until a manifest names them."""
    spark, files = rows.sparkSession, Files(rows.sparkSession, path)
    # A name no other writer can have taken.
    number = uuid.uuid4().int >> 66
    folder = f"{path.rstrip('/')}/write={number}"
    writer = rows.sortWithinPartitions(layout.chunk, *layout.sort).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000)
    for c in layout.bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if layout.repeats:
        # The first page decides on the dictionary, so it has to reach the first repeats.
        writer = writer.option("parquet.dictionary.page.size", DICTIONARY_BYTES).option("parquet.page.size", DICTIONARY_BYTES // 2)
    writer.partitionBy(layout.chunk).parquet(folder)
    if now.schema is None:
        bare = StructType([f for f in rows.schema if f.name != layout.chunk]).add(rows.schema[layout.chunk])
        now = replace(now, chunk=layout.chunk, schema=bare.json())
    found = [n.partition("=")[2] for n in files.names(f"write={number}") if "=" in n]
    draft = [Entry(number, c, *files.size(f"write={number}/{layout.chunk}={c}"), 0, 0, batch) for c in found]
    draft = [e for e in draft if e.files]
    if not draft or not layout.keys:
        return now, draft
    written = read_entries(spark, path, now, draft)
    chunk = F.col(layout.chunk).cast("string")
    keyed = written.where(_whole(layout.keys)).select(chunk.alias("_chunk"), _key_hash(layout).alias("_hash"))
    if layout.probe:
        keyed = materialize(keyed.distinct())
    counts = {r["_chunk"]: r["n"] for r in keyed.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    sized = {c: (n, -(-n * BITS // 64)) for c, n in counts.items()}
    entries = [replace(e, rows=n, words=w, probe=_probe_name(layout)) for e in draft for n, w in (sized.get(e.chunk, (0, 0)),)]
    # A row per chunk of the write.
    sizes = spark.createDataFrame([(e.chunk, e.words) for e in entries if e.words], "_chunk string, _words long")
    words = keyed.join(F.broadcast(sizes), "_chunk").select("_chunk", *_word_and_mask("_words"))
    packed = words.groupBy("_chunk", "_word").agg(F.bit_or("_mask").alias("_bits")).withColumn("_write", F.lit(number).cast("long"))
    packed.sortWithinPartitions("_chunk", "_word").write.mode("overwrite").parquet(f"{path.rstrip('/')}/_filter/write={number}")
    return now, entries


def append(rows: DataFrame, path: str, layout: Layout, batch: int | None = None) -> None:
    """Add rows. With ``batch``, what the same micro-batch has written before is replaced, so it may run again."""
    spark = rows.sparkSession
    now = manifest_of(spark, path) or Manifest()
    if batch is not None and batch <= now.merged:
        raise ValueError(f"batch {batch} is merged already: the table belongs to another run of the stream")
    now, entries = _stage(rows, path, layout, now, batch)
    kept = tuple(e for e in now.entries if batch is None or e.batch != batch)
    _publish(spark, path, replace(now, entries=kept + tuple(entries)))


def swap(spark: SparkSession, path: str, layout: Layout, now: Manifest, old: Iterable[Entry], rows: DataFrame | None) -> None:
    """Put ``rows`` in the place of the folders ``old``, all at once; without rows the folders only go."""
    old = set(old)
    kept = tuple(e for e in now.entries if e not in old)
    entries: list[Entry] = []
    if rows is not None:
        now, entries = _stage(rows, path, layout, now, None)
    _publish(spark, path, replace(now, entries=kept + tuple(entries)))


def compact(
    spark: SparkSession,
    path: str,
    layout: Layout,
    target: int = TARGET_BYTES,
    least: int = 2,
    merge: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Pack the small files of every chunk into sorted ones of about ``target`` bytes; returns the number of folders replaced.

    Folders whose files hold half of ``target`` on average are left alone; so is a chunk with fewer than ``least`` small files.
    With ``merge`` (such as newest row per key) every chunk of ``least`` folders or more is read whole and replaced by what it returns.
    Folders of the newest micro-batch stay, as that batch may run again.
    """
    now = manifest_of(spark, path)
    if now is None:
        return 0
    newest = max((e.batch for e in now.entries if e.batch is not None), default=None)
    small: dict[str, list[Entry]] = {}
    for e in now.entries:
        if (e.batch is None or e.batch != newest) and (merge is not None or 2 * e.size < target * e.files):
            small.setdefault(e.chunk, []).append(e)
    if merge is None:
        chosen = {c: some for c, some in small.items() if sum(e.files for e in some) >= least}
    else:
        chosen = {c: some for c, some in small.items() if len(some) >= least}
    old = [e for some in chosen.values() for e in some]
    if not old:
        return 0
    rows = read_entries(spark, path, now, old)
    if merge is not None:
        rows = merge(rows)
    # Ranges over chunk and order: as many files as the bytes need, and one more per chunk at most.
    parts = sum(-(-sum(e.size for e in some) // target) for some in chosen.values())
    ranged = rows.repartitionByRange(parts, layout.chunk, *layout.sort)
    through = max((e.batch for e in old if e.batch is not None), default=-1)
    swap(spark, path, layout, replace(now, merged=max(now.merged, through)), old, ranged)
    return len(old)


def holders(batch: DataFrame, path: str, layout: Layout, now: Manifest, before: int | None = None) -> tuple[DataFrame, list[Entry]]:
    """Keys of ``batch``, as far as they are probed, that stored folders may hold, by their filters, and these folders.

    Only filters of the chunks that the batch touches are read. ``before`` leaves out folders of that and later micro-batches.
    A folder whose filter is made of other columns may hold any key of its chunk.
    """
    spark = batch.sparkSession
    chunk = F.col(layout.chunk).cast("string")
    keys = batch.where(_whole(layout.probed)).select(*{c: None for c in (layout.chunk, *layout.probed)}).distinct()
    if layout.probe:
        keys = materialize(keys)
    # A chunk is a week or a bucket: few.
    touched = {r["c"] for r in keys.select(chunk.alias("c")).distinct().collect()}
    able = [e for e in now.entries if e.chunk in touched and e.words and (before is None or e.batch is None or e.batch < before)]
    told = [e for e in able if e.probe == _probe_name(layout)]
    untold = [e for e in able if e.probe != _probe_name(layout)]
    wanted, entries = keys.where(chunk.isin(*{e.chunk for e in untold})), untold
    if told:
        sizes = spark.createDataFrame([(e.write, e.chunk, e.words) for e in told], "_write long, _chunk string, _words long")
        probes = (
            keys.withColumns({"_hash": _key_hash(layout), "_chunk": chunk})
            .join(F.broadcast(sizes), "_chunk")
            .select(*keys.columns, "_chunk", "_write", *_word_and_mask("_words"))
        )
        folders = [f"{path.rstrip('/')}/_filter/write={w}" for w in sorted({e.write for e in told})]
        filters = spark.read.schema("_chunk string, _word long, _bits long, _write long").parquet(*folders).where(F.col("_chunk").isin(*touched))
        if fits_broadcast(keys):
            probes = F.broadcast(probes)
        hits = materialize(
            filters.join(probes, ["_write", "_chunk", "_word"])
            .where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
            .select("_write", "_chunk", *[c for c in keys.columns])
        )
        places = {(r["_write"], r["_chunk"]) for r in hits.select("_write", "_chunk").distinct().collect()}
        hits = hits.select(*keys.columns)
        wanted = (hits.unionByName(wanted) if untold else hits).distinct()
        entries = [e for e in told if (e.write, e.chunk) in places] + untold
    return wanted, entries


def near_keys(batch: DataFrame, path: str, layout: Layout, before: int | None = None) -> tuple[DataFrame, DataFrame, bool] | None:
    """Keys in the folders that may hold rows that agree with one of ``batch`` in the probed columns, a row per stored row; the
    values of ``batch`` in these columns that the filters do not rule out; whether these are few enough to be broadcast.

    None if no folder may hold any, in which case no row is read. ``batch`` needs no other columns of the key.
    A filter is wrong for about one key in a few hundred, so the rows of the folders it names decide; of these only the
    key columns are read, and with few candidates only the row groups that can hold them.
    """
    spark = batch.sparkSession
    now = manifest_of(spark, path)
    if now is None:
        return None
    wanted, entries = holders(batch, path, layout, now, before)
    if not entries:
        return None
    stored = read_entries(spark, path, now, entries).select(*layout.keys)
    few = wanted.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        for k in layout.probed:
            # Times are left to the chunk and the join: as Python values they depend on the driver's time zone.
            if isinstance(stored.schema[k].dataType, (StringType, IntegralType)):
                stored = stored.where(F.col(k).isin(*{r[k] for r in few}))
    wanted = wanted.select(*layout.probed)
    small = fits_broadcast(wanted)
    return stored, F.broadcast(wanted) if small else wanted, small


def known_keys(batch: DataFrame, path: str, layout: Layout, before: int | None = None, exact: bool = True) -> DataFrame | None:
    """The keys of ``batch`` that are stored; None if no folder may hold any, in which case no row is read.

    Unless ``exact`` there may be others that agree with one of ``batch`` in the probed columns, for a join that is to follow.
    """
    near = near_keys(batch, path, layout, before)
    if near is None:
        return None
    stored, wanted, _ = near
    known = stored.join(wanted, list(layout.probed), "left_semi")
    if layout.probe:
        keys = batch.where(_whole(layout.keys)).select(*layout.keys)
        if fits_broadcast(keys):
            known = known.join(F.broadcast(keys), list(layout.keys), "left_semi")
        elif exact:
            known = known.join(keys, list(layout.keys), "left_semi")
    return known.distinct()
