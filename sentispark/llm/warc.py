"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, ended by the seek
table of the seekable format (a skippable frame with the sizes of all frames). The index, a
Parquet table beside the bundles, maps each record to its bundle, frame and offset within the frame.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response and the others
refer to it (revisit records without payload, their HTTP head keeps the payload's length); all
smaller ones are responses.

Bundles are written by the tasks through the file system of the shared folder, under names no
other attempt uses; only those of attempts that succeeded are in the index, so a lost executor or
a repeated task leaves unused files and no wrong rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentispark.llm.common import partitions, slices

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
_FRAME = 1 << 20
_BUNDLE = 256 << 20
_INDEX = "id long, bundle string, frame int, frame_begin long, frame_size long, begin long, size long"


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path without scheme is local or mounted; ``file``, ``hdfs``, ``s3`` (also as ``s3a`` and ``s3n``) and ``gs`` are opened by pyarrow."""
    path = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def record(name: int, kind: str, url: str | None, digest: str, length: int, refers: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. The digest is of the full payload, in base 32 as the format has it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {length}\r\n\r\n".encode()
    # A target must be one line.
    target = "".join(c for c in url or "" if c >= " " and c != "\x7f").strip() or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(head) + len(payload)}",
    ]
    if kind == "revisit":
        lines[3:3] = [
            f"WARC-Refers-To: <urn:page:{refers}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + head + payload + b"\r\n\r\n"


def read_record(data: bytes, begin: int) -> tuple[dict, int]:
    """Fields of the record at ``begin``, its payload checked against its digest, and where it ends."""
    end = data.index(b"\r\n\r\n", begin)
    first, *lines = data[begin:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {begin}")
    fields = dict(line.split(": ", 1) for line in lines)
    stop = end + 4 + int(fields["Content-Length"])
    body = data.index(b"\r\n\r\n", end + 4) + 4
    head = dict(line.split(": ", 1) for line in data[end + 4 : body - 4].decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
    found = {
        "id": int(fields["WARC-Record-ID"][10:-1]),
        "type": fields["WARC-Type"],
        "url": fields["WARC-Target-URI"],
        "digest": digest,
        "length": int(head["Content-Length"]),
        "refers": int(fields["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in fields else None,
        "payload": data[body:stop],
    }
    if found["type"] == "response":
        found["length"] = len(found["payload"])
        if hashlib.sha256(found["payload"]).hexdigest() != digest:
            raise ValueError(f"payload of record {found['id']} does not match its digest")
    return found, stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int]]:
    """(compressed, full) size of each frame of an open bundle."""
    total = file.size()
    file.seek(total - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(total - 9 - count * width)
    table = file.read(count * width)
    return [struct.unpack_from("<II", table, k * width) for k in range(count)]


class _Bundle:
    """A bundle being written; holds one frame in memory."""

    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        system, path = _file_system(self.path)
        self.file = system.open_output_stream(path, compression=None)  # the name would make it compress again
        self.sizes: list[tuple[int, int]] = []
        self.written = 0
        self.held, self.size, self.rows = [], 0, []

    def add(self, name: int, data: bytes) -> None:
        self.rows.append((name, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def frame(self) -> list[tuple]:
        """End the frame; index rows of its records."""
        if not self.held:
            return []
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(self.held))
        self.file.write(packed)
        rows = [(n, self.path, len(self.sizes), self.written, len(packed), b, s) for n, b, s in self.rows]
        self.sizes.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.size, self.rows = [], 0, []
        return rows

    def close(self) -> None:
        self.file.write(seek_table(self.sizes))
        self.file.close()


def _writer(folder: str):
    schema = pa.schema(
        [("id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_begin", pa.int64()), ("frame_size", pa.int64()), ("begin", pa.int64()), ("size", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None

        def indexed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for piece in slices(batches, "payload", 4 << 20):
            for name, url, digest, length, first, payload in zip(*(c.to_pylist() for c in piece.columns)):
                bundle = bundle or _Bundle(folder)
                again = first is not None and first != name
                kind = "revisit" if again else "response"
                bundle.add(name, record(name, kind, url, digest, length, first if again else None, b"" if again else payload.encode()))
                if bundle.size >= _FRAME:
                    yield from indexed(bundle.frame())
                if bundle.written >= _BUNDLE:
                    bundle.close()
                    bundle = None
        if bundle:
            yield from indexed(bundle.frame())
            bundle.close()

    return run


def write(pages: DataFrame, folder: str, least: int = 100, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """Write an archive record for every row of ``pages`` and return the path of the index.

    A null payload is empty, a null url becomes about:blank. Rows without an id are left out. Rows that
    repeat an id and payload are all responses.
    """
    spark = pages.sparkSession
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    rows = pages.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload")
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("length") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(firsts.where("n > 1").drop("n"), "digest", "left")
    index = joined.select("id", "url", "digest", "length", "first", "payload").mapInArrow(_writer(folder), _INDEX)
    place = f"{folder.rstrip('/')}/index.parquet"
    index.write.parquet(place)
    return place


def lookup(spark: SparkSession, index: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, type, url, digest, length, refers, payload) of all records, or of the ids in ``wanted``.

    Frames are dealt over the tasks; each is read alone by its place and checked against the seek table.
    """
    rows = spark.read.schema(_INDEX).parquet(index)
    if wanted is not None:
        rows = rows.join(wanted.select(F.col(wanted.columns[0]).alias("id")).distinct(), "id", "left_semi")
    places = F.struct("id", "begin", "size")
    frames = rows.groupBy("bundle", "frame", "frame_begin", "frame_size").agg(F.collect_list(places).alias("records"))
    schema = pa.schema(
        [("id", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list] = {}
        for batch in batches:
            for bundle, frame, begin, size, records in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _file_system(bundle)
                with system.open_input_file(path) as file:
                    if bundle not in tables:
                        tables[bundle] = read_seek_table(file)
                    sizes = tables[bundle]
                    if sizes[frame][0] != size or sum(s for s, _ in sizes[:frame]) != begin:
                        raise ValueError(f"index and seek table of {bundle} differ")
                    file.seek(begin)
                    data = zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=sizes[frame][1])
                found = []
                for r in records:
                    fields, end = read_record(data, r["begin"])
                    if fields["id"] != r["id"] or end != r["begin"] + r["size"]:
                        raise ValueError(f"record {r['id']} is not where the index has it")
                    found.append(fields)
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    dealt = frames.repartition(partitions(spark), "bundle", "frame")
    return dealt.mapInArrow(run, "id long, type string, url string, digest string, length long, refers long, payload binary")
