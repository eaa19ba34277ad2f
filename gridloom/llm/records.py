"""Token ids as length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

File format, all integers little-endian. A shard `shard-NNNNN-ID.rec` is a run of records:

    length   u64   bytes of data
    check    u32   masked CRC-32 of the 8 length bytes
    data           the serialized sequence
    check    u32   masked CRC-32 of data

A serialized sequence is: has_id u8 (0: the document's id is null), doc_id i64, width u8 (2 or 4), then the ids as unsigned
integers of that width. The mask is rotate-right by 15 plus 0xA282EAD8, so that a checksum of data that holds checksums
stays strong. The index `shard-NNNNN-ID.idx` has one u64 for each record, its offset in the shard: record k is read by one
seek, in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder, kept, shipped
from .common import new_path, written

HEAD, FOOT, BODY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BqB")
#: Fixed value: the constant of the checksum mask.
MASK = 0xA282EAD8
#: A shard is closed once it holds so many bytes; the next one of the partition follows.
SHARD_BYTES = 128 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, FOOT.pack(masked(size)), data, FOOT.pack(masked(data))))


def serialized(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit integers."""
    values = np.frombuffer(ids, "<u4")
    narrow = not len(values) or int(values.max()) < 1 << 16
    return BODY.pack(doc_id is not None, doc_id or 0, 2 if narrow else 4) + (values.astype("<u2").tobytes() if narrow else ids)


def parsed(data: bytes) -> tuple[int | None, bytes]:
    has_id, doc_id, width = BODY.unpack_from(data)
    ids = data[BODY.size :]
    return doc_id if has_id else None, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def record_data(record: bytes) -> bytes:
    """The data of a whole record; lengths or checksums that don't fit raise."""
    if len(record) < HEAD.size + FOOT.size:
        raise ValueError("a record is cut short")
    size, check = HEAD.unpack_from(record)
    if masked(record[:8]) != check:
        raise ValueError("a record's length is damaged")
    data = record[HEAD.size : -FOOT.size]
    if len(data) != size or masked(data) != FOOT.unpack(record[-FOOT.size :])[0]:
        raise ValueError("a record's data is damaged")
    return data


#: Schemes of Hadoop's file systems by the store's own scheme.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "s3": "s3", "file": "file"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path by its scheme; a plain path is a shared folder, and dbfs: the folder that its nodes mount. A scheme
    that no store is known for raises."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme not in SCHEMES:
        raise ValueError(f"{path}: records can be written to {', '.join([*SCHEMES, 'dbfs'])} and plain paths")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


class ShardWriter:
    """Writes one shard and its index under names of its own, so that a task that is run twice harms nothing."""

    def __init__(self, folder: str, part: int, number: int):
        self.name = f"shard-{part:05d}-{number:03d}-{uuid.uuid4().hex[:12]}"
        self.store, base = opened(folder)
        self.store.create_dir(base, recursive=True)
        self.path = f"{base}/{self.name}"
        self.file = self.store.open_output_stream(f"{self.path}.rec")
        self.offsets: list[int] = []
        self.bytes = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        record = framed(serialized(doc_id, ids))
        self.offsets.append(self.bytes)
        self.file.write(record)
        self.bytes += len(record)
        self.ids += len(ids) // 4

    def close(self) -> tuple[str, int, int]:
        self.file.close()
        with self.store.open_output_stream(f"{self.path}.idx") as f:
            f.write(np.array(self.offsets, "<u8").tobytes())
        return self.name, len(self.offsets), self.ids


def write_records(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None
) -> DataFrame:
    """Encodes every whole text (null: empty), appends end_id, and writes shards in ascending doc_id order under folder.

    Returns the manifest (shard int, name string, n_records long, n_ids long), a written table that names the shards of the
    attempts that count, in order. Null ids come first; equal ids lie side by side, ordered by their text. Texts travel to
    their range of ids once; ids aren't shuffled. A text of any length is one record; extra columns aren't written, whatever
    their names. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    data = shipped(spark, vocabulary)
    end = struct.pack("<I", end_id)
    key = F.col(f"`{doc_id}`").cast("long")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(key.alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        .repartitionByRange(n, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(data.value, Encoder, "encoder")
        writer, part, done = None, 0, []
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer is None:
                    writer = ShardWriter(folder, part, len(done))
                writer.add(key.as_py(), encoder.ids(text.as_py()) + end)
                if writer.bytes >= SHARD_BYTES:
                    done.append((part, len(done), *writer.close()))
                    writer = None
        if writer:
            done.append((part, len(done), *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), MANIFEST_TYPES, strict=True)], ["part", "number", "name", "n_records", "n_ids"]
            )

    return written(ordered.mapInArrow(write, "part int, number int, name string, n_records long, n_ids long"), "manifest")


MANIFEST_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id long, start long (ids before the document's), n_tokens long, ids_crc32 long of every record of the manifest.

    The running start needs one number for each shard, over the manifest alone (a row for each 128 MB). Each shard is then
    read by its index, a task holding whole shards.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("name", "before").repartition(n, "name").mapInArrow(
        partial(_read, folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    store, base = opened(folder)
    for shards in batches:
        for name, start in zip(shards.column(0).to_pylist(), shards.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, ids in shard_sequences(store, f"{base}/{name}"):
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                start += len(ids) // 4
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


#: Bytes that are read at once where records lie side by side.
READ_BYTES = 1 << 20


def shard_sequences(store: fs.FileSystem, path: str, order: Callable[[int], list[int]] | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a shard through its index, in file order or in that of order(number of records). Offsets give each
    record's place and end; records that are asked for one after another and lie side by side are read together."""
    with store.open_input_file(f"{path}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    with store.open_input_file(f"{path}.rec") as f:
        ends = np.append(offsets[1:], f.size())
        wanted = range(len(offsets)) if order is None else order(len(offsets))
        at = 0
        while at < len(wanted):
            first = last = wanted[at]
            at += 1
            while at < len(wanted) and wanted[at] == last + 1 and ends[last + 1] - offsets[first] <= READ_BYTES:
                last += 1
                at += 1
            start = int(offsets[first])
            block = f.read_at(int(ends[last]) - start, start)
            for k in range(first, last + 1):
                yield parsed(record_data(block[offsets[k] - start : ends[k] - start]))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes docs to a new folder in the shared one, and what reading it back through its offsets gives: doc_id, start (ids
    before the document), n_tokens, ids_crc32. Null and empty texts are their end token alone; null ids come first and rows of
    equal id are records of their own; very long texts are one record; extra columns aren't carried; an empty table gives an
    empty one."""
    folder = new_path(docs.sparkSession, "records")
    return read_records(docs.sparkSession, folder, write_records(docs, folder, vocabulary, end_id))
