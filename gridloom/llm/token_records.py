"""Token ids in length-delimited binary records, with a separate offset index.

A file holds records one after another. All numbers are little-endian:

    u64 length of the payload | u32 masked CRC-32 of these 8 bytes | payload | u32 masked CRC-32 of the payload | 0x0A

    payload: i64 document id | u8 1 if the id is present | u8 bytes of an id (2 or 4) | ids

The mask rotates a checksum right by 15 bits and adds 0xA282EAD8, so that data which holds its own
checksums is told apart. Files are written through Spark's own committed output (the text source
with the closing 0x0A as its separator), so any store that Spark writes to will do, and retried or
speculative tasks leave no partial records. Files are in ascending order of document id (nulls
first, equal ids by text): by number, and inside each file. ``index/`` has a row for each record:
its file, byte offset and length, and its document id and number of ids; with it, records can be
read in any order.

The input is range-partitioned once, before it is encoded. A null text has no ids but the end id;
a null id is kept and flagged; rows that repeat are written each; other columns are ignored. An
empty input writes no record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import new_path, plain
from gridloom.llm.wordtokens import encode_groups

_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qBB")
_TAIL = struct.Struct("<IB")
_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record, without the closing 0x0A."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = _BODY.pack(doc_id or 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def record(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids, end) of the record at a byte offset; ValueError if a checksum is wrong."""
    size, crc = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError(f"damaged length at byte {at}")
    begin = at + _HEAD.size
    payload = data[begin : begin + size]
    if len(payload) != size or _TAIL.unpack_from(data, begin + size) != (masked(payload), 0x0A):
        raise ValueError(f"damaged record at byte {at}")
    doc_id, present, width = _BODY.unpack_from(payload)
    return (doc_id if present else None), np.frombuffer(payload, f"<u{width}", offset=_BODY.size), begin + size + _TAIL.size


def _frames(path: str, mode: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, ids, at in encode_groups(batch.column(1), path, mode, end_id):
                yield pa.RecordBatch.from_arrays([pa.array([frame(doc_ids[i], ids[at[i - a] : at[i - a + 1]]) for i in range(a, b)], pa.binary())], ["frame"])

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record of each file, checked as it is read."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_py()
            rows, at, start = [], 0, 0
            while at < len(data):
                doc_id, ids, end = record(data, at)
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), at, end - at))
                at, start = end, start + len(ids)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(rows), pa.string()), *(pa.array(x, pa.int64()) for x in columns)], ["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32", "offset", "n_bytes"])


def write_records(docs: DataFrame, folder: str, tokenizer: str, mode: str = "words", end_id: int = 1, file_bytes: int = 24 << 20) -> None:
    """Writes records and index of all rows of ``docs`` (doc_id, text) under ``folder``.

    ``file_bytes``: about so many bytes of text go to a file.
    """
    spark = docs.sparkSession
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(total // file_bytes + 1, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    frames = ordered.mapInArrow(_frames(tokenizer, mode, end_id), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.text(f"{folder}/records", lineSep="\n")
    scan(spark, folder).select("file", "offset", "n_bytes", "doc_id", "n_tokens").write.parquet(f"{folder}/index")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every record, read from the files: (file, doc_id, start_in_file, n_tokens, ids_crc32, offset, n_bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records").select("path", "content")
    return files.mapInArrow(_records, "file string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long, offset long, n_bytes long")


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record; start: the ids in all records before it."""
    every = scan(spark, folder)
    index = spark.read.parquet(f"{folder}/index")
    # one row for each file: the running total over files stays small
    before = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", (F.sum("n").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file")) - F.col("n")).alias("before"))
    return every.join(before, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def read_some(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) of the records of ``wanted`` (doc_id), found through the index."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py()
                found = [record(data, at)[:2] for at in offsets.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x.astype(np.int64) for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    index = spark.read.parquet(f"{folder}/index").join(plain(wanted, "doc_id").distinct(), "doc_id", "left_semi")
    places = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records").select(F.col("path").alias("file"), "content")
    return files.join(places, "file").select("content", "offsets").mapInArrow(cut, "doc_id long, ids array<long>")


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "records")
