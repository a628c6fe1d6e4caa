"""Token ids in length-delimited binary record files with a separate offset index.

Data file, records one after another:
    u64  length of the payload          u32  masked CRC-32 of those eight bytes
    payload                             u32  masked CRC-32 of the payload
Payload: i64 document id, u8 bytes of an id (2 or 4), 3 zero bytes, u32 number of ids, the ids.
Index file: one entry of three i64 for each record (document id, offset of the record,
number of ids), so that a reader can take records in any order. All integers are
little-endian. A masked checksum is the CRC rotated right by 15 bits plus a constant,
so that a file that holds checksums can be checksummed itself.

Rows are dealt by ranges of document ids (where an id repeats, of the beginnings and then the hashes of its texts), as many as
rows and bytes call for, and beyond MOST_RANGES of them one a gigabyte: tasks stream, so a range may be that large, and 100 TB make
less than 100,000. A range is written in ascending order, as one shard file after another; shard numbers follow the ranges
and the files in them; a shard's place in the whole is the sum of the shards before it, found from one row a shard. Files are published by a move
under a name that is the same for each attempt.

Defined cases: a null text is the empty text (only the end id); rows without an id come
first, as id -2**63 in the file and null when read; repeated ids are all kept, ordered by the
first 64 characters, then a hash of their texts; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import scratch_path, written
from brindle.llm.groups import tidied
from brindle.llm.shared_files import filesystem, publish
from brindle.llm.token_ids import encoder

# Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
NO_ID = -(1 << 63)
HEADER, INDEX = struct.Struct("<qB3xI"), struct.Struct("<qqq")

ROWS_PER_SHARD, BYTES_PER_SHARD = 16_384, 32 << 20
MOST_RANGES, LARGE_RANGE_BYTES, ROW_BYTES = 16_384, 1 << 30, 64
SHARDS_IN_RANGE = 1 << 24  # numbers, not a bound of the files' sizes


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int, ids: bytes, width: int) -> bytes:
    return HEADER.pack(doc_id, width, len(ids) // width) + ids


def index_entry(doc_id: int, offset: int, n: int) -> bytes:
    return INDEX.pack(doc_id, offset, n)


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; ValueError if a length or checksum is wrong."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("a record's payload is damaged")
    return body[:n]


def ids_of(payload: bytes) -> tuple[int, np.ndarray]:
    doc_id, width, n = HEADER.unpack_from(payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", n, HEADER.size)


def read_record(data_uri: str, offset: int) -> tuple[int, np.ndarray]:
    """One record by its place in the index, for shuffled reads."""
    system, path = filesystem(data_uri)
    with system.open_input_file(path) as stream:
        stream.seek(offset)
        payload = read_frame(stream)
        if payload is None:
            raise ValueError("no record there")
        return ids_of(payload)


def ranges_for(rows: int, size: int, rows_each: int, bytes_each: int) -> int:
    """How many ranges: one for so many rows or bytes; once that makes more than MOST_RANGES, these, or one a gigabyte if that is more."""
    wanted = max(1, -(-rows // rows_each), -(-size // bytes_each))
    return wanted if wanted <= MOST_RANGES else max(MOST_RANGES, -(-(size + ROW_BYTES * rows) // LARGE_RANGE_BYTES))


def by_id_ranges(docs: DataFrame, rows_per_shard: int, bytes_per_shard: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text as bytes) in ranges of ids, ascending in each, then by beginning and hash of the text; the number of ranges follows rows and bytes."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"))
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # A repeated id is dealt by the beginnings and hashes of its texts; bounds of ranges are kept on the driver, so they are short.
    order = [F.asc_nulls_first("doc_id"), F.substring("text", 1, 64).asc(), F.xxhash64("text").asc(), F.col("text").asc()]
    return rows.repartitionByRange(ranges_for(size["rows"], size["bytes"], rows_per_shard, bytes_per_shard), *order[:3]).sortWithinPartitions(*order)


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None, rows_per_shard: int = ROWS_PER_SHARD, bytes_per_shard: int = BYTES_PER_SHARD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write docs as record files under folder; returns the manifest, a row for each shard:
    shard, data and index URIs, records, tokens, start (tokens in all shards before it)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary)
        width = encode.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()

        def encoded() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                texts = encode.stream(text.as_py() for text in batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), texts):
                    yield NO_ID if doc_id is None else doc_id, ids + end

        docs, k = encoded(), 0
        following = next(docs, None)
        while following is not None:
            entries, tokens = [], 0

            def records(stream) -> None:
                nonlocal following, tokens
                at = 0
                while following is not None and (not entries or at < bytes_per_shard):
                    doc_id, ids = following
                    record = frame(payload_of(doc_id, ids, width))
                    stream.write(record)
                    entries.append(index_entry(doc_id, at, len(ids) // width))
                    at += len(record)
                    tokens += len(ids) // width
                    following = next(docs, None)

            data, index = f"{folder}/shard-{part:06d}-{k:06d}.rec", f"{folder}/shard-{part:06d}-{k:06d}.idx"
            publish(data, records)
            publish(index, lambda stream: stream.write(b"".join(entries)))  # noqa: B023
            shard = {"shard": part * SHARDS_IN_RANGE + k, "data": data, "index": index, "records": len(entries), "tokens": tokens}
            yield pa.RecordBatch.from_pylist([shard], schema=pa.schema([("shard", pa.int64()), ("data", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]))
            k += 1

    rows = by_id_ranges(docs, rows_per_shard, bytes_per_shard, id_column, text_column)
    shards = rows.mapInArrow(tidied(write), "shard bigint, data string, index string, records bigint, tokens bigint")
    shards = written(shards, "record-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("bigint"))


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, offset, ids_bytes for each record of the manifest's
    files, read from their data files. Each file's index is held against what is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["index"])
                with system.open_input_stream(path) as stream:
                    index = np.frombuffer(stream.read(), "<i8").reshape(-1, 3)
                out: list[tuple] = []
                start, at = row["start"], 0
                system, path = filesystem(row["data"])
                with system.open_input_stream(path, buffer_size=4 << 20) as stream:
                    for k in range(row["records"]):
                        payload = read_frame(stream)
                        if payload is None:
                            raise ValueError(f"{path} ends early")
                        doc_id, ids = ids_of(payload)
                        if tuple(index[k]) != (doc_id, at, len(ids)):
                            raise ValueError(f"{path}: the index does not fit record {k}")
                        out.append((None if doc_id == NO_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], at))
                        start += len(ids)
                        at += len(payload) + 16
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    spark = manifest.sparkSession
    dealt = manifest.select("shard", "data", "index", "records", "start")
    dealt = dealt.repartition(max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard")
    return dealt.mapInArrow(tidied(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint, offset bigint")


def records_of(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Write the record files of docs and read them back."""
    manifest = write_records(docs, vocabulary, folder or scratch_path(spark, "records"), end_id, rows_per_shard)
    return read_records(manifest)
