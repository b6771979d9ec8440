"""Token ids as length-delimited binary records, with a separate offset index.

A record frames one serialized sequence, as in the usual record files of training frameworks:

    8 bytes   length of the data
    4 bytes   masked checksum of these 8 bytes
    n bytes   the data
    4 bytes   masked checksum of the data
    1 byte    a line end

Numbers are little-endian; a checksum is the CRC-32 of zlib, rotated by 15 bits, plus a constant (the mask).  The data
is one byte whose lowest bit tells whether there is an id, 8 bytes of it, and the token ids; these have 4 bytes each if
the second bit is set, else 2, which do where none is above 65535.  The line end is what Spark's own text sink puts behind
a row, so the files are written and committed by Spark wherever it can write; a row of that sink is a block of whole records.

The index has a row per record: file, offset, size, id, number of token ids, how many stand before it, and their CRC-32 as
32-bit integers.  With it a reader takes records in any order: it opens a file once and cuts out the records asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.llm.common import pieces, quoted, shared_folder, small, table, texts_of
from foliomill.llm.tokens import encoder_of

END_ID = 2
BLOCK_BYTES, FILE_BYTES = 1 << 20, 32 << 20
# The mask of record checksums, and the layout of frames.
ROTATED, ADDED = 15, 0xA282EAD8
HEAD, TAIL, DATA = "<QI", "<I", "<Bq"
HEAD_SIZE, TAIL_SIZE, DATA_SIZE = map(struct.calcsize, (HEAD, TAIL, DATA))
LINE_END = b"\n"

RECORD_TYPE = "file string, offset bigint, size bigint, id bigint, ids binary"
RECORD = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("id", pa.int64()), ("ids", pa.binary())])


class CorruptRecord(ValueError):
    """A file that isn't records from its first byte to its last."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> ROTATED) | (crc << (32 - ROTATED))) + ADDED) & 0xFFFFFFFF


def serialized(id_: int | None, ids: bytes) -> bytes:
    """The data of a record, from an id and 32-bit token ids."""
    values = np.frombuffer(ids, "<u4")
    wide = bool(len(values)) and int(values.max()) >= 1 << 16
    return struct.pack(DATA, (id_ is not None) | wide << 1, id_ or 0) + (ids if wide else values.astype("<u2").tobytes())


def frame(data: bytes) -> bytes:
    """A record but for its line end."""
    length = struct.pack("<Q", len(data))
    return b"".join([length, struct.pack(TAIL, masked(length)), data, struct.pack(TAIL, masked(data))])


def unframe(content: memoryview, offset: int, file: str) -> memoryview:
    """The data of the record at ``offset``; both checksums must hold."""
    if offset + HEAD_SIZE > len(content):
        raise CorruptRecord(f"{file}: cut off at {offset}")
    length, check = struct.unpack_from(HEAD, content, offset)
    if masked(bytes(content[offset : offset + 8])) != check:
        raise CorruptRecord(f"{file}: wrong length at {offset}")
    begin = offset + HEAD_SIZE
    end = begin + length
    if end + TAIL_SIZE >= len(content) or content[end + TAIL_SIZE] != LINE_END[0]:
        raise CorruptRecord(f"{file}: cut off at {offset}")
    data = content[begin:end]
    if masked(bytes(data)) != struct.unpack_from(TAIL, content, end)[0]:
        raise CorruptRecord(f"{file}: wrong data at {offset}")
    return data


def size_of(data: memoryview) -> int:
    return HEAD_SIZE + len(data) + TAIL_SIZE + len(LINE_END)


def write_records(
    docs: DataFrame,
    path: str,
    text: str = "text",
    id_column: str = "doc_id",
    end_id: int = END_ID,
    json_path: str | None = None,
    ranks_path: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> None:
    """The token ids of each text and one end id, as record files in ascending order of the id.

    Null text is empty, a null id comes first; rows of one id follow one another in an order that is the same whenever they
    are written, and equal rows are written each.  An empty table gives no records.  A file holds ``file_bytes`` or so, more only
    where single records are larger.  Rows move once, as texts; what a third of all rows share (one id, one text) is still
    dealt to several tasks, by the rows' place in the input.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    rows = docs.select(quoted(id_column).cast("bigint").alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()
    block_bytes = min(BLOCK_BYTES, file_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = encoder_of(json_path, ranks_path, pattern), [], 0

        def block() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([LINE_END.join(held)], pa.binary())], names=["value"])
            held.clear()
            return out

        for batch in pieces(batches, 4 << 20):
            for id_, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1)))):
                held.append(frame(serialized(id_, ids + end)))
                size += len(held[-1])
                if size >= block_bytes:
                    yield block()
                    size = 0
        if held:
            yield block()

    blocks = rows.select("id", "text").mapInArrow(run, "value binary")
    # The bytes go out as they are: a cast to string doesn't look at them.
    blocks = blocks.select(F.col("value").cast("string").alias("value"))
    options = {"lineSep": LINE_END.decode(), "compression": "none", "maxRecordsPerFile": str(max(1, file_bytes // block_bytes))}
    blocks.write.options(**options).text(path)


def record_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, memoryview, int, pa.RecordBatch]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), memoryview(batch.column(1)[i].as_buffer()), i, batch


def made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)


def fields_of(file: str, offset: int, data: memoryview) -> tuple:
    flags, id_ = struct.unpack_from(DATA, data)
    ids = bytes(data[DATA_SIZE:])
    if not flags & 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return file, offset, size_of(data), id_ if flags & 1 else None, ids


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records, file by file: ``file``, ``offset``, ``size``, ``id``, ``ids`` (little-endian, 32 bits).

    Every checksum is verified; a file that is cut off or changed raises ``CorruptRecord``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, content, _, _ in contents(batches):
            rows, offset, size = [], 0, 0
            while offset < len(content):
                rows.append(fields_of(file, offset, unframe(content, offset, file)))
                size += rows[-1][2]
                offset += rows[-1][2]
                if size >= 4 * BLOCK_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return record_files(spark, path).mapInArrow(run, RECORD_TYPE)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """The index of the record files in ``path``: ``file``, ``offset``, ``size``, ``id``, ``n_tokens``, ``ids_crc32``, ``start``.

    Made from the files as they are read back.  ``start`` counts the token ids of all records before, in the order of writing.
    """
    n = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    records = read_records(spark, path).select("file", "offset", "size", "id", n, F.crc32("ids").alias("ids_crc32"))
    # The number of the task and that of its file tell the order of writing.
    for column, pattern in (("part", r"part-(\d+)-[^/]*$"), ("piece", r"-c(\d+)[^/]*$")):
        records = records.withColumn(column, F.regexp_extract("file", pattern, 1).cast("int"))
    raw = f"{index_path}/raw"
    records.write.parquet(raw)
    records = spark.read.parquet(raw)
    # A row per file goes through one task.
    files = records.groupBy("file", "part", "piece").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = small(files.select("file", before.alias("base")))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("offset")) - F.col("n_tokens")
    placed = records.withColumn("inside", inside).join(bases, "file")
    placed.select("file", "offset", "size", "id", "n_tokens", "ids_crc32", (F.col("base") + F.col("inside")).alias("start")).write.parquet(f"{index_path}/records")
    return spark.read.parquet(f"{index_path}/records")


def read_chosen(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of index rows ``wanted``, cut out of their files: ``file``, ``offset``, ``size``, ``id``, ``ids``.

    Rows that ``wanted`` repeats are read each.
    """
    offsets = wanted.groupBy("file").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))  # bounded by a file's records
    named = small(offsets.withColumnRenamed("file", "path"), 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, content, i, batch in contents(batches):
            rows, size = [], 0
            for offset in batch.column(2)[i].as_py():
                rows.append(fields_of(file, offset, unframe(content, offset, file)))
                size += rows[-1][2]
                if size >= 4 * BLOCK_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return record_files(spark, path).join(named, "path").select("path", "content", "offsets").mapInArrow(run, RECORD_TYPE)


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """All records in an order that ``seed`` draws: ``place`` and the columns of ``read_records``, sorted by place."""
    order = F.xxhash64(F.lit(seed), F.col("file"), F.col("offset"))
    drawn = read_chosen(spark, path, index).withColumn("place", order)
    return drawn.select("place", *RECORD.names).orderBy("place", "file", "offset")


def op13_records(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "records")
    write_records(table(spark, folder, "documents"), path)
    index = write_index(spark, path, f"{path}-index")
    return index.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
