"""WARC archives written and read back by Spark's own text files, whatever the filesystem.

Every record ends with two line ends, so a table of records written as text with that separator is an archive.  It is
read back in splits cut at "two line ends and a magic", which payloads may hold as well.  Each task lists its candidate
records with the offset of their successor, which the content length tells.  From the file's start, pointer jumping
over the splits finds where each split is entered, and only what the chain from there reaches is a record.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.llm.common import durable, grouped, quoted, shared_folder, small, table

# The format's signs.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
BREAK = END + MAGIC
# Smaller payloads are always stored.
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"


def header(name: str, value: Column) -> Column:
    """A header line, left out where the value is null; signs that would end the line are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE) -> None:
    """One record per row.  A null payload is empty; null ids and urls are left out of the record.

    Of equal payloads of at least 100 bytes the row of the smallest id is stored, others refer to it; rows that repeat
    that id are stored each, and rows without an id refer.
    """
    rows = pages.select(quoted(id_column).cast("bigint").alias("id"), quoted(url).alias("url"), F.coalesce(quoted(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("bytes", F.octet_length("payload"))
    same = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # Few payloads repeat as a rule; then the others stay where they are.
    rows = rows.join(small(durable(same.where("copies > 1 and first is not null").select("digest", "first"))), "digest", "left")
    again = F.col("first").isNotNull() & F.coalesce(F.col("id") != F.col("first"), F.lit(True))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    rows = rows.withColumn("again", again).withColumn("block", F.when(F.col("again"), http).otherwise(F.concat(http, "payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        header("WARC-Record-ID", urn("id")),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        header("WARC-Refers-To", F.when(F.col("again"), urn("first"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        "block",
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def fields_of(head: bytes) -> dict[str, str]:
    lines = [x.partition(b":") for x in head.split(b"\r\n")]
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in lines}


def record_of(data: bytes, head_end: int) -> dict:
    """What the contract asks of a record, ``data`` being all of it behind the magic."""
    head = fields_of(data[:head_end])
    block = data[head_end + 4 : head_end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(END.encode())
    kind, page, refers = head.get("warc-type"), _PAGE.fullmatch(head.get("warc-record-id", "")), _PAGE.fullmatch(head.get("warc-refers-to", ""))
    stored = kind != "revisit"
    return {
        "page_id": int(page[1]) if page else None,
        "target_uri": head.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": int(refers[1]) if refers else None,
        "payload_bytes": len(payload) if stored else int(fields_of(http).get("content-length", 0)),
        "payload_digest": hashlib.sha256(payload).hexdigest() if stored else head.get("warc-payload-digest", "").removeprefix("sha256:"),
    }


RECORD = [
    ("page_id", pa.int64()),
    ("target_uri", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
]
RECORD_TYPE = "page_id bigint, target_uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
SEGMENT = pa.schema([("file", pa.int64()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()), ("whole", pa.bool_()), *RECORD])
SEGMENT_TYPE = f"file bigint, split bigint, at bigint, size bigint, next bigint, leaves bigint, whole boolean, {RECORD_TYPE}"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    """File, split, offset within the split, and bytes of each segment.  A file's first one loses its magic."""
    now, at = None, 0
    for batch in batches:
        for file, split, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if now != (file, split):
                now, at = (file, split), 0
            if split == 0 and at == 0:
                magic = MAGIC.encode()
                # Without one, the offset is kept off the chain's start.
                value, at = (value[len(magic) :], len(magic)) if value.startswith(magic) else (value, at)
            yield file, split, at, value
            at += len(value) + len(BREAK)


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment; offsets count from the split's first byte."""
    held: list[dict] = []

    def flush() -> pa.RecordBatch:
        # Where the chain from each candidate leaves the split.
        leaves: dict[int, int] = {}
        for row in reversed(held):
            row["leaves"] = leaves[row["at"]] = leaves.get(row["next"], row["next"])
        out = pa.RecordBatch.from_pylist(held, SEGMENT)
        held.clear()
        return out

    for file, split, at, data in segments(batches):
        if held and (held[-1]["file"], held[-1]["split"]) != (file, split):
            yield flush()
        row = {"file": file, "split": split, "at": at, "size": len(data), "next": -1, "whole": False}
        head_end = data.find(END.encode())
        length = fields_of(data[:head_end]).get("content-length", "") if head_end >= 0 else ""
        if length.isdecimal():
            end = head_end + 4 + int(length)
            row["next"] = at + end + len(BREAK)
            # The last record of a file ends with the separator alone.
            row["whole"] = end in (len(data), len(data) - len(END)) and (end == len(data) or data.endswith(END.encode()))
            if row["whole"]:
                row |= record_of(data, head_end)
        held.append(row)
    if held:
        yield flush()


def walked(group: pa.Table) -> pa.RecordBatch:
    """Candidates of a split that the chain from its entry reaches."""
    group = group.combine_chunks()
    place = {a: i for i, a in enumerate(group.column("at").to_pylist())}
    following, at, reached = group.column("next").to_pylist(), group.column("entry")[0].as_py(), []
    while (i := place.get(at)) is not None and following[i] > at:
        reached.append(i)
        at = following[i]
    return group.drop_columns(["entry", "leaves"]).take(pa.array(reached, pa.int64())).combine_chunks().to_batches(max_chunksize=None)[0] if reached else (
        pa.RecordBatch.from_pylist([], group.drop_columns(["entry", "leaves"]).schema)
    )


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, split, at, data in segments(batches):
        yield pa.RecordBatch.from_pylist(
            [{"file": file, "split": split, "at": at, "data": data}], pa.schema([("file", pa.int64()), ("split", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
        )


def assembled(group: pa.Table) -> pa.RecordBatch:
    """A record whose payload holds breaks, put together from its segments."""
    rows = sorted(zip(group.column("at").to_pylist(), group.column("data").to_pylist()))
    data = BREAK.encode().join(d for _, d in rows)
    head_end = data.find(END.encode())
    # A record that the file breaks off in is none.
    there = len(data) >= head_end + 4 + int(fields_of(data[:head_end])["content-length"])
    return pa.RecordBatch.from_pylist([record_of(data, head_end)] if there else [], pa.schema(RECORD))


def read_archives(spark: SparkSession, path: str, bucket: int = 1 << 20) -> DataFrame:
    """Records of the archives in ``path``: ids, target, type, and size and digest of the full payload.

    A file is read as far as its chain of records holds; one that doesn't begin with a record gives none.
    """
    raw = spark.read.option("lineSep", BREAK).text(path)
    raw = raw.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data")
    )
    seen = durable(raw.mapInArrow(candidates, SEGMENT_TYPE))
    sizes = seen.groupBy("file", "split").agg(F.sum(F.col("size") + len(BREAK)).alias("bytes"), F.min("at").alias("skipped"))
    # A file has few splits.
    before = F.coalesce(F.sum(F.col("bytes") + F.col("skipped")).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = durable(sizes.select("file", "split", before.alias("base")))
    moved = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.col(c)).alias(c)
    rest = [c for c in seen.columns if c not in ("at", "next", "leaves")]
    placed = durable(seen.join(bases, ["file", "split"]).select(*rest, moved("at"), moved("next"), moved("leaves")))

    # From an entry the chain jumps to the next split's; with each round twice as many splits.
    jump = durable(placed.where("leaves > at").select("file", "at", F.col("leaves").alias("to")))
    reached = durable(placed.where(F.col("at") == len(MAGIC)).where("split = 0").select("file", "at"))
    most = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1)) if most > 1 else 0):
        reached = durable(reached.union(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))))
        beyond = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = durable(jump.join(beyond, ["file", "to"]).select("file", "at", F.col("far").alias("to")))
    entries = placed.join(reached, ["file", "at"], "left_semi").select("file", "split", F.col("at").alias("entry"))
    chain = placed.join(durable(entries), ["file", "split"])
    columns = [c for c in chain.columns if c not in ("entry", "leaves")]
    kinds = ", ".join(f"`{c}` {chain.schema[c].dataType.simpleString()}" for c in columns)
    records = durable(grouped(chain.select(*columns, "leaves", "entry"), ["file", "split"], walked, kinds))
    names = [n for n, _ in RECORD]
    out = records.where("whole").select(*names)
    broken = durable(records.where("not whole").select("file", F.col("at").alias("owner"), F.col("next").alias("until")))
    if broken.take(1):
        slots = broken.withColumn("slot", F.explode(F.sequence((F.col("owner") / bucket).cast("bigint"), (F.col("until") / bucket).cast("bigint"))))
        parts = placed.select("file", "split", "at", (F.col("at") / bucket).cast("bigint").alias("slot")).join(slots, ["file", "slot"])
        parts = durable(parts.where("at >= owner and at < until").select("file", "split", "at", "owner"))
        bytes_ = raw.mapInArrow(values, "file bigint, split bigint, at bigint, data binary").join(bases, ["file", "split"])
        bytes_ = bytes_.withColumn("at", F.col("at") + F.col("base")).drop("base").join(parts, ["file", "split", "at"])
        out = out.union(grouped(bytes_.select("file", "owner", "at", "data"), ["file", "owner"], assembled, RECORD_TYPE).select(*names))
    return out


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
