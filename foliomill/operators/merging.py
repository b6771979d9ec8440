"""Chunk records of a paper merged into one record.

One fold reads the chunk records: everything in them becomes tagged rows, which are reduced per (paper, kind, key) and then
per paper.  A paper with very many chunks costs one small row per key and task, not one row per chunk.  Only the summaries,
of which the first few count, are read on the side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill import config
from foliomill.functions.plan import pinned
from foliomill.operators.repair import REJECTED
from foliomill.schemas import ITEM_LISTS, NOTE_LISTS, RECORD, RECORD_FIELDS, RECORD_TYPE, spark_type

SCALARS = [f.name for f in RECORD if f.name not in (*ITEM_LISTS, *NOTE_LISTS, "summary")]
ALL_FAILED = "All chunks failed to extract"


def _ok(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("outcome") != REJECTED)


def merged_summaries(chunks: DataFrame) -> DataFrame:
    """Per paper: the first non-empty summaries by chunk order, joined by a blank."""
    said = _ok(chunks).select("paper_id", "chunk_no", F.col("record.summary").alias("summary")).where("summary <> ''")
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk_no"))
    kept = said.withColumn("_place", place).where(F.col("_place") <= config.SUMMARIES_KEPT)
    in_order = F.array_sort(F.collect_list(F.struct("chunk_no", "summary")))
    joined = kept.groupBy("paper_id").agg(in_order.alias("_said"))
    return joined.select("paper_id", F.array_join(F.col("_said.summary"), " ").alias("summary"))


def item_key(name: Column) -> Column:
    """Items with equal keys are one item; a missing name is the empty key."""
    return F.lower(F.coalesce(name, F.lit("")))


CHUNK = "chunk"


def tagged_rows(chunks: DataFrame) -> DataFrame:
    """One row per chunk, item and note: ``paper_id, chunk_no, usable, kind, key, ordinal`` and its content.

    An item stands in the column of its list, a note in ``note``, a chunk's own record in ``whole``.
    """
    record, usable = F.col("record"), F.coalesce(F.col("outcome") != REJECTED, F.lit(False))
    contents = {name: spark_type(RECORD_FIELDS[name]).elementType for name in ITEM_LISTS}
    contents |= {"note": T.StringType(), "whole": RECORD_TYPE}

    def row(kind: str, key: Column, ordinal: Column, **given: Column) -> Column:
        columns = [given.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in contents.items()]
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), ordinal.cast("int").alias("ordinal"), *columns)

    def items(kind: str, name: str) -> Column:
        return F.transform(record[kind], lambda item, i: row(kind, item_key(item[name]), i, **{kind: item}))

    def notes(kind: str) -> Column:
        return F.transform(record[kind], lambda note: row(kind, note, F.lit(0), note=note))

    none = F.lit(0)
    own = F.array(row(CHUNK, F.lit(""), none, whole=record))
    lists = [*(items(kind, name) for kind, name in ITEM_LISTS.items()), *map(notes, NOTE_LISTS)]
    empty = F.filter(own, lambda _: F.lit(False))
    rows = F.concat(own, *[F.when(usable, F.coalesce(found, empty)).otherwise(empty) for found in lists])
    return pinned(chunks.withColumn("usable", usable), _rows=rows).select("paper_id", "chunk_no", "usable", F.inline("_rows"))


def folded(chunks: DataFrame, strict_first: bool = False) -> DataFrame:
    """Per paper: ``n_chunks`` usable and ``n_failed`` others, ``first_record`` (that of the first usable chunk), per scalar
    field the first value by chunk order, per item list the first item of each name by chunk and position, and the sorted
    union of each list of notes.

    The first value is the first that is not null; with ``strict_first`` it is the first usable chunk's value even if that
    is null.
    """
    rows, number = tagged_rows(chunks), F.col("chunk_no")
    place = F.struct("chunk_no", "ordinal")
    is_chunk, usable = F.col("kind") == CHUNK, F.col("usable")

    def first_of(name: str) -> Column:
        value = F.col("whole")[name]
        return F.min_by(value, F.when(usable if strict_first else usable & value.isNotNull(), number)).alias(name)

    reduced = rows.groupBy("paper_id", "kind", "key").agg(
        F.count_if(is_chunk & usable).alias("n_chunks"),
        F.count_if(is_chunk & ~usable).alias("n_failed"),
        F.min(place).alias("place"),
        F.min_by(F.struct(*ITEM_LISTS, "note"), place).alias("content"),
        F.min_by("whole", F.when(usable & is_chunk, number)).alias("first_record"),
        *[first_of(name) for name in SCALARS],
    )

    def the_chunks(name: str) -> Column:
        """From the one row of the paper's chunks."""
        return F.max_by(name, F.when(is_chunk, F.lit(1))).alias(name)

    def items_of(kind: str) -> Column:
        # At most one item per distinct name the paper mentions.
        found = F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("place").alias("at"), F.col(f"content.{kind}").alias("item"))))
        return F.transform(F.array_sort(found), lambda x: x["item"]).alias(kind)

    def notes_of(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("content.note")))).alias(kind)

    return reduced.groupBy("paper_id").agg(
        F.sum("n_chunks").alias("n_chunks"),
        F.sum("n_failed").alias("n_failed"),
        *map(the_chunks, ["first_record", *SCALARS]),
        *map(items_of, ITEM_LISTS),
        *map(notes_of, NOTE_LISTS),
    )


def merged_scalars(chunks: DataFrame, strict_first: bool = False) -> DataFrame:
    """Per paper the chunk counts and scalar fields of ``folded``."""
    return folded(chunks, strict_first).select("paper_id", "n_chunks", "n_failed", *SCALARS)


def merged_notes(chunks: DataFrame) -> DataFrame:
    """Per paper with notes the sorted union of each list of notes."""
    notes = folded(chunks).select("paper_id", *NOTE_LISTS)
    return notes.where(sum((F.size(n) for n in NOTE_LISTS), F.lit(0)) > 0)


def merge_chunks(chunks: DataFrame, strict_first: bool = False) -> DataFrame:
    """One row per paper: ``paper_id, n_chunks, n_failed, error, record``.

    Expects ``paper_id, chunk_no, outcome, record``, best read from a written table, of which the summaries are
    read on the side.  Rejected chunks are left out; a paper without any usable chunk has no
    record but an error.  A single usable chunk passes through unchanged.
    """
    whole = folded(chunks, strict_first).join(merged_summaries(chunks), "paper_id", "left")
    single = F.col("n_chunks") == 1

    def settled(name: str) -> Column:
        value = F.col(name)
        if name in ITEM_LISTS or name in NOTE_LISTS:
            value = F.when(single, F.col("first_record")[name]).otherwise(value)
            value = F.coalesce(value, F.array().cast(spark_type(RECORD_FIELDS[name])))
        return value.alias(name)

    record = F.struct(*[settled(f.name) for f in RECORD])
    has_record = F.col("n_chunks") > 0
    return whole.select(
        "paper_id",
        "n_chunks",
        "n_failed",
        F.when(~has_record, F.lit(ALL_FAILED)).alias("error"),
        F.when(has_record, record).alias("record"),
    )
