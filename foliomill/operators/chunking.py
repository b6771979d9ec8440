"""Long texts cut into chunks at paragraph borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.plan import pinned

PARAGRAPH_BREAK = r"\n{2,}"
JOINER = "\n\n"


def _chunk_starts(paragraphs: Column, max_chars: int) -> Column:
    """1-based numbers of the paragraphs that open a chunk.

    A paragraph joins the open chunk unless the characters of both would exceed the limit;
    separators are not counted and a paragraph is never cut.  Only lengths are folded, so the
    text itself is copied once, when the chunks are put together.
    """
    start = F.struct(
        F.array(F.lit(1)).alias("starts"), F.lit(0).cast("bigint").alias("chars"), F.lit(1).alias("number")
    )

    def step(acc: Column, length: Column) -> Column:
        opens = (acc["number"] > 1) & (acc["chars"] + length > max_chars)
        return F.struct(
            F.when(opens, F.array_append(acc["starts"], acc["number"])).otherwise(acc["starts"]).alias("starts"),
            F.when(opens, length.cast("bigint")).otherwise(acc["chars"] + length).alias("chars"),
            (acc["number"] + 1).alias("number"),
        )

    return F.aggregate(F.transform(paragraphs, F.length), start, step, lambda acc: acc["starts"])


def chunk_text(
    docs: DataFrame,
    text: str = "text",
    max_chars: int = config.MAX_CHUNK_CHARS,
    separator: str = PARAGRAPH_BREAK,
) -> DataFrame:
    """One row per chunk: the columns of ``docs`` without the text, ``chunk_no`` from 0, and ``chunk``.

    A text within the limit is one chunk, unchanged.
    """
    rest = [c for c in docs.columns if c != text]
    is_long = F.length(F.col(text)) > max_chars
    paragraphs, starts = F.col("_paragraphs"), F.col("_starts")

    def paragraphs_from(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(paragraphs) + 1)
        return F.array_join(F.slice(paragraphs, start, end - start), JOINER)

    split = pinned(docs, _paragraphs=F.when(is_long, F.split(F.col(text), separator, -1)))
    placed = pinned(split, _starts=F.when(is_long, _chunk_starts(paragraphs, max_chars)))
    chunks = F.when(is_long, F.transform(starts, paragraphs_from)).otherwise(F.array(F.col(text)))
    return pinned(placed, _chunks=chunks).select(*rest, F.posexplode("_chunks").alias("chunk_no", "chunk"))
