"""Token counts of whole texts, long ones encoded in overlapping chunks that are spliced where they agree."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import annotate, table, texts_of
from foliomill.llm.tokens import CHUNK, OVERLAP, encoder_of

LIMIT = 512


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    json_path: str | None = None,
    ranks_path: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of its whole ``text``.

    Null counts as empty: 0 bytes, 0 tokens.  Rows stay as they are, repeated ones too.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN

    def start():
        encoder = encoder_of(json_path, ranks_path, pattern, chunk, overlap)

        def work(texts: pa.Array) -> list[pa.Array]:
            counts = [len(ids) // 4 for ids in encoder.encode(texts_of(texts))]
            return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(counts, pa.int64())]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return annotate(docs, start, fields, [text], keep)


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
