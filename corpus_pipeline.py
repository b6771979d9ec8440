"""From raw documents to packed token sequences: the stages, and their chain.

Each stage is judged on what the one before kept.  A document goes if it has no language (no letter in its text), if it is
a near or exact copy of one of smaller id, if nothing of it is left after repeated strings are cut out, or if it holds a
benchmark window.  What is left is packed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import annotate, durable, quoted, shared_folder, small, table, utf8
from foliomill.llm.op01_language_id import UNKNOWN, identify, learn
from foliomill.llm.op02_minhash_dedup import near_duplicates, word_keys
from foliomill.llm.op03_decontamination import find_items
from foliomill.llm.op09_substring_dedup import removed_runs, row_name, without
from foliomill.llm.op10_packing import pack
from foliomill.llm.words import split_words


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator's columns clash with."""
    return docs.select(*(quoted(c).alias(f"given_{c}") for c in docs.columns))


def back(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return found.select(*(new.get(c, quoted(f"given_{c}")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.  A null or letterless text is rejected; any other has a language.

    Where no document has a language to learn from, none is rejected.
    """
    names, matrix = learn(docs)
    if not names:
        return docs
    told = identify(aside(docs), (names, matrix), text="given_text")
    return back(told.where(F.col("lang_pred") != UNKNOWN), docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows that repeat it stay once.

    Rows of one id that differ in their words are documents of their own; a null id or a text without words repeats nothing.
    """
    found = durable(near_duplicates(docs).select(F.col("doc_id").alias("_id"), "kept"))
    gone = durable(found.where(~F.col("kept")).select("_id").distinct())
    left = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    again = found.where(F.col("kept") & F.col("_id").isNotNull()).groupBy("_id").agg(F.count("*").alias("_rows"))
    again = small(durable(again.where(F.col("_rows") > 1).select("_id")))

    def start():
        return lambda text: [word_keys(split_words(*utf8(text)))]

    # Only rows of ids that come again are moved, one per task and word sequence; texts that differ by more than their words
    # are told apart by their order.
    once = left.join(again, left["doc_id"] == again["_id"], "left_anti")
    repeated = aside(left.join(again, left["doc_id"] == again["_id"], "left_semi"))
    repeated = annotate(repeated, start, [T.StructField("_key", T.BinaryType())], ["given_text"])
    wordless = back(repeated.where(F.col("_key").isNull()), docs)
    given = F.struct(*(quoted(f"given_{c}") for c in docs.columns))
    firsts = repeated.where(F.col("_key").isNotNull()).groupBy("given_doc_id", "_key").agg(F.min_by(given, "given_text").alias("_row"))
    return once.union(wordless).union(back(firsts.select("_row.*"), docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document holds in a string of 50; ``n_chars`` follows.

    A character that is cut in two goes as a whole.  A document of which nothing but white space is left goes.
    """
    cut = durable(removed_runs(docs))

    def squeeze():
        codec = pa.Codec("zstd", 3)

        def work(text: pa.Array) -> list[pa.Array]:
            texts = [None if t is None else t.encode() for t in text.to_pylist()]
            packed = [None if t is None else codec.compress(t, asbytes=True) for t in texts]
            return [pa.array(packed, pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64())]

        return work

    # Texts travel compressed, and once.
    named = aside(docs).withColumn("_row", row_name("given_text", "given_doc_id"))
    rest = [c for c in named.columns if c != "given_text"]
    packed = annotate(named, squeeze, [T.StructField("_packed", T.BinaryType()), T.StructField("_size", T.LongType())], ["given_text"], rest)
    joined = packed.join(cut, F.col("_row") == F.col("node"), "left")

    def start():
        codec = pa.Codec("zstd")

        def work(packed: pa.Array, size: pa.Array, runs: pa.Array) -> list[pa.Array]:
            texts, runs = [], runs.to_pylist()
            for z, n, r in zip(packed.to_pylist(), size.to_pylist(), runs):
                text = z if z is None else codec.decompress(z, n, asbytes=True) if n else b""
                texts.append(text if text is None or r is None else without(text, r))
            texts = [t if t is None else t.decode("utf-8", "ignore") for t in texts]
            gone = [r is not None and not t.strip() for t, r in zip(texts, runs)]
            return [pa.array(texts, pa.string()), pa.array(gone, pa.bool_()), pa.array([r is not None for r in runs], pa.bool_())]

        return work

    fields = [T.StructField("_left", T.StringType()), T.StructField("_empty", T.BooleanType()), T.StructField("_cut", T.BooleanType())]
    kept = [c for c in rest if c != "_row"]
    done = annotate(joined, start, fields, ["_packed", "_size", "runs"], kept).where(~F.col("_empty"))
    new = {"text": F.col("_left")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_cut"), F.char_length("_left").cast(kind)).otherwise(F.col("given_n_chars"))
    return back(done, docs, **new)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = find_items(aside(docs), table(spark, sf_dir, "benchmark"), text="given_text")
    return back(found.where(F.size("hit_spans") == 0), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the ids."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Hashing, tokens and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline") if spark.conf.get("spark.checkpoint.dir", None) else None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if folder and number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
