"""Near-duplicates by DartMinHash, a weighted minwise hash, with banded joining and an exact check.

An element of a document is a shingle of five words; its weight is the number of times it occurs, that is, as many unit
regions.  Hash functions throw darts into every region: a Poisson number of them in each interval of ranks, with a
coordinate and a rank each.  The intervals are visited in ascending order until every coordinate of the document has a
dart, and the earliest per coordinate is its signature there.  Two documents agree in a coordinate with a probability
that is their weighted Jaccard similarity: sum of the smaller weights over sum of the larger.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import durable, forest, grouped, mixed, pieces, quoted, table, utf8
from foliomill.llm.graph import components
from foliomill.llm.words import Words, rolled, split_words

SHINGLE = 5
# Similarity to link at, as a fraction.
AT_LEAST = (4, 5)
# At similarity 0.8 one of 30 bands of 7 coordinates agrees with probability 0.9991, at 0.4 with 0.05.
BANDS, ROWS = 30, 7
FIRST_WIDTH = 1 / 64
# Documents of a candidate group that are compared with one another at once.
BLOCK = 64


def elements(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each unit region (shingle and its count so far), and the document it is of.

    A document of fewer than five words, but not none, is one shingle.
    """
    count = np.diff(words.first)
    shingles = rolled(words.hash, SHINGLE)
    many = np.maximum(count - SHINGLE + 1, 0)
    doc = np.repeat(np.arange(len(count)), many)
    last = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][doc] + SHINGLE - 1
    hashes = shingles[last]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = [rolled(words.hash[words.first[d] : words.first[d + 1]], int(count[d]))[-1] for d in short]
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, np.array(whole, np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.arange(len(doc))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(hashes + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc


def poisson(mean: float) -> np.ndarray:
    """Its distribution function."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 12))
    logs = n * math.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(n[1:]))])
    return np.cumsum(np.exp(logs))


def signatures(cells: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """The earliest dart per document and coordinate; documents without elements get the largest value."""
    empty = np.uint64(2**64 - 1)
    best = np.full(docs * size, empty)
    width, level = FIRST_WIDTH, 0
    while len(cells):
        open_ = best == empty
        seeds = mixed(cells + np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64))
        throws = np.searchsorted(poisson(width), seeds.astype(np.float64) / 2.0**64, "right")
        hit = np.flatnonzero(throws)
        many = throws[hit]
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        dart = mixed(np.repeat(seeds[hit], many) + (nth + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        place = np.repeat(doc[hit], many) * size + ((dart >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        new = open_[place]
        # Ranks matter only within an interval, as coordinates filled in an earlier one are closed.
        np.minimum.at(best, place[new], mixed(dart[new] ^ np.uint64(0x2545F4914F6CDD1D)))
        going = (best.reshape(docs, size) == empty).any(axis=1)[doc]
        cells, doc = cells[going], doc[going]
        # Intervals: [0, w), [w, 2w), [2w, 4w), [4w, 8w) and so on.
        level += 1
        width = FIRST_WIDTH * 2 ** max(0, level - 1)
    return best.reshape(docs, size)


def word_keys(words: Words) -> pa.Array:
    """128 bits of each text's word sequence, null without words."""
    keys = []
    for seed in (1, 2):
        place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))
        values = mixed(words.hash + mixed(place.astype(np.uint64) * np.uint64(2) + np.uint64(seed)))
        # A list here would make floats of all, and the key depend on the texts before.
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        keys.append(mixed(total[words.first[1:]] - total[words.first[:-1]] + np.diff(words.first).astype(np.uint64)))
    key, some = np.stack(keys, axis=1).astype("<u8"), np.diff(words.first) > 0
    return pa.array([k.tobytes() if s else None for k, s in zip(key, some)], pa.binary())


def sketch(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """``id``, ``key`` (128 bits of the word sequence) and ``bands``; both are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            words = split_words(*utf8(batch.column(1)))
            rows = batch.num_rows
            cells, doc = elements(words)
            darts = signatures(cells, doc, rows, BANDS * ROWS).reshape(rows, BANDS, ROWS)
            bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], rows, 0)
            for i in range(ROWS):
                bands = mixed(bands + darts[:, :, i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    word_keys(words),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64))
                    ),
                ],
                names=["id", "key", "bands"],
            )

    chosen = docs.select(quoted(id_column).cast("bigint").alias("id"), quoted(text).alias("text"))
    return chosen.mapInArrow(run, "id bigint, key binary, bands array<bigint>")


def compare(group: pa.Table) -> pa.RecordBatch:
    """Links between the documents of two blocks, or within one: their number by document, and a spanning forest."""
    group = group.combine_chunks()
    ids, first = np.unique(group.column("node").to_numpy(), return_index=True)
    group = group.take(pa.array(first))
    copies, block = group.column("copies").to_numpy(), group.column("block").to_numpy()
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    cells, doc = elements(split_words(*utf8(group.column("text").combine_chunks())))
    size = np.bincount(doc, minlength=len(ids))
    _, column, times = np.unique(cells, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(ids), len(ids)))
    for begin in range(0, int(column.max(initial=-1)) + 1, 4096):
        part = slice(*np.searchsorted(column, [begin, begin + 4096]))
        matrix = np.zeros((len(ids), 4096), np.float32)
        matrix[doc[part], column[part] - begin] = 1
        both += matrix @ matrix.T
    either = size[:, None] + size[None, :] - both
    linked = both * AT_LEAST[1] >= either * AT_LEAST[0]
    np.fill_diagonal(linked, False)
    if low != high:
        linked &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(linked))
    root = forest(a, b, len(ids))
    links = linked @ copies
    counted, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[counted], ids[tied]]), pa.int64()),
            pa.array(np.concatenate([ids[root[counted]], ids[root[tied]]]), pa.int64()),
            pa.array(np.concatenate([links[counted], np.zeros(len(tied), np.int64)]), pa.int64()),
        ],
        names=["node", "other", "links"],
    )


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the id, ``class_id`` (smallest id that links lead to), ``n_links`` and ``kept`` (id = class_id).

    Linked are documents whose five-word shingles, counted with their multiplicity, have a similarity of 0.8 or more;
    ``n_links`` counts the other documents linked directly.  Documents with equal words are one document in the
    search.  A document without words (null, empty), or without an id, links with nothing and is kept.  Rows that
    repeat an id with the same words all get the result of one, and count as copies.
    """
    sketched = durable(sketch(docs, text, id_column))
    lonely = sketched.where("key is null or id is null")
    wordy = sketched.where("key is not null and id is not null")
    # Written before it is joined, so that a text with very many copies can be split.
    texts = durable(wordy.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    members = durable(wordy.join(texts, "key").select("id", "node", "copies", F.when(F.col("id") == F.col("node"), F.col("bands")).alias("bands")))
    banded = members.where("bands is not null").select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
    buckets = durable(buckets.where("lead < last").select("band", "lead"))
    candidates = components(banded.join(buckets, "band").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    candidates = durable(candidates)
    sizes = durable(candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    placed = candidates.join(sizes, "component").join(
        members.where("id = node").select("node", "copies").dropDuplicates(["node"]), "node"
    )
    placed = durable(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    chosen = docs.select(quoted(id_column).cast("bigint").alias("node"), quoted(text).alias("text"))
    pairs = chosen.join(placed, "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "component", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "copies", "text"
    )
    found = durable(grouped(pairs, ["component", "low", "high"], compare, "node bigint, other bigint, links bigint"))
    classes = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = durable(links.join(classes, "node", "full").select("node", "component", "links"))
    out = members.join(known, "node", "left").select(
        F.col("id"),
        F.coalesce("component", "node").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = out.union(lonely.select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))
    return out.select(F.col("id").alias(id_column), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
