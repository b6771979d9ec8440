"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of words.  A table over hashed blocks of words says how far the search may jump;
where it says zero, the window's last block selects the patterns that end so, and they are compared word by word.
All patterns of one search have the same length, so windows shorter than the usual one (whole short items) have
searches of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import annotate, quoted, table, utf8
from foliomill.llm.words import Words, rolled, split_words

WINDOW = 10
# Words that tell where the search may jump.
BLOCK = 3
# Places searched in lockstep begin this many words apart.
STRIDE = 256
# Bytes of patterns that tasks hold at once; a larger benchmark is searched in several passes.
PATTERN_BYTES = 32 << 20


def windows(benchmark: DataFrame, text: str = "text", id_column: str = "item_id", size: int = WINDOW) -> DataFrame:
    """Distinct windows as (``words``, ``n``, ``items``): words joined by spaces, their number, the ids as sorted strings.

    An item without words or id has none.
    """
    schema = "item string, words string, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = split_words(*utf8(batch.column(1)))
            low = found.low.tobytes()
            out = []
            for row, item in enumerate(batch.column(0).to_pylist()):
                begin, end = found.first[row : row + 2]
                words = [low[s:e].decode() for s, e in zip(found.start[begin:end], found.end[begin:end])]
                n = min(size, len(words))
                out += [(item, " ".join(words[i : i + n]), n) for i in range(len(words) - n + 1) if n]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("item", "words", "n"), x)) for x in out],
                pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int32())]),
            )

    named = benchmark.where(quoted(id_column).isNotNull()).select(quoted(id_column).cast("string").alias("item"), quoted(text).alias("text"))
    return named.mapInArrow(run, schema).groupBy("words", "n").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Search:
    """Shift table, suffix buckets and words of patterns of one length."""

    def __init__(self, patterns: np.ndarray, rows: np.ndarray):
        """``patterns``: the word hashes of each; ``rows``: its number among all windows."""
        self.length = patterns.shape[1]
        self.block = min(BLOCK, self.length)
        # Sixteen slots per block and more keep chance jumps long.
        self.bits = int(np.clip(np.ceil(np.log2(16 * patterns.size)), 12, 26))
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint8)
        blocks = np.stack([rolled(p, self.block) for p in patterns])
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self.slot(blocks[:, end]), np.uint8(self.length - 1 - end))
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix, self.patterns, self.rows = blocks[order, -1], patterns[order], rows[order]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern row of all occurrences, as hashes tell them."""
        count, size = np.diff(words.first), self.length
        blocks = rolled(words.hash, self.block)
        jump = self.shift[self.slot(blocks)]
        parts = np.where(count >= size, -(-(count - size + 1) // STRIDE), 0)
        text = np.repeat(np.arange(len(count)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        cursor = words.first[:-1][text] + size - 1 + part * STRIDE
        stop = np.minimum(cursor + STRIDE, words.first[1:][text])
        ends = []
        while len(cursor):
            step = jump[cursor]
            ends.append(cursor[step == 0])
            cursor = cursor + np.maximum(step, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        low, high = (np.searchsorted(self.suffix, blocks[ends], side) for side in ("left", "right"))
        many = high - low
        ends = np.repeat(ends, many)
        pattern = np.arange(len(ends)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        same = np.ones(len(ends), bool)
        for back in range(size):
            rest = np.flatnonzero(same)
            same[rest] = words.hash[ends[rest] - back] == self.patterns[pattern[rest], size - 1 - back]
        return ends[same], self.rows[pattern[same]]


class Scanner:
    def __init__(self, texts: list[str], items: list[list[str]]):
        self.texts = [t.encode() for t in texts]
        self.items = items
        self.known: set[tuple[int, bytes]] = set()
        found = split_words(*utf8(pa.array(texts, pa.large_string())))
        sizes = np.diff(found.first)
        self.lengths = sizes
        self.searches = [
            Search(found.hash[found.first[rows][:, None] + np.arange(n)], rows) for n in np.unique(sizes) if len(rows := np.flatnonzero(sizes == n))
        ]

    def _true(self, words: Words, raw: bytes, end: int, row: int) -> bool:
        """Compares the words themselves."""
        begin = end + 1 - self.lengths[row]
        key = (row, raw[words.start[begin] : words.end[end]])
        if key in self.known:
            return True
        same = b" ".join(raw[s:e] for s, e in zip(words.start[begin : end + 1], words.end[begin : end + 1])) == self.texts[row]
        if same and len(self.known) < 100_000:
            self.known.add(key)
        return same

    def scan(self, words: Words) -> tuple[np.ndarray, list[list[str]]]:
        """Which words are hit, and each text's items."""
        raw = words.low.tobytes()
        edge = np.zeros(len(words.hash) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
        for search in self.searches:
            ends, rows = search.find(words)
            true = np.fromiter((self._true(words, raw, e, r) for e, r in zip(ends.tolist(), rows.tolist())), bool, len(ends))
            ends, rows = ends[true], rows[true]
            np.add.at(edge, ends + 1 - search.length, 1)
            np.add.at(edge, ends + 1, -1)
            text = np.searchsorted(words.first, ends, "right") - 1
            for t, r in set(zip(text.tolist(), rows.tolist())):
                items[t].update(self.items[r])
        return np.cumsum(edge)[:-1] > 0, [sorted(x) for x in items]


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    benchmark_text: str = "text",
    benchmark_id: str = "item_id",
    size: int = WINDOW,
    pattern_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``items`` (ids as sorted strings) and ``hit_spans`` (first and last word, from 0).

    Spans are the maximal runs of words inside occurrences of windows.  Null text has no words, a benchmark without
    words hits nothing, and rows stay as they are.  Patterns go to the tasks in passes of ``pattern_bytes``.
    """
    found = windows(benchmark, benchmark_text, benchmark_id, size)
    total = found.agg(F.sum(F.length("words") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)))).first()[0]
    passes = -(-(total or 0) // pattern_bytes)
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", SPANS),
    ]
    kept = docs.columns if keep is None else keep
    if not passes:
        return annotate(docs, lambda: _scan(None), fields, [text], kept)
    out = docs
    for number in range(passes):
        rows = found.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == number).select("words", "items").toPandas()
        shared = docs.sparkSession.sparkContext.broadcast((rows["words"].tolist(), [list(x) for x in rows["items"]]))
        inputs = [text] if number == 0 else [text, "items", "hit_spans"]
        last = number == passes - 1
        out = annotate(out, lambda shared=shared: _scan(shared), fields, inputs, kept if last else list(dict.fromkeys([*kept, text])))
    return out


def _scan(shared):
    """Per task: scans for the patterns of ``shared``, and adds what an earlier pass has found."""
    scanner = Scanner(*shared.value) if shared else None

    def work(texts: pa.Array, before_items: pa.Array | None = None, before_spans: pa.Array | None = None) -> list[pa.Array]:
        words = split_words(*utf8(texts))
        counts = np.diff(words.first)
        if scanner is None:
            return [pa.array(counts, pa.int64()), pa.array([[]] * len(texts), pa.list_(pa.string())), _spans(np.zeros(0, np.int64), np.zeros(0, np.int64), words)]
        hit, items = scanner.scan(words)
        if before_items is not None:
            items = [sorted({*a, *b}) for a, b in zip(items, before_items.to_pylist())]
            for row, spans in enumerate(before_spans.to_pylist()):
                for span in spans:
                    hit[words.first[row] + span["first"] : words.first[row] + span["last"] + 1] = True
        begins, ends = hit.copy(), hit.copy()
        begins[1:] &= ~hit[:-1]
        ends[:-1] &= ~hit[1:]
        borders = words.first[1:-1]
        borders = borders[(borders > 0) & (borders < len(hit))]
        begins[borders], ends[borders - 1] = hit[borders], hit[borders - 1]
        return [pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), _spans(np.flatnonzero(begins), np.flatnonzero(ends), words)]

    return work


def _spans(begins: np.ndarray, ends: np.ndarray, words: Words) -> pa.Array:
    text = np.searchsorted(words.first, begins, "right") - 1
    offsets = np.searchsorted(begins, words.first)
    first, last = begins - words.first[text], ends - words.first[text]
    both = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), both)


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = find_items(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
