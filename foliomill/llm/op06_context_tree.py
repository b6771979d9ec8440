"""Language-model scores by context-tree weighting.

A text is its words (A-Z lower-cased), each followed by a space, the last by an end sign; a null text is the end sign.
The next byte is told bit by bit, high bits first.  Every context of 0 to 5 bytes has, for each place in that binary
tree, a Krichevsky-Trofimov estimate from the training texts.  A node's weighted probability is the mean of its own
estimate and the product over its longer contexts; so for every bit the estimates of all depths are mixed, each by how
well its node has told the training texts.

Counts of byte 6-grams are gathered over all documents and grow with them.  They are filed under the last two bytes of
their context, so the deep part of the tree is weighted in parallel; only the two upper levels, at most 65,280 nodes,
meet at the driver.  The table of 6-gram costs goes to the tasks in passes of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import annotate, durable, grouped, held_out, pieces, quoted, table, utf8
from foliomill.llm.op09_substring_dedup import packed, split_by, unpacked
from foliomill.llm.words import LOWER, hashes

DEPTH = 5
END = 10
# Table entries that a task holds at once, counts that it holds back, bytes of text behind one part of the words,
# documents whose sums are put together at once, and groups in which counts of tasks are merged first.
PASS_ENTRIES, HELD, PART_BYTES, BUCKET_DOCS, SALTS = 8_000_000, 3_000_000, 32 << 20, 20_000, 16

_blank = np.zeros(256, bool)
_blank[[32, *range(9, 14)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each word, and the first word of each text (one more than texts)."""
    low = LOWER[data]
    inside = ~_blank[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(low))]
    begins[borders], ends[borders - 1] = inside[borders], inside[borders - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return low, inside, start, end, np.searchsorted(start, offsets)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that end at each byte of each text's normal form, with its context in one integer, its text, words of texts."""
    low, inside, start, end, first = tokens(data, offsets)
    docs = len(offsets) - 1
    words = np.diff(first)
    # Pads, words with a sign behind each, or the end sign alone.
    size = np.zeros(docs, np.int64)
    text_of_word = np.repeat(np.arange(docs), words)
    np.add.at(size, text_of_word, end - start + 1)
    size = np.maximum(size, 1) + DEPTH
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    lengths = end - start + 1
    before = np.cumsum(lengths) - lengths
    base = before[np.minimum(first[:-1], max(len(before) - 1, 0))] if len(before) else np.zeros(docs, np.int64)
    at = before - base[text_of_word] + begin[text_of_word] + DEPTH
    letters = np.flatnonzero(inside)
    word = np.repeat(np.arange(len(start)), end - start)
    out[letters - start[word] + at[word]] = low[letters]
    out[at + end - start] = 32
    out[begin + size - 1] = END
    keys = out.copy()
    for back in range(1, DEPTH + 1):
        keys[back:] |= out[:-back] << np.uint64(8 * back)
    pads = (begin[:, None] + np.arange(DEPTH)).reshape(-1)
    real = np.ones(len(out), bool)
    real[pads] = False
    return keys[real], np.repeat(np.arange(docs), size - DEPTH), words


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, grams of all texts with their number in training texts, filed under the two bytes before the last."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    salt = 0
    for batch in pieces(batches, 2 << 20):
        keys, text, _ = grams(*utf8(batch.column(0)))
        train = batch.column(1).to_numpy(zero_copy_only=False)
        salt = (salt * 31 + int(keys[:64].sum() % np.uint64(1 << 31))) % SALTS
        held.append((keys, train[text].astype(np.int64)))
        if sum(len(k) for k, _ in held) > HELD:
            held[:] = [merged()]
            # Different grams beyond half the bound are handed on; rows of one part are added up later.
            if 2 * len(held[0][0]) > HELD:
                yield filed(*held[0], salt)
                held.clear()
    if held:
        yield filed(*merged(), salt)


def filed(keys: np.ndarray, many: np.ndarray, salt: int) -> pa.RecordBatch:
    rows = [(value, salt, *packed(keys[at], many[at])) for value, at in split_by(((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64))]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["part", "salt", "keys", "many"])


def merge(group: pa.Table) -> pa.RecordBatch:
    """One row from several: the same grams, added up."""
    keys = np.concatenate([unpacked(c, np.uint64) for c in group.column("keys").to_pylist()])
    many = np.concatenate([unpacked(c, np.int64) for c in group.column("many").to_pylist()])
    keys, where = np.unique(keys, return_inverse=True)
    return filed(keys, np.bincount(where, many, len(keys)).astype(np.int64), group.column("salt")[0].as_py())


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series after eight steps up."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the sequential estimate (n + 1/2) / (total + 1) over all bits counted."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


class Level:
    """Nodes of one depth: estimates, and how far each is trusted against its longer contexts."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None):
        own = log_kt(zeros, ones)
        self.log = own if longer is None else np.logaddexp(own, longer) - np.log(2)
        self.trust = np.ones_like(own) if longer is None else np.exp(np.minimum(own - np.log(2) - self.log, 0))
        self.one = (ones + 0.5) / (zeros + ones + 1)

    def mix(self, node: np.ndarray, bit: np.ndarray, longer: np.ndarray | float) -> np.ndarray:
        one, trust = self.one[node], self.trust[node]
        return trust * np.where(bit == 1, one, 1 - one) + (1 - trust) * longer


def deep_levels(keys: np.ndarray, many: np.ndarray) -> tuple[list[tuple[np.ndarray, Level]], np.ndarray, np.ndarray, dict]:
    """Levels from the deepest up to 2 of one file of grams, with each bit's node; and the sums that level 2 hands up."""
    last = (keys & np.uint64(255)).astype(np.int64)
    place = np.arange(8)
    bit = (last[:, None] >> (7 - place)) & 1
    prefix = (1 << place) | (last[:, None] >> (8 - place))
    weight = np.repeat(many[:, None], 8, 1).reshape(-1)
    bit, prefix = bit.reshape(-1), prefix.reshape(-1)
    levels, below = [], None
    for depth in range(DEPTH, 1, -1):
        context = (keys >> np.uint64(8)) & np.uint64(2 ** (8 * depth) - 1)
        names = np.repeat(context, 8) * np.uint64(256) + prefix.astype(np.uint64)
        distinct, first, node = np.unique(names, return_index=True, return_inverse=True)
        ones = np.bincount(node, weight * bit, len(distinct))
        zeros = np.bincount(node, weight, len(distinct)) - ones
        longer = None if below is None else np.bincount(node[below[0]], below[1].log, len(distinct))
        level = Level(zeros, ones, longer)
        levels.append((node, level))
        below = (first, level)
    up = {"prefix": (distinct & np.uint64(255)).astype(np.int64), "zeros": zeros, "ones": ones, "log": level.log}
    return levels, bit, prefix, up


def handed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file, what its level 2 contributes to the level above: by the last byte of the context and place."""
    for batch in batches:
        for part, keys, many in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "many"))):
            *_, up = deep_levels(unpacked(keys, np.uint64), unpacked(many, np.int64))
            n = len(up["prefix"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part & 255), pa.int64()), *(pa.array(up[c]) for c in ("prefix", "zeros", "ones", "log"))],
                names=["last", "prefix", "zeros", "ones", "log"],
            )


def costs(upper: tuple[Level, Level]):
    """Per file: the log probability of each gram's last byte."""
    one, none = upper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cell, many in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "many"))):
                keys = unpacked(cell, np.uint64)
                levels, bit, prefix, _ = deep_levels(keys, unpacked(many, np.int64))
                told: np.ndarray | float = 0.0
                for node, level in levels:
                    told = level.mix(node, bit, told)
                told = one.mix((part & 255) * 256 + prefix, bit, told)
                told = none.mix(prefix, bit, told)
                logs = np.log(told).reshape(-1, 8).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([cell], pa.binary()), pa.array(packed(logs), pa.binary()), pa.array([len(keys)], pa.int64())],
                    names=["part", "keys", "logs", "entries"],
                )

    return run


def upper_levels(merged: DataFrame) -> tuple[Level, Level]:
    """Levels 1 and 0; at most 256 x 255 rows come to the driver."""
    rows = merged.mapInArrow(handed_up, "last bigint, prefix bigint, zeros double, ones double, log double")
    rows = rows.groupBy("last", "prefix").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log")).toPandas()
    rows = rows.sort_values(["last", "prefix"])
    sums = np.zeros((3, 256 * 256))
    at = (rows["last"] * 256 + rows["prefix"]).to_numpy()
    for i, name in enumerate(("zeros", "ones", "log")):
        sums[i, at] = rows[name]
    one = Level(*sums)
    zeros, ones = (x.reshape(256, 256).sum(axis=0) for x in sums[:2])
    return one, Level(zeros, ones, one.log.reshape(256, 256).sum(axis=0))


def word_entries(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            low, inside, start, end, first = tokens(*utf8(batch.column(1)))
            word, text = hashes(low[inside], end - start), np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.lexsort((text, word))
            word, text = word[order], text[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(word))).astype(np.uint32)
            word, text = word[at], text[at].astype(np.uint32)
            nodes = batch.column(0).to_numpy().tobytes()
            train = batch.column(2).to_numpy(zero_copy_only=False).tobytes()
            rows = [(value, nodes, train, *packed(word[a], text[a], many[a])) for value, a in split_by((word >> np.uint64(24)).astype(np.int64) % parts)]
            kinds = [pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["part", "nodes", "train", "word", "who", "many"]
            )

    return run


def word_sums(buckets: int):
    """Per part and bucket of documents: sums over their words, and in the first row the part's totals."""

    def work(group: pa.Table) -> pa.RecordBatch:
        word, node, many, train = [], [], [], []
        for nodes, flags, words, who, count in zip(*(group.column(c).to_pylist() for c in ("nodes", "train", "word", "who", "many"))):
            who = unpacked(who, np.uint32)
            word.append(unpacked(words, np.uint64))
            node.append(np.frombuffer(nodes, np.int64)[who])
            train.append(np.frombuffer(flags, bool)[who])
            many.append(unpacked(count, np.uint32).astype(np.int64))
        word, node, many, train = (np.concatenate(x) for x in (word, node, many, train))
        order = np.argsort(word)
        word, node, many, train = word[order], node[order], many[order], train[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        times = np.add.reduceat(many * train, first)
        of_each = np.repeat(times, np.diff(np.append(first, len(word))))
        sums, known = many * np.log10(of_each + 0.1), many * (of_each > 0)
        total, distinct = int(times.sum()), int((times > 0).sum())
        rows = []
        for value, at in split_by(node % buckets):
            who, where = np.unique(node[at], return_inverse=True)
            cells = packed(who, np.bincount(where, sums[at]), np.bincount(where, known[at]).astype(np.int64))
            rows.append((value, total, distinct, *cells))
            total = distinct = 0
        kinds = [pa.int64()] * 3 + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "total", "distinct", "node", "sums", "known"])

    return work


def document_sums(group: pa.Table) -> pa.RecordBatch:
    node = np.concatenate([unpacked(c, np.int64) for c in group.column("node").to_pylist()])
    sums = np.concatenate([unpacked(c, np.float64) for c in group.column("sums").to_pylist()])
    known = np.concatenate([unpacked(c, np.int64) for c in group.column("known").to_pylist()])
    node, where = np.unique(node, return_inverse=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(np.bincount(where, sums)), pa.array(np.bincount(where, known).astype(np.int64))], names=["node", "sums", "known"]
    )


def _cost(shared):
    """Per task: adds to each text's log probability what the shared entries give."""
    keys, logs = shared.value

    def work(texts: pa.Array, so_far: pa.Array | None = None) -> list[pa.Array]:
        wanted, text, words = grams(*utf8(texts))
        distinct, where = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        value = np.where(keys[at] == distinct, logs[at], 0.0)
        sums = np.bincount(text, value[where], len(texts))
        if so_far is not None:
            sums = sums + so_far.to_numpy()
        return [pa.array(words + 1, pa.int64()), pa.array(np.bincount(text, minlength=len(texts)), pa.int64()), pa.array(sums, pa.float64())]

    return work


def score(docs: DataFrame, text: str = "text", id_column: str = "doc_id", parts: int = 10, pass_entries: int = PASS_ENTRIES) -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10), ``n_bytes``
    (of the normal form) and ``bits_per_byte``.

    Learns from the rows whose crc32 of the id as text is not divisible by ``parts`` (a null id counts as empty text).
    Null counts as an empty text, the end token alone.  Rows that repeat count each in training.
    """
    rows = docs.select(quoted(id_column).alias("id"), F.coalesce(quoted(text), F.lit("")).alias("text"), held_out(id_column, parts).alias("held_out"))
    rows = rows.withColumn("node", F.xxhash64("id", "text")).withColumn("train", ~F.col("held_out"))
    gathered = rows.select("text", "train").mapInArrow(counted, "part bigint, salt bigint, keys binary, many binary")
    kind = "part bigint, salt bigint, keys binary, many binary"
    merged = durable(grouped(grouped(gathered, ["part", "salt"], merge, kind), ["part"], merge, kind))
    told = durable(merged.mapInArrow(costs(upper_levels(merged)), "part bigint, keys binary, logs binary, entries bigint"))

    # Whole files, at most 65,536, are put into passes of bounded size.
    passes, room = [[]], pass_entries
    for part, entries in sorted((r["part"], r["entries"]) for r in told.select("part", "entries").collect()):
        if entries > room and passes[-1]:
            passes.append([])
            room = pass_entries
        passes[-1].append(part)
        room -= entries
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("nats", T.DoubleType())]
    out, keep = rows.select("id", "node", "held_out", "text"), ["id", "node", "held_out"]
    for number, chosen in enumerate(passes):
        cells = told.where(F.col("part").isin(chosen)).select("keys", "logs").toPandas() if chosen else None
        keys = np.concatenate([np.zeros(1, np.uint64), *(unpacked(c, np.uint64) for c in cells["keys"])]) if chosen else np.zeros(1, np.uint64)
        logs = np.concatenate([np.zeros(1), *(unpacked(c, np.float64) for c in cells["logs"])]) if chosen else np.zeros(1)
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], logs[order]))
        inputs = ["text"] if number == 0 else ["text", "nats"]
        out = annotate(out, lambda shared=shared: _cost(shared), fields, inputs, keep if number == len(passes) - 1 else [*keep, "text"], 2 << 20)

    size = rows.agg(F.sum(F.octet_length("text")), F.count("*"), F.sum(F.col("train").cast("bigint"))).first()
    ends = size[2] or 0
    entries = rows.select("node", "text", "train").mapInArrow(
        word_entries(1 + (size[0] or 0) // PART_BYTES), "part bigint, nodes binary, train binary, word binary, who binary, many binary"
    )
    sums = durable(
        grouped(entries, ["part"], word_sums(1 + size[1] // BUCKET_DOCS), "bucket bigint, total bigint, distinct bigint, node binary, sums binary, known binary")
    )
    totals = sums.agg(F.sum("total"), F.sum("distinct")).first()
    n, v = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    base = durable(grouped(sums, ["bucket"], document_sums, "node bigint, sums double, known bigint"))
    copies = rows.groupBy("node").agg(F.count("*").alias("copies"))
    base = durable(base.join(copies, "node"))
    share, seen = F.coalesce(F.col("sums") / F.col("copies"), F.lit(0.0)), F.coalesce(F.col("known") / F.col("copies"), F.lit(0))
    return out.join(base, "node", "left").select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (seen.cast("bigint") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (share + float(np.log10(ends + 0.1)) - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))).alias("base_score"),
        (F.col("nats") / float(np.log(10))).alias("score"),
        "n_bytes",
        (-F.col("nats") / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op6_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))
