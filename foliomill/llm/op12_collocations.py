"""Phrases whose words keep together, by SETM: relations of occurrences, merge-joined with themselves and counted as groups.

``R1`` holds every word occurrence, sorted by piece and position, and is persisted in blocks of one language and about
``BLOCK`` bytes of text; an empty place stands between two pieces.  ``Rk`` is the merge join of ``Rk-1`` with ``R1`` on the
piece and the adjacent position: in a sorted block that is the place next to it.  The groups of ``Rk``, counted in their
block first, are dealt to parts and summed; those that are frequent get a number, which is sent back to the blocks that
hold the group.  The semi-join with them leaves what is extended to the next length.

A group of k words is named by the pair (number of its first k - 1 words, number of its last word), so that names are
exact whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.llm.common import quoted, shared_folder, table, utf8
from foliomill.llm.words import LOWER, hashes

BLOCK = 16 << 20
# Bytes of group names that one task sums.
PART_BYTES = 32 << 20
MIN_COUNT, MAX_WORDS, TOP, COVERED = 10, 3, 2000, 50
UNKNOWN = "und"

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAPS = BREAKS.copy()
GAPS[[32, 9]] = True

BLOCK_TYPE = "block bigint, spot bigint, lang string, n bigint, words binary, counts binary, places binary"
DEALT_TYPE = "part int, block bigint, spot bigint, lang string, names binary, counts binary"
LEVEL_TYPE = "block bigint, spot bigint, part int, numbers binary, number bigint, lang string, word string, name bigint, a bigint"


def packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; they come back as 64 bits wide."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").ravel()


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in order, and each one's place; places of words of two pieces are not adjacent."""
    low = LOWER[data]
    inside = ~GAPS[low]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(low))]
    begins[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    start, lengths = np.flatnonzero(begins), np.flatnonzero(ends) + 1 - np.flatnonzero(begins)
    letters = low[inside]
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))])
    # A piece ends at a sign and where a text does.
    cuts = np.cumsum(BREAKS[low], dtype=np.int64)
    piece = cuts[start] + np.searchsorted(borders, start, side="right")
    apart = np.zeros(len(start), np.int64)
    if len(start):
        apart[1:] = np.diff(piece) > 0
    return words, np.arange(len(start)) + np.cumsum(apart)


def block_of(texts: pa.Array) -> tuple[int, bytes, bytes, bytes] | None:
    """Number of words, the different ones, how often each stands, and at each place its number and 1, or 0."""
    words, places = occurrences(*utf8(texts))
    if not len(words):
        return None
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spread = np.zeros(places[-1] + 1, np.int64)
    spread[places] = codes + 1
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    return len(words), b"\n".join(coded.dictionary.to_pylist()), packed(counts), packed(spread)


def blocks_of(docs: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """``R1``: a row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.Array]] = {}
        bytes_: dict[str, int] = {}

        def flush(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            got = block_of(pa.concat_arrays(held.pop(name)))
            del bytes_[name]
            if got:
                row = {"block": task << 24 | made, "spot": task + 31 * made, "lang": name}
                made += 1
                yield pa.RecordBatch.from_pylist([row | dict(zip(("n", "words", "counts", "places"), got))], schema)

        schema = pa.schema(
            [("block", pa.int64()), ("spot", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *((c, pa.binary()) for c in ("words", "counts", "places"))]
        )
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            for name in names.unique().to_pylist():
                mine = texts.filter(pa.compute.equal(names, name))
                # No more than a block of texts at a time, unless one text is larger.
                step = max(1, len(mine) * size // max(mine.nbytes, 1))
                for at in range(0, len(mine), step):
                    part = mine.slice(at, step)
                    held.setdefault(name, []).append(part)
                    bytes_[name] = bytes_.get(name, 0) + part.nbytes
                    if bytes_[name] >= size:
                        yield from flush(name)
            while sum(bytes_.values()) > 2 * size:
                yield from flush(max(bytes_, key=bytes_.get))
        for name in list(held):
            yield from flush(name)

    return docs.select(F.coalesce(quoted(lang).cast("string"), F.lit(UNKNOWN)), F.coalesce(quoted(text), F.lit(""))).mapInArrow(run, BLOCK_TYPE)


def part_numbers(names: np.ndarray, parts: int) -> np.ndarray:
    mixed = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def word_order(words: list[bytes], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's different words in the order they are dealt, and the part of each, in that order."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    part = part_numbers(hashes(np.frombuffer(b"".join(words), np.uint8), lengths), parts)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def name_order(names: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different names of groups in the order they are dealt, their parts in that order, and how often each stands."""
    names, counts = np.unique(names, return_counts=True)
    part = part_numbers(names, parts)
    order = np.argsort(part, kind="stable")
    return names[order], part[order], counts[order]


def runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for begin, end in zip(cuts[:-1], cuts[1:]):
        if end > begin:
            yield int(part[begin]), begin, end


DEALT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("spot", pa.int64()), ("lang", pa.string()), ("names", pa.binary()), ("counts", pa.binary())])


def deal_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"].split(b"\n")
                order, part = word_order(words, parts)
                counts = unpacked(row["counts"])[order]
                rows = [
                    {"part": p, "block": row["block"], "spot": row["spot"], "lang": row["lang"],
                     "names": b"\n".join(words[i] for i in order[b:e]), "counts": packed(counts[b:e])}
                    for p, b, e in runs(part)
                ]
                yield pa.RecordBatch.from_pylist(rows, DEALT)

    return run


class Block:
    """The relations of one block, built up level by level from what the parts sent back."""

    def __init__(self, words: bytes, places: bytes):
        self.words, self.places = words.split(b"\n"), unpacked(places)

    def relation(self, numbers: list[np.ndarray], parts: list[int], bases: list[int]) -> np.ndarray:
        """Names of the next level's groups, one per occurrence; ``numbers`` of each level follow the order of dealing."""
        order, _ = word_order(self.words, parts[0])
        number = np.full(len(self.words) + 1, -1, np.int64)
        number[order + 1] = numbers[0]
        word = number[self.places]  # -1: between pieces, or not frequent
        groups = word
        for level, base in enumerate(bases):
            # The groups that begin at a place, joined with the word behind them.  The words without the first one
            # are a group of the same length, which must be frequent as well.
            k = level + 1
            left, right, last = groups[: len(word) - k], groups[1 : len(word) - k + 1], word[k:]
            at = np.flatnonzero((left >= 0) & (right >= 0) & (last >= 0))
            names = left[at] * base + last[at]
            if level == len(bases) - 1:
                return names
            dealt, _, _ = name_order(names, parts[level + 1])
            by_name = np.argsort(dealt)
            found = numbers[level + 1][by_name][np.searchsorted(dealt[by_name], names)] if len(names) else names
            groups = np.full(len(word) - k, -1, np.int64)
            groups[at] = found
        raise ValueError("no level to extend to")


def extend(parts: list[int], bases: list[int]):
    """From blocks, each with what came back to it, to the dealt groups of the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        back: list[list[np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            numbers = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in back]
            names = Block(now["words"], now["places"]).relation(numbers, parts, bases)
            names, part, counts = name_order(names, parts[len(bases)])
            same = {c: now[c] for c in ("block", "spot", "lang")}
            rows = [same | {"part": p, "names": packed(np.diff(names[b:e], prepend=0)), "counts": packed(counts[b:e])} for p, b, e in runs(part)]
            return pa.RecordBatch.from_pylist(rows, DEALT)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["level"] == 0:
                    if now:
                        yield dealt()
                    now, back = row, [[] for _ in bases]
                else:
                    back[row["level"] - 1].append(unpacked(row["numbers"]))
        if now:
            yield dealt()

    return run


LEVEL = pa.schema(
    [
        *((c, t) for c, t in (("block", pa.int64()), ("spot", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary()), ("number", pa.int64()))),
        *((c, t) for c, t in (("lang", pa.string()), ("word", pa.string()), ("name", pa.int64()), ("a", pa.int64()))),
    ]
)


def tally(parts: int, least: int, of_words: bool):
    """Sums the groups of a part: a row per frequent group, and one per block with its groups' numbers (-1: not frequent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["part"], []).append(row)
        for part, rows in held.items():
            counts = [unpacked(r["counts"]) for r in rows]
            ends = np.cumsum([0, *map(len, counts)])
            if of_words:
                # A word holds no line end, so it tells where the language ends.
                keys = pa.array([head + w for r in rows for head in [r["lang"].encode() + b"\n"] for w in r["names"].split(b"\n")], pa.large_binary())
                coded = keys.dictionary_encode()
                names, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            else:
                names, place = np.unique(np.concatenate([np.cumsum(unpacked(r["names"])) for r in rows]), return_inverse=True)
            # Sums below 2^53 are exact.
            sums = np.bincount(place, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
            often = np.flatnonzero(sums >= least)
            number = np.full(len(names), -1, np.int64)
            number[often] = np.arange(len(often)) * parts + part
            empty = {c: None for c in LEVEL.names}
            back = [
                empty | {"block": r["block"], "spot": r["spot"], "part": part, "numbers": packed(number[place[b:e]])}
                for r, b, e in zip(rows, ends[:-1], ends[1:])
            ]
            yield pa.RecordBatch.from_pylist(back, LEVEL)
            null = pa.nulls(len(often), pa.int64())
            if of_words:
                split = [names[i].as_py().rpartition(b"\n") for i in often]
                named = [pa.array([x.decode() for x, _, _ in split], pa.string()), pa.array([x.decode() for _, _, x in split], pa.string()), null]
            else:
                named = [pa.nulls(len(often), pa.string()), pa.nulls(len(often), pa.string()), pa.array(names[often], pa.int64())]
            columns = [null, null, pa.nulls(len(often), pa.int32()), pa.nulls(len(often), pa.binary()), pa.array(number[often], pa.int64()), *named]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[often], pa.int64())], schema=LEVEL)

    return run


def phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    block: int = BLOCK,
    part_bytes: int = PART_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``max_words`` words that stand ``min_count`` times in a language: ``lang``, ``words``, ``f``;
    and the words of each language: ``lang``, ``n``.

    A null language is "und"; null and empty texts have no words.  Rows that repeat count each.  A task holds about
    ``block`` bytes of texts (or one text), a block's relations, or ``part_bytes`` of names.  Blocks, frequent groups and
    what goes back to the blocks are written to the folder all executors share, so a lost one costs its own tasks.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "phrases")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    r1 = kept(blocks_of(docs, text, lang, block), "occurrences")
    n = r1.groupBy("lang").agg(F.sum("n").alias("n"))
    size = r1.agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-8 * (size["n"] or 0) // part_bytes))
    over = max(tasks, -(-size["blocks"] // 2))

    dealt = r1.select("block", "spot", "lang", "words", "counts").mapInArrow(deal_words(parts), DEALT_TYPE)
    back, bases, counted = None, [], None
    out = []
    for level in range(1, max_words + 1):
        done = kept(dealt.repartitionById(parts, F.col("part")).mapInArrow(tally(parts, min_count, level == 1), LEVEL_TYPE), f"groups-{level}")
        groups = done.where(F.col("block").isNull())
        if level == 1:
            words = groups.select("lang", "number", "word", F.col("a").alias("f"))
            counted = words.select("lang", "number", F.array("word").alias("words"), "f")
        else:
            base = bases[-1]
            named = groups.select((F.expr(f"name div {base}")).alias("left"), (F.col("name") % base).alias("last"), F.col("number"), F.col("a").alias("f"))
            named = named.join(counted.select(F.col("number").alias("left"), "lang", "words"), "left")
            named = named.join(words.select(F.col("number").alias("last"), "word"), "last")
            counted = kept(named.select("lang", "number", F.concat("words", F.array("word")).alias("words"), "f"), f"phrases-{level}")
        out.append(counted.select("lang", "words", "f"))
        highest = groups.agg(F.max("number")).first()[0]
        if level == max_words or highest is None:
            break
        # The number of words is the base of all names.
        bases.append(bases[0] if bases else highest + 1)
        if (highest + 1) * bases[0] >= 2**63:
            raise OverflowError("more frequent groups than 64-bit names can tell apart")
        mine = done.where(F.col("block").isNotNull()).select("block", "spot", F.lit(level).alias("level"), "part", "numbers")
        back = mine if back is None else back.union(mine)
        gone = F.lit(None)
        rows = r1.select("block", "spot", F.lit(0).alias("level"), F.lit(-1).alias("part"), gone.cast("binary").alias("numbers"), "lang", "words", "places")
        rows = rows.unionByName(back, allowMissingColumns=True)
        rows = rows.repartitionById(over, (F.col("spot") % over).cast("int")).sortWithinPartitions("block", "level", "part")
        dealt = rows.mapInArrow(extend([parts] * (level + 1), list(bases)), DEALT_TYPE)
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found, n


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int | None = TOP,
    covered: int = COVERED,
    block: int = BLOCK,
) -> DataFrame:
    """The first ``top`` phrases (all if None) of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases have 2 to ``max_words`` words and stand ``a`` >= ``min_count`` times.  ``score`` is floor(1000000 a a / (l r)) of the
    cut that makes it smallest, ``l`` and ``r`` being how often the two sides stand.  A phrase inside a longer one that
    stands at least ``covered`` percent as often is dropped.  An empty table gives no rows.
    """
    found, n = phrases(docs, text, lang, min_count, max_words, block)
    joined = lambda words: F.array_join(words, " ")  # noqa: E731  words hold no space
    found = found.select("lang", "words", "f", joined("words").alias("phrase"), F.size("words").alias("k"))
    candidates = found.where("k > 1")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("left", joined(F.slice("words", F.lit(1), F.col("cut")))).withColumn("right", joined(F.slice("words", F.col("cut") + 1, F.col("k"))))
    sides = found.select("lang", F.col("phrase").alias("side"), "f")
    cuts = cuts.join(sides.select("lang", F.col("side").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(sides.select("lang", F.col("side").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"  # noqa: E731  products have up to 38 digits
    score = F.expr(f"CAST(({wide('f')} * {wide('f')} * 1000000) div ({wide('l')} * {wide('r')}) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", F.col("f").alias("a")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    # Phrases of two words or more inside longer ones.
    spans = [(at, size) for size in range(2, max_words) for at in range(1, max_words - size + 2)]
    if spans:
        inner = F.array(*(F.when(F.col("k") >= F.lit(max(size + 1, at + size - 1)), joined(F.slice("words", at, size))) for at, size in spans))
        longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").where(F.col("phrase").isNotNull())
        longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * covered))

    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    ranked = scored.select("lang", place.alias("rank"), "phrase", "a", "best")
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.join(n, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


TWIN = f"""
    WITH pieces AS (
        SELECT coalesce(lang, '{UNKNOWN}') AS lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS words
        FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
    grams AS (
        SELECT lang, phrase, k, count(*) AS f
        FROM (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
            FROM pieces, range(1, {MAX_WORDS + 1}) s(k))
        GROUP BY ALL),
    candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM grams WHERE k > 1 AND f >= {MIN_COUNT}),
    cuts AS (
        SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r,
            ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
        JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:cut], ' ')
        JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')),
    scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    left_over AS (
        SELECT s.* FROM scored s WHERE NOT EXISTS (
            SELECT 1 FROM candidates c WHERE c.lang = s.lang AND 100 * c.f >= {COVERED} * s.a AND c.phrase <> s.phrase
                AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM left_over JOIN total USING (lang) QUALIFY rank <= {TOP}"""
