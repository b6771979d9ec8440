"""Near-duplicate embeddings by an exact metric range join.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), the range.  Every vector belongs to the cell of its nearest
pivot.  What lies in another pivot's cell lies beyond the plane halfway between the two pivots, so two vectors of different
cells can be partners only if that plane is within the range of both.

Vectors move once: different ones are written as blocks, files in the order of label and cell in the shared folder.  A task
reads two blocks and lets each cell of one meet each cell of the other, so that reading and comparing grow with the pairs of
blocks, but not what is moved or stored.

Of the rows that meet, a few coordinates in a turn of the space that takes the widest directions first are compared before
the rest: their distance is never above the whole one, so only pairs within the range by them are compared in full.  This is
done in single precision, and what is too close to the bound to tell is decided in double.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm.common import durable, forest, pieces, quoted, shared_folder, table
from foliomill.llm.graph import components
from foliomill.sources.opener import filesystem_of

COSINE = 0.98
# Vectors, chosen by hash, from which pivots are taken and their number is estimated; all vectors are joined.  Vectors of
# lengths beyond the most frequent ones get one pivot.
SAMPLE, MOST_PIVOTS, MOST_LENGTHS = 4096, 1024, 16
# A block's vectors, and bytes, at most (a range of rows may come out somewhat larger).
BLOCK, BLOCK_BYTES = 1 << 16, 16 << 20
# A row seen by a cell costs about as much as this many comparisons, and two cells that meet as much as this many such rows.
ROW_COST, MEETING = 100, 500
# Tasks in which blocks meet, at least, where there are so many pairs of them.
TASKS = 512
# Coordinates that are compared first, the share of pairs they are to leave at most, and vectors that are compared at a time.
COORDINATES, LEFT, STRIP = 16, 0.002, 1024
# From this share of pairs on all are compared in full at once.
DENSE = 1 / 16
# Cells of a block that are seen from the other block at a time, and rows.
SEEN_CELLS, SEEN_ROWS = 64, 8192


def rounding(size: int) -> float:
    """More than what single precision and rounded coordinates change in a product of two units of that many coordinates."""
    return 1e-5 + 2e-7 * size


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of id, label and vector that can have partners, and their vectors (doubles), for each length of vectors."""
    given = batch.column(2)
    length = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(length) - length
    values = given.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(length[length > 0]):
        rows = np.flatnonzero(known & (length == size))
        x = values[begin[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield rows[good], x[good]


def keys_of(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(v, digest_size=16).digest() for v in x]


def chosen(vectors: DataFrame, vector: str, id_column: str, label: str) -> DataFrame:
    return vectors.select(quoted(id_column).cast("bigint").alias("id"), quoted(label).cast("string").alias("label"), quoted(vector).alias("v"))


def cleaned(given: DataFrame) -> DataFrame:
    """``id``, ``label``, ``key`` (hash of the vector; null if the row links with nothing) and ``size`` (its length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            keys, sizes = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int32)
            for rows, x in by_length(batch):
                keys[rows], sizes[rows] = keys_of(x), x.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys.tolist(), pa.binary()), pa.array(sizes)], names=["id", "label", "key", "size"]
            )

    return given.mapInArrow(run, "id bigint, label string, key binary, size int")


def binary(x: np.ndarray) -> pa.Array:
    """The rows' bytes; those that single precision holds, in single precision."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    fits = (single == x).all(axis=1)
    if not fits.all():
        return pa.array([(s if f else v).tobytes() for s, v, f in zip(single, x, fits)], pa.binary())
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(single)])


def units(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
    x = x.astype(kind)
    # Scaled by the largest component first, so that no square overflows.
    x /= np.maximum(x.max(axis=1), -x.min(axis=1))[:, None]
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each point's nearest pivot, of units; points may be any multiples of units.

    Coordinates are rounded to integers whose products add up exactly in any order, so equal points get one cell anywhere.
    """
    if len(pivots) == 1:
        return np.zeros(len(points), np.int64)
    scale = 2.0 ** ((52 - math.ceil(math.log2(max(2, points.shape[1])))) // 2)
    ends, own = np.rint(pivots * scale).T, np.zeros(len(points), np.int64)
    for at in range(0, len(points), 1024):
        x = points[at : at + 1024].astype(np.float64)
        x /= np.abs(x).max(axis=1)[:, None]
        own[at : at + 1024] = (np.rint(x * scale) @ ends).argmax(axis=1)
    return own


def apart(pivots: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * pivots @ others.T, 0))


def within(near_own: np.ndarray, near: np.ndarray, between: np.ndarray, radius: float, slack: float) -> np.ndarray:
    """Whether the plane between the own pivot and another is within the radius, by the products with both."""
    # How far the plane lies, times the pivots' distance.
    return near_own - near <= (radius + slack) * between + slack


def visited(points: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each point's own cell, and which cells it has to be seen in."""
    own, near = nearest(points, pivots), points @ pivots.T
    return own, within(near[np.arange(len(own)), own][:, None], near, apart(pivots, pivots)[own], radius, rounding(points.shape[1]))


def turned(points: np.ndarray, coordinates: int = COORDINATES, axes: np.ndarray | None = None) -> np.ndarray:
    """The points' coordinates along ``axes``, or the first ones in a fixed turn of their space."""
    return points @ (fixed(points.shape[1], coordinates) if axes is None else axes)


def fixed(size: int, coordinates: int = COORDINATES) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(size).normal(size=(size, min(coordinates, size))))[0]


def widest(sample: np.ndarray, cosine: float) -> np.ndarray:
    """Orthogonal axes in which the sample's differences are widest, so many that few pairs of it stay within the range."""
    some = sample[:1024]
    axes = np.linalg.svd(some - some.mean(axis=0), full_matrices=False)[2].T
    count = min(COORDINATES, axes.shape[1])
    while count < axes.shape[1]:
        first = some @ axes[:, :count]
        square = (first * first).sum(axis=1)
        within_range = square[:, None] + square - 2 * first @ first.T <= 2 - 2 * cosine
        if within_range.sum() - len(some) <= LEFT * len(some) ** 2:
            break
        count = min(axes.shape[1], 2 * count)
    return np.ascontiguousarray(axes[:, :count])


def true_places(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of bytes in a buffer that goes on to a multiple of 8, faster where few are set."""
    words = flags.view(np.uint64).nonzero()[0]
    word, byte = flags.reshape(-1, 8)[words].nonzero()
    return words[word] * 8 + byte


# Arrays for products and comparisons, kept by each worker process: new ones cost more than the work in them.
SCRATCH: dict[str, np.ndarray] = {}


def scratch(name: str, count: int, kind: type) -> np.ndarray:
    if name not in SCRATCH or len(SCRATCH[name]) < count:
        SCRATCH[name] = np.zeros(count, kind)
    return SCRATCH[name][:count]


def factors(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the first coordinates, what two points' product is taken of: minus half the square of their distance."""
    half = np.einsum("ij,ij->i", first, first)[:, None] / -2
    one = np.ones_like(half)
    return np.concatenate([first, half, one], axis=1).astype(np.float32), np.concatenate([first, one, half], axis=1).astype(np.float32)


def close_pairs(
    points: np.ndarray,
    first: np.ndarray,
    cosine: float,
    strip: np.ndarray,
    others: np.ndarray,
    to: tuple[np.ndarray, np.ndarray] | None = None,
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    dense: Callable[[np.ndarray], None] | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of the points ``strip`` and ``others`` have at least that cosine, as pairs of places in these, and how many
    pairs were compared in full.  ``first`` are the points' first coordinates.  If ``others`` are places elsewhere, ``to`` has
    the points there, and ``first`` and ``to`` have ``factors`` of first coordinates.  ``exact`` gives the products in double
    for pairs that single precision can't tell; without it those of ``points`` count.  Where many pairs had to be compared,
    ``dense`` gets who is close to whom as a matrix instead."""
    if to is None:
        facing, left, right = points, factors(first[strip])[0], factors(first[others])[1]
    else:
        facing, left, right = to[0], first[strip], to[1][others]
    count, slack = len(left) * len(right), rounding(points.shape[1])
    near, flags = scratch("near", count, np.float32), scratch("flags", (count + 7) // 8 * 8, np.bool_)
    np.matmul(left, right.T, out=near.reshape(len(left), len(right)))
    np.greater_equal(near, np.float32(cosine - 1 - slack), out=flags[:count])
    flags[count:] = False
    places = np.count_nonzero(flags)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    band = slack if exact else 0
    if places > DENSE * count:
        product = points[strip] @ facing[others].T
        i = j = None
    else:
        i, j = np.divmod(true_places(flags), len(right))
        product = np.empty(len(i), points.dtype)
        for at in range(0, len(i), 1 << 14):
            part = slice(at, at + (1 << 14))
            product[part] = np.einsum("ij,ij->i", points[strip[i[part]]], facing[others[j[part]]])
    close = product >= cosine + band
    if exact:
        unsure = (product >= cosine - band) & ~close
        which = unsure.ravel().nonzero()[0]
        for at in range(0, len(which), 1 << 14):
            some = which[at : at + (1 << 14)]
            a, b = np.divmod(some, len(right)) if i is None else (i[some], j[some])
            close.ravel()[some] = exact(strip[a], others[b]) >= cosine
    if i is not None:
        return i[close], j[close], len(i)
    if dense:
        dense(close)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    return *close.nonzero(), count


def choose_pivots(sample: np.ndarray, rows: int, labels: int, radius: float) -> np.ndarray:
    """As many pivots as make meetings and comparisons together cheapest, judged on the sample."""
    best, cost, alike = sample[:1], math.inf, max(1, rows / labels)
    count = 1
    while count <= min(MOST_PIVOTS, max(1, len(sample) // 2)):
        rest = sample[count:] if len(sample) > count else sample
        own, seen = visited(rest, sample[:count], radius)
        # Of each cell, the share of all that another cell sees.
        share = np.stack([np.bincount(own[seen[:, c]], minlength=count) for c in range(count)], axis=1) / len(rest)
        this = ROW_COST * (share.sum() + MEETING * count**2 / alike) + alike * (share * share.T).sum()
        if this < cost:
            best, cost = sample[:count], this
        count *= 2
    return best


@dataclass
class Side:
    """Different vectors of one label and length, by cell; ``raw`` are their numbers as given."""

    node: np.ndarray
    copies: np.ndarray
    cell: np.ndarray
    raw: np.ndarray
    unit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    near_own: np.ndarray
    cells: np.ndarray
    bounds: np.ndarray


def numbers(raw: pa.Array, size: int) -> np.ndarray:
    """The stored rows as a matrix, doubles unless all are in single precision."""
    raw = raw.cast(pa.binary())
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int32, len(raw) + 1, raw.offset * 4)
    for kind in (np.float32, np.float64):
        width = np.dtype(kind).itemsize * size
        if (np.diff(at) == width).all():
            return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind).reshape(len(raw), size)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * size else np.float64).astype(np.float64) for r in raw.to_pylist()])


def sides_of(files: list[str], space: Callable[[int], tuple[np.ndarray, np.ndarray]], wanted: int | None = None) -> Iterator[Side]:
    """The sides in the files of a block, in the order of kinds; ``wanted``: the place of the only one asked for.

    ``space`` has pivots and axes for a length of vectors."""
    tables = []
    for path in files:
        filesystem, inner = filesystem_of(path)
        with filesystem.open_input_file(inner) as stream:
            tables.append(pq.ParquetFile(stream).read(columns=["kind", "cell", "node", "copies", "size", "raw"]))
    rows = pa.concat_tables(tables).combine_chunks()
    # Rows come by kind and cell, unless files are named in another order than that of their ranges.
    order = np.lexsort([rows.column(name).to_numpy() for name in ("cell", "kind")])
    if (np.diff(order) != 1).any():
        rows = rows.take(pa.array(order)).combine_chunks()
    column = {name: rows.column(name).chunk(0).to_numpy() for name in ("kind", "cell", "node", "copies", "size")}
    kinds, begin = np.unique(column["kind"], return_index=True)
    end = np.append(begin[1:], len(rows))
    for k in range(len(kinds)) if wanted is None else [wanted % len(kinds)]:
        cut = slice(begin[k], end[k])
        size = int(column["size"][begin[k]])
        pivots, axes = (x.astype(np.float32) for x in space(size))
        raw = numbers(rows.column("raw").chunk(0).slice(begin[k], end[k] - begin[k]), size)
        cell, unit = column["cell"][cut], np.empty(raw.shape, np.float32)
        left, right = np.empty((2, len(raw), axes.shape[1] + 2), np.float32)
        near_own = np.empty(len(raw), np.float32)
        for at in range(0, len(raw), SEEN_ROWS):
            part = slice(at, at + SEEN_ROWS)
            unit[part] = units(raw[part], raw.dtype)
            left[part], right[part] = factors(turned(unit[part], axes=axes))
            near_own[part] = np.einsum("ij,ij->i", unit[part], pivots[cell[part]])
        cells, bounds = np.unique(cell, return_index=True)
        yield Side(column["node"][cut], column["copies"][cut], cell, raw, unit, left, right, near_own, cells, np.append(bounds, len(raw)))


def meetings(a: Side, b: Side, pivots: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows of ``a`` and ``b`` that have to be compared, cell by cell, and whether they are the same rows.

    Cells of one block meet once, the lower number first."""
    size = pivots.shape[1]
    slack, there = rounding(size), pivots[b.cells]
    single = there.astype(np.float32).T
    for group in range(0, len(a.cells), SEEN_CELLS):
        cells = a.cells[group : group + SEEN_CELLS]
        between = apart(pivots[cells], there).astype(np.float32)
        seen = np.empty((len(cells), len(b.cell)), bool)
        place, here = np.searchsorted(b.cells, b.cell), pivots[cells].astype(np.float32).T
        for at in range(0, len(b.cell), SEEN_ROWS):
            part = slice(at, at + SEEN_ROWS)
            seen[:, part] = within(b.near_own[part, None], b.unit[part] @ here, between.T[place[part]], radius, slack).T
        for c, cell in enumerate(cells):
            facing = np.logical_or.reduceat(seen[c], b.bounds[:-1])
            if a is b:
                facing &= b.cells > cell
                yield (own := np.arange(a.bounds[group + c], a.bounds[group + c + 1])), own, True
            for begin in range(a.bounds[group + c], a.bounds[group + c + 1], SEEN_ROWS):
                part = slice(begin, min(begin + SEEN_ROWS, a.bounds[group + c + 1]))
                shown = within(a.near_own[part, None], a.unit[part] @ single, between[c], radius, slack).T
                for d in (facing & shown.any(axis=1)).nonzero()[0].tolist():
                    low, high = b.bounds[d], b.bounds[d + 1]
                    yield begin + shown[d].nonzero()[0], low + seen[c, low:high].nonzero()[0], False


@dataclass
class Links:
    """Links among so many rows: their number per row, and the rows that hang together."""

    rows: int
    count: np.ndarray = field(init=False)
    root: np.ndarray = field(init=False)
    waiting: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    held: int = 0

    def __post_init__(self) -> None:
        self.count, self.root = np.zeros(self.rows, np.int64), np.arange(self.rows)

    def add(self, i: np.ndarray, j: np.ndarray, copies: np.ndarray, single: bool) -> None:
        for x, y in ((i, j), (j, i)):
            low = x.min()
            counts = np.bincount(x - low, None if single else copies[y])
            self.count[low : low + len(counts)] += counts.astype(np.int64)
        x, y = self.root[i], self.root[j]
        new = np.flatnonzero(x != y)
        self.wait(x[new], y[new])

    def add_matrix(self, i: np.ndarray, j: np.ndarray, close: np.ndarray, copies: np.ndarray, single: bool) -> None:
        """``close``: which of the different rows ``i`` are linked with which of the different rows ``j``."""
        for x, y, linked in ((i, j, close), (j, i, close.T)):
            self.count[x] += linked.sum(axis=1) if single else (linked @ copies[y].astype(np.float64)).astype(np.int64)
        if len(np.unique(np.concatenate([self.root[i], self.root[j]]))) > 1:
            # The first link of each row ties nearly all that others would.
            a, b = close.any(axis=1).nonzero()[0], close.any(axis=0).nonzero()[0]
            self.wait(self.root[np.concatenate([i[a], i[close.argmax(axis=0)[b]]])], self.root[np.concatenate([j[close.argmax(axis=1)[a]], j[b]])])
            self.tie()
            x, y = self.root[i], self.root[j]
            a, b = (close & (x[:, None] != y)).nonzero()
            self.wait(x[a], y[b])

    def wait(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            self.waiting.append((x, y))
            self.held += len(x)
            if self.held > 1 << 16:
                self.tie()

    def tie(self) -> None:
        if self.held:
            x, y = (np.concatenate(e) for e in zip(*self.waiting))
            ends, number = np.unique(self.root[np.concatenate([x, y])], return_inverse=True)
            whole = np.arange(self.rows)
            whole[ends] = ends[forest(number[: len(x)], number[len(x) :], len(ends))]
            self.root = whole[self.root]
            self.waiting, self.held = [], 0


def links_between(a: Side, b: Side, pivots: np.ndarray, cosine: float) -> pa.RecordBatch:
    """``node``, ``other`` (a node it hangs together with) and ``links`` for the vectors of two blocks that have links there."""
    shift = 0 if a is b else len(a.node)
    node, copies = (a.node, a.copies) if a is b else (np.concatenate([a.node, b.node]), np.concatenate([a.copies, b.copies]))
    single, links, to = (copies == 1).all(), Links(len(node)), (b.unit, b.right)

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", units(a.raw[i]), units(b.raw[j]))

    for rows, others, same in meetings(a, b, pivots, math.sqrt(2 - 2 * cosine)):
        for at in range(0, len(rows), STRIP):
            strip = rows[at : at + STRIP]
            for to_at in range(at if same else 0, len(others), STRIP):
                facing, own = others[to_at : to_at + STRIP], same and at == to_at

                def dense(close: np.ndarray, strip=strip, facing=facing, own=own) -> None:
                    if own:
                        close = np.triu(close, 1)
                    # Different vectors of one id are no links of it.
                    close &= node[strip][:, None] != node[facing + shift]
                    links.add_matrix(strip, facing + shift, close, copies, single)

                i, j, _ = close_pairs(a.unit, a.left, cosine, strip, facing, to, exact, dense)
                if own:
                    i, j = i[i < j], j[i < j]
                i, j = strip[i], facing[j] + shift
                different = node[i] != node[j]
                i, j = i[different], j[different]
                if len(i):
                    links.add(i, j, copies, single)
    links.tie()
    linked = np.flatnonzero(links.count)
    return pa.RecordBatch.from_arrays(
        [pa.array(node[linked], pa.int64()), pa.array(node[links.root[linked]], pa.int64()), pa.array(links.count[linked], pa.int64())],
        names=["node", "other", "links"],
    )


def meeting_blocks(files: list, block: int) -> list[tuple[list[str], list[str] | None]]:
    """Blocks of about ``block`` rows, and which of them hold vectors of one kind: pairs of lists of files, or a list alone.

    ``files`` have ``low`` and ``high`` kinds and ``rows``, in the order of kinds."""
    blocks: list[list] = []
    for file in files:
        if blocks and blocks[-1][3] + file["rows"] <= block:
            blocks[-1][0].append(file["file"])
            blocks[-1][2], blocks[-1][3] = file["high"], blocks[-1][3] + file["rows"]
        else:
            blocks.append([[file["file"]], file["low"], file["high"], file["rows"]])
    pairs = []
    for x, (names, _, high, _) in enumerate(blocks):
        pairs.append((names, None))
        for others, low, _, _ in blocks[x + 1 :]:
            if low > high:
                break
            pairs.append((names, others))
    return pairs


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as columns in the shared folder, of which they take less than checkpoints; the plan itself where there is none."""
    path = written_to(df.sparkSession, kind)
    if not path:
        return df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_to(spark: SparkSession, kind: str) -> str | None:
    if spark.conf.get("spark.checkpoint.dir", None):
        return shared_folder(spark, kind)
    own = spark.sparkContext.getCheckpointDir()
    return own and f"{own}/{kind}-{uuid.uuid4().hex}"


def sample_of(given: DataFrame, sizes: list) -> dict[int, np.ndarray]:
    """Up to ``SAMPLE`` different vectors (units) of each length in ``sizes``, those of the smallest hashes."""
    # Hashes are even, so that many lie below a bound; some more are taken, as the number of different ones is estimated.
    bound = {s["size"]: (1 << 128) * SAMPLE * 5 // (4 * max(1, s["nodes"])) for s in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in pieces(batches, 4 << 20):
            for _, x in by_length(batch):
                most = bound.get(x.shape[1], 0)
                keys = keys_of(x)
                # A task hands on each once; it meets few of them.
                first = [i for i, key in enumerate(keys) if int.from_bytes(key, "big") < most and not (key in seen or seen.add(key))]
                if first:
                    columns = [pa.array([keys[i] for i in first], pa.binary()), binary(x[first]), pa.array(np.full(len(first), x.shape[1], np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "raw", "size"])

    rows = given.mapInArrow(run, "key binary, raw binary, size int").groupBy("key", "size").agg(F.first("raw").alias("raw"))
    place = F.row_number().over(Window.partitionBy("size").orderBy("key"))
    found = rows.withColumn("place", place).where(F.col("place") <= SAMPLE).orderBy("size", "key").select("size", "raw").toArrow()
    out = {}
    for s in sizes:
        raw = found.column("raw").filter(pc.equal(found.column("size"), s["size"])).combine_chunks()
        if len(raw):
            out[s["size"]] = units(numbers(raw, s["size"]))
    return out


def blocks_of(given: DataFrame, space: Callable[[int], tuple[np.ndarray, np.ndarray]], parts: int) -> DataFrame:
    """The different vectors of each label, with the smallest ``node`` of those that are equal and how many ``copies`` there
    are, ``kind`` (label and length) and ``cell``, in ranges of these."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            for rows, x in by_length(batch):
                keys, labels, ids = keys_of(x), batch.column(1).take(pa.array(rows)).to_pylist(), batch.column(0).take(pa.array(rows)).to_numpy()
                # What is equal within a batch goes on as one row, so that a vector of very many rows is no burden.
                found: dict[tuple, int] = {}
                number = np.fromiter((found.setdefault(k, len(found)) for k in zip(labels, keys)), np.int64, len(keys))
                node = np.full(len(found), np.iinfo(np.int64).max)
                np.minimum.at(node, number, ids)
                first = np.full(len(found), len(keys))
                np.minimum.at(first, number, np.arange(len(keys)))
                cell = nearest(x[first], space(x.shape[1])[0]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node),
                        pa.array(np.bincount(number)),
                        pa.array([k[0] for k in found], pa.string()),
                        pa.array([k[1] for k in found], pa.binary()),
                        pa.array(np.full(len(found), x.shape[1], np.int32)),
                        pa.array(cell),
                        binary(x[first]),
                    ],
                    names=["node", "copies", "label", "key", "size", "cell", "raw"],
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for name in ("kind", "key", "label"):
                column = rows.column(name)
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            out = rows.take(pa.array(first))
            for at, (name, of_all) in enumerate((("node", np.minimum), ("copies", np.add))):
                out = out.set_column(at, name, pa.array(of_all.reduceat(rows.column(name).to_numpy(), first)))
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    schema = "node bigint, copies bigint, label string, key binary, size int, cell int, raw binary"
    placed = given.mapInArrow(place, schema).withColumn("kind", F.xxhash64("label", "size"))
    # Keys deal out what one cell holds too much of.
    ranges = placed.repartitionByRange(parts, "kind", "cell", "key").sortWithinPartitions("kind", "cell", "key", "label")
    return ranges.mapInArrow(once, f"{schema}, kind bigint")


def range_join(
    vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str = "label", cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """Per row of ``vectors``: the id, ``n_links``, ``component_id`` and ``kept`` (id = component_id).

    Vectors are compared if their labels are equal and not null, and their lengths are equal.  One that is null, empty,
    zero, or holds a null or non-finite component links with nothing, nor does a row without an id; both are kept.
    Equal vectors of a label are one in the search; rows that repeat an id and its vector count once each as copies.
    """
    spark, radius = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    given = chosen(vectors, vector, id_column, label)
    rows = written(cleaned(given), "vectors")
    usable = rows.where("key is not null")
    alone = rows.where("key is null").select(
        F.col("id").alias(id_column), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    sizes = usable.groupBy("size").agg(
        F.count("*").alias("rows"), F.approx_count_distinct("label").alias("labels"), F.approx_count_distinct(F.struct("label", "key")).alias("nodes")
    )
    sizes = sorted(sizes.collect(), key=lambda s: (-s["rows"], s["size"]))  # vector lengths; a table has one as a rule
    if not sizes:
        return alone
    path = written_to(spark, "blocks")
    if not path:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = {}
    samples = sample_of(given, sizes[:MOST_LENGTHS])
    for size in sizes:
        if (sample := samples.get(size["size"])) is not None:
            known[size["size"]] = (choose_pivots(sample, size["nodes"], size["labels"], radius), widest(sample, cosine))
    known = spark.sparkContext.broadcast(known)

    def space(size: int) -> tuple[np.ndarray, np.ndarray]:
        return known.value[size] if size in known.value else (np.eye(1, size), fixed(size))

    # Vectors may come in double precision.
    bytes_, nodes = sum(s["rows"] * (8 * s["size"] + 100) for s in sizes), sum(s["nodes"] for s in sizes)
    parallel = spark.sparkContext.defaultParallelism
    parts = max(-(-bytes_ // BLOCK_BYTES), -(-nodes // block), min(parallel, -(-nodes // STRIP)))
    blocks_of(given, space, parts).write.parquet(path)
    blocks = spark.read.parquet(path)
    of_file = [F.min("kind").alias("low"), F.max("kind").alias("high"), F.count("*").alias("rows")]
    files = blocks.groupBy(F.col("_metadata.file_path").alias("file")).agg(*of_file).collect()
    files = sorted(files, key=lambda f: (f["low"], f["high"], f["file"]))  # some 16 MB each
    # As few blocks as give every core a pair of them, or as fill the memory for them.
    few = max(1, min(parallel, math.isqrt(2 * parallel * sum(s["labels"] for s in sizes))))
    fitting = max(1, BLOCK_BYTES * nodes // max(1, sum(s["nodes"] * 4 * s["size"] for s in sizes)))
    pairs = meeting_blocks(files, min(block, fitting, max(STRIP, -(-sum(f["rows"] for f in files) // few))))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs come by their first block, of which the last kind is kept.
        held, a = None, None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                names, others = pairs[number]
                if others is None:
                    held = names
                    for a in sides_of(names, space):
                        yield links_between(a, a, space(a.raw.shape[1])[0], cosine)
                    continue
                if held != names:
                    held, a = names, next(sides_of(names, space, -1))
                # Blocks are ranges of kinds: two have the last of one and the first of the other in common.
                yield links_between(a, next(sides_of(others, space, 0)), space(a.raw.shape[1])[0], cosine)

    numbers_ = spark.range(0, len(pairs), 1, min(len(pairs), max(TASKS, 64 * parallel)))
    joined = durable(numbers_.mapInArrow(meet, "node bigint, other bigint, links bigint"))
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    tied = components(joined.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    found = links.join(tied, "node", "full")
    found = written(blocks.select("label", "key", "node", "copies").join(found, "node", "left"), "components")
    out = usable.select("id", "label", "key").join(found, ["label", "key"]).select(
        "id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")).union(alone)


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return range_join(table(spark, folder, "embeddings"))
