"""What the operators share: row-wise Arrow work, text buffers, hashing, shared folders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.session import durable, shared_folder

__all__ = ["annotate", "durable", "held_out", "mixed", "pieces", "quoted", "shared_folder", "small", "table", "texts_of", "utf8"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(id_column: str, parts: int) -> Column:
    """True where crc32 of the id as text is divisible by ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(quoted(id_column).cast("string"), F.lit("")).cast("binary")) % parts == 0


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast if it has no more than ``rows`` rows (of a hundred bytes or so); joined as usual else."""
    return F.broadcast(df) if df.count() <= rows else df


def pieces(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes, so that work arrays stay small."""
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def annotate(
    df: DataFrame,
    start: Callable[[], Callable[..., list[pa.Array]]],
    fields: list[T.StructField],
    inputs: list[str],
    keep: list[str] | None = None,
    limit: int = 4 << 20,
) -> DataFrame:
    """``df`` with computed columns, made where the rows are.

    ``start`` runs once per task and returns a function from the Arrow arrays of ``inputs`` to those of
    ``fields``.  ``keep`` names the columns handed on (all by default); one named like a new column is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    names = [*kept, *(f.name for f in fields)]
    # Inputs get names of their own, so that no column of the caller's clashes with them.
    given = [f"_input_{i}" for i in range(len(inputs))]
    chosen = [quoted(c).alias(f"_kept_{i}") for i, c in enumerate(kept)] + [quoted(c).alias(g) for c, g in zip(inputs, given)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in pieces(batches, limit):
            made = work(*(batch.column(g) for g in given))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=names)

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + fields)
    return df.select(*chosen).mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column in one array, and where each row's begin (one more than rows); null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed hash of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grouped(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over each group of equal integer ``keys``, one group in memory at a time; groups are to be of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            if held and any(held[0].column(k)[0] != batch.column(k)[0] for k in keys):
                yield work(pa.Table.from_batches(held))
                held = []
            for begin, end in zip(bounds[:-1], bounds[1:]):
                held.append(batch.slice(begin, end - begin))
                if end < batch.num_rows:
                    yield work(pa.Table.from_batches(held))
                    held = []
        if held:
            yield work(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each of ``nodes`` numbers the smallest that the links ``a``-``b`` connect it with."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
