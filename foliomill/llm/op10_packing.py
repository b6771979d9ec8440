"""Sum-of-squares online packing of token sequences into windows of fixed size.

A document's ids are cut into full windows and a rest.  Each rest is put into the open window whose level makes the
sum over levels of (number of windows at that level) squared smallest; the counts stand in a level array.  Tasks
pack their own rows.  Every ``FLUSH`` documents, and at its end, a task closes its open windows: the emptiest are
cut up to fill the fullest, and what is left at the last is cut into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from foliomill.llm.common import pieces, quoted, table, texts_of
from foliomill.llm.tokens import encoder_of

WINDOW, END_ID, FLUSH = 1024, 0, 20_000

PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)

Piece = tuple[int, int, int, bytes]  # row, start, the document's ids, the piece's ids


class Packer:
    """Open windows by level; ``count[h]`` of them are filled up to ``h``."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The level to put ``size`` ids on; 0 opens a window.  Ties go to the fullest level."""
        count, top = self.count, self.window - size
        # A window that moves from h to h + size changes the sum by 2 (count[h + size] - count[h] + 1); one that
        # leaves h to be full, by 1 - 2 count[h]; one that is new, by 2 count[size] + 1.
        change = 2 * (count[size : size + top + 1] - count[: top + 1] + 1)
        change[top] = 1 - 2 * count[top]
        change[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[size] + 1 if size < self.window else 0
        return int(top - np.argmin(change[::-1]))

    def put(self, piece: Piece) -> list[Piece] | None:
        """Returns the pieces of a window that this one fills."""
        size = len(piece[3]) // 4
        at = self.level(size)
        held = self.open[at].pop() if at else []
        self.count[at] -= at > 0
        held.append(piece)
        if at + size == self.window:
            return held
        self.open[at + size].append(held)
        self.count[at + size] += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """All open windows, refilled so that none needs padding."""
        left = [(h, held) for h in range(self.window - 1, 0, -1) for held in self.open[h]]
        low, high = 0, len(left) - 1
        spare: list[Piece] = []  # pieces of the emptiest windows
        while low <= high:
            fill, held = left[low]
            low += 1
            while fill < self.window and (spare or low <= high):
                if not spare:
                    spare = left[high][1]
                    high -= 1
                row, start, total, ids = spare.pop()
                take = min(self.window - fill, len(ids) // 4)
                held.append((row, start, total, ids[: 4 * take]))
                if 4 * take < len(ids):
                    spare.append((row, start + take, total, ids[4 * take :]))
                fill += take
            yield from self._powers(held, fill) if fill < self.window else [held]
        if spare:
            yield from self._powers(spare, sum(len(p[3]) for p in spare) // 4)
        self.__init__(self.window)

    def _powers(self, held: list[Piece], fill: int) -> Iterator[list[Piece]]:
        held = held[::-1]
        while fill:
            room = size = 1 << (fill.bit_length() - 1)
            out = []
            while room:
                row, start, total, ids = held.pop()
                take = min(room, len(ids) // 4)
                out.append((row, start, total, ids[: 4 * take]))
                if 4 * take < len(ids):
                    held.append((row, start + take, total, ids[4 * take :]))
                room -= take
            yield out
            fill -= size


def pack(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    window: int = WINDOW,
    json_path: str | None = None,
    ranks_path: str | None = None,
    with_ids: bool = True,
    flush: int = FLUSH,
) -> DataFrame:
    """One row per piece: the id column, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and, unless ``with_ids`` is false, ``ids`` as little-endian 32-bit integers.

    A document is its text's ids and one end id; null or empty text is the end id alone.  Repeated rows are packed
    each.  An empty table gives none.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    end = np.array([END_ID], "<u4").tobytes()
    fields = [f for f in PIECE.fields if with_ids or f.name != "ids"]
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(json_path, ranks_path, pattern), Packer(window)
        # A task that is run again packs the same rows under the same numbers.
        sequence = TaskContext.get().partitionId() << 33
        ids_of_rows: list = []
        out: list[tuple] = []

        def emit(held: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for row, start, total, ids in held:
                n = len(ids) // 4
                out.append((ids_of_rows[row], start, n, zlib.crc32(ids), total, sequence, at, ids))
                at += n
            sequence += 1

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 8
            out.clear()
            types = [pa_type, *[pa.int64()] * 6, pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = [id_column, *(f.name for f in PIECE.fields)]
            return pa.RecordBatch.from_arrays(arrays[: len(schema)], names=names[: len(schema)])

        pa_type = None
        for batch in pieces(batches, 4 << 20):
            pa_type = batch.column(0).type
            for row_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1)))):
                ids += end
                total, row = len(ids) // 4, len(ids_of_rows)
                ids_of_rows.append(row_id)
                for start in range(0, total, window):
                    piece = (row, start, total, ids[4 * start : 4 * (start + window)])
                    full = packer.put(piece) if len(piece[3]) < 4 * window else [piece]
                    if full:
                        emit(full)
                if len(ids_of_rows) >= flush:
                    for held in packer.close():
                        emit(held)
                    ids_of_rows.clear()
            if out:
                yield made()
        for held in packer.close():
            emit(held)
        if out:
            yield made()

    return docs.select(quoted(id_column).alias("_id"), quoted(text).alias("_text")).mapInArrow(run, schema)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), with_ids=False)
