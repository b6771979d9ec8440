"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone.  An n-gram of letters binds them: the
product of the letters' vectors, each permuted (rolled) by its place in the n-gram.  A text bundles its n-grams (their
sum), a language bundles its training texts, each at unit weight, and a text is compared with the languages by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import annotate, held_out, mixed, pieces, quoted, table

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
# Sums are kept as integers of this scale, so that they don't depend on the order of addition.
SCALE = 1 << 24
# N-grams whose vectors are made at once; bounds the memory, not the text.
BLOCK = 8192


class Bundler:
    """N-gram counts and vectors of many texts at once."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """+1 / -1 by letter and dimension."""
        words = -(-self.dimensions // 64)
        bits = mixed(codes.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(1, words + 1, dtype=np.uint64))
        bits = np.unpackbits(bits.view(np.uint8).reshape(len(codes), -1), axis=1)[:, : self.dimensions]
        return bits.astype(np.float32) * 2 - 1

    def counts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of n-grams: text and n-gram numbers of each occurrence, the n-grams' places in the alphabet, the alphabet."""
        low = pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), "")
        sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = "\n".join(low.to_pylist()) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(self.letter[codes], codes, 32)
        text = np.repeat(np.arange(len(sizes)), sizes + 1)
        kept = np.ones(len(codes), bool)
        kept[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes, text = codes[kept], text[kept]
        seen = np.zeros(int(codes.max(initial=32)) + 1, bool)
        seen[codes] = True
        alphabet = np.flatnonzero(seen)
        size = len(alphabet)
        number = np.zeros(len(seen), np.int64)
        number[alphabet] = np.arange(size)
        at = number[np.concatenate([[32], codes, [32]])] if size else number[:0]
        middle = np.flatnonzero(codes != 32)
        grams = (at[middle] * size + at[middle + 1]) * size + at[middle + 2]
        text = text[middle]
        if size**GRAM <= 1 << 22:
            there = np.zeros(size**GRAM, bool)
            there[grams] = True
            distinct = np.flatnonzero(there)
            place = np.zeros(len(there), np.int64)
            place[distinct] = np.arange(len(distinct))
            index = place[grams]
        else:
            distinct, index = np.unique(grams, return_inverse=True)
        for begin in range(0, len(distinct), BLOCK):
            part = distinct[begin : begin + BLOCK]
            inside = slice(None) if len(distinct) <= BLOCK else (index >= begin) & (index < begin + BLOCK)
            yield text[inside], index[inside] - begin, np.stack([part // size**2, part // size % size, part % size]), alphabet

    def vectors(self, places: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        letters = self.letters(alphabet)
        out = np.roll(letters, GRAM - 1, axis=1)[places[0]]
        for i in range(1, GRAM):
            out *= np.roll(letters, GRAM - 1 - i, axis=1)[places[i]]
        return out

    def bundles(self, texts: pa.Array, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """One vector per text, and the text's number of n-grams."""
        out, total = np.zeros((len(texts), self.dimensions)), np.zeros(len(texts), np.int64)
        for text, index, places, alphabet in self.counts(texts):
            vectors = self.vectors(places, alphabet)
            total += np.bincount(text, minlength=len(texts))
            wide = vectors.shape[0]
            bounds = np.searchsorted(text, np.arange(0, len(texts) + rows, rows))
            for k in range(len(bounds) - 1):
                part = slice(bounds[k], bounds[k + 1])
                n = min(rows, len(texts) - k * rows)
                matrix = np.bincount((text[part] - k * rows) * wide + index[part], minlength=n * wide).reshape(n, wide)
                out[k * rows : k * rows + n] += matrix.astype(np.float32) @ vectors
        return out, total


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes as rows (``lang``, ``place``, ``value``); texts without a letter or language are left out."""
    schema = "lang string, values array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dimensions), {}
        for batch in pieces(batches, 4 << 20):
            found, total = bundler.bundles(batch.column(1))
            unit = found / np.maximum(np.linalg.norm(found, axis=1), 1e-9)[:, None]
            unit = np.rint(unit * SCALE).astype(np.int64)
            names = pc.dictionary_encode(batch.column(0))
            codes = names.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(names.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0) + unit[(codes == code) & (total > 0)].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))],
                names=["lang", "values"],
            )

    labelled = docs.where(quoted(lang).isNotNull()).select(quoted(lang).cast("string"), quoted(text))
    return (
        labelled.mapInArrow(run, schema)
        .select("lang", F.posexplode("values").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )


def prototypes(trained: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors; as many rows as languages, however many texts they come from."""
    rows = trained.toPandas()
    names = sorted(rows["lang"].unique())
    out = np.zeros((len(names), dimensions))
    out[rows["lang"].map({n: i for i, n in enumerate(names)}), rows["place"]] = rows["value"]
    norms = np.linalg.norm(out, axis=1)
    return [n for n, x in zip(names, norms) if x > 0], out[norms > 0] / norms[norms > 0][:, None]


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with that language's prototype, 0 where it is negative.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text where no language was learned.
    Equal cosines go to the first language by name.  Rows stay as they are, repeated ones too.
    """
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix.astype(np.float32)))

    def start():
        names, matrix = shared.value
        bundler = Bundler(matrix.shape[1]) if names else None

        def work(texts: pa.Array) -> list[pa.Array]:
            if not names:
                return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
            found, total = bundler.bundles(texts)
            cosines = (found @ matrix.T) / np.maximum(np.linalg.norm(found, axis=1), 1e-9)[:, None]
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            score[total == 0] = 0
            return [pa.array([names[b] if t else UNKNOWN for b, t in zip(best, total)], pa.string()), pa.array(score, pa.float64())]

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return annotate(docs, start, fields, [text], keep)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """From all documents but the held-out fifth."""
    return prototypes(train(docs.where(~held_out("doc_id", 5))))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, learn(docs), keep=["doc_id"]).select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")
