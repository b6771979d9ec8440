"""Files of a folder as rows: listing, inventory, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.plan import pinned
from foliomill.sources.opener import Opener, open_file

PDF_GLOB = "*.[pP][dD][fF]"
# Bytes of a file that are in memory at a time while it is hashed.
HASH_BLOCK = 4 << 20

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def scan_files(spark: SparkSession, folder: str, glob: str | None = PDF_GLOB) -> DataFrame:
    """All files below ``folder`` that match ``glob`` (every PDF, whatever the case of its extension).

    Spark lists no files of zero bytes.  Contents are read only if the column is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def folder_inventory(files: DataFrame, *by: str) -> DataFrame:
    """One row (or one per value of ``by``): number of files and PDFs, bytes, and whether the folder looks like an empty
    stand-in.

    Reads names and sizes only; file contents are not touched.
    """
    is_pdf = F.lower("path").endswith(".pdf")
    is_marker = F.element_at(F.split("path", "/"), -1) == ".gitkeep"
    counts = files.select(*by, "path", "length").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(is_pdf).alias("n_pdfs"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if(~is_marker).alias("n_real"),
    )
    return counts.select(
        *by, "n_files", "n_pdfs", "total_bytes", ((F.col("n_pdfs") == 0) & (F.col("n_real") == 0)).alias("is_empty_fallback")
    )


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """``path, file_hash, file_size, error``: the content is reduced to its hash before anything moves."""
    hashed = pinned(files.select("path", "length", content), file_hash=F.sha2(F.col(content), 256))
    return hashed.select(
        "path", "file_hash", F.col("length").alias("file_size"), F.lit(None).cast("string").alias("error")
    )


def with_fingerprint(files: DataFrame, opener: Opener = open_file, block: int = HASH_BLOCK) -> DataFrame:
    """Fingerprints of listed files (``path, length``) of any size: ``path, file_hash, file_size, error``.

    Each task opens its own files and hashes them block by block, once; their contents are never a cell of a row.  A file
    that cannot be opened or read to its end becomes a row with an error and no hash.
    """

    def hashed(path: str) -> tuple[str | None, str | None]:
        digest = hashlib.sha256()
        try:
            with opener(path) as stream:
                while data := stream.read(block):
                    digest.update(data)
        except Exception as failure:  # noqa: BLE001 - any failure of a file is that file's outcome
            return None, f"{path.rsplit('/', 1)[-1]}: {failure}"
        return digest.hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashed(path) for path in batch.column("path").to_pylist()]
            hashes, errors = ([row[i] for row in found] for i in range(2))
            columns = [batch.column("path"), pa.array(hashes, pa.string()), batch.column("length"), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "file_hash", "file_size", "error"])

    return files.select("path", "length").mapInArrow(run, "path string, file_hash string, file_size bigint, error string")


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)
