"""Append-only parquet tables, and keyed ones.

A run writes its rows under ``run=<id>`` and replaces only that folder, so a repeated run leaves
the same table.  Nothing is updated in place; the current state is computed from the log.

A keyed table is cut into buckets by a hash of its key.  An upsert rewrites the buckets that its
rows fall into and leaves the others alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.schemas import RECORD_TYPE

# Layouts, needed to read a table that was not written yet.
FILE = "file_hash string, paper_id string, original_filename string, file_path string, file_size_bytes bigint"
PARSED = (
    "paper_id string, title string, doi string, abstract string, publication_year int, authors array<string>, "
    "page_count bigint, parse_method string, raw_text string, parse_error string, status string, parsed_at timestamp"
)
# A paper's generation counts how often it was sent to the model anew; the first extraction is 0.
GENERATION = "paper_id string, generation int, stage string, requested_at timestamp"
PROMPT = "paper_id string, generation int, chunk_no int, prompt_hash string, chunk string"
RAW = (
    "paper_id string, generation int, chunk_no int, prompt_hash string, response string, error string, error_class string, "
    "attempts int, elapsed_s double, input_tokens bigint, output_tokens bigint, called_at timestamp"
)
MERGED = T.StructType(
    [
        T.StructField("paper_id", T.StringType()),
        T.StructField("generation", T.IntegerType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_failed", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("record", RECORD_TYPE),
        T.StructField("extracted_at", T.TimestampType()),
    ]
)
JOURNAL = "journal_id string, name string"
AUTHOR = "author_id string, full_name string, first_name string, last_name string"
LINK = "paper_id string, author_id string, position int"
OUTPUT = "paper_id string, summary_path string, extraction_json_path string"
# Changes by hand.  A tombstone or patch counts for what was there when it was written.
TOMBSTONE = "paper_id string, deleted_at timestamp"
PAPER_PATCH = (
    "paper_id string, patch_id string, patched_at timestamp, title string, doi string, abstract string, "
    "publication_year int, keywords array<string>, volume string, issue string, pages string"
)

# Buckets of a keyed table; a stored table keeps the number it was made with.
BUCKETS = 64


@dataclass(frozen=True)
class Lake:
    """A folder of tables."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame, run: str, by: str | None = None) -> DataFrame:
        """Writes ``rows`` as this run's part of ``table`` and returns what was written.

        ``by`` names a column whose values get a folder each below the run's.
        """
        folder = f"{self.path(table)}/run={run}"
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def clear(self, table: str, runs: list[str], layout: str, by: str | None = None) -> None:
        """Empties the parts of ``runs``, whose rows stand elsewhere by now."""
        for run in runs:
            self.append(table, self.spark.createDataFrame([], layout), run, by)

    def bucket(self, key: str, buckets: int = BUCKETS) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def upsert(self, table: str, rows: DataFrame, key: str, layout: str, keep_old: bool = False, buckets: int = BUCKETS) -> list[int]:
        """Puts ``rows`` into a keyed table: all rows of their keys are replaced (``keep_old``: those of known keys stay).

        Only buckets that ``rows`` fall into are read and rewritten; their numbers are returned.  ``rows`` should come from
        a written table.  Doing the same again leaves the same table.
        """
        new = rows.withColumn("bucket", self.bucket(key, buckets))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        old = self.read(table, f"{layout}, bucket int").where(F.col("bucket").isin(touched))
        if keep_old:
            settled = old.unionByName(new.join(old.select(key), key, "left_anti"))
        else:
            settled = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
        # The old buckets are read while they are replaced, so the new ones are written aside first.
        aside = f"{self.path(table)}-next"
        settled.write.mode("overwrite").parquet(aside)
        settled = self.spark.read.schema(settled.schema).parquet(aside)
        # A bucket is a file or two: its rows meet in one task, or in several where there are very many.
        placed = settled.repartition(F.col("bucket"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(table))
        return touched

    def read_keyed(self, table: str, layout: str, keys: DataFrame | None = None, key: str | None = None, buckets: int = BUCKETS) -> DataFrame:
        """A keyed table, or only the rows of ``keys``: then only their buckets are opened."""
        stored = self.read(table, f"{layout}, bucket int")
        if keys is not None:
            wanted = keys.select(key).distinct()
            touched = [r[0] for r in wanted.select(self.bucket(key, buckets)).distinct().collect()]
            stored = stored.where(F.col("bucket").isin(touched) if touched else F.lit(False)).join(wanted, key, "left_semi")
        return stored.drop("bucket")

    def replace_keyed(self, table: str, rows: DataFrame) -> None:
        """Makes ``rows``, taken from the keyed table itself and with their ``bucket``, all that it holds."""
        if self.stored(table) is None:
            return
        aside = f"{self.path(table)}-next"
        rows.write.mode("overwrite").parquet(aside)
        kept = self.spark.read.schema(rows.schema).parquet(aside)
        kept.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self.path(table))

    def stored(self, table: str) -> DataFrame | None:
        """A table in the layout it was written with; None if it never was."""
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def read(self, table: str, schema: T.StructType | str) -> DataFrame:
        """All runs of a table; empty if it was never written.  ``run`` is there if the schema names it."""
        empty = self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty
        return found.select(*empty.columns)
