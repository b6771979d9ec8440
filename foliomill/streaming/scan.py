"""A watched folder as a stream: each trigger takes the files it has not seen.

The stream knows every hash it has met by keyed state in RocksDB, so a trigger does not read the registry for that.  What
other jobs registered meanwhile is looked up in the few registry segments whose filters say so.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliomill.operators.dedup import scan_counts
from foliomill.plans.edits import alive
from foliomill.sources.files import BINARY_FILE, PDF_GLOB, with_fingerprint
from foliomill.sources.opener import Opener, open_file
from foliomill.sources.registry import append_registry, known_papers, register_papers
from foliomill.sources.tables import Lake

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "path string, file_hash string, file_size bigint, error string, outcome string"


def file_stream(
    spark: SparkSession, folder: str, files_per_trigger: int | None = None, opener: Opener = open_file
) -> DataFrame:
    """New PDFs below ``folder`` as a stream of fingerprints.  Spark lists them; each is opened and hashed once, in a task,
    and one that cannot be read is a row with an error."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", PDF_GLOB)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # Only names and sizes are selected, so Spark's own reader opens no file.
    return with_fingerprint(reader.load(folder).select("path", "length"), opener)


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps stream state in RocksDB, which keyed state of any size needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def state_key(file_hash: Column, path: Column) -> Column:
    """Files of one content share a key; one without a hash has its own, so that such files don't meet."""
    return F.coalesce(file_hash, F.concat(F.lit("path~"), path))


class FirstOfContent(StatefulProcessor):
    """The outcome of each file: ``ingested`` for the first of its content over the stream's whole life, else ``skipped``;
    ``failed`` without a hash, which leaves no state.

    Of one trigger's files the first in scan order counts.  Rows of a key stream by; one is held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "path string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        def settled(row: Row, outcome: str) -> Row:
            return Row(path=row["path"], file_hash=row["file_hash"], file_size=row["file_size"], error=row["error"], outcome=outcome)

        known, first = None, None
        for row in rows:
            if row["file_hash"] is None:
                yield settled(row, "failed")
                continue
            if known is None:
                known = self.seen.exists()
            if known:
                yield settled(row, "skipped")
            elif first is None:
                first = row
            else:
                first, later = sorted((first, row), key=lambda r: r["path"].split("/"))
                yield settled(later, "skipped")
        if first is not None:
            self.seen.update((first["path"],))
            yield settled(first, "ingested")

    def close(self) -> None:
        pass


def outcomes_of(files: DataFrame) -> DataFrame:
    """Fingerprints of a stream with their ``outcome``."""
    keyed = files.withColumn("key", state_key(F.col("file_hash"), F.col("path"))).groupBy("key")
    return keyed.transformWithState(
        statefulProcessor=FirstOfContent(), outputStructType=OUTCOME, outputMode="Append", timeMode="None"
    )


def unseen(files: DataFrame) -> DataFrame:
    """The files of a stream that are the first of their content, and all that have no hash."""
    return outcomes_of(files).where(F.col("outcome") != "skipped").drop("outcome")


def register_batch(lake: Lake, batch: DataFrame, batch_id: int) -> None:
    """Registers one trigger's files and writes its counters.

    Both go into folders named after the batch, so a repeated batch replaces itself; the lookup leaves
    out what the same batch wrote before.
    """
    run = f"stream-{batch_id:09d}"
    # Written first, so that the trigger's files are hashed and settled once.
    settled = lake.append("stream_outcomes", batch, run)
    offered = settled.where(F.col("outcome") == "ingested")
    known = lake.append("known_papers", alive(lake, known_papers(lake, offered, run), "registered_at"), run)
    elsewhere = known.select("file_hash", F.lit(True).alias("_known")).distinct()
    found = settled.join(elsewhere, "file_hash", "left")
    outcome = F.when(F.col("_known") & (F.col("outcome") == "ingested"), F.lit("skipped")).otherwise(F.col("outcome"))
    outcomes = lake.append("scan_outcomes", found.withColumn("outcome", outcome).drop("_known").select(*settled.columns), run)
    new = register_papers(outcomes.where(F.col("outcome") == "ingested"), known)
    append_registry(lake, new.drop("status", "is_new"), run)
    lake.append("scan_counts", scan_counts(outcomes), run)


def scan_stream(
    lake: Lake, folder: str, checkpoint: str, files_per_trigger: int | None = None, opener: Opener = open_file
) -> StreamingQuery:
    """Takes all files that are new since the last call, then stops.

    State lives in RocksDB below ``checkpoint`` (the session's provider is set) and outlives deletions: content the stream
    has met stays met for it, while a batch scan takes a deleted paper's file again.
    """
    use_rocksdb(lake.spark)
    files = file_stream(lake.spark, folder, files_per_trigger, opener)
    return (
        outcomes_of(files)
        .writeStream.foreachBatch(lambda batch, batch_id: register_batch(lake, batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
