"""A sink that keeps each answer it was given, whatever becomes of the job.

Spark's file writers publish a job's rows when the whole job is done.  Model calls are paid for one by one, so here every
task publishes its rows as it goes: a batch is written beside the table and moved into it when it is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from foliomill.sources.opener import filesystem_of

SINK = "kept_rows"


class KeptRows(DataSource):
    """Appends parquet files to the folder that the option ``path`` names."""

    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("kept rows are only ever appended")
        return KeptRowsWriter(self.options["path"])


class KeptRowsWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, folder = filesystem_of(self.path)
        filesystem.create_dir(folder, recursive=True)
        for batch in iterator:
            if not batch.num_rows:
                continue
            # Readers skip names that begin with a dot, so nobody sees half a file.
            name = f"part-{uuid.uuid4().hex}.parquet"
            with filesystem.open_output_stream(f"{folder}/.{name}") as out:
                pq.write_table(pa.Table.from_batches([batch]), out)
            filesystem.move(f"{folder}/.{name}", f"{folder}/{name}")
        return WriterCommitMessage()


def keep_rows(rows: DataFrame, path: str) -> None:
    """Appends ``rows`` to ``path``, batch by batch (of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows).

    A job that fails leaves what its tasks had written.  A task that is run again writes its rows again, so readers must
    take one row per key.
    """
    rows.sparkSession.dataSource.register(KeptRows)
    rows.write.format(SINK).mode("append").option("path", path).save()
