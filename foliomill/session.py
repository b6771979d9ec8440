"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes and splits hot partitions,
# so the operators carry no size hints of their own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A page far down a listing is found by a distributed sort instead of a heap in every task.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # A response row carries a whole text chunk; keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Of a key that an answer repeats the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Model calls are side effects: never run a second copy of a slow task.
    "spark.speculation": "false",
}


def build_session(app_name: str = "foliomill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors and the driver share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as columns in the shared folder, for a result that several branches of a job or several jobs read."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """``df`` saved in the cluster's shared checkpoint folder, for a result that is read several times.

    A lost executor then costs no recomputation.  The folder is the one the session names in
    ``spark.checkpoint.dir``; where there is none, the plan is returned as it is.
    """
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
