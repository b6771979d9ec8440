"""Duplicate files: inside a scan, against the registry, and the account of a scan.

Hashes are reduced to one row each before any join, so a hash shared by very many files never
meets itself in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.session import durable


def path_order(path: Column) -> Column:
    """Order in which a scan visits paths: folder by folder."""
    return F.split(path, "/")


def first_paths(files: DataFrame, key: str = "file_hash", path: str = "path", order: Column | None = None) -> DataFrame:
    """Per hash the path that a scan meets first; partial minima are taken before the shuffle."""
    order = path_order(F.col(path)) if order is None else order
    return files.groupBy(key).agg(F.min_by(path, order).alias(path))


def dedup_batch(files: DataFrame, key: str = "file_hash", path: str = "path", order: Column | None = None) -> DataFrame:
    """One file per hash: the first in scan order, with all its columns.  Files without a hash all stay."""
    order = path_order(F.col(path)) if order is None else order
    rest = [c for c in files.columns if c != key]
    # A file without a hash is a group of its own.
    alone = F.when(F.col(key).isNull(), F.col(path)).alias("_alone")
    chosen = files.groupBy(key, alone).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return chosen.select(key, "_first.*").select(*files.columns)


def drop_known(files: DataFrame, registry: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files whose hash is not registered."""
    return files.join(registry.select(key), key, "left_anti")


def duplicates_of(files: DataFrame, registry: DataFrame, key: str = "file_hash") -> DataFrame:
    """Each known file with the registered paper it equals and that paper's status."""
    known = registry.groupBy(key).agg(
        F.min_by(F.struct(F.col("paper_id").alias("existing_id"), "status"), "paper_id").alias("_paper")
    )
    # Written first, so that both sides come to the join as they are and adaptive execution can split a hot hash.
    return files.join(durable(known), key).select(*files.columns, "_paper.*")


def scan_outcomes(files: DataFrame, registry: DataFrame, key: str = "file_hash", order: Column | None = None) -> DataFrame:
    """``outcome`` of every scanned file: ``failed`` (it has an error), ``ingested`` (new, and first with
    its content) or ``skipped``."""
    firsts = first_paths(files.where(F.col("error").isNull()), key, order=order)
    new_firsts = firsts.join(registry.select(key).distinct(), key, "left_anti")
    marked = files.join(new_firsts.select("path", F.lit(True).alias("_new")), "path", "left")
    outcome = (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.col("_new"), F.lit("ingested"))
        .otherwise(F.lit("skipped"))
    )
    return marked.withColumn("outcome", outcome).drop("_new")


def scan_counts(outcomes: DataFrame) -> DataFrame:
    """One row of counters."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_duplicates"),
        F.count_if(F.col("outcome") == "ingested").alias("ingested"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )


def scan_details(outcomes: DataFrame, paper_id: Column) -> DataFrame:
    """The error texts and the new ids of a scan, one row each; they stay distributed."""
    errors = outcomes.where(F.col("outcome") == "failed").select(F.lit("error").alias("kind"), F.col("error").alias("detail"))
    ids = outcomes.where(F.col("outcome") == "ingested").select(F.lit("paper_id").alias("kind"), paper_id.alias("detail"))
    return errors.unionByName(ids)
