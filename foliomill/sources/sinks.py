"""Writers: wide CSV, nested JSON lines with a header, text files per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(wide: DataFrame, path: str) -> None:
    """CSV parts with a header line; null is an empty field."""
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in wide.dtypes]
    wide.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_export_json(nested: DataFrame, header: DataFrame, path: str, exported_at: Column | None = None) -> None:
    """``path/papers`` as JSON lines and ``path/header`` as one line with time, version and counts."""
    stamp = F.current_timestamp() if exported_at is None else exported_at
    stamped = header.withColumn("exported_at", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    nested.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/papers")
    stamped.write.mode("overwrite").json(f"{path}/header")


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """One row per paper, kept as parquet by id: a file per paper would be millions of small files."""
    texts.select("paper_id", F.col(column).alias("text")).write.mode("overwrite").parquet(path)


def write_text_files(texts: DataFrame, column: str, path: str) -> None:
    """A folder per paper with its text, for a selection small enough to be browsed."""
    texts.select("paper_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("paper_id").text(path)
