"""Stored records as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.schemas import RECORD_TYPE


def records_from_raw(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds the typed ``record`` read back from stored record JSON, so nothing has to be inferred again."""
    return df.withColumn("record", F.from_json(F.col(raw), RECORD_TYPE))
