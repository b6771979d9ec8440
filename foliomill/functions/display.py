"""Columns shown to readers: bands, percentages, sizes, dates, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.text import missing, present, value_text

DASH = "–"
ELLIPSIS = "…"


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), F.lit("unknown"))
        .when(confidence >= 0.9, F.lit("high"))
        .when(confidence >= 0.7, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def confidence_label(confidence: Column, is_inferred: Column) -> Column:
    percent = F.floor(confidence * 100 + 0.5).cast("bigint").cast("string")
    shown = F.coalesce(F.concat(percent, F.lit("%")), F.lit(DASH))
    note = F.when(F.coalesce(is_inferred, F.lit(False)), F.lit(" (inferred)")).otherwise(F.lit(""))
    return F.concat(shown, note)


def fmt_bytes(size: Column) -> Column:
    def scaled(divisor: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", size / F.lit(float(divisor)))

    return (
        F.when(size.isNull() | (size == 0), F.lit(DASH))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, scaled(1024, "KB"))
        .otherwise(scaled(1024 * 1024, "MB"))
    )


def truncate(text: Column, max_chars: int) -> Column:
    return (
        F.when(missing(text), F.lit(DASH))
        .when(F.length(text) <= max_chars, text)
        .otherwise(F.concat(F.substring(text, 1, max_chars), F.lit(ELLIPSIS)))
    )


def fmt_date(moment: Column) -> Column:
    return F.date_format(moment, "MMM d, yyyy")


def status_label(status: Column) -> Column:
    """The reader's name of a status; an unknown status is shown as it is."""
    label = F.lit(None).cast("string")
    for value, text in config.STATUS_LABELS.items():
        label = F.when(status == value, F.lit(text)).otherwise(label)
    return F.coalesce(label, status)


def display_title(title: Column, filename: Column) -> Column:
    return F.coalesce(present(title), filename)


def display_value(numeric: Column, text: Column) -> Column:
    return value_text(numeric, text)


def extraction_state(has_extraction: Column, needs_review: Column) -> Column:
    return (
        F.when(~F.coalesce(has_extraction, F.lit(False)), F.lit("none"))
        .when(F.coalesce(needs_review, F.lit(False)), F.lit("Review"))
        .otherwise(F.lit("Done"))
    )
