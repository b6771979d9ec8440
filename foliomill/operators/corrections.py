"""Changes after the fact: patches, failures, deletions, reprocessing.

All are logs or anti-joins; no table is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.text import missing

PAPER_FIELDS = ["title", "doi", "abstract", "publication_year", "keywords", "volume", "issue", "pages"]
RECORD_FIELDS = [
    "summary_text",
    "main_findings",
    "claimed_mechanism",
    "limitations",
    "notable_novelty",
    "relevant_for_optimization",
    "review_notes",
    "reviewed_by",
    "input_variables",
    "output_variables",
    "contextual_notes",
]


def acceptable_patches(patches: DataFrame) -> DataFrame:
    """Paper patches within the allowed bounds; one bad field refuses the whole patch."""
    ok = F.lit(True)
    if "publication_year" in patches.columns:
        year = F.col("publication_year")
        ok = ok & (year.isNull() | year.between(config.BIBLIO_YEAR_MIN, config.BIBLIO_YEAR_MAX))
    if "doi" in patches.columns:
        ok = ok & (F.col("doi").isNull() | (F.length("doi") <= config.MAX_DOI_CHARS))
    return patches.where(ok)


def _latest(patches: DataFrame, key: str, fields: list[str], order: Column) -> DataFrame:
    """Per key and field the latest supplied value; partial maxima are taken before the shuffle."""
    return patches.groupBy(key).agg(
        F.lit(True).alias("_patched"),
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f"_new_{f}") for f in fields],
    )


def apply_patches(
    papers: DataFrame, patches: DataFrame, key: str = "paper_id", order: tuple[str, ...] = ("patched_at", "patch_id")
) -> DataFrame:
    """Papers with the log of patches replayed: only supplied, non-null fields change."""
    fields = [f for f in PAPER_FIELDS if f in patches.columns and f in papers.columns]
    latest = _latest(acceptable_patches(patches), key, fields, F.struct(*order))
    joined = papers.join(latest, key, "left")
    return joined.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).select(*papers.columns)


def apply_record_patches(
    records: DataFrame, patches: DataFrame, key: str = "record_id", order: tuple[str, ...] = ("patched_at", "patch_id")
) -> DataFrame:
    """Records with the log of edits replayed; an edited record is marked, and complete unless under review."""
    fields = [f for f in RECORD_FIELDS if f in patches.columns and f in records.columns]
    joined = records.join(_latest(patches, key, fields, F.struct(*order)), key, "left")
    edited = F.col("_patched")
    settled = {f: F.coalesce(f"_new_{f}", f) for f in fields}
    settled["human_edited"] = F.when(edited, F.lit(True)).otherwise(F.col("human_edited"))
    settled["status"] = F.when(edited & (F.col("status") != "needs_review"), F.lit("complete")).otherwise(F.col("status"))
    return joined.withColumns(settled).select(*records.columns)


def apply_failures(papers: DataFrame, errors: DataFrame) -> DataFrame:
    """Papers with the latest failure of each stage written back.

    ``errors`` holds ``paper_id, stage ('parse' or 'extract'), error, failed_at``.
    """
    at = F.struct("failed_at", "error")

    def latest(stage: str) -> Column:
        return F.max_by("error", F.when(F.col("stage") == stage, at))

    failed = errors.groupBy("paper_id").agg(latest("parse").alias("_parse"), latest("extract").alias("_extract"))
    joined = papers.join(failed.withColumn("_failed", F.lit(True)), "paper_id", "left")
    return joined.withColumns(
        {
            "parse_error": F.coalesce("_parse", "parse_error"),
            "extraction_error": F.coalesce("_extract", "extraction_error"),
            "status": F.when(F.col("_failed"), F.lit("failed")).otherwise(F.col("status")),
        }
    ).select(*papers.columns)


def delete_papers(tables: dict[str, DataFrame], ids: DataFrame, key: str = "paper_id") -> dict[str, DataFrame]:
    """Every table without the rows of the given papers; the tables carry ``key``."""
    return {name: rows.join(ids.select(key), key, "left_anti") for name, rows in tables.items()}


def select_for_reprocess(papers: DataFrame, stage: str, ids: DataFrame | None = None) -> DataFrame:
    """Papers to run again from ``stage``: full, parse or extract (which needs stored text)."""
    if stage not in ("full", "parse", "extract"):
        raise ValueError(f"unknown stage {stage!r}")
    chosen = papers if ids is None else papers.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")
    return chosen.where(~missing(F.col("raw_text"))) if stage == "extract" else chosen
