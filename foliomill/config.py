"""Limits, label lists and other fixed values shared by the operators."""

from __future__ import annotations

# Status labels, in declaration order (listing by status sorts in this order).
PAPER_STATUSES = ["uploaded", "parsing", "parsed", "extracting", "extracted", "review_needed", "failed"]
RECORD_STATUSES = ["pending", "complete", "partial", "failed", "needs_review"]
JOB_STATUSES = ["queued", "running", "success", "failed", "retrying", "cancelled"]
IN_PROGRESS_STATUSES = ["parsing", "extracting"]
VARIABLE_ROLES = ["input", "output", "contextual"]

# What a reader sees for each status.
STATUS_LABELS = {
    "uploaded": "Uploaded",
    "parsing": "Parsing…",
    "parsed": "Parsed",
    "extracting": "Extracting…",
    "extracted": "Extracted",
    "review_needed": "Review Needed",
    "failed": "Failed",
}

# Columns a listing may be sorted by; anything else means created_at.
SORTABLE_COLUMNS = ["created_at", "updated_at", "title", "publication_year", "status"]

# Texts of the repaired records.
INCOMPLETE_SUMMARY = "Extraction incomplete – manual review required."
FAILED_SUMMARY = "Extraction failed – manual review required."
RECOVERY_WARNING = "Validation error (partial extraction): "
MISSING_SUMMARY_WARNING = "summary was missing from LLM output"
REVIEW_WHOLE_RECORD = "full_record"

SCHEMA_VERSION = "1.0.0"

# Thresholds of the text heuristics.
OCR_MIN_CHARS = 200
TITLE_LINES = 10
TITLE_MIN_CHARS, TITLE_MAX_CHARS = 21, 299
DOI_WINDOW = 5000
YEAR_WINDOW = 3000
MINED_YEAR_MIN, MINED_YEAR_MAX = 1990, 2030
ABSTRACT_MIN_CHARS, ABSTRACT_MAX_CHARS = 100, 3000
MAX_CHUNK_CHARS = 60_000
SUMMARIES_KEPT = 3

# Bounds of the row rules.
BIBLIO_YEAR_MIN, BIBLIO_YEAR_MAX = 1900, 2100
CHECKED_YEAR_MIN, CHECKED_YEAR_MAX = 1900, 2030
MAX_DOI_CHARS = 256
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
MAX_PAGE_SIZE = 200

# Retry policy of a model call (tries, then waits in seconds).
MODEL_TRIES = 3
MODEL_WAIT_FACTOR, MODEL_WAIT_MIN, MODEL_WAIT_MAX = 2, 4, 60

# Pages joined into one text block before blocks are joined into a document.
BLOCK_PAGES = 1_000
# So many variables get columns of their own where none are named; the others are kept in a map.
MAX_PIVOT_NAMES = 5_000
