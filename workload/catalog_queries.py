"""Listings, counts, flags, display columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import display
from foliomill.operators import catalog
from foliomill.operators.biblio import journal_id
from foliomill.session import shared_folder
from workload.base import query

LISTED = "paper_id, original_filename, title, doi, publication_year, status, file_size_bytes, created_at, updated_at"


def listed(t, **options):
    return catalog.page_of_papers(t.papers, **options).select(*LISTED.split(", "))


@query(
    "list_papers_page",
    f"SELECT {LISTED} FROM papers ORDER BY created_at DESC NULLS FIRST, paper_id LIMIT 50",
    ("papers",),
)
def list_papers_page(t):
    return listed(t)


STATUS_ORDER = """list_position(['uploaded', 'parsing', 'parsed', 'extracting', 'extracted', 'review_needed', 'failed'], status)"""


@query(
    "list_by_status_order",
    f"SELECT {LISTED} FROM papers ORDER BY {STATUS_ORDER} DESC NULLS FIRST, paper_id LIMIT 200 OFFSET 20",
    ("papers",),
)
def list_by_status_order(t):
    return listed(t, skip=20, limit=200, sort_by="status", direction="desc")


@query(
    "list_by_title",
    f"SELECT {LISTED} FROM papers ORDER BY title COLLATE \"binary\" ASC NULLS LAST, paper_id LIMIT 100",
    ("papers",),
)
def list_by_title(t):
    return listed(t, limit=100, sort_by="title", direction="asc")


@query(
    "list_by_year",
    f"SELECT {LISTED} FROM papers ORDER BY publication_year ASC NULLS LAST, paper_id LIMIT 100",
    ("papers",),
)
def list_by_year(t):
    return listed(t, limit=100, sort_by="publication_year", direction="asc")


@query(
    "list_by_status",
    f"SELECT {LISTED} FROM papers WHERE status = 'extracted' ORDER BY updated_at ASC NULLS LAST, paper_id LIMIT 50",
    ("papers",),
)
def list_by_status(t):
    return listed(t, status="extracted", sort_by="updated_at", direction="asc")


SEARCH = "WHERE title ILIKE '%src1_/en%' OR doi ILIKE '%src1_/en%' OR original_filename ILIKE '%src1_/en%'"


@query(
    "search_papers",
    f"SELECT {LISTED} FROM papers {SEARCH} ORDER BY created_at DESC NULLS FIRST, paper_id LIMIT 50",
    ("papers",),
)
def search_papers(t):
    return listed(t, search="SRC1_/EN")


@query("list_papers_total", f"SELECT count(*) AS total FROM papers {SEARCH}", ("papers",))
def list_papers_total(t):
    return catalog.count_papers(t.papers, search="SRC1_/EN")


@query("extracted_only", "SELECT paper_id, title FROM papers WHERE status = 'extracted'", ("papers",))
def extracted_only(t):
    return catalog.extracted_only(t.papers).select("paper_id", "title")


PAPER_AUTHORS = """(SELECT l_orderkey AS paper_id, string_agg(s_name, '|' ORDER BY l_linenumber, s_name) AS author_names
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)"""
FLAGS = "(SELECT paper_id, true AS has_extraction, bool_or(status = 'needs_review') AS needs_review FROM event_records GROUP BY paper_id)"


def journals(t):
    names = t.papers.select(F.col("journal_name").alias("name")).where("name IS NOT NULL").distinct()
    return names.select(journal_id(F.col("name")).alias("journal_id"), "name")


@query(
    "list_papers_relations",
    f"""SELECT paper_id, title, journal_name, coalesce(author_names, '') AS author_names, coalesce(has_extraction, false) AS has_extraction,
 coalesce(needs_review, false) AS needs_review FROM (SELECT * FROM papers ORDER BY created_at DESC, paper_id LIMIT 200 OFFSET 100) p
 LEFT JOIN {PAPER_AUTHORS} USING (paper_id) LEFT JOIN {FLAGS} USING (paper_id)""",
    ("papers", "event_records"),
)
def list_papers_relations(t):
    papers = t.papers.withColumn("journal_id", journal_id(F.col("journal_name")))
    page, _ = catalog.list_papers(papers, journals(t), t.links, t.authors, t.event_records, skip=100, limit=200)
    names = F.array_join("author_names", "|").alias("author_names")
    return page.select("paper_id", "title", "journal_name", names, "has_extraction", "needs_review")


@query("author_names", f"SELECT paper_id, author_names FROM {PAPER_AUTHORS}")
def author_names(t):
    names = catalog.author_names(t.links, t.authors)
    named = F.exists("author_names", lambda n: n.isNotNull())
    return names.select("paper_id", F.when(named, F.array_join("author_names", "|")).alias("author_names"))


@query("extraction_flags", f"SELECT * FROM {FLAGS}", ("event_records",))
def extraction_flags(t):
    return catalog.extraction_flags(t.event_records)


@query(
    "paper_detail",
    f"""SELECT paper_id, title, journal_name, coalesce(author_names, '') AS authors, status = 'extracted' AS summary_available, status = 'extracted' AS extraction_available
FROM papers LEFT JOIN {PAPER_AUTHORS} USING (paper_id)""",
    ("papers",),
)
def paper_detail(t):
    path = F.when(F.col("status") == "extracted", F.concat(F.lit("out/"), F.col("paper_id").cast("string")))
    papers = t.papers.withColumns(
        {"journal_id": journal_id(F.col("journal_name")), "summary_path": path, "extraction_json_path": path}
    )
    detail = catalog.paper_lists(papers, journals(t), t.links, t.authors)
    return detail.select(
        "paper_id",
        "title",
        F.col("journal.name").alias("journal_name"),
        F.array_join(F.col("authors.name"), "|").alias("authors"),
        "summary_available",
        "extraction_available",
    )


@query(
    "extraction_states",
    f"""SELECT paper_id, CASE WHEN NOT coalesce(has_extraction, false) THEN 'none' WHEN needs_review THEN 'Review' ELSE 'Done' END AS state
FROM papers LEFT JOIN {FLAGS} USING (paper_id)""",
    ("papers", "event_records"),
)
def extraction_states(t):
    joined = t.papers.select("paper_id").join(catalog.extraction_flags(t.event_records), "paper_id", "left")
    return joined.select(
        "paper_id", display.extraction_state(F.col("has_extraction"), F.col("needs_review")).alias("state")
    )


@query(
    "status_counts",
    """SELECT s.status, count(p.paper_id) AS n FROM (VALUES ('uploaded'), ('parsing'), ('parsed'), ('extracting'), ('extracted'), ('review_needed'), ('failed')) s(status)
LEFT JOIN papers p USING (status) GROUP BY s.status""",
    ("papers",),
)
def status_counts(t):
    return catalog.status_counts(t.papers)


@query(
    "sort_rows",
    "SELECT paper_id, file_size_bytes, row_number() OVER (ORDER BY file_size_bytes DESC NULLS LAST, paper_id) AS place FROM papers",
    ("papers",),
)
def sort_rows(t):
    rows = t.papers.select("paper_id", "file_size_bytes")
    return catalog.placed_rows(rows, "file_size_bytes", shared_folder(t.spark, "sorted"), descending=True)


@query(
    "list_papers_deep",
    f"""SELECT {LISTED}, place FROM (SELECT *, row_number() OVER (ORDER BY title DESC NULLS FIRST, paper_id) AS place FROM papers)
WHERE place BETWEEN (SELECT count(*) * 3 // 4 + 1 FROM papers) AND (SELECT count(*) * 3 // 4 + 200 FROM papers)""",
    ("papers",),
)
def list_papers_deep(t):
    """The page at three quarters of the listing."""
    listing = catalog.store_listing(t.papers, shared_folder(t.spark, "listing"), sort_by="title")
    return listing.page(listing.total() * 3 // 4, 200)


@query(
    "job_list_deep",
    """SELECT job_id, paper_id, created_at, status, place FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, job_id) AS place FROM job_events)
WHERE place BETWEEN (SELECT count(*) // 2 + 1 FROM job_events) AND (SELECT count(*) // 2 + 100 FROM job_events)""",
    ("job_events",),
)
def job_list_deep(t):
    jobs = catalog.store_jobs(t.job_events, shared_folder(t.spark, "jobs"))
    return jobs.page(jobs.total() // 2, 100)


@query("in_progress", "SELECT paper_id, status FROM papers WHERE status IN ('parsing', 'extracting')", ("papers",))
def in_progress(t):
    return catalog.in_progress(t.papers).select("paper_id", "status")


@query("recent", "SELECT paper_id, created_at FROM papers ORDER BY created_at DESC, paper_id LIMIT 8", ("papers",))
def recent(t):
    return catalog.recent(t.papers).select("paper_id", "created_at")


@query(
    "job_list",
    "SELECT job_id, paper_id, created_at, status FROM job_events ORDER BY created_at DESC, job_id LIMIT 100 OFFSET 10",
    ("job_events",),
)
def job_list(t):
    return catalog.list_jobs(t.job_events, skip=10, limit=100)


@query(
    "jobs_of_paper",
    "SELECT job_id, paper_id, created_at, status FROM job_events WHERE paper_id = 3 ORDER BY created_at DESC, job_id LIMIT 50",
    ("job_events",),
)
def jobs_of_paper(t):
    return catalog.list_jobs(t.job_events, paper_id=3)


@query(
    "confidence_bands",
    """SELECT record_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band,
 concat(coalesce(CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%', '–'), CASE WHEN is_inferred THEN ' (inferred)' ELSE '' END) AS label,
 coalesce(CAST(value_numeric AS VARCHAR), value_text) AS shown FROM conditions""",
    ("conditions",),
)
def confidence_bands(t):
    confidence = F.col("confidence")
    return t.conditions.select(
        "record_id",
        "ordinal.*",
        display.confidence_band(confidence).alias("band"),
        display.confidence_label(confidence, F.col("is_inferred")).alias("label"),
        display.display_value(F.col("value_numeric"), F.col("value_text")).alias("shown"),
    )


@query(
    "display_helpers",
    """SELECT paper_id, CASE WHEN coalesce(file_size_bytes, 0) = 0 THEN '–' WHEN file_size_bytes < 1024 THEN file_size_bytes || ' B'
  WHEN file_size_bytes < 1048576 THEN printf('%.1f KB', floor(file_size_bytes / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(file_size_bytes / 1048576 * 10 + 0.5) / 10) END AS size,
 CASE WHEN coalesce(title, '') = '' THEN '–' WHEN length(title) <= 40 THEN title ELSE substr(title, 1, 40) || '…' END AS short_title,
 strftime(created_at, '%b %-d, %Y') AS day,
 CASE status WHEN 'uploaded' THEN 'Uploaded' WHEN 'parsing' THEN 'Parsing…' WHEN 'parsed' THEN 'Parsed' WHEN 'extracting' THEN 'Extracting…' WHEN 'extracted' THEN 'Extracted'
  WHEN 'review_needed' THEN 'Review Needed' ELSE 'Failed' END AS label,
 coalesce(nullif(title, ''), original_filename) AS shown_title FROM papers""",
    ("papers",),
)
def display_helpers(t):
    return t.papers.select(
        "paper_id",
        display.fmt_bytes(F.col("file_size_bytes")).alias("size"),
        display.truncate(F.col("title"), 40).alias("short_title"),
        display.fmt_date(F.col("created_at")).alias("day"),
        display.status_label(F.col("status")).alias("label"),
        display.display_title(F.col("title"), F.col("original_filename")).alias("shown_title"),
    )
