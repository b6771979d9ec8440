"""Listing, searching and counting papers, records, evidence and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.text import missing
from foliomill.operators.ranks import Ranked, write_ranked

LISTED = [
    "paper_id",
    "original_filename",
    "title",
    "doi",
    "publication_year",
    "status",
    "page_count",
    "file_size_bytes",
    "created_at",
    "updated_at",
    "journal_id",
]


def filter_papers(papers: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """By exact status, and by a case-insensitive pattern within title, DOI or file name.

    ``%`` and ``_`` in the search act as wildcards.
    """
    if status:
        papers = papers.where(F.col("status") == status)
    if search:
        pattern = f"%{search}%"
        papers = papers.where(
            F.col("title").ilike(pattern) | F.col("doi").ilike(pattern) | F.col("original_filename").ilike(pattern)
        )
    return papers


def sort_order(sort_by: str, direction: str, tie: str = "paper_id") -> list[Column]:
    """Order of a listing: nulls last ascending and first descending, statuses as declared, ties by id."""
    name = sort_by if sort_by in config.SORTABLE_COLUMNS else "created_at"
    labels = F.array(*[F.lit(label) for label in config.PAPER_STATUSES])
    key = F.array_position(labels, F.col("status")) if name == "status" else F.col(name)
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_first()
    return [first, F.col(tie).asc()]


def _checked_page(skip: int, limit: int) -> None:
    if skip < 0 or not 1 <= limit <= config.MAX_PAGE_SIZE:
        raise ValueError(f"skip must be at least 0 and limit between 1 and {config.MAX_PAGE_SIZE}")


def count_papers(papers: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """One row: number of papers a listing with these filters has, before paging."""
    return filter_papers(papers, status, search).agg(F.count(F.lit(1)).alias("total"))


def page_of_papers(
    papers: DataFrame,
    skip: int = 0,
    limit: int = 50,
    status: str | None = None,
    search: str | None = None,
    sort_by: str = "created_at",
    direction: str = "desc",
) -> DataFrame:
    """One page of the listing's own columns; planned as a top-k without a full sort."""
    _checked_page(skip, limit)
    columns = [c for c in LISTED if c in papers.columns]
    found = filter_papers(papers, status, search).select(*columns)
    return found.orderBy(*sort_order(sort_by, direction)).offset(skip).limit(limit)


def store_listing(
    papers: DataFrame, path: str, status: str | None = None, search: str | None = None, sort_by: str = "created_at", direction: str = "desc"
) -> Ranked:
    """A listing stored in its order, for pages far down: ``page(skip, limit)`` opens the ranges it lies in and no others."""
    columns = [c for c in LISTED if c in papers.columns]
    return write_ranked(filter_papers(papers, status, search).select(*columns), sort_order(sort_by, direction), path)


def store_jobs(jobs: DataFrame, path: str, tie: str = "job_id") -> Ranked:
    """The jobs stored newest first, likewise."""
    return write_ranked(jobs, [F.col("created_at").desc_nulls_first(), F.col(tie).asc()], path)


def with_relations(
    page: DataFrame,
    journals: DataFrame,
    links: DataFrame,
    authors: DataFrame,
    records: DataFrame,
    sort_by: str = "created_at",
    direction: str = "desc",
) -> DataFrame:
    """A page with journal name, ordered author names and the extraction flags.

    The page has at most ``MAX_PAGE_SIZE`` rows: it is fetched once, so that the papers are scanned
    once, and its ids are broadcast to filter the large tables before anything is grouped.
    """
    rows = page.take(config.MAX_PAGE_SIZE + 1)
    if len(rows) > config.MAX_PAGE_SIZE:
        raise ValueError(f"a page has at most {config.MAX_PAGE_SIZE} rows")
    page = page.sparkSession.createDataFrame(rows, page.schema).coalesce(1)
    ids = F.broadcast(page.select("paper_id"))
    journal_ids = F.broadcast(page.select("journal_id").where(F.col("journal_id").isNotNull()).distinct())
    journal_names = journals.join(journal_ids, "journal_id", "left_semi").select(
        "journal_id", F.col("name").alias("journal_name")
    )
    names = author_names(links.join(ids, "paper_id", "left_semi"), authors)
    flags = extraction_flags(records.join(ids, "paper_id", "left_semi"))
    joined = page.join(journal_names, "journal_id", "left").join(names, "paper_id", "left").join(flags, "paper_id", "left")
    return joined.withColumns(
        {
            "author_names": F.coalesce("author_names", F.array().cast("array<string>")),
            "has_extraction": F.coalesce("has_extraction", F.lit(False)),
            "needs_review": F.coalesce("needs_review", F.lit(False)),
        }
    ).orderBy(*sort_order(sort_by, direction))


def list_papers(
    papers: DataFrame,
    journals: DataFrame,
    links: DataFrame,
    authors: DataFrame,
    records: DataFrame,
    skip: int = 0,
    limit: int = 50,
    status: str | None = None,
    search: str | None = None,
    sort_by: str = "created_at",
    direction: str = "desc",
) -> tuple[DataFrame, DataFrame]:
    """The page with its relations, and the total."""
    page = page_of_papers(papers, skip, limit, status, search, sort_by, direction)
    total = count_papers(papers, status, search)
    return with_relations(page, journals, links, authors, records, sort_by, direction), total


def author_rows(links: DataFrame, authors: DataFrame) -> DataFrame:
    """``paper_id, position, author_id, author_name``: a row per author of a paper, however many it has."""
    names = authors.select("author_id", F.col("full_name").alias("author_name"))
    return links.select("paper_id", "author_id", "position").join(names, "author_id").select("paper_id", "position", "author_id", "author_name")


def _unplaced() -> Column:
    """Sorts authors without a position behind the others."""
    return F.col("position").isNull().alias("_unplaced")


def author_names(links: DataFrame, authors: DataFrame) -> DataFrame:
    """``paper_id, author_names``: one list per paper, by position; ``author_rows`` has the same as rows."""
    people = F.array_sort(F.collect_list(F.struct(_unplaced(), "position", "author_name")))
    return author_rows(links, authors).groupBy("paper_id").agg(F.transform(people, lambda p: p["author_name"]).alias("author_names"))


def extraction_flags(records: DataFrame) -> DataFrame:
    """Per paper with records: ``has_extraction``, and ``needs_review`` if any version needs it."""
    return records.groupBy("paper_id").agg(
        F.lit(True).alias("has_extraction"), F.bool_or(F.col("status") == "needs_review").alias("needs_review")
    )


def paper_detail(papers: DataFrame, journals: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """Everything about papers, a row per author (one with nulls for a paper without): the paper's columns, its ``journal``,
    what output is available, ``position``, ``author_id`` and ``author_name``."""
    return _heads(papers, journals).join(author_rows(links, authors), "paper_id", "left")


def _heads(papers: DataFrame, journals: DataFrame) -> DataFrame:
    journal = journals.select("journal_id", F.struct("journal_id", "name").alias("journal"))
    available = {
        "summary_available": ~missing(F.col("summary_path")),
        "extraction_available": ~missing(F.col("extraction_json_path")),
    }
    return papers.drop("raw_text").join(journal, "journal_id", "left").withColumns(available)


def paper_lists(papers: DataFrame, journals: DataFrame, links: DataFrame, authors: DataFrame) -> DataFrame:
    """The same with a row per paper and its whole list ``authors`` by position, empty for a paper without.

    Lists are gathered from the links before anything else of the papers is joined to them.
    """
    person = F.struct(_unplaced(), "position", F.col("author_name").alias("name"), "author_id")
    people = author_rows(links, authors).groupBy("paper_id").agg(F.array_sort(F.collect_list(person)).alias("authors"))
    people = people.withColumn("authors", F.transform("authors", lambda p: p.dropFields("_unplaced")))
    joined = _heads(papers, journals).join(people, "paper_id", "left")
    return joined.withColumn("authors", F.coalesce("authors", F.array().cast(people.schema["authors"].dataType)))


def paper_page(papers: DataFrame, journals: DataFrame, links: DataFrame, authors: DataFrame, ids: list) -> DataFrame:
    """The same for a page of ids, one row per paper, with its whole list ``authors``."""
    if len(ids) > config.MAX_PAGE_SIZE:
        raise ValueError(f"a page has at most {config.MAX_PAGE_SIZE} papers")
    mine = paper_detail(papers.where(F.col("paper_id").isin(ids)), journals, links.where(F.col("paper_id").isin(ids)), authors)
    person = F.struct("position", F.col("author_name").alias("name"), "author_id")
    heads = [c for c in mine.columns if c not in ("paper_id", "position", "author_id", "author_name")]
    people = F.array_sort(F.collect_list(F.when(F.col("author_id").isNotNull(), person)))
    firsts = [F.first(c).alias(c) for c in heads]
    return mine.groupBy("paper_id").agg(*firsts, people.alias("authors"))


def evidence_for(evidence: DataFrame, records: DataFrame | None = None, field: str | None = None) -> DataFrame:
    """Evidence of canonical records, optionally of fields whose name contains ``field`` in any case.

    ``records`` are the canonical records to restrict to; the text is matched literally.
    """
    if field:
        evidence = evidence.where(F.contains(F.lower("field_name"), F.lower(F.lit(field))))
    if records is not None:
        evidence = evidence.join(records.select("record_id"), "record_id", "left_semi")
    return evidence


def list_jobs(jobs: DataFrame, skip: int = 0, limit: int = 50, paper_id: object = None, tie: str = "job_id") -> DataFrame:
    """Jobs, newest first, optionally of one paper."""
    _checked_page(skip, limit)
    if paper_id is not None:
        jobs = jobs.where(F.col("paper_id") == F.lit(paper_id))
    return jobs.orderBy(F.col("created_at").desc_nulls_first(), F.col(tie).asc()).offset(skip).limit(limit)


def status_counts(papers: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Papers per status over the whole table; every known label has a row, also with none."""
    labels = config.PAPER_STATUSES if labels is None else labels
    zeros = papers.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(label) for label in labels])).alias("status"), F.lit(0).cast("bigint").alias("n")
    )
    counted = papers.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(zeros).groupBy("status").agg(F.sum("n").alias("n"))


def in_progress(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("status").isin(config.IN_PROGRESS_STATUSES))


def recent(papers: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` newest papers."""
    return papers.orderBy(F.col("created_at").desc_nulls_first(), F.col("paper_id").asc()).limit(n)


def row_order(column: str, descending: bool = False) -> list[Column]:
    """The order of a listing by any of its columns: nulls last, ties by id."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return [key, F.col("paper_id").asc()]


def sort_rows(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return rows.orderBy(*row_order(column, descending))


def placed_rows(rows: DataFrame, column: str, path: str, descending: bool = False) -> DataFrame:
    """All rows with their ``place`` in that order, from 1; ``path`` keeps the order."""
    return write_ranked(rows, row_order(column, descending), path).rows()


def extracted_only(papers: DataFrame) -> DataFrame:
    return filter_papers(papers, status="extracted")
