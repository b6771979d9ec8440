"""Pages to documents: page text choice, assembly, metadata, parse outcome."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions import text as tx
from foliomill.functions.plan import pinned
from foliomill.sources.opener import Opener, open_file

NATIVE, OCR, HYBRID = "native", "ocr", "hybrid"
PAGE_SEPARATOR = "\n\n"
# What a page reader's job returns: one row per file, so pages never leave the task that read them.
FILE_ROWS = (
    "paper_id string, meta map<string,string>, "
    "pages array<struct<page_number int, native_text string, ocr_text string>>, error string"
)

# A page reader gets a file's bytes and yields dicts with "page_number", "native_text", optionally
# "ocr_text" (a text, or a function called only for pages with little text) and "meta" (of the file).
PageReader = Callable[[bytes], Iterator[dict]]


def _page(page: dict, threshold: int) -> dict:
    native, ocr = page.get("native_text") or "", page.get("ocr_text")
    if callable(ocr):
        ocr = ocr() if len(native.strip()) < threshold else None
    return {"page_number": page["page_number"], "native_text": native, "ocr_text": ocr}


def read_pages(
    files: DataFrame, page_reader: PageReader, threshold: int = config.OCR_MIN_CHARS, opener: Opener = open_file
) -> DataFrame:
    """Runs the reader on each file (``paper_id, path``); a bad file gives a row with its error.

    Each task opens its own files, so their bytes are neither shuffled nor kept.
    """

    def read(paper_id: str, path: str) -> dict:
        row: dict = {"paper_id": paper_id, "meta": None, "pages": [], "error": None}
        try:
            with opener(path) as stream:
                content = stream.read()
            for page in page_reader(content):
                row["meta"] = row["meta"] or page.get("meta")
                row["pages"].append(_page(page, threshold))
        except Exception as failure:  # noqa: BLE001 - any failure of a file is that file's outcome
            row["error"] = f"Parse error: {failure}"
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([read(file["paper_id"], file["path"])], schema=ARROW_FILE_ROWS)

    return files.select("paper_id", "path").mapInArrow(run, FILE_ROWS)


ARROW_FILE_ROWS = pa.schema(
    {
        "paper_id": pa.string(),
        "meta": pa.map_(pa.string(), pa.string()),
        "pages": pa.list_(
            pa.struct({"page_number": pa.int32(), "native_text": pa.string(), "ocr_text": pa.string()})
        ),
        "error": pa.string(),
    }
)


def page_method(native: Column, ocr: Column, threshold: int = config.OCR_MIN_CHARS) -> Column:
    """``ocr`` where the page's own text is short and the recognised text is longer, else ``native``."""
    native_len = F.length(tx.strip(F.coalesce(native, F.lit(""))))
    use_ocr = (native_len < threshold) & (F.length(tx.strip(ocr)) > native_len)
    return F.when(F.coalesce(use_ocr, F.lit(False)), F.lit(OCR)).otherwise(F.lit(NATIVE))


def documents_of(files: DataFrame, threshold: int = config.OCR_MIN_CHARS) -> DataFrame:
    """Documents from ``read_pages`` rows without a shuffle: text, page count, method, first page, metadata."""

    def choose(page: Column) -> Column:
        method = page_method(page["native_text"], page["ocr_text"], threshold)
        native = F.coalesce(page["native_text"], F.lit(""))
        return F.struct(
            page["page_number"].alias("page_number"),
            F.when(method == OCR, page["ocr_text"]).otherwise(native).alias("text"),
            method.alias("method"),
        )

    chosen = pinned(files, _pages=F.array_sort(F.transform("pages", choose)))
    methods = F.array_distinct(F.col("_pages.method"))
    return chosen.select(
        "paper_id",
        F.array_join(F.col("_pages.text"), PAGE_SEPARATOR).alias("text"),
        F.size("_pages").cast("bigint").alias("page_count"),
        F.when(F.size(methods) > 1, F.lit(HYBRID)).otherwise(F.coalesce(F.get(methods, F.lit(0)), F.lit(NATIVE))).alias(
            "parse_method"
        ),
        F.coalesce(F.get("_pages.text", F.lit(0)), F.lit("")).alias("first_page"),
        F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"),
        "error",
    )


def choose_page_text(pages: DataFrame, threshold: int = config.OCR_MIN_CHARS) -> DataFrame:
    """Adds ``method``, ``text`` and ``word_count`` to page rows with ``native_text`` and ``ocr_text``."""
    native = F.coalesce("native_text", F.lit(""))
    chosen = pinned(pages, method=page_method(F.col("native_text"), F.col("ocr_text"), threshold))
    return chosen.withColumn("text", F.when(F.col("method") == OCR, F.col("ocr_text")).otherwise(native)).withColumn(
        "word_count", tx.word_count(F.col("text"))
    )


def _rolled_up(lowest: Column, highest: Column) -> Column:
    return F.when(lowest != highest, F.lit(HYBRID)).otherwise(highest)


def assemble_blocks(
    pages: DataFrame, key: str = "paper_id", page: str = "page_number", block_pages: int = config.BLOCK_PAGES
) -> DataFrame:
    """Pages joined into blocks of ``block_pages`` consecutive numbers, with page count and method.

    A document of ordinary length is one block; a very long one is spread over several tasks.
    """
    block = F.floor(F.col(page) / block_pages).cast("bigint")
    gathered = pages.groupBy(key, block.alias("block_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), "text"))).alias("_pages"),
        F.count(F.lit(1)).alias("page_count"),
        F.min("method").alias("_low"),
        F.max("method").alias("_high"),
    )
    return gathered.select(
        key,
        "block_no",
        F.array_join(F.transform("_pages", lambda p: p["text"]), PAGE_SEPARATOR).alias("text"),
        "page_count",
        "_low",
        "_high",
        _rolled_up(F.col("_low"), F.col("_high")).alias("parse_method"),
    )


def assemble_document(pages: DataFrame, key: str = "paper_id", page: str = "page_number") -> DataFrame:
    """One row per document: whole text, page count, and ``hybrid`` where both page methods occur."""
    blocks = assemble_blocks(pages, key, page)
    joined = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("_blocks"),
        F.sum("page_count").alias("page_count"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
    )
    return joined.select(
        key,
        F.array_join(F.transform("_blocks", lambda b: b["text"]), PAGE_SEPARATOR).alias("text"),
        "page_count",
        _rolled_up(F.col("_low"), F.col("_high")).alias("parse_method"),
    )


def mine_metadata(docs: DataFrame) -> DataFrame:
    """Adds title, doi, year, abstract and authors; expects ``text, first_page, meta``."""
    text, meta = F.col("text"), F.col("meta")
    return (
        docs.withColumn("title", tx.mine_title(F.col("first_page"), meta["Title"]))
        .withColumn("doi", tx.mine_doi(text))
        .withColumn("publication_year", tx.mine_year(text, meta["CreationDate"]))
        .withColumn("abstract", tx.mine_abstract(text))
        .withColumn("authors", tx.split_authors(meta["Author"]))
    )


EMPTY_TEXT = "PDF parsing yielded empty text"


def parse_outcome(docs: DataFrame) -> DataFrame:
    """Adds ``parse_error`` and ``status``: a reader's error (column ``error``, if any) or blank text is a failure."""
    reader_error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    blank = F.when(tx.is_blank(F.col("text")), F.lit(EMPTY_TEXT))
    settled = pinned(docs, parse_error=F.coalesce(reader_error, blank))
    return settled.withColumn("status", F.when(F.col("parse_error").isNull(), F.lit("parsed")).otherwise(F.lit("failed")))


def require_text(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with text, and the blank ones with a reason."""
    blank = tx.is_blank(F.col(text))
    return docs.where(~blank), docs.where(blank).withColumn("parse_error", F.lit(EMPTY_TEXT))


def page_stats(pages: DataFrame, key: str = "paper_id") -> DataFrame:
    """Page count, method and text length per document, from its pages alone: no text is moved."""
    summed = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("page_count"),
        _rolled_up(F.min("method"), F.max("method")).alias("parse_method"),
        F.sum(F.length("text")).alias("_chars"),
        F.bool_or(~tx.is_blank(F.col("text"))).alias("_has_text"),
    )
    status = F.when(F.col("_has_text"), F.lit("parsed")).otherwise(F.lit("failed"))
    length = F.col("_chars") + len(PAGE_SEPARATOR) * (F.col("page_count") - 1)
    return summed.select(key, status.alias("status"), "page_count", "parse_method", length.alias("text_length"))


def parse_stats(docs: DataFrame) -> DataFrame:
    """Page count, method and text length per document."""
    return docs.select(
        "paper_id", "status", "page_count", "parse_method", F.length("text").cast("bigint").alias("text_length")
    )
