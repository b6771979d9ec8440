"""The whole way from a folder of files to tables, as jobs that each write what they produced.

Every job reads tables, appends its own run and can be repeated: a run replaces only its own part,
and work that is already in a table is not done again.  Expensive results (texts, answers, chunk
records) are written before anything else is derived from them, so a lost executor costs its own
tasks and nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.operators import biblio, chunking, corrections, dedup, inference, merging, parsing, repair, reports
from foliomill.operators import records as rec
from foliomill.plans import edits
from foliomill.plans.edits import fitted
from foliomill.sources import files as fs
from foliomill.sources.answers import keep_rows
from foliomill.sources.opener import Opener, open_file
from foliomill.sources.registry import REGISTERED, append_registry, known_papers, register_papers
from foliomill.sources.tables import MERGED, OUTPUT, PARSED, PROMPT, RAW, Lake


def ingest(lake: Lake, folder: str, run: str, opener: Opener = open_file) -> DataFrame:
    """Scans the folder, registers new papers, and returns the counters of the scan.

    Of the registry only the segments are read that may hold one of the hashes found.
    """
    prints = lake.append("fingerprints", fs.with_fingerprint(fs.scan_files(lake.spark, folder), opener), run)
    known = lake.append("known_papers", edits.alive(lake, known_papers(lake, prints, run), "registered_at"), run)
    outcomes = lake.append("scan_outcomes", dedup.scan_outcomes(prints, known), run)
    new = register_papers(outcomes.where(F.col("outcome") == "ingested"), known)
    append_registry(lake, new.drop("status", "is_new"), run)
    return lake.append("scan_counts", dedup.scan_counts(outcomes), run)


def others(lake: Lake, table: str, layout: str, run: str) -> DataFrame:
    """A table without the part this run writes, so that a repeated run sees what its first try saw."""
    return lake.read(table, f"{layout}, run string").where(F.col("run") != run).drop("run")


def registered(lake: Lake) -> DataFrame:
    return edits.alive(lake, lake.read("registry", REGISTERED), "registered_at")


def parse(
    lake: Lake, run: str, page_reader: parsing.PageReader, papers: DataFrame | None = None, opener: Opener = open_file
) -> DataFrame:
    """Reads, assembles and mines papers without a parse result (or the given ones)."""
    registry = registered(lake)
    if papers is None:
        done = edits.alive(lake, others(lake, "parsed", PARSED, run), "parsed_at")
        todo = registry.join(done.select("paper_id").distinct(), "paper_id", "left_anti")
    else:
        todo = registry.join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    files = todo.select("paper_id", F.col("file_path").alias("path"))
    docs = parsing.parse_outcome(parsing.documents_of(parsing.read_pages(files, page_reader, opener=opener)))
    mined = parsing.mine_metadata(docs).withColumns({"raw_text": F.col("text"), "parsed_at": F.current_timestamp()})
    parsed = lake.append("parsed", mined.select(*[name for name, _ in _columns(lake, PARSED)]), run)
    edits.attach_authors(lake, parsed.where(F.col("status") == "parsed").select("paper_id", "authors"))
    return parsed


def _columns(lake: Lake, layout: str) -> list[tuple[str, str]]:
    return lake.spark.createDataFrame([], layout).dtypes


def latest(df: DataFrame, *by: str) -> DataFrame:
    """Newest row per paper of an append-only table."""
    return rec.canonical(df, newest=list(by))


def prepare(
    lake: Lake, run: str, max_chars: int = config.MAX_CHUNK_CHARS, papers: DataFrame | None = None
) -> DataFrame:
    """Chunks and prompt hashes of parsed papers that have none yet in their generation (or of the given papers)."""
    key = ["paper_id", inference.GENERATION]
    done = others(lake, "prompts", PROMPT, run).select(*key).distinct()
    parsed = edits.alive(lake, lake.read("parsed", PARSED), "parsed_at").where(F.col("status") == "parsed")
    # The papers are chosen before any text moves.
    todo = edits.current_generation(lake, parsed.select("paper_id").distinct())
    todo = todo.join(done, key, "left_anti") if papers is None else todo.join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    texts = latest(parsed.join(todo, "paper_id"), "parsed_at")
    texts = corrections.select_for_reprocess(texts, "extract") if papers is not None else texts
    chunks = chunking.chunk_text(texts.select(*key, "raw_text"), "raw_text", max_chars)
    prompts = inference.build_prompt(chunks).select(*key, "chunk_no", "prompt_hash", "chunk")
    return lake.append("prompts", prompts.select(*[name for name, _ in _columns(lake, PROMPT)]), run)


def current_prompts(lake: Lake, run: str | None = None) -> DataFrame:
    """The prompts of each paper's newest generation that has no merged record yet (but for one that ``run`` made)."""
    key = ["paper_id", inference.GENERATION]
    prompts = lake.read("prompts", PROMPT)
    papers = prompts.select("paper_id").distinct().join(registered(lake).select("paper_id"), "paper_id", "left_semi")
    merged = lake.read("merged", MERGED) if run is None else others(lake, "merged", _ddl(lake), run)
    done = edits.alive(lake, merged, "extracted_at").select(*key).distinct()
    open_ = edits.current_generation(lake, papers).join(done, key, "left_anti")
    return prompts.join(open_, key, "left_semi")


def call_model(lake: Lake, run: str, model_fn: inference.ModelFn, max_in_flight: int, waves: int = 1, **options) -> None:
    """Calls the model for every prompt without a settled answer.

    Answers are kept as they come: those of a job that failed are there for the next one, which asks for the rest only.
    ``waves`` cuts the work into jobs that run one after the other.
    """
    for wave in range(waves):
        prompts = current_prompts(lake)
        key = inference.key_of(prompts)
        raw = edits.alive(lake, lake.read("raw_responses", RAW), "called_at")
        # Only names of prompts move until it is known which are to be asked.
        todo = inference.pending(prompts.select(*key).distinct(), raw)
        todo = todo.where(F.pmod(F.xxhash64(*key), F.lit(waves)) == wave)
        mine = prompts.join(todo, key, "left_semi").dropDuplicates(key)
        called = inference.infer(inference.build_prompt(mine), model_fn, max_in_flight, **options)
        keep_rows(fitted(called, RAW), f"{lake.path('raw_responses')}/run={run}")


def settle(lake: Lake, run: str, model: str) -> DataFrame:
    """Repairs and merges the answers of papers that have all of them, and writes the records.

    A paper with an answer still to come is left for the next run.  Each generation of a paper makes a record of its own;
    the newest one is canonical.
    """
    open_ = current_prompts(lake, run)
    key = inference.key_of(open_)
    prompts = open_.select(*key).distinct()
    raw = edits.alive(lake, lake.read("raw_responses", RAW), "called_at")
    mine = raw.join(prompts, key, "left_semi")
    ready = prompts.join(inference.incomplete_papers(prompts, mine), "paper_id", "left_anti")
    answers = inference.latest_responses(mine.join(ready, key, "left_semi"))
    repaired = repair.repair_responses(answers, "response")
    kept = repaired.select("paper_id", inference.GENERATION, "chunk_no", "outcome", "reject_reason", "record", "error")
    chunk_records = lake.append("chunk_records", kept, run)
    generation = chunk_records.select("paper_id", inference.GENERATION).distinct()
    merged = merging.merge_chunks(chunk_records.drop(inference.GENERATION)).join(generation, "paper_id")
    merged = merged.withColumn("extracted_at", F.current_timestamp())
    merged = lake.append("merged", merged.select(*MERGED.names), run)
    built = lake.append("records", rec.build_records(merged, model, F.col("extracted_at")), run)
    write_children(lake, built, run)
    edits.attach_journals(lake, built.select(F.col("bibliographic_info.journal").alias("name")))
    edits.attach_authors(lake, built.select("paper_id", F.col("bibliographic_info.authors").alias("authors")))
    return built


def _ddl(lake: Lake) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MERGED)


def write_children(lake: Lake, built: DataFrame, run: str) -> None:
    """The relational tables of the records: one pass over them per table, no shuffle."""
    children = {
        "materials": rec.explode_materials(built),
        "conditions": rec.explode_conditions(built),
        "methods": rec.explode_methods(built),
        "results": rec.explode_results(built),
    }
    for name, rows in children.items():
        lake.append(name, rows.drop("evidence"), run)
    lake.append("evidence", rec.record_evidence(built), run)


def current_papers(lake: Lake) -> DataFrame:
    """The state of every paper, replayed from the tables."""
    text, none = "string", F.lit(None)
    papers = registered(lake).drop("registered_at").withColumns(
        {
            "status": F.lit("uploaded"),
            **{name: none.cast(text) for name in ("title", "doi", "abstract", "raw_text", "parse_method")},
            **{name: none.cast(text) for name in ("volume", "issue", "pages", "journal_id", "schema_version")},
            **{name: none.cast(text) for name in ("parse_error", "extraction_error")},
            **{name: none.cast(text) for name in ("summary_path", "extraction_json_path")},
            "publication_year": none.cast("int"),
            "page_count": none.cast("bigint"),
            "keywords": none.cast("array<string>"),
        }
    )
    parsed = latest(edits.alive(lake, lake.read("parsed", PARSED), "parsed_at"), "parsed_at")
    papers = biblio.merge_parse(papers, parsed.where(F.col("status") == "parsed").drop("status"))
    merged = latest(edits.alive(lake, lake.read("merged", MERGED), "extracted_at"), inference.GENERATION, "extracted_at")
    info = merged.where(F.col("record").isNotNull()).select(
        "paper_id", F.col("record.schema_version").alias("schema_version"), "record.bibliographic_info.*"
    )
    papers = biblio.finalize_papers(biblio.merge_biblio(papers, info), info, lake.read_keyed("outputs", OUTPUT))
    papers = corrections.apply_failures(papers, failures(parsed, merged))
    return edits.patched_papers(lake, papers)


def current_records(lake: Lake) -> DataFrame:
    """All versions of all records with the edits merged in; ``is_canonical`` marks each paper's newest."""
    stored = lake.stored("records")
    if stored is None:
        raise ValueError(f"no records in {lake.root}")
    rows = edits.alive(lake, stored.drop("run"), "created_at").withColumns(
        {f: F.lit(None).cast("string") for f in ("review_notes", "reviewed_by")}
    )
    rows = corrections.apply_record_patches(rows, lake.read("record_patches", edits.RECORD_PATCH))
    newest = rec.canonical(rows.select("paper_id", "record_id", "created_at")).select("record_id", F.lit(True).alias("_newest"))
    return rows.join(newest, "record_id", "left").withColumn("is_canonical", F.col("_newest").isNotNull()).drop("_newest")


def reprocess(
    lake: Lake,
    run: str,
    stage: str,
    page_reader: parsing.PageReader,
    model_fn: Callable,
    model: str,
    papers: DataFrame | None = None,
    max_in_flight: int = 8,
    max_chars: int = config.MAX_CHUNK_CHARS,
    opener: Opener = open_file,
    **options,
) -> DataFrame:
    """Runs papers (all, or the given ones) again from ``stage``: full, parse or extract.

    Opens their next generation, so every prompt is asked anew and a new record follows; the former ones stay as versions.
    """
    asked = edits.request_again(lake, run, stage, papers)
    if stage != "extract":
        parse(lake, run, page_reader, asked, opener)
    prepare(lake, run, max_chars)
    call_model(lake, run, model_fn, max_in_flight, **options)
    built = settle(lake, run, model)
    write_reports(lake, built, run)
    return built


def failures(parsed: DataFrame, merged: DataFrame) -> DataFrame:
    """The failed stage of each paper that failed."""

    def failed(df: DataFrame, stage: str, error: str, at: str) -> DataFrame:
        rows = df.where(F.col(error).isNotNull())
        return rows.select("paper_id", F.lit(stage).alias("stage"), F.col(error).alias("error"), F.col(at).alias("failed_at"))

    return failed(parsed, "parse", "parse_error", "parsed_at").unionByName(
        failed(merged, "extract", "error", "extracted_at")
    )


def write_reports(lake: Lake, built: DataFrame, run: str, at: Column | None = None) -> None:
    """Markdown reports and machine-readable records of the given record rows, by paper, and where they stand."""
    registry = registered(lake).select("paper_id", "original_filename", "file_hash")
    named = built.select("paper_id", "record").join(registry, "paper_id")
    lake.append("reports", reports.summary_markdown(named, at), run)
    done = lake.append("record_json", reports.extraction_json(named, at), run)
    folder = lambda table: F.lit(f"{lake.path(table)}/run={run}")
    paths = done.select("paper_id", folder("reports").alias("summary_path"), folder("record_json").alias("extraction_json_path"))
    lake.upsert("outputs", paths, "paper_id", OUTPUT)


def run_all(
    lake: Lake,
    folder: str,
    run: str,
    page_reader: parsing.PageReader,
    model_fn: Callable,
    model: str,
    max_in_flight: int = 8,
    waves: int = 1,
    max_chars: int = config.MAX_CHUNK_CHARS,
) -> DataFrame:
    """All stages in a row; returns the state of the papers."""
    ingest(lake, folder, run)
    parse(lake, run, page_reader)
    prepare(lake, run, max_chars)
    call_model(lake, run, model_fn, max_in_flight, waves)
    built = settle(lake, run, model)
    write_reports(lake, built, run)
    return current_papers(lake)
