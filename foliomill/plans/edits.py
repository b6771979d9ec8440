"""Changes by hand to stored tables: patches, deletions, reprocessing, and the compaction that makes them physical.

Stored rows are never updated.  Patches and tombstones are logs that every reader merges in (merge on read); a tombstone
counts for the rows that were there when it was written, so a file that comes in again makes a paper again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators import biblio, corrections
from foliomill.sources import registry as reg
from foliomill.sources.tables import AUTHOR, GENERATION, JOURNAL, LINK, MERGED, PAPER_PATCH, PARSED, PROMPT, RAW, TOMBSTONE, Lake

RECORD_PATCH = (
    "record_id string, patch_id string, patched_at timestamp, summary_text string, main_findings string, claimed_mechanism string, "
    "limitations string, notable_novelty string, relevant_for_optimization boolean, review_notes string, reviewed_by string, "
    "input_variables string, output_variables string, contextual_notes string"
)
# Child tables of the records, which live and go with them.
CHILDREN = ["materials", "conditions", "methods", "results", "evidence"]


def fitted(rows: DataFrame, layout: str) -> DataFrame:
    """``rows`` in a table's layout: columns it does not give are null."""
    empty = rows.sparkSession.createDataFrame([], layout)
    given = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in empty.schema}
    return rows.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in empty.schema])


def patch_papers(lake: Lake, patches: DataFrame, run: str) -> DataFrame:
    """Logs paper patches (``paper_id``, ``patch_id`` and any of the patchable fields); bad ones are refused as a whole."""
    stamped = patches if "patched_at" in patches.columns else patches.withColumn("patched_at", F.current_timestamp())
    return lake.append("paper_patches", corrections.acceptable_patches(fitted(stamped, PAPER_PATCH)), run)


def patch_records(lake: Lake, patches: DataFrame, run: str) -> DataFrame:
    """Logs edits of records (``record_id``, ``patch_id`` and any of the editable fields)."""
    stamped = patches if "patched_at" in patches.columns else patches.withColumn("patched_at", F.current_timestamp())
    return lake.append("record_patches", fitted(stamped, RECORD_PATCH), run)


def delete_papers(lake: Lake, ids: DataFrame, run: str) -> DataFrame:
    """Logs the deletion of papers with all that belongs to them."""
    stamped = ids.select("paper_id").distinct().withColumn("deleted_at", F.current_timestamp())
    return lake.append("tombstones", stamped, run)


def alive(lake: Lake, rows: DataFrame, at: str) -> DataFrame:
    """Rows of papers (``paper_id``) that are not deleted, or were written at ``at`` after the deletion."""
    gone = lake.read("tombstones", TOMBSTONE).groupBy(F.col("paper_id").alias("_gone")).agg(F.max("deleted_at").alias("_gone_at"))
    return rows.join(gone, (rows["paper_id"] == F.col("_gone")) & (rows[at] <= F.col("_gone_at")), "left_anti")


def patched_papers(lake: Lake, papers: DataFrame) -> DataFrame:
    patches = alive(lake, lake.read("paper_patches", PAPER_PATCH), "patched_at")
    return corrections.apply_patches(papers, patches)


def current_generation(lake: Lake, papers: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """``papers`` with their newest ``generation``; 0 for one never sent again."""
    log = lake.read("generations", GENERATION) if log is None else log
    newest = log.groupBy("paper_id").agg(F.max("generation").alias("generation"))
    return papers.join(newest, "paper_id", "left").withColumn("generation", F.coalesce("generation", F.lit(0)))


def request_again(lake: Lake, run: str, stage: str, ids: DataFrame | None = None) -> DataFrame:
    """Opens the next generation of papers (all that can be, or ``ids``), to be run again from ``stage``.

    What the former generations gave stays: the prompts, the answers and the records.  A repeated ``run`` asks for the same.
    """
    papers = alive(lake, lake.read("registry", reg.REGISTERED), "registered_at").select("paper_id").distinct()
    text = alive(lake, lake.read("parsed", PARSED), "parsed_at").where("status = 'parsed'")
    texts = text.groupBy("paper_id").agg(F.max_by("raw_text", "parsed_at").alias("raw_text"))
    papers = papers.join(texts, "paper_id", "left") if stage == "extract" else papers.withColumn("raw_text", F.lit(None).cast("string"))
    chosen = corrections.select_for_reprocess(papers, stage, ids).select("paper_id")
    before = lake.read("generations", f"{GENERATION}, run string").where(F.col("run") != run)
    asked = current_generation(lake, chosen, before).select(
        "paper_id", (F.col("generation") + 1).alias("generation"), F.lit(stage).alias("stage"), F.current_timestamp().alias("requested_at")
    )
    return lake.append("generations", asked, run)


def compact(lake: Lake, into: str) -> None:
    """Rewrites the tables without deleted rows, as the one run ``into``, and folds the logs.

    No other job should read or write meanwhile.  One that failed is to be run again under the same name: what it had set
    aside is complete, and is taken as it is.
    """
    layouts = {
        "parsed": (PARSED, "parsed_at"),
        "merged": (_ddl(MERGED), "extracted_at"),
        "raw_responses": (RAW, "called_at"),
        "generations": (GENERATION, "requested_at"),
    }
    registered = alive(lake, lake.read("registry", reg.SEGMENTED), "registered_at")
    kept_papers = lake.append("compacting", registered.select("paper_id").distinct(), into)
    for table, (layout, at) in layouts.items():
        _rewrite(lake, table, layout, alive(lake, lake.read(table, layout), at), into)
    # Prompts bear no time: those of papers that are gone go.
    _rewrite(lake, "prompts", PROMPT, lake.read("prompts", PROMPT).join(kept_papers, "paper_id", "left_semi"), into)
    for table in ("records", *CHILDREN):
        stored = _stored(lake, table)
        if stored is not None:
            live = alive(lake, stored, "created_at") if table == "records" else stored.join(
                _stored(lake, "records").select("record_id"), "record_id", "left_semi"
            )
            _rewrite(lake, table, stored.schema, live, into)
    folded = alive(lake, lake.read("paper_patches", PAPER_PATCH), "patched_at")
    order = F.struct("patched_at", "patch_id")
    newest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in corrections.PAPER_FIELDS]
    folded = folded.groupBy("paper_id").agg(F.max_by("patch_id", order).alias("patch_id"), F.max("patched_at").alias("patched_at"), *newest)
    _rewrite(lake, "paper_patches", PAPER_PATCH, fitted(folded, PAPER_PATCH), into)
    links = lake.read("paper_authors", f"{LINK}, bucket int")
    lake.replace_keyed("paper_authors", links.join(kept_papers, "paper_id", "left_semi"))
    runs = _runs(lake, "registry")
    reg.compact_registry(lake, runs, into, _aside(lake, "registry", registered.drop("run", "bucket"), into))
    lake.clear("registry-next", [into], reg.REGISTERED)
    # Last: without tombstones the rows above must be gone.
    lake.clear("tombstones", _runs(lake, "tombstones"), TOMBSTONE)


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def _stored(lake: Lake, table: str) -> DataFrame | None:
    found = lake.stored(table)
    return None if found is None else found.drop("run")


def _runs(lake: Lake, table: str) -> list[str]:
    """The runs that wrote to a table, one row each."""
    return [r["run"] for r in lake.read(table, "run string").distinct().collect()]


def _aside(lake: Lake, table: str, rows: DataFrame, into: str) -> DataFrame:
    """``rows`` of a table, written beside it; those of a compaction that broke off stand there already."""
    found = lake.stored(f"{table}-next")
    if found is not None and (mine := found.where(F.col("run") == into).drop("run")).take(1):
        return mine.select(*rows.columns)
    return lake.append(f"{table}-next", rows, into)


def _rewrite(lake: Lake, table: str, layout, rows: DataFrame, into: str) -> None:
    """Makes ``rows``, taken from the table itself, all that it holds."""
    runs = _runs(lake, table)
    if not runs:
        return
    lake.append(table, _aside(lake, table, rows, into), into)
    lake.clear(table, [r for r in runs if r != into], layout)
    lake.clear(f"{table}-next", [into], layout)


def current_links(lake: Lake) -> DataFrame:
    return lake.read_keyed("paper_authors", LINK)


def attach_authors(lake: Lake, named: DataFrame) -> None:
    """Puts the authors of papers (``paper_id, authors``) into the author table, and replaces the papers' links.

    ``named`` should come from a written table; papers without an author keep their links.
    """
    given = named.where(F.size("authors") > 0)
    links = biblio.author_links(given)
    people = biblio.upsert_authors(lake.spark.createDataFrame([], AUTHOR), links)
    lake.upsert("authors", people, "author_id", AUTHOR, keep_old=True)
    lake.upsert("paper_authors", links.select("paper_id", "author_id", "position"), "paper_id", LINK)


def attach_journals(lake: Lake, names: DataFrame) -> None:
    """Puts journal names (column ``name``) into the journal table; known ones stay as they are."""
    empty = lake.spark.createDataFrame([], JOURNAL)
    lake.upsert("journals", biblio.upsert_journals(empty, names), "journal_id", JOURNAL, keep_old=True)
