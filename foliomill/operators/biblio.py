"""Papers, journals and authors: merging new values into what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions import text as tx

FILLED_AFTER_PARSE = ["title", "doi", "abstract", "publication_year"]
SET_AFTER_PARSE = ["page_count", "raw_text", "parse_method"]
FILLED_AFTER_EXTRACTION = ["title", "doi", "abstract", "publication_year"]
REPLACED_AFTER_EXTRACTION = ["volume", "issue", "pages", "keywords"]


def empty(df: DataFrame, name: str) -> Column:
    """True where a column counts as not supplied: null, empty text, zero or an empty list."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        return tx.missing(col)
    if isinstance(kind, T.ArrayType):
        return col.isNull() | (F.size(col) == 0)
    if isinstance(kind, T.NumericType):
        return col.isNull() | (col == 0)
    return col.isNull()


def _update(base: DataFrame, new: DataFrame, key: str, names: list[str], rule) -> DataFrame:
    """Left join of ``base`` with ``new`` (both unique by ``key``), each named column settled by ``rule``."""
    offered = new.select(
        key,
        F.lit(True).alias("_offered"),
        *[F.col(name).alias(f"_new_{name}") for name in names],
        *[(~empty(new, name)).alias(f"_has_{name}") for name in names],
    )
    joined = base.join(offered, key, "left")
    changes = {name: rule(name) for name in names}
    return joined.withColumns(changes).select(*base.columns)


def fill_missing(base: DataFrame, new: DataFrame, names: list[str], key: str = "paper_id") -> DataFrame:
    """A supplied new value is taken where the base has none."""
    return _update(
        base,
        new,
        key,
        names,
        lambda n: F.when(empty(base, n) & F.col(f"_has_{n}"), F.col(f"_new_{n}")).otherwise(F.col(n)),
    )


def overwrite(base: DataFrame, new: DataFrame, names: list[str], key: str = "paper_id") -> DataFrame:
    """Every row with an update takes the new values, whatever they are."""
    return _update(
        base, new, key, names, lambda n: F.when(F.col("_offered"), F.col(f"_new_{n}")).otherwise(F.col(n))
    )


def overwrite_present(base: DataFrame, new: DataFrame, names: list[str], key: str = "paper_id") -> DataFrame:
    """A supplied new value replaces the base value."""
    return _update(
        base, new, key, names, lambda n: F.when(F.col(f"_has_{n}"), F.col(f"_new_{n}")).otherwise(F.col(n))
    )


def _update_each(base: DataFrame, new: DataFrame, fill: list[str], replace: list[str], always: list[str]) -> DataFrame:
    def rule(name: str) -> Column:
        if name in fill:
            take = empty(base, name) & F.col(f"_has_{name}")
        elif name in replace:
            take = F.col(f"_has_{name}")
        else:
            take = F.col("_offered")
        return F.when(take, F.col(f"_new_{name}")).otherwise(F.col(name))

    return _update(base, new, "paper_id", [*fill, *replace, *always], rule)


def merge_parse(papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """Papers after parsing: bibliographic gaps filled, parse results and the status set."""
    update = parsed.withColumn("status", F.lit("parsed"))
    return _update_each(papers, update, FILLED_AFTER_PARSE, [], [*SET_AFTER_PARSE, "status"])


def merge_biblio(papers: DataFrame, biblio: DataFrame) -> DataFrame:
    """Papers after extraction: gaps filled, volume, issue, pages, keywords and journal replaced if given.

    ``biblio`` holds ``paper_id`` and the fields of the record's bibliographic part.
    """
    update = biblio.withColumn("publication_year", F.col("year"))
    replaced = list(REPLACED_AFTER_EXTRACTION)
    if "journal_id" in papers.columns:
        named = ~tx.missing(F.col("journal"))
        update = update.withColumn("journal_id", F.when(named, journal_id(F.col("journal"))))
        replaced.append("journal_id")
    return _update_each(papers, update, FILLED_AFTER_EXTRACTION, replaced, [])


def finalize_papers(papers: DataFrame, records: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Papers with a saved record: schema version, status ``extracted`` and output paths if given.

    ``records`` holds one row per paper with ``schema_version``; ``paths`` may add ``summary_path`` and
    ``extraction_json_path``.
    """
    done = records.select("paper_id", "schema_version", F.lit("extracted").alias("status"))
    papers = _update_each(papers, done, [], [], ["schema_version", "status"])
    if paths is None:
        return papers
    return overwrite_present(papers, paths, ["summary_path", "extraction_json_path"])


def journal_id(name: Column) -> Column:
    return F.sha2(F.concat(F.lit("journal~"), name), 256)


def author_id(full_name: Column) -> Column:
    return F.sha2(F.concat(F.lit("author~"), full_name), 256)


def upsert_journals(existing: DataFrame, names: DataFrame) -> DataFrame:
    """The journal dimension with a row for each new exact name (column ``name``)."""
    new = names.select("name").where(~tx.missing(F.col("name"))).distinct()
    added = new.join(existing.select("name"), "name", "left_anti").select(
        journal_id(F.col("name")).alias("journal_id"), "name"
    )
    return existing.unionByName(added, allowMissingColumns=True)


def upsert_authors(existing: DataFrame, names: DataFrame) -> DataFrame:
    """The author dimension with a row for each new exact full name, split into first and last name."""
    full_name = F.col("full_name")
    new = names.select("full_name").where(full_name.isNotNull()).distinct()
    added = new.join(existing.select("full_name"), "full_name", "left_anti").select(
        author_id(full_name).alias("author_id"),
        "full_name",
        tx.first_name(full_name).alias("first_name"),
        tx.last_name(full_name).alias("last_name"),
    )
    return existing.unionByName(added, allowMissingColumns=True)


def author_links(papers: DataFrame, authors: str = "authors") -> DataFrame:
    """``paper_id, author_id, full_name, position`` from each paper's author list.

    Positions count from 0; an author named twice keeps the first position.
    """
    names = F.col(authors)
    listed = F.filter(
        F.transform(names, lambda name, i: F.struct(i.alias("position"), name.alias("full_name"))),
        lambda x: F.array_position(names, x["full_name"]) == x["position"] + 1,
    )
    return papers.select("paper_id", F.inline(listed)).select(
        "paper_id", author_id(F.col("full_name")).alias("author_id"), "full_name", "position"
    )


def replace_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links of the papers that occur in ``new`` are replaced; others stay."""
    kept = links.join(new.select("paper_id"), "paper_id", "left_anti").select(*links.columns)
    return kept.unionByName(new.select(*links.columns))
