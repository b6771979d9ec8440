"""From child rows to variables: long form, wide form, maps, matrices, coverage, nested export.

The long form has one row per (paper, variable) after the last value has won.  It has no limit on
the number of variables; the wide forms are projections of it, and the sparse matrix holds all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.text import value_text
from foliomill.operators.filters import likely
from foliomill.operators.ranks import write_ranked

INPUT_PREFIX, OUTPUT_PREFIX = "input_", "output_"
CELL = ["value", "unit", "confidence", "needs_review"]
# Rows of a block of the sparse matrix.
BLOCK_ROWS = 1 << 16
# Suffixes of the columns beside each variable.
INPUT_EXTRAS = ["unit", "confidence"]
OUTPUT_EXTRAS = ["unit", "needs_review", "confidence"]
# Columns of the first material.
PRIMARY_MATERIAL = {
    "material_name": "name",
    "material_composition": "composition",
    "material_substrate": "substrate",
    "crystal_structure": "crystal_structure",
}


def norm_name(name: Column, prefix: str) -> Column:
    """Column name of a variable: prefix, lower case, underscores for blanks."""
    return F.concat(F.lit(prefix), F.replace(F.lower(name), F.lit(" "), F.lit("_")))


def only_papers(papers: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Papers restricted to ``ids``; none means all."""
    return papers if ids is None else papers.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")


def of_records(children: DataFrame, records: DataFrame) -> DataFrame:
    """Child rows of the given (canonical) records."""
    return likely(children, records, "record_id").join(records.select("record_id"), "record_id", "left_semi")


def long_inputs(conditions: DataFrame, key: str = "paper_id") -> DataFrame:
    """``key, name, value, value_numeric, unit, confidence, needs_review, ordinal`` of inputs and context."""
    return conditions.where(F.col("variable_role").isin("input", "contextual")).select(
        key,
        norm_name(F.col("parameter_name"), INPUT_PREFIX).alias("name"),
        value_text(F.col("value_numeric"), F.col("value_text")).alias("value"),
        "value_numeric",
        "unit",
        "confidence",
        F.lit(None).cast("boolean").alias("needs_review"),
        "ordinal",
    )


def long_outputs(results: DataFrame, key: str = "paper_id") -> DataFrame:
    """The same of all results, whatever their role."""
    return results.select(
        key,
        norm_name(F.col("property_name"), OUTPUT_PREFIX).alias("name"),
        value_text(F.col("value_numeric"), F.col("value_text")).alias("value"),
        "value_numeric",
        "unit",
        "confidence",
        "needs_review",
        "ordinal",
    )


def dataset_long(children: DataFrame, role: str) -> DataFrame:
    """Child rows with the given role."""
    return children.where(F.col("variable_role") == role)


def last_values(long: DataFrame, fields: list[str], order: str | Column = "ordinal", key: str = "paper_id") -> DataFrame:
    """One row per (paper, name): the last by ``order``.  Partial maxima are taken before the shuffle."""
    last = F.max_by(F.struct(*fields), order)
    return long.groupBy(key, "name").agg(last.alias("_last")).select(key, "name", "_last.*")


def variable_names(long: DataFrame, most: int = config.MAX_PIVOT_NAMES) -> list[str]:
    """Sorted distinct names; of more than ``most`` those that most papers have.

    The rest is never lost: a pivot without explicit names keeps it in a map.
    """
    counted = long.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most)
    return sorted(row.name for row in counted.collect())


def column_names(names: list[str], extras: list[str], taken: list[str] | tuple = ("paper_id",)) -> dict[tuple[str, str], str]:
    """A column for each variable (field "value") and each of its ``extras``, all different in any case.

    A variable's column is its name and an extra's is ``<name>_<extra>``.  Where that is taken already, as by a name that
    differs in case only or by a variable that is called like another's unit, a number is put behind it.  Variables choose
    before extras, in sorted order, so the same names always get the same columns.
    """
    used = {t.lower() for t in taken}
    columns: dict[tuple[str, str], str] = {}

    def choose(name: str, field: str, wished: str) -> None:
        column, n = wished, 1
        while column.lower() in used:
            n += 1
            column = f"{wished}__{n}"
        used.add(column.lower())
        columns[name, field] = column

    for name in sorted(set(names)):
        choose(name, "value", name)
    for name in sorted(set(names)):
        for extra in extras:
            choose(name, extra, f"{name}_{extra}")
    return columns


def column_dictionary(spark: SparkSession, columns: dict[tuple[str, str], str]) -> DataFrame:
    """``column, name, field``: what each column of a pivot holds."""
    rows = [(column, name, field) for (name, field), column in columns.items()]
    return spark.createDataFrame(rows, "column string, name string, field string")


def cells(long: DataFrame, order: str | Column = "ordinal", fields: list[str] | None = None, key: str = "paper_id") -> DataFrame:
    """One row per paper with a map from variable name to its last cell."""
    fields = fields or CELL
    last = last_values(long, fields, order, key)
    return last.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct(*fields).alias("cell")))).alias("cells")
    )


def _spread(names: list[str], extras: list[str], taken: list[str] | tuple = ("paper_id",)) -> list[Column]:
    chosen = column_names(names, extras, taken)
    fields = [(name, field) for name in names for field in ("value", *extras)]
    return [F.col("cells")[name][field].alias(chosen[name, field]) for name, field in fields]


def _others(names: list[str]) -> Column:
    """The variables that have no column, as a map."""
    named = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.map_filter("cells", lambda name, _: ~F.array_contains(named, name)).alias("other_variables")


def _pivot(long: DataFrame, names: list[str] | None, order: str | Column, extras: list[str], rest: bool | None) -> DataFrame:
    rest = names is None if rest is None else rest
    names = variable_names(long) if names is None else names
    columns = _spread(names, extras, ("paper_id", *(["other_variables"] if rest else [])))
    return cells(long, order).select("paper_id", *columns, *([_others(names)] if rest else []))


def pivot_inputs(long: DataFrame, names: list[str] | None = None, order: str | Column = "ordinal", rest: bool | None = None) -> DataFrame:
    """One row per paper; per input its value, unit and confidence (see ``column_names``).

    ``rest`` adds the map ``other_variables`` with all that have no column; without explicit names it is always there.
    """
    return _pivot(long, names, order, INPUT_EXTRAS, rest)


def pivot_outputs(long: DataFrame, names: list[str] | None = None, order: str | Column = "ordinal", rest: bool | None = None) -> DataFrame:
    """One row per paper; per output its value, unit, review flag and confidence; ``rest`` as in ``pivot_inputs``."""
    return _pivot(long, names, order, OUTPUT_EXTRAS, rest)


def primary_material(materials: DataFrame, order: str | Column = "ordinal", key: str = "paper_id") -> DataFrame:
    """Per paper the first material's descriptive columns."""
    fields = [F.col(source).alias(name) for name, source in PRIMARY_MATERIAL.items()]
    first = materials.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_first"))
    return first.select(key, "_first.*")


def export_wide(
    papers: DataFrame,
    journals: DataFrame,
    records: DataFrame,
    inputs: DataFrame,
    outputs: DataFrame,
    materials: DataFrame,
    input_names: list[str] | None = None,
    output_names: list[str] | None = None,
    rest: bool | None = None,
    order: str | Column = "ordinal",
    key: str = "paper_id",
) -> DataFrame:
    """One row per paper that has a canonical record: base columns, inputs, outputs, primary material.

    ``inputs`` and ``outputs`` are long forms of the canonical records.  With explicit names no pass over
    the data is needed to find them.  ``rest`` adds a map with the variables that have no column; where names are not
    given, it is always there.  With ``record_id`` as ``key`` child rows are gathered by their record and need no paper, so they
    are moved only to be grouped; rows of other records among them are left out when the papers take what is theirs.
    """
    rest = input_names is None or output_names is None if rest is None else rest
    exact = (lambda rows: rows) if key == "paper_id" else (lambda rows: of_records(rows, records))
    input_names = variable_names(exact(inputs)) if input_names is None else input_names
    output_names = variable_names(exact(outputs)) if output_names is None else output_names
    named_journals = journals.select("journal_id", F.col("name").alias("journal"))
    base = papers.select("paper_id", "title", "doi", F.col("publication_year").alias("year"), "journal_id")
    statuses = records.select(*dict.fromkeys(["paper_id", key]), F.col("status").alias("extraction_status"))
    base = base.join(statuses, "paper_id").join(named_journals, "journal_id", "left")
    gathered = cells(inputs.unionByName(outputs), order, key=key)
    joined = base.join(gathered, key, "left").join(primary_material(materials, order, key), key, "left")
    # Names of inputs and outputs differ by their prefix, so their columns cannot meet.
    fixed = ["paper_id", "title", "doi", "year", "journal", "extraction_status"]
    taken = [*fixed, *PRIMARY_MATERIAL, "other_variables"]
    columns = [*_spread(input_names, INPUT_EXTRAS, taken), *_spread(output_names, OUTPUT_EXTRAS, taken)]
    if rest:
        columns.append(_others([*input_names, *output_names]))
    return joined.select(*fixed, *columns, *PRIMARY_MATERIAL)


# --- X and y ---------------------------------------------------------------------------------

# What is kept of an input and of an output.
X_FIELDS = ["value", "unit", "confidence"]
Y_FIELDS = ["value", "value_min", "value_max", "unit", "conditions", "confidence"]


def x_long(conditions: DataFrame, order: str | Column = "ordinal", key: str = "paper_id") -> DataFrame:
    """Inputs by their raw names, the last of a name winning; ``value`` is the number."""
    rows = dataset_long(conditions, "input").withColumns(
        {"name": F.col("parameter_name"), "value": F.col("value_numeric")}
    )
    return last_values(rows, X_FIELDS, order, key)


def y_long(results: DataFrame, order: str | Column = "ordinal", key: str = "paper_id") -> DataFrame:
    """Outputs by their raw names, the last of a name winning."""
    rows = dataset_long(results, "output").withColumns({"name": F.col("property_name"), "value": F.col("value_numeric")})
    return last_values(rows, Y_FIELDS, order, key)


def variable_map(long: DataFrame, alias: str, key: str = "paper_id") -> DataFrame:
    """Per paper a map from name to the struct of the other columns; ``long`` is unique by (paper, name)."""
    fields = [c for c in long.columns if c not in (key, "name")]
    entries = F.collect_list(F.struct("name", F.struct(*fields).alias("cell")))
    return long.groupBy(key).agg(F.map_from_entries(entries).alias(alias))


def xy_maps(conditions: DataFrame, results: DataFrame, order: str | Column = "ordinal") -> DataFrame:
    """Per paper the maps ``X`` and ``y``."""
    x, y = variable_map(x_long(conditions, order), "X"), variable_map(y_long(results, order), "y")
    return x.join(y, "paper_id", "full")


def feature_matrix(papers: DataFrame, long: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per paper, one numeric column per variable, null where it was not observed.

    ``long`` is ``x_long`` or ``y_long``.  Papers without any variable keep their row.
    """
    names = variable_names(long) if names is None else names
    chosen = column_names(names, [])
    values = variable_map(long.select("paper_id", "name", "value"), "cells")
    ids = papers.select("paper_id").distinct()
    return ids.join(values, "paper_id", "left").select(
        "paper_id", *[F.col("cells")[name]["value"].alias(chosen[name, "value"]) for name in names]
    )


def sparse_matrix(papers: DataFrame, long: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix of any number of variables as its cells: ``block, row, column, value``; with the papers of the rows
    (``paper_id, row``) and the names of the columns (``name, column``), both numbered from 0 in sorted order.

    ``long`` is ``x_long`` or ``y_long``.  Cells that were not observed are left out; papers and names keep their numbers.  A
    block is ``block_rows`` rows, small enough to be one array.  The numberings are stored below ``path``.
    """
    def numbered(ids: DataFrame, key: str, number: str) -> DataFrame:
        stored = write_ranked(ids.select(key).distinct(), [F.col(key).asc()], f"{path}/{number}s")
        return stored.rows().select(key, (F.col("place") - 1).alias(number))

    rows, columns = numbered(papers, "paper_id", "row"), numbered(long, "name", "column")
    cells_ = long.where(F.col("value").isNotNull()).select("paper_id", "name", "value").join(rows, "paper_id").join(columns, "name")
    block = F.floor(F.col("row") / block_rows).cast("bigint").alias("block")
    return cells_.select(block, "row", "column", "value"), rows, columns


def coverage(long: DataFrame, papers: DataFrame) -> DataFrame:
    """Per variable: papers that observed it, their share in percent, and the range.

    ``long`` is unique by (paper, name); ``papers`` are all papers of the matrix, one row each.
    """
    n_papers = papers.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = long.groupBy("name").agg(
        F.count("value").alias("n_observed"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )
    return counted.select(
        "name",
        n_papers.cast("bigint").alias("n_papers"),
        "n_observed",
        F.round(F.lit(100.0) * F.col("n_observed") / n_papers, 1).alias("coverage_pct"),
        "min_value",
        "max_value",
    )


# --- nested export ---------------------------------------------------------------------------


def export_nested(
    papers: DataFrame,
    journals: DataFrame,
    records: DataFrame,
    conditions: DataFrame,
    results: DataFrame,
    raw: bool = False,
    evidence: DataFrame | None = None,
    order: str | Column = "ordinal",
) -> DataFrame:
    """One row per paper (all papers, with or without a record) with a struct ``extraction``.

    ``records`` are canonical; ``raw`` adds the stored answer.  ``evidence`` (rows with
    ``record_id, ordinal, kind`` and the evidence columns) adds the evidence list.  Child rows are gathered by their record, so
    they are moved only to be grouped; those of other records that the filter lets pass are left out when a paper takes its own.
    """
    named_journals = journals.select("journal_id", F.col("name").alias("journal"))
    base = papers.select("paper_id", "title", "doi", F.col("publication_year").alias("year"), "journal_id")
    x = variable_map(x_long(likely(conditions, records, "record_id"), order, "record_id"), "X", "record_id")
    y = variable_map(y_long(likely(results, records, "record_id"), order, "record_id"), "y", "record_id")
    head = records.select(
        "paper_id",
        "record_id",
        F.lit(True).alias("_has"),
        "status",
        F.col("summary_text").alias("summary"),
        *[F.coalesce(F.col(m), F.lit("{}")).alias(m) for m in ("input_variables", "output_variables", "contextual_notes")],
        *(["raw_response"] if raw else []),
    )
    joined = base.join(named_journals, "journal_id", "left").join(head, "paper_id", "left")
    joined = joined.join(x, "record_id", "left").join(y, "record_id", "left")
    no_x, no_y = (F.create_map().cast(maps.schema[m].dataType) for maps, m in ((x, "X"), (y, "y")))
    split = F.struct(F.coalesce("X", no_x).alias("X"), F.coalesce("y", no_y).alias("y")).alias("bo_ready")
    parts = ["status", "summary", "input_variables", "output_variables", "contextual_notes", split]
    if raw:
        parts.append(F.col("raw_response"))
    if evidence is not None:
        fields = [c for c in evidence.columns if c not in ("record_id", "paper_id", "kind", "ordinal")]
        listed = likely(evidence, records, "record_id").groupBy("record_id").agg(
            F.array_sort(F.collect_list(F.struct("kind", "ordinal", *fields))).alias("source_evidence")
        )
        joined = joined.join(listed, "record_id", "left")
        parts.append(F.col("source_evidence"))
    return joined.select(
        "paper_id", "title", "doi", "year", "journal", F.when(F.col("_has"), F.struct(*parts)).alias("extraction")
    )


def export_header(papers: DataFrame, records: DataFrame) -> DataFrame:
    """One row: schema version, number of papers, and how many have a record.  Both are unique by paper."""
    with_record = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    return papers.agg(F.count(F.lit(1)).alias("total_papers")).select(
        F.lit(config.SCHEMA_VERSION).alias("schema_version"), "total_papers", with_record.alias("with_record")
    )
