"""Per-paper files: Markdown report and machine-readable record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import double_text, present

# Headings and table heads of the report.
CONDITION_HEAD = [
    "## Processing Conditions (Input Variables)",
    "",
    "| Parameter | Value | Unit | Role | Confidence | Inferred? |",
    "|-----------|-------|------|------|-----------|-----------|",
]
RESULT_HEAD = [
    "## Experimental Results (Output Variables)",
    "",
    "| Property | Value | Min | Max | Unit | Conditions | Confidence | Review? |",
    "|----------|-------|-----|-----|------|------------|-----------|---------|",
]
MATERIAL_LINES = {
    "Composition": "composition",
    "Substrate": "substrate",
    "Crystal structure": "crystal_structure",
    "Device structure": "device_structure",
    "Layer stack": "layer_stack",
}
FINDING_SECTIONS = {
    "Main Findings": "main_findings",
    "Claimed Mechanism": "claimed_mechanism",
    "Limitations": "limitations",
    "Notable Novelty": "notable_novelty",
}
NOT_GIVEN = "N/A"
REVIEW_MARK = "⚠️ Yes"


def _or(value: Column, fallback: str) -> Column:
    return F.coalesce(present(value), F.lit(fallback))


def _lines(*parts: str | Column) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _when(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast("array<string>"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _confidence(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value)).otherwise(F.lit(NOT_GIVEN))


def _value(item: Column) -> Column:
    return F.coalesce(double_text(item["value_numeric"]), present(item["value_text"]), F.lit(NOT_GIVEN))


def _biblio(bib: Column) -> Column:
    issue = F.concat_ws("/", _or(bib["volume"], "-"), _or(bib["issue"], "-"), _or(bib["pages"], "-"))
    year = F.when(bib["year"] != 0, bib["year"].cast("string"))
    entries = {
        "Title": _or(bib["title"], NOT_GIVEN),
        "Journal": _or(bib["journal"], NOT_GIVEN),
        "Authors": _or(F.array_join(bib["authors"], ", "), NOT_GIVEN),
        "Year": F.coalesce(year, F.lit(NOT_GIVEN)),
        "DOI": _or(bib["doi"], NOT_GIVEN),
        "Volume/Issue/Pages": issue,
    }
    lines = [F.concat(F.lit(f"- **{name}:** "), value) for name, value in entries.items()]
    return _when(bib.isNotNull(), _lines("## Bibliographic Information", "", *lines, ""))


def _materials(items: Column) -> Column:
    def section(item: Column, i: Column) -> Column:
        title = F.concat(F.lit("### Material "), (i + 1).cast("string"), F.lit(": "), _or(item["name"], "Unknown"))
        facts = [F.concat(F.lit(f"- **{label}:** "), present(item[name])) for label, name in MATERIAL_LINES.items()]
        return F.array_compact(_lines(title, *facts, ""))

    body = F.flatten(F.transform(items, section))
    return _when(F.size(items) > 0, F.concat(_lines("## Materials / Systems", ""), body))


def _conditions(items: Column) -> Column:
    def row(item: Column) -> Column:
        inferred = F.when(item["is_inferred"], F.lit("Yes")).otherwise(F.lit("No"))
        return _row(
            item["parameter_name"],
            _value(item),
            _or(item["unit"], NOT_GIVEN),
            item["variable_role"],
            _confidence(item["confidence"]),
            inferred,
        )

    return _when(F.size(items) > 0, F.concat(_lines(*CONDITION_HEAD), F.transform(items, row), _lines("")))


def _results(items: Column) -> Column:
    def row(item: Column) -> Column:
        review = F.when(item["needs_review"], F.lit(REVIEW_MARK)).otherwise(F.lit("No"))
        return _row(
            item["property_name"],
            _value(item),
            F.coalesce(double_text(item["value_min"]), F.lit("-")),
            F.coalesce(double_text(item["value_max"]), F.lit("-")),
            _or(item["unit"], NOT_GIVEN),
            _or(item["conditions"], NOT_GIVEN),
            _confidence(item["confidence"]),
            review,
        )

    return _when(F.size(items) > 0, F.concat(_lines(*RESULT_HEAD), F.transform(items, row), _lines("")))


def _methods(items: Column) -> Column:
    def row(item: Column) -> Column:
        return F.concat(
            F.lit("- **"),
            item["technique_name"],
            F.lit("** ("),
            _or(item["category"], NOT_GIVEN),
            F.lit("): "),
            F.coalesce(item["description"], F.lit("")),
        )

    return _when(
        F.size(items) > 0, F.concat(_lines("## Characterization Methods", ""), F.transform(items, row), _lines(""))
    )


def _outcome(outcome: Column) -> Column:
    parts = [_lines("## Key Findings and Outcomes", "")]
    for title, name in FINDING_SECTIONS.items():
        text = outcome[name]
        parts.append(_when(F.coalesce(text != "", F.lit(False)), _lines(f"### {title}", "", text, "")))
    relevant = outcome["relevant_for_optimization"]
    verdict = F.when(relevant, F.lit("**Yes** ✓")).otherwise(F.lit("No"))
    line = F.concat(F.lit("**Relevant for optimization:** "), verdict)
    parts += [_when(relevant.isNotNull(), F.array(line)), _lines("")]
    return _when(outcome.isNotNull(), F.concat(*parts))


def _notes(warnings: Column, reviews: Column) -> Column:
    warned = F.concat(
        _lines("### Warnings"), F.transform(warnings, lambda w: F.concat(F.lit("- ⚠️ "), w)), _lines("")
    )
    review = F.concat(
        _lines("### Fields Needing Human Review"),
        F.transform(reviews, lambda f: F.concat(F.lit("- 🔍 `"), f, F.lit("`"))),
        _lines(""),
    )
    has_warnings, has_reviews = F.size(warnings) > 0, F.size(reviews) > 0
    return F.concat(
        _when(has_warnings | has_reviews, _lines("## Extraction Quality Notes", "")),
        _when(has_warnings, warned),
        _when(has_reviews, review),
    )


def summary_markdown(records: DataFrame, generated_at: Column | None = None, generator: str = "foliomill") -> DataFrame:
    """``paper_id, markdown`` from ``paper_id, original_filename, record``; empty sections are left out."""
    record = F.col("record")
    stamp = F.date_format(F.current_timestamp() if generated_at is None else generated_at, "yyyy-MM-dd HH:mm 'UTC'")
    bib = record["bibliographic_info"]
    head = _lines(
        F.concat(F.lit("# "), F.coalesce(present(bib["title"]), F.col("original_filename"))),
        "",
        F.concat(F.lit(f"**Generated by {generator}** | "), stamp),
        F.concat(F.lit("**Schema version:** "), record["schema_version"]),
        "",
        "---",
        "",
        "## Summary",
        "",
        record["summary"],
        "",
    )
    sections = [
        head,
        _biblio(bib),
        _materials(record["materials"]),
        _conditions(record["process_conditions"]),
        _results(record["result_properties"]),
        _methods(record["measurement_methods"]),
        _outcome(record["outcome"]),
        _notes(record["extraction_warnings"], record["fields_needing_review"]),
    ]
    return records.select("paper_id", F.array_join(F.concat(*sections), "\n").alias("markdown"))


def extraction_json(records: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """``paper_id, json``: the whole record with its nulls, and the file's name and hash."""
    stamp = F.current_timestamp() if generated_at is None else generated_at
    document = F.struct(
        F.col("paper_id").cast("string").alias("paper_id"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("generated_at"),
        F.col("record.schema_version").alias("schema_version"),
        F.col("record").alias("extraction"),
        F.struct("original_filename", "file_hash").alias("paper_metadata"),
    )
    return records.select("paper_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))
