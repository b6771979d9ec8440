"""Model answers: decoding, checking, recovering, merging, flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.operators import merging, records, repair, reports
from foliomill.schemas import NOTE_LISTS
from foliomill.session import durable
from workload.base import query


def chunk_records(t):
    return repair.repair_responses(t.responses)


def single_records(t):
    """Every accepted answer as a record of its own."""
    ok = repair.accepted(chunk_records(t))
    return ok.select("record_id", F.col("record_id").alias("paper_id"), "record")


@query(
    "strip_fences",
    "SELECT record_id, stripped FROM decoded",
    ("decoded",),
)
def strip_fences(t):
    return t.responses.select("record_id", repair.strip_fences(F.col("raw")).alias("stripped"))


@query("decode_responses", "SELECT record_id, body IS NOT NULL AS is_json, reject_reason FROM decoded", ("decoded",))
def decode_responses(t):
    decoded = repair.decode_responses(t.responses)
    return decoded.select("record_id", F.col("decoded").isNotNull().alias("is_json"), "reject_reason")


@query("response_violations", "SELECT record_id, violations FROM checked", ("checked",))
def response_violations(t):
    checked = repair.validate_records(repair.decode_responses(t.responses))
    return checked.select("record_id", F.array_join("violations", ",").alias("violations"))


@query(
    "recover_responses",
    """SELECT record_id, outcome, summary, CASE WHEN outcome <> 'rejected' THEN coalesce(CAST(json_array_length(good, '$.materials') AS INTEGER), 0) END AS n_materials,
 array_to_string(reviews, ',') AS reviews, CASE WHEN outcome <> 'rejected' THEN array_to_string(warnings, ',') END AS warnings,
 CAST(json_extract(good, '$.result_properties[0].value_numeric') AS DOUBLE) AS price FROM settled""",
    ("settled",),
)
def recover_responses(t):
    record = F.col("record")
    return chunk_records(t).select(
        "record_id",
        "outcome",
        record["summary"].alias("summary"),
        F.when(record.isNotNull(), F.size(record["materials"])).alias("n_materials"),
        F.array_join(record["fields_needing_review"], ",").alias("reviews"),
        F.array_join(record["extraction_warnings"], ",").alias("warnings"),
        F.get(record["result_properties"], F.lit(0))["value_numeric"].alias("price"),
    )


@query(
    "rejected_responses",
    "SELECT record_id, reject_reason FROM decoded WHERE reject_reason IS NOT NULL",
    ("decoded",),
)
def rejected_responses(t):
    return repair.rejects(chunk_records(t)).select("record_id", "reject_reason")


# Names of one kind, first per lower-cased name by chunk and position; a paper with one usable chunk keeps all.
def _merged_names(kind: str, field: str) -> str:
    return f"""(SELECT paper_id, array_to_string(list(name ORDER BY chunk_no, i), '|') AS {kind} FROM
 (SELECT paper_id, chunk_no, i, name, row_number() OVER (PARTITION BY paper_id, lower(coalesce(name, '')) ORDER BY chunk_no, i) AS rn,
   (SELECT count(*) FROM settled s WHERE s.paper_id = e.paper_id AND s.outcome <> 'rejected') AS n_ok FROM
  (SELECT paper_id, chunk_no, unnest(generate_series(1, len(names))) AS i, unnest(names) AS name FROM
   (SELECT paper_id, chunk_no, json_extract_string(good, '$.{kind}[*].{field}') AS names FROM settled WHERE good IS NOT NULL)) e)
 WHERE rn = 1 OR n_ok = 1 GROUP BY paper_id)"""


def _merged_notes(name: str) -> str:
    return f"""(SELECT paper_id, array_to_string(list_sort(list_distinct(flatten(list({name})))), '|') AS {name} FROM settled
 WHERE outcome <> 'rejected' GROUP BY paper_id)"""


MERGED_SQL = f"""SELECT p.paper_id, n_chunks, n_failed, summary, coalesce(materials, CASE WHEN n_chunks > 0 THEN '' END) AS materials,
 coalesce(process_conditions, CASE WHEN n_chunks > 0 THEN '' END) AS process_conditions,
 coalesce(measurement_methods, CASE WHEN n_chunks > 0 THEN '' END) AS measurement_methods,
 coalesce(result_properties, CASE WHEN n_chunks > 0 THEN '' END) AS result_properties, reviews, warnings
FROM (SELECT paper_id, count(*) FILTER (outcome <> 'rejected') AS n_chunks, count(*) FILTER (outcome = 'rejected') AS n_failed,
  array_to_string(list(summary ORDER BY chunk_no) FILTER (outcome <> 'rejected')[1:3], ' ') AS summary FROM settled GROUP BY paper_id) p
LEFT JOIN {_merged_names('materials', 'name')} USING (paper_id)
LEFT JOIN {_merged_names('process_conditions', 'parameter_name')} USING (paper_id)
LEFT JOIN {_merged_names('measurement_methods', 'technique_name')} USING (paper_id)
LEFT JOIN {_merged_names('result_properties', 'property_name')} USING (paper_id)
LEFT JOIN {_merged_notes('reviews')} USING (paper_id) LEFT JOIN {_merged_notes('warnings')} USING (paper_id)"""


@query("merge_chunks", MERGED_SQL, ("settled",))
def merge_chunks(t):
    record = F.col("record")
    names = {
        "materials": "name",
        "process_conditions": "parameter_name",
        "measurement_methods": "technique_name",
        "result_properties": "property_name",
    }
    return merging.merge_chunks(durable(chunk_records(t))).select(
        "paper_id",
        "n_chunks",
        "n_failed",
        record["summary"].alias("summary"),
        *[F.array_join(record[kind][field], "|").alias(kind) for kind, field in names.items()],
        F.array_join(record["fields_needing_review"], "|").alias("reviews"),
        F.array_join(record["extraction_warnings"], "|").alias("warnings"),
    )


@query(
    "merged_summaries",
    """SELECT paper_id, array_to_string(list(summary ORDER BY chunk_no)[1:3], ' ') AS summary FROM settled
WHERE outcome <> 'rejected' AND summary <> '' GROUP BY paper_id""",
    ("settled",),
)
def merged_summaries(t):
    return merging.merged_summaries(chunk_records(t))


@query(
    "merged_notes",
    f"SELECT paper_id, reviews, warnings FROM {_merged_notes('reviews')} JOIN {_merged_notes('warnings')} USING (paper_id) WHERE reviews <> '' OR warnings <> ''",
    ("settled",),
)
def merged_notes(t):
    notes = merging.merged_notes(chunk_records(t))
    names = dict(zip(NOTE_LISTS, ("warnings", "reviews")))
    return notes.select("paper_id", *[F.array_join(n, "|").alias(alias) for n, alias in names.items()])


@query(
    "chunk_failures",
    """SELECT paper_id, count(*) FILTER (outcome <> 'rejected') AS n_chunks, count(*) FILTER (outcome = 'rejected') AS n_failed FROM settled GROUP BY paper_id""",
    ("settled",),
)
def chunk_failures(t):
    return merging.merged_scalars(chunk_records(t)).select("paper_id", "n_chunks", "n_failed")


# --- child rows ------------------------------------------------------------------------------


def _child_sql(kind: str, fields: dict[str, str]) -> str:
    columns = ", ".join(
        f"CAST(json_extract_string(good, '$.{kind}[' || (i - 1) || '].{name}') AS {sql_type}) AS {name}"
        for name, sql_type in fields.items()
    )
    return f"""SELECT record_id, CAST(i - 1 AS INTEGER) AS ordinal, {columns} FROM
 (SELECT record_id, good, unnest(generate_series(1, CAST(json_array_length(good, '$.{kind}') AS BIGINT))) AS i FROM settled WHERE good IS NOT NULL)"""


@query("material_rows", _child_sql("materials", {"name": "VARCHAR", "composition": "VARCHAR"}), ("settled",))
def material_rows(t):
    return records.explode_materials(single_records(t)).select("record_id", "ordinal", "name", "composition")


@query(
    "condition_rows",
    _child_sql("process_conditions", {"parameter_name": "VARCHAR", "value_numeric": "DOUBLE", "variable_role": "VARCHAR"}),
    ("settled",),
)
def condition_rows(t):
    rows = records.explode_conditions(single_records(t))
    return rows.select("record_id", "ordinal", "parameter_name", "value_numeric", "variable_role")


@query("method_rows", _child_sql("measurement_methods", {"technique_name": "VARCHAR", "category": "VARCHAR"}), ("settled",))
def method_rows(t):
    return records.explode_methods(single_records(t)).select("record_id", "ordinal", "technique_name", "category")


@query(
    "result_rows",
    "SELECT *, 'output' AS variable_role, false AS needs_review FROM ("
    + _child_sql("result_properties", {"property_name": "VARCHAR", "value_numeric": "DOUBLE", "unit": "VARCHAR"})
    + ")",
    ("settled",),
)
def result_rows(t):
    rows = records.explode_results(single_records(t))
    return rows.select("record_id", "ordinal", "property_name", "value_numeric", "unit", "variable_role", "needs_review")


def evidence_table(t):
    return records.record_evidence(single_records(t))


EVIDENCE_SQL = """(SELECT record_id, 'material' AS kind, 'material.' || json_extract_string(good, '$.materials[0].name') AS field_name,
 json_extract_string(good, '$.materials[0].composition') AS field_value, json_extract_string(good, '$.materials[0].evidence.source_text') AS source_text,
 CAST(NULL AS VARCHAR) AS section, CAST(json_extract(good, '$.materials[0].evidence.confidence') AS DOUBLE) AS confidence FROM settled WHERE good IS NOT NULL
UNION ALL SELECT record_id, 'process_condition', 'process_condition.size', CAST(CAST(json_extract(good, '$.process_conditions[0].value_numeric') AS DOUBLE) AS VARCHAR), NULL,
 json_extract_string(good, '$.process_conditions[0].evidence.section'), NULL FROM settled WHERE good IS NOT NULL
UNION ALL SELECT record_id, 'result', 'result.price', CAST(CAST(json_extract(good, '$.result_properties[0].value_numeric') AS DOUBLE) AS VARCHAR), NULL, 'results', NULL
 FROM settled WHERE good IS NOT NULL)"""
EVIDENCE_COLUMNS = ["record_id", "kind", "field_name", "field_value", "source_text", "section", "confidence"]


@query("evidence_rows", f"SELECT * FROM {EVIDENCE_SQL}", ("settled",))
def evidence_rows(t):
    return evidence_table(t).select(*EVIDENCE_COLUMNS)


# Of ten answers that make one paper's records the newest is canonical.
NEWEST = "(SELECT paper_id, max(record_id) AS record_id FROM settled WHERE outcome <> 'rejected' GROUP BY paper_id)"


def version_heads(t, settled=None):
    settled = single_records(t) if settled is None else settled
    heads = settled.select("record_id", F.expr("CAST(floor(record_id / 10) AS BIGINT)").alias("paper_id"))
    return heads.withColumn("created_at", F.lit(0))


@query(
    "evidence_search",
    f"SELECT * FROM {EVIDENCE_SQL} WHERE contains(lower(field_name), lower('BRAND#1')) AND record_id IN (SELECT record_id FROM {NEWEST})",
    ("settled",),
)
def evidence_search(t):
    from foliomill.operators.catalog import evidence_for

    return evidence_for(evidence_table(t), records.canonical(version_heads(t)), "BRAND#1").select(*EVIDENCE_COLUMNS)


ITEM_SQL = {
    "materials": ("name", "composition"),
    "process_conditions": ("parameter_name", "variable_role"),
    "measurement_methods": ("technique_name", "category"),
    "result_properties": ("property_name", "unit"),
}
DETAIL_SQL = " UNION ALL ".join(
    f"SELECT record_id, '{kind}' AS kind, ordinal, {a} AS name, {b} AS shown FROM (" + _child_sql(kind, {a: "VARCHAR", b: "VARCHAR"}) + ")"
    for kind, (a, b) in ITEM_SQL.items()
)


@query(
    "record_detail",
    f"""SELECT n.record_id, n.paper_id, kind, ordinal, name, shown FROM {NEWEST} n LEFT JOIN ({DETAIL_SQL}
UNION ALL SELECT record_id, 'evidence', 0, field_name, field_value FROM {EVIDENCE_SQL}) USING (record_id)""",
    ("settled",),
)
def record_detail(t):
    r = durable(single_records(t))
    children = {
        "materials": records.explode_materials(r),
        "process_conditions": records.explode_conditions(r),
        "measurement_methods": records.explode_methods(r),
        "result_properties": records.explode_results(r),
        "evidence": records.record_evidence(r),
    }
    detail = records.record_detail(version_heads(t, r), children)
    text = lambda *paths: F.coalesce(*(F.get_json_object("item", f"$.{p}") for p in paths))
    names, shown = [a for a, _ in ITEM_SQL.values()], {k: b for k, (_, b) in ITEM_SQL.items()}
    value = F.when(F.col("kind") == "evidence", text("field_value"))
    for kind, field in shown.items():
        value = value.when(F.col("kind") == kind, text(field))
    return detail.select("record_id", "paper_id", "kind", "ordinal", text(*names, "field_name").alias("name"), value.alias("shown"))


@query(
    "record_rows",
    """SELECT record_id AS source_id, '1.0.0' AS schema_version, CASE WHEN len(reviews) > 0 THEN 'needs_review' ELSE 'complete' END AS status,
 summary AS summary_text FROM settled WHERE outcome <> 'rejected'""",
    ("settled",),
)
def record_rows(t):
    built = records.build_records(single_records(t), model="stored")
    return built.select(F.col("paper_id").alias("source_id"), "schema_version", "status", "summary_text")


@query(
    "records_from_raw",
    """SELECT record_id AS source_id, summary AS summary_text, coalesce(CAST(json_array_length(good, '$.materials') AS INTEGER), 0) AS n_materials
FROM settled WHERE outcome <> 'rejected'""",
    ("settled",),
)
def records_from_raw(t):
    from foliomill.sources.records import records_from_raw as replay

    stored = records.build_records(single_records(t), model="stored").select("paper_id", "raw_response")
    again = replay(stored)
    return again.select(
        F.col("paper_id").alias("source_id"),
        F.col("record.summary").alias("summary_text"),
        F.size("record.materials").alias("n_materials"),
    )


@query(
    "extraction_report",
    """SELECT record_id AS paper_id, 'extracted' AS status, len(reviews) > 0 AS needs_review, array_to_string(warnings, '|') AS warnings
FROM settled WHERE outcome <> 'rejected'""",
    ("settled",),
)
def extraction_report(t):
    report = records.extraction_report(single_records(t))
    return report.select("paper_id", "status", "needs_review", F.array_join("warnings", "|").alias("warnings"))


def stamp():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


# The report of the sections these answers can have.
MARKDOWN_SQL = """SELECT record_id AS paper_id, concat_ws(chr(10), '# file ' || record_id, '', '**Generated by foliomill** | 2024-01-01 00:00 UTC',
 '**Schema version:** 1.0.0', '', '---', '', '## Summary', '', summary, '',
 CASE WHEN good IS NOT NULL THEN concat_ws(chr(10), '## Materials / Systems', '', '### Material 1: ' || json_extract_string(good, '$.materials[0].name'),
  '- **Composition:** ' || json_extract_string(good, '$.materials[0].composition'), '', '### Material 2: ' || json_extract_string(good, '$.materials[1].name'), '',
  '## Processing Conditions (Input Variables)', '', '| Parameter | Value | Unit | Role | Confidence | Inferred? |',
  '|-----------|-------|------|------|-----------|-----------|',
  '| size | ' || CAST(CAST(json_extract(good, '$.process_conditions[0].value_numeric') AS DOUBLE) AS VARCHAR) || ' | N/A | input | N/A | No |', '',
  '## Experimental Results (Output Variables)', '', '| Property | Value | Min | Max | Unit | Conditions | Confidence | Review? |',
  '|----------|-------|-----|-----|------|------------|-----------|---------|',
  '| price | ' || CAST(CAST(json_extract(good, '$.result_properties[0].value_numeric') AS DOUBLE) AS VARCHAR) || ' | - | - | $ | N/A | N/A | No |', '',
  '## Characterization Methods', '', '- **' || json_extract_string(good, '$.measurement_methods[0].technique_name') || '** (N/A): ', '') END,
 CASE WHEN len(reviews) > 0 THEN '## Extraction Quality Notes' || chr(10) END,
 CASE WHEN len(warnings) > 0 THEN concat_ws(chr(10), '### Warnings', '- ⚠️ ' || warnings[1], '') END,
 CASE WHEN len(reviews) > 0 THEN concat_ws(chr(10), '### Fields Needing Human Review', '- 🔍 `' || reviews[1] || '`', '') END) AS markdown
FROM settled WHERE outcome <> 'rejected'"""


@query("summary_markdown", MARKDOWN_SQL, ("settled",))
def summary_markdown(t):
    named = single_records(t).withColumn("original_filename", F.concat(F.lit("file "), F.col("paper_id").cast("string")))
    return reports.summary_markdown(named, stamp())


@query(
    "extraction_json",
    """SELECT record_id::VARCHAR AS paper_id, '2024-05-01T10:00:00.000000Z' AS generated_at, '1.0.0' AS schema_version, 'file ' || record_id AS original_filename,
 sha256(record_id::VARCHAR) AS file_hash, summary, CASE WHEN good IS NULL THEN 0 ELSE json_array_length(good, '$.materials') END::INTEGER AS n_materials,
 json_extract_string(good, '$.materials[0].evidence.source_text') AS source_text, CAST(json_extract(good, '$.process_conditions[0].value_numeric') AS DOUBLE) AS size,
 array_to_string(reviews, '|') AS reviews, array_to_string(warnings, '|') AS warnings, good IS NOT NULL AS names_null_fields FROM settled WHERE outcome <> 'rejected'""",
    ("settled",),
)
def extraction_json(t):
    """The machine-readable files, parsed again."""
    named = single_records(t).select(
        "paper_id",
        "record",
        F.concat(F.lit("file "), F.col("paper_id").cast("string")).alias("original_filename"),
        F.sha2(F.col("paper_id").cast("string"), 256).alias("file_hash"),
    )
    written = reports.extraction_json(named, F.lit("2024-05-01 10:00:00").cast("timestamp")).select("json")
    at = lambda path: F.get_json_object("json", f"$.{path}")
    texts = lambda path: F.array_join(F.from_json(at(path), "array<string>"), "|")
    return written.select(
        at("paper_id").alias("paper_id"),
        at("generated_at").alias("generated_at"),
        at("schema_version").alias("schema_version"),
        at("paper_metadata.original_filename").alias("original_filename"),
        at("paper_metadata.file_hash").alias("file_hash"),
        at("extraction.summary").alias("summary"),
        F.json_array_length(at("extraction.materials")).alias("n_materials"),
        at("extraction.materials[0].evidence.source_text").alias("source_text"),
        at("extraction.process_conditions[0].value_numeric").cast("double").alias("size"),
        texts("extraction.fields_needing_review").alias("reviews"),
        texts("extraction.extraction_warnings").alias("warnings"),
        F.contains("json", F.lit('"stoichiometry":null')).alias("names_null_fields"),
    )
