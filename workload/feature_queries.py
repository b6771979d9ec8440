"""Variables of records: long and wide forms, maps, matrices, coverage, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.operators import features, records
from foliomill.operators.filters import likely
from foliomill.session import shared_folder, stored
from foliomill.sources import sinks
from workload.base import TWINS, query

INPUTS = ["input_annealing_temperature", "input_film_thickness", "input_pressure"]
OUTPUTS = ["output_bandgap", "output_coercivity", "output_tmr_ratio"]
X_NAMES = ["Annealing Temperature", "Film Thickness", "Pressure", "annealing temperature"]
Y_NAMES = ["Coercivity", "TMR ratio", "bandgap"]


POSITION = "ordinal[1] AS l_linenumber, ordinal[2] AS l_partkey, ordinal[3] AS l_suppkey, ordinal[4] AS l_shipdate"


def long_sql(kind: str, source: str) -> str:
    """Long form of conditions or results in SQL, with the position spelled out."""
    prefix, name, where, review = (
        ("input_", "parameter_name", "WHERE variable_role IN ('input', 'contextual')", "CAST(NULL AS BOOLEAN)")
        if kind == "inputs"
        else ("output_", "property_name", "", "needs_review")
    )
    return f"""(SELECT paper_id, '{prefix}' || replace(lower({name}), ' ', '_') AS name, coalesce(CAST(value_numeric AS VARCHAR), value_text) AS value,
 unit, confidence, {review} AS needs_review, ordinal FROM {source} {where})"""


def pivot_sql(kind: str, source: str, names: list[str], extras: list[str]) -> str:
    columns = []
    for name in names:
        for field, alias in [("value", name), *[(extra, f"{name}_{extra}") for extra in extras]]:
            columns.append(f"arg_max_null({field}, ordinal) FILTER (name = '{name}') AS {alias}")
    return f"SELECT paper_id, {', '.join(columns)} FROM {long_sql(kind, source)} GROUP BY paper_id"


@query(
    "long_inputs",
    f"SELECT paper_id, name, value, unit, confidence, {POSITION} FROM {long_sql('inputs', 'conditions')}",
    ("conditions",),
)
def long_inputs(t):
    return features.long_inputs(t.conditions).select("paper_id", "name", "value", "unit", "confidence", "ordinal.*")


@query(
    "long_outputs",
    f"SELECT paper_id, name, value, needs_review, {POSITION} FROM {long_sql('outputs', 'results')}",
    ("results",),
)
def long_outputs(t):
    return features.long_outputs(t.results).select("paper_id", "name", "value", "needs_review", "ordinal.*")


@query("pivot_inputs", pivot_sql("inputs", "conditions", INPUTS, features.INPUT_EXTRAS), ("conditions",))
def pivot_inputs(t):
    return features.pivot_inputs(features.long_inputs(t.conditions), INPUTS)


@query("pivot_outputs", pivot_sql("outputs", "results", OUTPUTS, features.OUTPUT_EXTRAS), ("results",))
def pivot_outputs(t):
    return features.pivot_outputs(features.long_outputs(t.results), rest=False)


@query(
    "primary_material",
    """SELECT paper_id, arg_min_null(name, ordinal) AS material_name, arg_min_null(composition, ordinal) AS material_composition,
 arg_min_null(substrate, ordinal) AS material_substrate, arg_min_null(crystal_structure, ordinal) AS crystal_structure FROM materials GROUP BY paper_id""",
    ("materials",),
)
def primary_material(t):
    return features.primary_material(t.materials)


MATERIAL_SQL = """SELECT canon.paper_id, arg_min_null(name, ordinal) AS material_name, arg_min_null(composition, ordinal) AS material_composition,
 arg_min_null(substrate, ordinal) AS material_substrate, arg_min_null(crystal_structure, ordinal) AS crystal_structure
 FROM materials m JOIN canon ON m.record_id = canon.record_id GROUP BY canon.paper_id"""


@query(
    "export_wide",
    f"""SELECT c.paper_id, c.title, c.doi, c.year, c.journal, k.status AS extraction_status, i.* EXCLUDE (paper_id), o.* EXCLUDE (paper_id), m.* EXCLUDE (paper_id)
FROM customers c JOIN canon k USING (paper_id) LEFT JOIN ({pivot_sql('inputs', 'version_conditions', INPUTS, features.INPUT_EXTRAS)}) i USING (paper_id)
LEFT JOIN ({pivot_sql('outputs', 'version_results', OUTPUTS, features.OUTPUT_EXTRAS)}) o USING (paper_id) LEFT JOIN ({MATERIAL_SQL}) m USING (paper_id)""",
    ("customers", "version_conditions", "version_results", "materials"),
)
def export_wide(t):
    return wide_export(t, canonical_statuses(t))


def canonical_statuses(t):
    return records.canonical(t.versions.select("record_id", "paper_id", "created_at", "status"))


def wide_export(t, canon):
    from workload.views import materials

    return features.export_wide(
        t.customers,
        t.segments,
        canon,
        features.long_inputs(likely(t.conditions, canon, "record_id"), "record_id"),
        features.long_outputs(likely(t.results, canon, "record_id"), "record_id"),
        materials(t, canon),
        INPUTS,
        OUTPUTS,
        key="record_id",
    )


@query("export_csv", TWINS["export_wide"])
def export_csv(t):
    """The wide table written as CSV and read back."""
    wide, path = wide_export(t, stored(canonical_statuses(t), "records")), shared_folder(t.spark, "csv")
    sinks.write_csv(wide, path)
    return t.spark.read.schema(wide.schema).option("header", True).option("escape", '"').csv(path)


def last_sql(kind: str, source: str) -> str:
    """Last value per paper and raw name, inputs or outputs only."""
    name, role, fields = (
        ("parameter_name", "input", ["value_numeric", "unit", "confidence"])
        if kind == "x"
        else ("property_name", "output", ["value_numeric", "value_min", "value_max", "unit", "conditions", "confidence"])
    )
    columns = ", ".join(f"arg_max_null({f}, ordinal) AS {'value' if f == 'value_numeric' else f}" for f in fields)
    return f"(SELECT paper_id, {name} AS name, {columns} FROM {source} WHERE variable_role = '{role}' GROUP BY paper_id, {name})"


def map_sql(kind: str, source: str) -> str:
    value = "coalesce(CAST(value AS VARCHAR), '')"
    return f"(SELECT paper_id, string_agg(name || '=' || {value} || ' ' || unit, ';' ORDER BY name) AS {kind} FROM {last_sql(kind, source)} GROUP BY paper_id)"


def shown_map(name: str):
    """A variable map as sorted text, which both engines write alike."""
    from foliomill.functions.text import double_text

    def entry(e):
        value = F.coalesce(double_text(e["value"]["value"]), F.lit(""))
        return F.concat(e["key"], F.lit("="), value, F.lit(" "), e["value"]["unit"])

    return F.array_join(F.transform(F.array_sort(F.map_entries(name)), entry), ";")


@query(
    "xy_maps",
    f"SELECT paper_id, x AS X, y FROM {map_sql('x', 'conditions')} FULL JOIN {map_sql('y', 'results')} USING (paper_id)",
    ("conditions", "results"),
)
def xy_maps(t):
    maps = features.xy_maps(t.conditions, t.results)
    return maps.select("paper_id", shown_map("X").alias("X"), shown_map("y").alias("y"))


@query(
    "export_nested",
    f"""SELECT c.paper_id, c.title, c.doi, c.year, c.journal, k.status, k.summary_text AS summary, k.raw_response, CASE WHEN k.paper_id IS NOT NULL THEN coalesce(x, '') END AS X,
 CASE WHEN k.paper_id IS NOT NULL THEN coalesce(y, '') END AS y, CASE WHEN k.paper_id IS NOT NULL THEN '{{}}' END AS input_variables
FROM customers c LEFT JOIN canon k USING (paper_id) LEFT JOIN {map_sql('x', 'version_conditions')} USING (paper_id) LEFT JOIN {map_sql('y', 'version_results')} USING (paper_id)""",
    ("customers", "version_conditions", "version_results"),
)
def export_nested(t):
    return shown_export(nested_export(t, t.segments, records.canonical(t.versions)))


def nested_export(t, journals, canon):
    return features.export_nested(t.customers, journals, canon, t.conditions, t.results, raw=True)


def shown_export(nested):
    e = F.col("extraction")
    return nested.withColumns({"X": e["bo_ready"]["X"], "y": e["bo_ready"]["y"]}).select(
        "paper_id",
        "title",
        "doi",
        "year",
        "journal",
        e["status"].alias("status"),
        e["summary"].alias("summary"),
        e["raw_response"].alias("raw_response"),
        shown_map("X").alias("X"),
        shown_map("y").alias("y"),
        e["input_variables"].alias("input_variables"),
    )


def json_export(t):
    """Papers and header of the nested export, written as JSON lines and read back."""
    canon = stored(records.canonical_whole(t.versions), "records")
    # Stored, so their size is known before papers would be moved by journal.
    nested = nested_export(t, stored(t.segments, "journals"), canon)
    path = shared_folder(t.spark, "json")
    sinks.write_export_json(nested, features.export_header(t.customers, canon), path, F.lit("2024-05-01 10:00:00").cast("timestamp"))
    return t.spark.read.schema(nested.schema).json(f"{path}/papers"), t.spark.read.json(f"{path}/header")


@query("export_json_papers", TWINS["export_nested"])
def export_json_papers(t):
    return shown_export(json_export(t)[0])


@query(
    "export_json_header",
    "SELECT '2024-05-01T10:00:00.000000Z' AS exported_at, '1.0.0' AS schema_version, count(*) AS total_papers, (SELECT count(*) FROM canon) AS with_record FROM customers",
    ("customers", "canon"),
)
def export_json_header(t):
    return json_export(t)[1].select("exported_at", "schema_version", "total_papers", "with_record")


def matrix_sql(kind: str, source: str, papers: str, names: list[str]) -> str:
    columns = ", ".join(f"max(value) FILTER (name = '{name}') AS \"{name}\"" for name in names)
    return f"SELECT p.paper_id, {columns} FROM {papers} p LEFT JOIN {last_sql(kind, source)} v USING (paper_id) GROUP BY p.paper_id"


# Of names that differ in case the second gets a numbered column.
@query(
    "feature_matrix_x",
    matrix_sql("x", "version_conditions", "customers", X_NAMES).replace('AS "annealing temperature"', 'AS "annealing temperature__2"'),
    ("customers", "version_conditions"),
)
def feature_matrix_x(t):
    return features.feature_matrix(t.customers, features.x_long(t.version_conditions), X_NAMES)


@query(
    "sparse_matrix_x",
    f"""SELECT r.paper_id, c.name, block, "row", "column", value FROM (SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS "row" FROM customers) r
 JOIN (SELECT paper_id, name, value FROM {last_sql('x', 'version_conditions')}) v USING (paper_id)
 JOIN (SELECT name, row_number() OVER (ORDER BY name) - 1 AS "column" FROM (SELECT DISTINCT name FROM {last_sql('x', 'version_conditions')})) c USING (name),
 LATERAL (SELECT "row" // 100 AS block) WHERE value IS NOT NULL""",
    ("customers", "version_conditions"),
)
def sparse_matrix_x(t):
    """The cells with what their numbers stand for."""
    cells, rows, columns = features.sparse_matrix(t.customers, features.x_long(t.version_conditions), shared_folder(t.spark, "matrix"), 100)
    return cells.join(rows, "row").join(columns, "column").select("paper_id", "name", "block", "row", "column", "value")


@query("feature_matrix_y", matrix_sql("y", "version_results", "customers", Y_NAMES), ("customers", "version_results"))
def feature_matrix_y(t):
    return features.feature_matrix(t.customers, features.y_long(t.version_results))


def coverage_sql(kind: str, source: str, papers: str) -> str:
    return f"""SELECT name, n_papers, count(value) AS n_observed, round(100.0::DOUBLE * count(value) / n_papers, 1) AS coverage_pct, min(value) AS min_value, max(value) AS max_value
FROM {last_sql(kind, source)} CROSS JOIN (SELECT count(*) AS n_papers FROM {papers}) GROUP BY name, n_papers"""


@query("coverage_inputs", coverage_sql("x", "version_conditions", "canon"), ("version_conditions", "canon"))
def coverage_inputs(t):
    canon = records.canonical(t.versions.select("record_id", "paper_id", "created_at"))
    return features.coverage(features.x_long(t.version_conditions), canon)


@query("coverage_outputs", coverage_sql("y", "version_results", "customers"), ("version_results", "customers"))
def coverage_outputs(t):
    return features.coverage(features.y_long(t.version_results), t.customers)


@query(
    "coverage_all_records",
    coverage_sql("x", "conditions", "versions"),
    ("conditions", "versions"),
)
def coverage_all_records(t):
    return features.coverage(features.x_long(t.conditions), t.versions)


@query(
    "dataset_inputs",
    "SELECT record_id, parameter_name, value_numeric, unit FROM conditions WHERE variable_role = 'input'",
    ("conditions",),
)
def dataset_inputs(t):
    return features.dataset_long(t.conditions, "input").select("record_id", "parameter_name", "value_numeric", "unit")


@query(
    "dataset_outputs",
    "SELECT record_id, property_name, value_numeric, unit FROM results WHERE variable_role = 'output'",
    ("results",),
)
def dataset_outputs(t):
    return features.dataset_long(t.results, "output").select("record_id", "property_name", "value_numeric", "unit")


@query(
    "export_header",
    "SELECT '1.0.0' AS schema_version, count(*) AS total_papers, (SELECT count(*) FROM canon) AS with_record FROM customers",
    ("customers", "canon"),
)
def export_header(t):
    return features.export_header(t.customers, records.canonical(t.versions.select("record_id", "paper_id", "created_at")))


@query(
    "export_selected",
    "SELECT paper_id, title FROM customers WHERE paper_id IN (SELECT paper_id FROM canon WHERE status = 'complete')",
    ("customers", "canon"),
)
def export_selected(t):
    wanted = records.canonical(t.versions).where(F.col("status") == "complete")
    return features.only_papers(t.customers, wanted).select("paper_id", "title")
