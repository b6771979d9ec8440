"""The contract a model answer must meet, and the table layouts derived from it.

Field names and bounds are fixed values: readers of the produced tables depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from foliomill import config


@dataclass(frozen=True)
class Field:
    """One field of the contract.

    kind      str, num, int, bool, strs, ints, map, object or list
    of        the fields of an object, or of a list's items
    required  must be given and not null
    default   used when the field is absent; such a field may not be null
    """

    name: str
    kind: str = "str"
    of: tuple[Field, ...] = ()
    required: bool = False
    default: Any = None
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()

    @property
    def nullable(self) -> bool:
        return not self.required and self.default is None and self.kind != "list" and not self.is_note_list

    @property
    def is_note_list(self) -> bool:
        return self.name in NOTE_LISTS


NOTE_LISTS = ("extraction_warnings", "fields_needing_review")


def _confidence() -> Field:
    return Field("confidence", "num", low=0.0, high=1.0)


def _flag(name: str) -> Field:
    return Field(name, "bool", default=False)


def _role(default: str) -> Field:
    return Field("variable_role", default=default, choices=tuple(config.VARIABLE_ROLES))


EVIDENCE = (
    Field("source_text"),
    Field("page_numbers", "ints"),
    Field("section"),
    _confidence(),
    _flag("is_inferred"),
    Field("inference_reasoning"),
)
BIBLIO = (
    Field("title"),
    Field("journal"),
    Field("authors", "strs"),
    Field("year", "int", low=config.BIBLIO_YEAR_MIN, high=config.BIBLIO_YEAR_MAX),
    Field("doi"),
    Field("volume"),
    Field("issue"),
    Field("pages"),
    Field("keywords", "strs"),
    Field("abstract"),
    Field("evidence", "object", of=EVIDENCE),
)
JOURNAL_QUALITY = (
    Field("impact_factor", "num"),
    Field("impact_factor_year", "int"),
    Field("impact_factor_source"),
    Field("impact_factor_status", default="unresolved"),
    Field("notes"),
)
MATERIAL = (
    Field("name"),
    Field("composition"),
    Field("stoichiometry"),
    Field("dopants", "strs"),
    Field("substrate"),
    Field("layer_stack"),
    Field("device_structure"),
    Field("crystal_structure"),
    Field("phase"),
    Field("dimensionality"),
    Field("morphology"),
    Field("additional_properties", "map"),
    Field("evidence", "object", of=EVIDENCE),
)
CONDITION = (
    Field("parameter_name", required=True),
    Field("value_numeric", "num"),
    Field("value_text"),
    Field("unit"),
    _role("input"),
    _confidence(),
    _flag("is_inferred"),
    Field("notes"),
    Field("evidence", "object", of=EVIDENCE),
)
METHOD = (Field("technique_name", required=True), Field("category"), Field("description"))
RESULT = (
    Field("property_name", required=True),
    Field("value_numeric", "num"),
    Field("value_min", "num"),
    Field("value_max", "num"),
    Field("value_text"),
    Field("unit"),
    Field("conditions"),
    _role("output"),
    _confidence(),
    _flag("is_inferred"),
    _flag("needs_review"),
    Field("evidence", "object", of=EVIDENCE),
)
OUTCOME = (
    Field("main_findings"),
    Field("claimed_mechanism"),
    Field("limitations"),
    Field("notable_novelty"),
    Field("relevant_for_optimization", "bool"),
    Field("evidence", "object", of=EVIDENCE),
)
RECORD = (
    Field("schema_version", default=config.SCHEMA_VERSION),
    Field("summary", required=True),
    Field("bibliographic_info", "object", of=BIBLIO),
    Field("journal_quality", "object", of=JOURNAL_QUALITY),
    Field("materials", "list", of=MATERIAL),
    Field("process_conditions", "list", of=CONDITION),
    Field("measurement_methods", "list", of=METHOD),
    Field("result_properties", "list", of=RESULT),
    Field("outcome", "object", of=OUTCOME),
    Field("input_variables", "map"),
    Field("output_variables", "map"),
    Field("contextual_notes", "map"),
    Field("extraction_warnings", "strs"),
    Field("fields_needing_review", "strs"),
)

# Item lists of a record and the field that names an item.
ITEM_LISTS = {
    "materials": "name",
    "process_conditions": "parameter_name",
    "measurement_methods": "technique_name",
    "result_properties": "property_name",
}
RECORD_FIELDS = {field.name: field for field in RECORD}

_SCALARS = {
    "str": T.StringType(),
    "num": T.DoubleType(),
    "int": T.IntegerType(),
    "bool": T.BooleanType(),
    "strs": T.ArrayType(T.StringType()),
    "ints": T.ArrayType(T.IntegerType()),
    # Free-form objects are kept as JSON text, readable outside Spark.
    "map": T.StringType(),
}


def spark_type(field: Field) -> T.DataType:
    if field.kind == "object":
        return struct_type(field.of)
    if field.kind == "list":
        return T.ArrayType(struct_type(field.of))
    return _SCALARS[field.kind]


def struct_type(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([T.StructField(field.name, spark_type(field)) for field in fields])


RECORD_TYPE = struct_type(RECORD)

RAW_RESPONSE_COLUMNS = (
    "response string, error string, error_class string, attempts int, elapsed_s double, "
    "input_tokens bigint, output_tokens bigint"
)
