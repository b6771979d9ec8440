"""From the raw text of a model answer to a typed record: unwrap, decode, check, recover.

The checks are generated from the contract in ``schemas`` as SQL expressions over the decoded
variant, so they run inside the JVM.  They work on a "shaped" copy of the answer in which every
field was looked up once: a scalar is a variant, an object is ``{raw, ok, fields}`` and a list is
``{raw, items: [{ok, fields}]}``, where ``ok`` says that it is an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.plan import pinned
from foliomill.functions.text import WS, strip
from foliomill.schemas import ITEM_LISTS, NOTE_LISTS, RECORD, RECORD_FIELDS, Field, spark_type

# Patterns of a fenced answer and of the widest brace span.
FENCE_OPEN = rf"(?md)^```(?:json)?[{WS}]*"
FENCE_CLOSE = rf"(?md)```[{WS}]*$"
BRACE_SPAN = r"(?s)\{.*\}"

TRUE_WORDS = "'true', 't', 'yes', 'y', 'on', '1'"
FALSE_WORDS = "'false', 'f', 'no', 'n', 'off', '0'"
MAX_INT = 2**31

# The parser's setting for objects that repeat a key.
LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"

# How a response ended up.
VALID, RECOVERED, MINIMAL, REJECTED = "valid", "recovered", "minimal", "rejected"


def strip_fences(raw: Column) -> Column:
    """The answer without Markdown code fences and surrounding whitespace."""
    opened = F.regexp_replace(strip(raw), FENCE_OPEN, "")
    return strip(F.regexp_replace(strip(opened), FENCE_CLOSE, ""))


def decode_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``decoded`` (variant, null on failure) and ``reject_reason`` (null on success).

    The text is parsed whole; if that fails, the span from the first to the last brace is tried.  Of a key that an object
    repeats the last value counts, for which the session's parser is set.
    """
    df.sparkSession.conf.set(LAST_KEY_WINS, "true")
    text = F.col("_text")
    span = F.regexp_extract(text, BRACE_SPAN, 0)
    df = pinned(df, _text=strip_fences(F.coalesce(F.col(raw), F.lit(""))))
    df = pinned(df, decoded=F.try_parse_json(text))
    # What the span gives always is an object; the whole text may also be a list or a single value.
    df = df.withColumn("_other", F.col("decoded").isNotNull() & ~text.startswith("{"))
    df = pinned(df, decoded=F.coalesce("decoded", F.try_parse_json(span)))
    reason = (
        F.when(text == "", F.lit("empty response"))
        .when(F.col("decoded").isNull() & (span == ""), F.lit("no JSON found"))
        .when(F.col("decoded").isNull(), F.lit("invalid JSON"))
        .when(F.col("_other"), F.lit("not an object"))
    )
    return pinned(df, reject_reason=reason).drop("_text", "_other")


# --- SQL of the checks; every helper takes and returns SQL text ------------------------------


def _get(value: str, kind: str, path: str = "$") -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def _is_object(value: str) -> str:
    return f"({_get(value, 'map<string,variant>')} IS NOT NULL)"


def _is_array(value: str) -> str:
    return f"({_get(value, 'array<variant>')} IS NOT NULL)"


def _is_string(value: str) -> str:
    return f"coalesce(schema_of_variant({value}) = 'STRING', false)"


def _is_null(value: str) -> str:
    """True for an explicit JSON null; false when the field is absent."""
    return f"({value} IS NOT NULL AND is_variant_null({value}))"


def _is_given(value: str) -> str:
    return f"({value} IS NOT NULL AND NOT is_variant_null({value}))"


def _whole_number(value: str) -> str:
    number = _get(value, "double")
    return f"CASE WHEN {number} = floor({number}) AND abs({number}) < {MAX_INT} THEN CAST({number} AS INT) END"


def _shape(value: str, fields: tuple[Field, ...], path: str = "$") -> str:
    parts = []
    for field in fields:
        here = f"{path}.{field.name}"
        raw = _get(value, "variant", here)
        if field.kind == "object":
            shaped = f"named_struct('raw', {raw}, 'ok', {_is_object(raw)}, 'fields', {_shape(value, field.of, here)})"
        elif field.kind == "list":
            item = f"item -> named_struct('ok', {_is_object('item')}, 'fields', {_shape('item', field.of)})"
            shaped = f"named_struct('raw', {raw}, 'items', transform({_get(value, 'array<variant>', here)}, {item}))"
        else:
            shaped = raw
        parts.append(f"'{field.name}', {shaped}")
    return f"named_struct({', '.join(parts)})"


def _raw(at: str, field: Field) -> str:
    return f"{at}.{field.name}.raw" if field.kind in ("object", "list") else f"{at}.{field.name}"


def _typed(at: str, field: Field) -> str:
    """The field's value in its Spark type; null where it does not fit."""
    value, here = _raw(at, field), f"{at}.{field.name}"
    array = _get(value, "array<variant>")
    plain = {
        "str": lambda: f"CASE WHEN {_is_string(value)} THEN {_get(value, 'string')} END",
        "num": lambda: _get(value, "double"),
        "int": lambda: _whole_number(value),
        "bool": lambda: (
            f"CASE WHEN lower({_get(value, 'string')}) IN ({TRUE_WORDS}) THEN true "
            f"WHEN lower({_get(value, 'string')}) IN ({FALSE_WORDS}) THEN false END"
        ),
        "strs": lambda: f"transform({array}, x -> CASE WHEN {_is_string('x')} THEN {_get('x', 'string')} END)",
        "ints": lambda: f"transform({array}, x -> {_whole_number('x')})",
        "map": lambda: f"CASE WHEN {_is_object(value)} THEN to_json({value}) END",
        "object": lambda: f"CASE WHEN {here}.ok THEN {_typed_struct(here + '.fields', field.of)} END",
        "list": lambda: f"transform({here}.items, item -> {_typed_struct('item.fields', field.of)})",
    }[field.kind]()
    if field.default is not None:
        default = str(field.default).lower() if field.kind == "bool" else f"'{field.default}'"
        return f"coalesce({plain}, {default})"
    return plain


def _typed_struct(at: str, fields: tuple[Field, ...]) -> str:
    parts = [f"'{field.name}', {_typed(at, field)}" for field in fields]
    return f"named_struct({', '.join(parts)})"


def _fits(at: str, field: Field) -> str:
    """True when a given value has the right type and lies within its bounds."""
    value = _raw(at, field)
    if field.kind == "list":
        return f"({at}.{field.name}.items IS NOT NULL)"
    if field.kind == "object":
        return f"{at}.{field.name}.ok"
    if field.kind == "map":
        return _is_object(value)
    if field.kind in ("strs", "ints"):
        item = _is_string("x") if field.kind == "strs" else f"({_whole_number('x')}) IS NOT NULL"
        return f"coalesce(forall({_get(value, 'array<variant>')}, x -> {item}), false)"
    if field.kind == "str" and not field.choices:
        return _is_string(value)
    typed = _typed(at, Field(field.name, field.kind))
    if field.low is not None:
        return f"coalesce(({typed}) BETWEEN {float(field.low)}D AND {float(field.high)}D, false)"
    if field.choices:
        choices = ", ".join(f"'{choice}'" for choice in field.choices)
        return f"coalesce(({typed}) IN ({choices}), false)"
    return f"({typed}) IS NOT NULL"


def _problems(at: str, fields: tuple[Field, ...], label: str = "") -> str:
    """SQL of an array with the labels of the fields that break the contract."""
    own, nested = [], []
    for field in fields:
        value, name = _raw(at, field), label + field.name
        broken = f"{_is_given(value)} AND NOT {_fits(at, field)}"
        if field.required:
            broken = f"NOT {_is_given(value)} OR ({broken})"
        elif not field.nullable:
            broken = f"{_is_null(value)} OR ({broken})"
        own.append(f"CASE WHEN {broken} THEN '{name}' END")
        if field.kind == "object":
            inner = _problems(f"{at}.{field.name}.fields", field.of, name + ".")
            nested.append(f"CASE WHEN {at}.{field.name}.ok THEN {inner} ELSE {NO_LABELS} END")
        elif field.kind == "list":
            inner = _problems("item.fields", field.of, name + "[].")
            each = f"item -> CASE WHEN item.ok THEN {inner} ELSE array('{name}[]') END"
            nested.append(f"coalesce(flatten(transform({at}.{field.name}.items, {each})), {NO_LABELS})")
    return f"concat({', '.join([f'array_compact(array({chr(44).join(own)}))', *nested])})"


NO_LABELS = "CAST(array() AS ARRAY<STRING>)"


# --- operators -------------------------------------------------------------------------------


def _fillable(at: str) -> str:
    """SQL of an array with the labels of the problems that recovery can fill in."""
    not_lists = [f"CASE WHEN {at}.{name}.items IS NULL THEN '{name}' END" for name in ITEM_LISTS]
    not_lists += [f"CASE WHEN NOT {_is_array(f'{at}.{name}')} THEN '{name}' END" for name in NOTE_LISTS]
    # A summary that counts as not given: absent, null, or an empty or zero value.
    falsy = f"""coalesce(to_json({at}.summary) IN ('null', '""', '0', '0.0', 'false', '[]', '{{}}'), true)"""
    return f"array_compact(array({', '.join(not_lists)}, CASE WHEN {falsy} THEN 'summary' END))"


def validate_records(df: DataFrame) -> DataFrame:
    """Adds ``violations`` (sorted distinct labels), ``fillable`` and the typed ``record``; null for a rejected row."""
    blank_summary = f"CASE WHEN NOT ({_get('shaped.summary', 'string')} RLIKE r'[^{WS}]') THEN 'summary' END"
    labels = f"array_compact(array_append({_problems('shaped', RECORD)}, {blank_summary}))"
    # The shaped copy is bound to a name by a one-item transform and never leaves the expression:
    # each of its parts carries the answer's whole key table, which would be copied into every row.
    check = f"""get(transform(array({_shape('decoded', RECORD)}), shaped -> named_struct(
        'violations', array_sort(array_distinct({labels})),
        'fillable', {_fillable('shaped')},
        'record', {_typed_struct('shaped', RECORD)})), 0)"""
    df = pinned(df, _check=F.when(F.col("reject_reason").isNull(), F.expr(check)))
    kept = [c for c in df.columns if c != "_check"]
    return df.select(*kept, "_check.violations", "_check.fillable", "_check.record")


def recover_records(df: DataFrame) -> DataFrame:
    """Adds ``outcome`` and settles ``record``.

    A record that meets the contract is kept.  Otherwise a missing summary and lists that are not
    lists are filled in; a record that then meets the contract is kept with a warning and marked
    for review.  Any other is replaced by a minimal record.  Rows that could not be decoded have
    no record.
    """
    broken, outcome, own = F.col("violations"), F.col("outcome"), F.col("record")
    df = pinned(
        df,
        outcome=F.when(F.col("reject_reason").isNotNull(), F.lit(REJECTED))
        .when(F.size(broken) == 0, F.lit(VALID))
        .when(F.size(F.array_except(broken, "fillable")) == 0, F.lit(RECOVERED))
        .otherwise(F.lit(MINIMAL)),
    )
    no_summary = F.array_contains("fillable", "summary")
    warning = F.concat(F.lit(config.RECOVERY_WARNING), F.array_join(broken, ", "))
    warnings = F.array_compact(F.array(warning, F.when(no_summary, F.lit(config.MISSING_SUMMARY_WARNING))))
    whole_record = F.array(F.lit(config.REVIEW_WHOLE_RECORD))
    summary = F.when((outcome == RECOVERED) & no_summary, F.lit(config.INCOMPLETE_SUMMARY)).otherwise(strip(own["summary"]))

    def noted(name: str, extra: Column) -> Column:
        given = F.coalesce(own[name], F.expr(NO_LABELS))
        return F.when(outcome == VALID, given).when(outcome == RECOVERED, F.concat(given, extra)).otherwise(extra)

    special = {
        "schema_version": F.when(outcome != MINIMAL, own["schema_version"]).otherwise(F.lit(config.SCHEMA_VERSION)),
        "summary": F.when(outcome == MINIMAL, F.lit(config.FAILED_SUMMARY)).otherwise(summary),
        "extraction_warnings": noted("extraction_warnings", warnings),
        "fields_needing_review": noted("fields_needing_review", whole_record),
    }

    def settled(field: Field) -> Column:
        if field.name in special:
            return special[field.name]
        kept = F.when(outcome != MINIMAL, own[field.name]).cast(spark_type(field))
        return F.coalesce(kept, F.array().cast(spark_type(field))) if field.name in ITEM_LISTS else kept

    record = F.struct(*[settled(field).alias(field.name) for field in RECORD])
    return pinned(df, record=F.when(outcome != REJECTED, record)).drop("fillable")


def repair_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Decode, validate and recover in one go; the variant is dropped."""
    return recover_records(validate_records(decode_responses(df, raw))).drop("decoded")


def accepted(df: DataFrame) -> DataFrame:
    """Rows with a usable record."""
    return df.where(F.col("outcome") != REJECTED)


def rejects(df: DataFrame) -> DataFrame:
    """Rows without one, with their reason."""
    return df.where(F.col("outcome") == REJECTED)
