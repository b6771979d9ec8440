"""Records and their child rows: building, flattening, choosing the canonical version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions.text import double_text
from foliomill.operators.filters import likely
from foliomill.schemas import CONDITION, MATERIAL, METHOD, RESULT, Field

EVIDENCE_FIELDS = ["source_text", "page_numbers", "section", "confidence", "is_inferred", "inference_reasoning"]
OUTCOME_FIELDS = ["main_findings", "claimed_mechanism", "limitations", "notable_novelty", "relevant_for_optimization"]
VARIABLE_MAPS = ["input_variables", "output_variables", "contextual_notes"]


def record_status(fields_needing_review: Column) -> Column:
    review = F.size(F.coalesce(fields_needing_review, F.array().cast("array<string>"))) > 0
    return F.when(review, F.lit("needs_review")).otherwise(F.lit("complete"))


def build_records(merged: DataFrame, model: str, created_at: Column | None = None) -> DataFrame:
    """Rows of the version table from merged records; the nested ``record`` is kept for the child tables.

    The id follows from paper, model, time and content, so a retried task makes the same one.
    """
    record = F.col("record")
    raw = F.to_json(record, {"ignoreNullFields": "false"})
    usable = merged.where(record.isNotNull())
    stamped = usable.withColumn("created_at", F.current_timestamp() if created_at is None else created_at)
    stamped = stamped.withColumn("raw_response", raw)
    identity = F.concat_ws("~", "paper_id", F.lit(model), F.col("created_at").cast("string"), "raw_response")
    return stamped.select(
        F.sha2(identity, 256).alias("record_id"),
        "paper_id",
        "created_at",
        F.lit(model).alias("model"),
        record["schema_version"].alias("schema_version"),
        record_status(record["fields_needing_review"]).alias("status"),
        record["summary"].alias("summary_text"),
        "raw_response",
        record["bibliographic_info"].alias("bibliographic_info"),
        record["journal_quality"].alias("journal_quality"),
        *[record["outcome"][name].alias(name) for name in OUTCOME_FIELDS],
        *[record[name].alias(name) for name in VARIABLE_MAPS],
        F.lit(False).alias("human_edited"),
        "record",
    )


def canonical(records: DataFrame, key: str = "paper_id", newest: list[str] | None = None) -> DataFrame:
    """The newest version per paper; earlier ones are thereby demoted.

    Planned as a per-task limit before the shuffle, so many versions of one paper cost one row per task.
    """
    newest = newest or ["created_at", "record_id"]
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in newest])
    return records.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).drop("_rank")


def canonical_whole(records: DataFrame, key: str = "paper_id", newest: list[str] | None = None) -> DataFrame:
    """``canonical`` of stored wide rows: ids are chosen first, so answers of earlier versions stay where they are read.

    The filter of chosen ids drops none of them, null or repeated ones either, and what else it lets pass loses again.
    """
    newest = newest or ["created_at", "record_id"]
    chosen = canonical(records.select(*dict.fromkeys([key, *newest, "record_id"])), key, newest)
    return canonical(likely(records, chosen, "record_id"), key, newest)


def _children(records: DataFrame, kind: str, fields: tuple[Field, ...]) -> DataFrame:
    rows = records.select("record_id", "paper_id", F.posexplode(F.col(f"record.{kind}")).alias("ordinal", "_item"))
    return rows.select("record_id", "paper_id", "ordinal", *[F.col(f"_item.{f.name}").alias(f.name) for f in fields])


def explode_materials(records: DataFrame) -> DataFrame:
    return _children(records, "materials", MATERIAL)


def explode_conditions(records: DataFrame) -> DataFrame:
    return _children(records, "process_conditions", CONDITION)


def explode_methods(records: DataFrame) -> DataFrame:
    return _children(records, "measurement_methods", METHOD)


def explode_results(records: DataFrame) -> DataFrame:
    return _children(records, "result_properties", RESULT)


def value_or_null(numeric: Column, text: Column) -> Column:
    """The number as text, else the text; null when there is neither."""
    return F.coalesce(double_text(numeric), text)


def evidence(materials: DataFrame, conditions: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence rows of all items that carry evidence; no shuffle.

    Each input holds ``record_id, paper_id, ordinal``, its item columns and a struct ``evidence``.
    """

    def rows(items: DataFrame, kind: str) -> DataFrame:
        name, value, _ = EVIDENCE_OF[kind]
        return items.where(F.col("evidence").isNotNull()).select(
            "record_id",
            "paper_id",
            F.lit(kind).alias("kind"),
            "ordinal",
            name(F.col).alias("field_name"),
            value(F.col).alias("field_value"),
            *_evidence_fields(kind, F.col("evidence")),
        )

    return rows(materials, "material").unionByName(rows(conditions, "process_condition")).unionByName(rows(results, "result"))


def record_evidence(records: DataFrame) -> DataFrame:
    """The evidence rows of records with their nested ``record``: one pass over them, whatever the kinds of items."""

    def of_kind(kind: str) -> Column:
        name, value, field = EVIDENCE_OF[kind]
        items = F.coalesce(F.col(f"record.{field}"), F.array())

        def row(item: Column, at: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"),
                at.alias("ordinal"),
                name(item.getField).alias("field_name"),
                value(item.getField).alias("field_value"),
                item["evidence"].isNotNull().alias("_given"),
                *_evidence_fields(kind, item["evidence"]),
            )

        return F.filter(F.transform(items, row), lambda x: x["_given"])

    found = F.concat(*[of_kind(kind) for kind in EVIDENCE_OF])
    return records.select("record_id", "paper_id", F.inline(found)).drop("_given")


def _evidence_fields(kind: str, evidence: Column) -> list[Column]:
    # Only material evidence keeps its reasoning; the others are stored without.
    gone = () if kind == "material" else ("inference_reasoning",)
    return [F.lit(None).cast("string").alias(f) if f in gone else evidence[f].alias(f) for f in EVIDENCE_FIELDS]


def _value(field) -> Column:
    return value_or_null(field("value_numeric"), field("value_text"))


# Per kind of item: the evidence's field name, its value, and the record's list.
EVIDENCE_OF = {
    "material": (
        lambda f: F.concat(F.lit("material."), F.coalesce(F.nullif(f("name"), F.lit("")), F.lit("unknown"))),
        lambda f: f("composition"),
        "materials",
    ),
    "process_condition": (lambda f: F.concat(F.lit("process_condition."), f("parameter_name")), _value, "process_conditions"),
    "result": (lambda f: F.concat(F.lit("result."), f("property_name")), _value, "result_properties"),
}


def extraction_report(records: DataFrame) -> DataFrame:
    """What an extraction run tells about each paper."""
    return records.select(
        "paper_id",
        "record_id",
        F.lit("extracted").alias("status"),
        (F.size("record.fields_needing_review") > 0).alias("needs_review"),
        F.col("record.extraction_warnings").alias("warnings"),
    )


def record_detail(records: DataFrame, children: dict[str, DataFrame], key: str = "record_id", order: str = "ordinal") -> DataFrame:
    """Canonical records with all their child rows, in long form: the record's columns, ``kind``, ``ordinal`` and ``item``.

    ``item`` is the child row as JSON, whole; ``kind`` names its table.  A record without children has one row whose kind is
    null.  The shape is the same however many children a record has.  Children are merged in by a sorted join: what Spark
    expects of their size, before lists are opened and JSON is written, is far too small to broadcast them by.
    """
    head = canonical(records)
    tagged = []
    for kind, rows in children.items():
        fields = [c for c in rows.columns if c not in (key, "paper_id", order)]
        item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        tagged.append(rows.select(key, F.lit(kind).alias("kind"), order, item.alias("item")))
    together = tagged[0]
    for rows in tagged[1:]:
        together = together.unionByName(rows)
    return head.join(together.hint("merge"), key, "left")


def record_lists(records: DataFrame, children: dict[str, DataFrame], ids: list, key: str = "record_id", order: str = "ordinal") -> DataFrame:
    """The canonical records among the given ones (a page of ids), each with one whole list per child table."""
    head = canonical(records).where(F.col(key).isin(ids))
    for kind, rows in children.items():
        mine = rows.where(F.col(key).isin(ids))
        fields = [c for c in rows.columns if c not in (key, "paper_id", order)]
        listed = mine.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(kind))
        none = F.array().cast(listed.schema[kind].dataType)
        head = head.join(listed, key, "left").withColumn(kind, F.coalesce(kind, none))
    return head
