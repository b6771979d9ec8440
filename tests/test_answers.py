"""Model answers: the contract, recovery, merging, child rows, reports."""

import json

import pytest
from pyspark.sql import functions as F

from foliomill import config
from foliomill.operators import merging, records, repair, reports
from foliomill.sources.records import records_from_raw

PROOF = {"source_text": "as we saw", "page_numbers": [2, 3], "section": "Results", "confidence": 0.9, "is_inferred": False}
GOOD = {
    "schema_version": "1.0.0",
    "summary": " Junctions with a thin barrier were annealed. ",
    "bibliographic_info": {"title": "On junctions", "authors": ["A. B", "C. D"], "year": 2022, "keywords": ["x"]},
    "journal_quality": {"impact_factor": None},
    "materials": [{"name": "Junction", "composition": "Co/MgO", "dopants": None, "additional_properties": {"k": 1}, "evidence": PROOF}],
    "process_conditions": [
        {"parameter_name": "annealing temperature", "value_numeric": 350.0, "unit": "°C", "confidence": 0.95, "evidence": PROOF},
        {"parameter_name": "gas", "value_text": "argon", "variable_role": "contextual", "is_inferred": True},
    ],
    "measurement_methods": [{"technique_name": "VSM", "category": "magnetic"}],
    "result_properties": [{"property_name": "ratio", "value_numeric": 0.0, "value_max": 600, "needs_review": True, "evidence": PROOF}],
    "outcome": {"main_findings": "It works.", "relevant_for_optimization": True},
    "input_variables": {"t": {"value": 350, "unit": "°C", "role": "input"}},
    "extraction_warnings": [],
    "fields_needing_review": [],
}


def changed(**changes):
    answer = json.loads(json.dumps(GOOD))
    for path, value in changes.items():
        *steps, last = path.split("__")
        target = answer
        for step in steps:
            target = target[int(step)] if step.isdigit() else target[step]
        target[int(last) if last.isdigit() else last] = value
    return answer


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


CASES = {
    "good": (json.dumps(GOOD), "valid", []),
    "fenced": (f"```json\n{json.dumps(GOOD)}\n```", "valid", []),
    "fenced plain": (f"  ```\n{json.dumps(GOOD)}\n```  ", "valid", []),
    "wrapped": (f"Here: {json.dumps(GOOD)} bye", "valid", []),
    "minimal": (json.dumps({"summary": "s", "outcome": None, "materials": []}), "valid", []),
    "numeric text": (json.dumps(changed(process_conditions__0__value_numeric="350")), "valid", []),
    "empty": ("", "rejected", None),
    "blank": (" \n ", "rejected", None),
    "null": (None, "rejected", None),
    "prose": ("This is not JSON at all.", "rejected", None),
    "broken": ('{"summary": ', "rejected", None),
    "broken span": ("x {a} y", "rejected", None),
    "list": ("[1, 2]", "rejected", None),
    "list of objects": ('[{"summary": "s"}]', "rejected", None),
    "number": ("5", "rejected", None),
    "no summary": (json.dumps(without("summary")), "recovered", ["summary"]),
    "empty summary": (json.dumps(changed(summary="")), "recovered", ["summary"]),
    "null summary": (json.dumps(changed(summary=None)), "recovered", ["summary"]),
    "blank summary": (json.dumps(changed(summary=" \t")), "minimal", ["summary"]),
    "number summary": (json.dumps(changed(summary=5)), "minimal", ["summary"]),
    "null list": (json.dumps(changed(materials=None)), "recovered", ["materials"]),
    "object for list": (json.dumps(changed(result_properties={"a": 1})), "recovered", ["result_properties"]),
    "text for notes": (json.dumps(changed(extraction_warnings="w")), "recovered", ["extraction_warnings"]),
    "number in notes": (json.dumps(changed(extraction_warnings=[1])), "minimal", ["extraction_warnings"]),
    "confidence": (json.dumps(changed(result_properties__0__confidence=1.5)), "minimal", ["result_properties[].confidence"]),
    "evidence": (
        json.dumps(changed(materials__0__evidence__confidence=-0.1)),
        "minimal",
        ["materials[].evidence.confidence"],
    ),
    "role": (json.dumps(changed(process_conditions__0__variable_role="banana")), "minimal", ["process_conditions[].variable_role"]),
    "null role": (json.dumps(changed(process_conditions__0__variable_role=None)), "minimal", ["process_conditions[].variable_role"]),
    "no name": (json.dumps(changed(measurement_methods__0={"category": "x"})), "minimal", ["measurement_methods[].technique_name"]),
    "item": (json.dumps(changed(materials=[3])), "minimal", ["materials[]"]),
    "year": (json.dumps(changed(bibliographic_info__year=1800)), "minimal", ["bibliographic_info.year"]),
    "half year": (json.dumps(changed(bibliographic_info__year=2000.5)), "minimal", ["bibliographic_info.year"]),
    "authors": (json.dumps(changed(bibliographic_info__authors=["a", 1])), "minimal", ["bibliographic_info.authors"]),
    "flag": (json.dumps(changed(result_properties__0__needs_review=None)), "minimal", ["result_properties[].needs_review"]),
    "number for text": (json.dumps(changed(materials__0__name=5)), "minimal", ["materials[].name"]),
    "text for object": (json.dumps(changed(outcome="fine")), "minimal", ["outcome"]),
    "map": (json.dumps(changed(input_variables=[1])), "minimal", ["input_variables"]),
    "pages": (json.dumps(changed(materials__0__evidence__page_numbers=["x"])), "minimal", ["materials[].evidence.page_numbers"]),
    "two": (json.dumps(changed(materials=None, outcome="fine")), "minimal", ["materials", "outcome"]),
}


@pytest.fixture(scope="module")
def repaired(spark):
    df = spark.createDataFrame([(name, raw) for name, (raw, *_) in CASES.items()], "name string, raw string")
    return {r.name: r for r in repair.repair_responses(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_outcome(repaired, name):
    _, outcome, violations = CASES[name]
    row = repaired[name]
    assert (row.outcome, row.violations) == (outcome, violations)
    if outcome == "valid":
        assert row.record.fields_needing_review == [] and row.record.extraction_warnings == []
    if outcome in ("recovered", "minimal"):
        assert row.record.fields_needing_review[-1] == "full_record"
        assert row.record.extraction_warnings[0] == config.RECOVERY_WARNING + ", ".join(violations)
    if outcome == "minimal":
        assert row.record.summary == config.FAILED_SUMMARY and row.record.materials == []
    if outcome == "rejected":
        assert row.record is None and row.reject_reason


def test_typed_record(repaired):
    record = repaired["good"].record
    assert record.summary == GOOD["summary"].strip()
    assert record.materials[0].evidence.page_numbers == [2, 3] and record.materials[0].additional_properties == '{"k":1}'
    assert record.process_conditions[0].variable_role == "input" and record.process_conditions[1].variable_role == "contextual"
    assert record.result_properties[0].value_max == 600.0 and record.result_properties[0].variable_role == "output"
    assert record.journal_quality.impact_factor_status == "unresolved"
    assert json.loads(record.input_variables) == GOOD["input_variables"] and record.output_variables is None
    assert repaired["numeric text"].record.process_conditions[0].value_numeric == 350.0
    kept = repaired["null list"].record
    assert kept.materials == [] and kept.process_conditions[0].parameter_name == "annealing temperature"
    assert repaired["no summary"].record.extraction_warnings[1] == config.MISSING_SUMMARY_WARNING
    assert repaired["empty"].reject_reason == "empty response" and repaired["list"].reject_reason == "not an object"
    assert repaired["prose"].reject_reason == "no JSON found" and repaired["broken span"].reject_reason == "invalid JSON"


def merged(spark, chunks, **options):
    rows = [(paper, number, json.dumps(c) if isinstance(c, dict) else c) for paper, number, c in chunks]
    df = spark.createDataFrame(rows, "paper_id string, chunk_no int, raw string")
    return {r.paper_id: r for r in merging.merge_chunks(repair.repair_responses(df), **options).collect()}


def chunk(summary, names=(), **more):
    return {"summary": summary, "materials": [{"name": n} for n in names], **more}


def test_merge(spark):
    found = merged(
        spark,
        [
            ("p", 3, chunk("four", ["B", "c"], extraction_warnings=["w2"])),
            ("p", 0, chunk("one", ["b", "A", "a"], extraction_warnings=["w1", "w2"], outcome=None)),
            ("p", 1, "not an answer"),
            ("p", 2, chunk("three", [None, "D"], outcome={"main_findings": "late"}, fields_needing_review=["z", "y"])),
            ("p", 4, chunk("five", [""], outcome={"main_findings": "later"})),
            ("single", 0, chunk("only", ["x", "X", "x"], extraction_warnings=["b", "a", "b"])),
            ("single", 1, ""),
            ("failed", 0, ""),
            ("failed", 1, "[]"),
        ],
    )
    p = found["p"]
    assert (p.n_chunks, p.n_failed, p.error) == (4, 1, None)
    assert p.record.summary == "one three four"
    assert [m.name for m in p.record.materials] == ["b", "A", None, "D", "c"]
    assert p.record.extraction_warnings == ["w1", "w2"] and p.record.fields_needing_review == ["y", "z"]
    assert p.record.outcome.main_findings == "late"
    single = found["single"].record
    assert [m.name for m in single.materials] == ["x", "X", "x"] and single.extraction_warnings == ["b", "a", "b"]
    assert found["failed"].record is None and found["failed"].error == merging.ALL_FAILED


def test_merge_strict_first(spark):
    chunks = [("p", 0, chunk("a")), ("p", 1, chunk("b", outcome={"main_findings": "late"}))]
    assert merged(spark, chunks, strict_first=True)["p"].record.outcome is None


def test_merge_is_exact_with_many_chunks_of_one_paper(spark):
    """Compared with a plain statement of the rule; one paper holds most of the chunks."""
    chunks = [("hot", n, chunk(f"s{n}", [f"m{(n * 7) % 11}", f"M{n % 5}"])) for n in range(120)]
    chunks += [(f"p{n}", n % 2, chunk("s", ["a"])) for n in range(20)]
    want, seen = [], set()
    for _, _, c in sorted(chunks[:120], key=lambda x: x[1]):
        for m in c["materials"]:
            if m["name"].lower() not in seen:
                seen.add(m["name"].lower())
                want.append(m["name"])
    found = merged(spark, chunks)
    assert [m.name for m in found["hot"].record.materials] == want and len(found) == 21
    assert found["hot"].record.summary == "s0 s1 s2"


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame([("p1", 0, json.dumps(GOOD)), ("p2", 0, json.dumps(changed(materials=None)))], "paper_id string, chunk_no int, raw string")
    return records.build_records(merging.merge_chunks(repair.repair_responses(df)), "rules", F.lit("2024-05-01 00:00:00").cast("timestamp")).cache()


def test_records_and_children(built):
    rows = {r.paper_id: r for r in built.collect()}
    assert rows["p1"].status == "complete" and rows["p2"].status == "needs_review"
    assert rows["p1"].main_findings == "It works." and rows["p1"].model == "rules"
    conditions = records.explode_conditions(built).where("paper_id = 'p1'").orderBy("ordinal").collect()
    assert [(c.ordinal, c.parameter_name, c.value_numeric) for c in conditions] == [(0, "annealing temperature", 350.0), (1, "gas", None)]
    assert records.explode_methods(built).count() == 2
    evidence = records.evidence(records.explode_materials(built), records.explode_conditions(built), records.explode_results(built))
    found = {(e.paper_id, e.field_name): e.field_value for e in evidence.collect()}
    assert found["p1", "material.Junction"] == "Co/MgO" and found["p1", "process_condition.annealing temperature"] == "350.0"
    assert found["p1", "result.ratio"] == "0.0" and len(found) == 5
    again = records_from_raw(built.select("paper_id", "raw_response", F.col("record").alias("was")))
    assert again.where("NOT (record <=> was)").count() == 0
    report = {r.paper_id: r.needs_review for r in records.extraction_report(built).collect()}
    assert report == {"p1": False, "p2": True}


def test_reports(built):
    named = built.withColumns({"original_filename": F.lit("file.pdf"), "file_hash": F.lit("h")})
    at = F.lit("2024-05-01 10:00:00").cast("timestamp")
    text = {r.paper_id: r.markdown for r in reports.summary_markdown(named, at).collect()}
    first = text["p1"].split("\n")
    assert first[0] == "# On junctions" and first[2].endswith("| 2024-05-01 10:00 UTC")
    assert "- **Authors:** A. B, C. D" in first and "- **Volume/Issue/Pages:** -/-/-" in first
    assert "| annealing temperature | 350.0 | °C | input | 0.95 | No |" in first
    assert "| gas | argon | N/A | contextual | N/A | Yes |" in first
    assert "| ratio | 0.0 | - | 600.0 | N/A | N/A | N/A | ⚠️ Yes |" in first
    assert "**Relevant for optimization:** **Yes** ✓" in first and "- **VSM** (magnetic): " in first
    assert "## Extraction Quality Notes" not in first
    assert "## Materials / Systems" not in text["p2"] and "- 🔍 `full_record`" in text["p2"]
    document = json.loads(reports.extraction_json(named, at).where("paper_id = 'p1'").first().json)
    assert document["paper_id"] == "p1" and document["paper_metadata"]["original_filename"] == "file.pdf"
    assert document["extraction"]["result_properties"][0]["value_min"] is None


def test_the_last_of_a_repeated_key_counts(spark):
    raws = ['{"summary": "first", "summary": "last"}', 'said: {"summary": "x", "materials": [{"name": "a", "name": "b"}], "materials": [{"name": "c", "name": "d"}]}']
    got = repair.repair_responses(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n int, raw string"), "raw").orderBy("n").collect()
    assert [(r.outcome, r.record.summary, [m.name for m in r.record.materials]) for r in got] == [("valid", "last", []), ("valid", "x", ["d"])]
