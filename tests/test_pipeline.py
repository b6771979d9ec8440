"""The pipeline over a folder of small files, and its repetition."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliomill.operators import inference
from foliomill.plans import pipeline
from foliomill.sources.tables import FILE, RAW, Lake
from foliomill.streaming import scan, status


def page_reader(content: bytes):
    """Pages are separated by form feeds; a file that starts with "bad" cannot be read."""
    text = content.decode()
    if text.startswith("bad"):
        raise ValueError("not a PDF")
    for number, page in enumerate(text.split("\f"), 1):
        yield {
            "page_number": number,
            "native_text": page,
            "ocr_text": lambda page=page: page.replace("SCAN", "recognised text of the scanned page"),
            "meta": {"Author": "Ada Lovelace; Grace Hopper"},
        }


def model(system: str, prompt: str):
    """A rule in place of a model: one material, one condition per prompt."""
    if "NOANSWER" in prompt:
        return "sorry"
    if "NOKEY" in prompt:
        raise RuntimeError("api_key missing")
    if "FLAKY" in prompt:
        raise ConnectionError("timed out")
    return json.dumps(
        {
            "summary": f"{len(prompt)} characters",
            "bibliographic_info": {"title": "Model title", "journal": "J. Tests", "volume": "7"},
            "materials": [{"name": "CoFeB", "composition": "Co40", "evidence": {"source_text": "a layer"}}],
            "process_conditions": [{"parameter_name": "temperature", "value_numeric": 350, "unit": "C"}],
        }
    )


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in box"
    (root / "sub").mkdir(parents=True)
    text = "A long enough title for this paper\nDOI: 10.1000/xyz.1, received 2021\n\n" + "word " * 60
    (root / "a.pdf").write_text(text + "\f" + "SCAN")
    (root / "sub" / "copy.PDF").write_text(text + "\f" + "SCAN")
    (root / "b.pdf").write_text("another paper NOANSWER " * 20)
    (root / "c.pdf").write_text("bad file")
    (root / "d.pdf").write_text("   ")
    (root / "e.pdf").write_text("waits FLAKY " * 30)
    (root / "f.pdf").write_text("locked NOKEY " * 30)
    (root / "notes.txt").write_text("ignored")
    return root


def run(lake, folder, name, answer=model):
    pipeline.ingest(lake, str(folder), name)
    pipeline.parse(lake, name, page_reader)
    pipeline.prepare(lake, name)
    pipeline.call_model(lake, name, answer, 2, waves=2, sleep=lambda s: None)
    return pipeline.settle(lake, name, "rules")


def test_folder_to_tables_and_second_run(spark, tmp_path, folder):
    lake = Lake(spark, str(tmp_path / "lake"))
    built = run(lake, folder, "r1")
    pipeline.write_reports(lake, built, "r1")
    counts = spark.read.parquet(lake.path("scan_counts")).first()
    assert (counts.found, counts.ingested, counts.skipped_duplicates, counts.failed) == (7, 6, 1, 0)

    papers = {p.original_filename: p for p in pipeline.current_papers(lake).collect()}
    assert len(papers) == 6
    a = papers["a.pdf"]
    assert (a.status, a.parse_method, a.page_count) == ("extracted", "hybrid", 2)
    assert a.title == "A long enough title for this paper" and a.doi == "10.1000/xyz.1" and a.volume == "7"
    assert a.publication_year == 2021 and a.raw_text.endswith("recognised text of the scanned page")
    assert papers["b.pdf"].status == "failed" and papers["b.pdf"].extraction_error == "All chunks failed to extract"
    assert papers["c.pdf"].parse_error == "Parse error: not a PDF"
    assert papers["d.pdf"].status == "failed" and "empty text" in papers["d.pdf"].parse_error
    assert papers["e.pdf"].status == "parsed"
    assert papers["f.pdf"].status == "failed"

    raw = lake.read("raw_responses", RAW)
    classes = {r.error_class: r.attempts for r in raw.where("error IS NOT NULL").collect()}
    assert classes == {"retryable": 3, "final": 1}
    assert spark.read.parquet(lake.path("materials")).count() == 1
    assert spark.read.parquet(lake.path("evidence")).first().field_name == "material.CoFeB"
    report = spark.read.parquet(lake.path("reports")).first().markdown
    assert "| temperature | 350.0 | C | input | N/A | No |" in report and "## Experimental Results" not in report

    # Second run: one new file, one repeated; only the new prompt and the failed call are asked.
    (folder / "g.pdf").write_text("a new paper " * 30)
    asked = spark.sparkContext.accumulator(0)

    def counted(system, prompt):
        asked.add(1)
        return model(system, prompt.replace("FLAKY", ""))

    run(lake, folder, "r2", counted)
    assert asked.value == 2
    papers = {p.original_filename: p.status for p in pipeline.current_papers(lake).collect()}
    assert papers["e.pdf"] == "extracted" and papers["g.pdf"] == "extracted" and len(papers) == 7
    second = spark.read.parquet(lake.path("scan_counts")).where("run = 'r2'").first()
    assert (second.found, second.ingested, second.skipped_duplicates) == (8, 1, 7)

    # A repeated run leaves the same registry.
    before = sorted(r.paper_id for r in lake.read("registry", FILE).collect())
    pipeline.ingest(lake, str(folder), "r2")
    assert sorted(r.paper_id for r in lake.read("registry", FILE).collect()) == before


def test_stream_takes_only_new_files(spark, tmp_path, folder):
    lake = Lake(spark, str(tmp_path / "lake"))

    def trigger():
        scan.scan_stream(lake, str(folder), str(tmp_path / "ck")).awaitTermination()
        rows = spark.read.parquet(lake.path("scan_counts")).agg(F.sum("found"), F.sum("ingested"), F.sum("skipped_duplicates"))
        return tuple(rows.first())

    assert trigger() == (7, 6, 1)
    (folder / "new.pdf").write_text("brand new")
    (folder / "again.pdf").write_text("brand new")
    (folder / "old.pdf").write_text("bad file")
    assert trigger() == (10, 7, 3)
    batch = pipeline.ingest(Lake(spark, str(tmp_path / "other")), str(folder), "all").first()
    assert (batch.found, batch.ingested, batch.skipped_duplicates) == (10, 7, 3)
    ids = [r.paper_id for r in lake.read("registry", FILE).collect()]
    assert len(ids) == len(set(ids)) == 7


def test_stream_dedup_state(spark, tmp_path, folder):
    scan.use_rocksdb(spark)
    stream = scan.unseen(scan.file_stream(spark, str(folder), files_per_trigger=3))

    def trigger():
        (
            stream.writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ck"))
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert trigger() == 6
    (folder / "new.pdf").write_text("brand new")
    (folder / "old.pdf").write_text("bad file")
    assert trigger() == 7


def test_live_status(spark, tmp_path):
    source, seen = str(tmp_path / "events"), {}
    layout = "paper_id string, event_id bigint, ts timestamp, status string"

    def add(rows):
        at = [(p, i, datetime(2024, 1, 1, 0, i), s) for p, i, s in rows]
        spark.createDataFrame(at, layout).coalesce(1).write.mode("append").parquet(source)

    def trigger():
        events = spark.readStream.schema(layout).parquet(source)
        query = status.watch_status(
            events, lambda rows, _: seen.update({r.paper_id: r.status for r in rows.collect()}), str(tmp_path / "ck")
        )
        query.awaitTermination()

    add([("a", 1, "uploaded"), ("a", 2, "parsing"), ("b", 1, "uploaded")])
    trigger()
    assert seen == {"a": "parsing", "b": "uploaded"}
    add([("a", 5, "parsed"), ("c", 3, "failed"), ("b", 0, "failed")])
    trigger()
    assert seen == {"a": "parsed", "b": "uploaded", "c": "failed"}
    counts = {r.status: r.n for r in status.live_counts(spark.read.parquet(source)).collect()}
    assert (counts["parsed"], counts["failed"], counts["extracted"]) == (1, 1, 0)


def test_retry_waits():
    assert [inference.retry_wait(n) for n in (1, 2, 3, 6)] == [4, 4, 8, 60]
