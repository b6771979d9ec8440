"""What stays and what changes in stored tables: generations, dimensions, edits, segments, kept answers, stream state."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from foliomill.operators import records as rec
from foliomill.plans import edits, pipeline
from foliomill.sources import files as fs
from foliomill.sources import opener
from foliomill.sources import registry as reg
from foliomill.sources.opener import filesystem_of, open_file
from foliomill.sources.tables import AUTHOR, JOURNAL, LINK, RAW, Lake
from foliomill.streaming import scan


def reader(content: bytes):
    yield {"page_number": 1, "native_text": content.decode(), "meta": {"Author": "Ada Lovelace; Grace Hopper"}}


def answers(label, authors=None, journal="Letters on Tests"):
    def model(system, prompt):
        bib = {"journal": journal, "volume": label} | ({"authors": authors} if authors else {})
        return json.dumps({"summary": f"by {label}", "bibliographic_info": bib, "materials": [{"name": label, "evidence": {"source_text": label}}]})

    return model


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / f"{name}.pdf").write_text(f"Paper {name} has words enough. " * 30)
    return folder


def papers_of(lake):
    return {p.original_filename[0]: p for p in pipeline.current_papers(lake).collect()}


def summaries(lake):
    return {(r.paper_id, r.summary_text): r.is_canonical for r in pipeline.current_records(lake).collect()}


def test_a_second_model_run_is_a_new_version(spark, lake, inbox):
    pipeline.run_all(lake, str(inbox), "r1", reader, answers("one"), "first model")
    ids = {name: p.paper_id for name, p in papers_of(lake).items()}
    some = spark.createDataFrame([(ids["a"],), (ids["b"],)], "paper_id string")
    pipeline.reprocess(lake, "again", "extract", reader, answers("two"), "second model", some)
    want = {(ids["a"], "by one"): False, (ids["a"], "by two"): True, (ids["b"], "by one"): False, (ids["b"], "by two"): True, (ids["c"], "by one"): True}
    assert summaries(lake) == want
    found = papers_of(lake)
    assert {n: p.volume for n, p in found.items()} == {"a": "two", "b": "two", "c": "one"}
    assert found["a"].summary_path.endswith("reports/run=again") and found["c"].extraction_json_path.endswith("record_json/run=r1")
    # An ordinary run has nothing to ask; a third generation is asked for all, from the parse on.
    asked = spark.sparkContext.accumulator(0)

    def counted(system, prompt):
        asked.add(1)
        return answers("three")(system, prompt)

    pipeline.run_all(lake, str(inbox), "r2", reader, counted, "third model")
    assert asked.value == 0
    pipeline.reprocess(lake, "third", "full", reader, counted, "third model")
    assert asked.value == 3
    assert {k[1] for k, newest in summaries(lake).items() if newest} == {"by three"}
    # The log counts up, and a repeated request asks for the same generation.
    edits.request_again(lake, "third", "full")
    log = lake.read("generations", "paper_id string, generation int").groupBy("paper_id").agg(F.max("generation").alias("g"))
    assert {r.paper_id: r.g for r in log.collect()} == {ids["a"]: 2, ids["b"]: 2, ids["c"]: 1}


def test_journals_authors_and_links(spark, lake, inbox):
    pipeline.run_all(lake, str(inbox), "r1", reader, answers("one"), "m")
    journals = lake.read_keyed("journals", JOURNAL).collect()
    assert [j.name for j in journals] == ["Letters on Tests"]
    assert {p.journal_id for p in papers_of(lake).values()} == {journals[0].journal_id}
    names = {r.author_id: r.full_name for r in lake.read_keyed("authors", AUTHOR).collect()}
    assert sorted(names.values()) == ["Ada Lovelace", "Grace Hopper"]
    links = edits.current_links(lake).collect()
    assert len(links) == 6 and {(names[r.author_id], r.position) for r in links} == {("Ada Lovelace", 0), ("Grace Hopper", 1)}
    # An extraction that names authors replaces the links of its papers, and adds to the authors.
    a = papers_of(lake)["a"].paper_id
    one = spark.createDataFrame([(a,)], "paper_id string")
    pipeline.reprocess(lake, "again", "extract", reader, answers("two", ["Mary Somerville", "Ada Lovelace"], "Acta"), "m", one)
    names = {r.author_id: r.full_name for r in lake.read_keyed("authors", AUTHOR).collect()}
    assert sorted(names.values()) == ["Ada Lovelace", "Grace Hopper", "Mary Somerville"]
    mine = lake.read_keyed("paper_authors", LINK, one, "paper_id")
    assert sorted((r.position, names[r.author_id]) for r in mine.collect()) == [(0, "Mary Somerville"), (1, "Ada Lovelace")]
    assert edits.current_links(lake).count() == 6
    assert sorted(r.name for r in lake.read_keyed("journals", JOURNAL).collect()) == ["Acta", "Letters on Tests"]


def stamps(folder):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs_ in os.walk(folder) for f in fs_ if f.endswith(".parquet")}


def test_an_upsert_rewrites_its_buckets_only(spark, lake):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    assert len(lake.upsert("t", rows, "k", "k string, v bigint", buckets=16)) == 16
    before = stamps(lake.path("t"))
    new = spark.createDataFrame([("k7", 70), ("k7", 71), ("fresh", 1)], "k string, v bigint")
    touched = lake.upsert("t", new, "k", "k string, v bigint", buckets=16)
    after = stamps(lake.path("t"))
    same = [f for f in before if after.get(f) == before[f]]
    assert len(touched) <= 2 and len(same) == 16 - len(touched)
    kept = lake.upsert("t", spark.createDataFrame([("k8", 0), ("other", 2)], "k string, v bigint"), "k", "k string, v bigint", keep_old=True, buckets=16)
    assert len(kept) <= 2
    want = sorted([(f"k{i}", i) for i in range(500) if i != 7] + [("k7", 70), ("k7", 71), ("fresh", 1), ("other", 2)])
    assert sorted(map(tuple, lake.read_keyed("t", "k string, v bigint").collect())) == want
    assert lake.upsert("t", new.limit(0), "k", "k string, v bigint", buckets=16) == []


def test_patches_deletions_and_compaction(spark, lake, inbox):
    pipeline.run_all(lake, str(inbox), "r1", reader, answers("one"), "m")
    ids = {name: p.paper_id for name, p in papers_of(lake).items()}
    patches = [(ids["a"], "p1", "Better title", None), (ids["b"], "p2", "Refused", 1066), (ids["c"], "p3", None, 1999)]
    edits.patch_papers(lake, spark.createDataFrame(patches, "paper_id string, patch_id string, title string, publication_year int"), "e1")
    record = pipeline.current_records(lake).where(F.col("paper_id") == ids["a"]).first().record_id
    edits.patch_records(lake, spark.createDataFrame([(record, "q1", "seen", "me")], "record_id string, patch_id string, review_notes string, reviewed_by string"), "e1")
    edits.delete_papers(lake, spark.createDataFrame([(ids["b"],)], "paper_id string"), "e2")

    def state():
        papers = {n: (p.title, p.publication_year, p.status) for n, p in papers_of(lake).items()}
        records = sorted((r.paper_id, r.summary_text, r.review_notes, r.human_edited, r.status) for r in pipeline.current_records(lake).collect())
        return papers, records

    before = state()
    assert before[0] == {"a": ("Better title", None, "extracted"), "c": (before[0]["c"][0], 1999, "extracted")}
    assert [r[0] for r in before[1]] == sorted([ids["a"], ids["c"]])
    assert {r[0]: r[2:] for r in before[1]}[ids["a"]] == ("seen", True, "complete")
    edits.patch_papers(lake, spark.createDataFrame([(ids["a"], "p9", "Best title")], "paper_id string, patch_id string, title string"), "e3")
    before = state()

    edits.compact(lake, "packed")
    assert state() == before
    for table in ("registry", "parsed", "merged", "prompts", "raw_responses", "records", "materials", "evidence", "paper_patches"):
        rows = lake.stored(table)
        assert rows.select("run").distinct().count() == 1, table
        assert "paper_id" not in rows.columns or not rows.where(F.col("paper_id") == ids["b"]).count(), table
    assert lake.stored("materials").count() == 2 and lake.read("tombstones", "paper_id string").count() == 0
    assert edits.current_links(lake).count() == 4 and lake.stored("paper_patches").count() == 2
    edits.compact(lake, "packed")
    assert state() == before

    # The file of a deleted paper makes a paper again; one that is deleted twice stays away.
    counts = pipeline.ingest(lake, str(inbox), "r2").first()
    assert (counts.ingested, counts.skipped_duplicates) == (1, 2)
    assert sorted(papers_of(lake)) == ["a", "b", "c"]
    edits.delete_papers(lake, spark.createDataFrame([(ids["b"],), (ids["b"],)], "paper_id string"), "e4")
    assert sorted(papers_of(lake)) == ["a", "c"]
    assert pipeline.ingest(lake, str(inbox), "r3").first().ingested == 1


@pytest.mark.parametrize("table", ["materials"])
def test_a_compaction_that_broke_off_is_taken_up(spark, lake, inbox, monkeypatch, table):
    pipeline.run_all(lake, str(inbox), "r1", reader, answers("one"), "m")
    gone = papers_of(lake)["b"].paper_id
    edits.delete_papers(lake, spark.createDataFrame([(gone,)], "paper_id string"), "e1")
    before = {n: p.title for n, p in papers_of(lake).items()}, summaries(lake)
    clear = Lake.clear

    def breaking(self, name, runs, layout, by=None):
        if name == table:
            raise OSError("the driver is gone")
        clear(self, name, runs, layout, by)

    monkeypatch.setattr(Lake, "clear", breaking)
    with pytest.raises(OSError):
        edits.compact(lake, "packed")
    monkeypatch.setattr(Lake, "clear", clear)
    edits.compact(lake, "packed")
    assert ({n: p.title for n, p in papers_of(lake).items()}, summaries(lake)) == before
    assert lake.stored("materials").count() == 2 and lake.stored("registry").count() == 2


def test_deletion_cascades_before_compaction(spark, lake, inbox):
    pipeline.run_all(lake, str(inbox), "r1", reader, answers("one"), "m")
    ids = spark.createDataFrame([(p.paper_id,) for p in papers_of(lake).values()], "paper_id string")
    edits.delete_papers(lake, ids, "gone")
    assert papers_of(lake) == {} and summaries(lake) == {}
    asked = spark.sparkContext.accumulator(0)
    pipeline.call_model(lake, "r2", lambda s, p: asked.add(1), 2)
    assert asked.value == 0 and pipeline.settle(lake, "r2", "m").count() == 0


def hashes_of(spark, names):
    return spark.createDataFrame([(hashlib.sha256(n.encode()).hexdigest(), n) for n in names], "file_hash string, path string").withColumn("file_size", F.lit(1))


def test_a_lookup_opens_few_segments(spark, lake):
    for run in range(3):
        new = hashes_of(spark, [f"{run}-{i}" for i in range(400)])
        reg.append_registry(lake, reg.register_papers(new, lake.read("registry", reg.REGISTERED)).drop("status", "is_new"), f"r{run}")
    stored = lake.read("registry", reg.SEGMENTED)
    segments = stored.select("run", "bucket").distinct().count()
    assert segments > 600
    wanted = hashes_of(spark, ["1-5", "2-77", *(f"new {i}" for i in range(40))])
    hit = reg.hit_segments(lake, wanted)
    assert len(hit) < 6 and {r for r, _ in hit} >= {"r1", "r2"}
    found = reg.known_papers(lake, wanted)
    assert sorted(r.original_filename for r in found.collect()) == ["1-5", "2-77"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan or "PartitionFilters: [(" in plan
    # No hash is ever missed, with its own run left out if asked.
    every = hashes_of(spark, [f"{r}-{i}" for r in range(3) for i in range(400)])
    assert reg.known_papers(lake, every).count() == 1200
    assert reg.known_papers(lake, every, "r1").count() == 800
    reg.compact_registry(lake, ["r0", "r1", "r2"], "all")
    assert {r for r, _ in reg.hit_segments(lake, every)} == {"all"} and reg.known_papers(lake, every).count() == 1200
    assert reg.known_papers(lake, hashes_of(spark, ["x"]).where("false")).count() == 0


def test_files_of_any_size_are_hashed_in_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    contents = {"a.pdf": b"0123456789" * 1000, "bad.pdf": b"x", "b.PDF": os.urandom(50_001)}
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    opened, largest = spark.sparkContext.accumulator(0), 4096

    class Guarded:
        """A stream that refuses to give more than a block at a time."""

        def __init__(self, path):
            self.stream = open_file(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, size):
            assert 0 < size <= largest
            return self.stream.read(size)

    def counting(path):
        opened.add(1)
        if path.endswith("bad.pdf"):
            raise OSError("cannot be read")
        return Guarded(path)

    listed = fs.scan_files(spark, str(tmp_path / "in"))
    rows = {r.path.rsplit("/", 1)[-1]: r for r in fs.with_fingerprint(listed, counting, block=largest).collect()}
    assert opened.value == 3
    assert rows.pop("bad.pdf").error == "bad.pdf: cannot be read"
    assert {n: (r.file_hash, r.file_size, r.error) for n, r in rows.items()} == {
        n: (hashlib.sha256(d).hexdigest(), len(d), None) for n, d in contents.items() if n != "bad.pdf"
    }
    plan = fs.with_fingerprint(listed, counting)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_paths_and_their_filesystems(tmp_path, monkeypatch):
    (tmp_path / "a b").write_text("x")
    for path in (str(tmp_path / "a b"), (tmp_path / "a b").as_uri(), f"file:{tmp_path}/a%20b"):
        with open_file(path) as stream:
            assert stream.read() == b"x"
    assert filesystem_of("dbfs:/x/y")[1] == "/dbfs/x/y"
    asked = []
    monkeypatch.setattr(opener, "FileSystem", type("Stub", (), {"from_uri": staticmethod(asked.append)}))
    for path in ("s3a://bucket/key", "gs://bucket/key", "abfss://box@account/key"):
        filesystem_of(path)
    assert asked == ["s3://bucket/key", "gs://bucket/key", "abfs://box@account/key"]


def test_answers_outlive_their_job(spark, lake, inbox):
    for i in range(6):
        (inbox / f"more{i}.pdf").write_text(f"Another text {i}. " * 20)
    pipeline.ingest(lake, str(inbox), "r1")
    pipeline.parse(lake, "r1", reader)
    pipeline.prepare(lake, "r1")
    asked = spark.sparkContext.accumulator(0)

    def breaks(system, prompt):
        if "Paper a" in prompt:
            raise SystemExit("the executor is gone")
        asked.add(1)
        return answers("one")(system, prompt)

    with pytest.raises(Exception):
        pipeline.call_model(lake, "r1", breaks, 3)
    kept = lake.read("raw_responses", RAW).count()
    assert 0 < kept <= 8
    counted = spark.sparkContext.accumulator(0)

    def whole(system, prompt):
        counted.add(1)
        return answers("one")(system, prompt)

    pipeline.call_model(lake, "r1", whole, 3)
    assert counted.value == 9 - kept
    assert pipeline.settle(lake, "r1", "m").count() == 9


def test_stream_over_three_triggers(spark, lake, inbox, tmp_path):
    def faulty(path):
        if "broken" in path:
            raise OSError("no such block")
        return open_file(path)

    def trigger():
        scan.scan_stream(lake, str(inbox), str(tmp_path / "ck"), opener=faulty).awaitTermination()
        rows = spark.read.parquet(lake.path("scan_counts")).agg(F.sum("found"), F.sum("ingested"), F.sum("skipped_duplicates"), F.sum("failed"))
        return tuple(rows.first())

    assert trigger() == (3, 3, 0, 0)
    (inbox / "broken one.pdf").write_text("1")
    (inbox / "broken two.pdf").write_text("2")
    (inbox / "d.pdf").write_text("new")
    (inbox / "a again.pdf").write_text((inbox / "a.pdf").read_text())
    assert trigger() == (7, 4, 1, 2)
    # Known by another job: registered meanwhile, not by the stream.
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "e.pdf").write_text("elsewhere")
    pipeline.ingest(lake, str(tmp_path / "other"), "batch")
    (inbox / "e.pdf").write_text("elsewhere")
    (inbox / "d again.pdf").write_text("new")
    found, ingested, skipped, failed = trigger()
    assert (found, ingested, skipped, failed) == (10, 5, 3, 2)  # with the batch's own count of 1, 1
    hashes = [r.file_hash for r in lake.read("registry", reg.REGISTERED).collect()]
    assert len(hashes) == len(set(hashes)) == 5
    errors = {r.error for r in spark.read.parquet(lake.path("scan_outcomes")).where("outcome = 'failed'").collect()}
    assert errors == {"broken one.pdf: no such block", "broken two.pdf: no such block"}


def test_one_hot_content_in_one_trigger(spark, tmp_path):
    rows = [(f"/x/{i:04d}.pdf", "h", 1, None) for i in range(3000)] + [(f"/y/{i}.pdf", None, 1, "bad") for i in range(50)]
    layout = "path string, file_hash string, file_size bigint, error string"
    spark.createDataFrame(rows, layout).repartition(7).write.parquet(str(tmp_path / "in"))
    scan.use_rocksdb(spark)
    query = scan.outcomes_of(spark.readStream.schema(layout).parquet(str(tmp_path / "in"))).writeStream.format("parquet")
    query = query.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    query.start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()} == {"ingested": 1, "skipped": 2999, "failed": 50}
    assert out.where("outcome = 'ingested'").first().path == "/x/0000.pdf"


def test_canonical_is_the_newest(spark):
    rows = spark.createDataFrame([("p", "r1", 1), ("p", "r2", 2), ("q", "r3", 1)], "paper_id string, record_id string, created_at int")
    assert sorted(r.record_id for r in rec.canonical(rows).collect()) == ["r2", "r3"]
