"""Ingestion, biblio, versions, corrections, catalogue, features, sinks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from foliomill.operators import biblio, catalog, corrections, dedup, features, inference, ranks, records
from foliomill.sources import files as fs
from foliomill.sources import sinks
from foliomill.sources.registry import paper_id, register_papers


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    for name, text in {"a/deep/one.pdf": "x", "a/two.PDF": "x", "z.Pdf": "yy", "n.txt": "t", ".gitkeep": ""}.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_scan_and_inventory(spark, folder, tmp_path):
    found = fs.with_fingerprint(fs.scan_files(spark, folder))
    names = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert set(names) == {"one.pdf", "two.PDF", "z.Pdf"} and names["one.pdf"].file_hash == names["two.PDF"].file_hash
    assert names["one.pdf"].file_hash == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    inventory = fs.folder_inventory(fs.scan_files(spark, folder, glob=None))
    assert tuple(inventory.first())[:2] == (4, 3) and not inventory.first().is_empty_fallback
    assert "content" not in plan(inventory)
    (tmp_path / "void").mkdir()
    assert fs.folder_inventory(fs.scan_files(spark, str(tmp_path / "void"), glob=None)).first().is_empty_fallback


def test_scan_outcomes_with_one_hot_hash(spark):
    """A third of all files are copies of one; first means first in folder order."""
    paths = [(f"d{n % 7}/f{n:04d}.pdf", "hot" if n % 3 == 0 else f"h{n // 2}", None if n % 50 else "unreadable") for n in range(900)]
    paths += [("a/b.pdf", "ab", None), ("a.b/c.pdf", "ab", None)]
    files = spark.createDataFrame(paths, "path string, file_hash string, error string").repartition(5)
    registry = spark.createDataFrame([("h10", "p10", "parsed"), ("h11", "p11", "failed")], "file_hash string, paper_id string, status string")
    known, seen, want = {"h10", "h11"}, set(), {}
    for path, digest, error in sorted(paths, key=lambda x: x[0].split("/")):
        if error:
            want[path] = "failed"
        elif digest in known or digest in seen:
            want[path] = "skipped"
        else:
            want[path] = "ingested"
            seen.add(digest)
    outcomes = dedup.scan_outcomes(files, registry)
    assert {r.path: r.outcome for r in outcomes.collect()} == want
    assert want["a/b.pdf"] == "ingested" and want["a.b/c.pdf"] == "skipped"
    counts = dedup.scan_counts(outcomes).first()
    assert counts.found == 902 and counts.failed == 18 and counts.ingested == len(seen)
    details = dedup.scan_details(outcomes, paper_id(F.col("file_hash")))
    assert details.where("kind = 'error'").count() == 18 and details.where("kind = 'paper_id'").count() == len(seen)
    twins = dedup.duplicates_of(files, registry)
    assert rows(twins, "existing_id", "status") == rows(files.join(registry, "file_hash"), "paper_id", "status")
    firsts = dedup.dedup_batch(files)
    assert firsts.count() == files.select("file_hash").distinct().count()
    new = register_papers(firsts.withColumn("file_size", F.lit(1)), registry)
    assert rows(new.where("NOT is_new"), "paper_id") == [("p10",), ("p11",)]
    for step in (plan(dedup.first_paths(files)), plan(firsts)):
        assert step.index("partial_min_by") > step.index("Exchange")


def test_joins_with_a_hot_key(spark):
    """A third of all rows share one hash that is known; null hashes are never known, and stay."""
    files = spark.range(9000).selectExpr("concat('f', id) AS path", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 97 = 0 THEN NULL ELSE concat('h', id) END AS file_hash")
    registry = spark.range(1000).selectExpr("IF(id = 0, 'hot', concat('h', id)) AS file_hash", "id AS paper_id", "'parsed' AS status")
    known = {r.file_hash: r.paper_id for r in registry.collect()}
    listed = [(r.path, r.file_hash) for r in files.collect()]
    assert rows(dedup.drop_known(files, registry), "path") == sorted((p,) for p, h in listed if h not in known)
    found = dedup.duplicates_of(files, registry.union(registry))
    assert rows(found, "path", "existing_id") == sorted((p, known[h]) for p, h in listed if h in known)
    kept = corrections.delete_papers({"files": files.withColumnRenamed("file_hash", "paper_id")}, files.where("file_hash = 'hot'").select(F.col("file_hash").alias("paper_id")))
    assert kept["files"].count() == sum(h != "hot" for _, h in listed)


def test_a_hot_key_is_split_by_adaptive_execution(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        files = spark.range(60000).repartition(8).selectExpr("concat('f', id) AS path", "IF(id % 3 < 2, 'hot', concat('h', id)) AS file_hash")
        registry = spark.range(1000).selectExpr("IF(id = 0, 'hot', concat('h', id)) AS file_hash", "id AS paper_id", "'parsed' AS status")
        for found, n in ((dedup.duplicates_of(files, registry), 40000), (dedup.drop_known(files, registry), 20000)):
            assert found.count() in range(n - 1000, n + 1001)
            found.collect()
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_authors_of_a_huge_paper_have_one_shape(spark):
    links = spark.range(3000).selectExpr("IF(id < 1000, 0, id) AS paper_id", "id AS author_id", "CAST(IF(id < 1000, id, 0) AS INT) AS position")
    authors = spark.range(3000).selectExpr("id AS author_id", "concat('a', id) AS full_name")
    got = catalog.author_rows(links, authors)
    assert got.count() == 3000 and rows(got.where("paper_id = 0"), "position", "author_name") == sorted(((i, f"a{i}") for i in range(1000)), key=repr)
    papers = spark.range(2).selectExpr("id AS paper_id", "'j' AS journal_id", "'' AS summary_path", "'p' AS extraction_json_path", "'t' AS raw_text")
    journals = spark.createDataFrame([("j", "J")], "journal_id string, name string")
    page = catalog.paper_page(papers, journals, links, authors, [0, 1])
    assert {r.paper_id: (len(r.authors), r.journal.name, r.summary_available, r.extraction_available) for r in page.collect()} == {0: (1000, "J", False, True), 1: (0, "J", False, True)}
    assert [p.name for p in page.where("paper_id = 0").first().authors] == [f"a{i}" for i in range(1000)]
    assert catalog.paper_detail(papers, journals, links, authors).count() == 1001
    with pytest.raises(ValueError):
        catalog.paper_page(papers, journals, links, authors, list(range(201)))


def test_author_names_has_a_list_per_paper(spark):
    from conftest import SMALL

    from workload import QUERIES

    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    found = QUERIES["author_names"](spark, SMALL)
    assert found.columns == ["paper_id", "author_names"] and found.count() == lines.select("l_orderkey").distinct().count()
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None), (2, 3, 1)], "paper_id int, author_id int, position int")
    authors = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "author_id int, full_name string")
    assert rows(catalog.author_names(links, authors), "paper_id", "author_names") == [(1, ["b", "a", None]), (2, [None])]


def test_paper_detail_has_the_authors_of_each_paper(spark):
    from conftest import SMALL

    from workload import QUERIES

    found = QUERIES["paper_detail"](spark, SMALL)
    assert "authors" in found.columns and found.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    papers = spark.range(2).selectExpr("id AS paper_id", "'j' AS journal_id", "'' AS summary_path", "'p' AS extraction_json_path", "'t' AS raw_text")
    journals = spark.createDataFrame([("j", "J")], "journal_id string, name string")
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 3, None), (5, 3, 1)], "paper_id int, author_id int, position int")
    authors = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "author_id int, full_name string")
    got = {r.paper_id: r for r in catalog.paper_lists(papers, journals, links, authors).collect()}
    assert [tuple(p) for p in got[0].authors] == [(1, "b", 2), (2, "a", 1), (None, "c", 3)] and got[1].authors == [] and len(got) == 2


def test_biblio_updates(spark):
    layout = "paper_id string, title string, doi string, abstract string, publication_year int, volume string, issue string, pages string, keywords array<string>, journal_id string"
    base = spark.createDataFrame(
        [("a", "", None, "abs", 0, "1", None, "p", ["k"], None), ("b", "T", "d", None, 1999, None, None, None, None, "j"), ("c",) + (None,) * 9], layout
    )
    info = spark.createDataFrame(
        [("a", "new", "", None, 2001, "2", "", None, [], "J. One"), ("b", "new", "x", "y", 2002, None, "3", None, ["q"], "")],
        "paper_id string, title string, doi string, abstract string, year int, volume string, issue string, pages string, keywords array<string>, journal string",
    )
    got = {r.paper_id: r for r in biblio.merge_biblio(base, info).collect()}
    a, b = got["a"], got["b"]
    assert (a.title, a.doi, a.abstract, a.publication_year, a.volume, a.issue, a.pages, a.keywords) == ("new", None, "abs", 2001, "2", None, "p", ["k"])
    assert a.journal_id is not None and b.journal_id == "j" and (b.title, b.doi, b.abstract, b.publication_year, b.issue, b.keywords) == ("T", "d", "y", 1999, "3", ["q"])
    assert got["c"].title is None
    always = biblio.overwrite(base, info, ["volume"])
    assert dict(rows(always, "paper_id", "volume")) == {"a": "2", "b": None, "c": None}
    present = biblio.overwrite_present(base, info, ["volume", "keywords"])
    assert dict((r[0], r[1]) for r in rows(present, "paper_id", "volume")) == {"a": "2", "b": None, "c": None}


def test_dimensions_and_links(spark):
    journals = biblio.upsert_journals(
        spark.createDataFrame([("old", "Known")], "journal_id string, name string"),
        spark.createDataFrame([("Known",), ("New",), ("New",), ("known",), (None,), ("",)], "name string"),
    )
    assert rows(journals, "name") == [("Known",), ("New",), ("known",)]
    papers = spark.createDataFrame([("p", ["A B", "C", "A B", "D"]), ("q", [])], "paper_id string, authors array<string>")
    links = biblio.author_links(papers)
    assert rows(links, "paper_id", "position", "full_name") == [("p", 0, "A B"), ("p", 1, "C"), ("p", 3, "D")]
    authors = biblio.upsert_authors(spark.createDataFrame([], "author_id string, full_name string, first_name string, last_name string"), links)
    assert rows(authors, "full_name", "first_name", "last_name") == [("A B", "A", "B"), ("C", None, "C"), ("D", None, "D")]
    old = spark.createDataFrame([("p", "x", "X", 0), ("r", "x", "X", 0)], links.schema.simpleString()[7:-1].replace(":", " "))
    assert rows(biblio.replace_links(old, links), "paper_id", "full_name") == [("p", "A B"), ("p", "C"), ("p", "D"), ("r", "X")]


def test_canonical_with_one_hot_paper(spark):
    versions = spark.range(3000).selectExpr("id AS record_id", "IF(id % 3 = 0, 0, id % 100) AS paper_id", "(id * 7919) % 1000 AS created_at")
    best = {}
    for r in versions.collect():
        best[r.paper_id] = max(best.get(r.paper_id, (-1, -1)), (r.created_at, r.record_id))
    chosen = records.canonical(versions)
    assert plan(chosen).count("WindowGroupLimit") == 2
    assert {r.paper_id: (r.created_at, r.record_id) for r in chosen.collect()} == best


def test_record_detail_has_all_lists_in_one_shape(spark):
    head = spark.createDataFrame([("r1", "p1", 1), ("r0", "p1", 0), ("r2", "p2", 1)], "record_id string, paper_id string, created_at int")
    items = spark.range(25).selectExpr("'r1' AS record_id", "CAST(id AS INT) AS ordinal", "concat('n', id) AS name")
    other = spark.createDataFrame([("r1", 0, None), ("r0", 0, "old")], "record_id string, ordinal int, technique string")
    found = records.record_detail(head, {"items": items, "methods": other})
    got = rows(found, "record_id", "kind", "ordinal", "item")
    assert sorted(got, key=repr) == sorted(
        [("r1", "items", i, f'{{"name":"n{i}"}}') for i in range(25)] + [("r1", "methods", 0, '{"technique":null}'), ("r2", None, None, None)], key=repr
    )
    lists = {r.record_id: r for r in records.record_lists(head, {"items": items, "methods": other}, ["r1", "r2", "r0"]).collect()}
    assert set(lists) == {"r1", "r2"} and [i.name for i in lists["r1"]["items"]] == [f"n{i}" for i in range(25)]
    assert len(lists["r1"].methods) == 1 and lists["r2"]["items"] == [] and lists["r2"].methods == []


def test_record_detail_sends_no_children_to_the_driver(spark):
    head = spark.range(50).selectExpr("id AS record_id", "id AS paper_id", "0 AS created_at")
    items = spark.range(200).selectExpr("id % 40 AS record_id", "CAST(id AS INT) AS ordinal", "concat('n', id) AS name")
    found = records.record_detail(head, {"items": items})
    assert found.count() == 210 and "Broadcast" not in plan(found)


def test_names_that_clash_get_columns_of_their_own(spark, tmp_path):
    names = ["pressure", "Pressure", "pressure_unit", "PRESSURE", "paper_id", "a b", "a b_confidence"]
    rows_ = [(p, "in", n, None, float(i + p), "u%d" % i, 0.5, i) for i, n in enumerate(names) for p in (1, 2)]
    layout = "paper_id int, variable_role string, parameter_name string, value_text string, value_numeric double, unit string, confidence double, ordinal int"
    long = spark.createDataFrame(rows_, layout).withColumnRenamed("parameter_name", "name").withColumns(
        {"value": F.col("value_numeric").cast("string"), "needs_review": F.lit(None).cast("boolean")}
    )
    wide = features.pivot_inputs(long)
    assert len({c.lower() for c in wide.columns}) == len(wide.columns) == 1 + 3 * len(names) + 1
    chosen = features.column_names(names, features.INPUT_EXTRAS)
    assert set(chosen.values()) == set(wide.columns) - {"paper_id", "other_variables"}
    wide.drop("other_variables").write.parquet(str(tmp_path / "wide"))
    wide.drop("other_variables").coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    for back in (spark.read.parquet(str(tmp_path / "wide")), spark.read.option("header", True).csv(str(tmp_path / "csv"))):
        for row in back.collect():
            p = int(row["paper_id"])
            assert {n: (row[chosen[n, "value"]], row[chosen[n, "unit"]]) for n in names} == {n: (str(float(i + p)), f"u{i}") for i, n in enumerate(names)}
    held = {(r["name"], r["field"]): r["column"] for r in features.column_dictionary(spark, chosen).collect()}
    assert held == chosen


def test_more_variables_than_columns(spark, tmp_path):
    long = spark.range(3000).selectExpr("id % 10 AS paper_id", "concat('v', id % 300) AS name", "CAST(id AS DOUBLE) AS value")
    last = long.groupBy("paper_id", "name").agg(F.max("value").alias("value"))
    cells, ids, columns = features.sparse_matrix(spark.range(12).withColumnRenamed("id", "paper_id"), last, str(tmp_path / "m"), block_rows=4)
    names = {r["column"]: r["name"] for r in columns.collect()}
    assert [names[i] for i in range(300)] == sorted(f"v{i}" for i in range(300)) and ids.count() == 12
    got = {(r["row"], names[r["column"]]): (r["value"], r["block"]) for r in cells.collect()}
    assert got == {(r.paper_id, r.name): (r.value, r.paper_id // 4) for r in last.collect()}
    texts = long.withColumns({"unit": F.lit("u"), "confidence": F.lit(1.0), "needs_review": F.lit(False), "value": F.col("value").cast("string"), "ordinal": F.col("value")})
    few = features.variable_names(texts, most=7)
    assert len(few) == 7
    pivoted = features.pivot_inputs(texts, few, rest=True)
    assert all(len(r.other_variables) == 30 - sum(n in few for n in {f"v{i}" for i in range(300) if i % 10 == r.paper_id}) for r in pivoted.collect())


def test_ranked_rows(spark, tmp_path):
    data = [(i, None if i % 50 == 0 else i * 7919 % 1000, f"t{i}") for i in range(5000)]
    df = spark.createDataFrame(data, "paper_id int, size int, title string").repartition(7)
    order = [F.col("size").desc_nulls_last(), F.col("paper_id").asc()]
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    stored = ranks.write_ranked(df, order, str(tmp_path / "ranked"), ranges=16)
    assert stored.total() == 5000 and stored.fences().count() > 8
    assert [r.paper_id for r in stored.rows().orderBy("place").collect()] == [r[0] for r in want]
    assert sorted(r.place for r in stored.rows().collect()) == list(range(1, 5001))
    for skip, limit in ((0, 10), (3333, 50), (4990, 50), (5000, 5), (9999, 5)):
        page = stored.page(skip, limit).collect()
        assert [(r.paper_id, r.place) for r in page] == [(r[0], skip + n + 1) for n, r in enumerate(want[skip : skip + limit])]
    read = stored.page(3333, 50)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*range_no", read)
    assert ranks.write_ranked(df.limit(0), order, str(tmp_path / "none")).page(0, 5).count() == 0


def test_patches_failures_deletion(spark):
    papers = spark.createDataFrame([("a", "t", "d", 2000, "uploaded", None, None, "text"), ("b", "t", "d", 2000, "parsed", None, None, "")],
        "paper_id string, title string, doi string, publication_year int, status string, parse_error string, extraction_error string, raw_text string")
    patches = spark.createDataFrame(
        [("a", 1, 1, "one", None, None), ("a", 2, 2, None, "10.1/x", None), ("a", 3, 3, "three", None, 1800), ("a", 0, 4, "zero", None, 1900), ("b", 1, 5, None, "d" * 257, None)],
        "paper_id string, patched_at int, patch_id int, title string, doi string, publication_year int",
    )
    got = rows(corrections.apply_patches(papers, patches), "paper_id", "title", "doi", "publication_year")
    assert got == [("a", "one", "10.1/x", 1900), ("b", "t", "d", 2000)]
    recs = spark.createDataFrame([("r", "s", "failed", False), ("q", "s", "needs_review", False), ("o", "s", "failed", False)],
        "record_id string, summary_text string, status string, human_edited boolean")
    edits = spark.createDataFrame([("r", 1, 1, None), ("q", 1, 2, "new")], "record_id string, patched_at int, patch_id int, summary_text string")
    assert rows(corrections.apply_record_patches(recs, edits), "record_id", "summary_text", "status", "human_edited") == [
        ("o", "s", "failed", False), ("q", "new", "needs_review", True), ("r", "s", "complete", True)
    ]
    errors = spark.createDataFrame([("a", "parse", "late", 2), ("a", "parse", "early", 1)], "paper_id string, stage string, error string, failed_at int")
    assert rows(corrections.apply_failures(papers, errors), "paper_id", "status", "parse_error") == [("a", "failed", "late"), ("b", "parsed", None)]
    gone = corrections.delete_papers({"papers": papers}, papers.where("paper_id = 'a'"))
    assert rows(gone["papers"], "paper_id") == [("b",)]
    assert rows(corrections.select_for_reprocess(papers, "extract"), "paper_id") == [("a",)]
    assert corrections.select_for_reprocess(papers, "parse", papers.where("paper_id = 'b'")).count() == 1
    with pytest.raises(ValueError):
        corrections.select_for_reprocess(papers, "other")


def test_listing_plans(spark, tmp_path):
    path = str(tmp_path / "papers")
    spark.range(2000).selectExpr(
        "concat('p', id) AS paper_id", "concat('file ', id, '.pdf') AS original_filename", "IF(id % 5 = 0, NULL, concat('Title ', id % 50)) AS title",
        "CAST(NULL AS STRING) AS doi", "IF(id % 2 = 0, 'parsed', 'uploaded') AS status", "id AS created_at", "repeat('x', 1000) AS raw_text",
    ).write.parquet(path)
    papers = spark.read.parquet(path)
    page = catalog.page_of_papers(papers, skip=5, limit=3, status="parsed", sort_by="title", direction="asc")
    steps = plan(page)
    assert "TakeOrderedAndProject" in steps and "raw_text" not in steps and "EqualTo(status,parsed)" in steps
    key = lambda r: (r.title is None, r.title or "", r.paper_id)
    want = sorted((r for r in papers.collect() if r.status == "parsed"), key=key)[5:8]
    assert [r.paper_id for r in page.collect()] == [r.paper_id for r in want]
    assert catalog.page_of_papers(papers, sort_by="title").first().title is None
    assert catalog.count_papers(papers, search="TITLE 4_").first().total == papers.where("title LIKE 'Title 4_'").count()
    deep = catalog.page_of_papers(papers, skip=1990, limit=50, sort_by="nonsense", direction="asc")
    assert [r.created_at for r in deep.collect()] == list(range(1990, 2000))
    for bad in ({"limit": 201}, {"limit": 0}, {"skip": -1}):
        with pytest.raises(ValueError):
            catalog.page_of_papers(papers, **bad)
    evidence = spark.createDataFrame([("r", "result.100%_x"), ("r", "material.a")], "record_id string, field_name string")
    assert catalog.evidence_for(evidence, field="100%_X").count() == 1 and catalog.evidence_for(evidence, field="100__").count() == 0


CONDITIONS = [
    ("r1", "p1", 0, "Film Thickness", 10.0, None, "nm", "input", 0.5), ("r1", "p1", 1, "film thickness", None, "thin", "A", "contextual", 0.6),
    ("r1", "p1", 2, "Gas", None, "Ar", None, "input", None), ("r1", "p1", 3, "Hidden", 1.0, None, None, "output", None),
    ("r2", "p2", 0, "Film Thickness", 0.0, None, "nm", "input", 0.1), ("r2", "p2", 1, "Film Thickness", None, None, "nm", "input", 0.2),
    ("old", "p1", 0, "Gone", 5.0, None, None, "input", None),
]
RESULTS = [
    ("r1", "p1", 0, "TMR ratio", 600.0, None, None, None, "%", None, "output", 0.9, False),
    ("r1", "p1", 1, "phase", None, None, None, "bcc", None, None, "contextual", None, True),
]


@pytest.fixture
def export_tables(spark):
    conditions = spark.createDataFrame(CONDITIONS, "record_id string, paper_id string, ordinal int, parameter_name string, value_numeric double, value_text string, unit string, variable_role string, confidence double")
    results = spark.createDataFrame(RESULTS, "record_id string, paper_id string, ordinal int, property_name string, value_numeric double, value_min double, value_max double, value_text string, unit string, conditions string, variable_role string, confidence double, needs_review boolean")
    materials = spark.createDataFrame([("p1", 1, "second"), ("p1", 0, "first")], "paper_id string, ordinal int, name string").withColumns({c: F.lit("x") for c in ("composition", "substrate", "crystal_structure")})
    papers = spark.createDataFrame([(p, f"T{p}", None, 2000, "j") for p in ("p1", "p2", "p3")], "paper_id string, title string, doi string, publication_year int, journal_id string")
    versions = spark.createDataFrame([(r, p, at, "complete", "s", None, None, None) for r, p, at in (("old", "p1", 1), ("r1", "p1", 2), ("r2", "p2", 1))],
        "record_id string, paper_id string, created_at int, status string, summary_text string, input_variables string, output_variables string, contextual_notes string")
    journals = spark.createDataFrame([("j", "J. One")], "journal_id string, name string")
    return papers, journals, records.canonical(versions), conditions, results, materials


def test_wide_export(spark, export_tables, tmp_path):
    papers, journals, canon, conditions, results, materials = export_tables
    inputs, outputs = features.long_inputs(features.of_records(conditions, canon)), features.long_outputs(features.of_records(results, canon))
    wide = features.export_wide(papers, journals, canon, inputs, outputs, materials)
    got = {r.paper_id: r.asDict() for r in wide.collect()}
    assert set(got) == {"p1", "p2"} and got["p1"]["journal"] == "J. One" and got["p1"]["material_name"] == "first"
    assert got["p1"]["input_film_thickness"] == "thin" and got["p1"]["input_film_thickness_unit"] == "A"
    assert got["p1"]["output_tmr_ratio"] == "600.0" and got["p1"]["output_phase_needs_review"] is True
    assert got["p2"]["input_film_thickness"] is None and got["p2"]["input_film_thickness_confidence"] == 0.2
    assert got["p2"]["material_name"] is None and "input_hidden" not in got["p1"] and "input_gone" not in got["p1"]
    rest = features.export_wide(papers, journals, canon, inputs, outputs, materials, ["input_gas"], [], rest=True)
    first = {r.paper_id: r for r in rest.collect()}["p1"]
    assert first.input_gas == "Ar" and set(first.other_variables) == {"input_film_thickness", "output_tmr_ratio", "output_phase"}
    assert len(features.variable_names(inputs, most=1)) == 1
    sinks.write_csv(wide, str(tmp_path / "csv"))
    again = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert again.columns == wide.columns and again.count() == 2


def test_maps_matrix_coverage(spark, export_tables, tmp_path):
    papers, journals, canon, conditions, results, _ = export_tables
    mine = features.of_records(conditions, canon)
    maps = {r.paper_id: r for r in features.xy_maps(mine, results).collect()}
    assert set(maps["p1"].X) == {"Film Thickness", "Gas"} and maps["p1"].X["Film Thickness"].value == 10.0
    assert set(maps["p1"].y) == {"TMR ratio"} and maps["p2"].X["Film Thickness"].value is None and maps["p2"].y is None
    x = features.x_long(mine)
    matrix = {r.paper_id: r for r in features.feature_matrix(papers, x).collect()}
    assert set(matrix) == {"p1", "p2", "p3"} and matrix["p1"]["Film Thickness"] == 10.0 and matrix["p3"]["Gas"] is None
    report = {r.name: tuple(r)[1:] for r in features.coverage(x, papers).collect()}
    assert report == {"Film Thickness": (3, 1, 33.3, 10.0, 10.0), "Gas": (3, 0, 0.0, None, None)}
    nested = features.export_nested(papers, journals, canon, conditions, results)
    sinks.write_export_json(nested, features.export_header(papers, canon), str(tmp_path / "out"))
    lines = {j["paper_id"]: j for j in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "out" / "papers")).collect()))}
    assert lines["p3"]["extraction"] is None and lines["p2"]["extraction"]["bo_ready"]["y"] == {}
    assert lines["p1"]["extraction"]["bo_ready"]["X"]["Film Thickness"] == {"value": 10.0, "unit": "nm", "confidence": 0.5}
    header = json.loads(spark.read.text(str(tmp_path / "out" / "header")).first().value)
    assert (header["total_papers"], header["with_record"], header["schema_version"]) == (3, 2, "1.0.0")
    proof = spark.createDataFrame([("r1", "p1", "result", 0, "result.x", "quote"), ("old", "p1", "result", 0, "gone", "q")],
        "record_id string, paper_id string, kind string, ordinal int, field_name string, source_text string")
    shown = features.export_nested(papers, journals, canon, conditions, results, evidence=proof)
    assert [e.field_name for e in {r.paper_id: r for r in shown.collect()}["p1"].extraction.source_evidence] == ["result.x"]


def test_rows_of_other_records_stay_where_they_are(spark):
    from conftest import SMALL

    from foliomill.operators.filters import likely
    from workload import QUERIES

    for key in ("id", "concat('r', id)", "CAST(id AS INT)"):
        ids = spark.range(0, 100_000, 50).selectExpr(f"IF(id = 50, NULL, {key}) AS record_id")
        children = spark.range(100_000).selectExpr(f"IF(id = 7, NULL, {key}) AS record_id", "id AS n")
        kept = {r.n for r in likely(children, ids, "record_id").collect()}
        assert set(range(0, 100_000, 50)) - {50} <= kept and len(kept) < 2_100
        wider = children.withColumn("record_id", F.lit(1.0))
        assert likely(wider, ids, "record_id") is wider
    papers, shown = QUERIES["export_wide"](spark, SMALL), QUERIES["export_nested"](spark, SMALL)
    assert plan(papers).count("getbit") >= 3 and plan(shown).count("getbit") >= 2


def test_children_of_records_are_filtered_first(spark, export_tables):
    _, _, canon, conditions, _, _ = export_tables
    assert "getbit" in plan(features.of_records(conditions, canon))


@pytest.mark.parametrize("name", ["export_csv", "export_json_header", "export_json_papers"])
def test_written_exports_filter_first(spark, monkeypatch, name):
    from conftest import SMALL

    from workload import QUERIES

    seen, sink = [], "write_csv" if name == "export_csv" else "write_export_json"
    write = getattr(sinks, sink)
    monkeypatch.setattr(sinks, sink, lambda rows_, *rest: (seen.append(plan(rows_)), write(rows_, *rest)))
    QUERIES[name](spark, SMALL)
    assert seen[0].count("getbit") >= 2


def test_few_strangers_pass_a_full_filter(spark, monkeypatch):
    from foliomill.operators import filters

    # As many bits to a key as a filter of 5 million has.
    monkeypatch.setattr(filters, "FILTER_BITS", 1 << 15)
    ids = spark.range(0, 52_000, 20).selectExpr("id AS record_id")
    kept = {r.record_id for r in filters.likely(spark.range(52_000).selectExpr("id AS record_id"), ids, "record_id").collect()}
    strangers = len(kept) - 2_600
    assert set(range(0, 52_000, 20)) <= kept and strangers < 0.02 * 49_400


def test_wide_export_by_record(spark, export_tables):
    papers, journals, canon, conditions, results, materials = export_tables
    by_paper = [features.long_inputs(features.of_records(conditions, canon)), features.long_outputs(features.of_records(results, canon))]
    want = features.export_wide(papers, journals, canon, *by_paper, materials)
    # Child rows name their record only, and an old version's are among them.
    by_record = [features.long_inputs(conditions.drop("paper_id"), "record_id"), features.long_outputs(results.drop("paper_id"), "record_id")]
    of_record = materials.withColumn("record_id", F.lit("r1")).drop("paper_id")
    got = features.export_wide(papers, journals, canon, *by_record, of_record, key="record_id")
    assert got.columns == want.columns and rows(got, *got.columns[:-5]) == rows(want, *want.columns[:-5])
    assert {r.paper_id: (r.material_name, set(r.other_variables or ())) for r in got.collect()} == {r.paper_id: (r.material_name, set(r.other_variables or ())) for r in want.collect()}


def test_csv_export_chooses_records_once(spark, monkeypatch):
    from conftest import SMALL

    from workload import QUERIES

    seen, write = [], sinks.write_csv
    monkeypatch.setattr(sinks, "write_csv", lambda wide, path: (seen.append(plan(wide)), write(wide, path)))
    QUERIES["export_csv"](spark, SMALL)
    assert "Window" not in seen[0] and "o_custkey" not in seen[0]


@pytest.mark.parametrize("name", ["export_json_header", "export_json_papers"])
def test_json_exports_choose_records_once(spark, monkeypatch, name):
    from conftest import SMALL

    from workload import QUERIES

    seen, write = [], sinks.write_export_json
    monkeypatch.setattr(sinks, "write_export_json", lambda nested, header, *rest: (seen.extend([plan(nested), plan(header)]), write(nested, header, *rest)))
    QUERIES[name](spark, SMALL)
    assert not any("Window" in steps or "o_custkey" in steps for steps in seen) and "FullOuter" not in seen[0]


def test_whole_records_are_chosen_by_their_ids(spark):
    """Earlier versions, papers and records without an id, equal ids of two papers, times that are missing or equal."""
    lines = [("a", "p1", 1), ("b", "p1", 2), ("c", "p1", 2), (None, "p2", 5), ("d", "p2", 4), ("e", None, 1), ("f", None, 3), ("b", "p3", 7),
        ("g", "p3", None), ("h", "p4", None), ("i", "p4", None), (None, "p5", None), ("a", "p5", None)]
    for kind in ("string", "int", "double"):
        cast = (lambda r: r) if kind == "string" else (lambda r: None if r is None else type(1.0 if kind == "double" else 1)(ord(r)))
        versions = spark.createDataFrame([(cast(r), p, at, f"{r}{p}") for r, p, at in lines], f"record_id {kind}, paper_id string, created_at int, raw_response string")
        for newest in (None, ["created_at", "raw_response"]):
            columns = versions.columns
            assert rows(records.canonical_whole(versions, newest=newest), *columns) == rows(records.canonical(versions, newest=newest), *columns)
        assert records.canonical_whole(versions.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["export_json_header", "export_json_papers"])
def test_json_exports_leave_answers_of_earlier_versions(spark, monkeypatch, name):
    from conftest import SMALL

    from workload import QUERIES, feature_queries

    kept, store = {}, feature_queries.stored
    monkeypatch.setattr(feature_queries, "stored", lambda df, kind: (kept.update({kind: plan(df)}), store(df, kind))[1])
    QUERIES[name](spark, SMALL)
    # Answers are read where the filter of chosen ids stands, and nowhere else; journals are known before papers are moved.
    assert "getbit" in kept["records"] and "journals" in kept
    scans = [line for line in kept["records"].splitlines() if "FileScan" in line]
    assert sorted("o_totalprice" in scan for scan in scans) == [False, True]


def test_nested_export_takes_children_by_record(spark, export_tables):
    papers, journals, canon, conditions, results, _ = export_tables
    want = features.export_nested(papers, journals, canon, conditions, results)
    got = features.export_nested(papers, journals, canon, conditions.drop("paper_id"), results.drop("paper_id"))
    assert {r.paper_id: r.asDict(True) for r in got.collect()} == {r.paper_id: r.asDict(True) for r in want.collect()}
    first = {r.paper_id: r for r in got.collect()}["p1"].extraction.bo_ready
    assert set(first.X) == {"Film Thickness", "Gas"} and set(first.y) == {"TMR ratio"}


def test_last_value_with_one_hot_paper(spark):
    long = spark.range(6000).selectExpr("IF(id % 3 = 0, 'hot', concat('p', id % 50)) AS paper_id", "concat('n', id % 13) AS name", "id AS value", "(id * 7919) % 6000 AS ordinal")
    want = {}
    for r in long.collect():
        want[r.paper_id, r.name] = max(want.get((r.paper_id, r.name), (-1, 0)), (r.ordinal, r.value))
    last = features.last_values(long, ["value"])
    assert {(r.paper_id, r.name): r.value for r in last.collect()} == {k: v[1] for k, v in want.items()}
    assert "partial_max_by" in plan(last)


def test_raw_answers(spark):
    prompts = inference.build_prompt(spark.createDataFrame([("p", 0, "a {paper_text} $1 \\"), ("p", 1, "b")], "paper_id string, chunk_no int, chunk string"), "<{paper_text}>")
    assert [r.prompt for r in prompts.orderBy("chunk_no").collect()] == ["<a {paper_text} $1 \\>", "<b>"]
    hashes = {r.chunk_no: r.prompt_hash for r in prompts.collect()}
    log = [(0, "late", None, None, 3), (0, None, "timeout", "retryable", 9), (0, "early", None, None, 1), (1, None, "timeout", "retryable", 1)]
    raw = spark.createDataFrame([("p", n, hashes[n], *rest) for n, *rest in log], "paper_id string, chunk_no int, prompt_hash string, response string, error string, error_class string, called_at int")
    assert rows(inference.latest_responses(raw), "chunk_no", "response") == [(0, "late"), (1, None)]
    assert rows(inference.pending(prompts, raw), "chunk_no") == [(1,)]
    errors = spark.createDataFrame([("Authentication failed",), ("no API_KEY",), ("rate limit",), (None,)], "e string")
    assert [r[0] for r in errors.select(inference.classify_error(F.col("e"))).collect()] == ["final", "final", "retryable", None]
