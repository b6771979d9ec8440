import random

import corpus_pipeline
from .test_decontamination import brute as benchmark_hits
from .test_minhash import brute as classes
from .test_repeats import brute as removed
from .test_tokens import check_packed

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    known = classes(rows)
    rows = [(i, t) for i, t in rows if known[i][2]]
    texts = {i: kept.decode("utf-8", "ignore") for i, _, n, _, _, kept in removed(rows)}
    rows = [(i, texts[i]) for i, t in rows if texts[i].strip() or texts[i] == t]
    hit = {i for i, _, words, _ in benchmark_hits(rows, items) if words}
    want = {i: t for i, t in rows if i not in hit}
    assert hit and 0 < len(want) < docs.count()
    check_packed(corpus_pipeline.run(spark, SMALL).collect(), want, 1024)


def test_stages_keep_columns_and_bear_odd_rows(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    rows = [(i, text(60), "en", "s", 5, 1.5, "k") for i in range(12)]
    rows += [(20, None, None, None, None, None, None), (21, "", "en", "s", 0, 0.0, ""), (22, "12 34", "de", "s", 5, 1.0, "x")]
    rows += [(None, text(30), "en", "s", 1, 1.0, "x"), (30, rows[3][1], "en", "s", 5, 1.0, "x"), (4, rows[4][1], "en", "s", 5, 1.5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SMALL)
            assert frame.schema.simpleString() == docs.schema.simpleString(), name
        ids = {r.doc_id for r in frame.collect()}
        assert ids == ({*range(12), None} if frame.count() else set())
        corpus_pipeline.packing(spark, frame, SMALL).count()


def test_repeated_rows_stay_once(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    a, b, c = text(40), text(40), text(40)
    rows = [(1, a, "x")] * 5 + [(2, b, "x"), (2, c, "x"), (2, f"{b}\n", "x"), (3, a, "x"), (3, a, "x"), (None, a, "x"), (None, a, "x")]
    rows += [(4, "", "x"), (4, "", "x"), (5, None, "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4)
    got = corpus_pipeline.minhash_dedup(spark, docs, SMALL)
    assert got.columns == docs.columns
    want = [(1, a, "x"), (2, b, "x"), (2, c, "x"), (None, a, "x"), (None, a, "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (5, None, "x")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
