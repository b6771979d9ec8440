import numpy as np

from foliomill.llm.op01_language_id import Bundler, identify, op1_language_id, prototypes, train

SMALL = "/root/testdata/sf0.01"


def test_vectors_are_bound_from_permuted_letters():
    import pyarrow as pa

    bundler = Bundler(256)
    a, b, space = bundler.letters(np.array([97, 98, 32]))
    got, total = bundler.bundles(pa.array(["AB", "b1", None, "ab, ab", ""]))
    first = np.roll(space, 2) * np.roll(a, 1) * b
    second = np.roll(a, 2) * np.roll(b, 1) * space
    assert np.array_equal(got[0], first + second) and np.array_equal(got[3], 2 * got[0])
    assert np.array_equal(got[1], np.roll(space, 2) * np.roll(b, 1) * space)
    assert total.tolist() == [2, 1, 0, 4, 0] and not got[2].any()


def test_large_alphabets(spark):
    import pyarrow as pa

    bundler = Bundler(128)
    texts = ["".join(chr(0x4E00 + (i * 37 + j) % 9000) for j in range(4000)) for i in range(3)] + ["ab"]
    together, _ = bundler.bundles(pa.array(texts), rows=2)
    for i, text in enumerate(texts):
        assert np.array_equal(together[i], bundler.bundles(pa.array([text]))[0][0])


def test_predictions(docs_of):
    rows = [(i, t, x, 9.0) for i, (t, x) in enumerate([("the house is with the", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("123", "de"), ("und der", None)])]
    docs = docs_of(rows, ", lang string, Score double")
    model = prototypes(train(docs))
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "de"]
    assert got[2].score == got[3].score == 0 and 0 < got[4].score < 1 and got[0].score > 0.99
    assert identify(docs, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    nothing = identify(docs, prototypes(train(docs.limit(0)))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op1_language_id(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    tested = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(tested) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
