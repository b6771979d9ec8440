from foliomill.operators import dedup


def test_files_without_a_hash_all_stay(spark):
    rows = [("a", "h1"), ("b", "h1"), ("c", None), ("d", None), ("e", "h2")]
    files = spark.createDataFrame(rows, "path string, file_hash string")
    assert sorted(r.path for r in dedup.dedup_batch(files).collect()) == ["a", "c", "d", "e"]
