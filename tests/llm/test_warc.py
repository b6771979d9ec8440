import hashlib

from foliomill.llm.op04_warc import BREAK, END, MAGIC, op4_warc, read_archives, write_archives

SMALL = "/root/testdata/sf0.01"


def brute(rows):
    first = {}
    for i, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        again = html in first and len(data) >= 100 and first[html] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip_with_traps(spark, tmp_path):
    trap = BREAK + "WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    rows = [(i, f"page {i} é\r\n\r\n" * (i * 7)) for i in range(60)]
    rows += [(100, trap), (101, "x" * 200 + trap + BREAK), (102, MAGIC), (103, BREAK * 30), (104, None), (105, ""), (106, END), (107, "\r\n"), (108, trap * 40)]
    # A record in a payload that ends where the payload does leads to a true record.
    rows += [(109, "a" + BREAK + "Content-Length: 5\r\n\r\nabcde"), (200, rows[20][1]), (201, rows[20][1]), (None, rows[20][1]), (20, rows[20][1]), (202, trap * 40), (203, "short"), (204, "short")]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, 1) for i, h in rows], "page_id long, url string, html string, digest int")
    for number, (split, files) in enumerate([("128m", 3), ("700b", 3), ("5k", 1)]):
        path = str(tmp_path / str(number))
        write_archives(pages.repartition(files), path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        try:
            got = read_archives(spark, path, bucket=512)
            assert plain(got) == brute(rows)
            assert {r.target_uri for r in got.collect()} == {f"http://h/{i}%0D%0AX: y" for i, _ in rows}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_that_break_off(spark, tmp_path):
    record = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n{}" + END
    good = record.format(1, 15, "HTTP/1.1 200" + "\r\n\r")
    (tmp_path / "a.txt").write_bytes((good + record.format(2, 999, "cut")).encode())
    (tmp_path / "b.txt").write_bytes(("junk" + good).encode())
    (tmp_path / "c.txt").write_bytes(b"")
    assert [r.page_id for r in read_archives(spark, str(tmp_path)).collect()] == [1]


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "x"))
    assert read_archives(spark, str(tmp_path / "x")).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()]
    assert plain(op4_warc(spark, SMALL)) == brute(rows)
