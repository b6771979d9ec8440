import random
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliomill.llm.op13_records import END_ID, fields_of, frame, op13_records, read_chosen, read_records, read_shuffled, serialized, write_index, write_records

SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [END_ID], "<u4").tobytes()


def rows_of(seed=1, count=400):
    rng = random.Random(seed)
    words = ["one", "two\n", "drei", "日本", "\n\n", "x" * 50, "<|endoftext|>", "é"]
    rows = [(rng.randrange(-50, 50) if rng.random() < 0.9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(80)))) for _ in range(count)]
    return rows + [(7, "the same")] * 200 + [(7, None), (7, ""), (None, None), (2**62, "far")] + [(8, "long text " * 20_000)]


def parsed(data):
    """Records of a file, read by the layout that the module states."""
    at, out = 0, []
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        crcs = struct.unpack_from("<I", data, at + 8)[0], struct.unpack_from("<I", data, at + 12 + n)[0]
        body = data[at + 12 : at + 12 + n]
        for crc, part in zip(crcs, (data[at : at + 8], body)):
            c = zlib.crc32(part)
            assert crc == ((c >> 15 | c << 17 & 0xFFFFFFFF) + 0xA282EAD8) % 2**32
        assert data[at + 16 + n : at + 17 + n] == b"\n"
        flags, id_ = struct.unpack_from("<Bq", body)
        ids = np.frombuffer(body[9:], "<u4" if flags & 2 else "<u2").astype("<u4").tobytes()
        out.append((at, n + 17, id_ if flags & 1 else None, ids))
        at += n + 17
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("records")
    rows = rows_of()
    df = spark.createDataFrame([(i, t, "f", 5) for i, t in rows], "doc_id long, text string, file string, ids int").repartition(5)
    write_records(df, str(base / "files"), file_bytes=40_000)
    return rows, str(base / "files"), write_index(spark, str(base / "files"), str(base / "index"))


def order(row):
    return row[0] is not None, row[0] or 0


def test_files_are_records_in_order(written):
    rows, path, _ = written
    files = sorted(Path(path).glob("part-*"))
    assert len(files) > 10
    records = [r[2:] for f in files for r in parsed(f.read_bytes())]
    assert [r[0] for r in records] == [i for i, _ in sorted(rows, key=order)]
    assert sorted(map(repr, records)) == sorted(repr((i, ids_of(t))) for i, t in rows)
    # A third of all rows are one row, which no single file holds.
    hot = [sum(r[2] == 7 for r in parsed(f.read_bytes())) for f in files]
    assert sum(x > 0 for x in hot) > 1


def test_reading_back(spark, written):
    rows, path, index = written
    records = {(Path(r.file).name, r.offset): (r.size, r.id, bytes(r.ids)) for r in read_records(spark, path).collect()}
    assert records == {(f.name, r[0]): r[1:] for f in Path(path).glob("part-*") for r in parsed(f.read_bytes())}
    listed = sorted(index.collect(), key=lambda r: r.start)
    at = 0
    for r in listed:
        size, id_, ids = records[Path(r.file).name, r.offset]
        assert (r.size, r.id, r.n_tokens, r.ids_crc32, r.start) == (size, id_, len(ids) // 4, zlib.crc32(ids), at)
        at += r.n_tokens
    assert [r.id for r in listed] == [i for i, _ in sorted(rows, key=order)]


def test_reading_by_the_index(spark, written):
    rows, path, index = written
    some = index.where("id % 3 = 0")
    got = read_chosen(spark, path, some.union(some.where("id = 2"))).collect()
    want = [repr((i, ids_of(t))) for i, t in rows if i is not None and i % 3 == 0]
    assert sorted(repr((r.id, bytes(r.ids))) for r in got) == sorted(want)
    first, again, other = (read_shuffled(spark, path, index, seed).collect() for seed in (1, 1, 2))
    assert first == again and [r.id for r in first] != [r.id for r in other]
    assert sorted(repr((r.id, bytes(r.ids))) for r in first) == sorted(repr((i, ids_of(t))) for i, t in rows)
    near = sum(a.file == b.file and a.offset < b.offset for a, b in zip(first, first[1:]))
    assert near < len(first) // 4


@pytest.mark.parametrize("harm", [lambda d: d[:-1], lambda d: d[: len(d) // 2], lambda d: d[:40] + bytes([d[40] ^ 1]) + d[41:], lambda d: b"\x01" + d[1:]])
def test_harmed_files_are_refused(spark, tmp_path, harm):
    good = frame(serialized(5, bytes(60))) + b"\n"
    (tmp_path / "part-00000-x-c000.txt").write_bytes(good * 3)
    assert read_records(spark, str(tmp_path)).count() == 3
    (tmp_path / "part-00000-x-c000.txt").write_bytes(harm(good * 3))
    with pytest.raises(Exception, match="CorruptRecord"):
        read_records(spark, str(tmp_path)).count()


@pytest.mark.parametrize("values", [[], [0, 65535], [65536, 1], [2**32 - 1]])
def test_ids_of_any_width(values):
    ids = np.array(values, "<u4").tobytes()
    for id_ in (None, 0, -(2**63)):
        assert fields_of("f", 3, memoryview(serialized(id_, ids)))[3:] == (id_, ids)


def test_empty_table(spark, tmp_path):
    write_records(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "files"))
    assert read_records(spark, str(tmp_path / "files")).count() == 0
    assert write_index(spark, str(tmp_path / "files"), str(tmp_path / "index")).count() == 0


def test_query(spark):
    at, want = 0, []
    for r in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = ids_of(r.text)
        want.append((r.doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(map(tuple, op13_records(spark, SMALL).collect())) == want
