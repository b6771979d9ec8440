import hashlib
import random

import numpy as np

from foliomill.llm.op09_substring_dedup import LENGTH, RunLengthIndex, op9_substring_dedup, removed_runs, repeats, row_name, stretches, without

SMALL = "/root/testdata/sf0.01"


def brute(rows):
    """By row: bytes, removed, runs, hash of the rest."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for p in range(len(data) - LENGTH + 1):
                s = data[p : p + LENGTH]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - LENGTH + 1) if i is not None else ():
            if first[data[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_index_against_brute_force():
    rng = np.random.default_rng(2)
    for letters, length in ((2, 6), (3, 50), (200, 4)):
        sizes = rng.integers(1, 90, 40)
        data = rng.integers(0, letters, int(sizes.sum())).astype(np.uint8)
        data[200:300] = data[700:800] = data[0:100]
        index = RunLengthIndex(data, sizes, length)
        doc = np.repeat(rng.permutation(40), sizes + 1)
        got, texts, at = index.earliest(doc), np.split(data, np.cumsum(sizes)[:-1]), np.cumsum(sizes + 1) - sizes - 1
        seen = {}
        for k, text in enumerate(texts):
            for p in range(len(text) - length + 1):
                seen.setdefault(text[p : p + length].tobytes(), []).append(doc[at[k]])
        for k, text in enumerate(texts):
            for p in range(len(text) - length + 1):
                assert got[at[k] + p] == min(seen[text[p : p + length].tobytes()])
        assert len(index.run_starts) <= len(index.text)


def test_stretches_cover_every_string_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[500:900] = 97
    offsets = np.array([0, 0, 49, 99, 1500, 3000])
    low, start, many, text = stretches(data, offsets)
    places = [p for s, m in zip(start, many) for p in range(s, s + m)]
    assert places == [p for a, b in zip(offsets[:-1], offsets[1:]) for p in range(a, b - LENGTH + 1)]
    by_string = {}
    for v, s, m in zip(low, start, many):
        for p in range(s, s + m):
            assert by_string.setdefault(data[p : p + LENGTH].tobytes(), v) == v


def test_cases(docs_of):
    rng = random.Random(6)
    letters = "abcdeé日 "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (30, 49, 55, 80, 200)]
    rows = [(i, text(rng.randrange(120)) + rng.choice(passages) + text(rng.randrange(120)) + rng.choice(passages)) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(5)] + [(300, None), (301, ""), (302, "a" * 49), (303, "a" * 50), (304, "a" * 5000), (305, "ab" * 3000)]
    rows += [(306, "ab" * 25), (None, rows[3][1]), (7, rows[7][1]), (8, rows[9][1]), (-5, rows[2][1][:90])]
    got = repeats(docs_of([(*r, 1) for r in rows], ", n_bytes int").repartition(4))
    want = brute(rows)
    assert plain(got) == [w[:5] for w in want]
    for r in got.where("kept is not null").collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        pairs = np.frombuffer(r.runs, "<u4").reshape(-1, 2)
        assert int((pairs[:, 1] - pairs[:, 0]).sum()) == r.n_removed and len(pairs) == r.n_spans
    given = docs_of([(*r, 1) for r in rows], ", n_bytes int").repartition(4)
    named = given.withColumn("node", row_name("text", "doc_id")).join(removed_runs(given), "node", "left").collect()
    left = [(r.doc_id, (r.text or "").encode() if r.runs is None else without((r.text or "").encode(), r.runs)) for r in named]
    assert sorted(left, key=repr) == sorted([(w[0], w[5]) for w in want], key=repr)
    assert removed_runs(docs_of([])).count() == 0
    assert repeats(docs_of([])).count() == 0
    assert plain(repeats(docs_of([(1, "b" * 70)]))) == [w[:5] for w in brute([(1, "b" * 70)])]


def test_many_parts(docs_of, monkeypatch):
    monkeypatch.setattr("foliomill.llm.op09_substring_dedup.PART_BYTES", 2000)
    monkeypatch.setattr("foliomill.llm.op09_substring_dedup.DEAL_BYTES", 4000)
    monkeypatch.setattr("foliomill.llm.op09_substring_dedup.INDEX_BYTES", 1000)
    test_cases(docs_of)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(op9_substring_dedup(spark, SMALL)) == [w[:5] for w in brute(rows)]
