import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from foliomill.llm.common import utf8
from foliomill.llm.op12_collocations import TWIN, collocations, occurrences, op12_collocations, packed, phrases, unpacked

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, words int"


def counts_of(rows, most):
    total, found = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    found[lang][tuple(words[i : i + k])] += 1
    return total, found


def brute(rows, least, most, top, covered=50):
    total, found = counts_of(rows, most)
    out = set()
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * candidates[q] >= covered * a for q in inside):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, total[lang], -score))
    return out


def texts(seed, count):
    rng = random.Random(seed)
    words = ["ab", "Ab", "cé", "Éf", "日", "x\x00y", "a-b", "\xa0", "i'm", "q", "rr", "ss"]
    signs = [" "] * 9 + ["  ", "\t", ". ", "\n", ",", "\x0b", " ! "]
    for _ in range(count):
        yield "".join(rng.choice(words[: rng.choice([4, 12])]) + rng.choice(signs) for _ in range(rng.randrange(60)))


def test_all_phrases(spark):
    rng = random.Random(1)
    rows = [(t, rng.choice(["en", "en", "en", "de", None, "und"])) for t in texts(2, 150)] + [(None, "en"), ("", "fr"), (". ,", "fr")]
    rows += [("One hot line here.", "en")] * 200
    df = spark.createDataFrame([(None, t, g, "s", 1) for t, g in rows], SCHEMA)
    for block, most, least in ((500, 4, 3), (1 << 20, 3, 10)):
        found, n = phrases(df, min_count=least, max_words=most, block=block, part_bytes=4096)
        total, want = counts_of(rows, most)
        got = {(r.lang, tuple(r.words)): r.f for r in found.collect()}
        assert got == {(g, p): a for g, f in want.items() for p, a in f.items() if a >= least}
        assert {r.lang: r.n for r in n.collect()} == {g: x for g, x in total.items() if x}
        for top in (5, None):
            rows_ = collocations(df, min_count=least, max_words=most, top=top, block=block).collect()
            assert len(rows_) == len(set(rows_)) and set(map(tuple, rows_)) == brute(rows, least, most, top)


def test_empty_and_rare(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en", "", 0), (2, None, None, "", 0)], SCHEMA)).count() == 0


def test_products_beyond_64_bits(spark):
    n = 3_100_000
    df = spark.createDataFrame([(1, "a b " * n, "en", "", 0)], SCHEMA)
    row = collocations(df, max_words=2, block=1 << 16).where("phrase = 'a b'").first()
    assert tuple(row) == ("en", 1, "a b", n, n, n, 2 * n, 10**6)


def test_places():
    words, places = occurrences(*utf8(pa.array(["A b.c", None, "d", "e  f", ",", "g"])))
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert places.tolist() == [0, 1, 3, 5, 7, 8, 10]
    values = np.array([0, -1, 2**62, 5])
    assert unpacked(packed(values)).tolist() == values.tolist() and not len(unpacked(packed(values[:0])))


def test_given_table(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = sorted(map(tuple, op12_collocations(spark, SMALL).collect()))
    assert got and got == sorted(con.sql(TWIN).fetchall())
