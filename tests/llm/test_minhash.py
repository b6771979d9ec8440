import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from foliomill.llm.common import utf8
from foliomill.llm.op02_minhash_dedup import elements, near_duplicates, op2_minhash_dedup, signatures, word_keys
from foliomill.llm.words import split_words
from .test_decontamination import words_of

SMALL = "/root/testdata/sf0.01"


def shingles(text):
    words = words_of(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similar(a, b):
    return bool(a) and 5 * (a & b).total() >= 4 * (a | b).total()


def brute(rows):
    """By id: class, links; pairs are looked for among documents that share a shingle."""
    known, holders = {i: shingles(t) for i, t in rows}, defaultdict(list)
    for i, found in known.items():
        for s in found:
            holders[s].append(i)
    links = defaultdict(set)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if similar(known[a], known[b]):
            links[a].add(b)
            links[b].add(a)
    out = {}
    for i in sorted(known):
        if i in out:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out |= {j: (i, len(links[j]), i == j) for j in seen}
    return out


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(2)
    base = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(400)]
    other = base[:300] + [rng.choice("klmn") for _ in range(100)]
    texts = [" ".join(base), " ".join(other), " ".join(base[:60]), "one two", "", "r " * 900, "r " * 700]
    cells, doc = elements(split_words(*utf8(pa.array(texts))))
    darts = signatures(cells, doc, len(texts), 4000)
    for a, b in ((0, 1), (0, 2), (5, 6), (3, 4)):
        x, y = shingles(texts[a]), shingles(texts[b])
        assert abs((darts[a] == darts[b]).mean() - (x & y).total() / (x | y).total()) < 0.035
    # Every document is hashed alike whatever stands beside it.
    cells, doc = elements(split_words(*utf8(pa.array(texts[2:4]))))
    assert np.array_equal(signatures(cells, doc, 2, 4000), darts[2:4])


def test_cases(docs_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    cloud = []
    for i in range(150):  # more than a block
        text = list(base)
        text[rng.randrange(150)] = word()
        cloud.append((1000 - i, " ".join(text)))
    rows = cloud + [(5, "One two"), (6, "one, TWO"), (7, "two one"), (8, None), (9, ""), (10, "..."), (11, "one two three")]
    rows += [(2000 + i, " ".join(word() for _ in range(40))) for i in range(30)] + [(3000, "x " * 20_000)]
    got = near_duplicates(docs_of([(*r, "c") for r in rows], ", class_id string"))
    assert got.columns == ["doc_id", "class_id", "n_links", "kept"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == brute(rows)
    odd = near_duplicates(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A b c")])).collect()
    assert sorted(map(str, map(tuple, odd))) == ["(1, 1, 2, True)", "(1, 1, 2, True)", "(2, 1, 2, False)", "(None, None, 0, True)"]
    assert near_duplicates(docs_of([])).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in op2_minhash_dedup(spark, SMALL).collect()} == brute(rows)


def test_equal_words_have_one_key_wherever_they_stand():
    rows = ["fgaa ccbb gbad", "x y z", "Fgaa, ccbb gbad\n", "", None]
    keys = word_keys(split_words(*utf8(pa.array(rows)))).to_pylist()
    assert keys[0] == keys[2] != keys[1] and keys[3] is keys[4] is None
