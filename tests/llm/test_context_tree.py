import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foliomill.llm import op06_context_tree as tree
from foliomill.llm.op06_context_tree import DEPTH, op6_context_tree, score

SMALL = "/root/testdata/sf0.001"


def normal(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return words, (" ".join(words) + "\n").encode()


def bits(data):
    """Context (most recent byte last), place in the byte's tree, bit."""
    data = b"\0" * DEPTH + data
    for i in range(DEPTH, len(data)):
        for k in range(8):
            yield data[i - DEPTH : i], 1 << k | data[i] >> (8 - k), data[i] >> (7 - k) & 1


def brute(rows, parts):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % parts == 0
    counts = defaultdict(lambda: [0, 0])
    tokens = Counter()
    for i, text in rows:
        if not held(i):
            words, data = normal(text)
            tokens.update([*words, None])
            for context, place, bit in bits(data):
                for depth in range(DEPTH + 1):
                    counts[context[DEPTH - depth :], place][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    logs, longer = {}, defaultdict(float)
    for depth in range(DEPTH, -1, -1):
        for key in [k for k in counts if len(k[0]) == depth]:
            own = kt(*counts[key])
            if depth < DEPTH:
                a, b = max(own, longer[key]), min(own, longer[key])
                logs[key] = a + math.log1p(math.exp(b - a)) - math.log(2)
            else:
                logs[key] = own
            longer[key[0][1:], key[1]] += logs[key] if depth else 0

    def told(context, place, bit, depth=0):
        key = (context[DEPTH - depth :], place)
        a, b = counts.get(key, (0, 0))
        own = ((a, b)[bit] + 0.5) / (a + b + 1)
        if depth == DEPTH:
            return own
        trust = math.exp(kt(a, b) - math.log(2) - logs.get(key, 0.0))
        return trust * own + (1 - trust) * told(context, place, bit, depth + 1)

    n, v, out = tokens.total(), len(tokens), []
    for i, text in rows:
        words, data = normal(text)
        every = [*words, None]
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in every)
        out.append((i, held(i), len(every), sum(tokens[w] > 0 for w in every), n, base, sum(math.log10(told(*x)) for x in bits(data)), len(data)))
    return out


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.n_bytes) for r in got), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("entries", [8_000_000, 40])
def test_against_brute_force(docs_of, entries):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("aB é日cc  \n\t\x0b") for _ in range(n))
    rows = [(i, text(rng.randrange(90))) for i in range(40)] + [(100, None), (101, ""), (102, " \n"), (None, "a b"), (3, "a b"), (200, "x" * 3000)]
    rows += [rows[5], rows[5]]
    got = score(docs_of([(*r, 1.0) for r in rows], ", score double").repartition(3), parts=3, pass_entries=entries)
    same(got.collect(), brute(rows, 3))


def test_edges(docs_of):
    assert score(docs_of([])).count() == 0
    untaught = [(4, "a b")] if zlib.crc32(b"4") % 1 == 0 else []
    same(score(docs_of(untaught), parts=1).collect(), [(4, True, 3, 0, 0, 3 * math.log10(0.1 / 0.1), 4 * 8 * math.log10(0.5), 4)])


def test_query(spark):
    rows = op6_context_tree(spark, SMALL).collect()
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 10 and all(r.score < 0 for r in rows)
    # The tree has learned from 200 documents only; their words' entropy is about two bits a byte.
    assert sum(r.score for r in unseen) / sum(r.n_bytes for r in unseen) * -math.log2(10) < 3


def test_grams_are_handed_on_beyond_a_bound(monkeypatch):
    """Few or many are held: the same sums, and never much more than the bound between two slices."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(30)]

    def sums(bound):
        monkeypatch.setattr(tree, "HELD", bound)
        monkeypatch.setattr(tree, "pieces", lambda batches, _: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], names=["text", "train"])
        total, sizes = Counter(), []
        for out in tree.counted(iter([batch])):
            found = [(tree.unpacked(k, np.uint64), tree.unpacked(m, np.int64)) for k, m in zip(out.column("keys").to_pylist(), out.column("many").to_pylist())]
            sizes.append(sum(len(k) for k, _ in found))
            for keys, many in found:
                total.update(dict(zip(keys.tolist(), many.tolist())))
        return total, sizes

    whole, sizes = sums(10**9)
    assert len(sizes) == 1 and whole.total() > 100_000
    parts, sizes = sums(20_000)
    assert parts == whole and len(sizes) > 3 and max(sizes) < 30_000
