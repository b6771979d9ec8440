import hashlib
import random
import re

from foliomill.llm.op03_decontamination import find_items, op3_decontamination

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    """Per document: words, hit words, items."""
    patterns = {}
    for item_id, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n and item_id is not None else 0):
            patterns.setdefault(tuple(words[i : i + n]), set()).add(str(item_id))
    sizes, out = {len(p) for p in patterns}, []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (p := tuple(words[i : i + n])) in patterns:
                    hit.update(range(i, i + n))
                    found |= patterns[p]
        out.append((doc_id, len(words), sorted(hit), sorted(found)))
    return out


def plain(df):
    return sorted(
        ((r.doc_id, r.n_words, [i for s in r.hit_spans for i in range(s.first, s.last + 1)], r["items"]) for r in df.collect()), key=repr
    )


def test_random_texts(docs_of, spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["a", "B", "é", "日", "c1"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 7, 12]))) for i in range(8)] + [(3, "b a b"), (None, "a"), (99, None)]
    docs = [(i, text(rng.randrange(700)), "x") for i in range(40)] + [(None, "A b", "y"), (7, None, "z"), (7, "", "z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4, 10):
        want = sorted(brute([d[:2] for d in docs], items, size), key=repr)
        for limit in (1 << 20, 60):
            got = find_items(docs_of(docs, ", items string"), bench, size=size, pattern_bytes=limit)
            assert got.columns == ["doc_id", "text", "n_words", "items", "hit_spans"]
            assert plain(got) == want
    none = find_items(docs_of(docs, ", items string"), bench.limit(0))
    assert plain(none) == sorted(brute([d[:2] for d in docs], []), key=repr)
    assert find_items(docs_of([]), bench).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    want = {
        d: (n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)) for d, n, hit, found in brute(docs, items)
    }
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op3_decontamination(spark, SMALL).collect()}
    assert got == want and any(x[4] for x in got.values())
