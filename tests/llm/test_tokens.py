import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliomill.llm.op05_token_counts import count_tokens, op5_token_counts
from foliomill.llm.op10_packing import WINDOW, op10_packing, pack
from foliomill.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoder(**more):
    paths = [public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken")]
    return Encoder(*paths, public_tokenizers.PATTERN, **more)


ODD = [
    "", " ", "   ", "a", " a  b   c ", "x\n\n  y \n z\t \t w", "it's we're I'LL don't 's", "<|endoftext|>", "a<|endoftext|> b <|endo ftext|>",
    "日本語 テキスト と ½ ² Ⅷ x²", "naïve café ñ ß", "\x1c \x1d\x1e a\x85b\xa0c  d　e", "tabs\t a \t\tb", "é é", "🙂🙂 🙂", "x" * 3000,
    "   a", "a  b", "a \x1fb", "1234 567 8,9.10", "end ", "end \n", "\n start",
]


def test_ids_are_those_of_the_library():
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder().encode(ODD)] == [ids_of(t) for t in ODD]


def test_random_texts_in_tiny_chunks():
    rng, signs = random.Random(5), " \n\t.'a1éß日<|endoftext|> \x1c🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += [" ".join("".join(rng.choice("abcé,") for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(30)]
    for chunk, overlap in ((40, 4), (64, 16), (1 << 16, 1 << 10)):
        got = encoder(chunk=chunk, overlap=overlap).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t) for t in texts]


def test_counts(docs_of):
    rows = [(i, t, 7) for i, t in enumerate(ODD)] + [(None, None, 1), (3, "a", 1), (3, "a", 1)]
    got = count_tokens(docs_of(rows, ", n_tokens int"), chunk=64, overlap=8)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    want = [(i, t, len((t or "").encode()), len(ids_of(t))) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert count_tokens(docs_of([])).count() == 0


def test_count_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op5_token_counts(spark, SMALL).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        i: (len((t or "").encode()), n := len(ids_of(t)), n > 512) for i, t in docs.items()
    }


def check_packed(rows, docs, window):
    """Each id lies in one piece, sequences have no gap and are full or a power of two long."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids, at = [*ids_of(text), 0], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part), len(ids)) and r.length
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0 and at < window


@pytest.mark.parametrize("window,flush", [(16, 20_000), (64, 3), (100, 5)])
def test_packing(docs_of, window, flush):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choice(["the", "of", "onti"]) for _ in range(rng.randrange(200))) for i in range(60)} | {60: None, 61: ""}
    packed = pack(docs_of([(i, t, 1) for i, t in docs.items()], ", length int").repartition(3), window=window, flush=flush)
    rows = packed.collect()
    check_packed(rows, docs, window)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert pack(docs_of([])).count() == 0
    twice = pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert sorted(str(r.doc_id) for r in twice) in (["1", "1", "None"], ["1", "1", "1", "None"], ["1", "1", "1", "1", "None"])


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_packed(op10_packing(spark, SMALL).collect(), docs, WINDOW)
