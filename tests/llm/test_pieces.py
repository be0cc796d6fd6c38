import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from demandlake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab c\n\t▁é😀\x00ßth '\".,<s>12 　\r"


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(MODEL)


def texts(n, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_ids_and_round_trip_equal_the_library(vocab):
    many = texts(3000, 40) + ["x" * 5000, "é" * 400 + " " * 300 + "ab" * 400, "", " ", "▁", "\n\n"]
    packed = vocab.encode(many)
    pieces.check_texts(vocab, many, packed, vocab.decode(packed))
    for t, p in zip(many, packed):
        assert vocab.encode([t]) == [p] and vocab.decode([p]) == [vocab.model.decode(np.frombuffer(p, "<u4").tolist())]
    assert vocab.encode([]) == [] and vocab.decode([]) == []


def test_ids_that_no_text_gives_decode_like_the_library(vocab):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.choice([0, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(1, 12))]
        assert vocab.decode([np.array(ids, "<u4").tobytes()]) == [vocab.model.decode(ids)]


def test_long_parts_use_the_same_order_as_short_ones(vocab):
    parts = [t for t in texts(300, 46, seed=5) if t]
    merged = vocab.merge(parts)
    for t in parts:
        symbols = vocab.pairs.merge_one(vocab.character[[ord(c) for c in t]].tolist())
        ids = [x for s in symbols for x in ([s] if s < vocab.size else vocab._fallback(chr(s - vocab.size)))]
        assert merged[t] == np.array(ids, "<u4").tobytes()


def test_parts_are_checked(vocab):
    vocab.fresh.clear()
    pieces.check_parts(vocab)
    vocab.fresh["▁hello"] = vocab.merge(["▁world"])["▁world"]
    with pytest.raises(ValueError):
        pieces.check_parts(vocab)
    right = vocab.encode(["hello"])
    with pytest.raises(ValueError):
        pieces.check_texts(vocab, ["hullo"], right, ["hullo"])
    with pytest.raises(ValueError):
        pieces.check_texts(vocab, ["hello"], right, ["hullo"])


def test_forgetting_parts_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 10)
    small = pieces.MergeVocabulary(MODEL)
    many = texts(200, 60, seed=7)
    for i in range(0, 200, 20):
        packed = small.encode(many[i:i + 20])
        pieces.check_texts(small, many[i:i + 20], packed, small.decode(packed))


@pytest.mark.parametrize("check", ["parts", "texts"])
def test_table_with_nulls_empties_repeats_and_clashing_columns(spark, check):
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "hello  world", None, 5), (3, "hello  world", None, 5), (None, "é😀\n", "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, n_tokens int")
    out = pieces.encode_decode(docs, MODEL, check=check)
    assert out.columns == ["doc_id", "extra", "n_tokens", "ids_u32le", "decoded"]
    got = out.collect()
    assert len(got) == 5
    lib = pieces.vocabulary(MODEL).model
    for r, (_, text, _, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.decoded)), rows):
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids_u32le), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == lib.decode(ids)
    assert pieces.encode_decode(docs.limit(0), MODEL).count() == 0


def test_query_against_the_library(spark):
    from demandlake.llm.queries import op8_sentencepiece
    got = {r.doc_id: r for r in op8_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    lib = pieces.vocabulary(MODEL).model
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_bos=True, add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_a_small_memory_gives_the_same_ids_and_is_kept():
    import public_tokenizers
    texts = [" ".join(f"wörd{i * 7 + k}x" for k in range(40)) for i in range(60)]
    model = public_tokenizers.path("piece_bpe_32k.model")
    small, large = pieces.MergeVocabulary(model, 500), pieces.MergeVocabulary(model)
    for a, b in pieces._parts([len(t) for t in texts], 2000):
        assert b - a <= 8
        assert small.encode(texts[a:b]) == large.encode(texts[a:b])
        assert max(len(small.known), len(small.older)) <= len(small.whole) + 500
