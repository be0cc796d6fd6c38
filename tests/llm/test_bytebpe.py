import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from demandlake.llm import bytebpe, merging
from demandlake.llm.queries import RANKS_FILE, op13_byte_bpe

SF = "/root/testdata/sf0.001"
LETTERS = list("abst mdrevl'  \t\n\r  　\x85 19٣é日本😀!?_-.\x00́ͅ")


@pytest.fixture(scope="module")
def vocab():
    return bytebpe.ByteVocabulary(RANKS_FILE)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def packed(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def random_texts(n, lengths, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.choice(lengths))) for _ in range(n)]


def test_boundaries_are_those_of_the_pattern(vocab):
    assert public_tokenizers.PATTERN == bytebpe.SPLIT
    pattern = regex.compile(bytebpe.SPLIT)
    for text in random_texts(300, [1, 2, 3, 8, 40, 400], 1):
        if any(ord(c) in (0x345,) for c in text):
            continue  # classes of marks differ between Unicode versions
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        assert vocab.token_starts(codes, np.zeros(0, np.int64)).tolist() == [m.start() for m in pattern.finditer(text)]


def test_scan_in_chunks_carries_the_state(vocab, monkeypatch):
    texts = random_texts(60, [0, 1, 5, 200], 2)
    whole = vocab.encode(texts)
    monkeypatch.setattr(bytebpe, "CHUNK", 7)
    assert vocab.encode(texts) == whole


def test_prefix_scan_equals_a_walk(vocab):
    auto = vocab.automaton
    f = np.random.default_rng(0).integers(0, auto.size, 5000)
    prefix, total = auto.before(f, 16)
    held = 0
    for p, x in zip(prefix.tolist(), f.tolist()):
        assert p == held
        held = int(auto.times[held * auto.size + x])
    assert total == held


def test_ids_and_bytes_equal_the_library(vocab, library):
    texts = random_texts(200, [0, 1, 2, 30, 300, 3000], 3) + ["a" * 5000, " " * 3000 + "x", "ab" * 200 + "'ll" * 50, "\n\n\n"]
    got = vocab.encode(texts)
    assert got == [packed(library, t) for t in texts]
    for text, own in zip(texts, got):
        ids = np.frombuffer(own, "<u4").astype(np.int64)
        ends = vocab.ends(ids)
        assert vocab.decode(ids, ends) == text.encode("utf-8")
        assert (ends[-1] if len(ends) else 0) == len(text.encode("utf-8"))


def test_forgetting_slices_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMORY", 20)
    vocab = bytebpe.ByteVocabulary(RANKS_FILE)
    texts = random_texts(200, [30, 300], 4)
    for i in range(0, 200, 10):
        assert vocab.encode(texts[i:i + 10]) == [packed(library, t) for t in texts[i:i + 10]]


def test_rounds_equal_the_heap():
    rng = np.random.default_rng(5)
    left, right = np.divmod(rng.choice(40 * 40, 500, replace=False), 40)
    place = rng.integers(0, 60, 500)     # many equal places: the leftmost pair goes first
    table = merging.PairTable(left, right, place, rng.integers(0, 40, 500))
    strings = [rng.integers(0, 40, n).tolist() for n in rng.integers(1, 100, 400)]
    flat = np.concatenate([np.array(s) for s in strings])
    for numbers, rows in table.merge_all(flat, np.array([len(s) for s in strings])):
        for i, row in zip(numbers.tolist(), rows.tolist()):
            assert row == table.merge_one(strings[i])


def test_query_on_whole_texts(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op13_byte_bpe(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = packed(library, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library):
    long = "Über 12 cats' don't\n" * 60_000
    rows = [(1, None, "x", 5), (2, "", "y", 5), (3, "it's", None, None), (3, "it's", None, None), (None, "a  b", "z", 1), (4, long, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")
    out = bytebpe.encode_decode(docs, RANKS_FILE)
    assert out.columns == ["doc_id", "n_tokens", "ids_u32le", "ends", "decoded"]
    got = out.collect()
    assert sorted((r.doc_id or 0, len(r.decoded)) for r in got) == sorted((r[0] or 0, len((r[1] or "").encode())) for r in rows)
    for r in got:
        text = next(t or "" for i, t, *_ in rows if i == r.doc_id)
        assert r.ids_u32le == packed(library, text) and r.decoded == text.encode()
        assert r.n_tokens == len(r.ends) and (not r.ends or r.ends[-1] == len(text.encode()))
    assert out.where("doc_id = 1").first().n_tokens == 0
    assert bytebpe.encode_decode(docs.limit(0), RANKS_FILE).count() == 0
